"""Quality rules: counts of words, symbols and repeats, and how far a document's histograms are from those of its language.

A language's references are histograms over all its documents: of character classes, and of its common words, those with a given share of its
words, so that a language has a bounded number of them whatever the corpus. A document's distance to either is the Jensen-Shannon distance; short
texts, whose histograms are mostly chance, are not judged by it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.batches import portions
from siftwork.llm.storage import Scratch

#: A word is common in a language if it is one in so many of its words; a language has references if it has one in so many of the corpus's words.
COMMON, LANGUAGE = 500, 1000
#: Least code points for the first distance, least words for the second, and the largest distances of what is kept.
LEAST_CHARS, LEAST_WORDS = 200, 100
MOST_CHARS, MOST_WORDS = 0.3, 0.5
#: What words lose at either end before they are looked up.
MARKS = b".,;:!?\"'()"
SYMBOLS = b"#*$%&|<>"
#: Distinct words that a task holds.
HELD = 200_000
CLASSES = ("space", "lower", "upper", "digit", "mark", "other", "beyond")
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def _classes() -> np.ndarray:
    """The class of every byte of UTF-8; -1 for bytes within a character."""
    out = np.full(256, CLASSES.index("other"))
    for k, some in (("space", b" \t\n\v\f\r"), ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("mark", MARKS + b"-"), ("beyond", range(0xC0, 256))):
        out[list(some)] = CLASSES.index(k)
    out[0x80:0xC0] = -1
    return out


CLASS = _classes()


def classes(seen: np.ndarray) -> np.ndarray:
    """Code points of each class, from counts of bytes."""
    inner = CLASS >= 0
    return np.bincount(CLASS[inner], weights=seen[inner], minlength=len(CLASSES)).astype(np.int64)


def bare(text: bytes) -> Counter:
    """Words in lower case (A-Z) without marks at their ends; what is nothing but marks counts as the empty word."""
    return Counter(w.strip(MARKS) for w in text.lower().split())


def repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three words that the text has twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    _, pair = np.unique(ids[:-2] * len(numbers) + ids[1:-1], return_inverse=True)
    _, window, times = np.unique(pair * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[window] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, 0 to 1, of two histograms of counts."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        both = sum(np.where(x > 0, x * np.log2(x / m), 0).sum() for x in (p, q))
    return math.sqrt(max(both / 2, 0.0))


def references(docs: DataFrame, scratch: Scratch) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """By language: counts of classes, the places of common words, and their counts with all other words' at the end.

    From all rows of docs(lang, text) with both; at most LANGUAGE languages of at most COMMON words, since shares add up to one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(k, 0, b"%d" % i, n) for k, c in chars.items() for i, n in enumerate(c.tolist()) if n]
            rows += [(k, 1, w, n) for k, c in words.items() for w, n in c.items()]
            rows += [(k, 2, b"", c.total()) for k, c in words.items()]
            lang, kind, word, n = zip(*rows, strict=True) if rows else ((), (), (), ())
            chars.clear()
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(kind, pa.int32()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], names=["lang", "kind", "word", "n"])

        for b in portions(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                chars[lang] = chars.get(lang, 0) + classes(np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256))
                words.setdefault(lang, Counter()).update(bare(text))
            if sum(map(len, words.values())) > HELD:
                yield out()
        yield out()

    read = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = scratch.keep(read.mapInArrow(run, "lang string, kind int, word binary, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")), "words")
    totals = counts.where("kind = 2").select("lang", F.col("n").alias("total"))
    every = totals.agg(F.sum("total")).first()[0] or 0
    if not every:
        return {}
    large = F.broadcast(totals.where(F.col("total") * LANGUAGE >= every))
    rows = counts.join(large, "lang").where((F.col("kind") != 1) | (F.col("n") * COMMON >= F.col("total"))).collect()
    out = {}
    for lang in sorted({r["lang"] for r in rows}):
        own = [r for r in rows if r["lang"] == lang]
        chars = np.zeros(len(CLASSES), dtype=np.int64)
        for r in own:
            if r["kind"] == 0:
                chars[int(bytes(r["word"]))] = r["n"]
        common = sorted((bytes(r["word"]), r["n"]) for r in own if r["kind"] == 1)
        n = np.array([k for _, k in common] + [own[0]["total"] - sum(k for _, k in common)], dtype=np.int64)
        out[lang] = chars, {w: i for i, (w, _) in enumerate(common)}, n
    return out


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance for every row of docs(doc_id, text, lang).

    Words are runs without ASCII white space. base_failed: fewer than 50 words, or more than half of them in repeated windows of three. kept is false if base_failed, or if one of the distances
    to the document's language is above its limit. char_distance is null for texts of fewer than 200 code points, word_distance for fewer than 100
    words, both for documents of null language or of one with less than a thousandth of the corpus's words; what is null doesn't speak
    against a document. Whole texts are read, however long. A null text is empty. Null and repeated doc_ids are rows like others;
    other columns are ignored; without a column lang there are no distances; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    try:
        known = spark.sparkContext.broadcast(references(rows, scratch))
    finally:
        scratch.clear()

    def one(text: bytes, lang: str | None) -> tuple:
        seen = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
        by_class, words = classes(seen), text.split()
        n, chars = len(words), int(by_class.sum())
        lines = [x for x in text.split(b"\n") if x.strip()]
        again = repeated(words)
        failed = n < 50 or 100 * again > 50 * n
        away, apart = None, None
        if lang in known.value:
            of_chars, place, of_words = known.value[lang]
            if chars >= LEAST_CHARS:
                away = round(distance(by_class, of_chars), 6)
            if n >= LEAST_WORDS:
                own = np.zeros(len(of_words), dtype=np.int64)
                for w, k in bare(text).items():
                    own[place.get(w, -1)] += k
                apart = round(distance(own, of_words), 6)
        kept = not failed and (away is None or away <= MOST_CHARS) and (apart is None or apart <= MOST_WORDS)
        return n, chars - int(by_class[CLASSES.index("space")]), int(seen[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), again, failed, kept, away, apart

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        names = [c.split()[0] for c in RESULT.split(", ")]
        for b in portions(batches):
            found = [one(t or b"", k) for t, k in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in found], t) for i, t in enumerate(kinds))], names=names)

    return rows.mapInArrow(run, RESULT)


_WORD = r"[^\x20\x09-\x0D]+"
_MARKS = MARKS.decode().replace("'", "''")
#: Code points of a text by class, in the order of CLASSES.
_COUNTS = ", ".join(f"length(regexp_replace(text, '{other}', '', 'g'))" for other in (r"[^\x20\x09-\x0D]", "[^a-z]", "[^A-Z]", "[^0-9]", r"[^.,;:!?\"''()\-]", r"[\x20\x09-\x0Da-zA-Z0-9.,;:!?\"''()\-]|[^\x00-\x7F]", r"[\x00-\x7F]"))


def _distance(a: str, b: str) -> str:
    """Over lists of counts."""
    share = "list_transform({0}, lambda x: x / list_sum({0})::double)"
    term = "case when t[{0}] > 0 then t[{0}] * log2(t[{0}] / ((t[1] + t[2]) / 2)) else 0 end"
    return f"round(sqrt(greatest(0, list_sum(list_transform(list_zip({share.format(a)}, {share.format(b)}), lambda t: {term.format(1)} + {term.format(2)})) / 2)), 6)"


#: The query over the table documents, in DuckDB's SQL.
ORACLE = f"""
with d as materialized (select row_number() over () as id, doc_id, lang, coalesce(text, '') as text, text is not null as there from documents),
    c as materialized (select id, doc_id, lang, there, text, [{_COUNTS}] as k, regexp_extract_all(text, '{_WORD}') as w from d),
    w as materialized (select id, lang, unnest(w) as word, generate_subscripts(w, 1) as pos from c),
    three as (select id, pos, word || ' ' || lead(word, 1) over p || ' ' || lead(word, 2) over p as key from w window p as (partition by id order by pos)),
    twice as (select id, pos from three where key is not null qualify count(*) over (partition by id, key) > 1),
    again as (select id, count(distinct pos + k.k) as n from twice, range(3) k(k) group by id),
    bare as materialized (select id, lang, trim(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_MARKS}') as word from w),
    total as (select lang, count(*) as total from bare where lang is not null group by lang qualify {LANGUAGE} * total >= sum(total) over ()),
    common as materialized (select lang, word, count(*) as n, any_value(total) as total from bare join total using (lang) group by lang, word having {COMMON} * count(*) >= any_value(total)),
    ref as (select lang, list(n order by word) || [any_value(total) - cast(sum(n) as bigint)] as n from common group by lang),
    ref_chars as (select lang, [{", ".join(f"cast(sum(k[{i}]) as bigint)" for i in range(1, len(CLASSES) + 1))}] as k from c join total using (lang) where there group by lang),
    own as (select id, lang, word, count(b.word) as n from (select c.id, c.lang, m.word from c join common m using (lang)) m left join bare b using (id, lang, word) group by id, lang, word),
    hist as (select id, list(n order by word) || [len(any_value(c.w)) - cast(sum(n) as bigint)] as n from own join c using (id) group by id),
    far as (select c.id, case when length(text) >= {LEAST_CHARS} then {_distance("c.k", "rc.k")} end as char_distance, case when len(w) >= {LEAST_WORDS} then {_distance("h.n", "r.n")} end as word_distance
        from c join ref_chars rc on c.lang = rc.lang left join ref r on r.lang = c.lang left join hist h on h.id = c.id),
    base as (select c.*, cast(len(w) as bigint) as n_words, coalesce(a.n, 0) as n_repeat_words, len(w) < 50 or 100 * coalesce(a.n, 0) > 50 * len(w) as base_failed,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines from c left join again a using (id))
select doc_id, n_words, cast(length(text) - k[1] as bigint) as word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, n_repeat_words, base_failed,
    not base_failed and coalesce(char_distance <= {MOST_CHARS}, true) and coalesce(word_distance <= {MOST_WORDS}, true) as kept, char_distance, word_distance
from base left join far using (id)
"""
