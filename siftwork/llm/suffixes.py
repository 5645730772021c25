"""Removal of long repeated strings by merged Burrows-Wheeler transforms.

A string of LENGTH bytes is found wherever it starts earlier. Every such string holds an anchor, the run of GRAM bytes with the smallest hash in it,
which all its occurrences share; so strings that repeat meet under their anchor. The bytes around an anchor that strings with
this anchor can cover are its context. Equal contexts are settled at once: all strings of all but the first are repeats. Where an anchor
has different contexts, each is cut into PARTS overlapping parts by where a string starts; a part's core are the bytes that all its
strings have. Parts of one core are settled in the same way where they are equal; the different ones go to a bucket of bounded
size, in which transforms of shards are built and merged by iterative interleave refinement: the blocks that stand
after LENGTH symbols are the repeated strings. A core with too many different parts for a bucket has its strings grouped by content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm import sketch
from siftwork.llm.batches import portions
from siftwork.llm.bwt import Shard, repeats
from siftwork.llm.hashing import M1, Runs, chunks, mix, signed
from siftwork.llm.storage import Scratch

LENGTH = 100
GRAM = 32
PARTS = 4
#: Parts of contexts in a bucket, about, and of one core in a bucket at most.
BUCKET = 8192
HOT = 4096
#: Parts in a shard whose transform is built by sorting.
SHARD = 1024
SPAN = "lo long, hi long"
SPANS = "array<struct<lo: long, hi: long>>"
#: Slices of anchors, and of cores, that are worked on one after another where that is asked for (a power of 2).
SLICES = 2
#: Low bits of a sliding minimum's keys, which hold the position.
PLACE = np.uint64((1 << 26) - 1)


def _sliding(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum over each n neighbours; as long as h less n - 1."""
    reach = 1
    while 2 * reach <= n:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    return np.minimum(h[: len(h) - (n - reach)], h[n - reach :]) if reach < n else h


class Places:
    """Places in a few texts, in order: number of the text, position in the texts joined, and the runs of bytes around."""

    def __init__(self, raw: list[bytes]):
        self.data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        sizes = np.array([len(t) for t in raw], dtype=np.int64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.at = self.text = np.zeros(0, dtype=np.int64)
        self.runs = Runs(self.data)

    def put(self, text: np.ndarray, pos: np.ndarray) -> None:
        """Takes the places at `pos` in the texts; those behind a text's end go."""
        at = self.start[text] + pos
        inside = at < self.end[text]
        self.text, self.at = text[inside], at[inside]

    def spans(self, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the bytes from `before` ahead of each place to `after` behind it, within its text."""
        return np.maximum(self.start[self.text], self.at - before), np.minimum(self.end[self.text], self.at + after)

    def content(self, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of runs together with how they lie about their places."""
        return mix(self.runs.hash(lo, hi) + mix((at - lo + 4096).astype(np.uint64) * np.uint64(1 << 20) + (hi - at + 4096).astype(np.uint64)))


def anchors(raw: list[bytes], length: int, gram: int) -> tuple[Places, np.ndarray]:
    """The anchors in a few texts, and their hashes."""
    found = Places(raw)
    if len(found.data) < length:
        return found, np.zeros(0, dtype=np.uint64)
    h = found.runs.every(gram)
    # Of equal hashes in a string the first is its anchor.
    low = _sliding((h & ~PLACE) | (np.arange(len(h), dtype=np.uint64) & PLACE), length - gram + 1)
    inside = np.ones(len(low), dtype=bool)
    for e in found.end[:-1].tolist():
        inside[max(0, e - length + 1) : e] = False  # strings that cross the end of a text
    first = np.nonzero(inside)[0]
    low = low[inside]
    if not len(low):
        return found, h[:0]
    change = np.concatenate([[True], low[1:] != low[:-1]])
    near, low = first[change], low[change]
    # The position counts from the string's start, which lies at most a string before.
    at = near + ((low - near.astype(np.uint64)) & PLACE).astype(np.int64)
    found.at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    found.text = np.searchsorted(found.end, found.at, side="right")
    return found, h[found.at]


def repeated(text: np.ndarray, doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether the same keys come earlier in the same text, or in another one here of a smaller document; rows are in the order of their places."""
    order = np.lexsort((doc, *keys))
    out = np.zeros(len(order), dtype=bool)
    if len(order):
        text, doc = text[order], doc[order]
        same = np.ones(len(order), dtype=bool)
        same[0] = False
        for k in keys:
            same[1:] &= k[order][1:] == k[order][:-1]
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        again = same.copy()
        again[1:] &= text[1:] == text[:-1]
        out[order] = again | (doc != doc[first])
    return out


def _dealt(key: np.ndarray, content: np.ndarray, doc: np.ndarray, at: np.ndarray, known: np.ndarray) -> pa.Array:
    """Keys by which rows meet. Known repeats have nothing to meet, and go anywhere: so a key that very many documents have comes once from a few texts."""
    spread = mix(content ^ mix(doc.astype(np.uint64) * M1 + at.astype(np.uint64)))
    return pa.array(signed(np.where(known, spread, key)))


def starts(length: int, gram: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """For each part (a, b): its strings start a to b - 1 bytes ahead of the anchor."""
    width = length - gram + 1
    edges = [width * k // parts for k in range(parts + 1)]
    return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _occurrences(docs: DataFrame, length: int, gram: int, slices: int = 1, k: int = 0) -> DataFrame:
    """(anchor, context, doc_id, pos, known) of every anchor of slice k; known: the texts at hand tell that it is a repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            raw, ids = _bytes(b.column(1)), b.column(0).to_numpy()
            for first, last in chunks(raw):
                a, anchor = anchors(raw[first:last], length, gram)
                keep = anchor & np.uint64(slices - 1) == k
                a.at, a.text, anchor = a.at[keep], a.text[keep], anchor[keep]
                if not len(anchor):
                    continue
                context = a.content(*a.spans(length - gram, length), a.at)
                doc, pos = ids[first + a.text], a.at - a.start[a.text]
                known = repeated(a.text, doc, anchor, context)
                yield pa.RecordBatch.from_arrays([_dealt(anchor, context, doc, pos, known), pa.array(signed(context)), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(known)], names=["anchor", "context", "doc_id", "pos", "known"])

    return _texts(docs.where("doc_id is not null")).mapInArrow(run, "anchor long, context long, doc_id long, pos int, known boolean")


def _judged(rows: DataFrame, key: str, content: str) -> DataFrame:
    """rows with `late`, whether they repeat what a smaller document has, and `many`, how many of the key are not late; rows that aren't late and alone with their key are left out.

    All is told from one shuffle and one order of the rows.
    """
    met = rows.repartition(key)
    late = F.col("known") | (F.rank().over(Window.partitionBy(key, content).orderBy("doc_id")) > 1)
    many = F.count(F.when(~F.col("late"), 1)).over(Window.partitionBy(key))
    return met.withColumn("late", late).withColumn("many", many).where("late or many > 1")


def _with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """(doc_id, text, and the other column of lists) of the documents in lists."""
    bits = docs.sparkSession.sparkContext.broadcast(sketch.bitmap(lists, sketch.place("doc_id")))
    return _texts(docs.where("doc_id is not null")).where(_marked(bits)(sketch.place("doc_id"))).join(lists, "doc_id")


def _parts(docs: DataFrame, wanted: DataFrame, length: int, gram: int, slices: int = 1, slice_: int = 0) -> DataFrame:
    """(core, part, doc_id, lo, hi, known) of the parts, lo to hi in the text, about the places of wanted(doc_id, at), with a core of the slice; `part` is a hash of content and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            raw, ids = _bytes(b.column(1)), b.column(0).to_numpy()
            edge = np.cumsum([0, *b.column(2).value_lengths().to_pylist()])
            of, pos = np.repeat(np.arange(b.num_rows), np.diff(edge)), b.column(2).flatten().to_numpy()
            for first, last in chunks(raw):
                a, own = Places(raw[first:last]), slice(edge[first], edge[last])
                a.put(of[own] - first, pos[own].astype(np.int64))
                out = []
                for k, (p, q) in enumerate(starts(length, gram)):
                    lo, hi = a.spans(q - 1, length - p)
                    some = np.nonzero(hi - lo >= length)[0]
                    lo, hi, at, text = lo[some], hi[some], a.at[some], a.text[some]
                    # What all strings of the part have, whether or not the text's ends leave room for all of them.
                    core = mix(a.runs.hash(at - p, at - q + 1 + length) + np.uint64(k << 56 | 0x1E98DF25))
                    # A part has its core in it, and its hash its place about the anchor.
                    out.append((text, core, a.content(lo, hi, at), lo - a.start[text], hi - a.start[text]))
                text, core, part, lo, hi = (np.concatenate(x) for x in zip(*out, strict=True))
                own = core & np.uint64(slices - 1) == slice_
                text, core, part, lo, hi = text[own], core[own], part[own], lo[own], hi[own]
                doc = ids[first + text]
                known = repeated(text, doc, core, part)
                yield pa.RecordBatch.from_arrays(
                    [_dealt(core, part, doc, lo, known), pa.array(signed(part)), pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(known)], names=["core", "part", "doc_id", "lo", "hi", "known"]
                )

    return _with_lists(docs, wanted).mapInArrow(run, "core long, part long, doc_id long, lo int, hi int, known boolean")


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(core, hot, doc_id, lo, body) of wanted(core, hot, doc_id, lo, hi). A document's parts are fewer than its bytes."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("core", "hot", "lo", "hi")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            n = np.array(b.column(2).value_lengths())
            parts = b.column(2).flatten()
            core, hot, at, end = (parts.field(k) for k in range(4))
            raw, of = _bytes(b.column(1)), np.repeat(np.arange(b.num_rows), n)
            body = [raw[i][x:y] for i, x, y in zip(of.tolist(), at.to_pylist(), end.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([core, hot, b.column(0).take(pa.array(of)), at.cast(pa.int64()), pa.array(body, pa.binary())], names=["core", "hot", "doc_id", "lo", "body"])

    return _with_lists(docs, lists).mapInArrow(run, "core long, hot boolean, doc_id long, lo long, body binary")


def _covered(doc: np.ndarray, start: np.ndarray, length: int) -> pd.DataFrame:
    """Runs (doc_id, lo, hi) that strings of `length` bytes at the starts cover."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)
    last = np.concatenate([new[1:], [True]])[: len(doc)]
    return pd.DataFrame({"doc_id": doc[new], "lo": start[new], "hi": start[last] + length})


def _merged(bodies: DataFrame, length: int, n: int) -> DataFrame:
    """Repeats among different parts, by bucket."""
    buckets = max(1, -(-n // BUCKET))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["core", "doc_id", "lo"], ignore_index=True)
        # A core's parts, much alike, go to different shards: a shard is soon sorted, and the merge finds what they share.
        count = -(-len(group) // SHARD)
        rows = np.concatenate([np.arange(k, len(group), count) for k in range(count)])
        body, edges = group["body"].to_numpy(), np.cumsum([0, *(len(range(k, len(group), count)) for k in range(count))])
        shards = [Shard(body[rows[a:b]].tolist(), length) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        block, shard, text, at = repeats(shards, length)
        text = rows[edges[shard] + text]
        doc, start = group["doc_id"].to_numpy()[text], group["lo"].to_numpy()[text] + at
        order = np.lexsort((start, doc, block))
        block, doc, start = block[order], doc[order], start[order]
        head = np.ones(len(block), dtype=bool)
        head[1:] = block[1:] != block[:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(len(block)), 0))
        # One place can stand in two parts: it isn't earlier than itself.
        late = (doc != doc[first]) | (start != start[first])
        return _covered(doc[late], start[late], length)

    dealt = bodies.select("core", "doc_id", "lo", "body", F.pmod(F.xxhash64("core"), F.lit(buckets)).alias("bucket"))
    return dealt.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(run, f"doc_id long, {SPAN}")


def _by_string(bodies: DataFrame, length: int) -> DataFrame:
    """The same for cores of very many parts: every string is a key, and its first place comes from a grouped minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            body = b.column(2).to_pylist()
            for lo, hi in chunks(body, 1 << 16):
                data = np.frombuffer(b"".join(body[lo:hi]), dtype=np.uint8)
                size = np.array([len(t) for t in body[lo:hi]], dtype=np.int64)
                many = np.maximum(size - length + 1, 0)
                text = np.repeat(np.arange(len(size)), many)
                at = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
                a = (np.cumsum(size) - size)[text] + at
                runs = Runs(data)
                h = runs.hash(a, a + length)
                begin = b.column(1).to_numpy()[lo:hi][text] + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(mix(h))), pa.array(signed(mix(runs.hash(a, a + length // 2) ^ np.uint64(0x5851F42D4C957F2D)))), b.column(0).slice(lo, hi - lo).take(pa.array(text)), pa.array(begin)], names=["k1", "k2", "doc_id", "start"]
                )

    strings = bodies.select("doc_id", "lo", "body").mapInArrow(run, "k1 long, k2 long, doc_id long, start long").distinct()
    first = strings.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("k1", "k2", "first")
    late = strings.join(first, ["k1", "k2"]).where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
    return late.select("doc_id", F.col("start").alias("lo"), (F.col("start") + length).alias("hi"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, sliced: int | None = None) -> DataFrame:
    """(doc_id, spans): the maximal runs of bytes that strings starting earlier cover; documents without any are left out.

    Texts are UTF-8 bytes; a string is earlier in a document of smaller doc_id, or in the same one at a smaller start. Rows
    without doc_id take no part; rows of one doc_id are one document. From `sliced` bytes of text on, if that is given, anchors and cores go slice by
    slice, which takes less disk at a time and more passes over the texts.
    """
    scratch = Scratch(docs.sparkSession)
    try:
        slices = SLICES if sliced is not None and (_texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0) >= sliced else 1
        places, equal, open_ = [], [], []
        for k in range(slices):
            judged = _judged(_occurrences(docs, length, gram, slices, k), "anchor", "context")
            places.append(scratch.keep(judged.groupBy("doc_id").agg(*(F.collect_list(F.when(of, F.col("pos"))).alias(name) for name, of in (("copies", F.col("late")), ("wanted", ~F.col("late"))))), "places"))
            scratch.tidy()
        wanted = _all(places).where(F.size("wanted") > 0).groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("wanted")))).alias("at"))
        for k in range(slices):
            parts = scratch.keep(_judged(_parts(docs, wanted, length, gram, slices, k), "core", "part").select("core", "doc_id", "lo", "hi", "late", (F.col("many") > HOT).alias("hot")), "parts")
            scratch.tidy()
            equal.append(scratch.keep(parts.where("late").groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "equal"))
            open_.append(scratch.keep(parts.where("not late").select("core", "hot", "doc_id", "lo", "hi"), "open"))
            scratch.done("parts")
        bodies = scratch.keep(_bodies(docs, _all(open_)), "bodies")
        cool = _all(open_).where("not hot").count()
        scratch.done("open")
        late = _merged(bodies.where("not hot"), length, cool).unionByName(_by_string(bodies.where("hot"), length))
        late = late.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
        # Spans are cut to the text where they are used, as contexts were.
        around = F.transform("copies", lambda p: F.struct(F.greatest(F.lit(0), p - (length - gram)).cast("long").alias("lo"), (p + length).cast("long").alias("hi")))
        met = _all(places).where(F.size("copies") > 0).select("doc_id", around.alias("spans")).unionByName(_all(equal).select("doc_id", F.col("spans").cast(SPANS))).unionByName(late)
        spans = _joined(met.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))).checkpoint()
    finally:
        scratch.clear()
    return spans


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _joined(met: DataFrame) -> DataFrame:
    """(doc_id, spans) with spans that overlap as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, lo, hi = unions(b.column(1), np.full(b.num_rows, 1 << 40))
            edge = pa.array(np.searchsorted(text, np.arange(b.num_rows + 1)).astype(np.int32))
            both = pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], names=["lo", "hi"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(edge, both)], names=["doc_id", "spans"])

    return met.mapInArrow(run, f"doc_id long, spans {SPANS}")


def union(spans: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """Maximal runs of the spans within 0..n."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], min(s["hi"], n)) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        elif lo < hi:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _marked(bits):
    @F.pandas_udf("boolean")
    def marked(at: pd.Series) -> pd.Series:
        return pd.Series(sketch.inside(bits.value, at.to_numpy()))

    return marked


def unions(spans: pa.ListArray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list of (lo, hi) for each text: text, lo and hi of the maximal runs within the text, in order."""
    text = np.repeat(np.arange(len(spans)), spans.fill_null([]).value_lengths().to_numpy())
    both = spans.flatten()
    lo, hi = both.field(0).to_numpy(), np.minimum(both.field(1).to_numpy(), sizes[text])
    text, lo, hi = (x[lo < hi] for x in (text, lo, hi))
    order = np.lexsort((lo, text))
    text, lo, hi = text[order], lo[order], hi[order]
    # Texts one after another on one line, with a gap between, need one running maximum.
    start = text * (int(sizes.max(initial=0)) + 2)
    far = np.maximum.accumulate(hi + start) if len(hi) else hi
    new = np.ones(len(lo), dtype=bool)
    new[1:] = (lo + start)[1:] > far[:-1]
    last = np.concatenate([new[1:], [True]])[: len(new)]
    return text[new], lo[new], (far - start)[last]


def _split(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Rows of docs that can have spans, with them, and the rest; and the name of the column of spans, which no column of docs has.

    Only the former are shuffled.
    """
    bits = docs.sparkSession.sparkContext.broadcast(sketch.bitmap(spans, sketch.place("doc_id")))
    taken, mark = {c.lower() for c in docs.columns}, ""
    while {f"{mark}spans", f"{mark}span_doc_id"} & taken:
        mark += "_"
    name, key = f"{mark}spans", f"{mark}span_doc_id"
    id_ = F.col("doc_id").cast("long")
    flag = id_.isNotNull() & _marked(bits)(sketch.place(F.coalesce(id_, F.lit(0).cast("long"))))
    named = spans.select(F.col("doc_id").alias(key), F.col("spans").alias(name))
    hit = docs.where(flag)
    return hit.join(named, hit["doc_id"].cast("long") == named[key], "left").drop(key), docs.where(~flag), name


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    Each byte that a string of `length` bytes covers which also starts earlier is removed. A null text is an empty one; a text shorter than
    `length` keeps all; a row without doc_id keeps all and makes no other row lose anything; other columns are ignored; an empty
    table gives no rows.
    """
    docs = _texts(docs)
    hit, rest, spans = _split(docs, repeated_spans(docs, length, gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            raw = _bytes(b.column(1))
            sizes = np.array([len(t) for t in raw], dtype=np.int64)
            text, lo, hi = unions(b.column(2), sizes)
            edge = np.searchsorted(text, np.arange(len(raw) + 1)).tolist()
            runs, kept = list(zip(lo.tolist(), hi.tolist(), strict=True)), []
            for i, t in enumerate(raw):
                digest, at = hashlib.sha256(), 0
                for x, y in runs[edge[i] : edge[i + 1]]:
                    digest.update(t[at:x])
                    at = y
                digest.update(t[at:])
                kept.append(digest.hexdigest())
            removed = np.bincount(text, weights=hi - lo, minlength=len(raw)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes), pa.array(removed), pa.array(np.bincount(text, minlength=len(raw)).astype(np.int64)), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    changed = hit.select("doc_id", "text", spans).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    text, zero = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    same = rest.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    return changed.unionByName(same)


def strip_text(text: str | None, spans: list[dict] | None) -> str | None:
    """The text without the runs; a character stays if any of its bytes stays."""
    if text is None or not spans:
        return text
    t = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    for lo, hi in union(spans, len(t)):
        while lo < len(t) and t[lo] & 0xC0 == 0x80:
            lo += 1
        while hi < len(t) and t[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append(t[at:lo])
            at = hi
    return b"".join([*out, t[at:]]).decode("utf-8", "surrogatepass")


def strip(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with repeated strings taken out of the column text; a row of which nothing is left goes. Other columns pass unchanged.

    Nulls, empty texts and rows without doc_id are as in `digest`; they stay. Other columns may have any names; an empty table gives no rows.
    """
    hit, rest, name = _split(docs, repeated_spans(docs, length, gram))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([strip_text(t, None if s is None else list(s)) for t, s in zip(text, spans, strict=True)], dtype=object)

    both = hit.withColumn(name, F.struct(cut(F.col("text").cast("string"), F.col(name)).alias("new"), F.col("text").alias("old")))
    new, old = F.col(f"{name}.new"), F.col(f"{name}.old")
    left = both.where((new != "") | (old == "") | old.isNull())
    return left.select(*(new.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns)).unionByName(rest)


def reference(texts: dict[int, str | None], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """Brute force over a few documents: doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for i in sorted(texts):
        t = (texts[i] or "").encode()
        gone = np.zeros(len(t) + 1, dtype=np.int64)
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            if s in seen:
                gone[k : k + length] = 1
            seen.add(s)
        kept = bytes(x for x, g in zip(t, gone, strict=False) if not g)
        out[i] = (len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


#: `digest` over the table documents, in DuckDB's SQL; texts are cut into pieces that overlap by 99 bytes, since long ones are slow to index.
ORACLE = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
    c as (select doc_id, first, substr(h, 2 * first + 1, 2198) as h from (select doc_id, h, unnest(range(0, len(h) // 2 - 99, 1000)) as first from d where len(h) >= 200)),
    s as (select doc_id, first + i as pos, md5(substr(h, 2 * i + 1, 200)) as string from (select doc_id, first, h, unnest(range(0, least(1000, len(h) // 2 - 99))) as i from c)),
    l as (select doc_id, pos from s qualify row_number() over (partition by string order by doc_id, pos) > 1),
    g as (select doc_id, pos, case when pos <= lag(pos) over (partition by doc_id order by pos) + 100 then 0 else 1 end as new from l),
    i as (select doc_id, pos, sum(new) over (partition by doc_id order by pos) as run from g),
    r as (select doc_id, run, min(pos) as lo, max(pos) + 100 as hi from i group by all),
    k as (select doc_id, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as a, lo as b from r union all select d.doc_id, coalesce(max(hi), 0), len(any_value(h)) // 2 from d left join r using (doc_id) group by d.doc_id),
    t as (select k.doc_id, sha256(unhex(string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' order by a))) as kept from k join d using (doc_id) group by k.doc_id),
    m as (select doc_id, cast(sum(hi - lo) as bigint) as n_removed, count(*) as n_spans from r group by doc_id)
select d.doc_id, cast(len(h) // 2 as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, kept as kept_sha256 from d join t using (doc_id) left join m using (doc_id)
"""
