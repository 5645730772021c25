"""Language of pages by fusing evidence: text, declared language, address, and what is known of the host.

The text's likelihoods come from a naive Bayes model over hashed character sequences. How a declared language and an address suffix depend on
the real one is counted over all pages, softly, by what the text says. Hosts have priors that are smoothed toward their domain's, the domain's toward
all pages', each a grouped sum; a page's own share is taken out of its host's before the host speaks about it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm import html
from siftwork.llm.batches import portions

DIM = 1 << 15
#: Labelled documents of each language that the text model is fitted on, at most: those with the smallest hash of their id.
SAMPLE = 4_000
#: Ids of the sample that are sent to every executor.
BROADCAST = 200_000
#: Character sequences are far from independent: a page counts as so many of them, at most.
WEIGHT = 60.0
#: Pages' worth of the level above in a host's and in a domain's prior.
STRENGTH = 5.0
#: Pages' worth of evenness in what declarations and suffixes say.
EVEN = 1.0
#: Declared languages and suffixes other than the model's languages.
NONE, OTHER = "-", "?"
WORD = re.compile(r"[^\W\d_]+")
DECLARED = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?\s*([a-zA-Z]+)|http-equiv\s*=\s*["']?content-language["']?[^>]*?content\s*=\s*["']?\s*([a-zA-Z]+)""", re.I | re.S)


def counted(words: dict[str, int]) -> np.ndarray:
    """Hashed sequences of two to four characters of words that are counted, with a blank on either side, and how often each occurs."""
    found = []
    for w in words:
        known = _KNOWN.get(w)
        if known is None:
            if len(_KNOWN) > 200_000:
                _KNOWN.clear()
            s = f" {w} "
            _KNOWN[w] = known = np.array([zlib.crc32(s[i : i + k].encode("utf-8", "surrogatepass")) % DIM for k in (2, 3, 4) for i in range(len(s) - k + 1)], dtype=np.int64)
        found.append(known)
    if not found:
        return np.zeros(DIM, dtype=np.int64)
    times = np.repeat(np.fromiter(words.values(), dtype=np.int64, count=len(words)), np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
    return np.bincount(np.concatenate(found), weights=times, minlength=DIM).astype(np.int64)


def grams(text: str) -> np.ndarray:
    return counted(Counter(WORD.findall(text.lower())))


_KNOWN: dict[str, np.ndarray] = {}


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each hashed sequence in each, from documents(doc_id, text, lang).

    Rows of null language, text or doc_id take no part. Languages are those of all other documents; the model is fitted on at most `sample` ids of each, those with
    the smallest hashes, so that a rare language isn't missed. Texts are read whole, where they lie: only ids are sorted and sent.
    """
    labelled = docs.where("lang is not null and text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    share = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / F.lit(float(1 << 31))).alias("u")
    # A little more than the sample is below the cut; what is below it is ranked.
    cut = F.when(F.col("n") > sample, (sample + 6 * sample**0.5 + 6) / F.col("n")).otherwise(1.0)
    few = labelled.select("doc_id", "lang", share).join(F.broadcast(labelled.groupBy("lang").agg(F.count("*").alias("n"))), "lang").where(F.col("u") <= cut)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id"))
    ids = few.select("lang", "doc_id", "u").distinct().withColumn("r", rank).where(F.col("r") <= sample).select("lang", "doc_id").checkpoint()
    if not ids.limit(1).count():
        return [], np.zeros((0, DIM))
    # At most `sample` ids a language.
    chosen = labelled.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, ["lang", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in portions(batches):
            words: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            for lang, own in words.items():
                total[lang] = total.get(lang, 0) + counted(own)
        for lang, n in total.items():
            some = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some])], names=["lang", "gram", "n"])

    # Summed up before the driver gets them: DIM numbers a language, at most.
    sums = chosen.select("lang", "text").mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    total = {lang: np.zeros(DIM, dtype=np.int64) for lang in {r["lang"] for r in ids.select("lang").distinct().collect()}}
    for lang, own in sums.groupby("lang"):
        total[lang][own["gram"].to_numpy()] = own["n"].to_numpy()
    langs = sorted(total)
    counts = np.array([total[k] for k in langs], dtype=float).reshape(len(langs), DIM) + 0.5
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def _address(url: Column, langs: list[str]) -> dict[str, Column]:
    host = F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    domain = F.regexp_extract(host, "([^.]+\\.[^.]+)$", 1)
    named = F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([a-zA-Z]{2})(?:[-_/.?#]|$)", 1))
    top = F.regexp_extract(host, "\\.([a-z]+)$", 1)
    suffix = F.when(named.isin(*langs), named).when(top.isin(*langs), top).when(top == "", NONE).otherwise(OTHER)
    return {"host": F.coalesce(host, F.lit("")), "domain": F.coalesce(F.when(domain != "", domain).otherwise(host), F.lit("")), "suffix": F.when(url.isNull(), NONE).otherwise(suffix)}


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """page_id, url, host, declared, suffix, lang, probability for every row of pages(page_id, url, html).

    Pages are read whole, however long. A null or empty html has no text and no declaration, a null url no address: what is missing says nothing, and the priors decide. lang is null where the
    model has no languages. Null and repeated page_ids are rows like others; other columns are ignored; an empty table gives no rows.
    """
    langs, logp = model
    if not langs:
        nothing = F.lit(None).cast("string")
        return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), *(nothing.alias(c) for c in ("host", "declared", "suffix", "lang")), F.lit(None).cast("double").alias("probability"))
    weights = html.model()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            declared, likely = [], []
            for page in b.column(2).to_pylist():
                page = page or ""
                m = DECLARED.search(page[: page.lower().find("<body") if "<body" in page.lower() else None])
                code = (m[1] or m[2]).lower() if m else NONE
                declared.append(code if code in langs or code == NONE else OTHER)
                g = grams(html.main_text(page, weights))
                n = g.sum()
                ll = logp @ g * min(1.0, WEIGHT / n) if n else np.zeros(len(langs))
                likely.append((ll - ll.max()).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(declared), pa.array(likely, pa.list_(pa.float64()))], names=["page_id", "url", "declared", "likely"])

    kept = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    seen = kept.mapInArrow(read, "page_id long, url string, declared string, likely array<double>")
    seen = seen.select("*", *(c.alias(k) for k, c in _address(F.col("url"), langs).items())).checkpoint()
    n = len(langs)

    def normal(logs: list[Column]) -> list[Column]:
        top = F.greatest(*logs) if n > 1 else logs[0]
        total = sum((F.exp(x - top) for x in logs), F.lit(0.0))
        return [F.exp(x - top) / total for x in logs]

    by_text = seen.select("*", *(p.alias(f"t{i}") for i, p in enumerate(normal([F.col("likely")[i] for i in range(n)]))))

    def said(by: str) -> DataFrame:
        """log P(said | language), smoothed; there are at most two rows more than languages."""
        sums = by_text.groupBy(by).agg(*(F.sum(f"t{i}").alias(f"c{i}") for i in range(n)))
        total = by_text.agg(*(F.sum(f"t{i}").alias(f"a{i}") for i in range(n)))
        of = sums.crossJoin(F.broadcast(total))  # one row
        return of.select(by, *(F.log((F.col(f"c{i}") + EVEN) / (F.col(f"a{i}") + EVEN * (n + 2))).alias(f"{by}{i}") for i in range(n)))

    both = by_text.join(F.broadcast(said("declared")), "declared").join(F.broadcast(said("suffix")), "suffix")
    # A page without a declaration or suffix isn't judged by that.
    own = [F.col("likely")[i] + F.when(F.col("declared") == NONE, 0.0).otherwise(F.col(f"declared{i}")) + F.when(F.col("suffix") == NONE, 0.0).otherwise(F.col(f"suffix{i}")) for i in range(n)]
    page = both.select("page_id", "url", "declared", "suffix", "host", "domain", *(x.alias(f"o{i}") for i, x in enumerate(own)))
    page = page.select("*", *(p.alias(f"p{i}") for i, p in enumerate(normal([F.col(f"o{i}") for i in range(n)])))).checkpoint()
    hosts = page.groupBy("host", "domain").agg(F.count("*").alias("h_n"), *(F.sum(f"p{i}").alias(f"h{i}") for i in range(n)))
    domains = hosts.groupBy("domain").agg(F.sum("h_n").alias("d_n"), *(F.sum(f"h{i}").alias(f"d{i}") for i in range(n)))
    all_ = domains.agg(F.sum("d_n").alias("a_n"), *(F.sum(f"d{i}").alias(f"a{i}") for i in range(n)))
    priors = hosts.join(domains, "domain").crossJoin(F.broadcast(all_)).drop("domain")  # one row
    known = page.join(priors, "host")

    def share(level: str, i: int, above: Column) -> Column:
        return (F.greatest(F.col(f"{level}{i}") - F.col(f"p{i}"), F.lit(0.0)) + STRENGTH * above) / (F.col(f"{level}_n") - 1 + STRENGTH)

    prior = [share("h", i, share("d", i, share("a", i, F.lit(1.0 / n)))) for i in range(n)]
    final = normal([F.col(f"o{i}") + F.log(prior[i] + 1e-12) for i in range(n)])
    ranked = F.array_max(F.array(*(F.struct(F.round(p, 9).alias("probability"), F.lit(-i).alias("order"), F.lit(langs[i]).alias("lang")) for i, p in enumerate(final))))
    return known.withColumn("best", ranked).select("page_id", "url", "host", "declared", "suffix", "best.lang", "best.probability")
