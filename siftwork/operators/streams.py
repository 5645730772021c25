"""Documents in shards of any sizes, in any order of shards.

Shards have their starts in the stream from running totals of their counts. Documents lie between ends; each is cut where a shard begins, by carrying
the last start of a document and of a shard along the stream, range by range. Nothing is counted token by token, and a place of the
stream is met once, however small or large the shards around it are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.tokens import EOS
from siftwork.operators.packing import DASH, gather
from siftwork.operators.prefix import carried, prefix_sum
from siftwork.sources import shards

#: Shards whose starts are sent to every executor.
BROADCAST = 200_000
ORDERS = ("name", "number")


def _place(order: str) -> Column:
    """What shards are sorted by: their names, or the numbers that names end in and then names."""
    if order not in ORDERS:
        raise ValueError(f"shards are in the order of {' or '.join(ORDERS)}")
    number = F.lpad(F.regexp_extract("shard", "(\\d+)$", 1), 40, "0")
    return F.col("shard") if order == "name" else F.concat(number, F.lit(" "), F.col("shard"))


def spans(counts: DataFrame, order: str = "name") -> DataFrame:
    """(shard, n, start, place) of counts(shard, n_tokens): where each shard begins in the stream, in the order of `place`; empty shards are left out."""
    some = counts.where("n_tokens > 0").select("shard", F.col("n_tokens").cast("long").alias("n"), _place(order).alias("place"))
    return prefix_sum(some, "place", "n", "upto").select("shard", "n", (F.col("upto") - F.col("n")).alias("start"), "place")


def _with_start(pieces: DataFrame, known: DataFrame) -> DataFrame:
    starts = known.select("shard", "start")
    return pieces.join(F.broadcast(starts) if starts.count() <= BROADCAST else starts, "shard")


def documents(pieces: DataFrame, known: DataFrame, eot: int = EOS) -> DataFrame:
    """(doc_start, doc_end, n_tokens, total_tokens_seen) of the documents in pieces(shard, at, tokens) of the shards in spans().

    A document ends with `eot`; an open end of the stream is a document too.
    """
    place = F.col("start") + F.col("at")
    ends = _with_start(pieces, known).select(F.explode(F.filter(F.transform("tokens", lambda t, i: F.when(t == eot, place + i)), lambda x: x.isNotNull())).alias("doc_end")).checkpoint()
    last = known.agg((F.max(F.col("start") + F.col("n")) - 1).alias("doc_end")).crossJoin(ends.agg(F.max("doc_end").alias("closed")))  # one row
    ends = ends.unionByName(last.where("doc_end > coalesce(closed, -1)").select("doc_end"))
    found = carried(ends, "doc_end", {"doc_end": "before"}, itself=False).withColumn("doc_start", F.coalesce("before", F.lit(-1)) + 1)
    return found.select("doc_start", "doc_end", (F.col("doc_end") - F.col("doc_start") + 1).alias("n_tokens"), (F.col("doc_end") + 1).alias("total_tokens_seen"))


def cut(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(total_tokens_seen, start, shard, lo, hi): a row for each range of a shard that a document of docs(total_tokens_seen, n_tokens) has, hi included.

    Documents follow each other without gaps from the first token on.
    """
    doc = docs.where("n_tokens > 0").select((F.col("total_tokens_seen") - F.col("n_tokens")).alias("g"), F.col("total_tokens_seen").alias("seen"), F.lit(None).cast("struct<shard:string,start:bigint,n:bigint>").alias("s"))
    both = doc.unionByName(known.select(F.col("start").alias("g"), F.lit(None).cast("long").alias("seen"), F.struct("shard", "start", "n").alias("s")))
    # A document and a shard may begin at one place.
    places = both.groupBy("g").agg(F.max("seen").alias("seen"), F.max("s").alias("s"))
    at = carried(places, "g", {"seen": "total_tokens_seen", "s": "of"}).where(F.col("g") < F.col("total_tokens_seen")).where(F.col("g") < F.col("of.start") + F.col("of.n"))
    end = F.least(F.col("total_tokens_seen"), F.col("of.start") + F.col("of.n")) - 1
    return at.select("total_tokens_seen", F.col("g").alias("start"), "of.shard", (F.col("g") - F.col("of.start")).alias("lo"), (end - F.col("of.start")).alias("hi"))


def pointers(cuts: DataFrame) -> DataFrame:
    """(total_tokens_seen, doc_id) of cut(): ranges as text, 'shard:lo-hi', in order, joined by a dash."""
    text = F.concat("shard", F.lit(":"), F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"))
    listed = F.array_sort(F.collect_list(F.struct("start", text.alias("t"))))
    return cuts.groupBy("total_tokens_seen").agg(F.array_join(F.transform(listed, lambda x: x["t"]), DASH).alias("doc_id"))


def slices(tokens: DataFrame, known: DataFrame, block: int = 1024) -> DataFrame:
    """(shard, block, at, tokens): tokens(tokens, n_tokens, total_tokens_seen) in pieces that end with documents, shards and blocks of their places."""
    ranges = cut(tokens, known).withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))))
    lo, hi = F.greatest("lo", F.col("block") * block), F.least("hi", F.col("block") * block + block - 1)
    skip = F.col("start") - F.col("lo") + lo - (F.col("total_tokens_seen") - F.col("n_tokens"))
    met = ranges.join(tokens.select("total_tokens_seen", "n_tokens", "tokens"), "total_tokens_seen")
    return met.select("shard", "block", lo.alias("at"), F.slice("tokens", (skip + 1).cast("int"), (hi - lo + 1).cast("int")).alias("tokens"))


def split(pieces: DataFrame, known: DataFrame, eot: int = EOS, block: int = 1024) -> DataFrame:
    """(doc_id, tokens, n_tokens, total_tokens_seen) of the documents in pieces(shard, block, at, tokens) of the shards in spans(); ids are pointers."""
    docs = documents(pieces, known, eot).select("n_tokens", "total_tokens_seen").checkpoint()
    cuts = cut(docs, known).checkpoint()
    asked = cuts.select(F.col("total_tokens_seen").alias("doc_id"), F.col("start").alias("part"), F.col("shard").alias("shard_name"), "lo", "hi")
    tokens = gather(asked, pieces.withColumnRenamed("shard", "shard_name"), block).withColumnRenamed("doc_id", "total_tokens_seen")
    return docs.join(pointers(cuts), "total_tokens_seen").join(tokens, "total_tokens_seen").select("doc_id", "tokens", "n_tokens", "total_tokens_seen")


def read(spark: SparkSession, path: str, order: str = "name", max_tokens: int | None = None, eot: int = EOS, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Pieces and spans of the shards that match the path; with max_tokens only of those that the documents up to so many tokens need.

    Which shards those are is known from the running totals of their headers' counts; the payloads of the others are not opened. The document with
    which the limit is reached is whole: where it runs on, shards are added, once, twice, four times as many, until one holds its end.
    """
    known = spans(shards.headers(spark, path), order).checkpoint()
    pieces = shards.read(spark, path, block=block)
    if max_tokens is None:
        return pieces, known
    last = known.where(F.col("start") < max(1, max_tokens)).agg(F.max("place").alias("place"), F.max("start").alias("start")).first()
    if last["place"] is None:
        return pieces.where("false"), known.where("false")

    def named(of: DataFrame) -> Column:
        # Names in order are one comparison for the source; others are listed, as many as the limit has shards.
        if order == "name":
            low, high = of.agg(F.min("shard"), F.max("shard")).first()
            return F.col("shard").between(low, high)
        return F.col("shard").isin([r["shard"] for r in of.select("shard").collect()])

    first, upto, more = known.where(F.col("place") == last["place"]), last["place"], 1
    while True:
        # The limit is reached with an end at or after its token.
        here = _with_start(pieces.where(named(first)), first).where(F.exists(F.transform("tokens", lambda t, i: (t == eot) & (F.col("start") + F.col("at") + i >= max_tokens - 1)), lambda x: x))
        if here.limit(1).count():
            break
        later = known.where(F.col("place") > upto).orderBy("place").limit(more).checkpoint()
        if not later.limit(1).count():
            break
        first, upto, more = later, later.agg(F.max("place")).first()[0], 2 * more
    chosen = known.where(F.col("place") <= upto).checkpoint()
    return pieces.where(named(chosen)), chosen
