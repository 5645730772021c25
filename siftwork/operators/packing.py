"""Documents in a stream of tokens, the stream in shards of a fixed number of tokens.

All of it is arithmetic on running totals, one row a document: token g of the stream lies in shard g div S at place g mod S. All shards but
the last are full. Nothing is counted token by token, and documents may be longer than a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions.tokens import EOS, n_tokens, tokenize
from siftwork.operators.prefix import carried, prefix_sum

# Between the ranges of a document that lies in several shards; what the names of shards begin with.
DASH = "—"
PREFIX = "fineweb"


def token_table(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, *keep, tokens, n_tokens) of documents(doc_id, text), each with its end."""
    return docs.select("doc_id", *keep, tokenize(F.col("text")).alias("tokens")).withColumn("n_tokens", F.size("tokens").cast("long"))


def positions(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, *keep, n_tokens, total_tokens_seen) in the order of doc_id."""
    # Tokens are counted, not made, and texts are read once: the ranges are sampled from the counts.
    return prefix_sum(docs.select("doc_id", *keep, (n_tokens(F.col("text")) + 1).alias("n_tokens")).checkpoint(), "doc_id", "n_tokens", "total_tokens_seen")


def placed(tokens: DataFrame) -> DataFrame:
    """(doc_id, total_tokens_seen) of a token table that has been written."""
    return prefix_sum(tokens.select("doc_id", "n_tokens"), "doc_id", "n_tokens", "total_tokens_seen").select("doc_id", "total_tokens_seen")


def shard_name(index: Column, prefix: str = PREFIX) -> Column:
    """Shard 0 is for validation."""
    return F.concat(F.lit(f"{prefix}_"), F.when(index == 0, "val").otherwise("train"), F.lit("_"), F.lpad(index.cast("string"), 6, "0"))


def layout(placed: DataFrame, size: int) -> DataFrame:
    """(shard_index, shard_name, n_tokens, n_docs_started): one row a shard, from positions()."""
    total = placed.agg(F.max("total_tokens_seen").alias("total"))
    shards = total.where("total > 0").select("total", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {size}"))).alias("shard_index"))
    started = placed.groupBy(F.expr(f"(total_tokens_seen - n_tokens) div {size}").alias("shard_index")).agg(F.count("*").alias("n_docs_started"))
    n = F.least(F.lit(size), F.col("total") - F.col("shard_index") * size)
    return shards.join(started, "shard_index", "left").select("shard_index", shard_name(F.col("shard_index")).alias("shard_name"), n.cast("long").alias("n_tokens"), F.coalesce("n_docs_started", F.lit(0)).cast("long").alias("n_docs_started"))


def ranges(size: int) -> Column:
    """Array of (shard, lo, hi) of the document's tokens, hi included, from n_tokens and total_tokens_seen."""
    first, last = F.col("total_tokens_seen") - F.col("n_tokens"), F.col("total_tokens_seen") - 1
    shards = F.sequence(F.floor(first / size), F.floor(last / size))
    return F.transform(shards, lambda s: F.struct(s.alias("shard"), F.greatest(first - s * size, F.lit(0)).cast("long").alias("lo"), F.least(last - s * size, F.lit(size - 1)).cast("long").alias("hi")))


def pointer(parts: Column) -> Column:
    """The ranges as text, 'name:lo-hi', joined by a dash."""
    return F.array_join(F.transform(parts, lambda r: F.concat(shard_name(r["shard"]), F.lit(":"), r["lo"].cast("string"), F.lit("-"), r["hi"].cast("string"))), DASH)


def parse_pointer(text: Column) -> Column:
    """Array of (name, lo, hi) of a pointer; hi of a part that ends in EOF is null. A name may hold colons and dots.

    'name:EOF' is the whole shard; after a part of the same shard it says only that this one runs to the shard's end.
    """
    part = "^(.*):(?:(\\d+)-)?(\\d+|EOF)$"
    parts = F.split(text, DASH)

    def name(p: Column) -> Column:
        return F.regexp_extract(p, part, 1)

    def one(p: Column) -> Column:
        lo, end = F.regexp_extract(p, part, 2), F.regexp_extract(p, part, 3)
        return F.struct(name(p).alias("name"), F.coalesce(F.when(lo != "", lo).cast("long"), F.lit(0)).alias("lo"), F.when(end != "EOF", end).cast("long").alias("hi"))

    def new(p: Column, i: Column) -> Column:
        return ~(p.rlike(":EOF$") & (i > 0) & (name(F.get(parts, i - 1)) == name(p)))

    return F.transform(F.filter(parts, new), one)


def slices(tokens: DataFrame, size: int, block: int = 1024) -> DataFrame:
    """(shard, block, at, tokens): the stream in pieces that end with documents, blocks and shards; `at` is the first one's place in the shard.

    tokens has doc_id, tokens, n_tokens, total_tokens_seen. A block is a place in the shard div `block`; a shard may have any size, its last block then is shorter.
    """
    each = -(-size // block)  # blocks of a shard
    first, last = F.col("total_tokens_seen") - F.col("n_tokens"), F.col("total_tokens_seen") - 1

    def number(g: Column) -> Column:
        return F.floor(g / size) * each + F.floor(g % size / block)

    piece = tokens.select("tokens", first.alias("first"), F.explode(F.sequence(number(first), number(last))).alias("b"))
    start = F.floor(F.col("b") / each) * size + F.col("b") % each * block
    end = F.least(start + block, (F.floor(F.col("b") / each) + 1) * size)
    lo = F.greatest(start, F.col("first"))
    hi = F.least(end, F.col("first") + F.size("tokens"))
    place = lo % size
    return piece.select(F.floor(lo / size).alias("shard"), F.floor(place / block).alias("block"), place.alias("at"), F.slice("tokens", (lo - F.col("first") + 1).cast("int"), (hi - lo).cast("int")).alias("tokens"))


def resolve(pointers: DataFrame, pieces: DataFrame, block: int = 1024) -> DataFrame:
    """(doc_id, tokens) of pointers(doc_id, pointer), from pieces of the named shards (shard_name, block, at, tokens).

    Ranges are met with pieces by shard and block, so a shard's pieces are never paired with all its ranges. Every range named
    is read, and of an open one the rest of its shard.
    """
    asked = pointers.select("doc_id", F.posexplode(parse_pointer(F.col("pointer"))).alias("part", "r")).select("doc_id", "part", F.col("r.name").alias("shard_name"), F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))
    ends = pieces.groupBy("shard_name").agg((F.max(F.col("at") + F.size("tokens")) - 1).alias("end"))
    asked = asked.join(ends, "shard_name").withColumn("hi", F.coalesce("hi", "end"))
    return gather(asked, pieces, block)


def gather(asked: DataFrame, pieces: DataFrame, block: int = 1024) -> DataFrame:
    """(doc_id, tokens) of asked(doc_id, part, shard_name, lo, hi): the tokens of a document's ranges in the order of `part`, hi included."""
    asked = asked.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))))
    met = asked.join(pieces, ["shard_name", "block"]).where("at <= hi and at + size(tokens) > lo")
    skip = F.greatest(F.col("lo") - F.col("at"), F.lit(0))
    take = F.least(F.col("hi") - F.col("at") + 1, F.size("tokens")) - skip
    got = met.select("doc_id", F.struct("part", "at", F.slice("tokens", (skip + 1).cast("int"), take.cast("int")).alias("tokens")).alias("s"))
    return got.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["tokens"])).alias("tokens"))


def islands(pieces: DataFrame, size: int, eot: int = EOS) -> DataFrame:
    """(doc_start, doc_end, n_tokens, total_tokens_seen) of the documents in a stream of pieces, which don't have to end with documents.

    A document ends with `eot`; an open end of the stream is a document too. Only ends are looked at: their places, and for each shard
    and block the last end before it, from one row a block.
    """
    g = F.col("shard") * size + F.col("at")
    # Tokens are read once.
    seen = pieces.select("shard", "block", (g + F.size("tokens")).alias("upto"), F.filter(F.transform("tokens", lambda t, i: F.when(t == eot, g + i)), lambda x: x.isNotNull()).alias("ends")).checkpoint()
    ends = seen.select("shard", "block", F.explode("ends").alias("doc_end"))
    total = seen.agg(F.max("upto").alias("total"), (F.max(F.array_max("ends")) + 1).alias("closed"))
    tail = total.where("total > coalesce(closed, 0)").select(F.expr(f"(total - 1) div {size}").alias("shard"), F.lit(1 << 40).cast("long").alias("block"), (F.col("total") - 1).alias("doc_end"))
    ends = ends.unionByName(tail)
    last = ends.groupBy("shard", "block").agg(F.max("doc_end").alias("last"))
    in_shard = last.withColumn("before", F.lag("last").over(Window.partitionBy("shard").orderBy("block")))
    shards = carried(last.groupBy("shard").agg(F.max("last").alias("s_last")), "shard", {"s_last": "s_before"}, itself=False)
    known = in_shard.join(shards, "shard").select("shard", "block", F.coalesce("before", "s_before", F.lit(-1)).alias("before"))
    lagged = F.lag("doc_end").over(Window.partitionBy("shard", "block").orderBy("doc_end"))
    out = ends.withColumn("own", lagged).join(known, ["shard", "block"]).withColumn("doc_start", F.coalesce("own", "before") + 1)
    return out.select("doc_start", "doc_end", (F.col("doc_end") - F.col("doc_start") + 1).alias("n_tokens"), (F.col("doc_end") + 1).alias("total_tokens_seen"))
