"""Key-value retrieval probes from a pool of sentences.

Everything random is a hash of a seed and of what it is for, so a probe is the same wherever and whenever it is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions.tokens import n_tokens
from siftwork.operators.prefix import carried, prefix_sum

LEAST, MOST = 5, 30
#: Entries of a probe's table: the most that fit the token budget are taken.
SIZES = (60, 55, 50, 45, 40, 35, 30)
#: Times that both sides of a permutation are moved on.
STEPS = 3
#: Fixed text: the instruction that probes begin with.
INSTRUCTION = "Please extract the value corresponding to the specified key from the following JSON object. Output only the value of the corresponding key and nothing else. The JSON data is as follows:\n"
BREAK = "\x1e"
#: Drawn sentences whose documents are sent to every task.
BROADCAST = 100_000


def sentences(text: Column) -> Column:
    """A text's sentences: they end with . ! or ? before white space."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), "([.!?])[ \\t\\n\\r]+", f"$1{BREAK}")
    return F.transform(F.split(marked, BREAK), lambda s: F.regexp_replace(s, "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", ""))


def pool(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(doc_id, sent_no, sentence, n_tok) of the sentences of `least` to `most` tokens; sent_no counts all of the document's from 0."""
    every = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sent_no", "sentence"))
    return every.withColumn("n_tok", n_tokens(F.col("sentence"))).where(F.col("n_tok").between(least, most))


def firsts(sents: DataFrame) -> DataFrame:
    """(doc_id, n, first): how many rows of sents a document has, and the number of its first one, in the order of doc_id. Written; texts are read once for it."""
    counts = sents.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).checkpoint()
    return prefix_sum(counts, "doc_id", "n", "upto").select("doc_id", "n", (F.col("upto") - F.col("n")).alias("first")).checkpoint()


def picked(sents: DataFrame, known: DataFrame, asked: DataFrame) -> DataFrame:
    """(sent_id, sentence) of asked(sent_id): rows of sents are numbered from 0 in the order of doc_id and sent_no, known is firsts().

    The documents of the numbers are found first, by carrying their starts along; only these documents' sentences are sorted.
    """
    starts = known.select(F.col("first").alias("at"), F.struct("doc_id", "first").alias("start"), F.lit(False).alias("asked"))
    both = starts.unionByName(asked.select(F.col("sent_id").alias("at"), F.lit(None).cast(starts.schema["start"].dataType).alias("start"), F.lit(True).alias("asked")))
    places = both.groupBy("at").agg(F.max("start").alias("start"), F.max("asked").alias("asked"))
    hits = carried(places, "at", {"start": "of"}).where("asked").select("of.doc_id", (F.col("at") - F.col("of.first")).alias("r"), F.col("at").alias("sent_id")).checkpoint()
    docs = hits.select("doc_id").distinct()
    some = sents.join(F.broadcast(docs) if hits.count() <= BROADCAST else docs, "doc_id")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_no")) - 1
    return some.withColumn("r", rank.cast("long")).join(hits, ["doc_id", "r"]).select("sent_id", "sentence")


def hashed(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts)))


def number(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("long")


def shuffled(i: Column, n: Column, key: Column) -> Column:
    """A permutation of 0..a*b-1, where a and b are the sides of the smallest near-square of n places at least; `key` chooses which one.

    i is a row and a column of the square. In turn the one is moved on by a hash of the other, within its side; every such step can be undone.
    """
    a, b = sides(n)
    row, column = F.floor(i / b), i % b
    for step in range(STEPS):
        row = (row + number(hashed(key, f"{step}a", column.cast("string"))) % a) % a
        column = (column + number(hashed(key, f"{step}b", row.cast("string"))) % b) % b
    return row * b + column


def sides(n: Column) -> tuple[Column, Column]:
    a = F.ceil(F.sqrt(n.cast("double")))
    return a, F.ceil(n / a)


def drawn(places: DataFrame, n: int, *by: str) -> DataFrame:
    """places(*by, i) with number, a place of 0..n-1 for each i below n: different ones for different i of the same `by`, by a permutation with them as its key.

    What the permutation takes beyond n is taken on by it until it is below, which it was to begin with, so that it comes to that.
    """
    key = F.concat_ws(":", *(F.col(c).cast("string") for c in by))
    size = F.lit(n).cast("long")
    found, open_ = None, places.withColumn("number", shuffled(F.col("i"), size, key)).checkpoint()
    while True:
        here = open_.where(F.col("number") < n)
        found = here if found is None else found.unionByName(here)
        # At most 1 in the square root of n each time.
        rest = open_.where(F.col("number") >= n)
        if rest.isEmpty():
            return found
        open_ = rest.withColumn("number", shuffled(F.col("number"), size, key)).checkpoint()


def contexts(sents: DataFrame, n_probes: int, seed: str, size: int = SIZES[0]) -> DataFrame:
    """(probe_id, pos, key, sentence): `size` different sentences a probe, all of them if there are fewer, in drawn order, each under a key of 32 characters."""
    spark = sents.sparkSession
    known = firsts(sents)
    n = known.agg(F.sum("n")).first()[0]
    if not n:
        return spark.createDataFrame([], "probe_id int, pos int, key string, sentence string")
    each = min(size, n)
    places = spark.range(n_probes * each).select(F.lit(f"{seed}:draw").alias("seed"), F.expr(f"cast(id div {each} as int)").alias("probe_id"), F.expr(f"id % {each}").alias("i"))
    draw = drawn(places, n, "seed", "probe_id").select("probe_id", F.col("i").cast("int").alias("pos"), F.col("number").alias("sent_id")).checkpoint()
    key = hashed(seed, "key", F.col("probe_id").cast("string"), F.col("pos").cast("string"))
    return draw.join(picked(sents, known, draw.select("sent_id")), "sent_id").select("probe_id", "pos", key.alias("key"), "sentence")


def quoted(value: Column) -> Column:
    """A JSON string; characters outside ASCII stay."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def prompts(context: DataFrame, budget: int, seed: str, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(probe_id, k, prompt, answer): the probe with the most entries of `sizes` whose prompt has fewer tokens than the budget.

    Three entries are shown as examples and a fourth is asked for. Raises where not even the smallest fits or a probe has too few entries.
    """
    entries = context.groupBy("probe_id").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "sentence"))).alias("e"))
    tried = entries.withColumn("k", F.explode(F.array(*map(F.lit, sizes)))).where("size(e) >= k").withColumn("e", F.slice("e", F.lit(1), F.col("k")))
    turn = F.transform("e", lambda x: F.struct(hashed(seed, "ask", F.col("probe_id").cast("string"), F.col("k").cast("string"), x["pos"].cast("string")).alias("h"), x["key"].alias("key"), x["sentence"].alias("sentence")))
    tried = tried.withColumn("asked", F.slice(F.array_sort(turn), F.lit(1), F.lit(4)))
    table = F.concat(F.lit("{"), F.array_join(F.transform("e", lambda x: F.concat(quoted(x["key"]), F.lit(": "), quoted(x["sentence"]))), ", "), F.lit("}"))
    shown = [F.concat(F.col("asked")[i]["key"], F.lit("\n"), F.col("asked")[i]["sentence"], F.lit("\n")) for i in range(3)]
    prompt = F.concat(F.lit(INSTRUCTION), table, F.lit("\n\n"), *shown, F.col("asked")[3]["key"], F.lit("\nanswer:"))
    made = tried.select("probe_id", "k", prompt.alias("prompt"), F.col("asked")[3]["sentence"].alias("answer"))
    fits = made.withColumn("n", n_tokens(F.col("prompt"))).where(F.col("n") + 1 <= budget)
    best = fits.groupBy("probe_id").agg(F.max(F.struct("k", "prompt", "answer")).alias("b"))
    out = entries.select("probe_id").join(best, "probe_id", "left")
    checked = F.when(F.col("b").isNull(), F.raise_error(F.lit("a probe doesn't fit the token budget"))).otherwise(F.col("b"))
    return out.withColumn("b", checked).select("probe_id", "b.k", "b.prompt", "b.answer")
