"""Sentence ends by what a corpus shows about its periods, without labelled text.

For each language grouped counts tell which words are abbreviations (a period follows them more often than chance, they are short, and rarely without one), which words
begin sentences, and which follow an abbreviation, an initial or a number as its company: log-likelihood ratios of counts. Then every word with a period is
judged by itself and by the next one. Only these words are looked at one by one; all tables are joined by type, and texts are never in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.tokens import words

# Fixed values of the method: least scores of an abbreviation, of company, of a word that begins sentences; how often an abbreviation has its period.
ABBREVIATION, COMPANY, STARTER, CERTAIN = 0.3, 7.88, 30.0, 0.99
OPENERS, CLOSERS = "[\"'(\\[«“‘„]", "[\"')\\]»”’“]"
NUMBER = "##"
#: Rows of a table that is sent to every task.
BROADCAST = 100_000


def type_of(word: Column) -> Column:
    """A word in lower case without quotes and brackets around it; all numbers are one type, with or without a period."""
    bare = F.lower(F.regexp_replace(word, f"^{OPENERS}+|{CLOSERS}+$", ""))
    return F.regexp_replace(bare, "^[0-9]+(?:[.,:][0-9]+)*(\\.?)$", f"{NUMBER}$1")


def pairs(docs: DataFrame, by: str = "lang") -> DataFrame:
    """(doc_id, by, i, word, next): every word of docs(doc_id, text, by) by its place, and the next word."""
    each = docs.select("doc_id", F.col(by).alias("by"), words(F.col("text")).alias("w"))
    placed = each.select("doc_id", "by", F.posexplode(F.arrays_zip(F.col("w").alias("word"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("next"))).alias("i", "x"))
    return placed.select("doc_id", "by", "i", "x.word", "x.next")


def types(each: DataFrame) -> DataFrame:
    """(by, type, n) of pairs(): different words are counted before their types are looked at."""
    return each.groupBy("by", "word").agg(F.count("*").alias("n")).groupBy("by", type_of(F.col("word")).alias("type")).agg(F.sum("n").alias("n"))


def counted(docs: DataFrame, by: str = "lang") -> DataFrame:
    """The types() of docs(doc_id, text, by), from words without their places, written once: what is counted from them doesn't read the texts again."""
    return types(docs.select(F.col(by).alias("by"), F.explode(words(F.col("text"))).alias("word"))).checkpoint()


def _stops(kind: Column) -> Column:
    return kind.rlike("[^.]\\.$")


def _base(kind: Column) -> Column:
    return F.when(_stops(kind), F.substring(kind, F.lit(1), F.length(kind) - 1)).otherwise(kind)


def abbreviations(counted: DataFrame) -> DataFrame:
    """(by, base, n_with, n, score, abbreviation) of the types() that have a letter and are seen with a period at least once."""
    counts = counted.groupBy("by", _base(F.col("type")).alias("base")).agg(F.sum(F.when(_stops(F.col("type")), F.col("n")).otherwise(0)).alias("n_with"), F.sum("n").alias("n"))
    every = counts.groupBy("by").agg(F.sum("n").alias("words"), F.sum("n_with").alias("stops"))
    met = counts.where("n_with > 0").where(F.col("base").rlike("\\p{L}")).join(F.broadcast(every) if every.count() <= BROADCAST else every, F.col("base").isNotNull() & counts["by"].eqNullSafe(every["by"])).drop(every["by"])
    p, without = F.col("stops") / F.col("words"), F.col("n") - F.col("n_with")
    # Where all words of a language have a period it says nothing.
    likely = 2 * (F.col("n_with") * F.log(F.lit(CERTAIN) / p) + F.when(without > 0, without * F.log(F.lit(1 - CERTAIN) / (1 - p))).otherwise(0.0))
    size = F.length(F.regexp_replace("base", "\\.", ""))
    score = likely * F.exp(-size.cast("double")) * (F.length("base") - size + 1) * F.pow(size.cast("double"), -without.cast("double"))
    rounded = F.round(score, 6) + 0.0  # no negative zero
    return met.select("by", "base", "n_with", "n", rounded.alias("score"), (rounded >= ABBREVIATION).alias("abbreviation"))


def ratio(ab: Column, a: Column, b: Column, n: Column) -> Column:
    """Log-likelihood ratio of ab of the a firsts, and b of all n, being followed by one thing."""

    def likely(k: Column, m: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(m > k, (m - k) * F.log(1 - p)).otherwise(0.0)

    apart = likely(ab, a, ab / a) + likely(b - ab, n - a, F.when(n > a, (b - ab) / F.when(n > a, n - a)).otherwise(0.0))
    return 2 * (apart - likely(ab, a, b / n) - likely(b - ab, n - a, b / n))


@dataclass
class Model:
    """Tables (by, base), (by, base, follows), (by, follows); by has "" for null."""

    abbreviations: DataFrame
    company: DataFrame
    starters: DataFrame


def _known(each: DataFrame, short: DataFrame) -> DataFrame:
    """The words of pairs() that have a period and a next word: base, what follows, and weak, whether the period may be one of an abbreviation, an initial or a number."""
    stopped = each.where(F.col("word").contains(".") & F.col("next").isNotNull()).withColumn("type", type_of(F.col("word"))).where(_stops(F.col("type"))).select("doc_id", F.coalesce(F.col("by").cast("string"), F.lit("")).alias("by"), "i", _base(F.col("type")).alias("base"), "next", _base(type_of(F.col("next"))).alias("follows"))
    met = stopped.join(_sent(short.withColumn("short", F.lit(True))), ["by", "base"], "left")
    initial = F.col("base").rlike("^\\p{L}$")
    return met.withColumn("initial", initial).withColumn("weak", F.col("short").isNotNull() | initial | (F.col("base") == NUMBER))


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def fit(docs: DataFrame, by: str = "lang") -> Model:
    each, seen_types = pairs(docs, by), counted(docs, by)
    short = abbreviations(seen_types).where("abbreviation").select(F.coalesce(F.col("by").cast("string"), F.lit("")).alias("by"), "base").checkpoint()
    known = seen_types.groupBy(F.coalesce(F.col("by").cast("string"), F.lit("")).alias("by"), _base(F.col("type")).alias("follows")).agg(F.sum("n").alias("b")).checkpoint()
    every = known.groupBy("by").agg(F.sum("b").alias("words"))
    seen = _known(each, short).groupBy("by", "base", "follows", "weak").agg(F.count("*").alias("ab")).checkpoint()
    firsts = seen.where("weak").groupBy("by", "base").agg(F.sum("ab").alias("a"))
    joined = seen.where("weak and ab > 1").join(firsts, ["by", "base"]).join(known, ["by", "follows"]).join(_sent(every), "by")
    # What follows no more often than anywhere else isn't company.
    company = joined.where((F.col("ab") * F.col("words") > F.col("a") * F.col("b")) & (ratio(F.col("ab"), F.col("a"), F.col("b"), F.col("words")) >= COMPANY)).select("by", "base", "follows").checkpoint()
    ends = seen.where("not weak").groupBy("by", "follows").agg(F.sum("ab").alias("ab"))
    all_ends = ends.groupBy("by").agg(F.sum("ab").alias("a"))
    begun = ends.join(known, ["by", "follows"]).join(_sent(all_ends), "by").join(_sent(every), "by")
    starters = begun.where((F.col("ab") * F.col("words") > F.col("a") * F.col("b")) & (ratio(F.col("ab"), F.col("a"), F.col("b"), F.col("words")) >= STARTER)).select("by", "follows").checkpoint()
    return Model(short, company, starters)


def split(docs: DataFrame, model: Model, by: str = "lang") -> DataFrame:
    """(doc_id, sent_no, sentence) of docs(doc_id, text, by), whose doc_ids are unique: words up to an end, one blank between them.

    A word that ends in . ! or ?, before quotes and brackets, ends a sentence. A period of an initial does not, nor does one of an abbreviation or a number before a small letter. Of an abbreviation, and
    of a number before its company, it does only where the next word is one that begins sentences. A null or blank text has none.
    """
    short = _known(pairs(docs, by), model.abbreviations)
    near = short.where("weak").join(_sent(model.company.withColumn("company", F.lit(True))), ["by", "base", "follows"], "left").join(_sent(model.starters.withColumn("starter", F.lit(True))), ["by", "follows"], "left")
    small = F.regexp_replace("next", f"^{OPENERS}+", "").rlike("^\\p{Ll}")
    stays = small | F.col("initial") | (F.col("starter").isNull() & (F.col("company").isNotNull() | F.col("short").isNotNull()))
    inner = near.where(stays).groupBy("doc_id").agg(F.collect_set("i").alias("inner"))
    met = docs.select("doc_id", words(F.col("text")).alias("w")).join(inner, "doc_id", "left").withColumn("inner", F.coalesce("inner", F.array().cast("array<int>")))
    ends = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).rlike(f"[.!?]{CLOSERS}*$") & ~F.array_contains("inner", i) | (i == F.size("w") - 1))
    cut = met.where("size(w) > 0").select("doc_id", "w", ends.alias("ends"))
    parts = F.transform("ends", lambda e, k: F.array_join(F.slice("w", F.when(k > 0, F.get("ends", k - 1)).otherwise(-1) + 2, e - F.when(k > 0, F.get("ends", k - 1)).otherwise(-1)), " "))
    return cut.select("doc_id", F.posexplode(parts).alias("sent_no", "sentence"))
