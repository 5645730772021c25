"""Selection of the best or worst documents by score."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.operators.prefix import by_range, carried, fresh

#: Ranges that a pass over the scores counts, and groups whose bounds are sent to every task.
BINS, BROADCAST = 1024, 10_000
#: Rows that may still be the wanted ones, in all groups together, from which on they are looked at one by one.
FEW = 20_000


def how_many(n: int, per_cent: float) -> int:
    return math.ceil(n * per_cent / 100)


def lengths(scores: DataFrame) -> DataFrame:
    """Adds tok_len from differences of total_tokens_seen, for score tables that have no lengths."""
    (before,) = fresh(scores, "before")
    known = carried(scores, "total_tokens_seen", {"total_tokens_seen": before}, itself=False)
    return known.withColumn("tok_len", F.col("total_tokens_seen") - F.coalesce(before, F.lit(0))).drop(before)


def ranked(scores: DataFrame, order: list[Column], by: str | None = None) -> DataFrame:
    """scores with __rank, from 1, by `order` overall or in each group of `by`.

    Rows go by range of the order to many tasks, each of which sorts its own; what lies before a range comes from a table of one row a range and group.
    """
    part, n, at, of, start = fresh(scores, "part", "n", "at", "by", "before")
    group = [] if by is None else [by]
    parts = by_range(scores, part, *group, *order)
    counts = parts.groupBy(*group, part).agg(F.count("*").alias(n))
    before = F.sum(n).over(Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*(F.col(g).alias(of) for g in group), F.col(part).alias(at), F.coalesce(before, F.lit(0)).alias(start))
    same = parts[part] == starts[at]
    if by is not None:
        same = same & parts[by].eqNullSafe(starts[of])
    inside = F.row_number().over(Window.partitionBy(part, *group).orderBy(*order))
    out = parts.join(F.broadcast(starts) if by is None else starts, same).withColumn("__rank", inside + F.col(start))
    return out.drop(part, at, start, of)


def kth(rows: DataFrame, want: DataFrame, keys: list[str]) -> DataFrame:
    """(g, *keys, k, same): of each group the keys of its want-th row in the order of keys, by counting alone.

    rows(g, *keys) has whole or finite numbers as keys, want(g, k) a k of 1 to the number of a group's rows. k is the row's place among the `same` rows of
    equal keys. A pass counts the rows of BINS equal ranges between the least and the greatest value that are still possible and
    keeps the one with the want-th row, until all values in it are equal; then the next key is looked at. A pass shuffles counts, no rows; only
    when all groups have no more than FEW rows left are these put in order.
    """


    def placed(left: DataFrame) -> DataFrame:
        """The result, from the FEW rows at most that are left."""
        group, equal = Window.partitionBy("g"), Window.partitionBy("g", *keys)
        at = left.withColumns({"at": F.row_number().over(group.orderBy(*keys)), "first": F.rank().over(group.orderBy(*keys)), "same": F.count("*").over(equal)})
        return at.where(F.col("at") == F.col("k")).select("g", *keys, (F.col("k") - F.col("first") + 1).alias("k"), "same").checkpoint()

    found = want.select("g", "k")
    for i, key in enumerate(keys):
        before = keys[:i]

        def met(state: DataFrame, before: list[str] = before) -> DataFrame:
            known = state.select("g", *(F.col(c).alias(f"is_{c}") for c in before), *(c for c in state.columns if c not in ("g", "same", *before)))
            same = rows.join(F.broadcast(known) if known.count() <= BROADCAST else known, "g")
            for c in before:
                same = same.where(F.col(c) == F.col(f"is_{c}"))
            return same

        bounds = met(found).groupBy("g").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("same"))
        state = found.drop("same").join(bounds, "g").checkpoint()
        while True:
            if (state.agg(F.sum("same")).first()[0] or 0) <= FEW:
                return placed(met(state).where(F.col(key).between(F.col("lo"), F.col("hi"))))
            open_ = state.where("lo < hi")
            if open_.isEmpty():
                break
            share = (F.col(key) - F.col("lo")) / (F.col("hi") - F.col("lo"))
            if dict(rows.dtypes)[key] == "double":
                # The difference of any two halves is finite.
                share = F.when(F.abs(F.col("hi") - F.col("lo")) == float("inf"), (F.col(key) / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)).otherwise(share)
            at = F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")
            bins = met(open_).where(F.col(key).between(F.col("lo"), F.col("hi"))).groupBy("g", *(f"is_{c}" for c in before), "k", at).agg(F.count("*").alias("same"), F.min(key).alias("lo"), F.max(key).alias("hi"))
            # At most BINS rows a group.
            upto = bins.withColumn("upto", F.sum("same").over(Window.partitionBy("g").orderBy("bin")))
            next_ = upto.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("same") < F.col("k"))).withColumn("k", F.col("k") - F.col("upto") + F.col("same"))
            state = state.where("lo = hi").unionByName(next_.select("g", *(F.col(f"is_{c}").alias(c) for c in before), "k", "lo", "hi", "same")).checkpoint()
        found = state.select("g", *before, F.col("lo").alias(key), "k", "same").checkpoint()
    return found


def select(scores: DataFrame, top: float = 20.0, bottom: float | None = None, by: str | None = None) -> DataFrame:
    """The ceil(n * top / 100) rows of the highest ai_score, or with `bottom` that share of the lowest; with `by` in each of its groups.

    Ties go to the smaller total_tokens_seen (null first), null scores first; NaN is above all numbers. The k-th row is found by counting, what is better passes a filter.
    """
    per_cent, up = (top, False) if bottom is None else (bottom, True)
    g, kind, x, seen, k, same = fresh(scores, "g", "kind", "x", "seen", "k", "same")
    score, endless = F.col("ai_score").cast("double"), F.lit(float("inf"))
    # Null, and what is no finite number, in the order of the scores.
    odd = [score == -endless, score == endless, F.isnan(score)]
    place = F.when(score.isNull(), 0).when(odd[0], 1 if up else 4).when(odd[1], 3 if up else 2).when(odd[2], 4 if up else 1).otherwise(2 if up else 3)
    finite = F.when(score.isNull() | F.isnan(score) | (F.abs(score) == endless), 0.0).otherwise(score if up else -score)
    group = F.lit(1) if by is None else F.coalesce(F.to_json(F.struct(F.col(by).alias("v"))), F.lit(""))
    keyed = scores.withColumns({g: group, kind: place, x: finite, seen: F.coalesce(F.col("total_tokens_seen").cast("long"), F.lit(-(1 << 62)))})
    rows = keyed.select(F.col(g).alias("g"), F.col(kind).alias("kind"), F.col(x).alias("x"), F.col(seen).alias("seen"))
    share = F.ceil(F.col("n").cast("double") * F.lit(float(per_cent)) / F.lit(100.0))
    want = rows.groupBy("g").agg(F.count("*").alias("n")).select("g", F.least(share, "n").cast("long").alias("k")).where("k > 0").checkpoint()
    last = kth(rows, want, ["kind", "x", "seen"])
    names = dict(zip(("g", "kind", "x", "seen", "k", "same"), (f"{c}_last" for c in (g, kind, x, seen, k, same)), strict=True))
    last = last.select(*(F.col(c).alias(n) for c, n in names.items()))
    met = keyed.join(F.broadcast(last) if last.count() <= BROADCAST else last, F.col(g) == F.col(names["g"]))
    mine, its = F.struct(kind, x, seen), F.struct(names["kind"], names["x"], names["seen"])
    better = met.where(mine < its).select(*scores.columns)
    ties = met.where((F.col(kind) == F.col(names["kind"])) & (F.col(x) == F.col(names["x"])) & (F.col(seen) == F.col(names["seen"])))
    if last.where(F.col(names["k"]) < F.col(names["same"])).isEmpty():
        return better.unionByName(ties.select(*scores.columns))
    # Rows that nothing tells apart: as many as are wanted.
    some = ranked(ties, [F.asc(g)], g).where(F.col("__rank") <= F.col(names["k"]))
    return better.unionByName(some.select(*scores.columns))


def summary(selected: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: n_selected, selected_tokens, total_tokens, token_pct (null without tokens)."""
    chosen = selected.agg(F.count("*").alias("n_selected"), F.coalesce(F.sum("tok_len"), F.lit(0)).cast("long").alias("selected_tokens"))
    every = scores.agg(F.max("total_tokens_seen").alias("total_tokens"))
    return chosen.crossJoin(every).withColumn("token_pct", F.round(F.try_divide(F.col("selected_tokens") * F.lit(100.0), F.col("total_tokens")), 6))
