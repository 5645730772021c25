"""Mixing sources to target weights by a temperature, realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent between 0 (all alike) and 1 (as they are). The exponent is sectioned, many
candidates a pass, each pass one grouped sum over the sources. A weight becomes a budget of tokens: whole passes over the source, and for the rest the
first part of a fixed permutation of it. The permutation goes block by block, so that its running totals are those of a small table of blocks and,
in the one block where the budget ends, of about BLOCK documents. What decides about a document is a row for its source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of the largest possible entropy that weights have at least.
ENTROPY = 0.95
#: Times that a document occurs, at most, before its budget is rounded to documents.
REPEAT = 4.0
#: Exponents are whole multiples of 1 / STEPS.
STEPS = 4096
SECTIONS = 16
BLOCK = 1024
#: Blocks that are summed up together, and such spans, where the end of a budget is looked for.
SPAN = 1024
SEED = "mix"
#: Sources up to which their table is broadcast; a row has less than 200 bytes.
BROADCAST = 20_000

WORD = "[^ \\t\\n\\r]+"


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def _key(docs: DataFrame) -> Column:
    # A null source is a source of its own, apart from any string.
    return F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))


def _rank(seed: str) -> Column:
    return _number(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))


def _tokens() -> Column:
    return F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def exponent(sources: DataFrame, entropy: float | None, repeat: float | None, cover: bool) -> int:
    """The largest exponent, in 1 / STEPS, whose weights have the entropy, or a larger one that the repetition limit needs; sources(tokens > 0)."""
    total = sources.agg(F.sum("tokens").alias("all"), F.count("*").alias("n"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if not total["n"] or total["n"] == 1:
        return STEPS
    log = F.log(F.col("tokens") / F.lit(float(total["all"])))
    lp_most, lp_least = (F.log(F.lit(total[k] / float(total["all"]))) for k in ("most", "least"))

    def fits(ks: list[int]) -> list[tuple[bool, bool]]:
        """For each exponent: is its entropy large enough, are its repetitions few enough."""
        row = sources.agg(*(F.sum(F.exp(log * (k / STEPS))).alias(f"z{k}") for k in ks), *(F.sum(F.exp(log * (k / STEPS)) * log).alias(f"s{k}") for k in ks)).select(
            *(f"z{k}" for k in ks), *(f"s{k}" for k in ks), *(F.exp(lp_least * (k / STEPS - 1)).alias(f"r{k}") for k in ks), *(F.exp(lp_most * (k / STEPS - 1)).alias(f"l{k}") for k in ks), F.log(F.lit(float(total["n"]))).alias("most")
        ).first()
        out = []
        for k in ks:
            h = math.log(row[f"z{k}"]) - k / STEPS * row[f"s{k}"] / row[f"z{k}"]
            # The smallest source repeats most; with `cover` the largest one has one pass, else passes average one.
            most = row[f"r{k}"] / row[f"l{k}"] if cover else row[f"r{k}"] / row[f"z{k}"]
            out.append((entropy is None or h >= entropy * row["most"] - 1e-12, repeat is None or most <= repeat + 1e-12))
        return out

    def section(good) -> int:
        """The least exponent that is good, if those above it are too."""
        lo, hi = -1, STEPS  # lo isn't good, hi is
        while hi - lo > 1:
            ks = sorted({lo + max(1, (hi - lo) * i // SECTIONS) for i in range(1, SECTIONS)} - {hi})
            seen = fits(ks)
            for k, x in zip(ks, seen, strict=True):
                if good(x):
                    hi = k
                    break
                lo = k
        return hi

    if entropy is None:
        return section(lambda x: x[1])
    first_low = section(lambda x: not x[0])
    k = STEPS if fits([STEPS])[0][0] else first_low - 1
    return max(k, section(lambda x: x[1])) if repeat is not None else max(k, 0)


def plan(docs: DataFrame, entropy: float | None = ENTROPY, repeat: float | None = REPEAT, cover: bool = False, seed: str = SEED) -> DataFrame:
    """One row a source: key, tokens, n_docs, exponent, budget, passes, n_blocks, cut_block, cut_rank, cut_id.

    The budgets add up to the tokens there are, or with `cover` to the least sum at which every source has a whole pass. Sources
    without tokens have weight 0 and one pass, since they take no room.
    """
    slim = docs.select(_key(docs).alias("key"), _id().alias("id"), _rank(seed).alias("rank"), _tokens().alias("n")).checkpoint()
    sources = slim.groupBy("key").agg(F.sum("n").alias("tokens"), F.count("*").alias("n_docs")).checkpoint()
    some = sources.where("tokens > 0")
    k = exponent(some, entropy, repeat, cover)
    power = F.exp(F.log(F.col("tokens").cast("double")) * (k / STEPS))
    total = some.agg(F.sum("tokens").alias("all"), F.sum(power).alias("z"), F.max("tokens").alias("most")).first()
    z, most = total["z"] or 1.0, float(total["most"] or 1)
    share = power / F.lit(z) * F.lit(float(total["all"] or 0))
    if cover:
        share = power / F.exp(F.log(F.lit(most)) * (k / STEPS)) * F.lit(most)
        share = F.greatest(share, F.col("tokens").cast("double"))
    budget = F.when(F.col("tokens") > 0, F.floor(share + 1e-6)).otherwise(0).cast("long")
    made = sources.withColumn("exponent", F.lit(k)).withColumn("budget", budget).withColumn("n_blocks", F.ceil(F.col("n_docs") / BLOCK).cast("long"))
    made = made.withColumn("passes", F.when(F.col("tokens") > 0, F.expr("budget div greatest(tokens, 1)")).otherwise(1).cast("long"))
    made = made.withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("passes") * F.col("tokens")).otherwise(0))
    few = made.select("key", "n_blocks", "rest").where("rest > 0")
    dealt = slim.join(_sized(few), "key").withColumn("block", F.col("rank") % F.col("n_blocks"))
    blocks = dealt.groupBy("key", "block").agg(F.sum("n").alias("in_block")).checkpoint()
    cut = _cut(blocks, few)
    inside = dealt.join(_sized(cut), "key").where("block = cut_block")
    # Rows of equal rank and id go together, so that equal rows meet an equal end.
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("rank", "id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.withColumn("upto", upto).where("upto <= room").groupBy("key").agg(F.max(F.struct("rank", "id")).alias("last"))
    ends = cut.join(last, "key", "left").select("key", "cut_block", F.coalesce("last.rank", F.lit(-1)).alias("cut_rank"), F.coalesce("last.id", F.lit(0)).alias("cut_id"))
    none = F.lit(0).cast("long")
    return made.join(ends, "key", "left").select(
        "key", "tokens", "n_docs", "exponent", "budget", "passes", "n_blocks", F.coalesce("cut_block", none).alias("cut_block"), F.coalesce("cut_rank", F.lit(-1)).cast("long").alias("cut_rank"), F.coalesce("cut_id", none).alias("cut_id")
    ).checkpoint()


def _cut(blocks: DataFrame, rests: DataFrame) -> DataFrame:
    """(key, cut_block, room): of blocks(key, block, in_block) the one in which the rest of rests(key, rest) ends, and what is left of the rest there.

    Found from above, by sums of SPAN * SPAN blocks, then of SPAN, then of one: a window is over SPAN rows of a source, or all its largest spans.
    """
    at = _sized(rests.select("key", F.lit(0).cast("long").alias("span"), F.col("rest").alias("room")))
    for width in (SPAN * SPAN, SPAN, 1):
        met = blocks.join(at, "key")
        if width < SPAN * SPAN:
            met = met.where(F.expr(f"block div {width * SPAN}") == F.col("span"))
        sums = met.groupBy("key", F.expr(f"block div {width}").alias("part")).agg(F.sum("in_block").alias("in_part"), F.first("room").alias("room"))
        upto = F.sum("in_part").over(Window.partitionBy("key").orderBy("part"))
        ends = sums.withColumn("upto", upto).where("upto > room and upto - in_part <= room")
        at = _sized(ends.select("key", F.col("part").alias("span"), (F.col("room") - F.col("upto") + F.col("in_part")).alias("room")).checkpoint())
    return at.select("key", F.col("span").alias("cut_block"), "room")


def _sized(sources: DataFrame) -> DataFrame:
    """With a broadcast hint if there are few rows; else the join sorts, and Spark splits what is skewed."""
    return F.broadcast(sources) if len(sources.select("key").limit(BROADCAST + 1).take(BROADCAST + 1)) <= BROADCAST else sources


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of docs has them in any case."""
    taken = {c.lower() for c in docs.columns}
    mark = ""
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def copies(docs: DataFrame, planned: DataFrame, seed: str = SEED) -> tuple[DataFrame, str, str, str]:
    """docs with three columns more, and their names: the budget of the row's source, the exponent, and the times that the row occurs in the mixture.

    Names are such as no column of docs has.
    """
    own = _fresh(docs, "mix_key", "mix_rank", "key", "budget", "exponent", "passes", "n_blocks", "cut_block", "cut_rank", "cut_id", "mix_copies")
    key, rank, key2, budget, exponent_, passes, n_blocks, cut_block, cut_rank, cut_id, times = own
    c = {n: F.col(n) for n in own}
    block = c[rank] % c[n_blocks]
    first = (block < c[cut_block]) | (block == c[cut_block]) & ((c[rank] < c[cut_rank]) | (c[rank] == c[cut_rank]) & (_id() <= c[cut_id]))
    rows = docs.withColumn(key, _key(docs)).withColumn(rank, _rank(seed))
    slim = planned.select(*(F.col(name).alias(new) for name, new in zip(("key", "budget", "exponent", "passes", "n_blocks", "cut_block", "cut_rank", "cut_id"), own[2:10], strict=True)))
    small = planned.count() <= BROADCAST
    joined = rows.join(F.broadcast(slim) if small else slim, rows[key] == slim[key2])
    names = [F.col(f"`{n}`") for n in docs.columns]
    return joined.select(*names, budget, exponent_, (c[passes] + first.cast("long")).alias(times)), budget, exponent_, times


def mix(docs: DataFrame, entropy: float | None = ENTROPY, repeat: float | None = REPEAT, cover: bool = False, seed: str = SEED) -> DataFrame:
    """doc_id, source, n_tokens, copies, budget (of the source), exponent (in 1 / STEPS) for every row of docs.

    Tokens are runs of characters other than blanks, tabs and line ends, counted in whole texts. A null text has none; a null source is a source of its own; a null doc_id
    ranks like any other; equal rows get equal copies; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "source", "text")
    found, budget, exponent_, times = copies(docs, plan(docs, entropy, repeat, cover, seed), seed)
    return found.select("doc_id", "source", _tokens().alias("n_tokens"), F.col(times).alias("copies"), F.col(budget).alias("budget"), F.col(exponent_).alias("exponent"))


def mixture(docs: DataFrame, entropy: float | None = None, repeat: float | None = 2.0, cover: bool = True, seed: str = SEED) -> DataFrame:
    """The rows of docs as often as the mixture has them; with `cover` each of them once at least.

    All columns pass unchanged, whatever their names; nulls and repeated rows are as in `mix`; an empty table gives no rows.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    found, _, _, times = copies(docs, plan(docs, entropy, repeat, cover, seed), seed)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(times)
    return found.where(F.col(times) > 0).select(*names, again).drop(times)


#: `mix` with its own parameters over the table documents.
ORACLE = f"""
with d as (select doc_id, source, coalesce(text, '') as text,
        case when source is null then '-' else '=' || source end as key,
        coalesce(doc_id, -9223372036854775808) as id,
        ('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), '-')), 1, 12))::bigint as rank,
        cast(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) as bigint) as n from documents),
    s as (select key, cast(sum(n) as bigint) as tokens, count(*) as n_docs from d group by key),
    t as (select cast(sum(tokens) as double) as al, count(*) as n, min(tokens) as least, max(tokens) as most from s where tokens > 0),
    g as (select k, sum(exp(ln(tokens / al) * (k / {STEPS}.0::double))) as z, sum(exp(ln(tokens / al) * (k / {STEPS}.0::double)) * ln(tokens / al)) as w
        from s, t, range(0, {STEPS} + 1) r(k) where tokens > 0 group by k),
    h as (select k, ln(z) - k / {STEPS}.0::double * w / z >= {ENTROPY}::double * ln(cast(n as double)) - 1e-12 as wide,
        exp(ln(least / al) * (k / {STEPS}.0::double - 1)) / z <= {REPEAT}::double + 1e-12 as few from g, t),
    e as (select case when (select n from t) <= 1 then {STEPS} else
        greatest(coalesce((select max(k) from h where wide), 0), (select min(k) from h where few)) end as exponent),
    p as (select key, tokens, n_docs, exponent, exp(ln(cast(greatest(tokens, 1) as double)) * (exponent / {STEPS}.0::double)) as power from s, e),
    b as (select key, tokens, n_docs, exponent, case when tokens > 0 then cast(floor(power / (select sum(power) from p where tokens > 0) * (select al from t) + 1e-6) as bigint) else 0 end as budget,
        cast(ceil(n_docs / {BLOCK}.0) as bigint) as n_blocks from p),
    f as (select *, case when tokens > 0 then budget // tokens else 1 end as passes, case when tokens > 0 then budget % tokens else 0 end as rest from b),
    m as (select d.*, f.exponent, f.budget, f.passes, f.rest,
        sum(n) over (partition by d.key order by d.rank % f.n_blocks, d.rank, d.id range between unbounded preceding and current row) as upto from d join f using (key)),
    x as (select doc_id, source, n, exponent, budget, passes + case when rest > 0 and upto <= rest then 1 else 0 end as copies from m)
select doc_id, source, n as n_tokens, cast(copies as bigint) as copies, budget, cast(exponent as integer) as exponent from x
"""
