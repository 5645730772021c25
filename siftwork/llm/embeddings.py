"""Near duplicates and exact top-k search over embeddings, both by walking two cover trees at once.

The top levels of a cover tree over a bounded sample give pivots; every vector goes to its nearest pivot, whose cell has its true covering radius. Cells
are the nodes that the dual walk starts from: pairs of cells that their radii rule out are never shipped. Cells are dealt in
blocks of bounded size; a task builds the trees of two blocks and walks them together, so every pair of vectors is decided in
exactly one task or by the bounds of its cells. Copies of a vector are one point with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.components import components, forest
from siftwork.llm.covertree import ENDLESS, EPS, LOWEST, NOBODY, Best, Tree, close_leaves, distances, net, search

COSINE = 0.93
BLOCK = 2048
TOP = 20
SCALE = 64
EVERY = 20
QUERY_BLOCK = 4096
#: Tasks, at most; with more pairs of blocks a task has several.
TASKS = 20_000
DATA_BLOCK = 8192
#: Vectors that pivots are chosen from, at most, and their numbers in all: those with the smallest hashes of their ids. All vectors are dealt to the pivots.
SAMPLE, SAMPLE_NUMBERS = 1024, 1 << 20
#: Cells serve where their bounds rule out this share of the pairs of vectors at least; else vectors are dealt evenly.
SPARED = 0.3
#: Number of a block: cell * UNITS + unit.
UNITS = 1 << 40


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id, label, v (array<double>) of the vectors without nulls and non-finite components, of any length."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    return out.where(F.exists("v", lambda x: x != 0)) if nonzero else out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; over their largest components first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(x * scale)


def _pivots(x: np.ndarray, want: int) -> np.ndarray:
    """`want` centres of the levels of a cover tree, coarser levels first; each level's radius is half of the one above."""
    chosen, radius = [0], float(distances(x[:1], x).max())
    while len(chosen) < min(want, len(x)) and radius > EPS:
        radius /= 2
        # Nested: the centres so far lead the next level.
        rest = np.setdiff1d(np.arange(len(x)), chosen)
        chosen = [c for c, _ in net(x, np.concatenate([np.array(chosen), rest]), radius)]
    return x[chosen[:want]]


class Cells:
    """Pivots of the groups that need several blocks, and what cells are made of: (group columns, cell, rest) -> blocks to meet."""

    def __init__(self, rows: DataFrame, by: list[str], key: str, block: int, point: Callable[[np.ndarray], np.ndarray], near: Callable[..., np.ndarray]):
        """rows(*by, key, v); by ends with n_dim. point: what a row of numbers stands for in the tree's space.

        near(points, pivots, cell of each point, distances): which cells have to meet, judged by the sample; pivots serve if that spares enough.
        """
        self.rows, self.by, self.point = rows, by, point
        sizes = rows.groupBy(*by).agg(F.count("*").alias("n")).checkpoint()
        self.pivots: dict[tuple, np.ndarray] = {}
        large = sizes.where(F.col("n") > block)
        if not large.limit(1).count():
            return
        numbers = F.sum("n_dim").over(Window.orderBy("h", key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        few = rows.join(large, by, "left_semi").withColumn("h", F.xxhash64(key)).orderBy("h", key).limit(SAMPLE)
        some = few.withColumn("numbers", numbers).where(F.col("numbers") <= SAMPLE_NUMBERS).toPandas()
        if len(some):
            known = {self.name(r): r["n"] for r in large.join(F.broadcast(rows.sparkSession.createDataFrame(some[by].drop_duplicates(), large.select(*by).schema)), by, "left_semi").collect()}
            for name, group in some.groupby(by, dropna=False):
                name = tuple(x.item() if hasattr(x, "item") else x for x in name)
                x = point(_matrix(group["v"]))
                tame = np.isfinite(x).all(axis=1) & (np.abs(x).max(axis=1) < math.sqrt(ENDLESS))
                if tame.sum() > 1 and name in known:
                    x = x[tame]
                    pivots = _pivots(x, -(-known[name] // block) + 1)
                    d = distances(x, pivots)
                    cell = d.argmin(axis=1)
                    n = np.bincount(cell, minlength=len(pivots)).astype(float)
                    if (n[:, None] * n[None] * near(x, pivots, cell, d.min(axis=1))).sum() <= (1 - SPARED) * n.sum() ** 2:
                        self.pivots[name] = pivots

    def name(self, row) -> tuple:
        return tuple(row[c] for c in self.by)

    def dealt(self) -> DataFrame:
        """rows with cell and far, the distance to the cell's pivot; -1 for rows too long for the tree, 0 without pivots."""
        if not self.pivots:
            return self.rows.withColumn("cell", F.lit(0)).withColumn("far", F.lit(0.0))
        pivots, point = self.rows.sparkSession.sparkContext.broadcast(self.pivots), self.point

        @F.pandas_udf("struct<cell int, far double>")
        def nearest(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
            for names, v in batches:
                cell, far = np.zeros(len(v), dtype=np.int32), np.zeros(len(v))
                for name, at in names.groupby(list(names.columns), dropna=False, sort=False).indices.items():
                    name = name if isinstance(name, tuple) else (name,)
                    p = pivots.value.get(tuple(name))
                    if p is None:
                        continue
                    x = point(_matrix(v.iloc[at]))
                    tame = np.isfinite(x).all(axis=1) & (np.abs(x).max(axis=1) < math.sqrt(ENDLESS))
                    cell[at[~tame]] = -1
                    d = distances(x[tame], p)
                    cell[at[tame]], far[at[tame]] = d.argmin(axis=1), d.min(axis=1)
                yield pd.DataFrame({"cell": cell, "far": far})

        return self.rows.withColumn("near", nearest(F.struct(*self.by), "v")).select(*self.rows.columns, "near.cell", "near.far")


def _unit_of(key: str, units: str | Column) -> Column:
    return F.pmod(F.xxhash64(key), units).cast("long")


def _blocks(cells: str) -> Column:
    """Numbers of the blocks of an array of (cell, units)."""
    return F.flatten(F.transform(cells, lambda c: F.transform(F.sequence(F.lit(0).cast("long"), c["units"] - 1), lambda u: c["cell"] * F.lit(UNITS) + u)))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors of equal, non-null label and equal length are linked when the cosine of their double-precision components
    is at least `cosine` (over 0). A vector that is null, empty, zero or holds null or non-finite components links with nothing, nor
    does one of null label. Rows of null vec_id give rows of null component_id and take no part; rows of equal vec_id count
    as one vector each, but share a component. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    good = usable(vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull()), nonzero=True).withColumn("n_dim", F.size("v"))
    classes = good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("n_dim").alias("n_dim")).checkpoint()
    limit = math.sqrt(2 - 2 * cosine)
    by = ["label", "n_dim"]
    cells = Cells(classes, by, "rep", block, _unit, lambda x, p, cell, far: _may_link(p, _most(far, cell, len(p)), limit))
    placed = cells.dealt()
    if cells.pivots:
        placed = placed.checkpoint()
    sized = placed.groupBy(*by, "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    even = sized.groupBy(*by).agg(F.sum("n").alias("n")).select(*by, F.lit(0).alias("cell"), F.ceil(F.col("n") / F.lit(block)).cast("long").alias("units"))
    plan = even.withColumn("others", F.array(F.struct(F.lit(0).cast("long").alias("cell"), "units")))
    kept = close_cells(sized, cells, limit, block) if cells.pivots else None
    if kept:
        table = spark.createDataFrame(kept, plan.schema)
        placed = placed.join(F.broadcast(table.select(*by).distinct().withColumn("celled", F.lit(True))), by, "left").withColumn("cell", F.when(F.col("celled"), F.col("cell")).otherwise(0)).drop("celled")
        plan = plan.join(F.broadcast(table.select(*by).distinct()), by, "left_anti").unionByName(table)
    else:
        placed = placed.withColumn("cell", F.lit(0))
    dealt = placed.join(plan.checkpoint(), [*by, "cell"]).withColumn("own", F.col("cell") * F.lit(UNITS) + _unit_of("rep", "units"))
    # Block i meets every block j near it: the pair goes by its smaller and its larger number.
    other = dealt.withColumn("other", F.explode(_blocks("others")))
    pairs = other.select("label", "n_dim", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "rep", "weight", "v")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep", ignore_index=True)
        unit = _unit(_matrix(group["v"]))
        first = (group["own"] == group["p"]).to_numpy()
        same = bool(group["p"].iloc[0] == group["q"].iloc[0])
        a = np.nonzero(first)[0]
        b = a if same else np.nonzero(~first)[0]
        weight = group["weight"].to_numpy()
        links, left, right = np.zeros(len(group), dtype=np.int64), [], []
        ta = Tree(unit[a])
        for i, j in close_leaves(ta, ta if same else Tree(unit[b]), limit):
            hit = unit[a[i]] @ unit[b[j]].T >= cosine
            if i is j:
                np.fill_diagonal(hit, False)
            r, c = np.nonzero(hit)
            r, c = a[i[r]], b[j[c]]
            np.add.at(links, r, weight[c])
            if i is not j:
                np.add.at(links, c, weight[r])
            left.append(r)
            right.append(c)
        root = forest(len(group), np.concatenate(left or [a[:0]]), np.concatenate(right or [a[:0]]))
        found = links > 0
        rep = group["rep"].to_numpy()
        return pd.DataFrame({"rep": rep[found], "root": rep[root[found]], "links": links[found]})

    # Blocks are small but take long: each pair has a task, which Spark would merge by size.
    n = plan.agg(F.sum(F.col("units") * (F.aggregate("others", F.lit(0).cast("long"), lambda s, c: s + c["units"]) + 1) / 2)).first()[0] or 1
    met = pairs.repartition(min(TASKS, int(n) + 1), "label", "n_dim", "p", "q").groupBy("label", "n_dim", "p", "q").applyInPandas(meet, "rep long, root long, links long").checkpoint()
    linked = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = classes.select("label", "v", "rep", "weight").join(links, "rep", "left").join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    members = good.select("vec_id", "label", "v").join(
        per_class.where("links is not null or weight > 1").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), ["label", "v"]
    ).select("vec_id", "links", "component")
    rest = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    per_id = members.groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    return rest.join(per_id, "vec_id", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"))


def _most(far: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, cell, far)
    return out


def _may_link(pivots: np.ndarray, radius: np.ndarray, limit: float) -> np.ndarray:
    near = distances(pivots, pivots) <= limit + radius[:, None] + radius[None] + 4 * EPS
    np.fill_diagonal(near, True)
    return near


def _bounds(p: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """No inner product of a point within r[i] of p[i] and one within s[j] of p[j] is above [i, j]."""
    length = np.sqrt((p * p).sum(axis=1))
    r, s = r + EPS * (r + length), s + EPS * (s + length)
    bound = p @ p.T + r[:, None] * length[None] + s[None] * (length + r)[:, None]
    return bound + EPS * ((length + r)[:, None] * (length + s)[None])


def _may_score(x: np.ndarray, pivots: np.ndarray, cell: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """Which pairs of cells may have a score of the k highest, if the sample were all there is."""
    if len(x) <= k:
        return np.ones((len(pivots), len(pivots)), dtype=bool)
    kth = np.partition(x @ x.T, len(x) - k - 1, axis=1)[:, len(x) - k - 1]
    worst = np.full(len(pivots), np.inf)
    np.minimum.at(worst, cell, kth)
    radius = _most(far, cell, len(pivots))
    return _bounds(pivots, radius, radius) >= worst[:, None]


def close_cells(sized: DataFrame, cells: Cells, limit: float, block: int) -> list[tuple]:
    """(*by, cell, units, others) of the groups where cells spare enough pairs; others are the (cell, units) that may hold points within the limit.

    As many rows as pivots, at most.
    """
    out = []
    found = pd.DataFrame([r.asDict() for r in sized.join(F.broadcast(_names(sized, cells)), cells.by, "left_semi").collect()])
    for name, group in found.groupby(cells.by, sort=False) if len(found) else ():
        p, cell, n, radius = cells.pivots[tuple(name)], group["cell"].to_numpy(), group["n"].to_numpy(), group["radius"].to_numpy()
        near = _may_link(p[cell], radius, limit)
        if (n[:, None] * n[None] * near).sum() > (1 - SPARED) * float(n.sum()) ** 2:
            continue
        units = -(-n // block)
        out += [(*(x.item() if hasattr(x, "item") else x for x in name), int(c), int(units[i]), [(int(cell[j]), int(units[j])) for j in np.nonzero(near[i])[0]]) for i, c in enumerate(cell.tolist())]
    return out


def _names(rows: DataFrame, cells: Cells) -> DataFrame:
    return rows.sparkSession.createDataFrame([*cells.pivots], rows.select(*cells.by).schema)


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, scale: int = SCALE, data_block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row with the other rows.

    A component x becomes floor(scale * x). Queries are the rows whose vec_id is divisible by `every`, candidates all rows but those of the
    query's own vec_id; ties go to the smaller vec_id. Products are exact, of any size; a score that doesn't fit a long is the nearest
    long (but the smallest), and such scores tie. Vectors that are null, empty or hold null or non-finite components, and rows of
    null vec_id, take no part; vectors meet only vectors of their length. Rows of equal vec_id as queries give the best of
    each other's results once. Other columns are ignored; an empty table gives no rows.
    """
    block = data_block or DATA_BLOCK
    good = usable(vectors.where("vec_id is not null").withColumn("label", F.lit(None)), nonzero=False)
    rows = good.select("vec_id", "v", F.size("v").alias("n_dim"), (F.col("vec_id") % every == 0).alias("is_query"))
    cells = Cells(rows, ["n_dim"], "vec_id", block, lambda x: _whole(x, scale), lambda x, p, cell, far: _may_score(x, p, cell, far, k))
    placed = cells.dealt()
    if cells.pivots:
        placed = placed.checkpoint()
    even = placed.groupBy("n_dim").agg(F.count("*").alias("n"), F.count_if("is_query").alias("m")).where("m > 0")
    zero = F.lit(0).cast("long")
    side = F.explode(F.array(F.lit(True), F.lit(False)))

    def met(placed: DataFrame, plan: DataFrame, pairs: int) -> DataFrame:
        """(query_id, vec_id, score) of placed(n_dim, cell, ...) by plan(n_dim, is_query, cell, units, others)."""
        both = placed.where("is_query").unionByName(placed.withColumn("is_query", F.lit(False)))
        dealt = both.join(F.broadcast(plan) if pairs < TASKS else plan, ["n_dim", "is_query", "cell"]).withColumn("own", F.col("cell") * F.lit(UNITS) + _unit_of("vec_id", "units"))
        spread = dealt.withColumn("other", F.explode(_blocks("others")))
        q, d = F.when(F.col("is_query"), F.col("own")).otherwise(F.col("other")), F.when(F.col("is_query"), F.col("other")).otherwise(F.col("own"))

        def meet(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("vec_id", ignore_index=True)
            x, query, ids = _matrix(group["v"]), group["is_query"].to_numpy(), group["vec_id"].to_numpy()
            own = ids[query]
            best = Best(len(own), k)
            search(x[query], own, x[~query], ids[~query], best, scale)
            found = best.id != NOBODY
            return pd.DataFrame({"query_id": np.repeat(own, found.sum(axis=1)), "vec_id": best.id[found], "score": best.score[found]})

        # Blocks are small but take long: each pair has a task, which Spark would merge by size.
        tasks = spread.select("n_dim", q.alias("qb"), d.alias("db"), "vec_id", "v", "is_query").repartition(max(1, min(TASKS, pairs)), "n_dim", "qb", "db")
        return tasks.groupBy("n_dim", "qb", "db").applyInPandas(meet, "query_id long, vec_id long, score long")

    units = F.when(F.col("is_query"), F.ceil(F.col("m") / F.lit(QUERY_BLOCK))).otherwise(F.ceil(F.col("n") / F.lit(block))).cast("long")
    facing = F.when(F.col("is_query"), F.ceil(F.col("n") / F.lit(block))).otherwise(F.ceil(F.col("m") / F.lit(QUERY_BLOCK))).cast("long")
    evenly = even.select("n_dim", side.alias("is_query"), "n", "m").select("n_dim", "is_query", F.lit(0).alias("cell"), units.alias("units"), F.array(F.struct(zero.alias("cell"), facing.alias("units"))).alias("others"))
    found, celled = None, []
    if cells.pivots:
        first, later, celled = _search_cells(placed, cells, evenly, met, k, block)
        found = first if later is None else first.unionByName(later) if first is not None else None
    others = placed.where(~F.col("n_dim").isin(celled)) if celled else placed
    plan = evenly.where(~F.col("n_dim").isin(celled)) if celled else evenly
    plan = plan.checkpoint()
    pairs = plan.where("is_query").agg(F.sum(F.col("units") * F.col("others")[0]["units"])).first()[0]
    if pairs or found is None:
        rest = met(others.withColumn("cell", F.lit(0)), plan, int(pairs or 0))
        found = rest if found is None else found.unionByName(rest)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_cells(placed: DataFrame, cells: Cells, evenly: DataFrame, met: Callable, k: int, block: int) -> tuple[DataFrame | None, DataFrame | None, list[int]]:
    """Results of the query cells' best data cells, those of all others that bounds don't rule out, and the lengths of vectors so searched.

    First every query cell meets the data cells of the highest bounds, as many as hold k rows and more; then those whose bound reaches the
    worst kth score of the cell's queries. Lists have as many rows as pivots.
    """
    spark = placed.sparkSession
    stat = placed.where(F.col("n_dim").isin([x for (x,) in cells.pivots])).groupBy("n_dim", "cell").agg(F.count("*").alias("n"), F.count_if("is_query").alias("m"), F.max("far").alias("far"), F.max(F.when(F.col("is_query"), F.col("far"))).alias("far_q")).toPandas()
    schema, near, rest, done = evenly.schema, [], {}, []
    for n_dim, group in stat.groupby("n_dim"):
        group = group.reset_index(drop=True)
        p = np.vstack([cells.pivots[(n_dim,)], np.zeros((1, int(n_dim)))])[group["cell"].to_numpy()]  # cell -1 has the row of zeros
        bound = _bounds(p, group["far_q"].fillna(0).to_numpy(), group["far"].to_numpy())
        endless = (group["cell"] < 0).to_numpy()
        bound[endless] = bound[:, endless] = np.inf
        first = np.zeros(bound.shape, dtype=bool)
        asked = (group["m"] > 0).to_numpy()
        for i in np.nonzero(asked)[0]:
            order = np.argsort(-bound[i], kind="stable")
            first[i, order[: int(np.searchsorted(np.cumsum(group["n"].to_numpy()[order]), k + 1)) + 1]] = True
        near.append((int(n_dim), group, first))
        rest[int(n_dim)] = (group, bound, first, asked)

    def plan(pairs: list[tuple[int, pd.DataFrame, np.ndarray]]) -> tuple[list[tuple], int]:
        out, total = [], 0
        for n_dim, group, meets in pairs:
            cell, q, d = group["cell"].tolist(), -(-group["m"] // QUERY_BLOCK), -(-group["n"] // block)
            for is_query, own, other, m in ((True, q, d, meets), (False, d, q, meets.T)):
                for i in np.nonzero(m.any(axis=1))[0].tolist():
                    js = np.nonzero(m[i])[0].tolist()
                    out.append((n_dim, is_query, cell[i], int(own[i]), [(cell[j], int(other[j])) for j in js]))
                    total += int(own[i]) * sum(int(other[j]) for j in js) if is_query else 0
        return out, total

    listed, total = plan(near)
    if not listed:
        return None, None, []
    one = met(placed, spark.createDataFrame(listed, schema), total).distinct().checkpoint()
    ranked = one.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("at") == k).select("query_id", "score")
    asked = placed.where("is_query").select("n_dim", "cell", F.col("vec_id").alias("query_id")).join(ranked, "query_id", "left")
    worst = {(r["n_dim"], r["cell"]): r["worst"] for r in asked.groupBy("n_dim", "cell").agg(F.when(F.count("score") == F.count("*"), F.min("score")).alias("worst")).where(F.col("n_dim").isin([*rest])).collect()}
    more = []
    for n_dim, (group, bound, first, some) in rest.items():
        least = np.array([-np.inf if worst.get((n_dim, c)) is None else float(worst[n_dim, c]) if worst[n_dim, c] > LOWEST else -np.inf for c in group["cell"].tolist()])
        more.append((n_dim, group, (bound >= least[:, None] * (1 - 1e-12 * np.sign(least))[:, None]) & ~first & some[:, None]))
        done.append(n_dim)
    listed, total = plan(more)
    return one, met(placed, spark.createDataFrame(listed, schema), total) if listed else None, done


#: Both queries over the table embeddings, in DuckDB's SQL.
SQL_USABLE = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
ORACLE_LINKS = f"""
with recursive g as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where label is not null and {SQL_USABLE} and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    u as (select vec_id, label, len(v) as n, list_transform(v, lambda x: x / list_aggregate(list_transform(v, lambda y: abs(y)), 'max')) as v from g),
    w as (select vec_id, label, n, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from u),
    l as (select a.vec_id as x, b.vec_id as y from w a join w b on a.label = b.label and a.n = b.n and a.vec_id <> b.vec_id where list_dot_product(a.v, b.v) >= 0.93),
    r as (select vec_id, vec_id as low from embeddings union select l.y, r.low from r join l on l.x = r.vec_id)
select e.vec_id, coalesce(n.n, 0) as n_links, m.low as component_id, m.low = e.vec_id as kept from embeddings e left join (select x as vec_id, count(*) as n from l group by x) n using (vec_id) join (select vec_id, min(low) as low from r group by vec_id) m using (vec_id)
"""
ORACLE_SEARCH = f"""
with g as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings where {SQL_USABLE}),
    s as (select a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.v, b.v) as bigint) as score from g a join g b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s qualify rank <= 20
"""
