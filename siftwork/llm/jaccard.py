"""Jaccard join of documents on five-word shingles, with R-trees over count vectors.

Every document's set is ordered rarest shingle first; two sets that are similar enough share one of their first shingles (prefix filter).
Documents that share such a shingle, and those that these share others with, make a group. In a group the count vectors of the sets are indexed
by an R-tree, and the pairs that its bounds let through tie the group's documents into clusters, of which only a spanning forest
leaves a task. Documents of a cluster then meet with their whole texts: the R-tree proposes pairs, whole sets decide, and again only the
links of a spanning forest leave the task. So what is written grows with the documents, never with the pairs. Copies (equal sets) count once.

A group larger than a task goes in two rounds: first unit by unit, with a few documents of the group in every unit, which ties copies together at a cost
that is linear in their number; then units whose documents lie in different components meet in pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import sketch
from siftwork.llm.batches import portions
from siftwork.llm.components import components, forest
from siftwork.llm.hashing import chunks, mix, powers, signed, words
from siftwork.llm.rtree import Index, count_vector, decoded, enough
from siftwork.llm.storage import Scratch

WORDS = 5
PER_CENT = 80
#: Shingles that meet in a task, about, as counts and as texts; larger groups are dealt into units.
COUNTED, VERIFIED = 1 << 20, 1 << 19
#: Shingles whose count orders prefixes, at most: the most frequent ones. It changes the order of work, never the result.
FREQUENT = 50_000
LEAST_COUNT = 16
#: Pairs of one document that are verified at a time.
BATCH = 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
TURN = np.uint64(0xD6E8FEB86659FD93)
SHORT = np.uint64(0xA0761D6478BD642F)


def shingles(texts: list[str | None], k: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    for lo, hi in chunks(raw):
        data = np.frombuffer(b" ".join([*raw[lo:hi], b""]), dtype=np.uint8)
        gap = SPACE[data]
        edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
        start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        word = words(data, start, end)
        ends = np.cumsum([len(t) + 1 for t in raw[lo:hi]])
        at = np.searchsorted(start, np.concatenate([[0], ends]))
        turns = powers(TURN, k)
        whole = np.zeros(max(0, len(word) - k + 1), dtype=np.uint64)
        for j in range(k):
            whole += word[j : j + len(whole)] * turns[j]
        whole = mix(whole)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            n = b - a
            if n >= k:
                found = np.sort(whole[a : b - k + 1])
                fresh = np.ones(len(found), dtype=bool)
                np.not_equal(found[1:], found[:-1], out=fresh[1:])
                yield found[fresh]
            elif n:
                yield mix((word[a:b] * turns[:n]).sum(keepdims=True) + np.array([n], dtype=np.uint64) * SHORT)
            else:
                yield word[:0]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def survey(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, k1, k2, counts) of every row, k1 and k2 a fingerprint of its set; (shingle, seen) with the counts of those that occur repeatedly in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 2500, 16 << 20):
            sets = list(shingles(b.column(1).to_pylist()))
            k1 = np.array([(s * TURN).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
            k2 = np.array([mix(s ^ SHORT).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
            every = np.sort(np.concatenate(sets or [k1[:0]]))
            edge = np.nonzero(np.concatenate([[True], every[1:] != every[:-1], [True]]))[0] if len(every) else np.zeros(1, dtype=np.int64)
            seen = np.diff(edge)
            often, seen = every[edge[:-1][seen > 1]], seen[seen > 1]
            m = len(often)
            counts = pa.array([count_vector(s).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([b.column(0), pa.nulls(m, pa.int64())]),
                    pa.array(np.concatenate([[len(s) for s in sets], seen]).astype(np.int64)),
                    pa.array(np.concatenate([signed(k1), signed(often)])),
                    pa.array(np.concatenate([signed(k2), np.zeros(m, dtype=np.int64)])),
                    pa.concat_arrays([counts, pa.nulls(m, pa.binary())]),
                    pa.array(np.arange(len(sets) + m) >= len(sets)),
                ],
                names=["doc_id", "n", "k1", "k2", "counts", "shingle"],
            )

    found = _texts(docs).mapInArrow(run, "doc_id long, n long, k1 long, k2 long, counts binary, shingle boolean").checkpoint()
    often = found.where("shingle").groupBy(F.col("k1").alias("shingle")).agg(F.sum("n").alias("seen")).where(F.col("seen") >= LEAST_COUNT)
    return found.where("not shingle").drop("shingle"), often


def _frequent(often: DataFrame, limit: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    top = often.orderBy(F.desc("seen"), "shingle").limit(limit).toPandas()
    key = top["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], np.log2(top["seen"].to_numpy(dtype=np.float64)[order]).astype(np.int64) if len(top) else np.zeros(0, dtype=np.int64)


def _bits(docs: DataFrame, ids: DataFrame):
    return docs.sparkSession.sparkContext.broadcast(sketch.bitmap(ids, sketch.place("id")))


def _placed(docs: DataFrame) -> DataFrame:
    return _texts(docs.where("doc_id is not null")).withColumn("place", sketch.place("doc_id"))


def _wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, body) of the texts of the documents in ids(id), and of few others where ids are few."""
    bits = _bits(docs, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sketch.inside(bits.value, b.column(2).to_numpy()))).select([0, 1]).rename_columns(["id", "body"])

    return _placed(docs).mapInArrow(run, "id long, body string")


def prefixes(docs: DataFrame, wanted, often: tuple[np.ndarray, np.ndarray], per_cent: int, shared: np.ndarray | None = None) -> DataFrame:
    """(shingle, doc_id) of the shingles that a set has to share one of with any set that is similar enough; with a bitmap of shared ones, those and few others.

    Of the documents in the bitmap `wanted`, and few others; one function does all of that, since each worker of a task takes memory.
    """
    key, heat = often
    bits = None if shared is None else docs.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            b = b.filter(pa.array(sketch.inside(wanted.value, b.column(2).to_numpy())))
            found, sizes = [], []
            for s in shingles(b.column(1).to_pylist()):
                n = len(s)
                p = n - -(-per_cent * n // 100) + 1 if n else 0
                if len(key) and p < n:
                    at = np.minimum(np.searchsorted(key, s), len(key) - 1)
                    warm = np.where(key[at] == s, heat[at], 0)
                    s = s[np.argsort(warm, kind="stable")]
                s = s[:p]
                if bits is not None:
                    s = s[sketch.inside(bits.value, _low(s))]
                found.append(s)
                sizes.append(len(s))
            shingle = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([pa.array(signed(shingle)), ids], names=["shingle", "doc_id"])

    return _placed(docs).mapInArrow(run, "shingle long, doc_id long")


def _low(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(sketch.BITS - 1)).astype(np.int64)


class Groups:
    """The components of some rows while links between them are found; rows of one label are tied from the start."""

    def __init__(self, labels: np.ndarray):
        self.label = np.unique(labels, return_inverse=True)[1]
        self.root = self.label.copy()

    def apart(self, j: int, rows: np.ndarray) -> np.ndarray:
        return rows[self.root[rows] != self.root[j]]

    def join(self, j: int, rows: np.ndarray) -> None:
        roots = np.unique(self.root[rows])
        self.root[np.isin(self.root, roots)] = self.root[j]

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, first row of its component) for the first row of every label that isn't itself that; as many links as span the components."""
        first = np.unique(self.label, return_index=True)[1]
        roots, at = np.unique(self.root, return_index=True)
        head = at[np.searchsorted(roots, self.root[first])]
        return first[first != head], head[first != head]


def _tie(a: np.ndarray, b: np.ndarray, n: np.ndarray, counts: list[np.ndarray], groups: Groups, per_cent: int, sets: list[np.ndarray] | None = None) -> None:
    """Ties groups by the links between rows a, indexed, and rows b; a is b: within one unit.

    A link is a pair that the R-tree lets through, or with `sets` one whose sets are similar enough. Pairs that are tied already aren't verified.
    """
    index = Index([counts[i] for i in a.tolist()], n[a])
    if sets is not None:
        edge = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        mark = np.zeros(len(codes), dtype=bool)
    for j in b.tolist():
        hit = a[index.candidates(counts[j], int(n[j]), per_cent)]
        hit = groups.apart(j, hit[hit < j] if a is b else hit)
        if not len(hit):
            continue
        if sets is None:
            groups.join(j, hit)
            continue
        mark[codes[edge[j] : edge[j + 1]]] = True
        while len(hit):
            some, hit = hit[:BATCH], hit[BATCH:]
            cut = np.concatenate([[0], np.cumsum(n[some])])
            at = np.arange(cut[-1]) + np.repeat(edge[some] - cut[:-1], n[some])
            same = np.add.reduceat(mark[codes[at]].astype(np.int64), cut[:-1])
            groups.join(j, some[same >= enough(n[some], n[j], per_cent)])
            hit = groups.apart(j, hit)
        mark[codes[edge[j] : edge[j + 1]]] = False


def _meet(per_cent: int, whole: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """(a, b) of a task's rows (own, id, component, n, body): links that span the components of own 0, or those of own 0 and 1 together."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        # Rows of one doc_id may have several texts.
        group = group.drop_duplicates(["id", "body"]).sort_values("id", ignore_index=True)
        sets = None
        if whole:
            sets = list(shingles(group["body"].tolist()))
            some = [i for i, s in enumerate(sets) if len(s)]
            group, sets = group.iloc[some], [sets[i] for i in some]
            counts, n = [count_vector(s) for s in sets], np.array([len(s) for s in sets], dtype=np.int64)
        else:
            n = group["n"].to_numpy()
            counts = [decoded(c, k) for c, k in zip(group["body"], n.tolist(), strict=True)]
        own, ids = group["own"].to_numpy(), group["id"].to_numpy()
        a, b = np.nonzero(own == 0)[0], np.nonzero(own == 1)[0]
        groups = Groups(group["component"].to_numpy())
        if len(ids):
            _tie(a, b if len(b) else a, n, counts, groups, per_cent, sets)
        row, head = groups.stars()
        return pd.DataFrame({"a": ids[row], "b": ids[head]})

    return run


def _dealt(rows: DataFrame, bodies: DataFrame, per_cent: int, whole: bool) -> DataFrame:
    """Links (a, b) of rows(lot, p, q, own, id, component, n), each task with its (lot, p, q)."""
    full = rows.drop("n").join(bodies, "id").withColumn("n", F.lit(0)) if whole else rows.join(bodies, ["id", "n"])
    return full.groupBy("lot", "p", "q").applyInPandas(_meet(per_cent, whole), "a long, b long")


def linked(member: DataFrame, bodies: DataFrame, per_cent: int, weight: int, whole: bool, scratch: Scratch) -> DataFrame:
    """Links (a, b) that span the components of member(grp, id, n) under links inside groups; bodies(id, body) holds count vectors, or whole texts."""
    sized = member.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    total = sized.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w"), F.max("w").alias("most")).first()
    zero, lots = F.lit(0).cast("long"), max(1, -(-int(total["w"]) // weight))
    # Small groups share a task, whose R-tree holds them all.
    lot = F.pmod(F.xxhash64("grp"), F.lit(lots)).cast("long")
    own = F.lit(0).alias("own")
    if (total["most"] or 0) <= weight:
        return scratch.keep(_dealt(member.select(lot.alias("lot"), F.lit(-1).cast("long").alias("p"), zero.alias("q"), own, "id", F.col("id").alias("component"), "n").distinct(), bodies, per_cent, whole), "links")
    large = sized.where(F.col("w") > weight).withColumn("units", F.ceil(F.col("w") / F.lit(weight)).cast("long")).select("grp", "units").checkpoint()
    small = member.join(large, "grp", "left_anti").select(lot.alias("lot"), F.lit(-1).cast("long").alias("p"), zero.alias("q"), own, "id", F.col("id").alias("component"), "n")
    inside = member.join(large, "grp").checkpoint()
    # In every unit: a few of the group's documents, which tie the units' components to each other.
    mixed = F.xxhash64("id")
    hubs = inside.groupBy("grp", "units").agg(F.array(F.min(F.struct("id", "n")), F.max(F.struct("id", "n")), F.min_by(F.struct("id", "n"), mixed), F.max_by(F.struct("id", "n"), mixed)).alias("h"))
    hubs = hubs.select("grp", F.explode(F.sequence(zero, F.col("units") - 1)).alias("p"), "h").select("grp", "p", F.explode("h").alias("h")).select("grp", "p", "h.id", "h.n")
    units = inside.select("grp", F.pmod(mixed, "units").cast("long").alias("p"), "id", "n").unionByName(hubs)
    rows = small.unionByName(units.select(F.col("grp").alias("lot"), "p", zero.alias("q"), own, "id", F.col("id").alias("component"), "n")).distinct()
    first = scratch.keep(_dealt(rows, bodies, per_cent, whole), "links")
    scratch.tidy()
    return first.unionByName(scratch.keep(_across(inside, first, bodies, per_cent, weight, whole), "links"))


def _across(inside: DataFrame, first: DataFrame, bodies: DataFrame, per_cent: int, weight: int, whole: bool) -> DataFrame:
    """Links between units of inside(grp, id, n) that lie in different components of the links so far."""
    known = inside.drop("units").join(components(first), "id", "left").withColumn("component", F.coalesce("component", "id")).checkpoint()
    parts = known.groupBy("grp", "component").agg(F.sum("n").alias("size")).checkpoint()
    open_ = parts.groupBy("grp").agg(F.count("*").alias("c"), F.sum(F.when(F.col("size") <= weight, F.col("size"))).alias("few")).where("c > 1").select("grp", F.ceil(F.coalesce("few", F.lit(0)) / F.lit(weight)).cast("long").alias("shared")).checkpoint()
    # Small components of a group share units, a large one has its own. Two units of one large component never meet.
    one = F.col("size") > weight
    unit = F.when(one, F.xxhash64("component", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / F.lit(weight))))).otherwise(F.pmod(F.xxhash64("component"), F.greatest("shared", F.lit(1).cast("long"))))
    member = known.join(parts, ["grp", "component"]).join(open_, "grp").select("grp", "id", "n", "component", unit.alias("unit"), F.when(one, F.col("component")).alias("large")).checkpoint()
    units = member.select("grp", "unit", "large").distinct()
    p = units.select("grp", F.col("unit").alias("p"), F.col("large").alias("lp"))
    q = units.select("grp", F.col("unit").alias("q"), F.col("large").alias("lq"))
    meets = p.join(q, "grp").where("lp is null and lq is null and p <= q or lp is not null and lq is null or lp < lq").select("grp", "p", "q", "lp").checkpoint()
    left = member.join(meets.select("grp", F.col("p").alias("unit"), "p", "q"), ["grp", "unit"]).withColumn("own", F.lit(0))
    right = member.join(meets.where("p <> q or lp is not null").select("grp", F.col("q").alias("unit"), "p", "q"), ["grp", "unit"]).withColumn("own", F.lit(1))
    rows = left.unionByName(right).select(F.col("grp").alias("lot"), "p", "q", "own", "id", "component", "n")
    return _dealt(rows, bodies, per_cent, whole)


def _groups(alike: DataFrame, weight: int, scratch: Scratch) -> DataFrame:
    """(grp, id, n) of alike(shingle, id, n): documents under a shingle and those under shingles of these, or a shingle alone where that is less to meet."""
    first = alike.groupBy("shingle").agg(F.min("id").alias("b"), F.max("id").alias("top"), F.count("*").alias("m"), F.sum("n").alias("w")).where("b <> top").select("shingle", "b", "m", "w")
    first = scratch.keep(first, "first")
    meets = scratch.keep(alike.join(first.select("shingle", "b"), "shingle"), "meets")
    scratch.done("alike")
    near = meets.groupBy("id").agg(F.min("b").alias("grp"))
    named = first.join(near, first["b"] == near["id"]).select("shingle", "grp", (F.col("m") * F.ceil(F.col("w") / F.lit(weight))).alias("cost")).checkpoint()
    scratch.done("first")
    wide = scratch.keep(meets.select("shingle", "id", "n").join(named, "shingle").select("grp", "id", "n").distinct(), "wide")
    scratch.tidy()
    cost = wide.groupBy("grp").agg((F.count("*") * F.ceil(F.sum("n") / F.lit(weight))).alias("wide"))
    dear = cost.join(named.groupBy("grp").agg(F.sum("cost").alias("apart")), "grp").where("wide > apart").select("grp").checkpoint()
    if not dear.limit(1).count():
        return wide
    alone = named.join(dear, "grp").select("shingle")
    return wide.join(dear, "grp", "left_anti").unionByName(meets.join(alone, "shingle").select(F.xxhash64("shingle", F.lit(1)).alias("grp"), "id", "n"))


def similar(docs: DataFrame, per_cent: int = PER_CENT, counted: int = COUNTED, verified: int = VERIFIED) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text).

    A set holds the distinct five-word shingles of the whole text, however long, words lower-cased in A-Z and separated by ASCII white space; a shorter
    text is one shingle; a null text, or one without words, has an empty set that links with nothing. Sets link when
    100 * |intersection| >= per_cent * |union|; component_id is the smallest doc_id reachable. Rows of one doc_id are one document, and
    share a component; a row without doc_id links with nothing and has a null component. Other columns are ignored; an empty
    table gives no rows. `counted` and `verified`: shingles to a task.
    """
    scratch = Scratch(docs.sparkSession)
    try:
        surveyed, often = survey(docs)
        named = surveyed.where("doc_id is not null and n > 0")
        # Groupings are written before they are joined, so that Spark can split a key that very many documents have.
        classes = named.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("id")).checkpoint()
        member = named.select("doc_id", "n", "k1", "k2").join(classes, ["n", "k1", "k2"]).select("doc_id", "id", "n").distinct().checkpoint()
        reps = _bits(docs, classes.select("id"))
        top = _frequent(often)
        rows = prefixes(docs, reps, top, per_cent)
        shared = scratch.keep(rows.groupBy("shingle").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("shingle"), "shared")
        scratch.tidy()
        rows = prefixes(docs, reps, top, per_cent, sketch.bitmap(shared, F.col("shingle").bitwiseAND(F.lit(sketch.BITS - 1))))
        live = rows.join(shared, "shingle").join(member, "doc_id").select("shingle", "id", "n").distinct()
        # Similar sets have sizes in one class or in neighbours, so a document stands in its own class and in the next.
        size = F.floor(F.log("n") / F.log(F.lit(101.0 / per_cent)))
        classed = F.explode(F.array(F.xxhash64("shingle", size), F.xxhash64("shingle", size + 1)))
        alike = scratch.keep(live.select(classed.alias("shingle"), "id", "n"), "alike")
        scratch.done("shared")
        groups = _groups(alike, counted, scratch)
        points = named.select(F.col("doc_id").alias("id"), "n", F.col("counts").alias("body"))
        bound = linked(groups, points, per_cent, counted, False, scratch)
        scratch.done("meets", "wide")
        clusters = components(bound).select(F.col("component").alias("grp"), "id").join(classes.select("id", "n"), "id").checkpoint()
        scratch.done("links")
        texts = _wanted(docs, clusters.select("id"))
        links = linked(clusters, texts, per_cent, verified, True, scratch).unionByName(member.where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
        final = components(links).withColumnRenamed("id", "doc_id")
        out = surveyed.select("doc_id", F.col("n").alias("n_shingles")).join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).checkpoint()
    finally:
        scratch.clear()
    return out


def one_of_each(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """The rows of docs whose doc_id is its component's smallest, and those without doc_id, unchanged; of rows of one doc_id all stay."""
    gone = similar(docs, per_cent).where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")


def reference(texts: dict[int, str | None], per_cent: int = PER_CENT) -> dict[int, tuple[int, int]]:
    """Brute force over a few documents: doc_id -> (n_shingles, component_id)."""
    import re

    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + WORDS]) for k in range(len(w) - WORDS + 1)} if len(w) >= WORDS else {tuple(w)} if w else set()
    ids = sorted(sets)
    pairs = [(x, y) for x in range(len(ids)) for y in range(x) if sets[ids[x]] and 100 * len(sets[ids[x]] & sets[ids[y]]) >= per_cent * len(sets[ids[x]] | sets[ids[y]])]
    root = forest(len(ids), np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=np.int64))
    return {i: (len(sets[i]), ids[root[k]]) for k, i in enumerate(ids)}


#: `similar` over the table documents, in DuckDB's SQL.
ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
    s as (select doc_id, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as shingle from d),
    n as (select doc_id, count(*) as n from s group by doc_id),
    o as (select a.doc_id as x, b.doc_id as y, count(*) as same from s a join s b using (shingle) where a.doc_id < b.doc_id group by all),
    l as (select x, y from o join n a on a.doc_id = x join n b on b.doc_id = y where 100 * same >= 80 * (a.n + b.n - same)),
    e as (select x, y from l union all select y, x from l),
    r as (select doc_id, doc_id as low from documents union select e.y, r.low from r join e on e.x = r.doc_id)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.low as component_id from documents d left join n using (doc_id) join (select doc_id, min(low) as low from r group by doc_id) m using (doc_id)
"""
