"""Toxicity by a chain of sparse linear classifiers.

Categories are predicted one after another; each model sees the words of the whole text and the probabilities of the
categories before it. While fitting, those earlier probabilities are out-of-fold predictions, so that later models learn from
inputs as uncertain as they will meet. A word counts once in a text, with its own weight and those of its beginnings.

The model's limits, the same at every size of the input: it is fitted on SAMPLE labelled documents at most, its features are hashed into DIM places,
and each linear model uses the SCREEN of them that tell its training rows apart best. They are chosen from grouped counts, a table of DIM rows at most; the
chosen features of the sample meet in one task, and the driver gets the weights. Scoring reads all rows and whole texts.
"""

from __future__ import annotations

import ctypes
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 1 << 18
#: Labelled rows used for fitting, at most: those with the smallest hash of their id.
SAMPLE = 8_000
FOLDS = 5
#: Features a model may use, at most: those that tell the classes apart best on its own training rows.
SCREEN = 3_000
BEGINNINGS = (4, 5, 6, 7)
CATEGORIES = ("low_quality", "toxic", "severe")
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]{2,}")


def forms_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]


def place_of(form: str) -> int:
    return zlib.crc32(form.encode("utf-8", "surrogatepass")) % DIM


def word_features(word: str) -> list[int]:
    return [place_of(x) for x in forms_of(word)]


def words_of(text: str | None) -> set[str]:
    return set(TOKEN.findall((text or "").lower()))


@dataclass
class Linear:
    """Sparse weights of the hashed features, weights of the earlier probabilities, bias."""

    index: np.ndarray
    weight: np.ndarray
    earlier: np.ndarray
    bias: float


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[Linear]
    thresholds: np.ndarray
    #: The words, and beginnings with a star, that the models' features stand for in the sample; no others have weight.
    forms: dict[str, int] = field(default_factory=dict)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def strengths(df: np.ndarray, hit: np.ndarray, n: int, up: int) -> np.ndarray:
    """How well each feature tells apart n rows, `up` of them in the class; in df of them and in hit of the class. 0 where it occurs once or never."""
    share = up / max(n, 1)
    out = (hit - df * share) / np.sqrt(df * share * (1 - share) + 1)
    out[df < 2] = 0
    return out


def strongest(strength: np.ndarray) -> np.ndarray:
    index = np.sort(np.argsort(-np.abs(strength), kind="stable")[:SCREEN])
    return index[strength[index] != 0]


def fit_linear(rows: np.ndarray, features: np.ndarray, earlier: np.ndarray, y: np.ndarray, l1: float = 1.0, l2: float = 0.05, steps: int = 150) -> Linear:
    """Logistic regression with both penalties by accelerated proximal steps; (rows, features) are the non-zero places of the matrix."""
    n, up = len(y), max(1, int(y.sum()))
    index = strongest(strengths(np.bincount(features, minlength=DIM), np.bincount(features, weights=y[rows], minlength=DIM), n, up))
    place = np.full(DIM, -1)
    place[index] = np.arange(len(index))
    keep = place[features] >= 0
    r, c = rows[keep], place[features[keep]]
    k, e = len(index), earlier.shape[1]
    w = np.zeros(k + e + 1)
    v, t = w.copy(), 1.0
    prior = np.log((up + 0.5) / (n - up + 0.5))
    norms = np.bincount(r, minlength=n)  # squared norm of each row
    rate = 4 / (max(1.0, float(np.sqrt((norms**2).mean()))) * n)

    def margin(w):
        z = np.bincount(r, weights=w[c], minlength=n) + w[-1] + prior
        return z + earlier @ w[k : k + e] if e else z

    def gradient(z):
        d = _sigmoid(z) - y
        return np.concatenate([np.bincount(c, weights=d[r], minlength=k), d @ earlier if e else [], [d.sum()]])

    def loss(z):
        return float(np.logaddexp(0, z).sum() - y @ z)

    low, still = np.inf, 0
    z = at_w = margin(v)  # of v and of w; margins are linear, so that those of v follow from those of w
    for _ in range(steps):
        g, base = gradient(z), loss(z)
        # Steps that no longer matter end the fit.
        still = still + 1 if base > low - 1e-4 * abs(low) else 0
        low = min(low, base)
        if still >= 8:
            break
        g[:k] += l2 * v[:k]
        while True:
            new = v - rate * g
            new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - rate * l1, 0)
            step, at_new = new - v, margin(new)
            if rate < 1e-9 or loss(at_new) + l2 / 2 * (new[:k] @ new[:k]) <= base + l2 / 2 * (v[:k] @ v[:k]) + g @ step + step @ step / (2 * rate) + 1e-9:
                break
            rate /= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, at_w = at_new + (t - 1) / t2 * (at_new - at_w), at_new
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
        rate *= 1.1
    used = w[:k] != 0
    return Linear(index[used], w[:k][used], w[k : k + e], float(w[-1] + prior))


def predict_linear(model: Linear, rows: np.ndarray, features: np.ndarray, earlier: np.ndarray, n: int) -> np.ndarray:
    dense = np.zeros(DIM)
    dense[model.index] = model.weight
    z = np.bincount(rows, weights=dense[features], minlength=n) + model.bias
    return _sigmoid(z + earlier @ model.earlier if len(model.earlier) else z)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Threshold of the highest F1; half way down to the next probability."""
    if not len(y) or not y.any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1
    k = int(np.argmax(f1))
    below = p[order[k + 1]] if k + 1 < len(y) else 0.0
    return float((p[order[k]] + below) / 2)


def fit_chain(rows: np.ndarray, features: np.ndarray, fold: np.ndarray, targets: np.ndarray, categories: tuple[str, ...] = CATEGORIES) -> Chain:
    n = len(fold)
    out_of_fold, models, thresholds = np.zeros((n, 0)), [], []
    for j in range(len(categories)):
        y, held = targets[:, j].astype(float), np.zeros(n)
        for f in range(FOLDS):
            train, test = fold != f, fold == f
            if not test.any() or not train.any():
                continue
            at = np.cumsum(train) - 1
            in_train = train[rows]
            m = fit_linear(at[rows[in_train]], features[in_train], out_of_fold[train], y[train])
            held[test] = predict_linear(m, rows, features, out_of_fold, n)[test]
        models.append(fit_linear(rows, features, out_of_fold, y))
        thresholds.append(best_threshold(held, y))
        out_of_fold = np.column_stack([out_of_fold, held])
    return Chain(categories, models, np.array(thresholds))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain | None:
    """A chain fitted on at most `sample` labelled documents; None where no document has labels.

    Categories: low_quality (quality 0), toxic (toxic 1), severe (both). Rows whose labels are null take no part; if an id has
    several labels, the largest of each counts.
    """
    labels = labels.where("doc_id is not null and quality is not null and toxic is not null")
    chosen = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    both = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [sorted({f for w in words_of(t) for f in word_features(w)}) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "toxic": b["toxic"], "features": found})

    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int")
    seen = both.mapInPandas(read, "doc_id long, quality int, toxic int, features array<int>")
    # Of several rows of one id, one.
    seen = seen.groupBy("doc_id").agg(F.min(F.struct("quality", "toxic", "features")).alias("r")).select("doc_id", (F.col("r.quality") == 0).alias("low"), (F.col("r.toxic") == 1).alias("toxic"), fold.alias("fold"), "r.features").checkpoint()
    known = seen.select("doc_id", "low", "toxic", "fold").toPandas()
    if not len(known):
        return None
    kinds = {"n": F.lit(True), "low": F.col("low"), "toxic": F.col("toxic"), "severe": F.col("low") & F.col("toxic")}
    counts = seen.select("low", "toxic", "fold", F.explode("features").alias("feature")).groupBy("feature").agg(*(F.count_if(of & (F.col("fold") == k)).cast("int").alias(f"{name}{k}") for name, of in kinds.items() for k in range(FOLDS)))
    # A row a hashed feature that two texts have: DIM at most, whatever the texts.
    table = counts.where(sum(F.col(f"n{k}") for k in range(FOLDS)) > 1).toPandas()
    wanted = np.zeros(DIM, dtype=bool)
    classes = {"low": known["low"].to_numpy(), "toxic": known["toxic"].to_numpy()}
    classes["severe"] = classes["low"] & classes["toxic"]
    place, folds = table["feature"].to_numpy(), known["fold"].to_numpy()
    for without in (None, *range(FOLDS)):
        ks = [k for k in range(FOLDS) if k != without]
        df = np.bincount(place, weights=sum(table[f"n{k}"] for k in ks), minlength=DIM)
        for name, y in classes.items():
            hit = np.bincount(place, weights=sum(table[f"{name}{k}"] for k in ks), minlength=DIM)
            train = folds != without if without is not None else np.ones(len(folds), dtype=bool)
            wanted[strongest(strengths(df, hit, int(train.sum()), max(1, int(y[train].sum()))))] = True
    del table, counts
    bits = docs.sparkSession.sparkContext.broadcast(wanted)

    @F.pandas_udf("array<int>")
    def chosen_of(features: pd.Series) -> pd.Series:
        return features.map(lambda f: f[bits.value[f]] if len(f) else f)

    def chain_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([b for b in batches if len(b)], ignore_index=True).sort_values("doc_id", ignore_index=True)
        rows = np.repeat(np.arange(len(got), dtype=np.int32), got["features"].map(len).to_numpy())
        features = np.concatenate([np.asarray(x, dtype=np.int32) for x in got["features"]])
        low, toxic = got["low"].to_numpy(), got["toxic"].to_numpy()
        chain = fit_chain(rows, features, got["fold"].to_numpy(), np.column_stack([low, toxic, low & toxic]))
        del got, rows, features
        give_back()
        for k, m in enumerate(chain.models):
            yield pd.DataFrame({"k": [k], "index": [m.index], "weight": [m.weight], "earlier": [m.earlier], "bias": [m.bias], "threshold": [chain.thresholds[k]]})

    def give_back() -> None:
        """Workers live on, and C's allocator keeps what a fit has freed."""
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    # The sample, `sample` rows of chosen features, meets in one task; the driver gets the weights.
    whole = seen.select("doc_id", "low", "toxic", "fold", chosen_of("features").alias("features")).repartition(1)
    found = whole.mapInPandas(chain_of, "k int, index array<long>, weight array<double>, earlier array<double>, bias double, threshold double").orderBy("k").collect()
    models = [Linear(np.array(r["index"], dtype=np.int64), np.array(r["weight"]), np.array(r["earlier"]), r["bias"]) for r in found]
    used = docs.sparkSession.sparkContext.broadcast(np.isin(np.arange(DIM), np.concatenate([m.index for m in models])))

    def carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms = {x for t in b["text"] for w in words_of(t) for x in forms_of(w) if used.value[place_of(x)]}
            yield pd.DataFrame({"form": sorted(forms)}, dtype=object)

    # As many as the models' features, and those of the sample's words that fall into the same places.
    forms = [r["form"] for r in both.select("text").mapInPandas(carried, "form string").distinct().collect()]
    return Chain(CATEGORIES, models, np.array([r["threshold"] for r in found]), {x: place_of(x) for x in forms})


def score(docs: DataFrame, chain: Chain | None, keep: bool = False) -> DataFrame:
    """doc_id, p_<category> for each category, is_toxic; with `keep`, the columns of docs instead and only rows that aren't toxic.

    A null or empty text has the probabilities of a text without words. Without a chain probabilities are null and nothing is toxic.
    Every row of docs is scored, repeated and null ids too; other columns don't matter.
    """
    names = [f"p_{c}" for c in (chain.categories if chain else CATEGORIES)]
    if chain is None:
        return docs if keep else docs.select(F.col("doc_id").cast("long"), *(F.lit(None).cast("double").alias(n) for n in names), F.lit(False).alias("is_toxic"))
    toxic = chain.categories.index("toxic")

    def probabilities(texts: list[str | None]) -> np.ndarray:
        z = np.zeros((len(texts), len(chain.models)))
        for i, text in enumerate(texts):
            words = words_of(text)
            # A feature counts once, however many words have it.
            carried = {chain.forms[w] for w in words & exact}
            for k, known in begun:
                carried.update(chain.forms[f"{x}*"] for x in {w[:k] for w in words if len(w) > k} & known)
            if carried:
                z[i] = sum(weights[f] for f in sorted(carried))
        p = np.zeros_like(z)
        for j, m in enumerate(chain.models):
            p[:, j] = _sigmoid(z[:, j] + m.bias + (p[:, :j] @ m.earlier if j else 0))
        return p

    weights = {f: np.zeros(len(chain.models)) for f in set(chain.forms.values())}
    for j, m in enumerate(chain.models):
        for f, w in zip(m.index.tolist(), m.weight.tolist(), strict=True):
            if f in weights:
                weights[f][j] = w
    exact = frozenset(chain.forms)
    begun = [(k, known) for k in BEGINNINGS if (known := frozenset(x[:-1] for x in exact if len(x) == k + 1 and x.endswith("*")))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = probabilities(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, p.T), pa.array(p[:, toxic] >= chain.thresholds[toxic])], names=["doc_id", *names, "is_toxic"])

    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        return pd.Series(probabilities(texts.tolist())[:, toxic] >= chain.thresholds[toxic])

    if keep:
        return docs.where(~rejected(F.col("text").cast("string")))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {', '.join(f'{n} double' for n in names)}, is_toxic boolean")
