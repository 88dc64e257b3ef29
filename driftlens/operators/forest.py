"""Anomaly scores of feature vectors: isolation forest, and reconstruction by principal components or by a small
non-linear autoencoder.

Means, deviations, covariances, the moments of the scores and the edge of anomalies are taken from all rows. Only the
forest's trees and the network's weights are fitted on a sample of bounded size (``SAMPLE`` or ``fit_rows`` rows, drawn
by a hash of the id); they are of a size that the parameters bound, whatever the data. Vectors that are null, of
another length than most, or with a null or an infinite value in them get a null score. With fewer than two others
all scores are 0.5. Empty tables give empty results.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.storage import cut

#: Rows that trees are fitted on, at most.
SAMPLE = 20_000
#: Buckets of a round of the search for a quantile.
BUCKETS = 1024


def standardised(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """``(id, z)``: each dimension less its mean, over its population deviation (plus 1e-8).

    Means and deviations are aggregates by dimension, a row per dimension; they are broadcast.
    """
    z = F.zip_with(vector, "stats", lambda x, s: (x.cast("double") - s["m"]) / s["s"])
    return rows.crossJoin(F.broadcast(_stats(rows, vector))).select(F.col(id_), z.alias("z"))  # stats is one row


def _stats(rows: DataFrame, vector: str) -> DataFrame:
    """One row: mean and population deviation (plus 1e-8) of each dimension."""
    flat = rows.select(F.posexplode(vector).alias("dim", "x")).select("dim", F.col("x").cast("double").alias("x"))
    return flat.groupBy("dim").agg(F.avg("x").alias("m"), (F.stddev_pop("x") + 1e-8).alias("s")).agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("stats"))


def able(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vectors have finite values and the length that most of these have, and that length."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.where(F.col(vector).isNotNull() & ~wrong)
    widths = whole.groupBy(F.size(vector).alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    width = widths[0]["w"] if widths else 0
    return whole.where(F.size(vector) == width), width


def moments(rows: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each dimension over all rows."""
    stats = _stats(rows, vector).first()["stats"]
    return np.array([d["m"] for d in stats]), np.array([d["s"] for d in stats])


def covariance(rows: DataFrame, vector: str, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Sums of products of the standardised dimensions over all rows; a task sends one row a dimension."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(mean), len(mean)))
        for b in batches:
            if len(b):
                z = (np.stack(b[vector].to_numpy()).astype(np.float64) - mean) / sd
                total += z.T @ z
        yield pd.DataFrame({"i": range(len(mean)), "row": list(total)})

    parts = rows.select(vector).mapInPandas(products, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((len(mean), len(mean)))
    for r in cells:
        out[r["i"], r["j"]] = r["x"]
    return out


def quantile(values: DataFrame, name: str, q: float) -> float:
    """The exact quantile, between neighbours in proportion, by counts in ever narrower buckets; nothing is sorted or collected whole."""
    known = values.where(F.col(name).isNotNull())
    low, high, n = known.agg(F.min(name), F.max(name), F.count(name)).first()

    def at(rank: int) -> float:
        lo, hi, k = low, high, rank
        while lo < hi:
            bucket = F.least(F.floor((F.col(name) - lo) / (hi - lo) * BUCKETS), F.lit(BUCKETS - 1))
            counts = known.where(F.col(name).between(lo, hi)).groupBy(bucket.alias("b")).agg(F.count(name).alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi")).orderBy("b").collect()
            for c in counts:
                if k < c["n"]:
                    lo, hi = c["lo"], c["hi"]
                    break
                k -= c["n"]
        return lo

    place = (n - 1) * q
    below = int(np.floor(place))
    first = at(below)
    return first + (at(below + 1) - first) * (place - below) if place > below else first


def sample(rows: DataFrame, id_: str, vector: str, size: int = SAMPLE, seed: int = 42) -> np.ndarray:
    """At most ``size`` vectors, those with the smallest hashes of the id."""
    drawn = rows.orderBy(F.xxhash64(F.col(id_), F.lit(seed)), id_).limit(size).select(vector).collect()
    return np.array([r[0] for r in drawn], dtype=np.float64)


def _average_path(n: np.ndarray | int) -> np.ndarray:
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, np.ndarray]:
    """One isolation tree as arrays: split dimension (-1 for a leaf), threshold, children, expected depth of a leaf."""
    dim, cut, left, right, depth = [], [], [], [], []

    def build(rows: np.ndarray, level: int) -> int:
        me = len(dim)
        for a, v in zip((dim, cut, left, right, depth), (-1, 0.0, -1, -1, level + float(_average_path(len(rows)))), strict=True):
            a.append(v)
        if level < limit and len(rows) > 1:
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            able = np.flatnonzero(high > low)
            if len(able):
                d = int(rng.choice(able))
                t = float(rng.uniform(low[d], high[d]))
                below = x[rows, d] <= t
                dim[me], cut[me] = d, t
                left[me], right[me] = build(rows[below], level + 1), build(rows[~below], level + 1)
        return me

    build(np.arange(len(x)), 0)
    return {"dim": np.array(dim), "cut": np.array(cut), "left": np.array(left), "right": np.array(right), "depth": np.array(depth)}


def path_lengths(trees: list[dict[str, np.ndarray]], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for t in trees:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            d = t["dim"][at]
            inner = d >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(d, 0)] <= t["cut"][at]
            at = np.where(inner, np.where(go, t["left"][at], t["right"][at]), at)
        total += t["depth"][at]
    return total / len(trees)


def _raw(rows: DataFrame, id_: str, vector: str, raw, width: int) -> DataFrame:
    """``(id, value)``: the raw value of each vector, null where it has none. Worked out once and kept as a table."""

    def valued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = np.array([v is not None and len(v) == width and bool(np.isfinite(np.asarray(v, dtype=np.float64)).all()) for v in b[vector]], dtype=bool)
            value = np.full(len(b), None, dtype=object)
            if ok.any():
                value[ok] = raw(np.stack(b.loc[ok, vector].to_numpy()).astype(np.float64)).tolist()
            yield pd.DataFrame({id_: b[id_], "value": value})

    kind = dict(rows.dtypes)[id_]
    return cut(rows.select(id_, vector).mapInPandas(valued, f"{id_} {kind}, value double"), "raw-scores")


def _scores(valued: DataFrame, id_: str, mean: float, sd: float, higher: bool, edge: float) -> DataFrame:
    """Scores from raw values: logistic of the z-value, towards 1 the stranger; an anomaly beyond ``edge``."""
    value = F.col("value")
    z = (value - mean) / sd
    power = F.when(value.isNotNull(), F.greatest(F.least(-z if higher else z, F.lit(50.0)), F.lit(-50.0)))
    beyond: Column = value > edge if higher else value < edge
    return valued.select(id_, (1 / (1 + F.exp(power))).alias("score"), beyond.alias("is_anomaly"))


def _spread(valued: DataFrame) -> tuple[float, float]:
    """Mean and deviation of the raw values of all rows."""
    m, s = valued.agg(F.avg("value"), F.stddev_pop("value")).first()
    return m, s + 1e-8


def _even(rows: DataFrame, id_: str) -> DataFrame:
    return rows.select(id_, F.lit(0.5).alias("score"), F.lit(False).alias("is_anomaly"))


@dataclass
class Model:
    """A fitted detector: arrays by name, the width of its vectors, and the centre, spread and edge of the raw values it was fitted on."""

    kind: str
    arrays: dict[str, np.ndarray]
    width: int
    centre: float = 0.0
    spread: float = 1.0
    edge: float = 0.0

    def raw(self, v: np.ndarray) -> np.ndarray:
        a = self.arrays
        z = (v - a["mean"]) / a["sd"]
        if self.kind == "forest":
            trees = [{k: a[f"{k}{i}"] for k in ("dim", "cut", "left", "right", "depth")} for i in range(int(a["trees"]))]
            return -(2.0 ** (-path_lengths(trees, z) / float(a["unit"])))
        if self.kind == "components":
            return ((z - z @ a["basis"].T @ a["basis"]) ** 2).mean(axis=1)
        h, n = z, int(a["layers"])
        for j in range(n):
            h = h @ a[f"w{j}"] + a[f"b{j}"]
            if j < n - 1:
                h = np.maximum(h, 0)
        return ((z - h) ** 2).mean(axis=1)

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the model as a table of one row."""
        held = io.BytesIO()
        np.savez(held, **self.arrays)
        row = (self.kind, bytearray(held.getvalue()), self.width, float(self.centre), float(self.spread), float(self.edge))
        spark.createDataFrame([row], "kind string, arrays binary, width int, centre double, spread double, edge double").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        r = spark.read.parquet(path).first()
        with np.load(io.BytesIO(bytes(r["arrays"]))) as held:
            return Model(r["kind"], dict(held), r["width"], r["centre"], r["spread"], r["edge"])


def _settled(model: Model, rows: DataFrame, id_: str, vector: str, contamination: float | None) -> tuple[Model, DataFrame]:
    """The model with the centre, spread and edge of its raw values over all rows, and these values."""
    valued = _raw(rows, id_, vector, model.raw, model.width)
    model.centre, model.spread = _spread(valued)
    model.edge = model.centre if contamination is None else quantile(valued, "value", contamination)
    return model, valued


def predict(model: Model | None, rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """``(id, score, is_anomaly)`` of any rows by a fitted model; 0.5 for all without one."""
    return _even(rows, id_) if model is None else _verdict(model, _raw(rows, id_, vector, model.raw, model.width), id_)


def _verdict(model: Model, valued: DataFrame, id_: str) -> DataFrame:
    return _scores(valued, id_, model.centre, model.spread, higher=model.kind != "forest", edge=model.edge)


def _forest(rows: DataFrame, id_: str, vector: str, trees: int, per_tree: int, contamination: float, seed: int) -> tuple[Model, DataFrame] | None:
    good, width = able(rows, vector)
    x = sample(good, id_, vector)
    if len(x) < 2:
        return None
    mean, sd = moments(good, vector)
    z = (x - mean) / sd
    rng = np.random.default_rng(seed)
    n = min(per_tree, len(z))
    made = [grow(z[rng.choice(len(z), n, replace=False)], rng, int(np.ceil(np.log2(max(n, 2))))) for _ in range(trees)]
    arrays = {f"{k}{i}": v for i, t in enumerate(made) for k, v in t.items()}
    arrays |= {"mean": mean, "sd": sd, "unit": np.array(float(_average_path(n))), "trees": np.array(trees)}
    return _settled(Model("forest", arrays, width), rows, id_, vector, contamination)


def fit_forest(rows: DataFrame, id_: str, vector: str, trees: int = 100, per_tree: int = 256, contamination: float = 0.1, seed: int = 42) -> Model | None:
    made = _forest(rows, id_, vector, trees, per_tree, contamination, seed)
    return made and made[0]


def isolation_forest(rows: DataFrame, id_: str, vector: str, trees: int = 100, per_tree: int = 256, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """``(id, score, is_anomaly)``: the shorter the paths that isolate a vector, the nearer to 1."""
    made = _forest(rows, id_, vector, trees, per_tree, contamination, seed)
    return _verdict(*made, id_) if made else _even(rows, id_)


def reconstruction(rows: DataFrame, id_: str, vector: str, k: int = 16) -> DataFrame:
    """``(id, score, is_anomaly)`` from the error of a rebuild by ``k`` principal components."""
    good, width = able(rows, vector)
    if len(good.select(F.lit(1)).head(2)) < 2:
        return _even(rows, id_)
    mean, sd = moments(good, vector)
    basis = np.linalg.eigh(covariance(good, vector, mean, sd))[1][:, ::-1].T[:k]
    return _verdict(*_settled(Model("components", {"mean": mean, "sd": sd, "basis": basis}, width), rows, id_, vector, None), id_)


def train_autoencoder(z: np.ndarray, layers: tuple[int, ...], epochs: int, rate: float, batch: int, dropout: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights of a symmetric network with rectified layers, by Adam on the squared error."""
    rng = np.random.default_rng(seed)
    sizes = [z.shape[1], *layers, *layers[-2::-1], z.shape[1]]
    net = [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    m = [(np.zeros_like(w), np.zeros_like(b)) for w, b in net]
    v = [(np.zeros_like(w), np.zeros_like(b)) for w, b in net]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for i in range(0, len(z), batch):
            x = z[order[i : i + batch]]
            acts, masks = [x], []
            for j, (w, b) in enumerate(net):
                h = acts[-1] @ w + b
                if j < len(net) - 1:
                    keep = (h > 0) * (rng.random(h.shape) >= dropout) / (1 - dropout)
                    masks.append(keep)
                    h = h * keep
                acts.append(h)
            g = 2 * (acts[-1] - x) / x.size
            step += 1
            for j in range(len(net) - 1, -1, -1):
                grads = (acts[j].T @ g, g.sum(axis=0))
                if j:
                    g = (g @ net[j][0].T) * masks[j - 1]
                new = []
                for q in range(2):
                    a = 0.9 * m[j][q] + 0.1 * grads[q]
                    c = 0.999 * v[j][q] + 0.001 * grads[q] ** 2
                    m[j] = (a, m[j][1]) if q == 0 else (m[j][0], a)
                    v[j] = (c, v[j][1]) if q == 0 else (v[j][0], c)
                    new.append(net[j][q] - rate * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8))
                net[j] = (new[0], new[1])
    return net


def _network(rows: DataFrame, id_: str, vector: str, layers: tuple[int, ...], epochs: int, rate: float, batch: int, dropout: float, seed: int, fit_rows: int) -> tuple[Model, DataFrame] | None:
    good, width = able(rows, vector)
    if len(good.select(F.lit(1)).head(2)) < 2:
        return None
    x = sample(good, id_, vector, fit_rows)
    mean, sd = moments(good, vector)
    net = train_autoencoder((x - mean) / sd, layers, epochs, rate, batch, dropout, seed)
    arrays = {"mean": mean, "sd": sd, "layers": np.array(len(net))} | {f"w{j}": w for j, (w, _) in enumerate(net)} | {f"b{j}": b for j, (_, b) in enumerate(net)}
    return _settled(Model("network", arrays, width), rows, id_, vector, None)


def fit_autoencoder(rows: DataFrame, id_: str, vector: str, layers: tuple[int, ...] = (128, 64, 16), epochs: int = 20, rate: float = 1e-3, batch: int = 32, dropout: float = 0.2, seed: int = 42, fit_rows: int = 2000) -> Model | None:
    made = _network(rows, id_, vector, layers, epochs, rate, batch, dropout, seed, fit_rows)
    return made and made[0]


def autoencoder(rows: DataFrame, id_: str, vector: str, layers: tuple[int, ...] = (128, 64, 16), epochs: int = 20, rate: float = 1e-3, batch: int = 32, dropout: float = 0.2, seed: int = 42, fit_rows: int = 2000) -> DataFrame:
    """``(id, score, is_anomaly)`` from the error of a small network's rebuild, its weights fitted on at most ``fit_rows`` rows."""
    made = _network(rows, id_, vector, layers, epochs, rate, batch, dropout, seed, fit_rows)
    return _verdict(*made, id_) if made else _even(rows, id_)
