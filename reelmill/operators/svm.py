"""Linear SVMs with squared hinge loss, many at once: one pass over the rows serves all of them.

A model is the least of 1/2 |w|^2 + sum of c_i max(0, 1 - y_i (w . x_i))^2, where x_i ends in a constant 1
for the intercept and c_i is the row's weight for this model, 0 if the model does not learn from it.
Each pass sends the models' coefficients to the tasks, which add up losses and gradients of their rows
for all models; sums meet by blocks of columns, and one vector per model comes to the driver, where
quasi-Newton steps are taken side by side. The dual value of the same rows bounds the optimum from below, so the
gap between both tells how good a model is, whatever the steps were; a model stops when its relative gap is small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a gradient that are added up in one group, and past steps that a direction is made of.
BLOCK, HISTORY = 4096, 10
#: Bytes of all tasks' sums up to which they are added on the driver without a shuffle; that many may come in every pass.
SUMMED = 4 << 20
#: Relative gap between primal and dual value at which a model is done.
GAP = 1e-4


@dataclass
class LinearSvm:
    """Coefficients by term, the intercept, and what is known of their quality: primal and dual value, gradient norm."""

    coefficients: np.ndarray
    intercept: float
    primal: float = float("nan")
    dual: float = float("nan")
    gradient: float = float("nan")


class Rows:
    """The feature vectors of a batch as one list of entries."""

    def __init__(self, features: pa.Array):
        features = features.storage if isinstance(features, pa.ExtensionArray) else features
        kind, idx, val = (features.field(n) for n in ("type", "indices", "values"))
        self.n = len(features)
        self.val = val.flatten().to_numpy(zero_copy_only=False)
        self.sizes = np.diff(val.offsets.to_numpy())
        dense = np.asarray(kind.to_numpy(zero_copy_only=False)) == 1
        if not dense.any():
            self.idx = idx.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            self.idx = np.concatenate([np.zeros(0, np.int64), *(np.arange(n) if d else np.asarray(i.as_py()) for d, n, i in zip(dense, self.sizes, idx))]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), self.sizes)

    def margins(self, w: np.ndarray) -> np.ndarray:
        """Rows x models; the last column of ``w`` are intercepts. Terms beyond its size weigh nothing."""
        known = self.idx < w.shape[1] - 1
        idx, val, row = self.idx[known], self.val[known], self.row[known]
        return np.stack([np.bincount(row, weights=c[idx] * val, minlength=self.n) + c[-1] for c in w], axis=1)

    def sums(self, factors: np.ndarray, size: int) -> np.ndarray:
        """For each model (column of ``factors``) the sum of factor times row."""
        return np.stack([np.append(np.bincount(self.idx, weights=f[self.row] * self.val, minlength=size), f.sum()) for f in factors.T])


def _evaluate(rows: DataFrame, w: np.ndarray, tasks: int, some: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each model its primal and dual value and gradient, and the margins' part of the dual.

    ``some``: the places in ``costs`` of the models in ``w``, if they are not all.
    """
    m, size = w.shape
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        total, stats = np.zeros((m, size)), np.zeros((m, 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = Rows(batch.column("features"))
            y = np.where(batch.column("label").to_numpy(zero_copy_only=False) == 1, 1.0, -1.0)
            cost = batch.column("costs").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cost = cost if some is None else cost[:, some]
            short = np.maximum(0.0, 1.0 - y[:, None] * x.margins(w))
            alpha = 2.0 * cost * short
            stats[:, 0] += (cost * short * short).sum(axis=0)
            stats[:, 1] += alpha.sum(axis=0)
            total += x.sums(alpha * y[:, None], size - 1)
        parts = [(-1, stats.tobytes()), *((b, total[:, b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in range(-(-size // BLOCK)))]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["block", "part"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["part"].iloc[0]).copy()
        for part in pdf["part"].iloc[1:]:
            total += np.frombuffer(part)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [total.tobytes()]})

    schema = "block int, part binary"
    found = rows.select("features", "label", "costs").mapInArrow(add, schema)
    if tasks * w.nbytes > SUMMED:
        found = found.groupBy("block").applyInPandas(join, schema)
    found = found.toArrow()
    shared.destroy()
    pulled, stats = np.zeros((m, size)), np.zeros((m, 2))
    for block, part in zip(found["block"].to_pylist(), found["part"].to_pylist()):
        if block < 0:
            stats += np.frombuffer(part).reshape(m, 2)
        else:
            pulled[:, block * BLOCK : (block + 1) * BLOCK] += np.frombuffer(part).reshape(m, -1)
    # pulled = sum of alpha y x; alpha^2 / (4 c) adds up to the loss.
    primal = 0.5 * (w * w).sum(axis=1) + stats[:, 0]
    dual = stats[:, 1] - stats[:, 0] - 0.5 * (pulled * pulled).sum(axis=1)
    return primal, dual, w - pulled, stats[:, 1]


class _Steps:
    """Quasi-Newton steps of one model with halving of those that do not lower its value enough."""

    def __init__(self, size: int):
        self.at = self.trial = np.zeros(size)
        self.value, self.gradient = np.inf, None
        self.past: list[tuple[np.ndarray, np.ndarray]] = []
        self.step, self.best_dual, self.done = 1.0, -np.inf, False

    def seen(self, value: float, dual: float, gradient: np.ndarray) -> None:
        """Take in the values at the trial point and choose the next one."""
        self.best_dual = max(self.best_dual, dual)
        if self.gradient is not None:
            enough = self.value + 1e-4 * self.step * float(self.gradient @ self.direction)
            if value > enough and self.step > 1e-8:
                self.step /= 2
                self.trial = self.at + self.step * self.direction
                return
            if value >= self.value:  # no further progress in this precision
                self.done = True
                return
            s, y = self.trial - self.at, gradient - self.gradient
            if s @ y > 1e-12 * (y @ y):
                self.past = [*self.past, (s, y)][-HISTORY:]
        self.at, self.value, self.gradient = self.trial, value, gradient
        if value - self.best_dual <= GAP * max(value, 1e-12):
            self.done = True
            return
        self.direction = -self._scaled(gradient)
        self.step = 1.0 if self.past else 1.0 / max(1.0, float(np.linalg.norm(gradient)))
        self.trial = self.at + self.step * self.direction

    def _scaled(self, g: np.ndarray) -> np.ndarray:
        q, used = g.copy(), []
        for s, y in reversed(self.past):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append(a)
        if self.past:
            s, y = self.past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.past, reversed(used)):
            q += (a - (y @ q) / (s @ y)) * s
        return q


def fit_many(rows: DataFrame, size: int, models: int, max_passes: int) -> list[LinearSvm]:
    """Models of rows (features, label, costs): ``costs`` holds the row's weight for each of the models.

    ``rows`` are read once in each pass, so they should be stored. Models that are done take no part in further passes.
    """
    steps = [_Steps(size + 1) for _ in range(models)]
    tasks = rows.rdd.getNumPartitions()
    for _ in range(max_passes):
        open_ = [i for i, s in enumerate(steps) if not s.done]
        if not open_:
            break
        w = np.stack([steps[i].trial for i in open_])
        primal, dual, gradient, _ = _evaluate(rows, w, tasks, open_)
        for at, i in enumerate(open_):
            steps[i].seen(float(primal[at]), float(dual[at]), gradient[at])
    return [LinearSvm(s.at[:-1], float(s.at[-1]), s.value, s.best_dual, float(np.linalg.norm(s.gradient))) for s in steps]


def certificate(rows: DataFrame, svms: list[LinearSvm]) -> DataFrame:
    """(model, primal, dual, gradient_norm): how far given models are from the best ones for rows (features, label, costs)."""
    w = np.stack([np.append(s.coefficients, s.intercept) for s in svms])
    primal, dual, gradient, _ = _evaluate(rows, w, rows.rdd.getNumPartitions())
    found = [(i, float(p), float(d), float(np.linalg.norm(g))) for i, (p, d, g) in enumerate(zip(primal, dual, gradient))]
    return rows.sparkSession.createDataFrame(found, "model int, primal double, dual double, gradient_norm double")


def with_margins(df: DataFrame, svms: list[LinearSvm], column: str) -> DataFrame:
    """df with the margins of all models as an array."""
    shared = df.sparkSession.sparkContext.broadcast(np.stack([np.append(s.coefficients, s.intercept) for s in svms]))
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(T.DoubleType()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = Rows(batch.column("features")).margins(shared.value)
                places = pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(places, pa.array(found.ravel()))], names=schema.names)

    return df.mapInArrow(score, schema)


def fit_sigmoids(held_out: DataFrame, models: int, passes: int = 50) -> list[tuple[float, float]]:
    """Platt's sigmoid (slope, offset) of each model, from rows (model, label, margin); all in the same passes.

    His smoothed targets are fitted by Newton steps, halved where they do not lower the loss.
    """
    sums = {r["model"]: r for r in held_out.groupBy("model").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).collect()}
    goal = np.array([[(sums[i]["p"] + 1.0) / (sums[i]["p"] + 2.0), 1.0 / (sums[i]["n"] + 2.0)] if i in sums else [0.5, 0.5] for i in range(models)])
    # Without any slope, the offset that fits best.
    at = np.array([[0.0, np.log((sums[i]["p"] + 1.0) / (sums[i]["n"] + 1.0))] if i in sums else [0.0, 0.0] for i in range(models)])
    value, step, direction, done = np.full(models, np.inf), np.ones(models), np.zeros((models, 2)), np.zeros(models, bool)
    trial = at.copy()

    def of(numbers) -> Column:
        return F.get(F.array(*(F.lit(float(x)) for x in numbers)), F.col("model"))

    for _ in range(passes):
        z = F.col("margin") * of(trial[:, 0]) + of(trial[:, 1])
        t = F.when(F.col("label") == 1, of(goal[:, 0])).otherwise(of(goal[:, 1]))
        rows = held_out.select("model", "margin", z.alias("z"), t.alias("t"))
        p = 1 / (1 + F.exp(-F.col("z")))
        # log(1 + exp(z)) - t z, written so that neither side overflows
        loss = F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("t") * F.col("z")
        d, h, m = p - F.col("t"), p * (1 - p), F.col("margin")
        found = rows.groupBy("model").agg(F.sum(loss).alias("f"), F.sum(d * m).alias("ga"), F.sum(d).alias("gb"), F.sum(h * m * m).alias("haa"), F.sum(h * m).alias("hab"), F.sum(h).alias("hbb"))
        for r in found.collect():  # one row for each model
            i = r["model"]
            if done[i]:
                continue
            if r["f"] > value[i] and step[i] > 1e-6:
                step[i] /= 2
            else:
                small = value[i] - r["f"] <= 1e-10 * max(1.0, abs(r["f"]))
                at[i], value[i], step[i] = trial[i], min(value[i], r["f"]), 1.0
                if small:
                    done[i] = True
                    continue
                hessian = np.array([[r["haa"] + 1e-9, r["hab"]], [r["hab"], r["hbb"] + 1e-9]])
                direction[i] = -np.linalg.solve(hessian, [r["ga"], r["gb"]])
            trial[i] = at[i] + step[i] * direction[i]
        if all(done[i] for i in sums):
            break
    return [(float(a), float(b)) for a, b in at]
