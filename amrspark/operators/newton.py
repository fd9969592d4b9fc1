"""Many penalised logistic models at once: one pass over the rows per Newton step of all of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest gradient component per unit of weight at which a model counts as converged.
TOLERANCE = 1e-9
MAX_STEPS = 100
#: Numbers of all second derivatives of a step: what a task and the driver hold.
MAX_CURVATURE = 1 << 26


@dataclass(frozen=True)
class Problem:
    """A model over the rows whose fold is not `without`: `penalty` / 2 times the squared slopes
    plus the weighted loss, rows of class 1 and 0 weighing `positive` and `negative`."""

    penalty: float
    without: int | None = None
    positive: float = 1.0
    negative: float = 1.0


@dataclass
class Linear:
    """A fitted model. `gradient` is the largest component at the result, per unit of weight."""

    coefficients: np.ndarray
    intercept: float
    gradient: float
    steps: int

    @property
    def converged(self) -> bool:
        return self.gradient <= TOLERANCE


def fit(rows: DataFrame, problems: list[Problem], size: int) -> list[Linear]:
    """Fit all problems to `rows` (v: array<double> of `size`, y: 0 or 1, w: weight, fold).

    Every step is one aggregate over the rows: loss, gradient and curvature of all models that have
    not converged, summed per task and then per model. The driver solves the small systems; a step
    that does not lower a model's loss is halved. Null or missing rows give models of zeros.
    """
    width = size + 1
    if len(problems) * width * width > MAX_CURVATURE:
        raise ValueError(f"{len(problems)} models of {size} features are too large for Newton steps")
    now = np.zeros((len(problems), width))
    step = np.zeros_like(now)
    loss = np.full(len(problems), np.inf)
    gradient = np.full(len(problems), np.inf)
    steps = np.zeros(len(problems), int)
    open_ = list(range(len(problems)))
    for _ in range(MAX_STEPS):
        if not open_:
            break
        sums = _sums(rows, [problems[m] for m in open_], now[open_] + step[open_])
        for place, m in list(enumerate(open_)):
            weight, value, slope, curve = sums.get(place, (0.0, 0.0, np.zeros(width), np.eye(width)))
            at = now[m] + step[m]
            kept = np.append(np.full(size, problems[m].penalty), 0.0)
            value += 0.5 * float(kept @ (at * at))
            if value > loss[m] + 1e-12 * abs(loss[m]) and np.abs(step[m]).max() > 1e-12:
                step[m] /= 2
                continue
            slope = slope + kept * at
            now[m], loss[m] = at, value
            steps[m] += 1
            gradient[m] = np.abs(slope).max() / max(weight, 1e-300) if weight else 0.0
            curve = curve + np.diag(kept)
            step[m] = -np.linalg.lstsq(curve, slope, rcond=None)[0]
            if gradient[m] <= TOLERANCE:
                open_.remove(m)
    return [Linear(b[:-1], float(b[-1]), float(g), int(s)) for b, g, s in zip(now, gradient, steps, strict=True)]


def _sums(rows: DataFrame, problems: list[Problem], betas: np.ndarray) -> dict[int, tuple]:
    """Per problem: weight, loss, gradient and curvature of the loss at its coefficients."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            x = _matrix(batch.column("v"), betas.shape[1] - 1)
            y, w, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "fold"))
            for m, p in enumerate(problems):
                mine = fold != p.without if p.without is not None else np.ones(len(y), bool)
                own, side = x[mine], y[mine]
                weight = w[mine] * np.where(side == 1, p.positive, p.negative)
                z = own @ betas[m]
                # log(1 + exp(-z)) of the own side, without overflow
                signed = np.where(side == 1, z, -z)
                lost = np.logaddexp(0.0, -signed)
                chance = np.exp(-np.logaddexp(0.0, -z))
                pull, bend = weight * (chance - side), weight * chance * (1 - chance)
                new = (weight.sum(), float(weight @ lost), own.T @ pull, (own * bend[:, None]).T @ own)
                sums[m] = [a + b for a, b in zip(sums[m], new, strict=True)] if m in sums else list(new)
        yield _row_batch(sums)

    def merge(table: pa.Table) -> pa.Table:
        m = table["m"][0].as_py()
        parts = [_numbers(b, betas.shape[1]) for b in table["sums"].to_pylist()]
        return pa.Table.from_batches([_row_batch({m: [sum(c) for c in zip(*parts, strict=True)]})])

    layout = "m int, sums binary"
    found = rows.select("v", "y", "w", "fold").mapInArrow(add, layout).groupBy("m").applyInArrow(merge, layout)
    return {r["m"]: _numbers(bytes(r["sums"]), betas.shape[1]) for r in found.collect()}


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) if size else np.empty((len(column), 0))
    return np.hstack([flat, np.ones((len(column), 1))])


def _row_batch(sums: dict[int, list]) -> pa.RecordBatch:
    packed = [np.concatenate([[s[0], s[1]], s[2], s[3].ravel()]).tobytes() for s in sums.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["m", "sums"])


def _numbers(packed: bytes, width: int) -> tuple[float, float, np.ndarray, np.ndarray]:
    flat = np.frombuffer(packed)
    return float(flat[0]), float(flat[1]), flat[2 : 2 + width], flat[2 + width :].reshape(width, width)


def score(rows: DataFrame, model: Linear, v: str, out: str) -> DataFrame:
    """Add the linear score of each row."""
    weights = F.array(*[F.lit(float(c)) for c in model.coefficients]) if len(model.coefficients) else F.array().cast("array<double>")
    products = F.zip_with(v, weights, lambda a, b: a * b)
    return rows.withColumn(out, F.aggregate(products, F.lit(0.0), lambda a, b: a + b) + F.lit(model.intercept))


def held_out(rows: DataFrame, models: list[tuple[float, int, Linear]]) -> DataFrame:
    """(c, fold, p, y): each row scored by every model (c, fold, model) of its own fold, in one pass."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold"))
            for c, k, model in models:
                mine = np.flatnonzero(fold == k)
                if len(mine):
                    x = _matrix(batch.column("v").take(pa.array(mine)), len(model.coefficients))
                    p = x @ np.append(model.coefficients, model.intercept)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(mine), c)), pa.array(np.full(len(mine), k, np.int32)),
                            pa.array(p), pa.array(y[mine].astype(np.int32)),
                        ],
                        ["c", "fold", "p", "y"],
                    )

    return rows.select("v", "y", "fold").mapInArrow(place, "c double, fold int, p double, y int")
