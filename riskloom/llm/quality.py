"""Document quality: random Fourier features, ridge by partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialize, text_or_empty, training_ids

SYMBOLS = b"#$%&*|<>{}[]~^=\\_+@"
STATS = 20


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


CLASSES = np.stack([
    _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(bytes(range(48, 58))), _table(SYMBOLS), _table(b"|"), _table(b"!?"),
    _table(b".,;:"), _table(b" \t\n\r\x0b\x0c"), _table(b"\n"), _table(bytes(range(128, 256))), _table(b"$"), _table(b"%*"),
])


def statistics(data: bytes) -> np.ndarray:
    """Twenty numbers about one UTF-8 text; all zero for an empty one."""
    out = np.zeros(STATS)
    words = data.split()
    if not words:
        return out
    size, n = len(data), len(words)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    out[:12] = CLASSES @ counts / size
    different = set(words)
    lines = data.split(b"\n")
    out[12:] = (
        np.log1p(size), np.log1p(n), sum(map(len, words)) / n, len(different) / n, len(set(lines)) / len(lines),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(w[-1:] in b"#$%&*!" for w in words) / n, np.log1p(size / (1 + counts[46])),
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    beta: np.ndarray
    cuts: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.cuts, self.levels) if len(self.cuts) else np.full(len(stats), 0.5)


def _stats_of(column) -> np.ndarray:
    data = column.cast(pa.binary())
    return np.array([statistics(t.as_buffer().to_pybytes()) for t in data]).reshape(-1, STATS)


def _sums(batches, per_batch):
    """One row a task: the sum of ``per_batch`` (a flat array) over its batches."""
    total = None
    for batch in batches:
        if batch.num_rows:
            part = per_batch(batch)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.float64())], names=["i", "v"])


def _summed(rows: DataFrame, per_batch, size: int) -> np.ndarray:
    """Partition sums, summed again by position: what reaches the driver is ``size`` numbers, whatever the data.
    Sums are rounded, so the order in which tasks end does not show in the model."""
    parts = rows.transform(in_arrow, lambda it: _sums(it, per_batch), "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for r in parts.collect():
        out[r["i"]] = float(f"{r['v']:.10g}")
    return out


def pool(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic (rising) fit by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            weight = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / weight, weight, a[2] + b[2]])
    return np.concatenate([np.full(int(k), v) for v, _, k in blocks]) if blocks else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, width: int = 200, gamma: float = 0.05, ridge: float = 1e-2, bins: int = 200,
        seed: int = 7, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fold, the first by a hash of the id; the
    bound is what makes the broadcast of their ids bounded. Two thirds of them give the normal equations, the rest
    the calibration, split by a second hash. Three passes over the sample sum moments, normal equations and
    calibration counts within each task; the driver solves one (width + 1)-square system.

    With no usable label of either class, as in empty tables, the model scores 0.5 everywhere. Null texts count as empty,
    null ids and labels not at all, an id labelled twice counts as good if either says so, texts are read whole, and no
    other columns of ``docs`` are read, whatever their names."""
    chosen = training_ids(labels, "quality", sample)
    part = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(3)) == 0).cast("int")
    rows = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("t")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("t", "label", part.alias("part"))

    def stats_rows(batches):
        for batch in batches:
            stats = _stats_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(stats), pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["s", "label", "part"])

    rows = materialize(rows.transform(in_arrow, stats_rows, "s array<double>, label int, part int"), "quality-sample")
    stats_in = lambda batch: np.array(batch.column(0).to_pylist()).reshape(-1, STATS)
    label_in = lambda batch: np.array(batch.column(1).to_pylist(), dtype=float)
    part_in = lambda batch: np.array(batch.column(2).to_pylist())

    def moments(batch):
        s = stats_in(batch)
        return np.concatenate([[len(s), label_in(batch).sum()], s.sum(axis=0), (s * s).sum(axis=0)])

    sums = _summed(rows, moments, 2 + 2 * STATS)
    n, ones = sums[:2]
    rng = np.random.default_rng(seed)
    mean = sums[2 : 2 + STATS] / max(n, 1)
    spread = np.sqrt(np.maximum(sums[2 + STATS :] / max(n, 1) - mean**2, 0)) + 1e-6
    directions = rng.normal(0, np.sqrt(2 * gamma), (STATS, width))
    phases = rng.uniform(0, 2 * np.pi, width)
    model = Model(mean, spread, directions, phases, np.zeros(width + 1), np.zeros(0), np.zeros(0))
    if not 0 < ones < n:
        return model
    size = width + 1

    def equations(batch):
        use = part_in(batch) == 0
        x, y = model.features(stats_in(batch)[use]), label_in(batch)[use]
        return np.concatenate([(x.T @ x).ravel(), x.T @ y])

    sums = _summed(rows, equations, size * size + size)
    fitted = np.linalg.solve(sums[: size * size].reshape(size, size) + ridge * np.eye(size), sums[size * size :])
    model = Model(mean, spread, directions, phases, fitted, np.zeros(0), np.zeros(0))
    edges = np.linspace(-0.25, 1.25, bins + 1)

    def counted(batch):
        use = part_in(batch) == 1
        place = np.clip(np.searchsorted(edges, model.raw(stats_in(batch)[use]), side="right") - 1, 0, bins - 1)
        y = label_in(batch)[use]
        return np.concatenate([np.bincount(place, minlength=bins).astype(float), np.bincount(place, weights=y, minlength=bins)])

    sums = _summed(rows, counted, 2 * bins)
    seen, good = sums[:bins], sums[bins:]
    if not seen.sum():
        model.cuts, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    use = seen > 0
    model.cuts = ((edges[:-1] + edges[1:]) / 2)[use]
    model.levels = np.clip(pool(good[use] / seen[use], seen[use]), 0.0, 1.0)
    return model


def quality(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row (id, score) per row of ``docs``: score between 0 and 1 that the text is of good quality. One pass
    over whole texts, no shuffle. A null text counts as empty; an empty text has statistics of zero and is scored
    like any other; repeated rows score alike; an empty table gives an empty one; no other columns are read."""
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("t"))

    def run(batches):
        for batch in batches:
            scores = model.score(_stats_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return rows.transform(in_arrow, run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
