"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = logistic(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): the pairwise term takes time linear in
the number of features. It is trained on at most `sample` labelled rows (the first in the order of a hash of doc_id), none of
them held out; scoring covers every document. Labels, language, source and doc_id are never inputs.

Defined cases: null and blank texts have no words and are scored by their statistics; a null n_chars counts as 0;
labels that are null are ignored, and of several labels for one doc_id the largest counts; repeated rows are scored
alike; without labels of both kinds every score is the share of label 1 (0.5 without labels); extra columns are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.quality import base_counts, class_counts
from gaugeworks.llm.words import Words, pieces

WORD_BITS = 14
WORDS = 1 << WORD_BITS
STATISTICS = 18


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def statistics(counts: np.ndarray, classes: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    words = np.maximum(counts[:, 0], 1)
    chars = np.maximum(classes.sum(axis=1), 1)
    own = [np.log1p(counts[:, 0]), counts[:, 1] / words, counts[:, 2] / words, np.log1p(counts[:, 3]), counts[:, 4] / words, np.log1p(np.maximum(n_chars, 0)), np.log1p(classes[:, 4]), (counts[:, 0] == 0).astype(float)]
    return np.column_stack([*own, *(classes / chars[:, None]).T])


def features(column: pa.Array, n_chars: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, first, index, value, statistics): hashed words of text i are at first[i] to first[i + 1], of length 1 together."""
    for at, to, raw, bounds in pieces(column):
        w = Words(raw, bounds, False)
        low = Words(raw, bounds, True)
        key = w.of() * WORDS + (low.hashes(3) & np.uint64(WORDS - 1)).astype(np.int64)
        key, n = np.unique(key, return_counts=True)
        value = np.log1p(n)
        text = key >> WORD_BITS
        norm = np.sqrt(np.bincount(text, weights=value**2, minlength=to - at))
        first = np.searchsorted(text, np.arange(to - at + 1))
        yield at, to, first, key & (WORDS - 1), value / norm[text], statistics(base_counts(raw, bounds, w), class_counts(raw, bounds), n_chars[at:to])


@dataclass
class Machine:
    w0: float
    w: np.ndarray  # hashed words, then statistics
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4) / 4

    def raw(self, first: np.ndarray, index: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        of = np.repeat(np.arange(n), np.diff(first))
        linear = np.bincount(of, weights=self.w[index] * value, minlength=n) + stats @ self.w[WORDS:]
        out = self.w0 + linear
        for f in range(self.v.shape[1]):
            vx = self.v[index, f] * value
            s = np.bincount(of, weights=vx, minlength=n) + stats @ self.v[WORDS:, f]
            squares = np.bincount(of, weights=vx**2, minlength=n) + stats**2 @ self.v[WORDS:, f] ** 2
            out = out + (s**2 - squares) / 2
        return out

    def score(self, first: np.ndarray, index: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(first, index, value, self.standard(stats)), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, y: np.ndarray, rank: int = 6, epochs: int = 12, rate: float = 0.03, decay: float = 1e-4, seed: int = 5) -> Machine:
    """Adam on the logistic loss in batches of 64 rows."""
    rng = np.random.default_rng(seed)
    size = WORDS + STATISTICS
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    mean = stats.mean(axis=0) if len(y) else np.zeros(STATISTICS)
    scale = np.maximum(stats.std(axis=0), 1e-6) if len(y) else np.ones(STATISTICS)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, rank)), mean, scale)
    if not len(y) or y.min() == y.max():
        m.v[:] = 0
        return m
    z = m.standard(stats)
    moments = [np.zeros_like(m.w), np.zeros_like(m.w), np.zeros_like(m.v), np.zeros_like(m.v)]
    for epoch in range(epochs):
        order, step_rate = rng.permutation(len(y)), rate / (1 + epoch / 3)
        for at in range(0, len(order), 64):
            take = order[at : at + 64]
            first = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in take])])
            index = np.concatenate([rows[i][0] for i in take])
            value = np.concatenate([rows[i][1] for i in take])
            of = np.repeat(np.arange(len(take)), np.diff(first))
            g = 1 / (1 + np.exp(-np.clip(m.raw(first, index, value, z[take]), -30, 30))) - y[take]
            g /= len(take)
            m.w0 -= step_rate * g.sum()
            used = np.unique(index)
            place = np.searchsorted(used, index)
            spot = np.concatenate([used, np.arange(WORDS, size)])
            sums = np.zeros((len(take), rank))
            np.add.at(sums, of, m.v[index] * value[:, None])
            sums += z[take] @ m.v[WORDS:]
            gw, gv = np.zeros(len(spot)), np.zeros((len(spot), rank))
            gx = g[of] * value
            np.add.at(gw, place, gx)
            np.add.at(gv, place, gx[:, None] * (sums[of] - m.v[index] * value[:, None]))
            gw[len(used) :] = g @ z[take]
            gv[len(used) :] = (g[:, None] * z[take]).T @ sums - (g @ z[take] ** 2)[:, None] * m.v[WORDS:]
            for param, grad, a, b in ((m.w, gw, moments[0], moments[1]), (m.v, gv, moments[2], moments[3])):
                grad = grad + decay * param[spot]
                a[spot] = 0.9 * a[spot] + 0.1 * grad
                b[spot] = 0.99 * b[spot] + 0.01 * grad**2
                param[spot] -= step_rate * a[spot] / (np.sqrt(b[spot]) + 1e-6)
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Machine:
    """A machine from at most `sample` labelled rows whose remainder isn't 0; the driver holds these rows' features only."""
    y = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text", F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)).alias("n_chars")).join(F.broadcast(y), "doc_id")
    # one document a doc_id, however many rows share it: the smallest by digest
    one = F.min(F.struct(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "n_chars", "text", "quality")).alias("one")
    rows = rows.groupBy("doc_id").agg(one).select("doc_id", "one.text", "one.n_chars", "one.quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, first, index, value, stats in features(b.column("text"), b.column("n_chars").to_numpy()):
                cut = pa.array(first, pa.int32())
                yield pa.record_batch([b.column("doc_id").slice(at, to - at).cast(pa.string()), b.column("quality").slice(at, to - at).cast(pa.int32()), pa.ListArray.from_arrays(cut, pa.array(index, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(value, pa.float32())), pa.ListArray.from_arrays(pa.array(np.arange(to - at + 1) * STATISTICS, pa.int32()), pa.array(stats.ravel()))], names=["doc_id", "quality", "index", "value", "stats"])

    got = rows.mapInArrow(run, "doc_id string, quality int, index array<int>, value array<float>, stats array<double>").toArrow()
    order = np.argsort(np.array(got.column("doc_id").to_pylist(), dtype=object), kind="stable") if got.num_rows else np.zeros(0, np.int64)
    index, value = got.column("index").combine_chunks(), got.column("value").combine_chunks()
    held = [(index[i].values.to_numpy(zero_copy_only=False).astype(np.int64), value[i].values.to_numpy(zero_copy_only=False).astype(float)) for i in order.tolist()]
    stats = np.array(got.column("stats").to_pylist(), float).reshape(-1, STATISTICS)[order]
    quality = (got.column("quality").to_numpy()[order] > 0).astype(float)
    return fit(held, stats, quality)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows)
            for at, to, first, index, value, stats in features(b.column(1), b.column(2).to_numpy()):
                out[at:to] = machine.score(first, index, value, stats)
            yield pa.record_batch([b.column(0), b.column(3), pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select("doc_id", "text", F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)).alias("n_chars"), (remainder(F.col("doc_id")) == 0).alias("held_out"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
