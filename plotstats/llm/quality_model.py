"""Quality classifier on random-indexing word vectors (operator 3).

Tokens are runs of letters, digits and characters beyond ASCII, and runs of other visible
characters; case is kept.  A token hashes to one of ``BUCKETS`` rows.  Each row has a
fixed sparse index vector of ``NONZERO`` signs in ``DIM`` places; its context vector is the sum of
the index vectors of the tokens within ``REACH`` places, over every document.  Tasks add up
partial sums, Spark sums them by row; so the table has BUCKETS rows at any size of corpus
and is broadcast as such.

A document pools its tokens' vectors (context vectors at unit length): mean, spread and
the length of the mean, and with them its log length and the share of distinct rows.  A two-layer
network in numpy is fitted on a bounded sample of labelled training rows
(``TRAIN_ROWS``) and its logits are divided by a temperature that is fitted on a part of
them held back.

Rows whose crc32 of the id as text leaves 0 modulo ``FOLDS`` are held out: their labels are
never read.  Labels, languages, sources and ids are no inputs of a score.

Edge cases: null and empty texts have no tokens and get the score of the zero
vector; null labels are not used; an id with several labels counts with each; repeated rows
are scored each; a null id is not held out; without labels of both classes every
score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import LETTERED, WHITE, bounded_sample, in_arrow, mix, runs, slices, span_hashes, sums, text_bytes, text_column, with_fields
from .components import saved

BUCKETS, DIM, NONZERO, REACH = 1 << 14, 32, 4, 2
FOLDS = 5
TRAIN_ROWS = 20_000
HIDDEN = 32
SLICE, PAIRS = 1 << 19, 1 << 16  # bytes of text and distinct pairs handled at a time
CUT = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def index_vectors() -> np.ndarray:
    """Fixed sparse sign vectors, one for each row."""
    out = np.zeros((BUCKETS, DIM), np.int32)
    rows = np.arange(BUCKETS)
    for i in range(NONZERO):
        h = mix(rows.astype(np.uint64) * np.uint64(NONZERO) + np.uint64(i + 1))
        np.add.at(out, (rows, (h % np.uint64(DIM)).astype(np.int64)), np.where(h >> np.uint64(63), 1, -1))
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each token, first token of each text with the total appended)."""
    lettered = LETTERED[data]
    a, b = runs(lettered, offsets)
    c, d = runs(~lettered & ~WHITE[data], offsets)
    starts, ends = np.concatenate((a, c)), np.concatenate((b, d))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return (span_hashes(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(starts, offsets)


def context_sums(bucket: np.ndarray, first: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sums of neighbours' index vectors by row (BUCKETS x DIM)."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs = []
    for d in range(1, REACH + 1):
        same = owner[d:] == owner[:-d]
        x, y = bucket[d:][same], bucket[:-d][same]
        pairs += [x * BUCKETS + y, y * BUCKETS + x]
    out = np.zeros((BUCKETS, DIM), np.int64)
    key, n = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.empty(0, np.int64), np.empty(0, np.int64))
    for at in range(0, len(key), PAIRS):
        word, other = key[at:at + PAIRS] // BUCKETS, key[at:at + PAIRS] % BUCKETS
        heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[heads]] += np.add.reduceat(index[other] * n[at:at + PAIRS, None], heads, axis=0)
    return out


def word_vectors(rows: DataFrame) -> np.ndarray:
    """Context vectors at unit length, summed over all rows (text)."""
    columns = [f"c{i}" for i in range(DIM)]

    def run(batches):
        index, total, seen = index_vectors(), np.zeros((BUCKETS, DIM), np.int64), np.zeros(BUCKETS, bool)
        for batch in slices(batches, "text", SLICE):
            bucket, first = tokens(*text_bytes(batch.column("text")))
            seen[bucket] = True
            total += context_sums(bucket, first, index)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, i]) for i in range(DIM))], names=["bucket", *columns])

    parts = in_arrow(rows.select("text"), run, ", ".join(["bucket long", *(f"{c} long" for c in columns)]))
    whole = parts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()  # BUCKETS rows at most
    out = np.zeros((BUCKETS, DIM))
    out[whole["bucket"].to_numpy(np.int64)] = whole[columns].to_numpy(float)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    bucket, first = tokens(data, offsets)
    n = np.diff(first)
    some = np.maximum(n, 1)[:, None]
    out = np.zeros((len(n), 2 * DIM + 3), np.float32)
    full = np.flatnonzero(n)
    if len(full):
        v = vectors[bucket]
        mean, square = np.zeros((len(n), DIM)), np.zeros((len(n), DIM))
        mean[full] = np.add.reduceat(v, first[full], axis=0, dtype=np.float64)
        square[full] = np.add.reduceat(v * v, first[full], axis=0, dtype=np.float64)
        mean, square = mean / some, square / some
        key = np.sort(np.repeat(np.arange(len(n)), n) * BUCKETS + bucket)
        new = np.concatenate(([True], key[1:] != key[:-1]))
        out[:, :DIM], out[:, DIM:2 * DIM] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
        out[:, -3], out[:, -2], out[:, -1] = np.linalg.norm(mean, axis=1), np.log1p(n), sums(new, first) / some[:, 0]
    return out


@dataclass
class Network:
    """Two layers (tanh, logistic) over standardised features, with a temperature."""

    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.center) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 40, seed: int = 1) -> Network | None:
    """Adam on the logistic loss; every fifth row sets the temperature."""
    if len(np.unique(y)) < 2:
        return None
    x, y = x.astype(np.float64), y.astype(np.float64)
    back = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    t, u = x[~back], y[~back]
    rng = np.random.default_rng(seed)
    net = Network(t.mean(0), t.std(0) + 1e-6, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    z = (t - net.center) / net.scale
    state, step = [[0.0, 0.0] for _ in range(4)], 0
    for epoch in range(epochs):
        order = rng.permutation(len(u))
        for at in range(0, len(u), 128):
            i = order[at:at + 128]
            h = np.tanh(z[i] @ net.w1 + net.b1)
            d = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30))) - u[i]) / len(i)
            back_h = np.outer(d, net.w2) * (1 - h * h)
            grads = [z[i].T @ back_h + 1e-4 * net.w1, back_h.sum(0), h.T @ d + 1e-4 * net.w2, d.sum()]
            step += 1
            for s, name, g in zip(state, ("w1", "b1", "w2", "b2"), grads):
                s[0], s[1] = 0.9 * s[0] + 0.1 * g, 0.999 * s[1] + 0.001 * g * g
                setattr(net, name, getattr(net, name) - 0.005 * (s[0] / (1 - 0.9 ** step)) / (np.sqrt(s[1] / (1 - 0.999 ** step)) + 1e-8))
    if back.any():
        raw = net.logit(x[back])
        heat = np.exp(np.linspace(np.log(0.25), np.log(20), 200))
        loss = [np.logaddexp(0, np.where(y[back] > 0, -1, 1) * raw / h).mean() for h in heat]
        net.temperature = float(heat[int(np.argmin(loss))])
    return net


def score_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_col: str = "text",
                    label_column: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with held_out, score and predicted; rows keep all their columns."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    vectors = word_vectors(rows)
    known = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    # the sampled labels are bounded, so they go to the texts
    known = F.broadcast(saved(bounded_sample(known, "doc_id", train_rows), "quality-labels"))

    def features(batches):
        for batch in slices(batches, "text", SLICE):
            x = pooled(*text_bytes(batch.column("text")), vectors)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "y", "x"])

    sample = in_arrow(rows.join(known, "doc_id").select("doc_id", "y", "text"), features, "doc_id long, y int, x array<float>")
    got = sorted((r.doc_id, r.y, r.x) for r in sample.limit(4 * train_rows).collect())
    net = fit_network(np.array([x for _, _, x in got]), np.array([y for _, y, _ in got])) if got else None

    def score(batches):
        for batch in slices(batches, text_col, SLICE):
            x = pooled(*text_bytes(batch.column(text_col)), vectors)
            p = net.probability(x) if net else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "score"])

    rest = docs.drop("held_out", "score", "predicted")
    scored = in_arrow(rest, score, with_fields(rest, ("score", "double")))
    return scored.withColumn("held_out", held_out(F.col(id_column))).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
