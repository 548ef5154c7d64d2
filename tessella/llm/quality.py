"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse vector: hashed words (log counts, scaled to length one), structure statistics
(shares of character kinds, word and line lengths, repetition) and metadata (size of the text).
The score is the logistic of w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j. The pairwise part is
computed in linear time: half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The model is fitted with AdaGrad on at most ``SAMPLE_ROWS`` labelled rows, chosen by hash among the
rows that may be learned from. Features are made on the executors; the driver gets sparse rows.

Defined cases: a null text is an empty text, which has a score like any other; rows with a null id
are scored, count as held out and are never learned from; labels other than 0 and 1 are ignored; a
document with several labels counts once for each; repeated rows are scored alike; a score of exactly 0.5 is
predicted as 1; without any label the score is 0.5; a very long text is scored whole; an empty table gives an
empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import held_out, short_batches, table, text_of

BUCKETS = 1 << 15
FACTORS = 8
SAMPLE_ROWS = 8000
EPOCHS = 6
RATE = 0.05
DECAY = 1e-5
SEED = 7
CACHE_WORDS = 300_000
STATS = 16

SCORED = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])
SPARSE = pa.schema([("label", pa.int32()), ("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

_kinds = np.zeros((256, 6), np.float32)
_kinds[ord("A") : ord("Z") + 1, 0] = 1
_kinds[ord("a") : ord("z") + 1, 1] = 1
_kinds[ord("0") : ord("9") + 1, 2] = 1
_kinds[128:, 3] = 1
_kinds[[ord(c) for c in ".,;:?'\"-()"], 4] = 1
_kinds[[ord(c) for c in "|!%$#&*+=<>/\\@_~^{}[]`"], 5] = 1


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = crc32(word) % BUCKETS
        return found


WORD_BUCKETS = _Buckets()


def statistics(text: bytes, words: list[bytes]) -> list[float]:
    """Structure statistics and metadata, all of the order of one."""
    size, n = max(1, len(text)), max(1, len(words))
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _kinds / size
    lines = [line for line in text.split(b"\n") if line.strip()]
    return [
        1.0, *kinds.tolist(), min(3.0, size / n / 8), len(set(words)) / n, min(3.0, 20 * len(lines) / n),
        1 - len(set(lines)) / max(1, len(lines)), text.count(b"|") / n, text.count(b"!!") / n,
        np.log1p(len(text)) / 8, np.log1p(len(words)) / 8, min(3.0, 5 * text.count(b".") / n),
    ]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, indices and values of the sparse matrix of a batch; words first, then statistics."""
    sizes, found, stats = [], [], []
    for text in texts:
        words = text.lower().split()
        sizes.append(len(words))
        found.append(np.fromiter(map(WORD_BUCKETS.__getitem__, words), np.int64, len(words)))
        stats.append(statistics(text, words))
    row = np.repeat(np.arange(len(texts)), sizes)
    keys, counts = np.unique(row * BUCKETS + np.concatenate(found), return_counts=True)
    row, index, value = keys // BUCKETS, keys % BUCKETS, np.log1p(counts).astype(np.float32)
    norm = np.sqrt(np.bincount(row, value**2, len(texts)))
    value /= np.maximum(norm, 1e-6)[row]
    rows = np.concatenate([row, np.repeat(np.arange(len(texts)), STATS)])
    return rows, np.concatenate([index, np.tile(BUCKETS + np.arange(STATS), len(texts))]), np.concatenate([value, np.array(stats, np.float32).ravel()])


@dataclass(frozen=True)
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, n: int, rows: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Log odds of ``n`` rows, by the sum-of-squares identity."""
        out = self.bias + np.bincount(rows, self.weights[index] * value, n)
        for f in range(self.factors.shape[1]):
            part = self.factors[index, f] * value
            out += 0.5 * (np.bincount(rows, part, n) ** 2 - np.bincount(rows, part**2, n))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margins(len(texts), *features(texts)), -30, 30)))


def fit(labels: np.ndarray, rows: np.ndarray, index: np.ndarray, value: np.ndarray, batch: int = 64) -> FactorisationMachine:
    """AdaGrad on the logistic loss; ``rows`` ascending."""
    size = BUCKETS + STATS
    rng = np.random.default_rng(SEED)
    w, v = np.zeros(size), rng.normal(0, 0.02, (size, FACTORS))
    if not len(labels):
        return FactorisationMachine(0.0, w.astype(np.float32), np.zeros((size, FACTORS), np.float32))
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias, gb, gw, gv = float(np.log(share / (1 - share))), 1e-8, np.full(size, 1e-8), np.full((size, FACTORS), 1e-8)
    begin = np.searchsorted(rows, np.arange(len(labels) + 1))
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            mine = order[at : at + batch]
            span = np.concatenate([np.arange(begin[k], begin[k + 1]) for k in mine])
            r = np.repeat(np.arange(len(mine)), begin[mine + 1] - begin[mine])
            i, x = index[span], value[span].astype(float)
            vx = v[i] * x[:, None]
            sums = np.stack([np.bincount(r, vx[:, f], len(mine)) for f in range(FACTORS)], 1)
            squares = np.bincount(r, (vx**2).sum(1), len(mine))
            margin = bias + np.bincount(r, w[i] * x, len(mine)) + 0.5 * ((sums**2).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[mine]) / len(mine)
            gb += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(gb)
            used, place = np.unique(i, return_inverse=True)
            dw = np.bincount(place, error[r] * x, len(used)) + DECAY * w[used]
            grad = (error[r] * x)[:, None] * (sums[r] - vx)
            dv = np.stack([np.bincount(place, grad[:, f], len(used)) for f in range(FACTORS)], 1) + DECAY * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
    return FactorisationMachine(bias, w.astype(np.float32), v.astype(np.float32))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows, index, value = features(batch.column(1).to_pylist())
            order = np.argsort(rows, kind="stable")
            offsets = np.searchsorted(rows[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order], t)) for x, t in ((index, pa.int32()), (value, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], schema=SPARSE)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> FactorisationMachine:
    """Fit on a bounded sample of the labelled rows that may be learned from."""
    short_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    slots = max(1, known.count() // SAMPLE_ROWS)
    chosen = known.withColumn("h", F.xxhash64("id", "label")).where(F.pmod("h", F.lit(slots)) == 0).orderBy("h").limit(SAMPLE_ROWS)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    # At most SAMPLE_ROWS small rows: a size bound that is proven by the limit.
    sample = texts.join(F.broadcast(chosen), "id").select("label", "text", "h")
    # Documents may repeat an id; the bound holds for them too.
    sample = sample.orderBy("h", F.crc32("text")).limit(SAMPLE_ROWS).select("label", "text")
    rows = sample.mapInArrow(_sparse, "label int, index array<int>, value array<float>").toArrow()
    target = np.asarray(rows["label"]).astype(float)
    index, value = (rows[name].combine_chunks() for name in ("index", "value"))
    if not len(target):
        return fit(target, *[np.zeros(0, np.int64)] * 3)
    owner = np.repeat(np.arange(len(target)), np.diff(np.asarray(index.offsets)))
    return fit(target, owner, np.asarray(index.flatten()).astype(np.int64), np.asarray(value.flatten()))


def _score(model: FactorisationMachine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield table({"id": batch.column(0), "held_out": batch.column(1), "score": model.scores(batch.column(2).to_pylist())}, SCORED)
    return run


def classify(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, ``held_out``, ``score``, ``predicted``."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(_score(model), "id long, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
