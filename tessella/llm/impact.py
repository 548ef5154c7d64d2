"""Exact top-k search by integer inner product over an impact-ordered index, score at a time.

Index. Rows are dealt into shards of ``SHARD_ROWS`` vectors. A shard holds, for every dimension, its
vectors in order of their component (the postings), cut into ``LEVELS`` segments of equal width: the
quantised impacts. Every row is indexed and shards are rows of a table.

Search. For a query, a component's contribution is counted from the least that any vector of the shard
can have, so contributions are never negative; the order of a dimension is read from its upper or its
lower end, by the query's sign. Segments fall into bands by impact, and bands are processed in descending
order: each posting adds the most that its segment can give to its vector's accumulator. Where a vector was
not seen yet, a dimension gives at most its next segment. A vector whose sum stays below a score that is known
to be reached k times (by vectors of this shard that were scored exactly, or in earlier shards) is ruled out
by proof. Once few are left, or all bands are done, those left are scored exactly. Nothing else ends a search,
so results are exact.

Plan. Blocks of queries meet shards by (block, lane): each pair of both is one unit, units of one block and
lane run one after the other in a task and hand on their best scores, and lanes bound how many. What is
shuffled is bounded by blocks x shards; a block has up to ``BLOCK_QUERIES`` queries and a shard up to
``SHARD_ROWS`` vectors, so a unit is bounded too. Each lane returns k rows a query, and the best k of these
are kept.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a
null id, nor vectors with a scaled component of 2**28 or more (products must fit a long; more than 128
dimensions lower this limit). A query is scored against all rows of another id and of its length; repeated
rows are separate candidates; equal query rows are one query, and different vectors of one id are separate queries.
Empty vectors score zero with each other. Ties go to the smaller id. An empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import batches_of, step, table

SCALE, TOP = 256.0, 5
SHARD_ROWS, BLOCK_QUERIES, LEVELS, BANDS = 16_384, 8_192, 64, 24
#: Shards that one task works through for a block of queries, and units that keep a machine busy.
LANE_SHARDS, UNITS = 64, 24
#: What is left is looked at when these parts of the postings are done; a search ends early when no more than one in
#: ``FEW`` vectors of the shard is left. ``SEEDS`` exact scores give the score that must be reached.
STOPS, FEW, SEEDS = (0.6, 0.8, 1.0), 12, 32
#: Queries of a block on a small table.
LEAST_QUERIES = 96

INDEX = pa.schema([
    ("shard", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("kind", pa.string()), ("vectors", pa.binary()),
    ("postings", pa.binary()), ("ends", pa.binary()),
])
INDEX_DDL = "shard long, dim int, n int, ids binary, kind string, vectors binary, postings binary, ends binary"
FOUND = pa.schema([("query_id", pa.int64()), ("tag", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "query_id long, tag long, vec_id long, score long"


def usable(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part: ``id``, ``dim``, ``vector`` (scaled and floored, as integers)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    size = F.greatest(F.size("vector"), F.lit(1))
    limit = F.pow(F.lit(2.0), F.least(F.lit(28.0), F.floor((63 - F.ceil(F.log2(size))) / 2)))

    def fits(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < limit)

    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", fits))
    return rows.select("id", F.size("vector").alias("dim"), F.transform("vector", lambda c: F.floor(c * scale).cast("int")).alias("vector"))


def _shard(number: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    n, dim = x.shape
    kind = "<i2" if not x.size or np.abs(x).max() < 2**15 else "<i4"
    order = np.argsort(x, axis=0, kind="stable").T
    ordered = np.take_along_axis(x.T, order, 1).astype(np.int64)
    low, width = ordered[:, :1], ordered[:, -1:] - ordered[:, :1] + 1
    level = (ordered - low) * LEVELS // width
    ends = np.stack([np.searchsorted(row, np.arange(LEVELS), "right") for row in level]) if dim else np.zeros((0, LEVELS))
    return table({
        "shard": [number], "dim": [dim], "n": [n], "ids": [ids.astype("<i8").tobytes()], "kind": [kind], "vectors": [x.astype(kind).tobytes()],
        "postings": [order.astype("<u2").tobytes()], "ends": [ends.astype("<i4").tobytes()],
    }, INDEX)


def _build(shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def cut(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            while sum(len(ids) for ids, _ in held[dim]) >= least:
                ids, x = (np.concatenate(part) for part in zip(*held[dim], strict=True))
                yield _shard(number, ids[:shard_rows], x[:shard_rows])
                number += 1
                held[dim] = [(ids[shard_rows:], x[shard_rows:])]

        for batch in batches:
            dims = np.asarray(batch.column(1))
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                x = np.asarray(batch.column(2).take(pa.array(mine)).flatten(), np.int32).reshape(len(mine), dim)
                held.setdefault(dim, []).append((np.asarray(batch.column(0))[mine], x))
                yield from cut(dim, shard_rows)
        for dim in held:
            yield from cut(dim, 1)
    return run


def build_index(vectors: DataFrame, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The index as a written table, one row for each shard."""
    rows = usable(vectors, scale, id_col, vector_col)
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    with batches_of(vectors.sparkSession, 4096):
        return step(rows.repartition(shards).mapInArrow(_build(SHARD_ROWS), INDEX_DDL))


class Shard:
    """One shard, unpacked: postings and segment bounds, read from the upper and from the lower end."""

    def __init__(self, dim: int, n: int, ids: bytes, kind: str, vectors: bytes, postings: bytes, ends: bytes) -> None:
        self.n, self.ids = n, np.frombuffer(ids, "<i8")
        self.x = np.frombuffer(vectors, kind).reshape(n, dim).astype(np.int64)
        order = np.frombuffer(postings, "<u2").reshape(dim, n).astype(np.int64)
        ends = np.frombuffer(ends, "<i4").reshape(dim, LEVELS)
        counts = np.diff(ends, axis=1, prepend=0)
        ordered = np.take_along_axis(self.x.T.astype(np.float64), order, 1)
        self.low, self.high = (ordered[:, 0], ordered[:, -1]) if dim else (np.zeros(0), np.zeros(0))
        least = np.take_along_axis(ordered, np.minimum(ends - counts, n - 1), 1)
        most = np.take_along_axis(ordered, np.maximum(ends - 1, 0), 1)
        level = np.zeros((dim, n), np.uint8)
        np.put_along_axis(level, order, np.stack([np.repeat(np.arange(LEVELS), c) for c in counts]).astype(np.uint8) if dim else level, 1)

        def side(high: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Best segment first; an empty one has the bound of the next."""
            return np.maximum.accumulate(np.where(number > 0, high, 0)[:, ::-1], axis=1)[:, ::-1], number

        self.up = side((most - self.low[:, None])[:, ::-1], counts[:, ::-1])
        self.down = side(self.high[:, None] - least, counts)
        self.order, self.reverse = order, order[:, ::-1]
        self.rank_up, self.rank_down = (LEVELS - 1 - level).T, level.T

    def search(self, query: np.ndarray, own: int, top: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of all that can be among the best ``top``, given a score that must be reached."""
        q = query.astype(np.float64)
        up, use = q > 0, np.flatnonzero(q)
        base = float(q @ np.where(up, self.low, self.high))
        weight, sign = np.abs(q)[use], up[use, None]
        high, number = (np.where(sign, a[use], b[use]) for a, b in zip(self.up, self.down, strict=True))
        high = high * weight[:, None]
        # Sums stay whole numbers below 2**52; beyond, rounding is allowed for.
        size = float(high[:, 0].sum()) + abs(base)
        slack = 0.0 if size < 2**52 else size * 1e-9
        place = np.concatenate([np.zeros((len(use), 1), np.int64), np.cumsum(number, 1)], 1)
        band = np.minimum(high * (BANDS / max(float(high.max(initial=0)), 1.0)), BANDS - 1).astype(np.int64)
        closed = np.concatenate([high, np.zeros((len(use), 1))], 1)
        levels, dims = np.arange(LEVELS), np.arange(len(use))
        gain, cap, done = np.zeros(self.n), closed[:, 0], np.zeros(len(use), np.int64)
        left = np.flatnonzero(self.ids != own)
        goals, query = [self.n * len(use) * part for part in STOPS], query.astype(np.int64)
        for b in range(BANDS - 1, -1, -1):
            now = (band >= b).sum(1)
            if b and int(place[dims, now].sum()) < goals[0]:
                continue
            goals.pop(0)
            below = closed[dims, now]
            if done.any():
                # Dimensions where a vector was seen count by their segment alone, whatever is still open.
                rank = np.where(sign.T, self.rank_up[left][:, use], self.rank_down[left][:, use])
                gain[left] += (rank < done) @ (cap - below)
            moved = np.flatnonzero(now > done).tolist()
            if moved:
                parts = [(self.reverse if sign[d, 0] else self.order)[use[d], place[d, done[d]] : place[d, now[d]]] for d in moved]
                mask = (levels >= done[:, None]) & (levels < now[:, None])
                gain += np.bincount(np.concatenate(parts), np.repeat((high - below[:, None])[mask], number[mask]), self.n)
            done, cap = now, below
            bound = gain[left] + (base + cap.sum() + slack)
            if len(left) > top:
                # Exact scores of the most promising give a score that must be reached.
                few = left[np.argpartition(bound, -min(SEEDS, len(left)))[-min(SEEDS, len(left)) :]]
                sure = int(np.sort(self.x[few] @ query)[-top])
                least = sure if least is None else max(least, sure)
            if least is not None:
                left = left[bound >= least]
            if len(left) * FEW <= self.n or not goals or int(place[dims, now].sum()) == self.n * len(use):
                break
        return self.ids[left], self.x[left] @ query


def best(ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Places of the best ``top``: higher scores first, then smaller ids."""
    return np.lexsort((ids, -scores))[:top]


def _search(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, found = None, None, []

        def flush() -> pa.RecordBatch:
            out: dict[str, list] = {name: [] for name in FOUND.names}
            for (own, tag, _), (ids, scores) in zip(queries, found, strict=True):
                for name, part in zip(FOUND.names, ([own] * len(ids), [tag] * len(ids), ids.tolist(), scores.tolist()), strict=True):
                    out[name] += part
            return table(out, FOUND)

        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in batch.schema.names}
                dim = row["dim"].as_py()
                mine = (dim, row["block"].as_py(), row["lane"].as_py())
                if mine != key:
                    if queries:
                        yield flush()
                    values = row["queries"].values
                    asked = np.asarray(values.field("vector").flatten(), np.int64).reshape(len(values), dim)
                    key, queries = mine, list(zip(np.asarray(values.field("id")).tolist(), np.asarray(values.field("tag")).tolist(), asked, strict=True))
                    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
                shard = Shard(dim, *(row[name].as_py() for name in ("n", "ids", "kind", "vectors", "postings", "ends")))
                for k, (own, _, query) in enumerate(queries):
                    ids, scores = found[k]
                    new = shard.search(query, own, top, int(scores[-1]) if len(scores) == top else None)
                    ids, scores = np.concatenate([ids, new[0]]), np.concatenate([scores, new[1]])
                    order = best(ids, scores, top)
                    found[k] = ids[order], scores[order]
        if queries:
            yield flush()
    return run


def search(index: DataFrame, queries: DataFrame, top: int = TOP, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each query and rank: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``."""
    spark = queries.sparkSession
    asked = usable(queries, scale, id_col, vector_col)
    asked = asked.withColumn("tag", F.xxhash64("vector")).dropDuplicates(["id", "tag"])
    shards, total = index.count(), asked.count()
    # Enough units to keep a small machine busy; bounded blocks and lanes on a large table.
    lanes = max(1, -(-shards // LANE_SHARDS), min(shards, UNITS // 4))
    blocks = max(1, -(-total // BLOCK_QUERIES), min(-(-total // LEAST_QUERIES), -(-UNITS // lanes)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "tag"), F.lit(blocks)).cast("int"))
    asked = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "tag", "vector")).alias("queries"))
    asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    # Shards are numbered by task and place: their ranks deal them evenly into lanes.
    dealt = index.withColumn("lane", F.pmod(F.xxhash64("shard"), F.lit(lanes)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    units = dealt.join(asked.hint("merge"), ["dim", "block", "lane"])
    with batches_of(spark, 8):
        found = step(units.mapInArrow(_search(top), FOUND_DDL))
    order = Window.partitionBy("query_id", "tag").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
