"""Embedding near-dedup with a pivot-permutation index.

Each vector is described by its ``NEAREST`` nearest reference points (pivots), in ascending pivot
number. Vectors that share at least ``SHARED`` pivots are candidates. Instead of counting shared
pivots over long inverted lists, the lists are those of pivot triples: two vectors share three pivots
if and only if they meet in some triple's list. Triples that only one vector has are dropped before
any vector moves. A pair that meets in several lists is counted in one of them: the list of the three
smallest pivots that it shares.

A list is cut into blocks of ``BLOCK_VECTORS`` and each pair of blocks is one unit of work, so a long
list is spread over tasks. A unit compares its vectors exactly (cosine in double precision) and
returns, for each vector, how many it links with, and a star of links for each of its groups: never
the pairs themselves. Equal vectors are one class and count as many.

Pivots are taken from a bounded sample, at least ``APART`` in cosine from each other, so that a large
group of near copies has one pivot and not many alike. They are numbered by how often the sample uses
them. Their number grows with the cube root of the number of vectors, which keeps lists short.

Defined cases: rows with a null label, a null, empty or zero vector, or null or non-finite components
link with nothing; vectors of different length are never compared; repeated rows are separate, equal
vectors; a null id has no component and is not kept, but counts as a partner; an empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import step, table, tasks_for
from tessella.operators.components import connected_components

COSINE = 0.93
NEAREST, SHARED = 8, 3
#: Pivots for each cube root of the number of vectors; the sample is at most this many rows.
PIVOTS_PER_ROOT, SAMPLE_ROWS = 10, 4096
APART = 0.7
BLOCK_VECTORS = 512
TRIPLES = np.array(list(combinations(range(NEAREST), SHARED)))

LISTS = pa.schema([("rep", pa.int64()), ("list", pa.int64())])
LINKS = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])


def choose_pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Unit vectors of the sample, apart from each other, most used first."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen: list[int] = []
    for k in range(len(unit)):
        if len(chosen) == wanted:
            break
        if not chosen or (unit[chosen] @ unit[k]).max() < APART:
            chosen.append(k)
    pivots = unit[chosen]
    uses = np.bincount(nearest_pivots(unit, pivots).ravel(), minlength=len(pivots))
    return pivots[np.argsort(-uses, kind="stable")]


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of each vector's nearest pivots, ascending."""
    near = min(NEAREST, len(pivots))
    return np.sort(np.argpartition(-(unit @ pivots.T), near - 1, axis=1)[:, :near], axis=1)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _lists(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                if dim not in pivots or len(pivots[dim]) < SHARED:
                    # Too few reference points to tell vectors apart: all share one list.
                    yield table({"rep": np.asarray(batch.column(0))[mine], "list": np.full(len(mine), -1)}, LISTS)
                    continue
                x = _vectors(batch.column(2).take(pa.array(mine)), dim)
                near = nearest_pivots(x / np.linalg.norm(x, axis=1, keepdims=True), pivots[dim]).astype(np.int64)
                triples = TRIPLES[TRIPLES[:, -1] < near.shape[1]]
                keys = (near[:, triples[:, 0]] << 42) + (near[:, triples[:, 1]] << 21) + near[:, triples[:, 2]]
                yield table({"rep": np.repeat(np.asarray(batch.column(0))[mine], len(triples)), "list": keys.ravel()}, LISTS)
    return run


def _local_groups(linked: np.ndarray) -> np.ndarray:
    """Smallest member of each vector's group in a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare_block(list_id: int, rep: np.ndarray, side: np.ndarray, same: bool, x: np.ndarray, size: np.ndarray, near: np.ndarray | None, cosine: float):
    """Links within one block (``same``) or between two: rep, star centre, linked vectors."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= cosine
    np.fill_diagonal(linked, False)
    if not same:
        linked &= side[:, None] != side[None, :]
    if near is not None and linked.any():
        # Shared pivots below the list's last one other than its own: the pair belongs to another list.
        own = [list_id >> 42, list_id >> 21 & 0x1FFFFF, list_id & 0x1FFFFF]
        lower = (near < own[2]) & ~np.isin(near, own)
        names, place = np.unique(near[lower], return_inverse=True)
        if len(names):
            has = np.zeros((len(rep), len(names)), np.float32)
            has[np.nonzero(lower)[0], place] = 1
            linked &= has @ has.T == 0
    counts = linked @ size
    some = np.flatnonzero(counts)
    return rep[some], rep[_local_groups(linked)[some]], counts[some]


def _compare(pivots: dict[int, np.ndarray], cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = [np.asarray(rows.column(name).combine_chunks()) for name in ("unit", "list", "same", "side", "dim", "rep", "size")]
            unit, list_id, same, side, dims, rep, size = columns
            begin = np.append(np.flatnonzero(np.append(True, unit[1:] != unit[:-1])), len(unit))
            vectors = rows.column("vector").combine_chunks()
            out: dict[str, list] = {name: [] for name in LINKS.names}
            for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                dim = int(dims[a])
                x = _vectors(vectors.slice(a, b - a), dim)
                near = None
                if list_id[a] >= 0:
                    near = nearest_pivots(x / np.linalg.norm(x, axis=1, keepdims=True), pivots[dim])
                found = compare_block(int(list_id[a]), rep[a:b], side[a:b], bool(same[a]), x, size[a:b], near, cosine)
                for name, part in zip(LINKS.names, found, strict=True):
                    out[name].append(part)
            yield table({name: np.concatenate(parts) for name, parts in out.items()}, LINKS)

        # Rows come sorted by unit; the last unit of a batch may go on in the next.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            unit = np.asarray(rows.column("unit").combine_chunks())
            last = int(np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))[-1])
            if last:
                yield from work(rows.slice(0, last))
                held = rows.slice(last).combine_chunks().to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))
    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each vector: id, ``n_links``, ``component_id``, ``kept``."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda c: c != 0)
    plain = F.transform("vector", lambda c: c + F.lit(0.0))  # no negative zeros
    rows = step(rows.select("id", F.when(good, F.xxhash64("label", plain)).alias("a"), F.when(good, F.xxhash64(F.lit(1), "label", plain)).alias("b"),
                            F.when(good, F.col("label").cast("string")).alias("label"), F.when(good, plain).alias("vector")))
    classes = rows.where("a IS NOT NULL").groupBy("a", "b").agg(
        F.min("id").alias("low"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    # The hash is the class's name: 64 bits would not do to compare vectors, but two of them name a class.
    classes = step(classes.select("a", "b", "low", "size", "label", "vector", F.size("vector").alias("dim"), F.xxhash64("a", "b").alias("rep")))
    total = classes.count()
    wanted = max(32, int(PIVOTS_PER_ROOT * np.cbrt(total)))
    sample = classes.orderBy("a", "b").select("dim", "vector").limit(min(SAMPLE_ROWS, 2 * wanted)).collect()
    pivots = {dim: choose_pivots(np.array([r["vector"] for r in sample if r["dim"] == dim]), wanted) for dim in {r["dim"] for r in sample}}

    placed = classes.select("rep", "dim", "vector").mapInArrow(_lists(pivots), "rep long, list long")
    placed = step(placed.join(classes.select("rep", "label", "dim"), "rep"))
    full = placed.groupBy("label", "dim", "list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    full = step(full.withColumn("blocks", F.ceil(F.col("n") / BLOCK_VECTORS).cast("int")).drop("n"))
    members = placed.join(full, ["label", "dim", "list"]).withColumn("side", F.pmod("rep", F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("side", "other"), F.greatest("side", "other")
    members = step(members.select("rep", "list", "side", (low == high).alias("same"), F.xxhash64("label", "dim", "list", low, high).alias("unit")))
    parts = tasks_for(vectors, members.count(), 20_000)
    work = members.join(classes.select("rep", "size", "dim", "vector"), "rep").repartition(parts, "unit").sortWithinPartitions("unit", "rep")
    found = step(work.mapInArrow(_compare(pivots, cosine), "rep long, other long, n long"))
    edges = step(found.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")).distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    linked = connected_components(nodes, edges).withColumnRenamed("node", "rep").join(classes.select("rep", "low"), "rep")
    least = linked.groupBy("component").agg(F.min("low").alias("least"))
    linked = linked.join(least, "component").select("rep", "least")
    counts = found.groupBy("rep").agg(F.sum("n").alias("links"))
    done = classes.select("a", "b", "rep", "low", "size").join(linked, "rep", "left").join(counts, "rep", "left")
    done = step(done.select("a", "b", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("least", "low").alias("component_id")))
    out = rows.select("id", "a", "b").join(done, ["a", "b"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
