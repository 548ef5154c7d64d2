"""Exact order statistics, quantiles and average ranks that never gather a group in one task.

Values are first reduced to (value, count).  Every group is cut into buckets at some of its own
distinct values, one in ``SPLIT_EVERY`` of them by hash, so the number of buckets follows the number
of distinct values; the cut points only balance the work, every result is exact.

Quantiles of few groups look only at the values between two approximate quantiles that hold the exact one
(``_bracketed_quantiles``); exact counts show that they do, and without that all values are ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import attach, attach_few, cut_lineage, materialised, null_safe

#: Distinct values of a bucket, on average.
SPLIT_EVERY = 100_000
#: Approximate quantiles that bracket an exact one err by a share of 1 / ``BRACKET`` of the rows at most.
BRACKET = 1000


def value_positions(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values per group with their count and the number of smaller rows.

    Output: keys, ``value``, ``count``, ``before``, ``total``.
    """
    keys = list(keys)
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(amount.alias("count"))
    )
    chosen = F.pmod(F.xxhash64("value"), F.lit(SPLIT_EVERY)) == 0
    cuts = counts.where(chosen).groupBy(*keys).agg(F.array_sort(F.collect_list("value")).alias("__cuts"))
    halves = "transform(sequence(length(bin(size(__cuts))) - 1, 0, -1), i -> shiftleft(1, i))"
    placed = attach(counts, cuts.withColumn("__steps", F.expr(halves)), keys)
    search = F.aggregate(
        "__steps",
        F.lit(0),
        lambda at, step: F.when(F.col("value") > F.get("__cuts", at + step - 1), at + step).otherwise(at),
    )
    placed = placed.select(*keys, "value", "count", F.coalesce(search, F.lit(0)).alias("__bucket"))
    offsets = placed.groupBy(*keys, "__bucket").agg(F.sum("count").alias("__n"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(
        *keys, "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"), F.sum("__n").over(group).alias("total")
    )
    within = (
        Window.partitionBy(*keys, "__bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    )
    running = placed.withColumn("__upto", F.sum("count").over(within))
    return attach(running, offsets, [*keys, "__bucket"]).select(
        *keys, "value", "count", (F.col("__off") + F.col("__upto") - F.col("count")).alias("before"), "total"
    )


def _picked(wanted: Mapping[str, tuple[Column, float]]) -> tuple[dict[str, str], dict[str, Column]]:
    """Short names of the different expressions, and the expressions by short name."""
    columns: dict[str, str] = {}
    for column, _p in wanted.values():
        columns.setdefault(str(column), f"m{len(columns)}")
    return columns, {columns[str(column)]: column.cast("double") for column, _p in wanted.values()}


def _bracketed_quantiles(df: DataFrame, keys: list[str], wanted: Mapping[str, tuple[Column, float]]) -> DataFrame | None:
    """Exact quantiles of few groups from three scans, without ordering all values; None if a bracket misses its quantile."""
    columns, picked = _picked(wanted)
    base = materialised(df.select(*keys, *[c.alias(m) for m, c in picked.items()]))
    items = [(i, columns[str(column)], float(p)) for i, (column, p) in enumerate(wanted.values())]
    slack = 2.0 / BRACKET
    points = {m: sorted({q for _, n, p in items if n == m for q in (p - slack, p + slack) if 0.0 < q < 1.0}) for m in picked}
    found = base.groupBy(*keys).agg(*[c for m in picked for c in (
        F.min(m).alias(f"__min_{m}"), F.max(m).alias(f"__max_{m}"), F.count(m).alias(f"__n_{m}"),
        F.percentile_approx(m, points[m] or [0.5], BRACKET).alias(f"__q_{m}"),
    )])

    def end(m: str, q: float) -> Column:
        return F.get(f"__q_{m}", F.lit(points[m].index(q))) if q in points[m] else F.col(f"__min_{m}" if q <= 0.0 else f"__max_{m}")

    ends = [c for i, m, p in items for c in (end(m, p - slack).alias(f"__a_{i}"), end(m, p + slack).alias(f"__b_{i}"))]
    limits = cut_lineage(found.select(*keys, *[f"__n_{m}" for m in picked], *ends))
    near = attach_few(base, limits, keys)
    sizes = near.groupBy(*keys).agg(*[c for i, m, _ in items for c in (
        F.count_if(F.col(m) < F.col(f"__a_{i}")).alias(f"__below_{i}"), F.max(F.when(F.col(m) < F.col(f"__a_{i}"), F.col(m))).alias(f"__prev_{i}"),
        F.count_if((F.col(m) >= F.col(f"__a_{i}")) & (F.col(m) <= F.col(f"__b_{i}"))).alias(f"__in_{i}"),
        F.min(F.when(F.col(m) > F.col(f"__b_{i}"), F.col(m))).alias(f"__next_{i}"),
    )])
    sizes = cut_lineage(attach(sizes, limits, keys))
    missed = F.lit(False)
    for i, m, p in items:
        at, below = F.lit(p) * (F.col(f"__n_{m}") - 1), F.col(f"__below_{i}")
        missed = missed | ((F.col(f"__n_{m}") > 0) & ~F.coalesce((F.floor(at) >= below - 1) & (F.ceil(at) <= below + F.col(f"__in_{i}")), F.lit(False)))
    if not sizes.where(missed).isEmpty():
        return None
    inside = {i: (F.col(m) >= F.col(f"__a_{i}")) & (F.col(m) <= F.col(f"__b_{i}")) for i, m, _ in items}
    some = F.lit(False)
    for test in inside.values():
        some = some | test
    parts = F.array(*[F.when(inside[i], F.struct(F.lit(i).alias("__i"), F.col(m).alias("__v"))) for i, m, _ in items])
    rows = near.where(some).select(*keys, F.explode(parts).alias("__e")).where("__e IS NOT NULL").select(*keys, "__e.__i", "__e.__v")
    placed = value_positions(rows, [*keys, "__i"], "__v").drop("total")
    placed = attach_few(placed, sizes, keys)
    results = []
    for name, (i, m, p) in zip(wanted, items):
        position, below = F.lit(p) * (F.col(f"__n_{m}") - 1), F.col(f"__below_{i}")

        def at(index: Column, i: int = i, below: Column = below) -> Column:
            first = below + F.col("before")
            value = F.when((first <= index) & (index < first + F.col("count")), F.col("value"))
            value = F.coalesce(value, F.when(index < below, F.col(f"__prev_{i}")), F.when(index >= below + F.col(f"__in_{i}"), F.col(f"__next_{i}")))
            return F.max(F.when(F.col("__i") == i, value))

        low, high = F.floor(position), F.ceil(position)
        part = F.max(F.when(F.col("__i") == i, position - F.floor(position)))
        results.append((at(low) + (at(high) - at(low)) * part).alias(name))
    return cut_lineage(placed.groupBy(*keys).agg(*results))


def _distributed_quantiles(
    df: DataFrame, keys: list[str], wanted: Mapping[str, tuple[Column, float]]
) -> DataFrame:
    columns, picked = _picked(wanted)
    base = df.select(*keys, *[c.alias(m) for m, c in picked.items()])
    long = base.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("v")) for m in picked])
        ).alias("e"),
    ).select(*keys, F.col("e.m").alias("__m"), F.col("e.v").alias("__v"))
    placed = value_positions(long, [*keys, "__m"], "__v")
    results = []
    for name, (column, p) in wanted.items():
        position = F.lit(float(p)) * (F.col("total") - 1)
        here = F.col("__m") == columns[str(column)]

        def at(index: Column, here: Column = here) -> Column:
            inside = here & (F.col("before") <= index) & (index < F.col("before") + F.col("count"))
            return F.max(F.when(inside, F.col("value")))

        low, high = F.floor(position), F.ceil(position)
        part = F.max(F.when(here, position - F.floor(position)))
        # This form returns equal neighbours unchanged, without a rounding step between them.
        results.append((at(low) + (at(high) - at(low)) * part).alias(name))
    return placed.groupBy(*keys).agg(*results)


def summarise(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Sequence[Column] = (),
    quantiles: Mapping[str, tuple[Column, float]] | None = None,
    few: bool = False,
) -> DataFrame:
    """``groupBy(keys).agg(aggregates)`` plus exact linear-interpolated quantiles.

    ``quantiles`` maps an output name to (expression, probability); NULLs are ignored. ``few`` says that
    groups are few and large; it never changes a result.
    """
    keys, quantiles = list(keys), dict(quantiles or {})
    if not quantiles:
        return df.groupBy(*keys).agg(*aggregates)
    spread = _bracketed_quantiles(df, keys, quantiles) if few or not keys else None
    if spread is None:
        spread = _distributed_quantiles(df, keys, quantiles)
    base = df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()
    if not keys:
        return attach(base, spread) if aggregates else spread
    return attach(base, spread, keys)


def average_rank(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Average rank of every distinct value per group: keys, ``value``, ``rank``, ``total``."""
    placed = value_positions(df, keys, value, weight)
    return placed.select(
        *keys, "value", (F.col("before") + (F.col("count") + 1) / 2).alias("rank"), "total"
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Zero-based position of every row within its group.

    Rows are range-partitioned by group and order, so a group that holds a large share of all rows
    is numbered piecewise and shifted by the sizes of the earlier pieces.
    """
    keys, order = list(keys), list(order)
    pieces = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("__piece", F.spark_partition_id()))
    sizes = pieces.groupBy(*keys, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__piece", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    within = F.row_number().over(Window.partitionBy(*keys, "__piece").orderBy(*order)) - 1
    numbered = attach(pieces.withColumn("__at", within), offsets, [*keys, "__piece"])
    return numbered.withColumn(out, (F.col("__off") + F.col("__at")).cast("int")).drop("__piece", "__at", "__off")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "rho") -> DataFrame:
    """Spearman correlation per group (Pearson of average ranks); NULL if undefined.

    Output: keys, ``pairs`` and ``out``.  Equal (x, y) pairs are merged before ranks are joined.
    """
    keys = list(keys)
    pairs = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, F.col(x).alias("__x"), F.col(y).alias("__y"))
        .agg(F.count(F.lit(1)).alias("__w"))
    )

    def ranks(column: str, name: str) -> DataFrame:
        table = average_rank(pairs, keys, column, "__w")
        kept = [F.col(k).alias(f"__{name}_{k}") for k in keys]
        return table.select(*kept, F.col("value").alias(f"__v{name}"), F.col("rank").alias(f"__r{name}"), F.col("total").alias(f"__n{name}"))

    rx, ry = ranks("__x", "a"), ranks("__y", "b")
    joined = pairs.join(rx, null_safe(pairs, rx, keys, "__a_") & (pairs["__x"] == rx["__va"]))
    joined = joined.join(
        ry.drop("__nb"), null_safe(pairs, ry, keys, "__b_") & (joined["__y"] == ry["__vb"])
    )
    dx = F.col("__ra") - (F.col("__na") + 1) / 2
    dy = F.col("__rb") - (F.col("__na") + 1) / 2
    total = joined.groupBy(*[pairs[k] for k in keys]).agg(
        F.sum("__w").alias("pairs"),
        F.sum(F.col("__w") * dx * dy).alias("__xy"),
        F.sum(F.col("__w") * dx * dx).alias("__xx"),
        F.sum(F.col("__w") * dy * dy).alias("__yy"),
    )
    defined = (F.col("pairs") >= 2) & (F.col("__xx") > 0) & (F.col("__yy") > 0)
    rho = F.col("__xy") / (F.sqrt("__xx") * F.sqrt("__yy"))
    return total.select(*keys, "pairs", F.when(defined, rho).alias(out))
