"""Gates that raise with names: required columns, unique keys, finite numbers, checked joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataQualityError(ValueError):
    """A table does not meet its contract."""


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise DataQualityError(f"{what} is missing columns: {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    found = duplicate_keys(df, keys).limit(5).collect()
    if found:
        raise DataQualityError(f"{what} repeats keys {list(keys)}, for example {[tuple(r)[:-1] for r in found]}")
    return df


def not_finite(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.coalesce(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(True))


def assert_finite(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    counts = df.agg(*[F.count_if(not_finite(c)).alias(c) for c in columns]).first().asDict()
    bad = {c: n for c, n in counts.items() if n}
    if bad:
        raise DataQualityError(f"{what} has values that are not finite: {bad}")
    return df


def gate_report(df: DataFrame, keys: Sequence[str], finite: Sequence[str]) -> DataFrame:
    """One row: rows, keys held more than once, and values that are not finite per column."""
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(not_finite(c)).alias("bad_" + c) for c in finite]
    )
    return per_key.agg(
        F.sum("n").alias("rows"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
        *[F.sum("bad_" + c).alias("bad_" + c) for c in finite],
    )


def validated_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], validate: str = "many_to_one", how: str = "inner"
) -> DataFrame:
    """Equi-join that fails when the declared side repeats a key."""
    if validate not in ("one_to_one", "many_to_one", "one_to_many"):
        raise ValueError(f"unknown validation {validate}")
    if validate in ("one_to_one", "many_to_one"):
        assert_unique(right, on, "right side")
    if validate in ("one_to_one", "one_to_many"):
        assert_unique(left, on, "left side")
    return left.join(right, list(on), how)


def key_identity(left: DataFrame, right: DataFrame, key: str, examples: int = 10) -> DataFrame:
    """One row comparing two key sets: sizes, missing keys each way, the lowest few of them."""
    sides = (
        left.select(F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(F.col(key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    )
    counts = sides.agg(
        F.sum("l").alias("left_keys"), F.sum("r").alias("right_keys"),
        F.count_if(F.col("l") > F.col("r")).alias("only_left"),
        F.count_if(F.col("r") > F.col("l")).alias("only_right"),
    )

    def lowest(condition: str, name: str) -> DataFrame:
        few = sides.where(condition).orderBy("k").limit(examples)
        return few.agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias(name))

    return (
        counts.crossJoin(F.broadcast(lowest("l > r", "left_examples")))
        .crossJoin(F.broadcast(lowest("r > l", "right_examples")))
        .withColumn("identical", (F.col("only_left") == 0) & (F.col("only_right") == 0))
    )


def assert_same_keys(left: DataFrame, right: DataFrame, key: str) -> None:
    row = key_identity(left, right, key).first()
    if not row["identical"]:
        raise DataQualityError(
            f"keys differ: {row['only_left']} only on the left ({row['left_examples']}), "
            f"{row['only_right']} only on the right ({row['right_examples']})"
        )
