"""Session settings, checkpointing and small planning helpers shared by all operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS_CONF = "spark.tessella.broadcastRows"
BROADCAST_ROWS_DEFAULT = 100_000
#: Rows that a task makes of copied rows, on average.
ROWS_A_TASK = 500_000


def build_session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """Session with AQE, skew handling and UTC; cluster settings are left to the cluster."""
    builder = SparkSession.builder.appName("tessella")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """New folder for intermediate files: shared on a cluster, local only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tessella-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Unlike a checkpoint this computes the last stage once, keeps column pruning and gives the
    optimiser true sizes; a lost executor only costs re-reading files.
    """
    spark = df.sparkSession
    path = scratch_folder(spark) + "/table"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialised(df: DataFrame) -> DataFrame:
    """Write out a table that is about to be read several times, unless it is a plain scan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    costly = any(node in plan for node in ("Join", "Aggregate", "Window", "Generate"))
    return cut_lineage(df) if costly else df


def deal(df: DataFrame, copies: int) -> DataFrame:
    """``df`` dealt to as many tasks as ``copies`` of its rows need, before they are made.

    A small file is one split, so without this one task would make and group all the copies.
    ``df`` is counted first, so it should be a scan or a written table.
    """
    needed = math.ceil(df.count() * copies / ROWS_A_TASK)
    return df if needed <= 1 else df.repartition(max(needed, df.sparkSession.sparkContext.defaultParallelism))


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint only when the counted number of rows is under the limit."""
    limit = int(df.sparkSession.conf.get(BROADCAST_ROWS_CONF, str(BROADCAST_ROWS_DEFAULT)))
    return F.broadcast(df) if rows <= limit else df


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality on ``keys`` where the right side carries them under ``prefix``."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[prefix + key])
    return condition


def attach_few(df: DataFrame, stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``attach`` for statistics of few groups: a join that shuffles would send all rows of a group to one task."""
    if keys:
        stats = cut_lineage(stats)
        stats = broadcast_if(stats, stats.count())
    return attach(df, stats, keys)


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add per-group statistics to every row; without keys ``stats`` is a one-row aggregate."""
    if not keys:
        return df.crossJoin(F.broadcast(stats))
    renamed = stats.select(
        *[F.col(k).alias("__k_" + k) for k in keys],
        *[F.col(c) for c in stats.columns if c not in keys],
    )
    joined = df.join(renamed, null_safe(df, renamed, keys, "__k_"), "left")
    return joined.drop(*["__k_" + k for k in keys])
