"""Connected components of graphs and of pixel masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut_lineage

MAX_ROUNDS = 64


def _follow(links: DataFrame, by: list[str]) -> DataFrame:
    """Shortcut links (node -> lower node) until every node points at its final target."""
    for _ in range(MAX_ROUNDS):
        nxt = links.select(*by, F.col("node").alias("to"), F.col("to").alias("__further"))
        jumped = links.join(nxt, [*by, "to"], "left")
        moved = cut_lineage(jumped.select(*by, "node", F.coalesce("__further", "to").alias("to"), F.col("__further").isNotNull().alias("moved")))
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return links
    raise RuntimeError("links did not settle")


def connected_components(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lowest node of each component: by, ``node``, ``component``.

    Every round hooks each root to its lowest neighbouring root, shortcuts the links and contracts
    the edges, so the edge list shrinks quickly whatever the shape of the components.
    """
    by = list(by)
    labels = nodes.select(*by, "node", F.col("node").alias("component"))
    links_all: list[DataFrame] = []
    rest = cut_lineage(
        edges.where("a <> b").select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    for _ in range(MAX_ROUNDS):
        if rest.isEmpty():
            break
        links = cut_lineage(rest.groupBy(*by, F.col("b").alias("node")).agg(F.min("a").alias("to")))
        links = _follow(links, by)
        links_all.append(links)
        la = links.select(*by, F.col("node").alias("a"), F.col("to").alias("ta"))
        lb = links.select(*by, F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = rest.join(la, [*by, "a"], "left").join(lb, [*by, "b"], "left").select(
            *by, F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y")
        )
        rest = cut_lineage(
            moved.where("x <> y").select(*by, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
    else:
        raise RuntimeError("components did not settle")
    for links in links_all:
        step = links.select(*by, F.col("node").alias("component"), "to")
        labels = labels.join(step, [*by, "component"], "left").select(*by, "node", F.coalesce("to", "component").alias("component"))
    return labels


ROW_STRIDE = 1 << 31


def pixel_components(mask: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """4-connected components of the pixels listed in ``mask``: by, row, col, ``component``.

    Pixels of a row are first merged into runs; only runs of neighbouring rows are linked.
    """
    by = list(by)
    line = Window.partitionBy(*by, "row").orderBy("col")
    island = mask.select(*by, "row", "col", (F.col("col") - F.row_number().over(line)).alias("__g"))
    start = F.min("col").over(Window.partitionBy(*by, "row", "__g"))
    runs = cut_lineage(island.select(
        *by, "row", "col", (F.col("row").cast("long") * ROW_STRIDE + start).alias("node")
    ))
    below = runs.select(*by, (F.col("row") - 1).alias("row"), "col", F.col("node").alias("b"))
    edges = runs.withColumnRenamed("node", "a").join(below, [*by, "row", "col"]).select(*by, "a", "b")
    found = connected_components(runs.select(*by, "node").distinct(), edges, by)
    return runs.join(found, [*by, "node"]).select(*by, "row", "col", "component")


def keep_large(components: DataFrame, minimum: int, by: Sequence[str] = ()) -> DataFrame:
    """Pixels of components with at least ``minimum`` pixels."""
    by = list(by)
    sizes = components.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= minimum)
    return components.join(sizes.drop("__n"), [*by, "component"], "left_semi")


def component_sizes(components: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return components.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("pixels"))
