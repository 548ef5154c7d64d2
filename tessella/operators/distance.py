"""Exact Euclidean distance on integer grids, in two passes instead of a neighbour search.

Rows first: in a row of mask positions only the nearest one to the left and to the right can matter to a
column, so each mask position is sent to the blocks of ``BLOCK`` columns that lie nearer to it than to
its neighbours in the row. Then columns: a block's row distances are parabolas over the rows, and their lower
envelope gives every position its nearest mask row. The work grows with the positions, whatever
the distances; a strip of ``STRIP`` rows in a block of columns of one image is one unit, and neither pass needs the
other positions of the image. Positions may be sparse or repeated, and the mask need not lie on them.

A unit gets the mask positions of its own rows, and of the rows above and below it those that can matter. Let a mask
position be ``far`` columns at most from any column of the block. What lies above it in the block, at a row whose
distance to the unit is more than its own and ``far`` combined (by Pythagoras), is farther from every position of the unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut_lineage, null_safe

#: Columns of one unit of the second pass.
BLOCK = 64
#: Rows of one unit of the second pass.
STRIP = 4096


def lower_envelope(at: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parabolas (r - at[i])^2 + height[i, c] that are lowest somewhere, for every column c at once.

    Returns for each column the parabolas in order, where each begins, and their number less one.
    """
    rows, columns = height.shape
    lifted = height + (at * at)[:, None]
    chosen, begin = np.zeros((rows, columns), np.int64), np.full((rows, columns), -np.inf)
    top, every = np.zeros(columns, np.int64), np.arange(columns)
    for i in range(1, rows):
        active = every
        while len(active):
            below = chosen[top[active], active]
            meet = (lifted[i, active] - lifted[below, active]) / (2.0 * (at[i] - at[below]))
            beaten = meet <= begin[top[active], active]
            stay = active[~beaten]
            top[stay] += 1
            chosen[top[stay], stay], begin[top[stay], stay] = i, meet[~beaten]
            active = active[beaten]
            top[active] -= 1
    return chosen, begin, top


def nearest_squares(mask_row: np.ndarray, mask_col: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Squared distance of each position to the nearest mask position; mask rows must hold what matters to ``col``."""
    columns, which = np.unique(col, return_inverse=True)
    order = np.argsort(mask_row, kind="stable")
    mask_row, mask_col = mask_row[order], mask_col[order]
    starts = np.flatnonzero(np.append(True, mask_row[1:] != mask_row[:-1]))
    across = np.minimum.reduceat((columns[None, :] - mask_col[:, None]).astype(float) ** 2, starts, axis=0)
    first = mask_row[0]
    at, rows = (mask_row[starts] - first).astype(float), (row - first).astype(float)
    chosen, begin, top = lower_envelope(at, across)
    out = np.empty(len(row))
    by_column = np.argsort(which, kind="stable")
    ends = np.cumsum(np.bincount(which, minlength=len(columns)))
    for c, (a, b) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)):
        mine = by_column[a:b]
        found = chosen[np.searchsorted(begin[1 : top[c] + 1, c], rows[mine]), c]
        out[mine] = (rows[mine] - at[found]) ** 2 + across[found, c]
    return out


def _measure(names: list[str]) -> Callable:
    """Rows come unit by unit; mask rows (``__mask`` set) are used and not returned."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            mask, row, col = (np.asarray(rows.column(c).combine_chunks()) for c in ("__mask", "__row", "__col"))
            unit = np.asarray(rows.column("__unit").combine_chunks().dictionary_encode().indices)
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            squares = np.full(len(unit), np.nan)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                marked = np.flatnonzero(mask[a:b]) + a
                plain = np.flatnonzero(~mask[a:b]) + a
                if len(marked) and len(plain):
                    squares[plain] = nearest_squares(row[marked], col[marked], row[plain], col[plain])
            kept = pa.array(~mask)
            out = rows.select(names).append_column("__d", pa.array(np.sqrt(squares), from_pandas=True)).filter(kept)
            yield from out.combine_chunks().to_batches()

        # The last unit of a batch may go on in the next.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0].column("__unit")[0] == batch.column("__unit")[batch.num_rows - 1]:
                continue
            rows = pa.Table.from_batches(held)
            unit = np.asarray(rows.column("__unit").combine_chunks().dictionary_encode().indices)
            last = int(np.flatnonzero(unit[1:] != unit[:-1])[-1]) + 1
            yield from work(rows.slice(0, last))
            held = rows.slice(last).combine_chunks().to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))
    return run


def _from_outside(sent: DataFrame, spots: DataFrame, by: list[str]) -> DataFrame:
    """Mask positions (by, row, col, block, strip) sent to other strips of their block, where they can matter.

    ``spots`` lists the units that hold positions.
    """
    far = f"greatest(abs(__col - __block * {BLOCK}), abs(__block * {BLOCK} + {BLOCK - 1} - __col))"
    edges = sent.groupBy(*by, "__block", "__strip").agg(
        F.expr(f"max(struct(__row - {far} AS reach, __row AS row))").alias("__down"), F.max("__row").alias("__bottom"),
        F.expr(f"min(struct(__row + {far} AS reach, __row AS row))").alias("__up"), F.min("__row").alias("__top"),
    )
    strips = spots.select(*by, "__block", "__strip", F.lit(True).alias("__spot")).unionByName(edges, allowMissingColumns=True)
    strips = strips.groupBy(*by, "__block", "__strip").agg(
        F.max("__down").alias("__down"), F.max("__bottom").alias("__bottom"), F.min("__up").alias("__up"), F.min("__top").alias("__top"), F.max("__spot").alias("__spot")
    )
    column = Window.partitionBy(*by, "__block")
    above = column.orderBy("__strip").rowsBetween(Window.unboundedPreceding, -1)
    below = column.orderBy(F.desc("__strip")).rowsBetween(Window.unboundedPreceding, -1)
    near = strips.select(
        *by, "__block", "__strip", "__spot", (F.col("__strip") * STRIP).alias("__r0"), (F.col("__strip") * STRIP + STRIP - 1).alias("__r1"),
        F.max("__down").over(above).alias("__down"), F.max("__bottom").over(above).alias("__bottom"),
        F.min("__up").over(below).alias("__up"), F.min("__top").over(below).alias("__top"),
    ).where("__spot")

    def combined(gap: str, far: str) -> str:
        return f"sqrt(pow(CAST({gap} AS DOUBLE), 2) + pow(CAST({far} AS DOUBLE), 2))"

    # Rows that can matter, on each side; one more row makes up for rounding.
    ranges = near.select(*[F.col(c).alias("__k_" + c) for c in by], F.col("__block").alias("__k_block"), F.col("__strip").alias("__to"), F.inline(F.array(
        F.expr(f"struct(CAST(floor(__r0 - {combined('__r0 - __down.row', '__down.row - __down.reach')}) AS BIGINT) - 1 AS __low, __bottom AS __high)"),
        F.expr(f"struct(__top AS __low, CAST(ceil(__r1 + {combined('__up.row - __r1', '__up.reach - __up.row')}) AS BIGINT) + 1 AS __high)"),
    ))).where("__low <= __high")
    # They meet in bands of ``BLOCK`` rows.
    bands = ranges.withColumn("__k_band", F.explode(F.expr(f"sequence(CAST(floor(__low / {BLOCK}) AS BIGINT), CAST(floor(__high / {BLOCK}) AS BIGINT))")))
    sent = sent.withColumn("__band", F.floor(F.col("__row") / BLOCK).cast("long"))
    same = null_safe(sent, bands, by, "__k_") & (sent["__block"] == bands["__k_block"]) & (sent["__band"] == bands["__k_band"])
    found = sent.join(bands, same & sent["__row"].between(bands["__low"], bands["__high"]))
    return found.select(*by, "__row", "__col", "__block", F.col("__to").alias("__strip"))


def grid_nearest(positions: DataFrame, mask: DataFrame, by: Sequence[str] = (), row: str = "row", col: str = "col", out: str = "distance", unit: float = 1.0) -> DataFrame:
    """Add to every position its distance to the nearest mask position of its group, times ``unit``; NULL where there is none."""
    by = list(by)
    if out in positions.columns:
        positions = positions.drop(out)
    line = Window.partitionBy(*by, "__row").orderBy("__col")
    marked = mask.select(*by, F.col(row).cast("long").alias("__row"), F.col(col).cast("long").alias("__col")).where("__row IS NOT NULL AND __col IS NOT NULL").distinct()
    marked = marked.select("*", F.lag("__col").over(line).alias("__before"), F.lead("__col").over(line).alias("__after"))
    at_row, at = F.col(row).cast("long"), F.col(col).cast("long")
    strip, block = F.floor(at_row / STRIP).cast("long"), F.floor(at / BLOCK).cast("long")
    spots = positions.where(at_row.isNotNull() & at.isNotNull()).groupBy(*by, block.alias("__block"), strip.alias("__strip")).agg(F.min(at).alias("__first"), F.max(at).alias("__last"))
    # Written once: what follows reads the positions and the mask no further time.
    spots = cut_lineage(spots)
    ends = spots.groupBy(*[F.col(c).alias("__k_" + c) for c in by]).agg(F.min("__first").alias("__first"), F.max("__last").alias("__last"))
    same = null_safe(marked, ends, by, "__k_")
    # Columns that lie nearer to this mask position than to its neighbours in the row.
    low = "coalesce(greatest(__first, floor((__before + __col) / 2)), __first)"
    high = "coalesce(least(__last, ceil((__col + __after) / 2)), __last)"
    sent = marked.join(ends, same).selectExpr("*", f"CAST(floor({low} / {BLOCK}) AS BIGINT) AS __b0", f"CAST(floor({high} / {BLOCK}) AS BIGINT) AS __b1").where("__b0 <= __b1")
    sent = sent.select(*by, "__row", "__col", F.explode(F.sequence("__b0", "__b1")).alias("__block"), F.floor(F.col("__row") / STRIP).cast("long").alias("__strip"))
    sent = cut_lineage(sent)
    sent = sent.unionByName(_from_outside(sent, spots, by))
    rows = positions.select("*", F.lit(False).alias("__mask"), at_row.alias("__row"), at.alias("__col"), block.alias("__block"), strip.alias("__strip"))
    empty = [F.col(c) if c in by else F.lit(None).cast(positions.schema[c].dataType).alias(c) for c in positions.columns]
    rows = rows.unionByName(sent.select(*empty, F.lit(True).alias("__mask"), "__row", "__col", "__block", "__strip"))
    # Positions without coordinates are units of their own, without a mask.
    name = F.concat_ws(
        "|", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit(""), F.col("__block").cast("string"), F.col("__strip").cast("string"),
        F.when(F.col("__row").isNull() | F.col("__col").isNull(), "none"),
    )
    rows = rows.withColumns({"__unit": name, "__row": F.coalesce("__row", F.lit(0)), "__col": F.coalesce("__col", F.lit(0))})
    rows = rows.repartition("__unit").sortWithinPartitions("__unit")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in positions.schema.fields)
    found = rows.select(*positions.columns, "__mask", "__row", "__col", "__unit").mapInArrow(_measure(positions.columns), f"{schema}, __d double")
    return found.select(*positions.columns, (F.col("__d") * unit).alias(out))
