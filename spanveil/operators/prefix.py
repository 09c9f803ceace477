"""Running totals and neighbours that survive one very large key.

A plain window puts a whole key into one task.  Here a key is cut into blocks of
its integer order column: block totals are aggregated (map-side combined), only
those totals are windowed per key, and rows are windowed per (key, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 32_768


def with_running(
    df: DataFrame,
    keys: list[str],
    order: str,
    *,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Add columns computed over all earlier rows of the key.

    ``sums`` and ``maxes`` are exclusive running totals (0 and null at the start);
    ``last`` is the value of the row just before.  ``order`` must be a
    non-negative integer, unique within the key.
    """
    sums, maxes, last = sums or {}, maxes or {}, last or {}
    exprs = {**sums, **maxes, **last}
    part = df.withColumn("_b", F.floor(F.col(order) / block))
    part = part.withColumns({f"_v_{n}": e for n, e in exprs.items()})
    totals = part.groupBy(*keys, "_b").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxes],
        *[F.max_by(f"_v_{n}", order).alias(f"_t_{n}") for n in last],
    )
    blocks = Window.partitionBy(*keys).orderBy("_b")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_b",
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in maxes],
        *[F.lag(f"_t_{n}").over(blocks).alias(f"_c_{n}") for n in last],
    )
    rows = Window.partitionBy(*keys, "_b").orderBy(order)
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    joined = part.join(carried, [*keys, "_b"])
    made = {}
    for n in sums:
        here = F.sum(f"_v_{n}").over(before)
        made[n] = F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.coalesce(here, F.lit(0))
    for n in maxes:
        made[n] = F.greatest(F.col(f"_c_{n}"), F.max(f"_v_{n}").over(before))
    for n in last:
        first = F.row_number().over(rows) == 1
        made[n] = F.when(first, F.col(f"_c_{n}")).otherwise(F.lag(f"_v_{n}").over(rows))
    spare = ["_b", *[f"_v_{n}" for n in exprs], *[f"_c_{n}" for n in exprs]]
    return joined.withColumns(made).drop(*spare)
