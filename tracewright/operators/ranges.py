"""Orders and running sums over large groups, without a task that holds a group.

Rows are dealt into ranges of (group, order): bounds come from a small sample by hash, sums of
ranges (a row each) give every range its start, and only ranges are sorted. Where no group
is larger than a range, there is one range a group and one plain window.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a range, unless MOST ranges of the largest group hold more.
RANGE = 100_000
MOST = 1024
#: Sampled rows between two bounds.
APART = 50


def persisted(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared checkpoint folder; in local mode a temporary one, where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def joined(rows: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each row with the columns of its group's row in ``small``, a table of a row for each group
    or range; null groups too."""
    if not by:
        return rows.crossJoin(F.broadcast(small))  # one row
    renamed = small.withColumnsRenamed({c: f"_{c}_" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by])
    return rows.join(F.broadcast(renamed), same).drop(*[f"_{c}_" for c in by])


def with_ranges(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, bool]:
    """(rows with ``_range``, ascending in the order, and whether any group has several)."""
    sizes = rows.groupBy(*by).count()
    largest = sizes.agg(F.max("count")).first()[0] or 0
    ranges = min(MOST, largest // RANGE)
    if ranges < 2:
        return rows.withColumn("_range", F.lit(0)), False
    every = max(1, largest // (ranges * APART))
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    sampled = rows.where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).groupBy(*by).agg(F.sort_array(F.collect_list(key)).alias("_s"))
    # MOST * APART sampled rows of a group, about, at any size
    bounds = sampled.select(*by, F.filter(F.col("_s"), lambda x, i: (i + 1) % APART == 0).alias("_bounds"))
    marked = rows.withColumn("_key", key)
    if by:
        renamed = bounds.withColumnsRenamed({c: f"_{c}_" for c in by})
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by])
        marked = marked.join(F.broadcast(renamed), same, "left").drop(*[f"_{c}_" for c in by])
    else:
        marked = marked.crossJoin(F.broadcast(bounds))  # one row
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(MOST.bit_length() + 2))])
    place = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.coalesce(F.size("_bounds"), F.lit(0))) & (F.get("_bounds", at + s - 1) <= F.col("_key")), at + s).otherwise(at))
    return marked.withColumn("_range", place).drop("_key", "_bounds"), True


def running(rows: DataFrame, by: Sequence[str], order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """Adds running sums of ``values``, up to and with the row, in each group's order. The order
    decides between all rows of a group."""
    ranged, several = with_ranges(rows, by, order)
    ranged = ranged.withColumns({f"_v_{c}": v for c, v in values.items()})
    run = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumns({c: F.sum(f"_v_{c}").over(run) for c in values})
    if several:
        sums = ranged.groupBy(*by, "_range").agg(*[F.sum(f"_v_{c}").alias(f"_s_{c}") for c in values])
        before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select(*by, "_range", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in values])
        inside = joined(inside, starts, [*by, "_range"]).withColumns({c: F.col(c) + F.col(f"_b_{c}") for c in values})
    return inside.select(*rows.columns, *values)


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Adds the 0-based place in each group's order."""
    return running(rows, by, order, {name: F.lit(1).cast("bigint")}).withColumn(name, F.col(name) - 1)


def nth_rows(rows: DataFrame, by: Sequence[str], order: Sequence[Column], at: Callable[[Column], Column]) -> DataFrame:
    """group, n (its rows) and ``key`` (struct of the order's columns k0, k1, ...) of the row at
    the 0-based place ``at(n)``; groups without such a row are left out. Only the range that
    holds the place is sorted."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    ranged, several = with_ranges(rows, by, order)
    keys = ranged.select(*by, "_range", key.alias("key"))
    if not several:
        sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
        run = Window.partitionBy(*by).orderBy("key")
        placed = joined(keys.withColumn("_i", F.row_number().over(run) - 1), sizes, by)
        return placed.where(F.col("_i") == at(F.col("n"))).select(*by, "n", "key")
    counts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    # rows of these windows are ranges
    spread = counts.select(*by, "_range", (F.sum("_c").over(upto) - F.col("_c")).alias("_start"), "_c", F.sum("_c").over(whole).alias("n"))
    wanted = spread.where((at(F.col("n")) >= F.col("_start")) & (at(F.col("n")) < F.col("_start") + F.col("_c"))).select(*by, "_range", "_start", "n")
    inside = joined(keys, wanted, [*by, "_range"])
    run = Window.partitionBy(*by, "_range").orderBy("key")
    return inside.withColumn("_i", F.col("_start") + F.row_number().over(run) - 1).where(F.col("_i") == at(F.col("n"))).select(*by, "n", "key")
