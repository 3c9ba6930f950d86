"""Two-level scans: order, halos and running moments of long recordings without a recording in one task.

Level one works on blocks, runs of rows of one recording; level two is a scan
over the small table of blocks, whose sums are added back. A block holds the rows
before it that its first windows reach back to (its halo), so that every trailing
window of a bounded number of rows is complete within its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.sources.staging import staged


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "at_") -> DataFrame:
    """Adds the position of a row in its recording, from 0 (long).

    Rows are sorted by recording and order over all tasks, numbered within each task, and moved on by what earlier tasks
    hold of the recording. Equal orders are numbered as they come, the same at every later read.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = staged(ranged.withColumn("part_", F.spark_partition_id()).withColumn("row_", F.monotonically_increasing_id()), "numbered")
    parts = rows.groupBy(*keys, "part_").agg(F.min("row_").alias("first_"), F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*keys, "part_", (F.coalesce(before, F.lit(0)) - F.col("first_")).alias("move_"))
    return rows.join(parts, [*keys, "part_"]).withColumn(name, F.col("row_") + F.col("move_")).drop("part_", "row_", "move_")


def with_halo(df: DataFrame, size: int, back: int, at: str = "at_") -> DataFrame:
    """Adds `block_`: rows appear in their block (at DIV size) and, the last `back` of it, in the next one too."""
    if back > size:
        raise ValueError("a halo may not be longer than a block")
    own = F.floor(F.col(at) / size)
    return df.withColumn("block_", F.explode(F.when(F.col(at) % size >= size - back, F.array(own, own + 1)).otherwise(F.array(own))))


def block_moments(own: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For each block of `own(keys, block_, columns)`: of each column the recording's mean `{c}_mean` and sample deviation `{c}_sd`,

    and what the blocks before hold: `{c}_n`, and the sums `{c}_s1`, `{c}_s2` of the first and second powers of value - mean.
    Nulls don't count. The mean as origin keeps the sums small; it cancels out of what is made of them.
    """
    parts = own.groupBy(*keys, "block_").agg(*[f(c).alias(f"{c}_{s}") for c in columns for s, f in (("bn", F.count), ("bm", F.avg), ("bv", F.var_pop))])
    every, earlier = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    n, zero = (lambda c: F.col(f"{c}_bn")), F.lit(0.0)
    parts = parts.withColumns({f"{c}_mean": F.sum(n(c) * F.col(f"{c}_bm")).over(every) / F.nullif(F.sum(n(c)).over(every), F.lit(0)) for c in columns})
    off = lambda c: F.coalesce(F.col(f"{c}_bm") - F.col(f"{c}_mean"), zero)
    second = lambda c: n(c) * (F.coalesce(F.col(f"{c}_bv"), zero) + off(c) * off(c))
    made = {}
    for c in columns:
        total = F.sum(n(c)).over(every)
        made[f"{c}_sd"] = F.when(total > 1, F.sqrt(F.sum(second(c)).over(every) / (total - 1)))
        made[f"{c}_n"] = F.coalesce(F.sum(n(c)).over(earlier), F.lit(0))
        made[f"{c}_s1"] = F.coalesce(F.sum(n(c) * off(c)).over(earlier), zero)
        made[f"{c}_s2"] = F.coalesce(F.sum(second(c)).over(earlier), zero)
    return parts.withColumns(made).select(*keys, "block_", *[f"{c}_{s}" for c in columns for s in ("mean", "sd", "n", "s1", "s2")])


class Running:
    """Sums over the last n rows of a block as differences of running sums: linear in the rows, whatever n is."""

    def __init__(self, df: DataFrame, keys: list[str], at: str = "at_"):
        self.df, self.w = df, Window.partitionBy(*keys, "block_").orderBy(at)

    def add(self, **values: Column) -> None:
        """Running sums (nulls as 0) by name."""
        upto = self.w.rowsBetween(Window.unboundedPreceding, 0)
        self.df = self.df.withColumns({k: F.sum(F.coalesce(v, F.lit(0.0))).over(upto) for k, v in values.items()})

    def last(self, name: str, n: int) -> Column:
        """Sum of the last n rows."""
        return F.col(name) - F.coalesce(F.lag(name, n).over(self.w), F.lit(0.0))


_FIRST = float("-inf")


def latest(rows: DataFrame, facts: DataFrame, keys: list[str], at: Column, fact_at: Column, value: Column, name: str, strict: bool = False, bucket: float = 3600.0) -> DataFrame:
    """Adds `name` to each of `rows`: the greatest `value` of the facts of its recording up to `at` (before it, if `strict`).

    An as-of search without a join: rows and facts are sorted together once, in buckets of time, and the greatest value so
    far is carried along; what earlier buckets hold comes in as one more row of each bucket. Linear in rows and facts, and a
    task's group is a bucket, not a recording. Facts without a time are not seen; a row without one sees none.
    """
    asks, kind = rows.select(*keys, at.cast("double").alias("t_"), F.struct(*rows.columns).alias("row_")), facts.select(value.alias("v")).schema["v"].dataType
    told = facts.select(*keys, fact_at.cast("double").alias("t_"), value.alias("value_")).where("t_ IS NOT NULL")
    tag = F.lit(0 if strict else 2)
    both = asks.withColumn("value_", F.lit(None).cast(kind)).withColumn("tag_", tag).unionByName(told.withColumn("row_", F.lit(None).cast(asks.schema["row_"].dataType)).withColumn("tag_", F.lit(1)))
    both = both.withColumn("bucket_", F.floor(F.col("t_") / bucket))
    earlier = Window.partitionBy(*keys).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*keys, "bucket_").agg(F.max("value_").alias("value_")).withColumn("value_", F.max("value_").over(earlier)).where("value_ IS NOT NULL AND bucket_ IS NOT NULL")
    carried = carried.select(*keys, F.lit(_FIRST).alias("t_"), F.lit(None).cast(asks.schema["row_"].dataType).alias("row_"), "value_", F.lit(-1).alias("tag_"), "bucket_")
    sofar = Window.partitionBy(*keys, "bucket_").orderBy("t_", "tag_").rowsBetween(Window.unboundedPreceding, 0)
    return both.unionByName(carried).withColumn("best_", F.max("value_").over(sofar)).where("row_ IS NOT NULL").select("row_.*", F.col("best_").alias(name))


def cells(lo: Column, hi: Column, width: float) -> Column:
    """The cells of a grid that a closed interval touches, none if an end is missing or the interval is empty."""
    a, b = F.floor(lo / width), F.floor(hi / width)
    return F.when(lo <= hi, F.sequence(a, b)).otherwise(F.expr("CAST(array() AS array<bigint>)"))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float = 600.0) -> DataFrame:
    """Pairs of rows of a recording whose closed intervals touch: `left.*` and the columns of `right` besides the keys.

    Intervals are dealt to the cells of a grid that they touch and joined by (recording, cell); a pair that shares several
    cells belongs to the one in which the later of the two begins. With a width near the usual length, the rows met are
    linear in the pairs that come out. The columns of both sides, but for the keys, have different names.
    """
    (a, b), (c, d) = left_span, right_span
    met = left.withColumn("cell_", F.explode(cells(F.col(a), F.col(b), width))).join(right.withColumn("cell_", F.explode(cells(F.col(c), F.col(d), width))), [*keys, "cell_"])
    met = met.where((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.floor(F.greatest(a, c) / width) == F.col("cell_")))
    return met.select(*left.columns, *[x for x in right.columns if x not in keys])
