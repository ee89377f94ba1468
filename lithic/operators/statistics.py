"""Exact column statistics, from one count by value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """attname, null_frac, n_distinct of each column.

    n_distinct is the number of different values, or minus their share of all
    rows where that is over a tenth.
    """
    # One pass for the total and the values that aren't null of all columns; then one count by value each.
    seen = rows.agg(F.count(F.lit(1)), *[F.count(F.col(f"`{c}`")) for c in columns]).first()
    total, out = seen[0], None
    for c, k in zip(columns, seen[1:], strict=True):
        one = value_counts(rows, c).agg(F.count(F.lit(1)).alias("d")).select(
            F.lit(c).alias("attname"),
            F.lit((total - k) / total if total else 0.0).alias("null_frac"),
            F.when(F.col("d") > 0.1 * total, -F.col("d") / F.lit(float(total))).otherwise(F.col("d").cast("double")).alias("n_distinct"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def sampled_summary(rows: DataFrame, columns: list[str], sample: int = 30_000, seed: int = 1) -> DataFrame:
    """attname, null_frac, n_distinct estimated from about ``sample`` rows.

    The number of different values is Haas and Stokes' estimate, n d / (n - f1
    + f1 n / N) for d values, f1 of them seen once, among n of N rows.
    """
    total = rows.count()
    some = rows.select(*columns) if total <= sample else rows.select(*columns).sample(sample / total, seed)
    n, out = some.count(), None
    for c in columns:
        one = value_counts(some, c).agg(F.count(F.lit(1)).alias("d"), F.count_if(F.col("n") == 1).alias("f1"), F.coalesce(F.sum("n"), F.lit(0)).alias("k"))
        k = F.greatest(F.col("k"), F.lit(1))
        whole = F.lit(float(total)) * F.col("k") / F.lit(float(max(n, 1)))
        d = F.least(k * F.col("d") / (k - F.col("f1") + F.col("f1") * k / F.greatest(whole, F.lit(1.0))), F.greatest(whole, F.lit(0.0)))
        one = one.withColumn("all", F.coalesce(d, F.lit(0.0))).select(
            F.lit(c).alias("attname"),
            (F.lit(1.0) - F.col("k") / F.lit(float(max(n, 1)))).alias("null_frac"),
            F.when(F.col("all") > 0.1 * total, -F.col("all") / F.lit(float(max(total, 1)))).otherwise(F.col("all")).alias("n_distinct"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def most_common(rows: DataFrame, column: str, target: int = 100) -> DataFrame:
    """value and freq (share of all rows) of the values that occur more than once, most frequent first, ties by value."""
    total = rows.count()
    return value_counts(rows, column).where("n > 1").orderBy(F.desc("n"), "value").limit(target).select("value", (F.col("n") / F.lit(total)).alias("freq"))


def histogram(rows: DataFrame, column: str, target: int = 100) -> DataFrame:
    """nth and value: bounds that cut the values outside most_common into parts of equal numbers of rows."""
    counts = value_counts(rows, column).join(most_common(rows, column, target).select("value"), "value", "left_anti")
    # Running totals without one task for all: first by range, then within it.
    placed = counts.repartitionByRange(max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "value").withColumn("part", F.spark_partition_id())
    before = placed.groupBy("part").agg(F.sum("n").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    ends = placed.withColumn("upto", within).join(F.broadcast(before.select("part", "base")), "part").select("value", "n", (F.col("upto") + F.col("base")).alias("upto"))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    bounds = min(target + 1, size[1])
    if bounds < 2:
        return counts.select(F.lit(0).alias("nth"), "value").limit(0)
    wanted = rows.sparkSession.createDataFrame([(k, 1 + k * (size[0] - 1) // (bounds - 1)) for k in range(bounds)], "nth int, row long")
    return ends.join(F.broadcast(wanted), (F.col("row") <= F.col("upto")) & (F.col("row") > F.col("upto") - F.col("n"))).select("nth", "value")
