"""Functions whose built-in form differs from the SQL that queries are written in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_NAMES = {"microseconds": "microsecond", "milliseconds": "millisecond"}
_YEARS = {"decade": (10, 0), "century": (100, 1), "millennium": (1000, 1)}


def date_trunc(unit: str, ts: Column) -> Column:
    """date_trunc for every unit from microseconds to millennium; the result has no time zone.

    Centuries and millennia begin with the year 1.
    """
    unit = unit.lower()
    if unit in _YEARS:
        size, first = _YEARS[unit]
        year = F.year(ts)
        start = F.floor((year - first) / size) * size + first
        return F.make_timestamp_ntz(start.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.date_trunc(_NAMES.get(unit, unit), ts).cast("timestamp_ntz")


def sum_exact(c: Column) -> Column:
    """Sum of long integers that can't overflow."""
    return F.sum(c.cast("decimal(38,0)"))


def int_div(a: str, b: str) -> Column:
    """Division of integer columns that drops the fraction."""
    return F.expr(f"{a} div {b}")


def percentile_disc_any(rows: DataFrame, by: list[str], value: str, fraction: float, name: str) -> DataFrame:
    """The first value, in order, at or above a fraction of its group; for any type that orders.

    Rows are counted by value first, so a window sees a row for each different
    value of a group, not each row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumn("__upto", F.sum("__c").over(w.orderBy(value))).withColumn("__n", F.sum("__c").over(w))
    at = F.greatest(F.ceil(F.lit(fraction) * F.col("__n")), F.lit(1))
    return ranked.where((F.col("__upto") >= at) & (F.col("__upto") - F.col("__c") < at)).select(*by, F.col(value).alias(name))


class TooManyGroups(Exception):
    pass


def group_cap(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """``rows``, unless ``by`` makes more than ``most`` groups, which is an error; 0 sets no limit."""
    if most and rows.select(*by).distinct().limit(most + 1).count() > most:
        raise TooManyGroups(f"more than {most} groups of {by}")
    return rows
