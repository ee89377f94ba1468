"""Line dedup by site-relative frequency.

A line (without surrounding spaces) is boilerplate on a host when the pages of
that host that hold it, divided by all pages of the host, exceed a ratio.  Such
lines are dropped from the host's pages wherever they stand; blank lines stay.

A share is measured on few pages, so the same boilerplate can fall on either
side of the ratio by chance of host.  ``pooled`` also drops a line that exceeds
the ratio over all hosts it stands on together, on each host where its share
isn't significantly below the ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

RATIO = 0.1
LEAST_PAGES = 3
#: For pooled shares: the bound's width in standard errors, and the pages a host needs to count.  On a smaller host a page or two make a large share.
Z = 1.96
LEAST_HOST = 30
BROADCAST_ROWS = 50_000
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def boilerplate(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """host, line_key, pages, host_pages of each line above the ratio.

    A page counts a line once.  A null host is a host of its own.
    """
    pages = docs.select(F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    keys = F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key)
    counts = pages.select("host", F.explode(F.array_distinct(keys)).alias("line_key")).groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least_pages)
    totals = totals.withColumnRenamed("host", "of")
    return counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("pages") > F.lit(float(ratio)) * F.col("host_pages")).select("host", "line_key", "pages", "host_pages")


def pooled_boilerplate(docs: DataFrame, found: DataFrame, ratio: float = RATIO, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """host, line_key, pages, host_pages of each line that exceeds the ratio over its hosts together and isn't significantly below it on this one.

    ``found`` is what ``boilerplate`` gives: a line can only exceed the ratio
    over all hosts if it does so on one.
    """
    known = found.where(F.col("host_pages") >= LEAST_HOST).select("line_key").distinct()
    known = materialize(known, "known-lines")
    pages = docs.select(F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    totals = pages.groupBy(F.col("host").alias("of")).agg(F.count(F.lit(1)).alias("host_pages")).where(F.col("host_pages") >= LEAST_HOST)
    keys = F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key)
    lines = pages.select("host", F.explode(F.array_distinct(keys)).alias("line_key"))
    lines = lines.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, "line_key", "left_semi")
    counts = lines.groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("pages"))
    counts = materialize(counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).drop("of"), "known-counts")
    over = counts.groupBy("line_key").agg(F.sum("pages").alias("all"), F.sum("host_pages").alias("of")).where(F.col("all") > F.lit(float(ratio)) * F.col("of")).select("line_key")
    n, share = F.col("host_pages"), F.col("pages") / F.col("host_pages")
    # Wilson's upper bound of the share.
    bound = (share + Z * Z / (2 * n) + Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    return counts.join(over, "line_key", "left_semi").where(bound > ratio).select("host", "line_key", "pages", "host_pages")


def dedup_lines(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, host_col: str = "source", text_col: str = "text", pooled: bool = False) -> DataFrame:
    """``docs`` with its text cleaned, and n_lines and n_dropped added (a name already in use gets a _ behind it).

    Null text stays null, with no lines.  A text of dropped lines only becomes
    empty.  Repeated rows count as pages of their own.  Hosts of fewer than
    ``least_pages`` pages lose nothing.  An empty table gives an empty result.
    """
    found = materialize(boilerplate(docs, ratio, least_pages, host_col, text_col), "boilerplate")
    if pooled:
        more = pooled_boilerplate(docs, found, ratio, host_col, text_col)
        found = materialize(found.unionByName(more).dropDuplicates(["host", "line_key"]), "boilerplate")
    # A host has at most (lines a page / ratio) such lines, so a host's list is
    # short; how many hosts there are isn't bounded, so the size is measured.
    per_host = found.groupBy("host").agg(F.collect_set("line_key").alias("__bad"))
    rows = docs.select(F.struct("*").alias("__row"), F.col(host_col).cast("string").alias("__host"), F.col(text_col).alias("__text"))
    if found.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(per_host), F.col("__host").eqNullSafe(F.col("host")), "left")
    else:
        salted = per_host.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__text"), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, (F.coalesce(F.col("__host"), F.lit("")) == F.coalesce(F.col("host"), F.lit(""))) & F.col("__host").eqNullSafe(F.col("host")) & (rows["__salt"] == salted["__salt"]), "left")
    lines = _lines(F.col("__text"))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__bad"), _key(x)))
    cleaned = joined.select("__row", F.when(F.col("__text").isNull(), F.lit(0)).otherwise(F.size(lines)).alias("__n"), F.col("__text"), F.when(F.col("__bad").isNotNull() & F.col("__text").isNotNull(), kept).alias("__kept"))
    text = F.when(F.col("__kept").isNotNull(), F.array_join(F.col("__kept"), "\n")).otherwise(F.col("__text"))
    dropped = F.when(F.col("__kept").isNotNull(), F.col("__n") - F.size("__kept")).otherwise(F.lit(0))
    free = lambda name: name if name not in docs.columns else free(f"{name}_")
    columns = [text.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    return cleaned.select(*columns, F.col("__n").alias(free("n_lines")), dropped.alias(free("n_dropped")))


def op5(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup_lines(docs).select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256")
    )


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, string_split(text, chr(10)) AS lines FROM documents
), hosts AS (
  SELECT source AS host, count(*) AS host_pages FROM d GROUP BY source
), once AS (
  SELECT source AS host, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ')))) AS line FROM d
), bad AS (
  SELECT o.host, o.line, count(*) AS pages FROM once o JOIN hosts h ON o.host IS NOT DISTINCT FROM h.host
  WHERE o.line <> '' GROUP BY o.host, o.line, h.host_pages
  HAVING count(*) >= {LEAST_PAGES} AND count(*) > {RATIO} * h.host_pages
), per_host AS (
  SELECT host, list(line) AS bad FROM bad GROUP BY host
), cut AS (
  SELECT doc_id, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), trim(x, ' '))) AS kept
  FROM d LEFT JOIN per_host ON d.source IS NOT DISTINCT FROM host
)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
  sha256(coalesce(array_to_string(kept, chr(10)), '')) AS text_sha256
FROM cut
"""
