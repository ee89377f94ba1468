"""Exact dedup by a heavy-hitter split.

Texts are compared by the SHA-256 of their normalised form (A-Z lower-cased).
A Misra-Gries summary of each partition finds the digests that may be frequent;
their exact counts are then taken with map-side aggregation, and the verified
winners - at most ``counters`` rows - are broadcast, so that no row of a large
group is ever shuffled.  All other digests take an ordinary shuffle.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, materialize

COUNTERS = 4096
#: A digest is hot from this share of all rows on, or from this many rows, which one task still joins with ease.
HOT_SHARE = 1e-3
HOT_ROWS = 100_000


def summarise(batches, counters: int):
    """Misra-Gries over one partition: (digest, lower bound of its count), ``counters`` rows at most.

    Whole batches are merged at once: counts are added, then the
    (counters + 1)-th largest is taken off all of them, which keeps the
    guarantee of the one-by-one form: a digest with more than 1/(counters+1) of
    the rows is never lost.
    """
    kept: Counter = Counter()
    for batch in batches:
        kept.update(batch.column("digest").to_pylist())
        if len(kept) > counters:
            least = sorted(kept.values(), reverse=True)[counters]
            kept = Counter({k: n - least for k, n in kept.items() if n > least})
    if kept:
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(kept), pa.string()), "atleast": pa.array(list(kept.values()), pa.int64())})


def with_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, hot_share: float = HOT_SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.  Null text counts as
    empty.  A null id never wins over another id; a group with null ids only
    has a null keep_id and keeps nothing.  Repeated ids are rows of their own:
    each counts in group_size, and all rows of the winning id are kept.  Texts
    are read whole, however long.  An empty table gives an empty result; other
    columns are ignored.
    """
    rows = materialize(with_digest(docs, id_col, text_col), "digests")
    total = rows.count()
    candidates = (
        rows.select("digest")
        .mapInArrow(lambda batches: summarise(batches, counters), "digest string, atleast long")
        .groupBy("digest")
        .agg(F.sum("atleast").alias("atleast"))
        .orderBy(F.desc("atleast"), "digest")
        .limit(counters)
    )
    per_digest = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    # Candidates and winners are `counters` rows at most, whatever the input: safe to broadcast.
    winners = materialize(
        rows.join(F.broadcast(candidates.select("digest")), "digest", "left_semi")
        .groupBy("digest")
        .agg(*per_digest)
        .where(F.col("group_size") >= F.lit(max(2.0, min(hot_share * total, HOT_ROWS)))),
        "winners",
    )
    hot = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    cold = rest.join(rest.groupBy("digest").agg(*per_digest), "digest")
    return hot.unionByName(cold).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""
