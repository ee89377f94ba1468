"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by (hash of the text, doc_id), so equal texts lie together.
Splitters between shards are found by rounds of counting: each round takes the
exact bytes below equally spaced candidate boundaries inside every interval
that still holds a splitter, and narrows the interval.  A splitter is settled
once a boundary is within ``tolerance`` of its target or the interval can't be
split further (a group larger than a shard holds up to 15 splitters, each found
in one more set of rounds); boundaries fall inside a group of equal texts only where the
group itself is too large for that.  The rows are then exchanged once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize

SHARDS = 16
TOLERANCE = 1e-3
BITS = 7
CELL_ROWS = 200_000
WIDTH = 62


def _histogram(rows: DataFrame, key: str, spans: list[tuple[int, int]]) -> dict[tuple[int, int], dict[int, Row]]:
    """For each span [low, high) of the key and each of its 2**BITS equal parts that has rows: bytes, rows, least and greatest key.

    One pass; spans * 2**BITS rows at most come back.
    """
    spans = sorted(set(spans))
    cell = "-1L"
    for n, (low, high) in enumerate(spans):
        cell = f"if({key} >= {low}L and {key} < {high}L, {n << BITS}L + ({key} - {low}L) div {_step(low, high)}L, {cell})"
    got = (
        rows.select(F.expr(cell).alias("cell"), "size", F.col(key).alias("key"))
        .where("cell >= 0")
        .groupBy("cell")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
        .collect()
    )
    out: dict[tuple[int, int], dict[int, Row]] = {s: {} for s in spans}
    for r in got:
        out[spans[r.cell >> BITS]][r.cell & ((1 << BITS) - 1)] = r
    return out


def _step(low: int, high: int) -> int:
    return max(1, -(-(high - low) >> BITS))


def splitters(rows: DataFrame, targets: list[float], slack: float, key: str, below: int = 0) -> list[tuple[int, bool, int]]:
    """For each target number of bytes: (boundary, settled, bytes below the boundary).

    A row is left of a boundary if its key is less.  ``settled`` is false where
    several rows share the key that holds the target and neither of its sides
    is within ``slack``; the boundary is then that key.
    """
    span = {t: (0, 1 << WIDTH, below) for t in targets}
    done: dict[float, tuple[int, bool, int]] = {}
    while active := {t: s for t, s in span.items() if t not in done}:
        counts = _histogram(rows, key, [(a, b) for a, b, _ in active.values()])
        for t, (low, high, under) in active.items():
            cells = counts[low, high]
            best, at, inside = (abs(under - t), low, under), under, None
            for c in sorted(cells):
                if at <= t < at + cells[c].bytes:
                    inside, before = cells[c], at
                best = min(best, (abs(at - t), cells[c].least, at))
                at += cells[c].bytes
                best = min(best, (abs(at - t), cells[c].most + 1, at))
            if best[0] <= slack or inside is None:
                done[t] = (best[1], True, best[2])
            elif inside.least == inside.most:
                done[t] = (best[1], True, best[2]) if inside.n == 1 else (inside.least, False, before)
            else:
                span[t] = (inside.least, inside.most + 1, before)
    return [done[t] for t in targets]


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 bytes of the text plus 1 (null: 1; its CRC is that of
    the empty text).  Shards differ by the tolerance or by about one document.
    Slots run from 0 without gaps in each shard.  A null doc_id orders as -1;
    repeated rows each get a slot; texts count whole, however long; an empty
    table gives an empty result.  With ``carry`` a last column ``row`` holds
    each input row.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    top = F.lit((1 << WIDTH) - 1)
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64(raw).bitwiseAND(top).alias("hash"),
            # Ties within a group are broken by a hash of the id, spread over the same width.
            F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(-1))).bitwiseAND(top).alias("tie"),
            *([F.struct("*").alias("row")] if carry else []),
        ),
        "sizes",
    )
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    targets = [total * k / shards for k in range(1, shards)]
    slack = tolerance * total / shards
    cuts = splitters(rows, targets, slack, "hash") if count else []
    inner: dict[float, int] = {}
    for key, under in sorted({(key, under) for key, settled, under in cuts if not settled}):
        own = [t for t, (k, settled, _) in zip(targets, cuts, strict=True) if k == key and not settled]
        found = splitters(rows.where(F.col("hash") == F.lit(key)), own, slack, "tie", under)
        inner |= {t: k for t, (k, _, _) in zip(own, found, strict=True)}
    # The shard is the number of splitters at or below the row's key.
    shard = F.lit(0)
    for t, (key, settled, _) in zip(targets, cuts, strict=False):
        right = F.col("hash") >= F.lit(key)
        if not settled:
            right = (F.col("hash") > F.lit(key)) | ((F.col("hash") == F.lit(key)) & (F.col("tie") >= F.lit(inner[t])))
        shard = shard + right.cast("int")
    cells = max(1, min(1 << 16, -(-count // (shards * CELL_ROWS))), min(64, count // (shards * 500)))
    placed = rows.select("*", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("tie", "size"), F.lit(cells)).cast("int").alias("cell"))
    # Each shard is cut into cells of a bounded number of rows; slots are counted
    # within cells and moved by the rows of the cells before.
    offsets = (
        placed.groupBy("shard", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("n")
    )
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("tie", "hash")) - 1)
    return numbered.join(offsets, ["shard", "cell"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("nth") + F.col("before")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(["row"] if carry else []),
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the rows of ``docs`` under ``path``, one folder ``shard=N`` per shard, in slot order within files, with a column slot.

    Every row is written once, those with null or repeated ids too: rows move
    with their places, they aren't joined to them.  Columns of ``docs`` named
    shard or slot, in any case, are replaced; an empty table writes no shard.
    """
    taken = [c for c in docs.columns if c.lower() in ("shard", "slot")]
    placed = shard_by_bytes(docs, **options, carry=True)
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in taken]
    placed.select(*columns, "slot", "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return shard_by_bytes(table(spark, sf_dir, "documents"))
