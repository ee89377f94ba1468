"""Near-duplicate documents by HyperMinHash.

A document's set of distinct 5-word shingles is hashed into buckets; of each
bucket's least hash a 16-bit register keeps the number of leading zeros and the
mantissa bits behind them.  Registers of empty buckets are borrowed from others
(dense enough for banding).  Bands of four registers - 64 bits, compared as
they are - give candidates; registers then estimate the Jaccard similarity,
corrected for chance collisions; what may reach the threshold is verified on
full sets.

Equal sets are one node from the start.  In each band's bucket every node is
first checked against one centre, the node that shares most buckets; that is
linear, and settles groups whose members resemble their origin.  Buckets that
still hold several components are then searched for links between these.  Those
of a bounded number of nodes are compared node by node.  The nodes of larger
ones are joined on rare shingles: two sets that reach the threshold share one
among so few of the rarest of each that a set which missed its centre has none
of the centre's among them.  No row is repeated for each part of its bucket,
and no link between different sets is lost beyond the bands' own chance of a
miss (5e-6 at the threshold).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import discard, join_ids, joined_utf8, materialize, released, slices, whole_groups

WORDS = 5
PERCENT = 75
REGISTERS = 128
BAND = 4
BANDS = REGISTERS // BAND
MANTISSA = 10
#: Estimates this far below the threshold are still verified: 4.5 standard deviations of the estimate.
MARGIN = 4.5 * (0.75 * 0.25 / REGISTERS) ** 0.5
#: Nodes, and bytes of their shingle sets, up to which a bucket is compared node by node.
CHUNK = 200
CHUNK_BYTES = 1 << 22
#: Ratio of one class of set sizes to the next.
SIZE_STEP = 1.1
#: Shingles, the most frequent ones, that are ordered by frequency; 16 bytes each are sent to every task.
RANKED = 250_000
#: Work that a task gets: pairs of nodes, rows, bytes of sets.
PAIRS_TASK, ROWS_TASK, BYTES_TASK = 1 << 21, 1 << 15, 1 << 24

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TURN = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _TURN[0]
    x = (x ^ (x >> np.uint64(27))) * _TURN[1]
    return x ^ (x >> np.uint64(31))


def shingles(buf: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text of ``joined_utf8``."""
    n = len(starts) - 1
    buf = _LOWER[buf]
    edges = np.diff(np.concatenate([[1], _IS_SPACE[buf].astype(np.int8), [1]]))
    first, last = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(first):
        return [np.zeros(0, np.uint64)] * n
    # A word is the sum of its scrambled (byte, place in word) pairs, scrambled again.
    begin = np.zeros(len(buf), np.int64)
    begin[first] = first
    place = np.arange(len(buf)) - np.maximum.accumulate(begin)
    value = mix((place.astype(np.uint64) << np.uint64(8)) + buf + _ODD)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    word = mix(sums[last] - sums[first])
    owner = np.searchsorted(starts, first, side="right") - 1
    bounds = np.searchsorted(owner, np.arange(n + 1))
    span = max(0, len(word) - WORDS + 1)
    rolled = np.zeros(span, np.uint64)
    for k in range(WORDS):
        rolled = rolled * _ODD + word[k : k + span]
    rolled = mix(rolled)
    out = []
    for text in range(n):
        a, b = bounds[text], bounds[text + 1]
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                whole = whole * _ODD + word[k]
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_PROBES: list[np.ndarray] = []


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """REGISTERS 16-bit registers by set; sets must not be empty."""
    if not _PROBES:
        _PROBES.append(np.random.default_rng(11).integers(0, REGISTERS, (4096, REGISTERS)))
    shift = np.uint64(64 - int(REGISTERS).bit_length() + 1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    bucket = (hashes >> shift).astype(np.int64)
    at = owner * REGISTERS + bucket
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]  # sets are sorted: the first of a bucket is its least
    rest = (hashes[new] & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.float64)
    part, power = np.frexp(np.maximum(rest, 1.0))
    zeros = int(shift) - power
    code = ((zeros + 1) << MANTISSA) | np.minimum(((part - 0.5) * (2 << MANTISSA)).astype(np.int64), (1 << MANTISSA) - 1)
    out = np.zeros(len(sets) * REGISTERS, np.uint16)
    out[at[new]] = code.astype(np.uint16)
    out = out.reshape(len(sets), REGISTERS)
    filled, source = out > 0, out.copy()
    for step in _PROBES[0]:
        rows = np.flatnonzero(~filled.all(axis=1))
        if not len(rows):
            break
        borrowed = source[rows][:, step]
        take = ~filled[rows] & (borrowed > 0)
        grid = out[rows]
        grid[take] = borrowed[take]
        out[rows] = grid
        filled[rows] |= take
    return out


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of unrelated sets of n and m elements agree.

    The least of a bucket is nearly exponential with rate n over buckets; two
    agree if they fall into one of the cells a register tells apart.
    """
    a, b = np.maximum(n / REGISTERS, 1.0), np.maximum(m / REGISTERS, 1.0)
    total = np.zeros(len(a))
    for zeros in range(40):
        low, high = 2.0 ** -(zeros + 1), 2.0**-zeros
        total += a * b / (a + b) * (np.exp(-(a + b) * low) - np.exp(-(a + b) * high)) * (low / (1 << MANTISSA))
    return np.minimum(total, 0.5)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    same = (x == y).mean(axis=1)
    c = chance(n.astype(float), m.astype(float))
    return (same - c) / (1 - c)


def may_link(x, y, n, m) -> np.ndarray:
    small, large = np.minimum(n, m), np.maximum(n, m)
    return (100 * small >= PERCENT * large) & (estimate(x, y, n, m) >= PERCENT / 100 - MARGIN)


def sketch_batches(batches):
    for batch in batches:
        for at, n in slices(batch):
            sets = shingles(*joined_utf8(batch.column("text").slice(at, n)))
            full = [k for k, s in enumerate(sets) if len(s)]
            keys = np.zeros((n, BANDS), np.int64)
            if full:
                keys[full] = registers([sets[k] for k in full]).view(np.int64)
            sums = np.array([[mix(s).sum(dtype=np.uint64), mix(s ^ _ODD).sum(dtype=np.uint64)] for s in sets], np.uint64).reshape(n, 2).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, n), batch.column("uid").slice(at, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), lists],
                ["doc_id", "uid", "n", "s1", "s2", "keys"],
            )


def set_batches(batches):
    for batch in batches:
        for at, n in slices(batch):
            sets = shingles(*joined_utf8(batch.column("text").slice(at, n)))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("uid").slice(at, n), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["node", "hashes"])


def _registers_of(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), BANDS).view(np.uint16)


def likely_batches(batches):
    """Of pairs (a, b, n, m, x, y) those whose estimate may reach the threshold."""
    for batch in batches:
        if batch.num_rows:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            good = may_link(_registers_of(batch.column("x")), _registers_of(batch.column("y")), n, m)
            yield batch.filter(pa.array(good)).select(["a", "b"])


#: Pairs whose registers are compared at a time.
PAIRS = 4096
GROUP = ["band", "key"]


def candidates(batch: pa.RecordBatch):
    """Yield (i, j, estimate) of row pairs of ``batch``, which holds whole groups, that may reach the threshold.

    A pair stands in one group, in different components; it belongs to the
    first band that it shares.  Rows are paired with those 1, 2, 3 ... places
    further on, for all groups at once, so nothing is looped over by group or
    row.
    """
    columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in [*GROUP, "component", "n"]}
    keys = batch.column("keys").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, BANDS)
    regs = keys.view(np.uint16)
    new = np.zeros(batch.num_rows, bool)
    for c in GROUP:
        new[1:] |= columns[c][1:] != columns[c][:-1]
    group, n = np.cumsum(new), columns["n"].astype(np.int64)
    for apart in range(1, batch.num_rows):
        first = np.flatnonzero(group[apart:] == group[:-apart])
        if not len(first):
            break
        second = first + apart
        good = columns["component"][first] != columns["component"][second]
        good &= 100 * np.minimum(n[first], n[second]) >= PERCENT * np.maximum(n[first], n[second])
        first, second = first[good], second[good]
        for at in range(0, len(first), PAIRS):
            i, j = first[at : at + PAIRS], second[at : at + PAIRS]
            # Registers that agree are never fewer than the estimate says.
            good = (regs[i] == regs[j]).mean(axis=1) >= PERCENT / 100 - MARGIN
            i, j = i[good], j[good]
            earlier = (keys[i] == keys[j]) & (np.arange(BANDS) < columns["band"][i][:, None])
            i, j = i[~earlier.any(axis=1)], j[~earlier.any(axis=1)]
            if len(i):
                like = estimate(regs[i], regs[j], n[i], n[j])
                good = like >= PERCENT / 100 - MARGIN
                yield i[good], j[good], like[good]


def hopeful_batches(batches):
    """Rows with a partner whose estimate may reach the threshold."""
    for batch in whole_groups(batches, GROUP):
        mark = np.zeros(batch.num_rows, bool)
        for i, j, _ in candidates(batch):
            mark[i] = mark[j] = True
        yield batch.filter(pa.array(mark))


def linked_batches(batches):
    """Links between components, verified on full sets, the likeliest first; one between any two components is enough."""
    for batch in whole_groups(batches, GROUP):
        found = list(candidates(batch))
        first, second, like = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        node, comp = (batch.column(c).to_numpy() for c in ("node", "component"))
        hashes = batch.column("hashes")
        offsets, flat = hashes.offsets.to_numpy(), hashes.values.to_numpy(zero_copy_only=False)
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        out = []
        for k in np.lexsort((second, first, -like)):
            i, j = first[k], second[k]
            a, b = find(comp[i]), find(comp[j])
            if a == b:
                continue
            x, y = flat[offsets[i] : offsets[i + 1]], flat[offsets[j] : offsets[j + 1]]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * shared >= PERCENT * (len(x) + len(y) - shared):
                root[a] = b
                out.append((node[i], node[j]))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def least_shared(n, m):
    """Elements that sets of n and m elements share at least, if they reach the threshold."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def size_classes(most: int) -> np.ndarray:
    """The least size of each class, up to sizes of ``most``."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * SIZE_STEP)))
    return np.array(out, np.int64)


def prefix_batches(batches, ranked: np.ndarray, rank: np.ndarray, complete: bool):
    """Elements by which a node is found, for each class of sizes a partner may have.

    In a set's order the ``ranked`` elements (ascending) come last, by their
    ``rank``.  If the list is ``complete`` the others are in no other component
    and give no row.  Of two sets in the same order that have ``least_shared``
    elements in common, each has the first of these among its first
    n - least_shared + 1.
    """
    for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
        sizes = batch.column("n").to_numpy()
        lows = size_classes(int(sizes.max()) * 100 // PERCENT + 1)
        lists = batch.column("hashes")
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        rows, elements, places, others = [], [], [], []
        for row, n in enumerate(sizes.tolist()):
            one = np.sort(flat[offsets[row] : offsets[row + 1]])
            at = np.minimum(np.searchsorted(ranked, one), len(ranked) - 1)
            listed = ranked[at] == one
            free = one[~listed]
            ordered = np.concatenate([free, one[listed][np.argsort(rank[at[listed]])]])
            skipped, least = len(free) if complete else 0, -(-PERCENT * n // 100)
            first, last = np.searchsorted(lows, [least, n * 100 // PERCENT], side="right") - 1
            kinds = np.arange(first, last + 1)
            take = np.maximum(n - least_shared(n, np.maximum(lows[kinds], least)) + 1 - skipped, 0)
            at = skipped + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            rows.append(np.full(len(at), row))
            elements.append(ordered[at])
            places.append(at + 1)
            others.append(np.repeat(kinds, take))
        rows, elements, places, others = map(np.concatenate, (rows, elements, places, others))
        own = (np.searchsorted(lows, sizes, side="right") - 1)[rows]
        node, component = (batch.column(c).to_numpy()[rows] for c in ("node", "component"))
        for at in range(0, len(rows), 1 << 16):
            part = slice(at, at + (1 << 16))
            columns = [elements[part], np.minimum(own, others)[part], np.maximum(own, others)[part], own[part], node[part], component[part], sizes[rows[part]], places[part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["e", "lo", "hi", "own", "node", "component", "n", "place"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text).

    Null and empty texts, and texts of white space, have no shingles and are
    linked with nothing.  Texts of fewer than five words are one shingle; long
    texts are read whole.  A row with a null id is its own component, with a
    null id, and is kept.  Rows that repeat an id are judged each by its own
    text; every row with a component's smallest id is kept.  An empty table
    gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    repeated = bool(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count())
    # What a text is known by: its id, or with repeated ids a hash of id and text.
    docs = docs.withColumn("uid", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text") if repeated else F.col("doc_id")))
    sketches = materialize(docs.mapInArrow(lambda b: released(sketch_batches(b)), "doc_id long, uid long, n long, s1 long, s2 long, keys array<long>"), "sketches")
    # One node for each different set: the smallest uid that has it.  Equal sets have equal keys.
    full = sketches.where("n > 0 and doc_id is not null")
    reps = materialize(full.groupBy("n", "s1", "s2").agg(F.min("uid").alias("node"), F.first("keys").alias("keys")), "nodes")
    rows = reps.select("node", "n", F.posexplode("keys").alias("band", "key"))
    # Crowded buckets are a table of their own, so that the join can split a hot one.
    crowded = materialize(rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "crowded")
    members = materialize(rows.join(crowded, ["band", "key"]), "members")
    # The centre of a bucket is the node that shares most: an origin has most in common with its copies.
    rank = materialize(members.groupBy("node").agg(F.sum("c").alias("s")), "rank")
    top = F.max(F.struct("s", (-F.col("node")).alias("minus"))).alias("top")
    centres = materialize(members.join(rank, "node").groupBy("band", "key").agg(top).select("band", "key", (-F.col("top.minus")).alias("centre")), "centres")
    pairs = members.select("band", "key", "node").join(centres, ["band", "key"]).where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    likely = materialize(_likely(reps, pairs), "likely")
    discard(crowded, rank, centres)
    star = _verified(docs, likely, repeated)
    discard(likely)
    comps = materialize(connected_components(star), "components")

    more = _compared(docs, reps, members, comps, repeated)
    discard(members, comps)
    final = materialize(connected_components(reduce(DataFrame.union, [star, *more])), "final")
    discard(star, *more)
    if repeated:  # components go by the least uid; they are named by the least id
        least = reps.join(full.select("n", "s1", "s2", "doc_id"), ["n", "s1", "s2"]).join(final, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("doc_id").alias("least"))
        by_set = reps.join(final, "node", "left").withColumn("component", F.coalesce("component", "node")).join(least, "component").select("n", "s1", "s2", F.col("least").alias("component_id"))
    else:
        by_set = reps.join(final, "node", "left").select("n", "s1", "s2", F.coalesce("component", "node").alias("component_id"))
    # Both sides are read from tables, so that the join can split a set that many documents have.
    named = full.select("doc_id", "n", "s1", "s2").join(materialize(by_set, "by-set"), ["n", "s1", "s2"]).select("doc_id", "n", "component_id")
    alone = sketches.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return named.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _compared(docs: DataFrame, reps: DataFrame, members: DataFrame, comps: DataFrame, repeated: bool) -> list[DataFrame]:
    """Further links (a, b) within buckets that still hold several components."""
    placed = materialize(members.drop("c").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    split = placed.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("total"))
    large = (F.col("c") > CHUNK) | (F.col("total") > CHUNK_BYTES // 8)
    split = materialize(split.where("low <> high").select("band", "key", "c", large.alias("large")), "split")
    nodes = materialize(placed.join(split.where("large").select("band", "key"), ["band", "key"]).select("node", "n", "component").distinct(), "large")
    found = [_by_node(docs, reps, placed, split.where("not large").drop("large"), repeated), _by_shingle(docs, reps, nodes, repeated)]
    discard(placed, split, nodes)
    return [links for links in found if links is not None]


def _by_node(docs: DataFrame, reps: DataFrame, placed: DataFrame, split: DataFrame, repeated: bool) -> DataFrame | None:
    """Links (a, b) within the buckets of ``split``, compared node by node; the number of tasks follows the number of pairs."""
    work = split.agg(F.sum(F.col("c") * F.col("c")).alias("pairs"), F.sum("c").alias("rows")).first()
    if not work["rows"]:
        return None
    spread = lambda most: max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(most))
    tasks = spread(max(work["pairs"] / PAIRS_TASK, work["rows"] / ROWS_TASK))
    dealt = placed.drop("n").join(split.drop("c"), ["band", "key"])
    dealt = dealt.select("band", "key", "node", "component").join(reps.select("node", "n", "keys"), "node")
    fields = "node long, band int, key long, component long, n long, keys array<long>"
    hoped = materialize(dealt.repartition(tasks, *GROUP).sortWithinPartitions(*GROUP).mapInArrow(lambda b: released(hopeful_batches(b)), fields), "hopeful")
    size = hoped.agg(F.sum(8 * F.col("n"))).first()[0]
    if not size:
        return None
    sets = _sets(docs, hoped.select("node").distinct(), repeated)
    dealt = hoped.join(sets, "node").repartition(spread(size / BYTES_TASK), *GROUP).sortWithinPartitions(*GROUP)
    more = materialize(dealt.mapInArrow(lambda b: released(linked_batches(b)), "a long, b long"), "more-links")
    discard(hoped, sets)
    return more


def _by_shingle(docs: DataFrame, reps: DataFrame, nodes: DataFrame, repeated: bool) -> DataFrame | None:
    """All links (a, b) between different components of ``nodes`` (node, n, component), found by rare shingles.

    Shingles of a single component can't be shared with another, so they come
    first in a set's order; a set with enough of them has no partner and gives
    no row.  Where more than RANKED shingles are shared only the most frequent
    are ranked, and all others come first and give rows: any order finds all
    links.  Of the rows of one shingle, those of the component that has most are
    not paired among themselves.
    """
    if nodes.isEmpty():
        return None
    sets = _sets(docs, nodes.select("node"), repeated)
    open_sets = sets.join(nodes, "node")
    counts = open_sets.select("component", F.explode("hashes").alias("e")).groupBy("e").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("c"))
    top = counts.where("low <> high").select("e", "c").orderBy(F.desc("c"), F.desc("e")).limit(RANKED).toArrow()
    if not top.num_rows:
        return None
    ranked = top.column("e").to_numpy()
    order, complete = np.argsort(ranked), len(ranked) < RANKED
    ranked, rank = ranked[order], -order  # the most frequent come last
    fields = "e long, lo long, hi long, own long, node long, component long, n long, place long"
    entries = materialize(open_sets.mapInArrow(lambda b: released(prefix_batches(b, ranked, rank, complete)), fields), "entries")
    discard(sets)
    key = ["e", "lo", "hi"]
    most = entries.groupBy(*key, "component").count().groupBy(*key).agg(F.max(F.struct("count", "component")).alias("top"), F.count(F.lit(1)).alias("several"))
    met = materialize(entries.join(most.where("several > 1").select(*key, F.col("top.component").alias("main")), key), "met")
    side = lambda s: met.select(*key, *(F.col(c).alias(c + s) for c in ("own", "node", "component", "n", "place", "main")))
    need = F.ceil(PERCENT * (F.col("n1") + F.col("n2")) / (100 + PERCENT))
    near = (F.col("n1") - F.col("place1") + 1 >= need) & (F.col("n2") - F.col("place2") + 1 >= need)
    once = "component1 <> component2 and (lo = hi or own1 <> own2) and (component2 = main2 or node1 < node2)"
    pairs = side("1").where("component1 <> main1").join(side("2"), key).where(once).where(near)
    pairs = materialize(pairs.select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct(), "pairs")
    likely = materialize(_likely(reps, pairs), "likely")
    discard(entries, met, pairs)
    links = _verified(docs, likely, repeated)
    discard(likely)
    return links


def _sets(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """node, hashes: full shingle sets of the wanted uids; texts of others are dropped before anything is computed."""
    found = join_ids(docs, wanted.select(F.col("node").alias("uid")), "left_semi")
    sets = found.select("uid", "text").mapInArrow(lambda b: released(set_batches(b)), "node long, hashes array<long>")
    # Rows that repeat an id with the same text have the same set; one is enough.  Without such rows nothing is shuffled.
    return materialize(sets.dropDuplicates(["node"]) if repeated else sets, "sets")


def _likely(reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose registers may reach the threshold."""
    side = lambda node, n, keys: reps.select(F.col("node").alias(node), F.col("n").alias(n), F.col("keys").alias(keys))
    return pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").mapInArrow(lambda b: released(likely_batches(b)), "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, repeated: bool) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), repeated)
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    links = joined.withColumn("both", both).where(100 * F.col("both") >= PERCENT * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")
    links = materialize(links, "links")
    discard(sets)
    return links


def op6(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return near_duplicates(table(spark, sf_dir, "documents"))
