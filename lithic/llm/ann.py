"""Approximate nearest neighbours: inverted lists with an adaptive dimension scan.

Vectors are turned by a random rotation, so that any leading dimensions are a
fair sample of a distance.  Every distinct vector is indexed in the list of its
nearest centroid; neighbouring lists share a cell of a bounded number of
entries, and a list too large for one has several.  A query visits the lists it
probes nearest first, first those of its home cell, then, with the distance of
its ``k``-th best carried on, those of all other cells.  Candidates' distances
are summed over blocks of columns, and after each block a hypothesis test drops
those whose distance so far would be too unlikely for a better neighbour.  What
survives gets its exact distance, in double precision, from the original
vectors.  How many lists are probed is set by the recall measured on the sample
that the centroids are fitted on.

Equal vectors are one entry of the index that knows its ids, cut to the
``k + 1`` smallest: no query can need more of them, since ties go to smaller
ids and only the query's own id is left out.  A cell's queries are cut into
chunks, so no task holds more than a cell and a chunk.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, released

K = 10
QUERY_EVERY = 100
#: Bound of the sample that centroids are fitted on.
SAMPLE = 20_000
MOST_LISTS = 2048
#: Share of the sample's true neighbours that the probed lists must hold, measured on this many of its rows.
RECALL = 0.97
JUDGES = 256
LEAST_PROBES = 8
#: Entries of a cell, and queries of a chunk.  On few entries cells are smaller, so that there are as many as this.
BLOCK = 8192
CELLS = 32
CHUNK = 2048
COLUMNS = 4
#: Chance that a test drops a candidate that lies just at the bound, and the draws that the tests' limits come from.
MISS = 0.01
DRAWS = 20_000


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray  # in rotated space
    probes: int
    first: np.ndarray  # a list's first cell
    cells: np.ndarray  # and how many it has


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres, 1)[:, 0]
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` nearest centres by row, nearest first."""
    out = []
    for at in range(0, len(x), 2048):
        part = x[at : at + 2048]
        d = np.square(centres).sum(axis=1)[None] - 2 * part @ centres.T
        best = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (len(part), 1))
        out.append(np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


@cache
def limits(dims: int) -> np.ndarray:
    """After each block of columns: the share of a squared distance that its columns so far exceed with probability MISS.

    After a random rotation a difference points anywhere with equal chance, so
    the shares of random directions are those of any difference.
    """
    drawn = np.square(np.random.default_rng(5).normal(size=(DRAWS, dims)))
    shares = np.cumsum(drawn, axis=1) / drawn.sum(axis=1, keepdims=True)
    return np.quantile(shares[:, COLUMNS - 1 : dims - 1 : COLUMNS], 1 - MISS, axis=0) if dims > COLUMNS else np.zeros(0)


def scan(query: np.ndarray, block: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, int]:
    """Rows of the rotated ``block`` that may be among the ``k`` nearest of the rotated ``query``, and the components read.

    ``bound`` is the squared distance of the k-th best known so far.  After each
    block of columns the rows whose sum so far is beyond ``limits`` go.
    """
    dims = block.shape[1]
    shares = limits(dims)
    alive, partial, read = np.arange(len(block)), np.zeros(len(block)), 0
    for n, at in enumerate(range(0, dims, COLUMNS)):
        stop = min(dims, at + COLUMNS)
        part = (block[:, at:stop] if len(alive) == len(block) else block[alive, at:stop]) - query[at:stop]
        partial += np.einsum("ij,ij->i", part, part)
        read += part.size
        if stop < dims and np.isfinite(bound):
            keep = partial <= bound * shares[n]
            alive, partial = alive[keep], partial[keep]
    if len(alive) > k:  # ties with the k-th stay; a hair's breadth is left for rounding
        bound = min(bound, float(np.partition(partial, k - 1)[k - 1]))
    return alive[partial <= bound * (1 + 1e-9) + 1e-30], read


def visit(query: np.ndarray, vectors: np.ndarray, ranges: list[tuple[int, int]], bound: float, k: int) -> tuple[np.ndarray, int]:
    """Rows of rotated ``vectors`` that may be among the ``k`` nearest, and the components read.

    ``ranges`` are the lists' rows, nearest list first.  Lists are taken in
    waves of 1, 1, 2, 4 ... of them, each with the bound that the ones before left.
    """
    rows, dists, read, at, wave = np.zeros(0, np.int64), np.zeros(0), 0, 0, 1
    while at < len(ranges):
        some = np.concatenate([np.arange(a, b) for a, b in ranges[at : at + wave]])
        at, wave = at + wave, max(1, at + wave)
        found, cost = scan(query, vectors[some], bound, k)
        rows, read = np.concatenate([rows, some[found]]), read + cost
        dists = np.concatenate([dists, np.square(vectors[some[found]] - query).sum(axis=1)])
        if len(dists) >= k:
            bound = min(bound, float(np.partition(dists, k - 1)[k - 1]))
            keep = dists <= bound * (1 + 1e-9) + 1e-30
            rows, dists = rows[keep], dists[keep]
    return rows, read


def along(centroids: np.ndarray) -> np.ndarray:
    """Numbers of centroids so ordered that neighbours in the order lie near each other: halves of halves along the widest dimension."""
    out, todo = [], [np.arange(len(centroids))]
    while todo:
        some = todo.pop()
        if len(some) <= 2:
            out.extend(some.tolist())
            continue
        dim = int(np.ptp(centroids[some], axis=0).argmax())
        some = some[np.argsort(centroids[some, dim], kind="stable")]
        todo += [some[len(some) // 2 :], some[: len(some) // 2]]
    return np.array(out, np.int64)


def enough_probes(x: np.ndarray, centroids: np.ndarray, k: int) -> int:
    """Least number of nearest lists that hold RECALL of the true neighbours of some rows of ``x`` among all its rows."""
    if len(x) < 2 or len(centroids) <= LEAST_PROBES:
        return len(centroids)
    own = nearest(x, centroids, 1)[:, 0]
    judges = np.random.default_rng(3).permutation(len(x))[:JUDGES]
    near = nearest(x[judges], x, min(len(x), k + 1))
    order = nearest(x[judges], centroids, len(centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None].repeat(len(judges), axis=0), axis=1)
    needed = np.take_along_axis(place, own[near], axis=1)[near != judges[:, None]]
    return min(len(centroids), max(LEAST_PROBES, int(np.quantile(needed, RECALL, method="higher")) + 1))


def list_batches(batches, index: Index):
    """Entries with the number of their list."""
    for batch in batches:
        if batch.num_rows:
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            lists = nearest(flat.reshape(batch.num_rows, -1) @ index.rotation, index.centroids, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.int32())], [*batch.schema.names, "list"])


def probe_batches(batches, index: Index):
    """A row for each query and cell that has lists it probes: these lists, nearest first, and whether the cell is the query's home."""
    for batch in batches:
        if not batch.num_rows:
            continue
        flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        lists = nearest(flat.reshape(batch.num_rows, -1) @ index.rotation, index.centroids, index.probes)
        for at, near in enumerate(lists):
            own, times = np.repeat(near, index.cells[near]), index.cells[near]
            cell = np.concatenate([np.arange(a, a + n) for a, n in zip(index.first[near], times, strict=True)])
            order = np.argsort(cell, kind="stable")
            kinds, begin = np.unique(cell[order], return_index=True)
            ends = pa.array(np.append(begin, len(cell)), pa.int32())
            same = batch.slice(at, 1).take(pa.array(np.zeros(len(kinds), np.int64)))
            visits = pa.ListArray.from_arrays(ends, pa.array(own[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([*same.columns, pa.array(kinds, pa.int32()), visits, pa.array(kinds == cell[0])], [*batch.schema.names, "cell", "visits", "home"])


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def search_cell(queries: pd.DataFrame, entries: pd.DataFrame, index: Index, k: int) -> pd.DataFrame:
    """The ``k`` nearest (with one to spare for the query's own id) of each query in one cell."""
    keys, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(queries) and len(entries):
        entries = entries.sort_values("list", kind="stable")
        plain, lists = _matrix(entries["vec"]), entries["list"].to_numpy()
        turned, ids = plain @ index.rotation, [np.asarray(i) for i in entries["ids"]]
        for key, vec, bound, visits in zip(queries["query_key"], queries["vec"], queries["bound"], queries["visits"], strict=True):
            q, visits = np.asarray(vec, np.float64), np.asarray(visits)
            ranges = list(zip(np.searchsorted(lists, visits), np.searchsorted(lists, visits, side="right"), strict=True))
            rows, _ = visit(q @ index.rotation, turned, [r for r in ranges if r[0] < r[1]], bound if bound == bound else np.inf, k + 1)
            exact = np.repeat(np.sqrt(np.square(plain[rows] - q).sum(axis=1)), [len(ids[r]) for r in rows])
            own = np.concatenate([np.zeros(0, np.int64), *(ids[r] for r in rows)])
            order = np.lexsort((own, exact))[: k + 1]
            keys.append(np.full(len(order), key)), found.append(own[order]), scores.append(exact[order])
    return pd.DataFrame({"query_key": np.concatenate(keys), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part: a vector without null, non-finite or only zero components."""
    # Adding 0.0 makes -0.0 equal to 0.0 also by its bits.
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0.0)
    )


def search(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each query row among all other rows, by Euclidean distance.

    Ties go to smaller ids.  Rows with a null id take no part; rows that
    repeat an id with the same vector count once, with another vector they are
    candidates and queries of their own, so that an id can come back for each.  With fewer candidates than
    ``k`` all are returned; an empty table gives an empty result.  There is no
    distance between vectors of different lengths: each length is searched by
    itself.
    """
    rows = materialize(usable(vectors, id_col, vec_col).distinct().withColumn("key", F.xxhash64("vec")), "vectors")
    lengths = sorted(r.dims for r in rows.select(F.size("vec").alias("dims")).distinct().collect())
    if len(lengths) < 2:
        return search_length(rows, is_query, k)
    found = None
    for dims in lengths:
        part = search_length(rows.where(F.size("vec") == dims), is_query, k)
        found = part if found is None else found.unionByName(part)
    return found


def build(rows: DataFrame, k: int) -> tuple[Index, DataFrame]:
    """The index over ``rows`` (vec_id, vec, key; vectors of one length), and its entries: key, vec, ids, list, cell."""
    count = rows.count()
    dims = len(rows.first().vec) if count else 1
    share = min(1 << 20, -(-(SAMPLE << 20) // max(count, 1)))
    sample = sorted((r.vec_id, r.vec) for r in rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).select("vec_id", "vec").collect())
    rotation = np.linalg.qr(np.random.default_rng(7).normal(size=(dims, dims)))[0]
    x = np.unique(np.array([v for _, v in sample]).reshape(-1, dims), axis=0) @ rotation
    centroids = kmeans(x, min(len(x), max(1, min(MOST_LISTS, 2 * int(np.sqrt(count)))))) if len(x) else np.zeros((1, dims))
    centroids = centroids[along(centroids)]
    lists = len(centroids)
    index = Index(rotation, centroids, enough_probes(x, centroids, k), np.arange(lists), np.ones(lists, np.int64))

    # One entry a distinct vector, with its k + 1 smallest ids; the rank limit is applied before the shuffle, too.
    nth = F.row_number().over(Window.partitionBy("key", "vec").orderBy("vec_id"))
    entries = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("key", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    shared = rows.sparkSession.sparkContext.broadcast(index)
    placed = materialize(entries.mapInArrow(lambda b: released(list_batches(b, shared.value)), "key long, vec array<double>, ids array<long>, list int"), "entries")
    sizes = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # MOST_LISTS rows at most
        sizes[r["list"]] = r["count"]
    most = max(64, min(BLOCK, int(sizes.sum()) // CELLS))
    cell, room = -1, 0
    for n, size in enumerate(sizes):
        if size > room:
            cell, room = cell + 1, most
        index.first[n], index.cells[n] = max(cell, 0), max(1, -(-size // most))
        cell, room = cell + index.cells[n] - 1, room - size if size <= most else 0
    # A list's place is (first cell, cells); both follow from tables of as many rows as lists.
    first, cells = (F.array(*(F.lit(int(v)) for v in values)) for values in (index.first, index.cells))
    at = F.col("list") + 1
    return index, placed.withColumn("cell", (F.element_at(first, at) + F.pmod(F.xxhash64("key"), F.element_at(cells, at))).cast("int"))


def search_length(rows: DataFrame, is_query, k: int) -> DataFrame:
    """``search`` among ``rows`` (vec_id, vec, key), whose vectors are of one length."""
    index, entries = build(rows, k)
    shared = rows.sparkSession.sparkContext.broadcast(index)
    asked = rows.where(is_query).select("vec_id", "key", "vec")
    # Equal query vectors are searched once.  The key of a search is the smallest id of its rows.
    searches = asked.groupBy("key", "vec").agg(F.min("vec_id").alias("query_key"))
    owners = asked.join(searches.select("key", "vec", "query_key"), ["key", "vec"]).select("vec_id", "query_key")
    probed = materialize(searches.select("query_key", "vec").mapInArrow(lambda b: released(probe_batches(b, shared.value)), "query_key long, vec array<double>, cell int, visits array<int>, home boolean"), "probes")

    def visited(queries: DataFrame, name: str) -> DataFrame:
        chunks = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("chunks"))
        left = queries.join(chunks, "cell").withColumn("chunk", F.pmod(F.xxhash64("query_key"), F.col("chunks")).cast("int")).drop("chunks", "home")
        right = entries.join(chunks, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("cell", "chunk", "list", "vec", "ids")
        grouped = left.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk"))
        return materialize(grouped.applyInPandas(lambda q, e: search_cell(q, e, shared.value, k), "query_key long, vec_id long, score double"), name)

    best = Window.partitionBy("query_key").orderBy("score", "vec_id")
    home = visited(probed.where("home").withColumn("bound", F.lit(None).cast("double")), "home")
    # The home cell's (k + 1)-th best, squared and with room for rounding, bounds what the other cells need to look at.
    bounds = home.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k + 1).select("query_key", (F.col("score") * F.col("score") * (1 + 1e-9)).alias("bound"))
    away = visited(probed.where("not home").join(bounds, "query_key", "left"), "away")
    top = home.unionByName(away).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    ranked = owners.withColumnRenamed("vec_id", "query_id").join(top.drop("nth"), "query_key").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
