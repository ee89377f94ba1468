"""Language identification by nearest centroid.

A text is a vector of TF-IDF weighted, length-normalised byte n-grams (square
root of the count times inverse document frequency).  Each language has several
centroids, found by spherical k-means over a bounded sample; a text goes to the
language of the centroid with the largest cosine, and is rejected where it is
farther from it than the language's radius.  Cosines grow with a text's number
of different n-grams, so a radius is a curve over that number.  It comes from
the language's own sample rows, thinned to several lengths and measured against
centroids fitted without them.  Document frequencies are counted over all
training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import gram_counts, joined_utf8, released, slices, unused

DIMS = 4096
ORDER = 3
CENTROIDS = 4
#: Bound of the sample that centroids are fitted on: rows a language, and rows in all.
PER_LANGUAGE = 800
SAMPLE = 6000
#: A text is rejected if its cosine is less than SLACK times this quantile of its language's cosines at its number of n-grams.
#: The quantile lies above the share of junk among training rows.
QUANTILE = 0.05
SLACK = 0.55
#: Cosines that a point of a radius curve needs; with fewer of its own a language takes the curve of all languages together.
LEAST = 20
#: Points of a curve: numbers of different n-grams that are powers of two, up to DIMS.
POINTS = DIMS.bit_length()
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # language after language, CENTROIDS rows each
    radius: np.ndarray  # least cosine by language and logarithm of the number of different n-grams

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return weigh(counts, self.idf)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and cosine by row; ties go to the language that sorts first."""
        near = self.vectors(counts) @ self.centroids.T
        best = near.argmax(axis=1)
        return best // CENTROIDS, np.clip(near[np.arange(len(near)), best], 0.0, 1.0)

    def least(self, counts: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Least cosine by row that isn't rejected, between the points of its language's curve by line."""
        at = np.log2(np.maximum((counts > 0).sum(axis=1), 1))
        low = at.astype(np.int64)
        part = at - low
        return self.radius[lang, low] * (1 - part) + self.radius[lang, np.minimum(low + 1, POINTS - 1)] * part


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts) * idf
    return x / np.maximum(np.sqrt(np.square(x).sum(axis=1, keepdims=True)), 1e-9)


def batch_counts(batch: pa.RecordBatch, column: str | int):
    """Yield (first row, rows, counts) of the lower-cased texts."""
    for at, n in slices(batch, column):
        texts = pc.utf8_lower(pc.fill_null(batch.column(column).slice(at, n), ""))
        yield at, n, gram_counts(*joined_utf8(texts), ORDER, DIMS)


def document_frequencies(batches):
    total, rows = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for _, n, counts in batch_counts(batch, "text"):
            total += (counts > 0).sum(axis=0)
            rows += n
    yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(-1, DIMS), pa.int32()), "n": pa.array(np.concatenate([[rows], total]), pa.int64())})


def sample_counts(batches):
    for batch in batches:
        for at, n, counts in batch_counts(batch, "text"):
            packed = [row.tobytes() for row in np.sqrt(counts).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(at, n), pa.array(packed, pa.binary())], ["lang", "roots"])


def spherical_kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        for j in range(k):
            if (own == j).any():
                mean = x[own == j].mean(axis=0)
                centres[j] = mean / max(np.linalg.norm(mean), 1e-9)
    return centres


def thinned(counts: np.ndarray, rng: np.random.Generator):
    """Counts of 1, 2, 4 ... n-grams drawn from each row that has more of them, and the rows themselves."""
    yield counts
    bags = []
    for row in counts.astype(np.int64):
        if row.sum() > 2 * DIMS:  # no more than the largest size is drawn from a long text
            row = rng.multivariate_hypergeometric(row, 2 * DIMS, method="marginals")
        bags.append(rng.permutation(np.repeat(np.arange(DIMS), row)))
    for size in 1 << np.arange(POINTS):
        some = [np.bincount(bag[:size], minlength=DIMS) for bag in bags if len(bag) > size]
        if some:
            yield np.stack(some).astype(np.float32)


def held_out_cosines(counts: np.ndarray, idf: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Point of the curve and cosine of thinned rows; each half of the rows is measured against centroids of the other."""
    points, cosines = [np.zeros(0, np.int64)], [np.zeros(0)]
    rng = np.random.default_rng(seed)
    half = rng.permutation(len(counts)) % 2 == 0
    for fitted in (half, ~half):
        if not fitted.any() or fitted.all():
            continue
        centres = spherical_kmeans(weigh(counts[fitted], idf), CENTROIDS, seed)
        for some in thinned(counts[~fitted], rng):
            points.append(np.rint(np.log2(np.maximum((some > 0).sum(axis=1), 1))).astype(np.int64))
            cosines.append((weigh(some, idf) @ centres.T).max(axis=1))
    return np.concatenate(points), np.concatenate(cosines)


def radius_curve(points: np.ndarray, cosines: np.ndarray) -> np.ndarray | None:
    """Least cosine at each point; where there are fewer than LEAST cosines it comes from the points beside it."""
    known = [p for p in range(POINTS) if (points == p).sum() >= LEAST]
    if not known:
        return None
    return np.interp(np.arange(POINTS), known, [SLACK * float(np.quantile(cosines[points == p], QUANTILE)) for p in known])


def training_rows(docs: DataFrame) -> Column:
    """Rows that may be learned from: a language, and crc32(doc_id) mod 3 other than 1."""
    return F.col("lang").isNotNull() & (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 3 != 1)


def train(docs: DataFrame, rows: Column | None = None) -> Model:
    rows = training_rows(docs) if rows is None else rows
    known = docs.where(rows).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("draw"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    each = max(1, min(PER_LANGUAGE, SAMPLE // max(1, len(languages))))
    freq = {r.dim: r.n for r in known.select("text").mapInArrow(lambda b: released(document_frequencies(b)), "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    idf = np.log((1.0 + freq.get(-1, 0)) / (1.0 + np.array([freq.get(d, 0) for d in range(DIMS)]))).astype(np.float32) + np.float32(1.0)
    share = F.lit(0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 20, -(-(each << 20) // sizes[lang])))).otherwise(share)
    drawn = known.where(F.pmod(F.col("draw"), F.lit(1 << 20)) < share).select("lang", "text").mapInArrow(lambda b: released(sample_counts(b)), "lang string, roots binary").collect()
    drawn.sort(key=lambda r: (r.lang, bytes(r.roots)))
    centroids, measured = [], []
    for n, lang in enumerate(languages):
        roots = [np.frombuffer(r.roots, np.float16) for r in drawn if r.lang == lang]
        x = np.stack(roots).astype(np.float32) if roots else np.zeros((1, DIMS), np.float32)
        x = np.rint(np.square(x))
        centroids.append(spherical_kmeans(weigh(x, idf), CENTROIDS, n))
        measured.append((len(x), *held_out_cosines(x, idf, n)))
    together = radius_curve(*(np.concatenate([m[k] for m in measured]) for k in (1, 2))) if measured else None
    together = np.zeros(POINTS) if together is None else together
    own = [radius_curve(*m[1:]) if m[0] >= LEAST else None for m in measured]
    radius = [together if curve is None else curve for curve in own]
    return Model(languages, idf, np.concatenate(centroids) if centroids else np.zeros((0, DIMS), np.float32), np.array(radius))


def label_batches(batches, model: Model):
    names = np.array([*model.languages, UNKNOWN], object)
    for batch in batches:
        # The last two columns are the text and whether it has letters.
        last = batch.num_columns - 1
        for at, n, counts in batch_counts(batch, last - 1):
            part = batch.slice(at, n)
            letters = np.asarray(part.column(last).to_numpy(zero_copy_only=False), bool)
            if model.languages:
                lang, near = model.predict(counts)
                lost = near < model.least(counts, lang)
            else:
                lang, near, lost = np.full(n, -1), np.zeros(n), np.ones(n, bool)
            lang, near = np.where(letters, lang, -1), np.where(letters, near, 0.0)
            kept = [part.column(c) for c in range(part.num_columns - 2)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(names[lang], pa.string()), pa.array(near.astype(np.float64)), pa.array(lost | (lang < 0))],
                [*part.schema.names[:-2], "__lang_pred", "__score", "__rejected"],
            )


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with __lang_pred, __score (cosine, 0 to 1) and __rejected added.

    Null texts and texts without a letter are ``und``, score 0 and rejected.
    Every row is judged by its whole text alone; other columns pass through,
    but columns of the added names are replaced.
    """
    docs = docs.drop("__lang_pred", "__score", "__rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select("*", text.alias(unused("text", docs.columns)), text.rlike(r"\p{L}").alias(unused("letters", docs.columns)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return rows.mapInArrow(lambda b: released(label_batches(b, shared.value)), f"{schema}, __lang_pred string, __score double, __rejected boolean")


def op9(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))
