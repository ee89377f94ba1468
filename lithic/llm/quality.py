"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network on features of
whole texts.  A first model separates positives from unlabelled text; from its
scores on held-back rows the share of positives in the unlabelled text is
estimated (best-bin mixture proportion).  The second model minimises the
non-negative unbiased risk with that class prior, so that its output is the
probability of the positive class.  Known negatives are never used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import gram_counts, joined_utf8, released, slices, unused

GRAMS = 256
SHAPE = 24
DIMS = SHAPE + GRAMS
#: Bound of the sample that is fitted on: trusted positives, and as many unlabelled texts.
SAMPLE = 6000
THRESHOLD = 0.3
HIDDEN = 24


def features(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Shape and byte-bigram features of each text of ``joined_utf8``."""
    n = len(starts) - 1
    size = np.maximum(np.diff(starts) - 1, 0).astype(np.float64)
    one = np.maximum(size, 1.0)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[starts[1:]] - total[starts[:-1]]

    upper, lower, digit = (buf >= 65) & (buf <= 90), (buf >= 97) & (buf <= 122), (buf >= 48) & (buf <= 57)
    space, high = (buf <= 32), buf >= 128
    stop = (buf == 46) | (buf == 63)
    symbol = ~(upper | lower | digit | space | high)
    edges = np.diff(np.concatenate([[1], space.astype(np.int8), [1]]))
    first, last = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    owner = np.searchsorted(starts, first, side="right") - 1
    words = np.bincount(owner, minlength=n).astype(np.float64)
    w1 = np.maximum(words, 1.0)
    # A word's hash: sum of its bytes times powers of an odd number by place within the word.
    power = np.cumprod(np.full(64, 0x9E3779B1, np.uint64))
    at = np.arange(len(buf), dtype=np.int64)
    begin = np.zeros(len(buf), np.int64)
    if len(first):
        begin[first] = first
        begin = np.maximum.accumulate(begin)
    value = (buf.astype(np.uint64) + np.uint64(1)) * power[(at - begin) & 63]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    hashed = sums[last] - sums[first]

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=mask.astype(np.float64), minlength=n) / w1

    same = np.zeros(len(first), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
    pair = hashed.copy()
    pair[1:] = hashed[1:] * np.uint64(0x9E3779B97F4A7C15) + hashed[:-1]

    def distinct(keys: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, owner))
        new = np.ones(len(keys), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        return np.bincount(owner[order], weights=new, minlength=n)

    kinds = distinct(hashed)
    length = last - first
    ends = buf[np.maximum(last - 1, 0)] if len(last) else np.zeros(0, np.uint8)
    heads = buf[first] if len(first) else np.zeros(0, np.uint8)
    letters = share(upper | lower | high)
    shape = [
        np.log1p(size), np.log1p(words), size / w1, np.log1p(share(buf == 10)),
        share(upper) / np.maximum(letters, 1), share(digit) / one, share(high) / one, share(symbol) / one, share(space) / one,
        share(symbol & ~stop & (buf != 44)) / w1, share(stop) / w1, share(buf == 44) / w1, share(buf == 33) / w1,
        per_word(same), kinds / w1, np.log1p(kinds) / np.maximum(np.log1p(words), 1e-3), distinct(pair) / w1,
        per_word(length <= 3), per_word(length >= 12), per_word((ends == 46) | (ends == 63)),
        per_word(((ends < 48) | ((ends > 57) & (ends < 65))) & (ends != 46) & (ends != 44)), per_word((heads >= 65) & (heads <= 90)), per_word(length == 1),
        (size == 0).astype(np.float64),
    ]
    grams = np.sqrt(gram_counts(buf, starts, 2, GRAMS))
    grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
    return np.hstack([np.stack(shape, axis=1), grams * 4.0]).astype(np.float32)


def batch_features(batch: pa.RecordBatch, column: str | int):
    for at, n in slices(batch, column):
        yield at, n, features(*joined_utf8(batch.column(column).slice(at, n)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2, skip = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.maximum(z @ w1 + b1, 0) @ w2 + z @ skip + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x).astype(np.float64), -40, 40)))


def fit_network(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int, rounds: int = 40) -> Model:
    """Adam over minibatches.  With a prior: non-negative PU risk, of the logistic loss in the first third and of the sigmoid loss after it; without: plain logistic loss of positives against unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    d = p.shape[1]
    w = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(()), np.zeros(d)]
    m, v, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    size = 256
    for epoch in range(rounds):
        rate = 3e-3 * (1 - epoch / rounds) + 1e-4
        for at in range(0, max(len(p), len(u)), size):
            xp, xu = p[rng.integers(0, len(p), size)], u[rng.integers(0, len(u), size)]
            x = np.concatenate([xp, xu])
            h = np.maximum(x @ w[0] + w[1], 0)
            f = h @ w[2] + x @ w[4] + w[3]
            s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
            sp, su = s[:size], s[size:]
            if prior is None:
                g = np.concatenate([sp - 1, su]) / size
            else:
                # Risk by the sigmoid loss, whose bound keeps a few far-off rows from outweighing the rest; slope of it:
                slope, soft = s * (1 - s), epoch >= rounds // 3
                negative = (su.mean() - prior * sp.mean()) if soft else (-np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean())
                as_pos, as_neg = (-slope, slope) if soft else (s - 1, s)
                part = np.concatenate([-prior * as_neg[:size], as_neg[size:]]) / size
                if negative >= 0:
                    g = np.concatenate([prior * as_pos[:size], np.zeros(size)]) / size + part
                else:  # the estimate of the negative part fell below zero: climb out of it instead
                    g = -part
            gh = np.outer(g, w[2]) * (h > 0)
            grads = [x.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(), x.T @ g]
            step += 1
            for k, gk in enumerate(grads):
                gk = gk + (1e-4 * w[k] if k in (0, 2, 4) else 0)
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, [x.astype(np.float32) for x in w], prior if prior is not None else -1.0)


def best_bin_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives in unlabelled rows from scores of both: the least ratio, over top bins, of unlabelled to positive mass, with a confidence margin."""
    cuts = np.quantile(pos, np.linspace(0.0, 0.99, 100))
    qp = np.array([(pos >= c).mean() for c in cuts])
    qu = np.array([(unl >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(pos)) + 1 / np.sqrt(len(unl)))
    best = int(np.argmin((qu + margin) / qp))
    return float(np.clip(qu[best] / qp[best], 0.02, 0.98))


def fit(pos: np.ndarray, unl: np.ndarray) -> Model | None:
    if len(pos) < 2 or len(unl) < 2:
        return None
    half_p, half_u = len(pos) // 2, len(unl) // 2
    first = fit_network(pos[:half_p] if half_p else pos, unl[:half_u] if half_u else unl, None, 1, 15)
    prior = best_bin_prior(first.logits(pos[half_p:]), first.logits(unl[half_u:]))
    return fit_network(pos, unl, prior, 2)


def train_fold(name: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id as text, mod 5, other than 0."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def sample_features(batches):
    for batch in batches:
        for at, n, x in batch_features(batch, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("positive").slice(at, n), batch.column("draw").slice(at, n), pa.array([row.tobytes() for row in x.astype(np.float16)], pa.binary())], ["positive", "draw", "x"])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from ``docs`` (doc_id, text) and the ids that ``labels`` has with quality 1; None if either side has no rows."""
    trusted = labels.where((F.col("quality") == 1) & train_fold()).select("doc_id").distinct()
    ids = docs.where(train_fold()).select("doc_id")
    n_unl = ids.count()
    n_pos = ids.join(trusted, "doc_id", "left_semi").count()
    whole = 1 << 24

    def below(n: int) -> int:
        return min(whole, -(-SAMPLE * whole // max(n, 1)))

    draw = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(whole))
    # The draw comes first, so that only the sample's ids meet the documents.
    chosen = trusted.where(draw("p") < below(n_pos)).withColumn("positive", F.lit(True))
    rows = docs.where(train_fold()).select("doc_id", "text")
    pos = rows.where(draw("p") < below(n_pos)).join(chosen, "doc_id").select("positive", draw("p").alias("draw"), "text")
    unl = rows.where(draw("u") < below(n_unl)).select(F.lit(False).alias("positive"), draw("u").alias("draw"), "text")
    got = pos.unionByName(unl).mapInArrow(lambda b: released(sample_features(b)), "positive boolean, draw long, x binary").collect()
    got.sort(key=lambda r: (r.draw, bytes(r.x)))
    x = {k: np.array([np.frombuffer(r.x, np.float16) for r in got if r.positive is k], np.float32).reshape(-1, DIMS) for k in (True, False)}
    return fit(x[True], x[False])


def score_batches(batches, model: Model | None):
    for batch in batches:
        for at, n, x in batch_features(batch, batch.num_columns - 1):  # the text comes last
            part = batch.slice(at, n)
            score = model.score(x) if model else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(part.num_columns - 1)), pa.array(score)], [*part.schema.names[:-1], "__score"])


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with __score, the probability of good quality.

    Null text scores like empty text.  Without a model (no trusted rows) all
    score 0.5.  Other columns pass through, but a column __score is replaced;
    repeated rows score alike.
    """
    docs = docs.drop("__score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.select("*", F.coalesce(F.col(text_col), F.lit("")).alias(unused("text", docs.columns)))
    return rows.mapInArrow(lambda b: released(score_batches(b, shared.value)), f"{schema}, __score double")


def op1(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (~train_fold()).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
