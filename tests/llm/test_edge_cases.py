"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lithic.llm import bpe, exact_dedup, langid, line_dedup, near_dedup, packing, quality, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, kept boolean, host string, __text string"
LONG = " ".join(f"word{i % 977} of {i}" for i in range(60_000))
WORDS = "the quick brown fox jumps over the lazy dog and runs far away from here today with some joy"


def rows():
    texts = [None, "", " \n\t ", "One.", "ONE.", "one.", WORDS, WORDS, WORDS + " again", LONG, LONG, "\n\n", "ünïcödé Ä ß", "x" * 5000, "1234 !!", "a\nb\nmenu", "c\nmenu", "d\nmenu ", "e\n menu\n"]
    out = [(n, t, None if n % 5 == 0 else "en", None if n % 7 == 0 else "site", None, None, 1, None, "h", "q") for n, t in enumerate(texts)]
    return [*out, out[6], (None, "no id", "en", "site", 1, 0.1, None, True, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    want = {}
    for r in rows():
        want.setdefault(lower(r[1]), []).append(r[0])
    assert len(got) == len(rows())
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    for r in got:
        ids = by[r.text_sha256]
        best = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(ids), r.doc_id is not None and r.doc_id == best)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_hot_from_a_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 3)
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.when(F.col("id") % 500 < 2, F.col("id") % 500).otherwise(F.col("id"))).alias("text"))
    got = exact_dedup.exact_dedup(many, hot_share=0.5)
    assert got.where("group_size = 6").count() == 12 and got.where("kept").count() == 3000 - 10


def test_exact_dedup_heavy_hitters(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = exact_dedup.exact_dedup(many, counters=4)
    assert got.where("kept").count() == 4000 - 1334 + 1
    assert got.where("group_size = 1334 and keep_id = 3999").count() == 1334


def test_summary_never_loses_a_heavy_digest():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"digest": ["a"] * 40 + [str(i) for i in range(59)]})
    found = {d for out in exact_dedup.summarise([batch.slice(0, 50), batch.slice(50)], 3) for d in out.column("digest").to_pylist()}
    assert "a" in found


def test_bpe_against_library(docs, empty):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(path))}
    lib = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(r[0]), len(i := lib.encode_ordinary(r[1] or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(docs, path, P.PATTERN).collect()) == want
    assert bpe.token_digests(empty, path, P.PATTERN).count() == 0
    ids = bpe.encode_documents(docs, path, P.PATTERN)
    assert sorted((str(r.doc_id), bytes(r.raw)) for r in bpe.decode_documents(ids, path).collect()) == sorted((str(r[0]), (r[1] or "").encode()) for r in rows())


def test_bpe_random_words():
    import random

    import tiktoken

    tokens = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    encoder = bpe.Encoder(tokens, P.PATTERN)
    lib = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    random.seed(5)
    parts = ["ab", "ing", " ", "  ", "\n ", "é", "日本", "'s", "99", "!?", "\U0001f600", "aaa", "\t", "\x1c", "Tion"]
    for _ in range(1500):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 25)))
        ids = lib.encode_ordinary(text)
        assert encoder.ids(text) == ids
        assert encoder.digest(text)[1] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert bpe.decode(ids, tokens) == text.encode()


def test_sharding(docs, empty):
    got = sharding.shard_by_bytes(docs, shards=4).collect()
    assert len(got) == len(rows())
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    sizes = sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert sorted((r.size, r.text_crc32) for r in got) == sizes
    assert {r.law for r in got} == {"bytes"} and all(0 <= r.shard < 4 and r.grown_shard is None for r in got)
    assert sharding.shard_by_bytes(empty).count() == 0


def test_sharding_balances_and_splits_only_large_groups(spark):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("same text")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    got = sharding.shard_by_bytes(many, shards=8).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 2 * got["size"].max() + 0.002 * sums.mean() and len(sums) == 8


def test_line_dedup(docs, empty):
    got = {str(r.doc_id): r for r in line_dedup.dedup_lines(docs.where("doc_id is not null and doc_id <> 6")).collect()}
    assert got["15"].text == "a\nb" and got["18"].text == "e\n" and got["18"].n_dropped == 1
    assert got["0"].text is None and got["0"].n_lines == 0 and got["11"].text == "\n\n"
    assert got["9"].text == LONG and got["3"].text == "One."
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit(1))).columns[-2:] == ["n_lines_", "n_dropped"]


def test_pipeline_drops_boilerplate_on_every_host(spark):
    import corpus_pipeline

    # The menu is on 8 to 13 % of the pages of each host, the slogan on 4 %, the notice on a third of host 9 and a page of host 0.
    pages = {"menu": {h: 8 + h % 6 for h in range(12)}, "slogan": {h: 4 for h in range(12)}, "notice": {9: 33, 0: 1}}
    made = []
    for h in range(12):
        for n in range(100):
            lines = [f"body {h} {n}", *(line for line, on in pages.items() if n < on.get(h, 0))]
            made.append((len(made), "\n".join(lines), "en", f"host{h}", 9))
    # Hosts of one page share a line without being dropped.
    made += [(len(made) + k, "shared\nby small hosts", "en", f"small{k}", 9) for k in range(5)]
    got = corpus_pipeline.drop_boilerplate(spark, spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert len(got) == len(made) and all(r.n_chars == len(r.text) for r in got)
    want = {n: "\n".join(x for x in t.split("\n") if x != "menu" and (x, s) != ("notice", "host9")) for n, t, _, s, _ in made}
    assert {r.doc_id: r.text for r in got} == want


def test_line_dedup_salted_join_agrees(docs, monkeypatch):
    plain = sorted(map(str, line_dedup.dedup_lines(docs).select("doc_id", "text", "n_dropped").collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    assert sorted(map(str, line_dedup.dedup_lines(docs).select("doc_id", "text", "n_dropped").collect())) == plain


def test_near_duplicates(docs, empty):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[2].component_id == 2 and by[2].kept
    assert {by[i].component_id for i in (3, 4, 5)} == {3} and {by[i].component_id for i in (6, 7, 8)} == {6}
    assert by[10].component_id == 9 and by[None].component_id is None
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(near_dedup, "CHUNK", 7)  # several chunks a bucket
    random.seed(3)
    base = [[f"w{random.randrange(5000)}" for _ in range(90)] for _ in range(6)]
    texts = []
    for n in range(150):
        words = list(base[n % 6])
        for _ in range(random.randrange(7)):
            words[random.randrange(len(words))] = f"x{random.randrange(10**6)}"
        texts.append(" ".join(words))
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(len(texts))}


def one_group(n):
    """Near copies of one text, a third too far from it; every fourth of these has a copy of its own."""
    import random

    random.seed(8)
    base, out = [f"w{k}" for k in range(90)], [" ".join(f"w{k}" for k in range(90))]
    while len(out) < n:
        words = list(base)
        for at in random.sample(range(90), random.choice([1, 2, 3, 3, 5, 6])):
            words[at] = f"x{random.randrange(10**9)}"
        out.append(" ".join(words))
        if len(out) % 12 == 0:
            out.append(" ".join([*words[:-1], "end"][: random.choice([90, 84])]))
    return out[:n]


@pytest.mark.parametrize("ranked", [250_000, 5])
def test_near_duplicates_within_a_large_bucket(spark, monkeypatch, ranked):
    monkeypatch.setattr(near_dedup, "CHUNK", 7)
    monkeypatch.setattr(near_dedup, "RANKED", ranked, raising=False)
    texts = one_group(240)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    least = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and least[a] != least[b]:
                low, high = sorted((least[a], least[b]))
                least = [low if x == high else x for x in least]
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(least))
    assert sum(least.count(x) > 1 for x in set(least)) > 5


def test_near_duplicates_rows_grow_with_the_group_not_its_square(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 10)
    made, write = [], near_dedup.materialize

    def counted(df, name):
        out = write(df, name)
        made[-1] += out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    for n in (200, 800):
        made.append(0)
        near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(one_group(n))), "doc_id long, text string")).count()
    assert made[1] < 6 * made[0], made


def test_language(docs, empty, spark):
    model = langid.train(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows())
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r["__lang_pred"] == "und") == (not letters) and 0 <= r["__score"] <= 1
    nothing = langid.train(empty)
    assert nothing.languages == [] and {r["__lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_language_rejects_far_texts_of_any_length(spark, sf):
    import base64
    import random

    random.seed(4)
    foreign = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
        "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
    ]
    of = lambda letters, n: "".join(random.choice(letters) for _ in range(n))
    latin, cjk = "abcdefghijklmnopqrstuvwxyz", [chr(c) for c in range(0x4E00, 0x9FFF)]
    far = [*foreign, *(" ".join([t] * 20) for t in foreign)]
    for n in (60, 400, 3000, 20_000):
        far += [of(latin, n), of(latin + " ", n), of("0123456789abcdef", n), base64.b64encode(random.randbytes(n)).decode(), of(cjk, n)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    got = langid.identify(spark.createDataFrame(list(enumerate(far)), "n long, text string"), model).collect()
    assert [far[r.n][:40] for r in got if not r["__rejected"]] == []
    held = langid.identify(docs.where(~langid.training_rows(docs)), model).collect()
    assert len(held) > 50 and sum(not r["__rejected"] for r in held) >= 0.97 * len(held)
    short = [" ".join(r.text.split()[:8]) for r in held if r.n_chars > 500]
    kept = langid.identify(spark.createDataFrame([(t,) for t in short], "text string"), model).where("not __rejected").count()
    assert kept >= 0.95 * len(short)


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(n, 1, 0) for n in range(0, 19, 2)] + [(None, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows()) and all(0 <= r["__score"] <= 1 for r in got)
    assert quality.train(empty, labels) is None
    assert {r["__score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_packing(docs, empty):
    import numpy as np
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = packing.pack_documents(docs.where("doc_id is not null and doc_id <> 6"), path).collect()
    for n, text in [(r[0], r[1]) for r in rows() if r[0] not in (None, 6)]:
        ids = np.asarray([*lib.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in got if r.doc_id == n), key=lambda r: r.piece)
        assert [r.start for r in mine] == list(range(0, len(ids), 2048))
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine]
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(empty, path).count() == 0
    assert packing.pack_documents(docs, path).where("doc_id = 6").count() == 2


def test_word_ids_against_the_untouched_library():
    import random

    import numpy as np
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        mine = packing.WordTokenizer(f.read())
    random.seed(8)
    parts = ["hello", " ", "world.", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|> ", "<|", "don't", "\n", "\u00e9t\u00e9", "e\u0301", "\u65e5\u672c", "42,", "x<|endoftext|>y", "\u00a0", "<w/>", "\u212a"]
    for _ in range(2000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        assert np.frombuffer(mine(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text
    assert np.frombuffer(mine("hello <|endoftext|> world"), "<u4").tolist() == [3306, 49407, 1002]


def plain_best_fit(lengths, capacity, weights):
    bins, out = [], []
    for size in lengths:
        need = (size, 1, size * size)
        fits = [(sum(w * ((c - n) / whole) ** 2 for w, c, n, whole in zip(weights, left, need, capacity)), k) for k, left in enumerate(bins) if all(c >= n for c, n in zip(left, need))]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append(list(capacity))
        bins[k] = [c - n for c, n in zip(bins[k], need)]
        out.append(k)
    return out


def test_best_fit_against_a_plain_form_and_the_scalar_choice():
    import numpy as np

    rng, differs = np.random.default_rng(4), 0
    for capacity in ((100.0, 100.0, 10_000.0), (100.0, 6.0, 4000.0)):
        for _ in range(40):
            lengths = np.sort(rng.integers(1, 64, 60))[::-1]
            bins, _ = packing.best_fit(lengths, capacity)
            assert bins.tolist() == plain_best_fit(lengths.tolist(), capacity, packing.WEIGHTS)
            differs += bins.tolist() != packing.best_fit(lengths, capacity, (1.0, 0.0, 0.0))[0].tolist()
    assert differs > 20


def test_written_shards_hold_every_row_once(docs, empty, tmp_path):
    whole = docs.withColumn("Slot", F.lit("clash"))
    sharding.write_shards(whole, f"file://{tmp_path}/s", shards=3)
    got = docs.sparkSession.read.parquet(f"file://{tmp_path}/s")
    text = lambda df: sorted(map(str, df.select(*docs.columns).collect()))
    assert text(got) == text(docs)
    for s in {r.shard for r in got.collect()}:
        slots = sorted(r.slot for r in got.where(F.col("shard") == s).collect())
        assert slots == list(range(len(slots)))
    sharding.write_shards(empty, f"file://{tmp_path}/e")


def test_best_fit_keeps_every_capacity():
    import numpy as np

    lengths = np.sort(np.random.default_rng(1).integers(1, 500, 400))[::-1]
    bins, offsets = packing.best_fit(lengths, (1000.0, 5.0, 400_000.0))
    for b in set(bins):
        mine = lengths[bins == b]
        assert mine.sum() <= 1000 and len(mine) <= 5 and (mine**2).sum() <= 400_000
        assert sorted(offsets[bins == b]) == sorted(np.cumsum([0, *mine[np.argsort(offsets[bins == b])]])[:-1])
    with pytest.raises(ValueError):
        packing.best_fit(np.array([1001]), (1000.0, 5.0, 2e6))
