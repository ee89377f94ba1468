import duckdb
import numpy as np
from pyspark.sql import functions as F

from lithic.llm import ann, url_filter
from lithic.llm.components import connected_components


def exact(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        d = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in ok if i != q)
        out[q] = d[:k]
    return out


def test_search_with_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    same = rows[5][1]
    rows += [(200 + i, same) for i in range(40)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] + [1.0] * 7), (304, [float("inf")] * 8), (None, same), (5, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("list", F.lit(2))
    got = ann.search(df, F.lit(True), k=5).collect()
    want = exact([r for n, r in enumerate(rows) if n < len(rows) - 1], 5)
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hits = sum(len(set(by[q]) & set(w)) for q, w in want.items())
    assert set(by) == set(want) and hits >= 0.9 * sum(map(len, want.values()))
    assert [i for _, i in by[210]] == [5, 200, 201, 202, 203]
    assert ann.search(df.where("vec_id < 0"), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id in (1, 2)"), F.lit(True)).count() == 2


def test_each_length_is_searched(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4 if i < 30 else 3)]) for i in range(40)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), k=3).collect()
    want = exact(rows[:30], 3) | exact(rows[30:], 3)
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(q, n + 1, i) for q, near in want.items() for n, (_, i) in enumerate(near)}


def test_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = ann.search(df, F.col("vec_id") % 10 == 0).collect()
    want = exact(rows, 10)
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(found[q] & {i for _, i in want[q]}) / len(want[q]) for q in found]) >= 0.9


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 105), (105, 103), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 103, 105)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


URLS = [
    "http://example.org/es/1", "https://EN.Example.ORG/en/17?x", "http://example.org/en/2", "http://notexample.org/es/", "http://a.b.com/de/9", "http://com/fr/", "http://x.net",
    "no scheme", "", None, "://", "http://h/a/b/c/d/e/f", "http://h/a//b", "ftp://H.com#frag/x", "http://h/?q=http://com/de/", "http://h\n/x\ny", "http://h/a/b/c/d/e/f",
]


def test_urls_against_sql(spark):
    pages = [(n, u, "h") for n, u in enumerate(URLS)] + [(100 + i, f"http://big.net/blog/post-{i}-x", None) for i in range(60)] + [(200 + i, f"http://big.net/shop/{i}", None) for i in range(30)] + [(3, URLS[3], None), (None, URLS[0], None)]
    labels = [(100 + i, int(i % 4 == 0)) for i in range(60)] + [(200 + i, 1) for i in range(30)] + [(4, None), (None, 1), (11, 0), (11, 1)]
    p = spark.createDataFrame(pages, "page_id long, url string, host string")
    m = spark.createDataFrame(labels, "doc_id long, quality int")
    got = url_filter.filter_urls(p, m.select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))).toPandas()
    con = duckdb.connect()
    pages_df, labels_df = p.toPandas(), m.toPandas()
    con.register("pages", pages_df.astype({"page_id": "Int64"}))
    con.register("labels", labels_df.astype({"doc_id": "Int64", "quality": "Int64"}))
    want = con.execute(url_filter.oracle_sql()).fetchall()
    clean = lambda rows: sorted(tuple("~" if v is None or v != v else str(v).removesuffix(".0") for v in r) for r in rows)
    assert clean(got.itertuples(index=False)) == clean(want)
    rules = {r.page_id: (r.rule, r.verdict) for r in got.itertuples() if r.page_id == r.page_id}
    assert rules[0] == ("example.org/es/", "block") and rules[1] == ("example.org/en/1", "block") and rules[2] == ("org/", "allow")
    assert rules[4] == ("com/de/", "block") and rules[100][1] == "block" and rules[200][1] == "allow"
    assert url_filter.filter_urls(p.where("page_id < 0"), m.select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))).count() == 0


def merged_by_hand(leaves):
    """Sums of the branch each leaf is merged into, in plain Python."""
    groups, final = {(h, *t, None): (n, g, [(h, t)]) for h, t, n, g in leaves}, {}
    for size in range(max(map(len, groups)), 1, -1):
        nodes = {}
        for key in [k for k in groups if len(k) == size]:
            nodes.setdefault(key[:-1], []).append(groups.pop(key))
        for above, branches in nodes.items():
            p = sum(b[1] for b in branches) / max(1, sum(b[0] for b in branches))
            rest = [b for b in branches if not (b[0] and abs(b[1] / b[0] - p) > url_filter.Z * (max(p * (1 - p), 1e-6) / b[0]) ** 0.5)]
            final |= {t: b[:2] for b in branches if b not in rest for t in b[2]}
            if rest:
                groups[above] = (sum(b[0] for b in rest), sum(b[1] for b in rest), [t for b in rest for t in b[2]])
    return final | {t: b[:2] for b in groups.values() for t in b[2]}


def test_branches_are_merged_at_every_level(spark):
    rng = np.random.default_rng(2)
    trees = [("h", t, 30, int(30 * p)) for t, p in [(("en", "*"), 0.9), (("en", "*", ""), 0.9), (("fr", "*"), 0.9), (("de", "*"), 0.1), (("de", "x", "y"), 0.1), (("de",), 0.9)]]
    for host in "abcd":
        paths = {tuple(str(rng.integers(3)) for _ in range(rng.integers(0, 6))) for _ in range(40)}
        trees += [(host, t, n := int(rng.integers(0, 30)), int(rng.binomial(n, rng.choice([0.1, 0.5, 0.9])))) for t in sorted(paths)]
    leaves = spark.createDataFrame([(h, list(t), n, g) for h, t, n, g in trees], "host string, general array<string>, n_labelled long, n_good long")
    got = {(r.host, tuple(r.general)): (r.seen, r.own_good) for r in url_filter.merge_branches(leaves).collect()}
    assert got == merged_by_hand(trees)
    assert got["h", ("en", "*")] == got["h", ("en", "*", "")] == got["h", ("fr", "*")] != got["h", ("de", "*")]
    assert url_filter.merge_branches(leaves.where("n_labelled < 0")).count() == 0


def test_few_labels_count_with_like_siblings_above(spark):
    pages, labels = [], []
    for section, count, good in (("a", 3, 0), ("b", 3, 0), ("c", 3, 0), ("d", 3, 0), ("news", 60, 60)):
        for i in range(count):
            pages.append((len(pages), f"http://x.net/{'ads' if section != 'news' else 'n'}/{section}/{i}"))
            labels.append((len(labels), int(i < good)))
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int"), rules=()).collect()
    assert {r.verdict for r in got if r.path.startswith("/ads/")} == {"block"} and {r.verdict for r in got if r.path.startswith("/n/")} == {"allow"}


def test_labelled_children_of_a_wide_node_stay(spark):
    sections = ["casino", *(f"topic-{k}-x" for k in range(40))]
    paths = [(f"/{name}/{i}", int(name != "casino")) for name in sections for i in range(12)] + [(f"/rare-{k}-x/1", 1) for k in range(30)]
    pages = spark.createDataFrame([(n, f"http://hot.net{p}") for n, (p, _) in enumerate(paths)], "page_id long, url string")
    labels = spark.createDataFrame([(n, good) for n, (_, good) in enumerate(paths)], "page_id long, good int")
    got = {r.path: r for r in url_filter.filter_urls(pages, labels, rules=()).collect()}
    assert {got[p].verdict for p, good in paths if not good} == {"block"} and {got[p].verdict for p, good in paths if good} == {"allow"}
    assert got["/casino/3"].template == "casino/*" and got["/rare-7-x/1"].template == "*/*"


def test_deep_branches_are_judged_apart(spark):
    paths = [(f"/a/b/c/d/{branch}/{i}", int(branch != "spam")) for branch in ("good", "fine", "spam") for i in range(30)]
    paths += [(f"/a/b/c/d/e/f/item-{i}-x", 1) for i in range(30)]
    pages = spark.createDataFrame([(n, f"http://deep.net{p}") for n, (p, _) in enumerate(paths)], "page_id long, url string")
    labels = spark.createDataFrame([(n, good) for n, (_, good) in enumerate(paths)], "page_id long, good int")
    got = url_filter.filter_urls(pages, labels, rules=()).collect()
    assert {r.path: r.verdict for r in got} == {p: "allow" if good else "block" for p, good in paths}
    assert {r.template for r in got if r.verdict == "block"} == {"a/b/c/d/spam/**"}
    assert len({r.template for r in got if "/item-" in r.path}) == 1


def test_scan_abandons_candidates_early(spark):
    """With the bound carried on, nearest list first, few of the components are read, and nearly all neighbours are found."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, vectors = zip(*((r.vec_id, r.embedding) for r in rows.collect()), strict=True)
    x = np.array(vectors, np.float64)
    usable = ann.usable(rows, "vec_id", "embedding").withColumn("key", F.xxhash64("vec"))
    index, entries = ann.build(usable, 10)
    assert entries.select("cell").distinct().count() > 8
    turned = x @ index.rotation
    own = ann.nearest(turned, index.centroids, 1)[:, 0]
    order = np.argsort(own, kind="stable")
    starts = np.searchsorted(own[order], np.arange(len(index.centroids) + 1))
    read = hits = whole = 0
    for q in range(0, len(x), 10):
        lists = ann.nearest(turned[q : q + 1], index.centroids, index.probes)[0]
        found, cost = ann.visit(turned[q], turned[order], [(starts[c], starts[c + 1]) for c in lists if starts[c] < starts[c + 1]], np.inf, 11)
        true = np.argsort(np.square(x - x[q]).sum(axis=1), kind="stable")[:11]
        hits += len(set(order[found]) & set(true))
        whole += sum(starts[c + 1] - starts[c] for c in lists) * x.shape[1]
        read += cost
    searched = len(range(0, len(x), 10))
    assert read < 0.5 * x.size * searched and read < 0.65 * whole and hits >= 0.9 * 11 * searched
