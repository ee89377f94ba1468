"""URL filter by a path-template tree, with DataFrame functions only.

Every url becomes a template: path segments that look variable (numbers, hex,
long tokens) turn into wildcards by their shape.  In each host's tree of
templates, a node with many different children has those with few labels merged
into one wildcard.  Then, from the leaves up, sibling branches whose labelled purity
doesn't differ significantly from that of the siblings together are merged, and
what was merged is a branch of the node above.  A template is rejected when its
purity, smoothed towards its host's and that towards the whole's, is below a
threshold.  Host rules, if any fits, decide before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Segments that a template shows where what follows them was merged.
DEPTH = 4
MOST_CHILDREN = 24
#: Labels that a child of a node with more children needs to stay apart from the wildcard.
LEAST_LABELS = 5
SMOOTH = 8.0
THRESHOLD = 0.5
Z = 1.96

#: A segment of digits only, with or without a short extension; of hex digits; or over 40 characters.
VARIABLE = r"^([0-9]+(\.[A-Za-z0-9]{1,5})?|[0-9A-Fa-f-]{16,}|.{41,})$"

def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    safe = F.coalesce(url, F.lit(""))
    start = F.instr(safe, "://")
    rest = F.when(start > 0, F.substring(safe, start + 3, F.length(safe))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    # Without (?s) a dot stops at line breaks; the classes here don't.
    path = F.substring(F.regexp_extract(rest, r"^[^?#]*", 0), F.length(host) + 1, F.length(rest))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def template(path: Column) -> Column:
    """All segments of the path, variable ones as ``*``."""
    segments = F.split(path, "/", -1)
    return F.transform(F.slice(segments, 2, F.size(segments)), lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))


def merge_branches(leaves: DataFrame) -> DataFrame:
    """host, general, seen, own_good and top of each of ``leaves`` (host, general, n_labelled, n_good): the sums of the branch it was merged into and that branch's level.

    A node's branches are its children and, as one more, the paths that end
    there.  Those that differ from all together keep their sums; the others'
    sums are the node's own among its siblings.  Each level takes one pass up
    and one down.
    """
    # No segment is without its slash but the mark of a path's end.
    ends = F.concat(F.transform("general", lambda x: F.concat(F.lit("/"), x)), F.array(F.lit("")))
    ended = materialize(leaves.select("host", ends.alias("node"), "n_labelled", "n_good"), "url-leaves")
    deepest = ended.agg(F.coalesce(F.max(F.size("node")), F.lit(0))).first()[0]
    sums = [F.sum("n_labelled").alias("n_labelled"), F.sum("n_good").alias("n_good")]
    merged, levels = None, []
    for level in range(deepest, 0, -1):
        nodes = ended.where(F.size("node") == level)
        nodes = (nodes if merged is None else nodes.unionByName(merged)).withColumn("above", F.slice("node", 1, level - 1))
        pooled = nodes.groupBy("host", "above").agg(F.sum("n_labelled").alias("pn"), F.sum("n_good").alias("pg"))
        p = F.col("pg") / F.greatest(F.col("pn"), F.lit(1))
        n = F.greatest(F.col("n_labelled"), F.lit(1))
        differs = F.abs(F.col("n_good") / n - p) > F.lit(Z) * F.sqrt(F.greatest(p * (1 - p), F.lit(1e-6)) / n)
        marked = nodes.join(pooled, ["host", "above"]).withColumn("own", (F.col("n_labelled") > 0) & differs).drop("pn", "pg")
        levels.append(materialize(marked, f"url-level-{level}"))
        merged = levels[-1].where(~F.col("own")).groupBy("host", F.col("above").alias("node")).agg(*sums)
    if merged is None:
        return leaves.select("host", "general", F.col("n_labelled").alias("seen"), F.col("n_good").alias("own_good"), F.lit(0).alias("top"))
    settled, found = merged.select("host", F.col("node").alias("above"), F.col("n_labelled").alias("seen"), F.col("n_good").alias("own_good"), F.lit(0).alias("top")), []
    for marked in reversed(levels):
        down = marked.join(settled, ["host", "above"], "left").select(
            "host", "node", *[F.when(F.col("own"), F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("n_labelled", "seen"), ("n_good", "own_good"))], F.when(F.col("own"), F.size("node")).otherwise(F.col("top")).alias("top")
        )
        down = materialize(down, "url-settled")
        found.append(down.where(F.element_at("node", -1) == ""))
        settled = down.withColumnRenamed("node", "above")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.select("host", F.transform(F.slice("node", 1, F.size("node") - 1), lambda x: F.substring(x, 2, F.length(x))).alias("general"), "seen", "own_good", "top")


def judge_templates(shapes: DataFrame) -> DataFrame:
    """Verdict of each (host, shape) of ``shapes``, which has n_labelled and n_good of each.

    Levels are generalised from the root down: where a node has more than
    MOST_CHILDREN different children, those with fewer than LEAST_LABELS labels
    are merged into ``*``.  A template shows DEPTH segments, or as many as lead to
    the branch whose purity is its own, and ``**`` for what follows.
    """
    tree = shapes.withColumn("general", F.col("shape"))
    # A node can only be wide where its host has as many shapes that go on to the level.
    deep = shapes.groupBy("host", F.size("shape").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    reach = deep.withColumn("n", F.sum("n").over(Window.partitionBy("host").orderBy(F.desc("size")))).where(F.col("n") > MOST_CHILDREN)
    last = reach.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    for level in range(1, last + 1):
        if level > DEPTH:  # keeps the plan short
            tree = materialize(tree, "url-tree")
        above, child = F.slice("general", 1, level - 1), F.get("general", F.lit(level - 1))
        children = tree.select("host", above.alias("above"), child.alias("child"), "n_labelled").where("child is not null").groupBy("host", "above", "child").agg(F.sum("n_labelled").alias("n"))
        wide = children.groupBy("host", "above").agg(F.count(F.lit(1)).alias("children")).where(F.col("children") > MOST_CHILDREN)
        few = children.where(F.col("n") < LEAST_LABELS).join(wide, ["host", "above"]).select(F.col("host").alias("h"), F.col("above").alias("a"), F.col("child").alias("c"), F.lit(True).alias("few"))
        starred = F.transform("general", lambda s, i: F.when(i == level - 1, F.lit("*")).otherwise(s))
        tree = tree.join(few, (F.col("host") == F.col("h")) & (above == F.col("a")) & (child == F.col("c")), "left").withColumn("general", F.when(F.col("few"), starred).otherwise(F.col("general"))).drop("h", "a", "c", "few")
    sums = [F.sum("n_labelled").alias("n_labelled"), F.sum("n_good").alias("n_good")]
    tree = materialize(tree, "url-tree")
    leaves = tree.groupBy("host", "general").agg(*sums)
    hosts = leaves.groupBy("host").agg(F.sum("n_labelled").alias("hn"), F.sum("n_good").alias("hg"))
    labelled, good = leaves.agg(F.coalesce(F.sum("n_labelled"), F.lit(0)), F.coalesce(F.sum("n_good"), F.lit(0))).first()
    judged = merge_branches(leaves).join(hosts, "host")
    overall = F.lit((good + 1) / (labelled + 2))
    of_host = (F.col("hg") + F.lit(SMOOTH) * overall) / (F.col("hn") + F.lit(SMOOTH))
    purity = (F.col("own_good") + F.lit(SMOOTH) * of_host) / (F.col("seen") + F.lit(SMOOTH))
    verdicts = judged.select(F.col("host").alias("h"), F.col("general").alias("g"), F.when(purity < THRESHOLD, "block").otherwise("allow").alias("says"), F.greatest(F.lit(DEPTH), F.col("top")).alias("shown"))
    shown = F.when(F.size("general") > F.col("shown"), F.concat(F.slice("general", F.lit(1), F.col("shown")), F.array(F.lit("**")))).otherwise(F.col("general"))
    return tree.join(verdicts, (F.col("host") == F.col("h")) & (F.col("general") == F.col("g"))).select("host", "shape", F.array_join(shown, "/").alias("template"), "says")


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template of each row of ``pages`` (page_id, url).

    ``labels`` (page_id, good 0/1) train the purities; ids with several labels
    count each.  Null urls and urls without ``://`` have an empty host and path
    and are judged like any other template.  Repeated rows are judged alike; an
    empty table gives an empty result.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("shape", template(F.col("path")))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    marks = labels.groupBy("page_id").agg(F.count("good").alias("l"), F.sum("good").alias("g"))
    known = rows.select("page_id", "host", "shape").join(marks, "page_id", "left")
    shapes = known.groupBy("host", "shape").agg(F.coalesce(F.sum("l"), F.lit(0)).alias("n_labelled"), F.coalesce(F.sum("g"), F.lit(0)).alias("n_good"))
    verdicts = materialize(judge_templates(materialize(shapes, "url-shapes")), "url-verdicts")
    named = verdicts.select(F.col("host").alias("h"), F.col("shape").alias("s"), "template", F.col("says").alias("method"))
    return rows.join(named, (F.col("host") == F.col("h")) & (F.col("shape") == F.col("s")), "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.col("method")).alias("verdict"), "template"
    )


def op8(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return filter_urls(table(spark, sf_dir, "pages"), marks)


def oracle_sql(rules=RULES) -> str:
    """The method with a single step of merging, of leaves of one length under one node, in DuckDB's SQL."""
    cases = sorted(rules, key=lambda r: (-len(r[0]), r[0]))

    def fits(text: str) -> str:
        name, slash, rest = text.partition("/")
        return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}')"

    pick = lambda k: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[k]}'" for r in cases) + " END"
    levels, last = [], "t0"
    for k in range(1, DEPTH + 1):
        levels.append(f"""
w{k} AS (
  SELECT host, general[1:{k - 1}] AS above FROM {last} WHERE len(general) >= {k}
  GROUP BY host, general[1:{k - 1}] HAVING count(DISTINCT general[{k}]) > {MOST_CHILDREN}
), t{k} AS (
  SELECT t.host, t.shape, t.n_labelled, t.n_good, CASE WHEN w.host IS NOT NULL AND len(t.general) >= {k}
    THEN t.general[1:{k - 1}] || ['*'] || t.general[{k + 1}:] ELSE t.general END AS general
  FROM {last} t LEFT JOIN w{k} w ON t.host = w.host AND t.general[1:{k - 1}] = w.above
)""")
        last = f"t{k}"
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path FROM cut
), r AS (
  SELECT *, list_transform(string_split(path, '/')[2:{DEPTH + 1}], lambda s: CASE WHEN regexp_matches(s, '{VARIABLE}') THEN '*' ELSE s END)
    || CASE WHEN len(string_split(path, '/')) > {DEPTH + 1} THEN ['**'] ELSE [] END AS shape FROM p
), m AS (
  SELECT doc_id AS page_id, count(quality) AS l, sum(quality) AS g FROM labels GROUP BY doc_id
), t0 AS (
  SELECT host, shape, shape AS general, coalesce(sum(l), 0) AS n_labelled, coalesce(sum(g), 0) AS n_good
  FROM r LEFT JOIN m USING (page_id) GROUP BY host, shape
), {",".join(levels)}, leaves AS (
  SELECT host, general, len(general) AS size, general[1:greatest(len(general) - 1, 0)] AS above,
    sum(n_labelled) AS n_labelled, sum(n_good) AS n_good FROM {last} GROUP BY host, general
), pooled AS (
  SELECT host, size, above, sum(n_labelled) AS pn, sum(n_good) AS pg FROM leaves GROUP BY host, size, above
), marked AS (
  SELECT l.*, l.n_labelled > 0 AND abs(l.n_good / greatest(l.n_labelled, 1) - pg / greatest(pn, 1))
    > {Z} * sqrt(greatest(pg / greatest(pn, 1) * (1 - pg / greatest(pn, 1)), 1e-6) / greatest(l.n_labelled, 1)) AS own
  FROM leaves l JOIN pooled q ON l.host = q.host AND l.size = q.size AND l.above = q.above
), merged AS (
  SELECT host, size, above, sum(n_labelled) AS mn, sum(n_good) AS mg FROM marked WHERE NOT own GROUP BY host, size, above
), hosts AS (
  SELECT host, sum(n_labelled) AS hn, sum(n_good) AS hg FROM leaves GROUP BY host
), whole AS (
  SELECT sum(hn) AS wn, sum(hg) AS wg FROM hosts
), verdicts AS (
  SELECT k.host, k.general, CASE WHEN (CASE WHEN own THEN n_good ELSE mg END
      + {SMOOTH} * (hg + {SMOOTH} * (wg + 1) / (wn + 2)) / (hn + {SMOOTH})) / (CASE WHEN own THEN n_labelled ELSE mn END + {SMOOTH}) < {THRESHOLD}
    THEN 'block' ELSE 'allow' END AS says
  FROM marked k LEFT JOIN merged g ON k.host = g.host AND k.size = g.size AND k.above = g.above JOIN hosts h ON k.host = h.host CROSS JOIN whole
)
SELECT page_id, host, path, {pick(0)} AS rule, coalesce({pick(1)}, says) AS verdict, array_to_string(general, '/') AS template
FROM r JOIN {last} t USING (host, shape) JOIN verdicts v USING (host, general)
"""
