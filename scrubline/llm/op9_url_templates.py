"""URL filters: fixed rules, then a tree of path templates per host.

Rules name a host (with all its subdomains) and a path's start; the longest that
fits decides.  All other urls are judged by their template:

1. From the root down, a segment stays literal under its host and parent
   template if it holds at least ``LEAST_ROWS`` rows and ``LEAST_SHARE`` of the
   parent's, or, however small its share, if at least ``LEAST_ROWS`` of its rows
   are labelled and its share of good rows, or that of what continues it, differs
   from the other small ones'.  All other segments are one wildcard (with the
   file extension kept).  The tree grows by ``DEPTH`` segments, and from there
   on below every template that has ``LEAST_ROWS`` deeper rows and both good and
   bad ones among them: each level is a few jobs over the rows that are left.
   Below the others it makes no difference, and what lies there is one wildcard.
2. A template's evidence is its labelled rows.  Sibling templates (same host,
   same parent) whose shares of good rows are within ``Z`` standard deviations
   of their parent's are merged and judged by their common share.
3. The share of good rows, smoothed towards the share of all labelled rows with
   the weight of ``PRIOR`` rows, must be at least ``PURITY``; else the template
   is rejected and its urls are blocked.

Everything is aggregates with map-side combine and joins to tables of templates;
a host that holds a third of the rows is spread over its rows' joins by
adaptive execution, or met by broadcast where the templates were counted few.

Null urls and urls without ``://`` have an empty host and path and are judged as
a host of that name.  Rows repeat as they stand; of repeated labels the worst
counts; other columns are left out.  Without labels every template is as good as
none is known: allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stage
from .common import lower_ascii, table

DEPTH = 3
LEAST_ROWS, LEAST_SHARE = 5, 0.02
Z = 1.96
PRIOR, PURITY = 20.0, 0.5

# Fixed values: (host, start of the path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``rule, verdict`` of the longest rule that fits, or null."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p),
                   F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def literals(rows: DataFrame, level: int) -> DataFrame:
    """``host, template, seg`` of the segments of this level that stay literal."""
    key = ["host", "template", "seg"]
    counted = rows.where("seg is not null").groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count("good").alias("known"))
    wholes = counted.groupBy("host", "template").agg(F.sum("n").alias("all"))
    enough = stage(counted.where(F.col("n") >= LEAST_ROWS).join(wholes, ["host", "template"]).withColumn(
        "often", F.col("n") >= LEAST_SHARE * F.col("all")), "segments")
    often = enough.where("often").select(key)
    rare = enough.where(~F.col("often") & (F.col("known") >= LEAST_ROWS)).select(key)
    return often if rare.isEmpty() else often.unionByName(differing(rows, often, rare, level))


def differing(rows: DataFrame, often: DataFrame, rare: DataFrame, level: int) -> DataFrame:
    """Those of the ``rare`` segments that the wildcard must not swallow.

    The good rows of a segment, and of each continuation of it (its next segments,
    from none to all), are compared with those of all segments in the wildcard.
    What differs leaves the wildcard, and the rest is compared again until nothing
    differs.  As many continuations are tried, the limit on theirs grows with
    their number as the greatest of so many normal deviates does.
    """
    key, rest = ["host", "template", "seg"], ["k", "rest"]
    asked = broadcast_if_small(stage(rare.select("host", "template").distinct(), "asked"))
    wild = rows.where("seg is not null and good is not null").join(asked, ["host", "template"], "left_semi").join(
        often, key, "left_anti")
    tails = wild.withColumn("k", F.explode_outer(F.sequence(F.lit(0), F.size("parts") - level - 1))).withColumn(
        "rest", F.xxhash64(F.slice("parts", F.lit(level + 2), F.col("k"))))
    own = stage(tails.groupBy(*key, *rest).agg(F.count("good").alias("n"), F.sum("good").alias("g")), "tails")
    tried = own.where(F.col("n") >= LEAST_ROWS).join(rare, key, "left_semi")
    tried = stage(tried.join(tried.groupBy(key).agg(F.count(F.lit(1)).alias("m")), key), "tried")
    found = None
    while True:
        left, trying = (own, tried) if found is None else (
            own.join(found, key, "left_anti"), tried.join(found, key, "left_anti"))
        pool = left.groupBy("host", "template", *rest).agg(F.sum("n").alias("pn"), F.sum("g").alias("pg"))
        share = F.col("pg") / F.col("pn")
        spread = F.sqrt(F.greatest(F.col("n") * share * (1 - share), F.lit(0.25)))
        limit = F.sqrt(Z * Z + F.when(F.col("k") > 0, 2 * F.log("m")).otherwise(0.0))
        more = stage(trying.join(pool, ["host", "template", *rest]).where(
            F.abs(F.col("g") - F.col("n") * share) > limit * spread).select(key).distinct(), "differing")
        if more.isEmpty():
            return rare.limit(0) if found is None else found
        found = more if found is None else stage(found.unionByName(more), "differing")


def templates(urls: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``page_id, host, path, good, parent, template`` from ``page_id, host, path, good``."""
    parts = F.split(F.ltrim(F.col("path"), F.lit("/")), "/")
    rows = urls.withColumn("parts", parts).withColumn("parent", F.lit("")).withColumn("template", F.lit(""))
    for level in range(depth):
        rows = grow(rows, level)
    done = []
    while True:
        rows = stage(rows, "level")
        deeper = F.size("parts") > depth
        mixed = rows.where(deeper).groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("n"), F.count("good").alias("known"), F.sum("good").alias("g")).where(
            (F.col("n") >= LEAST_ROWS) & (F.col("g") > 0) & (F.col("g") < F.col("known"))).select(
            "host", "template", F.lit(True).alias("mixed"))
        mixed = broadcast_if_small(stage(mixed, "mixed"))
        marked = rows.join(mixed, ["host", "template"], "left").withColumn(
            "mixed", deeper & F.col("mixed").isNotNull())
        done.append(marked.where(~F.col("mixed")).select(
            "page_id", "host", "path", "good",
            F.when(deeper, F.col("template")).otherwise(F.col("parent")).alias("parent"),
            F.when(deeper, F.concat("template", F.lit("/**"))).otherwise(F.col("template")).alias("template")))
        if mixed.isEmpty():
            return reduce(DataFrame.unionByName, done)
        rows = grow(marked.where("mixed").drop("mixed"), depth)
        depth += 1


def grow(rows: DataFrame, level: int) -> DataFrame:
    """The rows with their templates one segment longer."""
    rows = rows.withColumn("seg", F.get("parts", F.lit(level)))
    literal = broadcast_if_small(stage(literals(rows, level).withColumn("literal", F.lit(True)), "literals"))
    rows = rows.join(literal, ["host", "template", "seg"], "left")
    wild = F.concat(F.lit("*"), F.regexp_extract("seg", r"(\.[A-Za-z0-9]{1,5})$", 1))
    name = F.when(F.col("literal"), F.col("seg")).when(F.col("seg") == "", "").otherwise(wild)
    return rows.withColumn("parent", F.when(F.col("seg").isNull(), F.col("parent")).otherwise(F.col("template"))
                           ).withColumn("template", F.when(F.col("seg").isNull(), F.col("template")).otherwise(
                               F.concat("template", F.lit("/"), name))).drop("literal", "seg")


def purities(rows: DataFrame) -> DataFrame:
    """``host, parent, template, merged, purity`` of every template; ``rows`` has
    templates and good (0, 1 or, where not known, null)."""
    own = rows.groupBy("host", "parent", "template").agg(
        F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("g"))
    own = stage(own, "templates")
    every = own.agg(F.coalesce(F.sum("g") / F.nullif(F.sum("n"), F.lit(0)), F.lit(1.0)).alias("p")).first()["p"]
    above = own.groupBy("host", "parent").agg(F.sum("n").alias("pn"), F.sum("g").alias("pg"))
    share = F.col("pg") / F.greatest("pn", F.lit(1))
    spread = F.sqrt(F.greatest(F.col("n") * share * (1 - share), F.lit(0.25)))
    judged = own.join(above, ["host", "parent"]).withColumn(
        "merged", F.abs(F.col("g") - F.col("n") * share) <= Z * spread)
    pooled = judged.where("merged").groupBy("host", "parent").agg(
        F.sum("n").alias("mn"), F.sum("g").alias("mg"))
    judged = judged.join(pooled, ["host", "parent"], "left")
    n = F.when(F.col("merged"), F.col("mn")).otherwise(F.col("n"))
    g = F.when(F.col("merged"), F.col("mg")).otherwise(F.col("g"))
    return judged.select("host", "parent", "template", "merged",
                         ((g + PRIOR * every) / (n + PRIOR)).alias("purity"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] | None = None,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, template and purity of every row;
    ``labels`` has page_id and good."""
    rules = RULES if rules is None else rules
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"))
    good = labels.where("good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    known = stage(urls.join(good, "page_id", "left"), "known")
    rows = stage(templates(known), "urls")
    pure = broadcast_if_small(stage(purities(rows), "purities"))
    fit = rule_of(F.col("host"), F.col("path"), rules)
    return rows.join(pure, ["host", "parent", "template"], "left").withColumn("fit", fit).select(
        F.col("page_id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("purity") < PURITY, "block").otherwise("allow")).alias("verdict"),
        F.concat("host", "template").alias("template"), "purity")


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is good if the labels of its id call it neither toxic nor of low quality."""
    good = ((F.coalesce("toxic", F.lit(0)) == 0) & (F.coalesce("quality", F.lit(1)) == 1)).cast("int")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return judge(table(spark, sf_dir, "pages"), labels)


def _level_sql(k: int) -> str:
    return f"""
c{k} AS (SELECT host, template, parts[{k}] AS seg, count(*) AS n FROM r{k - 1}
         WHERE parts[{k}] IS NOT NULL GROUP BY ALL),
l{k} AS (SELECT host, template, seg FROM (
           SELECT *, sum(n) OVER (PARTITION BY host, template) AS whole FROM c{k})
         WHERE n >= {LEAST_ROWS} AND n >= {LEAST_SHARE} * whole),
r{k} AS (SELECT page_id, r.host, path, parts,
           CASE WHEN parts[{k}] IS NULL THEN parent ELSE r.template END AS parent,
           CASE WHEN parts[{k}] IS NULL THEN r.template ELSE r.template || '/' ||
             CASE WHEN l.seg IS NOT NULL THEN l.seg WHEN parts[{k}] = '' THEN ''
             ELSE '*' || regexp_extract(parts[{k}], '(\\.[A-Za-z0-9]{{1,5}})$', 1) END END AS template
         FROM r{k - 1} r LEFT JOIN l{k} l ON l.host = r.host AND l.template = r.template AND l.seg = parts[{k}]),"""


OP9_SQL = f"""
WITH r0 AS (
  SELECT page_id, host, path, string_split(ltrim(path, '/'), '/') AS parts, '' AS parent, '' AS template
  FROM (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)),
{"".join(_level_sql(k) for k in range(1, DEPTH + 1))}
t AS (SELECT page_id, host, path,
        CASE WHEN len(parts) > {DEPTH} THEN template ELSE parent END AS parent,
        CASE WHEN len(parts) > {DEPTH} THEN template || '/**' ELSE template END AS template FROM r{DEPTH}),
good AS (SELECT doc_id, min(CAST(coalesce(toxic, 0) = 0 AND coalesce(quality, 1) = 1 AS INT)) AS good
         FROM labels GROUP BY 1),
own AS (SELECT host, parent, template, count(good) AS n, coalesce(sum(good), 0) AS g
        FROM t LEFT JOIN good ON doc_id = page_id GROUP BY ALL),
base AS (SELECT coalesce(sum(g) / nullif(sum(n), 0), 1.0) AS p FROM own),
shares AS (SELECT *, sum(g) OVER w / greatest(sum(n) OVER w, 1) AS s FROM own
           WINDOW w AS (PARTITION BY host, parent)),
judged AS (SELECT *, abs(g - n * s) <= {Z} * sqrt(greatest(n * s * (1 - s), 0.25)) AS merged FROM shares),
pooled AS (SELECT *, sum(CASE WHEN merged THEN n END) OVER w AS mn, sum(CASE WHEN merged THEN g END) OVER w AS mg
           FROM judged WINDOW w AS (PARTITION BY host, parent)),
pure AS (SELECT host, parent, template,
           ((CASE WHEN merged THEN mg ELSE g END) + {PRIOR} * p) /
           ((CASE WHEN merged THEN mn ELSE n END) + {PRIOR}) AS purity FROM pooled, base),
fit AS (
  SELECT t.*, purity, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM t JOIN pure USING (host, parent, template))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN purity < {PURITY} THEN 'block' ELSE 'allow' END AS verdict,
       host || template AS template, purity
FROM fit
"""
