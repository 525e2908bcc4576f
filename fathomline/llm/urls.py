"""URL rules by hashed expressions: a URL becomes its host suffixes times its path prefixes, met by equality on hash prefixes.

Only DataFrame functions. An expression is hashed with SHA-256; rules and URLs meet on the first four bytes, and the full digest
confirms. Of the rules that fit, the longest (host and path together, then host, then block before allow) wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER

PREFIX_HEX = 8
DEFAULT = "allow"            # the verdict where no rule fits
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """verdict, rule_host, rule_path of a list of rules."""
    if not rules:
        return spark.sql("SELECT '' AS verdict, '' AS rule_host, '' AS rule_path WHERE false")
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"          # noqa: E731
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({', '.join(map(quoted, r))})" for r in rules) + " AS r(verdict, rule_host, rule_path)")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty for null or where there is no ://."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    part = lambda k: F.regexp_extract(u, "(?s)^.*?://([^/?#]*)([^?#]*)", k)               # noqa: E731
    return F.translate(part(1), UPPER, LOWER), part(2)


def judged(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """Every row of `urls` with host, path, rule (host and path of the winning rule, or null) and verdict.

    `rules`: verdict (allow or block), rule_host, rule_path; hosts are compared A-Z lower-cased, a rule with a null or an empty
    host or a null path never fits. Rules said twice count once. Repeated rows of `urls` stay; nulls in other columns are kept;
    columns called host, path, rule or verdict are refused. Empty tables on either side are fine. Host suffixes are made only up
    to the most labels that a rule's host has, path prefixes at slashes up to the deepest rule and at the lengths of those rule
    paths that end in no slash, so that a hostile URL does not multiply.
    """
    if bad := [c for c in ("host", "path", "rule", "verdict") if c in urls.columns]:
        raise ValueError(f"the rows already have {bad}")
    digest = lambda h, p: F.sha2(F.concat(h, F.lit("\n"), p), 256)                        # noqa: E731
    r = (rules.select(F.lower("verdict").alias("v"), F.translate("rule_host", UPPER, LOWER).alias("h"), F.col("rule_path").alias("p"))
         .where("h <> '' AND p IS NOT NULL AND v IS NOT NULL").groupBy("h", "p").agg(F.max("v").alias("v")))
    shape = r.agg(F.max(F.size(F.split("h", "\\."))).alias("labels"), F.max(F.size(F.split("p", "/"))).alias("depth"),
                  F.sort_array(F.collect_set(F.when(~F.col("p").endswith("/"), F.length("p")))).alias("lengths")).first()
    labels, depth = shape.labels or 0, shape.depth or 0
    host, path = host_and_path(F.col(f"`{url_col}`"))
    a = urls.select(F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("given"), F.monotonically_increasing_id().alias("row"),
                    host.alias("host"), path.alias("path"))
    # the last k labels of the host; the path up to its k-th slash, and at the odd lengths
    host_parts = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(host_parts), F.lit(max(labels, 1)))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    slashes = F.size(F.split("path", "/")) - 1
    prefixes = F.when(slashes > 0, F.transform(F.sequence(F.lit(1), F.least(slashes, F.lit(max(depth, 1)))),
                                               lambda k: F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), k), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    odd = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in shape.lengths]).cast("array<string>")
    prefixes = F.array_distinct(F.filter(F.concat(prefixes, odd), lambda x: x.isNotNull()))
    a = a.select("*", suffixes.alias("hs"), prefixes.alias("ps"))
    said = a.select("row", "given", "host", "path", F.explode_outer("hs").alias("xh"), "ps").select("*", F.explode_outer("ps").alias("xp"))
    said = said.select("row", "given", "host", "path", digest(F.col("xh"), F.col("xp")).alias("full"))
    known = r.select("v", "h", "p", digest(F.col("h"), F.col("p")).alias("r_full"))
    # rows meet on the short prefix alone; what met by chance is no rule that fits
    met = said.join(known, F.substring("full", 1, PREFIX_HEX) == F.substring("r_full", 1, PREFIX_HEX), "left")
    rank = F.when(F.col("full") == F.col("r_full"), F.struct(F.length(F.concat("h", "p")), F.length("h"), F.col("v"), F.concat("h", "p").alias("rule")))
    best = met.groupBy("row").agg(F.first("given").alias("given"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(rank).alias("best"))
    return best.select("given.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))


ORACLE = f"""
WITH u AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)) AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(v, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
m AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS k
      FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM m WHERE k = 1
"""
