"""URL filter lists: allow and block rules of a host and a path prefix.

Each URL is expanded into expressions: every suffix of its host at a dot (the host itself first), each with
every prefix of its path that is as long as some rule's path. Expressions are joined with the rules on a short
hash prefix; the full digest confirms what meets, so a clash of prefixes does no harm. Of the rules that
fit the longest wins, and among equally long ones the longer host, then a block.

Only native expressions are used. URLs are expanded and joined once for each distinct site part (host and as
much of the path as rules read), so a site with a third of the pages costs as much as any other; the
rules are broadcast if a count proves them small, else the join is shuffled and salted. Pages then get the rule of their
site part by a broadcast of a counted size, or by a join that deals the pages of a hot site to several tasks.

Defined results: null URLs and those without `://` have an empty host and path, and fit no rule; hosts keep their port
and user part; only A-Z are lower-cased, in hosts only; repeated rows get equal results; without a fitting rule the verdict
is the default; a rule with null or empty host or null path fits nothing; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortloom.llm.common import BROADCAST_ROWS, ascii_lower, hot_join, kept, table

#: Hexadecimal digits of the short prefix; rules up to which they are broadcast; salts of a shuffled join.
PREFIX, BROADCAST_RULES, SALTS = 8, 50_000, 16
#: The rules of the registered query: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    tail = F.substr(rest, F.length(host) + 1)
    path = F.substring_index(F.substring_index(tail, "?", 1), "#", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    rows = ", ".join("('" + "', '".join(x.replace("\\", "\\\\").replace("'", "\\'") for x in r) + "')" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS r(host, path, verdict)")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages (page_id, url). rules: host, path, verdict."""
    known = rules.where("host <> '' and path is not null and verdict is not null").select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    known = kept(known.distinct())
    sizes = sorted(r[0] for r in known.select(F.length("rule_path")).distinct().collect())  # no more than the longest path has characters
    n_rules = known.count()
    urls = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url"))
    host, path = host_and_path(F.col("url"))
    parts = urls.select("page_id", host.alias("host"), path.alias("path"))
    read = F.substr(F.col("path"), F.lit(1), F.lit(max(sizes, default=0)))
    parts = parts.withColumn("site_path", read)

    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("site_path") >= n, F.substr(F.col("site_path"), F.lit(1), F.lit(n))) for n in sizes] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    sites = parts.where("host <> ''").select("host", "site_path").distinct()
    each = sites.select("host", "site_path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("host", "site_path", "suffix", F.explode("prefixes").alias("prefix"))
    each = each.withColumn("full", digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substr(F.col("full"), F.lit(1), F.lit(PREFIX)))
    listed = known.withColumn("rule_full", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("rule_short", F.substr(F.col("rule_full"), F.lit(1), F.lit(PREFIX)))
    meets = (F.col("short") == F.col("rule_short")) & (F.col("full") == F.col("rule_full"))
    if n_rules <= BROADCAST_RULES:
        joined = each.join(F.broadcast(listed), meets)
    else:
        salted = each.withColumn("salt", F.pmod(F.xxhash64("host", "site_path"), F.lit(SALTS)))
        copies = listed.withColumn("rule_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        joined = salted.join(copies, meets & (F.col("salt") == F.col("rule_salt")))
    joined = joined.where((F.col("suffix") == F.col("rule_host")) & (F.col("prefix") == F.col("rule_path")))
    order = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("rule_verdict") == "block", "rule_host", "rule_path")
    best = joined.groupBy("host", "site_path").agg(F.max(F.struct(order.alias("o"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("x"))
    best = kept(best.select("host", "site_path", "x.rule", "x.verdict"))
    on = ["host", "site_path"]
    found = parts.join(F.broadcast(best), on, "left") if best.count() <= BROADCAST_ROWS else hot_join(parts, best, on, "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h0 FROM u),
p AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(h0) + 1), '^[^?#]*') AS path FROM h),
k(rh, rp, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(verdict, length(rh || rp)) AS verdict FROM p JOIN k ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT p.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
