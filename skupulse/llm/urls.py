"""URL filtering by hashed expressions.

Each URL expands into its host suffixes (the host and every parent domain)
times the prefixes of its path, in the lengths that rules have; expressions
join the rules on a short prefix of their SHA-256 digest, full digests confirm
the hits, and the longest rule decides.  URLs that no rule fits are allowed.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end.  A rule's path
must start the URL's path, literally.

Rules are broadcast while they are few (``BROADCAST_RULES``, counted first);
beyond, both sides are salted, as one parent domain may hold a third of all
rows.  DataFrame functions only.

Defined results: null urls, and urls without ``://``, have empty host and path
and fit no rule; of rules with the same expression the blocking one wins;
repeated rows are judged alike and all come back; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000
SHORT = 8                # hexadecimal digits of the digest that join
SALTS = 16               # for rule sets too large to broadcast
DEFAULT = "allow"

# Fixed values: (verdict, host, path) of the query's rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _after_scheme(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))


def host_of(url: str) -> Column:
    raw = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    known = (rules.select(F.col("verdict").alias("r_verdict"), F.concat("host", "path").alias("r_rule"),
                          F.length("path").alias("r_size"), F.sha2(F.concat("host", "path"), 256).alias("r_digest"))
             .withColumn("r_short", F.substring("r_digest", 1, SHORT)))
    # only prefixes as long as some rule's path can be one
    sizes = [r.r_size for r in known.select("r_size").distinct().orderBy("r_size").collect()]
    few = known.count() <= BROADCAST_RULES
    urls = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
            .groupBy("page_id", "url").agg(F.count("*").alias("rows")))
    urls = urls.select("page_id", "url", "rows", host_of("url").alias("host"), path_of("url").alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.lit(n) for n in sizes)).cast("array<int>"), lambda n: n <= F.length("path"))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))
    spread = (urls.withColumn("expression", F.explode_outer(F.when(F.col("host") != "", F.array_distinct(expressions))))
              .withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, SHORT)))
    on = F.col("short") == F.col("r_short")
    if few:
        hits = spread.join(F.broadcast(known), on, "left")
    else:
        salted = known.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = (spread.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
                .join(salted, on & (F.col("salt") == F.col("r_salt")), "left"))
    fits = F.col("digest") == F.col("r_digest")
    best = F.max(F.when(fits, F.struct(F.length("r_rule").alias("size"), F.col("r_verdict").alias("verdict"), F.col("r_rule").alias("rule"))))
    judged = hits.groupBy("page_id", "url").agg(F.first("rows").alias("rows"), F.first("host").alias("host"),
                                                F.first("path").alias("path"), best.alias("best"))
    return (judged.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("rows"))))
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")))


ORACLE = r"""
with u as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages
), p as (
  select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u
), r as (
  select * from (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                        ('block', 'net', '/es/'), ('block', 'net', '/fr/')) as t(verdict, rhost, rpath)
), f as (
  select p.page_id, p.host, p.path, rhost || rpath as rule, r.verdict, row_number() over (partition by p.page_id order by length(rhost || rpath) desc) as k
  from p left join r on (p.host = rhost or ends_with(p.host, '.' || rhost)) and starts_with(p.path, rpath)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from f where k = 1
"""
