"""URL allow and block rules by a range join over reversed-host keys, without Python on the executors.

A rule is (host, path, verdict). It fits its host and every subdomain if the url's path starts with the rule's
path; the longest rule string wins, then the longer host, then ``block``. A url without a fitting rule gets the
default verdict.

Method: sort-merge range join. A canonical key is the host's labels in reverse order, a zero byte, then the path.
With the host held fixed a rule is a prefix of the keys it fits, so it opens an interval at its key and closes it
at key + 0xFF, a byte that UTF-8 never holds. A url is looked up at each of its ancestor hosts that has rules (as
many levels as the longest rule host has labels). Openings, probes and closings of one ancestor host are sorted
together; the number of intervals open at an event is the height of the stack of nested rules, and the most recent
opening at that height is the stack's top, which is the longest rule that fits at this level.

Skew: equal urls are judged once, and the verdict of a url that many rows have is copied to several tasks that these are
dealt to, as are null urls. An ancestor host with many probes is dealt to several salted sweeps, and its
rules are copied to each of them; a sweep gets at least four times as many probes as there are rules to copy, so
that the copies never outweigh the probes.

Cases: null urls and urls without ``://`` have an empty host and path and get the default verdict; empty hosts
match nothing. Repeated rows each keep their own result row. Rules that repeat count once; of two rules with one
host and path, ``block`` holds. Empty tables give empty results, and no rules give every url the default verdict.
Further columns of the input are not returned; their names may clash with none of ours because only the id and the
url are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import ascii_lower, load, spread

#: The rules of the registered query: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
RULE_TYPE = "host string, path string, verdict string"
#: Probes of one salted sweep, at the least.
SWEEP = 512


def split_url(url):
    """(host, path) columns of a url column."""
    host = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _key(host, path):
    """Canonical key: reversed labels, a zero byte, the path; as bytes, which sort as their code points do."""
    return F.encode(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("\0"), path), "UTF-8")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", sweep: int = SWEEP) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages; see the module's text."""
    rules = (
        rules.select(ascii_lower("host").alias("level"), F.coalesce("path", F.lit("")).alias("rpath"), "verdict")
        .where("level <> ''").groupBy("level", "rpath").agg(F.max(F.struct(F.col("verdict") == "block", "verdict"))["verdict"].alias("verdict"))
    )
    per_host = rules.groupBy("level").agg(F.count(F.lit(1)).alias("n_rules"))
    most = rules.agg(F.max(F.size(F.split("level", r"\.")))).first()[0]  # one number

    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    host, path = split_url(F.col("_url"))
    urls = rows.where("_url is not null").select("_url").distinct().select("_url", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    probes = (
        urls.where("host <> ''")
        .select("_url", "path", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most or 1))), lambda n: F.array_join(F.slice(labels, -n, n), "."))).alias("level"))
    )
    load_of = probes.join(per_host, "level").groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.first("n_rules").alias("n_rules"))
    plan = load_of.select("level", F.ceil(F.col("n") / F.greatest(F.lit(sweep), 4 * F.col("n_rules"))).cast("int").alias("salts"))

    probe = probes.join(plan, "level").select(
        "level", F.pmod(F.xxhash64("_url"), F.col("salts")).cast("int").alias("salt"), _key(F.col("level"), F.col("path")).alias("key"), F.lit(1).alias("kind"), "_url",
        F.lit(None).cast("struct<size:int,host_size:int,verdict:string,rule:string>").alias("open"),
    )
    name = F.concat("level", "rpath")
    opened = rules.join(plan, "level").select(
        "level", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), _key(F.col("level"), F.col("rpath")).alias("key"),
        F.struct(F.length(name).alias("size"), F.length("level").alias("host_size"), F.col("verdict").alias("verdict"), name.alias("rule")).alias("open"),
    )
    # one row opens and one closes each rule
    edges = opened.select("level", "salt", F.explode(F.array(
        F.struct(F.col("key").alias("key"), F.lit(0).alias("kind"), F.col("open").alias("open")),
        F.struct(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"), F.lit(None).cast("struct<size:int,host_size:int,verdict:string,rule:string>").alias("open")),
    )).alias("e")).select("level", "salt", "e.key", "e.kind", F.lit(None).cast("string").alias("_url"), "e.open")
    events = probe.unionByName(edges)
    swept = Window.partitionBy("level", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    slot = Window.partitionBy("level", "salt", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    height = F.sum(F.when(F.col("kind") == 0, 1).when(F.col("kind") == 2, -1).otherwise(0)).over(swept)
    top = (
        events.withColumn("height", height).where("kind < 2")
        .withColumn("top", F.last("open", ignorenulls=True).over(slot))
        .where("kind = 1 and height > 0").select("_url", "top")
    )
    best = top.groupBy("_url").agg(F.max("top").alias("top"))  # size, then the host's size settle it: equal ones are one rule
    host, path = split_url(F.col("_url"))
    return spread(rows, best, "_url", "left").select(
        F.col("_id").alias(id_col), host.alias("host"), path.alias("path"), F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every url of pages against RULES."""
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES) + " AS rules(host, path, verdict)")
    return judge_urls(load(spark, sf_dir, "pages"), rules)


ORACLE = r"""
WITH rules(host, path, verdict) AS (VALUES ('org','/','allow'),('example.org','/es/','block'),('example.org','/en/1','block'),('com','/fr/','allow'),('com','/de/','block')),
u AS (SELECT page_id, row_number() OVER () AS i,
  coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT u.i, arg_max(r.host || r.path, 100000 * length(r.host || r.path) + length(r.host)) AS rule, arg_max(r.verdict, 100000 * length(r.host || r.path) + length(r.host)) AS verdict
  FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.i)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (i)
"""
