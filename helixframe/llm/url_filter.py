"""URL filters by a sort-merge range join, in DataFrame operations only.

Canonical keys.  A host is written with its labels reversed and a dot after each (``com.example.``),
so a rule's host and all its subdomains are one interval of keys: from ``com.example.`` up to
``com.example/`` (``/`` follows ``.``).  Intervals of hosts nest or are apart.  A sweep in key order
therefore meets, at each point, a stack of active nested hosts: the host that opened last and its
ancestors.  Opening a host makes the rules of it and of its ancestors the active stack; closing it
brings back its parent's.  The stacks are made by joins of each host with its ancestors; the sweep
is a window over the sorted union of stack changes and urls, which carries the last stack to each url.
The url takes the first rule of its stack (longest host, then longest path) whose path its own path
starts with.

The window is dealt out by top-level label.  Labels that many urls share (a bounded number of them, which are
broadcast) are dealt out further, by a hash of the url into as many parts as the session shuffles to, so no host or label
fills a task; only their stack changes are repeated, in each part.  No url is compared with all rules.

Null urls and urls without ``://`` have an empty host and path and fit no rule.  Rows keep their
number: repeated urls and ids give repeated rows, null ids too.  Urls of any length are matched whole.  Null rules, or rules with a null host, path or
verdict, are left out; of repeated rules with the same host and path ``block`` wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Verdict where no rule fits.
DEFAULT = "allow"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def lower_ascii(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    """(host, path) of a url column."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def reversed_host(host):
    """``www.example.com`` -> ``com.example.www.``; an empty host stays empty."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def stack_changes(rules: DataFrame) -> DataFrame:
    """Where the sweep's stack changes: label, key, kind (0 close, 1 open) and the stack from there on."""
    own = (
        rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
        .dropna()
        .where("host <> ''")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # 'block' sorts after 'allow'
    )
    hosts = own.select("host").distinct().withColumn("labels", F.split("host", r"\."))
    climb = hosts.select(
        "host",
        F.posexplode(
            F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
        ).alias("up", "ancestor")
    )
    entry = F.struct(
        (-F.length("ancestor")).alias("h"), (-F.length("path")).alias("p"), F.col("path"), F.concat("ancestor", "path").alias("rule"), F.col("verdict")
    )
    joined = climb.join(own.withColumnRenamed("host", "ancestor"), "ancestor")
    stacks = joined.groupBy("host").agg(F.array_sort(F.collect_list(entry)).alias("stack"))
    parent = joined.where("up > 0").groupBy("host").agg(F.array_sort(F.collect_list(entry)).alias("outer"))
    both = stacks.join(parent, "host", "left").withColumn("key", reversed_host(F.col("host")))
    label = F.element_at(F.split("host", r"\."), -1).alias("label")
    opens = both.select(label, "key", F.lit(1).alias("kind"), "stack")
    shut = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    empty = F.slice("stack", 1, 0)
    closes = both.select(label, shut.alias("key"), F.lit(0).alias("kind"), F.coalesce("outer", empty).alias("stack"))
    return opens.unionByName(closes)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict for each row of pages (page_id, url)."""
    n = C.partitions(pages.sparkSession)
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", "url").select(
        "page_id", host.alias("host"), path.alias("path"), F.pmod(F.xxhash64("page_id", "url"), F.lit(n)).cast("int").alias("deal")
    )
    urls = urls.select("*", F.element_at(F.split("host", r"\."), -1).alias("label"), reversed_host(F.col("host")).alias("key"), F.lit(2).alias("kind"))
    limit = C.hot_limit(pages.count())
    hot = F.broadcast(urls.groupBy("label").count().where(F.col("count") > limit).select("label", F.lit(True).alias("hot")))  # at most C.HOT_KEYS
    urls = urls.join(hot, "label", "left").withColumn("part", F.when(F.col("hot"), F.col("deal")).otherwise(F.lit(0))).drop("hot", "deal")
    changes = stack_changes(rules).join(hot, "label", "left")
    parts_ = F.sequence(F.lit(0), F.when(F.col("hot"), F.lit(n - 1)).otherwise(F.lit(0)))
    changes = changes.withColumn("part", F.explode(parts_)).drop("hot")
    swept = urls.unionByName(changes, allowMissingColumns=True)
    order = Window.partitionBy("label", "part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = swept.withColumn("active", F.last("stack", ignorenulls=True).over(order)).where("kind = 2")
    fit = F.get(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    return active.withColumn("fit", fit).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict")
    )


def rules_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), literal_rules(spark))


def literal_rules(spark, rules=RULES) -> DataFrame:
    """The rules as a plan of literals: no Python data reaches the executors."""
    out = None
    for v, h, p in rules:
        one = spark.range(1).select(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path"))
        out = one if out is None else out.unionByName(one)
    return out


OP10_SQL = r"""
with u as (
  select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), p as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), r(verdict, rhost, rpath) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), f as (
  select *, (
    select max(struct_pack(h := length(rhost), p := length(rpath), rule := rhost || rpath, verdict := verdict)) from r
    where (p.host = rhost or ends_with(p.host, '.' || rhost)) and starts_with(p.path, rpath)
  ) as best from p
)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from f
"""
