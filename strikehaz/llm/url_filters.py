"""URL filters: a sort-merge range join of reversed-host keys with nested prefix rules.

A rule (host, path) covers the interval of all keys that begin with its own key.  Intervals
of prefixes are nested or apart, never crossing.  Rule starts, rule ends and page keys are sorted
together; a running sum of +1 / -1 is the height of the stack of open rules at each place,
and the rule on top of it is the last start at that height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikehaz.llm.common import LOWER, UPPER, stored

START, PAGE, END = 0, 1, 2


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    """Reversed labels joined by / (not in hosts), then ? (in neither part), then the path; as bytes."""
    return F.concat(F.array_join(F.reverse(labels), "/"), F.lit("?"), path).cast("binary")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows of a written rule list."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict): one row for each page.

    A rule fits its host and all subdomains if the page's path begins with the rule's path;
    the longest rule (characters of host and path, then of the host, then the text) wins.
    Pages without a fitting rule, with a null URL or without :// get a null rule and the
    default verdict.  A rule without a host fits nothing; of two rules with the same host
    and path the blocking one holds.  Repeated pages get a row each.  Other columns of the
    tables are not read.

    Pages are reduced to distinct (host, path) before the sweep.  Keys are dealt out by
    sorted range, the place of a key being settled by host and path, so one host with any
    share of the pages spreads over many ranges; the open rules at the start of a range
    come from a table with one row for each range and height.
    """
    given = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = (
        rules.where("host <> ''").select(
            F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("labels", F.split("host", r"\."))
    )
    deepest = known.agg(F.max(F.size("labels"))).first()[0] or 0  # one number: longer hosts' extra labels fit no rule
    rule = F.struct(
        F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict")
    none = F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")
    starts = known.select(_key(F.col("labels"), F.col("path")).alias("key"), F.lit(START).alias("kind"), rule.alias("rule"), F.lit("").alias("host"), F.lit("").alias("path"))
    ends = starts.select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(END).alias("kind"), none.alias("rule"), "host", "path")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(deepest, 1)))), lambda n: F.slice(labels, -n, n))
    keys = (
        given.where("host <> ''").select("host", "path").distinct()
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .select(_key(F.col("suffix"), F.col("path")).alias("key"), F.lit(PAGE).alias("kind"), none.alias("rule"), "host", "path")
    )
    events = stored(
        starts.unionByName(ends).unionByName(keys).repartitionByRange("key", "kind", "host", "path").withColumn("bucket", F.spark_partition_id()))
    best = _swept(events).groupBy("host", "path").agg(F.max("top").alias("top"))
    return given.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


def _swept(events: DataFrame) -> DataFrame:
    """(host, path, top): the innermost rule open at each page key that lies in any."""
    order = ["key", "kind"]
    step = F.when(F.col("kind") == START, 1).when(F.col("kind") == END, -1).otherwise(0)
    so_far = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    opened = events.groupBy("bucket").agg(F.sum(step).alias("net")).select("bucket", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("open"))
    deep = events.withColumn("height", F.sum(step).over(so_far)).join(opened, "bucket").withColumn("height", F.col("height") + F.col("open"))
    deep = deep.where((F.col("kind") != END) & (F.col("height") > 0))
    level = Window.partitionBy("bucket", "height").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = deep.withColumn("top", F.last("rule", ignorenulls=True).over(level)).where(F.col("kind") == PAGE).select("bucket", "height", "host", "path", "top")

    lasts = deep.where(F.col("kind") == START).groupBy("bucket", "height").agg(F.max_by("rule", "key").alias("rule")).withColumn("at", F.lit(1))
    asked = seen.where("top IS NULL").select("bucket", "height").distinct().select("bucket", "height", F.lit(None).cast(lasts.schema["rule"].dataType).alias("rule"), F.lit(0).alias("at"))
    earlier = Window.partitionBy("height").orderBy("bucket", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = lasts.unionByName(asked).withColumn("carried", F.last("rule", ignorenulls=True).over(earlier)).where("at = 0").select("bucket", "height", "carried")
    return seen.join(carried, ["bucket", "height"], "left").select("host", "path", F.coalesce("top", "carried").alias("top"))
