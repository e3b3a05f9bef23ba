"""Operator 5, URL filters: nested allow and block rules by a sort-merge range join.

A rule (host, path, verdict) fits its host and every subdomain, when the url's path starts with the
rule's. Hosts become canonical keys with their labels reversed (``example.net`` -> ``net.example.``), so
that a host and its subdomains form one interval of keys. The rules' interval ends are events that carry
the stack of rules open from there on; urls and events are sorted together, and a running ``last`` hands
each url the stack at its place. The paths of the open rules decide which fit; the longest wins.

Everything is DataFrame functions. Rows are dealt by a hash of the row, not by host, so that a hot host
does not gather in one task; each share of rows gets its own copy of the events, two for a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, shuffle_partitions

#: Fixed values of the query's contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_key(host: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def interval_events(rules: DataFrame) -> DataFrame:
    """(key, stack): the rules that are open from this key on. A host's interval is [key, key with its
    last dot raised to a slash); intervals nest or are disjoint, so the stack at a host's start is the rules
    of the host and its parent domains, and at its end those of the parents alone."""
    rule = rules.where("host is not null and path is not null and verdict is not null").select(
        canonical_key(ascii_lower(F.col("host"))).alias("rule_key"),
        F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("n_host"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("open"),
    )
    hosts = rule.select("rule_key").distinct()
    labels = F.split(F.expr("substring(rule_key, 1, length(rule_key) - 1)"), r"\.")
    parents = hosts.select("rule_key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.concat_ws(".", F.slice(labels, 1, i)), F.lit(".")))).alias("parent"))
    opened = parents.join(rule.withColumnRenamed("rule_key", "parent"), "parent")
    stacks = opened.groupBy("rule_key").agg(F.array_sort(F.collect_list("open")).alias("at_start"), F.array_sort(F.collect_list(F.when(F.col("parent") != F.col("rule_key"), F.col("open")))).alias("at_end"))
    return stacks.select(F.col("rule_key").alias("key"), F.col("at_start").alias("stack")).union(
        stacks.select(F.concat(F.expr("substring(rule_key, 1, length(rule_key) - 1)"), F.lit("/")), "at_end")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", shares: int | None = None) -> DataFrame:
    """One row per input row: id_col, host, path, rule (null where none fits), verdict.

    Null urls and urls without ``://`` have an empty host and path and get the default verdict. Equal
    rules, ties of length: the longer host wins, then the greater rule string, then block. Repeated rows
    are judged one by one; other columns are ignored. ``shares``: how many groups the rows are dealt to,
    by default four for each shuffle partition."""
    shares = shares or 4 * shuffle_partitions(pages.sparkSession)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.pmod(F.xxhash64(F.col(id_col), url), F.lit(shares)).alias("share"))
    rows = rows.withColumns({"key": canonical_key(F.col("host")), "is_row": F.lit(1)})
    events = interval_events(rules).select("key", "stack", F.lit(0).alias("is_row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"))
    swept = rows.unionByName(events, allowMissingColumns=True)
    order = Window.partitionBy("share").orderBy("key", "is_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = swept.withColumn("open", F.last("stack", ignorenulls=True).over(order)).where("is_row = 1")
    best = F.array_max(F.transform(F.filter("open", lambda r: F.startswith(F.col("path"), r["path"])), lambda r: F.struct(r["n"], r["n_host"], r["rule"], r["verdict"])))
    return swept.withColumn("best", best).select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")
