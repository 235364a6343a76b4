"""URL rules by a sort-merge range join over reversed-host keys (DataFrame functions only).

A host's canonical key is its labels in reverse order, each followed by a dot, so a rule host
and all its subdomains form one interval ``[key, key with its last dot raised)``. Rule intervals
nest like brackets. One sort brings the interval bounds and the urls into key order; each bound
carries the stack of rules that are active from there on, and a running ``last`` over the sorted
rows hands every url the stack that is active at its key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """Path: from the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A frame of rules from ``(host, path, verdict)`` triples."""
    if not rules:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("host", "path", "verdict")))
    rows = F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(("host", "path", "verdict"), r, strict=True))) for r in rules))
    return spark.range(1).select(F.inline(rows))


def _bounds(rules: DataFrame) -> DataFrame:
    """``(key, stack)``: from ``key`` on, up to the next bound, the rules in ``stack`` are active."""
    rules = rules.select(
        F.translate("host", UPPER, LOWER).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
    ).filter("rule_host <> ''")
    hosts = rules.select("rule_host").distinct()
    labels = F.split("rule_host", r"\.", -1)
    enclosing = hosts.select(
        F.col("rule_host").alias("bound_host"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))).alias("rule_host"),
    )
    active = enclosing.join(rules, "rule_host").groupBy("bound_host").agg(
        F.collect_list(F.struct("rule_host", "rule_path", "rule_verdict")).alias("stack")
    )
    key = host_key(F.col("bound_host"))
    opened = active.select(key.alias("key"), "stack")
    closed = active.select(
        F.concat(F.substr(key, F.lit(1), F.length(key) - 1), F.lit("/")).alias("key"),
        F.filter("stack", lambda r: r.rule_host != F.col("bound_host")).alias("stack"),
    )
    return opened.unionAll(closed)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", slices: int | None = None) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    ``rules`` has ``host, path, verdict``; a rule fits its host and every subdomain when the url's
    path starts with the rule's path, and the longest ``host+path`` wins (a tie: the longer host,
    then the greater path). Without a fitting rule ``rule`` is null and ``verdict`` is ``default``.
    Null urls and urls without ``://`` have an empty host and path, which no rule fits. Repeated
    pages give repeated rows; an empty table gives no rows; further columns are not read.

    The urls are dealt over ``slices`` by a hash of the row, never by host, so a host with a third
    of all pages is spread like the others; the bounds (two for each rule host) go to every slice.
    """
    spark = pages.sparkSession
    slices = slices or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rows = rows.select(
        F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(slices)).cast("int").alias("slice"),
        host_key(F.col("host")).alias("key"),
        F.lit(1).alias("kind"),
        "page_id", "host", "path",
        F.lit(None).cast("array<struct<rule_host:string,rule_path:string,rule_verdict:string>>").alias("stack"),
    )
    bounds = _bounds(rules).select(
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "key", F.lit(0).alias("kind"),
        F.lit(None).cast(dict(rows.dtypes)["page_id"]).alias("page_id"), F.lit("").alias("host"), F.lit("").alias("path"), "stack",
    )
    sweep = W.partitionBy("slice").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = rows.unionAll(bounds).withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    fitting = F.filter("active", lambda r: F.startswith(F.col("path"), r.rule_path))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(
        (F.length(r.rule_host) + F.length(r.rule_path)).alias("n"), F.length(r.rule_host).alias("h"),
        F.concat(r.rule_host, r.rule_path).alias("rule"), r.rule_verdict.alias("verdict"))))
    return swept.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
