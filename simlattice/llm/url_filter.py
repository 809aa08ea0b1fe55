"""URL filters by hashed expressions.

A url is expanded into expressions: the suffixes of its host with as many labels as some rule's host, with every prefix
of its path that is as long as some rule's path, so their number is bounded by the rules, however long a host is. Rules and expressions meet on the first four bytes of the expression's SHA-256, a short prefix that
keeps the join key small; full digests then confirm a match. The longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the contract: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
NO_RULE = "allow"
PREFIX_HEX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1),
                       _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    host = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    after = _rest(url).substr(F.length(host) + 1, F.length(_rest(url)))
    return F.substring_index(F.substring_index(after, "?", 1), "#", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(h, p, v) for h, p, v in rules], "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                no_rule: str = NO_RULE) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``.

    ``rules(host, path, verdict)`` fit their host and all its subdomains where the url's path starts with the rule's.
    Of the rules that fit, the longest host and path together win, then the longer host, then ``block``; rules with a
    null or empty host or a null path or verdict take no part. Null urls and urls without ``://`` have an empty host
    and path and no rule; without a rule the verdict is ``no_rule``. Repeated rows and null identifiers are each
    judged. Other columns are ignored; an empty table gives an empty result, an empty rule table no rules.
    """
    ruled = rules.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"),
                         "verdict").filter("rule_host <> '' AND rule_path IS NOT NULL AND verdict IS NOT NULL")
    full = _digest(F.col("rule_host"), F.col("rule_path"))
    best = Window.partitionBy("rule_host", "rule_path").orderBy(F.col("verdict") != "block", "verdict")
    ruled = ruled.withColumn("nth", F.row_number().over(best)).filter("nth = 1").select(
        F.substring(full, 1, PREFIX_HEX).alias("short"), full.alias("digest"), "rule_host", "rule_path",
        F.col("verdict").alias("rule_verdict"))
    # the distinct lengths of rule paths and label counts of rule hosts, scalars of the plan
    lengths = ruled.agg(F.collect_set(F.length("rule_path"))).scalar()
    labels = ruled.agg(F.collect_set(F.size(F.split("rule_host", r"\.")))).scalar()

    url = F.coalesce(F.col(url_col), F.lit(""))
    judged = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"),
                          url_host(url).alias("host"), url_path(url).alias("path"))
    dots = F.length("host") - F.length(F.translate("host", ".", ""))
    judged = judged.withColumn("lengths", lengths).withColumn("labels", labels).withColumn("dots", dots)
    suffixes = F.transform(F.filter("labels", lambda c: c <= F.col("dots") + 1),
                           lambda c: F.call_function("substring_index", F.col("host"), F.lit("."), -c))
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")),
                           lambda n: F.substring("path", F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    expressions = F.when(F.col("host") != "", expressions)
    # all expressions of a url stay in its partition, so grouping by its number sends one row a url
    expanded = judged.select("row", "page_id", "host", "path", F.explode_outer(expressions).alias("expression"))
    met = expanded.join(ruled, (F.substring("expression", 1, PREFIX_HEX) == F.col("short"))
                        & (F.col("expression") == F.col("digest")), "left")
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host"),
                    (F.col("rule_verdict") == "block").alias("blocks"),
                    F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    won = met.groupBy("row", "page_id", "host", "path").agg(
        F.max(F.when(F.col("digest").isNotNull(), rank)).alias("won"))
    return won.select("page_id", "host", "path", F.col("won.rule").alias("rule"),
                      F.coalesce(F.col("won.verdict"), F.lit(no_rule)).alias("verdict"))
