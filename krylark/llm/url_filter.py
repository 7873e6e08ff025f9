"""URL rules by expansion: host suffixes and path prefixes are joined to the rules on short hash prefixes.

Native: DataFrame functions only.  A URL is expanded once for each *shape* (number of host labels, length of
path) that occurs in the rules, not for every possible suffix and prefix, so the expansion is bounded by the
rule table.  The join is on the first eight digits of a SHA-256; the whole digest is compared afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Rules are broadcast up to this many rows (a counted bound); beyond it both sides are shuffled with a salt.
BROADCAST_RULES = 100_000
SALTS = 16


def url_parts(url):
    """(host, path) columns; null or no ``://``: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format(f"`{url}`" if isinstance(url, str) else "url"))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: id, host, path, the rule that wins (or null) and the verdict.

    ``rules``: host, path, action (``allow`` or ``block``).  A rule fits its host and every subdomain if the path
    starts with the rule's; the longest wins, then the one with the longer host, then ``block``.  Rows whose url is
    null or has no ``://`` have an empty host and path and get the default; an empty table gives an empty result;
    repeated rows and null ids stay as they are; other columns of ``pages`` are ignored, whatever their names.
    """
    rules = rules.select(lower_ascii("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("action").alias("rule_action")).where("rule_host is not null and rule_action is not null").distinct()
    shapes = rules.select(F.size(F.split("rule_host", "\\.")).alias("labels"), F.length("rule_path").alias("chars")).distinct().collect()
    n_rules = rules.limit(BROADCAST_RULES + 1).count()

    host, path = url_parts(url_col)
    df = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("rid", F.monotonically_increasing_id())
    if not shapes:
        return df.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", "\\.")
    df = df.withColumn("labels", labels)
    exprs = F.array(*[
        F.when((F.size("labels") >= s.labels) & (F.length("path") >= s.chars), F.concat(F.array_join(F.slice("labels", F.size("labels") - s.labels + 1, s.labels), "."), F.substring("path", 1, s.chars)))
        for s in shapes
    ])
    df = df.select("rid", "id", "host", "path", F.explode_outer(F.filter(exprs, lambda x: x.isNotNull())).alias("expression")).withColumn("digest", F.sha2("expression", 256)).withColumn("prefix", F.substring("digest", 1, 8))
    text = F.concat("rule_host", "rule_path")
    right = rules.select(text.alias("rule"), F.length("rule_host").alias("host_chars"), "rule_action", F.sha2(text, 256).alias("rule_digest")).withColumn("rule_prefix", F.substring("rule_digest", 1, 8))
    if n_rules <= BROADCAST_RULES:
        joined = df.join(F.broadcast(right), F.col("prefix") == F.col("rule_prefix"), "left")
    else:
        right = right.withColumn("rule_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        joined = df.withColumn("salt", (F.col("rid") % SALTS).cast("int")).join(right, (F.col("prefix") == F.col("rule_prefix")) & (F.col("salt") == F.col("rule_salt")), "left")
    hit = F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length("rule").alias("chars"), "host_chars", (F.col("rule_action") == "block").alias("blocks"), "rule", "rule_action"))
    best = joined.groupBy("rid").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(hit).alias("best"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_action", F.lit(default)).alias("verdict"))
