"""Allow and block rules for URLs by host suffix and path prefix.

Each URL is expanded into expressions: its host and parent domains, with the
prefixes of its path that have the length of some rule's path. Expressions meet
rules by equality of a short prefix of their digest, full digests confirm, and
the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.llm.columns import col, packed, unpacked
from gyre.session import materialize, sized

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that the join is on.
SHORT = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end. Both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_table(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict) with their text, digest and rank. Host names are lower-cased, a null path is empty, a null host is no rule.

    Equal rules count once; of equal ones that differ in verdict, block stands.
    """
    host = F.translate("host", _UPPER, _LOWER)
    made = rules.where("host is not null").select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    made = made.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
    rule = F.concat("host", "path")
    return made.select(rule.alias("rule"), "verdict", F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length"), F.length(rule).alias("rank"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest rule (host and path together) wins, of equally long ones the one
    that blocks, then the last by text. Null urls and urls without `://` have an
    empty host and path, which no rule fits; equal rows have equal results;
    columns of pages with the outputs' names (without case) are replaced.

    Distinct (host, path) pairs are expanded, so that a hot one costs one row.
    """
    table = materialize(rule_table(rules), "rules")
    # the shapes that rules have: at most as many as label counts and path lengths occur
    shapes = table.agg(F.collect_set("labels").alias("labels"), F.collect_set("path_length").alias("lengths")).first()
    labels, lengths = (F.array(*[F.lit(int(x)) for x in sorted(v)]) if v else F.array().cast("array<int>") for v in shapes)
    host, path = host_and_path(col(url_col))
    named, own = packed(pages, ("host", "path", "rule", "verdict"), host=host, path=path)
    pairs = named.where("host <> ''").select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.filter(labels, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = pairs.select("host", "path", F.explode(suffixes).alias("suffix")).select("host", "path", "suffix", F.explode(prefixes).alias("prefix"))
    digest = F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256)
    expressions = expressions.select("host", "path", digest.alias("full")).withColumn("short", F.substring("full", 1, SHORT))
    hits = expressions.join(sized(table.withColumn("short", F.substring("digest", 1, SHORT))), "short").where("full = digest")
    best = F.max_by(F.struct("rule", "verdict"), F.struct("rank", "verdict", "rule"))
    found = hits.groupBy("host", "path").agg(best.alias("b"))
    out = named.join(found, ["host", "path"], "left")
    return out.select(*unpacked(own), "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(otherwise)).alias("verdict"))
