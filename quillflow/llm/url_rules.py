"""URL filters: pattern rules that are indexed by their rarest literal token.

A rule is (rule, action). Two forms:

* site rules ``host/path``: the host itself or any subdomain, and a path that starts with the path
  (case of the path counts);
* patterns over ``host + rest of the url`` in lower case: ``*`` stands for anything, a leading
  ``||`` for the start of the host or of one of its labels; without it a pattern begins anywhere.

A literal token is a run of letters and digits that the rule bounds on both sides, so it must
be a whole token of every url that the rule fits. Each rule is filed under the one of its tokens that
the fewest urls have (counted over the table); the tokens of a url fetch candidate rules, and only
their regular expressions run. Rules without such a token are candidates of every url.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import UPPER, lower_ascii, stored

# Rules up to this number are broadcast (some hundred bytes each); more are joined by token.
BROADCAST_RULES = 100_000

# Default patterns for urls that no site rule fits.
PATTERNS = (
    ("||spam-farm.", "block"),
    ("/wp-login.php", "block"),
    ("/cgi-bin/", "block"),
    ("?sessionid=", "block"),
    ("||ads.", "block"),
)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_\x80-\U0010ffff])", r"\\\1", text)


def _lower(text: str) -> str:
    return text.translate(str.maketrans(UPPER, UPPER.lower()))


def site_regex(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return r"^(?:[^/]*\.)?" + _quoted(_lower(host) + slash + path)


def pattern_regex(rule: str) -> str:
    start, rest = (r"^(?:[^/]*\.)?", rule[2:]) if rule.startswith("||") else ("", rule)
    return "(?s)" + start + ".*".join(_quoted(p) for p in _lower(rest).split("*"))


def literal_tokens(rule: str, site: bool) -> list[str]:
    """Runs of letters and digits with another character (or the start of a label) on both sides."""
    anchored = site or rule.startswith("||")
    text = _lower(rule.removeprefix("||"))
    found = []
    for m in re.finditer(r"[a-z0-9]+", text):
        left = m.start() > 0 and text[m.start() - 1] != "*" or m.start() == 0 and anchored
        right = m.end() < len(text) and text[m.end()] != "*"
        if left and right and all(ord(c) < 128 for c in text[max(0, m.start() - 1):m.end() + 1]):
            found.append(m.group())
    return sorted(set(found))


def rule_table(spark, sites, patterns) -> DataFrame:
    """(kind, rule, action, regex, tokens) of all rules, made of literals."""
    rows = [("site", rule, action, site_regex(rule), literal_tokens(rule, True)) for rule, action in sites]
    rows += [("pattern", rule, action, pattern_regex(rule), literal_tokens(rule, False)) for rule, action in patterns]
    return spark.createDataFrame(
        rows, "kind string, rule string, action string, regex string, tokens array<string>")


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """host, path and rest (from the end of the host on); empty for null or a url without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return (lower_ascii(F.regexp_extract(text, r"://([^/?#]*)", 1)),
            F.regexp_extract(text, r"://[^/?#]*([^?#]*)", 1),
            F.regexp_extract(text, r"(?s)://[^/?#]*(.*)", 1))


def judge_urls(pages: DataFrame, sites, patterns=PATTERNS, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url).

    ``rule`` is the longest site rule that fits (of equal lengths the greater text), else null. The
    verdict is its action, else the longest fitting pattern's, else ``default``. Null urls and urls
    without ``://`` have an empty host and path and fit no site rule. Repeated rows are judged
    alike; other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    rules = rule_table(spark, sites, patterns)
    small = len(sites) + len(patterns) <= BROADCAST_RULES
    side = F.broadcast if small else lambda df: df
    host, path, rest = url_parts(F.col("url"))
    urls = pages.where("url IS NOT NULL").select("url").distinct().select(
        "url", host.alias("host"), path.alias("path"), rest.alias("rest"))
    tokens = F.array_distinct(F.concat(
        F.array(F.lit("")), F.split(lower_ascii(F.concat("host", "rest")), "[^a-z0-9]+")))
    urls = stored(urls.withColumn("tokens", tokens), "urls")
    literals = rules.select("kind", "rule", F.explode("tokens").alias("token"))
    counts = urls.select(F.explode("tokens").alias("token")).join(
        side(literals.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    rarest = literals.join(counts, "token", "left").groupBy("kind", "rule").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)), "token"))["token"].alias("token"))
    index = rules.join(rarest, ["kind", "rule"], "left").select(
        "kind", "rule", "action", "regex", F.coalesce("token", F.lit("")).alias("token"))
    target = F.when(F.col("kind") == "site", F.concat("host", "path")).otherwise(lower_ascii(F.concat("host", "rest")))
    best = F.struct(F.length("rule").alias("size"), "rule", "action")
    fitting = urls.select("url", "host", "path", "rest", F.explode("tokens").alias("token")).join(
        side(index), "token").where((F.col("host") != "") & F.rlike(target, F.col("regex")))
    judged = stored(fitting.groupBy("url").agg(
        F.max(F.when(F.col("kind") == "site", best)).alias("site"),
        F.max(F.when(F.col("kind") == "pattern", best)).alias("pattern")), "judged")
    page_host, page_path, _ = url_parts(F.col("url"))
    return pages.select("page_id", "url").join(judged, "url", "left").select(
        "page_id", page_host.alias("host"), page_path.alias("path"), F.col("site")["rule"].alias("rule"),
        F.coalesce(F.col("site")["action"], F.col("pattern")["action"], F.lit(default)).alias("verdict"))
