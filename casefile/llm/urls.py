"""URL filter with redirect equivalence.

Rules block or allow a host with its subdomains, under a path. URLs that redirect
to each other, or name one canonical URL, are one page under several names, so
connected components over those edges carry decisions to aliases that no rule
fits: an explicit allow in the component wins, else a block blocks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.llm.graph import components, saved

RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"(?i)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?\s*[0-9.]+\s*[;,]\s*url\s*=\s*'?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """What is after the first ``://`` up to ``/ ? #``, A to Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A url's name in the graph: host, path and query. The scheme and the
    fragment do not tell pages apart; null for what is no url."""
    query = F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), query))


def resolved(base: Column, link: Column) -> Column:
    """``link``, found on the page ``base``, as a full url."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    slash = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(slash, link))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(source_url, target_url) of canonical links and timed redirects in pages.
    The patterns are tried only on pages that hold their key word."""
    low = F.lower("html")
    found = F.array_compact(
        F.array(
            F.when(low.contains("canonical"), F.nullif(F.regexp_extract("html", CANONICAL, 1), F.lit(""))),
            F.when(low.contains("http-equiv"), F.nullif(F.regexp_extract("html", REFRESH, 1), F.lit(""))),
        )
    )
    links = pages.where(F.col("url").contains("://")).select("url", F.explode(found).alias("link"))
    return links.select(F.col("url").alias("source_url"), resolved(F.col("url"), F.col("link")).alias("target_url"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def with_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest rule that fits (host, path);
    of equally long ones an allowing one.

    Rules are looked up by host: every suffix of a distinct host is joined with
    the rules, and the rules that fit a host come back in one list to its urls.
    """
    hosts = urls.select("host").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    listed = (
        hosts.select("host", F.explode(suffixes).alias("rule_host"))
        .join(rules, "rule_host")
        .select(
            "host",
            F.struct(
                F.length(F.concat("rule_host", "rule_path")).alias("size"),
                (F.col("rule_verdict") == "allow").alias("allows"),
                F.concat("rule_host", "rule_path").alias("rule"),
                "rule_path",
                "rule_verdict",
            ).alias("entry"),
        )
        .groupBy("host")
        .agg(F.collect_list("entry").alias("entries"))
    )
    best = F.array_max(F.filter("entries", lambda e: F.col("path").startswith(e["rule_path"])))
    joined = urls.join(listed, "host", "left").withColumn("__best", best)
    return joined.withColumns(
        {"rule": F.col("__best")["rule"], "rule_verdict": F.col("__best")["rule_verdict"]}
    ).drop("entries", "__best")


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    ``edges`` (source_url, target_url) are logged redirects; those in the pages'
    own html are always used. A page without a fitting rule has the verdict of
    its component, and without one is allowed. Null urls and what is no url have
    an empty host and path, and are allowed. Rows are kept, repeats too; a null or
    empty html has no edges. Other columns are not read.
    """
    found = page_edges(pages)
    if edges is not None:
        found = found.unionByName(edges.select("source_url", "target_url"))
    url = F.col("url")
    urls = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    judged = saved(with_rule(urls, rules), "judged")

    both = found.select(F.col("source_url").alias("url")).unionByName(found.select(F.col("target_url").alias("url")))
    ends = both.select(
        node_of(url).alias("node"), host_of(url).alias("host"), path_of(url).alias("path")
    ).where("node IS NOT NULL").distinct()
    pairs = found.select(node_of(F.col("source_url")).alias("a"), node_of(F.col("target_url")).alias("b"))
    members = components(pairs)
    held = with_rule(ends, rules).join(members, "node").groupBy("component").agg(
        F.max((F.col("rule_verdict") == "allow").cast("int")).alias("allows"),
        F.max((F.col("rule_verdict") == "block").cast("int")).alias("blocks"),
    )
    spread = members.join(held, "component").select(
        "node",
        F.when(F.col("allows") == 1, "allow").when(F.col("blocks") == 1, "block").otherwise("allow").alias("shared"),
    )
    return judged.join(spread, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", "shared", F.lit("allow")).alias("verdict")
    )
