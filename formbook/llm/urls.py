"""URL rules, with decisions carried over redirects and canonical links.

Method. A rule (host, path) fits a host and its subdomains where the path begins with the rule's; the longest fitting rule decides. Pages
that redirect to each other or name each other as canonical are one component (distributed connected components over these
edges). An address without a rule takes its component's decision: allow where some member is allowed by a rule, else block
where some member is blocked by a rule, else allow. A rule that fits the address itself always stands.

Defined results: an address that is null or has no ``://`` has empty host and path, no rule and verdict allow; repeated rows are judged alike;
empty tables give no rows; links that are not absolute, root-relative or protocol-relative make no edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.llm.components import components
from formbook.session import checkpointed

# (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = "(?i)<link\\s[^>]*rel\\s*=\\s*[\"']?canonical[^>]*>"
_REFRESH = "(?i)<meta\\s[^>]*http-equiv\\s*=\\s*[\"']?refresh[^>]*>"


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(url.isNull() | (at == 0), F.lit(None)).otherwise(F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """Address without scheme and fragment; null where there is none."""
    rest = F.regexp_extract(_after(url), "^[^/?#]*([^#]*)", 1)
    return F.when(_after(url).isNotNull(), F.concat(host(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def rule(host_: Column, path_: Column, rules: tuple = RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, allow before block; null without one."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow", r[1:])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out.cast("struct<rule:string,verdict:string>")


def links(pages: DataFrame) -> DataFrame:
    """(url, target) of canonical links and refreshes in the pages."""
    tags = F.concat(F.regexp_extract_all("html", F.lit(_CANONICAL), F.lit(0)), F.regexp_extract_all("html", F.lit(_REFRESH), F.lit(0)))
    found = pages.where(F.col("url").isNotNull() & F.col("html").isNotNull()).select("url", F.explode(tags).alias("tag"))
    target = F.coalesce(
        F.nullif(F.regexp_extract("tag", "(?i)href\\s*=\\s*[\"']?([^\"'\\s>]+)", 1), F.lit("")), F.nullif(F.regexp_extract("tag", "(?i)url\\s*=\\s*[\"']?([^\"'\\s>]+)", 1), F.lit(""))
    )
    found = found.select("url", target.alias("t")).where(F.col("t").isNotNull())
    scheme = F.regexp_extract("url", "^([^:]*)://", 1)
    absolute = (
        F.when(F.instr("t", "://") > 0, F.col("t")).when(F.col("t").startswith("//"), F.concat(scheme, F.lit(":"), F.col("t")))
        .when(F.col("t").startswith("/"), F.concat(scheme, F.lit("://"), host(F.col("url")), F.col("t")))
    )
    return found.select("url", absolute.alias("target")).where(F.col("target").isNotNull())


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """``pages`` (page_id, url, html) with host, path, rule, verdict; ``redirects`` may add (url, target) pairs."""
    edges = links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", "target").where(F.col("url").isNotNull() & F.col("target").isNotNull()))
    edges = checkpointed(edges.distinct())
    classes = components(edges.select(node(F.col("url")).alias("a"), node(F.col("target")).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull()), "a", "b")
    # what rules say of each address of a component; addresses keep host and path in their name
    sides = edges.select(F.explode(F.array("url", "target")).alias("u")).select(node(F.col("u")).alias("node"), rule(host(F.col("u")), path(F.col("u")), rules).alias("r")).distinct()
    said = (
        classes.join(sides, "node").groupBy("component")
        .agg(F.max(F.when(F.col("r.verdict") == "allow", 1).otherwise(0)).alias("allowed"), F.max(F.when(F.col("r.verdict") == "block", 1).otherwise(0)).alias("blocked"))
        .select(F.col("component").alias("_c"), F.when((F.col("allowed") == 0) & (F.col("blocked") == 1), "block").otherwise("allow").alias("_by_class"))
    )
    decided = classes.join(said, F.col("component") == F.col("_c")).select(F.col("node").alias("_node"), "_by_class")
    own = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url")).alias("_key"))
    own = own.withColumn("_r", rule(F.col("host"), F.col("path"), rules))
    return own.join(decided, F.col("_key") == F.col("_node"), "left").select(
        "page_id", "url", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), F.col("_by_class"), F.lit("allow")).alias("verdict")
    )
