"""URL verdicts: suffix and path rules, and block decisions that follow redirects.

Rules decide the urls they match. Urls that redirect to each other, or name each other as
canonical, are aliases; their classes are connected components over all such links. A url
without a rule takes the decision of its class: allow if any member has an allow rule,
else block if any has a block rule, else allow. DataFrame functions only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MOST_RULES = 256  # rules are literals of the plan; this bounds it


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where there is no ``://``."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as ``struct<rule, verdict>``, else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        hit = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, hit).otherwise(out)
    return out


def alias_key(url: Column) -> Column:
    """A url with A-Z of its scheme and host lower-cased: the name that aliases go by."""
    start = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    return F.concat(F.translate(start, UPPER, UPPER.lower()), F.substring(url, F.length(start) + 1, F.length(url)))


def resolved(base: Column, href: Column) -> Column:
    """The url that a page's reference means; null where it names no other page. Dot segments inside a path stay."""
    ref = F.replace(href, F.lit("&amp;"), F.lit("&"))
    origin = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    path = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    folder = F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^.*/", 0)).otherwise("/")
    return (
        F.when((ref == "") | ref.startswith("#"), None)
        .when(ref.contains("://"), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?):", 0), ref))
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(ref.startswith("/"), F.concat(origin, ref))
        .when(ref.startswith("?"), F.concat(origin, path, ref))
        .otherwise(F.concat(origin, folder, F.regexp_replace(ref, r"^\./", "")))
    )


def alias_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst``: all canonical links and refresh redirects that the pages' html states, resolved against the page's url."""
    tag = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
    href = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
    meta = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
    to = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
    named = lambda tags, ref: F.transform(F.regexp_extract_all(html_col, F.lit(tags), F.lit(0)), lambda x: F.regexp_extract(x, ref, 1))
    rows = pages.where(F.col(url_col).contains("://") & F.lower(html_col).rlike("canonical|refresh"))
    rows = rows.select(F.col(url_col).alias("src"), F.explode(F.concat(named(tag, href), named(meta, to))).alias("ref"))
    rows = rows.select(alias_key(F.col("src")).alias("src"), alias_key(resolved(F.col("src"), F.col("ref"))).alias("dst"))
    return rows.where("dst <> src")


def judge(
    pages: DataFrame,
    rules: list[Rule],
    links: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row of ``pages``.

    ``links`` (``src, dst`` urls) defaults to what the pages' html states. Rows with a null
    or odd url get an empty host and path, no rule and ``allow``. Repeated rows are kept, other columns
    are not read. Texts of any length are searched whole. Links from or to null are ignored, urls outside
    ``pages`` take part in the classes. Aliases are compared with scheme and host in lower case. An empty
    table gives an empty table. More than ``MOST_RULES`` rules raise a ValueError.
    """
    links = alias_links(pages, url_col, html_col) if links is None else links.select(alias_key(F.col("src")).alias("src"), alias_key(F.col("dst")).alias("dst"))
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", matched(F.col("host"), F.col("path"), rules))
    links = stored(links.where("src is not null and dst is not null").distinct(), "aliases")
    named = components(links, "src", "dst")
    host, path = host_and_path(F.col("node"))
    named = named.withColumn("own", matched(host, path, rules)["verdict"])
    decided = named.groupBy("component").agg(
        F.when(F.max(F.coalesce(F.col("own") == "allow", F.lit(False))), "allow")
        .when(F.max(F.coalesce(F.col("own") == "block", F.lit(False))), "block")
        .otherwise("allow")
        .alias("decision")
    )
    named = named.join(stored(decided, "decided"), "component").where("own is null and decision = 'block'").select("node")
    # only blocked aliases without a rule change anything, and a url is one row here
    rows = rows.join(named, alias_key(rows["url"]) == named["node"], "left")
    verdict = F.coalesce("hit.verdict", F.when(F.col("node").isNotNull(), "block").otherwise("allow"))
    return rows.select(
        F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict")
    )
