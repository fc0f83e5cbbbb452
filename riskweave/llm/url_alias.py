"""URL filter with redirect equivalence.

Rules name a host and a path prefix. A url's own longest rule decides; a url without one inherits a block
from any url that redirects to it, that it redirects to, or that shares a canonical link with it, however
long the chain. An explicit allow rule always wins over an inherited block.

A url is compared without its fragment, with scheme and host in lower case, without a default port, with dot segments
resolved and ``/`` for an empty path. Links are read from attributes by name, resolved against the page's base, and not
from comments. Null urls, and urls without ``://``, have an empty host and path, fit no rule and are no alias of anything
(verdict: allow). Repeated pages and links do no harm; empty tables give
empty tables. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Tags that declare links, with their attributes (quoted values may hold any sign); a tag of more than 200 parts is none.
_TAG = r"(?is)<(?:link|meta|base)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'){0,200}+>"
_ATTRIBUTE = r"(?s)([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?"
_COMMENT = r"(?s)<!--.*?(?:-->|\z)"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and for paths that start with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def own_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (name, allow) of the longest fitting rule, or null. The rules are a parameter, not data."""
    found = F.lit(None).cast("struct<name:string,allow:boolean>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.allow).alias("allow"))).otherwise(found)
    return found


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def _without_dots(path: Column) -> Column:
    """A path from the root with its ``.`` and ``..`` segments resolved."""
    part = F.split(path, "/", -1)
    kept = F.aggregate(
        part,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    tail = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), tail)).otherwise(path)


def node_of(url: Column) -> Column:
    """The form in which urls are compared; urls without ``://`` only lose their fragment."""
    plain = without_fragment(url)
    site = F.translate(F.regexp_extract(plain, r"(?s)^([^/?#]*://[^/?#]*)", 1), _UPPER, _LOWER)
    rest = F.substring(plain, F.length(site) + 1, F.length(plain))
    path = F.regexp_extract(rest, r"(?s)^([^?]*)", 1)
    query = F.substring(rest, F.length(path) + 1, F.length(rest))
    site_only = F.regexp_replace(F.regexp_replace(site, r"^(http://.*):(?:80)?$", "$1"), r"^(https://.*):(?:443)?$", "$1")
    rooted = F.when(path == "", F.lit("/")).otherwise(_without_dots(path))
    return F.when(site != "", F.concat(site_only, rooted, query)).otherwise(plain)


def _absolute(link: Column, base: Column) -> Column:
    """A link of a page resolved against the page's url; links of schemes without ``://`` are no page (null)."""
    link = without_fragment(F.trim(F.regexp_replace(link, r"(?i)&(amp|#38|#x26);", "&")))
    page = without_fragment(base)
    site = F.regexp_extract(page, r"(?s)^([^/?#]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(page, r"(?s)^([^/?#]*:)//", 1)
    whole = F.regexp_extract(page, r"(?s)^([^?]*)", 1)
    folder = F.concat(site, F.regexp_extract(F.substring(whole, F.length(site) + 1, F.length(whole)), r"(?s)^(.*/)", 1))
    folder = F.when(folder == site, F.concat(site, F.lit("/"))).otherwise(folder)
    return (
        F.when(link == "", None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("//") & (scheme != ""), F.concat(scheme, link))
        .when(site == "", None)
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(whole, link))
        .otherwise(F.concat(folder, link))
    )


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, without quotes; null if it has none.

    Attributes are read one after another, so a name inside another one's value, or at its end, is not taken for it.
    """
    names = F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
    values = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2))
    at = F.array_position(names, name)
    return F.when(at > 0, F.regexp_replace(F.get(values, (at - 1).cast("int")), r"^[\"']|[\"']$", ""))


def _declared(tag: Column) -> Column:
    """The url a tag declares for its page: a canonical link or a refresh; null for other tags."""
    kind = F.lower(F.regexp_extract(tag, r"^<(\w+)", 1))
    canonical = F.array_contains(F.split(F.lower(F.trim(_attribute(tag, "rel"))), r"\s+"), "canonical")
    refresh = F.lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh"
    target = F.regexp_extract(_attribute(tag, "content"), r"(?is)^[^;,]*[;,]\s*url\s*=\s*[\"']?\s*([^\"']*)", 1)
    return F.when((kind == "link") & canonical, _attribute(tag, "href")).when((kind == "meta") & refresh, target)


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): all canonical links and refresh redirects that pages declare, outside comments, resolved against the
    page's base."""
    rows = pages.select(F.col(url).alias("_u"), F.col(html).alias("_h"))
    # most pages declare nothing: a cheap test before comments are cut out of whole pages
    rows = rows.filter(F.col("_h").rlike(r"(?i)canonical|refresh"))
    tags = rows.select("_u", F.regexp_extract_all(F.regexp_replace("_h", _COMMENT, ""), F.lit(_TAG), F.lit(0)).alias("_t"))
    bases = F.filter("_t", lambda t: F.lower(t).startswith("<base") & _attribute(t, "href").isNotNull())
    base = F.when(F.size(bases) > 0, _absolute(_attribute(F.get(bases, F.lit(0)), "href"), F.col("_u")))
    links = F.filter(F.transform("_t", _declared), lambda x: F.trim(x) != "")
    # base and link leave the generator as values, so that what follows does not repeat how they were found
    pairs = F.transform(links, lambda x: F.struct(x.alias("link"), F.coalesce(base, F.col("_u")).alias("base")))
    return (
        tags.select("_u", F.explode(pairs).alias("_p"))
        .select(node_of(F.col("_u")).alias("a"), node_of(_absolute(F.col("_p.link"), F.col("_p.base"))).alias("b"))
        .filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    edges: DataFrame | None = None,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_of): one row per page.

    ``edges`` (a, b) are known redirects beside the links found in the pages. ``alias_of`` names the class of a
    url that has links: the smallest url in it.
    """
    found = link_edges(pages, url, html)
    if edges is not None:
        given = edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b"))
        found = found.unionByName(given)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url")).select(
        "page_id",
        host_of(F.col("_url")).alias("host"),
        path_of(F.col("_url")).alias("path"),
        node_of(F.col("_url")).alias("_node"),
    )
    rows = rows.withColumn("_rule", own_rule(F.col("host"), F.col("path"), rules))
    classes = components(found)
    nodes = classes.withColumn("_r", own_rule(host_of(F.col("node")), path_of(F.col("node")), rules))
    # a class may be very large: its verdict is combined before the shuffle, its members are only joined
    spoilt = nodes.groupBy("component").agg(F.max(F.coalesce(~F.col("_r.allow"), F.lit(False))).alias("_bad"))
    members = nodes.select(F.col("node").alias("_node"), "component").join(spoilt, "component")
    judged = rows.join(members, "_node", "left")
    verdict = (
        F.when(F.col("_rule.allow"), "allow").when(~F.col("_rule.allow"), "block").when(F.col("_bad"), "block").otherwise("allow")
    )
    return judged.select(
        "page_id", "host", "path", F.col("_rule.name").alias("rule"), verdict.alias("verdict"), F.col("component").alias("alias_of")
    )
