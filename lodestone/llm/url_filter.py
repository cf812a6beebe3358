"""URL rules, and the spread of block decisions over redirects and canonical links.

A rule is a host and the start of a path; the longest that fits a URL decides.  URLs that no
rule fits follow their class.  URLs of one canonical form are one node of a graph, so aliases by
scheme, fragment, tracking parameter or ending need no edges; redirects, canonical links and
refreshes are its edges, and a class is a connected component.  A class with a blocked member
blocks its undecided members, unless an explicit allow rule fits a member: allow has precedence.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans import scratch
from lodestone.plans.arrow import table
from lodestone.plans.components import connected_components
from lodestone.plans.size import small

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)"
_LINK_TAG = r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"
_HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_REFRESH_TAG = r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"
_REFRESH_URL = r"(?is)\burl\s*=\s*['\"]?([^'\">\s]+)"


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, group), F.lit(""))


def host(url: Column) -> Column:
    """What lies between the first ``://`` and the path, A-Z lower-cased; empty without one."""
    return F.translate(_part(url, 2), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return _part(url, 3)


#: What does not tell resources apart: a host's first label, a query's parameters, a path's end.
ALIAS_HOSTS, TRACKING, ALIAS_ENDS = r"^(?:www|m)\.", r"(?i)^(?:utm_[^=]*|ref|gclid|fbclid)(?:=|$)", r"(?:/|/?index\.html?|\.html?)$"


def node(url: Column) -> Column:
    """A URL's canonical form: https, the host without ``www.`` or ``m.``, the path without a
    closing slash or ``.html``, the query without tracking parameters, no fragment; null
    without ``://``."""
    scheme = F.regexp_replace(F.translate(_part(url, 1), _UPPER, _LOWER), "^http$", "https")
    place = F.regexp_replace(host(url), ALIAS_HOSTS, "")
    told = F.filter(F.split(F.regexp_replace(_part(url, 4), r"^\?", ""), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.when(F.size(told) > 0, F.concat(F.lit("?"), F.array_join(told, "&"))).otherwise("")
    whole = F.concat(scheme, F.lit("://"), place, F.regexp_replace(_part(url, 3), ALIAS_ENDS, ""), query)
    return F.when(F.instr(url, "://") > 0, whole)


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, rule, allow)`` for each distinct host and path that a rule fits.

    ``rules`` has ``rule_host``, ``rule_path`` and ``allow``.  Hosts are looked up by their
    suffixes, so the rules may be many.  The longest rule wins; of equally long ones that with
    the longer host, then an allowing one.
    """
    keys = urls.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    looked = keys.withColumn("rule_host", F.explode(suffixes))
    fits = looked.join(rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    size = F.struct((F.length("rule_host") + F.length("rule_path")).alias("a"), F.length("rule_host").alias("b"), F.col("allow").alias("c"))
    chosen = F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "allow"), size).alias("won")
    return fits.groupBy("host", "path").agg(chosen).select("host", "path", "won.rule", "won.allow")


def _resolved(base: Column, link: Column) -> Column:
    """A link on a page: absolute, without a scheme, from the root, or next to the page."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    scheme, top = _part(base, 1), F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    folder = F.regexp_replace(F.concat(_part(base, 3), F.lit("/")), r"^(|.*/)[^/]*/$", "$1")
    folder = F.when(folder == "", "/").otherwise(folder)
    found = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(top, link))
        .otherwise(F.concat(top, folder, link))
    )
    return F.when(link != "", found)


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """URLs ``(a, b)``: a page's, and that of each canonical link and each meta refresh in it.

    Null URLs and pages link nowhere; tags without an address are left out.
    """
    html, url = F.col(html_col), F.col(url_col)
    some = pages.filter(url.isNotNull() & html.rlike(r"(?i)\bcanonical\b|\bhttp-equiv\b"))
    tags = F.regexp_extract_all(html, F.lit(_LINK_TAG), F.lit(1))
    hrefs = F.transform(tags, lambda t: F.concat(*(F.regexp_extract(t, _HREF, i) for i in (1, 2, 3))))
    moved = F.transform(F.regexp_extract_all(html, F.lit(_REFRESH_TAG), F.lit(1)), lambda t: F.regexp_extract(t, _REFRESH_URL, 1))
    edges = some.select(url.alias("a"), F.explode_outer(F.concat(hrefs, moved)).alias("link"))
    return edges.select("a", _resolved(F.col("a"), F.col("link")).alias("b")).filter("b is not null")


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, bool]],
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every page.

    ``rules`` are (host, path, allow); ``redirects`` may add edges ``(a, b)`` of URLs.  A URL
    that is null or has no ``://`` has an empty host and path, no rule and no class, and is
    allowed, as is every undecided URL whose class is not blocked.  URLs met only as the end
    of an edge are judged by the rules too and count for their class.  Repeated rows are judged
    alike; an empty table gives none.
    """
    spark = pages.sparkSession
    ruling = table(spark, [tuple(r) for r in rules], rule_host=pa.string(), rule_path=pa.string(), allow=pa.bool_())
    parts = lambda url: (host(url).alias("host"), path(url).alias("path"), node(url).alias("node"))
    named = pages.select(F.col(id_col).alias("page_id"), *parts(F.col(url_col)))
    ends = page_links(pages, url_col, html_col)
    if redirects is not None:
        ends = ends.unionByName(redirects.select("a", "b"))
    ends = scratch.written(ends.filter("instr(a, '://') > 0 and instr(b, '://') > 0"))
    linked = small(connected_components(ends.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b"))))
    met = ends.select(F.explode(F.array("a", "b")).alias("url")).select(*parts(F.col("url")))
    members = named.filter("node is not null").select("host", "path", "node").unionByName(met).distinct()
    ruled = members.join(match_rules(members, ruling), ["host", "path"]).join(linked, "node", "left")
    classes = ruled.groupBy(F.coalesce("component", "node").alias("class"))
    classes = classes.agg(F.bool_or("allow").alias("any_allow"), F.bool_or(~F.col("allow")).alias("any_block"))
    blocked = scratch.written(classes.filter("any_block and not any_allow").select("class", F.lit(True).alias("in_blocked")), narrow=True)
    judged = named.join(match_rules(named, ruling), ["host", "path"], "left").join(linked, "node", "left")
    judged = judged.withColumn("class", F.coalesce("component", "node")).join(small(blocked), "class", "left")
    allow = F.coalesce("allow", ~F.col("in_blocked"), F.lit(True))
    return judged.select("page_id", "host", "path", "rule", F.when(allow, "allow").otherwise("block").alias("verdict"))
