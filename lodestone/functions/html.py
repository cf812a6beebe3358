"""Content of raw HTML by regular expressions: pages are not well-formed, so no XML parser reads them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import strip, word_count

# Elements that are no content, classes of such elements, classes of content,
# marks of script frameworks, words in classes of loading pages.
DROPPED_TAGS = ("script", "style", "nav", "header", "footer", "aside", "form")
DROPPED_CLASSES = ("comments", "social-share", "in_share_element", "fb-like", "twitter-like", "printfriendly", "ve_form_element", "mw_social_icons_container", "related_posts", "navigation", "breadcrumb", "advertisement", "ad", "ads", "sidebar")
CONTENT_CLASSES = ("blog_entry_content", "entry_content", "post-content", "article-content", "content")
MAIN_CLASSES = ("main-content", "content-area", "post-content")
FRAMEWORKS = ("ng-app", "data-reactroot", "v-app", "__NUXT__", "data-server-rendered", "gatsby")
LOADING = ("loading", "spinner", "skeleton", "načítava", "načitanie")
CMS = ("WordPress", "Drupal", "Joomla")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
ARTICLE_TYPES = ("Article", "BlogPosting", "NewsArticle")
MIN_CONTENT = 100


def _class(name: str) -> str:
    return rf"\bclass\s*=\s*[\"'][^\"']*(?<![\w-]){name}(?![\w-])[^\"']*[\"']"


def _first(html: Column, pattern: str, group: int) -> Column:
    """A group of a pattern's first match; null without a match."""
    return F.get(F.regexp_extract_all(html, F.lit(pattern), F.lit(group)), F.lit(0))


def element(html: Column, tag: str) -> Column:
    """What the first element of a name holds; null without one."""
    return _first(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)


def by_class(html: Column, names: tuple[str, ...]) -> Column:
    """What the first element with one of the classes holds, up to the next end of its kind;
    classes are tried in turn; null without one."""
    found = []
    for name in names:
        pattern = rf"(?is)<(\w+)\b[^>]*{_class(name)}[^>]*>(.*?)</\1\s*>"
        found.append(_first(html, pattern, 2))
    return F.coalesce(*found)


def without_noise(html: Column) -> Column:
    """HTML without comments and elements that are no content."""
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    html = F.regexp_replace(html, rf"(?is)<({'|'.join(DROPPED_TAGS)})\b[^>]*>.*?</\1\s*>", "")
    names = "(?:" + "|".join(DROPPED_CLASSES) + ")"
    return F.regexp_replace(html, rf"(?is)<(\w+)\b[^>]*{_class(names)}[^>]*>.*?</\1\s*>", "")


def text_of(html: Column) -> Column:
    """The text of HTML: tags removed, common entities decoded, stripped."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return strip(text)


def _filled(column: Column) -> Column:
    return F.when(column != "", column)


def meta(html: Column, name: str) -> Column:
    """The content of a meta tag by its name or property, the name before the content."""
    pattern = rf"(?is)<meta\b[^>]*\b(?:name|property)\s*=\s*[\"']{name}[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"']"
    return _filled(F.regexp_extract(html, pattern, 1))


def title(html: Column) -> Column:
    """The first that is not empty: an entry title, the first heading, the title element."""
    return F.coalesce(*(_filled(text_of(x)) for x in (by_class(html, ("entry-title",)), element(html, "h1"), element(html, "title"))))


def date(html: Column) -> Column:
    """The machine-readable date of the first time element, else the text of a dated element."""
    stamped = _filled(F.regexp_extract(html, r"(?is)<time\b[^>]*\bdatetime\s*=\s*[\"']([^\"']+)[\"']", 1))
    return F.coalesce(stamped, _filled(text_of(by_class(html, ("published", "entry-date", "post-date")))))


def excerpt(html: Column) -> Column:
    """The text of an excerpt, else two hundred characters of the first paragraph."""
    first = F.regexp_extract(html, r"(?is)<p\b[^>]*>(.*?)(?:</p\s*>|<p\b|$)", 1)
    own = _filled(text_of(by_class(html, ("excerpt", "entry-summary", "post-excerpt"))))
    return F.coalesce(own, F.substring(text_of(first), 1, 200))


def content(html: Column) -> Column:
    """The text of the first content area that is long enough; empty without one."""
    areas = [by_class(html, (name,)) for name in CONTENT_CLASSES]
    areas += [element(html, "article"), element(html, "main"), by_class(html, ("main", "content-area", "blog-content"))]
    texts = F.transform(F.array_compact(F.array(*areas)), lambda a: text_of(without_noise(a)))
    return F.coalesce(F.get(F.filter(texts, lambda t: F.length(t) > MIN_CONTENT), F.lit(0)), F.lit(""))


def dom_features(html: Column) -> Column:
    """A struct of what tags a page has."""
    generator = F.coalesce(meta(html, "generator"), F.lit(""))
    cms = F
    for name in CMS:
        cms = cms.when(F.contains(F.lower(generator), F.lit(name.lower())), name.lower())
    pattern = r"(?is)<meta\b[^>]*\b(?:name|property)\s*=\s*[\"']([^\"']+)[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"']"
    keys = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x: x["v"] != "")
    tags = F.aggregate(
        last,
        F.create_map().cast("map<string,string>"),
        lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])),
    )
    return F.struct(
        html.rlike(r"(?i)<article\b").alias("has_article_tag"),
        html.rlike(r"(?i)<main\b").alias("has_main_tag"),
        F.regexp_count(html, F.lit(r"(?i)<script\b")).alias("script_count"),
        F.regexp_count(html, F.lit(r"(?i)<iframe\b")).alias("iframe_count"),
        F.regexp_count(html, F.lit(r"(?i)<form\b")).alias("form_count"),
        cms.otherwise(None).alias("cms"),
        html.rlike(r"(?i)<script\b[^>]*application/ld\+json").alias("structured_data"),
        tags.alias("meta_tags"),
    )


def js_rendered(html: Column) -> Column:
    """Marks of a script framework, a nearly empty content element with a script, or a loading class."""
    marks = F.greatest(*(F.contains(html, F.lit(m)) for m in FRAMEWORKS))
    area = F.coalesce(element(html, "main"), element(html, "article"))
    hollow = F.coalesce((F.length(text_of(area)) < 100) & area.rlike(r"(?i)<script\b"), F.lit(False))
    loading = html.rlike(r"(?Uis)\bclass\s*=\s*[\"'][^\"']*(?:" + "|".join(LOADING) + ")")
    return marks | hollow | loading


def strategies(html: Column) -> Column:
    """An array of extractions by method, in a fixed order, of those that found any content:
    JSON-LD, the article element, the main area, content classes, the whole body.

    Each looks at the page as it came; none sees what another has removed."""
    ld = F.regexp_extract(html, r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>", 1)
    got = lambda path: F.get_json_object(ld, path)
    known = got("$.@type").isin(*ARTICLE_TYPES)
    article, main = element(html, "article"), F.coalesce(element(html, "main"), by_class(html, MAIN_CLASSES))
    body = F.coalesce(element(html, "body"), html)
    areas = F.array_compact(F.array(*(by_class(html, (n,)) for n in CONTENT_CLASSES)))
    texts = F.transform(areas, lambda a: text_of(without_noise(a)))
    classed = F.get(F.filter(texts, lambda t: F.length(t) > MIN_CONTENT), F.lit(0))
    none = F.lit(None).cast("string")

    def found(method: str, name: Column, text: Column, when: Column, short: Column) -> Column:
        return F.struct(F.lit(method).alias("method"), name.alias("title"), text.alias("content"), when.alias("date"), short.alias("excerpt"))

    every = F.array(
        found("structured_data", F.when(known, F.coalesce(got("$.headline"), got("$.name"))), F.when(known, got("$.articleBody")), F.when(known, got("$.datePublished")), F.when(known, got("$.description"))),
        found("article_tag", _filled(text_of(element(article, "h1"))), text_of(without_noise(article)), _filled(F.regexp_extract(article, r"(?is)<time\b[^>]*\bdatetime\s*=\s*[\"']([^\"']+)[\"']", 1)), none),
        found("main_content", _filled(text_of(element(main, "h1"))), text_of(without_noise(main)), none, none),
        found("content_selectors", title(html), classed, none, none),
        found("fallback", F.coalesce(_filled(text_of(element(html, "title"))), _filled(text_of(element(html, "h1"))), meta(html, "og:title")), text_of(without_noise(body)), none, none),
    )
    return F.filter(every, lambda x: F.coalesce(x["content"] != "", F.lit(False)))


def score(extraction: Column) -> Column:
    """Points for length, a title, a date and the more reliable methods."""
    n = word_count(extraction["content"])
    length = F.when(n > 500, 3).when(n > 200, 2).when(n > 50, 1).otherwise(0)
    named = F.when(F.length(extraction["title"]) > 5, 1).otherwise(0)
    dated = F.when(extraction["date"].isNotNull() & (extraction["date"] != ""), 1).otherwise(0)
    method = F.when(extraction["method"] == "structured_data", 2).when(extraction["method"] == "article_tag", 1).otherwise(0)
    return length + named + dated + method


def best(extractions: Column) -> Column:
    """The extraction with the most points, of equal ones the first; null of none."""
    ranked = F.transform(extractions, lambda x, i: F.struct((-score(x)).alias("minus"), i.alias("at"), x.alias("it")))
    return F.get(F.array_sort(ranked), F.lit(0))["it"]


def links(html: Column) -> Column:
    """The distinct targets of a page's anchors, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*\"([^\"]*)\""), F.lit(1)))


#: Where a listing page has the links to its articles: a pattern of each place, the first that
#: finds anything holds.
LISTING_SELECTORS = (
    r"(?is)<article\b[^>]*>(?:(?!</article>).)*?<h2\b[^>]*>\s*<a\b[^>]*\bhref\s*=\s*\"([^\"]+)\"",
    r"(?is)class\s*=\s*\"[^\"]*\b(?:entry|post)-title\b[^\"]*\"[^>]*>\s*<a\b[^>]*\bhref\s*=\s*\"([^\"]+)\"",
    r"(?is)<h2\b[^>]*>\s*<a\b[^>]*\bhref\s*=\s*\"([^\"]+)\"",
)
LAST_LISTING = 50


def listing_links(html: Column, base: Column, selectors: Sequence[str] = LISTING_SELECTORS, index: str = "/blog/") -> Column:
    """The distinct links to articles of a listing page: those of the first selector that finds
    any, else all anchors below ``base`` that look like articles: deep enough and no index."""
    body = F.coalesce(html, F.lit(""))
    likely = lambda u: F.contains(u, base) & ~F.contains(u, F.lit(index)) & (F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit(""))) >= 4)
    found = F.filter(links(body), likely)
    for pattern in reversed(selectors):
        here = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
        found = F.when(F.size(here) > 0, here).otherwise(found)
    return F.array_distinct(found)


def listed(pages: DataFrame, selectors: Sequence[str] = LISTING_SELECTORS, last: int = LAST_LISTING) -> DataFrame:
    """``(site, url)``: the distinct links of each site's listing pages ``(site, page, base, html)``
    up to its first page without any, and no further than page ``last``.

    A site's first empty page is found by an aggregation, so no site's pages are gathered.
    """
    each = pages.filter(F.col("page").between(1, last)).select("site", "page", listing_links(F.col("html"), F.col("base"), selectors).alias("urls"))
    ends = each.filter(F.size("urls") == 0).groupBy("site").agg(F.min("page").alias("__end"))
    read = each.join(ends, "site", "left").filter(F.col("__end").isNull() | (F.col("page") < F.col("__end")))
    return read.select("site", F.explode("urls").alias("url")).distinct()
