"""Queries over raw pages and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import html as H
from lodestone.functions import urls as U
from lodestone.operators import reports as R
from lodestone.queries.common import WS, count_sql, strip_sql, table

BASE = "https://base.example"


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def html_extract(spark, sf_dir):
    html = F.col("html")
    return _pages(spark, sf_dir).select("page_id", H.title(html).alias("title"), H.content(html).alias("content"), H.date(html).alias("date"))


def html_excerpt(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", H.excerpt(F.col("html")).alias("excerpt"))


def html_dom_features(spark, sf_dir):
    f = _pages(spark, sf_dir).select("page_id", H.dom_features(F.col("html")).alias("f")).select("page_id", "f.*")
    counts = ("script_count", "iframe_count", "form_count")
    return f.select("page_id", "has_article_tag", "has_main_tag", *(F.col(c).cast("bigint").alias(c) for c in counts), "structured_data", F.size("meta_tags").cast("bigint").alias("meta_tags"))


def html_js_detect(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", H.js_rendered(F.col("html")).alias("js_rendered"))


def html_multi_strategy(spark, sf_dir):
    each = _pages(spark, sf_dir).select("page_id", F.explode(H.strategies(F.col("html"))).alias("x"))
    return each.select("page_id", "x.method", "x.title", "x.content", H.score(F.col("x")).cast("bigint").alias("score"))


def html_best_extraction(spark, sf_dir):
    best = _pages(spark, sf_dir).select("page_id", H.best(H.strategies(F.col("html"))).alias("x"))
    return best.select("page_id", "x.method", "x.title", "x.content")


def links_extract(spark, sf_dir):
    each = _pages(spark, sf_dir).select("page_id", F.explode(H.links(F.col("html"))).alias("link"))
    return each.withColumn("url", U.normalize(F.col("link"), BASE))


def url_normalize(spark, sf_dir):
    bare = F.regexp_replace("url", r"^https?://[^/]*", "")
    kind = F.when(F.pmod("page_id", F.lit(3)) == 0, F.col("url")).when(F.pmod("page_id", F.lit(3)) == 1, bare).otherwise(F.substring(bare, 2, 1000))
    return _pages(spark, sf_dir).select("page_id", U.normalize(kind, BASE).alias("url"))


def url_category(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.authority(F.col("url")).alias("domain"), U.category(F.col("url")).alias("category"))


def _papers(spark, sf_dir):
    """Page ids as addresses of papers, by turns of each known kind."""
    i, pid = F.pmod("page_id", F.lit(6)), F.col("page_id").cast("string")
    return _pages(spark, sf_dir).select(
        "page_id",
        F.when(i == 0, F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pubmed/"), pid))
        .when(i == 1, F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC"), pid, F.lit("/")))
        .when(i == 2, F.concat(F.lit("https://doi.org/10.1000/"), pid))
        .when(i == 3, F.concat(F.lit("https://www.nature.com/articles/s"), pid))
        .when(i == 4, F.concat(F.lit("https://link.springer.com/article/"), pid))
        .otherwise(F.col("url"))
        .alias("url"),
    )


def url_identifier(spark, sf_dir):
    return _papers(spark, sf_dir).select("page_id", U.identifier(F.col("url")).alias("identifier"))


def url_source(spark, sf_dir):
    return _papers(spark, sf_dir).select("page_id", U.source(F.col("url")).alias("source"), U.failure_kind(F.col("url")).alias("failure_kind"))


def _with_links(spark, sf_dir):
    """Papers with their pages, of which every third has a link to a PDF added."""
    p = _pages(spark, sf_dir).select("page_id", "html").join(_papers(spark, sf_dir), "page_id")
    link = F.concat(F.lit('<a href="/files/'), F.col("page_id").cast("string"), F.lit('.pdf">PDF</a>'))
    return p.withColumn("html", F.when(F.pmod("page_id", F.lit(3)) == 0, F.concat(F.col("html"), link)).otherwise(F.col("html")))


def pdf_link(spark, sf_dir):
    return _with_links(spark, sf_dir).select("page_id", U.pdf_link(F.col("url"), F.col("html")).alias("pdf_url"))


def download_status(spark, sf_dir):
    """What became of each paper's download, by fixed rules for what is there and what answers."""
    p = _with_links(spark, sf_dir)
    i = lambda n: F.pmod("page_id", F.lit(n))
    taken = U.accepts(F.when(i(4) == 0, "application/PDF").otherwise("text/html"), F.octet_length("html") - 5000)
    found = U.pdf_link(F.col("url"), F.col("html")).isNotNull() & (i(2) == 0)
    return p.select("page_id", taken.alias("accepted"), U.download_status(i(5) == 0, taken & (i(7) != 3), found).alias("status"))


def source_advice(spark, sf_dir):
    """What to do about the sources of failed downloads."""
    failed = download_status(spark, sf_dir).filter("status = 'failed'").join(_papers(spark, sf_dir), "page_id")
    return R.advice(failed.select(U.source(F.col("url")).alias("source")))


def listing_pages(spark, sf_dir):
    """Links of listing pages: seven sites, pages with a title link, a deep anchor, or none."""
    i, top = F.col("page_id"), F.regexp_extract("url", r"^[^:]+://[^/?#]*", 0)
    head = F.when(F.pmod(i, F.lit(11)) == 10, "").when(F.pmod(i, F.lit(2)) == 0, F.concat(F.lit('<h3 class="big entry-title"><a href="'), F.col("url"), F.lit('">x</a></h3>')))
    head = head.otherwise(F.concat(F.lit('<a href="'), top, F.lit('/a/b/c">x</a>')))
    p = _pages(spark, sf_dir).select(
        F.pmod(i, F.lit(7)).alias("site"), (F.expr("page_id div 7") + 1).alias("page"), top.alias("base"), F.concat(head, F.coalesce("html", F.lit(""))).alias("html")
    )
    return H.listed(p)


def source_domains(spark, sf_dir):
    p = _pages(spark, sf_dir).select(U.authority(F.col("url")).alias("domain"), U.category(F.col("url")).alias("category"))
    return p.groupBy("domain", "category").agg(F.count("*").alias("pages"))


def source_success(spark, sf_dir):
    """Downloads by source; a third of the papers failed by a fixed rule."""
    p = _papers(spark, sf_dir).withColumn("failed", F.pmod("page_id", F.lit(3)) == 2).withColumn("source", U.source(F.col("url")))
    return p.groupBy("source").agg(F.count("*").alias("total"), F.count_if(~F.col("failed")).alias("successful"), F.count_if("failed").alias("failed"))


def new_urls(spark, sf_dir):
    """Hosts of pages that no page of the first half of the ids has."""
    p = _pages(spark, sf_dir).select("page_id", U.authority(F.col("url")).alias("host"))
    half = p.agg(F.max("page_id").alias("m"))
    tagged = p.crossJoin(F.broadcast(half)).withColumn("old", F.col("page_id") * 2 < F.col("m"))  # one row
    return tagged.filter("not old").select("host").subtract(tagged.filter("old").select("host"))


def ref_urls(spark, sf_dir):
    """URLs of a reference section made of each page's own address and links."""
    text = F.concat(F.lit("Text. Zdroje, odkazy: "), F.col("url"), F.lit(", "), F.lit("https://doi.org/10.1/a-"), F.col("page_id").cast("string"), F.lit(". "))
    section = U.reference_section(text)
    each = _pages(spark, sf_dir).select("page_id", F.explode(U.extract_urls(section)).alias("url"))
    return each.select("page_id", "url", U.category(F.col("url")).alias("category"))


QUERIES = {f.__name__: f for f in (html_extract, html_excerpt, html_dom_features, html_js_detect, html_multi_strategy, html_best_extraction, links_extract, url_normalize, url_category, url_identifier, url_source, pdf_link, download_status, source_advice, listing_pages, source_domains, source_success, new_urls, ref_urls)}


def _element(x: str, tag: str) -> str:
    found = f"regexp_extract({x}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1)"
    return f"CASE WHEN regexp_matches({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>') THEN {found} END"


def _text(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"
    for name, char in H.ENTITIES:
        char = "''''" if char == "'" else f"'{char}'"
        x = f"replace({x}, '{name}', {char})"
    return strip_sql(x)


def _quiet(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for tag in H.DROPPED_TAGS:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    return f"regexp_replace({x}, '(?is)<div\\b[^>]*\\bclass\\s*=\\s*\"ad\"[^>]*>.*?</div\\s*>', '', 'g')"


_TITLE = f"coalesce(nullif({_text(_element('html', 'h1'))}, ''), nullif({_text(_element('html', 'title'))}, ''))"
_ARTICLE = _text(_quiet(_element("html", "article")))
_BODY = _text(_quiet(f"coalesce({_element('html', 'body')}, html)"))
_STRATEGIES = f"""x AS (
  SELECT page_id, 'article_tag' AS method, 1 AS bonus, nullif({_text(_element(_element('html', 'article'), 'h1'))}, '') AS title, {_ARTICLE} AS content FROM pages
  UNION ALL SELECT page_id, 'fallback', 0, coalesce(nullif({_text(_element('html', 'title'))}, ''), nullif({_text(_element('html', 'h1'))}, '')), {_BODY} FROM pages),
scored AS (
  SELECT page_id, method, title, content, (CASE WHEN {count_sql('content')} > 500 THEN 3 WHEN {count_sql('content')} > 200 THEN 2 WHEN {count_sql('content')} > 50 THEN 1 ELSE 0 END
    + CASE WHEN length(title) > 5 THEN 1 ELSE 0 END + bonus)::BIGINT AS score FROM x WHERE content <> '')"""
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_CATEGORY = "CASE " + " ".join("WHEN regexp_matches({h}, '" + "|".join(k.replace(".", r"\.") for k in keys) + f"') THEN '{name}'" for name, keys in U.CATEGORIES) + " ELSE 'other' END"
_SOURCE = "CASE " + " ".join(f"WHEN contains(url, '{part}') THEN '{name}'" for part, name in U.SOURCES) + " ELSE 'Other' END"
_NORMAL = "CASE WHEN {u} IS NULL OR {u} = '' THEN NULL WHEN starts_with({u}, '/') THEN '" + BASE + "' || {u} WHEN starts_with({u}, 'http') THEN {u} ELSE '" + BASE + "/' || {u} END"
_PAPERS = """papers AS (
  SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://www.ncbi.nlm.nih.gov/pubmed/' || page_id WHEN 1 THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || page_id || '/'
    WHEN 2 THEN 'https://doi.org/10.1000/' || page_id WHEN 3 THEN 'https://www.nature.com/articles/s' || page_id WHEN 4 THEN 'https://link.springer.com/article/' || page_id ELSE url END AS url FROM pages)"""
_FAILURE = "CASE WHEN " + " OR ".join(f"contains(url, '{p}')" for p in U.PAYWALLED) + " THEN 'paywall' WHEN " + " OR ".join(f"contains(url, '{p}')" for p in U.NO_PDF) + " THEN 'format' ELSE 'other' END"

_TOP = "regexp_extract(url, '^[^:]+://[^/?#]*')"
_PDF_URL = f"""CASE WHEN page_id % 3 = 0 THEN regexp_extract({{url}}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/files/' || page_id || '.pdf'
  WHEN page_id % 6 = 1 THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || page_id || '/pdf/' END"""
_PAPER = """CASE page_id % 6 WHEN 0 THEN 'https://www.ncbi.nlm.nih.gov/pubmed/' || page_id WHEN 1 THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || page_id || '/'
  WHEN 2 THEN 'https://doi.org/10.1000/' || page_id WHEN 3 THEN 'https://www.nature.com/articles/s' || page_id WHEN 4 THEN 'https://link.springer.com/article/' || page_id ELSE url END"""
_DOWNLOADS = f"""dp AS (SELECT page_id, {_PAPER} AS url, octet_length(encode(html)) + CASE WHEN page_id % 3 = 0 THEN length('<a href="/files/' || page_id || '.pdf">PDF</a>') ELSE 0 END AS size FROM pages),
da AS (SELECT *, page_id % 4 = 0 OR size - 5000 >= 1000 AS accepted, {_PDF_URL.format(url='url')} AS pdf_url FROM dp),
downloads AS (SELECT *, CASE WHEN page_id % 5 = 0 THEN 'already_exists' WHEN accepted AND page_id % 7 <> 3 THEN 'success_direct' WHEN pdf_url IS NOT NULL AND page_id % 2 = 0 THEN 'success_indirect' ELSE 'failed' END AS status FROM da)"""
_FAILED = "(SELECT count(*) FROM downloads WHERE status = 'failed' AND ({}))"
_LISTED = f"""SELECT page_id % 7 AS site, page_id // 7 + 1 AS page, page_id % 11 = 10 AS empty, CASE WHEN page_id % 2 = 0 THEN url ELSE {_TOP} || '/a/b/c' END AS url FROM pages"""

SQL = {
    "pdf_link": f"WITH {_DOWNLOADS} SELECT page_id, pdf_url FROM da",
    "download_status": f"WITH {_DOWNLOADS} SELECT page_id, accepted, status FROM downloads",
    "source_advice": f"""WITH {_DOWNLOADS}, a AS (SELECT list_filter([
  CASE WHEN {_FAILED.format("contains(url, 'nature.com') OR contains(url, 'springer.com')")} > 0 THEN 'institutional_access' END,
  CASE WHEN {_FAILED.format("contains(url, 'sciencedaily.com') OR contains(url, 'meddeviceonline.com')")} > 0 THEN 'scrape_as_html' END,
  CASE WHEN {_FAILED.format("contains(url, 'ncbi.nlm.nih.gov/pubmed')")} > 0 THEN 'abstracts_only' END], lambda x: x IS NOT NULL) AS a)
SELECT unnest(CASE WHEN len(a) > 0 THEN a ELSE ['review_failures'] END) AS advice FROM a""",
    "listing_pages": f"""WITH l AS ({_LISTED}), e AS (SELECT site, min(page) AS stop FROM l WHERE empty AND page <= 50 GROUP BY 1)
SELECT DISTINCT l.site, url FROM l LEFT JOIN e ON e.site = l.site WHERE page <= 50 AND (stop IS NULL OR page < stop)""",
    "html_extract": f"SELECT page_id, {_TITLE} AS title, CASE WHEN length({_ARTICLE}) > 100 THEN {_ARTICLE} ELSE '' END AS content, CAST(NULL AS VARCHAR) AS date FROM pages",
    "html_excerpt": f"SELECT page_id, substr({_text(r'''regexp_extract(html, '(?is)<p\b[^>]*>(.*?)(?:</p\s*>|<p\b|$)', 1)''')}, 1, 200) AS excerpt FROM pages",
    "html_dom_features": r"""
SELECT page_id, regexp_matches(html, '(?i)<article\b') AS has_article_tag, regexp_matches(html, '(?i)<main\b') AS has_main_tag,
  len(regexp_extract_all(html, '(?i)<script\b')) AS script_count, len(regexp_extract_all(html, '(?i)<iframe\b')) AS iframe_count,
  len(regexp_extract_all(html, '(?i)<form\b')) AS form_count, regexp_matches(html, '(?i)<script\b[^>]*application/ld\+json') AS structured_data,
  len(list_distinct(regexp_extract_all(html, '(?is)<meta\b[^>]*\b(?:name|property)\s*=\s*["'']([^"'']+)["''][^>]*\bcontent\s*=\s*["''][^"'']+["'']', 1))) AS meta_tags FROM pages""",
    "html_js_detect": rf"""
SELECT page_id, {' OR '.join(f"contains(html, '{m}')" for m in H.FRAMEWORKS)}
  OR coalesce(length({_text(f"coalesce({_element('html', 'main')}, {_element('html', 'article')})")}) < 100 AND regexp_matches(coalesce({_element('html', 'main')}, {_element('html', 'article')}), '(?i)<script\b'), false)
  OR regexp_matches(html, '(?is)\bclass\s*=\s*["''][^"'']*(?:{'|'.join(H.LOADING)})') AS js_rendered FROM pages""",
    "html_multi_strategy": f"WITH {_STRATEGIES} SELECT page_id, method, title, content, score FROM scored",
    "html_best_extraction": f"WITH {_STRATEGIES} SELECT page_id, arg_max(method, score * 2 + (method = 'article_tag')::INT) AS method, arg_max(title, score * 2 + (method = 'article_tag')::INT) AS title, arg_max(content, score * 2 + (method = 'article_tag')::INT) AS content FROM scored GROUP BY page_id",
    "links_extract": rf"""
WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*"([^"]*)"', 1)) AS link FROM pages)
SELECT page_id, link, {_NORMAL.format(u='link')} AS url FROM l""",
    "url_normalize": f"""
WITH b AS (SELECT page_id, url, regexp_replace(url, '^https?://[^/]*', '') AS bare FROM pages),
k AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN bare ELSE substr(bare, 2, 1000) END AS u FROM b)
SELECT page_id, {_NORMAL.format(u='u')} AS url FROM k""",
    "url_category": f"SELECT page_id, {_HOST} AS domain, {_CATEGORY.format(h=_HOST)} AS category FROM pages",
    "url_identifier": rf"""
WITH {_PAPERS}
SELECT page_id, CASE WHEN contains(url, 'pubmed') AND regexp_extract(url, 'pubmed/([0-9]+)', 1) <> '' THEN 'pubmed_' || regexp_extract(url, 'pubmed/([0-9]+)', 1)
  WHEN contains(url, 'pmc/articles') AND regexp_extract(url, 'PMC([0-9]+)', 1) <> '' THEN 'pmc_' || regexp_extract(url, 'PMC([0-9]+)', 1)
  WHEN contains(url, 'doi.org') THEN 'doi_' || replace(regexp_extract(url, 'doi\.org/(.+)', 1), '/', '_')
  WHEN contains(url, 'nature.com') AND regexp_extract(url, 'articles/([^/?]+)', 1) <> '' THEN 'nature_' || regexp_extract(url, 'articles/([^/?]+)', 1)
  ELSE replace({_HOST}, '.', '_') || '_' || (('0x' || substr(md5(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), 1, 8))::BIGINT % 10000) END AS identifier FROM papers""",
    "url_source": f"WITH {_PAPERS} SELECT page_id, {_SOURCE} AS source, {_FAILURE} AS failure_kind FROM papers",
    "source_domains": f"SELECT {_HOST} AS domain, {_CATEGORY.format(h=_HOST)} AS category, count(*) AS pages FROM pages GROUP BY 1, 2",
    "source_success": f"WITH {_PAPERS} SELECT {_SOURCE} AS source, count(*) AS total, count(*) FILTER (page_id % 3 <> 2) AS successful, count(*) FILTER (page_id % 3 = 2) AS failed FROM papers GROUP BY 1",
    "new_urls": f"""
WITH h AS (SELECT {_HOST} AS host, page_id * 2 < (SELECT max(page_id) FROM pages) AS old FROM pages)
SELECT DISTINCT host FROM h WHERE NOT old AND host NOT IN (SELECT host FROM h WHERE old)""",
    "ref_urls": rf"""
WITH t AS (SELECT page_id, list_distinct(list_transform(regexp_extract_all(url || ', https://doi.org/10.1/a-' || page_id || '.', 'https?://[^ "''<>\[\]{{}}]+'), lambda u: regexp_replace(u, '[.,;:]+$', ''))) AS us FROM pages),
e AS (SELECT page_id, unnest(us) AS url FROM t)
SELECT page_id, url, {_CATEGORY.format(h=_HOST)} AS category FROM e""",
}
