"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of a URL's host for each category, the first that fits wins.
CATEGORIES = (
    ("academic", ("pubmed", "ncbi", "doi", "jstor", "springer", "nature", "science", "elsevier", "wiley", "arxiv", "plos", "academic", "university", "edu")),
    ("news", ("news", "magazine", "journal", "bbc", "cnn", "reuters", "guardian", "times", "post")),
    ("government", ("gov", "who", "fda", "nih", "cdc", "europa.eu")),
    ("social_media", ("facebook", "twitter", "instagram", "youtube", "linkedin")),
    ("blog", ("blog", "wordpress", "medium", "substack")),
)
# Parts of a URL that name its source, the first that fits wins.
SOURCES = (
    ("ncbi.nlm.nih.gov/pubmed", "PubMed"),
    ("ncbi.nlm.nih.gov/pmc", "PMC"),
    ("nature.com", "Nature"),
    ("springer.com", "Springer"),
    ("sciencedirect.com", "ScienceDirect"),
    ("researchgate.net", "ResearchGate"),
    ("physicsworld.com", "Physics World"),
    ("sciencedaily.com", "Science Daily"),
    ("meddeviceonline.com", "Medical Device Online"),
    ("sunlightinstitute.org", "Sunlight Institute"),
    ("centreforbrainhealth.ca", "Centre for Brain Health"),
    ("afriscitech.com", "AfriSciTech"),
)
# Sites whose failed downloads are access limits, and those that have no PDF.
PAYWALLED, NO_PDF = ("springer.com", "nature.com", "sciencedirect.com"), ("sciencedaily.com", "centreforbrainhealth.ca", "afriscitech.com")
# Words that head a list of references.
REFERENCE_HEADINGS = ("REFERENCIE", "ODKAZY", "LINKY", "CITÁCIE", "ZDROJE", "LITERATÚRA", "POUŽITÉ ZDROJE", "ŠTÚDIE", "ODKAZY NA ŠTÚDIE", "POUŽITÉ CITÁCIE")
# Fixed value: what the extraction takes for a URL where parity is asked for; paths end at '-' and '%'.
NARROW_URL = r"(?U)https?://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:[\w.])*)?)?"
WIDE_URL = r"(?U)https?://[^\s\"'<>\[\]{}]+"


def authority(url: Column) -> Column:
    """What lies between ``//`` and the path, lower-cased; empty without a scheme."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def category(url: Column) -> Column:
    host = authority(url)
    found = F
    for name, keywords in CATEGORIES:
        found = found.when(host.rlike("|".join(k.replace(".", r"\.") for k in keywords)), name)
    return found.otherwise("other")


def source(url: Column) -> Column:
    found = F
    for part, name in SOURCES:
        found = found.when(F.contains(url, F.lit(part)), name)
    return found.otherwise("Other")


def failure_kind(url: Column) -> Column:
    """Why a download probably failed, by its site."""
    has = lambda parts: F.greatest(*(F.contains(url, F.lit(p)) for p in parts))
    return F.when(has(PAYWALLED), "paywall").when(has(NO_PDF), "format").otherwise("other")


def normalize(url: Column, base: str) -> Column:
    """An absolute URL: rooted ones and bare paths go below ``base``; null and empty give null."""
    return (
        F.when(url.isNull() | (url == ""), None)
        .when(url.startswith("/"), F.concat(F.lit(base), url))
        .when(url.startswith("http"), url)
        .otherwise(F.concat(F.lit(base + "/"), url))
    )


def identifier(url: Column) -> Column:
    """A name for a paper's URL: PubMed, PMC, DOI or Nature ids, else the host and a hash of the
    path, which is the same in every run."""

    def by(part: str, pattern: str, name: str) -> Column:
        found = F.regexp_extract(url, pattern, 1)
        return F.when(F.contains(url, F.lit(part)) & (found != ""), F.concat(F.lit(name), F.replace(found, F.lit("/"), F.lit("_"))))

    # Fixed values below: parts and patterns of the papers' URLs.
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    digest = F.pmod(F.conv(F.substring(F.md5(path), 1, 8), 16, 10).cast("bigint"), F.lit(10_000))
    return F.coalesce(
        by("pubmed", r"pubmed/(\d+)", "pubmed_"),
        by("pmc/articles", r"PMC(\d+)", "pmc_"),
        by("doi.org", r"doi\.org/(.+)", "doi_"),
        by("nature.com", r"articles/([^/?]+)", "nature_"),
        F.concat(F.replace(authority(url), F.lit("."), F.lit("_")), F.lit("_"), digest.cast("string")),
    )


def reference_section(text: Column) -> Column:
    """What follows the first heading of references, stripped; null without one."""
    some = "(?:" + "|".join(REFERENCE_HEADINGS) + ")"
    found = F.regexp_extract(text, rf"(?Uis)({some}(?:\s*,\s*{some})*\s*:)(.*)$", 2)
    has = text.rlike(rf"(?Ui){some}(?:\s*,\s*{some})*\s*:")
    return F.when(has, F.regexp_replace(found, r"(?U)^\s+|\s+$", ""))


def extract_urls(text: Column, narrow: bool = False) -> Column:
    """The distinct URLs of a text, without closing punctuation."""
    found = F.regexp_extract_all(text, F.lit(NARROW_URL if narrow else WIDE_URL), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:]+$", "")))


def pdf_link(url: Column, html: Column) -> Column:
    """The first link to a PDF in a page that is absolute or rooted, else the PMC address."""
    # Where a page names its PDF.
    patterns = (r'(?i)href="([^"]+\.pdf[^"]*)"', r'(?i)href="([^"]+/pdf[^"]*)"', r'(?i)data-pdf-url="([^"]+)"', r'(?i)pdf-url="([^"]+)"')
    links = F.concat(*(F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in patterns))
    usable = F.filter(links, lambda u: u.startswith("http") | u.startswith("/"))
    first = F.get(usable, F.lit(0))
    top = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    pmc = F.regexp_extract(url, r"PMC(\d+)", 1)
    return F.coalesce(
        F.when(first.startswith("/"), F.concat(top, first)).otherwise(first),
        F.when(F.contains(url, F.lit("pmc/articles")) & (pmc != ""), F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC"), pmc, F.lit("/pdf/"))),
    )


# Fixed value: an answer that does not call itself a PDF is taken from so many bytes on.
LEAST_ANSWER = 1000


def accepts(content_type: Column, size: Column) -> Column:
    """Whether an answer counts as a download: it calls itself a PDF, or is large enough."""
    named = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("pdf"))
    return named | (F.coalesce(size, F.lit(0)) >= LEAST_ANSWER)


def download_status(exists: Column, direct: Column, indirect: Column) -> Column:
    """What became of a download: there before, taken from its URL, from a link that its page
    has, or failed; unknown probes count as failed."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(exists), "already_exists").when(yes(direct), "success_direct").when(yes(indirect), "success_indirect").otherwise("failed")
