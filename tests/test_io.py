"""Readers, writers, pages, URLs, streams and the registered queries."""

import datetime
import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions import html, urls
from lodestone.sources import readers, writers
from lodestone.streaming import intake

ROOT = Path(__file__).resolve().parents[1]


def _article(url, scraped="2024-01-02T03:04:05"):
    return {"url": url, "title": "T", "content": "text", "date": "2024-01-01", "excerpt": "", "scraped_at": scraped, "word_count": 1}


def test_article_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(_article("u1")))
    (tmp_path / "b.json").write_text("{ not json")
    (tmp_path / "c.txt").write_text("no")
    rows = readers.articles(spark, str(tmp_path)).collect()
    assert [(r["url"], r["file_name"], r["published"].year) for r in rows] == [("u1", "a.json", 2024)]


def test_entity_files(spark, tmp_path):
    doc = {"chunk_entities": [{"chunk_id": 1, "source_title": "t", "entities": [{"text": "x", "label": "L", "start": 0, "end": 1, "confidence": 0.5}]}]}
    (tmp_path / "e.json").write_text(json.dumps(doc))
    (row,) = readers.chunk_entities(spark, str(tmp_path)).collect()
    assert (row["chunk_id"], row["text"], row["confidence"]) == (1, "x", 0.5)


def test_pdfs_and_url_lists(spark, tmp_path):
    (tmp_path / "pubmed_12.pdf").write_bytes(b"<html>" + b"plain words " * 20)
    (tmp_path / "doi_10.1_ab.pdf").write_bytes(b"%PDF-1.4 binary")
    got = {r["filename"]: r for r in readers.pdfs(spark, f"{tmp_path}/*.pdf").collect()}
    assert not got["pubmed_12.pdf"]["is_pdf"] and got["pubmed_12.pdf"]["word_count"] > 30 and got["pubmed_12.pdf"]["identifier"]["value"] == "12"
    assert got["doi_10.1_ab.pdf"]["is_pdf"] and got["doi_10.1_ab.pdf"]["identifier"]["value"] == "10.1/ab"
    (tmp_path / "list.md").write_text("# head\n\n http://a \nhttp://b\n")
    assert [r["url"] for r in readers.url_list(spark, f"{tmp_path}/list.md").collect()] == ["http://a", "http://b"]


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert writers.current_version(spark, root) is None and writers.list_versions(spark, root) == []
    name = writers.version_name(datetime.datetime(2024, 1, 2, 3, 4, 5), ["web", "blog"])
    assert name == "v_20240102_030405_blog_web"
    writers.commit_snapshot(spark, root, name, {"t": spark.range(3)}, {"note": "x"})
    writers.commit_snapshot(spark, root, "v_2025", {"t": spark.range(5)})
    assert writers.current_version(spark, root) == "v_2025" and writers.read_snapshot(spark, root, "t").count() == 5
    assert writers.read_snapshot(spark, root, "t", name).count() == 3
    assert [v["version"] for v in writers.list_versions(spark, root)] == ["v_2025", name]
    assert writers.duplicates(spark.range(3).union(spark.range(1)), "id").count() == 1


def test_html(spark):
    page = """<html><head><title>Site</title><meta name="generator" content="WordPress 6"><script type="application/ld+json">{"@type":"Article","headline":"H","articleBody":"one two","datePublished":"2024-01-01"}</script></head>
    <body><nav>menu</nav><article><h1>Head &amp; more</h1><time datetime="2024-02-03">x</time><p>First para.<p>Second. <div class="ads">buy</div>%s</article></body></html>""" % ("word " * 60)
    df = spark.createDataFrame([(1, page), (2, "<div data-reactroot></div>"), (3, None)], "i int, html string")
    h = F.col("html")
    got = {r["i"]: r for r in df.select("i", html.title(h).alias("t"), html.content(h).alias("c"), html.date(h).alias("d"), html.js_rendered(h).alias("js"), html.best(html.strategies(h)).alias("b"), html.dom_features(h).alias("f")).collect()}
    assert got[1]["t"] == "Head & more" and got[1]["d"] == "2024-02-03" and "buy" not in got[1]["c"] and "Second." in got[1]["c"]
    assert got[1]["b"]["method"] == "article_tag" and got[1]["f"]["cms"] == "wordpress" and got[1]["f"]["structured_data"]
    assert got[2]["js"] and not got[1]["js"] and got[3]["t"] is None


@pytest.mark.parametrize(
    ("url", "name", "category", "source"),
    [("https://www.ncbi.nlm.nih.gov/pubmed/123", "pubmed_123", "academic", "PubMed"), ("https://doi.org/10.1/a/b", "doi_10.1_a_b", "academic", "Other"),
     ("https://www.nature.com/articles/s41?x", "nature_s41", "academic", "Nature"), ("https://x.blog.sk/a", None, "blog", "Other"), ("https://cdc.gov/x", None, "government", "Other")],
)
def test_urls(spark, url, name, category, source):
    df = spark.createDataFrame([(url,)], "u string")
    got = df.select(urls.identifier(F.col("u")), urls.category(F.col("u")), urls.source(F.col("u"))).first()
    assert (got[1], got[2]) == (category, source) and (name is None or got[0] == name)


def test_references(spark):
    text = "Telo http://no.sk/. Referencie, odkazy: http://a.sk/b-c, https://d.sk/e. http://a.sk/b-c"
    df = spark.createDataFrame([(text,), ("nothing",), (None,)], "t string")
    section = urls.reference_section(F.col("t"))
    rows = df.select(urls.extract_urls(section).alias("wide"), urls.extract_urls(section, narrow=True).alias("narrow")).collect()
    assert rows[0]["wide"] == ["http://a.sk/b-c", "https://d.sk/e"] and rows[0]["narrow"] == ["http://a.sk/b", "https://d.sk/e"]
    assert rows[1]["wide"] is None and rows[2]["wide"] is None


def test_article_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, url in enumerate(("u1", "u2", "u1")):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(_article(url)))
    out = f"{tmp_path}/out"
    query = intake.upsert_stream(intake.article_stream(spark, f"{tmp_path}/in"), lambda rows, _: rows.write.mode("append").parquet(out), f"{tmp_path}/log")
    query.awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(out).collect()) == ["u1", "u2"]


def test_registered_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_the_rest_works_without_the_subpackage():
    """As in a checkout without it; an error inside the subpackage is not swallowed."""
    gone = "import sys; sys.modules['lodestone.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') and q[2].isdigit() for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", gone], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[-1] == "False", out.stderr
