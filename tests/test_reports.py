"""PDF files, listings, reports, search, graph files, models as hooks, components and overlaps."""

import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions import html, urls
from lodestone.operators import chunk, entities, reports, scoring, search
from lodestone.plans import components
from lodestone.plans.components import connected_components
from lodestone.sources import pdf, readers, writers


def made_pdf(pages, info="/Title (A \\(good\\) title) /Author <FEFF00C1006E>", deflate=True):
    def obj(n, body):
        return b"%d 0 obj\n%s\nendobj\n" % (n, body)

    parts = [b"%PDF-1.4\n", obj(1, b"<< /Type /Catalog /Pages 2 0 R >>")]
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(pages)))
    parts.append(obj(2, f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode()))
    for i, lines in reversed(list(enumerate(pages))):
        content = b"BT /F1 12 Tf 10 700 Td " + b" T* ".join(b"(%s) Tj" % x.encode("cp1252") for x in lines) + b" [(wi) 20 (de) -300 (gap)] TJ ET"
        data = zlib.compress(content) if deflate else content
        parts.append(obj(10 + 2 * i, b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)))
        parts.append(obj(11 + 2 * i, b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode " if deflate else b"", data)))
    parts.append(obj(3, f"<< {info} >>".encode()))
    return b"".join(parts) + b"trailer << /Root 1 0 R /Info 3 0 R >>\n%%EOF"


@pytest.mark.parametrize("deflate", [True, False])
def test_pdf_reader(deflate):
    found = pdf.read(made_pdf([["First line", "esc \\050 x"], ["Second é page"]], deflate=deflate))
    assert found.pages == 2 and found.info == {"title": "A (good) title", "author": "Án"}
    assert found.text == "First line\nesc ( xwide gap\nSecond é pagewide gap"
    for bad in (b"", b"<html>", b"%PDF-1.4 nothing", b"%PDF-1.4 trailer << /Encrypt 5 0 R >>"):
        with pytest.raises(ValueError):
            pdf.read(bad)


def test_pdf_files(spark, tmp_path):
    (tmp_path / "pmc_77.pdf").write_bytes(made_pdf([["Some words on a page"]]))
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4 cut off")
    (tmp_path / "page.pdf").write_bytes(b"<html>" + b"plain words " * 20)
    files = readers.pdfs(spark, f"{tmp_path}/*.pdf")
    got = {r["filename"]: r for r in files.collect()}
    assert got["pmc_77.pdf"]["page_count"] == 1 and got["pmc_77.pdf"]["content"] == "Some words on a pagewide gap" and got["pmc_77.pdf"]["title"] == "A (good) title"
    assert got["broken.pdf"]["error"] == "no pages" and got["broken.pdf"]["content"] is None
    assert tuple(reports.pdf_summary(files).first())[:3] == (3, 2, 1)


def test_lexicon_files_and_graph_files(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"PART": ["cell", "cell wall", " "], "GAS": ["oxygen"]}))
    assert sorted(tuple(r) for r in readers.lexicon(spark, str(tmp_path / "t.json")).collect()) == [("cell", "PART"), ("cell wall", "PART"), ("oxygen", "GAS")]
    nodes = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    edges = spark.createDataFrame([("a", "b", 3)], "e1 string, e2 string, strength int")
    writers.write_graph(nodes, edges, f"{tmp_path}/g")
    back = readers.graph(spark, f"{tmp_path}/g")
    assert sorted(tuple(r) for r in back[0].collect()) == [("a", 1), ("b", 2)] and back[1].count() == 1
    with pytest.raises(ValueError):
        writers.write_graph(nodes.union(nodes), edges, f"{tmp_path}/h")


def test_listing_stops_at_the_first_empty_page(spark):
    h2, deep = '<article><p>x</p><h2 class="t"><a href="{}">', '<a href="https://s.org/{}/b/c">'
    rows = [("s", 1, h2.format("/one") + deep.format("no")), ("s", 2, deep.format("two") + '<a href="https://s.org/blog/x/y">'), ("s", 3, None), ("s", 4, h2.format("/four")), ("t", 51, h2.format("/late")), ("u", 1, h2.format("/one"))]
    df = spark.createDataFrame([(s, p, "https://s.org", h) for s, p, h in rows], "site string, page int, base string, html string")
    assert sorted(tuple(r) for r in html.listed(df).collect()) == [("s", "/one"), ("s", "https://s.org/two/b/c"), ("u", "/one")]


def test_download_rules(spark):
    df = spark.createDataFrame([("application/PDF", 1, True, None, None), (None, 1000, False, True, None), ("text/html", 999, None, False, True), (None, None, None, None, None)], "t string, n int, a boolean, b boolean, c boolean")
    got = [tuple(r) for r in df.select(urls.accepts(F.col("t"), F.col("n")), urls.download_status(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [(True, "already_exists"), (True, "success_direct"), (False, "success_indirect"), (False, "failed")]


def test_pdf_links(spark):
    made = [('<a href="/x/a.pdf?d=1">', "https://h.org/p", "https://h.org/x/a.pdf?d=1"), ('<a href="a.pdf">', "https://h.org/pmc/articles/PMC7/", "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC7/pdf/"), ('<i data-pdf-url="https://c.d/e">', "https://h.org/", "https://c.d/e"), ("", "https://h.org/", None)]
    df = spark.createDataFrame([(h, u) for h, u, _ in made], "h string, u string")
    assert [r[0] for r in df.select(urls.pdf_link(F.col("u"), F.col("h"))).collect()] == [w for *_, w in made]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", None)], "k string, n int")
    lines = reports.markdown("Title", [("Part", rows, ("k", "n"))])
    writers.write_report(spark, lines, f"file://{tmp_path}/r.md")
    assert (tmp_path / "r.md").read_text() == "# Title\n## Part\n| k | n |\n|---|---|\n| a |  |\n| b | 2 |\n"
    writers.write_splits(rows, f"{tmp_path}/s", some=F.col("n").isNotNull(), all=F.lit(True))
    assert spark.read.json(f"{tmp_path}/s/some").count() == 1 and spark.read.json(f"{tmp_path}/s/all").count() == 2
    failed = lambda *names: [r[0] for r in reports.advice(spark.createDataFrame([(n,) for n in names], "source string")).collect()]
    assert failed("PubMed", "Nature", "PMC") == ["institutional_access", "abstracts_only"] and failed() == ["review_failures"]
    ranked = reports.extremes(spark.createDataFrame([(i, (i % 4) / 4) for i in range(9)], "doc_id int, cleanliness double"), top=2).collect()
    assert sorted((r["side"], r["place"], r["doc_id"]) for r in ranked) == [("cleanest", 1, 3), ("cleanest", 2, 7), ("dirtiest", 1, 0), ("dirtiest", 2, 4)]
    split = scoring.paywall_exact(spark.createDataFrame([("x LOCKED",), ("x",), ("",), (None,)], "content string"), "LOCKED")
    assert [r["status"] for r in split.collect()] == ["paywalled", "free", "failed", "failed"]


def test_search(spark):
    texts = spark.createDataFrame([(1, "Red fish blue fish"), (2, "red bird"), (3, None), (4, "")], "chunk_id int, text string")
    index = search.inverted_index(texts)
    assert {(r["term"], r["df"], r["cf"]) for r in search.vocabulary(index).collect()} == {("red", 2, 2), ("fish", 1, 2), ("blue", 1, 1), ("bird", 1, 1)}
    queries = spark.createDataFrame([(7, "FISH fish red"), (8, "none")], "query_id int, query string")
    assert [(r["query_id"], r["id"], r["rank"]) for r in search.look_up(index, queries, 4, k=1).collect()] == [(7, 1, 1)]


def test_components_of_a_long_chain_and_a_hub(spark):
    r = random.Random(1)
    edges = [(f"n{i:04}", f"n{i + 1:04}") for i in range(130)] + [("hub", f"s{i:04}") for i in range(300)]
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "a string, b string")
    for small in (200_000, 0):  # broadcast, and hubs apart from the rest
        got = {x["node"]: x["component"] for x in connected_components(df, small).collect()}
        assert got == {n: "hub" if n[0] in "hs" else "n0000" for n in got} and len(got) == 131 + 301


def brute_overlaps(spans):
    kept = []
    for s, e, label in sorted(spans, key=lambda x: (x[0] - x[1], x[0], x[2])):
        if all(s >= f or e <= b for b, f, _ in kept):
            kept.append((s, e, label))
    return sorted(kept)


def test_overlaps_equal_brute_force(spark):
    r = random.Random(4)
    spans = {t: [(s, s + r.randint(1, 5), r.choice("AB")) for s in (r.randint(0, 60) for _ in range(40))] for t in range(6)}
    rows = [(t, "x", label, s, e) for t, each in spans.items() for s, e, label in set(each)]
    got = {}
    for x in entities.without_overlaps(spark.createDataFrame(rows, "id int, text string, label string, start int, end int")).collect():
        got.setdefault(x["id"], []).append((x["start"], x["end"], x["label"]))
    assert {t: sorted(v) for t, v in got.items()} == {t: brute_overlaps(set(each)) for t, each in spans.items()}


def test_models_as_hooks(spark):
    sizes = lambda: lambda sentences: [[float(len(s)), 1.0] for s in sentences]
    first_word = lambda: lambda words: [(0, 1, "ORG")] if words else []
    df = spark.createDataFrame([(1, "One sentence here. Another sentence is here. A third one follows. And the fourth one."), (2, None)], "doc_id int, content string")
    got = {r["article_id"]: r for r in chunk.sentence_distances(df, load=sizes).collect()}
    assert len(got[1]["distances"]) == 2 and all(0 <= d < 1 for d in got[1]["distances"]) and got[2]["distances"] == []
    assert chunk.semantic_chunks(df, load=sizes, largest=8, amount=10.0).filter("article_id = 1").count() > 1
    named = entities.statistical_entities(df.select(F.col("doc_id").alias("chunk_id"), F.col("content").alias("text")), first_word).collect()
    assert [tuple(r) for r in named] == [(1, "One", "SPACY_ORG", 0, 1, 0.7)]


def test_a_small_graph_takes_few_queries(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(200)] + [(i + 7, i) for i in range(300, 700, 7)] + [(5, 5), (None, 3), (-4, 900)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    made, written = [], components.scratch.written
    monkeypatch.setattr(components.scratch, "written", lambda *a, **k: made.append(1) or written(*a, **k))
    by_rounds = {tuple(x) for x in components.connected_components(df, 0).collect()}
    rounds = len(made)
    at_once = components.connected_components(df).collect()
    assert {tuple(x) for x in at_once} == by_rounds and len(at_once) == len(by_rounds)
    assert len(made) - rounds == 2 < rounds  # the edges and their components, however many rounds
    assert components.connected_components(df.filter("a is null")).count() == 0
