"""Chunks, entities, graph and retrieval on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunk, entities, graph, retrieval, vector


def brute_chunks(sizes, most, overlap):
    """(start, end) of chunks over sentence sizes."""
    out, current = [], []
    for i, n in enumerate(sizes):
        if current and sum(sizes[j] for j in current) + n > most:
            out.append((current[0], current[-1] + 1))
            kept = []
            if overlap > 0 and len(current) > 1:
                for j in reversed(current):
                    if sum(sizes[k] for k in kept) + sizes[j] > overlap:
                        break
                    kept.insert(0, j)
            current = kept
        current.append(i)
    return [*out, (current[0], current[-1] + 1)] if current else out


@pytest.mark.parametrize(("most", "overlap"), [(20, 6), (20, 0), (5, 50), (1000, 10)])
def test_fixed_chunks(spark, most, overlap):
    r = random.Random(most)
    sizes = {d: [r.randint(3, 12) for _ in range(r.randint(1, 40))] for d in range(25)}
    text = lambda ns: " ".join(" ".join(["wordy"] * n) + "." for n in ns)
    df = spark.createDataFrame([(d, text(ns)) for d, ns in sizes.items()] + [(90, None), (91, ""), (92, "short. text.")], "doc_id int, content string")
    got = {}
    rows = chunk.fixed_chunks(df, most, overlap, 10, min_length=10).orderBy("article_id", "chunk_id").collect()
    for row in rows:
        got.setdefault(row["article_id"], []).append((row["sentence_start_idx"], row["sentence_end_idx"] + 1))
        ns = sizes[row["article_id"]]
        assert row["word_count"] == sum(ns[slice(*got[row["article_id"]][-1])])
        before, after = row["preceding_context_words"], row["following_context_words"]
        assert before <= 10 and after <= 10 and len(row["preceding_context"].split()) == before
    assert got == {d: brute_chunks(ns, most, overlap) for d, ns in sizes.items()}
    single = [r for r in rows if r["chunk_position"] == "complete"]
    assert all(r["previous_chunk_id"] is None and r["next_chunk_id"] is None for r in single)


def test_semantic_chunks_lose_no_text(spark):
    text = "Cats chase small mice daily. Cats chase small birds daily. Engines burn heavy fuel slowly. Engines burn light fuel slowly. Short one here."
    df = spark.createDataFrame([(1, text), (2, "Only a single sentence"), (3, None)], "doc_id int, content string")
    got = chunk.semantic_chunks(df, smallest=3, largest=12, amount=50.0).orderBy("article_id", "chunk_id").collect()
    assert sum(r["word_count"] for r in got if r["article_id"] == 1) == len(text.split())
    assert [r["text"] for r in got if r["article_id"] == 2] == ["Only a single sentence"]
    few = chunk.semantic_chunks(df, smallest=12, largest=12, amount=50.0, keep_small=False).filter("article_id = 1").count()
    assert few < sum(r["article_id"] == 1 for r in got)


def test_percentiles(spark):
    values = [1.0, 2.0, 4.0, 5.0, 8.0, 16.0, 33.0]
    df = spark.createDataFrame([(values,)], "v array<double>")
    kinds = [chunk.threshold(F.col("v"), k, a) for k, a in (("percentile", 85.0), ("standard_deviation", 2.0), ("gradient", 50.0))]
    got = df.select(*kinds).first()
    want = [np.percentile(values, 85), np.mean(values) + 2 * np.std(values), np.percentile(np.abs(np.gradient(values)), 50)]
    assert list(got) == pytest.approx(want)


def _lexicon(spark):
    return spark.createDataFrame([("cell", "PART"), ("Cell Membrane", "PART"), ("membrane protein", "MOLECULE"), ("ATP", "MOLECULE")], "term string, label string")


def test_lexicon_and_overlaps(spark):
    df = spark.createDataFrame([(1, "The cell membrane protein and ATP, atp."), (2, None), (3, "")], "chunk_id int, text string")
    found = entities.lexicon_entities(df, _lexicon(spark))
    got = sorted((r["text"], r["start"], r["end"]) for r in found.collect())
    assert got == [("ATP", 5, 6), ("atp", 6, 7), ("cell", 1, 2), ("cell membrane", 1, 3), ("membrane protein", 2, 4)]
    clear = sorted((r["text"], r["label"]) for r in entities.without_overlaps(found).collect())
    assert clear == [("ATP", "MOLECULE"), ("atp", "MOLECULE"), ("cell membrane", "PART")]
    named = spark.createDataFrame([(1, "x", "SPACY_A", 0, 1), (1, "y", "SPACY_A", 2, 3), (9, "z", "SPACY_A", 1, 2)], "id int, text string, label string, start int, end int")
    assert {r["text"] for r in entities.ner_antijoin(named, found).collect()} == {"x", "z"}


def test_regex_entities(spark):
    df = spark.createDataFrame([(1, "Voda H2O a CO2 pri 37 °C, 5,5 mg a 10 nm. To je A.")], "chunk_id int, text string")
    got = {(r["text"], r["label"]) for r in entities.regex_entities(df).collect()}
    assert {("H2O", "CHEMICAL_FORMULA"), ("CO2", "CHEMICAL_FORMULA"), ("5,5 mg", "MEASUREMENT"), ("10 nm", "MEASUREMENT")} <= got
    assert ("To", "CHEMICAL_FORMULA") not in got and ("A", "CHEMICAL_FORMULA") not in got


@pytest.mark.parametrize(
    ("text", "label", "confidence", "kept"),
    [("dopamín", "HORMONE", 1.0, True), ("x", "SPACY_ORG", 1.0, False), ("Na", "CHEMICAL_FORMULA", 0.8, False), ("the", "TERM", 1.0, False), ("123", "TERM", 1.0, False),
     ("?!", "TERM", 1.0, False), ("leptin", "TERM", 0.29, False), ("leptin", "TERM", 0.3, True), ("V", "MEASUREMENT_UNIT", 1.0, False), ("UV", "TERM", 1.0, True), ("qq", "TERM", 1.0, False), (None, "TERM", 1.0, False)],
)
def test_entity_filter(spark, text, label, confidence, kept):
    df = spark.createDataFrame([(text, label, confidence)], "text string, label string, confidence double")
    assert entities.entity_filter(df).count() == int(kept)


def test_names_and_merging(spark):
    rows = [("Mitochondrie", 1.0), ("mitochondria", 0.8), ("  na  mitochondrií", 1.0), ("ATP", 1.0), ("atp", 0.5), ("atp", 0.5), ("the redox", 1.0), ("Redox", 1.0)]
    df = spark.createDataFrame([(t, "T", c) for t, c in rows], "text string, label string, confidence double")
    got = {r["normalized_name"]: r for r in entities.entity_merge(df).collect()}
    assert {k: r["mention_count"] for k, r in got.items()} == {"mitochondria": 3, "atp": 3, "redox": 2}
    assert (got["mitochondria"]["name"], got["atp"]["name"], got["redox"]["name"]) == ("mitochondria", "ATP", "Redox")
    assert got["atp"]["confidence"] == pytest.approx(2 / 3) and got["atp"]["variants"] == ["ATP", "atp"]


def _mentions(spark):
    rows = [(1, "a"), (1, "b"), (1, "A"), (2, "a"), (2, "b"), (2, "c"), (3, "b"), (3, "c"), (4, "d")]
    return spark.createDataFrame([(c, t, "T", 1.0, c // 3) for c, t in rows], "chunk_id int, text string, label string, confidence double, article_id int")


def test_graph(spark):
    m = _mentions(spark)
    edges = graph.cooccurrence(m)
    got = {(r["e1"], r["e2"]): r["strength"] for r in edges.collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 2, ("b", "c"): 2, ("c", "b"): 2}
    repeated = {(r["e1"], r["e2"]): r["strength"] for r in graph.pair_counts(m).collect()}
    assert repeated[("a", "b")] == 3
    asked = spark.createDataFrame([("a",), ("d",)], "entity string")
    near = {(r["entity"], r["neighbour"]): r["strength"] for r in graph.neighborhood(asked, edges).collect()}
    assert near == {("a", "b"): 2, ("a", "c"): 2}
    assert ("a", "a") in {(r["entity"], r["neighbour"]) for r in graph.neighborhood(asked, edges, include_start=True).collect()}
    nodes = graph.entity_nodes(m, forms=(), preferred=())
    context = {r["entity"]: [tuple(x) for x in r["related"]] for r in graph.entity_context(asked, nodes, edges).collect()}
    assert context == {"a": [("b", 2)], "d": []}
    assert {r["entity"]: r["community"] for r in graph.communities(edges).collect()} == {"a": "a", "b": "a", "c": "a"}


@pytest.mark.parametrize(("graph_score", "want"), [(0.0, 0.8), (0.199, 0.8398), (0.2, 0.76), (0.8, 0.94), (0.801, 0.9204)])
def test_fusion(spark, graph_score, want):
    got = spark.range(1).select(retrieval.fuse(F.lit(1.0), F.lit(graph_score))).first()[0]
    assert got == pytest.approx(want)


def test_top_k_is_exact(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "vec_id bigint, embedding array<double>").repartition(7)
    q = df.filter("vec_id % 20 = 0 and vec_id < 900").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = {}
    for row in vector.top_k(q, df, 5).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = row["vec_id"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i, ranks in got.items():
        assert [ranks[k] for k in range(1, 6)] == np.argsort(-(u @ u[i]), kind="stable")[:5].tolist()
    cells = vector.cell_centroids(df.filter("vec_id < 900"), 4)
    assert vector.nearest_cells(df.filter("vec_id < 900"), cells, 2).count() == 400


def test_answers(spark):
    queries = spark.createDataFrame([(1, "O svetlo"), (2, "x"), (3, "y")], "query_id int, query string")
    results = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.5, 2), (2, 10, 0.2, 1)], "query_id int, chunk_id int, similarity double, rank int")
    text = "krátke. Toto je dostatočne dlhá veta, ktorá niečo hovorí o svetle. Tento postup môžete použiť každý deň. http://x je odkaz na ďalšiu stránku s textom."
    chunks = spark.createDataFrame([(10, text, "A"), (11, "Druhý text. Ďalej", "B")], "chunk_id int, text string, title string")
    got = {r["query_id"]: r for r in retrieval.answers(queries, results, chunks).collect()}
    assert [got[i]["status"] for i in (1, 2, 3)] == ["answered", "low", "none"]
    assert got[1]["opening"].startswith("Svetlo") and len(got[1]["points"]) == 1 and got[1]["supporting"] == ["B: Druhý text."]
    assert got[1]["tips"] == ["Tento postup môžete použiť každý deň."]
