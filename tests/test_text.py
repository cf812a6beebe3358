"""Text functions, cleaning and scores against restatements in Python."""

import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import clean, scoring, similarity

TEXTS = [
    "", None, "One.  Two !Three...... four--five ---- six .Seven", "a\u00a0b\u2003c", "Header:\nHEADER\n# note\nplain line of more than eight words which is not one\nlast:",
    "Toto je prvá veta článku. Druhá veta je dlhšia! Tretia? Áno.Štvrtá veta", "x" * 200_000,
]


def column(spark, expression, texts=TEXTS):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["x"] for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_words(spark):
    assert column(spark, T.word_count(F.col("t"))) == [len((t or "").split()) for t in TEXTS]


def test_clean_text_and_sentences(spark):
    def cleaned(t):
        t = re.sub(r"\s+", " ", t or "")
        t = re.sub(r"-{2,}", "--", re.sub(r"\.{3,}", "...", t))
        t = re.sub(r"\s+([.,;:!?])", r"\1", t)
        return re.sub(r"([.!?])\s*([A-ZÁÄČĎÉÍĹĽŇÓÔŔŠŤÚÝŽ])", r"\1 \2", t).strip()

    assert column(spark, T.clean_text(F.col("t"))) == [cleaned(t) for t in TEXTS]
    want = [[s.strip() for s in re.split(r"[.!?]+(?:\s|$)", t or "") if len(s.strip()) > 10] for t in TEXTS]
    assert column(spark, T.sentences(F.col("t"))) == want


def test_headers(spark):
    assert column(spark, T.section_headers(F.col("t")))[4] == ["Header:", "HEADER", "# note", "last:"]


def test_phrases(spark):
    got = column(spark, T.phrases(F.col("t"), ("the", "and"), 3, 4), ["the quick brown foxes and", "the and the", "two words"])
    assert got[0] == ["the quick brown", "quick brown foxes", "brown foxes and", "the quick brown foxes", "quick brown foxes and"]
    assert got[1:] == [[], []]


def test_empty_sections(spark):
    made = ["A:\nB:\ntext", "A:\n\n\n\n\ntext", "A:\n\n\n\ntext", "end:"]
    assert column(spark, clean.without_empty_sections(F.col("t")), made) == ["A:\nB:\ntext", "\n\n\n\ntext", "A:\n\n\n\ntext", ""]


def test_cleaner_edges(spark):
    made = ["Veta jedna [12] a [R] www.site.sk koniec.", "Text. Klikni sem a čítaj. Koniec vety.", "Hore.\nPodobné články: a b", "á\u00a0\u00a0 , b"]
    got = column(spark, clean.clean(F.col("t")), made)
    assert got == ["Veta jedna  a  koniec.", "Text. Koniec vety.", "Hore.", "á, b"]


def test_exclusive_quartiles(spark):
    values = spark.createDataFrame([(v,) for v in (1, 2, 4, 5, 8, 16, 33)], "v int")
    row = scoring.value_quartiles(values, "v").first()
    assert (row["n"], row["q1"], row["q3"]) == (7, 2.0, 16.0)
    assert scoring.value_quartiles(values.limit(3), "v").first()["q1"] is None
    array = values.agg(F.sort_array(F.collect_list("v")).alias("a"))
    assert array.select(scoring.exclusive_quartile(F.col("a"), 1)).first()[0] == 2.0


def test_review_of_missing_values(spark):
    rows = spark.createDataFrame([(None, None, None, None, None, None)], "url string, title string, content string, date string, excerpt string, word_count int")
    r = scoring.review(rows).first()
    assert r["category"] == "critical" and not r["suitable"] and 0 <= r["quality_score"] <= 1
    assert {w["name"] for w in r["warnings"]} == {"empty_content", "missing_url", "missing_title", "missing_content", "missing_date", "short_title"}


@pytest.mark.parametrize(("score", "bucket"), [(0.0, "poor"), (0.3, "fair"), (0.6, "good"), (1.0, "excellent")])
def test_buckets_cover_all_scores(spark, score, bucket):
    row = spark.createDataFrame([(score,)], "s double").agg(*scoring.buckets(F.col("s"))).first()
    assert row[f"score_{bucket}"] == 1 and sum(row) == 1


def test_pairs(spark):
    rows = [(1, "Alpha beta gamma. Delta epsilon zeta.", "alpha beta gammas! Other words here.", "Title one", "Title two"), (2, None, "x", "", None), (3, "same text", "same text", "t", "t")]
    df = spark.createDataFrame(rows, "pair_id int, text_a string, text_b string, title_a string, title_b string")
    got = {r["pair_id"]: r for r in similarity.compare(df, stop=()).collect()}
    assert got[1]["title_similarity"] == SequenceMatcher(None, "title one", "title two").ratio()
    assert got[1]["content_overlap"] == pytest.approx(2 / 10) and got[3]["similarity_score"] == pytest.approx(1.0)
    assert got[2]["length_ratio"] == 0.0 and got[2]["similarity_score"] == 0.0
    issues = {r["pair_id"]: [i["type"] for i in r["issues"]] for r in similarity.pair_issues(similarity.compare(df, stop=()).withColumn("fetched_paywall", F.lit(False))).collect()}
    assert issues[3] == [] and "length_mismatch" in issues[2]
    unique = sorted((r["pair_id"], r["side"], r["sentence"]) for r in similarity.unique_sentences(df).collect())
    assert unique == [(1, "a", "Delta epsilon zeta"), (1, "b", "Other words here"), (2, "b", "x")]
