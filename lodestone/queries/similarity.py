"""Queries that compare documents with another version of them: the benchmark text whose number
is the document's id modulo the number of those texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import similarity as S
from lodestone.queries.common import ARTICLES, NOT_WORD, any_sql, articles, count_sql, pieces_sql, table, words_sql

SIGNS = ("clown", "avec", "with")
STOP = ("the", "and", "of")


def _pairs(spark, sf_dir):
    a = articles(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("text_b"))
    other = items.withColumn("title_b", F.substring("text_b", 1, 40))
    return a.withColumn("item_id", F.pmod("doc_id", F.lit(items.count()))).join(other, "item_id").select(F.col("doc_id").alias("pair_id"), F.col("content").alias("text_a"), "text_b", F.col("title").alias("title_a"), "title_b")


def doc_pair_similarity(spark, sf_dir):
    c = S.compare(_pairs(spark, sf_dir), stop=STOP, titles=False)
    return c.select("pair_id", *(F.round(x, 6).alias(x) for x in ("length_ratio", "word_count_ratio", "content_overlap", "similarity_score")))


def pair_issues(spark, sf_dir):
    c = S.compare(_pairs(spark, sf_dir), stop=STOP, titles=False)
    c = c.withColumn("title_similarity", S.jaccard(F.col("title_a"), F.col("title_b"), ())).withColumn("fetched_paywall", F.pmod("pair_id", F.lit(2)) == 0)
    issues = F.transform("issues", lambda x: F.concat(x["type"], F.lit(":"), x["severity"]))
    return S.pair_issues(c, SIGNS).select("pair_id", F.array_join(issues, "|").alias("issues"))


def pair_structure(spark, sf_dir):
    s = S.pair_structure(_pairs(spark, sf_dir))
    return s.select("pair_id", *(F.round(f"{x}_ratio", 6).alias(f"{x}_ratio") for x in ("char_count", "word_count", "sentence_count", "paragraph_count")), F.col("word_count_difference").cast("bigint").alias("word_count_difference"))


def title_similarity(spark, sf_dir):
    """The character-level ratio of titles, for which neither engine has a function of its own."""
    p = _pairs(spark, sf_dir)
    S.ship(spark)
    return p.select("pair_id", F.round(S.sequence_ratio(S.normalized(F.col("title_a")), S.normalized(F.col("title_b"))), 6).alias("title_similarity"))


def unique_sentences(spark, sf_dir):
    """The first five sentences of either text that the other has nothing like."""
    u = S.unique_sentences(_pairs(spark, sf_dir))
    return u.select("pair_id", "side", F.col("place").cast("bigint").alias("place"), "sentence")


QUERIES = {f.__name__: f for f in (doc_pair_similarity, pair_issues, pair_structure, title_similarity, unique_sentences)}

_STOP = ", ".join(f"'{s}'" for s in STOP)


def _norm(x: str) -> str:
    return words_sql(f"lower(regexp_replace({x}, '{NOT_WORD}', ' ', 'g'))")


_PAIRS = f"""{ARTICLES}, pairs AS (SELECT doc_id AS pair_id, content AS a, text AS b, title AS ta, substr(text, 1, 40) AS tb FROM articles JOIN benchmark ON item_id = doc_id % (SELECT count(*) FROM benchmark))"""
_RATIO = "CASE WHEN {a} > 0 AND {b} > 0 THEN least({a}, {b})::DOUBLE / greatest({a}, {b}) WHEN {a} = 0 AND {b} = 0 THEN 1 ELSE 0 END"
_COMPARED = f"""w AS (SELECT pair_id, a, b, ta, tb, list_filter({_norm('a')}, lambda x: x NOT IN ({_STOP})) AS wa, list_filter({_norm('b')}, lambda x: x NOT IN ({_STOP})) AS wb FROM pairs),
ca AS (SELECT pair_id, u AS x, count(*) AS n FROM (SELECT pair_id, unnest(wa) AS u FROM w) GROUP BY 1, 2),
cb AS (SELECT pair_id, u AS x, count(*) AS n FROM (SELECT pair_id, unnest(wb) AS u FROM w) GROUP BY 1, 2),
d AS (SELECT pair_id, sum(ca.n * cb.n) AS d FROM ca JOIN cb USING (pair_id, x) GROUP BY 1), sa AS (SELECT pair_id, sum(n * n) AS s FROM ca GROUP BY 1), sb AS (SELECT pair_id, sum(n * n) AS s FROM cb GROUP BY 1),
j AS (SELECT *, list_distinct(wa) AS da, list_distinct(wb) AS db FROM w),
compared AS (SELECT pair_id, a, ta, tb, {_RATIO.format(a='length(a)', b='length(b)')} AS length_ratio, {_RATIO.format(a=count_sql('a'), b=count_sql('b'))} AS word_count_ratio,
  CASE WHEN len(da) > 0 AND len(db) > 0 THEN len(list_intersect(da, db))::DOUBLE / (len(da) + len(db) - len(list_intersect(da, db))) ELSE 0 END AS content_overlap,
  coalesce(d.d::DOUBLE / sqrt(sa.s::DOUBLE * sb.s), 0) AS similarity_score FROM j LEFT JOIN d USING (pair_id) LEFT JOIN sa USING (pair_id) LEFT JOIN sb USING (pair_id))"""
_TITLES = f"(SELECT CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) ELSE 0 END FROM (SELECT list_distinct({_norm('ta')}) AS x, list_distinct({_norm('tb')}) AS y))"


def _lines(x: str) -> str:
    return f"len(list_filter(string_split({x}, chr(10)), lambda s: trim(s) <> ''))"


SQL = {
    "doc_pair_similarity": f"WITH {_PAIRS}, {_COMPARED} SELECT pair_id, round(length_ratio, 6) AS length_ratio, round(word_count_ratio, 6) AS word_count_ratio, round(content_overlap, 6) AS content_overlap, round(similarity_score, 6) AS similarity_score FROM compared",
    "pair_issues": f"""WITH {_PAIRS}, {_COMPARED}
SELECT pair_id, array_to_string(list_filter([CASE WHEN length_ratio < 0.2 THEN 'length_mismatch:critical' WHEN length_ratio < 0.5 THEN 'length_mismatch:major' END,
  CASE WHEN content_overlap < 0.1 THEN 'content_mismatch:critical' WHEN content_overlap < 0.3 THEN 'content_mismatch:major' END, CASE WHEN {_TITLES} < 0.7 THEN 'title_mismatch:minor' END,
  CASE WHEN {any_sql('lower(a)', SIGNS)} <> (pair_id % 2 = 0) THEN 'paywall_status_change:major' END, CASE WHEN word_count_ratio < 0.3 THEN 'word_count_change:major' END], lambda x: x IS NOT NULL), '|') AS issues FROM compared""",
    "pair_structure": f"""WITH {_PAIRS} SELECT pair_id, round({_RATIO.format(a='length(a)', b='length(b)')}, 6) AS char_count_ratio, round({_RATIO.format(a=count_sql('a'), b=count_sql('b'))}, 6) AS word_count_ratio,
  round({_RATIO.format(a=f"len({pieces_sql('a')})", b=f"len({pieces_sql('b')})")}, 6) AS sentence_count_ratio, round({_RATIO.format(a=_lines('a'), b=_lines('b'))}, 6) AS paragraph_count_ratio,
  abs({count_sql('a')} - {count_sql('b')}) AS word_count_difference FROM pairs""",
}
