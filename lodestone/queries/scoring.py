"""Queries that score articles and sum the scores up."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import scoring as S
from lodestone.queries.common import (
    ARTICLES, MARKETING, NOT_WORD, PAYWALL, REVIEW, WS, any_sql, articles, count_sql, joined, pieces_sql, present_sql, rounded, strip_sql, substring_count_sql, table, words_sql,
)


def qa_paywall(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", F.round(S.review_paywall(F.col("content"), REVIEW), 6).alias("paywall_score"))


def qa_validate(spark, sf_dir):
    r = S.review(articles(spark, sf_dir), REVIEW)
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), "|")
    return r.select("doc_id", names("issues").alias("issues"), names("warnings").alias("warnings"), F.round("quality_score", 6).alias("quality_score"), "category", "suitable")


def qa_summary(spark, sf_dir):
    return rounded(S.review_summary(S.review(articles(spark, sf_dir), REVIEW)), "avg_quality")


def qa_issue_histogram(spark, sf_dir):
    return S.issue_histogram(S.review(articles(spark, sf_dir), REVIEW))


def qa_vs_labels(spark, sf_dir):
    """The review against the labels of quality."""
    r = S.review(articles(spark, sf_dir), REVIEW).select("doc_id", "suitable")
    return r.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "suitable").agg(F.count("*").alias("n"))


def paywall_score(spark, sf_dir):
    p = S.paywall(articles(spark, sf_dir), PAYWALL)
    return rounded(p.select("doc_id", "indicator_confidence", "truncated", "commercial", "content_quality", "confidence", "detected", "level", joined("recommendations")), "indicator_confidence", "content_quality", "confidence")


def paywall_structure(spark, sf_dir):
    return S.paywall(articles(spark, sf_dir), PAYWALL).select("doc_id", "abrupt_ending", "suspiciously_short")


def paywall_summary(spark, sf_dir):
    return rounded(S.paywall_summary(S.paywall(articles(spark, sf_dir), PAYWALL)), "avg_quality")


def paywall_simple(spark, sf_dir):
    return S.paywall_simple(articles(spark, sf_dir), PAYWALL).select("doc_id", F.col("indicators_found").cast("bigint").alias("indicators_found"), "detected")


def paywall_exact(spark, sf_dir):
    return S.paywall_exact(articles(spark, sf_dir), PAYWALL.exact).groupBy("status").agg(F.count("*").alias("articles"))


def marketing_score(spark, sf_dir):
    m = articles(spark, sf_dir).select("doc_id", S.marketing(F.col("content"), MARKETING).alias("m"))
    return m.select("doc_id", F.col("m.score").cast("bigint").alias("score"), F.round("m.confidence", 6).alias("confidence"))


def _reviewed(spark, sf_dir):
    return S.content_review(articles(spark, sf_dir), MARKETING)


def content_quality(spark, sf_dir):
    r = _reviewed(spark, sf_dir)
    return r.select("doc_id", F.round("review.quality", 6).alias("quality"), F.array_join("review.issues", "|").alias("issues"), "needs_cleaning", F.round("cleanliness", 6).alias("cleanliness"))


def content_summary(spark, sf_dir):
    return rounded(S.content_summary(_reviewed(spark, sf_dir)), "needs_cleaning_share", "avg_cleanliness")


def corpus_stats(spark, sf_dir):
    c = S.corpus_stats(articles(spark, sf_dir))
    c = c.withColumn("median", F.col("median").cast("double")).withColumn("min", F.col("min").cast("bigint")).withColumn("max", F.col("max").cast("bigint"))
    return rounded(c, "mean", "median", "stdev", "q1", "q3")


def short_articles(spark, sf_dir):
    return S.short_articles(articles(spark, sf_dir)).select("doc_id", F.col("word_count").cast("bigint").alias("word_count"))


def full_articles(spark, sf_dir):
    return S.full_articles(articles(spark, sf_dir)).select("doc_id", F.col("word_count").cast("bigint").alias("word_count"))


def articles_by_year(spark, sf_dir):
    year = F.coalesce(F.year(F.try_to_timestamp("date")).cast("string"), F.lit("unknown"))
    return articles(spark, sf_dir).groupBy(year.alias("year")).agg(F.count("*").alias("articles"), F.sum("word_count").cast("bigint").alias("words"))


def corpus_size(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.groupBy("source", "lang").agg(F.count("*").alias("files"), F.sum(F.coalesce(F.col("word_count"), F.lit(0))).cast("bigint").alias("total_words"))


def article_rollup(spark, sf_dir):
    a = articles(spark, sf_dir)
    total = lambda c: F.when(F.grouping(c) == 1, "*").otherwise(F.col(c)).alias(c)
    r = a.rollup("lang", "source").agg(F.count("*").alias("articles"), F.sum("word_count").cast("bigint").alias("words"), F.grouping("lang").alias("gl"), F.grouping("source").alias("gs"))
    return r.select(F.when(F.col("gl") == 1, "*").otherwise(F.col("lang")).alias("lang"), F.when(F.col("gs") == 1, "*").otherwise(F.col("source")).alias("source"), "articles", "words")


QUERIES = {f.__name__: f for f in (qa_paywall, qa_validate, qa_summary, qa_issue_histogram, qa_vs_labels, paywall_score, paywall_structure, paywall_summary, paywall_simple, paywall_exact, marketing_score, content_quality, content_summary, corpus_stats, short_articles, full_articles, articles_by_year, corpus_size, article_rollup)}


def _sum(terms) -> str:
    return "(" + " + ".join(terms) + ")" if terms else "0"


def _has(x: str, needle: str, value: float) -> str:
    return f"contains({x}, '{needle}')::INT * {value}"


_LOW = "lower(coalesce(content, ''))"
_QA_PAYWALL = f"least(({_sum([_has(_LOW, i, 2.0 if any(s in i for s in REVIEW.strong) else 1.0) for i in REVIEW.indicators])} + {_sum([_has(_LOW, t, 1.5) for t in REVIEW.truncation])})::DOUBLE / 3, 1)"


def _tag(when: str, name: str) -> str:
    return f"CASE WHEN {when} THEN '{name}' END"


_MISSING = [f"CASE WHEN coalesce({c}, '') = '' THEN 'missing_{c}' END" for c in ("url", "title", "content", "date")]
REVIEWED = f"""facts AS (
  SELECT *, {count_sql("coalesce(content, '')")} AS n, {_QA_PAYWALL} AS paywall,
    len(list_filter(string_split(coalesce(content, ''), chr(10)), lambda x: {strip_sql('x')} <> '')) AS filled,
    {words_sql(_LOW)} AS low, coalesce(title, '') AS t, coalesce(url, '') AS u FROM articles),
judged AS (
  SELECT *, list_filter([{_tag('n < 50', 'extremely_short')}, {_tag('paywall > 0.8', 'paywall')}, {_tag('n >= 50 AND n < 200', 'short')}], lambda x: x IS NOT NULL) AS issues,
    list_filter([{_tag("coalesce(content, '') = ''", 'empty_content')}, {_tag("coalesce(content, '') <> '' AND filled < 3", 'few_lines')},
      {_tag("coalesce(content, '') <> '' AND len(list_distinct(low)) < len(low) * 0.3", 'repetition')}, {', '.join(_MISSING)},
      {_tag("u <> '' AND NOT starts_with(u, 'http')", 'invalid_url')}, {_tag('length(t) < 10', 'short_title')}, {_tag('length(t) > 200', 'long_title')}], lambda x: x IS NOT NULL) AS warnings
  FROM facts),
reviewed AS (
  SELECT *, greatest(0.0, least(1.0, 1.0 - 0.4 * (CASE WHEN n < 50 THEN 1.0 ELSE 0 END + CASE WHEN paywall > 0.8 THEN paywall ELSE 0 END)
      - 0.2 * (CASE WHEN n >= 50 AND n < 200 THEN 0.8 ELSE 0 END)
      - 0.1 * coalesce(list_sum(list_transform(warnings, lambda w: CASE WHEN w IN ('few_lines', 'short_title') THEN 0.7 WHEN w IN ('repetition', 'long_title') THEN 0.6 WHEN w = 'invalid_url' THEN 0.8 ELSE 1.0 END)), 0)
      + CASE WHEN word_count > 1000 THEN 0.1 WHEN word_count > 500 THEN 0.05 ELSE 0 END
      + ((u <> '')::INT + (t <> '')::INT + (coalesce(content, '') <> '')::INT + (coalesce(date, '') <> '')::INT + (coalesce(excerpt, '') <> '')::INT) / 5.0 * 0.1))::DOUBLE AS quality_score,
    CASE WHEN n < 50 OR paywall > 0.8 THEN 'critical' WHEN n >= 50 AND n < 200 THEN 'major' WHEN len(warnings) > 0 THEN 'minor' ELSE 'good' END AS category FROM judged),
final AS (SELECT *, quality_score > 0.6 AND category <> 'critical' AND n >= 200 AS suitable FROM reviewed)"""

_BUCKETS = "count(*) FILTER ({x} < 0.3) AS score_poor, count(*) FILTER ({x} >= 0.3 AND {x} < 0.6) AS score_fair, count(*) FILTER ({x} >= 0.6 AND {x} < 0.8) AS score_good, count(*) FILTER ({x} >= 0.8) AS score_excellent"
_TITLE = "lower(coalesce(title, ''))"
_WEIGHT = f"({_sum([f'{substring_count_sql(_LOW, k)} * {w}' for k, w in PAYWALL.weights])} + {_sum([_has(_TITLE, k, w * 0.5) for k, w in PAYWALL.weights])})::DOUBLE"


def _found(patterns) -> str:
    return _sum([f"regexp_matches(low, '(?i){p}')::INT" for p in patterns])


SCORED = f"""f AS (
  SELECT doc_id, coalesce(content, '') AS c, {_LOW} AS low, least({_WEIGHT} / 10, 1) AS indicator_confidence, {count_sql("coalesce(content, '')")} AS n FROM articles),
g AS (
  SELECT *, {_found(PAYWALL.truncation)} > 0 AS truncated, {_found(PAYWALL.commercial)} > 0 AS commercial,
    len(list_filter({pieces_sql('c')}, lambda s: length(s) > 10)) AS meaningful, {_found(PAYWALL.degradation)} AS degraded,
    CASE WHEN n > 0 THEN {_sum([substring_count_sql('low', k) for k in PAYWALL.filler])}::DOUBLE / n ELSE 0 END AS filler,
    lower(array_to_string(string_split(c, '.')[-3:], '.')) AS tail FROM f),
h AS (
  SELECT *, greatest(0, 1.0::DOUBLE - CASE WHEN n < 50 THEN 0.5 WHEN n < 200 THEN 0.2 ELSE 0 END - CASE WHEN meaningful < 3 THEN 0.3 ELSE 0 END
    - 0.2 * degraded - CASE WHEN filler > 0.1 THEN filler * 0.5 ELSE 0 END) AS content_quality FROM g),
i AS (SELECT *, indicator_confidence + CASE WHEN truncated THEN 0.3 ELSE 0 END + CASE WHEN commercial THEN 0.2 ELSE 0 END AS raised FROM h),
j AS (SELECT *, least(CASE WHEN content_quality > 0.8 THEN raised * 0.7 ELSE raised END, 1)::DOUBLE AS confidence FROM i),
scored AS (SELECT *, confidence > 0.4 AS detected, CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence > 0.5 THEN 'medium' WHEN confidence > 0.2 THEN 'low' ELSE 'very_low' END AS level FROM j)"""
_ADVICE = """list_filter([CASE WHEN detected THEN CASE WHEN confidence > 0.8 THEN 'exclude' WHEN confidence > 0.5 THEN 'review_manually' ELSE 'investigate' END END,
  CASE WHEN truncated THEN 'fetch_again' END, CASE WHEN commercial THEN 'filter_promotion' END,
  CASE WHEN content_quality < 0.5 THEN 'exclude_poor' WHEN content_quality < 0.7 THEN 'review_quality' END,
  CASE WHEN NOT detected AND content_quality > 0.7 THEN 'suitable' END], lambda x: x IS NOT NULL)"""


def _marketing(x: str) -> str:
    refs = [f"(CASE WHEN len(regexp_extract_all({x}, '(?:^|{NOT_WORD})({w})(?:$|{NOT_WORD})')) > -1 THEN len(list_filter(string_split_regex({x}, '{NOT_WORD}+'), lambda t: t = '{w}')) END)" for w in ("the", "und")]
    return _sum([f"2 * {substring_count_sql(x, k)}" for k in MARKETING.marketing] + [substring_count_sql(x, k) for k in (*MARKETING.navigation, *MARKETING.meta)] + [f"(CASE WHEN {r} > 3 THEN {r} ELSE 0 END)" for r in refs])


_REVIEW_TEXT = strip_sql(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(content, ''), '{WS}+', ' ', 'g'), '(?i)\[r\]', '', 'g'), '\[[0-9]+\]', '', 'g'), '(?i)https?://[^ ]+|www\.[^ ]+', '', 'g')")
CONTENT = f"""rt AS (SELECT doc_id, {_REVIEW_TEXT} AS t, len(list_filter(string_split(coalesce(content, ''), chr(10) || chr(10)), lambda p: {strip_sql('p')} <> '')) AS paragraphs FROM articles),
rf AS (SELECT *, {count_sql('t')} AS n, len(string_split_regex(t, '[.!?]+')) AS ends, {words_sql('lower(t)')} AS low, {pieces_sql('t')} AS ps, {_marketing('lower(t)')} AS score FROM rt),
rg AS (SELECT *, CASE WHEN len(ps) > 0 THEN list_sum(list_transform(ps, lambda s: {count_sql('s')}))::DOUBLE / len(ps) END AS mean,
  least(score::DOUBLE / greatest(n / 100.0, 1), 1) AS confidence FROM rf),
rh AS (SELECT *, CASE WHEN t = '' THEN ['empty'] ELSE list_filter([{_tag('n < 100', 'very_short')}, {_tag('n >= 100 AND n < 300', 'short')}, {_tag('ends < 5', 'few_sentences')},
  {_tag('paragraphs < 2', 'poor_paragraphs')}, {_tag('len(list_distinct(low)) < len(low) * 0.4', 'repetition')}, {_tag('mean < 5', 'short_sentences')}, {_tag('mean > 30', 'long_sentences')}], lambda x: x IS NOT NULL) END AS issues FROM rg),
ri AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE greatest(0, 1 - coalesce(list_sum(list_transform(issues, lambda x: CASE WHEN x = 'very_short' THEN 0.3 WHEN x IN ('few_sentences', 'repetition') THEN 0.2 ELSE 0.1 END)), 0)) END::DOUBLE AS quality FROM rh),
content_reviewed AS (SELECT *, confidence > 0.3 OR round(quality, 9) < 0.6 OR len(issues) > 2 AS needs_cleaning, (1 - confidence) * 0.4 + quality * 0.6 AS cleanliness FROM ri)"""
_QUARTILES = """o AS (SELECT word_count::DOUBLE AS v, row_number() OVER (ORDER BY word_count) AS r FROM articles),
m AS (SELECT count(*) AS n FROM articles),
k AS (SELECT n, greatest(1, least((q * (n + 1)) // 4, n - 1)) AS j, q, q * (n + 1) AS p FROM m, (VALUES (1), (3)) q(q)),
qs AS (SELECT q, (a.v * (4 - (p - 4 * j)) + b.v * (p - 4 * j)) / 4 AS v FROM k JOIN o a ON a.r = j JOIN o b ON b.r = j + 1)"""

SQL = {
    "qa_paywall": f"WITH {ARTICLES} SELECT doc_id, round({_QA_PAYWALL}, 6) AS paywall_score FROM articles",
    "qa_validate": f"WITH {ARTICLES}, {REVIEWED} SELECT doc_id, array_to_string(issues, '|') AS issues, array_to_string(warnings, '|') AS warnings, round(quality_score, 6) AS quality_score, category, suitable FROM final",
    "qa_summary": f"""WITH {ARTICLES}, {REVIEWED} SELECT count(*) AS articles, count(*) FILTER (category = 'critical') AS critical_articles, count(*) FILTER (category = 'major') AS major_articles,
  count(*) FILTER (category = 'minor') AS minor_articles, count(*) FILTER (category = 'good') AS good_articles, count(*) FILTER (suitable) AS suitable_articles, round(avg(quality_score), 6) AS avg_quality,
  {_BUCKETS.format(x='quality_score')}, count(*) FILTER (category = 'critical') > 0.2 * count(*) AS many_critical, avg(quality_score) < 0.7 AS low_quality FROM final""",
    "qa_issue_histogram": f"""WITH {ARTICLES}, {REVIEWED}, e AS (SELECT unnest(list_concat(issues, warnings)) AS name FROM final)
SELECT CASE WHEN name IN ('extremely_short', 'paywall') THEN 'critical' WHEN name = 'short' THEN 'major' ELSE 'warning' END AS type, name, count(*) AS n FROM e GROUP BY 1, 2""",
    "qa_vs_labels": f"WITH {ARTICLES}, {REVIEWED} SELECT quality, suitable, count(*) AS n FROM final JOIN labels USING (doc_id) GROUP BY 1, 2",
    "paywall_score": f"WITH {ARTICLES}, {SCORED} SELECT doc_id, round(indicator_confidence, 6) AS indicator_confidence, truncated, commercial, round(content_quality, 6) AS content_quality, round(confidence, 6) AS confidence, detected, level, CASE WHEN len({_ADVICE}) > 0 THEN array_to_string({_ADVICE}, '|') ELSE 'no_issues' END AS recommendations FROM scored",
    "paywall_structure": f"WITH {ARTICLES}, {SCORED} SELECT doc_id, c <> '' AND {any_sql('tail', PAYWALL.endings)} AS abrupt_ending, n < 100 AS suspiciously_short FROM scored",
    "paywall_summary": f"""WITH {ARTICLES}, {SCORED} SELECT count(*) AS articles, count(*) FILTER (detected) AS detected_articles, count(*) FILTER (level = 'high') AS high_articles, count(*) FILTER (level = 'medium') AS medium_articles,
  count(*) FILTER (level = 'low') AS low_articles, count(*) FILTER (level = 'very_low') AS very_low_articles, count(*) FILTER (truncated) AS truncated_articles, count(*) FILTER (commercial) AS commercial_articles,
  round(avg(content_quality), 6) AS avg_quality, count(*) FILTER (NOT detected AND content_quality > 0.7) AS suitable_articles FROM scored""",
    "paywall_simple": f"WITH {ARTICLES} SELECT doc_id, {present_sql(f'({_LOW} || chr(1) || {_TITLE})', PAYWALL.simple)} AS indicators_found, {present_sql(f'({_LOW} || chr(1) || {_TITLE})', PAYWALL.simple)} > 0 AS detected FROM articles",
    "paywall_exact": f"WITH {ARTICLES} SELECT CASE WHEN coalesce(content, '') = '' THEN 'failed' WHEN contains(content, '{PAYWALL.exact}') THEN 'paywalled' ELSE 'free' END AS status, count(*) AS articles FROM articles GROUP BY 1",
    "marketing_score": f"WITH {ARTICLES}, s AS (SELECT doc_id, content, {_marketing('lower(content)')} AS score FROM articles) SELECT doc_id, score, round(least(score::DOUBLE / greatest({count_sql('content')} / 100.0, 1), 1), 6) AS confidence FROM s",
    "content_quality": f"WITH {ARTICLES}, {CONTENT} SELECT doc_id, round(quality, 6) AS quality, array_to_string(issues, '|') AS issues, needs_cleaning, round(cleanliness, 6) AS cleanliness FROM content_reviewed",
    "content_summary": f"""WITH {ARTICLES}, {CONTENT} SELECT count(*) AS articles, count(*) FILTER (needs_cleaning) AS needs_cleaning, round(avg(needs_cleaning::INT), 6) AS needs_cleaning_share, count(*) FILTER (confidence > 0.5) AS marketing_high,
  count(*) FILTER (confidence > 0.2 AND confidence <= 0.5) AS marketing_medium, count(*) FILTER (confidence <= 0.2) AS marketing_low, round(avg(cleanliness), 6) AS avg_cleanliness, {_BUCKETS.format(x='round(quality, 9)')} FROM content_reviewed""",
    "corpus_stats": f"""WITH {ARTICLES}, {_QUARTILES} SELECT count(*) AS articles, sum(word_count)::BIGINT AS total_words, round(avg(word_count), 6) AS mean, round(median(word_count::DOUBLE), 6) AS median, round(stddev_samp(word_count), 6) AS stdev,
  min(word_count) AS min, max(word_count) AS max, round((SELECT v FROM qs WHERE q = 1), 6) AS q1, round((SELECT v FROM qs WHERE q = 3), 6) AS q3 FROM articles""",
    "short_articles": f"WITH {ARTICLES}, {_QUARTILES} SELECT doc_id, word_count FROM articles WHERE word_count < greatest(50, (SELECT v FROM qs WHERE q = 1) * 0.3) OR length(content) < 200",
    "full_articles": f"WITH {ARTICLES}, {_QUARTILES} SELECT doc_id, word_count FROM articles WHERE length(title) > 10 AND length(content) > 1000 AND word_count > greatest((SELECT v FROM qs WHERE q = 3), (SELECT median(word_count::DOUBLE) FROM articles) * 1.5)",
    "articles_by_year": f"WITH {ARTICLES} SELECT coalesce(substr(date, 1, 4), 'unknown') AS year, count(*) AS articles, sum(word_count)::BIGINT AS words FROM articles GROUP BY 1",
    "corpus_size": f"WITH {ARTICLES} SELECT source, lang, count(*) AS files, sum(word_count)::BIGINT AS total_words FROM articles GROUP BY 1, 2",
    "article_rollup": f"WITH {ARTICLES} SELECT CASE WHEN grouping(lang) = 1 THEN '*' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN '*' ELSE source END AS source, count(*) AS articles, sum(word_count)::BIGINT AS words FROM articles GROUP BY ROLLUP (lang, source)",
}
