"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import clean
from lodestone.operators import phrases as P
from lodestone.operators.similarity import jaccard
from lodestone.queries.common import ARTICLES, CLEANING, MARKETING, NOT_WORD, WORD, WS, articles, count_sql, joined, pieces_sql, present_sql, strip_sql, table, words_sql

MARKERS = ("license", "copyright", "version", "general", "public")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def word_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("words"), F.rank().over(_by_words()).cast("bigint").alias("place_in_source"))


def _by_words():
    from pyspark.sql import Window

    return Window.partitionBy("source").orderBy(T.word_count(F.col("text")).desc())


def text_stats(spark, sf_dir):
    s = _docs(spark, sf_dir).select("doc_id", T.text_stats(F.col("text")).alias("s")).select("doc_id", "s.*")
    counts = ("char_count", "word_count", "sentence_count", "paragraph_count")
    return s.select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in counts), F.round("avg_word_length", 6).alias("avg_word_length"), F.round("avg_sentence_length", 6).alias("avg_sentence_length"))


def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


def sentences(spark, sf_dir):
    each = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(T.clean_text(F.col("text")))).alias("place", "sentence"))
    return each.select("doc_id", F.col("place").cast("bigint").alias("place"), "sentence")


def section_headers(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.section_headers(F.col("text")).alias("headers")).select("doc_id", joined("headers"))


def clean_article(spark, sf_dir):
    out = clean.clean_articles(articles(spark, sf_dir), CLEANING)
    return out.select("doc_id", "cleaned", F.col("original_word_count").cast("bigint").alias("original_word_count"), F.col("cleaned_word_count").cast("bigint").alias("cleaned_word_count"))


def cleaning_stats(spark, sf_dir):
    stats = clean.cleaning_stats(articles(spark, sf_dir), CLEANING)
    return stats.select("articles", "removed_marketing", "removed_references", "removed_navigation", "removed_footer", "words_removed")


def marker_score(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", clean.marker_score(F.col("text"), MARKERS).cast("bigint").alias("markers"))


def pdf_clean(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.pdf_clean(F.col("text")).alias("cleaned"))


def embedding_text(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.select("doc_id", T.embedding_text(F.col("title"), F.col("excerpt"), F.col("content"), F.lit("")).alias("passage"))


def semantic_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.semantic_sentences(F.col("text"))).cast("bigint").alias("sentences"))


def query_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.query_text(F.col("text")).alias("query"))


def safe_filename(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", T.safe_filename(F.col("title")).alias("filename"))


def jaccard_excerpt(spark, sf_dir):
    """Overlap of each article with the benchmark text of its id modulo their number."""
    a = articles(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "other")
    return a.withColumn("item_id", F.pmod("doc_id", F.lit(items.count()))).join(items, "item_id").select("doc_id", F.round(jaccard(F.col("content"), F.col("other"), ()), 6).alias("overlap"))


def top_words(spark, sf_dir):
    """The fifty most frequent longer words: a report of a fixed length."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\w{4,}\b"), F.lit(0)))
    counts = _docs(spark, sf_dir).select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(50)


def top_phrases(spark, sf_dir):
    """The thirty most frequent phrases: a report of a fixed length."""
    return P.top_phrases(_docs(spark, sf_dir), MARKETING.function_words)


QUERIES = {f.__name__: f for f in (word_counts, text_stats, clean_text, sentences, section_headers, clean_article, cleaning_stats, marker_score, pdf_clean, embedding_text, semantic_sentences, query_text, safe_filename, jaccard_excerpt, top_words, top_phrases)}

_UPPER = "A-ZÁÄČĎÉÍĹĽŇÓÔŔŠŤÚÝŽ"
CLEAN_TEXT = strip_sql(
    rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g'), '\.{{3,}}', '...', 'g'), '-{{2,}}', '--', 'g'), '{WS}+([.,;:!?])', '\1', 'g'), '([.!?]){WS}*([{_UPPER}])', '\1 \2', 'g')"
)
SENTENCES = f"list_filter(list_transform(string_split_regex({CLEAN_TEXT}, '[.!?]+(?:{WS}|$)'), lambda s: {strip_sql('s')}), lambda s: length(s) > 10)"
_KEYWORD = rf"(^|{NOT_WORD})(?:with|avec|nicht|para)(?:[^\p{{L}}\p{{M}}\p{{N}}_.][^.]*)?\."
_STEPS = [
    (f"(?is){_KEYWORD}", r"\1"),
    ("(?is)(clown|idiot)", ""),
    (r"\[[0-9]+\]", ""),
    (rf"(?i)reserved{WS}*>>", ""),
    (rf"(?is)all{WS}+rights{WS}+reserved.*", ""),
]
_SPACING = [(r"\n{4,}", r"\n\n\n"), (r"[ \t]{3,}", "  "), (rf"\n{WS}*\n{WS}*\n", r"\n\n"), (rf"{WS}+([.,!?;:])", r"\1"), (rf"([.,!?;:]){WS}{{2,}}", r"\1 ")]


def _fold(x: str, rules) -> str:
    for pattern, by in rules:
        by = f"'{by}'" if r"\n" not in by else "'" + by.replace(r"\n", "' || chr(10) || '") + "'"
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return x


_SPACED = strip_sql(_fold(_fold("coalesce(content, '')", _STEPS), _SPACING))
_SAYS = f"({strip_sql('x')} <> '' AND NOT ends_with({strip_sql('x')}, ':'))"
CLEANED = f"""spaced AS (SELECT doc_id, content, string_split({_SPACED}, chr(10)) AS ls FROM articles),
cleaned AS (
  SELECT doc_id, content, array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i:
    NOT ends_with({strip_sql('ls[i]')}, ':') OR len(list_filter(ls[i + 1 : i + 4], lambda x: {_SAYS})) > 0), lambda i: ls[i]), chr(10)) AS cleaned
  FROM spaced)"""
_HEADING = f"""length(l) > 0 AND length(l) < 100 AND ((upper(l) = l AND lower(l) <> l)
  OR (ends_with(l, ':') AND strpos(l, ':') = length(l)) OR starts_with(l, '#') OR {count_sql('l')} <= 8)"""
HEADERS = f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda l: {_HEADING})[1:5], '|')"
_FLAT = strip_sql(f"regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g')")
#: RE2 looks neither ahead nor behind: what a split must keep is kept by a mark after or before it.
_FINE = rf"string_split(regexp_replace({_FLAT}, '[.!?]+ ([{_UPPER}0-9])', chr(1) || '\1', 'g'), chr(1))"
_PLAIN = f"string_split(replace({_FLAT}, '. ', '.' || chr(1)), chr(1))"
SEMANTIC = f"list_filter(list_transform(CASE WHEN len({_FINE}) > 1 THEN {_FINE} ELSE {_PLAIN} END, lambda s: {strip_sql('s')}), lambda s: length(s) > 10)"
_LETTERS = f"list_sum(list_transform({words_sql('text')}, lambda w: length(w)))"


def _counted(n: int) -> str:
    x = _fold("content", _STEPS[:n])
    return f"len(regexp_extract_all({x}, '{_STEPS[n][0]}'))"


SQL = {
    "word_counts": f"SELECT doc_id, {count_sql('text')} AS words, rank() OVER (PARTITION BY source ORDER BY {count_sql('text')} DESC) AS place_in_source FROM documents",
    "text_stats": f"""
WITH s AS (SELECT doc_id, text, {count_sql('text')} AS w, len({pieces_sql('text')}) AS p,
  len(list_filter(string_split(text, chr(10)), lambda s: {strip_sql('s')} <> '')) AS l, coalesce({_LETTERS}, 0) AS c FROM documents)
SELECT doc_id, length(text) AS char_count, w AS word_count, p AS sentence_count, l AS paragraph_count,
  round(CASE WHEN w > 0 THEN c::DOUBLE / w ELSE 0 END, 6) AS avg_word_length,
  round(CASE WHEN p > 0 THEN w::DOUBLE / p ELSE 0 END, 6) AS avg_sentence_length FROM s""",
    "clean_text": f"SELECT doc_id, {CLEAN_TEXT} AS cleaned FROM documents",
    "sentences": f"""
WITH s AS (SELECT doc_id, {SENTENCES} AS ss FROM documents)
SELECT doc_id, unnest(range(len(ss))) AS place, unnest(ss) AS sentence FROM s""",
    "section_headers": f"SELECT doc_id, {HEADERS} AS headers FROM documents",
    "clean_article": f"""
WITH {ARTICLES}, {CLEANED}
SELECT doc_id, cleaned, {count_sql('content')} AS original_word_count, {count_sql('cleaned')} AS cleaned_word_count FROM cleaned""",
    "cleaning_stats": f"""
WITH {ARTICLES}, {CLEANED}
SELECT count(*) AS articles, sum({_counted(0)} + {_counted(1)})::BIGINT AS removed_marketing, sum({_counted(2)})::BIGINT AS removed_references,
  sum({_counted(3)})::BIGINT AS removed_navigation, sum(least({_counted(4)}, 1))::BIGINT AS removed_footer,
  sum({count_sql('content')} - {count_sql('cleaned')})::BIGINT AS words_removed FROM cleaned""",
    "marker_score": f"SELECT doc_id, {present_sql('lower(text)', MARKERS)} AS markers FROM documents",
    "embedding_text": f"""
WITH {ARTICLES}
SELECT doc_id, 'passage: ' || concat_ws(' | ', CASE WHEN title <> '' THEN 'Title: ' || title END,
  CASE WHEN length({strip_sql('excerpt')}) > 20 THEN 'Context before: ' || substr({strip_sql('excerpt')}, 1, 150) END, 'Content: ' || content) AS passage FROM articles""",
    "semantic_sentences": f"SELECT doc_id, len({SEMANTIC}) AS sentences FROM documents",
    "query_text": f"SELECT item_id, 'query: ' || {strip_sql('text')} AS query FROM benchmark",
    "pdf_clean": rf"""
SELECT doc_id, {strip_sql(rf"regexp_replace(regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '[^{WORD[1:-1]} .,;:!?()\[\]{{}}/\\\x22''-]', ' ', 'g'), '(^|{NOT_WORD})[0-9]+{WS}*$', '\1')")} AS cleaned FROM documents""",
    "safe_filename": rf"""
WITH {ARTICLES}
SELECT doc_id, substr(replace({strip_sql("regexp_replace(title, '[^\\p{L}\\p{N} _-]', '', 'g')")}, ' ', '_'), 1, 50) AS filename FROM articles""",
    "jaccard_excerpt": f"""
WITH t AS (SELECT doc_id, list_distinct({words_sql(f"lower(regexp_replace(d.text, '{NOT_WORD}', ' ', 'g'))")}) AS a, list_distinct({words_sql(f"lower(regexp_replace(b.text, '{NOT_WORD}', ' ', 'g'))")}) AS b
  FROM documents d JOIN benchmark b ON item_id = doc_id % (SELECT count(*) FROM benchmark))
SELECT doc_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0 END, 6) AS overlap FROM t""",
    "top_phrases": f"""
WITH s AS (SELECT unnest(string_split_regex(lower(text), '[.!?]+')) AS s FROM documents),
w AS (SELECT list_filter(regexp_extract_all(s, '{WORD}+'), lambda x: length(x) >= 3) AS w FROM s),
g AS (SELECT w, n.n AS n, unnest(range(len(w) - n.n + 1)) AS i FROM w, (VALUES (3), (4), (5), (6), (7), (8)) n(n) WHERE len(w) >= n.n),
p AS (SELECT w[i + 1 : i + n] AS p FROM g)
SELECT array_to_string(p, ' ') AS phrase, count(*) AS n FROM p
WHERE len(list_filter(p, lambda x: length(x) > 3 AND x NOT IN ({', '.join(f"'{x}'" for x in MARKETING.function_words)}))) > 0
GROUP BY 1 ORDER BY n DESC, phrase LIMIT 30""",
    "top_words": f"""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '{WORD}+')) AS word FROM documents)
SELECT word, count(*) AS n FROM w WHERE length(word) >= 4 GROUP BY word ORDER BY n DESC, word LIMIT 50""",
}
