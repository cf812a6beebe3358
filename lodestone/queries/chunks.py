"""Queries that cut articles into chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import chunk as C
from lodestone.queries.common import ARTICLES, WORD, articles, count_sql, joined
from lodestone.queries.text import HEADERS, SEMANTIC, SENTENCES

#: Sizes that suit the short test documents.
SIZE, OVERLAP, CONTEXT = 60, 15, 30


def chunks(spark, sf_dir, *columns, headers=False):
    """Chunks with the named columns, or with all."""
    return C.fixed_chunks(articles(spark, sf_dir), SIZE, OVERLAP, CONTEXT, headers=headers, columns=columns or None)


def _long(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("bigint"))
    return df


def chunk_fixed(spark, sf_dir):
    c = chunks(spark, sf_dir, "chunk_id", "text", "word_count", "chunk_position", "sentence_start_idx", "sentence_end_idx")
    return _long(c, "chunk_id", "word_count", "sentence_start_idx", "sentence_end_idx")


def chunk_context(spark, sf_dir):
    c = chunks(spark, sf_dir, "chunk_id", "preceding_context", "following_context", "preceding_context_words", "following_context_words")
    c = c.select("article_id", "chunk_id", "preceding_context", "following_context", "preceding_context_words", "following_context_words")
    return _long(c, "chunk_id", "preceding_context_words", "following_context_words")


def chunk_adjacency(spark, sf_dir):
    c = chunks(spark, sf_dir, "chunk_id", "previous_chunk_id", "next_chunk_id", "chunk_sentence_count")
    c = c.select("article_id", "chunk_id", C.chunk_key(F.col("article_id"), F.col("chunk_id")).alias("chunk_key"), "previous_chunk_id", "next_chunk_id", "chunk_sentence_count")
    return _long(c, "chunk_id", "previous_chunk_id", "next_chunk_id", "chunk_sentence_count")


def chunk_stats(spark, sf_dir):
    s = C.chunk_stats(chunks(spark, sf_dir, "word_count"))
    return s.withColumn("avg_words", F.round("avg_words", 6))


def chunk_metadata(spark, sf_dir):
    """Chunks as flat records: null neighbours are -1, strings are cut."""
    a = articles(spark, sf_dir).select(F.col("doc_id").alias("article_id"), "url", "title", "date")
    c = chunks(spark, sf_dir, "chunk_id", "preceding_context", "previous_chunk_id", "next_chunk_id").join(a, "article_id")
    absent = lambda x: F.coalesce(x, F.lit(-1)).cast("bigint")
    return c.select(
        F.concat(F.lit("chunk_"), C.chunk_key(F.col("article_id"), F.col("chunk_id")).cast("string")).alias("id"),
        F.coalesce("url", F.lit("")).alias("source_url"),
        F.coalesce("title", F.lit("")).alias("source_title"),
        F.coalesce("date", F.lit("")).alias("source_date"),
        F.substring("preceding_context", 1, 200).alias("preceding"),
        absent(F.col("previous_chunk_id")).alias("previous"),
        absent(F.col("next_chunk_id")).alias("next"),
    )


def chunk_semantic(spark, sf_dir):
    c = C.semantic_chunks(articles(spark, sf_dir), smallest=15, largest=SIZE, amount=80.0)
    return _long(c, "chunk_id", "word_count")


def semantic_breaks(spark, sf_dir):
    d = C.sentence_distances(articles(spark, sf_dir)).filter(F.size("sents") > 2)
    kinds = [F.round(C.threshold(F.col("distances"), k, a), 6).alias(k) for k, a in (("percentile", 85.0), ("standard_deviation", 1.0), ("gradient", 85.0))]
    return d.select("article_id", F.size("distances").cast("bigint").alias("n"), *kinds)


def chunk_headers(spark, sf_dir):
    return chunks(spark, sf_dir, "chunk_id", "chunk_start_sentence", "chunk_end_sentence", headers=True).filter("chunk_id = 0").select("article_id", joined("article_section_headers"), "chunk_start_sentence", "chunk_end_sentence")


QUERIES = {f.__name__: f for f in (chunk_fixed, chunk_context, chunk_adjacency, chunk_stats, chunk_metadata, chunk_semantic, semantic_breaks, chunk_headers)}

#: A sentence's number, words, words before it, and the first sentence an overlap before it may start at.
CHUNKS = f"""sl AS (SELECT doc_id, {SENTENCES.replace("coalesce(text, '')", "coalesce(content, '')")} AS ss FROM articles WHERE length(trim(content)) >= 100),
se AS (SELECT doc_id, ss, len(ss) AS n, unnest(range(len(ss))) AS i, unnest(ss) AS s FROM sl),
sw AS (SELECT doc_id, n, i, s, {count_sql('s')} AS w FROM se),
sp AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) - w AS p FROM sw),
so AS (SELECT a.doc_id, a.i, min(b.i) AS o FROM sp a JOIN sp b ON a.doc_id = b.doc_id AND b.i <= a.i AND a.p - b.p <= {OVERLAP} GROUP BY 1, 2),
fold(doc_id, i, st, cs, ce) AS (
  SELECT doc_id, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM sl WHERE len(ss) > 0
  UNION ALL
  SELECT f.doc_id, x.i, CASE WHEN x.i > f.st AND x.p + x.w - b.p > {SIZE} THEN CASE WHEN x.i - f.st > 1 THEN greatest(f.st, so.o) ELSE x.i END ELSE f.st END,
    CASE WHEN x.i > f.st AND x.p + x.w - b.p > {SIZE} THEN f.st END, CASE WHEN x.i > f.st AND x.p + x.w - b.p > {SIZE} THEN x.i END
  FROM fold f JOIN sp x ON x.doc_id = f.doc_id AND x.i = f.i + 1 JOIN sp b ON b.doc_id = f.doc_id AND b.i = f.st JOIN so ON so.doc_id = x.doc_id AND so.i = x.i),
cc AS (
  SELECT doc_id, cs AS s0, ce AS e0 FROM fold WHERE cs IS NOT NULL
  UNION ALL SELECT f.doc_id, f.st, len(ss) FROM fold f JOIN sl ON sl.doc_id = f.doc_id AND f.i = len(ss) - 1),
ck AS (SELECT doc_id, s0, e0, row_number() OVER (PARTITION BY doc_id ORDER BY e0) - 1 AS chunk_id, count(*) OVER (PARTITION BY doc_id) AS nc FROM cc),
chunks AS (
  SELECT ck.doc_id AS article_id, chunk_id, s0, e0, nc, array_to_string(ss[s0 + 1 : e0], ' ') AS text, ss,
    (SELECT sum(w) FROM sp WHERE sp.doc_id = ck.doc_id AND i >= s0 AND i < e0)::BIGINT AS word_count,
    CASE WHEN chunk_id = nc - 1 AND chunk_id = 0 THEN 'complete' WHEN chunk_id = nc - 1 OR e0 >= len(ss) - 2 THEN 'end' WHEN chunk_id = 0 THEN 'beginning' ELSE 'middle' END AS chunk_position
  FROM ck JOIN sl ON sl.doc_id = ck.doc_id)"""
WITH_CHUNKS = f"WITH RECURSIVE {ARTICLES}, {CHUNKS}"
_CONTEXT = f"""ends AS (SELECT doc_id, n AS i, sum(w) AS p FROM sp GROUP BY doc_id, n UNION ALL SELECT doc_id, i, p FROM sp),
ctx AS (
  SELECT c.article_id, c.chunk_id, c.ss, c.s0, c.e0,
    (SELECT min(x.i) FROM ends x WHERE x.doc_id = c.article_id AND x.i <= c.s0 AND b.p - x.p <= {CONTEXT}) AS f,
    (SELECT max(x.i) FROM ends x WHERE x.doc_id = c.article_id AND x.i >= c.e0 AND x.p - e.p <= {CONTEXT}) AS l, b.p AS bp, e.p AS ep
  FROM chunks c JOIN ends b ON b.doc_id = c.article_id AND b.i = c.s0 JOIN ends e ON e.doc_id = c.article_id AND e.i = c.e0)"""
_KEY = "article_id * 1000000 + chunk_id"
_BUCKETS = f"list_transform(regexp_extract_all(lower(s), '{WORD}+'), lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT % 16)"
#: Vectors of sentences, distances of neighbours but for the first and the last, and a percentile.
SEMANTICS = f"""ms AS (SELECT doc_id, coalesce(content, '') AS raw, {SEMANTIC.replace("coalesce(text, '')", "coalesce(content, '')")} AS ss FROM articles),
mb AS (SELECT *, list_transform(ss, lambda s: {_BUCKETS}) AS bs FROM ms),
mv AS (SELECT *, list_transform(bs, lambda b: list_transform(range(16), lambda d: len(list_filter(b, lambda x: x = d))::DOUBLE)) AS vs FROM mb),
md AS (SELECT *, list_transform(range(1, greatest(len(ss) - 1, 1)), lambda i: CASE WHEN list_inner_product(vs[i], vs[i]) * list_inner_product(vs[i + 1], vs[i + 1]) > 0
  THEN 1 - list_inner_product(vs[i], vs[i + 1]) / sqrt(list_inner_product(vs[i], vs[i]) * list_inner_product(vs[i + 1], vs[i + 1])) ELSE 1.0 END::DOUBLE) AS ds FROM mv)"""


def _percentile(values: str, amount: float) -> str:
    o, at = f"list_sort({values})", f"((len({values}) - 1) * ({amount}::DOUBLE / 100.0::DOUBLE))"
    low, high = f"{o}[floor({at})::BIGINT + 1]", f"{o}[least(floor({at})::BIGINT + 1, len({values}) - 1) + 1]"
    return f"({low} + ({high} - {low}) * ({at} - floor({at})))"


_MEAN = "(list_sum(ds) / len(ds))"
_SLOPES = "list_transform(range(len(ds)), lambda i: abs((ds[least(i + 1, len(ds) - 1) + 1] - ds[greatest(i - 1, 0) + 1]) / (least(i + 1, len(ds) - 1) - greatest(i - 1, 0))))"

SQL = {
    "chunk_fixed": f"{WITH_CHUNKS} SELECT article_id, chunk_id, text, word_count, chunk_position, s0 AS sentence_start_idx, e0 - 1 AS sentence_end_idx FROM chunks",
    "chunk_context": f"""{WITH_CHUNKS}, {_CONTEXT}
SELECT article_id, chunk_id, array_to_string(ss[f + 1 : s0], ' ') AS preceding_context, array_to_string(ss[e0 + 1 : l], ' ') AS following_context,
  (bp - (SELECT p FROM ends x WHERE x.doc_id = article_id AND x.i = f))::BIGINT AS preceding_context_words, ((SELECT p FROM ends x WHERE x.doc_id = article_id AND x.i = l) - ep)::BIGINT AS following_context_words FROM ctx""",
    "chunk_adjacency": f"""{WITH_CHUNKS}
SELECT article_id, chunk_id, {_KEY} AS chunk_key, CASE WHEN chunk_id > 0 THEN chunk_id - 1 END AS previous_chunk_id, CASE WHEN chunk_id < nc - 1 THEN chunk_id + 1 END AS next_chunk_id, e0 - s0 AS chunk_sentence_count FROM chunks""",
    "chunk_stats": f"{WITH_CHUNKS} SELECT count(DISTINCT article_id) AS articles, count(*) AS chunks, round(avg(word_count), 6) AS avg_words FROM chunks",
    "chunk_headers": f"""{WITH_CHUNKS}
SELECT article_id, {HEADERS.replace('text', 'content')} AS article_section_headers, substr(ss[s0 + 1], 1, 150) || '...' AS chunk_start_sentence, substr(ss[e0], 1, 150) || '...' AS chunk_end_sentence
FROM chunks JOIN articles ON doc_id = article_id WHERE chunk_id = 0""",
    "semantic_breaks": f"""WITH {ARTICLES}, {SEMANTICS}
SELECT doc_id AS article_id, len(ds) AS n, round({_percentile('ds', 85.0)}, 6) AS percentile, round({_MEAN} + sqrt(list_sum(list_transform(ds, lambda x: (x - {_MEAN}) * (x - {_MEAN}))) / len(ds)), 6) AS standard_deviation,
  round(CASE WHEN len(ds) > 1 THEN {_percentile(_SLOPES, 85.0)} ELSE 0 END, 6) AS gradient FROM md WHERE len(ss) > 2""",
    "chunk_semantic": f"""WITH RECURSIVE {ARTICLES}, {SEMANTICS}, ml AS (SELECT *, {_percentile('ds', 80.0)} AS lim FROM md WHERE len(ss) > 2),
mc AS (SELECT doc_id, ss, list_concat([0], list_filter(range(1, len(ds) + 1), lambda i: ds[i] > lim)) AS st FROM ml),
mg AS (SELECT doc_id, ss, st, list_transform(range(len(st)), lambda k: list_sum(list_transform(ss[st[k + 1] + 1 : coalesce(st[k + 2], len(ss))], lambda x: {count_sql('x')}))::BIGINT) AS sz FROM mc),
mf(doc_id, k, s, n, cs, ce) AS (
  SELECT doc_id, 0::BIGINT, 0::BIGINT, sz[1], NULL::BIGINT, NULL::BIGINT FROM mg
  UNION ALL
  SELECT f.doc_id, f.k + 1, CASE WHEN f.n > 0 AND f.n + sz[f.k + 2] > {SIZE} THEN st[f.k + 2] ELSE f.s END, CASE WHEN f.n > 0 AND f.n + sz[f.k + 2] > {SIZE} THEN sz[f.k + 2] ELSE f.n + sz[f.k + 2] END,
    CASE WHEN f.n > 0 AND f.n + sz[f.k + 2] > {SIZE} THEN f.s END, CASE WHEN f.n > 0 AND f.n + sz[f.k + 2] > {SIZE} THEN st[f.k + 2] END
  FROM mf f JOIN mg USING (doc_id) WHERE f.k + 1 < len(st)),
mp AS (
  SELECT doc_id, cs AS s, ce AS e FROM mf WHERE cs IS NOT NULL
  UNION ALL SELECT f.doc_id, f.s, len(ss) FROM mf f JOIN mg USING (doc_id) WHERE f.k = len(st) - 1),
mt AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS chunk_id, array_to_string(ss[s + 1 : e], ' ') AS text FROM mp JOIN mg USING (doc_id)
  UNION ALL SELECT doc_id, 0, raw FROM md WHERE len(ss) <= 2)
SELECT doc_id AS article_id, chunk_id, text, {count_sql('text')} AS word_count FROM mt""",
    "chunk_metadata": f"""{WITH_CHUNKS}, {_CONTEXT}
SELECT 'chunk_' || ({_KEY}) AS id, coalesce(url, '') AS source_url, coalesce(title, '') AS source_title, coalesce(date, '') AS source_date, substr(array_to_string(x.ss[f + 1 : x.s0], ' '), 1, 200) AS preceding,
  CASE WHEN chunk_id > 0 THEN chunk_id - 1 ELSE -1 END AS previous, CASE WHEN chunk_id < nc - 1 THEN chunk_id + 1 ELSE -1 END AS next
FROM chunks c JOIN articles a ON a.doc_id = c.article_id JOIN ctx x USING (article_id, chunk_id)""",
}
