"""Queries that search.  Documents stand for chunks; the vector of a document, and of a benchmark
question, is the one of the same number."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import entities as E
from lodestone.operators import graph as G
from lodestone.operators import retrieval as R
from lodestone.operators import vector as V
from lodestone.operators.packs import DEFAULT_ANSWER
from lodestone.plans import scratch
from lodestone.queries.common import ARTICLES, LEXICON_SQL, any_sql, articles, lexicon, strip_sql, table
from lodestone.queries.entities import STEMS, clear_sql, found_sql

K = 5
SKIPPED, TIPS = ("clown", "www."), ("with", "avec", "nicht")
TOPICS = (("license", "On licenses:"), ("the", "In English:"))


def vector_topk(spark, sf_dir):
    """The nearest vectors to every vector whose id is divisible by twenty, over all vectors."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    t = V.top_k(q, e, 10)
    return t.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def _chunks(spark, sf_dir):
    return articles(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("content").alias("text"), "title")


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _content(spark, sf_dir):
    """The entities of each document, written once as most steps read them."""
    m = E.without_overlaps(E.lexicon_entities(_chunks(spark, sf_dir), lexicon(spark)))
    return scratch.written(m.select(F.col("id").alias("chunk_id"), F.lower("text").alias("entity"), "text", "label", "confidence").filter(F.length("text") > 2))


def _parts(spark, sf_dir):
    """What the steps of a search read, each part written once."""
    content = _content(spark, sf_dir)
    edges = scratch.written(G.cooccurrence(content))
    asked = scratch.written(E.query_entities(_queries(spark, sf_dir), lexicon(spark), STEMS).withColumnRenamed("id", "query_id"))
    nodes = G.entity_nodes(content, forms=(), preferred=())
    context = scratch.written(G.entity_context(asked, nodes, edges))
    near = scratch.written(G.neighborhood(asked, edges, top=50))
    e = table(spark, sf_dir, "embeddings")
    q = _queries(spark, sf_dir).join(e, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("query_vec"))
    hits = V.top_k(q, e, 2 * K).select("query_id", F.col("vec_id").alias("chunk_id"), "similarity")
    hits = scratch.written(hits.join(_chunks(spark, sf_dir).select("chunk_id"), "chunk_id", "left_semi"))
    return content, asked, context, near, hits


def _results(spark, sf_dir, parts):
    content, asked, context, near, hits = parts
    relevance = R.graph_relevance(hits, content, asked, context, near)
    return R.rerank(hits, relevance, _chunks(spark, sf_dir), K)


def graph_relevance(spark, sf_dir):
    content, asked, context, near, hits = _parts(spark, sf_dir)
    r = R.graph_relevance(hits, content, asked, context, near)
    return r.select("query_id", "chunk_id", F.round("graph_relevance", 6).alias("graph_relevance"))


def hybrid_search(spark, sf_dir):
    r = _results(spark, sf_dir, _parts(spark, sf_dir))
    return r.select("query_id", "chunk_id", *(F.round(c, 6).alias(c) for c in ("similarity", "graph_relevance", "combined")), F.col("rank").cast("bigint").alias("rank"))


def result_relationships(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return R.result_relationships(_results(spark, sf_dir, parts), parts[0], parts[2])


def entity_summary(spark, sf_dir):
    """Query entities with the best documents of the first question that asks for them."""
    content, asked, context, _, hits = _parts(spark, sf_dir)
    first = asked.groupBy("entity").agg(F.min("query_id").alias("query_id"))
    ranked = hits.withColumn("rank", F.expr("row_number() over (partition by query_id order by round(similarity, 9) desc, chunk_id)")).filter("rank <= 5")
    s = R.entity_summary(context, first.join(ranked, "query_id").select("entity", "chunk_id", "rank"), _chunks(spark, sf_dir))
    return s.select("entity", "name", "label", "mention_count", F.size("samples").cast("bigint").alias("samples"), F.array_join("titles", "|").alias("titles"))


def answer_extract(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    a = R.answers(_queries(spark, sf_dir), _results(spark, sf_dir, parts), _chunks(spark, sf_dir), SKIPPED, TIPS, TOPICS)
    return a.select("query_id", "status", "opening", *(F.array_join(c, "|").alias(c) for c in ("points", "supporting", "tips")), "source", F.round("similarity", 6).alias("similarity"))


def qa_pairs(spark, sf_dir):
    return R.qa_pairs(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (vector_topk, graph_relevance, hybrid_search, result_relationships, entity_summary, answer_extract, qa_pairs)}

_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_PARTS = f"""WITH RECURSIVE {ARTICLES}, {LEXICON_SQL}, kd AS (SELECT doc_id AS chunk_id, content AS text FROM articles), {found_sql('fd', 'kd')}, {clear_sql('fd')},
content AS (SELECT chunk_id, lower(text) AS entity, text, label FROM fd_clear WHERE length(text) > 2),
kq AS (SELECT item_id AS chunk_id, text FROM benchmark), {found_sql('fq', 'kq')},
sw AS (SELECT item_id, unnest(list_transform(string_split_regex(lower(text), '[ \\n]+'), lambda x: regexp_replace(x, '[^\\p{{L}}]', '', 'g'))) AS x FROM benchmark),
stem AS (SELECT item_id, CASE x {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in STEMS)} END AS e FROM sw),
asked AS (SELECT chunk_id AS query_id, lower(text) AS entity FROM fq WHERE length(text) > 2 UNION SELECT item_id, e FROM stem WHERE e IS NOT NULL),
en AS (SELECT DISTINCT chunk_id, entity AS e FROM content),
ep AS (SELECT a.e AS e1, b.e AS e2, count(*) AS strength FROM en a JOIN en b ON a.chunk_id = b.chunk_id AND a.e < b.e GROUP BY 1, 2 HAVING count(*) >= 2),
edges AS (SELECT e1, e2, strength FROM ep UNION ALL SELECT e2, e1, strength FROM ep),
known AS (SELECT DISTINCT entity FROM asked WHERE entity IN (SELECT entity FROM content)),
er AS (SELECT *, row_number() OVER (PARTITION BY e1 ORDER BY strength DESC, e2) AS p FROM edges),
related AS (SELECT entity AS wanted, e2 AS entity, strength, least(strength / 1000.0, 0.5)::DOUBLE AS part, p FROM known JOIN er ON e1 = entity WHERE p <= 10),
starts AS (SELECT DISTINCT entity FROM asked),
one AS (SELECT entity, e2, strength FROM starts JOIN edges ON e1 = entity),
two AS (SELECT entity, e2 AS neighbour, strength FROM one UNION ALL SELECT o.entity, e.e2, o.strength FROM one o JOIN edges e ON e.e1 = o.e2),
nsum AS (SELECT entity, neighbour, sum(strength) AS strength FROM two WHERE neighbour <> entity GROUP BY 1, 2),
near AS (SELECT entity, neighbour FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY strength DESC, neighbour) AS k FROM nsum) WHERE k <= 50),
qnear AS (SELECT DISTINCT query_id, neighbour FROM asked JOIN near USING (entity)),
sims AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_COS} AS similarity FROM embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings b),
hits AS (SELECT query_id, chunk_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, chunk_id) AS k FROM sims) WHERE k <= {2 * K} AND chunk_id IN (SELECT doc_id FROM documents)),
each AS (SELECT h.query_id, h.chunk_id, a.entity AS wanted,
    CASE WHEN EXISTS (SELECT 1 FROM en WHERE en.chunk_id = h.chunk_id AND en.e = a.entity) THEN 1.0 ELSE 0 END
    + coalesce((SELECT sum(part) FROM related r JOIN en ON en.e = r.entity WHERE r.wanted = a.entity AND en.chunk_id = h.chunk_id), 0)
    + 0.3 * least((SELECT count(*) FROM en JOIN qnear q ON q.neighbour = en.e WHERE en.chunk_id = h.chunk_id AND q.query_id = h.query_id)::DOUBLE / (SELECT count(*) FROM en WHERE en.chunk_id = h.chunk_id), 1) AS score
  FROM hits h JOIN asked a USING (query_id) WHERE h.chunk_id IN (SELECT chunk_id FROM en)),
relevance AS (SELECT h.query_id, h.chunk_id, h.similarity, coalesce((SELECT sum(least(score, 1)) FROM each e WHERE e.query_id = h.query_id AND e.chunk_id = h.chunk_id) / (SELECT count(*) FROM asked a WHERE a.query_id = h.query_id), 0)::DOUBLE AS graph_relevance FROM hits h),
fused AS (SELECT *, CASE WHEN graph_relevance > 0.8 THEN 0.6 * similarity + 0.4 * graph_relevance WHEN graph_relevance < 0.2 THEN 0.8 * similarity + 0.2 * graph_relevance ELSE 0.7 * similarity + 0.3 * graph_relevance END AS combined FROM relevance),
results AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY round(combined, 9) DESC, chunk_id) AS rank FROM fused f JOIN documents ON doc_id = chunk_id
  WHERE combined > 0.3 AND similarity > 0.2 AND length(trim(text)) > 50) WHERE rank <= {K})"""

_NODES = """cm AS (SELECT regexp_replace(entity, '^(?:a|the|na|v|o|do|pre|pri|od|za) +', '') AS name, text, label FROM content),
ct0 AS (SELECT name, text, label, count(*) AS n FROM cm GROUP BY 1, 2, 3), ct AS (SELECT *, sum(n) OVER (PARTITION BY name, text) AS times FROM ct0),
cr AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY times * 10 + 5
  + CASE WHEN upper(text) = text AND lower(text) <> text AND length(text) <= 5 THEN 50 WHEN length(text) > 1 AND upper(text[1]) = text[1] AND lower(text[1]) <> text[1] AND lower(text[2:]) = text[2:] THEN 20 ELSE 0 END DESC, text, label) AS k FROM ct),
cn AS (SELECT name AS normalized_name, max(text) FILTER (k = 1) AS best, max(label) FILTER (k = 1) AS label, sum(n)::BIGINT AS mention_count FROM cr GROUP BY cr.name),
kn AS (SELECT DISTINCT entity, best AS name, label, mention_count FROM asked JOIN cn ON entity = lower(best) OR entity = normalized_name),
qf AS (SELECT entity, min(query_id) AS query_id FROM asked GROUP BY 1),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, chunk_id) AS rank FROM hits),
sf AS (SELECT entity, count(*) FILTER (rank <= 3) AS samples, array_to_string(list_sort(list_distinct(list(title))), '|') AS titles FROM qf JOIN hr USING (query_id) JOIN articles ON doc_id = chunk_id WHERE rank <= 5 GROUP BY 1)"""
_BLANKS = r"[ \t\n\x0B\f\r]+"
_CAPITAL = "upper(s[1]) || s[2:]"
_ANSWERS = f"""best AS (SELECT r.query_id, r.rank, r.similarity, a.content AS text, a.title FROM results r JOIN articles a ON a.doc_id = r.chunk_id),
also AS (SELECT query_id, string_agg(title || ': ' || CASE WHEN contains(substr(text, 1, 150), '.') THEN split_part(substr(text, 1, 150), '.', 1) || '.' ELSE substr(text, 1, 150) END, '|' ORDER BY rank) AS supporting
  FROM best WHERE rank BETWEEN 2 AND 3 AND similarity > 0.4 GROUP BY 1),
top AS (SELECT * FROM best WHERE rank = 1 AND similarity >= 0.3),
said AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_BLANKS}', '\\1' || chr(1), 'g'), chr(1))[1:8], lambda s: {strip_sql('s')}),
  lambda s: length(s) > 40 AND length(s) < 300 AND NOT {any_sql('lower(s)', SKIPPED)}) AS ps,
  list_filter(list_transform(string_split(text, '. '), lambda s: lower({strip_sql('s')})), lambda s: {any_sql('s', TIPS)} AND length(s) > 20 AND length(s) < 150) AS ts FROM top),
told AS (SELECT *, CASE WHEN len(ps) > 0 THEN list_transform(list_transform(ps, lambda s: CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END), lambda s: {_CAPITAL})[1:3]
  ELSE [CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END] END AS points FROM said)"""
_OPENING = "CASE " + " ".join(f"WHEN contains(lower(b.text), '{w}') THEN '{t}'" for w, t in TOPICS) + f" ELSE '{DEFAULT_ANSWER}' END"

SQL = {
    "entity_summary": f"{_PARTS}, {_NODES} SELECT entity, name, label, mention_count, samples, titles FROM kn LEFT JOIN sf USING (entity)",
    "answer_extract": f"""{_PARTS}, {_ANSWERS}
SELECT b.item_id AS query_id, CASE WHEN t.query_id IS NOT NULL THEN 'answered' WHEN b.item_id IN (SELECT query_id FROM best) THEN 'low' ELSE 'none' END AS status,
  CASE WHEN t.query_id IS NOT NULL THEN {_OPENING} END AS opening, array_to_string(points, '|') AS points, CASE WHEN t.query_id IS NOT NULL THEN coalesce(supporting, '') END AS supporting,
  array_to_string(list_transform(ts, lambda s: {_CAPITAL} || CASE WHEN ends_with(s, '.') THEN '' ELSE '.' END)[1:2], '|') AS tips, t.title AS source, round(t.similarity, 6) AS similarity
FROM benchmark b LEFT JOIN told t ON t.query_id = b.item_id LEFT JOIN also ON also.query_id = b.item_id""",
    "vector_topk": f"""
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 10""",
    "graph_relevance": f"{_PARTS} SELECT query_id, chunk_id, round(graph_relevance, 6) AS graph_relevance FROM relevance",
    "hybrid_search": f"{_PARTS} SELECT query_id, chunk_id, round(similarity, 6) AS similarity, round(graph_relevance, 6) AS graph_relevance, round(combined, 6) AS combined, rank FROM results",
    "result_relationships": f"{_PARTS} SELECT query_id, r.chunk_id, wanted AS entity1, x.entity AS entity2, strength FROM results r JOIN en a ON a.chunk_id = r.chunk_id JOIN related x ON x.wanted = a.e AND x.p <= 5 JOIN en b ON b.chunk_id = r.chunk_id AND b.e = x.entity",
    "qa_pairs": """
WITH t AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text AS question, answer FROM t WHERE role = 'user' AND next_role = 'assistant'""",
}
