"""Queries over the entity graph of the chunks' mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.plans import scratch
from lodestone.queries.chunks import WITH_CHUNKS, chunks
from lodestone.queries.common import ARTICLES, articles, joined
from lodestone.queries.entities import FORMS, MENTIONS, keyed_chunks, mentions

PREFERRED = (("person", ("idiot",)),)
ASKED = ("clown", "license", "avec", "with", "nowhere")


def _mentions(spark, sf_dir):
    """Read more than once by most of these queries, so written once."""
    return scratch.written(mentions(spark, sf_dir))


def _nodes(m):
    return G.entity_nodes(m, forms=FORMS, preferred=PREFERRED)


def _articles(spark, sf_dir):
    return articles(spark, sf_dir).withColumnRenamed("doc_id", "article_id")


def _asked(spark):
    return spark.createDataFrame([(a,) for a in ASKED], "entity string")


def graph_tables(spark, sf_dir):
    """The nodes and edges of the entity graph."""
    m = _mentions(spark, sf_dir)
    return _nodes(m), G.cooccurrence(m)


def entity_nodes(spark, sf_dir):
    n = _nodes(_mentions(spark, sf_dir))
    return n.select("normalized_name", "name", "label", "mention_count", "chunk_count")


def article_nodes(spark, sf_dir):
    return G.article_nodes(chunks(spark, sf_dir, "chunk_id"), _articles(spark, sf_dir))


def chunk_article_join(spark, sf_dir):
    c = G.chunk_articles(chunks(spark, sf_dir, "chunk_id"), _articles(spark, sf_dir))
    return c.select("article_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "title", "url")


def mention_edges(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    return G.mention_edges(m, _nodes(m), exact=True).groupBy("name").agg(F.count("*").alias("mentions"), F.count_distinct("chunk_id").alias("chunks"))


def cooccurrence(spark, sf_dir):
    return G.cooccurrence(_mentions(spark, sf_dir))


def strongest_edges(spark, sf_dir):
    """Which concepts are connected most: the twenty strongest edges, a report of a fixed length."""
    e = G.cooccurrence(mentions(spark, sf_dir)).filter("e1 < e2")
    return e.orderBy(F.desc("strength"), "e1", "e2").limit(20)


def cooccurrence_edges(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    return G.edges_between_nodes(G.cooccurrence(m), _nodes(m))


def cooccurrence_analysis(spark, sf_dir):
    c = G.connections(G.pair_counts(_mentions(spark, sf_dir)))
    return c.select("entity", "total_connections", "unique_connections", joined("strongest"))


def graph_stats(spark, sf_dir):
    c = scratch.written(keyed_chunks(spark, sf_dir))
    m = scratch.written(mentions(spark, sf_dir, c))
    nodes = _nodes(m)
    return G.graph_stats(nodes, G.article_nodes(c, _articles(spark, sf_dir)), c, G.cooccurrence(m), G.mention_edges(m, nodes, exact=True))


def entity_context(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    c = G.entity_context(_asked(spark), _nodes(m), G.cooccurrence(m))
    names = F.array_join(F.transform("related", lambda r: F.concat(r["name"], F.lit(":"), r["strength"].cast("string"))), "|")
    return c.select("entity", "name", "label", "mention_count", names.alias("related"))


def neighborhood_2hop(spark, sf_dir):
    return G.neighborhood(_asked(spark), G.cooccurrence(_mentions(spark, sf_dir)), top=10)


def communities(spark, sf_dir):
    return G.communities(G.cooccurrence(_mentions(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (entity_nodes, article_nodes, chunk_article_join, mention_edges, cooccurrence, strongest_edges, cooccurrence_edges, cooccurrence_analysis, graph_stats, entity_context, neighborhood_2hop, communities)}

NODES = f"""m AS (SELECT (SELECT CASE {' '.join(f"WHEN t = '{a}' THEN '{b}'" for a, b in FORMS)} ELSE t END FROM (SELECT regexp_replace(lower(text), '^(?:a|the|na|v|o|do|pre|pri|od|za) +', '') AS t)) AS name, text, label FROM mentions),
mt0 AS (SELECT name, text, label, count(*) AS n FROM m GROUP BY 1, 2, 3), mt AS (SELECT *, sum(n) OVER (PARTITION BY name, text) AS times FROM mt0),
mr AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY (CASE WHEN name = 'person' AND text = 'idiot' THEN 1000 ELSE 0 END) + times * 10 + 5
  + CASE WHEN upper(text) = text AND lower(text) <> text AND length(text) <= 5 THEN 50 WHEN length(text) > 1 AND upper(text[1]) = text[1] AND lower(text[1]) <> text[1] AND lower(text[2:]) = text[2:] THEN 20 ELSE 0 END DESC, text, label) AS k FROM mt),
mc AS (SELECT lower(text) AS low, count(DISTINCT chunk_id) AS chunk_count FROM mentions GROUP BY 1),
nm AS (SELECT name AS normalized_name, max(text) FILTER (k = 1) AS best, max(label) FILTER (k = 1) AS label, sum(n)::BIGINT AS mention_count FROM mr GROUP BY mr.name),
nodes AS (SELECT normalized_name, best AS name, label, mention_count, chunk_count FROM nm LEFT JOIN mc ON low = lower(best))"""
EDGES = """en AS (SELECT DISTINCT chunk_id, trim(lower(text)) AS e FROM mentions),
ep AS (SELECT a.e AS e1, b.e AS e2, count(*) AS strength FROM en a JOIN en b ON a.chunk_id = b.chunk_id AND a.e < b.e GROUP BY 1, 2 HAVING count(*) >= 2),
edges AS (SELECT e1, e2, strength FROM ep UNION ALL SELECT e2, e1, strength FROM ep)"""
_ASKED = "asked(entity) AS (VALUES " + ", ".join(f"('{a}')" for a in ASKED) + ")"
SQL = {
    "entity_nodes": f"{MENTIONS}, {NODES} SELECT * FROM nodes",
    "article_nodes": f"{WITH_CHUNKS} SELECT article_id, any_value(title) AS title, any_value(url) AS url, count(*) AS chunk_count FROM chunks JOIN articles ON doc_id = article_id GROUP BY 1",
    "chunk_article_join": f"{WITH_CHUNKS} SELECT article_id, chunk_id, title, url FROM chunks JOIN articles ON doc_id = article_id",
    "mention_edges": f"{MENTIONS}, {NODES} SELECT name, count(*) AS mentions, count(DISTINCT chunk_id) AS chunks FROM mentions JOIN nodes ON text = name GROUP BY 1",
    "cooccurrence": f"{MENTIONS}, {EDGES} SELECT * FROM edges",
    "strongest_edges": f"{MENTIONS}, {EDGES} SELECT * FROM edges WHERE e1 < e2 ORDER BY strength DESC, e1, e2 LIMIT 20",
    "cooccurrence_edges": f"{MENTIONS}, {NODES}, {EDGES} SELECT a.name AS name1, b.name AS name2, strength FROM edges JOIN (SELECT DISTINCT name FROM nodes) a ON lower(a.name) = e1 JOIN (SELECT DISTINCT name FROM nodes) b ON lower(b.name) = e2",
    "cooccurrence_analysis": f"""{MENTIONS}, n AS (SELECT chunk_id, lower(text) AS e, count(*) AS n FROM mentions GROUP BY 1, 2),
p AS (SELECT a.e AS e1, b.e AS e2, sum(a.n * b.n)::BIGINT AS strength FROM n a JOIN n b ON a.chunk_id = b.chunk_id AND a.e <> b.e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY e1 ORDER BY strength DESC, e2) AS k FROM p)
SELECT e1 AS entity, sum(strength)::BIGINT AS total_connections, count(*) AS unique_connections, string_agg(e2, '|' ORDER BY k) FILTER (k <= 5) AS strongest FROM r GROUP BY 1""",
    "graph_stats": f"""{MENTIONS}, {NODES}, {EDGES}, deg AS (SELECT e1 AS key, count(*) * 2 AS value FROM edges GROUP BY 1 ORDER BY value DESC, key LIMIT 10)
SELECT 'entities' AS stat, '' AS key, count(*) AS value FROM nodes UNION ALL SELECT 'articles', '', count(DISTINCT article_id) FROM chunks UNION ALL SELECT 'chunks', '', count(*) FROM chunks
UNION ALL SELECT 'co_occurs', '', count(*) FROM edges UNION ALL SELECT 'mentioned_in', '', count(*) FROM mentions JOIN nodes ON text = name
UNION ALL SELECT 'type', label, count(*) FROM nodes GROUP BY label UNION ALL SELECT 'degree', key, value FROM deg""",
    "entity_context": f"""{MENTIONS}, {NODES}, {EDGES}, {_ASKED}, k AS (SELECT DISTINCT entity, name, label, mention_count FROM asked JOIN nodes ON entity = lower(name) OR entity = normalized_name),
r AS (SELECT *, row_number() OVER (PARTITION BY e1 ORDER BY strength DESC, e2) AS p FROM edges),
b AS (SELECT e1, string_agg(e2 || ':' || strength, '|' ORDER BY p) AS related FROM r WHERE p <= 10 GROUP BY 1)
SELECT entity, name, label, mention_count, coalesce(related, '') AS related FROM k LEFT JOIN b ON e1 = lower(name)""",
    "neighborhood_2hop": f"""{MENTIONS}, {EDGES}, {_ASKED}, one AS (SELECT entity, e2, strength FROM asked JOIN edges ON e1 = entity),
t AS (SELECT entity, e2 AS neighbour, strength FROM one UNION ALL SELECT o.entity, e.e2, o.strength FROM one o JOIN edges e ON e.e1 = o.e2),
s AS (SELECT entity, neighbour, sum(strength)::BIGINT AS strength FROM t WHERE neighbour <> entity GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY strength DESC, neighbour) AS k FROM s)
SELECT entity, neighbour, strength FROM r WHERE k <= 10""",
    "communities": f"""{MENTIONS}, {EDGES}, links AS MATERIALIZED (SELECT DISTINCT e1, e2 FROM edges),
reach(s, t) AS (SELECT e1, e1 FROM links UNION SELECT r.s, l.e2 FROM reach r JOIN links l ON l.e1 = r.t)
SELECT s AS entity, min(t) AS community FROM reach GROUP BY 1""",
}
