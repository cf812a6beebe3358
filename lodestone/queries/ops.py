"""Queries for sources, incremental work and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import word_count
from lodestone.functions.urls import authority
from lodestone.plans import scratch
from lodestone.sources import readers, writers
from lodestone.streaming import intake
from lodestone.queries.common import ARTICLES, articles, count_sql, table
from lodestone.queries.entities import MENTIONS
from lodestone.queries.graph import EDGES, NODES, graph_tables


def source_union(spark, sf_dir):
    """Documents, pages and conversations as sources of one corpus."""
    a = articles(spark, sf_dir).select("url", "title", "content")
    p = table(spark, sf_dir, "pages").select("url", F.col("html").alias("content"))
    c = table(spark, sf_dir, "conversations").select(F.col("text").alias("content"))
    u = readers.union_sources({"blog": a, "web": p, "forum": c})
    return u.groupBy("source_type").agg(F.count("*").alias("rows"), F.count("url").alias("with_url"), F.sum(word_count(F.col("content"))).cast("bigint").alias("words"))


def scan_articles(spark, sf_dir):
    """Articles written as JSON files and read back with the article schema."""
    path = scratch.folder(spark)
    articles(spark, sf_dir).select("url", "title", "content", "date", "excerpt", "word_count").write.json(path)
    back = spark.read.schema(readers.ARTICLE).json(path).withColumn("published", F.try_to_timestamp("date"))
    return back.select("url", "title", F.length("content").cast("bigint").alias("chars"), F.year("published").cast("bigint").alias("year"))


def snapshot_round_trip(spark, sf_dir):
    """A version is committed, replaced by a second one, and the current one read."""
    root = scratch.folder(spark)
    a = articles(spark, sf_dir).select("doc_id", "source", "word_count")
    writers.commit_snapshot(spark, root, "v_1", {"articles": a.filter("word_count < 100")})
    writers.commit_snapshot(spark, root, "v_2", {"articles": a})
    return writers.read_snapshot(spark, root, "articles").groupBy("source").agg(F.count("*").alias("articles"), F.sum("word_count").cast("bigint").alias("words"))


def upsert(spark, sf_dir):
    """All documents as known ones; every third again with another length, and all once more
    under ids of their own."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("bigint").alias("n"))
    again = d.filter("doc_id % 3 = 0").withColumn("n", F.lit(-1).cast("bigint"))
    new = again.unionByName(d.withColumn("doc_id", -F.col("doc_id") - 1))
    return writers.upserted(d, new, "doc_id").groupBy("source").agg(F.count("*").alias("rows"), F.count_if(F.col("n") < 0).alias("replaced"))


def uniqueness(spark, sf_dir):
    """Hosts of pages that several pages have: where a constraint on them would be broken."""
    p = table(spark, sf_dir, "pages").select(authority(F.col("url")).alias("host"))
    return writers.duplicates(p, "host")


def graph_round_trip(spark, sf_dir):
    """Nodes and edges written as a graph and read back: numbers and sums by type."""
    path = scratch.folder(spark)
    writers.write_graph(*graph_tables(spark, sf_dir), path)
    nodes, edges = readers.graph(spark, path)
    by_label = nodes.groupBy(F.concat(F.lit("node "), "label").alias("kind")).agg(F.count("*").alias("rows"), F.sum("mention_count").cast("bigint").alias("total"))
    return by_label.unionByName(edges.agg(F.lit("edge").alias("kind"), F.count("*").alias("rows"), F.sum("strength").cast("bigint").alias("total")).select("kind", "rows", "total"))


def usage_report(spark, sf_dir):
    u = intake.usage_windows(table(spark, sf_dir, "events"), "1 day")
    return u.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("value", 4).alias("value"))


def usage_stream(spark, sf_dir):
    """The same report from the event files as a stream, read to its end."""
    path = f"{sf_dir}/events.parquet"
    stored = spark.read.parquet(path)
    folder, glob = (path, "*") if not path.endswith(".parquet") else (sf_dir, "events.parquet")
    events = spark.readStream.schema(stored.schema).option("pathGlobFilter", glob).parquet(folder)
    out = scratch.folder(spark)
    report = intake.usage_windows(events, "1 day")
    write = lambda rows, _: rows.write.mode("overwrite").parquet(f"{out}/table")
    query = report.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/table").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("value", 4).alias("value"))


def user_sessions(spark, sf_dir):
    s = intake.sessions(table(spark, sf_dir, "events"), "6 hours")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"), F.max("events").alias("longest"))


QUERIES = {f.__name__: f for f in (source_union, scan_articles, snapshot_round_trip, upsert, uniqueness, graph_round_trip, usage_report, usage_stream, user_sessions)}
_USAGE = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"
SQL = {
    "source_union": f"""WITH {ARTICLES}
SELECT 'blog' AS source_type, count(*) AS rows, count(url) AS with_url, sum({count_sql('content')})::BIGINT AS words FROM articles
UNION ALL SELECT 'web', count(*), count(url), sum({count_sql('html')})::BIGINT FROM pages UNION ALL SELECT 'forum', count(*), 0, sum({count_sql('text')})::BIGINT FROM conversations""",
    "scan_articles": f"WITH {ARTICLES} SELECT url, title, length(content) AS chars, CAST(substr(date, 1, 4) AS BIGINT) AS year FROM articles",
    "snapshot_round_trip": f"WITH {ARTICLES} SELECT source, count(*) AS articles, sum(word_count)::BIGINT AS words FROM articles GROUP BY 1",
    "upsert": "SELECT source, 2 * count(*) AS rows, count(*) FILTER (doc_id % 3 = 0) AS replaced FROM documents GROUP BY 1",
    "uniqueness": r"SELECT host, count(*) AS n FROM (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages) GROUP BY 1 HAVING count(*) > 1",
    "graph_round_trip": f"""{MENTIONS}, {NODES}, {EDGES}
SELECT 'node ' || label AS kind, count(*) AS rows, sum(mention_count)::BIGINT AS total FROM nodes GROUP BY label UNION ALL SELECT 'edge', count(*), sum(strength)::BIGINT FROM edges""",
    "usage_report": _USAGE,
    "usage_stream": _USAGE,
    "user_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS longest FROM c GROUP BY 1""",
}
