"""The entity graph: nodes, co-occurrence edges, neighbourhoods and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.entities import entity_merge, entity_name
from lodestone.plans.components import connected_components

MIN_STRENGTH = 2


def entity_nodes(mentions: DataFrame, **packs) -> DataFrame:
    """Merged entities with ``chunk_count``, the number of chunks that mention the name as it is."""
    chunks = mentions.groupBy(F.lower("text").alias("__low")).agg(F.count_distinct("chunk_id").alias("chunk_count"))
    merged = entity_merge(mentions, **packs).withColumn("__low", F.lower("name"))
    return merged.join(chunks, "__low", "left").drop("__low")


def article_nodes(chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """``(article_id, title, url, chunk_count)`` of the articles that have chunks."""
    counts = chunks.groupBy("article_id").agg(F.count("*").alias("chunk_count"))
    return articles.join(counts, "article_id").select("article_id", "title", "url", "chunk_count")


def chunk_articles(chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """Each chunk with the title and URL of its article."""
    return chunks.join(articles.select("article_id", "title", "url"), "article_id")


def mention_edges(mentions: DataFrame, nodes: DataFrame, exact: bool = False) -> DataFrame:
    """``(name, chunk_id, confidence)``: mentions tied to their node by normalized name; with
    ``exact`` by the very name, which loses mentions in other forms."""
    if exact:
        return mentions.join(nodes.select("name"), F.col("text") == F.col("name")).select("name", "chunk_id", "confidence")
    named = mentions.withColumn("normalized_name", entity_name(F.col("text")))
    return named.join(nodes.select("normalized_name", "name"), "normalized_name").select("name", "chunk_id", "confidence")


def _pairs(names: DataFrame, *fields: str) -> DataFrame:
    """Rows (e1, e2) of structs for all pairs of a chunk's different names, the lesser first, of
    rows (chunk_id, *fields) that come once for each chunk and name.

    A chunk is a bounded text and so is the array of its names, whose pairs come one by one: one
    shuffle by chunk in place of a join of the names with themselves.
    """
    each = names.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("all")).filter(F.size("all") > 1)
    first = each.select("all", F.posexplode("all").alias("at", "e1"))
    return first.select("e1", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("e2"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs (e1, e2, strength) and their reverse; a union would work out the pairs twice."""
    ends = F.explode(F.array(F.struct("e1", "e2"), F.struct(F.col("e2").alias("e1"), F.col("e1").alias("e2"))))
    return pairs.select(ends.alias("x"), "strength").select("x.e1", "x.e2", "strength")


def cooccurrence(mentions: DataFrame, min_strength: int = MIN_STRENGTH) -> DataFrame:
    """``(e1, e2, strength)`` in both directions: in how many chunks two names occur together.

    Names of a chunk are distinct; pairs are counted before they are doubled.
    """
    names = mentions.select("chunk_id", F.trim(F.lower("text")).alias("e")).filter("chunk_id is not null and e is not null").distinct()
    pairs = _pairs(names, "e").groupBy(F.col("e1.e").alias("e1"), F.col("e2.e").alias("e2")).agg(F.count("*").alias("strength"))
    pairs = pairs.filter(F.col("strength") >= min_strength)
    return _both_ways(pairs)


def edges_between_nodes(edges: DataFrame, nodes: DataFrame, exact: bool = False) -> DataFrame:
    """Edges whose ends are nodes, by lower-cased name, or with ``exact`` by the name as it is."""
    key = F.col("name") if exact else F.lower("name")
    names = nodes.select(key.alias("key"), "name").distinct()
    left = edges.join(names.select(F.col("key").alias("e1"), F.col("name").alias("name1")), "e1")
    both = left.join(names.select(F.col("key").alias("e2"), F.col("name").alias("name2")), "e2")
    return both.select("name1", "name2", "strength")


def pair_counts(mentions: DataFrame) -> DataFrame:
    """``(e1, e2, strength)`` counting every pair of mentions, repeats included, e1 < e2."""
    names = mentions.groupBy("chunk_id", F.lower("text").alias("e")).agg(F.count("*").alias("n")).filter("chunk_id is not null and e is not null")
    pairs = _pairs(names, "e", "n").groupBy(F.col("e1.e").alias("e1"), F.col("e2.e").alias("e2"))
    return pairs.agg(F.sum(F.col("e1.n") * F.col("e2.n")).alias("strength"))


def connections(pairs: DataFrame, top: int = 5) -> DataFrame:
    """For each entity its connections in all, different ones, and the strongest."""
    both = _both_ways(pairs)
    place = F.expr("row_number() over (partition by e1 order by strength desc, e2)")
    best = both.withColumn("__place", place).filter(F.col("__place") <= top).groupBy("e1")
    best = best.agg(F.transform(F.array_sort(F.collect_list(F.struct("__place", "e2"))), lambda x: x["e2"]).alias("strongest"))
    sums = both.groupBy("e1").agg(F.sum("strength").alias("total_connections"), F.count("*").alias("unique_connections"))
    return sums.join(best, "e1").withColumnRenamed("e1", "entity")


def article_diversity(mentions: DataFrame, top: int = 5) -> DataFrame:
    """``(article_id, unique_entities, mentions, top_entities)`` of each article."""
    names = mentions.groupBy("article_id", F.lower("text").alias("e")).agg(F.count("*").alias("n"))
    place = F.expr("row_number() over (partition by article_id order by n desc, e)")
    ranked = names.withColumn("__place", place)
    best = F.transform(F.array_sort(F.collect_list(F.when(F.col("__place") <= top, F.struct("__place", "e")))), lambda x: x["e"])
    return ranked.groupBy("article_id").agg(F.count("*").alias("unique_entities"), F.sum("n").alias("mentions"), best.alias("top_entities"))


def graph_stats(nodes: DataFrame, articles: DataFrame, chunks: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """``(stat, key, value)``: numbers of nodes and edges, entities by type, highest degrees."""
    one = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("stat"), F.lit("").alias("key"), "value")
    sizes = one(nodes, "entities").unionByName(one(articles, "articles")).unionByName(one(chunks, "chunks"))
    sizes = sizes.unionByName(one(edges, "co_occurs")).unionByName(one(links, "mentioned_in"))
    types = nodes.groupBy(F.col("label").alias("key")).agg(F.count("*").alias("value")).select(F.lit("type").alias("stat"), "key", "value")
    degree = edges.groupBy(F.col("e1").alias("key")).agg((F.count("*") * 2).alias("value")).orderBy(F.desc("value"), "key").limit(10)
    return sizes.unionByName(types).unionByName(degree.select(F.lit("degree").alias("stat"), "key", "value"))


def entity_context(entities: DataFrame, nodes: DataFrame, edges: DataFrame, related: int = 10) -> DataFrame:
    """``(entity, name, label, mention_count, related)`` for each of the entities that is a node:
    its strongest neighbours as (name, strength), none for an isolated one."""
    low = F.lower("name")
    keyed = nodes.withColumn("__key", F.explode(F.array_distinct(F.array(low, F.col("normalized_name")))))
    known = entities.select("entity").distinct().join(keyed, F.col("entity") == F.col("__key")).drop("__key")
    place = F.expr("row_number() over (partition by e1 order by strength desc, e2)")
    wanted = edges.join(known.select(low.alias("e1")).distinct(), "e1", "left_semi").withColumn("__place", place)
    best = wanted.filter(F.col("__place") <= related).groupBy("e1")
    best = best.agg(F.transform(F.array_sort(F.collect_list(F.struct("__place", "e2", "strength"))), lambda x: F.struct(x["e2"].alias("name"), x["strength"].alias("strength"))).alias("related"))
    empty = F.array().cast("array<struct<name:string,strength:bigint>>")
    return known.join(best, F.lower("name") == F.col("e1"), "left").select("entity", "name", "label", "mention_count", F.coalesce("related", empty).alias("related"))


def neighborhood(entities: DataFrame, edges: DataFrame, top: int = 50, include_start: bool = False) -> DataFrame:
    """``(entity, neighbour, strength)``: the nodes within two steps over different edges,
    weighted by the first edge of each way there; the ``top`` of each entity.

    Edges are stored in both directions, so the way back is another edge and the start is its
    own neighbour unless left out, which is the default.
    """
    first = entities.select(F.col("entity").alias("e1")).distinct().join(edges, "e1")
    one = first.select(F.col("e1").alias("entity"), F.col("e2").alias("neighbour"), "strength")
    step = edges.select(F.col("e1").alias("e2"), F.col("e2").alias("neighbour"))
    two = first.join(step, "e2").select(F.col("e1").alias("entity"), "neighbour", "strength")
    both = one.unionByName(two)
    if not include_start:
        both = both.filter("neighbour <> entity")
    summed = both.groupBy("entity", "neighbour").agg(F.sum("strength").alias("strength"))
    place = F.expr("row_number() over (partition by entity order by strength desc, neighbour)")
    return summed.withColumn("__place", place).filter(F.col("__place") <= top).drop("__place")


def communities(edges: DataFrame) -> DataFrame:
    """``(entity, community)``: connected components of the edges, named by their least entity.

    Components of any diameter are found whole; an empty table of edges has none.
    """
    found = connected_components(edges.select(F.col("e1").alias("a"), F.col("e2").alias("b")))
    return found.select(F.col("node").alias("entity"), F.col("component").alias("community"))
