"""Hybrid retrieval: vector hits reranked by the entity graph, and extractive answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import contains_any, strip, text_of
from lodestone.operators import packs

VECTOR_WEIGHT, GRAPH_WEIGHT = 0.7, 0.3
MIN_COMBINED, MIN_SIMILARITY, MIN_CONTENT = 0.3, 0.2, 50
MAX_STRENGTH = 1000.0


def graph_relevance(candidates: DataFrame, content: DataFrame, queries: DataFrame, context: DataFrame, neighborhood: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, graph_relevance)`` for each candidate.

    ``content`` has the entities of chunks, ``queries`` those of queries, ``context`` the related
    names with strengths of query entities and ``neighborhood`` their neighbours.  A query entity
    scores one if the chunk has it, what its related entities in the chunk add, each up to a
    half, and .3 for the share of the chunk's entities that are neighbours; its score is at most
    one.  The relevance is the mean over the query's entities; zero where either side has none.
    """
    own = candidates.select("query_id", "chunk_id").distinct()
    held = content.select("chunk_id", F.col("entity")).distinct()
    asked = queries.select("query_id", F.col("entity").alias("wanted")).distinct()
    sizes = held.groupBy("chunk_id").agg(F.count("*").alias("n_content"))
    asked_n = asked.groupBy("query_id").agg(F.count("*").alias("n_asked"))
    near = neighborhood.join(queries.select("query_id", F.col("entity").alias("start")).distinct(), F.col("start") == F.col("entity"))
    near = near.select("query_id", F.col("neighbour").alias("entity")).distinct()
    in_chunk = own.join(held, "chunk_id")
    neighbours = in_chunk.join(near, ["query_id", "entity"]).groupBy("query_id", "chunk_id").agg(F.count("*").alias("n_near"))
    related = context.select(F.col("entity").alias("wanted"), F.explode("related").alias("r"))
    related = related.select("wanted", F.lower("r.name").alias("entity"), F.least(F.col("r.strength") / MAX_STRENGTH, F.lit(0.5)).alias("part"))
    matched = in_chunk.join(asked, "query_id").join(related, ["wanted", "entity"]).groupBy("query_id", "chunk_id", "wanted").agg(F.sum("part").alias("part"))
    direct = in_chunk.join(asked.withColumn("entity", F.col("wanted")), ["query_id", "entity"]).select("query_id", "chunk_id", "wanted", F.lit(1.0).alias("direct"))
    each = own.join(asked, "query_id").join(direct, ["query_id", "chunk_id", "wanted"], "left").join(matched, ["query_id", "chunk_id", "wanted"], "left")
    each = each.join(neighbours, ["query_id", "chunk_id"], "left").join(sizes, "chunk_id")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share = F.least(zero(F.col("n_near")) / F.col("n_content"), F.lit(1.0))
    score = F.least(zero("direct") + zero("part") + 0.3 * share, F.lit(1.0))
    means = each.groupBy("query_id", "chunk_id").agg(F.sum(score).alias("total")).join(asked_n, "query_id")
    means = means.select("query_id", "chunk_id", (F.col("total") / F.col("n_asked")).alias("graph_relevance"))
    out = own.join(means, ["query_id", "chunk_id"], "left")
    return out.withColumn("graph_relevance", zero("graph_relevance"))


def fuse(vector: Column, graph: Column, vector_weight: float = VECTOR_WEIGHT, graph_weight: float = GRAPH_WEIGHT) -> Column:
    """Weighted sum; the graph weighs a tenth more where it scores above .8, less below .2."""
    high = min(0.5, graph_weight + 0.1)
    low = min(0.9, vector_weight + 0.1)
    gw = F.when(graph > 0.8, high).when(graph < 0.2, 1 - low).otherwise(graph_weight)
    vw = F.when(graph > 0.8, 1 - high).when(graph < 0.2, low).otherwise(vector_weight)
    return vector * vw + graph * gw


def rerank(hits: DataFrame, relevance: DataFrame, chunks: DataFrame, k: int = 10, **weights: float) -> DataFrame:
    """``(query_id, chunk_id, similarity, graph_relevance, combined, rank)``: the k best hits
    ``(query_id, chunk_id, similarity)`` of each query that are good enough."""
    joined = hits.join(relevance, ["query_id", "chunk_id"], "left").join(chunks.select("chunk_id", "text"), "chunk_id")
    graph = F.coalesce("graph_relevance", F.lit(0.0))
    scored = joined.withColumn("graph_relevance", graph).withColumn("combined", fuse(F.col("similarity"), F.col("graph_relevance"), **weights))
    good = (F.col("combined") > MIN_COMBINED) & (F.col("similarity") > MIN_SIMILARITY) & (F.length(strip(text_of("text"))) > MIN_CONTENT)
    rank = F.expr("row_number() over (partition by query_id order by round(combined, 9) desc, chunk_id)")
    ranked = scored.filter(good).withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", "chunk_id", "similarity", "graph_relevance", "combined", "rank")


def result_relationships(results: DataFrame, content: DataFrame, context: DataFrame, top: int = 5) -> DataFrame:
    """``(query_id, chunk_id, entity1, entity2, strength)``: the strongest relations of a result's
    entities that the result has too."""
    held = content.select("chunk_id", "entity").distinct()
    best = context.select(F.col("entity").alias("entity1"), F.explode(F.slice("related", 1, top)).alias("r")).select("entity1", F.lower("r.name").alias("entity2"), F.col("r.strength").alias("strength"))
    first = results.select("query_id", "chunk_id").join(held.withColumnRenamed("entity", "entity1"), "chunk_id").join(best, "entity1")
    return first.join(held.withColumnRenamed("entity", "entity2"), ["chunk_id", "entity2"]).select("query_id", "chunk_id", "entity1", "entity2", "strength")


def entity_summary(context: DataFrame, hits: DataFrame, chunks: DataFrame, samples: int = 3, related: int = 10) -> DataFrame:
    """``(entity, name, label, mention_count, top_related, samples, titles)``: an entity with the
    texts of its best hits ``(entity, chunk_id, rank)``."""
    texts = hits.join(chunks.select("chunk_id", "text", "title"), "chunk_id")
    sample = F.when(F.col("rank") <= samples, F.struct("rank", F.concat(F.substring("text", 1, 200), F.lit("...")).alias("t")))
    found = texts.groupBy("entity").agg(
        F.transform(F.array_sort(F.collect_list(sample)), lambda x: x["t"]).alias("samples"), F.array_sort(F.collect_set("title")).alias("titles")
    )
    out = context.join(found, "entity", "left")
    return out.select("entity", "name", "label", "mention_count", F.slice("related", 1, related).alias("top_related"), "samples", "titles")


def key_points(text: Column, skipped: Sequence[str] = packs.SKIPPED_IN_ANSWERS) -> Column:
    """Up to three of the first eight sentences that say something, as whole sentences."""
    first = F.slice(F.split(text_of(text), r"(?<=[.!?])\s+"), 1, 8)
    parts = F.filter(F.transform(first, strip), lambda s: (F.length(s) > 40) & (F.length(s) < 300) & ~contains_any(F.lower(s), skipped))
    ended = F.transform(parts, lambda s: F.when(s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit("."))))
    return F.slice(F.transform(ended, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 10**6))), 1, 3)


def tips(text: Column, marks: Sequence[str] = packs.TIP_WORDS) -> Column:
    """Up to two short sentences that give advice, in lower case but for their first letter."""
    parts = F.transform(F.split(text_of(text), r"\. "), lambda s: F.lower(strip(s)))
    kept = F.filter(parts, lambda s: contains_any(s, marks) & (F.length(s) > 20) & (F.length(s) < 150))
    whole = F.transform(kept, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 10**6), F.when(s.endswith("."), "").otherwise(".")))
    return F.slice(whole, 1, 2)


def opening(query: Column, topics: Sequence[tuple[str, str]] = packs.ANSWER_TOPICS, default: str = packs.DEFAULT_ANSWER) -> Column:
    found = F
    for word, text in topics:
        found = found.when(F.contains(F.lower(text_of(query)), F.lit(word)), text)
    return found.otherwise(default) if topics else F.lit(default)


def answers(queries: DataFrame, results: DataFrame, chunks: DataFrame, skipped: Sequence[str] = packs.SKIPPED_IN_ANSWERS, marks: Sequence[str] = packs.TIP_WORDS, topics: Sequence[tuple[str, str]] = packs.ANSWER_TOPICS) -> DataFrame:
    """``(query_id, status, opening, points, supporting, tips, source, similarity)``.

    ``status`` is none without results and low when the best is not similar enough; both have no
    further content.  Without key points the beginning of the best text stands for them.
    """
    best = results.join(chunks.select("chunk_id", "text", "title"), "chunk_id")
    text, similarity = F.col("m.text"), F.col("m.similarity")
    head = F.substring(F.col("text"), 1, 150)
    short = F.when(F.instr(head, ".") > 0, F.concat(F.substring_index(head, ".", 1), F.lit("."))).otherwise(head)
    also = F.when(F.col("rank").between(2, 3) & (F.col("similarity") > 0.4), F.struct("rank", F.concat("title", F.lit(": "), short).alias("t")))
    grouped = best.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("similarity", "text", "title"))).alias("m"),
        F.transform(F.array_sort(F.collect_list(also)), lambda x: x["t"]).alias("also"),
    )
    out = queries.join(grouped, "query_id", "left")
    status = F.when(F.col("m").isNull(), "none").when(similarity < 0.3, "low").otherwise("answered")
    shown = lambda c: F.when(F.col("status") == "answered", c)
    points = key_points(text, skipped)
    preview = F.array(F.when(F.length(text) > 400, F.concat(F.substring(text, 1, 400), F.lit("..."))).otherwise(text))
    return out.withColumn("status", status).select(
        "query_id",
        "status",
        shown(opening(F.col("query"), topics)).alias("opening"),
        shown(F.when(F.size(points) > 0, points).otherwise(preview)).alias("points"),
        shown(F.col("also")).alias("supporting"),
        shown(tips(text, marks)).alias("tips"),
        shown(F.col("m.title")).alias("source"),
        shown(similarity).alias("similarity"),
    )


def qa_pairs(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, question, answer)``: each user turn with the next turn, if the assistant's."""
    nxt = "lead({}) over (partition by conv_id order by turn)"
    paired = turns.withColumn("__role", F.expr(nxt.format("role"))).withColumn("answer", F.expr(nxt.format("text")))
    return paired.filter((F.col("role") == "user") & (F.col("__role") == "assistant")).select("conv_id", "turn", F.col("text").alias("question"), "answer")
