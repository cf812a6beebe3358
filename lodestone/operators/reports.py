"""Summaries of work done, and their text: rows of a report are few whatever the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import count_of, let
from lodestone.operators.clean import review_text
from lodestone.operators.packs import SLOVAK_MARKETING, MarketingPack

# Sources whose failures call for an advice, and the advices.
ADVICE = (
    (("Springer", "Nature"), "institutional_access"),
    (("Science Daily", "Medical Device Online"), "scrape_as_html"),
    (("PubMed",), "abstracts_only"),
)
NO_ADVICE = "review_failures"


def advice(failed: DataFrame) -> DataFrame:
    """``(advice)``: what to do about the sources of failed downloads, in a fixed order; one row
    for none that calls for anything."""
    has = lambda names: F.coalesce(F.bool_or(F.col("source").isin(*names)), F.lit(False))
    told = failed.agg(F.array_compact(F.array(*(F.when(has(names), text) for names, text in ADVICE))).alias("a"))
    return told.select(F.explode(F.when(F.size("a") > 0, F.col("a")).otherwise(F.array(F.lit(NO_ADVICE)))).alias("advice"))


def pdf_summary(files: DataFrame) -> DataFrame:
    """One row about files with ``content``, ``word_count`` and ``char_count``; those without
    content have failed."""
    done = F.col("content").isNotNull() & (F.col("content") != "")
    size = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("bigint")
    return files.agg(
        F.count("*").alias("total_pdfs"),
        F.count_if(done).alias("processed"),
        F.count_if(~done).alias("failed"),
        size("word_count").alias("total_words"),
        size("char_count").alias("total_chars"),
    )


def noise(text: Column, pack: MarketingPack = SLOVAK_MARKETING) -> Column:
    """An array of (kind, pattern, times) of what sells, navigates or describes in a text, and of
    self-references met more than three times.  The text is worked out once, not for each pattern."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: _noise_of(low, pack))


def _noise_of(low: Column, pack: MarketingPack) -> Column:
    found = [(kind, k, count_of(low, k), 0) for kind in ("marketing", "navigation", "meta") for k in getattr(pack, kind)]
    found += [("self_reference", p, F.regexp_count(low, F.lit("(?U)" + p)), 3) for p in pack.self_references]
    tag = lambda kind, k, n, least: F.when(n > least, F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("pattern"), n.cast("bigint").alias("times")))
    return F.array_compact(F.array(*(tag(*f) for f in found)))


def top_noise(articles: DataFrame, pack: MarketingPack = SLOVAK_MARKETING, top: int = 20) -> DataFrame:
    """``(kind, pattern, times, articles)``: the patterns met as often in most articles; a report
    of a fixed length."""
    # The outer variant: the other has a filter on the array's size, which would look for all of it again.
    each = articles.select(F.explode_outer(noise(review_text(F.col("content")), pack)).alias("x")).filter("x is not null").select("x.*")
    counts = each.groupBy("kind", "pattern", "times").agg(F.count("*").alias("articles"))
    return counts.orderBy(F.desc("articles"), "kind", "pattern", "times").limit(top)


def extremes(reviewed: DataFrame, id_col: str = "doc_id", top: int = 10) -> DataFrame:
    """``(side, place, id, cleanliness)``: the cleanest and the dirtiest articles; a report of a
    fixed length.  Each side is a top-k of its own, so no order of all rows is made."""

    def side(name: str, order: Column) -> DataFrame:
        best = rows.orderBy(order, id_col).limit(top).withColumn("side", F.lit(name))
        key = F.col("cleanliness") if name == "dirtiest" else -F.col("cleanliness")
        return best.withColumn("__key", key)

    rows = reviewed.select(id_col, F.round("cleanliness", 9).alias("cleanliness"))
    both = side("cleanest", F.desc("cleanliness")).unionByName(side("dirtiest", F.asc("cleanliness")))
    place = F.expr(f"row_number() over (partition by side order by __key, {id_col})")
    return both.select("side", place.alias("place"), id_col, "cleanliness")


def top_texts(mentions: DataFrame, top: int = 20) -> DataFrame:
    """``(name, mentions)``: the names met most, a report of a fixed length."""
    return mentions.groupBy(F.lower("text").alias("name")).agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "name").limit(top)


def markdown(title: str, sections: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """``(n, line)``: a Markdown report of small tables, each with its heading, its columns and
    one line for each row, in the order of those columns."""
    part = lambda df, section, line: df.select(F.lit(section).alias("s"), line.alias("line"))
    spark = sections[0][1].sparkSession
    heads = [(-1, 0, f"# {title}")]
    bodies = []
    for i, (heading, rows, columns) in enumerate(sections):
        heads += [(i, 0, f"## {heading}"), (i, 1, "| " + " | ".join(columns) + " |"), (i, 2, "|" + "---|" * len(columns))]
        cells = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
        bodies.append(part(rows, i, F.concat(F.lit("| "), cells, F.lit(" |"))))
    lines = spark.createDataFrame(heads, "s int, k int, line string")
    for body in bodies:
        lines = lines.unionByName(body.withColumn("k", F.lit(3)))
    return lines.select(F.expr("row_number() over (order by s, k, line)").cast("bigint").alias("n"), "line")
