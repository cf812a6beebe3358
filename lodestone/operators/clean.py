"""Cleaning of articles: patterns are deleted, white space set right, empty sections dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import contains_any, count_present, let, strip, text_of, word_count
from lodestone.operators.packs import REFERENCE_MARKS, SLOVAK_CLEANING, CleaningPack

_SPACING = (
    (r"\n{4,}", "\n\n\n"),
    (r"[ \t]{3,}", "  "),
    (r"(?U)\n\s*\n\s*\n", "\n\n"),
    (r"(?U)\s+([.,!?;:])", "$1"),
    (r"(?U)([.,!?;:])\s{2,}", "$1 "),
)


def _steps(pack: CleaningPack) -> list[tuple[str, str]]:
    """(family, pattern) in order; footers take everything after them along."""
    steps = [("marketing", "(?U)(?sm)" + p) for p in pack.marketing]
    steps += [("references", "(?U)" + p) for p in pack.references]
    steps += [("navigation", "(?U)(?m)" + p) for p in pack.navigation]
    return steps + [("footer", f"(?Uis){p}.*") for p in pack.footers]


def spaced(text: Column) -> Column:
    for pattern, by in _SPACING:
        text = F.regexp_replace(text, pattern, by)
    return strip(text)


def without_empty_sections(text: Column) -> Column:
    """No line that ends in a colon unless one of the next four says something else."""

    def says(line: Column) -> Column:
        return (strip(line) != "") & ~strip(line).endswith(":")

    def kept(lines: Column) -> Column:
        return F.filter(lines, lambda line, i: ~strip(line).endswith(":") | F.exists(F.slice(lines, i + 2, F.lit(4)), says))

    return F.array_join(let(F.split(text, "\n"), kept), "\n")


def clean(text: Column, pack: CleaningPack = SLOVAK_CLEANING) -> Column:
    out = text_of(text)
    for _, pattern in _steps(pack):
        out = F.regexp_replace(out, pattern, "")
    return without_empty_sections(spaced(out))


def clean_articles(articles: DataFrame, pack: CleaningPack = SLOVAK_CLEANING, text_col: str = "content") -> DataFrame:
    """The articles with ``cleaned``, word counts before and after and the reduction of
    characters in percent; a null text counts as empty and is reduced by zero."""
    before, after = F.length(text_of(text_col)), F.length("cleaned")
    reduction = F.when(before > 0, F.round((1 - after / before) * 100, 2)).otherwise(0.0)
    return (
        articles.withColumn("cleaned", clean(F.col(text_col), pack))
        .withColumn("original_word_count", word_count(F.col(text_col)))
        .withColumn("cleaned_word_count", word_count(F.col("cleaned")))
        .withColumn("reduction_percentage", reduction)
    )


def removals(articles: DataFrame, pack: CleaningPack = SLOVAK_CLEANING, text_col: str = "content") -> DataFrame:
    """How many matches each family of patterns removes; later patterns see what earlier ones left."""
    text, counts = text_of(text_col), {}
    for family, pattern in _steps(pack):
        found = F.regexp_count(text, F.lit(pattern))
        counts[family] = counts.get(family, F.lit(0)) + (F.least(found, F.lit(1)) if family == "footer" else found)
        text = F.regexp_replace(text, pattern, "")
    return articles.select("*", *(n.alias(f"removed_{family}") for family, n in counts.items()))


def cleaning_stats(articles: DataFrame, pack: CleaningPack = SLOVAK_CLEANING, text_col: str = "content") -> DataFrame:
    """One row: articles, removals by family, words removed, mean reduction."""
    counted = removals(clean_articles(articles, pack, text_col), pack, text_col)
    families = [c for c in counted.columns if c.startswith("removed_")]
    return counted.agg(
        F.count("*").alias("articles"),
        *(F.sum(c).cast("bigint").alias(c) for c in families),
        F.sum(F.col("original_word_count") - F.col("cleaned_word_count")).cast("bigint").alias("words_removed"),
        F.avg("reduction_percentage").alias("avg_reduction"),
    )


def marker_score(text: Column, markers: tuple[str, ...]) -> Column:
    """How many scientific markers occur in a text."""
    return count_present(F.lower(text_of(text)), markers)


def review_text(text: Column) -> Column:
    """White space squeezed and reference marks removed, as the content review wants it."""
    out = F.regexp_replace(text_of(text), r"(?U)\s+", " ")
    for pattern in REFERENCE_MARKS:
        out = F.regexp_replace(out, "(?Ui)" + pattern, "")
    return strip(out)


def mentions_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return contains_any(F.lower(text_of(text)), phrases)
