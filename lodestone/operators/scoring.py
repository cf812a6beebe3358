"""Scores of articles: review, paywall, marketing and content quality.  Each is a projection;
the summaries are one aggregation over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import contains_any, count_of, count_present, distinct_count, let, pieces, strip, text_of, total, word_count, words
from lodestone.operators.clean import review_text
from lodestone.operators.packs import SLOVAK_MARKETING, SLOVAK_PAYWALL, SLOVAK_REVIEW, MarketingPack, PaywallPack, ReviewPack
from lodestone.plans.ranges import running_totals


def points(condition: Column, value: float | Column) -> Column:
    """A value where a condition holds, else zero."""
    return F.when(condition, value).otherwise(0.0)


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


# Review ------------------------------------------------------------------------------------


def review_paywall(text: Column, pack: ReviewPack = SLOVAK_REVIEW) -> Column:
    """Weights of the indicators in a text, over three and at most one."""
    low = F.lower(text_of(text))
    weights = [2.0 if any(s in i for s in pack.strong) else 1.0 for i in pack.indicators]
    found = total(points(F.contains(low, F.lit(i)), w) for i, w in zip(pack.indicators, weights, strict=True))
    cut = total(points(F.contains(low, F.lit(t)), 1.5) for t in pack.truncation)
    return F.least((found + cut) / 3.0, F.lit(1.0))


def review(articles: DataFrame, pack: ReviewPack = SLOVAK_REVIEW) -> DataFrame:
    """Articles (url, title, content, date, excerpt, word_count) with ``issues``, ``warnings``,
    ``quality_score``, ``suitable`` and ``category``.  Null and empty values are the same."""
    text, title, url = text_of("content"), text_of("title"), text_of("url")
    n, paywall = F.col("__n"), F.col("paywall_score")
    issue = lambda when, kind, what, sure: F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(what).alias("name"), (sure if isinstance(sure, Column) else F.lit(sure)).alias("confidence")))
    issues = F.array_compact(F.array(
        issue(n < 50, "critical", "extremely_short", 1.0),
        issue(paywall > 0.8, "critical", "paywall", paywall),
        issue((n >= 50) & (n < 200), "major", "short", 0.8),
    ))
    filled = F.size(F.filter(F.split(text, "\n"), lambda x: strip(x) != ""))
    low = words(F.lower(text))
    some = text != ""
    warnings = F.array_compact(F.array(
        issue(~some, "warning", "empty_content", 1.0),
        issue(some & (filled < 3), "warning", "few_lines", 0.7),
        issue(some & (distinct_count(low) < F.size(low) * 0.3), "warning", "repetition", 0.6),
        *(issue(text_of(c) == "", "warning", f"missing_{c}", 1.0) for c in ("url", "title", "content", "date")),
        issue((url != "") & ~url.startswith("http"), "warning", "invalid_url", 0.8),
        issue(F.length(title) < 10, "warning", "short_title", 0.7),
        issue(F.length(title) > 200, "warning", "long_title", 0.6),
    ))
    weight = lambda of, kind: F.aggregate(F.filter(of, lambda x: x["type"] == kind), F.lit(0.0), lambda s, x: s + x["confidence"])
    complete = total((text_of(c) != "").cast("int") for c in ("url", "title", "content", "date", "excerpt"))
    stored = F.coalesce("word_count", F.lit(0))
    score = (
        F.lit(1.0)
        - 0.4 * weight(F.col("issues"), "critical")
        - 0.2 * weight(F.col("issues"), "major")
        - 0.1 * weight(F.col("warnings"), "warning")
        + F.when(stored > 1000, 0.1).when(stored > 500, 0.05).otherwise(0.0)
        + complete / 5 * 0.1
    )
    has = lambda kind: F.exists("issues", lambda x: x["type"] == kind)
    category = F.when(has("critical"), "critical").when(has("major"), "major").when(F.size("warnings") > 0, "minor").otherwise("good")
    return (
        articles.withColumn("__n", word_count(text))
        .withColumn("paywall_score", review_paywall(text, pack))
        .withColumn("issues", issues)
        .withColumn("warnings", warnings)
        .withColumn("quality_score", clamp(score))
        .withColumn("category", category)
        .withColumn("suitable", (F.col("quality_score") > 0.6) & (F.col("category") != "critical") & (n >= 200))
        .drop("__n")
    )


def buckets(score: Column) -> list[Column]:
    """Counts by score: below .3, .6, .8 and up to 1."""
    edges = (("poor", 0.0, 0.3), ("fair", 0.3, 0.6), ("good", 0.6, 0.8), ("excellent", 0.8, 1.01))
    return [F.count_if((score >= a) & (score < b)).alias(f"score_{name}") for name, a, b in edges]


def review_summary(reviewed: DataFrame) -> DataFrame:
    """One row of counts over reviewed articles."""
    kinds = [F.count_if(F.col("category") == c).alias(f"{c}_articles") for c in ("critical", "major", "minor", "good")]
    many = F.count_if(F.col("category") == "critical") / F.count("*")
    return reviewed.agg(
        F.count("*").alias("articles"),
        *kinds,
        F.count_if("suitable").alias("suitable_articles"),
        F.avg("quality_score").alias("avg_quality"),
        *buckets(F.col("quality_score")),
        F.coalesce(many > 0.2, F.lit(False)).alias("many_critical"),
        F.coalesce(F.avg("quality_score") < 0.7, F.lit(False)).alias("low_quality"),
    )


def issue_histogram(reviewed: DataFrame) -> DataFrame:
    """How often each issue and warning was found."""
    each = reviewed.select(F.explode(F.concat("issues", "warnings")).alias("i"))
    return each.groupBy(F.col("i.type").alias("type"), F.col("i.name").alias("name")).agg(F.count("*").alias("n"))


# Paywall -----------------------------------------------------------------------------------


def paywall(articles: DataFrame, pack: PaywallPack = SLOVAK_PAYWALL) -> DataFrame:
    """Articles (title, content) with the indicators' confidence, structure, truncation, sale
    and quality, and what they add up to."""
    text = text_of("content")
    low, title = F.lower(text), F.lower(text_of("title"))
    weight = total(count_of(low, k) * w for k, w in pack.weights) + total(points(F.contains(title, F.lit(k)), w * 0.5) for k, w in pack.weights)
    found = lambda patterns: total(low.rlike("(?Ui)" + p).cast("int") for p in patterns)
    n = F.col("n_words")
    meaningful = F.size(F.filter(pieces(text), lambda s: F.length(s) > 10))
    filler = F.when(n > 0, total(count_of(low, k) for k in pack.filler) / n).otherwise(0.0)
    quality = (
        F.lit(1.0)
        - F.when(n < 50, 0.5).when(n < 200, 0.2).otherwise(0.0)
        - points(meaningful < 3, 0.3)
        - 0.2 * found(pack.degradation)
        - points(filler > 0.1, filler * 0.5)
    )
    parts = F.split(text, r"\.")
    tail = F.lower(F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 2), F.lit(3)), "."))
    raised = F.col("indicator_confidence") + points(F.col("truncated"), 0.3) + points(F.col("commercial"), 0.2)
    final = F.least(F.when(F.col("content_quality") > 0.8, raised * 0.7).otherwise(raised), F.lit(1.0))
    level = F.when(F.col("confidence") > 0.8, "high").when(F.col("confidence") > 0.5, "medium").when(F.col("confidence") > 0.2, "low")
    return (
        articles.withColumn("n_words", word_count(text))
        .withColumn("indicator_confidence", F.least(weight / 10.0, F.lit(1.0)))
        .withColumn("abrupt_ending", (text != "") & contains_any(tail, pack.endings))
        .withColumn("suspiciously_short", n < 100)
        .withColumn("truncated", found(pack.truncation) > 0)
        .withColumn("commercial", found(pack.commercial) > 0)
        .withColumn("content_quality", F.greatest(F.lit(0.0), quality))
        .withColumn("confidence", final)
        .withColumn("detected", F.col("confidence") > 0.4)
        .withColumn("level", level.otherwise("very_low"))
        .withColumn("recommendations", paywall_advice())
    )


def paywall_advice() -> Column:
    """What to do about an article, from its paywall columns."""
    quality, sure = F.col("content_quality"), F.col("confidence")
    advice = F.array_compact(F.array(
        F.when(F.col("detected"), F.when(sure > 0.8, "exclude").when(sure > 0.5, "review_manually").otherwise("investigate")),
        F.when(F.col("truncated"), "fetch_again"),
        F.when(F.col("commercial"), "filter_promotion"),
        F.when(quality < 0.5, "exclude_poor").when(quality < 0.7, "review_quality"),
        F.when(~F.col("detected") & (quality > 0.7), "suitable"),
    ))
    return F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("no_issues")))


def paywall_summary(scored: DataFrame) -> DataFrame:
    levels = [F.count_if(F.col("level") == x).alias(f"{x}_articles") for x in ("high", "medium", "low", "very_low")]
    return scored.agg(
        F.count("*").alias("articles"),
        F.count_if("detected").alias("detected_articles"),
        *levels,
        F.count_if("truncated").alias("truncated_articles"),
        F.count_if("commercial").alias("commercial_articles"),
        F.avg("content_quality").alias("avg_quality"),
        F.count_if(~F.col("detected") & (F.col("content_quality") > 0.7)).alias("suitable_articles"),
    )


def paywall_simple(articles: DataFrame, pack: PaywallPack = SLOVAK_PAYWALL) -> DataFrame:
    """How many of the plain indicators a text or its title has, and whether any."""
    both = F.concat(F.lower(text_of("content")), F.lit("\0"), F.lower(text_of("title")))
    scored = articles.withColumn("indicators_found", count_present(both, pack.simple))
    return scored.withColumn("detected", F.col("indicators_found") > 0)


def paywall_exact(articles: DataFrame, phrase: str = SLOVAK_PAYWALL.exact) -> DataFrame:
    """``status``: failed without content, paywalled with the exact phrase, else free."""
    text = F.col("content")
    return articles.withColumn("status", F.when(text.isNull() | (text == ""), "failed").when(F.contains(text, F.lit(phrase)), "paywalled").otherwise("free"))


# Marketing and content quality -------------------------------------------------------------


def marketing(text: Column, pack: MarketingPack = SLOVAK_MARKETING) -> Column:
    """struct(score, confidence): words that sell, navigate or describe, against the length."""
    low = F.lower(text_of(text))
    mentions = [F.regexp_count(low, F.lit("(?U)" + p)) for p in pack.self_references]
    score = (
        2 * total(count_of(low, k) for k in pack.marketing)
        + total(count_of(low, k) for k in (*pack.navigation, *pack.meta))
        + total(F.when(m > 3, m).otherwise(0) for m in mentions)
    )
    per_hundred = F.greatest(word_count(text) / 100, F.lit(1.0))
    return F.struct(score.cast("int").alias("score"), F.least(score / per_hundred, F.lit(1.0)).alias("confidence"))


def content_quality(text: Column, paragraphs: Column) -> Column:
    """struct(quality, issues): length, sentences, paragraphs and repetition of a text."""
    body = text_of(text)
    facts = F.struct(
        word_count(body).alias("n"),
        F.size(F.split(body, r"[.!?]+")).alias("ends"),
        words(F.lower(body)).alias("low"),
        F.transform(pieces(body), word_count).alias("sizes"),
        paragraphs.alias("paragraphs"),
        (body == "").alias("empty"),
    )
    return let(facts, _judged_content)


def _judged_content(f: Column) -> Column:
    n, ends, low, sizes = f["n"], f["ends"], f["low"], f["sizes"]
    mean = F.when(F.size(sizes) > 0, F.aggregate(sizes, F.lit(0), lambda s, x: s + x) / F.size(sizes))
    rules = [
        (n < 100, "very_short", 0.3),
        ((n >= 100) & (n < 300), "short", 0.1),
        (ends < 5, "few_sentences", 0.2),
        (f["paragraphs"] < 2, "poor_paragraphs", 0.1),
        (distinct_count(low) < F.size(low) * 0.4, "repetition", 0.2),
        (mean < 5, "short_sentences", 0.1),
        (mean > 30, "long_sentences", 0.1),
    ]
    lost = total(points(when, by) for when, _, by in rules)
    issues = F.array_compact(F.array(*(F.when(when, name) for when, name, _ in rules)))
    return F.struct(
        F.when(f["empty"], 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1.0 - lost), 9)).alias("quality"),
        F.when(f["empty"], F.array(F.lit("empty"))).otherwise(issues).alias("issues"),
    )


def content_review(articles: DataFrame, pack: MarketingPack = SLOVAK_MARKETING, parity: bool = False) -> DataFrame:
    """Articles with the marketing score and quality of their squeezed text, cleanliness and
    whether they need cleaning.  Paragraphs are counted before squeezing; with ``parity`` after,
    when there never are two."""
    paragraphs = F.size(F.filter(F.split(text_of("content"), "\n\n"), lambda p: strip(p) != ""))
    if parity:
        paragraphs = (F.col("__text") != "").cast("int")
    confidence, quality = F.col("marketing.confidence"), F.col("review.quality")
    return (
        articles.withColumn("__text", review_text(F.col("content")))
        .withColumn("marketing", marketing(F.col("__text"), pack))
        .withColumn("review", content_quality(F.col("__text"), paragraphs))
        .withColumn("cleaned_word_count", word_count(F.col("__text")))
        .withColumn("needs_cleaning", (confidence > 0.3) | (quality < 0.6) | (F.size("review.issues") > 2))
        .withColumn("cleanliness", (1.0 - confidence) * 0.4 + quality * 0.6)
        .drop("__text")
    )


#: Above these shares of marketing an article counts as high or medium.
HIGH_MARKETING, MEDIUM_MARKETING = 0.5, 0.2


def content_summary(reviewed: DataFrame) -> DataFrame:
    confidence = F.col("marketing.confidence")
    return reviewed.agg(
        F.count("*").alias("articles"),
        F.count_if("needs_cleaning").alias("needs_cleaning"),
        F.avg(F.col("needs_cleaning").cast("int")).alias("needs_cleaning_share"),
        F.count_if(confidence > HIGH_MARKETING).alias("marketing_high"),
        F.count_if((confidence > MEDIUM_MARKETING) & (confidence <= HIGH_MARKETING)).alias("marketing_medium"),
        F.count_if(confidence <= MEDIUM_MARKETING).alias("marketing_low"),
        F.avg("cleanliness").alias("avg_cleanliness"),
        *buckets(F.col("review.quality")),
    )


# Corpus ------------------------------------------------------------------------------------


def exclusive_quartile(values: Column, quarter: int) -> Column:
    """A quartile by the exclusive method, from a sorted array of at least two values."""
    n = F.size(values)
    m = quarter * (n + 1)
    j = F.greatest(F.lit(1), F.least(F.floor(m / 4).cast("int"), n - 1))
    rest = m - 4 * j
    return (F.get(values, j - 1) * (4 - rest) + F.get(values, j) * rest) / 4.0


def value_quartiles(rows: DataFrame, value_col: str) -> DataFrame:
    """One row (n, median, q1, q3): the median, and exclusive quartiles, null below four values.

    Values are counted first and ranks found on the distinct ones by running totals over ranges,
    so neither all values nor all distinct ones are ever gathered.
    """
    counts = rows.filter(F.col(value_col).isNotNull()).groupBy(F.col(value_col).cast("double").alias("v")).agg(F.count("*").alias("k"))
    ranked = running_totals(counts, "v", "k", "upto")
    n = ranked.agg(F.sum("k").alias("n"))
    pick = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))

    def quartile(q: int) -> Column:
        m = q * (F.col("n") + 1)
        j = F.greatest(F.lit(1), F.least(F.floor(m / 4), F.col("n") - 1))
        rest = m - 4 * j
        return (pick(j) * (4 - F.max(rest)) + pick(j + 1) * F.max(rest)) / 4.0

    joined = ranked.crossJoin(F.broadcast(n))  # one row
    median = (pick(F.expr("(n + 1) div 2")) + pick(F.expr("(n + 2) div 2"))) / 2.0
    some = F.max("n") >= 4
    return joined.agg(F.max("n").alias("n"), median.alias("median"), F.when(some, quartile(1)).alias("q1"), F.when(some, quartile(3)).alias("q3"))


def corpus_stats(articles: DataFrame) -> DataFrame:
    """One row about the word counts: mean, median, deviation, least, most and quartiles."""
    base = articles.agg(
        F.count("*").alias("articles"),
        F.sum("word_count").cast("bigint").alias("total_words"),
        F.avg("word_count").alias("mean"),
        F.stddev_samp("word_count").alias("stdev"),
        F.min("word_count").alias("min"),
        F.max("word_count").alias("max"),
    )
    return base.crossJoin(F.broadcast(value_quartiles(articles, "word_count").drop("n")))  # one row each


def short_articles(articles: DataFrame) -> DataFrame:
    """Articles with far fewer words than the first quartile, or under two hundred characters."""
    limit = value_quartiles(articles, "word_count").select(F.greatest(F.lit(50.0), F.coalesce("q1", F.lit(0.0)) * 0.3).alias("__limit"))
    found = articles.crossJoin(F.broadcast(limit))  # one row
    return found.filter((F.col("word_count") < F.col("__limit")) | (F.length(text_of("content")) < 200)).drop("__limit")


def full_articles(articles: DataFrame) -> DataFrame:
    """Articles with a title, over a thousand characters and more words than most."""
    stats = corpus_stats(articles).select(F.greatest(F.coalesce("q3", F.lit(0.0)), F.col("median") * 1.5).alias("__limit"))
    found = articles.crossJoin(F.broadcast(stats))  # one row
    long = (F.length(text_of("title")) > 10) & (F.length(text_of("content")) > 1000)
    return found.filter(long & (F.col("word_count") > F.col("__limit"))).drop("__limit")
