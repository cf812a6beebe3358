"""What the registered queries share: the article view over ``documents``, in Spark and in SQL,
word packs of words that occur in the test tables, and SQL for common text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import word_count
from lodestone.operators.packs import CleaningPack, MarketingPack, PaywallPack, ReviewPack

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: title is the first line's first 80 characters, dates and URLs follow
    the id by a fixed rule, and every seventeenth article has no date."""
    d = table(spark, sf_dir, "documents")
    day = F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), F.pmod("doc_id", F.lit(730)).cast("int")), "yyyy-MM-dd")
    return d.select(
        "doc_id",
        F.concat(F.lit("https://"), "source", F.lit(".example/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.trim(F.substring(F.substring_index("text", "\n", 1), 1, 80)).alias("title"),
        F.col("text").alias("content"),
        F.when(F.pmod("doc_id", F.lit(17)) != 0, day).alias("date"),
        F.substring("text", 1, 200).alias("excerpt"),
        word_count(F.col("text")).alias("word_count"),
        "lang",
        "source",
    )


#: White space for DuckDB's regular expressions, whose \s is ASCII only.
WS = r"[\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{M}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{M}\p{N}_]"


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def count_sql(x: str) -> str:
    return f"len({words_sql(x)})"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def pieces_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '[.!?]+'), lambda s: {strip_sql('s')}), lambda s: s <> '')"


def substring_count_sql(x: str, needle: str) -> str:
    return f"((length({x}) - length(replace({x}, '{needle}', ''))) // {len(needle)})"


def any_sql(x: str, needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{n}')" for n in needles) + ")"


def present_sql(x: str, needles: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({x}, '{n}')::INT" for n in needles) + ")"


ARTICLES = f"""articles AS (
  SELECT doc_id, 'https://' || source || '.example/' || lang || '/' || doc_id AS url,
         trim(substr(split_part(text, chr(10), 1), 1, 80)) AS title, text AS content,
         CASE WHEN doc_id % 17 <> 0 THEN strftime(DATE '2023-01-01' + CAST(doc_id % 730 AS INTEGER), '%Y-%m-%d') END AS date,
         substr(text, 1, 200) AS excerpt, {count_sql("text")} AS word_count, lang, source
  FROM documents)"""

CLEANING = CleaningPack(
    marketing=(r"(?i)\b(with|avec|nicht|para)\b[^.]*\.", r"(?i)(clown|idiot)"),
    references=(r"\[\d+\]",),
    navigation=(r"(?i)reserved\s*>>",),
    footers=(r"all\s+rights\s+reserved",),
)
PAYWALL = PaywallPack(
    weights=(("with the", 3.0), ("avec", 3.0), ("was", 2.0), ("nicht", 2.0), ("para", 2.0), ("from", 1.0), ("dans", 1.0), ("stupid", 1.0)),
    truncation=("this.*that", "pour.*avec"),
    commercial=("was.*from", "und.*nicht"),
    degradation=("the.*license", "copyright", "rights.*reserved"),
    endings=("this", "avec", "nicht"),
    filler=("the", "pour"),
    simple=("clown", "idiot", "license", "copyright", "nicht", "avec"),
    exact="All rights reserved",
)
REVIEW = ReviewPack(indicators=("with the", "avec", "nicht", "para", "clown", "idiot"), strong=("avec", "clown"), truncation=("from the", "dans le"))
MARKETING = MarketingPack(
    marketing=("clown", "idiot", "with the", "avec"),
    navigation=("from", "dans"),
    meta=("license", "copyright", "nicht"),
    self_references=(r"\bthe\b", r"\bund\b"),
    function_words=("the", "and", "with", "this", "that", "from", "pour", "avec", "dans", "nicht", "para"),
)
#: Terms of the test lexicon: words that occur, with invented labels.
LEXICON = (
    ("the", "DETERMINER"), ("of the", "PHRASE"), ("to the", "PHRASE"), ("and", "JOINER"), ("und", "JOINER"), ("et", "JOINER"),
    ("with", "RELATION"), ("avec", "RELATION"), ("from", "RELATION"), ("pour", "RELATION"), ("para", "RELATION"), ("was", "STATE"),
    ("nicht", "STATE"), ("clown", "PERSON"), ("idiot", "PERSON"), ("license", "LEGAL"), ("copyright", "LEGAL"),
    ("rights reserved", "LEGAL"), ("that", "POINTER"), ("this", "POINTER"), ("des", "DETERMINER"), ("der", "DETERMINER"),
)


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON), "term string, label string")


LEXICON_SQL = "lexicon(term, label) AS (VALUES " + ", ".join(f"('{t}', '{x}')" for t, x in LEXICON) + ")"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded so that sums in another order compare equal."""
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def joined(column: str) -> Column:
    """An array of strings as one string."""
    return F.array_join(column, "|").alias(column)
