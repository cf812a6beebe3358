"""Queries for entity mentions, over the chunks of articles and the test lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import chunk as C
from lodestone.operators import entities as E
from lodestone.operators import packs
from lodestone.operators import reports as R
from lodestone.plans import scratch
from lodestone.queries.chunks import WITH_CHUNKS, chunks
from lodestone.queries.common import LEXICON_SQL, NOT_WORD, WORD, WS, articles, joined, lexicon, rounded, strip_sql, table

COMMON = ("and", "und", "et", "des", "der")
STEMS = (("clowns", "clown"), ("idiots", "idiot"), ("licenses", "license"), ("licensed", "license"), ("copyrighted", "copyright"))
FORMS = (("clown", "person"), ("idiot", "person"), ("copyright", "license"))


def keyed_chunks(spark, sf_dir, *columns):
    """Chunks with their key and the named texts, ``text`` by default."""
    columns = columns or ("text",)
    c = chunks(spark, sf_dir, "chunk_id", *columns)
    return c.select("article_id", C.chunk_key(F.col("article_id"), F.col("chunk_id")).alias("chunk_id"), *columns)


def found(spark, sf_dir, column="text", rows=None):
    """The terms of the test lexicon in the texts of all chunks, or of the given ones."""
    return E.lexicon_entities(keyed_chunks(spark, sf_dir, column) if rows is None else rows, lexicon(spark), text_col=column)


def mentions(spark, sf_dir, rows=None):
    """Filtered mentions without overlaps: article_id, chunk_id, text, label, confidence."""
    kept = E.entity_filter(E.without_overlaps(found(spark, sf_dir, rows=rows)), COMMON)
    return kept.select(F.expr("id div 1000000").alias("article_id"), F.col("id").alias("chunk_id"), "text", "label", "start", "end", "confidence")


def lexicon_entities(spark, sf_dir):
    m = found(spark, sf_dir)
    return m.select(F.col("id").alias("chunk_id"), "text", "label", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def regex_entities(spark, sf_dir):
    return E.regex_entities(keyed_chunks(spark, sf_dir)).select(F.col("id").alias("chunk_id"), "text", "label", "confidence")


def overlap_resolution(spark, sf_dir):
    m = E.without_overlaps(found(spark, sf_dir))
    return m.select(F.col("id").alias("chunk_id"), "text", "label", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def _capitals():
    """Capitalised words as a stand-in for a statistical model's mentions."""
    return lambda words: [(i, i + 1, "MISC") for i, w in enumerate(words) if w[0].isupper()]


def _named(spark, sf_dir, rows=None):
    return E.statistical_entities(keyed_chunks(spark, sf_dir) if rows is None else rows, _capitals)


def _once(spark, sf_dir, *columns):
    """Keyed chunks that are read more than once, so written once."""
    return scratch.written(keyed_chunks(spark, sf_dir, *columns))


def statistical_entities(spark, sf_dir):
    return _named(spark, sf_dir).groupBy("label", "text").agg(F.count("*").alias("n"))


def ner_antijoin(spark, sf_dir):
    c = _once(spark, sf_dir)
    m = E.ner_antijoin(_named(spark, sf_dir, c), found(spark, sf_dir, rows=c))
    return m.groupBy(F.col("id").alias("chunk_id")).agg(F.count("*").alias("mentions"))


def entity_filter(spark, sf_dir):
    c = _once(spark, sf_dir)
    both = found(spark, sf_dir, rows=c).select("id", "text", "label", "confidence").unionByName(_named(spark, sf_dir, c).select("id", "text", "label", "confidence"))
    both = both.unionByName(E.regex_entities(c))
    return E.entity_filter(both, COMMON).groupBy("label", F.lower("text").alias("text")).agg(F.count("*").alias("n"))


def entity_normalize(spark, sf_dir):
    return mentions(spark, sf_dir).select("text", E.entity_name(F.col("text"), FORMS).alias("name")).distinct()


def entity_merge(spark, sf_dir):
    m = E.entity_merge(mentions(spark, sf_dir), FORMS, (("person", ("idiot",)),))
    return m.select("normalized_name", "name", "label", "mention_count", F.round("confidence", 6).alias("confidence"), joined("variants"))


def entity_stats(spark, sf_dir):
    return rounded(E.entity_stats(mentions(spark, sf_dir)), "avg_confidence")


def entity_type_counts(spark, sf_dir):
    """Mentions by label before overlaps are resolved, contexts included."""
    c = _once(spark, sf_dir, "text", "following_context")
    both = found(spark, sf_dir, rows=c).unionByName(found(spark, sf_dir, "following_context", c))
    return both.groupBy("label").agg(F.count("*").alias("n"))


def entity_type_stats(spark, sf_dir):
    t = E.type_stats(mentions(spark, sf_dir))
    return t.select("label", "mentions", "unique_names", joined("top_names"))


def entity_top_texts(spark, sf_dir):
    """The twenty names met most: a report of a fixed length."""
    return R.top_texts(mentions(spark, sf_dir))


def entity_type_kept(spark, sf_dir):
    """Types with enough mentions and names to be worth a node type, a model's among them."""
    c = _once(spark, sf_dir)
    both = mentions(spark, sf_dir, c).select("label", "text").unionByName(_named(spark, sf_dir, c).select("label", "text"))
    return E.kept_types(both)


def chunk_entities(spark, sf_dir):
    """Each chunk's mentions, in text and following context apart, without overlaps."""
    c = _once(spark, sf_dir, "text", "following_context")
    both = found(spark, sf_dir, rows=c).withColumn("part", F.lit("text")).unionByName(found(spark, sf_dir, "following_context", c).withColumn("part", F.lit("context")))
    m = E.without_overlaps(both, ["part"])
    return m.groupBy(F.col("id").alias("chunk_id"), "part").agg(F.count("*").alias("mentions"), F.count_distinct("label").alias("labels"))


def context_entities(spark, sf_dir):
    """The text's mentions and those of the first part of a long context that the text lacks."""
    c = _once(spark, sf_dir, "text", "following_context")
    part = c.filter(F.length("following_context") > 50).withColumn("part", F.substring("following_context", 1, 500))
    m = E.context_entities(found(spark, sf_dir, rows=c), found(spark, sf_dir, "part", part))
    return m.groupBy(F.col("id").alias("chunk_id")).agg(F.count("*").alias("mentions"))


def article_diversity(spark, sf_dir):
    from lodestone.operators.graph import article_diversity as run

    return run(mentions(spark, sf_dir)).select("article_id", "unique_entities", "mentions", joined("top_entities"))


def stem_lookup(spark, sf_dir):
    q = table(spark, sf_dir, "documents").select("doc_id", F.explode(E.stems(F.col("text"), STEMS)).alias("stem"))
    return q.groupBy("doc_id", "stem").agg(F.count("*").alias("n"))


def query_entities(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return E.query_entities(q, lexicon(spark), STEMS).select(F.col("id").alias("item_id"), "entity")


QUERIES = {f.__name__: f for f in (lexicon_entities, regex_entities, overlap_resolution, statistical_entities, ner_antijoin, entity_filter, entity_normalize, entity_merge, entity_stats, entity_type_counts, entity_type_stats, entity_top_texts, entity_type_kept, chunk_entities, context_entities, article_diversity, stem_lookup, query_entities)}


def found_sql(name: str, rows: str, text: str = "text") -> str:
    return f"""{name}_w AS (SELECT chunk_id, regexp_extract_all({text}, '{WORD}+') AS w FROM {rows}),
{name}_g AS (SELECT chunk_id, w, n.n AS n, unnest(range(len(w) - n.n + 1)) AS i FROM {name}_w, (VALUES (1), (2), (3)) n(n) WHERE len(w) >= n.n),
{name} AS (SELECT chunk_id, array_to_string(w[i + 1 : i + n], ' ') AS text, label, i AS start, i + n AS "end" FROM {name}_g JOIN lexicon ON term = lower(array_to_string(w[i + 1 : i + n], ' ')))"""


def clear_sql(name: str) -> str:
    """Longer terms win; terms of equal length cannot overlap in this lexicon."""
    return f"""{name}_clear AS (SELECT * FROM {name} a WHERE NOT EXISTS (SELECT 1 FROM {name} b WHERE b.chunk_id = a.chunk_id AND b."end" - b.start > a."end" - a.start AND a.start < b."end" AND a."end" > b.start))"""


_QUOTED = ", ".join(f"'{c}'" for c in COMMON)
KEYED = f"""{WITH_CHUNKS}, {LEXICON_SQL}, kc AS (SELECT article_id, article_id * 1000000 + chunk_id AS chunk_id, text FROM chunks), {found_sql('fe', 'kc')}"""
MENTIONS = f"""{KEYED}, {clear_sql('fe')}, mentions AS (SELECT chunk_id // 1000000 AS article_id, chunk_id, text, label, start, "end", 1.0::DOUBLE AS confidence FROM fe_clear WHERE lower(text) NOT IN ({_QUOTED}))"""
_NAMED = f"""nw AS (SELECT chunk_id, regexp_extract_all(text, '{WORD}+') AS w FROM kc),
nn AS (SELECT chunk_id, unnest(range(len(w))) AS start, unnest(w) AS text FROM nw), named AS (SELECT * FROM nn WHERE regexp_matches(text, '^\\p{{Lu}}'))"""
_BY_PATTERN = " UNION ALL ".join(
    f"SELECT chunk_id, unnest(regexp_extract_all(text, '(?i)(?:^|{NOT_WORD})([0-9]+(?:[.,][0-9]+)?{WS}*(?:{p[p.index('(?:', 12) + 3 : -3]}))(?:$|{NOT_WORD})', 1)) AS text, 'MEASUREMENT' AS label, 0.9::DOUBLE AS confidence FROM kc"
    for p in packs.MEASUREMENTS
)
#: A formula has word characters only and so is a whole word.
_PATTERNS = f"""fw AS (SELECT chunk_id, unnest(regexp_extract_all(text, '{WORD}+')) AS text FROM kc),
patterned AS (
  SELECT chunk_id, text, 'CHEMICAL_FORMULA' AS label, 0.8::DOUBLE AS confidence FROM fw
  WHERE regexp_full_match(text, '[A-Z][a-z]?[0-9]*(?:[A-Z][a-z]?[0-9]*)*') AND length(text) > 1 AND lower(text) NOT IN ({', '.join(f"'{x}'" for x in packs.FORMULA_STOP)})
  UNION ALL {_BY_PATTERN})"""
_ABBREVIATED, _GENERIC = (", ".join(f"'{x}'" for x in xs) for xs in ([a for a in packs.ABBREVIATIONS if a == a.upper()], packs.GENERIC_FORMULAS))
_CTX = f"""sent AS (SELECT doc_id, ss FROM sl),
ends AS (SELECT doc_id, n AS i, sum(w) AS p FROM sp GROUP BY doc_id, n UNION ALL SELECT doc_id, i, p FROM sp),
fc AS (SELECT c.article_id * 1000000 + c.chunk_id AS chunk_id, array_to_string(ss[e0 + 1 : (SELECT max(x.i) FROM ends x WHERE x.doc_id = c.article_id AND x.i >= c.e0 AND x.p - e.p <= 30)], ' ') AS text
  FROM chunks c JOIN ends e ON e.doc_id = c.article_id AND e.i = c.e0)"""
_FORMS = "CASE " + " ".join(f"WHEN t = '{a}' THEN '{b}'" for a, b in FORMS) + " ELSE t END"
_NAME = "(SELECT " + _FORMS + " FROM (SELECT regexp_replace(lower(text), '^(?:a|the|na|v|o|do|pre|pri|od|za) +', '') AS t))"
_STEM = "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STEMS) + " END"

SQL = {
    "lexicon_entities": f'{KEYED} SELECT chunk_id, text, label, start, "end" FROM fe',
    "overlap_resolution": f'{KEYED}, {clear_sql("fe")} SELECT chunk_id, text, label, start, "end" FROM fe_clear',
    "ner_antijoin": f"""{KEYED}, {_NAMED}
SELECT chunk_id, count(*) AS mentions FROM named s WHERE NOT EXISTS (SELECT 1 FROM fe r WHERE r.chunk_id = s.chunk_id AND ((r.start <= s.start AND s.start < r."end") OR (r.start < s.start + 1 AND s.start + 1 <= r."end"))) GROUP BY 1""",
    "entity_normalize": f"{MENTIONS}, d AS (SELECT DISTINCT text FROM mentions) SELECT text, {_NAME} AS name FROM d",
    "entity_merge": f"""{MENTIONS}, m AS (SELECT {_NAME} AS name, text, label, confidence FROM mentions),
t0 AS (SELECT name, text, label, count(*) AS n FROM m GROUP BY 1, 2, 3), t AS (SELECT *, sum(n) OVER (PARTITION BY name, text) AS times FROM t0),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY (CASE WHEN name = 'person' AND text = 'idiot' THEN 1000 ELSE 0 END) + times * 10 + 5
  + CASE WHEN upper(text) = text AND lower(text) <> text AND length(text) <= 5 THEN 50 WHEN length(text) > 1 AND upper(text[1]) = text[1] AND lower(text[1]) <> text[1] AND lower(text[2:]) = text[2:] THEN 20 ELSE 0 END DESC, text, label) AS k FROM t)
SELECT name AS normalized_name, max(text) FILTER (k = 1) AS name, max(label) FILTER (k = 1) AS label, sum(n)::BIGINT AS mention_count, 1.0::DOUBLE AS confidence, array_to_string(list_sort(list_distinct(list(text))), '|') AS variants FROM r GROUP BY r.name""",
    "entity_stats": f"{MENTIONS} SELECT count(*) AS total_entities, count(DISTINCT lower(text)) AS unique_entities, count(DISTINCT label) AS entity_types, round(avg(confidence), 6) AS avg_confidence FROM mentions",
    "entity_type_counts": f"{KEYED}, {_CTX}, {found_sql('fx', 'fc')}, u AS (SELECT label FROM fe UNION ALL SELECT label FROM fx) SELECT label, count(*) AS n FROM u GROUP BY 1",
    "entity_type_stats": f"""{MENTIONS}, n AS (SELECT label, lower(text) AS name, count(*) AS n FROM mentions GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, name) AS k FROM n)
SELECT label, sum(n)::BIGINT AS mentions, count(*) AS unique_names, string_agg(name, '|' ORDER BY k) FILTER (k <= 10) AS top_names FROM r GROUP BY 1""",
    "entity_top_texts": f"{MENTIONS} SELECT lower(text) AS name, count(*) AS mentions FROM mentions GROUP BY 1 ORDER BY mentions DESC, name LIMIT 20",
    "statistical_entities": f"{KEYED}, {_NAMED} SELECT 'SPACY_MISC' AS label, text, count(*) AS n FROM named GROUP BY text",
    "entity_type_kept": f"""{MENTIONS}, {_NAMED}, u AS (SELECT label, text FROM mentions UNION ALL SELECT 'SPACY_MISC', text FROM named)
SELECT label, count(*) AS mentions, count(DISTINCT lower(text)) AS unique_names FROM u GROUP BY 1 HAVING count(*) > 50 AND count(DISTINCT lower(text)) > 5""",
    "regex_entities": f"{KEYED}, {_PATTERNS} SELECT * FROM patterned",
    "entity_filter": f"""{KEYED}, {_PATTERNS}, u AS (SELECT text, label FROM fe UNION ALL SELECT text, label FROM patterned)
SELECT label, lower(text) AS text, count(*) AS n FROM u
WHERE NOT (label = 'CHEMICAL_FORMULA' AND length(text) <= 2) AND {strip_sql('lower(text)')} NOT IN ({_QUOTED})
  AND NOT (length({strip_sql('text')}) <= 2 AND upper({strip_sql('text')}) NOT IN ({_ABBREVIATED})) AND NOT regexp_matches({strip_sql('text')}, '^(?:[0-9]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_ ]+)$')
  AND NOT (label = 'CHEMICAL_FORMULA' AND length({strip_sql('text')}) <= 3 AND lower({strip_sql('text')}) IN ({_GENERIC})) GROUP BY 1, 2""",
    "chunk_entities": f"""{KEYED}, {_CTX}, {found_sql('fx', 'fc')}, {clear_sql('fe')}, {clear_sql('fx')},
u AS (SELECT chunk_id, 'text' AS part, label FROM fe_clear UNION ALL SELECT chunk_id, 'context', label FROM fx_clear)
SELECT chunk_id, part, count(*) AS mentions, count(DISTINCT label) AS labels FROM u GROUP BY 1, 2""",
    "context_entities": f"""{KEYED}, {_CTX}, fl AS (SELECT chunk_id, substr(text, 1, 500) AS text FROM fc WHERE length(text) > 50), {found_sql('fx', 'fl')},
u AS (SELECT chunk_id FROM fe UNION ALL SELECT chunk_id FROM fx WHERE NOT EXISTS (SELECT 1 FROM fe WHERE fe.chunk_id = fx.chunk_id AND lower(fe.text) = lower(fx.text)))
SELECT chunk_id, count(*) AS mentions FROM u GROUP BY 1""",
    "article_diversity": f"""{MENTIONS}, n AS (SELECT article_id, lower(text) AS e, count(*) AS n FROM mentions GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY n DESC, e) AS k FROM n)
SELECT article_id, count(*) AS unique_entities, sum(n)::BIGINT AS mentions, string_agg(e, '|' ORDER BY k) FILTER (k <= 5) AS top_entities FROM r GROUP BY 1""",
    "stem_lookup": f"""
WITH w AS (SELECT doc_id, unnest(list_transform(string_split_regex(lower(text), '[ \\n]+'), lambda x: regexp_replace(x, '[^\\p{{L}}]', '', 'g'))) AS x FROM documents)
SELECT doc_id, {_STEM} AS stem, count(*) AS n FROM w WHERE {_STEM} IS NOT NULL GROUP BY 1, 2""",
    "query_entities": f"""
WITH {LEXICON_SQL}, kc AS (SELECT item_id AS chunk_id, text FROM benchmark), {found_sql('fe', 'kc')},
w AS (SELECT item_id, unnest(list_transform(string_split_regex(lower(text), '[ \\n]+'), lambda x: regexp_replace(x, '[^\\p{{L}}]', '', 'g'))) AS x FROM benchmark)
SELECT chunk_id AS item_id, lower(text) AS entity FROM fe WHERE length(text) > 2 UNION SELECT item_id, {_STEM} FROM w WHERE {_STEM} IS NOT NULL""",
}
