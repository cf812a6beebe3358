"""The registered queries over the operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import embed_dedup, langid, line_dedup, mixing, packing, quality, sharding, simhash, topics, url_filter, warc
from lodestone.plans import scratch

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 40
#: (host, path, allow)
URL_RULES = (
    ("com", "/en/", False),
    ("example.com", "/en/7", True),
    ("net", "/de/", True),
    ("example.net", "/de/8", False),
    ("org", "/es/", False),
)
MIX = mixing.Plan(
    categories={
        "source": [f"src{i}" for i in range(20)],
        "lang": ["en", "fr", "de", "es"],
        "topic": topics.names(),
    },
    powers={"source": 0.7, "lang": 0.7, "topic": 0.8},
    share=0.5,
)


def tokenizer() -> str:
    """The place of the packing vocabulary; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back.  Null html is an empty payload; null
    ids are records that none refer to; an empty table has no records."""
    folder = scratch.folder(spark)
    manifest = warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(manifest, folder).drop("url", "file")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold, kept in the largest id only.  Null and empty texts
    have one empty line; a null id neither counts nor loses lines; rows that repeat an id are one document."""
    docs = _table(spark, sf_dir, "documents")
    return line_dedup.line_counts(docs, line_dedup.keep_bitmaps(docs)).withColumnRenamed("id", "doc_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page.  Null URLs, and those without ``://``, have an empty host
    and path and are allowed; repeated rows are judged alike."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document.  Null and wordless texts have fingerprint zero; a
    null id never names a group; repeated rows come out as often as they come in."""
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    print16 = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return groups.select(F.col("id").alias("doc_id"), print16, F.col("component").alias("component_id"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by rendezvous hashing of its id, equal weights.  A null text
    has no bytes; null ids are one key; rows that tie in id, CRC and size get slots in any order."""
    return sharding.shard_records(_table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their windows.  Null and empty texts are their end id alone;
    repeated rows are packed each."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, tokens, probability and draw of every document.  Null and unlisted categories share one
    cell of their dimension; texts without tokens have no topic; repeated ids of one cell are drawn alike."""
    docs = _table(spark, sf_dir, "documents")
    weighed = mixing.weigh(docs, MIX, tokenizer())
    cell = [F.col(f"c_{d}").alias(d) for d in mixing.DIMENSIONS]
    return weighed.select(F.col("id").alias("doc_id"), *cell, "n_tokens", "probability", F.col("gap").alias("marginal_gap"), "selected")


def op8_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors.  Null, zero and non-finite vectors and those without a label
    link with nothing; rows that repeat an id are vectors of their own."""
    return embed_dedup.link_embeddings(_table(spark, sf_dir, "embeddings"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document.  Null texts, and those without a letter, are ``und``; a null
    id is neither held out nor learned from."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document under jointly certified cutoffs.  Null and empty texts
    fail the base rule; null ids are judged but never labelled; null languages are the stratum of the rest."""
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), certify=quality.joint_cutoffs)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the pipeline makes of all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = [op1_warc, op2_line_dedup, op3_url_filter, op4_simhash, op5_sharding, op6_packing]
    found += [op7_mixing, op8_embed_dedup, op9_langid, op10_quality, pipeline]
    return {f.__name__: f for f in found}


_OP1 = """
WITH paid AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
least_ids AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM paid)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM least_ids"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TAGS = r"regexp_extract_all(html, '(?is)<{0}\b[^>]*\b{1}\s*=\s*[\x22\x27]?{2}\b[^>]*>')"
_HREF = r"(?is)\bhref\s*=\s*(?:\x22([^\x22]*)\x22|\x27([^\x27]*)\x27|([^\s\x22\x27>]+))"


def _op3_sql() -> str:
    """Rules by all hosts and paths; classes by reachability over links between canonical forms."""
    rest = "substr(u, strpos(u, '://') + 3)"
    host, path = _LOWER.format(f"regexp_extract({rest}, '^[^/?#]*')"), f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    told = f"list_filter(string_split(regexp_extract({rest}, '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{url_filter.TRACKING}'))"
    scheme = "regexp_replace(" + _LOWER.format("substr(u, 1, strpos(u, '://') - 1)") + ", '^http$', 'https')"
    form = f"""{scheme} || '://' || regexp_replace({host}, '{url_filter.ALIAS_HOSTS}', '') || regexp_replace({path}, '{url_filter.ALIAS_ENDS}', '')
    || CASE WHEN len({told}) > 0 THEN '?' || array_to_string({told}, '&') ELSE '' END"""
    rules = ", ".join(f"('{h}', '{p}', '{'allow' if ok else 'block'}')" for h, p, ok in URL_RULES)
    canonical, refresh = _TAGS.format("link", "rel", "canonical"), _TAGS.format("meta", "http-equiv", "refresh")
    return f"""
WITH RECURSIVE tags AS (SELECT url, unnest({canonical}) AS tag FROM pages),
links AS (
  SELECT url, trim(regexp_extract(tag, '{_HREF}', 1) || regexp_extract(tag, '{_HREF}', 2) || regexp_extract(tag, '{_HREF}', 3)) AS link FROM tags
  UNION ALL SELECT url, regexp_extract(unnest({refresh}), '(?is)\\burl\\s*=\\s*[\\x22\\x27]?([^\\x22\\x27>\\s]+)', 1) FROM pages),
ends AS (
  SELECT url AS a, CASE WHEN starts_with(link, '/') THEN regexp_extract(url, '^[^:]*://[^/?#]*') || link ELSE link END AS b
  FROM links WHERE contains(link, '://') OR (starts_with(link, '/') AND NOT starts_with(link, '//'))),
urls AS (SELECT url AS u FROM pages UNION SELECT a FROM ends UNION SELECT b FROM ends),
named AS (
  SELECT u, CASE WHEN contains(u, '://') THEN {host} ELSE '' END AS host, CASE WHEN contains(u, '://') THEN {path} ELSE '' END AS path,
         CASE WHEN contains(u, '://') THEN {form} END AS node FROM urls),
rules(h, p, verdict) AS (VALUES {rules}),
won AS (
  SELECT u, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM named, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY u),
edges AS (SELECT x.node AS s, y.node AS t FROM ends JOIN named x ON x.u = a JOIN named y ON y.u = b WHERE x.node IS NOT NULL AND y.node IS NOT NULL),
both_ways AS (SELECT s, t FROM edges UNION SELECT t, s FROM edges),
reach(s, t) AS (SELECT s, s FROM both_ways UNION SELECT r.s, e.t FROM reach r JOIN both_ways e ON e.s = r.t),
classes AS (SELECT n.node, coalesce(min(t), n.node) AS class FROM (SELECT DISTINCT node FROM named WHERE node IS NOT NULL) n LEFT JOIN reach ON s = n.node GROUP BY n.node),
blocked AS (SELECT class FROM named JOIN won USING (u) JOIN classes USING (node) GROUP BY class HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow'))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(verdict, CASE WHEN b.class IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN named ON named.u = url LEFT JOIN won ON won.u = url LEFT JOIN classes c ON c.node = named.node LEFT JOIN blocked b ON b.class = c.class"""


_OP2 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents),
keyed AS (
  SELECT doc_id, n, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
held AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n)
              FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN held USING (key) GROUP BY doc_id
"""


_OP8 = """
WITH RECURSIVE able AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS s, b.vec_id AS t FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(s, t) AS (SELECT s, t FROM links UNION SELECT r.s, l.t FROM reach r JOIN links l ON l.s = r.t),
least_ids AS (SELECT s, least(s, min(t)) AS component_id FROM reach GROUP BY s),
counts AS (SELECT s, count(*) AS n_links FROM links GROUP BY s)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least_ids ON least_ids.s = vec_id LEFT JOIN counts ON counts.s = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op8_embed_dedup": _OP8, "op1_warc": _OP1, "op2_line_dedup": _OP2, "op3_url_filter": _op3_sql(), "op5_sharding": _op5_sql()}


def _op5_sql() -> str:
    """Scores by MD5 as in the operator; the CRC-32 from its polynomial, byte by byte."""
    digits = sharding._HEX

    def best(shards: int) -> str:
        u = f"(('0x' || substr(md5(doc_id::VARCHAR || ':' || s), 1, {digits}))::BIGINT::DOUBLE + 0.5) / {16**digits}::DOUBLE"
        return f"(SELECT arg_max(s, -1.0 / ln({u})) FROM range({shards}) r(s))"

    return f"""
WITH RECURSIVE step(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
raw AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
placed AS (
  SELECT doc_id, len(b) + 16 AS size, {best(SHARDS)} AS shard, {best(SHARDS + 1)} AS grown,
         xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM raw, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM placed"""

