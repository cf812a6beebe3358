"""Rendezvous hashing of record keys over weighted shards, in built-in expressions only.

Every (key, shard) pair has a pseudo-random score and a record goes to the shard that scores
highest.  A new shard takes just those records on which it outscores all others; nothing moves
between old shards.  Scores are -weight / ln(u) with u uniform in (0, 1) out of an MD5, so a
shard's share follows its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans import scratch

#: Bits of the MD5 that make u: so many that a double holds them exactly.
_HEX = 13


def score(key: Column, shard: int, weight: float) -> Column:
    """The score of one shard for a key given as a string."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")))
    whole = F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("double")
    return F.lit(-float(weight)) / F.ln((whole + 0.5) / float(16**_HEX))


def _best(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct(score, -shard) of the winner; equal scores fall to the smaller shard."""
    each = [
        F.struct(score(key, first + i, w).alias("score"), F.lit(-(first + i)).alias("minus"))
        for i, w in enumerate(weights)
    ]
    return F.array_max(F.array(*each))


def assign(docs: DataFrame, key_col: str, weights: Sequence[float], grown: Sequence[float] = ()) -> DataFrame:
    """The rows with ``shard``, and ``grown_shard`` once the shards of ``grown`` are added.

    A key is any value that casts to a string; rows with a null key share one shard, as rows
    with equal keys do.  Weights must be positive.
    """
    if not weights or any(w <= 0 for w in [*weights, *grown]):
        raise ValueError("each shard needs a positive weight")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    out = docs.withColumn("__best", _best(key, weights))
    out = out.withColumn("shard", (-F.col("__best.minus")).cast("int"))
    if grown:
        out = out.withColumn("__new", _best(key, grown, len(weights)))
        won = F.col("__new.score") > F.col("__best.score")
        out = out.withColumn("grown_shard", F.when(won, -F.col("__new.minus")).otherwise(F.col("shard")).cast("int"))
    return out.drop("__best", "__new")


def number_slots(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with ``slot``, gapless from 0 within each shard in the given order.

    Rows are range-partitioned by shard and order, so a shard spreads over as many partitions
    as it needs, and numbered inside partitions; counts of each (partition, shard), of which
    there are fewer than partitions plus shards, give where a partition starts.  Rows are written
    before they are partitioned, as the bounds of ranges are sampled from them, and after: counts
    and numbers then see the same partitions.  Rows that tie in the whole order get slots in any
    order.
    """
    tied = scratch.written(rows.withColumn("__tie", F.monotonically_increasing_id()), narrow=True)
    dealt = tied.repartitionByRange("shard", *order, "__tie").withColumn("__part", F.spark_partition_id())
    dealt = scratch.written(dealt)
    counts = dealt.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    start = "coalesce(sum(__n) over (partition by shard order by __part rows between unbounded preceding and 1 preceding), 0)"
    starts = counts.select("shard", "__part", F.expr(start).alias("__start"))
    place = "row_number() over (partition by shard, __part order by {}) - 1".format(", ".join([*order, "__tie"]))
    numbered = dealt.withColumn("__place", F.expr(place))
    out = numbered.join(F.broadcast(starts), ["shard", "__part"])
    slot = (F.col("__start") + F.col("__place")).cast("bigint").alias("slot")
    return out.select(*rows.columns, slot)


def shard_records(
    docs: DataFrame,
    weights: Sequence[float],
    grown: Sequence[float] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row.

    ``size`` is the text's UTF-8 bytes plus 16; a null text has none, and the CRC-32 of
    nothing.  The law is ``key``: a record's shard depends on its id and the shards alone.
    Slots follow id, then CRC and size.  Texts are summed up where they lie and never shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = number_slots(assign(narrow, "doc_id", weights, grown), ["doc_id", "text_crc32", "size"])
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot"]
    return placed.select(*columns, *(["grown_shard"] if grown else []))
