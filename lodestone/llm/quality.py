"""Quality rules whose cutoffs come with a proven limit on false rejection.

Each rule compares a ratio of counts of the whole text with a cutoff.  Labelled good documents
tell how many of them a cutoff would reject, and an exact binomial (Clopper-Pearson) bound how
many of all good documents it can reject at most.  Cutoffs are tried from the loosest down
within each stratum and rule, stopping at the first that cannot be certified, so a rule's whole
sequence costs one test; the confidence is split over all strata and rules (Bonferroni), and the
allowed share of false rejections over the rules.  :func:`joint_cutoffs`, which the query and the
pipeline use, certifies the rules together instead and needs a fifth of the labels.  A stratum
with too few labels gets no cutoff and loses nothing to the rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import judged
from lodestone.plans import scratch
from lodestone.plans.arrow import map_arrow, table

WINDOW_WORDS, MIN_WORDS, MAX_REPEAT_PCT = 8, 20, 30
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
_FACTOR, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1

COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
COUNTS += ", n_lines bigint, n_shouted bigint"

#: Rules: a name and the counts that its ratio divides.
RULES = (
    ("symbols", "n_symbols", "word_chars"),
    ("repeats", "n_repeat_words", "n_words"),
    ("same_lines", "n_dup_lines", "n_lines"),
    ("shouting", "n_shouted", "word_chars"),
)
#: Cutoffs tried for every ratio, loosest first: a document is rejected above its cutoff.
CUTOFFS = tuple(round(0.9 - 0.02 * i, 2) for i in range(45))
#: Of the good documents of a stratum at most this share is rejected, with this error probability.
MAX_FALSE, ERROR = 0.02, 0.05
#: The strata; other languages and null are one more.
STRATA = ("en", "fr", "de", "es")


def repeated_words(words: Sequence[bytes | str]) -> int:
    """How many words lie in windows of eight words that occur twice or more in the text."""
    n = len(words) - WINDOW_WORDS + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window, power = np.zeros(n, np.uint64), 1
    for k in range(WINDOW_WORDS):
        window += (hashes[k : k + n] ^ (hashes[k : k + n] >> np.uint64(29))) * np.uint64(power)
        power = power * _FACTOR & _MASK
    order = np.argsort(window, kind="stable")
    ordered = window[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n + 1, bool)
    twice[1:n] = same
    twice[: n - 1] |= same
    starts = order[twice[:n]]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW_WORDS, -1)
    return int((np.cumsum(edges) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of ``COUNTS``."""
    if not text:
        return (0, 0, 0, 0, 0, 1, 0)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = text.split("\n")
    filled = [x for x in lines if x.strip(BLANKS)]
    shouted = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ!"))
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(filled) - len(set(filled)),
        repeated_words(words),
        len(lines),
        shouted,
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.array([text_counts(t.as_py()) for t in batch.column(0)], np.int64).reshape(-1, 7)
        columns = [pa.array(np.ascontiguousarray(c)) for c in counts.T]
        names = [x.split()[0] for x in COUNTS.split(", ")]
        yield pa.RecordBatch.from_arrays([*columns, *batch.columns[1:]], [*names, *batch.schema.names[1:]])


def count_texts(docs: DataFrame, text_col: str, carry: Sequence[Column]) -> DataFrame:
    """The counts of every whole text, with the carried columns of its row."""
    narrow = docs.select(F.col(text_col).alias("__text"), *carry)
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[1:])
    return map_arrow(narrow, _counted, COUNTS + fields)


def base_failed() -> Column:
    """Under twenty words, or over 30 % of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def upper_bound(bad: int, n: int, error: float) -> float:
    """The exact binomial upper bound on a rate of which ``bad`` cases in ``n`` were seen."""
    if bad >= n:
        return 1.0

    def at_most(p: float) -> float:
        terms = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p) for k in range(bad + 1)]
        top = max(terms)
        return exp(top) * sum(exp(t - top) for t in terms)

    low, high = bad / n, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if at_most(mid) > error else (low, mid)
    return high


def _ratio(rule: tuple[str, str, str]) -> Column:
    return F.coalesce(F.col(rule[1]) / F.when(F.col(rule[2]) > 0, F.col(rule[2])), F.lit(0.0))


def _stratum(strata: Sequence[str]) -> Column:
    return F.when(F.col("__stratum").isin(*strata), F.col("__stratum")).otherwise("*")


def certified_cutoffs(
    counted: DataFrame,
    labels: DataFrame,
    strata: Sequence[str] = STRATA,
    max_false: float = MAX_FALSE,
    error: float = ERROR,
) -> dict[tuple[str, str], float]:
    """Cutoffs by (stratum, rule) that reject at most ``max_false`` of a stratum's good documents
    over all rules, all of them at once with probability ``1 - error``.

    ``counted`` has the counts with ``__id`` and ``__stratum``, ``labels`` ``doc_id`` and ``quality``; documents of quality 1 that pass the base rule are
    the holdout.  Documents labelled twice with different qualities, with a null quality or a
    null id are left out.  Only counts by stratum, rule and cutoff leave the cluster.
    """
    clear = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2"))
    good = clear.filter("doc_id is not null and q = 1 and q2 = 1").select(F.col("doc_id").alias("__doc"))
    held = counted.filter(~base_failed()).join(good, F.col("__id") == F.col("__doc"), "left_semi")
    held = held.withColumn("stratum", _stratum(strata))
    above = [F.count_if(_ratio(r) > c).alias(f"{r[0]}_{i}") for r in RULES for i, c in enumerate(CUTOFFS)]
    seen = held.groupBy("stratum").agg(F.count("*").alias("n"), *above).collect()
    each = error / (len(RULES) * (len(strata) + 1))
    found = {}
    for row in seen:
        for rule in RULES:
            for i, cutoff in enumerate(CUTOFFS):
                if upper_bound(row[f"{rule[0]}_{i}"], row["n"], each) > max_false / len(RULES):
                    break
                found[row["stratum"], rule[0]] = cutoff
    return found


def _place(rule: tuple[str, str, str]) -> Column:
    """The number of the loosest cutoff that rejects a row, ``len(CUTOFFS)`` if none does."""
    return sum((F.when(_ratio(rule) > c, 0).otherwise(1) for c in CUTOFFS), F.lit(0))


def joint_cutoffs(
    counted: DataFrame,
    labels: DataFrame,
    strata: Sequence[str] = STRATA,
    max_false: float = MAX_FALSE,
    error: float = ERROR,
) -> dict[tuple[str, str], float]:
    """As :func:`certified_cutoffs`, but certifying what all rules together reject.

    A stratum tightens one rule by one cutoff a step, those steps first that reject few
    unlabelled documents for each bad one, and stops at the first step whose joint rejection
    cannot be certified.  The order comes from documents without a good label alone, so it is
    fixed before the good ones are looked at and a stratum's whole sequence costs one test.
    """
    clear = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2"), F.count_if(F.col("quality").isNull()).alias("nulls"))
    clear = clear.select(F.col("doc_id").alias("__doc"), F.when((F.col("q") == F.col("q2")) & (F.col("nulls") == 0), F.col("q")).alias("quality"))
    held = counted.filter(~base_failed()).join(clear, F.col("__id") == F.col("__doc"), "left").withColumn("stratum", _stratum(strata))
    above = [F.count_if(_ratio(r) > c).alias(f"{r[0]}_{i}") for r in RULES for i, c in enumerate(CUTOFFS)]
    seen: dict[str, dict[int, dict]] = {}
    for row in held.filter("quality is null or quality <> 1").groupBy("stratum", F.coalesce(F.col("quality") == 0, F.lit(False)).alias("bad")).agg(*above).collect():
        seen.setdefault(row["stratum"], {})[row["bad"]] = row.asDict()
    steps: dict[str, list[tuple[str, int]]] = {}
    for stratum in (*strata, "*"):
        other, bad = (seen.get(stratum, {}).get(k, {}) for k in (False, True))
        scored = []
        for k, (rule, _, _) in enumerate(RULES):
            worst = 0.0
            for i in range(len(CUTOFFS)):
                worst = max(worst, (other.get(f"{rule}_{i}", 0) + 1) / (bad.get(f"{rule}_{i}", 0) + 1))
                scored.append((worst, i, k))
        steps[stratum] = [(RULES[k][0], i) for _, i, k in sorted(scored)]
    never = len(CUTOFFS) * len(RULES)
    first = []
    for rule in RULES:
        by_stratum = F.lit(None).cast("array<int>")
        for stratum, order in steps.items():
            at = sorted((i, n) for n, (name, i) in enumerate(order) if name == rule[0])
            by_stratum = F.when(F.col("stratum") == stratum, F.array(*[F.lit(n) for _, n in at], F.lit(never))).otherwise(by_stratum)
        first.append(F.get(by_stratum, _place(rule)))
    good = held.filter("quality = 1").withColumn("step", F.least(*first)).groupBy("stratum", "step").count().collect()
    found = {}
    for stratum, order in steps.items():
        times = {r["step"]: r["count"] for r in good if r["stratum"] == stratum}
        n, rejected = sum(times.values()), 0
        for k, (rule, i) in enumerate(order):
            rejected += times.get(k, 0)
            if n == 0 or upper_bound(rejected, n, error / len(steps)) > max_false:
                break
            found[stratum, rule] = CUTOFFS[i]
    return found


def evidence(told: DataFrame, labels: DataFrame, strata: Sequence[str] = STRATA, error: float = ERROR) -> DataFrame:
    """``(stratum, n_good, false_bound)``: for each stratum how many labelled good documents pass
    the base rule, and the bound on the share of such documents that its verdicts reject.

    A stratum with too few labels for any cutoff has no rejection among them and a bound that is
    above the allowance all the same.  One row for each stratum leaves the cluster.
    """
    clear = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.every(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"))
    held = told.filter(~F.col("base_failed")).join(clear.filter("good").select(F.col("doc_id").alias("__doc")), F.col("__id") == F.col("__doc"), "left_semi")
    seen = held.groupBy(_stratum(strata).alias("stratum")).agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("out")).collect()
    found = {r["stratum"]: (r["n"], r["out"]) for r in seen}
    rows = []
    for stratum in (*strata, "*"):
        n, out = found.get(stratum, (0, 0))
        rows.append((stratum, n, upper_bound(out, n, error / (len(strata) + 1))))
    return table(told.sparkSession, rows, stratum=pa.string(), n_good=pa.int64(), false_bound=pa.float64())


def verdicts(
    counted: DataFrame,
    cutoffs: dict[tuple[str, str], float],
    strata: Sequence[str] = STRATA,
) -> DataFrame:
    """The counted rows with ``base_failed`` and ``kept``."""
    stratum = _stratum(strata)
    rejected = F.lit(False)
    for (name, rule), cutoff in sorted(cutoffs.items()):
        ratio = _ratio(next(r for r in RULES if r[0] == rule))
        rejected = rejected | ((stratum == name) & (ratio > cutoff))
    out = counted.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected)


def _named(id_col: str, stratum_col: str) -> list[Column]:
    return [F.col(id_col).alias("__id"), F.col(stratum_col).alias("__stratum")]


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", certify: Callable = certified_cutoffs) -> DataFrame:
    """``(doc_id, counts, base_failed, kept, stratum, n_good, false_bound)`` for each row, the
    last two as of :func:`evidence`.

    A null or empty text has no words, fails the base rule and is not kept; its counts are zero.
    Rows with a null id are judged but never labelled; repeated rows are judged alike, and each
    counts in the holdout when its id is labelled.  Without labels only the base rule rejects.
    """
    counted = scratch.written(count_texts(docs, text_col, _named(id_col, stratum_col)))
    told = verdicts(counted, certify(counted, labels))
    bounds = evidence(told, labels)  # a row for each stratum
    out = told.withColumn("stratum", _stratum(STRATA)).join(F.broadcast(bounds), "stratum")
    names = [c.split()[0] for c in COUNTS.split(", ")]
    return out.select(F.col("__id").alias("doc_id"), *names, "base_failed", "kept", "stratum", "n_good", "false_bound")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", certify: Callable = certified_cutoffs) -> DataFrame:
    """The rows that :func:`judge` keeps, with all their columns, whatever those are called.

    Null and empty texts go; rows that repeat stay or go together; an empty table stays empty.
    """
    keys = [F.col(id_col), F.col(stratum_col), judged.text_key(text_col)]
    named = [F.col(id_col).alias("__id"), F.col(stratum_col).alias("__stratum"), keys[2].alias("__key")]
    counted = scratch.written(count_texts(docs, text_col, named))
    told = verdicts(counted, certify(counted, labels))
    return judged.without(docs, told.filter("not kept").select("__id", "__stratum", "__key"), keys)
