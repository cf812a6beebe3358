"""Mixes sources by iterative proportional fitting, then samples documents.

Documents fall into cells of source, language and topic; categories are those listed by the
caller and one for the rest, so the table of cells has a bound that the parameters set and only
it leaves the cluster.  Raking scales the cells' tokens to each marginal in turn, never above
the tokens that a cell has, until nothing changes; how far each marginal is then missed is
returned.  A cell's fitted share of its own tokens is the probability with which each of its
documents is drawn, by a hash of its id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import judged, topics
from lodestone.plans import scratch
from lodestone.plans.arrow import table

DIMENSIONS = ("source", "lang", "topic")
REST = "*"
ROUNDS, TOLERANCE = 100_000, 1e-9
_WORD = r"[^\x20\x09-\x0D]+"
_HEX = 13


@dataclass(frozen=True)
class Plan:
    """Listed categories by dimension, the power that tempers their observed shares (0: equal
    shares, 1: as observed), the share of all tokens to draw, and for dimensions whose targets
    are given outright those shares, which ``*`` may have for the rest."""

    categories: Mapping[str, Sequence[str]]
    powers: Mapping[str, float]
    share: float
    targets: Mapping[str, Mapping[str, float]] = field(default_factory=dict)

    def cell(self, dimension: str) -> Column:
        column = F.col(dimension)
        return F.when(column.isin(*self.categories[dimension]), column).otherwise(REST)


def topic(text: Column) -> Column:
    """A coarse subject by wording: legal, table, contact or general; null texts are general."""
    return (
        F.when(text.rlike("(?i)licen[sc]e|copyright|rights reserved"), "legal")
        .when(F.regexp_count(text, F.lit(r" \| ")) >= 5, "table")
        .when(F.instr(text, "@") > 0, "contact")
        .otherwise("general")
    )


def tokens(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def tempered(observed: Mapping[str, float], power: float) -> dict[str, float]:
    """Target shares: observed shares to a power, scaled to one; empty categories have none."""
    raised = {k: v**power for k, v in observed.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(cells: Sequence[tuple[str, ...]], supply: np.ndarray, targets: Sequence[Mapping[str, float]], share: float) -> np.ndarray:
    """The tokens to draw from each cell.

    Each round scales the cells to every marginal in turn and cuts them to their supply; rounds
    end when one changes nothing within the tolerance.  Then either all marginals hold, or
    supply or contradictory targets keep some from it, see :func:`gaps`.  Cells without tokens
    stay at zero.  Raises if rounds do not settle.
    """
    budget = share * float(supply.sum())
    drawn = supply.astype(float) * share
    numbers = []
    for d, wanted in enumerate(targets):
        names = sorted({c[d] for c in cells})
        place = {x: i for i, x in enumerate(names)}
        numbers.append((np.array([place[c[d]] for c in cells], np.int64), np.array([wanted.get(x, 0.0) for x in names]) * budget))
    for _ in range(ROUNDS):
        before = drawn
        for of, wanted in numbers:
            have = np.bincount(of, drawn, len(wanted))
            factor = np.divide(wanted, have, out=np.zeros_like(wanted), where=have > 0)
            drawn = np.minimum(drawn * factor[of], supply)
        if np.abs(drawn - before).sum() <= TOLERANCE * budget:
            return drawn
    raise ValueError(f"raking has not settled in {ROUNDS} rounds")


def gaps(cells: Sequence[tuple[str, ...]], drawn: np.ndarray, targets: Sequence[Mapping[str, float]], budget: float) -> list[dict[str, float]]:
    """By dimension, how far each category's tokens miss its target, as a share of the target;
    of the budget where the target is zero."""
    found = []
    for d, wanted in enumerate(targets):
        have: dict[str, float] = {}
        for cell, n in zip(cells, drawn.tolist(), strict=True):
            have[cell[d]] = have.get(cell[d], 0.0) + n
        found.append({x: abs(n - wanted.get(x, 0.0) * budget) / max((wanted.get(x) or 1.0) * budget, 1e-300) for x, n in have.items()})
    return found


def fit(celled: DataFrame, plan: Plan) -> list[tuple[str, str, str, float, float]]:
    """(source, lang, topic, probability, gap) of each cell, from columns ``c_*`` and
    ``n_tokens``; the gap is the largest of the cell's three marginals."""
    keys = [f"c_{d}" for d in DIMENSIONS]
    rows = celled.groupBy(*keys).agg(F.sum("n_tokens").alias("n")).orderBy(*keys).collect()
    cells = [tuple(r[k] for k in keys) for r in rows]
    if not cells:
        return []
    supply = np.array([r["n"] or 0 for r in rows], float)
    targets = []
    for i, d in enumerate(DIMENSIONS):
        observed: dict[str, float] = {}
        for cell, n in zip(cells, supply.tolist(), strict=True):
            observed[cell[i]] = observed.get(cell[i], 0.0) + n
        targets.append(tempered(plan.targets[d], 1.0) if d in plan.targets else tempered(observed, plan.powers[d]))
    drawn = rake(cells, supply, targets, plan.share)
    missed = gaps(cells, drawn, targets, plan.share * float(supply.sum()))
    gap = [max(missed[i][x] for i, x in enumerate(c)) for c in cells]
    return [(*c, float(x / n) if n else plan.share, g) for c, x, n, g in zip(cells, drawn.tolist(), supply.tolist(), gap, strict=True)]


def uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":mix")))
    return (F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("double") + 0.5) / float(16**_HEX)


def _celled(docs: DataFrame, plan: Plan, model: topics.Model | str | None, id_col: str, text_col: str, carry: Sequence[Column]) -> DataFrame:
    """Tokens, cell and number of each row; texts are read here and nowhere else."""
    own = [plan.cell("source").alias("c_source"), plan.cell("lang").alias("c_lang"), uniform(F.col(id_col)).alias("__u"), *carry]
    if model is None:
        told = docs.select(tokens(F.col(text_col)).alias("n_tokens"), topic(F.col(text_col)).alias("topic"), *own)
    elif isinstance(model, str):
        _, told = topics.clusters(docs, model, plan.categories["lang"], own, id_col=id_col, text_col=text_col)
    else:
        told = topics.tell(docs, model, own, text_col)
    named = F.when(F.col("topic").isin(*plan.categories["topic"]), F.col("topic")).otherwise(REST)
    return scratch.written(told.withColumn("c_topic", named).drop("topic"))


def _drawn(celled: DataFrame, plan: Plan) -> DataFrame:
    text, number = pa.string(), pa.float64()
    # At most one row for each combination of listed categories: the plan bounds it.
    cells = table(celled.sparkSession, fit(celled, plan), c_source=text, c_lang=text, c_topic=text, probability=number, gap=number)
    weighed = celled.join(F.broadcast(cells), ["c_source", "c_lang", "c_topic"], "left")
    return weighed.withColumn("selected", F.col("__u") < F.col("probability")).drop("__u")


def weigh(docs: DataFrame, plan: Plan, model: topics.Model | str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, c_source, c_lang, c_topic, probability, gap, selected)`` for each row.

    With a model, tokens are its tokenizer's and topics its clusters; with a tokenizer's path in its
    place the clusters are learned from all these documents; without one they are words and
    :func:`topic`.  Documents need ``source`` and ``lang``; null and unlisted categories
    share one cell.  Texts without tokens follow their cell's probability.  Repeated ids are
    drawn alike where their cells are, null ids as one id; an empty table gives no rows.
    """
    return _drawn(_celled(docs, plan, model, id_col, text_col, [F.col(id_col).alias("id")]), plan)


def sample(docs: DataFrame, plan: Plan, model: topics.Model | str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn documents, with all their columns, as :func:`weigh` decides on each row."""
    keys = [F.col(id_col), F.col("source"), F.col("lang"), judged.text_key(text_col)]
    carry = [k.alias(f"__key{i}") for i, k in enumerate(keys)]
    told = _drawn(_celled(docs, plan, model, id_col, text_col, carry), plan)
    left = told.filter("not selected").select([f"__key{i}" for i in range(len(keys))])
    return judged.without(docs, left, keys)
