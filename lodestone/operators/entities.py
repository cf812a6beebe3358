"""Entity mentions: lexicon and pattern matches, overlaps, filters, names and merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import strip
from lodestone.operators import packs
from lodestone.plans.arrow import map_arrow
from lodestone.plans.size import SMALL_ROWS, small


#: Texts looked at once.
_TEXTS = 1024


def _trie(terms: Sequence[tuple[str, str]], longest: int) -> tuple:
    """Terms (words with spaces between them, label) as numbers of words, sorted steps from a
    node by a word with the nodes they lead to, and the labels that end at each node."""
    words, steps, ends = {}, {}, {}
    for term, label in terms:
        run = term.split(" ")
        if len(run) > longest or not term:
            continue
        node = 0
        for w in run:
            node = steps.setdefault((node, words.setdefault(w, len(words) + 1)), len(steps) + 1)
        ends.setdefault(node, []).append(label)
    width = len(words) + 1
    keys = np.array([n * width + w for n, w in steps] or [-1], np.int64)
    order = np.argsort(keys)
    labels = [ends.get(n, []) for n in range(len(steps) + 1)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in labels])])
    return words, keys[order], np.array([*steps.values()] or [0])[order], bounds, [x for each in labels for x in each]


def _matched(trie: tuple, longest: int) -> Callable:
    """Rows (id, words) as rows (id, text, label, start, end) of the terms among the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, keys, nodes, bounds, labels = trie
        width, labels = len(words) + 1, pa.array(labels, pa.string())
        for part in (b.slice(i, _TEXTS) for b in batches for i in range(0, b.num_rows, _TEXTS)):
            flat, sizes = part.column(1).flatten(), pc.list_value_length(part.column(1)).to_numpy()
            told = flat.dictionary_encode()
            number = np.array([words.get(w.lower(), 0) for w in told.dictionary.to_pylist()], np.int64)
            number = number[told.indices.to_numpy()] if len(flat) else number
            row = np.repeat(np.arange(len(sizes)), sizes)
            first = np.cumsum(sizes) - sizes
            at = np.flatnonzero(number)
            node = np.zeros(len(at), np.int64)
            for depth in range(longest):
                fits = at + depth < len(flat)
                fits[fits] &= row[at[fits] + depth] == row[at[fits]]
                at, node = at[fits], node[fits]
                step = node * width + number[at + depth]
                place = np.minimum(np.searchsorted(keys, step), len(keys) - 1)
                fits = (keys[place] == step) & (number[at + depth] > 0)
                at, node = at[fits], nodes[place[fits]]
                many = bounds[node + 1] - bounds[node]
                found = np.repeat(at, many)
                if not len(found):
                    continue
                label = np.repeat(bounds[node] - np.cumsum(many) + many, many) + np.arange(len(found))
                text = pc.binary_join_element_wise(*(flat.take(pa.array(found + j)) for j in range(depth + 1)), " ")
                start = found - first[row[found]]
                columns = [part.column(0).take(pa.array(row[found])), text, labels.take(pa.array(label)), pa.array(start, pa.int32()), pa.array(start + depth + 1, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "text", "label", "start", "end"])

    return run


def lexicon_entities(texts: DataFrame, lexicon: DataFrame, longest: int = 3, id_col: str = "chunk_id", text_col: str = "text", limit: int = SMALL_ROWS) -> DataFrame:
    """``(id, text, label, start, end, confidence)``: runs of words that are lexicon terms,
    whatever their case; ``start`` and ``end`` are word numbers, half open.

    ``lexicon`` has ``term`` and ``label``; terms are compared word by word.  One of at most
    ``limit`` terms is sent to all tasks, which look words up where they lie, so only mentions
    become rows.  With a larger one each word comes with the few after it; those that start a
    term are found by a join on the word, and only their runs are compared with terms.
    """
    split = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))
    each = texts.select(F.col(id_col).alias("id"), split(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    terms = lexicon.select(F.array_join(split(F.lower("term")), " ").alias("term"), "label").filter("term is not null").distinct()
    told = terms.limit(limit + 1).collect()
    if len(told) <= limit:
        kind = texts.schema[id_col].dataType.simpleString()
        trie = _trie(sorted((tuple(r) for r in told), key=str), longest)
        return map_arrow(each, _matched(trie, longest), f"id {kind}, text string, label string, start int, end int").withColumn("confidence", F.lit(1.0))
    at = F.transform("w", lambda x, i: F.struct(i.alias("start"), F.slice("w", i + 1, F.lit(longest)).alias("run")))
    words = each.select("id", F.explode_outer(at).alias("x")).filter("x is not null").select("id", "x.*")
    starts = terms.select(F.substring_index("term", " ", 1).alias("first")).distinct()
    words = words.withColumn("first", F.lower(F.get("run", F.lit(0)))).join(small(starts, limit), "first", "left_semi")
    ends = F.transform(F.sequence(F.lit(1), F.size("run")), lambda n: F.struct((F.col("start") + n).alias("end"), F.array_join(F.slice("run", F.lit(1), n), " ").alias("text")))
    runs = words.select("id", "start", F.explode_outer(ends).alias("g")).select("id", "start", "g.*").withColumn("term", F.lower("text"))
    return runs.join(small(terms, limit), "term").select("id", "text", "label", "start", "end", F.lit(1.0).alias("confidence"))


def _recognized(load: Callable[[], Callable[[list[str]], list[tuple[int, int, str]]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recognize = load()
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
        for batch in (b.slice(i, _TEXTS) for b in batches for i in range(0, b.num_rows, _TEXTS)):
            at, rows = [], []
            for i, words in enumerate(batch.column(1).to_pylist()):
                for start, end, label in recognize(words):
                    at.append(i)
                    rows.append((" ".join(words[start:end]), f"SPACY_{label}", start, end))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "text", "label", "start", "end"])

    return run


def statistical_entities(texts: DataFrame, load: Callable, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``(id, text, label, start, end, confidence)`` by a model: ``load`` returns it once for each
    partition, a function of a text's words that gives (start, end, label) by word number.

    Labels are prefixed and mentions less sure than rule-based ones; null texts have none.
    """
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"(?U)\w+"), F.lit(0))
    kind = texts.schema[id_col].dataType.simpleString()
    each = texts.select(F.col(id_col).alias("id"), words.alias("words"))
    return map_arrow(each, _recognized(load), f"id {kind}, text string, label string, start int, end int").withColumn("confidence", F.lit(0.7))


def regex_entities(texts: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``(id, text, label, confidence)``: chemical formulas and measurements by pattern."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    formulas = F.filter(F.regexp_extract_all(body, F.lit("(?U)" + packs.FORMULA), F.lit(0)), lambda x: (F.length(x) > 1) & ~F.lower(x).isin(*packs.FORMULA_STOP))
    measured = F.concat(*(F.regexp_extract_all(body, F.lit("(?Ui)" + p), F.lit(0)) for p in packs.MEASUREMENTS))
    tag = lambda items, label, sure: F.transform(items, lambda x: F.struct(x.alias("text"), F.lit(label).alias("label"), F.lit(sure).alias("confidence")))
    found = F.concat(tag(formulas, "CHEMICAL_FORMULA", 0.8), tag(measured, "MEASUREMENT", 0.9))
    return texts.select(F.col(id_col).alias("id"), F.explode_outer(found).alias("e")).filter("e is not null").select("id", "e.*")


def without_overlaps(mentions: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Mentions not overlapped by a longer one of the same text; of equally long ones the first
    start and then the least label stays.

    ``extra`` columns, such as the part of a chunk that offsets count from, keep apart what must
    not overlap.  Mentions are sorted by start and resolved within each run of overlapping ones,
    which is short however long the text.
    """
    key = ["id", *extra]
    fields = [c for c in mentions.columns if c not in key]
    by = ", ".join(f"`{c}`" for c in key)
    before = F.expr(f"max(`end`) over (partition by {by} order by start, `end` rows between unbounded preceding and 1 preceding)")
    numbered = mentions.withColumn("__new", (before.isNull() | (F.col("start") >= before)).cast("int"))
    numbered = numbered.withColumn("__run", F.expr(f"sum(__new) over (partition by {by} order by start, `end` rows unbounded preceding)"))
    order = F.struct((F.col("start") - F.col("end")).alias("a"), F.col("start").alias("b"), F.col("label").alias("c"), F.struct(*fields).alias("m"))
    grouped = numbered.groupBy(*key, "__run").agg(F.array_sort(F.collect_list(order)).alias("all"))
    empty = F.slice("all", 1, 0)
    clear = lambda kept, x: ~F.exists(kept, lambda k: (x["m"]["start"] < k["m"]["end"]) & (x["m"]["end"] > k["m"]["start"]))
    kept = F.aggregate("all", empty, lambda acc, x: F.when(clear(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return grouped.select(*key, F.explode_outer(kept).alias("x")).select(*key, "x.m.*")


def ner_antijoin(statistical: DataFrame, rules: DataFrame) -> DataFrame:
    """Statistical mentions whose start or end lies in no rule-based mention of the same text."""
    s, r = statistical.alias("s"), rules.alias("r")
    inside = ((F.col("r.start") <= F.col("s.start")) & (F.col("s.start") < F.col("r.end"))) | ((F.col("r.start") < F.col("s.end")) & (F.col("s.end") <= F.col("r.end")))
    return s.join(r, (F.col("s.id") == F.col("r.id")) & inside, "left_anti")


def context_entities(own: DataFrame, context: DataFrame) -> DataFrame:
    """A chunk's own mentions and those of its contexts whose text it does not have, once each
    time they are met."""
    names = own.select("id", F.lower("text").alias("__low")).distinct()
    new = context.withColumn("__low", F.lower("text")).join(names, ["id", "__low"], "left_anti").drop("__low")
    return own.unionByName(new)


def is_common(text: Column, common: Sequence[str] = packs.COMMON_WORDS) -> Column:
    return strip(F.lower(text)).isin(*common)


def is_low_quality(text: Column, label: Column, confidence: Column) -> Column:
    """Short but no known abbreviation, only digits or punctuation, unsure, or too generic."""
    name = strip(text)
    upper = [a for a in packs.ABBREVIATIONS if a == a.upper()]
    return (
        ((F.length(name) <= 2) & ~F.upper(name).isin(*upper))
        | name.rlike(r"(?U)^\d+$")
        | name.rlike(r"(?U)^[^\w\s]+$")
        | (F.coalesce(confidence, F.lit(1.0)) < 0.3)
        | ((label == "MEASUREMENT_UNIT") & F.lower(name).isin(*packs.GENERIC_UNITS))
        | ((label == "CHEMICAL_FORMULA") & (F.length(name) <= 3) & F.lower(name).isin(*packs.GENERIC_FORMULAS))
    )


def entity_filter(mentions: DataFrame, common: Sequence[str] = packs.COMMON_WORDS) -> DataFrame:
    """Mentions worth a node: none by a statistical model, no two-letter formula, no common
    word, nothing of low quality.  Rows with a null text or label are left out."""
    text, label = F.col("text"), F.col("label")
    poor = (
        label.startswith("SPACY_")
        | ((label == "CHEMICAL_FORMULA") & (F.length(text) <= 2))
        | is_common(text, common)
        | is_low_quality(text, label, F.col("confidence"))
    )
    return mentions.filter(text.isNotNull() & label.isNotNull() & ~poor)


def entity_name(text: Column, forms: Sequence[tuple[str, str]] = packs.NAME_FORMS, leading: Sequence[str] = packs.LEADING_WORDS) -> Column:
    """The name that stands for a mention: lower case, white space squeezed, one leading function
    word dropped, inflected forms mapped."""
    low = F.regexp_replace(strip(F.lower(text)), r"(?U)\s+", " ")
    bare = F.regexp_replace(low, rf"(?U)^(?:{'|'.join(leading)})\s+", "")
    table = F.create_map(*(F.lit(x) for pair in forms for x in pair)) if forms else None
    return F.coalesce(F.try_element_at(table, bare), bare) if forms else bare


def entity_merge(mentions: DataFrame, forms: Sequence[tuple[str, str]] = packs.NAME_FORMS, preferred: Sequence[tuple[str, Sequence[str]]] = packs.PREFERRED_FORMS) -> DataFrame:
    """``(normalized_name, name, label, mention_count, confidence, variants)``: one row for each
    name, represented by its best form.

    Forms score by preference, how often they occur, confidence and capitals; ties fall to the
    least text and label.  Mentions are counted by form first, so a name with very many
    mentions is a few rows when its forms meet.
    """
    name = entity_name(F.col("text"), forms)
    by_form = mentions.groupBy(name.alias("normalized_name"), "text", "label", "confidence").agg(F.count("*").alias("n"))
    texts = by_form.groupBy("normalized_name", "text").agg(F.sum("n").alias("times"))
    counted = by_form.join(texts, ["normalized_name", "text"])
    liked = F.lit(0)
    for of, ranked in preferred:
        for place, form in enumerate(ranked):
            liked = F.when((F.col("normalized_name") == of) & (F.col("text") == form), 1000 - place).otherwise(liked)
    text = F.col("text")
    shouted = (F.upper(text) == text) & (F.lower(text) != text) & (F.length(text) <= 5)
    proper = (F.upper(F.substring(text, 1, 1)) == F.substring(text, 1, 1)) & (F.lower(F.substring(text, 1, 1)) != F.substring(text, 1, 1)) & (F.lower(F.substring(text, 2, 10**6)) == F.substring(text, 2, 10**6)) & (F.length(text) > 1)
    score = liked + F.col("times") * 10 + F.coalesce("confidence", F.lit(1.0)) * 5 + F.when(shouted, 50).when(proper, 20).otherwise(0)
    ranked = counted.withColumn("__order", F.struct((-score).alias("a"), text.alias("b"), F.col("label").alias("c")))
    return ranked.groupBy("normalized_name").agg(
        F.min_by("text", "__order").alias("name"),
        F.min_by("label", "__order").alias("label"),
        F.sum("n").alias("mention_count"),
        (F.sum(F.coalesce("confidence", F.lit(1.0)) * F.col("n")) / F.sum("n")).alias("confidence"),
        F.array_sort(F.collect_set("text")).alias("variants"),
    )


def entity_stats(mentions: DataFrame) -> DataFrame:
    return mentions.agg(
        F.count("*").alias("total_entities"),
        F.count_distinct(F.lower("text")).alias("unique_entities"),
        F.count_distinct("label").alias("entity_types"),
        F.avg("confidence").alias("avg_confidence"),
    )


def type_stats(mentions: DataFrame, top: int = 10) -> DataFrame:
    """Each type's mentions, different names and most frequent names."""
    names = mentions.groupBy("label", F.lower("text").alias("name")).agg(F.count("*").alias("n"))
    place = F.expr("row_number() over (partition by label order by n desc, name)")
    best = names.withColumn("__place", place).filter(F.col("__place") <= top).groupBy("label")
    best = best.agg(F.transform(F.array_sort(F.collect_list(F.struct("__place", "name"))), lambda x: x["name"]).alias("top_names"))
    sums = names.groupBy("label").agg(F.sum("n").alias("mentions"), F.count("*").alias("unique_names"))
    return sums.join(best, "label")


def kept_types(mentions: DataFrame, more_names: int = 5, more_mentions: int = 50) -> DataFrame:
    """``(label, mentions, unique_names)`` of the types with enough of both to be node types."""
    names = mentions.groupBy("label", F.lower("text").alias("name")).agg(F.count("*").alias("n"))
    sums = names.groupBy("label").agg(F.sum("n").alias("mentions"), F.count("*").alias("unique_names"))
    return sums.filter((F.col("unique_names") > more_names) & (F.col("mentions") > more_mentions))


def stems(query: Column, table: Sequence[tuple[str, str]] = packs.QUERY_STEMS) -> Column:
    """Entities that the inflected words of a query ask for; letters only, in order."""
    found = F.create_map(*(F.lit(x) for pair in table for x in pair))
    tokens = F.transform(F.split(F.lower(F.coalesce(query, F.lit(""))), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"(?U)[^\p{L}]", ""))
    return F.array_compact(F.transform(tokens, lambda w: F.try_element_at(found, w)))


def query_entities(queries: DataFrame, lexicon: DataFrame, table: Sequence[tuple[str, str]] = packs.QUERY_STEMS, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """``(id, entity)``: the distinct entities of a query, longer than two characters."""
    matched = lexicon_entities(queries, lexicon, id_col=id_col, text_col=text_col)
    matched = matched.filter(~F.col("label").startswith("SPACY_") & (F.col("label") != "CHEMICAL_FORMULA"))
    stemmed = queries.select(F.col(id_col).alias("id"), F.explode(stems(F.col(text_col), table)).alias("entity"))
    both = matched.select("id", strip(F.lower("text")).alias("entity")).unionByName(stemmed)
    return both.filter(F.length("entity") > 2).distinct()
