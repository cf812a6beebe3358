"""Text functions as built-in expressions.  White space, letters and word characters are
Unicode's, as the rules they serve expect, hence ``(?U)`` before every pattern."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often a lambda inside refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: Column | str) -> Column:
    """A column with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """The parts between white space; an array, empty for empty and null texts."""
    return F.filter(F.split(text_of(text), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def distinct_count(items: Column) -> Column:
    return F.size(F.array_distinct(items))


def count_of(text: Column, needle: str) -> Column:
    """How often a string occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def total(parts: Iterable[Column]) -> Column:
    """The sum of columns; zero of none."""
    out = F.lit(0)
    for part in parts:
        out = out + part
    return out


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, needles)), lambda n: F.contains(text, n)) if needles else F.lit(False)


def count_present(text: Column, needles: Sequence[str]) -> Column:
    """How many of the strings occur at all."""
    return total(F.contains(text, F.lit(n)).cast("int") for n in needles)


def replaced(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Regular-expression replacements, one after the other."""
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def pieces(text: Column) -> Column:
    """What lies between runs of ``.``, ``!`` and ``?``, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text_of(text), r"[.!?]+"), strip), lambda s: s != "")


def clean_text(text: Column) -> Column:
    """One space for white space, runs of dots and dashes shortened, spaces set right around
    punctuation and after a sentence's end."""
    upper = "A-ZÁÄČĎÉÍĹĽŇÓÔŔŠŤÚÝŽ"
    rules = [
        (SPACE, " "),
        (r"\.{3,}", "..."),
        (r"-{2,}", "--"),
        (r"(?U)\s+([.,;:!?])", "$1"),
        (rf"(?U)([.!?])\s*([{upper}])", "$1 $2"),
    ]
    return strip(replaced(text_of(text), rules))


def sentences(text: Column) -> Column:
    """The parts of a cleaned text between sentence ends that are longer than ten characters;
    the ends are left out."""
    parts = F.transform(F.split(text_of(text), r"(?U)[.!?]+(?:\s|$)"), strip)
    return F.filter(parts, lambda s: F.length(s) > 10)


def semantic_sentences(text: Column) -> Column:
    """Sentences that end before a capital or a digit; a text without such an end splits after
    each full stop and space.  Those of ten characters or less are left out."""
    flat = strip(F.regexp_replace(text_of(text), SPACE, " "))
    starts = "A-ZÁÄČĎÉÍĹĽŇÓÔŔŠŤÚÝŽ0-9"
    fine = F.split(flat, rf"(?U)[.!?]+\s+(?=[{starts}])")
    plain = F.split(flat, r"(?<=\.) ")
    parts = F.when(F.size(fine) > 1, fine).otherwise(plain)
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 10)


def section_headers(text: Column) -> Column:
    """The first five lines that look like a heading: short, and in capitals, ending in their
    only colon, starting with ``#`` or of at most eight words."""

    def heading(line: Column) -> Column:
        shouted = (F.upper(line) == line) & (F.lower(line) != line)
        colon = F.endswith(line, F.lit(":")) & (F.instr(line, ":") == F.length(line))
        return (
            (F.length(line) > 0)
            & (F.length(line) < 100)
            & (shouted | colon | F.startswith(line, F.lit("#")) | (word_count(line) <= 8))
        )

    return F.slice(F.filter(F.transform(F.split(text_of(text), "\n"), strip), heading), 1, 5)


def normalized(text: Column) -> Column:
    """Lower case, anything but word characters and white space a space, white space squeezed."""
    return strip(replaced(F.lower(text_of(text)), [(r"(?U)[^\w\s]", " "), (SPACE, " ")]))


def pdf_clean(text: Column) -> Column:
    """White space squeezed, other characters than words and common punctuation a space, and
    digits at the end, such as page numbers, removed."""
    rules = [(SPACE, " "), (r"(?U)[^\w\s\-.,;:!?()\[\]{}/\\\"']", " "), (r"(?U)(?m)\b\d+\s*$", "")]
    return strip(replaced(text_of(text), rules))


def text_stats(text: Column) -> Column:
    """A struct of counts of characters, words, sentences and lines, and mean lengths."""
    body, parts = text_of(text), pieces(text)
    w = words(body)
    letters = F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x))
    lines = F.filter(F.split(body, "\n"), lambda s: strip(s) != "")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))

    return F.struct(
        F.length(body).alias("char_count"),
        F.size(w).alias("word_count"),
        F.size(parts).alias("sentence_count"),
        F.size(lines).alias("paragraph_count"),
        ratio(letters, F.size(w)).alias("avg_word_length"),
        ratio(F.size(w), F.size(parts)).alias("avg_sentence_length"),
    )


def embedding_text(title: Column, before: Column, body: Column, after: Column) -> Column:
    """A passage with its title and the beginnings of its contexts, if those are long enough."""

    def context(label: str, text: Column) -> Column:
        flat = strip(text_of(text))
        return F.when(F.length(flat) > 20, F.concat(F.lit(label), F.substring(flat, 1, 150)))

    parts = [
        F.when(text_of(title) != "", F.concat(F.lit("Title: "), title)),
        context("Context before: ", before),
        F.concat(F.lit("Content: "), text_of(body)),
        context("Context after: ", after),
    ]
    return F.concat(F.lit("passage: "), F.concat_ws(" | ", *parts))


def query_text(text: Column) -> Column:
    """A question as the embedding model wants it."""
    return F.concat(F.lit("query: "), strip(text_of(text)))


def quoted(needle: str) -> str:
    """A literal as a regular expression."""
    return re.sub(r"([.\\+*?^$()\[\]{}|])", r"\\\1", needle)


def safe_filename(title: Column) -> Column:
    """Letters, digits, spaces, dashes and underscores of a title, spaces as underscores, at
    most fifty characters."""
    kept = strip(F.regexp_replace(text_of(title), r"(?U)[^\p{L}\p{N} _-]", ""))
    return F.substring(F.replace(kept, F.lit(" "), F.lit("_")), 1, 50)


def sentence_words(text: Column) -> Column:
    """The lower-cased words of three letters or more of each sentence."""
    long_words = lambda sentence: F.regexp_extract_all(sentence, F.lit(r"(?U)\b\w{3,}\b"), F.lit(0))
    return F.transform(F.split(F.lower(text_of(text)), r"[.!?]+"), long_words)


def phrases(text: Column, stop: Sequence[str], shortest: int = 3, longest: int = 8) -> Column:
    """All runs of three to eight longer words of a sentence with at least one word of four
    letters or more that is no function word."""

    def meaningful(phrase: Column) -> Column:
        return F.exists(phrase, lambda w: (F.length(w) > 3) & ~w.isin(*stop))

    def cut(w: Column, n: int) -> Callable[[Column], Column]:
        return lambda i: F.slice(w, i, F.lit(n))

    def grams(w: Column) -> Column:
        runs = []
        for n in range(shortest, longest + 1):
            starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
            runs.append(F.transform(starts, cut(w, n)))
        return F.filter(F.concat(*runs), meaningful)

    found = F.flatten(F.transform(sentence_words(text), grams))
    return F.transform(found, lambda p: F.array_join(p, " "))
