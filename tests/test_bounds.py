"""Queries whose work or memory must not grow faster than their input."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pyarrow as pa

from lodestone.operators import chunk, entities, graph, phrases, reports, search, similarity, vector
from lodestone.operators.packs import REFERENCE_MARKS, MarketingPack


def test_phrases_are_counted_where_they_can_be_frequent(spark):
    """Exact with ties and beyond the first bound, with few of all phrases counted."""
    stop = ("with", "from")
    texts = [f"Alpha beta gamma delta number{i}. Unlike{i} words{i} with from the end{i}! the fox{i % 7} with runs" for i in range(200)] + [None, "", "a. b", "one two"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = Counter()
    for t in texts:
        for s in (t or "").lower().replace("!", ".").split("."):
            w = [x for x in s.split() if len(x) >= 3]
            runs = [w[i : i + n] for n in range(3, 9) for i in range(len(w) - n + 1)]
            want.update(" ".join(p) for p in runs if any(len(x) > 3 and x not in stop for x in p))
    best = sorted(want.items(), key=lambda x: (-x[1], x[0]))
    for top, first in ((3, 4), (3, 1), (10, 2), (12, 4096), (len(best) + 1, 5)):
        assert [tuple(r) for r in phrases.top_phrases(df, stop, top=top, first=first).collect()] == best[:top]
    made = []
    counted = phrases.map_arrow
    try:
        phrases.map_arrow = lambda *a: made.append(counted(*a)) or made[-1]
        phrases.top_phrases(df, stop, top=3, first=4)
    finally:
        phrases.map_arrow = counted
    assert made[-1].count() < sum(want.values()) / 2


def test_top_k_holds_a_block_and_no_more():
    """The k best of a partition come once for each query, whatever its batches, with ties by id."""
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(600, 8)), 10, axis=0)  # ten copies of each
    x[5990:] = 0
    ids = r.permutation(len(x))
    vectors = [v.tolist() for v in x]
    vectors[3], vectors[17], vectors[40] = None, [1.0], [1.0] * 7 + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.list_(pa.float32()))], ["vec_id", "vec"])
    q = x[::20].astype(np.float32).astype(float)
    made = list(vector._scored(list(range(len(q))), q, 15, "cosine")(iter(batch.slice(i, 700) for i in range(0, len(x), 700))))
    got = pa.Table.from_batches(made).to_pylist()
    assert len(got) == 15 * len(q) and max(b.num_rows for b in made) <= 15 * 256
    kept = [i for i in range(len(x)) if i not in (3, 17, 40)]
    y, norm = x[kept].astype(np.float32).astype(float), lambda m: np.linalg.norm(m, axis=1)
    scores = np.divide(q @ y.T, size := np.outer(norm(q), norm(y)), out=np.zeros((len(q), len(y))), where=size > 0)
    best = np.lexsort((np.broadcast_to(ids[kept], scores.shape), -np.round(scores, 9)), axis=1)[:, :15]
    assert [g["vec_id"] for g in got] == ids[kept][best].ravel().tolist()
    assert np.allclose([g["similarity"] for g in got], np.take_along_axis(scores, best, 1).ravel())


def test_unique_sentences_by_brute_force(spark):
    """As by comparing all sentences, in one pass without a shuffle or a row for a pair of them."""
    r = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "ähre", "omega", "tau", "日本"]
    say = lambda: " ".join(r.choice(words, r.integers(1, 6)))
    rows = []
    for i in range(40):
        b = [say() for _ in range(r.integers(0, 9))]
        a = [s + r.choice(["", "x", " tau"]) if r.random() < 0.5 else say() for s in b + ["--", "Beta"]]
        rows.append((i, "! ".join(a), ". ".join(b)))
    df = spark.createDataFrame([*rows, (98, None, "a. b"), (99, "", None)], "pair_id bigint, text_a string, text_b string").repartition(3)
    norm = lambda s: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s.lower())).strip()
    cut = lambda t: [s.strip() for s in re.split("[.!?]+", t or "") if s.strip()]
    want = []
    for i, a, b in [*rows, (98, None, "a. b"), (99, "", None)]:
        for side, own, other in (("a", cut(a), cut(b)), ("b", cut(b), cut(a))):
            like = lambda x: any(x == y or (x and y and SequenceMatcher(None, x, y).ratio() > 0.8) for y in map(norm, other))  # noqa: B023, E731
            want += [(i, side, k, s) for k, s in enumerate(own) if not like(norm(s))][:5] if own else []
    got = similarity.unique_sentences(df)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want) and len(want) > 40
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan


def test_chunks_split_texts_once(spark):
    """A filter on an article's sentences would clean and split its text again; only what is asked for is made."""
    df = spark.createDataFrame([(1, "The first sentence is here. The second sentence is there. " * 4), (2, "..." * 60), (3, None)], "doc_id int, content string")
    plan = chunk.fixed_chunks(df, 10, 3, 5, headers=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    whole = chunk.fixed_chunks(df, 10, 3, 5, headers=False)
    some = chunk.fixed_chunks(df, 10, 3, 5, headers=False, columns=("text", "following_context", "chunk_id"))
    assert some.columns == ["article_id", "chunk_id", "text", "following_context"]
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.select(*some.columns).collect())) and some.count() > 3


def test_terms_are_found_where_words_lie(spark):
    """Mentions as by a join of all runs of words, without a row for each word."""
    r = random.Random(2)
    words = ["the", "Of", "of", "ÄHRE", "ähre", "rights", "reserved", "x_1", "ὈΔΥΣΣΕΎΣ"]
    rows = [(i, " ".join(r.choice(words) + r.choice(["", ".", " -"]) for _ in range(r.randint(0, 40)))) for i in range(60)] + [(98, None), (99, "")]
    df = spark.createDataFrame(rows, "chunk_id bigint, text string").repartition(3)
    terms = [("The", "A"), ("the", "B"), ("of the", "A"), ("ähre", "C"), ("rights reserved of", "D"), ("a b c d", "E"), ("ὈΔΥΣΣΕΎΣ", None), (None, "F"), ("", "G"), ("rights-reserved", "D")]
    lexicon = spark.createDataFrame(terms, "term string, label string")
    told = entities.lexicon_entities(df, lexicon)
    assert "Generate" not in told._jdf.queryExecution().optimizedPlan().toString()
    got, want = (sorted(map(str, x.select("id", "text", "label", "start", "end", "confidence").collect())) for x in (told, entities.lexicon_entities(df, lexicon, limit=0)))
    assert got == want and len(got) > 200
    assert entities.lexicon_entities(df, lexicon.limit(0)).count() == 0


def test_names_of_a_chunk_are_paired_without_a_join(spark):
    r = random.Random(6)
    rows = [(r.randint(0, 30), r.choice(["A", "a", " b", "c", "D", None])) for _ in range(300)] + [(None, "a"), (None, "b")]
    df = spark.createDataFrame(rows, "chunk_id int, text string")
    pairs, counted = Counter(), Counter()
    for c in {c for c, _ in rows if c is not None}:
        names = [t.lower() for k, t in rows if k == c and t is not None]
        pairs.update(combinations(sorted({t.strip() for t in names}), 2))
        n = Counter(names)
        counted.update({(x, y): n[x] * n[y] for x, y in combinations(sorted(n), 2)})
    edges = graph.cooccurrence(df, 2)
    assert {tuple(x) for x in edges.filter("e1 < e2").collect()} == {(*p, n) for p, n in pairs.items() if n > 1}
    assert {tuple(x) for x in graph.pair_counts(df).collect()} == {(*p, n) for p, n in counted.items()}
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan  # which would work out all mentions twice


def test_semantic_chunks_are_one_pass(spark):
    """Distances and chunks as by their definition; no lambda holds a limit, which it would work out for each sentence."""
    r = random.Random(8)
    words = ["Cats", "chase", "mice", "Engines", "burn", "fuel", "ähre", "the", "of"]
    rows = [(i, " ".join(" ".join(r.choice(words) for _ in range(r.randint(1, 9))).capitalize() + r.choice(".!") for _ in range(r.randint(0, 30)))) for i in range(50)] + [(98, None), (99, " two  words ")]
    df = spark.createDataFrame(rows, "doc_id bigint, content string").repartition(3)
    for buffer in (1, 2):
        plain = {x["article_id"]: x for x in chunk.sentence_distances(df, buffer, embed=lambda s: chunk.hashed_vector(s)).collect()}
        told = {x["article_id"]: x for x in chunk.sentence_distances(df, buffer).collect()}
        assert told.keys() == plain.keys()
        for i, x in plain.items():
            assert told[i]["sents"] == x["sents"] and np.allclose(told[i]["distances"], x["distances"], atol=1e-12)
        for keep in (True, False):
            want = []
            for i, x in told.items():
                sents, away = x["sents"], x["distances"]
                texts = [dict(rows)[i] or ""]
                if away:
                    limit = np.percentile(away, 70)
                    starts = [0, *(k + buffer for k, d in enumerate(away) if d > limit)]
                    groups = [sents[s:e] for s, e in zip(starts, [*starts[1:], len(sents)])]
                    texts, now = [], []
                    for g in groups:
                        if now and len(" ".join(now + g).split()) > 20:
                            texts, now = [*texts, " ".join(now)], []
                        now = now + g
                    texts = [t for t in [*texts, " ".join(now)] if keep or len(t.split()) >= 8]
                want += [(i, k, t, len(t.split())) for k, t in enumerate(texts)]
            got = chunk.semantic_chunks(df, 8, 20, amount=70.0, buffer=buffer, keep_small=keep)
            assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 60
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and plan.count("array_sort(") + plan.count("sort_array(") <= 4


def test_noise_of_a_text_is_worked_out_once(spark):
    df = spark.createDataFrame([(f"The clown sells. Clown the the the {i % 3} the license" + " with the" * (i % 4),) for i in range(30)] + [(None,)], "content string")
    pack = MarketingPack(marketing=("clown", "with the"), navigation=("from",), meta=("license",), self_references=(r"\bthe\b",), function_words=())
    want = Counter()
    for r in df.collect():
        low = (r["content"] or "").lower()
        found = [("marketing", "clown", low.count("clown"), 0), ("marketing", "with the", low.count("with the"), 0), ("navigation", "from", low.count("from"), 0)]
        found += [("meta", "license", low.count("license"), 0), ("self_reference", r"\bthe\b", len(re.findall(r"\bthe\b", low)), 3)]
        want.update((kind, p, n) for kind, p, n, least in found if n > least)
    got = reports.top_noise(df, pack)
    assert [tuple(r) for r in got.collect()] == [(*k, n) for k, n in sorted(want.items(), key=lambda x: (-x[1], x[0]))][:20]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 2 + len(REFERENCE_MARKS)


def test_texts_are_ranked_where_they_lie(spark):
    """As by an index, with rows of one id as one text, and without rows for postings."""
    r = random.Random(4)
    words = ["red", "Fish", "blue", "bird", "ähre", "x", "the"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, say(r.randint(0, 9))) for i in range(80)] + [(97, None), (98, "")]
    asked = [(q, say(r.randint(0, 4))) for q in range(12)] + [(50, "nothing"), (51, None)]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    for more in ([], [(5, "red red fish"), (5, "bird"), (7, "ähre")]):
        df = spark.createDataFrame(rows + more, "chunk_id bigint, text string").repartition(3)
        want = search.look_up(search.inverted_index(df), queries, 80, 4)
        got = search.find(df, queries, 80, 4)
        assert got.columns == want.columns
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
        tidy = lambda x: sorted((r["query_id"], r["id"], round(r["score"], 8), r["rank"]) for r in x.collect())
        assert tidy(got) == tidy(want) and len(tidy(got)) > 30
    assert tidy(search.find(df, queries, 80, 4, limit=1)) == tidy(want)
    assert search.find(df, queries.limit(0), 80).count() == search.find(df.limit(0), queries, 0).count() == 0
