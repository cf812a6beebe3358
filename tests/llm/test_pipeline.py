"""The stages of the pipeline against brute force, on odd rows and on none."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import packing, quality, queries, tokens, topics

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, node int, kept boolean, __id int, component int"
LINE = "this very line stands in many documents of the corpus"


def _prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def _rows():
    r = random.Random(12)
    texts = [_prose(r, r.choice([30, 60, 200])) for _ in range(120)]
    texts += [t + " and more" for t in texts[:20]] + texts[:10]
    texts = [f"{t}\n{LINE}" if i % 4 == 0 else t for i, t in enumerate(texts)]
    rows = [(i, t, ["en", "fr", None, "xx"][i % 4], ["src0", None, "other"][i % 3], len(t)) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "xx", "src0", 1), (3, _prose(r, 50), "en", "src1", 1), (None, texts[5], "en", "src0", 1), (None, _prose(r, 40), None, None, None)]
    rows += [(900, None, "en", "src0", None), (901, "", "en", "src0", 0), (902, _prose(r, 30_000), "de", "src2", 0)]
    return [(*row, "x", 7, True, 1, 2) for row in rows]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(_rows(), SCHEMA).repartition(3)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(130)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs


def _kept(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_quality_keeps_what_brute_force_keeps(spark, tables):
    path, docs = tables
    want = Counter()
    for row in _rows():  # too few labels for a cutoff: the base rule alone
        n, *_, repeats = quality.text_counts(row[1])[:5]
        if n >= 20 and 100 * repeats <= 30 * n:
            want[row[:2]] += 1
    out = STAGES["quality"](spark, docs, path)
    assert out.columns == docs.columns and _kept(out) == want


def test_lines_go_as_in_brute_force(spark, tables):
    path, docs = tables
    rows = _rows()
    holders = {}
    for doc, text, *_ in rows:
        for x in (text or "").split("\n"):
            key = x.strip(" \t\n\x0b\x0c\r").lower()
            if doc is not None and len(key) >= 20:
                holders.setdefault(key, set()).add(doc)
    lost = {}  # by document, the numbers of its lines that go
    for doc, text, *_ in rows:
        for n, x in enumerate((text or "").split("\n")):
            held = holders.get(x.strip(" \t\n\x0b\x0c\r").lower(), ())
            if doc is not None and len(held) >= 3 and doc != max(held):
                lost.setdefault(doc, set()).add(n)
    want = Counter((d, t and "\n".join(x for n, x in enumerate(t.split("\n")) if n not in lost.get(d, ()))) for d, t, *_ in rows)
    out = STAGES["line_dedup"](spark, docs, path)
    assert out.columns == docs.columns and _kept(out) == want
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)


def test_one_of_each_group_stays(spark, tables):
    path, docs = tables
    rows = _rows()

    def grams(text):
        words = (text or "").encode().lower().split()
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])

    sets = [grams(r[1]) for r in rows]
    label = list(range(len(rows)))
    near = [[j for j, y in enumerate(sets) if x == y or 5 * len(x & y) >= 4 * len(x | y) > 0] for x in sets]
    while (new := [min(label[j] for j in js) for js in near]) != label:
        label = new
    least = {}
    for group, row in zip(label, rows, strict=True):
        if row[0] is not None:
            least[group] = min(least.get(group, row[0]), row[0])
    stays = {row[0] for group, row in zip(label, rows, strict=True) if row[0] is not None and row[0] == least[group]}
    want = Counter(r[:2] for r in rows if r[0] is None or r[0] in stays)
    out = STAGES["simhash"](spark, docs, path)
    assert out.columns == docs.columns and _kept(out) == want


def test_mixing_and_packing_of_odd_rows(spark, tables):
    path, docs = tables
    mixed = STAGES["mixing"](spark, docs, path)
    assert mixed.columns == docs.columns and 0 < mixed.count() < docs.count() and not _kept(mixed) - _kept(docs)
    pieces = STAGES["packing"](spark, docs, path).collect()
    lengths = Counter()
    for p in pieces:
        lengths[p["doc_id"]] += p["length"]
    assert set(lengths) == {r[0] for r in _rows()} and lengths[900] == lengths[901] == 1 and lengths[902] > 30_000


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_of_nothing(spark, tables, name):
    path, docs = tables
    assert STAGES[name](spark, docs.limit(0), path).count() == 0


def test_packer_takes_the_best_unused_neighbour():
    r = np.random.default_rng(4)
    docs = [r.integers(0, 60, r.integers(5, 40)).astype(np.uint16) for _ in range(50)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=60)
    idf = np.log1p((50 - df + 0.5) / (df + 0.5))
    mean = float(np.mean([len(d) for d in docs]))
    placed = []
    packer = packing.Packer(64, idf, mean, lambda doc, start, length, sequence, offset: placed.append((doc, start, length, sequence, offset)))
    packer.shard(docs)

    def score(q, d):
        tf = Counter(docs[d].tolist())
        return sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) for t in set(docs[q].tolist()) if t in tf)

    unused, want, at, rest = set(range(50)), [], [0, 0], None  # at: sequence and offset

    def put(doc, start):
        length = min(len(docs[doc]) - start, 64 - at[1])
        want.append((doc, start, length, *at))
        at[1] += length
        if full := at[1] == 64:
            at[:] = [at[0] + 1, 0]
        return start + length, full

    while unused or rest:
        seed, start = rest or (min(unused), 0)
        unused.discard(seed)
        rest, full = None, False
        while start < len(docs[seed]):
            start, full = put(seed, start)
        if full:
            continue
        for d in sorted(unused, key=lambda d: (-round(score(seed, d), 4), d)):
            if score(seed, d) == 0:
                break
            unused.discard(d)
            stop, full = put(d, 0)
            if full:
                rest = (d, stop) if stop < len(docs[d]) else None
                break
    assert placed == want


def test_topics_split_what_differs():
    r = np.random.default_rng(1)
    kinds = [np.arange(0, 300), np.arange(300, 600), np.arange(600, 900)]
    made = [(i % 3, ["en", None][i % 2], r.choice(kinds[i % 3], 80)) for i in range(120)]
    model = topics.learn([(lang, *topics._counts(ids)) for _, lang, ids in made], "", 3)
    found = {(kind, model.number(ids, lang)) for kind, lang, ids in made}
    assert len(found) == 3 and len({t for _, t in found}) == 3
    assert model.number(np.zeros(0, int)) is None and topics.learn([], "").number(made[0][2]) is None


def test_topics_are_learned_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(topics, "SAMPLE_DOCS", 3)  # a sample would not meet each subject
    r = np.random.default_rng(6)
    kinds = [[f"{c}{d}" for c in "bcdfg" for d in x] for x in ("aei", "ouy", "hjk", "lmn")]
    rows = [(i, " ".join(r.choice(kinds[i % 4], 60)), ["en", "xx", None][i % 3], i % 4) for i in range(200)]
    rows += [(None, rows[1][1], "en", 1), (3, rows[3][1], None, 3), (900, None, "en", 9), (901, "", None, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kind int")
    models = []
    for parts in (1, 7):
        model, told = topics.clusters(df.repartition(parts), queries.tokenizer(), ["en", "fr"], [F.col("kind").alias("of"), F.col("text")], 4)
        got = told.collect()
        assert len(got) == len(rows)
        found = {(x["of"], x["topic"]) for x in got}
        assert (9, None) in found and len(found) == 5 and {t for _, t in found} == {None, *topics.names(4)}
        encoder = tokens.encoder(queries.tokenizer())
        assert all(x["topic"] is None or x["n_tokens"] == len(encoder.encode(x["text"])) for x in got)
        models.append(model)
    # One model whatever the partitions, of the frequencies of all texts.
    assert (models[0].centres == models[1].centres).all() and set(models[0].offsets) == {"en", "fr", None}
    seen = np.zeros(1 << topics.BITS)
    for _, text, *_ in rows[:202]:
        seen[topics._counts(encoder.encode(text))[0]] += 1
    assert np.allclose(models[0].idf, np.log(203 / (1 + seen)))
    # Every document is at its nearest centre, and centres are the directions of their documents.
    values = np.zeros((202, 1 << topics.BITS))
    for row, (_, text, *_) in zip(values, rows, strict=False):
        at, counts = topics._counts(encoder.encode(text))
        row[at] = models[0].values(at, counts)
    english = np.array([x[2] == "en" for x in rows[:202]])
    for same in (english, ~english):
        values[same] -= values[same].mean(axis=0)
    values /= np.linalg.norm(values, axis=1, keepdims=True)
    of = (values @ models[0].centres).argmax(axis=1)
    for j in range(4):
        centre = values[of == j].sum(axis=0)
        assert np.allclose(centre / np.linalg.norm(centre), models[0].centres[:, j], atol=1e-4)
    few, told = topics.clusters(df.limit(0), queries.tokenizer(), ["en"], [F.col("doc_id")])
    assert told.count() == 0 and few.centres.shape[1] == 0


def test_mixing_learns_topics_from_all_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topics, "fit", lambda *_: pytest.fail("learned from a sample"))
    rows = [(i, f"{['sun moon', 'tax law', 'salt oil'][i % 3]} word{i % 7} " * 5, "en", "src0", 1) for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_mixing(spark, str(tmp_path)).collect()
    assert len(got) == 60 and all(r["topic"] in topics.names() for r in got)
    assert STAGES["mixing"](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count() <= 60
