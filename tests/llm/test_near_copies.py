"""The pipeline's near copies against brute force over all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lodestone.llm import buckets, fingerprints, near_copies, simhash

SCHEMA = "doc_id bigint, text string, n int"


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_groups(texts):
    sets = [brute_set(t) for t in texts]
    label = list(range(len(sets)))
    near = [[j for j, y in enumerate(sets) if x == y or 5 * len(x & y) >= 4 * len(x | y) > 0] for x in sets]
    while True:
        new = [min(label[j] for j in js) for js in near]
        if new == label:
            return label
        label = new


def edited(n=60, seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    made = [" ".join(word() for _ in range(r.choice([3, 30, 120, 400]))) for _ in range(n)]
    common = " ".join(word() for _ in range(25))
    made = [f"{t} {common}" if i % 2 else t for i, t in enumerate(made)]
    for t in made[:]:
        for share in (0.01, 0.02, 0.04):  # around the threshold
            words = t.split()
            for _ in range(max(1, int(len(words) * share))):
                words[r.randrange(len(words))] = word()
            made.append(" ".join(words))
    return made + made[:4] + [made[1].upper(), None, "", " \n", "a", "a b"]


@pytest.mark.parametrize("sample", [20_000, 0])
def test_stage_finds_every_pair(spark, monkeypatch, sample):
    monkeypatch.setattr(near_copies, "SAMPLE_DOCS", sample)
    texts = edited()
    want = brute_groups(texts)
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 2), (None, texts[4], 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r["id"]: r["component"] for r in near_copies.near_copies(df).collect() if r["id"] is not None} == dict(enumerate(want))
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted([*set(want), *([3] if want[3] == 3 else [])])
    prints = [fingerprints.fingerprint(t.encode() if t else None) for t in texts]
    linked = [(i, w) for i, w in enumerate(want) if i != w]
    assert any((prints[i] ^ prints[w]).bit_count() > 3 for i, w in linked)  # beyond the reach of op4
    assert near_copies.near_copies(df.limit(0)).count() == 0


def test_sketches_never_rule_out_too_much():
    r = np.random.default_rng(3)
    for n, m, shared in [(1, 1, 0), (0, 3, 0), (300, 290, 280), (5000, 40, 30), (1000, 1000, 900), (64, 65, 60)]:
        both = r.integers(0, 2**63, shared, dtype=np.uint64)
        x = np.unique(np.concatenate((both, r.integers(0, 2**63, n - shared, dtype=np.uint64))))
        y = np.unique(np.concatenate((both, r.integers(0, 2**63, m - shared, dtype=np.uint64))))
        assert near_copies.apart(near_copies.sketch(x), near_copies.sketch(y)) <= len(np.setxor1d(x, y))
    assert near_copies.apart(near_copies.sketch(x), near_copies.sketch(x)) == 0


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_runs_across_batches(size):
    keys = np.sort(np.random.default_rng(size).integers(0, 40, 60))
    nodes = np.arange(60)
    rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes)], ["key", "node"])
    got = [r for out in buckets._runs(rows.slice(i, size) for i in range(0, 60, size)) for r in out.to_pylist()]
    twice = [i for i in range(60) if (keys == keys[i]).sum() > 1 or i in (0, 59)]
    assert [r["node"] for r in got] == twice
    assert all(r["prev_node"] == (i - 1 if i and keys[i - 1] == keys[i] else None) for r, i in zip(got, twice, strict=True))


def _labels(nodes, edges):
    label = {int(n): int(n) for n in nodes}
    while True:
        new = dict(label)
        for p, q in edges:
            new[p] = new[q] = min(new[p], new[q])
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("long_run", [3, 1000])
@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("size", [1, 5, 1000])
def test_bucket_pairs_connect_what_brute_force_does(long_run, size, whole):
    r = np.random.default_rng(5)
    centres = r.integers(0, 2**63, 6)
    nodes = np.unique([int(c) ^ (1 << int(r.integers(0, 60))) ^ (1 << int(r.integers(0, 60))) for c in centres for _ in range(9)])
    rows = sorted({(int(k), int(n)) for n in nodes for k in r.integers(0, 8, 4)})
    batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in (0, 1)], ["key", "node"])
    run = buckets.settling(simhash.linked, long_run, whole)
    out = [x for b in run(batch.slice(i, size) for i in range(0, len(rows), size)) for x in b.to_pylist()]
    left = {(x["key"], x["node"]) for x in out if x["a"] is None}
    pairs = {(x["a"], x["b"]) for x in out if x["a"] is not None}
    assert not left or not whole or long_run == 3
    close = lambda p, q: (p ^ q).bit_count() <= 3
    assert all(close(p, q) for p, q in pairs) and all(x["key"] is None for x in out if x["a"] is not None)
    pairs |= {(p, q) for k, p in left for j, q in left if j == k and p < q and close(p, q)}
    by_key = {}
    for k, n in rows:
        by_key.setdefault(k, []).append(n)
    want = {(p, q) for each in by_key.values() for p in each for q in each if p < q and close(p, q)}
    assert _labels(nodes, pairs) == _labels(nodes, want) and len(want) > 10


def test_runs_of_sketches_lose_no_pair():
    r = np.random.default_rng(6)
    base = [np.unique(r.integers(0, 2**63, k, dtype=np.uint64)) for k in (40, 70, 130, 600)]
    sets = [np.unique(np.concatenate((x[r.random(len(x)) > 0.06], r.integers(0, 2**63, len(x) // 16, dtype=np.uint64)))) for x in base for _ in range(12)]
    rows = sorted(((key, len(x), i, 0, i // 2, near_copies.sketch(x)) for key in (1, 2) for i, x in enumerate(sets)), key=lambda x: (x[0], x[2]))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    names = ["key", "n", "node", "place", "component", "sketch"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    got = set(zip(*near_copies.crossed(batch), strict=True))
    similar = lambda x, y: 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y))
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if i // 2 != j // 2 and similar(sets[i], sets[j])}
    assert want <= got and len(got) < len(sets) ** 2 / 3 and len(want) > 50
