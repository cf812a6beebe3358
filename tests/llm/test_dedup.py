"""SimHash groups and line dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import fingerprints, line_dedup, simhash
from lodestone.plans.components import connected_components

SCHEMA = "doc_id bigint, text string, fp string"


def brute_print(text):
    words = (text or "").encode().lower().split()
    spans = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64(b" ".join(s), seed=42).intdigest() for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    label = list(range(len(prints)))
    near = [[j for j, q in enumerate(prints) if (p ^ q).bit_count() <= 3] for p in prints]
    while True:
        new = [min(label[j] for j in js) for js in near]
        if new == label:
            return label
        label = new


def texts(n, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    made = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(n)]
    for t in made[: n // 3]:
        parts = t.split()
        if parts:
            parts[r.randrange(len(parts))] = "changed"
        made.append(" \t".join(parts).upper())
    return made + made[:5] + [None, "", " \n", "a", "a b"]


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "one TWO", "a b c", "ÄÖ x\x0by z\xa0q", "w " * 5000])
def test_fingerprint(text):
    assert fingerprints.fingerprint(text.encode() if text is not None else None) == brute_print(text)


def test_keys_meet_within_three_bits():
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 63, 600, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in r.choice(64, r.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    keys = []
    for x in (a, b):
        rows, found = fingerprints.bucket_keys(x)
        keys.append([set(found[rows == i].tolist()) for i in range(len(x))])
    assert all(p & q for p, q in zip(*keys, strict=True))


def test_simhash_groups(spark):
    made = texts(60)
    rows = [(i, t, "clash") for i, t in enumerate(made)] + [(3, made[3], "again"), (None, made[4], "x"), (None, "quite alone here", "x")]
    got = simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    prints = [brute_print(t) for t in made]
    want = brute_groups(prints)
    for r in got:
        if r["id"] is not None:
            assert r["fp"] % 2**64 == prints[r["id"]] and r["component"] == want[r["id"]]
    assert sorted(str(r["component"]) for r in got if r["id"] is None) == sorted([str(want[4]), "None"])
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert {r["doc_id"] for r in kept.collect()} == {*want, None}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_groups(empty).count() == 0
    assert line_dedup.keep_bitmaps(empty).count() == 0
    assert line_dedup.drop_lines(empty, line_dedup.keep_bitmaps(empty)).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, x) for x in range(401, 450)] + [(7, 7), (None, 3)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}
    root = lambda v: v if parent.setdefault(v, v) == v else root(parent[v])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {v: root(v) for v in parent}


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def brute_lines(rows):
    keys = {d: [lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for d, t in rows}
    held = {}
    for d, ks in keys.items():
        for k in ks:
            if len(k) >= 20:
                held.setdefault(k, set()).add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys[d], strict=True) if not (len(k) >= 20 and len(held[k]) >= 3 and d != max(held[k]))]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("partitions", [1, 3, 60])
def test_line_dedup(spark, partitions):
    r = random.Random(partitions)
    pool = [f"line number {i} " + "x" * r.randint(0, 20) for i in range(25)] + ["é" * 20, "é" * 19, "short"]
    rows = []
    for d in range(120):
        lines = [r.choice(pool) for _ in range(r.randint(0, 6))] + ["  The Most Common Line of all\t"] * (d % 3 != 0)
        r.shuffle(lines)
        rows.append((d, "\n".join(x.upper() if r.random() < 0.2 and x.isascii() else x for x in lines)))
    rows += [(500, None), (501, ""), (502, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        maps = line_dedup.keep_bitmaps(df)
        got = {x["id"]: (x["n_lines"], x["n_dropped"], x["kept_sha256"]) for x in line_dedup.line_counts(df, maps).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute_lines(rows)


def test_line_dedup_odd_rows(spark):
    line = "a line of more than twenty characters"
    rows = [(1, line, 1), (1, line, 2), (2, f"{line}\nrest", 3), (3, line, 4), (None, line, 5), (4, "x" * 300_000, 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, keep int")
    out = line_dedup.drop_lines(df, line_dedup.keep_bitmaps(df))
    assert out.columns == ["doc_id", "text", "keep"]
    got = sorted(((r["keep"], r["text"]) for r in out.collect()))
    assert [t for _, t in got] == ["", "", "rest", line, line, "x" * 300_000]


def test_bitmap_round_trip():
    for n in (1, 7, 8, 9, 100):
        assert line_dedup.kept_lines(None, n).all()
