"""WARC archives, URL rules, sharding and mixing."""

import gzip
import hashlib
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import mixing, queries, sharding, tokens, url_filter, warc
from lodestone.plans import scratch

LONG = "<p>" + "payload " * 30
PAGES = [(5, "http://a/x y", LONG, 1), (2, "http://b", LONG, 2), (9, None, LONG, 3), (7, "http://c", "short", 4), (8, "http://d", "short", 5), (1, "http://e\r\nX: 1", None, 6), (None, "http://f", LONG, 7), (11, "http://ü", "<b>ü€</b>" * 20, 8)]


def _pages(spark, partitions=3):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string, digest int").repartition(partitions)


def test_warc_round_trip(spark):
    folder = scratch.folder(spark)
    manifest = warc.write(_pages(spark), folder, shard_bytes=600, roll_bytes=500)
    assert manifest.count() > 2
    got = {r["page_id"]: r for r in warc.read(manifest, folder).collect()}
    assert len(got) == len(PAGES)
    for key, _, html, _ in PAGES:
        payload = (html or "").encode()
        assert (got[key]["payload_bytes"], got[key]["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items() if r["record_type"] == "revisit"} == {5: ("revisit", 2), 9: ("revisit", 2), None: ("revisit", 2)}


def test_warc_is_deterministic(spark):
    made = []
    for partitions in (1, 6):
        folder = scratch.folder(spark)
        warc.write(_pages(spark, partitions), folder, shard_bytes=600, roll_bytes=500)
        files = sorted(Path(folder.removeprefix("file://")).glob("*.warc.gz"))
        made.append([(f.name, f.read_bytes()) for f in files])
        assert not list(Path(folder.removeprefix("file://")).glob("_temporary/*"))
    assert made[0] == made[1]
    with gzip.open(Path(folder.removeprefix("file://")) / made[0][0][0]) as stream:
        assert stream.read(8) == b"WARC/1.1"


def test_warc_of_nothing(spark):
    folder = scratch.folder(spark)
    manifest = warc.write(_pages(spark).filter("page_id = 12345"), folder)
    assert warc.read(manifest, folder).count() == 0


RULES = [("com", "/en/", False), ("example.com", "/en/7", True), ("net", "/de/", True), ("example.net", "/de/8", False), ("org", "/es/", False)]


def test_url_rules(spark):
    rows = [
        (1, "http://Sub.EXAMPLE.com/en/70?q", "sub.example.com", "/en/70", "example.com/en/7", "allow"),
        (2, "https://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
        (3, "http://x.example.net/de/80#f", "x.example.net", "/de/80", "example.net/de/8", "block"),
        (4, "http://notexample.net/de/80", "notexample.net", "/de/80", "net/de/", "allow"),
        (5, "http://mycom/en/", "mycom", "/en/", None, "allow"),
        (6, None, "", "", None, "allow"),
        (7, "no scheme.com/en/", "", "", None, "allow"),
        (8, "a://b.org?x/es/", "b.org", "", None, "allow"),
        (9, "", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, None, "x") for i, u, *_ in rows], "page_id bigint, url string, html string, host string")
    got = sorted(tuple(r) for r in url_filter.judge(pages, RULES).collect())
    assert got == sorted((i, h, p, r, v) for i, _, h, p, r, v in rows)


def test_url_aliases(spark):
    link = '<link href="{}" rel="canonical">'
    rows = [
        (1, "http://a.fr/1", link.format("https://bad.com/en/1")),
        (2, "http://b.fr/2?x=1&y=2", '<META http-equiv=refresh content="0; URL=/3">'),
        (3, "http://b.fr/3", link.format("http://a.fr/1#top")),
        (4, "http://example.com/en/7", link.format("http://c.fr/4")),
        (5, "http://c.fr/4", link.format("http://d.com/en/")),
        (6, "http://e.fr/", link.format("")),
        (7, "http://f.fr/a/b", '<link rel="canonical" href="c?k=1&amp;l=2">'),
        (8, "http://f.fr/a/c?k=1&l=2", None),
        (9, "http://g.fr/9", None),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    moved = spark.createDataFrame([("http://f.fr/a/c?k=1&l=2", "http://x.org/es/"), ("http://g.fr/9", None)], "a string, b string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, RULES, moved).collect()}
    assert {k: v for k, (_, v) in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block", 9: "allow"}
    assert got[1][0] is None and got[4][0] == "example.com/en/7"
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def test_sharding(spark):
    rows = [(i, "t" * (i % 50), 1) for i in range(3000)] + [(None, None, 2)] * 3 + [(7, "ü", 3)] * 500
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    got = sharding.shard_records(df, [1.0] * 10, [1.0]).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 10)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    nulls = [r for r in got if r["doc_id"] is None]
    assert {r["size"] for r in nulls} == {16} and {r["text_crc32"] for r in nulls} == {0} and len({r["shard"] for r in nulls}) == 1
    odd = next(r for r in got if r["doc_id"] == 7 and r["size"] == 18)
    assert odd["text_crc32"] == zlib.crc32("ü".encode())
    moved = [r for r in got if r["grown_shard"] == 10 and r["doc_id"] is not None and r["size"] != 18]
    assert 150 < len(moved) < 400
    assert sharding.shard_records(df.limit(0), [1.0]).count() == 0


def test_weighted_shards(spark):
    df = spark.range(6000).withColumnRenamed("id", "doc_id")
    shares = Counter(r["shard"] for r in sharding.assign(df, "doc_id", [1.0, 2.0, 3.0]).collect())
    assert [round(shares[i] / 6000, 1) for i in range(3)] == [0.2, 0.3, 0.5]


PLAN = mixing.Plan({"source": ["a", "b"], "lang": ["en", "fr"], "topic": ["legal", "general"]}, {"source": 0.5, "lang": 0.5, "topic": 1.0}, 0.5)


def test_rake_meets_marginals():
    cells = [(s, x, t) for s in "ab" for x in ("en", "fr") for t in ("g", "h")]
    supply = np.array([400, 100, 50, 80, 90, 60, 70, 150], float)
    wanted = [{"a": 0.5, "b": 0.5}, {"en": 0.6, "fr": 0.4}, {"g": 0.6, "h": 0.4}]
    drawn = mixing.rake(cells, supply, wanted, 0.4)
    assert (drawn <= supply + 1e-9).all()
    for d, target in enumerate(wanted):
        for name, share in target.items():
            got = sum(x for c, x in zip(cells, drawn, strict=True) if c[d] == name)
            assert abs(got / (0.4 * supply.sum()) - share) < 1e-6


def test_mixing(spark):
    rows = [(i, "license text " * 4 if i % 7 == 0 else "plain words here", "en" if i % 4 else "fr", "a" if i % 5 else None, i) for i in range(2000)]
    rows += [(None, None, None, None, 1), (3, "", "xx", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, row int")
    got = mixing.weigh(docs, PLAN).collect()
    assert len(got) == len(rows)
    assert {r["c_source"] for r in got} == {"a", "b", "*"} and {r["c_topic"] for r in got} == {"legal", "general"}
    assert all(0 <= r["probability"] <= 1 for r in got)
    words = lambda t: len((t or "").split())
    assert sum(r["n_tokens"] for r in got) == sum(words(r[1]) for r in rows)
    kept = mixing.sample(docs, PLAN)
    assert kept.columns == docs.columns
    assert sorted((r["row"], r["doc_id"]) for r in kept.collect() if r["doc_id"] is not None) == sorted((next(x[4] for x in rows if x[0] == r["id"] and words(x[1]) == r["n_tokens"]), r["id"]) for r in got if r["selected"] and r["id"] is not None)
    expected = sum(r["n_tokens"] * r["probability"] for r in got)
    drawn = sum(r["n_tokens"] for r in got if r["selected"])
    assert abs(drawn - expected) < 0.1 * expected
    assert mixing.sample(docs.limit(0), PLAN).count() == 0


def test_warc_keeps_what_is_there(spark):
    folder = scratch.folder(spark)
    manifest = warc.write(_pages(spark), folder)
    with pytest.raises(ValueError):
        warc.write(_pages(spark), folder)
    file = Path(folder.removeprefix("file://")) / manifest.first()["file"]
    file.write_bytes(file.read_bytes()[:-1] + b"x")
    with pytest.raises(Exception, match="is not what the manifest lists"):
        warc.read(manifest, folder).count()


def test_warc_splits_a_hot_key(spark):
    rows = [(k, "http://a", f"payload {i} " * 20) for k in (None, 3) for i in range(30)] + [(3, "http://a", "twice " * 20)] * 2 + [(9, "http://b", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    folder = scratch.folder(spark)
    manifest = warc.write(pages, folder, shard_bytes=2000)
    by_file = manifest.groupBy("shard").sum("records").collect()
    assert len(by_file) > 5
    got = warc.read(manifest, folder).collect()
    assert Counter(r["page_id"] for r in got) == {None: 30, 3: 32, 9: 1}
    assert {r["payload_digest"] for r in got} == {hashlib.sha256(h.encode()).hexdigest() for *_, h in rows}
    ids = [h["warc-record-id"] for f in Path(folder.removeprefix("file://")).glob("*.warc.gz") for h, _ in warc.parse(gzip.open(f))]
    assert len(ids) == len(set(ids))


def test_shards_by_key_and_digest():
    bounds = [(None, 5), (2, -7), (2, 9), (4, 0)]
    keys = pa.array([None, None, 1, 2, 2, 2, 3, 4, 4, 5])
    ties = np.array([4, 5, 0, -8, -7, 9, 0, -1, 0, 0])
    assert warc.shards_of(bounds, keys, ties).tolist() == [0, 1, 1, 1, 2, 3, 3, 3, 4, 4]


def test_given_targets_and_gaps():
    cells = [("a", "en", "g"), ("a", "fr", "g"), ("b", "en", "g")]
    supply = np.array([100.0, 100.0, 100.0])
    wanted = [{"a": 0.9, "b": 0.1}, {"en": 0.5, "fr": 0.5}, {"g": 1.0}]
    drawn = mixing.rake(cells, supply, wanted, 0.5)
    missed = mixing.gaps(cells, drawn, wanted, 150.0)
    assert max(x for d in missed for x in d.values()) < 1e-6
    short = mixing.rake(cells, np.array([10.0, 100.0, 100.0]), wanted, 0.9)  # not enough of a and en
    assert max(x for d in mixing.gaps(cells, short, wanted, 0.9 * 210) for x in d.values()) > 0.1


def test_mixing_query_by_brute_force(spark, tmp_path):
    r = np.random.default_rng(2)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma,", "delta.", "été"], r.integers(1, 40))) if i % 9 else " | ".join(["x"] * 30) for i in range(400)]
    rows = [(i, t, ["en", "fr", "de", "es"][i % 4], f"src{i % 3}", i) for i, t in enumerate(texts)] + [(500, None, None, None, 0), (501, "", "en", "src0", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op7_mixing(spark, str(tmp_path)).collect()}
    encoder = tokens.Encoder(queries.tokenizer())
    assert all(got[i]["n_tokens"] == len(encoder._tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows)
    assert got[500]["topic"] == got[501]["topic"] == "*" and got[500]["source"] == "*"
    cell = lambda x: tuple(x[d] for d in mixing.DIMENSIONS)
    supply = Counter()
    for x in got.values():
        supply[cell(x)] += x["n_tokens"]
    total = sum(supply.values())
    share = {c: next(x["probability"] for x in got.values() if cell(x) == c) for c in supply}
    for d, name in enumerate(mixing.DIMENSIONS):
        observed = Counter()
        for c, n in supply.items():
            observed[c[d]] += n
        raised = {k: n ** queries.MIX.powers[name] for k, n in observed.items() if n}
        for k, want in raised.items():
            want *= total * queries.MIX.share / sum(raised.values())
            have = sum(n * share[c] for c, n in supply.items() if c[d] == k)
            gap = max(x["marginal_gap"] for x in got.values() if x[name] == k)
            assert abs(have - want) <= (gap + 1e-6) * want
    for i, x in got.items():
        u = (int(hashlib.md5(f"{i}:mix".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        assert x["selected"] == (u < x["probability"])
