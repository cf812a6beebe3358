"""Quality cutoffs that are certified over all rules together."""

import random

from lodestone.llm import queries, quality


def _tables(spark, path, good, bad=40):
    r = random.Random(9)
    prose = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(30))
    rows = [(i, prose(), "fr") for i in range(good)]
    rows += [(10_000 + i, prose().replace(" ", "% "), "fr") for i in range(bad)]
    rows += [(20_000 + i, prose().replace(" ", "% "), "fr") for i in range(bad)]  # without a label
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = [(i, int(i < 10_000)) for i, _, _ in rows if i < 20_000]
    labels = spark.createDataFrame([*labels, (20_001, None), (None, 1)], "doc_id bigint, quality int")
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    labels.write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return str(path)


def test_a_small_stratum_is_certified(spark, tmp_path):
    got = {r["doc_id"]: r["kept"] for r in queries.op10_quality(spark, _tables(spark, tmp_path, 240)).collect()}
    assert not any(k for i, k in got.items() if i >= 10_000)
    assert sum(k for i, k in got.items() if i < 10_000) >= 0.98 * 240


def test_too_few_labels_certify_nothing(spark, tmp_path):
    # .98^n <= .05 / 5 needs 228 of them.
    got = {r["doc_id"]: r["kept"] for r in queries.op10_quality(spark, _tables(spark, tmp_path, 227)).collect()}
    assert all(got.values())


def test_joint_rejection_stays_within_its_bound(spark):
    # Both rules alone reject 1 % of the good documents, but not the same ones.
    r = random.Random(1)
    counts = [f.split()[0] for f in quality.COUNTS.split(", ")]
    rows = []
    for i in range(3000):
        row = dict.fromkeys(counts, 0) | {"n_words": 100, "word_chars": 500, "n_lines": 10}
        row["n_symbols"] = 300 if i % 100 == 0 else 0
        row["n_shouted"] = 300 if i % 100 == 1 else r.randrange(8)
        rows.append((*(row[c] for c in counts), i, "en"))
    counted = spark.createDataFrame(rows, quality.COUNTS + ", __id bigint, __stratum string")
    labels = spark.createDataFrame([(i, 1) for i in range(3000)], "doc_id bigint, quality int")
    cutoffs = quality.joint_cutoffs(counted, labels)
    out = quality.verdicts(counted, cutoffs).filter("not kept").count()
    assert quality.upper_bound(out, 3000, quality.ERROR / 5) <= quality.MAX_FALSE
