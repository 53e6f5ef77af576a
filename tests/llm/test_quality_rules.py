import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tarnkite.llm import quality_rules as q


def corpus(prose):
    rows, labels = [], []
    for k in range(400):
        good = k % 4 != 0
        text = prose(20 + k % 60, k)
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split()) if k % 8 else " ".join(w + "%%%" for w in text.split())
        rows.append((k, text))
        labels.append((k, int(good)))
    return rows, labels


def test_held_out_accuracy_and_equal_texts(spark, docs, prose):
    rows, labels = corpus(prose)
    lab = spark.createDataFrame([(*x, 1, 2.0) for x in [*labels, (1, None), (2, 5), (None, 1), (9999, 0)]], "doc_id long, quality int, toxic int, score double")
    df = docs([*rows, (1000, None), (1001, ""), (1002, rows[1][1]), (None, rows[1][1]), (1003, "w" * 300_000)])
    got = {r.doc_id: r for r in q.classify(df, lab).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    held = [k for k, _ in labels if got[k].held_out]
    assert len(held) > 80
    assert np.mean([got[k].predicted == y for k, y in labels if got[k].held_out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[1].score == got[1002].score == got[None].score
    assert got[1000].score == got[1001].score
    kept = q.keep_good(df, lab)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_held_out_labels_do_not_matter(spark, docs, prose):
    rows, labels = corpus(prose)
    flip = [(k, 1 - y if zlib.crc32(str(k).encode()) % 3 == 1 else y) for k, y in labels]
    a, b = (q.train(docs(rows), spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flip))
    assert a == b


def test_compiled_rules_equal_the_model(spark, docs, prose):
    rows, labels = corpus(prose)
    model = q.train(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert 0 < len(model.rules) < 100
    import pyarrow as pa

    x = q.statistics(pa.array([t for _, t in rows]))
    z = model.base + sum(w * q.holds(r, x) for r, w in model.rules)
    got = {r.doc_id: r.score for r in q.score_quality(docs(rows).select("doc_id", "text"), model).select("doc_id", "score").collect()}
    assert [got[i] for i, _ in rows] == pytest.approx(q.sigmoid(z).tolist())


def test_no_labels_one_class_no_documents(spark, docs, prose):
    rows, _ = corpus(prose)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in q.classify(docs(rows[:5]), none).collect()} == {0.5}
    ones = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int")
    assert {r.predicted for r in q.classify(docs(rows[:20]), ones).collect()} == {1}
    assert q.classify(docs(rows[:5]).limit(0), ones).count() == 0


def plain_statistics(text):
    """The statistics of one text, by its bytes and words."""
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw.lower() if raw.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in raw)) if w]
    n = len(words)
    if not n:
        return [0.0] * len(q.STATISTICS)
    share = lambda chars: sum(b in chars for b in raw) / n
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in raw)
    found = {
        "log_words": math.log2(n), "word_length": sum(map(len, words)) / n, "upper": sum(65 <= b <= 90 for b in raw) / max(1, letters), "digits": share(b"0123456789"),
        "marks": share(b"#$%&*@^~=<>{}[]\\_"), "bangs": share(b"!?"), "bars": share(b"|"), "stops": share(b"."), "commas": share(b",;:"), "high": sum(b >= 128 for b in raw) / n, "breaks": share(b"\n"),
        "short_words": sum(len(w) <= 3 for w in words) / n, "repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, "distinct": len(set(words)) / n,
    }
    return [found[k] for k in q.STATISTICS]


def test_statistics_against_plain_counts(prose):
    texts = [None, "", " \n\t", "One one ONE two!", "é É ß|x", prose(300, 3), "#$% 12 a,b;c\nLast.", prose(2000, 4).upper(), "x" * 3000, "a " * 500]
    got = q.statistics(pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        assert row.tolist() == pytest.approx(plain_statistics(text), abs=1e-12)


def test_the_weights_are_the_least_of_the_lasso_loss():
    """No weight of the fitted rules can be moved to a penalised loss that is lower by more than the steps leave open."""
    draw = np.random.default_rng(5)
    x = draw.random((600, len(q.STATISTICS)))
    y = ((x[:, 0] > 0.6) & (x[:, 3] < 0.5) | (draw.random(600) < 0.05)).astype(float)
    model = q.fit_rules(x, y)
    a = np.stack([q.holds(rule, x) for rule, _ in model.rules], 1).astype(float)
    w = np.array([v for _, v in model.rules])

    def loss(w, b):
        z = a @ w + b
        return np.mean(np.logaddexp(0, z) - y * z) + q.LASSO * np.abs(w).sum()

    best = loss(w, model.base)
    for k in range(len(w)):
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += step
            assert loss(moved, model.base) > best - 1e-4
    assert min(loss(w, model.base + s) for s in (-0.05, 0.05)) > best - 1e-4


def test_the_sample_is_a_bound_also_where_ids_repeat(spark, monkeypatch):
    """One labelled id in 50,000 rows of different texts, and one in as many equal rows."""
    seen = []
    monkeypatch.setattr(q, "fit_rules", lambda x, y: seen.append(len(y)) or q.RuleModel(0.0, []))
    labels = spark.createDataFrame([(1, 1), (7, 0)], "doc_id long, quality int")
    assert labels.where(q.held_out()).isEmpty()
    many = spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"))
    q.train(many, labels, sample=100)
    q.train(many.withColumn("text", F.lit("one text")).unionByName(many.limit(1).withColumn("doc_id", F.lit(7).cast("long"))), labels, sample=100)
    assert seen == [100, 2]
