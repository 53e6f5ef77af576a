"""The pipeline against the stages' brute-force versions, one after the other."""

import random

import test_decontaminate
import test_jaccard_join
import test_line_dedup
import test_mixing

import corpus_pipeline
from tarnkite.llm import quality_rules


def sample(prose):
    draw, docs, labels = random.Random(8), [], []
    items = [(k, prose(16 + k, 7000 + k)) for k in range(6)]
    passage = prose(60, 6999)
    for k in range(260):
        parts = [prose(draw.randint(5, 80), k) for _ in range(draw.randint(1, 3))]
        if k % 13 == 0:
            parts.append(passage)
        if k % 17 == 5:
            parts.append(items[k % 6][1])
        text = "\n".join(parts)
        if k % 9 == 4 and docs:
            words = docs[-1][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        if k % 6 == 1:
            text = " ".join(w + draw.choice(["%%%", "***", "&&&"]) for w in text.split())
        docs.append((k * 3 % 263, text, "en", f"src{k % 4 if k % 3 else 0}", len(text)))
        if k % 2 == 0 or k % 6 == 1:
            labels.append((k * 3 % 263, int(k % 6 != 1), 0))
    return docs, labels, items


def test_run_and_stages(spark, prose, tmp_path):
    docs, labels, items = sample(prose)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = {r.doc_id for r in quality_rules.classify(df, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect() if r.predicted}
    bad = {i for i, q, _ in labels if not q}
    assert not good & bad
    rows = [(i, t) for i, t, *_ in docs if i in good]
    source = {i: s for i, _, _, s, _ in docs}
    cleaned = test_line_dedup.brute(rows)
    rows = [(i, cleaned[i, t]) for i, t in rows if cleaned[i, t] == t or cleaned[i, t].split()]
    heads = {c for _, _, c in test_jaccard_join.brute(rows)}
    rows = [r for r in rows if r[0] in heads]
    leaks = {i for i, _ in test_decontaminate.brute(rows, items)}
    rows = [r for r in rows if r[0] not in leaks]
    assert len(docs) > len(good) > len(heads) > len(rows) > 50

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r.size for i, r in got.items()} == {i: len(t.split()) for i, t in rows}
    sizes, taken = {}, {}
    for i, t in rows:
        sizes[source[i]] = sizes.get(source[i], 0) + len(t.split())
        taken[source[i]] = taken.get(source[i], 0) + got[i].taken
    want = test_mixing.filled(sizes)
    assert all(abs(taken[s] - want[s]) < 40 for s in sizes)

    step = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == df.columns, name
    assert {r.doc_id: r.text for r in step.collect()} == dict(rows)
    assert all(r.n_chars == len(r.text) for r in step.collect())


def test_stages_of_nothing(spark, prose, tmp_path):
    docs, labels, items = sample(prose)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
