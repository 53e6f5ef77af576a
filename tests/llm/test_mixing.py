import pytest

from tarnkite.llm import mixing


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        level = (total - sum(most * sizes[s] for s in capped)) / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def rows_of(prose):
    rows = []
    for k in range(600):
        source = [None, "b", "a", "Z", "", "é"][k % 17 % 6] if k % 3 else "hot"
        rows.append((k, source, prose(1 + k * 7 % 60, k)))
    return rows + [(900, "none", ""), (901, "none", None), (902, "a", " \t"), (902, "a", " \t"), (None, "b", "x y z"), (5, "hot", rows[5][2])]


@pytest.mark.parametrize("block", [16, 4096])
def test_targets_and_totals(docs, prose, block):
    rows = rows_of(prose)
    got = mixing.mix(docs(rows, "doc_id long, source string, text string"), block=block).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = filled(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.target == pytest.approx(want[r.source])
        assert r.source_size == sizes[r.source]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], abs=30)


def test_reruns_agree(docs, prose):
    df = docs(rows_of(prose), "doc_id long, source string, text string")
    assert sorted(map(repr, mixing.mix(df).collect())) == sorted(map(repr, mixing.mix(df.repartition(3)).collect()))


def test_nothing_to_mix(docs):
    df = docs([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert {(r.target, r.taken) for r in mixing.mix(df).collect()} == {(0.0, 0)}
    assert mixing.mix(df.limit(0)).count() == 0


def test_flight_keeps_both_totals():
    sizes, p = [float(1 + k * k % 97) for k in range(300)], [0.1 + 0.8 * (k % 9) / 9 for k in range(300)]
    out = mixing.moved(sizes, p, 3)
    left = [k for k, x in enumerate(out) if 0 < x < 1]
    assert len(left) <= 2
    assert sum(out) == pytest.approx(sum(p))
    assert sum(s * x for s, x in zip(sizes, out, strict=True)) == pytest.approx(sum(s * x for s, x in zip(sizes, p, strict=True)))


def test_inclusion_probabilities_hold_on_average():
    sizes = [3.0, 5.0, 8.0, 13.0, 21.0, 34.0]
    mean = [0.0] * 6
    for seed in range(4000):
        for k, x in enumerate(mixing.moved(sizes, [0.3, 0.6, 0.5, 0.4, 0.7, 0.5], seed)):
            mean[k] += x / 4000
    assert mean == pytest.approx([0.3, 0.6, 0.5, 0.4, 0.7, 0.5], abs=0.03)


def test_rows_that_repeat_lie_in_many_blocks(spark, monkeypatch):
    """50,000 equal rows, and null ids of one size: no block is above BLOCK."""
    rows = spark.range(50_000).selectExpr("7L AS doc_id", "'a' AS source", "'x y z' AS text")
    rows = rows.unionByName(spark.range(9_000).selectExpr("CAST(NULL AS LONG)", "'a'", "'x y'").toDF("doc_id", "source", "text"))
    rows = rows.unionByName(spark.range(30_000).selectExpr("id", "'b'", "'one'").toDF("doc_id", "source", "text"))
    told, plain = [], mixing.fly

    def watched(group):
        if len(group) > mixing.BLOCK:
            raise ValueError(f"{len(group)} documents in a block")
        return plain(group)

    monkeypatch.setattr(mixing, "fly", watched)
    got = mixing.mix(rows).groupBy("source").agg({"taken": "sum", "target": "max", "*": "count"}).collect()
    told = {r.source: (r["sum(taken)"], r["max(target)"], r["count(1)"]) for r in got}
    assert {s: x[2] for s, x in told.items()} == {"a": 59_000, "b": 30_000}
    assert all(taken == pytest.approx(target, abs=30) for taken, target, _ in told.values())


def test_a_text_that_is_most_of_its_source(docs, prose):
    rows = [(0, "a", prose(250_000, 1)), *((k, "ab"[k % 2], prose(20 + k % 30, k)) for k in range(1, 300))]
    got = mixing.mix(docs(rows, "doc_id long, source string, text string")).collect()
    sizes = {s: sum(len(r[2].split()) for r in rows if r[1] == s) for s in "ab"}
    target = filled(sizes)
    for s in "ab":
        taken = sum(r.taken for r in got if r.source == s)
        assert abs(taken - target[s]) <= max(250_000 if s == "a" else 0, 0.02 * target[s] + 60)
    assert all(r.taken <= 2 * r.size for r in got)
    assert max(r.size for r in got) == 250_000
