import numpy as np
import pyarrow as pa
import pytest

from tarnkite.llm import _common as c
from tarnkite.llm import _tokens as t


def hashes(texts, lane=0):
    raw, at = t.text_bytes(pa.array(texts))
    begin, end, _ = t.words(raw, at)
    return t.word_hashes(raw, begin, end, lane).tolist()


def opposite(n):
    """A Thue-Morse word of n letters and its complement, equal under any polynomial modulo 2 ** 64 from 1,024 on."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_do_not_collide_by_structure():
    for n in (8, 16, 32, 64, 128, 512, 1024, 2048):
        for lane in (0, 1):
            assert len(set(hashes([*opposite(n)], lane))) == 2, n


def test_equal_words_have_equal_hashes_wherever_they_stand(monkeypatch):
    words = ["a", "B", "abcdefgh", "abcdefghi", "é" * 31, "x" * 64, "x" * 65, "Y" * 300, "a\x00", "a\x00\x00"]
    want = [hashes([w])[0] for w in words]
    assert len(set(want)) == len(want)
    assert hashes([" ".join(words), "\t".join(reversed(words)).upper().replace("É", "é")]) == want + want[::-1]
    monkeypatch.setattr(t, "PIECE", 7)
    assert hashes([" ".join(words)]) == want
    assert not set(want) & set(hashes([" ".join(words)], 1))


def test_ranges():
    assert t.spans_of(np.array([3, 9, 0]), np.array([5, 9, 2])).tolist() == [3, 4, 0, 1]


def test_document_keys(spark):
    rows = [(1, "a"), (1, "a"), (1, None), (1, ""), (None, "a"), (11, "a"), (None, None)]
    found = [bytes(r[0]) for r in spark.createDataFrame(rows, "doc_id long, text string").select(c.doc_key()).collect()]
    assert found[0] == found[1]
    assert len(set(found)) == 6
    assert {len(x) for x in found} == {16}


def test_filters_let_all_own_values_through(spark):
    values = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 500)
    for bits in (10, 16):
        table = c.hash_filter(spark.createDataFrame([(int(x),) for x in values], "v long"), "v", bits)
        assert c.passes(table, values.view(np.uint64)).all()
    others = np.random.default_rng(4).integers(0, 1 << 64, 5000, dtype=np.uint64)
    assert c.passes(table, others).mean() < 0.02


@pytest.mark.parametrize(("n", "bits", "rate"), [(0, 16, 0), (1 << 12, 16, 0.008), (1 << 14, 16, 0.17), (1 << 16, 16, 0.65), (300, 6, 1)])
def test_rate_of_a_filter_follows_its_load(spark, n, bits, rate):
    """Sixteen bits a value let below 0.8 % through, four 17 %; an overfull filter has one probe, and still lets no own value go."""
    rng = np.random.default_rng(n)
    values, others = rng.integers(-(1 << 63), 1 << 63, n), rng.integers(0, 1 << 64, 1 << 17, dtype=np.uint64)
    rows = spark.createDataFrame([(int(x),) for x in values], "v long")
    table = c.hash_filter(rows, "v", bits, n)
    assert table.probes == c.probes_for(bits, n)
    assert c.passes(table, values.view(np.uint64)).all()
    assert rate * 0.5 <= c.passes(table, others).mean() <= rate


def test_rate_of_a_filter_of_small_hashes(spark):
    """Hashes that were chosen for being small share their first bits; a filter is as good for them as for others."""
    rng = np.random.default_rng(5)
    values, others = (rng.integers(0, 1 << 64, (n, 24), dtype=np.uint64).min(axis=1) for n in (1 << 12, 1 << 16))
    table = c.hash_filter(spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "v long"), "v", 16, len(values))
    assert c.passes(table, values).all()
    assert c.passes(table, others).mean() <= 0.008


def test_join_one_and_with_first(spark):
    rows = spark.createDataFrame([("hot", k) for k in range(500)] + [("b", 1), ("none", 2)], "key string, n long")
    other = spark.createDataFrame([("hot", 7), ("b", 8)], "key string, value long")
    got = c.join_one(rows, other, ["key"], rows["n"]).collect()
    assert sorted((r.key, r.n, r.value) for r in got) == sorted([("hot", k, 7) for k in range(500)] + [("b", 1, 8)])
    led = c.with_first(rows, ["key"], rows["n"], rows["n"]).collect()
    assert {(r.key, r["first"], r.many) for r in led} == {("hot", 0, 500), ("b", 1, 1), ("none", 2, 1)}
