import itertools
import re

import pytest

from tarnkite.llm import decontaminate as d


ALONE = "[\u3000-\u9fff\uf000-\uffff\U00010000-\U0010ffff]"


def tokens(text):
    return re.findall(f"{ALONE}|[a-z0-9\u0080-\u2fff\ua000-\uefff]+", text.translate({k: k + 32 for k in range(65, 91)}))


def brute(docs, items):
    out = set()
    for i, text in docs:
        own = tokens(text or "")
        for j, item in items:
            want = tokens(item or "")
            if not want:
                continue
            window, least = d.needed(len(want))
            for shift in range(-len(want), len(own) + 1):
                same = [0 <= shift + k < len(own) and own[shift + k] == want[k] for k in range(len(want))]
                if any(sum(same[k : k + window]) >= least for k in range(len(want) - window + 1)):
                    out.add((i, j))
    return out


@pytest.mark.parametrize("n", range(d.LEAST, d.WINDOW + 1))
def test_masks_hit_every_stretch(n):
    window, least = d.needed(n)
    masks = [*d.MASKS, *([d.SHORT_MASK] if n < d.SHORT else [])]
    for off in itertools.combinations(range(n), window - least):
        assert any(all(bit == "0" or k + at not in off for k, bit in enumerate(mask)) for mask in masks for at in range(n - len(mask) + 1))


def test_against_brute_force(spark, docs, prose):
    items = [(k, prose(8 + k * 3, 1000 + k)) for k in range(16)] + [(50, ""), (51, None), (52, "too short"), (53, "Lone"), (54, prose(7, 54)), (3, prose(17, 1003))]
    items += [(60, "机器学习是人工智能的一个分支，研究算法。"), (61, "短句"), (62, "éü ßß")]
    rows = []
    for k in range(120):
        own, item = prose(30, k).split(), items[k % 16][1].split()
        for off in range(k % 7):
            item[(off * 5 + k) % len(item)] = "other"
        if k % 3:
            own[10:10] = item[: len(item) - (k % 5) * 2]
        rows.append((k, " ".join(own).upper() if k % 2 else ", ".join(own)))
    rows += [(500, None), (501, ""), (502, items[9][1]), (502, items[9][1]), (None, items[4][1]), (503, "w " * 30_000 + items[7][1])]
    rows += [(510, f"{prose(5, 1)} too, Short {prose(5, 2)}"), (511, "tooshort and alone"), (512, prose(9, 3) + " " + items[20][1]), (513, prose(7, 54).rsplit(" ", 1)[0])]
    rows += [(520, "他说机器学习是人工智能的一条分支，研究算法。很好"), (521, "机器学习的短句"), (522, "短 句"), (523, "短x句"), (524, "Éü ßß"), (525, "xéü ßß"), (526, "lone😀")]
    bench = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, matched int")
    want = brute(rows, items)
    assert 40 < len(want)
    for size in (1 << 21, 500):
        got = d.contaminated(docs(rows), bench, block_bytes=size)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
        clean = d.without_contaminated(docs(rows), bench, block_bytes=size)
        assert clean.columns == docs(rows).columns
        assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(docs([(1, "a")]), none).count() == 0
    assert d.without_contaminated(docs([(1, "a")]), none).count() == 1
    assert d.contaminated(docs([(1, "a")]).limit(0), spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")).count() == 0


def test_repetitive_texts_take_bounded_memory(spark, docs, monkeypatch):
    monkeypatch.setattr(d, "PAIRS_AT_ONCE", 1000)
    items = [(1, "la " * 40), (2, "la " * 3 + "end"), (3, "la lo " * 12)]
    rows = [(1, "la " * 3000), (2, "la " * 500 + "end"), (3, "lo la " * 300), (4, "lo " * 100)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    for size in (1 << 21, 10):
        got = d.contaminated(docs(rows), bench, block_bytes=size).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert len(got) == len(want)


def test_both_ways_tell_the_same(spark, docs, prose):
    items = [(k, prose(12 + k, 1000 + k)) for k in range(12)] + [(20, "very rare words")]
    rows = [(k, f"{prose(20, k)} {' '.join(items[k % 12][1].split()[k % 4:])} {prose(9, 40 + k)}") for k in range(60)] + [(70, "some very rare words"), (70, "some very rare words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    told = [sorted(map(tuple, d.contaminated(docs(rows), bench, block_bytes=size).collect())) for size in (1 << 21, 10)]
    assert told[0] == told[1]
    assert len(told[0]) > 60


def test_every_short_item_has_its_own_mask():
    assert [d.masks_for(n) for n in (0, 1, 7)] == [[], ["1"], ["1" * 7]]
    assert [d.needed(n) for n in (1, 7, 8, 20, 50)] == [(1, 1), (7, 7), (8, 7), (20, 16), (20, 16)]
