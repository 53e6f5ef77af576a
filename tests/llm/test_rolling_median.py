import datetime
import random

import numpy as np
import pytest

from tarnkite.llm import rolling_median as rm

MINUTE = 60_000_000
START = datetime.datetime(2024, 1, 1)
SCHEMA = "click_id long, ts timestamp_ntz, kind string, value double, median2 int, n int, pid int, far string"


def doubled(xs):
    xs = sorted(xs)
    return xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]


def brute(rows, span):
    once = {}
    for i, ts, kind, value in rows:
        if ts is not None:
            c = None if value is None or value != value else int(np.floor(100 * value + 0.5))
            once.setdefault(i, (ts, kind, c))
    out = []
    for i, (ts, kind, own) in once.items():
        xs = [c for t, k, c in once.values() if k == kind and ts - datetime.timedelta(microseconds=span) < t <= ts and c is not None]
        if not xs:
            out.append((i, kind, 0, None, None, None))
            continue
        m = doubled(xs)
        mad = doubled([abs(2 * x - m) for x in xs])
        out.append((i, kind, len(xs), m, mad, None if own is None else 2 * abs(2 * own - m) > 2 * mad))
    return sorted(out, key=repr)


def clicks(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA).repartition(parts)


def found(df):
    assert df.columns == ["click_id", "kind", "n", "median2", "mad4", "far"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(n, minutes, seed, kinds=("a", "b", None), spread=1000, same=0.1):
    draw, rows, at = random.Random(seed), [], START
    for i in range(n):
        if draw.random() > same:
            at = START + datetime.timedelta(microseconds=draw.randrange(minutes * MINUTE))
        value = None if draw.random() < 0.05 else round(draw.choice((draw.gauss(0, 1), draw.gauss(spread, 5), draw.choice((1.0, 2.0)))), 2)
        rows.append((i, at, draw.choices(kinds, [8, *[1] * (len(kinds) - 1)])[0], value))
    return rows + rows[::17]


@pytest.fixture
def width(spark):
    def put(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))

    yield put
    put(4)


@pytest.mark.parametrize(("n", "minutes", "tiles"), [(700, 600, 4), (900, 60, 7), (900, 10, 40), (600, 1, 60)])
def test_against_brute_force(spark, width, n, minutes, tiles):
    """From windows inside a tile to windows over all of some forty tiles."""
    width(tiles)
    rows = made(n, minutes, n + tiles)
    assert found(rm.rolling_median(clicks(spark, rows))) == brute(rows, rm.SPAN)


def test_one_time_over_many_tiles(spark, width):
    width(20)
    draw = random.Random(5)
    rows = [(i, START, "a", float(draw.randrange(30))) for i in range(300)]
    rows += [(1000 + i, START + datetime.timedelta(minutes=i % 40, microseconds=i % 3), "a", draw.random()) for i in range(300)]
    assert found(rm.rolling_median(clicks(spark, rows))) == brute(rows, rm.SPAN)


def test_edges_of_windows_nulls_and_broken_rows(spark):
    later = lambda us: START + datetime.timedelta(microseconds=us)
    rows = [(1, later(0), "a", 0.005), (2, later(rm.SPAN - 1), "a", -0.005), (3, later(rm.SPAN), "a", 7.0), (4, later(rm.SPAN), "a", None)]
    rows += [(5, None, "a", 1.0), (5, later(3 * rm.SPAN), "a", 1.0), (6, later(0), None, 2.5), (7, later(1), "", float("nan")), (None, later(2), "q", 1.0), (None, later(2), "q", 1.0)]
    rows += [(8, later(9), "z", float("inf")), (9, later(9), "z", 1e18)]
    got = found(rm.rolling_median(clicks(spark, rows)))
    assert got == brute([r for r in rows if r[0] not in (8, 9)] + [(8, later(9), "z", None), (9, later(9), "z", None)], rm.SPAN)
    assert [r[2] for r in got if r[0] == 3] == [2]


def test_empty_table(spark):
    assert found(rm.rolling_median(clicks(spark, [(1, START, "a", 1.0)]).limit(0))) == []
    assert found(rm.rolling_median(clicks(spark, [(1, None, "a", 1.0)]))) == []


def test_table_against_sorting():
    draw = np.random.default_rng(3)
    for m in (1, 7, 300, 9000):
        values = np.round(draw.normal(0, 40, m)).astype(np.int64)
        table = rm.Table(values, np.array([5, -3]), np.array([4, 2]))
        low = draw.integers(0, m + 1, 50)
        high = np.minimum(m, low + draw.integers(0, m + 1, 50))
        table.open(low, high)
        for k, (a, b) in enumerate(zip(low, high, strict=True)):
            window = np.sort(np.concatenate([values[a:b], [5] * 4, [-3] * 2]))
            assert table.n[k] == len(window)
        rank = draw.integers(1, table.n + 1)
        want = [np.sort(np.concatenate([values[a:b], [5] * 4, [-3] * 2]))[r - 1] for a, b, r in zip(low, high, rank, strict=True)]
        assert table.sorted[table.pick(rank)].tolist() == want
        radius = table.radius(np.full(50, 3), rank)
        want = [np.sort(np.abs(2 * np.concatenate([values[a:b], [5] * 4, [-3] * 2]) - 3))[r - 1] for a, b, r in zip(low, high, rank, strict=True)]
        assert radius.tolist() == want
