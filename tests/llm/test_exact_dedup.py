import hashlib
import re

from tarnkite.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append((i is None, i or 0, k, i))
    out = []
    for norm, members in groups.items():
        first = min(members)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[3], first[3], len(members), m == first, sha) for m in members]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_against_brute_force(spark, docs, prose):
    rows = [(k, prose(20, k % 7)) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "\t\n"), (104, "a b"), (90, "a \n b"), (91, "a  b"), (105, " a b"), (106, "A b"), (107, "a b"), (108, "x" * 200_000)]
    for width in (1, 3, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(width))
        assert found(exact_dedup(docs(rows).repartition(5))) == brute(rows)
        assert found(exact_dedup(docs(rows).repartition(5), fan_bits=1)) == brute(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repeated_rows_and_null_ids(docs):
    rows = [(5, "same"), (5, "same"), (None, "same"), (7, "same"), (None, "alone")]
    got = found(exact_dedup(docs(rows)))
    assert sum(r[3] for r in got) == 2
    assert {r[1] for r in got if r[2] == 4} == {5}
    assert (None, None, 1, True) in {r[:4] for r in got}


def test_empty_table(docs):
    assert exact_dedup(docs([(1, "a")]).limit(0)).count() == 0
