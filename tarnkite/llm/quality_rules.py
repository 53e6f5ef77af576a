"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are boosted on a bounded sample of labelled rows; each path from a
root to a node is a rule, a conjunction of comparisons. A lasso logistic
regression gives most rules weight 0. The rest become Spark column
expressions, so scoring a corpus is one scan without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c
from . import _tokens as t

STATISTICS = ("log_words", "word_length", "upper", "digits", "marks", "bangs", "bars", "stops", "commas", "high", "breaks", "short_words", "repeats", "distinct")
#: Labelled rows that the rules are fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LASSO = 30, 3, 24, 0.3, 2e-3


def byte_class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = byte_class(bytes(range(65, 91))), byte_class(bytes(range(48, 58)))
_LETTER = _UPPER | byte_class(bytes(range(97, 123))) | byte_class(bytes(range(128, 256)))
_CLASSES = {"digits": _DIGIT, "marks": byte_class(b"#$%&*@^~=<>{}[]\\_"), "bangs": byte_class(b"!?"), "bars": byte_class(b"|"), "stops": byte_class(b"."), "commas": byte_class(b",;:"), "high": byte_class(bytes(range(128, 256))), "breaks": byte_class(b"\n")}


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; a text without words has zeros."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for low, high in t.slices(texts):
        raw, at = t.text_bytes(texts.slice(low, high - low))
        begin, end, doc = t.words(raw, at)
        n = np.bincount(doc, minlength=high - low)
        some = np.maximum(n, 1)
        within = lambda kind: np.diff(np.concatenate([[0], np.cumsum(kind[raw])])[at])  # noqa: B023, E731
        found = {"log_words": np.log2(some), "word_length": np.bincount(doc, end - begin, high - low) / some, "upper": within(_UPPER) / np.maximum(1, within(_LETTER)), "short_words": np.bincount(doc, end - begin <= 3, high - low) / some}
        found |= {k: within(kind) / some for k, kind in _CLASSES.items()}
        hashes = t.word_hashes(raw, begin, end)
        again = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        found["repeats"] = np.bincount(doc[1:][again], minlength=high - low) / some
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        found["distinct"] = np.bincount(doc, new, high - low) / some
        out[low:high] = np.stack([found[k] for k in STATISTICS], 1) * (n > 0)[:, None]
    return out


@F.arrow_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in STATISTICS]))
def text_statistics(texts: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(x) for x in np.ascontiguousarray(statistics(texts).T)], list(STATISTICS))


#: (statistic, True for "above", threshold), all of which must hold.
Rule = tuple[tuple[int, bool, float], ...]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) == above
    return out


def grown(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, cuts: list[np.ndarray], rule: Rule, rows: np.ndarray) -> list[tuple[Rule, float, bool]]:
    """The nodes below `rule`: their rules, Newton steps, and whether they are leaves."""
    gain, best = 1e-6, None
    if len(rule) < DEPTH and len(rows) >= 10:
        score = lambda g, h: g * g / (h + 1.0)
        g, h = slope[rows], curve[rows]
        for k, marks in enumerate(cuts):
            if not len(marks):
                continue
            cell = np.searchsorted(marks, x[rows, k], "left")  # a value at a cut is not above it
            below_g, below_h = (np.cumsum(np.bincount(cell, w, len(marks) + 1))[:-1] for w in (g, h))
            many = np.cumsum(np.bincount(cell, minlength=len(marks) + 1))[:-1]
            gains = score(below_g, below_h) + score(g.sum() - below_g, h.sum() - below_h) - score(g.sum(), h.sum())
            gains[(many < 5) | (len(rows) - many < 5)] = 0
            if gains.max() > gain:
                gain, best = float(gains.max()), (k, float(marks[int(gains.argmax())]))
    step = float(slope[rows].sum() / (curve[rows].sum() + 1.0))
    if best is None:
        return [(rule, step, True)]
    nodes = [(rule, step, False)] if rule else []
    for above in (False, True):
        side = rows[(x[rows, best[0]] > best[1]) == above]
        nodes += grown(x, slope, curve, cuts, (*rule, (best[0], above, best[1])), side)
    return nodes


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class RuleModel:
    base: float
    rules: list[tuple[Rule, float]]

    def score(self, statistics: str = "statistics") -> Column:
        """Score between 0 and 1 from the named column of statistics: the compiled rules."""
        total = F.lit(float(self.base))
        for rule, weight in self.rules:
            test = F.lit(True)
            for k, above, cut in rule:
                value = F.col(f"{statistics}.{STATISTICS[k]}")
                test &= value > cut if above else value <= cut
            total += F.when(test, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleModel:
    """Boost trees, take their rules, fit lasso logistic weights (accelerated proximal steps).

    Without rows the score is 0.5; with one class it is that class's smoothed share.
    """
    if not len(y):
        return RuleModel(0.0, [])
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return RuleModel(base, [])
    draw = np.random.default_rng(seed)
    cuts = []
    for k in range(x.shape[1]):
        marks = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)))
        cuts.append((marks[1:] + marks[:-1]) / 2 if len(marks) > 1 else marks[:0])
    z, found = np.full(len(y), base), {}
    for _ in range(TREES):
        rows = np.flatnonzero(draw.random(len(y)) < 0.5)
        p = sigmoid(z)
        for rule, step, leaf in grown(x, y - p, p * (1 - p), cuts, (), rows):
            if rule:
                found[tuple(sorted(rule))] = None
            if leaf:
                z = z + RATE * step * holds(rule, x)
    rules = list(found)
    # Rules that hold for the same rows are one; bits are compared, for the driver's memory.
    a = np.stack([holds(r, x) for r in rules], 1) if rules else np.zeros((len(y), 0), bool)
    kept = np.sort(np.unique(np.packbits(a, axis=0), axis=1, return_index=True)[1]) if rules else np.zeros(0, int)
    a, rules = a[:, kept].astype(float), [rules[k] for k in kept]
    w = v = np.zeros(a.shape[1])
    b = u = base
    scale, t0 = 0.25 * (1 + np.linalg.norm(a, 2) ** 2 / len(y)) if rules else 1.0, 1.0
    for _ in range(400):
        off = sigmoid(a @ v + u) - y
        new_w = v - (a.T @ off / len(y)) / scale
        new_w = np.sign(new_w) * np.maximum(0, np.abs(new_w) - LASSO / scale)
        new_b = u - off.mean() / scale
        t1 = (1 + np.sqrt(1 + 4 * t0 * t0)) / 2
        v, u = new_w + (t0 - 1) / t1 * (new_w - w), new_b + (t0 - 1) / t1 * (new_b - b)
        w, b, t0 = new_w, new_b, t1
    return RuleModel(float(b), [(rules[k], float(w[k])) for k in np.flatnonzero(w)])


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """Rules from at most `sample` labelled rows.

    Labels are bounded before the join, by hashes of their ids, and rows after
    it, by hashes of id and text; of rows that repeat an id, a text and a label
    one counts.
    """
    c.bounded_batches(docs.sparkSession)
    wanted = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("doc_id", "quality", F.xxhash64("doc_id", "text").alias("mark"), text_statistics("text").alias("s"))
    rows = rows.dropDuplicates(["doc_id", "quality", "mark"]).orderBy("mark", "doc_id", "quality").limit(sample)
    got = sorted(rows.select("doc_id", "quality", "s.*").collect())
    x = np.array([r[2:] for r in got], float).reshape(len(got), len(STATISTICS))
    return fit_rules(x, np.array([r[1] for r in got], float))


def score_quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    """docs with `statistics` and `score`; texts without words, and null ones, have zeros as statistics."""
    return docs.withColumn("statistics", text_statistics("text")).withColumn("score", model.score())


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The quality of each document.

    docs: doc_id, text; labels: doc_id, quality (1, 0; other values are no
    labels; a row for each vote); further columns are ignored. Returns a row
    for each row of docs: doc_id, held_out (null ids: false), score (0 to 1),
    predicted (1 where score >= 0.5). Equal texts have equal scores. Without
    usable labels every score is 0.5. An empty table gives none.
    """
    scored = score_quality(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without those that the classifier rejects."""
    model, name = train(docs, labels), c.unused(docs.columns, "statistics")
    return docs.withColumn(name, text_statistics("text")).where(model.score(name) >= 0.5).drop(name)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """classify() of all documents by the labels; it says what holds for nulls, empty texts, ties and repeated rows."""
    return classify(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels"))
