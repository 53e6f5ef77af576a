"""Benchmark decontamination by spaced seeds.

Each mask fixes which tokens of a window count and which are ignored; the
hashes of all windows of the benchmark are joined with those of all windows of
the training texts, so a hit survives substitutions at ignored places. Around
each hit the item is laid on the document and compared token by token: it counts
as contaminated when, in some stretch of WINDOW tokens (or the whole item, if
shorter), at least SHARE of the tokens are equal. MASKS hit every such stretch,
wherever its substitutions are (tests try them all). Items of fewer than LEAST
tokens must be there whole and exactly.

A benchmark of up to BLOCK_BYTES of text is broadcast as an index, and the join
is a lookup; the seeds of a larger one are shuffled and joined with the seeds of
the documents that pass a filter of bounded size. Either way the documents are
read and tokenised once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c
from . import _tokens as t

MASKS = ("1101111", "1100010111", "1001110101")
#: Also for items of fewer than SHORT tokens, where fewer windows fit.
SHORT_MASK, SHORT = "111", 17
WINDOW, SHARE = 20, 0.8
#: Items with fewer tokens match as a whole only.
LEAST = 8
#: Bytes of benchmark text that are broadcast, at most; its index takes about fifteen times as much.
BLOCK_BYTES = 1 << 22
#: Pairs of a place and an item that are held at once.
PAIRS_AT_ONCE = 1 << 20
_BITS = 22

PAIRS = "item_id long, n_tokens int, matched int, window int, at long"
SEEDS = "seed long, again long, item long, place int"


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts, and where each text's begin (one more place than texts)."""
    raw, at = t.text_bytes(texts)
    begin, end, doc = t.words(raw, at, "characters")
    return t.word_hashes(raw, begin, end), np.searchsorted(doc, np.arange(len(texts) + 1))


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window of the tokens under the mask."""
    n = len(hashes) - len(mask) + 1
    total = np.full(max(n, 0), int(mask, 2), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1" and n > 0:
            total += hashes[k : k + n] * t._SLOT[k]
    return t.mixed(total)


def masks_for(length: int) -> list[str]:
    """The masks under which an item of so many tokens is looked for."""
    if length < LEAST:
        return ["1" * length] if length else []
    return [*MASKS, *([SHORT_MASK] if length < SHORT else [])]


def item_seeds(tokens: np.ndarray, first: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """For each mask in use: the seeds of the items that it is for, and their places."""
    length = np.diff(first)
    item = np.repeat(np.arange(len(length)), length)
    for mask in sorted({m for n in np.unique(length).tolist() for m in masks_for(n)}):
        of = item[: max(0, len(item) - len(mask) + 1)]
        good = of == item[len(mask) - 1 :][: len(of)]
        good &= np.array([mask in masks_for(n) for n in range(int(length.max()) + 1)])[length[of]]
        yield mask, seeds(tokens, mask)[good], np.flatnonzero(good)


def needed(n: int) -> tuple[int, int]:
    """Length of the stretch for an item of n tokens, and how many must be equal."""
    window = min(n, WINDOW)
    return window, n if n < LEAST else int(np.ceil(round(window * SHARE, 6)))


def best_stretch(item: np.ndarray, tokens: np.ndarray, start: int) -> tuple[int, int] | None:
    """The most equal tokens in a stretch of the item, laid on tokens at start, and the stretch's place in tokens; none if too few."""
    window, least = needed(len(item))
    low, high = max(start, 0), min(start + len(item), len(tokens))
    equal = np.zeros(len(item) + 1, np.int64)
    equal[low - start + 1 : high - start + 1] = item[low - start : high - start] == tokens[low:high]
    sums = np.cumsum(equal)
    score = sums[window:] - sums[:-window]
    k = int(score.argmax())
    return (int(score[k]), start + k) if score[k] >= least else None


class Index:
    """The windows of benchmark items."""

    def __init__(self, ids: list, texts: list) -> None:
        self.tokens, self.first = token_hashes(pa.array(texts, pa.large_string()))
        self.ids = ids
        self.tables = []
        for mask, found, place in item_seeds(self.tokens, self.first):
            order = np.argsort(found, kind="stable")
            there = np.zeros(1 << _BITS, bool)
            there[found >> np.uint64(64 - _BITS)] = True
            place = place[order]
            of = np.searchsorted(self.first, place, "right") - 1
            self.tables.append((mask, there, found[order], place - self.first[of], of))

    def candidates(self, tokens: np.ndarray) -> Iterator[np.ndarray]:
        """(item, place in tokens where the item would begin) of each hit, once in each part of bounded size."""
        hits = []
        for k, (mask, there, found, _, _) in enumerate(self.tables):
            own = seeds(tokens, mask)
            p = np.flatnonzero(there[own >> np.uint64(64 - _BITS)])
            low, high = np.searchsorted(found, own[p], "left"), np.searchsorted(found, own[p], "right")
            hits.append(np.stack([p, np.full(len(p), k), low, high])[:, high > low])
        if not hits:
            return
        p, table, low, high = (x := np.concatenate(hits, 1))[:, np.argsort(x[0], kind="stable")]
        part = (np.cumsum(high - low) - 1) // PAIRS_AT_ONCE
        for k in np.unique(part).tolist():
            here, pairs = part == k, []
            for m, (_, _, _, place, of) in enumerate(self.tables):
                one = here & (table == m)
                which = t.spans_of(low[one], high[one])
                pairs.append(np.stack([of[which], np.repeat(p[one], (high - low)[one]) - place[which]], 1))
            yield np.unique(np.concatenate(pairs), axis=0)

    def matches(self, tokens: np.ndarray, first: np.ndarray) -> list[tuple]:
        """(text number, item_id, n_tokens, matched, window, at) of the contaminated texts; first: where each text's tokens begin."""
        best: dict[tuple[int, int], tuple] = {}
        for part in self.candidates(tokens):
            for item, start in part.tolist():
                own = self.tokens[self.first[item] : self.first[item + 1]]
                low, high = max(start, 0), min(start + len(own), len(tokens))
                # Several short texts may lie under one item; each is judged alone.
                for doc in range(int(np.searchsorted(first, low, "right")) - 1, int(np.searchsorted(first, high - 1, "right"))):
                    found = best_stretch(own, tokens[first[doc] : first[doc + 1]], start - int(first[doc]))
                    if found:
                        row = (found[0], -found[1])
                        best[doc, item] = max(best.get((doc, item), row), row)
        sizes = np.diff(self.first)
        return [(doc, self.ids[item], int(sizes[item]), m, needed(int(sizes[item]))[0], -p) for (doc, item), (m, p) in sorted(best.items())]


def broadcast_index(benchmark: DataFrame, block_bytes: int) -> Index | None:
    """The index of a benchmark of up to block_bytes of text; None of a larger one."""
    rows = benchmark.select("item_id", "text").where("text is not null")
    if (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        return None
    part = rows.orderBy("item_id", "text").collect()
    return Index([r[0] for r in part], [r[1] for r in part])


def text_matches(texts: pa.Array, index: Index) -> Iterator[tuple[int, list[tuple]]]:
    """For each slice of the texts: where it begins, and its matches."""
    for low, high in t.slices(texts):
        yield low, index.matches(*token_hashes(texts.slice(low, high - low)))


def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (item, item_id, text): item, item_id, tokens."""
    for batch in batches:
        tokens, first = token_hashes(batch.column(2))
        arrays = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tokens.view(np.int64)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["item", "item_id", "tokens"])


def seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (item, tokens): rows of SEEDS."""
    for batch in batches:
        for row in range(batch.num_rows):
            tokens = batch.column(1)[row].values.to_numpy().view(np.uint64)
            for _, found, place in item_seeds(tokens, np.array([0, len(tokens)])):
                again = t.mixed(found ^ t._SLOT[20])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(again.view(np.int64)), pa.array(np.full(len(found), batch.column(0)[row].as_py())), pa.array(place.astype(np.int32))], ["seed", "again", "item", "place"])


def document_seeds(masks: Iterable[str], shared):
    """For mapInArrow over (doc, text): the seeds that pass the filter, with their places."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in t.slices(batch.column(1)):
                tokens, first = token_hashes(batch.column(1).slice(low, high - low))
                doc = np.repeat(np.arange(high - low), np.diff(first))
                for mask in masks:
                    found = seeds(tokens, mask)
                    keep = np.flatnonzero((doc[: len(found)] == doc[len(mask) - 1 :][: len(found)]) & c.passes(shared.value, found))
                    keep = keep[c.passes(shared.value, t.mixed(found[keep] ^ t._SLOT[20]))]
                    if len(keep):
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low).take(pa.array(doc[keep])), pa.array(found[keep].view(np.int64)), pa.array((keep - first[doc[keep]]).astype(np.int32))], ["doc", "seed", "at"])

    return scan


def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (doc, text, item, start, tokens) where a document's text leads its candidates: those that match."""
    name, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        docs, texts, items, starts = (batch.column(k).to_pylist() for k in range(4))
        out = []
        for k, doc in enumerate(docs):
            if items[k] is None:
                name, own = doc, token_hashes(pa.array([texts[k]]))[0]
            elif doc == name:
                item = batch.column(4)[k].values.to_numpy().view(np.uint64)
                if found := best_stretch(item, own, starts[k]):
                    out.append((doc, items[k], len(item), found[0], needed(len(item))[0], found[1]))
        if out:
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["doc", "item", "n_tokens", "matched", "window", "at"])


def joined_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc (c.doc_key()) and PAIRS of the contaminated documents, for a benchmark of any size: the seeds of both sides are joined."""
    spark = docs.sparkSession
    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").where("text is not null")
    items = c.staged(rows.mapInArrow(tokenised, "item long, item_id long, tokens array<long>"), "items")
    own = c.staged(items.select("item", "tokens").mapInArrow(seed_rows, SEEDS), "item-seeds")
    marks = own.select("seed").union(own.select("again"))
    many = marks.count()
    shared = spark.sparkContext.broadcast(c.hash_filter(marks, "seed", c.filter_bits(many), many))
    lengths = [r[0] for r in items.select(F.least(F.size("tokens"), F.lit(SHORT))).distinct().collect()]
    masks = sorted({m for n in lengths for m in masks_for(n)})
    keyed = docs.select(c.doc_key().alias("doc"), "text")
    found = keyed.mapInArrow(document_seeds(masks, shared), "doc binary, seed long, at int")
    hits = c.join_one(found, own.select("seed", "item", "place"), ["seed"], F.col("doc"))
    cands = c.staged(hits.select("doc", "item", (F.col("at") - F.col("place")).alias("start")).distinct(), "seed-hits")
    with_tokens = c.join_one(cands, items.select("item", "tokens"), ["item"], F.col("doc"))
    none = [F.lit(None).cast(kind).alias(x) for x, kind in (("item", "long"), ("start", "int"), ("tokens", "array<long>"))]
    texts = c.sieved(keyed, cands.select("doc").distinct()).dropDuplicates(["doc"]).select("doc", "text", *none)
    both = texts.unionByName(with_tokens.select("doc", F.lit(None).cast("string").alias("text"), "item", "start", "tokens"))
    both = both.repartition("doc").sortWithinPartitions("doc", F.col("item").isNotNull())
    good = both.mapInArrow(laid, "doc binary, item long, n_tokens int, matched int, window int, at long")
    best = good.groupBy("doc", "item").agg(F.max(F.struct("matched", -F.col("at"), "n_tokens", "window", "at")).alias("b"))
    best = best.join(items.select("item", "item_id"), "item").select("doc", "item_id", "b.n_tokens", "b.matched", "b.window", "b.at")
    return c.staged(best, "contaminated")


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains.

    docs: doc_id, text; benchmark: item_id, text; further columns are ignored.
    Tokens are runs of letters, digits and non-ASCII characters, A-Z as a-z;
    characters of scripts that set no spaces are tokens of their own. Returns
    doc_id, item_id, n_tokens (of the item), matched (equal tokens in the best
    stretch, the first of those), window (its length), at (its first token in
    the document; the place before it where the item begins earlier). Null and
    empty texts and items without tokens match nothing; items of fewer than
    LEAST tokens match where they are whole; items that repeat give rows that
    repeat, and so do documents; an empty table gives none.
    """
    c.bounded_batches(docs.sparkSession)
    spark, index = docs.sparkSession, broadcast_index(benchmark, block_bytes)
    if index is None:
        found = joined_matches(docs, benchmark)
        return docs.select(c.doc_key().alias("doc"), "doc_id").join(found, "doc").drop("doc")
    shared = spark.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, rows in text_matches(batch.column(1), shared.value):
                if rows:
                    ids = batch.column(0).take(pa.array([low + r[0] for r in rows]))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, kind) for x, kind in zip(list(zip(*rows, strict=True))[1:], (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True))], ["doc_id", "item_id", "n_tokens", "matched", "window", "at"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id long, {PAIRS}")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, all columns, without the documents that contain a benchmark item (by contaminated()'s rule)."""
    c.bounded_batches(docs.sparkSession)
    index = broadcast_index(benchmark, block_bytes)
    if index is None:
        key = c.unused(docs.columns, "doc")
        found = joined_matches(docs, benchmark).select(F.col("doc").alias(key)).distinct()
        return docs.withColumn(key, c.doc_key()).join(found, key, "left_anti").drop(key)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for low, rows in text_matches(batch.column(place), shared.value):
                clean[[low + r[0] for r in rows]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """contaminated() of all documents and the whole benchmark; it says what holds for nulls, short items and repeated rows."""
    return contaminated(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))


_TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{3000}-\x{9fff}\x{f000}-\x{ffff}\x{10000}-\x{10ffff}]|[a-z0-9\x{80}-\x{2fff}\x{a000}-\x{efff}]+')"
#: By all equal tokens of all documents and items, for tables without null or repeated ids; a stretch is best where a token enters it or at the item's start.
OP7_SQL = """
WITH own AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT doc_id, TOKENS AS w FROM documents)),
items AS (SELECT item_id, w, len(w) AS n, least(len(w), 20) AS width FROM (SELECT item_id, TOKENS AS w FROM benchmark)),
item_tokens AS (SELECT item_id, unnest(w) AS token, unnest(range(n)) AS place FROM items),
same AS (SELECT doc_id, item_id, pos - place AS start, place FROM own JOIN item_tokens USING (token)),
counted AS (
  SELECT doc_id, item_id, n, width, start, place, count(*) OVER (PARTITION BY doc_id, item_id, start ORDER BY place RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) AS upto,
         count(*) FILTER (place < width) OVER (PARTITION BY doc_id, item_id, start) AS early
  FROM same JOIN items USING (item_id)),
stretches AS (
  SELECT doc_id, item_id, n, width, start AS spot, early AS matched FROM counted
  UNION ALL SELECT doc_id, item_id, n, width, start + place - width + 1, upto FROM counted WHERE place >= width)
SELECT doc_id, item_id, any_value(n)::INT AS n_tokens, max(matched)::INT AS matched, any_value(width)::INT AS "window", arg_min(spot, -matched * 1000000000 + spot)::BIGINT AS "at"
FROM stretches WHERE matched >= CASE WHEN n < 8 THEN n ELSE ceil(width * 0.8) END GROUP BY doc_id, item_id
""".replace("TOKENS", _TOKENS)
