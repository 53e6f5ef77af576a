"""Substring dedup by suffix trees that variable-length prefixes keep apart.

The suffixes of all texts begin at their words, and only their first RUN words
matter. Each suffix is filed under a prefix of its own: its words up to the end
of its anchor, the run of GRAM words with the least hash among those inside its
first RUN words. The prefix is from GRAM to RUN words long, equal suffixes have
equal prefixes, and neighbouring suffixes share an anchor, so one row files all
of them. Prefixes that stand in the corpus once have no tree; a filter of
bounded size leaves them out before anything but their hashes is shuffled. The
suffixes under a prefix are a subtree, which one task holds: it sorts them by
the hashes of their first RUN words, and those that meet are under an internal
node of that depth, so that they begin a repeat. A prefix with too many suffixes
for one task is split further: its suffixes are counted by all RUN words, in
parts. In a text, suffixes that begin repeats cover the maximal repeats; the
words that they cover go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c
from . import _tokens as t

#: Words of an anchor, and words from which on a repeat counts.
GRAM, RUN = 16, 35
#: Anchors under one prefix that one task takes whole: at least and at most.
LEAST_GROUP, MOST_GROUP = 256, 1 << 20
#: A text's anchors: the first of the suffixes filed under each, and the hash of each of these suffixes' first RUN words.
FILED = "prefix long, doc binary, at int, heads array<long>"


def summed(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` words."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * t._SLOT[k]
    return t.mixed(total)


def anchors(hashes: np.ndarray, doc: np.ndarray, gram: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the anchors of all texts: the prefix's hash, and the first and the number of the suffixes filed under it."""
    grams = summed(hashes, gram)
    n = max(0, len(hashes) - run + 1)
    begin = np.flatnonzero(doc[:n] == doc[run - 1 :]) if n else np.zeros(0, np.int64)
    best, least = np.arange(n), grams[:n].copy()
    for k in range(1, run - gram + 1):
        less = np.flatnonzero(grams[k : k + n] < least)
        best[less] = less + k
        np.minimum(least, grams[k : k + n], out=least)
    best = best[begin]
    # Suffixes of one text that share an anchor stand in a row.
    first = np.flatnonzero((np.diff(best, prepend=-1) != 0) | (np.diff(doc[begin], prepend=-1) != 0))
    many = np.diff(np.append(first, len(begin)))
    return grams[best[first]], begin[first], many


def texts_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a batch: its rows, and the hash, text number and first word's number of all its words."""
    texts = batch.column(column)
    for low, high in t.slices(texts):
        raw, at = t.text_bytes(texts.slice(low, high - low))
        begin, end, doc = t.words(raw, at)
        yield low, high, t.word_hashes(raw, begin, end, fold=False), doc, np.searchsorted(doc, np.arange(high - low))


def prefixes(gram: int, run: int):
    """For mapInArrow over (text): prefix, n of a piece's anchors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, hashes, doc, _ in texts_of(batch, 0):
                found, n = np.unique(anchors(hashes, doc, gram, run)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["prefix", "n"])

    return scan


def filed(shared, large, gram: int, run: int, of_large: bool):
    """For mapInArrow over (doc, text): a row of FILED for each anchor that the filter lets through and that is under a large prefix, or not."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, hashes, doc, word0 in texts_of(batch, 1):
                prefix, begin, many = anchors(hashes, doc, gram, run)
                keep = np.flatnonzero(np.isin(prefix, large.value) if of_large else c.passes(shared.value, prefix) & ~np.isin(prefix, large.value))
                if not len(keep):
                    continue
                begin, many = begin[keep], many[keep]
                spots = t.spans_of(begin, begin + many)
                heads = np.zeros(len(spots), np.uint64)
                for k in range(run):
                    heads += hashes[spots + k] * t._SLOT[k]
                cut = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
                docs = batch.column(0).slice(low, high - low).take(pa.array(doc[begin]))
                heads = pa.ListArray.from_arrays(pa.array(cut), pa.array(t.mixed(heads).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(prefix[keep].view(np.int64)), docs, pa.array((begin - word0[doc[begin]]).astype(np.int32)), heads], ["prefix", "doc", "at", "heads"])

    return scan


def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over FILED sorted by prefix: doc, at, bits: which of the suffixes of a row, from `at` on, begin a repeat."""
    held: list[pa.RecordBatch] = []

    def tree(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = rows.column("heads").combine_chunks()
        heads, cut = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        prefix = np.repeat(rows.column("prefix").to_numpy(), np.diff(cut))
        order = np.argsort(heads, kind="stable")  # under equal heads, rows stay sorted by prefix
        meet = (heads[order][1:] == heads[order][:-1]) & (prefix[order][1:] == prefix[order][:-1])
        deep = np.zeros(len(heads), bool)
        deep[order[1:][meet]] = deep[order[:-1][meet]] = True
        row = np.repeat(np.arange(rows.num_rows), np.diff(cut))
        bits = np.bincount(row, deep * (2.0 ** (np.arange(len(heads)) - cut[row])), rows.num_rows).astype(np.int64)
        some = pa.array(np.flatnonzero(bits))
        yield pa.RecordBatch.from_arrays([rows.column("doc").combine_chunks().take(some), rows.column("at").combine_chunks().take(some), pa.array(bits).take(some)], ["doc", "at", "bits"])

    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(0)[-1]
        cut = int(np.searchsorted(batch.column(0).to_numpy(), last.as_py(), "left"))
        if cut or (held and held[0].column(0)[0] != last):
            held.append(batch.slice(0, cut))
            yield from tree(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from tree(pa.Table.from_batches(held))


def repeats(docs: DataFrame, gram: int, run: int, most: int = MOST_GROUP) -> DataFrame:
    """doc, at, bits: the suffixes, by their first word's number, that begin a repeat; bit k stands for the suffix `at` + k.

    docs: doc, text. A row has at most run - gram + 1 suffixes, which must be under 53.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    counts = docs.select("text").mapInArrow(prefixes(gram, run), "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    twice = c.staged(counts.where("n > 1"), "prefixes")
    total, distinct = twice.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shared = context.broadcast(c.hash_filter(twice, "prefix", c.filter_bits(distinct), distinct))
    # So few prefixes have more anchors than this that they can be broadcast: four for each partition, or one for each million anchors.
    limit = min(most, max(LEAST_GROUP, total // (4 * c.shuffle_width(spark))))
    large = context.broadcast(twice.where(F.col("n") > limit).toArrow().column("prefix").to_numpy().view(np.uint64))
    small = docs.select("doc", "text").mapInArrow(filed(shared, large, gram, run, False), FILED)
    found = small.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(subtrees, "doc binary, at int, bits long")
    if not len(large.value):
        return found
    split = docs.select("doc", "text").mapInArrow(filed(shared, large, gram, run, True), FILED)
    split = split.select("prefix", "doc", "at", F.posexplode("heads").alias("k", "head"))
    deep = split.groupBy("prefix", "head").agg(F.count("*").alias("n")).where("n > 1").select("prefix", "head")
    deep = c.join_one(split, deep, ["prefix", "head"], F.col("doc"))
    return found.unionByName(deep.select("doc", (F.col("at") + F.col("k")).alias("at"), F.lit(1).cast("long").alias("bits")))


def cleaned(run: int):
    """For mapInArrow over (doc_id, text, spots): doc_id, text without the words that repeats cover, n_words, n_removed, spans, kept_sha256."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row, text in enumerate(batch.column(1).cast(pa.large_binary()).to_pylist()):
                words = (text or b"").split()  # at the six ASCII white spaces
                spans: list[dict] = []
                gone = np.zeros(len(words) + 1, np.int64)
                spots = batch.column(2)[row]
                if spots.is_valid and len(spots):
                    at, bits = (spots.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                    which, k = np.nonzero((bits[:, None] >> np.arange(int(bits.max()).bit_length())) & 1)
                    starts = np.unique(at[which] + k)
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + run, -1)
                covered = np.cumsum(gone[:-1]) > 0
                edges = np.flatnonzero(np.diff(covered, prepend=False, append=False))
                spans = [{"from": a, "to": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
                kept = b" ".join(compress(words, (~covered).tolist()) if spans else words)
                for column, value in zip(out, (kept.decode() if text is not None else None, len(words), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            kinds = (pa.large_string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kind) for x, kind in zip(out, kinds, strict=True))], ["doc_id", "text", "n_words", "n_removed", "spans", "kept_sha256"])

    return scan


def dedup_substrings(docs: DataFrame, gram: int = GRAM, run: int = RUN, most: int = MOST_GROUP) -> DataFrame:
    """doc_id, text, n_words, n_removed, spans, kept_sha256 of each row of docs (doc_id, text; further columns are ignored).

    Words are what is between ASCII white space, unchanged. Each word goes that
    is in a run of `run` words of its text which also begins anywhere else, in
    another row or in the same one; all places of a repeat go. text is what is
    left, joined by one space; spans are the numbers of the words that went
    (from, to exclusive), kept_sha256 is of text in UTF-8. Null texts stay null,
    have no words and the digest of the empty text; texts of fewer than `run`
    words stay whole. Rows that repeat an id and a text are two rows, so they
    repeat each other. An empty table gives none.
    """
    spark = docs.sparkSession
    c.bounded_batches(spark)
    keyed = docs.select("doc_id", "text", c.doc_key().alias("doc"))
    found = repeats(keyed, gram, run, most).groupBy("doc").agg(F.collect_set(F.struct("at", "bits")).alias("spots"))
    both = keyed.join(found, "doc", "left").select("doc_id", "text", "spots")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(cleaned(run), f"doc_id {kind}, text string, n_words long, n_removed long, spans array<struct<`from`:int,`to`:int>>, kept_sha256 string")


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """dedup_substrings() of all documents; it says what holds for nulls, short texts and repeated rows."""
    return dedup_substrings(c.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP12_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM t WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM s),
r AS (SELECT doc_id, list(i ORDER BY i) AS spots FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1 GROUP BY 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM (SELECT doc_id, unnest(spots) AS i FROM r)),
gone AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM t),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN g USING (doc_id, k) GROUP BY 1)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
