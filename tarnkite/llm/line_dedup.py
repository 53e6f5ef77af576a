"""Line dedup by winnowing over line hashes.

The lines of a text that have words are its sequence. A gram is a shortest run
of lines with GRAM words from some line on; of the grams inside each window, a
shortest run of RUN words from some line on or up to some line, the one with the
least hash is selected. Two equal windows hold the same grams, so both select
the same one: each repeated run of RUN words or more has a fingerprint in all
its places, and each of its lines is in one of its windows.

Places that share a fingerprint are joined with the first of them, and both are
extended over equal lines in both directions, as far as the windows reach that
selected the print; further lines have prints of their own. Windows inside the
extension go. A window that outlasts it may yet stand at another place, which
must then have the same line where the first place differed: the place chains
on to the first of the places that do. So each round leaves only windows that
need more lines than the one before, until no place has a companion. Lines are
compared by two independent 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as c
from . import _tokens as t

#: Words of a fingerprint, and words from which on a repeated run is deleted.
GRAM, RUN = 25, 50

LINES = "doc binary, id long, lines array<long>, checks array<long>, words array<int>, rows array<int>, prints array<struct<mark:long,spot:int,start:int,windows:int>>"
#: A print's place and the lines around it: `at` is the gram's first line, starts and ends are those of the windows that selected it.
PLACES = "key long, id long, doc binary, spot int, at int, lines array<long>, checks array<long>, rows array<int>, starts array<int>, ends array<int>"
ROUND = PLACES + ", `from` int, `to` int"
PRINT = pa.struct([("mark", pa.int64()), ("spot", pa.int32()), ("start", pa.int32()), ("windows", pa.int32())])


def line_table(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, number of words, number in its text, and text number of each line that has words."""
    begin, end, doc = t.words(raw, at)
    # A line's number: the newlines in its text before it.
    breaks = np.flatnonzero(raw == 10)
    before = np.searchsorted(breaks, begin)
    row = before - np.searchsorted(breaks, at)[doc]
    new = np.ones(len(begin), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(begin))
    place = t.mixed((np.arange(len(begin)) - np.repeat(start, stop - start)).astype(np.uint64))
    hashes = [summed(t.mixed(t.word_hashes(raw, begin, end, lane) ^ place), start, stop) for lane in (0, 1)]
    return *hashes, stop - start, row[start], doc[start]


def summed(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return t.mixed(total[stop] - total[start] + (stop - start).astype(np.uint64))


def chained(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each run hashes[start:end], line by line."""
    out, live, k = np.zeros(len(start), np.uint64), np.arange(len(start)), 0
    while len(live):
        out[live] = t.mixed(out[live] * t._SLOT[0] ^ hashes[start[live] + k])
        k += 1
        live = live[start[live] + k < end[live]]
    return out


def windows_of(words: np.ndarray, doc: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and end of each shortest run of `run` words, in order; both rise."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    place = np.arange(len(words))
    ends = np.searchsorted(total, total[:-1] + run, "left")
    starts = np.searchsorted(total, total[1:] - run, "right") - 1
    on = ends <= np.searchsorted(doc, doc, "right")
    back = starts >= np.searchsorted(doc, doc, "left")
    pairs = np.unique(np.concatenate([place[on] * (len(words) + 1) + ends[on], starts[back] * (len(words) + 1) + place[back] + 1]))
    return pairs // (len(words) + 1), pairs % (len(words) + 1)


def selected(lines: np.ndarray, words: np.ndarray, doc: np.ndarray, gram: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first line of each selected gram, and the first and the number of the windows that selected it."""
    total = np.concatenate([[0], np.cumsum(words)])
    place = np.arange(len(lines))
    ends = np.searchsorted(total, total[:-1] + gram, "left")
    hashes = np.full(len(lines), np.iinfo(np.uint64).max, np.uint64)
    has = ends <= np.searchsorted(doc, doc, "right")
    hashes[has] = chained(lines, place[has], ends[has])
    begins, stop = windows_of(words, doc, run)
    best, value, step = begins.copy(), hashes[begins], 1
    alive = np.arange(len(begins))
    while len(alive):
        at = begins[alive] + step
        alive = alive[(at < stop[alive]) & (ends[np.minimum(at, len(ends) - 1)] <= stop[alive])]
        at = begins[alive] + step
        less = hashes[at] < value[alive]
        best[alive[less]], value[alive[less]] = at[less], hashes[at[less]]
        step += 1
    # The least gram moves on as the window does, so each has its windows in a row.
    first = np.flatnonzero(np.diff(best, prepend=-1))
    return hashes[best[first]], best[first], first, np.diff(np.append(first, len(best)))


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype()) if values.dtype != np.uint64 else values.view(np.int64), kind))


def line_prints(gram: int, run: int):
    """For mapInArrow over (doc, id, text): the lines and fingerprints of the texts that have any."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for low, high in t.slices(texts):
                lines, checks, words, rows, doc = line_table(*t.text_bytes(texts.slice(low, high - low)))
                if not len(lines):
                    continue
                marks, spots, starts, many = selected(lines, words, doc, gram, run)
                bounds = np.searchsorted(doc, np.arange(high - low + 1))
                with_marks = np.searchsorted(doc[spots], np.arange(high - low + 1))
                keep = np.flatnonzero(np.diff(with_marks))
                if not len(keep):
                    continue
                own = bounds[doc[spots]]
                # Windows are counted from the text's first.
                before = np.concatenate([[0], np.cumsum(many)])[with_marks[doc[spots]]]
                prints = pa.StructArray.from_arrays([pa.array(marks.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (spots - own, starts - before, many))], fields=list(PRINT))
                arrays = [lists(lines, bounds, pa.int64()), lists(checks, bounds, pa.int64()), lists(words, bounds, pa.int32()), lists(rows, bounds, pa.int32()), pa.ListArray.from_arrays(pa.array(with_marks.astype(np.int32)), prints)]
                take = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low).take(take), batch.column(1).slice(low, high - low).take(take), *(a.take(take) for a in arrays)], ["doc", "id", "lines", "checks", "words", "rows", "prints"])

    return scan


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and where each row's begin (and the last row's end)."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().astype(np.int64)


def placed(batch: pa.RecordBatch, of: np.ndarray, key: np.ndarray, at: np.ndarray, columns: tuple, begin: np.ndarray, starts: np.ndarray, ends: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    """A batch of ROUND: the rows `of`, each with `many` windows and the lines that these span; starts, ends, at count from begin."""
    cut = np.concatenate([[0], np.cumsum(many)])
    low, high = starts[cut[:-1]], ends[cut[1:] - 1]
    which, line_cut = t.spans_of(begin + low, begin + high), np.concatenate([[0], np.cumsum(high - low)])
    kinds = (pa.int64(), pa.int64(), pa.int32())
    take = pa.array(of)
    none = pa.nulls(len(of), pa.int32())
    names = batch.schema.names
    arrays = [pa.array(key), *(batch.column(names.index(x)).take(take) for x in ("id", "doc", "spot")), pa.array((at - low).astype(np.int32))]
    arrays += [lists(x[which], line_cut, kind) for x, kind in zip(columns, kinds, strict=True)]
    arrays += [lists(x - np.repeat(low, many), cut, pa.int32()) for x in (starts, ends)]
    return pa.RecordBatch.from_arrays([*arrays, none, none], ["key", "id", "doc", "spot", "at", "lines", "checks", "rows", "starts", "ends", "from", "to"])


def surroundings(run: int):
    """For mapInArrow over (doc, id, lines, checks, words, rows, prints): a row of ROUND for each print."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                lines, checks, words, rows = (one.column(k)[0].values.to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5))
                mark, spot, start, many = (one.column(6)[0].values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
                starts, ends = windows_of(words, np.zeros(len(words), np.int64), run)
                which = t.spans_of(start, start + many)
                none = np.zeros(len(spot), np.int64)
                named = pa.RecordBatch.from_arrays([one.column(1).take(pa.array(none)), one.column(0).take(pa.array(none)), pa.array(spot.astype(np.int32))], ["id", "doc", "spot"])
                yield placed(named, np.arange(len(spot)), mark, spot, (lines, checks, rows), none, starts[which], ends[which], many)

    return scan


def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over PLACES and the first place of each (at0, lines0, checks0): the line ranges to delete, and the windows that outlast the extension."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        key, at, at0 = (col[x].to_numpy(zero_copy_only=False) for x in ("key", "at", "at0"))
        key, at, at0 = key.view(np.uint64), at.astype(np.int64), at0.astype(np.int64)
        (lines, begin), (lines0, begin0), (starts, _), (ends, first) = (flat(col[x]) for x in ("lines", "lines0", "starts", "ends"))
        checks, checks0, rows = (flat(col[x])[0] for x in ("checks", "checks0", "rows"))
        size, size0, n = np.diff(begin), np.diff(begin0), len(at)

        def reach(live: np.ndarray, step: int) -> np.ndarray:
            """How many equal lines there are before the grams (step -1), or from them on (1)."""
            out, k = np.zeros(n, np.int64), 0  # noqa: B023
            while len(live):
                off = k if step > 0 else -k - 1
                i, j = at[live] + off, at0[live] + off  # noqa: B023
                live = live[(i >= 0) & (j >= 0) & (i < size[live]) & (j < size0[live])]  # noqa: B023
                i, j = begin[live] + at[live] + off, begin0[live] + at0[live] + off  # noqa: B023
                live = live[(lines[i] == lines0[j]) & (checks[i] == checks0[j])]  # noqa: B023
                k += 1
                out[live] = k
            return out

        back, on = reach(np.arange(n), -1), reach(np.arange(n), 1)
        many = np.diff(first)
        row = np.repeat(np.arange(n), many)
        starts, ends = (x[first[0] : first[-1]].astype(np.int64) for x in (starts, ends))
        more_back, more_on = at[row] - starts > back[row], ends - at[row] > on[row]
        settled = np.flatnonzero(~more_back & ~more_on)
        if len(settled):
            new = np.flatnonzero(np.diff(row[settled], prepend=-1))
            of = row[settled][new]
            low, high = starts[settled][new], ends[settled][np.append(new[1:], len(settled)) - 1]
            none = pa.nulls(len(of), pa.int64())
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [none, col["id"].take(take), col["doc"].take(take), col["spot"].take(take), *(pa.nulls(len(of), kind) for kind in (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()))), pa.array(rows[begin[of] + low].astype(np.int32)), pa.array(rows[begin[of] + high - 1].astype(np.int32))],
                ["key", "id", "doc", "spot", "at", "lines", "checks", "rows", "starts", "ends", "from", "to"],
            )
        # Those that begin before the equal lines chain on by the line before these, the others by the line after them.
        for windows, side in ((np.flatnonzero(more_back), 1), (np.flatnonzero(~more_back & more_on), 2)):
            if not len(windows):
                continue
            new = np.flatnonzero(np.diff(row[windows], prepend=-1))
            of, count = row[windows][new], np.diff(np.append(new, len(windows)))
            depth = back[of] if side == 1 else on[of]
            differs = lines[begin[of] + at[of] + (-depth - 1 if side == 1 else depth)].view(np.uint64)
            chain = t.mixed(t.mixed(key[of] * t._SLOT[1] + (2 * depth + side).astype(np.uint64)) ^ differs).view(np.int64)
            yield placed(batch, of, chain, at[of], (lines, checks, rows), begin[of], starts[windows], ends[windows], count)


def repeated_runs(docs: DataFrame, gram: int = GRAM, run: int = RUN) -> DataFrame:
    """doc, runs: for each document (by c.doc_key()) the line ranges that repeat an earlier place."""
    c.bounded_batches(docs.sparkSession)
    keyed = docs.select(c.doc_key().alias("doc"), F.col("doc_id").alias("id"), "text")
    prints = c.staged(keyed.mapInArrow(line_prints(gram, run), LINES), "line-prints")
    spots = prints.select("doc", F.explode("prints").alias("p")).select("doc", "p.*")
    shared = c.with_first(spots, ["mark"], F.lit(0), F.col("doc")).where(F.col("many") > 1)
    # Rows that repeat are one document, with one set of prints.
    shared = shared.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("mark", "spot", "start", "windows"))).alias("prints"))
    own = prints.select("doc", "id", "lines", "checks", "words", "rows").dropDuplicates(["doc"])
    around = own.join(shared, "doc").select("doc", "id", "lines", "checks", "words", "rows", "prints")
    step = c.staged(around.mapInArrow(surroundings(run), ROUND), "print-places")
    place = F.struct(c.order_key(F.col("id")).alias("id"), "doc", "spot", "at", "lines", "checks")
    later = (F.col("doc") != F.col("first.doc")) | (F.col("spot") != F.col("first.spot"))
    gone = []
    while not step.isEmpty():
        led = c.with_first(step.select("key", "id", "doc", "spot", "at", "lines", "checks", "rows", "starts", "ends"), ["key"], place, F.col("doc")).where(later)
        first = [F.col(f"first.{x}").alias(f"{x}0") for x in ("at", "lines", "checks")]
        found = c.staged(led.select("key", "id", "doc", "spot", "at", "lines", "checks", "rows", "starts", "ends", *first).mapInArrow(extended, ROUND), "print-places")
        gone.append(found.where("key is null").select("doc", "from", "to"))
        step = found.where("key is not null")
    if not gone:
        return docs.sparkSession.createDataFrame([], "doc binary, runs array<struct<`from`:int,`to`:int>>")
    return merged(c.union(gone).distinct()).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))


def merged(runs: DataFrame) -> DataFrame:
    """doc, from, to: ranges that overlap as one."""
    order = W.partitionBy("doc").orderBy("from", "to")
    before = F.max("to").over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = runs.withColumn("new", F.when(before.isNull() | (F.col("from") > before), 1).otherwise(0))
    return apart.withColumn("part", F.sum("new").over(order)).groupBy("doc", "part").agg(F.min("from").alias("from"), F.max("to").alias("to"))


def dedup_lines(docs: DataFrame, gram: int = GRAM, run: int = RUN) -> DataFrame:
    """docs, all columns, with text after the deletions, and n_lines, n_removed.

    docs: doc_id, text. Lines end at newlines and are equal when their words
    are, A-Z as a-z; lines without words neither part nor join runs and go with
    the run around them. Places go by doc_id (null last), then by a hash of
    id and text, then by line. Each line goes that is in a run of at least `run`
    words which stands at an earlier place too, in the same or another document;
    a text may become empty. Shorter repeated runs stay. Null texts stay null
    with 0 lines, empty ones have 1; rows that repeat both id and text are one
    document and get one result. An empty table gives none. Where docs has a
    column called n_lines or n_removed, the new one has underscores before it.
    """
    key, runs = c.unused(docs.columns, "doc"), c.unused(docs.columns, "runs")
    found = repeated_runs(docs, gram, run).withColumnsRenamed({"doc": key, "runs": runs})
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda _, i: ~F.exists(runs, lambda r: i.between(r["from"], r["to"])))
    out = docs.withColumn(key, c.doc_key()).join(found, key, "left")
    cleaned = F.when(F.col(runs).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    removed = F.when(F.col(runs).isNull(), 0).otherwise(F.size(lines) - F.size(left))
    others = [F.col(f"`{x}`") if x != "text" else cleaned.alias("text") for x in docs.columns]
    return out.select(*others, n.cast("long").alias(c.unused(docs.columns, "n_lines")), removed.cast("long").alias(c.unused(docs.columns, "n_removed")))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """dedup_lines() over all documents; it says what holds for nulls, ties, repeated rows and clashing names."""
    return dedup_lines(c.table(spark, sf_dir, "documents").select("doc_id", "text"))


#: By the whole text of every window, for tables without null or repeated ids.
OP10_SQL = r"""
WITH texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, pos, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM texts)),
worded AS (
  SELECT doc_id, pos, array_to_string(w, ' ') AS line, row_number() OVER d AS k, (sum(len(w)) OVER d)::BIGINT AS upto, (sum(len(w)) OVER d - len(w))::BIGINT AS before
  FROM lines WHERE len(w) > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
windows AS (
  SELECT a.doc_id, a.k AS low, b.k AS high FROM worded a ASOF JOIN (SELECT doc_id, k, upto FROM worded) b ON a.doc_id = b.doc_id AND a.before + 50 <= b.upto
  UNION SELECT b.doc_id, a.k, b.k FROM worded b ASOF JOIN (SELECT doc_id, k, before FROM worded) a ON a.doc_id = b.doc_id AND b.upto - 50 >= a.before),
runs AS (
  SELECT w.doc_id, low, high, string_agg(line, chr(10) ORDER BY l.k) AS run FROM windows w JOIN worded l ON l.doc_id = w.doc_id AND l.k BETWEEN low AND high GROUP BY ALL),
later AS (SELECT doc_id, low, high FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, low) AS turn FROM runs) WHERE turn > 1),
spans AS (SELECT r.doc_id, a.pos AS low, b.pos AS high FROM later r JOIN worded a ON a.doc_id = r.doc_id AND a.k = r.low JOIN worded b ON b.doc_id = r.doc_id AND b.k = r.high),
gone AS (SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN spans s ON s.doc_id = l.doc_id AND l.pos BETWEEN s.low AND s.high),
lost AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY 1)
SELECT t.doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(parts, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text,
       coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed
FROM texts t LEFT JOIN lost USING (doc_id)
"""
