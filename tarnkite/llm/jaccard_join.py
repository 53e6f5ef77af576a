"""Size-aware heavy-light n-gram Jaccard join.

A document's set holds the hashes of its distinct five-word shingles. Two sets
of n and m shingles link when they share at least 4/9 (n + m) of them, that is
at a Jaccard similarity of 0.8. All sets go by one order of shingles, rare ones
first, as a count sketch of fixed size over the whole corpus tells it.

Sets of at most `boundary` shingles are light: they are joined with each other
on the 2-subsets of their first n - ceil(0.8 n) + 2 shingles, of which linked
sets share one. Each larger, heavy, set meets all sets of fitting sizes in the
inverted lists of the first n - ceil(0.8 n) + 1 shingles. The boundary is the
size at which subsets begin to cost more than lists, from a histogram of sizes.

What a document is linked with matters here only through its component, so
lists are not expanded into pairs: a list's members are compared with its first
member, and then only members that this has left in different components are
compared with each other. Sizes, places in the order, and parity sketches of
the sets rule out most of the pairs (exactly); the texts decide the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c
from . import _tokens as t
from .components import components
from .line_dedup import lists

WIDTH = 5
#: Cells of the count sketch (2 ** bits) for a small corpus and at most, and of them in one row of it.
CELL_BITS, MOST_BITS, ROW_BITS = 20, 24, 10
#: A list that may be longer is dealt out over several tasks.
LIST = 4096
#: Documents that one task compares with one set.
STAR = 256
#: Beside a subset's row, what a list's row costs (it is often shared, and then
#: joined twice more), and what reading one entry of its list does.
LIST_COST, SCAN_COST = 3.0, 1 / 16

#: Sketches for each core of the cluster.
SKETCHES = 4

SIGNATURES = "doc binary, id long, n int, d1 long, d2 long, tokens array<long>, parity array<long>, subsets double, reads double"
ITEMS = "k long, salt int, light boolean, pos int, n int, cls long"
SHARED = "k long, dealt boolean, light boolean, pos int, n int, cls long, pos0 int, n0 int, cls0 long"


def least_overlap(n):
    """What a set of n shares at least with any set that it links with."""
    return (4 * n + 4) // 5


def prefix(n):
    return np.where(n >= 4, n - least_overlap(n) + 1, 0)  # sets of fewer than four link with equal sets only


def doc_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text, with repetitions, and the text's number."""
    raw, at = t.text_bytes(texts)
    begin, end, doc = t.words(raw, at)
    return t.shingles(t.word_hashes(raw, begin, end), doc, len(texts), WIDTH)


def sketch_rows(bits: int):
    """For mapInArrow over (text): the rows of the count sketch that a task's shingles are in, with as few bytes a cell as hold the task's counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for low, high in t.slices(batch.column(0)):
                cells += np.bincount(doc_sets(batch.column(0).slice(low, high - low))[0] >> np.uint64(64 - bits), minlength=len(cells))
        rows = cells.astype(np.min_scalar_type(int(cells.max()))).reshape(-1, 1 << ROW_BITS)
        some = np.flatnonzero(rows.any(1))
        for low in range(0, len(some), 1024):
            part = some[low : low + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([rows[k].tobytes() for k in part], pa.binary())], ["part", "cells"])

    return count


def summed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = np.frombuffer(cells.as_buffer(), f"u{len(cells.as_buffer()) >> ROW_BITS}")
            total[part] = total.get(part, 0) + counts.astype(np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "cells"])


def cell_bits(size: int) -> int:
    """Bits of the sketch's cells for a corpus of so many bytes: one more for each sixteenfold from 256 MB on."""
    return min(MOST_BITS, CELL_BITS + max(0, size.bit_length() - 28) // 4)


def cells_of(hashes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The cell of each shingle."""
    return (hashes >> np.uint64(65 - len(cells).bit_length())).astype(np.int64)


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How often the shingles of each cell occur in all documents: a sketch of 8 MB to 128 MB, by the size of the corpus."""
    bits = cell_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    # A task's sketch is as large however little it reads, so there are few tasks, a few for each core.
    few = SKETCHES * docs.sparkSession.sparkContext.defaultParallelism
    parts = docs.select("text").coalesce(few).mapInArrow(sketch_rows(bits), "part int, cells binary")
    cells = np.zeros((1 << (bits - ROW_BITS), 1 << ROW_BITS), np.int64)
    for row in parts.repartition("part").mapInArrow(summed_rows, "part int, cells binary").toLocalIterator():
        cells[row["part"]] += np.frombuffer(row["cells"], np.int64)
    return cells.ravel()


def signatures(counts, mean: float):
    """For mapInArrow over (doc, id, text): size, digest, first shingles and parity sketch of each set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = counts.value
        level = np.minimum(4 * np.log2(1 + cells / mean), 63).astype(np.uint64) if mean else np.zeros(len(cells), np.uint64)
        for batch in batches:
            for low, high in t.slices(batch.column(2)):
                found, doc = doc_sets(batch.column(2).slice(low, high - low))
                cell = cells_of(found, cells)
                order = np.lexsort(((level[cell] << np.uint64(58)) | (found >> np.uint64(6)), doc))
                found, doc = found[order], doc[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
                found, doc = found[new], doc[new]
                bounds = np.searchsorted(doc, np.arange(high - low + 1))
                n = np.diff(bounds)
                digests = [sums(t.mixed(found ^ np.uint64(mark)), bounds) for mark in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                p = prefix(n)
                take = np.arange(len(found)) - bounds[doc] < p[doc] + (p[doc] > 0)
                tokens, of = found[take], doc[take]
                listed = np.arange(len(found)) - bounds[doc] < p[doc]
                reads = np.bincount(doc[listed], np.maximum(0.0, cells[cells_of(found[listed], cells)] - mean - 4 * mean**0.5), minlength=high - low)
                parity, parity_bounds = parities(found, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(n, pa.int32()),
                        *(pa.array(d.view(np.int64)) for d in digests),
                        lists(tokens, np.searchsorted(of, np.arange(high - low + 1)), pa.int64()), lists(parity, parity_bounds, pa.int64()),
                        pa.array((p + 1) * p / 2.0), pa.array(reads.astype(float)),  # no shingles at all give whole numbers
                    ],
                    ["doc", "id", "n", "d1", "d2", "tokens", "parity", "subsets", "reads"],
                )

    return scan


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of values in each range of bounds, modulo 2 ** 64."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def parities(found: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches: each shingle flips one of 2 ** k >= n bits (64 at least), so two
    sketches differ in at most as many bits as the sets have shingles of their own."""
    n = np.diff(bounds)
    words = (1 << np.maximum(0, np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64))) * (n > 0)
    out_bounds = np.concatenate([[0], np.cumsum(words)])
    bit = found & (np.repeat(np.maximum(words, 1) * 64, n).astype(np.uint64) - np.uint64(1))
    out = np.zeros(int(out_bounds[-1]), np.uint64)
    np.bitwise_xor.at(out, np.repeat(out_bounds[:-1], n) + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out, out_bounds


def light_boundary(sizes: DataFrame) -> int:
    """Up to which size subsets cost less than lists: the least total over a histogram of sizes."""
    step = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(16 * F.log2("n"))).alias("step")
    rows = sizes.where("n >= 4").groupBy(step).agg(F.max("n"), F.sum("subsets"), F.sum("reads"), F.sum(F.size("tokens") - 1)).collect()
    best, at, cost = 0.0, 0, 0.0
    for _, n, subsets, reads, listed in sorted(rows, key=lambda r: r[1]):
        cost += subsets - LIST_COST * listed - SCAN_COST * reads
        if cost < best:
            best, at = cost, n
    return at


def emitted(counts, boundary: int):
    """For mapInArrow over (cls, n, tokens): the keys on which a set is joined."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = counts.value
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                cls, n = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                column = part.column(2)
                bounds, tokens = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy().view(np.uint64)
                rows = []
                first = prefix(n)
                for p in np.unique(first[(n <= boundary) & (first > 0)]).tolist():
                    of = np.flatnonzero((n <= boundary) & (first == p))
                    own = tokens[bounds[of][:, None] + np.arange(p + 1)]
                    i, j = np.triu_indices(p + 1, 1)
                    rare = np.minimum(own[:, i], own[:, j]), cells[cells_of(np.stack([own[:, i], own[:, j]]), cells)].min(0)
                    rows.append((t.mixed(own[:, i] * t._SLOT[0] + own[:, j] * t._SLOT[1]).ravel(), rare[1].ravel(), np.tile(j, len(of)), np.repeat(of, len(i)), True))
                of = np.flatnonzero((5 * n > 4 * boundary) & (first > 0))
                many = first[of]
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                own = tokens[np.repeat(bounds[of], many) + place]
                rows.append((own, cells[cells_of(own, cells)], place, np.repeat(of, many), False))
                for key, most, pos, of, light in rows:
                    if len(key):
                        salt = t.mixed(cls[of].view(np.uint64)) % (1 + most // LIST).astype(np.uint64)
                        # A key that is dealt out has salts from 1 on.
                        salt = np.where(most >= LIST, salt + np.uint64(1), np.uint64(0))
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(np.full(len(key), light)), pa.array(pos.astype(np.int32)), pa.array(n[of].astype(np.int32)), pa.array(cls[of])], ["k", "salt", "light", "pos", "n", "cls"])

    return scan


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows of ITEMS sorted by key: those whose key another set has, each with the key's first set."""
    kept = None  # the first row of the last key, and whether it is out
    for batch in batches:
        k, salt, light, pos, n, cls = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        if kept is not None:
            k, salt, light, pos, n, cls = (np.concatenate([[x], y]) for x, y in zip(kept[0], (k, salt, light, pos, n, cls), strict=True))
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (salt[1:] != salt[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        out = ~new | (salt > 0)
        out[:-1] |= ~new[1:]
        if kept is not None and kept[1]:
            out[0] = False
        last = first[-1]
        kept = ([x[last] for x in (k, salt, light, pos, n, cls)], bool(out[last] or (last == 0 and kept is not None and kept[1])))
        at = np.flatnonzero(out)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(k[at]), pa.array(salt[at] > 0), pa.array(light[at]), *(pa.array(x[at]) for x in (pos, n, cls)), *(pa.array(x[first[at]]) for x in (pos, n, cls))], ["k", "dealt", "light", "pos", "n", "cls", "pos0", "n0", "cls0"])


def may_link(n: Column, pos: Column, m: Column, pos0: Column, light: Column, boundary: int) -> Column:
    """Whether sets of n and m can link whose first common shingle has these places (light: the second one)."""
    need = F.floor((4 * (n + m) + 8) / 9)
    fits = 5 * F.least(n, m) >= 4 * F.greatest(n, m)
    heavy = light | (F.greatest(n, m) > boundary)
    return fits & heavy & (F.least(n - pos, m - pos0) + light.cast("int") >= need)


def near_parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (a, b, na, nb, pa, pb): the pairs whose sketches do not rule out a link."""
    for batch in batches:
        n = batch.column(2).to_numpy(zero_copy_only=False) + batch.column(3).to_numpy(zero_copy_only=False)
        keep = np.ones(batch.num_rows, bool)
        for k in range(batch.num_rows):
            x, y = (batch.column(m)[k].values.to_numpy().view(np.uint64) for m in (4, 5))
            while len(x) != len(y):  # a longer sketch folds into a shorter one
                if len(x) > len(y):
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                else:
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            keep[k] = int(np.bitwise_count(x ^ y).sum()) <= n[k] - 2 * ((4 * n[k] + 8) // 9)
        if keep.any():
            yield batch.select([0, 1]).filter(pa.array(keep))


def linked_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (star, part, cls, n, text) sorted so that the star's own row leads: the links with the star."""
    star = None
    for batch in batches:
        for low, high in t.slices(batch.column(4)):
            found, doc = doc_sets(batch.column(4).slice(low, high - low))
            bounds = np.searchsorted(doc, np.arange(high - low + 1))
            names, parts, sets = (batch.column(k).slice(low, high - low).to_pylist() for k in (0, 1, 2))
            out = []
            for k, name in enumerate(names):
                own = np.unique(found[bounds[k] : bounds[k + 1]])
                if sets[k] == name:
                    star = (name, parts[k], own)
                elif star and star[:2] == (name, parts[k]):
                    common = len(np.intersect1d(own, star[2], assume_unique=True))
                    if 9 * common >= 4 * (len(own) + len(star[2])):
                        out.append((name, sets[k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])


def linked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, stars: bool) -> DataFrame:
    """The pairs (a, b) of sets that link. sets: cls, n, doc, parity, one row a set; docs: doc, text.

    stars: whether each b comes from lists that it is in, each with one star a;
    then it is in no more pairs than it has keys, and only a can be in very many.
    """
    one = sets.select("cls", "n", "parity")
    near = c.join_one(pairs, one.toDF("a", "na", "pa"), ["a"], F.col("b"))
    other = one.toDF("b", "nb", "pb")
    near = (near.join(other, "b") if stars else c.join_one(near, other, ["b"], F.col("a"))).select("a", "b", "na", "nb", "pa", "pb")
    near = c.staged(near.mapInArrow(near_parities, "a long, b long"), "near-pairs")
    # a is the star of its pairs; one with many is dealt out over parts, each with its own copy.
    parts = F.ceil(F.col("many") / F.lit(STAR)).cast("int")
    dealt = c.with_first(near, ["a"], F.lit(0), F.col("b")).select("a", "b", parts.alias("parts"))
    dealt = dealt.select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "parts")
    # Each part has its star's row too, from whichever of its pairs comes first.
    roles = dealt.select(F.col("a").alias("star"), "part", F.explode(F.array("a", "b")).alias("cls")).distinct()
    roles = c.staged(roles.join(sets.select("cls", "doc"), "cls"), "star-roles")
    few = c.sieved(docs, roles.select("doc").distinct()).dropDuplicates(["doc"])
    rows = c.join_one(roles, few, ["doc"], F.col("part")).select("star", "part", "cls", "text")
    rows = rows.repartition("star", "part").sortWithinPartitions("star", "part", F.col("cls") != F.col("star"))
    return c.staged(rows.select("star", "part", "cls", F.lit(0).alias("n"), "text").mapInArrow(linked_texts, "a long, b long"), "links")


def similar_sets(docs: DataFrame) -> DataFrame:
    """One row a document: doc (c.doc_key()), id, n_shingles, component_id (see
    jaccard_components), first (whether it is the one that stands for its component)."""
    spark = docs.sparkSession
    c.bounded_batches(spark)
    docs = docs.select(c.doc_key().alias("doc"), F.col("doc_id").alias("id"), "text")
    cells = shingle_counts(docs)
    counts, mean = spark.sparkContext.broadcast(cells), float(cells.mean())
    made = docs.mapInArrow(signatures(counts, mean), SIGNATURES).withColumn("row", F.monotonically_increasing_id())
    made = c.staged(made, "signatures")
    # Equal sets are one class, named by the row of the least id.
    place = F.struct(c.order_key(F.col("id")).alias("id"), "row", "doc")
    classes = made.where("n >= 4").groupBy("n", "d1", "d2").agg(F.min(place).alias("rep"), F.first("tokens").alias("tokens"), F.first("parity").alias("parity"), F.first("subsets").alias("subsets"), F.first("reads").alias("reads"))
    classes = c.staged(classes.select(F.col("rep.row").alias("cls"), "n", F.col("rep.doc").alias("doc"), "tokens", "parity", "subsets", "reads"), "set-classes")
    boundary = light_boundary(classes)
    items = classes.select("cls", "n", "tokens").mapInArrow(emitted(counts, boundary), ITEMS)
    items = items.repartition("k", "salt").sortWithinPartitions("k", "salt", "pos", "n", "cls")
    shared = c.staged(items.mapInArrow(shared_keys, SHARED), "shared-keys")
    sets = classes.select("cls", "n", "doc", "parity")

    # First members: of each list, and of each dealt list's parts.
    heads = shared.where("dealt").select("k", "light", F.col("pos0").alias("pos"), F.col("n0").alias("n"), F.col("cls0").alias("cls")).distinct()
    tops = heads.groupBy("k").agg(F.min(F.struct("pos", "n", "cls")).alias("top"))
    heads = heads.join(tops, "k").select("light", "pos", "n", "cls", F.col("top.pos").alias("pos0"), F.col("top.n").alias("n0"), F.col("top.cls").alias("cls0"))
    stars = c.union([shared.select(*heads.columns), heads]).where("cls <> cls0")
    stars = stars.where(may_link(F.col("n"), F.col("pos"), F.col("n0"), F.col("pos0"), F.col("light"), boundary))
    tried = c.staged(stars.select(F.col("cls0").alias("a"), F.col("cls").alias("b")).distinct(), "star-pairs")
    links = linked(tried, sets, docs, True)

    # Lists whose members are not in one component yet: their pairs across components.
    joined = components(links)
    member = shared.join(joined.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    member = c.staged(member.select("k", "dealt", "light", "pos", "n", "cls", "component"), "list-members")
    split = member.groupBy("k").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("many"), F.max("dealt").alias("dealt"))
    split = split.where("least <> most and (many > 2 or dealt)").select("k", F.ceil(F.col("many") / F.lit(LIST)).cast("int").alias("parts"))
    # One side of a long list is dealt out, the other meets each part.
    left = c.join_one(member.drop("dealt"), split, ["k"], F.col("cls"))
    right = left.select("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(x).alias(f"{x}0") for x in ("pos", "n", "cls", "component")))
    left = left.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    across = left.join(right, ["k", "part"]).where((F.col("cls0") < F.col("cls")) & (F.col("component0") != F.col("component")) & may_link(F.col("n"), F.col("pos"), F.col("n0"), F.col("pos0"), F.col("light"), boundary))
    pairs = across.select(F.col("cls0").alias("a"), F.col("cls").alias("b")).distinct()
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = c.staged(pairs.join(known, ["a", "b"], "left_anti"), "cross-pairs")
    if not pairs.isEmpty():
        joined = components(joined.select(F.col("component").alias("a"), F.col("node").alias("b")).union(linked(pairs, sets, docs, False)))
    joined = c.staged(joined, "components")

    # Each document gets the least id of its component, by way of its class.
    own = made.select("id", "n", "d1", "d2", "row", "doc", F.pmod(F.xxhash64("row"), F.lit(64)).alias("salt"))
    some = own.where("n > 0")
    near = c.staged(some.groupBy("n", "d1", "d2", "salt").agg(F.min(place).alias("rep")), "near-sets")
    far = near.groupBy("n", "d1", "d2").agg(F.min("rep").alias("rep"))
    far = c.staged(far.join(joined, F.col("rep.row") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep.row")), "sets")
    far = c.with_first(far, ["component"], F.col("rep"), F.col("rep.row")).select("n", "d1", "d2", F.col("first.id.id").alias("component_id"), F.col("first.row").alias("head"))
    down = c.staged(near.select("n", "d1", "d2", "salt").join(far, ["n", "d1", "d2"]), "set-components")
    whole = some.join(down, ["n", "d1", "d2", "salt"]).select("doc", "id", F.col("n").cast("long").alias("n_shingles"), "component_id", (F.col("head") == F.col("row")).alias("first"))
    return whole.unionByName(own.where("n = 0").select("doc", "id", F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("first")))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Components of documents that link by five-word shingles.

    docs: doc_id, text; further columns are ignored. Words are runs of bytes
    other than ASCII white space, A-Z as a-z; a text with fewer than five words
    has its whole sequence as its one shingle; one without words (or null) has
    an empty set and links with nothing. Two documents link when 100 * |x & y|
    >= 80 * |x | y|. Returns a row for each row of docs: doc_id, n_shingles,
    component_id (the least doc_id reachable by links, nulls last; its own for
    an empty set). Rows that repeat are documents that link. An empty table
    gives none. Shingles are compared by 64-bit hashes of hashes that no two
    words share by their structure; equal sets are told by 128 bits.
    """
    return similar_sets(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, all columns, with the document of least doc_id of each component; those without words all stay."""
    key = c.unused(docs.columns, "doc")
    first = similar_sets(docs).where(F.col("first") & (F.col("n_shingles") > 0)).select(F.col("doc").alias(key)).distinct()
    worded = F.coalesce(F.col("text").rlike(c.WORDS), F.lit(False))
    # A row that repeats has one key; the join has put its copies into one partition.
    kept = docs.where(worded).withColumn(key, c.doc_key()).join(first, key, "left_semi").dropDuplicates([key]).drop(key)
    return kept.unionByName(docs.where(~worded))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """jaccard_components() of all documents; it says what holds for nulls, empty and short texts and repeated rows."""
    return jaccard_components(c.table(spark, sf_dir, "documents"))


#: By all shared shingles, for tables without null or repeated ids.
OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END)) AS gram FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
same AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM same JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT DISTINCT a AS doc, a AS other FROM links UNION SELECT r.doc, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(d.doc_id, low), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT doc, min(other) AS low FROM reach GROUP BY 1) ON doc = d.doc_id
"""
