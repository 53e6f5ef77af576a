"""WARC archives with a two-level capture index.

Level one holds a line for each record, sorted by URL key (host labels
reversed) and page_id, in compressed blocks of BLOCK_LINES lines; level two,
the directory, holds the first key of each block and where the block lies. A
lookup bisects the parts' first keys, then one part's directory, reads that
one block, bisects its lines, and reads that one range of an archive.

Archives and index are plain files in a folder that all executors share, read
and written by ranges through pyarrow's file systems. A task writes files under
names of its own and reports them with its rows, which are stored; a file of a
task that failed or ran twice is in no row, so nothing reads it.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

#: Index lines in a compressed block; blocks in a part's directory; parts in the top list.
BLOCK_LINES, PART_BLOCKS = 1000, 4096
#: Bytes of payload in one archive, about.
ARCHIVE_BYTES = 1 << 28
#: Ranges of one archive this near to each other are read at once, up to READ bytes.
GAP, READ = 1 << 14, 1 << 20
#: Blocks and directories that a lookup task keeps.
CACHED = 64

CAPTURE = "key string, archive string, offset long, length long"
#: What a writer gets: html of responses, sha1 and size of revisits.
TO_WRITE = ("page_id", "url", "html", "sha1", "size", "revisit", "refers_to")
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: Separates the fields of an index line; url_key() leaves none in a key.
SEP = "\t"
DATE = "1970-01-01T00:00:00Z"


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there.

    file://, s3://, s3a://, s3n://, gs://, abfs(s)://, hdfs:// (with libhdfs on
    every machine) and dbfs:/ (through its mount) are supported; any other is
    an error before anything is written.
    """
    known = re.sub(r"\As3[an]://", "s3://", folder)
    known = re.sub(r"\Adbfs:/+", "file:///dbfs/", known)
    try:
        return fs.FileSystem.from_uri(known)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as error:
        raise ValueError(f"archives can't be kept in {folder}: the folder must be at file://, s3a://, gs://, abfs://, dbfs:/ or hdfs:// with libhdfs") from error


def url_key(url: str | None) -> str:
    """Scheme dropped, host in lower case with its labels reversed, then port, path and query: com,example)/path?q."""
    whole = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?(.*)\Z", whole, re.DOTALL)
    if not found:
        return whole
    return ",".join(reversed(found[1].lower().split("."))) + (found[2] or "") + ")" + (found[3] or "/")


def capture_key(url: str | None, page_id: int | None) -> str:
    """What the index is sorted by: the URL key, then page_id, null last."""
    return url_key(url) + SEP + ("~" if page_id is None else f"{page_id + (1 << 63):020d}")


def sha1_name(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, refers_to: tuple | None, digest: str, size: int) -> bytes:
    """One record as a gzip member. refers_to: (page_id,) of the response that a revisit, which has no payload, repeats."""
    name = lambda n: "urn:page:" + ("none" if n is None else str(n))
    lines = ["WARC/1.1", "WARC-Type: " + ("revisit" if refers_to else "response"), f"WARC-Record-ID: <{name(page_id)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{name(refers_to[0])}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload or b'')}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + (payload or b"") + b"\r\n\r\n") + pack.flush()


def parsed(member: bytes) -> dict:
    """The record in a gzip member; a response's digest and length are those of the payload that is there."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    said = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda text: None if text == "none" else int(text)
    out = {"page_id": number(said["WARC-Record-ID"][1:-1].split(":")[2]), "record_type": said["WARC-Type"], "refers_to": None, "payload": None}
    url = said.get("WARC-Target-URI")
    out["url"] = url if url is None else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)
    if out["record_type"] == "revisit":
        return out | {"refers_to": number(said["WARC-Refers-To"][1:-1].split(":")[2]), "payload_bytes": int(said["WARC-Payload-Length"]), "payload_digest": said["WARC-Payload-Digest"][5:]}
    payload = rest[: int(said["Content-Length"])]
    digest = sha1_name(payload)
    if digest != said["WARC-Payload-Digest"][5:]:
        raise ValueError(f"payload of page {out['page_id']} is not what its record says")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}


def archive_writer(folder: str):
    """For mapInArrow over TO_WRITE: a capture for each record written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        out, name, offset = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, sha1, size, revisit, refers_to in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if out is None or offset > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                if revisit:
                    member = record_bytes(page_id, url, None, (refers_to,), base64.b32encode(bytes.fromhex(sha1)).decode(), size)
                else:
                    payload = (html or "").encode()
                    member = record_bytes(page_id, url, payload, None, sha1_name(payload), len(payload))
                out.write(member)
                rows.append((capture_key(url, page_id), name, offset, len(member)))
                offset += len(member)
            yield from as_batch(rows, CAPTURES)
        if out is not None:
            out.close()

    return write


CAPTURES = {"key": pa.string(), "archive": pa.string(), "offset": pa.int64(), "length": pa.int64()}
PARTS = {"first": pa.string(), "part": pa.string()}
RECORDS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def as_batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def marked_as(shared, repeated: bool):
    """For mapInArrow over rows whose last column is their payload's mark: those whose mark passes the filter, or the others."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = c.passes(shared.value, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(hit == repeated))

    return some


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """A WARC record for each row of pages, in archives in folder; returns the captures, stored.

    pages: page_id, url, html; further columns are ignored; null html is an
    empty payload. Of records with equal payloads (SHA-256 and length) of at
    least `least` bytes the one with the smallest page_id (null last; of
    repeated rows the first by url) is the response, the others revisit it.

    What is a revisit is decided on ids and digests alone. Payloads that do not
    repeat, as a filter of bounded size tells, are written where they are read;
    of each that does one copy is shuffled, and revisits carry none.
    """
    spark = pages.sparkSession
    c.bounded_batches(spark)
    system, root = store(folder)
    system.create_dir(root)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    mark = F.xxhash64(payload).alias("mark")
    narrow = pages.select("page_id", "url", F.unhex(F.sha2(payload, 256)).alias("sha"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("size"), mark)
    narrow = c.staged(narrow.withColumn("row", F.monotonically_increasing_id()), "page-digests")
    place = F.struct(c.order_key(F.col("page_id")).alias("id"), F.col("url"), F.col("row"))
    led = c.with_first(narrow.where(F.col("size") >= least), ["sha"], place, F.col("row")).where(F.col("many") > 1)
    again = c.staged(led.select("page_id", "url", "sha", "sha1", "size", "mark", (F.col("row") != F.col("first.row")).alias("revisit"), F.col("first.id.id").alias("refers_to")), "repeated-pages")
    marks = again.where("not revisit").select("mark")
    many = marks.count()
    shared = spark.sparkContext.broadcast(c.hash_filter(marks, "mark", c.filter_bits(many, most=c.TEXT_BITS), many))
    text = {"page_id": "long", "url": "string", "html": "string", "sha1": "string", "size": "long", "revisit": "boolean", "refers_to": "long"}
    none = lambda x: F.lit(None).cast(text[x]).alias(x)

    # Payloads that stand alone go straight to the archives; others that pass the filter by chance are told by their digests.
    alone = pages.select("page_id", "url", "html", mark).mapInArrow(marked_as(shared, False), "page_id long, url string, html string, mark long")
    hits = pages.select("page_id", "url", "html", mark).mapInArrow(marked_as(shared, True), "page_id long, url string, html string, mark long")
    hits = hits.withColumn("sha", F.unhex(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)))
    short = hits.where(F.coalesce(F.octet_length("html"), F.lit(0)) < least) if least else None
    copies = hits.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= least) if least else hits
    heads = again.where("not revisit").select("sha", F.struct("page_id", "url").alias("head"))
    one = copies.groupBy("sha").agg(F.first("html").alias("html"), F.first(F.struct("page_id", "url")).alias("own")).join(heads, "sha", "left")
    one = one.withColumn("head", F.coalesce("head", "own")).select("head.page_id", "head.url", "html")
    responses = [x.select("page_id", "url", "html", none("sha1"), none("size"), F.lit(False).alias("revisit"), none("refers_to")) for x in (alone, one, short) if x is not None]
    revisits = again.where("revisit").select("page_id", "url", none("html"), "sha1", "size", "revisit", "refers_to")
    rows = c.union([*responses, revisits]).select(*TO_WRITE)
    return c.staged(rows.mapInArrow(archive_writer(folder), CAPTURE), "captures")


def index_writer(folder: str):
    """For mapInArrow over sorted captures: writes blocks and directories; a row for each part."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        lines: list[str] = []
        blocks: list[tuple[str, int, int]] = []
        out, name, offset, parts = None, "", 0, []

        def block() -> None:
            nonlocal out, name, offset
            if out is None:
                name, offset = uuid.uuid4().hex, 0
                out = system.open_output_stream(f"{root}/{name}.cdx.gz", compression=None)
            packed = zlib.compress("\n".join(lines).encode(), 6)
            out.write(packed)
            blocks.append((SEP.join(lines[0].split(SEP)[:2]), offset, len(packed)))
            offset += len(packed)
            lines.clear()

        def part() -> None:
            nonlocal out
            if out is not None:
                out.close()
                with system.open_output_stream(f"{root}/{name}.dir", compression=None) as d:
                    d.write(zlib.compress(json.dumps(blocks).encode()))
                parts.append((blocks[0][0], name))
                blocks.clear()
                out = None

        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                lines.append(SEP.join(map(str, row)))
                if len(lines) == BLOCK_LINES:
                    block()
                if len(blocks) == PART_BLOCKS:
                    part()
        if lines:
            block()
        part()
        yield from as_batch(parts, PARTS)

    return write


def build_index(captures: DataFrame, folder: str) -> None:
    """Writes the captures' index to folder: blocks, their directories, and the list of parts.

    The list has a line for each part, that is for up to BLOCK_LINES *
    PART_BLOCKS captures or each task that wrote; only it comes to the driver.
    """
    system, root = store(folder)
    system.create_dir(root)
    line = captures.select("key", "archive", "offset", "length")
    line = line.repartitionByRange(c.shuffle_width(captures.sparkSession), "key", "archive", "offset").sortWithinPartitions("key", "archive", "offset")
    parts = c.staged(line.mapInArrow(index_writer(folder), "first string, part string"), "index-parts")
    top = sorted((r["first"], r["part"]) for r in parts.collect())
    with system.open_output_stream(f"{root}/parts", compression=None) as out:
        out.write(zlib.compress(json.dumps(top).encode()))


class Index:
    """Lookups by key; keeps a few directories and blocks."""

    def __init__(self, folder: str) -> None:
        self.system, self.root = store(folder)
        self.top = json.loads(zlib.decompress(self.read("parts")))
        self.kept: OrderedDict[tuple, list] = OrderedDict()

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        with self.system.open_input_file(f"{self.root}/{name}") as f:
            return f.read_at(f.size() if length is None else length, offset)

    def cached(self, key: tuple, make) -> list:
        if key not in self.kept:
            self.kept[key] = make()
            if len(self.kept) > CACHED:
                self.kept.popitem(last=False)
        self.kept.move_to_end(key)
        return self.kept[key]

    def directory(self, part: str) -> list:
        return self.cached((part,), lambda: json.loads(zlib.decompress(self.read(f"{part}.dir"))))

    def block(self, part: str, offset: int, length: int) -> list[tuple[str, list[str]]]:
        def load() -> list:
            lines = (line.split(SEP) for line in zlib.decompress(self.read(f"{part}.cdx.gz", offset, length)).decode().split("\n"))
            return [(SEP.join(x[:2]), x[2:]) for x in lines]

        return self.cached((part, offset), load)

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """archive, offset, length of each capture with this key (urlkey and page_id)."""
        k = max(0, bisect.bisect_left(self.top, key, key=lambda x: x[0]) - 1)
        while k < len(self.top) and self.top[k][0] <= key:
            part = self.top[k][1]
            blocks = self.directory(part)
            b = max(0, bisect.bisect_left(blocks, key, key=lambda x: x[0]) - 1)
            while b < len(blocks) and blocks[b][0] <= key:
                lines = self.block(part, blocks[b][1], blocks[b][2])
                i = bisect.bisect_left(lines, key, key=lambda x: x[0])
                while i < len(lines) and lines[i][0] == key:
                    archive, offset, length = lines[i][1]
                    yield archive, int(offset), int(length)
                    i += 1
                b += 1
            k += 1


def page_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        urls, ids = (x.to_pylist() for x in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, i) for u, i in zip(urls, ids, strict=True)], pa.string())], ["key"])


def lookup(pages: DataFrame, folder: str) -> DataFrame:
    """Captures (key, archive, offset, length) of pages (url, page_id), by the index in folder.

    Pages may be in any order and partitioning; they are sorted by key so that
    neighbours find their block at hand. Pages without captures give no rows.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or Index(folder)
            yield from as_batch([(key, *found) for key in batch.column(0).to_pylist() for found in index.find(key)], CAPTURES)

    keys = pages.select("url", "page_id").mapInArrow(page_keys, "key string").distinct()
    keys = keys.repartitionByRange(c.shuffle_width(pages.sparkSession), "key").sortWithinPartitions("key")
    return keys.mapInArrow(find, CAPTURE)


def read_records(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records at the captures, neighbouring ranges of an archive read at once."""

    def ranges(batch: pa.RecordBatch) -> Iterator[list[tuple[str, int, int]]]:
        near: list[tuple[str, int, int]] = []
        for archive, offset, length in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if near and (archive != near[-1][0] or not 0 <= offset - (near[-1][1] + near[-1][2]) <= GAP or offset + length - near[0][1] > READ):
                yield near
                near = []
            near.append((archive, offset, length))
        if near:
            yield near

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        for batch in batches:
            for near in ranges(batch):
                with system.open_input_file(f"{root}/{near[0][0]}") as f:
                    whole = f.read_at(near[-1][1] + near[-1][2] - near[0][1], near[0][1])
                found = [parsed(whole[o - near[0][1] : o - near[0][1] + n]) for _, o, n in near]
                yield from as_batch([tuple(r[k] if k != "payload" or payloads else None for k in RECORDS) for r in found], RECORDS)

    line = captures.select("archive", "offset", "length").repartitionByRange(c.shuffle_width(captures.sparkSession), "archive", "offset")
    return line.sortWithinPartitions("archive", "offset").mapInArrow(read, RECORD)


def archive_pages(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Archives of pages in folder/archives and their index in folder/index."""
    build_index(write_archives(pages, f"{folder}/archives", least), f"{folder}/index")


def read_pages(pages: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the given pages (url, page_id), found by the index: RECORD's columns.

    One row a record; pages that were archived twice give two. An empty table
    gives none. Null urls have the empty key; null page_ids are looked up too.
    """
    return read_records(c.staged(lookup(pages, f"{folder}/index"), "found-captures"), f"{folder}/archives", payloads)


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive_pages() of all pages, read back by read_pages(); write_archives() says what holds for nulls, ties and repeated rows."""
    pages = c.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = c.new_folder(spark, "warc")
    archive_pages(pages, folder)
    return read_pages(pages, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 of a hex digest: five bits at a time, out of two neighbouring hex digits.
_DIGIT = "(strpos('0123456789abcdef', substr(sha, {k} + (5 * i) // 4, 1)) - 1)"
OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages),
led AS (SELECT *, min(page_id) OVER w AS head, row_number() OVER (w ORDER BY page_id) AS turn FROM p WINDOW w AS (PARTITION BY payload))
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((({_DIGIT.format(k=1)} * 16 + {_DIGIT.format(k=2)}) >> (3 - (5 * i) % 4)::INT)) & 31), 1)), '') AS payload_digest,
       CASE WHEN turn = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN turn > 1 THEN head END AS refers_to
FROM led
"""
