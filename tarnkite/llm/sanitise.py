"""Information-theoretic sanitisation of personal data.

Base spans (e-mail and IP addresses, card and phone numbers) are the protected
entities, by their values. From co-occurrence in whole documents over the whole
corpus comes P(e | t), the chance that a document with term t has entity e, and
from it what t discloses of e: PMI(t; e) = log2 P(e | t) / p(e), against e's
information content IC(e) = -log2 p(e). A term exceeds the thresholds when it
gives away REVEALS of that content and leaves at most REST bits of it.

Most entities are in one or two documents, where plain shares say nothing: any
rare word of the document would imply the entity. P(e | t) of a term that was
with e in k of n documents is therefore a deleted estimate: of all pairs of an
entity and a term that are in that state when one document is left out, the
share whose left-out document has the entity too. So the corpus itself tells
how far a term seen once with an entity can be relied on. States that it knows
little of fall back, by PRIOR pseudo-documents, on k / (n + 1).

Copies are weighted: an entity's documents that share the least hash of their
word pairs under one of MARKS orders are one group, and each counts as its
group's fraction, so that a text copied a hundred times is one piece of
evidence. Revealing terms are spans as well, wherever they occur: a term of one
kind of entity is generalised to "about that kind", a term that reveals several
kinds is removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c
from . import _tokens as t

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
#: Share of an entity's information content, and bits of it that may be left, from which on a term is a span.
REVEALS, REST = 0.9, 0.75
#: Pseudo-documents of the estimate, and documents from which on a state is read from its own counts only.
PRIOR, STATES = 8.0, 64
#: Bytes of the shortest term, orders of the copies' hashes, terms that a task counts before it reports.
LEAST_LETTERS, MARKS, COUNTED = 3, 4, 1 << 18

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does; possessive, as nothing is to be tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

BASE = "doc binary, id long, spans array<struct<kind:int,start:int,end:int>>, entities array<struct<entity:long,kind:int>>, terms array<long>, marks array<long>"
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_ENTITIES = pa.list_(pa.struct([("entity", pa.int64()), ("kind", pa.int32())]))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from each @ with a domain, back over what may stand before it. Linear in any text."""
    last, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            begin = at
            while begin > last and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at:
                last = domain.end()
                yield begin, last
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, by start and then kind; places are code points."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(x.isdigit() for x in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def value_hash(kind: int, value: str) -> int:
    """The entity: case of addresses and punctuation of numbers make no difference."""
    value = value.lower() if kind < 2 else re.sub("[^0-9]", "", value)
    raw = np.frombuffer(f"{kind} {value}".encode(), np.uint8)
    return int(t.word_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)])).view(np.int64)[0])


def terms_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin, end (bytes) and text number of each word that can be a term."""
    begin, end, doc = t.words(raw, at, "other")
    long = end - begin >= LEAST_LETTERS
    begin, end, doc = begin[long], end[long], doc[long]
    return t.word_hashes(raw, begin, end), begin, end, doc


def evidence(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[dict], list[int], list[int]]:
    """The entities of a text, its distinct terms outside all base spans, and its marks as a copy."""
    raw, at = t.text_bytes(pa.array([text]))
    hashes, begin, end, _ = terms_of(raw, at)
    # Places in bytes: code points before each byte, and back.
    points = np.flatnonzero(np.append((raw & 0xC0) != 0x80, True))
    free = np.zeros(len(raw) + 1, np.int64)
    for a, _, b in spans:
        free[points[a]] += 1
        free[points[b]] -= 1
    inside = np.concatenate([[0], np.cumsum(np.cumsum(free) > 0)])
    hashes = hashes[inside[end] == inside[begin]]
    found = {(value_hash(kind, text[a:b]), kind) for a, kind, b in spans}
    pairs = t.mixed(hashes[:-1] * t._SLOT[0] + hashes[1:] * t._SLOT[1])
    marks = [int(t.mixed(pairs ^ t._SLOT[8 + k]).min()) >> 1 for k in range(MARKS)] if len(pairs) else [int(hashes[0] >> np.uint64(1)) if len(hashes) else 0] * MARKS
    return [{"entity": e, "kind": kind} for e, kind in sorted(found)], np.unique(hashes).view(np.int64).tolist(), marks


def find_base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (doc, id, text): a row of BASE for each text."""
    for batch in batches:
        texts = batch.column(2)
        for low, high in t.slices(texts):
            part = texts.slice(low, high - low)
            raw, at = t.text_bytes(part)
            marks = np.concatenate([[0], np.cumsum(((raw >= 48) & (raw <= 57)) | (raw == 64))])
            spans, entities, terms, copies = ([[]] * len(part) for _ in range(4))
            for k in np.flatnonzero(np.diff(marks[at])).tolist():
                text = part[k].as_py()
                if found := base_spans(text):
                    spans[k] = [{"kind": kind, "start": a, "end": b} for a, kind, b in found]
                    entities[k], terms[k], copies[k] = evidence(text, found)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(spans, _SPANS), pa.array(entities, _ENTITIES), *(pa.array(x, pa.list_(pa.int64())) for x in (terms, copies))], ["doc", "id", "spans", "entities", "terms", "marks"])


def tally(terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each term once, with the sum of its counts."""
    order = np.argsort(terms, kind="stable")
    terms = terms[order]
    first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else order
    return terms[first], np.add.reduceat(counts[order], first) if len(terms) else counts


def document_counts(shared):
    """For mapInArrow over (text): in how many texts each term that passes the filter occurs, in parts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def report() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], ["term", "docs"])

        for batch in batches:
            for low, high in t.slices(batch.column(0)):
                hashes, _, _, doc = terms_of(*t.text_bytes(batch.column(0).slice(low, high - low)))
                hit = c.passes(shared.value, hashes)
                hashes, doc = hashes[hit], doc[hit]
                order = np.lexsort((hashes, doc))
                hashes, doc = hashes[order], doc[order]
                held.append(hashes[np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]))[: len(hashes)]])
                if sum(map(len, held)) > COUNTED:
                    terms, counts = tally(np.concatenate([terms, *held]), np.concatenate([counts, np.ones(sum(map(len, held)), np.int64)]))
                    held.clear()
                    if len(terms) > COUNTED:
                        yield report()
                        terms, counts = terms[:0], counts[:0]
        terms, counts = tally(np.concatenate([terms, *held]), np.concatenate([counts, np.ones(sum(map(len, held)), np.int64)]))
        if len(terms):
            yield report()

    return scan


def term_places(shared):
    """For mapInArrow over (doc, text): the places, in code points, of terms that pass the filter."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in t.slices(batch.column(1)):
                raw, at = t.text_bytes(batch.column(1).slice(low, high - low))
                hashes, begin, end, doc = terms_of(raw, at)
                hit = c.passes(shared.value, hashes)
                if hit.any():
                    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    begin, end, of = begin[hit], end[hit], doc[hit]
                    first = points[at[of]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low).take(pa.array(of)), pa.array(hashes[hit].view(np.int64)), pa.array((points[begin] - first).astype(np.int32)), pa.array((points[end] - first).astype(np.int32))], ["doc", "term", "start", "end"])

    return scan


def weighted(base: DataFrame) -> DataFrame:
    """entity, kind, doc, weight: each entity's documents, copies of one text with their group's fraction each."""
    seen = base.where(F.size("entities") > 0).select("doc", "marks", F.explode("entities").alias("e")).select("e.entity", "e.kind", "doc", "marks").distinct()
    each = seen.select("entity", "kind", "doc", F.posexplode("marks").alias("turn", "mark"))
    led = c.with_first(each, ["entity", "kind", "turn", "mark"], F.col("doc"), F.col("doc")).groupBy("entity", "kind", "doc").agg(F.min("first").alias("group"))
    sized = c.with_first(led, ["entity", "kind", "group"], F.lit(0), F.col("doc"))
    return sized.select("entity", "kind", "doc", (1.0 / F.col("many")).alias("weight"))


def disclosed_pairs(base: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of counts over all documents.

    The first has each entity in more than one document with each term of these:
    entity, kind, term, k (their weighted documents), n (the same, and all
    others that have the term), entity_docs (weighted). The second has the rest,
    that is terms with the entities of one document only: term, kind, k = 1, n,
    pairs (how many such entities).
    """
    spark = docs.sparkSession
    own = c.staged(weighted(base), "entity-documents")
    entities = own.groupBy("entity", "kind").agg(F.count("*").alias("docs"), F.sum("weight").alias("entity_docs"))
    terms = base.where(F.size("terms") > 0).select("doc", "terms").dropDuplicates(["doc"])
    many = c.join_one(own, entities.where("docs > 1"), ["entity", "kind"], F.col("doc")).drop("docs")
    pairs = many.join(terms, "doc").select("entity", "kind", "entity_docs", "weight", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "kind", "entity_docs", "term").agg(F.sum("weight").alias("k"), F.count("*").alias("both"))
    pairs = c.staged(pairs, "entity-terms")
    alone = c.join_one(own, entities.where("docs = 1").select("entity", "kind"), ["entity", "kind"], F.col("doc"))
    alone = alone.groupBy("doc", "kind").agg(F.count("*").alias("pairs"))
    alone = alone.join(terms, "doc").select("kind", "pairs", F.explode("terms").alias("term")).groupBy("kind", "term").agg(F.sum("pairs").alias("pairs"))
    alone = c.staged(alone, "lone-terms")
    own_terms = c.staged(pairs.select("term").union(alone.select("term")).distinct(), "entity-words")
    distinct = own_terms.count()
    shared = spark.sparkContext.broadcast(c.hash_filter(own_terms, "term", c.filter_bits(distinct, most=24), distinct))
    counts = docs.select("text").mapInArrow(document_counts(shared), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    counts = c.staged(counts.join(own_terms, "term"), "term-documents")
    # A term's documents that lack the entity count whole; a term cannot be in fewer documents than they are together.
    n = F.col("k") + F.greatest(F.lit(0), F.col("docs") - F.col("both"))
    pairs = c.join_one(pairs, counts, ["term"], F.col("entity")).select("entity", "kind", "term", "k", n.alias("n"), "entity_docs")
    alone = alone.join(counts, "term").select("kind", "term", F.lit(1.0).alias("k"), F.greatest(F.lit(1.0), F.col("docs").cast("double")).alias("n"), "pairs")
    return pairs, alone


def state_counts(pairs: DataFrame, alone: DataFrame) -> dict[tuple[int, int], int]:
    """How many pairs of an entity and a term have been together in k of n documents, n up to STATES + 1: a table of bounded size."""
    state = [F.greatest(F.lit(1), F.round("k")).cast("int").alias("k"), F.greatest(F.lit(1), F.round("n")).cast("int").alias("n")]
    rows = pairs.select(*state, F.lit(1).cast("long").alias("pairs")).union(alone.select(*state, "pairs")).where(F.col("n") <= STATES + 1)
    return {(r["k"], r["n"]): r["pairs"] for r in rows.groupBy("k", "n").agg(F.sum("pairs").alias("pairs")).collect()}


def chance(counts: dict[tuple[int, int], int], k: int, n: int, prior: float = PRIOR) -> float:
    """P(e | t) after k of n documents, by the pairs that leaving one document out brings into that state."""
    with_it, without = (k + 1) * counts.get((k + 1, n + 1), 0), (n + 1 - k) * counts.get((k, n + 1), 0)
    return (with_it + prior * k / (n + 1)) / (with_it + without + prior)


def revealing_terms(base: DataFrame, docs: DataFrame, reveals: float = REVEALS, rest: float = REST) -> DataFrame:
    """term, kinds (a bit for each kind of entity that it reveals), from counts over all documents."""
    pairs, alone = (c.staged(x, "disclosures") for x in disclosed_pairs(base, docs))
    counts = state_counts(pairs, alone)
    rows = [(k, n, chance(counts, k, n)) for n in range(1, STATES + 1) for k in range(1, n + 1)]
    known = F.broadcast(base.sparkSession.createDataFrame(rows, "state_k int, state_n int, known double"))
    total = base.count()

    def over(found: DataFrame) -> DataFrame:
        state = (F.greatest(F.lit(1), F.round("k")) == F.col("state_k")) & (F.greatest(F.lit(1), F.round("n")) == F.col("state_n"))
        share = F.coalesce("known", F.col("k") / (F.col("n") + 1))
        content = F.log2(F.lit(float(total)) / F.col("entity_docs"))
        found = found.join(known, state, "left").withColumn("content", content).withColumn("mutual", F.log2(share) + content)
        return found.where((F.col("content") > 0) & (F.col("mutual") >= F.lit(reveals) * F.col("content")) & (F.col("content") - F.col("mutual") <= rest)).select("term", "kind")

    both = over(pairs).union(over(alone.withColumn("entity_docs", F.lit(1.0))))
    return both.groupBy("term").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("kinds"))


def all_spans(docs: DataFrame, reveals: float = REVEALS, rest: float = REST) -> DataFrame:
    """doc (c.doc_key()), id, base, spans for each row of docs: see sanitise()."""
    c.bounded_batches(docs.sparkSession)
    keyed = docs.select(c.doc_key().alias("doc"), F.col("doc_id").alias("id"), "text")
    base = c.staged(keyed.mapInArrow(find_base, BASE), "base-spans")
    terms = c.staged(revealing_terms(base, keyed, reveals, rest), "revealing-terms")
    if terms.isEmpty():
        found = base.sparkSession.createDataFrame([], "doc binary, terms array<struct<kind:int,start:int,end:int,kinds:int>>")
    else:
        many = terms.count()
        shared = docs.sparkSession.sparkContext.broadcast(c.hash_filter(terms, "term", c.filter_bits(many), many))
        places = keyed.select("doc", "text").mapInArrow(term_places(shared), "doc binary, term long, start int, end int")
        places = c.join_one(places, terms, ["term"], F.col("doc"))
        found = places.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct(F.lit(TERM).alias("kind"), "start", "end", "kinds"))).alias("terms"))
    whole = base.select("doc", "id", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(0).alias("kinds"))).alias("base"))
    whole = whole.join(found, "doc", "left")
    clear = F.filter("terms", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    spans = F.array_sort(F.transform(F.concat("base", F.coalesce(clear, F.array())), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["kinds"].alias("kinds"))))
    return whole.select("doc", "id", "base", spans.alias("spans"))


def named(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    names = F.array([F.lit(x) for x in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, reveals: float = REVEALS, rest: float = REST) -> DataFrame:
    """Sanitised texts and their spans.

    docs: doc_id, text; further columns are ignored. Returns a row for each row
    of docs: doc_id, text (base spans replaced by their kinds, as in [EMAIL];
    revealing terms by [ABOUT EMAIL], or by nothing if they reveal several
    kinds), spans (structs start, kind, end, kinds; code points, end exclusive;
    base spans and the terms that overlap none; in order). Null texts stay null
    without spans. Rows that repeat are one document of the evidence (each counts
    among a term's documents, which can only weaken it) and get equal results.
    Of base spans that overlap the first is replaced and names both. An empty
    table gives none.
    """
    spans = all_spans(docs, reveals, rest).select("doc", "spans").dropDuplicates(["doc"])
    rows = docs.select("doc_id", "text", c.doc_key().alias("doc")).join(spans, "doc")
    return rows.select("doc_id", replaced(F.col("text"), F.col("spans")).alias("text"), "spans")


@F.arrow_udf(T.StringType())
def replaced(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        parts, last = [], 0
        for s in found or []:
            if s["start"] < last:  # base spans of two kinds may overlap: the first names both
                last = max(last, s["end"])
                continue
            kinds = [KINDS[k].upper() for k in range(len(KINDS)) if s["kinds"] >> k & 1]
            name = f"[{KINDS[s['kind']].upper()}]" if s["kind"] < TERM else f"[ABOUT {kinds[0]}]" if len(kinds) == 1 else ""
            parts += [text[last : s["start"]], name]
            last = s["end"]
        out.append(text if text is None else "".join(parts) + text[last:])
    return pa.array(out, pa.string())


def op8_sanitise(spark, sf_dir: str) -> DataFrame:
    """all_spans() of all documents; sanitise() says what holds for nulls, ties and repeated rows."""
    found = all_spans(c.table(spark, sf_dir, "documents"))
    # Kinds are picked out first: a second parameter of filter()'s function would be an element's index.
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]  # noqa: B023
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
