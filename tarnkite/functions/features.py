"""Page features relative to the page that links to it, and their sparse vectors."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import skew as sk
from ..sources.tables import stored
from . import text as tx

#: Letters of a page that the longest run of text is measured against, and topical words kept.
USUAL_RUN, TOP = 1000.0, 20
#: Numbers of an order that one task looks at.
PART = 1 << 16
STATS = "struct<text_length: double, links: double, title_tokens: array<string>, link_tokens: array<string>>"
#: Numeric and token slots of a feature vector, in order.
NUMBERS, TOKENS = ("rel_text", "rel_links", "longest"), ("top_words", "title_words", "parent_link_words", "parent_title_words")


def passed_stats(html: Column) -> list[Column]:
    """What a page's links carry on: text_length, links, title_tokens."""
    return [F.length(tx.page_text(html)).cast("double").alias("text_length"), tx.link_count(html).cast("double").alias("links"), tx.ranked_words(tx.title(html)).alias("title_tokens")]


def relative(own: Column, parent: Column) -> Column:
    """0 without a parent or where the parent has none to compare with."""
    ratio = F.try_divide(own, parent)
    return F.when(ratio.isNull(), 0.0).otherwise(tx.squashed(ratio))


def with_parents(measures: DataFrame, order: str, *carried: str) -> DataFrame:
    """measures (host, ...) with `parent`: a struct of the carried columns of the page before it on its host, by a number; null for the first.

    Measures are stored once, as they are narrow and heavy to compute. A host
    is looked at in ranges of PART numbers, so one with a third of all pages is
    in no one task; the first page of a range takes the last of the ranges before.
    """
    rows = stored(measures, "measures").withColumn("_at", F.col(order)).withColumn("_part", F.floor(F.col(order) / PART))
    return sk.carried(rows, "host", F.struct(*carried), "parent", itself=False).drop("_at", "_part")


def page_metrics(pages: DataFrame) -> DataFrame:
    """url, ptl, rptl, rptl_norm, nl, rnl, rnl_norm, lts, lts_norm of each page (url, ptl, nl, lts and parent: ptl, nl or null)."""
    ratio = lambda own: F.coalesce(F.try_divide(F.col(own), F.col(f"parent.{own}")), F.lit(0.0))
    return pages.select(
        "url", "ptl", ratio("ptl").alias("rptl"), relative(F.col("ptl"), F.col("parent.ptl")).alias("rptl_norm"),
        "nl", ratio("nl").alias("rnl"), relative(F.col("nl"), F.col("parent.nl")).alias("rnl_norm"),
        "lts", tx.squashed(F.col("lts") / USUAL_RUN).alias("lts_norm"),
    )


def page_measures(html: Column) -> list[Column]:
    """All that a page's own features need, in one pass over html: text_length, links, title_tokens, top_words, run."""
    body = tx.page_text(html)
    both = tx.bound(body, lambda t: F.struct(F.length(t).cast("double").alias("text_length"), tx.top_words(t, TOP).alias("top_words")))
    return [both.alias("text"), tx.link_count(html).cast("double").alias("links"), tx.ranked_words(tx.title(html)).alias("title_tokens"), tx.longest_text(html).alias("run")]


def page_features(pages: DataFrame) -> DataFrame:
    """page_id and the slots NUMBERS and TOKENS of each page (page_id, html, parent: STATS or null)."""
    return relative_features(pages.select("page_id", "parent", *page_measures(F.col("html"))))


def relative_features(measures: DataFrame) -> DataFrame:
    """The slots NUMBERS and TOKENS of each page (page_measures() and parent: STATS or null), with all other columns but these."""
    none = F.array().cast("array<string>")
    rest = [x for x in measures.columns if x not in ("text", "links", "title_tokens", "run", "parent")]
    return measures.select(
        *rest,
        relative(F.col("text.text_length"), F.col("parent.text_length")).alias("rel_text"),
        relative(F.col("links"), F.col("parent.links")).alias("rel_links"),
        tx.squashed(F.col("run") / USUAL_RUN).alias("longest"),
        F.col("text.top_words").alias("top_words"),
        F.col("title_tokens").alias("title_words"),
        F.coalesce("parent.link_tokens", none).alias("parent_link_words"),
        F.coalesce("parent.title_tokens", none).alias("parent_title_words"),
    )


def stats_to_text(stats: Column) -> Column:
    """Fields closed by semicolons, tokens joined by commas; null stays null."""
    return F.when(stats.isNotNull(), F.concat(stats["text_length"].cast("string"), F.lit(";"), stats["links"].cast("string"), F.lit(";"), F.array_join(stats["title_tokens"], ","), F.lit(";"), F.array_join(stats["link_tokens"], ","), F.lit(";")))


def stats_from_text(line: Column) -> Column:
    """The inverse of stats_to_text."""
    piece = F.split(line, ";")
    tokens = lambda k: F.filter(F.split(F.try_element_at(piece, F.lit(k)), ","), lambda x: x != "")
    number = lambda k: F.try_element_at(piece, F.lit(k)).try_cast("double")
    return F.when(line.isNotNull(), F.struct(number(1).alias("text_length"), number(2).alias("links"), tokens(3).alias("title_tokens"), tokens(4).alias("link_tokens")))


def sparse_vector(numbers: list[Column], tokens: list[Column]) -> Column:
    """map<slot or slot:token, value> of unit length: numbers by slot, then 1 for each distinct token; empty if all is 0."""
    parts = [F.array(*(F.struct(F.lit(str(k)).alias("key"), x.cast("double").alias("value")) for k, x in enumerate(numbers)))]
    for k, words in enumerate(tokens, len(numbers)):
        slot = F.lit(f"{k}:")
        parts.append(F.transform(F.array_distinct(words), lambda w: F.struct(F.concat(slot, w).alias("key"), F.lit(1.0).alias("value"))))  # noqa: B023
    # One-element arrays bind what is used twice, so that it is computed once.
    sized = F.transform(F.array(F.concat(*parts)), lambda es: F.struct(es.alias("entries"), F.sqrt(F.aggregate(es, F.lit(0.0), lambda acc, e: acc + e["value"] * e["value"])).alias("size")))
    unit = F.transform(sized, lambda s: F.when(s["size"] > 0, F.map_from_entries(F.transform(s["entries"], lambda e: F.struct(e["key"], (e["value"] / s["size"]).alias("value"))))))
    return F.coalesce(F.element_at(unit, 1), F.create_map().cast("map<string,double>"))


def dot(x: Column, w: Column) -> Column:
    """Sum of products over the keys of x; keys that w lacks count 0."""
    return F.aggregate(F.map_entries(x), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(w, e["key"]), F.lit(0.0)))


def _rounded(x: float) -> float:
    """x to nine decimals as C's round() has it: half away from zero, and a little less than 0 is -0.0. (Java's digits have no sign at 0.)"""
    far = abs(x) * 1e9
    return x if not math.isfinite(far) else math.copysign(math.floor(far) + (far - math.floor(far) >= 0.5), x) / 1e9


@F.arrow_udf(T.StringType())
def shown(scores: pa.Array) -> pa.Array:
    """Scores to nine decimals, hundredfold, with two decimals, as C prints them: of the number itself, half to even. (Java rounds the digits that it would print, half up: 1.005 is a little less, and gives 1.01 there.)"""
    return pa.array([None if x is None else f"{100 * _rounded(x):.2f}" for x in scores.to_pylist()], pa.string())


def exact_sum(terms: Column) -> Column:
    """The sum (an aggregate) of a unit vector's terms, added up in whole numbers of 2^-44 and of 2^-86, so that neither it nor its sign goes by their order."""
    far = terms * float(1 << 44)
    rest = F.rint((far - F.rint(far)) * float(1 << 42))
    return (F.sum(F.rint(far).cast("long")).cast("double") + F.sum(rest.cast("long")) / float(1 << 42)) / float(1 << 44)
