"""Cleaning, tokenising and measuring the text of pages, as column expressions.

(?d) makes Java's dot and line rules those of plain newlines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that never count as topical.
STOP_WORDS = (
    "this", "that", "shall", "under", "with", "other", "within", "from", "such", "which", "means", "each", "have", "including", "upon", "after", "these", "been", "include",
    "otherwise", "against", "least", "through", "than", "unless", "does", "either", "whether", "without", "only", "between", "described", "percent", "their", "then",
    "those", "when", "except", "into", "during", "iii", "where", "would", "they", "itself", "last", "there", "also", "below", "here", "includes", "more", "neither", "being",
    "both", "cannot", "about", "above", "were", "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eigth", "ninth", "tenth", "three", "four", "five", "seven",
    "eight", "nine",
)
# Tags whose text counts, and tags that leave no trace.
TEXT_TAGS = ("div", "p", "b", "i", "u", "em", "strong", "ul", "li", "pre", "article", "blockquote", "body", "table", "th", "tr", "td", "tbody", "thead", "tfoot", "h1", "h2", "h3", "h4", "h5", "h6")
SKIP_TAGS = ("br", "hr", "img", "link", "meta", "META", "if", "endif", "wbr")
# What is taken out of a page, in this order, to get at its text; and the patterns of its parts.
TEXT_STEPS = (
    (r"(?ds)<(a|script|style).*?>.*?</\1>", ""),
    (r"(?d)<.*?>", ""),
    (r"&\w{2,4};", ""),
    (r"\n(\s*\n)+", "\n"),
)
NOT_ASCII = r"[^\x00-\x7e]"
TITLE = r"(?d)<title[^>]*>(.*?)</title>"
LINK_START = r"(?d)<a\s.*?>"
BODY_START, BODY_END = r"(?s)^.*?<body[^>]*>", r"(?s)</body>.*$"
MARKUP, TAG_NAME = r"<[^>]+>|[^><]+", r"^<\W*(\w+)"

#: Shorter words do not count.
LEAST_LETTERS = 4

Text = Column | str


def as_column(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_clean(html: Text) -> Column:
    """Without DEL and all that is not ASCII."""
    return F.regexp_replace(as_column(html), NOT_ASCII, "")


def page_text(html: Text) -> Column:
    """Visible text: anchors, scripts and styles go with their content (an opening like <article
    counts as an anchor's), then tags that end on their line, short entities, and blank lines."""
    out = as_column(html)
    for pattern, instead in TEXT_STEPS:
        out = F.regexp_replace(out, pattern, instead)
    return out


def word_tokens(text: Text) -> Column:
    """Runs of ASCII letters in lower case; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(as_column(text)), F.lit("[a-z]+"), 0), F.array().cast("array<string>"))


def topical(token: Column) -> Column:
    return (F.length(token) >= LEAST_LETTERS) & ~token.isin(*STOP_WORDS)


def bound(value: Column, use) -> Column:
    """use(value), with value computed once: the one element of an array binds it."""
    return F.transform(F.array(value), use)[0]


def counted(words: Column) -> Column:
    """array<struct<n, w>> of the distinct words, n being minus their number: frequent first, then by name. Linear but for sorting."""

    def runs(ordered: Column) -> Column:
        places = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda k: ~F.get(ordered, k).eqNullSafe(F.get(ordered, k - 1)))
        return bound(starts, lambda s: F.transform(s, lambda k, j: F.struct((k - F.coalesce(F.get(s, j + 1), F.size(ordered))).alias("n"), F.get(ordered, k).alias("w"))))

    return F.array_sort(bound(F.array_sort(words), runs))


def top_words(text: Text, n: int | None = None) -> Column:
    """The topical words of a text, frequent first, then by name: all, or the first n."""
    found = F.transform(counted(F.filter(word_tokens(text), topical)), lambda p: p["w"])
    return found if n is None else F.slice(found, 1, n)


def ranked_words(text: Text) -> Column:
    """All topical words of a text, frequent first, then by name."""
    return top_words(text)


def word_counts(df: DataFrame, key: str, text: Text) -> DataFrame:
    """key, token, n: how often each topical word occurs."""
    tokens = df.select(key, F.explode(word_tokens(text)).alias("token")).where(topical(F.col("token")))
    return tokens.groupBy(key, "token").agg(F.count("*").alias("n"))


def frequent_words(df: DataFrame, key: str, text: Text, n: int) -> DataFrame:
    """key, words: the n most frequent topical words, ties by name; texts without any have an empty list. No shuffle: each row is on its own."""
    return df.select(key, top_words(text, n).alias("words"))


def title(html: Text) -> Column:
    """The first title on one line, or ''."""
    return F.regexp_extract(as_column(html), TITLE, 1)


def link_count(html: Text) -> Column:
    return F.size(F.regexp_extract_all(as_column(html), F.lit(LINK_START), 0)).cast("long")


def body(html: Text) -> Column:
    """What stands between the body tags."""
    return F.regexp_replace(F.regexp_replace(as_column(html), BODY_START, ""), BODY_END, "")


def longest_text(html: Text) -> Column:
    """Letters of the longest run of text that no tag outside TEXT_TAGS interrupts.

    One pass with a stack that holds, for each open tag, whether its text
    counts. An end tag pops whatever is on top; tags in SKIP_TAGS and tags
    without a name leave the stack alone; a tag outside TEXT_TAGS ends the run.
    A pop or text on an empty stack ends the pass.
    """
    parts = F.regexp_extract_all(as_column(html), F.lit(MARKUP), 0)

    def step(acc: Column, part: Column) -> Column:
        stack, run, best = acc["stack"], acc["run"], acc["best"]
        tag = F.regexp_extract(part, TAG_NAME, 1)
        closes, opens = part.startswith("</"), part.startswith("<")
        pushes = (tag != "") & ~tag.isin(*SKIP_TAGS)
        counts = F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit(False))
        longer = run + F.length(F.regexp_replace(part, r"\s", ""))
        empty = F.size(stack) == 0
        state = lambda s, r, b, over: F.struct(s.alias("stack"), r.alias("run"), b.alias("best"), over.alias("over"))
        no, yes = F.lit(False), F.lit(True)
        return (
            F.when(acc["over"] | (empty & (closes | ~opens)), state(stack, run, best, yes))
            .when(closes, state(F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))), run, best, no))
            .when(opens & pushes, state(F.concat(stack, F.array(tag.isin(*TEXT_TAGS))), F.when(tag.isin(*TEXT_TAGS), run).otherwise(0), best, no))
            .when(~opens & counts, state(stack, longer, F.greatest(best, longer), no))
            .otherwise(acc)
        )

    start = F.struct(F.array(F.lit(False)).alias("stack"), F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(False).alias("over"))
    return F.aggregate(parts, start, step, lambda acc: acc["best"].cast("long"))


def squashed(t: Column) -> Column:
    """A ratio on a scale from -1 to 1 with 1 in the middle; -1 for what is not positive."""
    return F.when(t > 0, 2.0 / (1.0 + F.exp(-5.0 * F.log10(t))) - 1.0).otherwise(-1.0)
