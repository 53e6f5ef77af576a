"""Chat formatting in budgeted, turn-aligned windows (DataFrame functions only).

Prefix sums of the turns' tokens, taken in two levels so that a very long
conversation is not summed in one task, choose spans of whole turns: each begins
where the one before ends and goes up to the furthest turn whose prefix sum is
still within ``room`` tokens of the span's beginning, so a window is over budget
only where one turn alone is. The choice goes from turn to turn through chapters
of CHAPTER turns, which are independent, so a conversation of any length is in
many tasks; a chapter begins a new span, which makes a span more than needed in
a chapter at most, and none in a conversation of one chapter. Each window
opens with the conversation's system turn and up to ``history_turns`` turns
before the span, if they fit ``history``; all of these are context and are
masked, so each assistant text is a target exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as c

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
KEY = ["none", "conv"]
#: Turn numbers in one part of the two-level prefix sums, and turns that spans are chosen in at once.
PART, CHAPTER = 256, 256


def turn_tokens(text: Column) -> Column:
    """An estimate that needs no tokenizer: a token for four characters begun, four for the template."""
    return F.ceil(F.length(text) / F.lit(4)).cast("long") + F.lit(4)


def escaped(text: Column) -> Column:
    """No control string is left inside; unescaped() reverses it."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def with_spans(turns: DataFrame) -> DataFrame:
    """turns (seq, start, tokens, room, is_system) with span, rising; the system turn is in the first one."""
    chapter = W.partitionBy(*KEY, F.floor(F.col("seq") / CHAPTER))
    own = F.when(~F.col("is_system"), F.struct("seq", "start", (F.col("start") + F.col("tokens")).alias("end")))
    turns = turns.withColumn("ends", F.array_sort(F.collect_list(own).over(chapter)))
    first = F.get("ends", 0)
    begin = F.struct(first["start"].alias("from"), F.array(first["seq"]).alias("cuts"))
    step = lambda acc, t: F.when(t["end"] - acc["from"] > F.col("room"), F.struct(t["start"].alias("from"), F.concat(acc["cuts"], F.array(t["seq"])).alias("cuts"))).otherwise(acc)
    cuts = F.aggregate(F.slice("ends", 2, CHAPTER), begin, step, lambda acc: acc["cuts"])
    span = F.floor(F.col("seq") / CHAPTER) * (2 * CHAPTER) + F.size(F.filter(cuts, lambda x: x <= F.col("seq"))) - 1
    return turns.withColumn("span", F.when(F.col("is_system"), F.lit(0)).otherwise(span).cast("long")).drop("ends")


def placed_turns(conversations: DataFrame, budget: int, history: int) -> DataFrame:
    """Each turn with its number in the conversation, its span and the tokens before it."""
    turns = conversations.select(
        F.col("conv_id").isNull().alias("none"),
        F.coalesce("conv_id", F.lit(0)).alias("conv"),
        F.coalesce(F.floor(F.col("turn") / PART), F.lit(-(1 << 60))).alias("part"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tokens", turn_tokens(F.col("text")))
    inside = W.partitionBy(*KEY, "part").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*KEY).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    # The system turn, if it comes first, is no part of the sums.
    first = F.min_by(F.struct("role", "tokens"), F.struct("turn", "role", "text"))
    parts = turns.groupBy(*KEY, "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"), first.alias("first"))
    parts = parts.select(
        *KEY,
        "part",
        F.coalesce(F.sum("n").over(before), none).alias("n_before"),
        F.coalesce(F.sum("sum").over(before), none).alias("sum_before"),
        F.first("first").over(W.partitionBy(*KEY).orderBy("part")).alias("first"),
    )
    parts = parts.withColumn("system", F.when(F.col("first.role") == "system", F.col("first.tokens")).otherwise(none)).drop("first")
    room = F.greatest(F.lit(budget - history) - F.col("system"), F.lit(max(1, budget // 4))).cast("long")
    turns = (
        turns.withColumn("seq", F.coalesce(F.count("*").over(inside), none))
        .withColumn("start", F.coalesce(F.sum("tokens").over(inside), none))
        .join(parts, [*KEY, "part"])
        .withColumn("seq", F.col("seq") + F.col("n_before"))
        .withColumn("is_system", (F.col("seq") == 0) & (F.col("system") > 0))
        .withColumn("start", F.when(F.col("is_system"), none).otherwise(F.col("start") + F.col("sum_before") - F.col("system")))
        .withColumn("room", room)
    )
    return with_spans(turns).select(*KEY, "span", "seq", "start", "is_system", "role", "text")


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256, history_turns: int = 2) -> DataFrame:
    """Formatted windows of all conversations.

    conversations: conv_id, turn, role, text; further columns are ignored. Turns
    go by turn (null first), then role, then text; null roles and texts count as
    empty; null conv_ids are one conversation; rows that repeat are turns that
    repeat. Returns a row for each window: conv_id, window (rising), formatted,
    n_context (leading turns that an earlier window has as targets, or the
    system turn again) and loss (spans of code points, end exclusive, that hold
    the escaped text of each fresh assistant turn). An empty table gives none.
    """
    turns = c.staged(placed_turns(conversations, budget, history), "chat-turns")
    fresh = turns.select(*KEY, "span", "seq", F.lit(True).alias("fresh"), "role", "text")
    starts = turns.groupBy(*KEY, "span").agg(F.min_by(F.struct("seq", "start"), "seq").alias("at"))
    starts = starts.select(*KEY, "span", F.col("at.seq").alias("at"), F.col("at.start").alias("from"))
    again = turns.where(~F.col("is_system")).select(*KEY, "seq", "start", "role", "text", F.explode(F.array([F.lit(k) for k in range(1, history_turns + 1)])).alias("k"))
    again = again.withColumn("at", F.col("seq") + F.col("k")).join(starts, [*KEY, "at"]).where(F.col("from") - F.col("start") <= history)
    system = turns.where("is_system").select(*KEY, "seq", "role", "text").join(starts.where("span > 0").select(*KEY, "span"), KEY)
    late = F.lit(False).alias("fresh")
    rows = c.union([fresh, again.select(*KEY, "span", "seq", late, "role", "text"), system.select(*KEY, "span", "seq", late, "role", "text")])
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))  # the first bare newline ends the role
    piece = F.concat(F.lit(OPEN), role, F.lit("\n"), escaped(F.col("text")), F.lit(CLOSE))
    rows = rows.select(
        *KEY, "span", "seq", "fresh", piece.alias("piece"), F.length(escaped(F.col("text"))).alias("n"), (F.col("fresh") & (F.col("role") == "assistant")).alias("target")
    )
    windows = rows.groupBy(*KEY, "span").agg(F.array_sort(F.collect_list(F.struct("seq", "fresh", "piece", "n", "target"))).alias("turns"))
    tail = len(CLOSE)
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["piece"])).alias("at"),
            F.when(
                t["target"],
                F.concat(
                    acc["loss"],
                    F.array(F.struct((acc["at"] + F.length(t["piece"]) - tail - t["n"]).alias("start"), (acc["at"] + F.length(t["piece"]) - tail).alias("end"))),
                ),
            )
            .otherwise(acc["loss"])
            .alias("loss"),
        ),
        lambda acc: acc["loss"],
    )
    return windows.select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"),
        F.col("span").alias("window"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: ~t["fresh"])).alias("n_context"),
        spans.alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """What formatted windows say: conv_id, window, turns (role, text of the fresh ones), targets (texts under the mask)."""
    pieces = F.split(F.regexp_replace("formatted", r"<\|im_end\|>\n\z", ""), r"<\|im_end\|>\n")
    head = rf"(?s)\A<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*)\z"
    return windows.select(
        "conv_id",
        "window",
        F.transform(
            F.slice(pieces, F.col("n_context") + 1, F.size(pieces)),
            lambda p: F.struct(unescaped(F.regexp_extract(p, head, 1)).alias("role"), unescaped(F.regexp_extract(p, head, 2)).alias("text")),
        ).alias("turns"),
        F.transform("loss", lambda s: unescaped(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))).alias("targets"),
        F.length("formatted").alias("chars"),
    )


def with_control_strings(conversations: DataFrame) -> DataFrame:
    """conversations and one more, -1, whose turns look like the template."""
    said = CLOSE.strip() + OPEN + "assistant ok"
    more = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)


def op5_chat_windows(spark, sf_dir: str) -> DataFrame:
    """What format_windows() makes of all conversations, and of one that looks like the template, read back; it says what holds for nulls, ties and repeated rows."""
    windows = c.staged(format_windows(with_control_strings(c.table(spark, sf_dir, "conversations"))), "chat-windows")
    read = read_windows(windows).select(
        "conv_id",
        "window",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("loss"),
        "chars",
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("windows"),
        F.sum("chars").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("windows", lambda w: w["loss"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("windows", lambda w: w["said"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP5_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
numbered AS (
  SELECT *, row_number() OVER w - 1 AS seq, ceil(length(text) / 4.0)::BIGINT + 4 AS tokens,
         length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10))) + 24 AS chars
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
led AS (
  SELECT *, seq = 0 AND role = 'system' AS is_system,
         max(CASE WHEN seq = 0 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS system,
         max(CASE WHEN seq = 0 AND role = 'system' THEN chars ELSE 0 END) OVER (PARTITION BY conv_id) AS system_chars
  FROM numbered),
summed AS (
  SELECT *, greatest(1024 - 256 - system, 256) AS room, seq // 256 AS chapter,
         CASE WHEN is_system THEN 0 ELSE sum(tokens) OVER (PARTITION BY conv_id ORDER BY seq) - tokens - system END AS start
  FROM led),
chapters AS (
  SELECT conv_id, chapter, any_value(room) AS room, list({'w': start, 'e': start + tokens, 'cuts': [seq]} ORDER BY seq) AS turns FROM summed WHERE NOT is_system GROUP BY conv_id, chapter),
cuts AS (
  SELECT conv_id, chapter, list_reduce(turns, lambda a, b:
    CASE WHEN b.e - a.w > room THEN {'w': b.w, 'e': b.e, 'cuts': list_concat(a.cuts, b.cuts)} ELSE {'w': a.w, 'e': b.e, 'cuts': a.cuts} END).cuts AS cuts
  FROM chapters),
spans AS (
  SELECT s.*, CASE WHEN is_system THEN 0 ELSE s.chapter * 512 + len(list_filter(cuts, lambda x: x <= seq)) - 1 END AS span
  FROM summed s LEFT JOIN cuts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.chapter = s.chapter),
starts AS (SELECT conv_id, span, min(seq) AS at, arg_min(start, seq) AS "from", max(system_chars) AS system_chars FROM spans GROUP BY ALL),
again AS (
  SELECT t.conv_id, t.chars FROM spans t JOIN starts s ON s.conv_id IS NOT DISTINCT FROM t.conv_id
  AND s.at IN (t.seq + 1, t.seq + 2) WHERE NOT t.is_system AND s."from" - t.start <= 256),
total AS (
  SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM (
    SELECT conv_id, chars FROM spans UNION ALL SELECT conv_id, chars FROM again
    UNION ALL SELECT conv_id, system_chars FROM starts WHERE span > 0) GROUP BY 1)
SELECT g.conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '')) AS loss_sha256,
       any_value(formatted_chars) AS formatted_chars
FROM numbered g JOIN total ON total.conv_id IS NOT DISTINCT FROM g.conv_id GROUP BY g.conv_id
"""
