"""Chat formatting in budgeted windows.

The turns of a conversation get prefix sums of their tokens.  A window is a span of whole
turns, as many as fit the budget next to the system turn and the repeated history; every
window begins with the system turn and a limited history of the turns before it.  What is
repeated is context: only an assistant turn that is new in its window is under the loss
mask, so each is learnt once.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.  In roles and texts ``&`` becomes
``&amp;`` and ``<|`` becomes ``&lt;|`` (in roles also the newline ``&nl;``), so that a text
can hold any control string and is read back exactly.

Defined cases: a null text or role is empty; a null conv_id is a conversation of its own; turns
with equal numbers are ordered by role and text, null turns come first; equal rows are
turns of their own; a turn above the budget is a window alone; an empty table gives an
empty result; other columns do not take part.  The order of a conversation's text needs its
turns in one row, so a conversation must fit in a task; conversations are never split
across rows nor gathered beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let

START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET = 512
HISTORY_TURNS = 2
HISTORY_TOKENS = 128
#: Tokens that the template adds to a turn.
OVERHEAD = 4


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def n_tokens(text: Column) -> Column:
    """Default token count of a text: its words, plus the template."""
    return F.size(F.array_remove(F.split(text, SPACES), "")) + OVERHEAD


def _total(turns: Column) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda n, t: n + t["tokens"])


def _windows(system: Column, turns: Column, budget: int, history_turns: int, history_tokens: int) -> Column:
    """Structs first, end (of the new turns), begin (of the history)."""
    room = F.greatest(F.lit(1).cast("long"), budget - _total(system) - history_tokens)
    empty = F.expr("CAST(array() AS array<int>)")
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"), empty.alias("starts"))

    def step(acc: Column, turn: Column, limit: Column) -> Column:
        opens = (acc["at"] == 0) | (acc["used"] + turn["tokens"] > limit)
        return F.struct(
            F.when(opens, turn["tokens"]).otherwise(acc["used"] + turn["tokens"]).alias("used"),
            (acc["at"] + 1).alias("at"),
            F.when(opens, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"),
        )

    def spans(limit: Column) -> Column:
        starts = F.aggregate(turns, zero, lambda acc, turn: step(acc, turn, limit), lambda acc: acc["starts"])
        return let(starts, lambda s: F.transform(s, lambda first, i: span(first, F.coalesce(F.get(s, i + 1), F.size(turns)))))

    def span(first: Column, end: Column) -> Column:
        back = F.filter(
            F.sequence(F.greatest(F.lit(0), first - history_turns), first),
            lambda h: _total(F.slice(turns, h + 1, first - h)) <= history_tokens,
        )
        return F.struct(first.alias("first"), end.alias("end"), F.array_min(back).alias("begin"))

    return let(room, spans)


def _formatted(system: Column, turns: Column, window: Column) -> Column:
    """One window as struct: formatted text, number of repeated turns, loss spans."""
    n_system = F.size(system)
    inside = F.concat(system, F.slice(turns, window["begin"] + 1, window["end"] - window["begin"]))
    # only the first window has the system turn for the first time
    repeated = F.when(window["first"] == 0, F.lit(0)).otherwise(n_system + window["first"] - window["begin"])

    def of(pieces: Column) -> Column:
        ends = F.aggregate(
            pieces,
            F.expr("CAST(array(0L) AS array<bigint>)"),
            lambda acc, p: F.concat(acc, F.array(F.get(acc, F.size(acc) - 1) + F.char_length(p["head"]) + F.char_length(p["body"]) + len(END))),
        )
        spans = let(
            ends,
            lambda at: F.filter(
                F.transform(
                    pieces,
                    lambda p, i: F.struct(
                        (F.get(at, i) + F.char_length(p["head"])).alias("start"),
                        F.char_length(p["body"]).cast("long").alias("length"),
                        (p["target"] & (i >= repeated)).alias("learn"),
                    ),
                ),
                lambda x: x["learn"],
            ),
        )
        return F.struct(
            F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
            repeated.alias("n_repeated"),
            F.transform(spans, lambda x: F.struct(x["start"], x["length"])).alias("loss_spans"),
        )

    pieces = F.transform(
        inside,
        lambda t: F.struct(
            F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("target"),
        ),
    )
    return let(pieces, of)


def format_windows(
    turns: DataFrame,
    *,
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
    tokens=n_tokens,
) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, window, formatted, n_repeated, loss_spans.

    `n_repeated` counts the leading turns of a window that were in an earlier one;
    `loss_spans` are (start, length) in code points of `formatted`.  One shuffle, by
    conversation.
    """
    text = F.coalesce("text", F.lit(""))
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        text.alias("text"),
        tokens(text).cast("long").alias("tokens"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    leads = F.get(F.col("turns"), F.lit(0))["role"] == "system"
    whole = whole.select(
        "conv_id",
        F.when(leads, F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0)).alias("system"),
        F.when(leads, F.slice("turns", F.lit(2), F.size("turns"))).otherwise(F.col("turns")).alias("turns"),
    )
    spans = _windows(F.col("system"), F.col("turns"), budget, history_turns, history_tokens)
    # a conversation of a system turn alone is still one window
    alone = F.expr("array(named_struct('first', 0, 'end', 0, 'begin', 0))")
    whole = whole.withColumn("spans", F.when(F.size("turns") == 0, alone).otherwise(spans))
    made = whole.withColumn("made", F.transform("spans", lambda w: _formatted(F.col("system"), F.col("turns"), w)))
    return made.select("conv_id", F.posexplode("made").alias("window", "m")).select("conv_id", "window", "m.*")


def read_back(windows: DataFrame) -> DataFrame:
    """The result of `format_windows` -> conv_id, n_turns, digests of turns and learnt text.

    Everything is read from the formatted text and its spans: turns that are not repeated,
    in order, and the text under the loss mask.
    """
    turn_texts = F.split("formatted", r"<\|im_end\|>\n", -1)
    new = F.slice(turn_texts, F.col("n_repeated") + 1, F.size(turn_texts) - 1 - F.col("n_repeated"))

    def parsed(t: Column) -> Column:
        bare = F.substr(t, F.lit(len(START) + 1))
        cut = F.locate("\n", bare)
        return F.concat(
            _unescape_role(F.substr(bare, F.lit(1), cut - 1)), F.lit("\n"), unescape(F.substr(bare, cut + 1)), F.lit("\n")
        )

    learnt = F.transform(
        "loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    )
    part = F.struct(
        "window",
        F.size(new).alias("n"),
        F.array_join(F.transform(new, parsed), "").alias("turns"),
        F.array_join(learnt, "").alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    whole = windows.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("p"))

    def joined(name: str) -> Column:
        return F.array_join(F.transform("p", lambda x: x[name]), "")

    def summed(name: str) -> Column:
        return F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x[name])

    return whole.select(
        "conv_id",
        summed("n").alias("n_turns"),
        F.sha2(joined("turns"), 256).alias("turns_sha256"),
        F.char_length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        summed("chars").alias("formatted_chars"),
        F.size("p").cast("long").alias("n_windows"),
    )
