"""Chat formatting with typed content parts, in DataFrame functions only.

Each turn holds an ordered array of parts. Text parts are escaped and written out; image, audio and document parts
become placeholders, and their references and expanded token counts are recorded beside the formatted text.

Template (fixed): <|role|>, the role's name, <|body|> and a line feed, the parts, <|end|> and a line feed; a part that isn't text is
<|part:type|>. Inside texts and role names every control string gets a backslash after its first character and every backslash is
doubled, so no control string of this or another template survives and dropping each escaping backslash gives the text back.
A placeholder's name can't be that of another control string, so no role, text or type can forge the boundary of a turn.

Places are sums of lengths over a window, so work grows with the length of a conversation, not with its square.

Defined cases: null texts, roles and parts are empty; turns go by turn, then role and text, nulls first; repeated rows
are turns of their own; a null conv_id is a conversation; unknown part types become placeholders; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLE, BODY, END = "<|role|>", "<|body|>\n", "<|end|>\n"
#: Fixed control strings of public chat templates; their first characters open an escape.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]
#: Expanded token counts: an image by tiles, audio by seconds, a document by pages (parameters of the format).
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}

PARTS = "array<struct<type:string,text:string,ref:string,units:long>>"


def escaped(text: Column) -> Column:
    pattern = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\"), pattern, r"\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def placeholder(part: Column) -> Column:
    kind = F.coalesce(part["type"], F.lit("unknown"))
    return F.concat(F.lit("<|part:"), F.regexp_replace(kind, "[^a-z]", "_"), F.lit("|>"))


def part_tokens(part: Column) -> Column:
    per = F.create_map(*[F.lit(x) for kv in TOKENS_PER_UNIT.items() for x in kv])
    return F.coalesce(F.try_element_at(per, part["type"]), F.lit(1)).cast("long") * F.coalesce(part["units"], F.lit(1))


def visit(parts: Column) -> Column:
    """Flatten the parts of a turn into one string. Neighbouring text parts are escaped together, so none completes another's control string."""
    begin = F.struct(F.lit("").alias("done"), F.lit("").alias("run"))

    def step(state: Column, part: Column) -> Column:
        text = F.struct(state["done"].alias("done"), F.concat(state["run"], F.coalesce(part["text"], F.lit(""))).alias("run"))
        other = F.struct(F.concat(state["done"], escaped(state["run"]), placeholder(part)).alias("done"), F.lit("").alias("run"))
        return F.when(part["type"].eqNullSafe("text"), text).otherwise(other)

    return F.aggregate(F.coalesce(parts, F.expr(f"cast(array() as {PARTS})")), begin, step, lambda state: F.concat(state["done"], escaped(state["run"])))


def attachments(parts: Column) -> Column:
    others = F.filter(F.coalesce(parts, F.expr(f"cast(array() as {PARTS})")), lambda p: ~p["type"].eqNullSafe("text"))
    return F.transform(others, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))


def text_parts(text: Column) -> Column:
    """The content of a plain-text turn."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def format_conversations(turns: DataFrame, content: str = "content") -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (turn from 0, start and length in code points of each assistant body), attachments.

    Each turn is formatted on its own row; a conversation gathers the formatted turns in order.
    """
    rows = turns.select(
        "conv_id", "turn",
        F.concat(F.lit(ROLE), escaped(F.col("role")), F.lit(BODY)).alias("head"),
        visit(F.col(content)).alias("body"),
        F.col("role").eqNullSafe("assistant").alias("loss"),
        attachments(F.col(content)).alias("attached"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "head", "body", "attached")
    length = F.char_length("head") + F.char_length("body") + len(END)
    placed = rows.select("*", (F.row_number().over(order) - 1).alias("k"), F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    gathered = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "at", "head", "body", "loss", "attached"))).alias("ts"))
    spans = F.transform(F.filter("ts", lambda t: t["loss"]), lambda t: F.struct(t["k"].alias("turn"), (t["at"] + F.char_length(t["head"])).alias("start"), F.char_length(t["body"]).cast("long").alias("length")))
    return gathered.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.flatten(F.transform("ts", lambda t: t["attached"])).alias("attachments"),
    )


def turn_strings(formatted: Column) -> Column:
    """The turns of a formatted conversation, each without what ends it."""
    return F.slice(F.split(formatted, re.escape(END), -1), 1, F.size(F.split(formatted, re.escape(END), -1)) - 1)


def read_back(pieces: Column) -> Column:
    """(role, text) of each turn string; placeholders stay as they are."""

    def opened(p: Column) -> Column:
        head = F.substring_index(p, BODY, 1)
        return F.struct(
            unescaped(F.substring(head, len(ROLE) + 1, 2**31 - 1)).alias("role"),
            unescaped(F.substring(p, F.char_length(head) + len(BODY) + 1, F.lit(2**31 - 1))).alias("text"),
        )

    return F.transform(pieces, opened)


def conversation_digest(conversations: DataFrame) -> DataFrame:
    """The columns of the query, each read back from the formatted text.

    The loss mask's spans are taken out of the turn they lie in: a span ends where the turn's closing string begins.
    """
    formatted = format_conversations(conversations.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("content")))
    opened = formatted.select("conv_id", "formatted", "loss_spans", turn_strings(F.col("formatted")).alias("pieces"))
    masked = F.transform("loss_spans", lambda s: unescaped(F.substring(F.element_at("pieces", s["turn"] + 1), -s["length"].cast("int"), s["length"].cast("int"))))
    return opened.select("conv_id", read_back(F.col("pieces")).alias("turns"), F.array_join(masked, "").alias("loss"), "formatted").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
