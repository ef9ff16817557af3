"""Chat formatting of typed content parts, native: turns between control strings, parts flattened in order.

A message holds parts (kind, text, ref, units): text parts give their text, image, audio and document parts a
placeholder, a reference and a count of expanded tokens. Output and masks are made and read back by
built-in functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PARTS = "array<struct<kind:string,text:string,ref:string,units:int>>"
#: Per kind of attachment its placeholder and the tokens that one unit (tile, second, page) expands to.
KINDS = {"image": ("<|image|>", 256), "audio": ("<|audio|>", 25), "document": ("<|document|>", 512)}


def escaped(text: Column) -> Column:
    """Text in which no control string can stand: backslashes double and `<|` becomes `<\\|`. Reversible."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    """Undoes escaped(). Pairs of backslashes are set apart first, so that `<\\\\|` stays what it was."""
    parts = F.transform(F.split(text, r"\\\\", -1), lambda x: F.replace(x, F.lit("<\\|"), F.lit("<|")))
    return F.array_join(parts, "\\")


def escaped_role(role: Column) -> Column:
    """A role on its line: escaped, and line ends written as \\n."""
    return F.replace(escaped(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\", -1), lambda x: F.replace(F.replace(x, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def flattened(parts: Column) -> Column:
    """struct(body, attachments, expanded): a visit of the parts in order.

    body: escaped texts and placeholders, nothing between; attachments: (kind, ref, tokens) in order;
    expanded: their tokens. Null parts or texts give nothing; an unknown kind gives its escaped text.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    mark, cost = F.create_map(*[F.lit(x) for k, (m, _) in KINDS.items() for x in (k, m)]), F.create_map(*[F.lit(x) for k, (_, c) in KINDS.items() for x in (k, c)])
    body = F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at(mark, p["kind"]), escaped(F.coalesce(p["text"], F.lit(""))))), "")
    held = F.filter(parts, lambda p: F.element_at(mark, p["kind"]).isNotNull())
    notes = F.transform(held, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), (F.element_at(cost, p["kind"]) * F.coalesce(p["units"], F.lit(1))).cast("long").alias("tokens")))
    return F.struct(body.alias("body"), notes.alias("attachments"), F.aggregate(notes, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded"))


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def formatted(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per conversation: (conv_col, formatted, loss_spans, attachments, expanded_tokens, n_turns).

    Turns stand in order of turn_col (null first; turns of one number by role, then body; repeated rows are
    turns of their own). formatted: per turn START, role, line end, body, END, line end. loss_spans:
    (start, length) in code points of the bodies of `learned` roles. attachments: (turn, kind, ref, tokens),
    turn being the position from 0. A null conversation id is a conversation of its own; a conversation is one
    output row, so its size bounds a row and nothing else; an empty table gives an empty one.
    """
    m = messages.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), flattened(F.col(f"`{parts_col}`")).alias("x"))
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    tail = len(END) + 1
    m = m.select("conv", "turn", "role", F.col("x.body").alias("body"), head.alias("head"), F.col("x.attachments").alias("attachments"), F.col("x.expanded").alias("expanded"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "body", "attachments").rowsBetween(Window.unboundedPreceding, 0)
    width = F.length("head") + F.length("body") + tail
    m = m.withColumn("begin", (F.sum(width).over(order) - width).cast("int"))
    row = F.struct("turn", "role", "body", "attachments", "begin", "head", "expanded")
    turns = m.select("conv", row.alias("r")).groupBy("conv").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    spans = F.transform(F.filter("rows", lambda r: F.coalesce(r["role"], F.lit("")).isin(*learned)), lambda r: F.struct((r["begin"] + F.length(r["head"])).alias("start"), F.length(r["body"]).alias("length")))
    notes = F.flatten(F.transform("rows", lambda r, i: F.transform(r["attachments"], lambda a: F.struct(i.alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return turns.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("rows", lambda r: F.concat(r["head"], r["body"], F.lit(END + "\n"))), "").alias("formatted"),
        spans.alias("loss_spans"),
        notes.alias("attachments"),
        F.aggregate(F.transform("rows", lambda r: r["expanded"]), F.lit(0).cast("long"), lambda a, x: a + x).alias("expanded_tokens"),
        F.size("rows").cast("long").alias("n_turns"),
    )


def parsed(formatted_: DataFrame, col: str = "formatted") -> Column:
    """array<struct<role,text>> read back from a formatted text: control strings cut it, texts are unescaped.

    Placeholders of attachments stay in the text as they stand in the output.
    """
    pieces = F.filter(F.split(F.col(col), r"<\|im_start\|>", -1), lambda p: F.length(p) > 0)
    inner = lambda p: F.substring(p, F.lit(1), F.length(p) - len(END) - 1)
    role = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(pieces, lambda p: F.struct(unescaped_role(role(p)).alias("role"), unescaped(F.substring(inner(p), F.length(role(p)) + 2, F.length(p))).alias("text")))


def loss_text(col: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped span by span, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(F.col(col), s["start"] + 1, s["length"]))), "")
