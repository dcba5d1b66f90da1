"""Chat formatting with a grammar round trip, in DataFrame functions alone.

    conversation := mode turn*          mode := "<s>" | "<s>\\"
    turn         := "[INST]" role "[/INST]" text "</s>"

Every conversation is rendered plainly, parsed back by the grammar and compared with its
source. Where that differs, because a role or text holds a control string, the
conversation is rendered again with such content escaped (`mode` says which).
Escaping is reversible: backslash becomes `\\b`, the four control strings `\\s`, `\\e`, `\\i`, `\\j`.

Defined results: null text and role are empty; a null conv_id forms one conversation of its
own; turns of equal number go by role, then text; null turns come first; repeated rows are
turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template, and what stands for them inside escaped content.
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
ESCAPES = {"\\": "\\b", BEGIN: "\\s", END: "\\e", OPEN: "\\i", CLOSE: "\\j"}
ESCAPED_MODE = BEGIN + "\\"
_CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES.items():  # the backslash first
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES.items()):  # the backslash last
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def render(turns: Column, escaped: bool) -> Column:
    put = escape if escaped else lambda x: x
    parts = F.transform(
        turns, lambda t: F.concat(F.lit(OPEN), put(t["role"]), F.lit(CLOSE), put(t["text"]), F.lit(END))
    )
    return F.concat(F.lit(ESCAPED_MODE if escaped else BEGIN), F.array_join(parts, ""))


def parse(df: DataFrame, formatted: str, out: str) -> DataFrame:
    """Add `out`: the turns of a rendered conversation, or null where the grammar does not hold.

    Each step is a column of its own, so that it is computed once.
    """
    text = F.col(formatted)
    escaped = F.startswith(text, F.lit(ESCAPED_MODE))
    body = F.when(escaped, F.substring(text, len(ESCAPED_MODE) + 1, 2**31 - 1)).otherwise(
        F.substring(text, len(BEGIN) + 1, 2**31 - 1)
    )
    pieces, turns = F.col("__pieces"), F.col("__turns")
    split = df.withColumn("__pieces", F.split(body, END, -1)).withColumn(
        # a turn without its end mark has two control strings, the open mark first, the close mark after it
        "__turns",
        F.transform(
            F.slice(pieces, F.lit(1), F.size(pieces) - 1),
            lambda s: F.transform(
                F.array(F.split(s, _CONTROL, -1)),
                lambda p: F.struct(
                    (
                        (F.size(p) == 3)
                        & (F.concat(F.lit(OPEN), F.get(p, F.lit(1)), F.lit(CLOSE), F.get(p, F.lit(2))) == s)
                    ).alias("fits"),
                    F.get(p, F.lit(1)).alias("role"),
                    F.get(p, F.lit(2)).alias("text"),
                ),
            )[0],
        ),
    )
    well_formed = (
        F.startswith(text, F.lit(BEGIN)) & (F.element_at(pieces, -1) == "") & F.forall(turns, lambda t: F.coalesce(t["fits"], F.lit(False)))
    )
    plain = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    coded = F.transform(
        turns, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))
    )
    return split.withColumn(out, F.when(well_formed, F.when(escaped, coded).otherwise(plain))).drop("__pieces", "__turns")


def loss_segments(formatted: Column, trained_role: str = "assistant") -> Column:
    """The rendered text cut into segments, in order, each with whether a trainer takes its loss from it: the trained turns' content.

    The segments' lengths are the loss mask as run lengths; their texts, joined, are the rendered text.
    """
    pieces = F.split(formatted, END, -1)
    mark = F.concat(*(F.lit(x) for x in (OPEN, trained_role, CLOSE)))

    def cut(piece: Column, i: Column) -> Column:
        whole = F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), piece)  # the mark that ends the turn before
        at = F.instr(whole, f"{OPEN}{trained_role}{CLOSE}")
        head = F.when(at > 0, F.substring(whole, F.lit(1), at - 1 + F.length(mark))).otherwise(whole)
        tail = F.when(at > 0, F.substring(whole, at + F.length(mark), F.length(whole))).otherwise(F.lit(""))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")), F.struct(tail.alias("text"), F.lit(True).alias("loss"))
        )

    return F.filter(F.flatten(F.transform(pieces, cut)), lambda x: x["text"] != "")


def format_chats(
    rows: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row a conversation: `formatted`, whether `escaped`, the turns `parsed` back from it, and whether they are `identical` to the source."""
    turns = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    source = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("s")).select(
        "conv_id",
        F.transform("s", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
    )
    plain = parse(source.withColumn("plain", render(F.col("turns"), False)), "plain", "from_plain")
    tried = plain.withColumn("escaped", ~F.coalesce(F.col("from_plain") == F.col("turns"), F.lit(False)))
    coded = tried.withColumn("coded", F.when(F.col("escaped"), render(F.col("turns"), True)))
    read = parse(coded, "coded", "from_coded")
    return read.select(
        "conv_id",
        F.when(F.col("escaped"), F.col("coded")).otherwise(F.col("plain")).alias("formatted"),
        "escaped",
        F.when(F.col("escaped"), F.col("from_coded")).otherwise(F.col("from_plain")).alias("parsed"),
        (~F.col("escaped") | F.coalesce(F.col("from_coded") == F.col("turns"), F.lit(False))).alias("identical"),
    )


def loss_text(formatted: Column, segments: Column) -> Column:
    """All text under the loss mask, unescaped, joined with nothing between."""
    escaped = F.startswith(formatted, F.lit(ESCAPED_MODE))
    under = F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: x["text"]), "")
    return F.when(escaped, unescape(under)).otherwise(under)
