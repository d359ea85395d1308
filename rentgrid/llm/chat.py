"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is written as an opening mark, a space, the text, a space and the closing mark
of its role; conversations are their turns one after another. The parser cuts a
formatted text before every mark that no backslash precedes: openings and closings
must then alternate, and each opening's piece is a turn. Every turn is first rendered
as it is and parsed back. Where role and text do not come back identical, the text is
escaped (a backslash before each mark and the backslashes that lead up to it), and the
round trip is checked again; reading removes that backslash.

Turns are rendered before they are grouped, so only finished strings meet in one row.
A conversation is one row of the result, so it has to fit into one.

Defined results: a null text or role counts as empty; rows go by ``turn`` (nulls
first), then role and text; repeated rows are turns of their own; rows with a null
``conv_id`` form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening and closing marks by role. Any other role is written in its opening mark, URL-encoded.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE=", "]", "[/ROLE]")
MARK = r"\[/?INST\]|</?s>|<</?SYS>>|\[ROLE=[^\]\s]*\]|\[/ROLE\]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?=[\\\[<])\\*(?:{MARK})", r"\\$0")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*(?:{MARK}))", "$1")


def opening(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), F.url_encode(role), F.lit(OTHER[1]))
    for name, (mark, _) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def closing(role: Column) -> Column:
    out = F.lit(OTHER[2])
    for name, (_, mark) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def rendered(role: Column, text: Column) -> Column:
    return F.concat(opening(role), F.lit(" "), text, F.lit(" "), closing(role))


def pieces(formatted: Column) -> Column:
    """A formatted text cut before every mark that is not escaped."""
    return F.split(formatted, rf"(?=[\[<])(?<!\\)(?={MARK})")


def _mark(piece: Column) -> Column:
    return F.substring_index(piece, " ", 1)                   # no mark has a space


def _role(piece: Column) -> Column:
    role = F.url_decode(F.regexp_extract(_mark(piece), r"^\[ROLE=([^\]\s]*)\]$", 1))
    for name, (begin, _) in MARKS.items():
        role = F.when(_mark(piece) == begin, F.lit(name)).otherwise(role)
    return role


def _turn(piece: Column) -> Column:
    size = F.length(_mark(piece))
    text = piece.substr(size + 2, F.length(piece) - size - 2)
    return F.struct(_role(piece).alias("role"), unescaped(text).alias("text"))


def parsed(cut: Column) -> Column:
    """The turns ``(role, text)`` of a cut text; null where openings and closings do not alternate."""
    opens = F.filter(cut, lambda p, i: i % 2 == 0)
    closes = F.filter(cut, lambda p, i: i % 2 == 1)
    turns = F.transform(opens, _turn)
    valid = (F.size(opens) == F.size(closes)) & F.forall(
        opens, lambda p: p.rlike(rf"^(?:{MARK}) ") & p.endswith(" ") & ~p.rlike(r"^(?:\[/|</|<</)")) & (
        F.transform(opens, lambda p: closing(_role(p))) == closes)
    return F.when(valid, turns)


def formatted_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with ``rendered``: escaped only where the plain rendering does not read back."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    source = F.array(F.struct(F.col("role"), F.col("text")))
    plain = rows.withColumn("rendered", rendered(F.col("role"), F.col("text")))
    read = F.coalesce(parsed(pieces(F.col("rendered"))) == source, F.lit(False))
    strict = rendered(F.col("role"), escaped(F.col("text")))
    return plain.withColumn("__read", read).withColumn("rendered", F.when(F.col("__read"), F.col("rendered")).when(
        F.coalesce(parsed(pieces(strict)) == source, F.lit(False)), strict).otherwise(F.raise_error(
            F.concat(F.lit("a turn does not read back: "), F.col("text"))))).drop("__read")


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted``: one text per conversation."""
    order = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered")))
    return formatted_turns(turns).groupBy("conv_id").agg(F.array_join(F.transform(order, lambda t: t["rendered"]), "").alias("formatted"))


def read_back(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns``: the turns that the parser finds in each formatted text."""
    return conversations.withColumn("turns", parsed(pieces(F.col("formatted"))))


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: what the assistant says, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def digests(conversations: DataFrame) -> DataFrame:
    """The registered query, with conversation -1, whose texts look like marks."""
    spark = conversations.sparkSession
    hard = spark.range(2).select(F.lit(-1).cast(conversations.schema["conv_id"].dataType).alias("conv_id"),
                                 F.col("id").cast(conversations.schema["turn"].dataType).alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = read_back(formatted(conversations.select("conv_id", "turn", "role", "text").unionByName(hard)))
    said = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("turns"))
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
