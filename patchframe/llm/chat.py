"""Chat formatting with typed content parts, in built-in functions only.

A visitor flattens the parts of each turn, in order, into one string.  Text is escaped,
other parts become placeholders; the attachments behind them and the tokens they expand
to are recorded, and a loss mask says which characters of a turn an assistant wrote.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Strings with a meaning in the template, and the parts it knows.
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROL = [BEGIN, END, OPEN, CLOSE, *PLACEHOLDERS.values()]

PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"
_ESCAPED = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)


def escape(text: Column) -> Column:
    """Text in which no control string is left: backslashes doubled, one set behind a control string's first character."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _ESCAPED, r"\\")


def unescape(text: Column) -> Column:
    """What :func:`escape` was given."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _apart(kinds: Column, rendered: Column) -> Column:
    """Rendered parts, a backslash before a text that forms a control string with the texts it directly follows."""
    most = max(map(len, CONTROL)) - 1
    any_control = "|".join(map(re.escape, CONTROL))
    pairs = F.arrays_zip(kinds.alias("kind"), rendered.alias("s"))

    def step(a: Column, x: Column) -> Column:
        s = F.when((x["kind"] == "text") & F.concat(a["tail"], x["s"]).rlike(any_control), F.concat(F.lit("\\"), x["s"])).otherwise(x["s"])
        tail = F.when(x["kind"] == "text", F.right(F.concat(a["tail"], s), F.lit(most))).otherwise(F.lit(""))
        return F.struct(F.concat(a["s"], F.array(s)).alias("s"), tail.alias("tail"))

    return F.aggregate(pairs, F.struct(F.array().cast("array<string>").alias("s"), F.lit("").alias("tail")), step)["s"]


def text_part(text: Column) -> Column:
    """The parts of a turn that is one text."""
    none = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.alias("ref"), F.lit(None).cast("bigint").alias("tokens")))


def format_turns(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
                 learn: str = "assistant") -> DataFrame:
    """One formatted string per conversation.

    The project keeps no conversations, so this is general: rows of ``id, turn, role,
    parts``, with ``parts`` an array of ``kind, text, ref, tokens``.

    formatted     every turn as ``<s>[INST]role[/INST]parts</s>``
    turns         per turn its start, length and ``loss``: spans (from the turn's start)
                  of the text parts of turns by ``learn``
    attachments   per placeholder: turn, part, kind, ref, tokens it expands to, start
    n_expanded    tokens that all placeholders expand to

    Turns go by ``turn``, then role, then parts, so ties and repeated rows have one
    order and stay.  A null text, role or list of parts is empty; a null turn comes
    first; a null id is a conversation of its own.  A part of unknown kind is an error.
    Other columns do not matter.  Positions count code points.  A conversation becomes one row, as its
    result is one string; nothing else is gathered.
    """
    known = F.create_map(*[F.lit(x) for k in PLACEHOLDERS.items() for x in k])
    T = turns.select(
        F.col(id).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"),
        F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("p"),
    )
    rendered = F.transform("p", lambda x: F.when(x["kind"] == "text", escape(F.coalesce(x["text"], F.lit("")))).otherwise(
        F.coalesce(known[x["kind"]], F.raise_error(F.concat(F.lit("chat: unknown kind of part "), F.coalesce(x["kind"], F.lit("null")))).cast("string"))))
    T = T.withColumn("s", rendered).withColumn("s", F.when(F.size("p") > 1, _apart(F.transform("p", lambda x: x["kind"]), F.col("s"))).otherwise(F.col("s"))).withColumn("head", F.concat(F.lit(BEGIN + OPEN), escape(F.col("r")), F.lit(CLOSE)))
    # Start of each part within its turn, by a running sum over the (few) parts of one turn.
    T = T.withColumn("at", F.aggregate("s", F.array(F.length("head")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x)))))
    T = T.withColumn("body", F.concat("head", F.array_join("s", ""), F.lit(END))).withColumn("n", F.length("body"))
    zipped = F.transform("p", lambda x, i: F.struct(
        x["kind"].alias("kind"), x["ref"].alias("ref"), F.coalesce(x["tokens"], F.lit(0)).cast("bigint").alias("tokens"),
        i.alias("part"), F.get("at", i).cast("bigint").alias("start"), F.length(F.get("s", i)).cast("bigint").alias("length")))
    T = T.withColumn("z", zipped)
    loss = F.transform(F.filter("z", lambda x: (x["kind"] == "text") & (F.col("r") == learn)), lambda x: F.struct(x["start"], x["length"]))
    held = F.transform(F.filter("z", lambda x: x["kind"] != "text"), lambda x: F.struct(
        x["part"].alias("part"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens"), x["start"].alias("start")))
    order = W.partitionBy("c").orderBy("t", "r", "body")
    T = T.select(
        "c", "body", loss.alias("loss"), held.alias("held"), F.col("n").cast("bigint").alias("n"),
        F.row_number().over(order).alias("i"), F.sum(F.col("n").cast("bigint")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("upto"),
    )
    G = T.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("i", "body", "upto", "n", "loss", "held"))).alias("g"))
    attachments = F.flatten(F.transform("g", lambda x: F.transform(x["held"], lambda h: F.struct(
        (x["i"] - 1).alias("turn"), h["part"].alias("part"), h["kind"].alias("kind"), h["ref"].alias("ref"), h["tokens"].alias("tokens"),
        (x["upto"] - x["n"] + h["start"]).alias("start")))))
    return G.select(
        F.col("c").alias(id), F.array_join(F.col("g.body"), "").alias("formatted"),
        F.transform("g", lambda x: F.struct((x["upto"] - x["n"]).alias("start"), x["n"].alias("length"), x["loss"].alias("loss"))).alias("turns"),
        attachments.alias("attachments"),
    ).withColumn("n_expanded", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]))


def read_turns(formatted: DataFrame, id: str = "conv_id") -> DataFrame:
    """What a formatted conversation holds: ``id, n_turns, turns array<role, text>, loss, n_chars``.

    Read from the string and its mask alone.  Texts come back unescaped; a placeholder
    stays as it stands (``attachments`` says where they are).  ``loss`` is all text
    under the mask, unescaped, in order with nothing between.
    """
    cut = F.split("formatted", re.escape(END), -1)
    two = F.transform(F.slice("cut", F.lit(1), F.size("cut") - 1), lambda x: F.split(x, re.escape(CLOSE), 2))
    read = F.transform("two", lambda x: F.struct(
        unescape(F.substring(x[0], len(BEGIN + OPEN) + 1, 1 << 30)).alias("role"), unescape(x[1]).alias("text")))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    under = F.flatten(F.zip_with("cut", F.col("turns.loss"), lambda piece, spans: F.transform(
        F.coalesce(spans, none), lambda s: unescape(piece.substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))))
    return formatted.withColumn("cut", cut).withColumn("two", two).select(
        F.col(id), F.size("two").cast("long").alias("n_turns"), read.alias("turns"), F.array_join(under, "").alias("loss"),
        F.length("formatted").cast("long").alias("n_chars"),
    )
