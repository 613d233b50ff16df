"""Chat formatting by prefix-target expansion.

A conversation is rendered turn by turn, each turn as

    <s>[ROLE] escaped text</s>

Every assistant turn becomes an example of its own: all turns before it are
context, and only its reply is trainable.  Turns after the last reply (or of a
conversation without one) make a last example with nothing to train on, so no
turn is lost.

Texts and roles may hold the control strings themselves.  A backslash goes
behind every one of ``\\ < [ ]`` in them, so neither ``</s>`` nor ``[INST]`` nor
any other bracketed control string can come out of a text; taking the
backslashes out again gives the text back exactly.

Only DataFrame functions are used.  One shuffle brings a conversation's turns
together; the examples and what is read back from them stay there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>[", "</s>"
_SPECIAL = r"([\\<\[\]])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _SPECIAL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _SPECIAL + r"\\", "$1")


def format_examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text", target_role: str = "assistant") -> DataFrame:
    """``(conv_id, example, n_examples, text, loss_start, loss_length)``, one
    row per assistant turn plus one per conversation that does not end with
    one.  The loss span is in code points from 0; it holds the escaped reply.

    Defined results: a null text or role counts as empty; null turn numbers
    come first; turns with the same number are ordered by role and text, and
    repeated rows stay repeated turns; rows of a null conversation id form one
    conversation; an empty table gives no rows; other columns are not read.
    """
    one = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
                 F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    whole = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    whole = whole.select("conv_id", F.transform("t", lambda t: F.struct(
        t["role"].alias("role"),
        F.concat(F.lit(OPEN), escape(t["role"]), F.lit("] ")).alias("head"),
        escape(t["text"]).alias("body"))).alias("t"))
    last = F.size("t") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: (F.col("t")[i]["role"] == target_role) | (i == last))
    rows = whole.select("conv_id", "t", targets.alias("targets"))
    rows = rows.select("conv_id", "t", F.size("targets").alias("n_examples"), F.posexplode("targets").alias("example", "at"))
    shown = F.array_join(F.transform(F.slice("t", F.lit(1), F.col("at") + 1), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    reply = F.col("t")[F.col("at")]
    rows = rows.select("conv_id", "example", "n_examples", shown.alias("text"),
                       F.when(reply["role"] == target_role, F.length(reply["body"])).otherwise(0).cast("long").alias("loss_length"))
    return rows.select("conv_id", "example", "n_examples", "text",
                       (F.length("text") - F.col("loss_length") - len(CLOSE)).cast("long").alias("loss_start"), "loss_length")


def read_turns(text: Column) -> Column:
    """The ``(role, text)`` turns of a formatted example, read back."""
    parts = F.filter(F.split(text, CLOSE), lambda p: p != "")
    pattern = r"(?s)\A<s>\[(.*?)\] (.*)\z"
    return F.transform(parts, lambda p: F.struct(
        unescape(F.regexp_extract(p, pattern, 1)).alias("role"), unescape(F.regexp_extract(p, pattern, 2)).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: ``n_turns``,
    ``turns_sha256`` (role, newline, text, newline per turn), ``loss_chars``
    and ``loss_sha256`` of all text under the loss mask, ``formatted_chars``
    (code points of all examples)."""
    whole = F.when(F.col("example") == F.col("n_examples") - 1, read_turns(F.col("text")))   # the longest prefix is the last
    rows = examples.select(
        "conv_id", "example", whole.alias("turns"), F.length("text").cast("long").alias("chars"),
        unescape(F.substring("text", F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int"))).alias("loss"))
    rows = rows.select(
        "conv_id", "example", "chars", "loss", F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("flat"))
    whole = rows.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"), F.max("flat").alias("flat"), F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"))
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.col("flat").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars")
