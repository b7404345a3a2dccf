r"""Chat formatting with typed content parts, with DataFrame functions only.

A turn's content is a list of parts: text, image, audio, document. A visitor flattens them in order:
text is escaped, any other part becomes a placeholder that carries its running number, while its
reference and its expanded token count are recorded beside the text.

A turn reads ``<turn>role<body>content</turn>``, a part ``<kind:number>``. Every control string begins
with ``<``, and no escaped text contains one: a backslash becomes ``\b`` and ``<`` becomes ``\l``. So texts
cannot forge controls, splitting needs no context, and replacing ``\l``, then ``\b``, restores the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BODY, CLOSE = "<turn>", "<body>", "</turn>"
PART = "struct<kind:string,value:string,units:double>"


@dataclass(frozen=True)
class TokenRates:
    """Tokens that a placeholder expands to, for each unit of its part, rounded up, at least one."""

    image: float = 256.0  # a tile
    audio: float = 25.0  # a second
    document: float = 512.0  # a page


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as the one part of a turn; null is empty."""
    return F.array(
        F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("value"), F.lit(None).cast("double").alias("units"))
    )


def _visit(turns: Column, rates: TokenRates) -> Column:
    """Fold the turns into (formatted, loss, attachments, n): one visit of each part, in order."""

    def tokens(part: Column) -> Column:
        rate = F.when(part["kind"] == "image", rates.image).when(part["kind"] == "audio", rates.audio).otherwise(rates.document)
        return F.greatest(F.lit(1), F.ceil(rate * F.coalesce(part["units"], F.lit(1.0)))).cast("bigint")

    def number(done: Column, parts: Column, n: Column) -> Column:
        """Attachments before the n-th part, over all turns."""
        return done + F.size(F.filter(F.slice(parts, F.lit(1), n), lambda p: p["kind"] != "text"))

    def flat(turn: Column, done: Column) -> Column:
        """A turn's content: escaped texts and placeholders."""
        return F.array_join(
            F.transform(
                turn["parts"],
                lambda p, n: F.when(p["kind"] == "text", escape(F.coalesce(p["value"], F.lit("")))).otherwise(
                    F.concat(F.lit("<"), escape(p["kind"]), F.lit(":"), number(done, turn["parts"], n + 1).cast("string"), F.lit(">"))
                ),
            ),
            "",
        )

    # First the parts of each turn, then pieces of text and their lengths; no text is copied per turn.
    counted = F.transform(turns, lambda t: F.size(F.filter(t["parts"], lambda p: p["kind"] != "text")))
    before = F.transform(counted, lambda c, n: F.aggregate(F.slice(counted, F.lit(1), n), F.lit(0), lambda a, x: a + x))
    return F.transform(
        F.arrays_zip(turns.alias("turn"), before.alias("done")),
        lambda z: F.struct(
            F.concat(F.lit(OPEN), escape(F.coalesce(z["turn"]["role"], F.lit(""))), F.lit(BODY)).alias("head"),
            flat(z["turn"], z["done"]).alias("body"), (z["turn"]["role"] == "assistant").alias("learn"),
            F.transform(
                F.filter(
                    F.transform(z["turn"]["parts"], lambda p, n: F.struct(p.alias("p"), number(z["done"], z["turn"]["parts"], n + 1).alias("n"))),
                    lambda x: x["p"]["kind"] != "text",
                ),
                lambda x: F.struct(
                    x["n"].cast("int").alias("number"), x["p"]["kind"].alias("kind"), x["p"]["value"].alias("ref"),
                    tokens(x["p"]).alias("tokens"), z["turn"]["turn"].alias("turn"),
                ),
            ).alias("attachments"),
        ),
    )


def format_conversations(turns: DataFrame, parts: str | None = None, rates: TokenRates = TokenRates()) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans, attachments, attachment_tokens``.

    ``turns`` has conv_id, turn, role and either text or, named by ``parts``, a column of type array of
    (kind, value, units). Turns follow each other by turn, null first, ties by role, then content;
    repeated rows are repeated turns. Null text, parts and role count as empty. A null conv_id is a
    conversation of its own. ``loss_spans`` are (start, end) in code points of ``formatted``: the content
    of assistant turns, of positive length or zero. A conversation is one output row and so must fit
    in a task; nothing else is gathered. Other columns are ignored.
    """
    none = F.array().cast(f"array<{PART}>")
    content = F.coalesce(F.col(parts).cast(f"array<{PART}>"), none) if parts else text_parts(F.col("text").cast("string"))
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.col("role"), content.alias("parts")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    pieces = grouped.select("conv_id", _visit(F.col("turns"), rates).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    spans = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + len(CLOSE)).cast("bigint").alias("at"),
            F.when(
                x["learn"],
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(x["head"])).cast("bigint").alias("start"),
                            (acc["at"] + F.length(x["head"]) + F.length(x["body"])).cast("bigint").alias("end"),
                        )
                    ),
                ),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    attachments = F.flatten(F.transform("p", lambda x: x["attachments"]))
    return pieces.select(
        "conv_id", whole.alias("formatted"), spans.alias("loss_spans"), attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
    )


def _plain(content: Column) -> Column:
    """Content without placeholders, unescaped. Escaped text has no '<', so the pattern meets placeholders only."""
    return unescape(F.regexp_replace(content, "<[^>]*>", ""))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text, formatted``: turns as (role, text), recovered from the formatted text alone."""
    cut = F.split("formatted", CLOSE, -1)
    turns = F.transform(
        F.slice(cut, F.lit(1), F.size(cut) - 1),
        lambda t: F.struct(
            unescape(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), BODY, 1)).alias("role"),
            _plain(F.substr(t, F.instr(t, BODY) + len(BODY))).alias("text"),
        ),
    )
    loss = F.transform("loss_spans", lambda s: _plain(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")


def report(turns: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted conversations, a row each."""
    back = read_back(format_conversations(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
