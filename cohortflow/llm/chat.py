"""Chat formatting: typed content parts become one marked text per conversation, with spans and attachments.

A message holds an array of parts ``struct<kind, text, ref, width, height, seconds, pages>``.  A visitor (one branch
per kind) renders text parts escaped and puts an ordered placeholder for images, audio and documents; each
placeholder's reference, position and expanded token count are recorded.  Everything is a built-in expression.

Escaping: the template's control strings all contain ``<`` or ``#``.  In texts ``\\`` becomes ``\\b``, ``<`` becomes
``\\l`` and ``#`` becomes ``\\h`` (roles also ``:`` as ``\\c``), so no control string can occur inside a text, and
undoing the four pairs, ``\\b`` last, gives the text back.

Edge cases: a null text, role or part list counts as empty; a null or unknown kind with a text is text, an unknown
kind without one is a ``file`` attachment; missing measures count as the least size (one token).  Null turns come
first; rows of one turn are ordered by role and content; repeated rows stay; rows with a null conversation id form
one conversation.  Extra columns are ignored.  An empty table gives an empty result.  One conversation is one output
text, so it is the unit that has to fit into a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class Template:
    """Marks of a turn, and the expansion of attachments into tokens."""

    head: str = "### "
    sep: str = ": "
    end: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    patch: int = 28  # image pixels a token covers per side
    audio_rate: float = 25.0  # tokens a second
    page_tokens: int = 1024  # tokens a document page


_TEXT_MARKS = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_ROLE_MARKS = (*_TEXT_MARKS, (":", "\\c"))


def escape(text: Column, marks=_TEXT_MARKS) -> Column:
    for plain, mark in marks:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column, marks=_TEXT_MARKS) -> Column:
    for plain, mark in reversed(marks):  # the backslash itself comes last
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def text_parts(text: Column) -> Column:
    """A plain text column as a list of one text part."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), none("string").alias("ref"),
                            none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages")))


def _kind(p: Column) -> Column:
    known = p.kind.isin("image", "audio", "document")
    return F.when(known, p.kind).when((p.kind == "text") | p.text.isNotNull() | p.kind.isNull(), F.lit("text")).otherwise(F.lit("file"))


def _render(p: Column) -> Column:
    kind = _kind(p)
    return F.when(kind == "text", escape(F.coalesce(p.text, F.lit("")))).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>")))


def _tokens(p: Column, t: Template) -> Column:
    side = lambda c: F.ceil(F.coalesce(c, F.lit(1)) / F.lit(t.patch))
    return F.greatest(F.lit(1), F.when(p.kind == "image", side(p.width) * side(p.height))
                      .when(p.kind == "audio", F.ceil(F.coalesce(p.seconds, F.lit(0.0)) * F.lit(t.audio_rate)))
                      .when(p.kind == "document", F.coalesce(p.pages, F.lit(1)) * F.lit(t.page_tokens)).otherwise(F.lit(1))).cast("long")


def format_chat(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
                template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, turns, attachments, media_tokens.

    `turns`: array of (turn_start, role, start, length, loss): code-point offsets into `formatted` of the turn and of
    its text; `loss` marks the text under the loss mask.  `attachments`: array of (position, kind, ref, tokens) in
    order.  The texts move once, by conversation; window and grouping share that exchange."""
    t = template
    m = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts"))
    m = m.withColumn("parts", F.filter("parts", lambda p: p.isNotNull())).withColumn("pieces", F.transform("parts", _render))
    sizes = F.transform("pieces", F.char_length)
    m = m.withColumn("body", F.array_join("pieces", "")).withColumn("head", F.concat(F.lit(t.head), escape(F.col("role"), _ROLE_MARKS), F.lit(t.sep)))
    placed = F.transform("parts", lambda p, i: F.struct(
        F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x).cast("long").alias("position"),
        _kind(p).alias("kind"), p.ref.alias("ref"), _tokens(p, t).alias("tokens")))
    m = m.select("conv_id", "turn", "role", F.concat("head", "body", F.lit(t.end)).alias("chunk"),
                 F.char_length("head").cast("long").alias("head_len"), F.char_length("body").cast("long").alias("length"),
                 F.filter(placed, lambda a: a.kind != "text").alias("media"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "chunk", F.to_json("media"))
    m = m.withColumn("idx", F.row_number().over(order)).withColumn(
        "turn_start", F.coalesce(F.sum(F.char_length("chunk").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    body_at = F.col("turn_start") + F.col("head_len")
    m = m.select("conv_id", F.struct(
        "idx", "chunk",
        F.struct("turn_start", "role", body_at.alias("start"), "length", F.col("role").isin(*t.loss_roles).alias("loss")).alias("turn"),
        F.transform("media", lambda a: a.withField("position", a.position + body_at)).alias("media")).alias("one"))
    g = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    media = F.flatten(F.col("all.media"))
    return g.select("conv_id", F.size("all").cast("long").alias("n_turns"), F.array_join(F.col("all.chunk"), "").alias("formatted"),
                    F.col("all.turn").alias("turns"), media.alias("attachments"),
                    F.aggregate(media, F.lit(0).cast("long"), lambda a, x: a + x.tokens).alias("media_tokens"))


def read_chat(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Parse `formatted` back: adds `messages` (array of role, text) and `loss_texts` (unescaped texts under the mask)."""
    t = template
    chunks = F.split("formatted", t.end)  # no regular-expression characters in the mark
    chunks = F.slice(chunks, F.lit(1), F.size(chunks) - 1)
    out = formatted.withColumn("_chunks", chunks)
    head = lambda c: F.substring_index(c, t.sep, 1)  # noqa: E731  a role has no colon
    messages = F.transform("_chunks", lambda c: F.struct(
        unescape(head(c).substr(F.lit(len(t.head) + 1), F.char_length(c)), _ROLE_MARKS).alias("role"),
        unescape(c.substr(F.char_length(head(c)) + len(t.sep) + 1, F.char_length(c))).alias("text")))
    masked = F.filter(F.arrays_zip(F.col("_chunks").alias("chunk"), F.col("turns").alias("turn")), lambda z: z.turn.loss)
    texts = F.transform(masked, lambda z: unescape(z.chunk.substr(
        (z.turn.start - z.turn.turn_start + 1).cast("int"), z.turn.length.cast("int"))))
    return out.withColumn("messages", messages).withColumn("loss_texts", texts).drop("_chunks")
