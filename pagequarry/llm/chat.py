r"""Chat formatting with typed content parts.

A message is a row ``conv_id, turn, role, parts``; a part is
``struct<kind, text, ref, width, height, seconds, pages>`` with kind ``text``,
``image``, ``audio`` or ``document``.  One visitor walks the parts in order: text
is escaped, every other part becomes a placeholder ``<kind>``, its reference goes
to the list of attachments, and what it will expand to is counted in tokens.

A turn is written ``### role: content</turn>\n``.  In texts ``\ < #`` are written
``\b \l \h`` (in roles also ``:`` as ``\c``), so neither marks nor placeholders
can come from a text, and reading back is exact.  The loss mask covers the content
of the turns of ``LEARNED`` roles, without marks.

Turns are formatted where they are; a conversation is the concatenation of its
pieces in order, and is read as a stream, so that no conversation has to fit into
memory.

Defined cases: a null text is empty; a null role is written ``\0`` and read back as
null; turns of one number are ordered by role, then piece; repeated rows are turns
of their own; null conversation ids are one conversation; parts of another kind
are written ``<other>``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARNED = ("assistant",)
KINDS = ("image", "audio", "document")
PATCH = 28
TOKENS_PER_SECOND = 25
TOKENS_PER_PAGE = 512
HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def _unescaped(text: str) -> str:
    return text.replace("\\c", ":").replace("\\h", "#").replace("\\l", "<").replace("\\b", "\\")


def text_part(text: Column) -> Column:
    """A message's parts if it is only text."""
    none = [F.lit(None)] * 5
    part = F.struct(F.lit("text"), text, *none).cast(PART)
    return F.array(part)


def _placeholder(part: Column) -> Column:
    kind = F.when(part["kind"].isin(*KINDS), part["kind"]).otherwise("other")
    return F.concat(F.lit("<"), kind, F.lit(">"))


def _tokens(part: Column) -> Column:
    """What a placeholder stands for: patches of an image, frames of a sound, pages of a document."""
    patches = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    return (
        F.when(part["kind"] == "image", patches)
        .when(part["kind"] == "audio", F.ceil(part["seconds"] * TOKENS_PER_SECOND))
        .when(part["kind"] == "document", part["pages"] * TOKENS_PER_PAGE)
        .cast("long")
    )


def format_turns(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, piece, loss_start, loss_end, attachments, expanded_tokens``, one row per message.

    The loss span is in code points of the piece, null where nothing is learned.
    ``attachments`` lists ``ref, kind, tokens`` in the order of the placeholders.
    """

    def visit(part: Column) -> Column:
        return F.when(part["kind"] == "text", escaped(part["text"])).otherwise(_placeholder(part))

    parts = F.filter(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    role = F.coalesce(F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(""))
    role = F.when(F.col("role").isNull(), "\\0").otherwise(role)
    content = F.array_join(F.transform(parts, visit), "")
    media = F.filter(parts, lambda p: ~p["kind"].eqNullSafe("text"))
    attached = F.transform(media, lambda p: F.struct(p["ref"].alias("ref"), p["kind"].alias("kind"), _tokens(p).alias("tokens")))
    learned = F.col("role").isin(*LEARNED)
    start = F.length(role) + len(HEAD) + len(MIDDLE)
    rows = messages.select("conv_id", "turn", role.alias("r"), content.alias("c"), attached.alias("attachments"), learned.alias("l"))
    start = F.length("r") + len(HEAD) + len(MIDDLE)
    return rows.select(
        "conv_id",
        "turn",
        F.concat(F.lit(HEAD), "r", F.lit(MIDDLE), "c", F.lit(END)).alias("piece"),
        F.when(F.col("l"), start).alias("loss_start"),
        F.when(F.col("l"), start + F.length("c")).alias("loss_end"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + F.coalesce(a["tokens"], F.lit(0))).alias("expanded_tokens"),
    )


def read_turn(piece: str) -> tuple[str | None, str]:
    """Role and text of a formatted turn."""
    head, content = piece[len(HEAD) : -len(END)].split(MIDDLE, 1)
    return (None if head == "\\0" else _unescaped(head)), _unescaped(content)


_DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ]
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = object()
    key, turns, loss, counts, done = none, None, None, None, []

    def row():
        return (key, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2])

    def out():
        nonlocal done
        rows, done = done, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _DIGEST.types)], schema=_DIGEST)

    for batch in batches:
        for conv_id, piece, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if conv_id != key or key is none:
                if key is not none:
                    done.append(row())
                key, turns, loss, counts = conv_id, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            role, text = read_turn(piece)
            turns.update(f"{role or ''}\n{text}\n".encode())
            counts[0] += 1
            counts[2] += len(piece)
            if start is not None:
                learned = _unescaped(piece[start:end])
                loss.update(learned.encode())
                counts[1] += len(learned)
        if done:
            yield out()
    if key is not none:
        done.append(row())
        yield out()


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of each conversation.

    The turns of a conversation meet in one sorted stream, since a digest of all of them is asked for.
    """
    rows = formatted.select(F.col("conv_id").cast("long").alias("conv_id"), "piece", "loss_start", "loss_end", "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "piece"
    )
    return rows.mapInArrow(
        _digests,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
