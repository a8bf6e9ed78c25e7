"""Formatting of conversations with a chat template that is only called, never read.

The template is rendered for each prefix of a conversation's turns. Where a rendering starts with the one before, the
rest is the new turn's span; a template that changes what it has written is thereby found. Inside a span, the text's
place is found by rendering the turn once more with a probe character in its stead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]
PROBE = "\ue000"  # of the private use area

#: The marks of the turn format.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    """Doubles the bar after each ``<``, so that no mark can stand in a text."""
    return text.replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


def _role_out(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def _role_in(role: str) -> str:
    return unescape(role.replace("\\\\", "\0").replace("\\n", "\n").replace("\0", "\\")) if "\0" not in role else unescape(_slow_role(role))


def _slow_role(role: str) -> str:
    out, i = [], 0
    while i < len(role):
        step = 2 if role[i] == "\\" else 1
        out.append({"\\\\": "\\", "\\n": "\n"}.get(role[i : i + 2], role[i]) if step == 2 else role[i])
        i += step
    return "".join(out)


def marked_turns(turns: list[Turn]) -> str:
    """The template: each turn between marks, with its role in the first line."""
    return "".join(f"{START}{_role_out(role)}\n{escape(text)}{END}\n" for role, text in turns)


def parse(formatted: str) -> list[Turn]:
    """The turns of a text that ``marked_turns`` made."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition("\n")
        turns.append((_role_in(role), unescape(text[: text.rindex(END)])))
    return turns


class Rendering:
    """A conversation rendered turn by turn: the text, each turn's span, each text's place, and where history changed."""

    def __init__(self, render: Render, turns: list[Turn]):
        self.text, self.spans, self.texts, self.rewrites = "", [], [], []
        for i, (role, text) in enumerate(turns):
            before, self.text = self.text, render(turns[: i + 1])
            if not self.text.startswith(before):
                self.rewrites.append(i)
                self.spans = [(0, 0)] * i  # earlier places hold no more
                self.texts = [(0, 0)] * i
                self.spans.append((0, len(self.text)))
                self.texts.append((0, 0))
                continue
            self.spans.append((len(before), len(self.text)))
            probe = next(chr(c) for c in range(ord(PROBE), ord(PROBE) + 4096) if chr(c) not in self.text)
            probed = render([*turns[:i], (role, probe)])
            at = probed.find(probe, len(before))
            end = at + len(self.text) - len(probed) + 1
            fits = at >= 0 and probed.count(probe) == 1 and end >= at and self.text[:at] == probed[:at] and self.text[end:] == probed[at + 1 :]
            self.texts.append((at, end) if fits else (0, 0))


def format_conversations(
    conversations: DataFrame, render: Render = marked_turns, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """``conv_id, formatted, turn_spans, loss_spans, rewrites``: one row for each conversation.

    Spans are arrays of structs (start, end) in code points; ``loss_spans`` covers the texts of ``learn_roles``;
    ``rewrites`` lists the turns (from 0) at which the template changed what stood before, whose conversations have no
    loss spans for the turns up to there. Turns are ordered by turn (null first), then role and text; repeated turns are
    all kept; null roles and texts are empty; a row with a null id is a conversation of its own (rows without an id that
    are equal are turns of one); other columns are ignored; an empty table gives an empty result. A conversation is one
    value of the result and so is gathered in one task; rendering each prefix costs the square of its number of turns.
    """
    ship(conversations.sparkSession)
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("turn"))
    rows = rows.withColumn("apart", F.when(F.col("conv_id").isNull(), F.struct(F.xxhash64(F.lit(17), "turn"), F.xxhash64(F.lit(89), "turn"))))
    grouped = rows.groupBy("conv_id", "apart").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    grouped = grouped.select("conv_id", F.transform("turns", lambda t: t.role).alias("roles"), F.transform("turns", lambda t: t.text).alias("texts"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("turn_spans", span), ("loss_spans", span), ("rewrites", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = lambda spans: [{"start": a, "end": b} for a, b in spans]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                out = []
                for conv_id, roles, texts in zip(*(c.to_pylist() for c in batch.slice(lo, 512).columns), strict=True):
                    made = Rendering(render, list(zip(roles, texts, strict=True)))
                    loss = [at for role, at in zip(roles, made.texts, strict=True) if role in learn_roles and at[1] > at[0]]
                    out.append({"conv_id": conv_id, "formatted": made.text, "turn_spans": pairs(made.spans), "loss_spans": pairs(loss), "rewrites": made.rewrites})
                yield pa.RecordBatch.from_pylist(out, schema)

    return grouped.mapInArrow(run, "conv_id long, formatted string, turn_spans array<struct<start:long,end:long>>, loss_spans array<struct<start:long,end:long>>, rewrites array<int>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, from formatted conversations alone."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest()
                out.append((conv_id, len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 6, schema, strict=True)], schema=schema)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
