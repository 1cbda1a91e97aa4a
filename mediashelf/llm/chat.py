"""Chat formatting: conversations become one marked-up text each, assembled column by column, with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is marked: `open` role newline text `close`; control strings inside roles and texts are escaped.

    The escape is reversible: a backslash becomes two, and the first character of each control string becomes a backslash and a
    letter, so no control string is left and every backslash begins an escape.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    #: Strings that mean something to common templates.
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def escape(self, values: pa.Array) -> pa.Array:
        """The column with control strings escaped; rows without any, and without a backslash, cost one search."""
        values = pc.replace_substring(values, "\\", "\\\\")
        for c in self.controls:
            values = pc.replace_substring(values, c, {"<": "\\l", "[": "\\b"}[c[0]] + c[1:])
        return values

    def escape_role(self, values: pa.Array) -> pa.Array:
        """A role is one line besides."""
        return pc.replace_substring(self.escape(values), "\n", "\\n")

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", lambda m: {"l": "<", "b": "[", "n": "\n"}.get(m[1], m[1]), text, flags=re.DOTALL) if "\\" in text else text

    def parse(self, text: str) -> list[tuple[str, str, int, int]]:
        """The turns of a formatted text: (role, text, where its text begins, where it ends), unescaped, in code points."""
        out, at = [], 0
        while at < len(text):
            if not text.startswith(self.open, at):
                raise ValueError(f"no turn at {at}")
            start = text.index("\n", at) + 1
            end = text.index(self.close, start)
            out.append((self.unescape(text[at + len(self.open) : start - 1]), self.unescape(text[start:end]), start, end))
            at = end + len(self.close)
        return out


def scatter(columns: list[pa.Array | bytes], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each row) of the rows' segments one after another: one buffer, filled column by column.

    Segment lengths give cumulative offsets; for each column the places of all its bytes in the buffer follow from them, and one
    indexed copy puts them there. A column is an array of strings or one constant.
    """
    lengths = np.empty((rows, len(columns)), np.int64)
    sources: list[np.ndarray] = []
    for k, c in enumerate(columns):
        if isinstance(c, bytes):
            lengths[:, k] = len(c)
            sources.append(np.frombuffer(c, np.uint8))
        else:
            offsets, data = _parts(c)
            lengths[:, k] = np.diff(offsets)
            sources.append(data[offsets[0] : offsets[-1]])
    ends = np.cumsum(lengths.ravel())
    begins = (ends - lengths.ravel()).reshape(rows, len(columns))
    out = np.empty(int(ends[-1]) if rows else 0, np.uint8)
    for k, (c, data) in enumerate(zip(columns, sources, strict=True)):
        if isinstance(c, bytes):
            out[(begins[:, k][:, None] + np.arange(len(c))).ravel()] = np.tile(data, rows)
        else:
            n = lengths[:, k]
            out[np.repeat(begins[:, k] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = data
    return out, ends.reshape(rows, len(columns))[:, -1] if rows else np.zeros(0, np.int64)


def _parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of large strings."""
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return bounds, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def characters(values: pa.Array) -> np.ndarray:
    return pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)


def format_turns(roles: pa.Array, texts: pa.Array, conversation_ends: np.ndarray, template: Template) -> tuple[pa.Array, pa.Array]:
    """(texts, loss masks) of conversations, given their turns in order; a mask is a list of [begin, end) in code points."""
    names, said = template.escape_role(roles), template.escape(texts)
    opened, closed = template.open.encode(), template.close.encode()
    data, ends = scatter([opened, names, b"\n", said, closed], len(roles))
    starts = np.concatenate(([0], conversation_ends[:-1])).astype(np.int64)
    bounds = np.concatenate(([0], ends))[np.concatenate(([0], conversation_ends))]
    out = pa.LargeStringArray.from_buffers(len(conversation_ends), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data))
    head, body = len(template.open) + characters(names) + 1, characters(said)
    turn_end = np.cumsum(head + body + len(template.close))
    base = np.repeat(np.concatenate(([0], turn_end))[starts], conversation_ends - starts)
    stop = turn_end - len(template.close) - base
    trained = pc.is_in(roles, pa.array(template.trained, roles.type)).to_numpy(zero_copy_only=False)
    masks = pa.StructArray.from_arrays([pa.array((stop - body)[trained]), pa.array(stop[trained])], names=["begin", "end"])
    per = np.concatenate(([0], np.cumsum(trained)))[np.concatenate(([0], conversation_ends))]
    return out, pa.ListArray.from_arrays(pa.array(per, pa.int32()), masks)


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *, template: Template | None = None) -> DataFrame:
    """(conv, n_turns, formatted, loss_mask array<struct<begin, end>>) for every conversation; positions are code points.

    Spark deals turns by conversation and sorts them; a task assembles batch by batch and keeps only the turns of the conversation
    that a batch ends in. A conversation is one text in the result, so one task must hold the largest one; nothing else grows.

    Turns are in order of `turn` (null first), those that tie in order of role, then text; null roles and texts are empty;
    a null `conv` is a conversation of its own; repeated rows are repeated turns; no turns give no conversations; other columns play no part.
    """
    template = template or Template()
    rows = turns.select(F.col(conv).alias("_llm_conv"), F.col(turn).alias("_llm_turn"), F.coalesce(role, F.lit("")).alias("_llm_role"), F.coalesce(text, F.lit("")).alias("_llm_text"))
    ordered = rows.repartition("_llm_conv").sortWithinPartitions("_llm_conv", "_llm_turn", "_llm_role", "_llm_text").drop("_llm_turn")

    def build(held: list[pa.RecordBatch], last: int | None) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
        """What is complete, formatted, and the rest; `last`: rows that belong to a conversation that may go on."""
        t = pa.Table.from_batches(held).combine_chunks()
        done = t.slice(0, len(t) - (last or 0))
        ids = done.column(0).combine_chunks()
        ends = np.append(_changes(ids), len(ids)).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        roles, texts = (done.column(k).cast(pa.large_string()).combine_chunks() for k in (1, 2))
        roles, texts = (x if isinstance(x, pa.Array) else x.chunk(0) if x.num_chunks else pa.array([], pa.large_string()) for x in (roles, texts))
        formatted, masks = format_turns(roles, texts, ends, template)
        first = pa.array(np.concatenate(([0], ends[:-1])).astype(np.int64)) if len(ends) else pa.array([], pa.int64())
        out = pa.RecordBatch.from_arrays([ids.take(first), pa.array(np.diff(np.concatenate(([0], ends)))), formatted.cast(pa.string()), masks], names=[conv, "n_turns", "formatted", "loss_mask"])
        return out, t.slice(len(done)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            cuts = _changes(b.column(0))
            goes_on = held and len(b) and not _same(held[-1].column(0)[-1], b.column(0)[0])
            if goes_on or len(cuts):
                last = len(b) - (int(cuts[-1]) if len(cuts) else 0)
                out, held = build([*held, b], last)
                yield out
            elif len(b):
                held.append(b)
        if held:
            yield build(held, None)[0]

    schema = rows.select(F.col("_llm_conv").alias(conv)).withColumns({
        "n_turns": F.lit(0).cast("long"), "formatted": F.lit(""),
        "loss_mask": F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("end"))),
    }).schema
    return ordered.mapInArrow(run, schema)


def _same(a: pa.Scalar, b: pa.Scalar) -> bool:
    return a.as_py() == b.as_py()


def _changes(ids: pa.Array) -> np.ndarray:
    """Rows whose conversation isn't the one of the row before."""
    if len(ids) < 2:
        return np.zeros(0, np.int64)
    code = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(code[1:] != code[:-1]) + 1


def digest(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """What the formatted texts say, read back: digests of all turns and of the text under the loss mask, and lengths."""
    template = template or Template()
    conv = conversations.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, mask in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns, said, loss, n = template.parse(text), hashlib.sha256(), hashlib.sha256(), 0
                for role, body, _, _ in turns:
                    said.update(f"{role}\n{body}\n".encode())
                for m in mask:
                    body = template.unescape(text[m["begin"] : m["end"]])
                    loss.update(body.encode())
                    n += len(body)
                rows.append((len(turns), said.hexdigest(), n, loss.hexdigest(), len(text)))
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[conv, *names])

    source = conversations.select(conv, "formatted", "loss_mask")
    schema = source.select(conv).withColumns({"n_turns": F.lit(0).cast("long"), "turns_sha256": F.lit(""), "loss_chars": F.lit(0).cast("long"), "loss_sha256": F.lit(""), "formatted_chars": F.lit(0).cast("long")}).schema
    return source.mapInArrow(run, schema)
