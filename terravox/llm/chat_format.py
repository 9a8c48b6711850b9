"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and a token is
under the loss where its span meets an assistant turn's span: both lists are
sorted, so each turn finds its tokens by binary search.

Template: ``<|role|>text<|end|>`` for each turn, where role is escaped too. The
markers are added tokens of the encoder, so no token reaches over a marker.
Control strings inside a text are escaped by a backslash after their first
character (and after each backslash), which `unescape` takes out again.

Defined results: a null text or role is empty; turns are ordered by turn, then
role, then text (nulls first), so ties have one order; rows with a null conv_id
are one conversation; repeated rows are turns of their own. One conversation is
one text, so it is rendered in one task, streamed from the sorted rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, stored, tidied

#: Control strings that texts may not hold bare: this template's and common others'.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ROLES = ("system", "user", "assistant", "tool")
END = "<|end|>"

_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL) + r"|[<\[|](?=\\)")
_UNESCAPE = re.compile(r"([<\[\\|])\\", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


@dataclass
class Rendered:
    text: str
    roles: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)  # of the escaped texts


def render(turns: list[tuple[str, str]]) -> Rendered:
    parts, out, at = [], Rendered(""), 0
    for role, text in turns:
        opening, body = f"<|{escape(role)}|>", escape(text)
        out.roles.append(role)
        out.spans.append((at + len(opening), at + len(opening) + len(body)))
        parts += [opening, body, END]
        at = out.spans[-1][1] + len(END)
    out.text = "".join(parts)
    return out


_TURN = re.compile(r"<\|(.*?)\|>(.*?)<\|end\|>", re.S)


def parse(text: str) -> list[tuple[str, str, tuple[int, int]]]:
    """Role, text and the escaped text's span of each turn of a rendered conversation."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError("not a rendered conversation")
        out.append((unescape(m[1]), unescape(m[2]), m.span(2)))
        at = m.end()
    return out


class ChatEncoder:
    def __init__(self, path: str):
        from tokenizers import AddedToken, Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.tokenizer.post_processor = None  # it would trim white space off the offsets
        self.tokenizer.add_special_tokens([AddedToken(x, normalized=False) for x in (*(f"<|{r}|>" for r in ROLES), END)])

    def encode(self, rendered: Rendered, learn: str = "assistant") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, token spans (n, 2) in code points and the loss mask."""
        e = self.tokenizer.encode(rendered.text, add_special_tokens=False)
        ids, spans = np.array(e.ids, np.int32), np.array(e.offsets, np.int64).reshape(-1, 2)
        mask = np.zeros(len(ids), bool)
        for role, (a, b) in zip(rendered.roles, rendered.spans, strict=True):
            if role == learn and b > a:
                mask[np.searchsorted(spans[:, 1], a, "right") : np.searchsorted(spans[:, 0], b, "left")] = True
        return ids, spans, mask


_encoders: dict[str, ChatEncoder] = {}

_FORMATTED = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("loss", T.ArrayType(T.BooleanType()))])


def format_conversations(rows: DataFrame, tokenizer_path: str, learn: str = "assistant") -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text): the rendered text, its ids, their spans and the loss mask."""
    turns = bounded_batches(rows).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")

    def run(batches):
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = ChatEncoder(tokenizer_path)
        encoder, here, said, out = _encoders[tokenizer_path], None, [], []

        def flush():
            rendered = render(said)
            ids, spans, mask = encoder.encode(rendered, learn)
            out.append((here, rendered.text, ids, spans[:, 0], spans[:, 1], mask))

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if said and conv != here:
                    flush()
                    said = []
                    if len(out) >= 200:
                        yield _batch(out)
                        out = []
                here = conv
                said.append((role, text))
        if said:
            flush()
        if out:
            yield _batch(out)

    return ordered.mapInArrow(tidied(run), _FORMATTED)


def _batch(out) -> pa.RecordBatch:
    conv, text, ids, starts, ends, mask = zip(*out, strict=True)
    i32 = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(text, pa.string()), pa.array([x.astype(np.int32) for x in ids], i32), pa.array([x.astype(np.int32) for x in starts], i32), pa.array([x.astype(np.int32) for x in ends], i32), pa.array(mask, pa.list_(pa.bool_()))], names=[f.name for f in _FORMATTED])


_READ = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()), T.StructField("n_tokens", T.LongType())])


def loss_texts(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The texts under the mask: each run of masked tokens, unescaped."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return [unescape(text[starts[a] : ends[b - 1]]) for a, b in zip(edge[0::2], edge[1::2], strict=True)]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, taken from their rendered text, spans and mask alone."""

    def run(batches):
        for batch in batches:
            rows = []
            for conv, text, starts, ends, mask in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                turns = parse(text)
                loss = "".join(loss_texts(text, np.array(starts, np.int64), np.array(ends, np.int64), np.array(mask, bool)))
                said = "".join(f"{role}\n{t}\n" for role, t, _ in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(starts)))
            columns = list(zip(*rows, strict=True)) or [()] * len(_READ)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in f.name else pa.int64()) for c, f in zip(columns, _READ, strict=True)], names=[f.name for f in _READ])

    return formatted.mapInArrow(tidied(run), _READ)


def chat_digests(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """Formats rows into a table in the shared folder and reads the digests back from it."""
    return read_back(stored(format_conversations(rows, tokenizer_path), "chat"))
