"""Chat formatting with offset-aligned masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of the turns meet the
token spans by binary search. Turn marks are special tokens, so no token lies across a turn's border.
"""

from __future__ import annotations

import functools
import json
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm import common


class Template(NamedTuple):
    """A turn is ``opening role middle text closing``.

    Inside roles and texts a backslash is doubled, and one is put behind the first character of every
    control string: the three marks and ``reserved``, which other templates and tokenizers obey.
    """

    opening: str = "<|turn|>"
    middle: str = "<|says|>"
    closing: str = "<|end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.opening, self.middle, self.closing


@functools.cache
def _guard(template: Template) -> re.Pattern:
    controls = "|".join(re.escape(c) for c in (*template.marks, *template.reserved))
    return re.compile(rf"\\|(?=(?:{controls})).", re.DOTALL)


def escape(text: str, template: Template = Template()) -> str:
    return _guard(template).sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]], template: Template = Template()) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the (start, end) of every turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = template.opening + escape(role, template) + template.middle, escape(text, template)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, template.closing]
        at += len(head) + len(body) + len(template.closing)
    return "".join(parts), spans


def parse(formatted: str, template: Template = Template()) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns = []
    for turn in formatted.split(template.closing)[:-1]:
        role, _, text = turn.removeprefix(template.opening).partition(template.middle)
        turns.append((unescape(role), unescape(text)))
    return turns


class Encoder:
    """Ids and character offsets of a rendered conversation; the template's marks are special tokens behind the file's own.

    Tokens spell bytes, so their offsets are running sums of their lengths; of a character that several
    tokens share, each has the whole.
    """

    def __init__(self, path: str, pattern: str, template: Template):
        import tiktoken

        ranks = common.byte_level_ranks(path)
        with open(path, encoding="utf-8") as f:
            own = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        first = max(*ranks.values(), *own.values(), 0) + 1
        special = own | {mark: first + i for i, mark in enumerate(template.marks)}
        self._encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self._length = np.zeros(first + len(template.marks), np.int64)
        for spelling, i in [*ranks.items(), *((k.encode(), i) for k, i in special.items())]:
            self._length[i] = len(spelling)

    def encode(self, formatted: str) -> tuple[np.ndarray, np.ndarray]:
        ids = self._encoding.encode_to_numpy(formatted, allowed_special="all").astype(np.int32)
        ends = np.cumsum(self._length[ids])
        offsets = np.stack([ends - self._length[ids], ends], axis=1)
        if len(ids) and not formatted.isascii():
            place = np.cumsum((np.frombuffer(formatted.encode(), np.uint8) & 0xC0) != 0x80)
            offsets = np.stack([place[offsets[:, 0]] - 1, place[ends - 1]], axis=1)
        return ids, offsets.astype(np.int32)


@functools.cache
def encoder_for(path: str, pattern: str, template: Template) -> Encoder:
    return Encoder(path, pattern, template)


def mask_of(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens inside one of the sorted, disjoint spans; ``offsets`` is n by 2."""
    if not len(offsets) or not spans:
        return np.zeros(len(offsets), bool)
    edges = np.asarray(spans)
    at = np.searchsorted(edges[:, 0], offsets[:, 0], side="right") - 1
    return (at >= 0) & (offsets[:, 1] <= edges[np.maximum(at, 0), 1]) & (offsets[:, 1] > offsets[:, 0])


def learnt(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """All text under a loss mask, unescaped; characters that several tokens share come once."""
    starts, ends = starts[mask], ends[mask]
    if not len(ends):
        return ""
    done = np.maximum.accumulate(ends)
    starts[1:] = np.maximum(starts[1:], done[:-1])
    new = starts < ends
    starts, ends = starts[new], ends[new]
    gap = np.flatnonzero(starts[1:] != ends[:-1]) + 1  # runs without a gap are one slice
    return unescape("".join(formatted[i:j] for i, j in zip(starts[[0, *gap]], ends[[*(gap - 1), -1]])))


def format_conversations(rows: DataFrame, tokenizer: str, pattern: str, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: tuple[str, ...] = ("assistant",), template: Template = Template()) -> DataFrame:
    """(conv_id, formatted, n_turns, ids, starts, ends, loss_mask), one row per conversation.

    Turns follow ``turn``; ties go by role and text, null turns come first. Null texts and roles are
    empty, rows with a null id make up one conversation, repeated rows are turns of their own. A mask
    is true for the tokens of texts whose role is in ``learn``. An empty table gives no rows.
    """
    own = rows.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("turn"))
    whole = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    whole = whole.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    kind = common.arrow_type(whole, "conv_id")
    ints = pa.list_(pa.int32())
    schema = pa.schema([("conv_id", kind), ("formatted", pa.string()), ("n_turns", pa.int64()), ("ids", ints), ("starts", ints), ("ends", ints), ("loss_mask", pa.list_(pa.bool_()))])

    def run(frames):
        encoder = encoder_for(tokenizer, pattern, template)

        def flush(rows):
            keys, texts, turns, *lists = zip(*rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists[0]])]).astype(np.int32))
            flat = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in lists]
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(texts, pa.string()), pa.array(turns, pa.int64()), *flat], schema=schema)

        held, size = [], 0
        for frame in frames:
            for key, roles, texts in zip(*(c.to_pylist() for c in frame.columns)):
                formatted, spans = render(list(zip(roles, texts)), template)
                ids, offsets = encoder.encode(formatted)
                mask = mask_of(offsets, [s for s, r in zip(spans, roles) if r in learn])
                held.append((key, formatted, len(roles), ids, offsets[:, 0], offsets[:, 1], mask))
                size += len(formatted) + 13 * len(mask)
                if size > common.OUT_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return whole.mapInArrow(run, T.StructType([whole.schema["conv_id"], T.StructField("formatted", T.StringType()), T.StructField("n_turns", T.LongType()), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "starts", "ends")), T.StructField("loss_mask", T.ArrayType(T.BooleanType()))]))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What the output holds, from the output alone: (conv_id, turns, learnt), the turns as (role, text) pairs."""
    turns = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    pairs = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    own = formatted.select("conv_id", "formatted", "starts", "ends", "loss_mask")
    schema = pa.schema([("conv_id", common.arrow_type(own, "conv_id")), ("formatted", pa.string()), ("turns", pairs), ("learnt", pa.string())])

    def run(frames):
        def rows():
            for frame in frames:
                keys, texts = frame.column(0).to_pylist(), frame.column(1).to_pylist()
                starts, ends, mask = (c.flatten().to_numpy(zero_copy_only=False) for c in frame.columns[2:])
                edges = frame.column(2).offsets.to_numpy() - frame.column(2).offsets[0].as_py()
                for key, value, a, b in zip(keys, texts, edges, edges[1:]):
                    found = [{"role": r, "text": x} for r, x in parse(value, template)]
                    yield key, value, found, learnt(value, starts[a:b], ends[a:b], mask[a:b])

        yield from common.batches(rows(), schema, 1)

    return own.mapInArrow(run, T.StructType([own.schema["conv_id"], T.StructField("formatted", T.StringType()), T.StructField("turns", turns), T.StructField("learnt", T.StringType())]))
