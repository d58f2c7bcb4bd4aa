"""Fill-in-middle transformation: texts cut at unit ends, found in 64-bit words of their UTF-8.

A unit is a run of white space with the word behind it, or the white space a text ends with. Eight
bytes are looked at at once: white-space bytes are marked in the top bit of each by additions that
can't carry into the next byte, a unit ends where an unmarked byte stands before a marked one, and the
ends of a word of eight bytes are one ``bitwise_count``. The k-th end is then found by a search in the
running counts, and inside its word by byte-wise prefix counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm import common

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed, and of 100 of those so many begin with the suffix.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42
#: Words of eight bytes that are looked at together; a text needs about one byte of counts a word beside these.
BLOCK = 1 << 17

_ONES = np.uint64(0x0101010101010101)
_TOP = np.uint64(0x8080808080808080)
_LOW = ~_TOP


def _spaces(x: np.ndarray) -> np.ndarray:
    """The top bit of every byte that is a space or one of 9 to 13; all others are 0."""
    low = x & _LOW
    nine, fourteen = low + _ONES * np.uint64(128 - 9), low + _ONES * np.uint64(128 - 14)
    other = x ^ _ONES * np.uint64(32)
    blank = ~(((other & _LOW) + _LOW) | other)
    return (nine & ~fourteen & ~x | blank) & _TOP


def _ends(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte of all but the last word that isn't white space and stands before white space."""
    space = _spaces(words)
    after = space[:-1] >> np.uint64(8) | space[1:] << np.uint64(56)
    return ~space[:-1] & after & _TOP


class Units:
    """Unit ends of one UTF-8 text. Bytes behind the text count as spaces, so its last word ends there."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw
        self.words = np.frombuffer(raw + b" " * (16 - len(raw) % 8), "<u8")  # a word of spaces at least follows
        blocks = range(0, len(self.words) - 1, BLOCK)
        counts = [np.bitwise_count(_ends(self.words[at : at + BLOCK + 1])) for at in blocks]
        self.counts = np.concatenate(counts)
        self.totals = np.cumsum([int(c.sum()) for c in counts])
        self.ended = int(self.totals[-1])
        self.n = self.ended + raw[-1:].isspace()

    def end(self, k: int) -> int:
        """Bytes up to the end of the k-th unit, from 1; none for 0."""
        if k == 0:
            return 0
        if k > self.ended:
            return len(self.raw)
        block = int(np.searchsorted(self.totals, k))
        k -= int(self.totals[block - 1]) if block else 0
        running = np.cumsum(self.counts[block * BLOCK : (block + 1) * BLOCK], dtype=np.int64)
        at = int(np.searchsorted(running, k))
        k -= int(running[at - 1]) if at else 0
        at += block * BLOCK
        ends = _ends(self.words[at : at + 2])
        before = (ends >> np.uint64(7)) * _ONES  # in every byte, the ends up to it
        reached = (before | _TOP) - np.uint64(k) * _ONES & _TOP
        return 8 * at + 8 - int(np.bitwise_count(reached)[0]) + 1


def code_points(raw: bytes) -> int:
    """Code points of UTF-8: bytes that don't continue one."""
    x = np.frombuffer(raw + b"\0" * (-len(raw) % 8), "<u8")
    continued = sum(int(np.bitwise_count(w & ~(w << np.uint64(1)) & _TOP).sum()) for w in (x[i : i + BLOCK] for i in range(0, len(x), BLOCK)))
    return len(raw) - continued


def cut_points(raw: bytes, h1: int, h2: int) -> tuple[int, int, int]:
    """(units, code points of the prefix, code points of the middle)."""
    units = Units(raw)
    first, second = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.end(first), units.end(second)
    return units.n, code_points(raw[:a]), code_points(raw[a:b])


_CUTS = ("n", "prefix_chars", "middle_chars")


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in _CUTS]))
def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    rows = (cut_points(t.as_buffer().to_pybytes() if t.is_valid else b"", x, y) for t, x, y in zip(text, h1.to_pylist(), h2.to_pylist()))
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 3, names=_CUTS)


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits out of the id's digest; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    ``form`` is ``psm`` or ``spm``, by the order of prefix, suffix and middle, or ``plain``: the output is
    the text as it was. Plain are empty texts, texts that hold a mark, and those whose draw says so; they
    have null counts of code points. A null text is empty; a null id has the draws of an empty id; rows
    that repeat an id have its draws each; texts of any length are cut whole. An empty table gives an empty one.
    """
    h = draws(F.col("doc_id"), seed)
    own = docs.select(*(c.alias(n) for c, n in zip(common.quoted([doc_id, text]), ("doc_id", "text")))).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = own.withColumns({f"h{i + 1}": x for i, x in enumerate(h)})
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    own = own.withColumn("cuts", _cuts("text", "h1", "h2"))
    own = own.select("doc_id", "text", "cuts.n", F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm").alias("form"), F.col("cuts.prefix_chars").alias("a"), F.col("cuts.middle_chars").alias("b"))
    counts = [F.when(F.col("form") != "plain", F.col(c)).alias(name) for c, name in (("a", "prefix_chars"), ("b", "middle_chars"))]
    return own.select("doc_id", "text", "n", "form", *counts).withColumn("output", _output())


def _output() -> Column:
    text, a, b = F.col("text"), F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle = text.substr(F.lit(1), a), text.substr(a + 1, b)
    suffix = text.substr(a + b + 1, F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm)


def restored(output: Column, form: Column) -> Column:
    """The text again, out of output and form alone: transformed texts hold each mark once."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)  # nothing stands before the first mark
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
