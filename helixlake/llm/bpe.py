"""Byte-level BPE by a lazily determinised transducer; streaming decode by a UTF-8 state machine.

The rank file gives a nondeterministic transducer over bytes: in every place a walk through the trie
of the tokens may begin, and where a walk ends a token it may write it if the pair with the token
before stands, that is, if no merge would reach across their boundary (:meth:`Merges.stands`).
Exactly one sequence of standing pairs spells any text, the one the merges make. Determinised, a
state is the set of walks under way, and a transition lists the tokens that end with its byte; states
and transitions are made when a text first needs them, and there are no more than trie nodes. For
each place the transducer keeps the one token that can end there. Tokens are written out once all
walks under way agree on them, so output lags input by a bounded number of bytes.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm import common

#: Remembered pieces and pairs that a worker holds.
MAX_PIECES, MAX_PAIRS = 700_000, 1_000_000
#: Bytes of one piece after which the transducer looks for tokens to write out.
SETTLE = 4096
#: Longer texts are split into pieces a stretch at a time.
LONG = 1 << 21
_TOP = 1 << 31


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """What the ranks say of tokens: their halves, and which neighbours stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spell = {i: t for t, i in ranks.items()}
        self._edges: dict[int, tuple | None] = {}
        self._stands: dict[tuple[int, int], bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge into ``token`` joins; None where merging never ends in it."""
        text = self.spell[token]
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], _TOP))
            if parts[at] + parts[at + 1] not in self.ranks:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def edges(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]] | None:
        """Tokens that lie at the token's right and left edge while it is being merged, each with the rank that ends it."""
        if token not in self._edges:
            found: list[list[tuple[bytes, int]]] = [[], []]
            whole = True
            for side in (0, 1):
                at, until = token, _TOP
                while at is not None:
                    found[side].append((self.spell[at], until))
                    until = at
                    if len(self.spell[at]) == 1:
                        break
                    pair = self.halves(at)
                    whole &= pair is not None
                    at = pair and pair[1 - side]
            self._edges[token] = (found[0], found[1]) if whole else None
        return self._edges[token]

    def stands(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' bytes leaves just these two; ``left`` -1 stands for a piece's start."""
        a, b = self.edges(left) if left >= 0 else ([],), self.edges(right)
        if a is None or b is None:
            return False
        get = self.ranks.get
        # a merge across comes first if it ranks below what ends the left part, or ties with what ends the right one
        return not any((m := get(x + y)) is not None and m < ends_x and m <= ends_y for x, ends_x in a[0] for y, ends_y in b[1])


class Transducer:
    """Encodes the bytes of one piece; agrees with merging by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self._trie: list[dict[int, int]] = [{}]
        self._ends, self._depths = [-1], [0]
        for text, token in ranks.items():
            node = 0
            for byte in text:
                if byte not in self._trie[node]:
                    self._trie[node][byte] = len(self._trie)
                    self._trie.append({})
                    self._ends.append(-1)
                    self._depths.append(self._depths[node] + 1)
                node = self._trie[node][byte]
            self._ends[node] = token
        self._size = {token: len(text) for text, token in ranks.items()}
        self._pairs: dict[int, bool] = {}
        self._ids, self._states, self._next = {(): 0}, [()], [{}]

    def _step(self, at: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """Make a transition: the next state, and the tokens that end here with their lengths, longest first."""
        nodes = tuple(n for n in (self._trie[node].get(byte) for node in (*self._states[at], 0)) if n is not None)
        ends = tuple((self._ends[n], self._size[self._ends[n]]) for n in nodes if self._ends[n] >= 0)
        state = tuple(n for n in nodes if self._trie[n])
        number = self._ids.setdefault(state, len(self._states))
        if number == len(self._states):
            self._states.append(state)
            self._next.append({})
        self._next[at][byte] = step = (number, ends)
        return step

    def encode(self, piece: bytes) -> list[int]:
        table, pairs, at, place, last, out = self._next, self._pairs, 0, 0, [-1], []
        for byte in piece:
            step = table[at].get(byte)
            if step is None:
                step = self._step(at, byte)
            at, ends = step
            place += 1
            for token, length in ends:
                if length <= place:
                    pair = last[place - length] << 24 | token
                    stands = pairs.get(pair)
                    if stands is None:
                        if len(pairs) > MAX_PAIRS:
                            pairs.clear()
                        stands = pairs[pair] = self.merges.stands(last[place - length], token)
                    if stands:
                        break
            else:
                raise ValueError(f"the ranks spell no token sequence over byte {byte}")
            last.append(token)
            if place >= SETTLE:
                settled = self._agreed(last, place, self._states[at])
                if settled:
                    out += self._back(last, settled)
                    last = last[settled:]
                    place -= settled
        return out + self._back(last, place)

    def _back(self, last: list[int], place: int) -> list[int]:
        """The tokens that lead to ``place``."""
        out, size = [], self._size
        while place > 0:
            out.append(last[place])
            place -= size[last[place]]
        return out[::-1]

    def _agreed(self, last: list[int], place: int, walks: tuple[int, ...]) -> int:
        """The last place through which the tokens go whichever walk under way ends in a token."""
        starts = {place, *(max(0, place - self._depths[node]) for node in walks)}
        while len(starts) > 1:
            far = max(starts)
            starts.discard(far)
            starts.add(far - self._size[last[far]])
        return starts.pop()


class Pieces(dict):
    """Ids of pieces seen before, as little-endian unsigned 32-bit bytes; a new piece goes through the transducer.

    When ``most`` pieces are held, they become the older half, and those still in use come back from it.
    """

    def __init__(self, ranks: dict[bytes, int], most: int = MAX_PIECES):
        super().__init__()
        self.transducer, self.ranks, self.most, self.older = Transducer(ranks), ranks, most // 2, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            ids = np.array([whole] if whole is not None else self.transducer.encode(raw), "<u4").tobytes()
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Splitter:
    """Splits texts by a pattern, with letters and numbers as the tiktoken library knows them.

    The regex module follows a later Unicode version. The letters and numbers among the later code
    points are told apart by how the library splits a sample; texts that hold one it doesn't know are
    split by a pattern whose classes leave these out.
    """

    def __init__(self, pattern: str):
        import re
        import unicodedata

        import regex
        import tiktoken

        self.plain = self.careful = regex.compile(pattern)
        self.later = None
        later = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn"]
        later = regex.findall(r"[\p{L}\p{N}]", "".join(later))
        # "!" merges with a byte behind it only inside one piece, which needs the sign to be no letter and no number
        firsts = {b"!" + c.encode()[:1] for c in later}
        ranks = {bytes([i]): i for i in range(256)} | {pair: 256 + i for i, pair in enumerate(sorted(firsts))}
        probe = tiktoken.Encoding("probe", pat_str=r"[^\s\p{L}\p{N}]+|[\s\S]", mergeable_ranks=ranks, special_tokens={})
        spans: list[list[int]] = []
        for c in (ord(c) for c in later if len(probe.encode_ordinary("!" + c)) < 1 + len(c.encode())):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        if spans:
            out = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in spans)
            self.later = re.compile(f"[{out}]")
            careful = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{out}])")
            careful = careful.replace(r"\p{L}+", rf"(?:(?![{out}])\p{{L}})+").replace(r"\p{N}+", rf"(?:(?![{out}])\p{{N}})+")
            self.careful = regex.compile(careful)

    def of(self, text: str):
        """The compiled pattern for a text."""
        return self.plain if self.later is None or text.isascii() or not self.later.search(text) else self.careful


class Codec:
    """Encoder and decoder of one rank file, with what a worker remembers between texts."""

    def __init__(self, ranks_path: str, pattern: str):
        ranks = load_ranks(ranks_path)
        self.pieces, self.splitter = Pieces(ranks), Splitter(pattern)
        size = max(ranks.values()) + 1
        spell = [b""] * size
        for token, i in ranks.items():
            spell[i] = token
        self._length = np.fromiter(map(len, spell), np.int64, size)
        self._start = np.concatenate([[0], np.cumsum(self._length)])[:-1]
        self._blob = np.frombuffer(b"".join(spell), np.uint8)

    def encode(self, text: str) -> np.ndarray:
        get = self.pieces.__getitem__
        if len(text) <= LONG:
            return np.frombuffer(b"".join(map(get, self.splitter.of(text).findall(text))), "<u4")
        found, out = (m.group() for m in self.splitter.of(text).finditer(text)), []
        while stretch := list(islice(found, 200_000)):
            out.append(b"".join(map(get, stretch)))
        return np.frombuffer(b"".join(out), "<u4")

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes of token ids."""
        length = self._length[ids]
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ids) else 0) + np.repeat(self._start[ids] - ends + length, length)
        return self._blob[at].tobytes()

    def decode_stream(self, ids: np.ndarray, step: int = 16_384) -> Iterator[str]:
        """Text of a token stream, ``step`` ids at a time; characters cut between tokens are waited for."""
        machine = Utf8()
        for at in range(0, len(ids), step):
            yield machine.feed(self.spell(ids[at : at + step]))
        yield machine.close()


class Utf8:
    """Incremental UTF-8: the state is how many bytes the open character still needs, and those it has."""

    def __init__(self):
        self._open = b""

    @staticmethod
    def needs(lead: int) -> int:
        """Bytes of a character by its first one; 0 for a byte that can't be the first."""
        return 1 if lead < 0x80 else 0 if lead < 0xC2 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4 if lead < 0xF5 else 0

    def feed(self, raw: bytes) -> str:
        data = self._open + raw
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:  # the last first byte: is its character whole?
                if self.needs(byte) > back:
                    cut -= back
                break
        self._open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        left, self._open = self._open, b""
        return left.decode("utf-8", "replace")


@functools.cache
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): token ids of every whole text and the text decoded from them.

    Null texts count as empty (no ids, empty text), null and repeated ids are carried, other columns
    aren't read. Every match of the pattern is encoded by itself; there are no special tokens.
    An empty table gives an empty one.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = common.arrow_type(own, "doc_id")

    def run(frames):
        both = codec(ranks_path, pattern)
        schema = pa.schema([("doc_id", kind), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

        def flush(keys, ids, texts):
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = pa.array(np.concatenate(ids).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(texts, pa.string())], schema=schema)

        keys, ids, texts, size = [], [], [], 0
        for frame in frames:
            for key, value in zip(frame.column(0).to_pylist(), frame.column(1)):
                found = both.encode(value.as_py() or "")
                keys.append(key)
                ids.append(found)
                texts.append("".join(both.decode_stream(found)))
                size += 4 * len(found) + len(texts[-1])
                if size > common.OUT_BYTES:
                    yield flush(keys, ids, texts)
                    keys, ids, texts, size = [], [], [], 0
        if keys:
            yield flush(keys, ids, texts)

    return own.mapInArrow(run, T.StructType([own.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))


def decode(rows: DataFrame, ranks_path: str, pattern: str, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of an id list in ``into``; a null list gives null."""

    @F.pandas_udf(T.StringType())
    def of(lists):
        both = codec(ranks_path, pattern)
        return lists.map(lambda x: None if x is None else "".join(both.decode_stream(np.asarray(x, np.int64))))

    return rows.withColumn(into, of(ids))


def decode_tokens(tokens: Iterable[bytes]) -> Iterator[str]:
    """Text as soon as it is whole, from token bytes that arrive one by one."""
    machine = Utf8()
    for token in tokens:
        if text := machine.feed(token):
            yield text
    if text := machine.close():
        yield text
