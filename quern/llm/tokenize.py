"""Byte-pair encoding as a streaming transducer, and its decoder.

A text is cut into pieces by the tokenizer's pattern, lazily. Each piece goes through a transducer that holds a bounded window of
bytes and emits tokens once no byte still to come can change them. How many bytes that takes is computed from the merge list
(sufficient_lookahead). So the memory for a text doesn't grow with its length, and a piece of megabytes is encoded in pieces.
"""

from __future__ import annotations

import base64
import os
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that the window takes in beyond the lookahead before it encodes; a matter of speed only.
WINDOW = 2048
#: Pieces whose ids a worker remembers; a matter of speed only.
MEMORY = 200_000


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The public tokenizer's file: in the folder QUERN_TOKENIZERS if that is set, else where the package of tokenizers lies."""
    folder = os.environ.get("QUERN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


# Fixed value: the pattern by which the byte-level tokenizers cut a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Merges:
    """The vocabulary of a byte-level tokenizer: ids by bytes, an id being also the rank of the merge that makes it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.single = [ranks[bytes([b])] for b in range(256)]

    @classmethod
    def load(cls, file: str) -> Merges:
        with open(file, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def encode(self, data: bytes, whole: bool = True) -> list[bytes]:
        """The tokens of ``data``: of all adjacent pairs that make a token, that of the lowest rank is merged first, the leftmost first.

        ``whole``: it is a whole piece, which is one token if the vocabulary has it, even if no merge makes it.
        """
        if whole and data in self.ranks:
            return [data]
        parts = [data[i : i + 1] for i in range(len(data))]
        if len(parts) > 64:
            return self._encode_long(parts)
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _encode_long(self, parts: list[bytes]) -> list[bytes]:
        """The same by a heap of pairs over a linked list, for windows in which a scan for each merge would be slow."""
        import heapq

        n, ranks = len(parts), self.ranks
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(parts[i] + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[after[i]])))
            if before[i] >= 0 and (r := ranks.get(parts[before[i]] + parts[i])) is not None:
                heapq.heappush(heap, (r, before[i], len(parts[before[i]]) + len(parts[i])))
        return [p for p, a in zip(parts, alive, strict=True) if a]

    def children(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The pair whose merge makes ``token``: what is left of it when merges of its own rank and above aren't made."""
        if len(token) == 1:
            return None
        rank = self.ranks[token]
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                return None  # no merge makes it; it can only stand as a whole piece
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def sufficient_lookahead(self) -> int:
        """Bytes after a token's end beyond which nothing can change the token.

        A byte reaches to the left only by a chain of merges: each takes the first symbol that a merge of higher rank to its left
        would have needed as its right part. Ranks rise along such a chain, so it can't be longer than the heaviest path through
        the merge list, which one pass in the order of ranks finds: weight[y] is the reach of a chain that has taken a symbol y
        away from whatever stands before it. A token of the longest size may stand across the end of the path.
        """
        kids: dict[bytes, tuple[bytes, bytes]] = {}
        weight: dict[bytes, int] = {}
        most = 0
        for token in sorted(self.ranks, key=self.ranks.__getitem__):
            pair = self.children(token)
            if pair is None:
                continue
            kids[token] = pair
            reach = max(len(token), len(pair[0]) + weight.get(pair[1], 0))
            most = max(most, reach)
            spine = token
            while spine in kids:  # every symbol with which the token could have begun
                spine = kids[spine][0]
                weight[spine] = max(weight.get(spine, 0), reach)
        return most + self.longest


class Transducer:
    """Encodes texts to ids, piece by piece, with bounded memory."""

    def __init__(self, merges: Merges, pattern: str, lookahead: int | None = None, window: int = WINDOW, memory: int = MEMORY):
        self.merges, self.pieces = merges, regex.compile(pattern)
        self.lookahead = merges.sufficient_lookahead() if lookahead is None else lookahead
        self.window, self.memory = window, memory
        self.known: dict[str, list[int]] = {}

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that arrives in chunks. A token goes out once ``lookahead`` bytes stand behind it."""
        held, started = b"", False
        ranks = self.merges.ranks
        for chunk in chunks:
            held += chunk
            if len(held) < self.window + self.lookahead:
                continue
            sure, start = len(held) - self.lookahead, 0
            for token in self.merges.encode(held, whole=False):
                if start + len(token) > sure:
                    break
                yield ranks[token]
                start += len(token)
            held, started = held[start:], started or start > 0
        for token in self.merges.encode(held, whole=not started) if held else ():
            yield ranks[token]

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        step = self.window
        if len(data) <= step + self.lookahead:
            return [self.merges.ranks[t] for t in self.merges.encode(data)]
        return list(self.stream(data[i : i + step] for i in range(0, len(data), step)))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for null and empty ones. Special tokens' strings are ordinary text."""
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for m in self.pieces.finditer(text):
            piece = m[0]
            ids = known.get(piece)
            if ids is None:
                ids = self._piece(piece)
                if len(piece) <= 64:
                    if len(known) >= self.memory:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


class Decoder:
    """Ids to text, incrementally: a state machine over bytes holds back an unfinished character, at most three bytes."""

    #: By lead byte: length, and the least and greatest second byte.
    _LEADS = [(0xC2, 0xDF, 2, 0x80, 0xBF), (0xE0, 0xE0, 3, 0xA0, 0xBF), (0xE1, 0xEC, 3, 0x80, 0xBF), (0xED, 0xED, 3, 0x80, 0x9F), (0xEE, 0xEF, 3, 0x80, 0xBF), (0xF0, 0xF0, 4, 0x90, 0xBF), (0xF1, 0xF3, 4, 0x80, 0xBF), (0xF4, 0xF4, 4, 0x80, 0x8F)]

    def __init__(self, merges: Merges):
        self.bytes = {i: b for b, i in merges.ranks.items()}
        self.leads = {b: (n, lo, hi) for a, z, n, lo, hi in self._LEADS for b in range(a, z + 1)}

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as it is whole; bytes that are no UTF-8 give U+FFFD, one for each ill-formed run as far as it was well-formed."""
        state: bytearray = bytearray()
        todo: deque[int] = deque()
        for i in ids:
            todo.extend(self.bytes[i])
            out = []
            while todo:
                b = todo[0]
                if not state:
                    todo.popleft()
                    if b < 0x80:
                        out.append(chr(b))
                    elif b in self.leads:
                        state.append(b)
                    else:
                        out.append("�")
                    continue
                n, lo, hi = self.leads[state[0]]
                if (lo <= b <= hi) if len(state) == 1 else (0x80 <= b <= 0xBF):
                    state.append(todo.popleft())
                    if len(state) == n:
                        out.append(state.decode("utf-8"))
                        state.clear()
                else:
                    out.append("�")
                    state.clear()
            if out:
                yield "".join(out)
        if state:
            yield "�"

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))


@lru_cache(maxsize=4)
def decoder(file: str) -> Decoder:
    """One for each worker and vocabulary."""
    return Decoder(Merges.load(file))


@lru_cache(maxsize=4)
def transducer(file: str) -> Transducer:
    """One for each worker and vocabulary."""
    return Transducer(Merges.load(file), PATTERN)


def _encode_batches(batches: Iterator[pa.RecordBatch], file: str, count_only: bool) -> Iterator[pa.RecordBatch]:
    t = transducer(file)
    for batch in batches:
        texts = batch.column("_text").to_pylist()
        ids = pa.array([len(t.encode(x)) for x in texts], pa.int64()) if count_only else pa.array([t.encode(x) for x in texts], pa.list_(pa.int32()))
        keys = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_text"]
        yield pa.RecordBatch.from_arrays([*(c for _, c in keys), ids], names=[*(n for n, _ in keys), "n_tokens" if count_only else "ids"])


def encode_texts(df: DataFrame, text: str, keep: list[str], file: str | None = None, count_only: bool = False) -> DataFrame:
    """``keep`` and ids (array of integers), or with ``count_only`` n_tokens (bigint).

    A null or empty text has no ids: an empty list, or 0. Every row is kept; nothing is exchanged; no special tokens are made.
    """
    file = file or tokenizer_file()
    src = df.select(*keep, F.col(text).cast("string").alias("_text"))
    extra = T.StructField("n_tokens", T.LongType()) if count_only else T.StructField("ids", T.ArrayType(T.IntegerType()))
    return src.mapInArrow(lambda it: _encode_batches(it, file, count_only), T.StructType([*(f for f in src.schema.fields if f.name != "_text"), extra]))


def _decode_batches(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    d = decoder(file)
    for batch in batches:
        texts = [d.decode(i for i in ids or () if i is not None) for ids in batch.column("_ids").to_pylist()]
        keys = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_ids"]
        yield pa.RecordBatch.from_arrays([*(c for _, c in keys), pa.array(texts, pa.string())], names=[*(n for n, _ in keys), "text"])


def decode_ids(df: DataFrame, ids: str, keep: list[str], file: str | None = None) -> DataFrame:
    """``keep`` and text, of the lists of ids in ``ids``. Null and empty lists give an empty text, null ids nothing; an id that the vocabulary
    doesn't have is an error. Every row is kept; nothing is exchanged."""
    file = file or tokenizer_file()
    src = df.select(*keep, F.col(ids).cast("array<int>").alias("_ids"))
    return src.mapInArrow(lambda it: _decode_batches(it, file), T.StructType([*(f for f in src.schema.fields if f.name != "_ids"), T.StructField("text", T.StringType())]))
