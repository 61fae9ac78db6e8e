"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut in halves down to leaves; a leaf is split into pattern matches
and each match into tokens.  Neighbours are joined by re-encoding a window
around their boundary that grows until nothing outside it can change:

* Matches: a match depends only on the text from its start to one character
  past its end (three from its start, for contractions).  Left matches whose
  look-ahead stayed inside the left half are final; the rest is split anew
  until a match starts where a match of the right half starts.
* Tokens of a long match: an encoding is the right one when each adjacent
  pair of tokens, encoded on its own, gives that pair again.  The window
  around the boundary grows until its two edge pairs do.

Decoding looks tokens up in leaves and concatenates up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructType

from prefloom.llm.words import blocks

LEAF_CHARS = 1 << 14
LEAF_BYTES = 24
LEAF_IDS = 1 << 12
LOOK = 3  # characters from a match's start that a contraction can reach
CACHE_ENTRIES = 200_000
MAX_RANK_FILE = 64 << 20
NO_RANK = 1 << 32  # above every rank: ids are 32-bit

_codecs: dict[tuple[str, str], Codec] = {}


class _PieceIds(dict):
    """Match -> its ids as little-endian unsigned 32-bit integers; filled on demand.

    A full cache becomes the older one; what is met again there is taken over.
    """

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = struct.pack(f"<{len(found := self.codec.encode_piece(piece.encode()))}I", *found)
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern)
        self.cache = _PieceIds(self)
        self._pairs: dict[tuple[int, int], bool] = {}

    # --- tokens of one match -------------------------------------------------
    def _merge(self, raw: bytes) -> list[int]:
        """Tokens by repeated merging of the lowest-ranked adjacent pair."""
        ranks, rank = self.ranks, self.ranks.get
        parts = [raw[i : i + 1] for i in range(len(raw))]
        # the rank of each part with the next; a merge changes those of its two neighbours only
        pairs = [rank(raw[i : i + 2], NO_RANK) for i in range(len(raw) - 1)]
        while pairs and (low := min(pairs)) != NO_RANK:
            at = pairs.index(low)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], NO_RANK)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], NO_RANK)
        return [ranks[p] for p in parts]

    def _agree(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            known = self._merge(self.tokens[a] + self.tokens[b]) == [a, b]
            if len(self._pairs) >= CACHE_ENTRIES:
                self._pairs.clear()
            self._pairs[a, b] = known
        return known

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self._agree(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(k, len(right))
            window = self._merge(b"".join(self.tokens[t] for t in left[i:] + right[:j]))
            if (i == 0 or self._agree(left[i - 1], window[0])) and (j == len(right) or self._agree(window[-1], right[j])):
                return left[:i] + window + right[j:]
            k *= 2

    def encode_piece(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        if len(raw) <= LEAF_BYTES:
            return self._merge(raw)
        half = len(raw) // 2
        return self._join(self.encode_piece(raw[:half]), self.encode_piece(raw[half:]))

    # --- matches of a text ---------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """The pattern's matches over the whole text, by halves."""
        if len(text) <= LEAF_CHARS:
            return self.find.findall(text)
        half = len(text) // 2
        return self._join_pieces(text, half, self.pieces(text[:half]), self.pieces(text[half:]))

    def _join_pieces(self, text: str, cut: int, left: list[str], right: list[str]) -> list[str]:
        at = cut
        while left:  # a match that saw the cut is not final
            start = at - len(left[-1])
            if at < cut and start + LOOK <= cut:
                break
            left.pop()
            at = start
        k = 8
        while True:
            starts, end = {}, cut
            for i, p in enumerate(right[:k]):
                starts[end] = i
                end += len(p)
            done = k >= len(right)
            stop = len(text) if done else end
            fresh, pos = [], at
            for m in self.find.finditer(text[at:stop]):
                if pos >= cut and pos in starts:
                    return left + fresh + right[starts[pos] :]
                if not done and (at + m.end() >= stop or pos + LOOK > stop):
                    break
                fresh.append(m.group())
                pos = at + m.end()
            else:
                if done:
                    return left + fresh
            k *= 4

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, self.pieces(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def _codec(shared) -> Codec:
    """One codec per Python worker, whatever the number of tasks it runs."""
    key, raw, pattern = shared.value
    if (key, pattern) not in _codecs:
        _codecs[key, pattern] = Codec(parse_ranks(raw), pattern)
    return _codecs[key, pattern]


def _share(df: DataFrame, path: str, pattern: str):
    """The rank file as a broadcast variable: a vocabulary, bounded and independent of the data."""
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) > MAX_RANK_FILE:
        raise ValueError(f"rank file of {len(raw)} bytes is larger than {MAX_RANK_FILE}")
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(raw).hexdigest(), raw, pattern))


def encode_bpe(
    docs: DataFrame,
    path: str,
    pattern: str,
    text_col: str = "text",
    keep: list[str] | None = None,
    ids_col: str = "ids",
    count_col: str = "n_tokens",
    as_array: bool = False,
) -> DataFrame:
    """`keep` columns (default: all), `count_col` long, `ids_col`.

    Ids are binary (little-endian unsigned 32-bit), or array<int> with
    `as_array`.  Special tokens are never produced.  A null or empty text has
    no ids.  One narrow pass over whole texts; rows keep their multiplicity.
    Input columns named as the new ones are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (ids_col, count_col)]
    d = docs.select(*dict.fromkeys([*keep, text_col]))
    fields = [f for f in d.schema.fields if f.name in keep]
    out = StructType(list(fields)).add(count_col, "long").add(ids_col, ArrayType(IntegerType()) if as_array else "binary")
    arrow, shared = to_arrow_schema(out), _share(docs, path, pattern)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            texts = batch.column(text_col)
            for lo, hi, _, _ in blocks(texts, 4 << 20):
                ids = [codec.encode(t or "") for t in texts.slice(lo, hi - lo).to_pylist()]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                if as_array:
                    offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    col = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                else:
                    col = pa.array(ids, pa.binary())
                cols = [batch.column(n).slice(lo, hi - lo) for n in names]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(t) for c, t in zip([*cols, pa.array(counts), col], arrow.types, strict=True)], schema=arrow
                )

    return d.mapInArrow(run, out)


def decode_bpe(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (default: all) and the bytes of the ids (binary or array<int>); null ids give no bytes.

    An input column named as the new one is replaced.
    """
    keep = [c for c in (encoded.columns if keep is None else keep) if c != out_col]
    d = encoded.select(*dict.fromkeys([*keep, ids_col]))
    fields = [f for f in d.schema.fields if f.name in keep]
    out = StructType(list(fields)).add(out_col, "binary")
    arrow, shared = to_arrow_schema(out), _share(encoded, path, pattern)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            ids = batch.column(ids_col)
            for lo in range(0, len(ids), 512):
                part = ids.slice(lo, 512).to_pylist()
                raw = [codec.decode(np.frombuffer(x, "<u4") if isinstance(x, bytes) else np.array(x or [], np.int64)) for x in part]
                cols = [batch.column(n).slice(lo, 512) for n in names]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(t) for c, t in zip([*cols, pa.array(raw, pa.binary())], arrow.types, strict=True)], schema=arrow
                )

    return d.mapInArrow(run, out)
