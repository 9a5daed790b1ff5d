"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

Texts are split by the vocabulary's pattern; the distinct pieces of a batch are encoded
together. Pieces of similar length form a padded matrix of token ids. In every round each
row merges its leftmost pair of least rank, the pair's rank being looked up in an open
hash table; rows without a mergeable pair leave the matrix, the others are compacted.
Pieces beyond LONG_PIECE bytes, for which rounds over a matrix would take quadratic time,
are merged by the same rule with a heap.

Defined cases: null and empty texts have the empty list; texts of blanks or markup are
ordinary text, also where they spell a special token. Row order and repeated ids are kept.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.session import Shared, spread, table

LONG_PIECE = 256
MEMO_PIECES = 1 << 18
BATCH_CHARS = 4_000_000
NONE = np.int32(np.iinfo(np.int32).max)
#: How the public byte-level vocabularies split text before the merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public vocabularies lie; a path of one's own may be given instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """Merges of a vocabulary: (left id, right id) -> id of the joined token, its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.pattern = pattern
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, joined = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), joined.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(2, len(keys)) * 3))))
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        self.reach = 0
        self._fill(keys, np.array(joined, np.int32))

    @cached_property
    def pair_ranks(self) -> dict[int, int]:
        """The pairs as a dictionary, made where the first long piece is met."""
        used = self.values != NONE
        return dict(zip(self.keys[used].tolist(), self.values[used].tolist()))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        slots, mask = self._slots(keys), (1 << self.bits) - 1
        while len(keys):
            free = np.flatnonzero(self.values[slots] == NONE)
            first = free[np.unique(slots[free], return_index=True)[1]]
            self.keys[slots[first]], self.values[slots[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & mask
            self.reach += 1

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it can't merge; negative ids never merge."""
        shape, left, right = left.shape, left.ravel(), right.ravel()
        bad = (left < 0) | (right < 0)
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slots, mask = self._slots(keys), (1 << self.bits) - 1
        out = np.where(self.keys[slots] == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((out == NONE) & (self.values[slots] != NONE) & ~bad)
        for _ in range(self.reach):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & mask
            at = slots[open_]
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.values[at] != NONE)]
        out[bad] = NONE
        return out.reshape(shape)

    def encode_matrix(self, pieces: list[bytes]) -> list[list[int]]:
        """Pieces of at most LONG_PIECE bytes, best of similar length."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        flat = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[inside] = flat
        out: list[list[int]] = [[]] * len(pieces)
        row = np.arange(len(pieces))
        rank = self.ranks(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(pieces), 0), NONE)
        while len(row):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(row), np.int64)
            least = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NONE)
            done = least == NONE
            if done.any():
                count = (ids[done] >= 0).sum(1)
                for r, tokens, n in zip(row[done].tolist(), ids[done].tolist(), count.tolist()):
                    out[r] = tokens[:n]
                row, ids, rank, at, least = row[~done], ids[~done], rank[~done], at[~done], least[~done]
                if not len(row):
                    break
            n = np.arange(len(row))
            ids[n, at] = least
            w = ids.shape[1]
            move = np.arange(w - 1) > at[:, None]
            ids[:, :-1] = np.where(move, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            if w > 2:
                rank[:, :-1] = np.where(move[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            longest = int((ids >= 0).sum(1).max())
            ids, rank = ids[:, :longest], rank[:, : longest - 1]
            if longest < 2:
                continue
            inner = at < longest - 1
            rank[n[inner], at[inner]] = self.ranks(ids[n[inner], at[inner]], ids[n[inner], at[inner] + 1])
            back = (at > 0) & (at <= longest - 1)
            rank[n[back], at[back] - 1] = self.ranks(ids[n[back], at[back] - 1], ids[n[back], at[back]])
        return out

    def encode_long(self, piece: bytes) -> list[int]:
        """The same rule for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.pair_ranks
        first = self.ranks(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                r = ranks.get((ids[i] << 32) | ids[j])
                if r is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct pieces, bucketed by length."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        out: dict[str, tuple[int, ...]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            if len(raw) > LONG_PIECE:
                out[p] = tuple(self.encode_long(raw))
            else:
                n = len(raw)
                buckets.setdefault(n if n <= 16 else 1 << (n - 1).bit_length(), []).append((p, raw))
        for members in buckets.values():
            for lo in range(0, len(members), 4096):
                part = members[lo : lo + 4096]
                for (p, _), ids in zip(part, self.encode_matrix([raw for _, raw in part])):
                    out[p] = tuple(ids)
        return out


class Encoder:
    """Texts to ids, with a bounded memory of pieces already encoded."""

    def __init__(self, pairs: PairTable):
        self.pairs, self.split = pairs, regex.compile(pairs.pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars < BATCH_CHARS):
                chars += len(texts[hi] or "")
                hi += 1
            pieces = [self.split(t) if t else [] for t in texts[lo:hi]]
            if len(self.memo) > MEMO_PIECES:
                self.memo = {}
            new = set(chain.from_iterable(pieces)) - self.memo.keys()
            self.memo |= self.pairs.encode_pieces(new)
            get = self.memo.__getitem__
            for own in pieces:
                yield list(chain.from_iterable(map(get, own)))
            lo = hi


_ENCODERS: dict[str, Encoder] = {}


def shared_pairs(spark: SparkSession, path: str | None = None, pattern: str = PATTERN) -> Shared:
    """The merges as a broadcast: a few MB, bounded by the vocabulary and not by the data."""
    return Shared(spark, PairTable(read_ranks(path or vocabulary_path()), pattern))


def _encoder(pairs: Shared) -> Encoder:
    if pairs.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[pairs.key] = Encoder(pairs.value)
    return _ENCODERS[pairs.key]


def encode_column(
    df: DataFrame, text: str, out: str = "ids", path: str | None = None, count_only: bool = False,
    also: tuple[str, Callable[[list[str | None]], np.ndarray]] | None = None,
) -> DataFrame:
    """df's other columns and the ids (or, with count_only, their number as bigint) of `text`.

    The text itself isn't returned. A null text has no ids, so it counts 0. A column of
    df that is already called `out` is an error. `also` is the name of a further column of
    doubles and what makes it of the texts, in the same pass.
    """
    keep = [c for c in df.columns if c != text]
    if out in keep or (also and also[0] in keep):
        raise ValueError(f"there is a column named {out if out in keep else also[0]} already")
    pairs = shared_pairs(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(pairs)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            lists = encoder.encode(texts)
            others = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            if count_only:
                ids = pa.array([len(x) for x in lists], pa.int64())
            else:
                offsets, flat = [0], []
                for x in lists:
                    flat.append(np.array(x, np.int32))
                    offsets.append(offsets[-1] + len(x))
                values = pa.array(np.concatenate(flat) if flat else np.array([], np.int32), pa.int32())
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            more = [pa.array(also[1](texts), pa.float64())] if also else []
            yield pa.RecordBatch.from_arrays([*others, ids, *more], names=[*keep, out, *([also[0]] if also else [])])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{out}` {'bigint' if count_only else 'array<int>'}", *([f"`{also[0]}` double"] if also else [])])
    return spread(df).mapInArrow(run, schema)


def decode_ids(ids: Iterable[int], ranks: dict[bytes, int]) -> str:
    """The text of ids; the exact inverse of the encoding."""
    names = {v: k for k, v in ranks.items()}
    return b"".join(names[i] for i in ids).decode("utf-8", "surrogatepass")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_ids: doc_id and ids of every document by byte_bpe_50k."""
    return encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def p6_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens per source and language."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text")
    return (
        encode_column(docs, "text", "n_tokens", count_only=True).groupBy("source", "lang")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    )


QUERIES = {"p6_ids": p6_ids, "p6_token_totals": p6_token_totals}
ORACLES: dict[str, str] = {}
