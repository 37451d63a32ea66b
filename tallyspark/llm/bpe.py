"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is
itself a token is resolved by one probe, for all new pre-tokens of a batch at
once.  Tier two merges the bytes of the others: a heap holds adjacent pairs by
(rank, position) over a linked list of byte runs, the lowest pair merges first.
Short pre-tokens of a batch step together (``HeapRows``): each has its linked
runs and its heap, an implicit binary tree, in a row of a few matrices.

Texts are cut into pieces at spaces first (see ``pieces``), which never cuts a
pre-token, and each task remembers the ids of pieces it has met.

Defined results: a null text is an empty one, with no ids; null ids decode to
empty bytes; repeated rows come back repeated; empty tables give empty results;
the operators are columns, so other columns are never touched.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import small_batches
from .pieces import BLOCK_CHARS, BLOCK_ROWS, PieceMemory

WORDS = 300_000  # pre-tokens that a worker remembers; merging one again takes a few microseconds
WIDTHS = (8, 16, 32)  # bytes of the strings whose heaps step together; longer ones have a heap of their own
ROWS_AT_ONCE = 4096
PRETOKENS_AT_ONCE = 1 << 16


class PerfectHash:
    """Minimal perfect hash: every key gets its own slot below ``len(keys)``.

    Level by level, keys alone at their position of a bit array stay there and
    the rest go to the next level; a slot is the rank of the key's bit.
    """

    ROOM = 2.0  # positions per key of a level

    def __init__(self, hashes: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        rest, below = hashes, 0
        while len(rest):
            size = max(1, int(len(rest) * self.ROOM)) | 1
            at = self._position(rest, len(self.levels), size)
            taken = np.bincount(at, minlength=size) == 1
            self.levels.append((size, taken, below + np.cumsum(taken) - taken))
            below += int(taken.sum())
            rest = rest[~taken[at]]
        self.size = below

    @staticmethod
    def _position(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (hashes ^ np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h = h * np.uint64(0xD6E8FEB86659FD93)
        return ((h >> np.uint64(20)) % np.uint64(size)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash; a hash of no key gets an arbitrary slot or -1."""
        out, open_ = np.full(len(hashes), -1, dtype=np.int64), np.arange(len(hashes))
        for level, (size, taken, rank) in enumerate(self.levels):
            at = self._position(hashes[open_], level, size)
            hit = taken[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out


def _hashes(tokens: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], dtype=np.uint64)


class PairRanks:
    """Rank of the token that two adjacent tokens make, for arrays of pairs of ids: a hash table in flat arrays."""

    NONE = 1 << 40  # above every rank

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {
            (left << 32 | right): rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        }
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        found = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
        self.bits = max(4, (4 * len(keys)).bit_length())
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        self.keys, self.ranks = np.append(keys[order], -1), np.append(found[order], self.NONE)  # one entry past the end
        self.begin = np.searchsorted(bucket[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        bucket = self._bucket(keys)
        at, end = self.begin[bucket], self.begin[bucket + 1]
        out = np.full(len(keys), self.NONE, dtype=np.int64)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            here = at[open_]
            hit = self.keys[here] == keys[open_]
            out[open_[hit]] = self.ranks[here[hit]]
            at[open_] += 1
            open_ = open_[~hit & (here + 1 < end[open_])]
        return out


class HeapRows:
    """The heaps and linked byte runs of many byte strings of at most ``width`` bytes (a power of two), a row each.

    Node 1 of a row's heap is the lowest of its pairs, node i the lower of nodes 2i and
    2i + 1, and node ``width`` + p the pair whose first run begins at p: rank and p in
    one number.  A step merges the pair on top of every row and mends the three paths
    above the pairs that changed.
    """

    def __init__(self, tokens: list[bytes], width: int, byte_rank: np.ndarray, first: np.ndarray, pairs: PairRanks):
        n, self.width, self.pairs = len(tokens), width, pairs
        data = np.frombuffer(b"".join([t.ljust(width, b"\0") for t in tokens]), dtype=np.uint8).reshape(n, width).astype(np.int64)
        self.sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=n)
        place = np.arange(width)
        self.run = np.where(place < self.sizes[:, None], byte_rank[data], -1).ravel()  # id of the run that begins here, or -1
        self.end = np.tile(np.arange(1, width + 2), n)  # of that run; rows of width + 1
        self.before = np.tile(np.arange(-1, width), n)
        self.heap = np.full((n, 2 * width), PairRanks.NONE << 8, dtype=np.int64)
        ranks = first[data[:, :-1] << 8 | data[:, 1:]]
        self.heap[:, width:-1] = np.where(place[1:] < self.sizes[:, None], ranks, PairRanks.NONE) << 8 | place[:-1]
        for node in range(width - 1, 0, -1):
            self.heap[:, node] = np.minimum(self.heap[:, 2 * node], self.heap[:, 2 * node + 1])
        self.heap = self.heap.ravel()

    def merged(self) -> list[bytes]:
        width, heap, run, end, before, none = self.width, self.heap, self.run, self.end, self.before, PairRanks.NONE
        rows = np.arange(len(self.sizes))
        while True:
            top = heap[rows * 2 * width + 1]
            left = top < none << 8
            rows, top = rows[left], top[left]
            if not len(rows):
                break
            a, rank = top & 255, top >> 8
            runs, links, leaves = rows * width, rows * (width + 1), rows * 2 * width + width
            mid = end[links + a]
            stop = end[links + mid]
            run[runs + a], run[runs + mid] = rank, -1
            end[links + a], before[links + stop] = stop, a
            heap[leaves + mid] = none << 8
            more = stop < self.sizes[rows]
            after = np.full(len(rows), none, dtype=np.int64)
            after[more] = self.pairs.get(rank[more], run[(runs + stop)[more]])
            heap[leaves + a] = after << 8 | a
            some = np.flatnonzero(a > 0)
            b = before[(links + a)[some]]
            heap[leaves[some] + b] = self.pairs.get(run[runs[some] + b], rank[some]) << 8 | b
            base = np.concatenate([rows, rows, rows[some]]) * 2 * width
            node = np.concatenate([a, mid, b]) + width
            while node[0] > 1:
                node >>= 1
                child = base + 2 * node
                heap[base + node] = np.minimum(heap[child], heap[child + 1])
        kept = run.reshape(-1, width) >= 0
        flat, ends = run.reshape(-1, width)[kept].astype("<i4").tobytes(), 4 * np.cumsum(kept.sum(axis=1))
        return [flat[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist())]


class Codec:
    """Encoder and decoder of one vocabulary (token bytes to id, which is also its merge rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        hashes = _hashes(list(ranks))
        self.perfect = PerfectHash(hashes)
        self.slot_token: list[bytes] = [b""] * len(ranks)
        self.slot_id = np.zeros(len(ranks), dtype="<i4")
        for slot, (token, rank) in zip(self.perfect.slots(hashes).tolist(), ranks.items()):
            self.slot_token[slot], self.slot_id[slot] = token, rank
        self.byte_rank = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.pair_rank = [-1] * (1 << 16)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pair_rank[token[0] << 8 | token[1]] = rank
        self.pairs, self.first = PairRanks(ranks), np.array(self.pair_rank, dtype=np.int64)
        self.first[self.first < 0] = PairRanks.NONE
        in_order = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            in_order[rank] = token
        self.token_bytes = np.frombuffer(b"".join(in_order), dtype=np.uint8)
        self.token_size = np.fromiter(map(len, in_order), dtype=np.int64, count=len(in_order))
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.memory = PieceMemory(regex.compile(pattern).findall, self.resolve)

    def merge(self, token: bytes) -> bytes:
        """Ids of a byte string by heap merges over linked byte runs."""
        n, rank_of = len(token), self.ranks.get
        bits = n.bit_length()
        mask = (1 << bits) - 1
        end = list(range(1, n + 2))  # of the run that begins here; 0 once it has been merged away
        before = list(range(-1, n))
        run = list(map(self.byte_rank.__getitem__, token))  # id of the run that begins here
        # an entry is rank, begin and stop of a pair in one number: the lowest rank comes first, then the leftmost
        pair_rank, heap, last = self.pair_rank, [], token[0]
        for i in range(1, n):
            this = token[i]
            if (r := pair_rank[last << 8 | this]) >= 0:
                heap.append((r << bits | i - 1) << bits | i + 1)
            last = this
        heapify(heap)
        while heap:
            top = heappop(heap)
            stop = top & mask
            top >>= bits
            a = top & mask
            mid = end[a]
            if not mid or end[mid] != stop:
                continue  # one of the two runs has grown or gone since
            run[a] = top >> bits
            end[a] = stop
            end[mid] = 0
            before[stop] = a
            if stop < n and (r := rank_of(token[a : (last := end[stop])])) is not None:
                heappush(heap, (r << bits | a) << bits | last)
            if a and (r := rank_of(token[(first := before[a]) : stop])) is not None:
                heappush(heap, (r << bits | first) << bits | stop)
        return array("i", [r for r, e in zip(run, end) if e]).tobytes()

    def resolve(self, pretokens: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens: the perfect hash first, the heap for what is not a token."""
        starts = range(0, len(pretokens), PRETOKENS_AT_ONCE)
        return [ids for at in starts for ids in self._resolved(pretokens[at : at + PRETOKENS_AT_ONCE])]

    def _resolved(self, pretokens: list[str]) -> list[bytes]:
        raw = [p.encode("utf-8", "replace") for p in pretokens]
        slots = self.perfect.slots(_hashes(raw)).tolist()
        out: list[bytes] = []
        rows: dict[int, list[int]] = {width: [] for width in WIDTHS}  # of each width, the numbers of its byte strings
        together = -1 not in self.byte_rank
        for token, slot in zip(raw, slots):
            if slot >= 0 and self.slot_token[slot] == token:
                out.append(self.slot_id[slot : slot + 1].tobytes())
            elif together and 1 < len(token) <= WIDTHS[-1]:
                rows[WIDTHS[bisect_left(WIDTHS, len(token))]].append(len(out))
                out.append(b"")
            else:
                out.append(self.merge(token))
        byte_rank = np.array(self.byte_rank, dtype=np.int64)
        for width, numbers in rows.items():
            for at in range(0, len(numbers), ROWS_AT_ONCE):
                some = numbers[at : at + ROWS_AT_ONCE]
                heaps = HeapRows([raw[i] for i in some], width, byte_rank, self.first, self.pairs)
                for i, ids in zip(some, heaps.merged()):
                    out[i] = ids
        return out

    def encode(self, texts: list[str], words: int = WORDS, chars: int = BLOCK_CHARS) -> Iterator[np.ndarray]:
        return self.memory.limited(words, chars).encode(texts)

    def decode(self, lists: list[np.ndarray]) -> Iterator[bytes]:
        """Bytes of each list of ids, gathered from the tokens' bytes."""
        for ids in lists:
            size = self.token_size[ids]
            ends = np.cumsum(size)
            at = np.repeat(self.token_start[ids] - ends + size, size)
            at += np.arange(len(at))
            yield self.token_bytes[at].tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker; the vocabulary file is part of every executor's installation."""
    return Codec(read_ranks(path), pattern)


def encode(text: Column | str, path: str, pattern: str, words: int = WORDS, rows: int = BLOCK_ROWS, chars: int = BLOCK_CHARS) -> Column:
    """Token ids (array<int>) of each text; special tokens are never made.

    ``words`` bounds what a worker remembers, ``rows`` its batches and ``chars`` the texts of a
    batch that are encoded together: smaller values take less memory and more time, with the same ids.
    """
    small_batches(rows)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        texts = ["" if t is None else t for t in texts]
        return pd.Series(list(codec(path, pattern).encode(texts, words, chars)), dtype=object)

    return ids(text)


def decode(ids: Column | str, path: str, pattern: str) -> Column:
    """Bytes of each array of token ids."""

    @F.pandas_udf("binary")
    def raw(lists: pd.Series) -> pd.Series:
        none = np.zeros(0, dtype=np.int32)
        return pd.Series(list(codec(path, pattern).decode([none if x is None else x for x in lists])), dtype=object)

    return raw(ids)
