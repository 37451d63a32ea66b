"""Token-ID output in a compressed file format: static range asymmetric numeral system (rANS).

A dataset is a folder with two Parquet tables.  ``table``: the shared frequency of
every id, scaled to 2**20.  ``blocks``: one row a block, its ``payload`` a self-contained
byte string

    header   magic, version, lanes, ids, documents, words, checkpoints, checksum of the table
    directory  document ids (int64), their null flags (uint8), their id counts (uint32)
    states   final state of every lane, then per checkpoint its word offset and lane states
    words    32-bit renormalisation words, in decoding order
    checksum CRC-32 of all before

Id i of a block belongs to lane i mod lanes; all lanes step together in numpy.  A
block holds whole documents and decodes without any other; a checkpoint every
``CHECKPOINT_STEPS`` steps lets a reader begin inside one.  Blocks are numbered in
ascending doc_id order: ``part`` is the range of ids, ``block`` counts inside it, and
``before`` is the number of ids of the part that precede the block.

The first pass tokenises and stores ids, the frequencies are counted over all of
them, the second pass sorts by ranges of doc_id and encodes.  Nothing but the table
(one row per vocabulary id) reaches the driver.

Defined results: a null text is an empty one (only the end id); null ids come
first; equal ids are ordered by their tokens; an empty table writes and reads an
empty dataset; other columns are not written.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, store
from .pieces import BLOCK_ROWS, PieceMemory

SCALE_BITS = 20
LOW = np.uint64(1 << 31)  # states stay in [2**31, 2**63)
LANES = 4096
BLOCK_IDS = 1 << 20
CHECKPOINT_STEPS = 128
MAGIC, VERSION = b"RANS", 1
HEADER = struct.Struct("<4sHHIIIIII")


class Damaged(ValueError):
    """A block whose checksum, version or frequency table does not fit."""


class Frequencies:
    """Shared table: scaled frequencies by id, their cumulative sums, and the id of each of the 2**20 slots."""

    def __init__(self, ids: np.ndarray, scaled: np.ndarray):
        self.ids, self.scaled = ids.astype("<u4"), scaled.astype("<u4")
        self.check = zlib.crc32(self.ids.tobytes() + self.scaled.tobytes())
        size = int(ids.max(initial=0)) + 1
        self.f, self.c = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64)
        self.f[ids] = scaled
        self.c[ids] = np.cumsum(scaled) - scaled
        self.slot_id = np.repeat(self.ids, scaled)

    @classmethod
    def scale(cls, ids: np.ndarray, counts: np.ndarray) -> Frequencies:
        """Every id that occurs gets at least one slot; the rest in proportion, the most frequent take what remains."""
        order = np.argsort(ids)
        ids, counts = ids[order], counts[order]
        if len(ids) == 0:
            return cls(ids.astype(np.int64), counts.astype(np.int64))
        room = (1 << SCALE_BITS) - len(ids)
        scaled = 1 + (counts.astype(np.float64) / counts.sum() * room).astype(np.int64)
        scaled[np.argmax(counts)] += (1 << SCALE_BITS) - scaled.sum()
        return cls(ids, scaled)


def encode_block(docs: list[tuple[int | None, np.ndarray]], table: Frequencies) -> bytes:
    ids = np.concatenate([x for _, x in docs]) if docs else np.array([], dtype="<u4")
    n, steps = len(ids), -(-len(ids) // LANES)
    state = np.full(LANES, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    shift, scale = np.uint64(63 - SCALE_BITS), np.uint64(SCALE_BITS)
    written = 0
    for step in range(steps - 1, -1, -1):
        part = ids[step * LANES : (step + 1) * LANES].astype(np.int64)
        x, f = state[: len(part)], table.f.take(part)
        full = x >= f << shift
        words.append(x[full].astype("<u4"))
        written += len(words[-1])
        x = np.where(full, x >> np.uint64(32), x)
        whole = x // f
        state[: len(part)] = (whole << scale) + (x - whole * f) + table.c.take(part)
        if step and step % CHECKPOINT_STEPS == 0:
            marks.append((written, state.copy()))
    stream = b"".join(w.tobytes() for w in reversed(words))
    keys = np.array([0 if d is None else d for d, _ in docs], dtype="<i8")
    nulls = np.array([d is None for d, _ in docs], dtype=np.uint8)
    sizes = np.array([len(x) for _, x in docs], dtype="<u4")
    body = [
        HEADER.pack(MAGIC, VERSION, LANES, n, len(docs), written, len(marks), table.check, 0),
        keys.tobytes(), nulls.tobytes(), sizes.tobytes(), state.astype("<u8").tobytes(),
    ]
    for after, lanes in reversed(marks):  # words still to come at the checkpoint, so its offset is the rest
        body += [struct.pack("<I", written - after), lanes.astype("<u8").tobytes()]
    raw = b"".join([*body, stream])
    return raw + struct.pack("<I", zlib.crc32(raw))


def decode_block(raw: bytes, table: Frequencies, checkpoint: int = 0) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their id counts, and the ids from ``checkpoint`` (0: the block's begin) on."""
    if len(raw) < HEADER.size + 4 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise Damaged("checksum")
    magic, version, lanes, n, n_docs, n_words, n_marks, check, _ = HEADER.unpack_from(raw)
    if (magic, version) != (MAGIC, VERSION) or check != table.check:
        raise Damaged("format or frequency table")
    at = HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    keys, nulls, sizes = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    state, offset, first = take("<u8", lanes), 0, 0
    for nth in range(1, n_marks + 1):
        here, states = int(take("<u4", 1)[0]), take("<u8", lanes)
        if nth == checkpoint:
            state, offset, first = states, here, checkpoint * CHECKPOINT_STEPS
    words = take("<u4", n_words).astype(np.uint64)
    out = np.empty(max(n - first * lanes, 0), dtype="<u4")
    state = state.copy()
    mask, scale = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    for begin in range(0, len(out), lanes):
        size = min(lanes, len(out) - begin)
        x = state[:size]
        slot = x & mask
        found = table.slot_id.take(slot.view(np.int64))
        whose = found.astype(np.int64)
        x = table.f.take(whose) * (x >> scale) + slot - table.c.take(whose)
        low = np.flatnonzero(x < LOW)
        x[low] = x[low] << np.uint64(32) | words[offset : offset + len(low)]
        offset += len(low)
        state[:size] = x
        out[begin : begin + size] = found
    return [None if z else k for k, z in zip(keys.tolist(), nulls.tolist())], sizes, out


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write for bytes: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class AddedTokens:
    """Cuts texts at the added tokens of a vocabulary file as the library does: those that are not normalised first."""

    def __init__(self, listed: list[dict]):
        self.tokens = {t["content"]: t for t in listed}
        groups = [[c for c, t in self.tokens.items() if t["normalized"] == late] for late in (False, True)]
        longest = lambda g: sorted(g, key=len, reverse=True)
        self.expressions = [regex.compile("|".join(map(regex.escape, longest(g)))) for g in groups if g]

    def _split(self, expression: regex.Pattern, text: str) -> Iterator[str | int]:
        at = 0
        for m in expression.finditer(text):
            token, (begin, end) = self.tokens[m[0]], m.span()
            if token["single_word"] and regex.search(r"\w", text[max(begin - 1, 0) : begin] + text[end : end + 1]):
                continue
            yield text[at:begin].rstrip() if token["lstrip"] else text[at:begin]
            yield token["id"]
            at = len(text) - len(text[end:].lstrip()) if token["rstrip"] else end
        yield text[at:]

    def cut(self, text: str) -> list[str | int]:
        """The stretches between added tokens, and the tokens as ids."""
        if not any(content in text for content in self.tokens):
            return [text]
        parts: list[str | int] = [text]
        for expression in self.expressions:
            parts = [y for x in parts for y in (self._split(expression, x) if isinstance(x, str) else [x])]
        return [x for x in parts if x != ""]


@lru_cache(maxsize=2)
def _added_tokens(path: str) -> AddedTokens:
    with open(path, encoding="utf-8") as f:
        return AddedTokens(json.load(f).get("added_tokens", []))


def _encoded(texts: list[str], path: str, pattern: str, added: bool) -> Iterator[np.ndarray]:
    """Ids of each text: added tokens as one id, the stretches between them by their pieces."""
    cut = list(map(_added_tokens(path).cut, texts)) if added else [[t] for t in texts]
    ids = _tokenizer(path, pattern).encode([x for parts in cut for x in parts if isinstance(x, str)])
    for parts in cut:
        found = [next(ids).view("<u4") if isinstance(x, str) else np.array([x], dtype="<u4") for x in parts]
        yield found[0] if len(found) == 1 else np.concatenate([np.array([], dtype="<u4"), *found])


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str) -> PieceMemory:
    """The library's merges for every new pre-token, cut by the byte-level expression that its file asks for."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    merge, letters = Tokenizer.from_file(path).model.tokenize, _byte_letters()
    letter = np.array([ord(letters[b]) for b in range(256)], dtype="<u4")

    def resolve(words: list[str]) -> list[bytes]:
        raw = [w.encode("utf-8", "replace") for w in words]
        written = letter[np.frombuffer(b"".join(raw), dtype=np.uint8)].tobytes().decode("utf-32-le")
        ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))).tolist()
        ids, cuts = array("I"), [0]
        for a, b in zip([0, *ends], ends):
            ids.extend([t.id for t in merge(written[a:b])])
            cuts.append(4 * len(ids))
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    return PieceMemory(regex.compile(pattern).findall, resolve)


def token_ids(text: Column | str, path: str, pattern: str, end_id: int, added: bool = False) -> Column:
    """Ids of each text and the end id: little-endian uint16 or zstandard-compressed uint32, behind a byte that says which.

    With ``added``, the vocabulary file's added tokens are found in texts and get
    their one id, as in the library's ``encode``; else they are text like any other.
    """

    small_batches(BLOCK_ROWS)

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        end = np.array([end_id], dtype="<u4")
        encoded = _encoded(["" if t is None else t for t in texts], path, pattern, added)
        return pd.Series([_narrow(np.concatenate([x, end])) for x in encoded], dtype=object)

    return ids(text)


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as uint16 where all fit (marked by the first byte), which zstandard makes hardly smaller; else as uint32, compressed."""
    if ids.max(initial=0) < 1 << 16:
        return b"\x02" + ids.astype("<u2").tobytes()
    return b"\x04" + zstandard.ZstdCompressor(level=1).compress(ids.tobytes())


def unpack_ids(packed: bytes) -> np.ndarray:
    if packed[0] == 2:
        return np.frombuffer(packed, dtype="<u2", offset=1).astype("<u4")
    return np.frombuffer(zstandard.decompress(packed[1:]), dtype="<u4")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, dtype=np.int64)
    for batch in batches:
        packed = batch.column(0).to_pylist()
        short = np.frombuffer(b"".join([p[1:] for p in packed if p[0] == 2]), dtype="<u2")
        for ids in (short, *[unpack_ids(p) for p in packed if p[0] != 2]):
            n = np.bincount(ids, minlength=len(total))
            if len(n) > len(total):
                total = np.pad(total, (0, len(n) - len(total)))
            total += n
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])


def write(
    docs: DataFrame, path: str, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
    added: bool = False,
) -> None:
    """Tokenise ``docs`` (vocabulary file ``tokenizer``, pre-token expression ``pattern``) and write the dataset at ``path``.

    ``added``: see ``token_ids``.
    """
    ids = store(docs.select(F.col(id_col).alias("doc_id"), token_ids(text_col, tokenizer, pattern, end_id, added).alias("ids")), "ids")
    counts = ids.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    table = Frequencies.scale(counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))
    spark = docs.sparkSession
    rows = pd.DataFrame({"id": table.ids.astype(np.int64), "frequency": table.scaled.astype(np.int64)})
    spark.createDataFrame(rows, "id long, frequency long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((table.ids, table.scaled))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequencies = None
        held: list[tuple[int | None, np.ndarray]] = []
        size = before = block = part = 0

        def closed() -> pa.RecordBatch:
            values = {"part": part, "block": block, "before": before, "n_ids": size, "payload": encode_block(held, frequencies)}
            return pa.RecordBatch.from_pylist([values], schema=BLOCK)

        for batch in batches:
            frequencies = frequencies or Frequencies(*(x.astype(np.int64) for x in shared.value))
            for part, doc_id, packed in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((doc_id, unpack_ids(packed)))
                size += len(held[-1][1])
                if size >= BLOCK_IDS:
                    yield closed()
                    held, before, block, size = [], before + size, block + 1, 0
        if held:
            yield closed()

    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    blocks = ordered.mapInArrow(encode, "part int, block int, before long, n_ids long, payload binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


BLOCK = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]
)
ROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), ids (little-endian uint32 bytes)."""
    rows = spark.read.schema("id long, frequency long").parquet(f"{path}/table").toPandas().sort_values("id")
    shared = spark.sparkContext.broadcast((rows["id"].to_numpy(np.int64), rows["frequency"].to_numpy(np.int64)))
    blocks = spark.read.schema("part int, block int, before long, n_ids long, payload binary").parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a range of ids
    earlier = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = store(parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "ids")
    placed = blocks.join(parts, "part").select((F.col("base") + F.col("before")).alias("start"), "payload")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequencies = None
        for batch in batches:
            frequencies = frequencies or Frequencies(*shared.value)
            for start, payload in zip(*(c.to_pylist() for c in batch.columns)):
                keys, sizes, ids = decode_block(payload, frequencies)
                ends = np.cumsum(sizes, dtype=np.int64)
                begins = ends - sizes
                raw = [ids[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(start + begins, pa.int64()), pa.array(raw, pa.binary())], schema=ROW
                )

    return placed.mapInArrow(decode, "doc_id long, start long, ids binary")
