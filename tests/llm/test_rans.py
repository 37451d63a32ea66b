"""rANS dataset: exact round trip against the tokenizers library, checkpoints, damage."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import rans as R
from tallyspark.llm.common import DOCUMENTS
from tallyspark.llm.queries import QUERIES
from tallyspark.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("n", [0, 1, 5, R.LANES, R.LANES + 1, R.LANES * R.CHECKPOINT_STEPS * 3 + 17])
def test_block_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 70000).astype("<u4")
    seen, counts = np.unique(ids, return_counts=True)
    table = R.Frequencies.scale(seen.astype(np.int64), counts)
    docs = [(None, ids[: n // 3]), (-4, ids[n // 3 : n // 2]), (2**62, ids[n // 2 :])]
    raw = R.encode_block(docs, table)
    keys, sizes, got = R.decode_block(raw, table)
    assert keys == [None, -4, 2**62] and sizes.tolist() == [len(x) for _, x in docs] and np.array_equal(got, ids)
    for mark in range(1, R.HEADER.unpack_from(raw)[6] + 1):
        at = mark * R.CHECKPOINT_STEPS * R.LANES
        assert np.array_equal(R.decode_block(raw, table, mark)[2], ids[at:])
    with pytest.raises(R.Damaged):
        R.decode_block(raw[:40] + bytes([raw[40] ^ 1]) + raw[41:], table)
    if n:
        other = R.Frequencies.scale(np.array([1, 2, 9]), np.array([5, 5, 1]))
        with pytest.raises(R.Damaged):
            R.decode_block(raw, other)


def test_compression_is_near_the_entropy():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.zipf(1.3, 400_000), 50000).astype("<u4")
    seen, counts = np.unique(ids, return_counts=True)
    p = counts / counts.sum()
    raw = R.encode_block([(1, ids)], R.Frequencies.scale(seen.astype(np.int64), counts))
    assert len(raw) < 1.05 * len(ids) * -(p * np.log2(p)).sum() / 8 + 60_000


@pytest.mark.parametrize("block", [40, R.BLOCK_IDS])
def test_dataset_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK_IDS", block)
    texts = ["the cat sat", None, "", "a  b", "a\n \nb", "word " * 900, "<|endoftext|> é 日本", "x" * 5000, "thbleth and 12", "Ñandú größe, été\u0085 ȷ ɐɐ ªº", "\x00\x7f\xad ¡" + chr(0x10FFFF)]
    rows = [(1000 - i, texts[i % len(texts)] if i % 4 else f"row {i}") for i in range(120)] + [(None, "lost"), (7, "tie b"), (7, "tie a")]
    path = scratch_path(spark, f"rans-{uuid.uuid4().hex[:6]}")
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    R.write(df, path, PATH, public_tokenizers.PATTERN)
    got = sorted(R.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    want = {d: library_ids(t) for d, t in rows if d != 7}
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert r.start == at and (r.doc_id == 7 or ids == want[r.doc_id])
        at += len(ids)
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in got if r.doc_id == 7) == sorted(map(library_ids, ["tie a", "tie b"]))


def test_added_tokens_are_those_of_a_plain_encode(spark, tmp_path):
    plain = Tokenizer.from_file(PATH)
    end = "<|endoftext|>"
    texts = [end, f"a{end}b", f"the end {end} \n{end}{end} of it", f"{end[:-1]}  {end}x ", "none", f" {end}\n", None, ""]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    at = 0
    for r in sorted(QUERIES["op10_rans_output"](spark, str(tmp_path)).collect(), key=lambda r: r.doc_id):
        ids = plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_flags_of_added_tokens(tmp_path):
    from tokenizers import AddedToken

    t = Tokenizer.from_file(PATH)
    t.add_tokens([AddedToken("zq", single_word=True, normalized=True), AddedToken("<l>", lstrip=True, normalized=False)])
    t.add_special_tokens([AddedToken("<l><r>", rstrip=True, normalized=False)])
    path = str(tmp_path / "t.json")
    t.save(path)
    texts = ["a  <l> b", "a  <l><r>  b", "zq zqx xzq (zq)", "<r><l><r>", "no", "zq<l>zq"]
    got = [x.tolist() for x in R._encoded(texts, path, public_tokenizers.PATTERN, True)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_empty_dataset(spark):
    path = scratch_path(spark, "rans-empty")
    R.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH, public_tokenizers.PATTERN)
    assert R.read(spark, path).count() == 0


@pytest.mark.parametrize("ids", [[], [0, 65535, 2], [0, 65536, 2], [2**32 - 1]])
def test_packed_ids(ids):
    assert R.unpack_ids(R._narrow(np.array(ids, dtype="<u4"))).tolist() == ids
