"""Byte-level BPE against the tiktoken library; perfect hash; round trip."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import bpe as B
from tallyspark.llm import pieces

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})
HARD = ["", " ", "  ", "a  b", "a   b", " a", "a ", "a \n", "a\n ", "a\n \nb", "a \n\n b", "\t\t x", "x   y", "\u0085 z",
        "\x1c \x1d", "it's we'll I'D 'tis", "<|endoftext|> x", "ththbleand", "日本語 テキスト 漢字", "🙂🙂 👩‍👩‍👧", "é" * 3000,
        "x" * 20000, "12345 67 890", "a.b,c;d!?", "word " * 3000, "    ", "a\r\n\r\n b", "퟿"]


def same(texts):
    got = [x.tolist() for x in B.codec(PATH, PATTERN).encode(texts)]
    assert got == [REFERENCE.encode_ordinary(t) for t in texts]
    assert list(B.codec(PATH, PATTERN).decode([np.array(x, dtype=int) for x in got])) == [t.encode() for t in texts]


def test_hard_texts():
    same(HARD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'sabtheé1٣.!  "), st.characters(codec="utf-8")), max_size=40), max_size=6))
def test_any_text(texts):
    same(texts)


def test_heaps_of_rows_merge_like_one_heap():
    codec, rng = B.codec(PATH, PATTERN), np.random.default_rng(3)
    letters = np.frombuffer(b"  aeinorstthebl\xc3\xa9\xe6\x97\x00\xff", dtype=np.uint8)
    for width in B.WIDTHS:
        tokens = [bytes(rng.choice(letters, n)) for n in rng.integers(1, width + 1, 3000)]
        tokens += [b"a" * n for n in range(1, width + 1)] + [tokens[0]] * 3
        rows = B.HeapRows(tokens, width, np.array(codec.byte_rank), codec.first, codec.pairs)
        assert rows.merged() == [codec.merge(t) for t in tokens]


def test_ranks_of_pairs():
    codec = B.codec(PATH, PATTERN)
    of = {rank: token for token, rank in codec.ranks.items()}
    left, right = np.random.default_rng(4).integers(0, len(of), (2, 20000))
    left, right = left % 3000, np.where(np.arange(20000) % 2, right, right % 300)
    want = [codec.ranks.get(of[a] + of[b], B.PairRanks.NONE) for a, b in zip(left.tolist(), right.tolist())]
    assert codec.pairs.get(left, right).tolist() == want and min(want) < B.PairRanks.NONE


def test_vocabulary_without_all_bytes():
    ranks = {b"a": 0, b"b": 1, b"ab": 2, b"abab": 3, b" ": 4, b" ab": 5}
    codec = B.Codec(ranks, PATTERN)
    assert [x.tolist() for x in codec.encode(["ababab", "ab abab", ""])] == [[3, 2], [2, 4, 3], []]


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**63, 20000).astype(np.uint64))
    h = B.PerfectHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert B.PerfectHash(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


def test_forgetting_changes_nothing():
    small = B.Codec(B.read_ranks(PATH), PATTERN)
    small.memory.others.limit = 6
    texts = [f"w{i % 40} x{i} y{i % 7}, " + "z" * (i % 90) for i in range(900)]
    got = [x.tolist() for at in range(0, 900, 50) for x in small.encode(texts[at : at + 50], 6)]
    assert got == [REFERENCE.encode_ordinary(t) for t in texts]
    assert len(small.memory.words.old) + len(small.memory.words.young) < 400


def test_a_worker_holds_the_words_of_a_block_not_of_a_batch():
    words, chars = 200, 2000
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) + " ö." for i in range(500)]  # 10,000 words, none twice
    small = B.Codec(B.read_ranks(PATH), PATTERN)
    got, most = [], 0
    for ids in small.encode(texts, words, chars):
        got.append(ids.tolist())
        memory = small.memory
        most = max(most, *(len(m.young) + len(m.old) for m in (memory.words, memory.composites)))
    assert got == [REFERENCE.encode_ordinary(t) for t in texts]
    assert most < 2 * words + chars // 4


def test_columns(spark):
    rows = [(1, "the cat"), (2, None), (3, ""), (3, ""), (None, "ththble é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumn("ids", B.encode("text", PATH, PATTERN))
    df = df.withColumn("raw", B.decode("ids", PATH, PATTERN))
    for r in df.collect():
        assert list(r.ids) == REFERENCE.encode_ordinary(r.text or "") and bytes(r.raw) == (r.text or "").encode()
    assert df.limit(0).count() == 0


def test_pieces_of_a_block_are_cut_together():
    """One call of the expression cuts all pieces that begin with their only space; the ids are those of each piece alone."""
    words = ["it.", "a\nB", "x'll", "12.5", "é!", "ö\u0085", " b", "\x1cq", "z\x1f", "'s", "***", "", "\n", "日本。"]
    texts = [" ".join(words[i:] + words[:i]) for i in range(len(words))] + ["  a  b ", " ", "", "one", "a\n \nb.", "end. \n"]
    codec, calls = B.Codec(B.read_ranks(PATH), PATTERN), []
    cut = codec.memory.cut
    codec.memory.cut = lambda text: calls.append(text) or cut(text)
    got = [x.tolist() for x in codec.encode(texts)]
    for text, ids in zip(texts, got):
        assert ids == [i for t in cut(text) for i in np.frombuffer(codec.resolve([t])[0], "<i4").tolist()]
    calls.clear()
    many = " ".join(f"w{i}." for i in range(500))
    (ids,) = codec.encode([many])
    assert ids.tolist() == [i for t in cut(many) for i in np.frombuffer(codec.resolve([t])[0], "<i4").tolist()]
    assert len(calls) < 5


def test_pieces_are_cut_before_every_space():
    texts = ["", " ", "a b", "  two  spaces ", "é ü\n x", "", "Wort", " end "]
    cut, bounds = pieces.cut_before_spaces(texts)
    found = [cut.to_pylist()[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
    assert found == [[t.split(" ")[0], *[" " + p for p in t.split(" ")[1:]]] for t in texts]


def test_known_pieces_are_looked_up_once():
    class Counting(dict):
        asked = 0

        def get(self, key, default=None):
            Counting.asked += 1
            return super().get(key, default)

        def __contains__(self, key):
            Counting.asked += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            Counting.asked += 1
            return super().__getitem__(key)

    memory = pieces.PieceMemory(str.split, lambda words: [str(len(w)).zfill(4).encode() for w in words])
    text = "a " + " ".join(f"word{'x' * i}" for i in range(50))
    first = [x.tolist() for x in memory.encode([text])]
    memory.words.young = Counting(memory.words.young)
    assert [x.tolist() for x in memory.encode([text])] == first
    assert Counting.asked == 50
