"""Cutting texts at spaces so that pieces can be tokenised one by one and their words remembered.

The byte-level pre-token expression joins a space to the word after it and never
joins it to a word before it, so a text may be cut before a space.  Where a space
has white space or an end of the text on both sides, the cut could split a run of
white space that the expression keeps together; such a text is tokenised whole.

The memory is a bounded cache: it never changes a result.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import compress, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 700_000  # pre-tokens with a space before them that are remembered, at most
OTHERS = 50_000  # other pre-tokens
COMPOSITES = 400_000  # pieces of several pre-tokens
LONG = 64  # characters; longer pre-tokens are not remembered
BLOCK_CHARS = 12_000_000  # of the texts whose pieces are numbered together
BLOCK_ROWS = 3000  # texts of an Arrow batch
PIECES_AT_ONCE = 1 << 14  # pieces whose pre-tokens are held at the same time
TEXTS_AT_ONCE = 500  # texts whose ids are put together at once
WORD = f"^ [{''.join(c for c in map(chr, range(0x250)) if c.isalpha())}]+$"  # a space and only Latin letters: one pre-token


class Remembered:
    """What was learned of at most ``limit`` keys, besides those of the request at hand.

    Two generations: keys in use move to the young one; when it holds half the
    limit it becomes the old one and what only the former old one held is
    forgotten.
    """

    def __init__(self, learn: Callable[[list[str]], Iterable], limit: int):
        self.learn, self.limit = learn, limit
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.long: list[str] = []

    def start(self) -> dict[str, object]:
        """The dict that answers the next request; what it lacks is got by ``fill``."""
        for key in self.long:
            del self.young[key]
        self.long = []
        if len(self.young) > self.limit // 2:
            self.young, self.old = {}, self.young
        return self.young

    def fill(self, keys: Iterable[str]) -> dict[str, object]:
        """The same dict, with every one of ``keys``, until the next start."""
        young = self.young
        return self._add(list(dict.fromkeys([key for key in keys if key not in young])))

    def of(self, keys: list[str]) -> list:
        """What was or is now learned of each of ``keys``, which are distinct and looked up once if they are known."""
        found = list(map(self.young.get, keys))
        young = self._add([key for key, known in zip(keys, found) if known is None])
        return [young[key] if known is None else known for key, known in zip(keys, found)]

    def _add(self, missing: list[str]) -> dict[str, object]:
        young, fresh = self.young, missing
        with collector_paused():
            if self.old:
                kept = list(map(self.old.pop, missing, repeat(None)))
                young.update((key, known) for key, known in zip(missing, kept) if known is not None)
                fresh = [key for key, known in zip(missing, kept) if known is None]
            self.long += [key for key in fresh if len(key) > LONG]
            young.update(zip(fresh, self.learn(fresh)))
        return young


@contextmanager
def collector_paused() -> Iterator[None]:
    """Without looking for cycles: very many small objects are made here, and none refers back."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist


def sizes_and_starts(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of ids as bytes, put one after another: how many each has, and where they begin."""
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    return sizes, np.cumsum(sizes) - sizes


def places(starts: np.ndarray, n: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of stretches of ``n`` ids from ``starts`` on; ``ends`` are the running sums of ``n``."""
    at = np.repeat(starts - (ends - n), n)
    at += np.arange(len(at))
    return at


def cut_before_spaces(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, and where each text's begin; all but a text's first piece begin with their only space.

    The pieces are the texts' own bytes, cut at other places.
    """
    whole = pa.array(texts, pa.large_string())
    _, ends, data = whole.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[: len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[: ends[-1]] if data else np.zeros(0, dtype=np.uint8)
    spaces = np.flatnonzero(raw == ord(" "))
    bounds = np.arange(len(ends)) + np.searchsorted(spaces, ends)
    later = np.ones(bounds[-1], dtype=bool)
    later[bounds[:-1]] = False
    cuts = np.empty(len(later) + 1, dtype=np.int64)
    cuts[bounds] = ends
    cuts[:-1][later] = spaces
    return pa.LargeStringArray.from_buffers(len(later), pa.py_buffer(cuts), data), bounds


class PieceMemory:
    """Encodes texts piece by piece, remembering the ids of pre-tokens.

    ``cut`` gives the pre-tokens of a piece; ``resolve`` gives the ids, as bytes, of
    each of a list of pre-tokens.
    """

    def __init__(self, cut: Callable[[str], list[str]], resolve: Callable[[list[str]], list[bytes]]):
        self.cut = cut
        self.words = Remembered(resolve, WORDS)  # with the space before them
        self.others = Remembered(resolve, OTHERS)
        self.composites = Remembered(self.learned, COMPOSITES)  # pieces of several pre-tokens
        self.chars = BLOCK_CHARS

    def limited(self, words: int, chars: int = BLOCK_CHARS) -> PieceMemory:
        """The same memory, for at most ``words`` words (and composites in proportion) besides those of a block.

        A block ends with the text that reaches ``chars`` characters, however many texts are asked for at once.
        """
        self.words.limit, self.composites.limit, self.chars = words, COMPOSITES * words // WORDS, chars
        return self

    def learned(self, pieces: list[str]) -> list[bytes]:
        starts = range(0, len(pieces), PIECES_AT_ONCE)
        return [ids for at in starts for ids in self.put_together(pieces[at : at + PIECES_AT_ONCE])]

    def put_together(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, each of its pre-tokens looked up once.

        Pieces that begin with their only space, with no other white space at either end, are
        cut in one go: put one after another, they may be cut before each space again, and there only.
        """
        safe = [p.rfind(" ") == 0 and not p[1:2].isspace() and not p[-1].isspace() for p in pieces]
        tokens = self.cut("".join(compress(pieces, safe)))
        begins = [i for i, t in enumerate(tokens) if t[0] == " "]
        if len(begins) != sum(safe):
            safe, tokens, begins = [False] * len(pieces), [], []
        for piece, joined in zip(pieces, safe):
            if not joined:
                begins.append(len(tokens))
                tokens += self.cut(piece)
        if not tokens:
            return [b""] * len(pieces)
        numbered = pa.array(tokens, pa.large_string()).dictionary_encode()
        distinct, number = listed(numbered.dictionary), numbered.indices.to_numpy()
        spaced = [t[0] == " " and len(t) > 1 for t in distinct]
        words = self.words.fill([t for t, s in zip(distinct, spaced) if s])
        others = self.others.fill([t for t, s in zip(distinct, spaced) if not s])
        ids = [words[t] if s else others[t] for t, s in zip(distinct, spaced)]
        sizes, starts = sizes_and_starts(ids)
        n = sizes[number]
        ends = np.cumsum(n)
        found = np.frombuffer(b"".join(ids), dtype="<i4")[places(starts[number], n, ends)].tobytes()
        cuts = 4 * np.append(0, ends)[[*begins, len(tokens)]]
        each = [found[a:b] for a, b in pairwise(cuts.tolist())]
        joined, single = iter(each[: sum(safe)]), iter(each[sum(safe) :])
        return [next(joined if s else single) for s in safe]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids (int32) of each text."""
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= self.chars:
                yield from self._block(block)
                block, size = [], 0
        if block:
            yield from self._block(block)

    def _block(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each distinct piece of the block is looked up once; Arrow numbers the pieces."""
        cut, bounds = cut_before_spaces(texts)
        numbered = cut.dictionary_encode()
        number, pieces = numbered.indices.to_numpy(), listed(numbered.dictionary)
        # a space between two pieces is unsafe if white space (or another space) stands on both its sides
        simple = pc.match_substring_regex(numbered.dictionary, WORD).to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(~simple)  # the others; a word has white space at neither end
        odd_pieces = [pieces[i] for i in odd.tolist()]
        opens, closes = np.zeros(len(pieces), dtype=bool), np.zeros(len(pieces), dtype=bool)
        opens[odd] = [p == " " or p[1:2].isspace() for p in odd_pieces]
        closes[odd] = [not p or p[-1].isspace() for p in odd_pieces]
        unsafe = np.flatnonzero(closes[number[:-1]] & opens[number[1:]])
        of_text = np.searchsorted(bounds, unsafe, "right") - 1
        whole = set(of_text[unsafe + 1 < bounds[of_text + 1]].tolist())

        for memory in (self.words, self.others, self.composites):
            memory.start()
        ids = self.words.of(list(compress(pieces, simple.tolist())))
        place = np.cumsum(simple) - 1  # the words' ids come first, then those of the other pieces
        place[odd] = np.arange(len(ids), len(pieces))
        number = place[number]
        ids += self.composites.of(odd_pieces)
        sizes, starts = sizes_and_starts(ids)
        flat = np.frombuffer(b"".join(ids), dtype="<i4")
        for begin in range(0, len(texts), TEXTS_AT_ONCE):
            edges = bounds[begin : begin + TEXTS_AT_ONCE + 1]
            own = number[edges[0] : edges[-1]]
            n = sizes[own]
            ends = np.cumsum(n)
            found = flat[places(starts[own], n, ends)]
            cuts = np.concatenate([[0], ends])[edges - edges[0]]
            for i, text in enumerate(texts[begin : begin + TEXTS_AT_ONCE]):
                yield np.frombuffer(self.put_together([text])[0], dtype="<i4") if begin + i in whole else found[cuts[i] : cuts[i + 1]]
