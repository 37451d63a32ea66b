"""Secret scanning with a trigram inverted index.

Each rule's regular expression yields a Boolean query over trigrams that every
match must contain.  A task indexes its batch of texts: for each trigram named by
some query, the posting list of the texts that hold it (lower-cased).  The query
of a rule intersects and unites posting lists; only its candidates are searched
with the rule's expression.  A rule whose query is empty (no mandatory trigram)
searches every text.  The index is cut by batch, as search engines cut theirs by
segment: no text is shuffled, memory is that of one batch, and a lost task rebuilds
its own segment only.

A span is (kind, begin, end) in code points, end exclusive.  Per kind, matches
are leftmost and non-overlapping; those that fail the rule's length test go.

Defined results: a null text is an empty one and has no span; repeated rows come
back repeated; empty tables give empty results; other columns come back unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from re import _constants as K  # the parsed form of an expression
from re import _parser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unused

MAX_EXACT = 32  # strings that a part of an expression may stand for before they become a query

SPAN = "array<struct<kind:string,begin:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``least`` code points are needed in ``group`` of a match (0: the whole match)."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False
    compiled: re.Pattern = field(init=False, compare=False, default=None)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.pattern))

    def spans(self, text: str) -> Iterator[tuple[str, int, int]]:
        for m in self.compiled.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield self.kind, m.start(), m.end()


RULES = (
    Rule(
        "assign",
        r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=12,
        group=2,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18, base=True),
    # maximal runs of 16 or more: the same spans as all runs of one or more, less the short ones
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosting_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)

# A query is None (every text), a trigram (bytes), ("and", queries) or ("or", queries).


def _all(parts: list):
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return parts[0] if len(parts) == 1 else ("and", tuple(parts)) if parts else None


def _any(parts: list):
    parts = list(dict.fromkeys(parts))
    return None if not parts or None in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_string(s: str):
    """Query of a literal part: its trigrams, in bytes of the lower-cased text."""
    b = s.encode().lower()
    return _all([b[i : i + 3] for i in range(len(b) - 2)])


def _flush(exact: set[str] | None):
    return _any([_of_string(s) for s in sorted(exact)]) if exact else None


def _walk(tree) -> tuple[set[str] | None, object]:
    """(strings the part stands for if few, else None; query that holds besides)."""
    exact, queries, whole = {""}, [], True

    def take(strings: set[str] | None) -> None:
        nonlocal exact, whole
        joined = {a + b for a in exact for b in strings} if strings is not None else None
        if joined is None or len(joined) > MAX_EXACT:
            queries.append(_flush(exact))
            joined = strings if strings is not None and len(strings) <= MAX_EXACT else {""}
            whole = False
        exact = joined

    for op, value in tree:
        if op is K.LITERAL:
            take({chr(value)})
        elif op is K.IN and value[0][0] is not K.NEGATE and (few := _class(value)) is not None:
            take(few)
        elif op is K.SUBPATTERN:
            inner, query = _walk(value[-1])
            queries.append(query)
            take(inner)
        elif op is K.BRANCH:
            parts = [_walk(x) for x in value[1]]
            if all(e is not None for e, _ in parts) and len(union := set().union(*(e for e, _ in parts))) <= MAX_EXACT:
                queries.append(_any([q for _, q in parts]))
                take(union)
            else:
                queries.append(_any([_all([q, _flush(e)]) for e, q in parts]))
                take(None)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] == 0 and value[1] == 1 and (e := _walk(value[2]))[0] is not None:
            take(e[0] | {""})
        else:
            if op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] >= 1:
                inner, query = _walk(value[2])
                queries += [query, _flush(inner)]
            take(None)
    return (exact, _all(queries)) if whole else (None, _all([*queries, _flush(exact)]))


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is K.LITERAL:
            out.add(chr(value))
        elif op is K.RANGE and value[1] - value[0] < MAX_EXACT:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MAX_EXACT else None


def trigram_query(pattern: str):
    """Boolean query over lower-cased trigrams that any text with a match satisfies."""
    exact, query = _walk(_parser.parse(pattern))
    return _all([query, _flush(exact) if exact is not None else None])


def _named(query) -> set[bytes]:
    return set() if query is None else {query} if isinstance(query, bytes) else set().union(*map(_named, query[1]))


class Segment:
    """Posting lists of one batch of texts for the trigrams that the queries name."""

    def __init__(self, texts: list[str], trigrams: set[bytes]):
        self.size = len(texts)
        wanted = np.zeros(1 << 24, dtype=bool)
        for t in trigrams:
            wanted[int.from_bytes(t, "big")] = True
        self.postings: dict[bytes, np.ndarray] = {}
        found: dict[int, list[int]] = {}
        for row, text in enumerate(texts):
            b = np.frombuffer(text.encode("utf-8", "replace").lower(), dtype=np.uint8)
            for at in range(0, max(len(b) - 2, 0), 1 << 20):
                part = b[at : at + (1 << 20) + 2].astype(np.uint32)
                codes = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
                for code in np.unique(codes[wanted[codes]]).tolist():
                    rows = found.setdefault(code, [])
                    if not rows or rows[-1] != row:
                        rows.append(row)
        for code, rows in found.items():
            self.postings[code.to_bytes(3, "big")] = np.array(rows)

    def rows(self, query) -> np.ndarray:
        """Candidates of a query, ascending."""
        if query is None:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.postings.get(query, np.array([], dtype=int))
        lists = sorted((self.rows(q) for q in query[1]), key=len)
        out = lists[0]
        for other in lists[1:]:
            out = np.intersect1d(out, other, True) if query[0] == "and" else np.union1d(out, other)
        return out


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of ``rules`` in ``text``, by begin, then as the rules are listed."""
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = set().union(*map(_named, queries))

    small_batches()

    @F.pandas_udf(SPAN)
    def scan(texts: pd.Series) -> pd.Series:
        texts = ["" if t is None else t for t in texts]
        segment = Segment(texts, trigrams)
        out: list[list] = [[] for _ in texts]
        for nth, (rule, query) in enumerate(zip(rules, queries)):
            for row in segment.rows(query).tolist():
                out[row] += [(b, nth, e) for _, b, e in rule.spans(texts[row])]
        return pd.Series([[{"kind": rules[n].kind, "begin": b, "end": e} for b, n, e in sorted(x)] for x in out])

    return scan(text)


def spans_text(spans: Column) -> Column:
    """kind:begin:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span (overlapping ones merged) replaced by ``mark``; texts without one are unchanged."""
    text, spans = F.col(text_col), find_spans(F.col(text_col), rules)

    def cut(found: Column) -> Column:
        start = F.struct(F.lit(1).alias("next"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            fresh = s["begin"] + 1 >= acc["next"]
            between = F.substring(text, acc["next"], s["begin"] + 1 - acc["next"])
            out = F.when(fresh, F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["next"], s["end"] + 1).alias("next"), out.alias("out"))

        tail = lambda acc: F.concat(acc["out"], F.substring(text, acc["next"], F.length(text)))
        return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, start, step, tail))

    name = unused("_spans", docs.columns)
    cleaned = docs.withColumn(name, spans).withColumn(text_col, F.when(text.isNotNull(), cut(F.col(name))))
    return cleaned.select(*docs.columns)
