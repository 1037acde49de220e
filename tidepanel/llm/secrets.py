"""Secret scans through a trigram index.

Each rule's regex is turned into a Boolean query over trigrams that every match must contain. The texts of a task are
indexed segment by segment: for the trigrams that any rule asks for, a posting bitmap over the segment's texts. The
queries intersect and unite postings, and only candidate texts meet the regex. Rules without mandatory trigrams
(the hex runs) scan every text. Segments never leave their task, so there is no shuffle and nothing grows with a key.
"""
from __future__ import annotations

import functools
import re
import re._constants as K
import re._parser as P
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepanel.llm.common import flat, id_text, sha, steps


@dataclass(frozen=True)
class Rule:
    """``group``/``least``: matches whose group is shorter are dropped after matching. ``base``: counted and hashed."""
    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    base: bool = False


#: The kinds that are counted, then further well-known credential formats.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

#: A Boolean query: True (any text), ("and"|"or", parts), or a trigram as bytes.
Query = object
#: Sets of exact strings up to this size are kept while a regex is read.
WIDE = 64


def _all(parts: list) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """One of the strings occurs: all trigrams of one of them."""
    if min(map(len, strings)) < 3:
        return True
    return _any([_all([b[i:i + 3] for i in range(len(b) - 2)]) for b in sorted(s.lower().encode() for s in strings)])


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """Trigrams (of the lower-cased text) that any match implies; True if the regex implies none.

    Walks the parsed regex and keeps, as long as it is small, the exact set of strings a run of items can be; where
    the set ends (a wide class, an open repeat) its trigrams join the conjunction.
    """
    def one(item) -> tuple[set[str] | None, Query]:
        op, arg = item
        if op is K.LITERAL:
            return {chr(arg)}, True
        if op is K.IN:
            chars = set()
            for kind, x in arg:
                if kind is K.LITERAL:
                    chars.add(chr(x))
                elif kind is K.RANGE and x[1] - x[0] < 8:
                    chars |= {chr(c) for c in range(x[0], x[1] + 1)}
                else:
                    return None, True
            return (chars, True) if len(chars) <= 8 else (None, True)
        if op is K.SUBPATTERN:
            return whole(arg[3])
        if op is K.BRANCH:
            parts = [whole(x) for x in arg[1]]
            if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= WIDE:
                return set().union(*(e for e, _ in parts)), True
            return None, _any([_all([q, True if e is None else _of_strings(e)]) for e, q in parts])
        if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            low, high, body = arg
            exact, need = whole(body)
            if exact is not None and low == 0 and high == 1 and len(exact) < WIDE:
                return exact | {""}, True
            if exact is not None and low == high == 1:
                return exact, need
            return None, (_all([need, True if exact is None else _of_strings(exact)]) if low else True)
        if op is K.AT:
            return {""}, True
        return None, True

    def whole(items) -> tuple[set[str] | None, Query]:
        items = list(items)
        needs, run, exact_all = [], {""}, True
        for item in items:
            exact, need = one(item)
            if need is not True:
                needs.append(need)
            if exact is None or len(run) * len(exact) > WIDE:
                needs.append(_of_strings(run))
                run, exact_all = (set(exact) if exact is not None else {""}), False
            else:
                run = {a + b for a in run for b in exact}
        if exact_all:
            return run, _all(needs)
        return None, _all([*needs, _of_strings(run)])

    exact, need = whole(P.parse(pattern, flags))
    return _all([need, _of_strings(exact)]) if exact is not None else need


def trigrams(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


class Segment:
    """Posting bitmaps of one step of texts for the trigrams that the queries name."""

    def __init__(self, data: np.ndarray, at: np.ndarray, wanted: list[bytes], table: np.ndarray):
        self.n, self.row = len(at) - 1, {t: i for i, t in enumerate(wanted)}
        self.postings = np.zeros((len(wanted), self.n), bool)
        if len(data) >= 3:
            low = _LOWER[data]
            which = table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
            pos = np.flatnonzero(which)
            text = np.searchsorted(at, pos, "right") - 1
            inside = pos + 3 <= at[text + 1]
            self.postings[which[pos[inside]].astype(np.int64) - 1, text[inside]] = True

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.ones(self.n, bool)
        if isinstance(query, bytes):
            return self.postings[self.row[query]]
        parts = [self.candidates(p) for p in query[1]]
        return functools.reduce(np.logical_and if query[0] == "and" else np.logical_or, parts)


@functools.lru_cache(4)
def compiled(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    wanted = sorted(set().union(*map(trigrams, queries)))
    table = np.zeros(1 << 24, np.uint16)
    for i, t in enumerate(wanted):
        table[(t[0] << 16) | (t[1] << 8) | t[2]] = i + 1
    # shorter runs can be skipped at once where the whole match is one repeated class: same spans after the length rule
    return [re.compile(r.pattern[:-1] + f"{{{r.least},}}" if re.fullmatch(r"\[[^\]]+\]\+", r.pattern) and not r.group and r.least else r.pattern, r.flags)
            for r in rules], queries, wanted, table


def spans_of(batch: pa.RecordBatch, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """Per text the spans (start, rule number, end) in code points, ordered."""
    patterns, queries, wanted, table = compiled(rules)
    segment = Segment(*flat(batch.column("text")), wanted, table)
    texts: dict[int, str] = {}
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
    column = batch.column("text")
    for k, rule in enumerate(rules):
        for i in np.flatnonzero(segment.candidates(queries[k])).tolist():
            if i not in texts:
                texts[i] = column[i].as_py() or ""
            out[i] += [(m.start(), k, m.end()) for m in patterns[k].finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    for spans in out:
        spans.sort()
    return out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row; code points, end exclusive.

    Null and empty texts have no spans; repeated rows are scanned each for itself; overlapping spans of different
    kinds are all kept, ordered by start, then rule, then end.
    """
    kinds = [r.kind for r in rules]
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            found = [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in x] for x in spans_of(part, rules)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(item))], ["doc_id", "spans"])

    return id_text(docs).mapInArrow(run, "doc_id long, spans array<struct<kind string, start int, end int>>")


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans as text; same cases as :func:`scan`."""
    base = [k for k, r in enumerate(rules) if r.base]
    names = [f"n_{rules[k].kind}" for k in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            found = spans_of(part, rules)
            word = lambda x: f"{rules[x[1]].kind}:{x[0]}:{x[2]}"
            counts = [pa.array([sum(x[1] == k for x in f) for f in found], pa.int64()) for k in base]
            hashes = pa.array([sha(",".join(word(x) for x in f if rules[x[1]].base).encode()) for f in found])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, hashes, pa.array([",".join(map(word, f)) for f in found])],
                                             ["doc_id", *names, "base_sha256", "spans"])

    return id_text(docs).mapInArrow(run, f"doc_id long, {''.join(n + ' long, ' for n in names)}base_sha256 string, spans string")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """The same columns with every secret replaced by ``mask`` and ``n_chars`` brought in line; null texts stay null."""
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            clean = []
            for text, spans in zip(part.column("text").to_pylist(), spans_of(part, rules), strict=True):
                out, done = [], 0
                for start, _, end in spans:
                    if start >= done:
                        out += [text[done:start], mask]
                    done = max(done, end)
                clean.append(text if not spans else "".join(out) + text[done:])
            columns = part.columns
            columns[text_at] = pa.array(clean, pa.string())
            if "n_chars" in part.schema.names:
                at = part.schema.names.index("n_chars")
                columns[at] = pa.array([None if t is None else len(t) for t in clean], pa.int64()).cast(columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, docs.schema)
