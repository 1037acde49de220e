"""Byte-level BPE by prefix dynamic programming.

Merging the adjacent pair of lowest rank, leftmost first, until none is left gives every byte string exactly one
encoding. Two facts make it computable from left to right:

* a token sequence is that encoding if and only if every two neighbours in it are the encoding of their joint
  bytes (a merge across one border would also happen with only those two tokens present), so
* the encoding of a prefix without its last token is the encoding of the shorter prefix.

For each byte prefix it is therefore enough to store its one valid last token: a token that ends there, and that
stands its ground beside the last token of the prefix it leaves. Appending bytes extends the array; an edit keeps
the entries before it, and the entries behind it as soon as a full token length of them agrees again.
"""
from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidepanel.llm.common import id_text, steps, without_gc

#: Entries of each generation of the chunk caches of a worker.
CACHE = 400_000


class PrefixBpe:
    """Encoder for one table of ranks. ``last`` arrays hold, at i, the last token of the first i bytes (0: unused)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.matches = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.matches.add_word(token.decode("latin-1"), (len(token), i))
        self.matches.make_automaton()
        self._fit: dict[int, bool] = {}
        self._own: dict[int, bool] = {}
        self._edges: dict[int, tuple[list[int], list[int]] | None] = {}

    def merged(self, data: bytes, trace: list[tuple[int, int, int]] | None = None) -> list[int]:
        """The definition: merge the lowest-ranked adjacent pair, leftmost first; used on one or two tokens only.

        ``trace`` receives (rank, first byte, byte after the end) of each merge in order.
        """
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = self.ranks
        costs = [ranks.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
        while True:
            best = min((c for c in costs if c is not None), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = costs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            if trace is not None:
                start = sum(map(len, parts[:i]))
                trace.append((best, start, start + len(parts[i])))
            del costs[i]
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1])
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i])

    def edges(self, token: int) -> tuple[list[int], list[int]] | None:
        """What stands at the left and right end of a token while it is merged from its bytes, in order of time.

        None for a token that merging never makes, or makes out of rank order.
        """
        if token not in self._edges:
            data, trace = self.tokens[token], []
            made = self.merged(data, trace)
            order = [r for r, _, _ in trace]
            ok = made == [token] and order == sorted(order)
            self._edges[token] = ([self.ranks[data[:1]], *(r for r, s, _ in trace if s == 0)],
                                  [self.ranks[data[-1:]], *(r for r, _, e in trace if e == len(data))]) if ok else None
            self._own[token] = made == [token]
        return self._edges[token]

    def reachable(self, token: int) -> bool:
        """Whether merging ever makes this token from its own bytes."""
        if token not in self._own:
            self.edges(token)
        return self._own[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens stay side by side: no merge across the border comes before those inside the tokens."""
        a, b = self.edges(left), self.edges(right)
        if a is None or b is None:
            return self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        ends, heads, tokens, ranks, never = a[1], b[0], self.tokens, self.ranks, 1 << 60
        i = j = 0
        while True:
            across = ranks.get(tokens[ends[i]] + tokens[heads[j]], never)
            end = ends[i + 1] if i + 1 < len(ends) else never
            head = heads[j + 1] if j + 1 < len(heads) else never
            if across < end and across <= head and across != never:
                return False
            if end == head == never:
                return True
            if end <= head:
                i += 1
            else:
                j += 1

    def _grow(self, data: bytes, last: list[int]) -> Iterator[int]:
        """Append the entries of ``data`` behind those of ``last`` one by one, yielding each end.

        The automaton names all tokens that end at a place, the longest first; at most one of them is valid.
        """
        known = len(last) - 1
        back = max(0, known + 1 - self.longest)
        memo, text = self._fit, data[back:].decode("latin-1")
        for at, (size, token) in self.matches.iter(text):
            end = at + back + 1
            if end < len(last) or end <= known:
                continue
            if end > len(last):
                raise ValueError("the ranks lack a single byte")
            start = end - size
            if start:
                pair = last[start] << 20 | token
                fit = memo.get(pair)
                if fit is None:
                    if len(memo) >= 2 * CACHE:
                        memo.clear()
                    fit = memo[pair] = self.fits(last[start], token)
            else:
                fit = self.reachable(token)
            if fit:
                last.append(token)
                yield end

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Grow ``last`` (of a prefix of ``data``; [0] for none) to all of ``data``: exact appends."""
        if len(last) > 1:
            for _ in self._grow(data, last):
                pass
            return last
        memo = self._fit  # the same steps as in _grow, without its bookkeeping: whole words come here
        append, done = last.append, 0
        for at, (size, token) in self.matches.iter(data.decode("latin-1")):
            if at < done:
                continue
            start = at + 1 - size
            if start:
                pair = last[start] << 20 | token
                fit = memo.get(pair)
                if fit is None:
                    if len(memo) >= 2 * CACHE:
                        memo.clear()
                    fit = memo[pair] = self.fits(last[start], token)
            else:
                fit = self.reachable(token)
            if fit:
                append(token)
                done = at + 1
        if len(last) <= len(data):
            raise ValueError("the ranks lack a single byte")
        return last

    def edit(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace data[start:end] by ``new``; only entries near the edit are worked out again."""
        out = data[:start] + new + data[end:]
        fresh, shift, same = last[:start + 1], len(new) - (end - start), 0
        for i in self._grow(out, fresh):
            behind = i - shift
            # an entry depends on the bytes and entries of one token length before it
            same = same + 1 if i >= start + len(new) and behind > end and last[behind] == fresh[i] else 0
            if same >= self.longest:
                fresh += last[behind + 1:]
                break
        return out, fresh

    def tokens_of(self, data: bytes, last: list[int]) -> list[int]:
        """Read the encoding backwards from the stored last tokens."""
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """A piece that is itself a token is that token, as in the common rank-file encoders."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tokens_of(piece, self.extend(piece, [0]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Chunks:
    """Bounded memo of chunk -> value in two generations, for the skewed distribution of words."""

    def __init__(self, make, size: int = CACHE):
        self.make, self.size, self.new, self.old = make, size, {}, {}

    def __call__(self, key: str):
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = self.make(key)
            if len(key) <= 64:
                if len(self.new) >= self.size:
                    self.old, self.new = self.new, {}
                self.new[key] = got
        return got


class TextEncoder:
    """Whole texts: each match of the splitting pattern is encoded separately."""

    #: A space that stands inside a run of white space and is not its last character: no safe place to cut.
    UNSAFE = regex.compile(r"\s (?:\s|\Z)")

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.bpe = PrefixBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.split = regex.compile(pattern)
        self.strings = {i: str(i) for i in self.bpe.tokens}
        self.piece = Chunks(lambda p: self.bpe.encode_piece(p.encode()))
        self.head, self.rest = Chunks(self.encode_slow), Chunks(lambda c: self.encode_slow(" " + c))

    def encode_slow(self, text: str) -> list[int]:
        out: list[int] = []
        for m in self.split.finditer(text):
            out += self.piece(m.group())
        return out

    def encode(self, text: str) -> list[int]:
        """A single space before a word, or the last one of a run, always starts a match, so texts are cut there first."""
        if " " not in text or self.UNSAFE.search(text):
            return self.encode_slow(text)
        first, *more = text.split(" ")
        out = list(self.head(first))
        rest = self.rest
        for chunk in more:
            out += rest(chunk)
        return out


@functools.lru_cache(2)
def encoder(path: str, pattern: str) -> TextEncoder:
    """One per worker process."""
    return TextEncoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, ids_sha256, decoded_sha256) per row of ``docs``; one pass, no shuffle.

    Null text counts as empty: no ids, the hash of the empty string. Repeated rows and null ids stay as they are.
    The vocabulary is read from ``path`` on each worker. ``with_ids=False`` leaves the ids out of the result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        strings, decode = enc.strings, enc.bpe.decode
        for part in without_gc(steps(batches)):
            ids_out, n, ids_sha, text_sha = [], [], [], []
            for text in part.column("text").to_pylist():
                ids = enc.encode(text or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(strings.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(decode(ids)).hexdigest())
                if with_ids:
                    ids_out.append(ids)
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return id_text(docs).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary): the bytes that the ids stand for; null ids give null."""
    def run(batches):
        bpe = encoder(path, pattern).bpe
        for b in batches:
            data = [None if ids is None else bpe.decode(ids) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")
