"""Packing documents into token sequences by linear grouping and best fit.

Lengths are whole numbers up to the sequence size, so everything that has to be decided is decided on the histogram of lengths,
which has at most that many entries whatever the number of documents:

1. large lengths are put into groups of equal count and rounded up to their group's largest (linear grouping),
2. a linear program over the few rounded sizes chooses how often each configuration is used (column generation),
3. actual lengths replace the rounded ones, and the gaps they leave are known exactly,
4. what is left over and all small documents go into the fullest sequence that still takes them (best fit, largest first).

The plan is a bounded list of runs "pieces of this length with these ranks go to these sequences at this offset". Pieces are
numbered within their length by counts per partition, and look their place up: no global sort, no document in the driver.
"""
from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.llm.common import Stage, id_text, steps, without_gc

SEQUENCE, END = 4096, 1
#: Lengths above this share of a sequence are large; the numbers of groups that are tried, 0 for best fit alone. The best plan counts.
LARGE, GROUPS = 1 / 8, (12, 16, 0)
#: Entries of each generation of a worker's memos of words and of their parts.
CACHE = 220_000


class WordIds:
    """Ids of whole texts. The tokenizer drops white space and never looks across it, so words are encoded once."""

    #: What the tokenizer takes for white space; Python's split() would also cut at the four separators 1C to 1F.
    ODD = re.compile("[\\x1c-\\x1f]")
    WORD = re.compile("[^\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")

    #: Words on which lower case and the splitting pattern work letter by letter, and what they are split into.
    PLAIN = re.compile("[!-~\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]+")
    PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\\xdf-\\xf6\\xf8-\\xff]+|[0-9]|[^a-z\\xdf-\\xf6\\xf8-\\xff0-9]+")

    def __init__(self, path: str, spell_added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = spell_added
        #: What is one id wherever it stands in a word, unless it is to be spelled out.
        added = [] if spell_added else [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)")
        level = ByteLevel(add_prefix_space=False, use_regex=False)  # how the model spells bytes
        self.byte = {c: level.pre_tokenize_str(chr(c))[0][0] for c in [*range(0x21, 0x7F), *range(0xC0, 0x100)]}
        self.known: dict[str, bytes] = {}  # each memo in two generations
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def fresh(self, words: list[str]) -> None:
        """Encode words; those of plain Latin letters by their pre-tokens, which go to the merges directly, unless an added token is in them."""
        cut, other = {}, []
        for w in words:
            if self.PLAIN.fullmatch(w) and not self.added.search(w):
                cut[w] = self.PART.findall(w.lower())
            else:
                other.append(w)
        tokenize, byte = self.tokenizer.model.tokenize, self.byte
        for part in {p for parts in cut.values() for p in parts}:
            if part not in self.parts:
                had = self.old_parts.get(part)
                self.parts[part] = had if had is not None else array("I", [t.id for t in tokenize(part.translate(byte))]).tobytes()
        of = self.parts.__getitem__
        for w, parts in cut.items():
            self.known[w] = of(parts[0]) if len(parts) == 1 else b"".join(map(of, parts))
        for i in range(0, len(other), 4096):
            some = other[i:i + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[w] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self.WORD.findall(t) if self.ODD.search(t) else t.split() for t in texts]
        if len(self.known) > CACHE:
            self.known, self.old = {}, self.known
        if len(self.parts) > CACHE:
            self.parts, self.old_parts = {}, self.parts
        new = []
        for w in set().union(*split):
            if w not in self.known:
                if w in self.old:
                    self.known[w] = self.old[w]
                else:
                    new.append(w)
        self.fresh(new)
        of = self.known.__getitem__
        return [b"".join(map(of, words)) for words in split]


@lru_cache(2)
def word_ids(path: str, spell_added: bool = False) -> WordIds:
    """Ids as the library gives them; ``spell_added``: the markers of the tokenizer file are text like any other."""
    return WordIds(path, spell_added)


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, pid, nth): token pieces, numbered per length within their partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid, seen = word_ids(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        tail = END.to_bytes(4, "little")
        for part in without_gc(steps(batches)):
            doc, piece, start, length, crc, nth = [], [], [], [], [], []
            for i, ids in zip(part.column("doc_id").to_pylist(), enc.encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    some = ids[at:at + 4 * size]
                    n = len(some) // 4
                    doc.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(some))
                    nth.append(int(seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([pid] * len(doc), pa.int64()), pa.array(nth, pa.int64())],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "nth"])
    return id_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, pid long, nth long")


def configurations(sizes: list[int], need: list[int], size: int) -> list[tuple[list[int], float]]:
    """How often to use which multiset of sizes so that all needs are met with the fewest sequences (fractional)."""
    k, s, n = len(sizes), np.array(sizes), np.array(need, float)
    columns = [np.eye(k)[g] * (size // sizes[g]) for g in range(k)]
    basis = np.array(columns).T
    while True:
        inverse = np.linalg.inv(basis)
        value = inverse @ n
        price = inverse.sum(axis=0)
        # the dearest filling of one sequence at these prices
        best, pick = np.zeros(size + 1), np.full(size + 1, -1)
        for c in range(min(sizes), size + 1):
            fit = np.flatnonzero(s <= c)
            gain = best[c - s[fit]] + price[fit]
            top = int(gain.argmax())
            if gain[top] > best[c - 1] + 1e-12:
                best[c], pick[c] = gain[top], fit[top]
            else:
                best[c] = best[c - 1]
        if best[size] <= 1 + 1e-7:
            return [(basis[:, i].astype(int).tolist(), float(value[i])) for i in range(k) if value[i] > 1e-9]
        column, c = np.zeros(k), size
        while c > 0:
            if pick[c] >= 0:
                column[pick[c]] += 1
                c -= s[pick[c]]
            else:
                c -= 1
        step = inverse @ column
        ratio = np.where(step > 1e-9, value / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column


def plan(counts: dict[int, int], size: int = SEQUENCE, groups: int = GROUPS[0]) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(runs, number of sequences) for a histogram length -> count.

    A run (length, from, to, sequence, offset, per): ranks from..to-1 of that length, ``per`` to a sequence, from that sequence on.
    """
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, deque[tuple[int, int]]] = {}  # free tokens -> (first sequence, how many)
    order: list[int] = []  # heap of the keys of gaps
    total = 0

    def free(room: int, first: int, many: int) -> None:
        if many and room:
            if not gaps.get(room):
                heapq.heappush(order, room)
            gaps.setdefault(room, deque()).append((first, many))

    large = [n for n in left if n > size * LARGE and n < size]
    if large and groups:
        per = -(-sum(left[n] for n in large) // groups)
        cells: list[list[list[int]]] = [[]]  # each group: [length, count], the longest first
        room = per
        for n in large:
            rest = left[n]
            while rest:
                take = min(rest, room)
                cells[-1].append([n, take])
                rest, room = rest - take, room - take
                if not room:
                    cells.append([])
                    room = per
        cells = [c for c in cells if c]
        merged: list[list[list[int]]] = []
        for c in cells:  # groups that round to the same size are one
            if merged and merged[-1][0][0] == c[0][0]:
                merged[-1] += c
            else:
                merged.append(c)
        for shape, times in configurations([c[0][0] for c in merged], [sum(x[1] for x in c) for c in merged], size):
            many = int(times + 1e-9)
            if not many:
                continue
            bins = [(total, many, 0)]
            total += many
            for g, amount in enumerate(shape):
                for _ in range(amount):
                    after = []
                    for first, count, fill in bins:
                        while count and merged[g]:
                            n, have = merged[g][0]
                            take = min(count, have)
                            runs.append((n, used[n], used[n] + take, first, fill, 1))
                            used[n] += take
                            left[n] -= take
                            after.append((first, take, fill + n))
                            merged[g][0][1] -= take
                            if not merged[g][0][1]:
                                merged[g].pop(0)
                            first, count = first + take, count - take
                        if count:
                            after.append((first, count, fill))
                    bins = after
            for first, count, fill in bins:
                free(size - fill, first, count)
    for n, rest in left.items():
        tight = sorted(r for r in gaps if r >= n and gaps[r])
        for room in tight:
            per = room // n
            while rest and gaps[room]:
                first, many = gaps[room].popleft()
                whole = min(many, rest // per)
                if whole:
                    runs.append((n, used[n], used[n] + whole * per, first, size - room, per))
                    used[n] += whole * per
                    rest -= whole * per
                    free(room - per * n, first, whole)
                if rest and whole < many:  # the last one takes fewer
                    runs.append((n, used[n], used[n] + rest, first + whole, size - room, rest))
                    used[n] += rest
                    free(room - rest * n, first + whole, 1)
                    whole, rest = whole + 1, 0
                if whole < many:
                    gaps[room].appendleft((first + whole, many - whole))
            if not rest:
                break
        if rest:
            per = size // n
            whole, part = divmod(rest, per)
            if whole:
                runs.append((n, used[n], used[n] + whole * per, total, 0, per))
                free(size - per * n, total, whole)
            if part:
                runs.append((n, used[n] + whole * per, used[n] + rest, total + whole, 0, part))
                free(size - part * n, total + whole, 1)
            used[n] += rest
            total += whole + bool(part)
    return runs, total


def place(cut: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Add (sequence_id, offset) to stored pieces; sequences are filled without gaps from offset 0."""
    per_part = Stage(cut.groupBy("length", "pid").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_part.df.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    runs, _ = min((plan(counts, size, g) for g in GROUPS), key=lambda p: p[1])
    # the runs of one length follow each other in rank
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    shared = cut.sparkSession.sparkContext.broadcast((table[:, 0] << 44 | table[:, 1], table))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(per_part.df.select("length", "pid", before.alias("before")), ["length", "pid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("before").to_numpy() + b.column("nth").to_numpy()
            row = table[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            k = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                                              pa.array(row[:, 3] + k // row[:, 5]), pa.array(row[:, 4] + k % row[:, 5] * length)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every token piece of every row.

    A document is its ids and the end id; null and empty texts are the end id alone; only longer ones are cut. Rows that
    repeat are packed each for itself; an empty table gives no rows.
    """
    return place(Stage(pieces(docs, path, size), "pieces").df, size)
