"""Substring deduplication by recompression.

Every text is parsed bottom-up: equal neighbours become a block symbol, then in each round the alphabet is split in two by
a hash and every left symbol followed by a right one becomes a pair symbol. A symbol's name is a 64-bit hash of what it
is made of, so it is the same in every task. Which symbols form depends on the words nearby only: two equal
windows of 13 words have the same symbols inside, whatever stands around them. Two Spark rounds use that:

1. every segment of texts asks which of its top symbols occur in another segment too;
2. windows whose inner symbols are all shared are named by a hash of all their words and ask for the smallest document
   that holds them. Words of windows known from a smaller document go.

Requests go out as sorted arrays of names, one per segment and name range, and come back as bitmaps in the same order. A
name is sent once per segment however often it occurs, so a passage that all documents share is no hot key.

How far a window's rim can differ: a block of two may be a longer run outside (2 words; 1 if the window itself has no
equal neighbours), the first round can pair 1 more word, the second one symbol of at most 2 words. So words 5 to 7 of 13
always lie in symbols that both windows have, words 4 to 8 if no two neighbours in the window are equal.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.common import SPACE, STEP_BYTES, Stage, flat, giving_back, id_text, mixed, range_hash, sha, steps, unique_name, words

WINDOW = 13
#: Bytes of text in a segment, and names that one task of a round gathers.
SEGMENT_BYTES, RANGE_NAMES = 6 << 20, 2_000_000
LAST = np.iinfo(np.int64).max


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as got:
        return got.read_next_batch()


def segments(docs: DataFrame) -> Stage:
    """All rows of ``docs`` in pieces of bounded size, each one row, so that a piece always names its symbols in one order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in giving_back(steps(batches, "text", SEGMENT_BYTES)):
            data, _ = flat(part.column("text"))
            n = int(np.count_nonzero(SPACE[data])) + part.num_rows if len(data) < 4 * SEGMENT_BYTES else len(data) // 2
            yield pa.RecordBatch.from_arrays([pa.array([unique_name()]), pa.array([n], pa.int64()), pa.array([_pack(part)], pa.binary())], ["segment", "n", "payload"])
    return Stage(docs.mapInArrow(run, "segment string, n long, payload binary"), "segments", "none")


class Words:
    """The words of a segment's texts: hashes, bytes and the text each belongs to. Places fit 32 bits, as Arrow's offsets do."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        self.data, self.at = flat(batch.column("text"))
        ids = batch.column("doc_id").fill_null(LAST)
        self.ids = np.asarray(ids.to_numpy(zero_copy_only=False), np.int64)
        got, first = [], 0
        while first < batch.num_rows:  # in steps, as hashing needs several wide arrays of the bytes
            end = max(first + 1, int(np.searchsorted(self.at, self.at[first] + STEP_BYTES, "right")) - 1)
            lo, hi = self.at[first], self.at[end]
            h, s, e, heads = words(self.data[lo:hi], self.at[first:end + 1] - lo)
            got.append((h, (s + lo).astype(np.int32), (e + lo).astype(np.int32), np.diff(heads)))
            first = end
        self.hash, self.start, self.end, self.counts = (np.concatenate([g[i] for g in got]) for i in range(4))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.text = np.repeat(np.arange(batch.num_rows, dtype=np.int32), self.counts)


def parse(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, number of words) of the top symbols, in order; no symbol reaches into another text."""
    name, span, own = h, np.ones(len(h), np.int8), text

    def join(pair: np.ndarray, salt: int):
        nonlocal name, span, own
        left = np.flatnonzero(pair)
        fresh = name.copy()
        fresh[left] = mixed(name[left] * np.uint64(0x9E3779B97F4A7C15) + (name[left + 1] ^ np.uint64(salt)) * np.uint64(0xC2B2AE3D27D4EB4F))
        wide = span.copy()
        wide[left] += span[left + 1]
        stay = np.ones(len(name), bool)
        stay[left + 1] = False
        name, span, own = fresh[stay], wide[stay], own[stay]

    if len(name) < 2:
        return name, span
    beside = np.zeros(len(name), bool)
    beside[:-1] = (name[:-1] == name[1:]) & (own[:-1] == own[1:])
    alone = beside.copy()
    alone[1:] &= ~beside[:-1]
    alone[:-1] &= ~beside[1:]
    join(alone, 1)
    for salt, most in ((2, 2), (3, 4)):
        if len(name) < 2:
            break
        side = (mixed(name + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(name), bool)
        pair[:-1] = side[:-1] & ~side[1:] & (own[:-1] == own[1:]) & (span[:-1] + span[1:] <= most)
        join(pair, salt)
    return name, span


class Names:
    """The distinct symbol names of a segment in order, and which symbol has which."""

    def __init__(self, w: Words, bits: int):
        name, self.span = parse(w.hash, w.text)
        symbol_text = w.text[np.cumsum(self.span, dtype=np.int64) - 1] if len(name) else w.text[:0]
        short = name >> np.uint64(32 - bits)  # the range and 32 more bits; a chance match only costs a look at a window
        self.values, self.inverse = np.unique(short, return_inverse=True)
        low, high = np.full(len(self.values), LAST), np.full(len(self.values), -LAST)
        ids = w.ids[symbol_text]
        np.minimum.at(low, self.inverse, ids)
        np.maximum.at(high, self.inverse, ids)
        self.local = low != high  # already in two documents here


class Windows:
    """Windows with shared inner symbols: distinct hashes in order, the smallest document of each, their places."""

    def __init__(self, w: Words, names: Names, elsewhere: np.ndarray, window: int):
        shared = np.repeat((names.local | elsewhere)[names.inverse], names.span)
        n = len(w.hash)
        starts = np.arange(max(0, n - window + 1), dtype=np.int32)
        starts = starts[w.text[starts] == w.text[starts + window - 1]]
        run = np.zeros(n + 1, np.int32)
        np.cumsum(shared, out=run[1:])
        twins = np.zeros(n, np.int32)
        np.cumsum(w.hash[1:] == w.hash[:-1], out=twins[1:])
        rim = np.where(twins[starts + window - 1] == twins[starts], 4, 5)
        inner = run[starts + window - rim] - run[starts + rim] == window - 2 * rim
        self.starts = starts[inner]
        self.values, self.inverse = np.unique(range_hash(w.hash, self.starts, self.starts + window), return_inverse=True)
        self.owner = w.ids[w.text[self.starts]]
        self.least = np.full(len(self.values), LAST)
        np.minimum.at(self.least, self.inverse, self.owner)


def _ranges(values: np.ndarray, shift: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of sorted values by their top bits, empty ranges left out."""
    if not len(values):
        return
    top = (values >> np.uint64(shift)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    cut = np.flatnonzero(np.diff(top, prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(values)), strict=True):
        yield int(top[a]), int(a), int(b)


def _zip(x: np.ndarray) -> bytes:
    return x.nbytes.to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unzip(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd"), kind)


def _bits(total: int) -> int:
    return max(0, math.ceil(math.log2(max(1, total) / RANGE_NAMES)))


def _flags(reply, n: int) -> np.ndarray:
    """The replies of all ranges in order as one bitmap."""
    out = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in sorted(reply or [], key=lambda r: r["range"])]
    return np.concatenate(out).astype(bool) if out else np.zeros(n, bool)


REQUEST = pa.schema([("segment", pa.string()), ("range", pa.int64()), ("names", pa.binary()), ("least", pa.binary())])


def _request_names(bits: int):
    def run(batches):
        for b in giving_back(batches):
            for segment, payload in zip(b.column("segment").to_pylist(), b.column("payload"), strict=True):
                values = Names(Words(_unpack(payload.as_py())), bits).values
                rows = [(r, values[i:j].astype(np.uint32).tobytes()) for r, i, j in _ranges(values, 32, bits)]
                yield pa.RecordBatch.from_arrays([pa.array([segment] * len(rows)), pa.array([r for r, _ in rows], pa.int64()),
                                                  pa.array([x for _, x in rows], pa.binary()), pa.array([None] * len(rows), pa.binary())], schema=REQUEST)
    return run


def _request_windows(bits: int, more: int, window: int):
    def asked(payload, reply) -> list[tuple[int, bytes, bytes]]:  # what one segment needs is gone before the next one is read
        w = Words(_unpack(payload.as_py()))
        names = Names(w, bits)
        win = Windows(w, names, _flags(reply.as_py(), len(names.values)), window)
        return [(r, win.values[i:j].tobytes(), _zip(win.least[i:j])) for r, i, j in _ranges(win.values, 64 - more, more)]

    def run(batches):
        for b in giving_back(batches):
            for segment, payload, reply in zip(b.column("segment").to_pylist(), b.column("payload"), b.column("reply"), strict=True):
                rows = asked(payload, reply)
                yield pa.RecordBatch.from_arrays([pa.array([segment] * len(rows)), pa.array([r for r, _, _ in rows], pa.int64()),
                                                  pa.array([x for _, x, _ in rows], pa.binary()), pa.array([x for _, _, x in rows], pa.binary())], schema=REQUEST)
    return run


def _answer(windows: bool):
    """Of one range: bitmaps for the names in two segments, or for the windows that a smaller document has elsewhere."""
    def answer(table: pa.Table) -> pa.Table:
        segments, blobs = table.column("segment").to_pylist(), table.column("names").to_pylist()
        parts = [np.frombuffer(x, np.uint64 if windows else np.uint32) for x in blobs]
        sizes = [len(p) for p in parts]
        values, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        if windows:
            least = np.concatenate([_unzip(x, np.int64) for x in table.column("least").to_pylist()])
            lowest = np.full(len(values), LAST)
            np.minimum.at(lowest, inverse, least)
            yes = lowest[inverse] < least
        else:
            yes = (np.bincount(inverse) > 1)[inverse]
        cut = np.cumsum([0, *sizes])
        return pa.table({"segment": segments, "range": table.column("range"), "n": pa.array(sizes, pa.int32()),
                         "bits": pa.array([np.packbits(yes[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    def run(table: pa.Table) -> pa.Table:
        [out] = map(answer, giving_back(iter([table])))
        return out
    return run


def _round(requests: DataFrame, windows: bool, out: str) -> Stage:
    answers = requests.groupBy("range").applyInArrow(_answer(windows), "segment string, range long, n int, bits binary")
    replies = answers.groupBy("segment").agg(F.collect_list(F.struct("range", "n", "bits")).alias(out))
    return Stage(replies, out)


def _judged(docs: DataFrame, window: int, finish, schema) -> DataFrame:
    """Run both rounds over the rows of ``docs`` and hand each segment with its removed words to ``finish``."""
    if window < WINDOW:
        raise ValueError(f"windows of fewer than {WINDOW} words need not share a symbol")
    held = segments(docs)
    total = held.df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits, more = min(30, _bits(total * 2 // 3)), min(30, _bits(total // 2))
    request = "segment string, range long, names binary, least binary"
    first = _round(held.df.select("segment", "payload").mapInArrow(_request_names(bits), request), False, "reply")
    known = held.df.select("segment", "payload").join(first.df, "segment", "left")
    second = _round(known.mapInArrow(_request_windows(bits, more, window), request), True, "answer")
    both = first.df.join(second.df, "segment", "left")

    def removed(w: Words, reply, answer) -> np.ndarray:
        names = Names(w, bits)
        win = Windows(w, names, _flags(reply.as_py(), len(names.values)), window)
        earlier = _flags(answer.as_py(), len(win.values))
        hit = win.starts[earlier[win.inverse] | (win.owner > win.least[win.inverse])]
        change = np.zeros(len(w.hash) + 1, np.int32)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + window, -1)
        return np.cumsum(change[:-1]) > 0

    def judged(payload, reply, answer) -> pa.RecordBatch:
        w = Words(_unpack(payload.as_py()))
        return finish(w, removed(w, reply, answer))

    def run(batches):
        for b in giving_back(batches):
            yield from map(judged, b.column("payload"), b.column("reply"), b.column("answer"))

    return held.df.select("segment", "payload").join(both, "segment", "left").mapInArrow(run, schema)


def kept_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row.

    Removed is each word of a window of ``window`` words whose words also start in a document of smaller doc_id. Null and
    empty texts have no words. Rows that repeat a doc_id leave each other alone, null ids count as larger than
    all others. Fewer than 13 words cannot be asked for.
    """
    def finish(w: Words, gone: np.ndarray) -> pa.RecordBatch:
        keep = ~gone
        per = np.concatenate([[0], np.cumsum(keep)])[w.first]
        n_kept = np.diff(per)
        data = w.data.copy()
        data[SPACE[data]] = 0x20
        edge = np.zeros(len(data) + 1, np.int8)
        edge[w.start[keep]] += 1
        edge[w.end[keep]] -= 1  # words never touch inside a text; between texts one may end where the next begins
        show = np.cumsum(edge[:-1]).astype(bool)
        kept = np.flatnonzero(keep)
        final = np.zeros(len(kept), bool)
        final[per[1:][n_kept > 0] - 1] = True
        show[w.end[kept[~final]]] = True
        size = np.concatenate([[0], np.cumsum(show)])[w.at]
        out = memoryview(data[show])
        return pa.RecordBatch.from_arrays(
            [w.batch.column("doc_id"), pa.array(w.counts, pa.int64()), pa.array(w.counts - n_kept, pa.int64()),
             pa.array([sha(out[a:b]) for a, b in zip(size[:-1], size[1:], strict=True)])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _judged(id_text(docs), window, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of ``docs``; repeated passages are cut out of ``text`` with the white space behind them, ``n_chars`` follows.

    The same cases as :func:`kept_words`; null texts stay null, everything else of a text stays as it is.
    """
    def finish(w: Words, gone: np.ndarray) -> pa.RecordBatch:
        columns, names = w.batch.columns, w.batch.schema.names
        if gone.any():
            sign = np.zeros(len(w.data) + 1, np.int32)
            heads = w.start[gone]
            after = np.append(w.start[1:], len(w.data))[gone]
            after = np.minimum(after, w.at[1:][w.text[gone]])
            np.add.at(sign, heads, 1)
            np.add.at(sign, after, -1)
            show = np.cumsum(sign[:-1]) == 0
            size = np.concatenate([[0], np.cumsum(show)])[w.at]
            out, null = memoryview(w.data[show]), w.batch.column("text").is_null().to_pylist()
            text = [None if n else str(out[a:b], "utf-8") for a, b, n in zip(size[:-1], size[1:], null, strict=True)]
            columns[names.index("text")] = pa.array(text, pa.string())
            if "n_chars" in names:
                at = names.index("n_chars")
                columns[at] = pa.array([None if t is None else len(t) for t in text], pa.int64()).cast(columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names)

    return _judged(docs, window, finish, docs.schema)
