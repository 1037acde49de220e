"""Language-model scores: the probability of a text summed over all its segmentations into the pieces of an existing vocabulary.

The vocabulary and its scores are those of a public tokenizer and are not trained; the scores (ranks) give the first piece
probabilities, which the corpus then re-estimates in a few rounds of expectation and maximisation over its distinct words. A text is the
sequence of its words, each behind a word mark, and an end; pieces never cross a word mark, and every single byte is a piece, so all texts have a
probability and those of all texts sum to one. The forward recursion runs in log space over the lattice of all pieces that match, for
many words at once.

A text is looked at once: its segment (a few MB of texts of one partition) keeps word numbers, and sends each of its distinct words once, with
its count in training texts. Counts are summed per word over the corpus, the lattice is solved once per distinct word, and both figures
return to the segments by a join.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.common import Stage, id_text, steps, without_gc

MARK = b" "
_GAP = re.compile(rb"[\x20\x09-\x0d]")
#: Rounds of re-estimation, and how many pieces the first probabilities count for.
ROUNDS, PRIOR = 3, 1000.0
#: Rank r of the vocabulary starts at a weight of 1 / (r + OFFSET).
OFFSET = 10.0
#: Bytes of text of a segment; bytes of words solved together; bytes of one text split at a time.
SEGMENT, STEP, CHUNK = 24 << 20, 1 << 19, 4 << 20


def vocabulary(path: str) -> dict[bytes, float]:
    """Piece -> weight from the scores of a tokenizer file; every byte that words can hold is a piece, at least of the lowest weight."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    found: dict[bytes, float] = {}
    for i in ids:
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if 0x20 not in piece[1:]:
            found[piece] = found.get(piece, 0.0) + 1 / (min(-model.get_score(i), len(ids)) + OFFSET)
    for b in range(256):
        if b == 0x20 or not 0x09 <= b <= 0x0D:
            found.setdefault(bytes([b]), 1 / (len(ids) + OFFSET))
    return found


class Lattice:
    """All segmentations of words into ``pieces``."""

    def __init__(self, pieces: list[bytes]):
        nodes: dict[int, int] = {}
        piece_of = [-1]
        for k, piece in enumerate(pieces):
            at = 0
            for b in piece:
                step = at << 8 | b
                if step not in nodes:
                    nodes[step] = len(piece_of)
                    piece_of.append(-1)
                at = nodes[step]
            piece_of[at] = k
        steps = np.fromiter(nodes.keys(), np.int64, len(nodes))
        inner = np.unique(steps >> 8)
        self.piece_of = np.array(piece_of)
        self.row_of = np.full(len(piece_of), -1)
        self.row_of[inner] = np.arange(len(inner))
        self.child = np.full((max(1, len(inner)), 256), -1, np.int32)
        self.child[self.row_of[steps >> 8], steps & 255] = np.fromiter(nodes.values(), np.int64, len(nodes))

    def edges(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, first place (one extra place per word), its offset in the word, length and piece of every piece that matches."""
        word = np.repeat(np.arange(len(at) - 1), np.diff(at))
        stop = at[1:][word]
        pos, row, m, out = np.arange(len(flat)), np.zeros(len(flat), np.int64), 0, []
        while len(pos):
            node = self.child[row, flat[pos + m]]
            ok = node >= 0
            pos, node, m = pos[ok], node[ok], m + 1
            piece = self.piece_of[node]
            hit = piece >= 0
            out.append((pos[hit], np.full(hit.sum(), m), piece[hit]))
            row = self.row_of[node]
            on = (row >= 0) & (pos + m < stop[pos])
            pos, row = pos[on], row[on]
        pos, size, piece = (np.concatenate(x) for x in zip(*out, strict=True))
        w = word[pos]
        return w, pos + w, pos - at[w], size, piece

    @staticmethod
    def _sweep(total: np.ndarray, order: np.ndarray, keys: np.ndarray, into: np.ndarray, source: np.ndarray, weight: np.ndarray) -> None:
        """total[into] += total[source] * weight in log space, group of equal keys by group; within a group all ``into`` differ."""
        cuts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
            e = order[lo:hi]
            total[into[e]] = np.logaddexp(total[into[e]], total[source[e]] + weight[e])

    def solve(self, words: list[bytes], logp: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each word, and with ``counts`` the expected uses of each piece."""
        size = np.array([len(w) for w in words])
        at = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(b"".join(words), np.uint8)
        w, start, offset, length, piece = self.edges(flat, at)
        end, weight = start + length, logp[piece]
        heads = at[:-1] + np.arange(len(words))
        tails = heads + size
        key = (offset + length << 10) + length
        order = np.argsort(key, kind="stable")
        alpha = np.full(len(flat) + len(words), -np.inf)
        alpha[heads] = 0.0
        self._sweep(alpha, order, key[order], end, start, weight)
        z = alpha[tails]
        if counts is None:
            return z, None
        beta = np.full(len(flat) + len(words), -np.inf)
        beta[tails] = 0.0
        key = -((offset << 10) + length)
        order = np.argsort(key, kind="stable")
        self._sweep(beta, order, key[order], start, end, weight)
        used = np.exp(alpha[start] + weight + beta[end] - z[w]) * counts[w]
        return z, np.bincount(piece, used, len(logp))


@lru_cache(maxsize=2)
def _lattice(pieces: tuple[bytes, ...]) -> Lattice:
    return Lattice(list(pieces))


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, A to Z in lower case, some MB at a time."""
    lo = 0
    while len(data) - lo > CHUNK:
        cut = _GAP.search(data, lo + CHUNK)
        hi = cut.start() if cut else len(data)
        yield data[lo:hi].lower().split()  # bytes: only ASCII letters and white space count
        lo = hi
    yield data[lo:].lower().split()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


SEGMENTS = "segment long, ids array<long>, held array<boolean>, sizes array<long>, codes binary, words array<binary>, counts array<long>"


def _segments(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Texts of a partition, some MB at a time, as numbers of their distinct words."""
    import zstandard
    from pyspark import TaskContext
    part, made = TaskContext.get().partitionId(), 0
    schema = pa.schema([("segment", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())),
                        ("codes", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])
    ids, held, sizes, codes, numbers, size = [], [], [], [], _Numbers(), 0

    def flush() -> pa.RecordBatch:
        all_codes = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        learned = np.repeat(~np.array(held, bool), sizes)
        counts = np.bincount(all_codes[learned], minlength=len(numbers))
        row = [part << 32 | made, ids, held, sizes, zstandard.ZstdCompressor(1).compress(all_codes.tobytes()), list(numbers), counts]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    for batch in batches:
        for i, h, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            mine = [np.fromiter(map(numbers.__getitem__, some), np.int32, len(some)) for some in words_of(text)]
            ids.append(i)
            held.append(h)
            sizes.append(sum(map(len, mine)))
            codes += mine
            size += len(text) + 16
            if size >= limit:
                yield flush()
                ids, held, sizes, codes, numbers, size, made = [], [], [], [], _Numbers(), 0, made + 1
    if ids:
        yield flush()


class Model:
    """Piece probabilities; the last entry is the end of a text."""

    def __init__(self, weights: dict[bytes, float]):
        self.pieces = tuple(weights)
        first = np.array([*weights.values(), 1 / OFFSET])
        self.first = self.p = first / first.sum()

    def learn(self, used: np.ndarray) -> None:
        self.p = (used + PRIOR * self.first) / (used.sum() + PRIOR)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """Log10 probability of each word behind its mark."""
        return _lattice(self.pieces).solve([MARK + w for w in words], np.log(self.p))[0] / math.log(10)

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        return _lattice(self.pieces).solve([MARK + w for w in words], np.log(self.p), counts)[1]

    @property
    def end(self) -> float:
        return float(np.log10(self.p[-1]))


def fit(words: DataFrame, ends: int, path: str, rounds: int = ROUNDS) -> Model:
    """Piece probabilities from the words (word, c) of all training texts and their number ``ends``.

    A task sends the expected uses of each piece, so what reaches the driver is one figure per piece of the vocabulary.
    """
    model = Model(vocabulary(path))
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            used = np.zeros(len(sent.value.p))
            for b in steps(batches, "word", STEP):
                used += sent.value.expected(b.column("word").to_pylist(), b.column("c").to_numpy().astype(float))
            some = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(used[some])], ["piece", "used"])

        used = np.zeros(len(model.p))
        for r in words.where("c > 0").mapInArrow(expect, "piece long, used double").groupBy("piece").agg(F.sum("used").alias("used")).collect():
            used[r["piece"]] = r["used"]
        used[-1] = ends
        model.learn(used)
        sent.unpersist()
    return model


def score(docs: DataFrame, path: str, every: int = 7, held: int = 2, rounds: int = ROUNDS, segment: int = SEGMENT) -> DataFrame:
    """Token counts, a word model's score (``base_score``) and the lattice score of every whole text; log10.

    Learned from texts whose crc32(doc_id) modulo ``every`` is not ``held``; a row without an id is learned from. Null texts are empty: the end
    alone. Repeated rows each count and are each returned. Without any training text, pieces keep their first probabilities, and the
    word model gives every token log10(1). An empty table gives an empty result. Other columns are not read.
    """
    rest = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % every
    texts = id_text(docs).withColumn("held", F.coalesce(rest == held, F.lit(False)))
    tokens = Stage(texts.mapInArrow(lambda b: without_gc(_segments(b, segment)), SEGMENTS), "tokens")
    stage = tokens.df
    postings = stage.select("segment", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("segment", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = Stage(postings.groupBy("word").agg(F.sum("n").alias("c")), "words").df
    ends = stage.select(F.explode("held").alias("held")).where("not held").count()
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = total["n"] + ends, total["v"] + (ends > 0)
    sent = words.sparkSession.sparkContext.broadcast(fit(words, ends, path, rounds))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "word", STEP):
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(sent.value.log10(b.column("word").to_pylist()))], ["word", "c", "logp"])

    solved = words.mapInArrow(solve, "word binary, c long, logp double")
    back = postings.select("segment", "at", "word").join(solved, "word").select("segment", "at", "c", "logp")

    def totals(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard
        row = left.to_pylist()[0]
        ids, sizes = row["ids"], np.array(row["sizes"], np.int64)
        at, c, logp = (right.column(k).to_numpy() for k in ("at", "c", "logp"))
        values = np.zeros((3, len(at)))
        values[:, at] = np.log10((c + 1) / (n + v + 1)), logp, c > 0
        codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["codes"]), np.int32)
        stop = np.cumsum(sizes)
        out = np.zeros((3, len(ids)))
        some = np.flatnonzero(sizes)
        for k in range(3):
            if len(some):
                out[k, some] = np.add.reduceat(values[k][codes], (stop - sizes)[some])
        base_end, end = math.log10((ends + 1) / (n + v + 1)), sent.value.end
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(sizes + 1),
                         "n_known": pa.array(out[2].astype(np.int64) + (ends > 0)), "train_tokens": pa.array(np.full(len(ids), n, np.int64)),
                         "base_score": pa.array(out[0] + base_end), "score": pa.array(out[1] + end)})

    return (tokens.df.select("segment", "ids", "held", "sizes", "codes").groupBy("segment").cogroup(back.groupBy("segment"))
            .applyInArrow(totals, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
