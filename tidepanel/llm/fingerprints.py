"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph (line) is hashed to a wide vector; a document's fingerprint is their sum, modulo a power of two per lane. Order
does not matter, equal multisets are equal, and paragraphs go in and out by adding and subtracting their vectors. The vector
has two parts: SURE lanes modulo 2**32 filled by a cryptographic hash decide equality; LIKE lanes modulo 2**16 take
one signed unit per word triple of the paragraph, so that the distance of two fingerprints follows how much
of the documents differs.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.common import flat, id_text, mixed, range_hash, sha, words

SURE, LIKE, TRIPLE = 16, 128, 3


def _parts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sure and like lanes of each text."""
    sure = np.zeros((len(texts), SURE), np.uint32)
    like = np.zeros((len(texts), LIKE), np.int64)
    lines: list[bytes] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        got = [p for p in text.encode("utf-8", "surrogatepass").split(b"\n") if p]
        lines += got
        owner += [i] * len(got)
    if not lines:
        return sure, like.astype(np.uint16)
    who = np.array(owner)
    digest = np.frombuffer(b"".join(hashlib.blake2b(p).digest() for p in lines), np.uint32).reshape(-1, SURE)
    np.add.at(sure, who, digest)
    array = pa.array(lines, pa.large_binary())
    h, _, _, first = words(*flat(array))
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - TRIPLE + 1, 1))
    line = np.repeat(np.arange(len(lines)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    unit = mixed(range_hash(h, start, np.minimum(start + TRIPLE, first[1:][line])))
    lane = (unit % np.uint64(LIKE)).astype(np.int64)
    sign = np.where(unit >> np.uint64(63), 1, -1)
    like = np.bincount(who[line] * LIKE + lane, sign, len(texts) * LIKE).astype(np.int64).reshape(-1, LIKE)
    return sure, like.astype(np.uint16)


def fingerprint(texts: list[str]) -> np.ndarray:
    """One row of bytes per text."""
    sure, like = _parts(texts)
    return np.concatenate([sure.view(np.uint8), like.view(np.uint8)], axis=1)


def _combine(a: np.ndarray, b: np.ndarray, sign: int) -> np.ndarray:
    cut = SURE * 4
    x = a[..., :cut].copy().view(np.uint32)
    y = a[..., cut:].copy().view(np.uint16)
    u, v = b[..., :cut].copy().view(np.uint32), b[..., cut:].copy().view(np.uint16)
    return np.concatenate([(x + u if sign > 0 else x - u).view(np.uint8), (y + v if sign > 0 else y - v).view(np.uint8)], axis=-1)


def insert(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of all paragraphs of both."""
    return _combine(a, b, 1)


def delete(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of the paragraphs of ``a`` without those of ``b``."""
    return _combine(a, b, -1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal fingerprints, else one minus the squared distance over the sum of squared lengths, within 0 to 1."""
    cut = SURE * 4
    x = a[:, cut:].copy().view(np.int16).astype(np.float64)
    y = b[:, cut:].copy().view(np.int16).astype(np.float64)
    gap = (a[:, cut:].copy().view(np.uint16) - b[:, cut:].copy().view(np.uint16)).view(np.int16).astype(np.float64)
    total = (x * x).sum(1) + (y * y).sum(1)
    near = np.where(total > 0, 1 - (gap * gap).sum(1) / np.where(total > 0, total, 1), 0.0)
    return np.where((a == b).all(1), 1.0, np.clip(near, 0.0, 1.0))


def compute(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint binary) per row; null and empty texts have the zero vector."""
    def run(batches):
        for b in batches:
            got = fingerprint([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.tobytes() for x in got], pa.binary())], ["doc_id", "fingerprint"])
    return id_text(docs).mapInArrow(run, "doc_id long, fingerprint binary")


#: Characters of text that one range of doc_ids holds.
RANGE_CHARS = 8_000_000
#: Most ranges; beyond, ranges grow. Tasks stream through sorted rows, so a larger range needs no more memory.
RANGES = 2000
#: Documents that are hashed together.
GROUP = 256


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    Edited is a text whose last floor(n/2) code points are replaced by the first as many of the next document in
    ascending doc_id (repeated ids by a hash of the text, null ids first), the first after the last; a single
    document is its own next. Null texts are empty. Ranges of doc_id are dealt to partitions, each with the first document of
    the following range besides, so one shuffle of the texts is enough and no neighbour is missing.
    """
    docs = id_text(docs)
    total = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count(F.lit(1)).alias("n")).first()
    parts = min(RANGES, max(1, -(-int(total["chars"]) // RANGE_CHARS)))
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    keyed = docs.withColumn("k", order).withColumn("tie", F.xxhash64("text"))
    cuts = []
    if parts > 1:
        cuts = sorted(set(docs.select(order.alias("k")).agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10 * parts).alias("c")).first()["c"]))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("k"))) if cuts else F.lit(0)
    keyed = keyed.withColumn("part", part)
    heads = keyed.groupBy("part").agg(F.min(F.struct("k", "tie")).alias("h")).orderBy("part").collect()  # one row per range
    guests = {(h["h"]["k"], h["h"]["tie"]): heads[i - 1]["part"] for i, h in enumerate(heads)}
    values = [F.struct(F.lit(k).cast("long").alias("k"), F.lit(t).cast("long").alias("tie"), F.lit(p).cast("int").alias("to")) for (k, t), p in guests.items()]
    if values:
        as_guest = F.filter(F.array(*values), lambda g: (g["k"] == F.col("k")) & (g["tie"] == F.col("tie")))
        guest_to = F.when(F.size(as_guest) > 0, as_guest[0]["to"])
        stops = F.filter(F.array(F.struct(F.col("part").alias("to"), F.lit(0).alias("guest")), F.struct(guest_to.alias("to"), F.lit(1).alias("guest"))), lambda s: s["to"].isNotNull())
    else:
        stops = F.array(F.struct(F.col("part").alias("to"), F.lit(0).alias("guest")))
    dealt = keyed.select("doc_id", "text", "k", "tie", F.explode(stops).alias("s")).select("doc_id", "text", "k", "tie", F.col("s.to").alias("to"), F.col("s.guest").alias("guest"))
    dealt = dealt.repartitionById(parts, "to").sortWithinPartitions("guest", "k", "tie").select("doc_id", "text", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []

        def work(pairs: int) -> pa.RecordBatch:
            own, nxt = texts[:pairs], texts[1:pairs + 1]
            new = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(own, nxt, strict=True)]
            plain = fingerprint(texts[:pairs + 1])
            a, b, c = plain[:pairs], fingerprint(new), plain[1:pairs + 1]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[:pairs], pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array([sha(t.encode("utf-8", "surrogatepass")) for t in new]),
                 pa.array([x.tobytes().hex() for x in a]), pa.array([x.tobytes().hex() for x in b]), pa.array(likeness(a, b)), pa.array(likeness(a, c))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        guest = False
        for batch in batches:
            for i, t, g in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("guest").to_pylist(), strict=True):
                if g and guest:
                    continue  # a repeated row at the head of the next range
                guest = guest or bool(g)
                ids.append(i)
                texts.append(t)
                if len(texts) > GROUP:
                    yield work(len(texts) - 1)
                    ids, texts = ids[-1:], texts[-1:]
        if len(texts) > 1:
            yield work(len(texts) - 1)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
