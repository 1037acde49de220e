"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton. A text is parsed greedily into the longest
phrases that occur in the sample; the language that needs the fewest phrases, each counted with the bits that
point into its sample, wins. Automata are dense transition tables whose gaps restart at the root and count a
phrase, so a whole batch of text blocks walks through all languages in step, one gather per character.
"""
from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.llm.common import giving_back, id_text, steps

#: Bounds of the training sample, per language: rows, characters of one row, characters in all.
SAMPLE_ROWS, ROW_CHARS, SAMPLE_CHARS = 200, 1000, 24_000
#: Texts are parsed whole, in blocks of so many characters; a phrase ends with its block.
BLOCK = 1024
UNKNOWN = "und"
_PHRASE = 1 << 30


@functools.cache
def letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for c in range(0x110000):
        table[c] = unicodedata.category(chr(c))[0] == "L"
    return table


def points(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of other characters as one space."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(letters()[x], x, 32)
    stay = np.ones(len(x), bool)
    stay[1:] = (x[1:] != 32) | (x[:-1] != 32)
    return x[stay]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings (online construction)."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go


@dataclass
class Model:
    """``table[state * width + class]``: the next row's start, plus _PHRASE if the character begins a new phrase."""
    languages: list[str]
    classes: dict[int, int]
    width: int
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray

    def parse(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Best language and its share among all, for each text."""
        n, found = len(texts), len(self.languages)
        lookup = np.zeros(0x110000, np.uint8)
        for point, k in self.classes.items():
            lookup[point] = k
        parts = [points(t) if t else np.zeros(0, np.uint32) for t in texts]
        size = np.array([len(p) for p in parts])
        known = np.array([bool((p != 32).any()) for p in parts], bool)
        codes = lookup[np.concatenate(parts)] if n else np.zeros(0, np.uint8)
        begin = np.cumsum(size) - size
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(n), blocks)
        start = (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        length = np.minimum(size[owner] - start, BLOCK)
        order = np.argsort(-length, kind="stable")
        at, length, owner = (begin[owner] + start)[order], length[order], owner[order]
        state = np.repeat(self.roots[:, None], len(at), axis=1)
        count = np.ones((found, len(at)), np.int64)
        alive = np.searchsorted(-length, -np.arange(1, BLOCK + 1), "right")
        for j in range(int(length[0]) if len(length) else 0):
            m = int(alive[j])
            got = self.table[state[:, :m] + codes[at[:m] + j]]
            count[:, :m] += got >> 30
            state[:, :m] = got & (_PHRASE - 1)
        phrases = np.zeros((found, n))
        for k in range(found):
            phrases[k] = np.bincount(owner, count[k], n) * self.bits[k]
        best = phrases.argmin(axis=0) if found else np.zeros(n, int)
        share = 1 / np.exp(np.clip(phrases.min(axis=0) - phrases, -700, 0) / max(self.bits)).sum(axis=0) if found else np.zeros(n)
        ok = known & (found > 0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, ok, strict=True)], np.where(ok, share, 0.0)


def build(samples: dict[str, str]) -> Model:
    """Automata of all languages as one table over their common letters (class 0: a letter in no sample)."""
    parsed = {k: points(v)[:SAMPLE_CHARS] for k, v in sorted(samples.items())}
    parsed = {k: v for k, v in parsed.items() if len(v)}
    seen, often = np.unique(np.concatenate(list(parsed.values()) or [np.zeros(0, np.uint32)]), return_counts=True)
    seen = seen[np.argsort(-often, kind="stable")][:255]
    classes = {int(p): i + 1 for i, p in enumerate(seen)}
    width, tables, roots, bits, base = len(classes) + 1, [], [], [], 0
    for codes in parsed.values():
        go = suffix_automaton([classes.get(int(p), 0) for p in codes])
        root = np.full(width, base * width, np.int64)
        for c, q in go[0].items():
            root[c] = (base + q) * width
        table = np.tile(root + _PHRASE, (len(go), 1))
        for s, edges in enumerate(go):
            for c, q in edges.items():
                if c:
                    table[s, c] = (base + q) * width
        table[:, 0] = base * width + _PHRASE
        tables.append(table.astype(np.int32))
        roots.append(base * width)
        bits.append(math.log2(max(2, len(codes))))
        base += len(go)
    flat = np.concatenate(tables).reshape(-1) if tables else np.zeros(0, np.int32)
    return Model(list(parsed), classes, width, flat, np.array(roots, np.int32), np.array(bits))


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = ROW_CHARS) -> Model:
    """Model of the labelled ``docs`` (doc_id, text, lang): ``rows`` texts per language by a hash of the id, ``chars`` of each.

    The sample is bounded by languages x rows x chars whatever the input; the window keeps no more than that per task.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    known = docs.where("lang is not null and text is not null and length(text) > 0").select("doc_id", F.col("lang").cast("string").alias("lang"), F.substring("text", 1, chars).alias("text"))
    chosen = known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).select("lang", "n", "text").collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["n"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return build({k: "\n".join(v) for k, v in samples.items()})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every whole text; ``und`` with score 0 if it is null or has no letter.

    Equal costs go to the language first in alphabetical order; with no language learned all is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            language, score = shared.value.parse(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(language, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id="doc_id"):
    """Rows that no model may learn from; a null id is never held out and never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that are not held out, predicted for all."""
    model = learn(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame) -> DataFrame:
    """All columns of the rows whose text is in a learned language; only texts that are null or without letters go, also if no language could be learned."""
    model = learn(docs.where(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in giving_back(steps(batches)):
            texts = part.column("text").to_pylist()
            stay = [x != UNKNOWN for x in shared.value.parse(texts)[0]] if shared.value.languages else [bool(t) and bool((points(t) != 32).any()) for t in texts]
            yield part.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
