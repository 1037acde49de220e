"""Lattice likelihoods against sums over all segmentations, scores against a plain implementation."""
import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tests.llm.conftest import odd_rows, prose
from tidepanel.llm import lattice

PATH = P.path("piece_bpe_32k.model")


def segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            for rest in segmentations(word[k:], pieces):
                yield [word[:k], *rest]


def test_likelihood_and_uses_are_sums_over_segmentations():
    rng = random.Random(1)
    pieces = [b"a", b"b", b"ab", b"ba", b"aba", b"bb", b"abab", b"aa"]
    logp = np.log(np.array([rng.random() for _ in pieces]) / 9)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    counts = np.array([float(rng.randint(0, 4)) for _ in words])
    z, used = lattice.Lattice(pieces).solve(words, logp, counts)
    want = np.zeros(len(pieces))
    for w, c, got in zip(words, counts, z, strict=True):
        ps = [(s, math.exp(sum(logp[pieces.index(x)] for x in s))) for s in segmentations(w, pieces)]
        assert math.isclose(got, math.log(sum(p for _, p in ps)), rel_tol=1e-12)
        for s, p in ps:
            for x in s:
                want[pieces.index(x)] += c * p / sum(q for _, q in ps)
    assert np.allclose(used, want)


def test_probabilities_of_all_texts_sum_to_one():
    model = lattice.Model({b"a": 1.0, b"b": 2.0, b"ab": 0.5, b" ": 1.0, b" a": 3.0})
    assert math.isclose(model.p.sum(), 1)
    full = lattice.Model(lattice.vocabulary(PATH))
    assert math.isclose(full.p.sum(), 1) and np.isfinite(full.log10([b"x" * 3000, "漢字🙂".encode(), b"\xff\x00"])).all()


def brute(rows, rounds):
    known, ends = collections.Counter(), 0
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: (t or "").encode().lower().split()
    for i, t in rows:
        if not held(i):
            known.update(split(t))
            ends += 1
    n, v = sum(known.values()) + ends, len(known) + (ends > 0)
    model = lattice.Model(lattice.vocabulary(PATH))
    for _ in range(rounds):
        used = model.expected(list(known), np.array([float(c) for c in known.values()])) if known else np.zeros(len(model.p))
        used[-1] = ends
        model.learn(used)
    out = []
    for i, t in rows:
        words = split(t)
        base = sum(math.log10((known[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        score = (model.log10(words).sum() if words else 0.0) + model.end
        out.append((i, held(i), len(words) + 1, sum(known[w] > 0 for w in words) + (ends > 0), n, base, score))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [24 << 20, 3000])
def test_scores(spark, none, segment):
    rng = random.Random(2)
    rows = odd_rows() + [(i, prose(rng, rng.randint(0, 80)).title()) for i in range(1000, 1200)]
    df = spark.createDataFrame([(*r, "x", 0, True) for r in rows], "doc_id long, text string, word string, c long, held boolean").repartition(3)
    got = sorted((tuple(r) for r in lattice.score(df, PATH, rounds=2, segment=segment).collect()), key=str)
    want = brute(rows, 2)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2])), sorted(want, key=lambda r: (str(r[0]), r[2])), strict=True):
        assert g[:5] == w[:5] and np.allclose(g[5:], w[5:], rtol=1e-9)
    assert lattice.score(none, PATH).count() == 0
    only_held = [(i, "some words") for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = lattice.score(spark.createDataFrame(only_held, "doc_id long, text string"), PATH).collect()
    assert len(got) == len(only_held) and all(r["n_known"] == 0 and r["base_score"] == 0 and r["score"] < 0 for r in got)


def test_long_texts_are_split_at_white_space(monkeypatch):
    monkeypatch.setattr(lattice, "CHUNK", 10)
    text = b"AB cd\x0b" * 20 + b"x" * 50 + b" e\x1cf \n"
    assert [w for some in lattice.words_of(text) for w in some] == text.lower().split()


def test_learning_helps_on_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    totals = [sum(r["score"] for r in lattice.score(docs, PATH, rounds=k).collect() if r["held_out"]) for k in (0, 1, 3)]
    assert totals[0] < totals[1] < totals[2]
