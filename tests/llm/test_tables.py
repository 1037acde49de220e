"""Operators across rows against brute force on small fixtures."""
import collections
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tests.llm.conftest import odd_rows, prose, sha
from tidepanel.llm import curves, licences, neardup, packing, repeats, tokencount

WORD = re.compile("[^\x20\x09-\x0d]+")


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def copies(spark):
    """Families of near copies around the threshold, exact copies, a line and a passage that many documents share."""
    rng = random.Random(11)
    line, passage = prose(rng, 9), prose(rng, 40)
    texts = [t for k in range(12) for t in family(rng, prose(rng, rng.choice([12, 40, 150])), 12, rng.choice([1, 2, 5]))]
    texts += family(rng, prose(rng, 60), 60, 3) + [texts[0]] * 5 + [line + "\n" + prose(rng, rng.randint(1, 30)) for _ in range(80)]
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(40)] + [prose(rng, 30) for _ in range(50)]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def brute_classes(rows):
    bags = {i: collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) for i, t in rows if (w := WORD.findall(t or ""))}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(bags, 2):
        common = sum((bags[i] & bags[j]).values())
        if 5 * common >= 4 * (sum(bags[i].values()) + sum(bags[j].values()) - common):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def test_near_duplicate_classes(spark, copies, odd, none):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    want = brute_classes(copies)
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()} == want
    kept = neardup.keep_one(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert neardup.classes(odd).count() == odd.count() and neardup.classes(none).count() == 0
    got = neardup.keep_one(odd)
    assert got.columns == odd.columns and collections.Counter(r["doc_id"] for r in got.collect())[7] == 0
    assert got.where("doc_id is null").count() == 1 and neardup.keep_one(none).count() == 0


def test_unrelated_rows_of_one_id_stay(spark):
    rng = random.Random(17)
    x, y, z = (prose(rng, 40) for _ in range(3))
    rows = [(5, x, "p"), (5, y, "q"), (5, x, "r"), (8, y, "s"), (9, z, "t"), (9, None, "u"), (None, x, "v")]
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(3)).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter([(5, x), (5, y), (9, z), (9, None), (None, x)])


def test_signatures_estimate_weighted_likeness():
    rng = np.random.default_rng(0)
    names = rng.integers(0, 2**63, 60, dtype=np.uint64)
    x, y = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    h, t, w = np.concatenate([names, names]), np.repeat([0, 1], 60), np.concatenate([x, y])
    sig = neardup.signatures(h[w > 0], t[w > 0], w[w > 0], 2, 20_000)
    assert abs(np.mean(sig[0] == sig[1]) - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.015


def brute_repeats(rows, window):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] != i:
                gone[k:k + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def repeated():
    rng = random.Random(13)
    passages = [prose(rng, n) for n in (13, 14, 20, 60)] + ["a " * 15, "x y " * 9, "a a a b " * 6, " ".join("aabbccdd" * 2)]
    rows = []
    for i in range(300):
        parts = [prose(rng, rng.randint(0, 15)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), rng.choice(passages))
        if rng.random() < 0.2:
            parts.append(" ".join(rng.choice("ab") for _ in range(40)))
        rows.append((i * 2, rng.choice([" ", "\n", "\t \n"]).join(parts)))
    return rows


@pytest.mark.parametrize(("names", "segment", "window"), [(2_000_000, 8 << 20, 13), (200, 4000, 13), (50, 900, 20)])
def test_repeated_passages(spark, repeated, monkeypatch, names, segment, window):
    monkeypatch.setattr(repeats, "RANGE_NAMES", names)
    monkeypatch.setattr(repeats, "SEGMENT_BYTES", segment)
    df = spark.createDataFrame(repeated, "doc_id long, text string").repartition(4)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.kept_words(df, window).collect()), key=str)
    assert got == brute_repeats(repeated, window)


def test_words_of_the_same_polynomial_are_told_apart(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{word} {tail}"), (2, f"{other} {tail}"), (3, f"{word} {tail}")]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.kept_words(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_repeats(rows, 13) and [r[2] for r in got] == [0, 0, 13]


def test_cutting_keeps_the_rest(spark, repeated, odd, none):
    rows = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.kept_words(odd).collect()]
    assert sorted(rows, key=str) == brute_repeats(odd_rows(), 13)
    df = spark.createDataFrame([(i, t, 0) for i, t in repeated], "doc_id long, text string, n_chars int")
    texts, want = dict(repeated), {r[0]: r for r in brute_repeats(repeated, 13)}
    for r in repeats.cut(df).collect():
        assert sha(" ".join(WORD.findall(r["text"]))) == want[r["doc_id"]][3] and r["n_chars"] == len(r["text"])
        assert want[r["doc_id"]][2] or r["text"] == texts[r["doc_id"]]
    assert repeats.cut(odd).schema == odd.schema and repeats.cut(none).count() == 0 and repeats.kept_words(none).count() == 0
    with pytest.raises(ValueError):
        repeats.kept_words(odd, 12)


def test_words_cost_what_the_tokenizer_says():
    rng = random.Random(5)
    ids = packing.word_ids(P.path("word_bpe_49k.json"))
    pieces = ["a", "B", "  ", "\n", "é", "é", "漢", "'s", "'T", "1", "12", ",;.", "A\x1c", "\x1d", "\x85", "\xa0", " ", "　", "🙂", "İ", "Σ", "ß", "́", "<|endoftext|>", "​", "﻿", "\x00"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + [t or "" for _, t in odd_rows()]
    want = ids.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.encode(texts)] == [e.ids for e in want]


def test_markers_in_texts_are_the_ids_of_the_library(spark):
    from tokenizers import Tokenizer
    path, rng = P.path("word_bpe_49k.json"), random.Random(23)
    library = Tokenizer.from_file(path)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<", "a", "Dog's", " ", "\n", "é", "漢", "1", "Σ", "\x1c"]
    texts = ["a<|endoftext|>b", "<|endoftext|>", "é<|startoftext|>"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(500)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [320, 49407, 321]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.word_ids(path).encode(texts)] == want
    rows = {r["doc_id"]: r for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    assert [(rows[i]["length"], rows[i]["ids_crc32"]) for i in range(len(texts))] == [(len(w) + 1, zlib.crc32(np.array([*w, 1], "<u4").tobytes())) for w in want]
    library.encode_special_tokens = True  # in flat files the marker is the separator, so there it is spelled out
    counts = tokencount.count_documents(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, 49407)
    assert {r["doc_id"]: r["n_tokens"] for r in counts.collect()} == {i: len(e.ids) for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False))}


def check_packing(rows, docs, size):
    tokens = packing.word_ids(P.path("word_bpe_49k.json")).tokenizer
    want = collections.Counter()
    for _, t in docs:
        ids = [*tokens.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), size)):
            some = ids[at:at + size]
            want[_, k, at, len(some), zlib.crc32(np.array(some, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return len(filled)


def test_packing_is_whole_and_tight(spark, odd, none):
    rng = random.Random(17)
    docs = [(i, prose(rng, rng.choice([3, 20, 60, 100, 150, 300]))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = packing.pack(df, P.path("word_bpe_49k.json"), 512).collect()
    room: list[int] = []
    for n in sorted((r["length"] for r in rows), reverse=True):  # first fit, largest first
        at = next((i for i, free in enumerate(room) if free >= n), None)
        if at is None:
            room.append(512 - n)
        else:
            room[at] -= n
    assert check_packing(rows, docs, 512) <= len(room) + 1
    check_packing(packing.pack(odd, P.path("word_bpe_49k.json")).collect(), odd_rows(), 4096)
    assert packing.pack(none, P.path("word_bpe_49k.json")).count() == 0


def test_plans_place_every_piece():
    rng = random.Random(19)
    for _ in range(12):
        counts = collections.Counter(rng.choice([rng.randint(1, 1000), rng.randint(300, 600), 1000]) for _ in range(rng.randint(1, 3000)))
        for groups in (0, 5, 16):
            runs, n = packing.plan(dict(counts), 1000, groups)
            fill, placed = collections.defaultdict(list), collections.Counter()
            for length, a, b, first, offset, per in runs:
                for r in range(b - a):
                    fill[first + r // per].append((offset + r % per * length, length))
                placed[length] += b - a
            assert placed == counts and set(fill) == set(range(n))
            for parts in fill.values():
                end = 0
                for offset, length in sorted(parts):
                    assert offset == end
                    end += length
                assert end <= 1000


def test_hilbert_curve_is_a_walk():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    path = cells[np.argsort(curves.hilbert(cells, 3))]
    assert len(set(curves.hilbert(cells, 3).tolist())) == 512 and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def brute_neighbours(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) and len(v) == 16]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            out[i] = [j for _, j in sorted((-float(v @ u), j) for j, u in good if j != i)[:k]]
    return out


def test_nearest_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    vectors = [centres[i % 30] + 0.2 * rng.normal(size=16) for i in range(1500)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(5000 + i, rows[40][1]) for i in range(80)] + [(3000, None), (3020, [0.0] * 16), (3040, [1.0, None] * 8), (3060, [float("nan")] * 16), (3080, [1.0] * 3), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, rank int, score double")
    want = brute_neighbours(rows, 20)
    for block, floor in ((2048, 1.0), (128, 0.9)):
        monkeypatch.setattr(curves, "BLOCK", block)
        got = collections.defaultdict(list)
        for r in curves.search(df).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        assert set(got) == set(want) and all([x[0] for x in g] == list(range(1, 21)) for g in got.values())
        assert np.mean([len({x[1] for x in got[q]} & set(want[q])) / 20 for q in want]) >= floor
        vec = dict(rows)
        assert all(abs(s - float(np.dot(vec[q], vec[j]))) < 1e-12 for q in got for _, j, s in got[q])
    assert curves.search(df.limit(0)).count() == 0
    few = {r["vec_id"] for r in curves.search(df.where("vec_id in (0, 1, 2)")).collect()}
    assert few == {1, 2}


def test_licences(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "code without any"), ("a/b/COPYING", "intro\nThis work is licensed under the GNU General Public License, version 3."),
             ("a/b/c/y.py", "Licensed under CC BY-NC 4.0.\nmore text here and there, as files of code have much of it"), ("z/x.py", None), ("z/y.py", ""), ("a/x", "the MIT people have a license to be released under water some day"), (None, "x"), ("top", "text"), ("a/x", "twice")]
    files += [(f"f/{i}", prose(random.Random(i), 40)) for i in range(50)]
    df = spark.createDataFrame([(*f, 1.0) for f in files], "path string, text string, score double")
    got = {r["path"]: (r["licence"], r["origin"], r["inherited_from"]) for r in licences.scan(df).collect()}
    assert got["a/LICENSE"] == ("MIT", "own", None) and got["a/b/c/x.py"] == ("GPL-3.0", "inherited", "a/b") and got["a/b/c/y.py"] == ("CC-BY-NC-4.0", "own", None)
    assert got["a/x"] == ("MIT", "inherited", "a") and got["z/x.py"] == got["z/y.py"] == got["top"] == got["f/7"] == (None, "none", None)
    assert len(got) == len({p for p, _ in files if p})
    assert licences.scan(df.limit(0)).count() == 0
    plan = licences.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_runs(files):
    """Best (score, licence) of every line and every run of a template's number of words."""
    words = {p: re.findall("[a-z0-9]+", (t or "").lower()) for p, t in files}
    df, n = collections.Counter(w for ws in words.values() for w in set(ws)), len(files)
    vocabulary = {w for _, t in licences.TEMPLATES for w in re.findall("[a-z0-9]+", t.lower())}
    square = lambda ws: sum(np.log((1 + n) / (1 + df[w] * (w in vocabulary))) ** 2 for w in set(ws))
    out = {}
    for p, text in files:
        units = [re.findall("[a-z0-9]+", x.lower()) for x in (text or "").split("\n")]
        scores = []
        for name, t in licences.TEMPLATES:
            t = re.findall("[a-z0-9]+", t.lower())
            for u in units + [words[p][i:i + len(t)] for i in range(max(1, len(words[p]) - len(t) + 1))]:
                if common := set(u) & set(t):
                    scores.append((-round(square(common) / np.sqrt(square(u) * square(t)), 6), name))
        best = min(scores, default=(0, None))
        out[p] = (best[1], -best[0]) if -best[0] >= licences.THRESHOLD else None
    return out


def test_notices_inside_lines_and_across_breaks(spark):
    rng = random.Random(29)
    notices = [t for _, t in licences.TEMPLATES]
    files = [("h/1", "Copyright (c) X. All rights reserved. Licensed under the MIT License. See LICENSE in the project root for license information."),
             ("h/2", prose(rng, 300) + " " + notices[0] + " " + prose(rng, 300)), ("h/3", prose(rng, 20) + "\n// This program is free software: you can redistribute it\n// and/or modify it under the terms of\n// the GNU General Public License as\n// published by the Free Software Foundation\n" + prose(rng, 90)),
             ("w/1", "Released under\nthe MIT\nLicense."), ("w/2", "text"), ("v/1", "see the license of the software in version two of the terms"), ("v/2", "Released MIT")]
    for i in range(150):  # whole and damaged notices anywhere, at both ends and around the edges of stretches
        kept = " ".join(w for w in rng.choice(notices).split() if rng.random() < rng.choice([0.7, 1]))
        files.append((f"r{i}/x", prose(rng, rng.randint(0, 70)) + rng.choice([" ", "\n"]) + kept + rng.choice([" ", "\n", ""]) + prose(rng, rng.randint(0, 70))))
    files += [(f"f/{i}", prose(rng, 40)) for i in range(50)]
    rows = {r["path"]: r for r in licences.scan(spark.createDataFrame(files, "path string, text string").repartition(3)).collect()}
    assert {p: (r["licence"], round(r["score"], 6)) if r["origin"] == "own" else None for p, r in rows.items()} == brute_runs(files)
    assert [rows[p]["licence"] for p in ("h/1", "h/2", "h/3", "w/1")] == ["MIT", "Apache-2.0", "GPL-3.0", "MIT"]
    assert (rows["w/2"]["origin"], rows["w/2"]["licence"]) == ("inherited", "MIT") and rows["f/7"]["origin"] == "none"


def test_licences_of_rows_without_and_with_repeated_ids(spark, odd, tmp_path):
    from tidepanel.llm import queries
    more = [(None, "Licensed under CC BY-SA 4.0."), (None, "plain words"), (None, "plain words"), (8, "Licensed under CC BY-NC 4.0.\n" + "plain " * 40), (8, None)]
    rows = odd.union(spark.createDataFrame([(i, t, "en", "s", 0, 0, "x", 1.0) for i, t in more], odd.schema))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op2_licences"](spark, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in odd_rows() + more)
    said = collections.Counter((r["doc_id"], r["licence"], r["origin"]) for r in got)
    assert said[None, "CC-BY-SA-4.0", "own"] == 1 and said[None, "CC-BY-SA-4.0", "inherited"] == 3
    assert said[8, "CC-BY-NC-4.0", "own"] == 1 and said[8, None, "none"] == 2 and said[7, None, "none"] == 2
    assert {r["path"] for r in got if r["doc_id"] is None} == {"s/en/-/-"} and {r["path"] for r in got if r["doc_id"] == 8} == {"s/en/0/8"}


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline as c
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = c.run(spark, sf).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    classes = brute_classes(sorted(text.items()))
    kept = {i for i, c_ in classes.items() if i == c_ and any(x.isalpha() for x in text[i])}
    assert {r["doc_id"] for r in out} == kept and [n for n, _ in c.STAGES] == ["language", "near_duplicates", "substrings", "secrets", "packing"]
    for name, stage in c.STAGES[:-1]:
        assert stage(spark, docs, sf).schema == docs.schema, name
