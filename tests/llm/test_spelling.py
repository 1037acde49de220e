"""Spelling variants against brute force over all pairs of words."""
import collections
import random
import re
import zlib

from tests.llm.conftest import odd_rows
from tidepanel.llm import spelling
from tidepanel.llm.common import Stage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def brute_words(rows):
    out = collections.Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    by_size = collections.defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_size[len(w) + k] if one_edit(v, w)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def result(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def made(rng, n):
    """Words over few letters and endings, their edits at all places, and one very long word with an edit."""
    out = {}
    while len(out) < n:
        w = "".join(rng.choice(["ab", "ti", "on", "a", "é", "z"]) for _ in range(rng.randint(3, 6))) + rng.choice(["", "tion", "ing", "ons"])
        for _ in range(rng.randint(1, 4)):
            i, kind = rng.randint(0, len(w)), rng.randint(0, 3)
            w = w if kind == 3 else w[:i] + rng.choice("abé") * (kind > 0) + w[i + (kind < 2):]
        if len(w) >= 6:
            out[w] = rng.choice([5, 6, 30, 200, 1000, 6000])
    out |= {"x" * 3000: 5, "x" * 2999: 30, "x" * 1500 + "y" + "x" * 1499: 200}
    return out


def test_pairs_and_forms(spark):
    rng = random.Random(31)
    for qmax, share in ((3, 1 / 200), (4, 1 / 1000), (6, 1 / 20000), (3, 1)):
        words = made(rng, 900)
        df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
        assert result(spelling.group(df, 5, qmax, share)) == brute(words)


def test_texts(spark, odd, none):
    rng = random.Random(37)
    base = list(made(rng, 150))[:150]
    rows = [(i, " ".join(rng.choice([w, w.upper(), w + "1", w.title()]) for w in rng.choices(base, k=60))) for i in range(400)] + [(None, " ".join(base * 2)), (3, None)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, word string, n int")
    assert result(spelling.variants(df)) == brute(brute_words(rows))
    assert result(spelling.variants(odd)) == brute(brute_words(odd_rows())) and result(spelling.variants(none)) == []


def test_nothing_is_broadcast(spark):
    # a table read from a file is taken to be as small as the file, whatever is made of it
    words = made(random.Random(41), 300)
    stored = Stage(spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(words.items())], "id long, word string, n long"), "words").df
    pairs = spelling.near(stored)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    text = list(words)
    assert sorted((text[r["id"]], text[r["other"]]) for r in pairs.collect()) == sorted((a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and one_edit(a, b))
    assert "Broadcast" not in spelling.group(stored.select("word", "n"))._jdf.queryExecution().executedPlan().toString()


def test_sql(spark, sf):
    from __spark_entry__ import oracle_sql, queries
    from tests.oracle_check import compare, connect
    name = "op13_spelling_variants"
    got, want = (d.astype({"form_n": "float64"}) for d in (queries()[name](spark, sf).toPandas(), connect(sf).execute(oracle_sql()[name]).df()))
    assert compare(got, want) == ""
