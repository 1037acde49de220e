"""Hash trees and their proofs against a plain implementation."""
import hashlib
import random
import zlib

import pytest

from tests.llm.conftest import odd_rows, prose
from tidepanel.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """Root, and for each node its (left, right) siblings level by level."""
    paths, at, owner = [[] for _ in nodes], nodes, list(range(len(nodes)))
    while len(at) > 1:
        for i, o in enumerate(owner):
            run = o // 3 * 3
            paths[i].append(("".join(at[run:o]), "".join(at[o + 1:run + 3])))
        at, owner = [h(*at[i:i + 3]) for i in range(0, len(at), 3)], [o // 3 for o in owner]
    return at[0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    enc = lambda vs: h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in vs])
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, enc(r))) for s in sources]
    climbed = [climb([enc(r) for r in g]) for g in groups]
    root, tops = climb([c[0] for c in climbed])
    out = []
    for g, (sub, paths), top in zip(groups, climbed, tops, strict=True):
        for r, path in zip(g, paths, strict=True):
            path = path + top
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            at = enc((*r[:4], r[4].replace("\n", ""))) if bad else enc(r)
            for left, right in path:
                at = h(left, at, right)
            out.append((r[0], enc(r), sub, root, h(*[a + b for a, b in path]), at, at == root))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in merkle.verify(df).collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, key string, idx long, n long"


@pytest.mark.parametrize("sizes", [[1], [3], [4, 1, 1], [730, 2, 28, 1], [2200, 3, 9, 27, 10]])
def test_trees_of_one_and_several_blocks(spark, sizes):
    rng = random.Random(sum(sizes))
    names = [None, "a", "é", "z", "B"]
    rows = [(0, names[k], rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "line\nline", prose(rng, 5)])) for k, n in enumerate(sizes) for _ in range(n)]
    rng.shuffle(rows)
    rows = [(i * 7 - 50, *r[1:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(*r, "x", 0, 0) for r in rows], SCHEMA).repartition(6)
    assert result(df) == brute(rows)
    got = {r["source"]: (r["n_rows"], r["root"]) for r in merkle.manifest(df).collect()}
    assert got == {names[k]: (n, brute(rows)[0][3]) for k, n in enumerate(sizes)}


def test_many_sources(spark):
    rows = [(i, f"s{i % 800}", "en", 1, f"text {i}") for i in range(1600)]
    assert result(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")) == brute(rows)


def test_odd_rows(spark, odd, none):
    assert result(odd) == brute([(i, "s", "en", 0, t) for i, t in odd_rows()])
    assert result(none) == [] and merkle.manifest(none).count() == 0
    every = [(None, None, None, None, None)] * 3 + [(1, None, None, None, "a\n")] * 2
    assert result(spark.createDataFrame([(*r, "x", 0, 0) for r in every], SCHEMA)) == brute(every)


def test_sql(spark, sf):
    from __spark_entry__ import oracle_sql, queries
    from tests.oracle_check import compare, connect
    name = "op12_merkle_manifest"
    assert compare(queries()[name](spark, sf).toPandas(), connect(sf).execute(oracle_sql()[name]).df()) == ""
