"""Operators on single texts against brute force and other libraries."""
import base64
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.conftest import odd_rows, prose, sha
from tidepanel.llm import bpe, fingerprints as fp, langid, secrets, tokencount

MULTI = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(MULTI, P.PATTERN)


def test_encoding_is_that_of_the_library(own, library):
    rng = random.Random(5)
    for _ in range(1500):
        s = "".join(rng.choice("ab  \n\t é漢'st1,;.A\x1c\xa0🙂") for _ in range(rng.randint(0, 40)))
        assert own.encode(s) == library.encode_ordinary(s), repr(s)
    for _, t in odd_rows():
        assert own.encode(t or "") == library.encode_ordinary(t or "")


def test_neighbours_fit_as_the_merges_say(own):
    rng, b = random.Random(1), own.bpe
    for _ in range(4000):
        x, y = rng.randrange(50256), rng.randrange(50256)
        assert b.fits(x, y) == (b.merged(b.tokens[x] + b.tokens[y]) == [x, y])


def test_appends_and_edits_agree_with_encoding_anew(own):
    rng, b = random.Random(2), own.bpe
    for _ in range(300):
        data = bytes(rng.choice(b"thersionand") for _ in range(rng.randint(1, 300)))
        last = b.extend(data[:len(data) // 2], [0])
        assert b.extend(data, last) == b.extend(data, [0])
        i = rng.randint(0, len(data))
        j = rng.randint(i, len(data))
        changed, got = b.edit(data, last, i, j, bytes(rng.choice(b"the in") for _ in range(rng.randint(0, 9))))
        assert got == b.extend(changed, [0])
        assert b.decode(b.tokens_of(changed, got)) == changed


def test_bpe_rows(odd, none, library):
    rows = bpe.encode(odd, MULTI, P.PATTERN)
    texts = sorted((t or "") for _, t in odd_rows())
    got = sorted((r["decoded_sha256"], r["n_tokens"], r["ids_sha256"]) for r in rows.collect())
    ids = [library.encode_ordinary(t) for t in texts]
    assert got == sorted((sha(t), len(i), sha(",".join(map(str, i)))) for t, i in zip(texts, ids))
    back = {r["doc_id"]: bytes(r["data"]) for r in bpe.decode(rows, MULTI, P.PATTERN).collect()}
    assert back[9].decode() == dict(odd_rows())[9]
    assert bpe.encode(none, MULTI, P.PATTERN).count() == 0


def spans(text):
    return sorted((m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, text, r.flags) if m.end(r.group) - m.start(r.group) >= r.least)


def test_secrets_like_plain_regexes(spark, odd, none):
    rng = random.Random(1)
    bits = ["pass", "word", "token", "API_KEY", "apikey", "=", ": ", ' "', "'", "AKIA", "abcdef012", "ABCD1234", "é", "x", " ", "ghp_", "a" * 36, "xoxb-", "-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefgh.", "ſecret"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = [r.kind for r in secrets.RULES]
    for r in secrets.digests(df).collect():
        want = spans(texts[r["doc_id"]])
        assert r["spans"] == ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == sha(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in want if k < 3))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[1] == k for x in want) for k in range(3))
    for r in secrets.scan(df).limit(50).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == [(kinds[k], s, e) for s, k, e in spans(texts[r["doc_id"]])]
    masked = secrets.redact(df)
    assert masked.columns == df.columns and masked.count() == len(texts)
    assert secrets.digests(odd).count() == odd.count() and secrets.digests(none).count() == 0
    red = secrets.redact(odd)
    assert red.schema == odd.schema and red.where("text is null").count() == 1


def test_trigram_queries_are_necessary():
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigram_query("abc?d") == ("or", (("and", (b"abc", b"bcd")), b"abd"))
    rng = random.Random(4)
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern, rule.flags)

        def holds(q, text):
            return q is True or (q in text if isinstance(q, bytes) else (all if q[0] == "and" else any)(holds(p, text) for p in q[1]))

        for text in ("API_key = 'abcdef'", "secret:zzzzzzz", "AKIA" + "B" * 20, "-----BEGIN PRIVATE KEY-----", "ghp_" + "x" * 40, "xoxa-1234567890", "AIza" + "q" * 35):
            if re.search(rule.pattern, text, rule.flags):
                assert holds(query, text.lower().encode())


def test_fingerprints_add_up_in_any_order():
    a, b = "one two three four\nfive six seven", "eight nine ten\nfive six seven"
    x, y = fp.fingerprint([a]), fp.fingerprint([b])
    both = fp.fingerprint([b + "\n" + a])
    assert (fp.insert(x, y) == both).all() and (fp.delete(both, y) == x).all()
    assert (fp.fingerprint(["five six seven\none two three four"]) == x).all()
    assert fp.likeness(x, x)[0] == 1 and 0 < fp.likeness(x, y)[0] < 1
    assert fp.likeness(fp.fingerprint([""]), x)[0] == 0


def test_edited_fingerprints(spark, odd, none, monkeypatch):
    rng = random.Random(7)
    rows = [(i, t) for i, t in odd_rows() if i is not None and i != 7] + [(100 + i, prose(rng, rng.randint(0, 80))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        want[i] = (len(t), sha(e), fp.fingerprint([t])[0].tobytes().hex(), fp.fingerprint([e])[0].tobytes().hex(), fp.likeness(fp.fingerprint([t]), fp.fingerprint([n]))[0])
    for size in (8_000_000, 3000):  # one range, many ranges
        monkeypatch.setattr(fp, "RANGE_CHARS", size)
        got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_next"]) for r in fp.edited(df).collect()}
        assert got == want
    assert fp.edited(odd).count() == odd.count() and fp.edited(none).count() == 0
    one = fp.edited(df.where("doc_id = 4")).first()
    assert one["edited_sha256"] == sha("wowo") and one["near_next"] == 1
    assert fp.compute(odd).count() == odd.count()


def phrases(sample: str, text: str) -> int:
    """Greedy parse in blocks, by searching the sample."""
    parsed, sample = 0, sample
    for at in range(0, len(text), langid.BLOCK):
        block, i = text[at:at + langid.BLOCK], 0
        while i < len(block):
            n = 1
            while i + n < len(block) and block[i:i + n + 1] in sample:
                n += 1
            i, parsed = i + n, parsed + 1
    return parsed


def test_phrases_are_longest_matches():
    rng = random.Random(9)
    model = langid.build({"a": prose(rng, 300), "b": "zwölf boxkämpfer jagen viktor quer über den großen sylter deich " * 3})
    samples = {"a": "".join(map(chr, langid.points(prose(random.Random(9), 300)))), "b": "".join(map(chr, langid.points("zwölf boxkämpfer jagen viktor quer über den großen sylter deich " * 3)))}
    for text in (prose(rng, 500), "über den großen deich", "漢字 text", "A1b2", "x"):
        said = "".join(map(chr, langid.points(text)))
        cost = {k: phrases(samples[k], said) * np.log2(len(samples[k])) for k in samples}
        assert model.parse([text])[0][0] == min(sorted(cost), key=cost.get)


def test_languages_held_out(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in truth if got[i]["held_out"]]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd).collect()}
    assert [out[i] for i in (1, 2, 3, 5)] == ["und"] * 4 and out[6] == "en"
    assert langid.identify(none).count() == 0
    kept = langid.accepted(odd)
    assert kept.schema == odd.schema and kept.count() == odd.count() - 4


def test_token_counts(odd, none, monkeypatch):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = sorted(size(t) for _, t in odd_rows())
    for block, level in ((1 << 20, 4096), (64, 4)):
        monkeypatch.setattr(tokencount, "LEVEL", level)
        count = tokencount.count
        monkeypatch.setattr(tokencount, "count", lambda *a, block=block, count=count: count(*a, block=block))
        rows = tokencount.count_documents(odd.sparkSession, odd, path, 49407).collect()
        monkeypatch.setattr(tokencount, "count", count)
        assert sorted(r["n_tokens"] for r in rows) == want
        assert {r["doc_id"]: r["n_tokens"] for r in rows}[6] == size(dict(odd_rows())[6])
    assert tokencount.count_documents(none.sparkSession, none, path, 49407).count() == 0


def test_registered_token_counts_are_those_of_the_byte_tokenizer(odd, tmp_path):
    from tidepanel.llm import queries
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = [(70, "a<|endoftext|>b"), (71, "  \n\n "), (72, "UPPER lower")]
    rows = odd.union(odd.sparkSession.createDataFrame([(i, t, "en", "s", 0, 0, "x", 1.0) for i, t in more], odd.schema))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op7_token_counts"](odd.sparkSession, str(tmp_path)).collect()
    want = [(i, len(library.encode_ordinary(t or ""))) for i, t in odd_rows() + more]
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=str) == sorted(want, key=str)


def test_unlabelled_texts_are_accepted(odd):
    from pyspark.sql import functions as F
    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = langid.accepted(bare)
    assert kept.schema == bare.schema and kept.count() == odd.count() - 4
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in odd_rows()} - {1, 2, 3, 5}


def test_words_that_come_back_are_encoded_once():
    from tidepanel.llm.bpe import Chunks
    made = []
    memo = Chunks(lambda word: made.append(word) or word)
    words = [f"w{i}" for i in range(350_000)]
    assert all(memo(w) == w for _ in range(2) for w in words) and len(made) == len(words)
