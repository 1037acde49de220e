"""Spelling variants: words one edit apart, found with an index of variable-length grams.

Words are runs of Latin letters, counted over all texts. A gram dictionary is built from them: every pair of letters, and
each longer gram (up to QMAX letters) that holds more than SHARE of all letter positions; so frequent pairs give way to longer
grams, and the dictionary has at most QMAX/SHARE entries whatever the vocabulary. A word is decomposed into the longest gram at each
place, without grams that lie inside an earlier one.

For every letter that an edit may take, the decomposition tells which grams it can affect: those whose choice looked at the
letter, and those after it that a new gram could swallow. All other grams stay, at the same distance from the word's
start or end. Posting lists are merged under that bound: a word is entered under each pair of its grams with a bounded gap
between them (together with the letters outside the gap), and looks up the pairs that flank its widest affected stretches,
once among words of its own length and once among those one letter shorter. What meets there differs within the gap only; gaps
one edit apart are kept, then verified on whole words.

Null texts have no runs; a null doc_id is the empty string in front of the colon of the deletion rule. Repeated rows count each time. An empty table
has no words. Of nearest words with equal n the smallest in code-point order is the form. Other columns are not read.
"""
from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.common import Stage

QMIN, QMAX = 2, 3
SHARE = 1 / 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MASK = (1 << 64) - 1


def vocabulary(docs: DataFrame, letters: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """(word, n) of words with at least ``letters`` letters and ``least`` occurrences.

    Where ``every`` divides h, the CRC-32 of ``doc_id:run``, the run loses its letter h modulo its length. Shorter runs cannot become words.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{letters},}}"), F.lit(0))).alias("run"))
    low = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    runs = runs.select("id", low.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


class Dictionary:
    """Longer grams that are frequent; a pair of letters is always a gram."""

    def __init__(self, grams: list[str], qmax: int = QMAX):
        self.qmax = qmax
        self.grams = frozenset(grams)
        self.stems = frozenset(g[:-1] for g in grams)
        self.inner = frozenset(g[a:b] for g in grams for a in range(1, len(g)) for b in range(a + 1, len(g) + 1))

    def decompose(self, word: str) -> tuple[list[int], list[int], list[int]]:
        """First and last letter of each gram, and for every place the last letter that the choice of its gram has looked at."""
        first, last, seen, covered = [], [], [], -1
        for p in range(len(word)):
            if p + QMIN > len(word):
                seen.append(p + QMIN - 1)
                continue
            d = QMIN
            while word[p:p + d] in self.stems and word[p:p + d + 1] in self.grams and p + d < len(word):
                d += 1
            seen.append(p + d if word[p:p + d] in self.stems else p + d - 1)
            if p + d - 1 > covered:
                covered = p + d - 1
                first.append(p)
                last.append(covered)
        return first, last, seen

    def affected(self, word: str, first: list[int], last: list[int], seen: list[int]) -> list[tuple[int, int]]:
        """Widest stretches of grams that one replaced or deleted letter can affect, as (grams before it, first gram after it).

        Grams before place ``p`` stay, where p is the first place whose choice looked at the letter (at most QMAX - 1 places before it). After the
        letter, a gram stays unless some dictionary gram could reach from the letter over its end: less than QMAX letters.
        So at most 2 QMAX - 1 letters lie between the grams that stay, the letter included.
        """
        found: list[tuple[int, int]] = []
        for i in range(len(word)):
            p = next(p for p in range(max(0, i - self.qmax), i + 1) if seen[p] >= i)
            a = bisect_left(first, p)
            b = bisect_right(first, i)
            while b < len(first) and word[i + 1:last[b] + 1] in self.inner:
                b += 1
            while found and found[-1][0] >= a and found[-1][1] <= b:
                found.pop()
            if not found or a > found[-1][0] or b > found[-1][1]:
                if not (found and found[-1][0] <= a and found[-1][1] >= b):
                    found.append((a, b))
        return found


def sides(word: str) -> tuple[list[int], list[int]]:
    """Checksums of the letters before and from each place on."""
    head, tail = [0], [0]
    for c in word:
        head.append(zlib.crc32(c.encode(), head[-1]))
    for c in reversed(word):
        tail.append(zlib.crc32(c.encode(), tail[-1]))
    return head, tail[::-1]


def postings(dictionary: Dictionary, word: str, lookup: bool) -> Iterator[tuple[int, int, str]]:
    """(key, length of the words meant, letters of the gap): entries of a word, or what it looks up."""
    first, last, seen = dictionary.decompose(word)
    ends, starts, size = [0, *(e + 1 for e in last)], [*first, len(word)], len(word)
    head, tail = sides(word)
    if lookup:
        for a, b in dictionary.affected(word, first, last, seen):
            lo, hi = ends[a], starts[b]
            for target in (size, size - 1):
                yield head[lo] << 32 | tail[hi], target, word[lo:hi]
    else:
        for lo in ends:
            for hi in starts[bisect_left(starts, lo):bisect_right(starts, lo + 2 * dictionary.qmax - 1)]:
                yield head[lo] << 32 | tail[hi], size, word[lo:hi]


def _keys(words: DataFrame, dictionary: Dictionary, lookup: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            mixed = (np.array(keys, np.uint64) ^ np.array(sizes, np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(mixed), pa.array(owners, pa.int64()), pa.array(shorter, pa.bool_()), pa.array(gaps, pa.string())],
                                              ["key", "id", "shorter", "gap"])
        keys, sizes, owners, shorter, gaps = [], [], [], [], []
        for batch in batches:
            for i, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
                for key, size, gap in postings(dictionary, word, lookup):
                    keys.append(key)
                    sizes.append(size)
                    owners.append(i)
                    shorter.append(size < len(word))
                    gaps.append(gap)
                    if len(keys) >= 50_000:
                        yield flush()
                        keys, sizes, owners, shorter, gaps = [], [], [], [], []
        if keys:
            yield flush()
    return words.select("id", "word").mapInArrow(run, "key long, id long, shorter boolean, gap string")


def gram_dictionary(words: DataFrame, qmax: int = QMAX, share: float = SHARE) -> Dictionary:
    """Longer grams with more than ``share`` of all letter positions: at most (qmax - QMIN) / share of them, so they may pass through the driver."""
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    sizes = F.sequence(F.lit(QMIN + 1), F.lit(qmax))
    grams = F.flatten(F.transform(sizes, lambda q: F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - q + 1, F.lit(1))), lambda p: F.substring("word", p, q))))
    counted = words.select(F.explode(grams).alias("gram")).where(F.length("gram") > QMIN).groupBy("gram").count().where(F.col("count") > total * share)
    return Dictionary([r["gram"] for r in counted.collect()], qmax)


def _sorted(df: DataFrame) -> DataFrame:
    """The right side of a join that is never broadcast: Spark goes by the compressed file of the words, of which keys and entries are many times as large."""
    return df.hint("merge")


def near(words: DataFrame, qmax: int = QMAX, share: float = SHARE) -> DataFrame:
    """(id, other): all ordered pairs of ``words`` (id, word) that differ by one inserted, deleted or replaced letter."""
    dictionary = gram_dictionary(words, qmax, share)
    entries = _keys(words, dictionary, False).select("key", F.col("id").alias("other"), F.col("gap").alias("met"))
    asked = _keys(words, dictionary, True)
    met = asked.join(_sorted(entries), (asked["key"] == entries["key"]) & (F.levenshtein("gap", "met", 1) == 1))
    both = F.when(F.col("shorter"), F.array(F.struct("id", "other"), F.struct(F.col("other").alias("id"), F.col("id").alias("other")))).otherwise(F.array(F.struct("id", "other")))
    pairs = met.select(F.explode(both).alias("p")).select("p.id", "p.other").distinct()
    text = words.select("id", "word")
    pairs = pairs.join(_sorted(text), "id").join(_sorted(text.select(F.col("id").alias("other"), F.col("word").alias("other_word"))), "other")
    return pairs.where(F.levenshtein("word", "other_word", 1) == 1).select("id", "other")


def _roots(links: DataFrame) -> DataFrame:
    """(id, root) of (id, form): every round doubles the steps; n grows fivefold a step, so six rounds are enough for any long."""
    at = Stage(links.select("id", F.col("form_id").alias("root")), "roots").df
    for _ in range(6):
        onward = at.select(F.col("id").alias("root"), F.col("root").alias("onward"))
        moved = Stage(at.join(_sorted(onward), "root", "left").select("id", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots").df
        at = moved.select("id", "root")
        if moved.where("moved").isEmpty():
            break
    return at


def group(vocabulary: DataFrame, ratio: int = 5, qmax: int = QMAX, share: float = SHARE) -> DataFrame:
    """Form, root and near-word count of every word of a vocabulary (word, n).

    The form is the near word of largest n, if that is at least ``ratio`` times the word's own.
    """
    words = Stage(vocabulary.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "words").df
    other = words.select(F.col("id").alias("other"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    best = near(words, qmax, share).join(_sorted(other), "other").groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form", F.col("other").alias("form_id"))).alias("b"))
    held = F.when(-F.col("b.m") >= ratio * F.col("n"), F.col("b"))
    found = Stage(words.join(_sorted(best), "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), held["form"].alias("form"), (-held["m"]).alias("form_n"), held["form_id"].alias("form_id")), "forms").df
    roots = _roots(found.where("form_id is not null")).join(_sorted(words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))), "root").select("id", "root_word")
    return found.join(_sorted(roots), "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """Spelling variants of all words of the texts."""
    return group(vocabulary(docs))


_HEX = "hex(encode(doc_id || ':' || r))"
_CRC = (f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, length({_HEX}) // 2), lambda i: [('0x' || substr({_HEX}, 2 * i + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))::BIGINT[]), "
        "lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)")
SQL = f"""WITH RECURSIVE run AS (SELECT doc_id, translate(r, '{UPPER}', '{LOWER}') AS r, count(*) AS c
    FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{6,}}')) AS r FROM documents) GROUP BY ALL),
  hashed AS (SELECT r, c, {_CRC} AS h FROM run),
  words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, sum(c)::BIGINT AS n FROM hashed GROUP BY 1 HAVING sum(c) >= 5 AND length(word) >= 6),
  cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
  pairs AS (SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word),
  best AS (SELECT p.word, count(*) AS n_near, first(struct_pack(w := p.other, n := o.n) ORDER BY o.n DESC, p.other) AS b FROM pairs p JOIN words o ON o.word = p.other GROUP BY p.word),
  found AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 5 * w.n THEN b.w END AS form, CASE WHEN b.n >= 5 * w.n THEN b.n END AS form_n FROM words w LEFT JOIN best USING (word)),
  steps AS (SELECT word, word AS at FROM found UNION ALL SELECT s.word, f.form FROM steps s JOIN found f ON f.word = s.at WHERE f.form IS NOT NULL)
  SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM found f JOIN steps s ON s.word = f.word JOIN found g ON g.word = s.at WHERE g.form IS NULL"""
