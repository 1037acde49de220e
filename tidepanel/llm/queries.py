"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL where there is any."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.core.session import ship
from tidepanel.llm.merkle import SQL as merkle_sql
from tidepanel.llm.spelling import SQL as spelling_sql

BYTE_MULTI = "byte_bpe_multi_50k.tiktoken"
BYTE, END_OF_TEXT = "byte_bpe_50k.tiktoken", 50256
WORD = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_bpe(spark, sf_dir):
    """Byte-level BPE ids of every whole text and what they decode to, as digests."""
    from tidepanel.llm import bpe
    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path(BYTE_MULTI), public_tokenizers.PATTERN, with_ids=False)


@query
def op6_secret_scan(spark, sf_dir):
    """Secrets of every whole text."""
    from tidepanel.llm import secrets
    return secrets.digests(documents(spark, sf_dir))


@query
def op10_substring_dedup(spark, sf_dir):
    """Words of every whole text outside 13-word passages that a smaller document has too."""
    from tidepanel.llm import repeats
    return repeats.kept_words(documents(spark, sf_dir))


@query
def op5_near_dups(spark, sf_dir):
    """Class of near-duplicates of every document."""
    from tidepanel.llm import neardup
    return neardup.classes(documents(spark, sf_dir))


@query
def op3_language_id(spark, sf_dir):
    """Language of every whole text."""
    from tidepanel.llm import langid
    return langid.identify(documents(spark, sf_dir))


@query
def op4_fingerprints(spark, sf_dir):
    """Multiset fingerprints of every text and of its edited text."""
    from tidepanel.llm import fingerprints
    return fingerprints.edited(documents(spark, sf_dir))


@query
def op7_token_counts(spark, sf_dir):
    """Token counts of all documents, found by scanning flat token files."""
    from tidepanel.llm import tokencount
    return tokencount.count_documents(spark, documents(spark, sf_dir), public_tokenizers.path(BYTE), END_OF_TEXT, public_tokenizers.PATTERN)


@query
def op8_best_fit_packing(spark, sf_dir):
    """All documents in sequences of at most 4096 tokens."""
    from tidepanel.llm import packing
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(WORD))


@query
def op9_nearest_vectors(spark, sf_dir):
    """The 20 nearest vectors of every twentieth."""
    from tidepanel.llm import curves
    return curves.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op12_merkle_manifest(spark, sf_dir):
    """Leaf, subroot, root, proof and check of every document."""
    from tidepanel.llm import merkle
    return merkle.verify(documents(spark, sf_dir))


ORACLES["op12_merkle_manifest"] = merkle_sql


@query
def op13_spelling_variants(spark, sf_dir):
    """Nearest and last more frequent spelling of every word of all texts."""
    from tidepanel.llm import spelling
    return spelling.variants(documents(spark, sf_dir))


ORACLES["op13_spelling_variants"] = spelling_sql


@query
def op11_lattice_scores(spark, sf_dir):
    """Word-model and subword-lattice scores of every whole text."""
    from tidepanel.llm import lattice
    return lattice.score(documents(spark, sf_dir), public_tokenizers.path(PIECES))


#: The place of a document in a tree of folders: source, language, hundred.
DOCUMENT_PATH = "concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), coalesce(cast(floor(doc_id / 100) as string), '-'), coalesce(cast(doc_id as string), '-'))"
#: What tells rows apart that share an id or have none; rows that are alike in all share one file.
ROW_FILE = f"concat({DOCUMENT_PATH}, '#', hex(xxhash64(text)))"


@query
def op2_licences(spark, sf_dir):
    """Licence of every document, its own or that of the nearest folder."""
    from tidepanel.llm import licences
    docs = documents(spark, sf_dir).select("doc_id", F.expr(DOCUMENT_PATH).alias("path"), F.expr(ROW_FILE).alias("file"), "text")
    found = licences.scan(docs.select(F.col("file").alias("path"), "text")).withColumnRenamed("path", "file")
    return docs.select("doc_id", "path", "file").join(found, "file").select("doc_id", "path", "licence", F.round("score", 6).alias("score"), "origin", "inherited_from")
