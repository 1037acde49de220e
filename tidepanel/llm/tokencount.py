"""Token counts of flat, unindexed token files by a separator scan.

Files are plain little-endian ids, documents end with a separator id, nothing says where. Blocks of a file are read independently and
searched in one vectorised comparison; a block knows its separators but not where its first document began. A
prefix scan over one summary row per block (last separator so far, number of separators so far) stitches them together, in
two levels, so that a single huge file is no single task.
"""
from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidepanel.core.scratch import new_path
from tidepanel.llm.bpe import encoder
from tidepanel.llm.common import Stage, id_text, steps, unique_name, without_gc
from tidepanel.llm.packing import word_ids

#: Ids in a block, blocks whose summaries one window scans, bytes of a file that the writer makes.
BLOCK, LEVEL, FILE_BYTES = 1 << 20, 4096, 256 << 20


def _open(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_flat(docs: DataFrame, folder: str, path: str, end: int, kind: str = "<u2", pattern: str | None = None) -> Stage:
    """Encode every text by the tokenizer file ``path`` into flat files in the shared ``folder``; returns the stored list (file, ids, ordinal, doc_id).

    With a ``pattern`` the file holds byte ranks and the pattern splits the texts; without, it is one of the tokenizers library.
    A file gets its final name when it is complete. Only files of the list count, so what a lost task left behind does no harm.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        if pattern is None:
            encode = word_ids(path, True).encode  # a marker in a text is no separator
        else:
            enc = encoder(path, pattern)
            encode = lambda texts: [array("I", enc.encode(t)).tobytes() for t in texts]
        fs.create_dir(base, recursive=True)
        out, name, ordinal, written = None, "", 0, 0
        rows: list[tuple] = []

        def close():
            nonlocal out
            out.close()
            fs.move(f"{base}/{name}.part", f"{base}/{name}.bin")
            out = None
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([written] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                                             ["file", "ids", "ordinal", "doc_id"])

        for part in without_gc(steps(batches)):
            for i, got in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist()), strict=True):
                if out is None:
                    name, ordinal, written, rows = f"{TaskContext.get().partitionId():06d}-{unique_name()}", 0, 0, []
                    out = fs.open_output_stream(f"{base}/{name}.part")
                ids = np.append(np.frombuffer(got, "<u4"), end).astype(kind)
                out.write(ids.tobytes())
                rows.append((f"{name}.bin", ordinal, i))
                ordinal, written = ordinal + 1, written + len(ids)
                if written * ids.itemsize >= FILE_BYTES:
                    yield from close()
        if out is not None:
            yield from close()

    return Stage(id_text(docs).mapInArrow(run, "file string, ids long, ordinal long, doc_id long"), "flat-list")


def count(files: DataFrame, folder: str, end: int, kind: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens) of each document in ``files`` (file, ids: their number in it).

    n_tokens is without the separator. Ids behind the last separator of a file are no document. Neighbouring separators
    enclose an empty one; an empty file has none.
    """
    step = np.dtype(kind).itemsize
    blocks = files.where("ids > 0").select("file", "ids", F.explode(F.sequence(F.lit(0), ((F.col("ids") - 1) / block).cast("long"))).alias("block"))
    blocks = blocks.repartition(F.col("file"), F.col("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        for b in batches:
            for name, ids, k in zip(*(b.column(c).to_pylist() for c in ("file", "ids", "block")), strict=True):
                with fs.open_input_file(f"{base}/{name}") as f:
                    data = f.read_at(min(block, ids - k * block) * step, k * block * step)
                at = np.flatnonzero(np.frombuffer(data, kind) == end) + k * block
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([len(at)], pa.int64()),
                                                  pa.array([int(at[-1]) if len(at) else None], pa.int64()), pa.array([at], pa.list_(pa.int64()))], ["file", "block", "n", "last", "ends"])

    found = Stage(blocks.select("file", "ids", "block").mapInArrow(run, "file string, block long, n long, last long, ends array<long>"), "ends")
    small = found.df.select("file", "block", "n", "last", (F.col("block") / LEVEL).cast("long").alias("super"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    upper = small.groupBy("file", "super").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    upper = upper.select("file", "super", F.sum("n").over(before("file", "super")).alias("n_up"), F.max("last").over(before("file", "super")).alias("last_up"))
    lower = small.select("file", "block", "super", F.sum("n").over(before("file", "super", "block")).alias("n_in"), F.max("last").over(before("file", "super", "block")).alias("last_in"))
    carry = lower.join(upper, ["file", "super"]).select("file", "block", (F.coalesce("n_up", F.lit(0)) + F.coalesce("n_in", F.lit(0))).alias("ahead"),
                                                        (F.coalesce("last_in", "last_up", F.lit(-1)) + 1).alias("open"))
    each = found.df.select("file", "block", "ends").where(F.size("ends") > 0).join(carry, ["file", "block"])
    each = each.select("file", "ahead", "open", "ends", F.posexplode("ends").alias("i", "stop"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.get("ends", F.col("i") - 1) + 1)
    return each.select("file", (F.col("ahead") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"))


def count_documents(spark: SparkSession, docs: DataFrame, path: str, end: int, pattern: str | None = None) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens): write flat files of all texts, scan them, and name the documents.

    Null and empty texts have 0 tokens; repeated rows and null ids are documents like others.
    """
    folder = new_path(spark, "tokens")
    listed = write_flat(docs, folder, path, end, pattern=pattern)
    found = count(listed.df.select("file", "ids").distinct(), folder, end)
    return listed.df.select("file", "ordinal", "doc_id").join(found, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
