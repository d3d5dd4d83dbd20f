"""What several operators share: shared-folder checkpoints, small literal tables, blocks of text bytes."""

from __future__ import annotations

import ctypes
import json
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; only where it is unset and the master is local, as in tests, a new local one."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}


def long_texts(spark: SparkSession) -> SparkSession:
    """The session, with smaller Arrow batches unless it has its own: 10,000 documents, or 64 MB of them, at once take much memory on both sides.

    Workers also look for this package where the driver found it. Both stay for the rest of the session, as its DataFrames
    are computed after this call; `SETTINGS` names the settings, so a caller can put them back.
    """
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), root]))
    for key, (default, smaller) in SETTINGS.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, smaller)
    return spark


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no earlier stage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*kept: DataFrame) -> None:
    """Deletes the files of durable DataFrames that nothing will read again; others are left alone."""
    for df in kept:
        try:
            file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        except Py4JError:  # not a checkpoint
            continue
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of constants as one JVM literal; no Python rows reach the executors."""
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.explode(parsed).alias("r")).select("r.*")


def crc_mod(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def spread(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that extra columns never clash."""
    return docs.select(*[docs[c] for c in cols])


MARK_BITS = 26


def marks(ids: DataFrame, column: str) -> np.ndarray:
    """2**MARK_BITS bits (8 MB, whatever the input) with those of the ids set; unset bits rule an id out, set ones don't prove it."""
    at = F.col(column).bitwiseXOR(F.shiftright(column, MARK_BITS)).bitwiseAND((1 << MARK_BITS) - 1)
    rows = ids.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("page")).agg(F.expr("bitmap_construct_agg(at & 32767)").alias("bits")).collect()
    out = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    for r in rows:
        out[r["page"] << 12 : (r["page"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def marked(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id's bit is set."""
    at = (ids ^ (ids >> MARK_BITS)) & ((1 << MARK_BITS) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def text_blocks(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, number of rows, texts without nulls) of slices with about `most` bytes of text; a longer text stands alone."""
    texts = batch.column(column)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    row, n = 0, len(sizes)
    while row < n:
        base = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield row, stop - row, texts.slice(row, stop - row)
        row = stop
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: a worker lives through many stages and would keep its largest."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim  # of the GNU C library
except (AttributeError, OSError):
    _TRIM = None


def utf8_block(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a null-free string array, and the n + 1 offsets of its texts in them."""
    large = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if large else np.int32
    at = np.frombuffer(offsets, dtype=kind, count=len(texts) + 1, offset=texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    size = int(at[-1] - at[0])
    raw = np.frombuffer(data, dtype=np.uint8, count=size, offset=int(at[0])) if size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+` of all texts in a row, and the number of words of each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
    if empty.any():
        rows = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(rows[~empty], minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pa.array(~empty))
    return flat, counts
