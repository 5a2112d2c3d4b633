"""Fingerprints of input files."""

from __future__ import annotations

import ctypes
import ctypes.util
import re
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

WHOLE, PIECE = 128 << 20, 1 << 20
_STATE = 256  # bytes set aside for libcrypto's SHA256_CTX, which has 112
# Hadoop would decompress the first and not list the second.
_UNRANGED = re.compile(r"\.(gz|gzip|bz2|deflate|snappy|lz4|zst|lzo|passthrough)$|/[_.][^/]*$")


def fingerprint(spark: SparkSession, paths: str | Sequence[str], whole: int = WHOLE) -> DataFrame:
    """SHA-256 of the bytes of every file.

    Files of at most ``whole`` bytes are each read by one task, side by side. A larger one is read split by
    split: each is a task of its own, which goes on from the state of the hash that the one before it left, so
    splits of one file follow one another. The last split is read by the driver, ``PIECE`` bytes at a time.
    Without a libcrypto that hands out that state, or with a name that Hadoop would decompress or hide, a file
    is read by one task and must be under 2 GB.
    """
    columns = (F.col("path").alias("source_file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    files = spark.read.format("binaryFile").load(paths)
    large = files.filter(F.col("length") > whole).select("path", "length").collect()
    if not large:
        return files.select(*columns)
    library = _library()
    chained = [r for r in large if library and not _UNRANGED.search(r["path"])]
    digests = {path: _chained(spark, library, path, length) for path, length in {(r["path"], r["length"]) for r in chained}}
    got = files.filter(F.col("length") <= whole).select(*columns)
    if chained:
        rows = [(r["path"], r["length"], digests[r["path"]]) for r in chained]
        got = got.unionByName(spark.createDataFrame(rows, "source_file string, bytes long, sha256 string"))
    for r in large:
        if r not in chained:
            got = got.unionByName(spark.read.format("binaryFile").load(_escaped(r["path"])).select(*columns))
    return got


def _library() -> str | None:
    """The name of a libcrypto whose hash can go on from a saved state."""
    for name in (ctypes.util.find_library("crypto"), "libcrypto.so.3"):
        try:
            if name and all(hasattr(ctypes.CDLL(name), f"SHA256_{step}") for step in ("Init", "Update", "Final")):
                return name
        except OSError:
            pass
    return None


def _grown(library: str, state: bytes, pieces: Iterable[bytes]) -> tuple[bytes, int]:
    """The state after ``pieces``, and their bytes."""
    update, context, n = ctypes.CDLL(library).SHA256_Update, ctypes.create_string_buffer(state, _STATE), 0
    for piece in pieces:
        update(context, bytes(piece), ctypes.c_size_t(len(piece)))
        n += len(piece)
    return context.raw, n


def _escaped(path: str) -> str:
    return re.sub(r"([\\{}\[\]*?^])", r"\\\1", path)


def _rest(spark: SparkSession, path: str, start: int) -> Iterator[bytes]:
    """The bytes of a file from ``start`` on, by the file system that Spark reads it with."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        stream.seek(start)
        while piece := stream.readNBytes(PIECE):
            yield bytes(piece)
    finally:
        stream.close()


def _chained(spark: SparkSession, library: str, path: str, length: int) -> str:
    sc = spark.sparkContext
    context = ctypes.create_string_buffer(_STATE)
    ctypes.CDLL(library).SHA256_Init(context)
    state, done = context.raw, 0
    # A comma would part two paths, but not within braces.
    splits = sc.binaryRecords(_escaped(path).replace(",", r"{\,}"), PIECE)
    for i in range(splits.getNumPartitions() - 1):
        [(state, n)] = sc.runJob(splits, lambda pieces, state=state: [_grown(library, state, pieces)], [i])
        done += n
    # The last split ends with less than a whole record, at which Spark's reader of records would fail.
    state, n = _grown(library, state, _rest(spark, path, done))
    if done + n != length:
        raise OSError(f"{path} has {done + n} bytes instead of {length}")
    digest = ctypes.create_string_buffer(32)
    ctypes.CDLL(library).SHA256_Final(digest, ctypes.create_string_buffer(state, _STATE))
    return digest.raw.hex()


def dataset_fingerprint(files: DataFrame) -> DataFrame:
    """One digest for a set of files, whatever order they were listed in.

    Adds up the four quarters of every digest, so partial sums meet before the shuffle and
    nothing grows with the number of files. A file given twice counts twice.
    """
    quarters = [
        F.sum(F.conv(F.substring("sha256", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).alias(f"q{i}")
        for i in range(4)
    ]
    return files.agg(*quarters, F.count("*").alias("files"), F.sum("bytes").alias("bytes")).select(
        F.sha2(F.concat_ws(":", "q0", "q1", "q2", "q3", "files"), 256).alias("input_sha256"), "files", "bytes"
    )
