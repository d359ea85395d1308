"""Manifests of input files and content hashes of tables."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Files are streamed in blocks of so many bytes.
BLOCK = 1 << 20
#: Files of more bytes are streamed: one that is read whole takes several times its size of a task's memory.
WHOLE = 1 << 25


def stream_hashes(batches):
    """For ``mapInArrow``: SHA-256 of each ``path``, read in blocks from its own file system, whatever the file's size."""
    from urllib.parse import quote

    from pyarrow import fs

    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            if path.startswith("file:"):
                store, place = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
            else:
                store, place = fs.FileSystem.from_uri(quote(path, safe=":/@"))
            digest = hashlib.sha256()
            with store.open_input_stream(place, compression=None) as stream:
                while block := stream.read(BLOCK):
                    digest.update(block)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "sha256"])


def file_table(spark: SparkSession, folder: str, pattern: str = "*", largest: int = WHOLE) -> DataFrame:
    """``(path, size, sha256)`` of the files below a folder; the path is relative to it.

    Sizes come from the listing alone. Files up to ``largest`` bytes are read whole for
    their hash (the limit reaches the scan, so larger ones are not read there); a file
    above it is streamed in blocks, each in a task of its own.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    name = F.substr(F.col("path"), F.lit(len(root) + 2)).alias("path")
    hashes = files.where(F.col("length") <= largest).select(name, F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > largest).select("path")
    if n := large.count():
        hashes = hashes.union(large.repartition(n).mapInArrow(stream_hashes, "path string, sha256 string").select(name, "sha256"))
    return files.select(name, F.col("length").alias("size")).join(hashes, "path", "left")


def check_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """State of every file: missing, without reference, ok, wrong size, wrong hash (size first).

    A file listed without a hash is ``sem-hash`` when its size is right.
    """
    f = files.select("path", F.col("size").alias("_s"), F.col("sha256").alias("_h"))
    m = manifest.select("path", "size", "sha256", F.lit(True).alias("_m"))
    state = (F.when(F.col("_s").isNull(), "ausente").when(F.col("_m").isNull(), "sem-referencia")
             .when(F.col("_s") != F.col("size"), "tamanho-errado")
             .when(F.col("_h").isNull(), "sem-hash")
             .when(F.col("_h") != F.col("sha256"), "hash-errado").otherwise("ok"))
    return f.join(m, "path", "full_outer").select("path", state.alias("state"), F.col("_s").alias("size"),
                                                  F.col("_h").alias("sha256"))


def merge_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Unchanged files keep access date and query and gain ``verified_at``; changed ones note the old hash.

    Both have ``path, sha256, size, accessed_at, query``. A file is gone if ``new`` has no row for it or neither
    size nor hash; one with a size only is there but not hashed, so nothing old is kept for it.
    """
    o = old.select("path", *[F.col(c).alias(f"o_{c}") for c in ("sha256", "size", "accessed_at", "query")])
    same = F.col("sha256").eqNullSafe(F.col("o_sha256")) & F.col("sha256").isNotNull()
    gone = F.col("sha256").isNull() & F.col("size").isNull()
    keep = same | gone
    return new.join(o, "path", "full_outer").select(
        "path", F.when(gone, F.col("o_sha256")).otherwise(F.col("sha256")).alias("sha256"), F.coalesce("size", "o_size").alias("size"),
        F.when(keep, F.col("o_accessed_at")).otherwise(F.col("accessed_at")).alias("accessed_at"),
        F.when(keep, F.col("o_query")).otherwise(F.col("query")).alias("query"),
        F.when(same, F.col("accessed_at")).alias("verified_at"),
        F.when(~same & ~gone, F.col("o_sha256")).alias("previous_sha256"))


def content_digest(df: DataFrame) -> DataFrame:
    """One row ``(rows, sum, mix)`` that does not depend on row order or file layout.

    NULL and an empty string differ: every column is hashed beside its NULL flag.
    """
    names = sorted(df.columns)
    parts = [p for c in names for p in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    h = F.xxhash64(*parts)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("sum"),
                  F.bit_xor(F.xxhash64(h, F.lit(1))).alias("mix"))


def content_hash(df: DataFrame) -> str:
    """SHA-256 of the digest with column names and types."""
    row = content_digest(df).first()
    schema = ",".join(f"{c}:{t}" for c, t in sorted(df.dtypes))
    return hashlib.sha256(f"{schema}|{row['rows']}|{row['sum']}|{row['mix']}".encode()).hexdigest()
