"""What the text operators share: whole-text batches, held-out rows, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts reach Python in batches of about so many bytes (a longer text is a batch of its own).
BATCH_BYTES = 8 << 20


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """True for rows kept from training: ``crc32(key as text) mod modulus = remainder``; a null key is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def text_batches(batches: Iterator[pa.RecordBatch], column: str, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``size`` bytes in each, whatever the length of its texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = lengths.cumsum()
        start = 0
        while start < batch.num_rows:
            reached = ends[start - 1] if start else 0
            stop = max(start + 1, int(ends.searchsorted(reached + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def per_document(df: DataFrame, carried: Sequence[str], text: str, schema: str,
                 columns: Callable[[list[str]], dict[str, list]], size: int = BATCH_BYTES) -> DataFrame:
    """Rows of ``carried`` with what ``columns(texts)`` derives from whole texts (null: empty), a batch at a time.

    ``schema`` names the derived columns, ``size`` the bytes of text in a batch. Only ``carried`` and ``text`` are read, and
    the text once where it is carried too.
    """
    source = text if text in carried else "__text"
    kept = df.select(*[F.col(f"`{c}`") for c in carried],
                     *([] if text in carried else [F.col(f"`{text}`").cast("string").alias("__text")]))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:len(carried)]]
    derived = [part.strip().split(" ")[0] for part in schema.split(",")]
    names = [*carried, *derived]

    def run(batches):
        for batch in text_batches(batches, source, size):
            made = columns([t or "" for t in batch.column(source).to_pylist()])
            new = [made[c] if isinstance(made[c], pa.Array) else pa.array(made[c]) for c in derived]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(carried)], *new], names=names)

    return kept.mapInArrow(run, ", ".join([*types, schema]))


def packed(documents: DataFrame, *used: str, text: str = "text") -> DataFrame:
    """``used``, the text and ``__row``, a struct of all other columns, so that no column can clash with a derived one."""
    rest = [F.col(f"`{c}`") for c in documents.columns if c != text]
    return documents.select(*used, text, F.struct(*rest).alias("__row"))


def unpacked(df: DataFrame, columns: Sequence[str], **changed: Column) -> DataFrame:
    """The original ``columns`` of packed rows, some of them ``changed``."""
    return df.select(*[changed[c].alias(c) if c in changed else F.col(f"__row.`{c}`").alias(c) for c in columns])


def sent(spark: SparkSession, value) -> Callable:
    """A function that gives ``value`` inside tasks, sent to each executor once with the code of its classes.

    For models and vocabularies, whose size is fixed by parameters.
    """
    from pyspark import cloudpickle

    packed_value = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    opened: list = []

    def get():
        if not opened:
            opened.append(cloudpickle.loads(packed_value.value))
        return opened[0]

    return get


def known_labels(labels: DataFrame, key: str, label: str, modulus: int, remainder: int) -> DataFrame:
    """``key, __label`` of all training rows. Keys with contradicting labels take the larger one."""
    return (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()
                         & ~held_out(F.col(key), modulus, remainder))
            .groupBy(key).agg(F.max(F.col(label).cast("int")).alias("__label")))


def labelled_sample(documents: DataFrame, labels: DataFrame, key: str, label: str, modulus: int, remainder: int,
                    rows: int, seed: str = "sample") -> DataFrame:
    """At most about ``rows`` labelled training rows ``(documents..., label)``, drawn by a hash of the key.

    The share drawn follows from a count, so a smaller table is used whole and the
    same table gives the same sample.
    """
    known = known_labels(labels, key, label, modulus, remainder)
    found = known.count()
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / max(found, 1)))
    return documents.join(known.where(drawn), key)
