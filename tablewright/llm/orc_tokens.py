"""Token ids of documents as ORC files that can be read in parallel by stripe and skipped by their metadata.

A file holds one range of document ids in ascending order. Ids are integer lists, which ORC
run-length encodes; ``doc_id`` has minimum and maximum per stripe and per row group, and a
Bloom filter per row group, so a filter on it skips files, stripes and row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bpe import encoder, file_tokenizer, little_endian
from .texts import ready

ROWS_PER_INDEX = 1_000
STRIPE_BYTES = 16 << 20
SLICE_BYTES = 4 << 20  # of texts encoded at a time: the fewer slices, the fewer lookups of all pieces


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1) -> None:
    """Encode the whole ``text`` of every row and write ``doc_id, position, n_tokens, ids`` to ``path``.

    The library's defaults hold (strings of special tokens in a text become these tokens), nothing is added but
    ``end_id`` after each document. Rows are in ascending order of ``doc_id`` over all files, null ids first; rows with
    the same id keep the order of their texts' hashes. ``position`` numbers the rows in that order, with gaps between
    files. A null or empty text has ``end_id`` only. Other columns are ignored; an empty table leaves an empty file.
    """
    ready(docs.sparkSession)
    # Texts are dealt before they are encoded: the range sampling then reads them only, and they are smaller than ids.
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ids = encoder(("file", tokenizer), lambda: file_tokenizer(tokenizer), end_id, SLICE_BYTES)(F.col("text"))
    rows = dealt.select("doc_id", F.monotonically_increasing_id().alias("position"), ids.alias("ids"))
    rows.select("doc_id", "position", F.size("ids").cast("long").alias("n_tokens"), "ids").write.options(
        **{
            "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
            "orc.row.index.stride": str(ROWS_PER_INDEX), "orc.stripe.size": str(STRIPE_BYTES), "compression": "zstd",
        }
    ).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written table. Filters on ``doc_id`` reach the files' metadata; stripes are read by separate tasks."""
    return spark.read.schema("doc_id long, position long, n_tokens long, ids array<int>").orc(path)


def with_starts(tokens: DataFrame) -> DataFrame:
    """Add ``start``: the number of ids in all rows before a row. Totals by file, then running totals within each."""
    file = F.shiftrightunsigned("position", 33)
    # One row per file: the totals read the counts alone, not the ids.
    totals = tokens.groupBy(file.alias("__file")).agg(F.sum("n_tokens").alias("__sum"))
    before = totals.select("__file", (F.sum("__sum").over(Window.orderBy("__file")) - F.col("__sum")).alias("__before"))
    inside = Window.partitionBy("__file").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        tokens.withColumn("__file", file)
        .withColumn("__up_to", F.sum("n_tokens").over(inside))
        .join(F.broadcast(before), "__file")
        .withColumn("start", F.col("__before") + F.col("__up_to") - F.col("n_tokens"))
        .drop("__file", "__before", "__up_to")
    )


def checksums(tokens: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``, the CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    ready(tokens.sparkSession)
    return tokens.withColumn("ids_crc32", F.crc32(little_endian()(F.col("ids")))).drop("ids")
