"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters.

A document is one row, or several if it has more than ``PIECE`` ids, so a batch of rows is
bounded however long a text is: ``(doc_id, doc_no, piece, after, start, ids)``. ``doc_no``
counts the documents of a file, ``start`` the ids before the piece in its file and ``after`` those
of the document that follow it. Rows stand in the order of doc_id, within and across files, so the ORC writer's own encodings do the
rest: ids and counters are run-length encoded integers, each stripe and each ``ROW_GROUP`` rows
carry minima and maxima, and doc_id a Bloom filter. A reader that filters on doc_id skips
files, stripes and row groups by metadata, and Spark reads stripes of one file in parallel.

A table of (file, ids) beside the files, one row per file, gives each file's place in the
whole stream; it is made from the files after they are written.

The crc32 of a document is the exclusive or of its pieces' crc32s, each moved over the bytes
that follow it, so pieces are digested where they are read and one grouped ``bit_xor`` ends it.

Defined results: a null or empty text is the end id alone; null doc_id comes first; rows of
one doc_id are documents of their own, in the order of their texts' hash, and rows equal in
both may stand in either order. No documents, no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glucoframe.llm.packing import PieceCache, token_ids
from glucoframe.llm.ranges import partitions_of
from glucoframe.llm.scratch import Scratch
from glucoframe.llm.textstream import release_memory, slices, text_buffers

END = 2
PIECE = 1024
ROW_GROUP = 1000
STRIPE_BYTES = 32 << 20
FALSE_HITS = 0.01
SLICE_BYTES = 6 << 20
ROWS = "doc_id long, doc_no long, piece int, after long, start long, ids array<int>"


def _encoded(batches: Iterable[pa.RecordBatch], path: str, end: int, size: int) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    cache = PieceCache(path)
    doc_no = start = 0
    for batch in batches:
        ids = batch.column("doc_id")
        data, offsets = text_buffers(batch.column("text"))
        for i, j in slices(offsets, SLICE_BYTES):
            tokens, cut = token_ids(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], cache)
            tokens = tokens.astype(np.int32)
            tokens[cut[1:] - 1] = end  # each text's last id
            n = np.diff(cut)
            pieces = -(-n // size)
            doc = np.repeat(np.arange(j - i), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = cut[:-1][doc] + piece * size
            after = np.maximum(n[doc] - (piece + 1) * size, 0)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i).take(pa.array(doc)), pa.array(doc_no + doc), pa.array(piece.astype(np.int32)),
                 pa.array(after), pa.array(start + first),
                 pa.ListArray.from_arrays(pa.array(np.append(first, cut[-1]).astype(np.int32)), pa.array(tokens))],
                ["doc_id", "doc_no", "piece", "after", "start", "ids"])
            doc_no += j - i
            start += int(cut[-1])
    release_memory()


class TokenFiles:
    """A folder of token files."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def write(self, docs: DataFrame, tokenizer_path: str, end: int = END, piece: int = PIECE, stripe_bytes: int = STRIPE_BYTES,
              row_group: int = ROW_GROUP) -> TokenFiles:
        """Encode ``docs`` (doc_id, text) into files in the order of doc_id."""
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        key = F.xxhash64("text")
        ranged = docs.repartitionByRange(partitions_of(docs), "doc_id", key).sortWithinPartitions("doc_id", key)
        rows = ranged.mapInArrow(partial(_encoded, path=tokenizer_path, end=end, size=piece), ROWS)
        (rows.write.option("compression", "zstd").option("maxRecordsPerFile", 0).option("orc.stripe.size", stripe_bytes)
         .option("orc.create.index", "true").option("orc.row.index.stride", row_group)
         .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", FALSE_HITS)
         .orc(f"{self.path}/ids"))
        name = F.col("_metadata.file_name")
        files = (self._rows().groupBy(name.alias("file"))
                 .agg(F.max(F.col("start") + F.size("ids")).alias("n_ids"), F.max("doc_no").alias("last_doc")))
        # the writer makes one file of a partition, numbers it, and partitions are in order
        files = files.withColumn("number", F.regexp_extract("file", r"part-(\d+)", 1).cast("long"))
        before = Window.partitionBy(F.lit(0)).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
        (files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
         .write.parquet(f"{self.path}/files"))
        return self

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(ROWS).orc(f"{self.path}/ids")

    def rows(self) -> DataFrame:
        """Pieces with ``start`` in the whole stream. A filter on doc_id reaches the files'
        metadata; columns that are not asked for are not read."""
        files = self.spark.read.schema("file string, number long, n_ids long, last_doc long, first_id long").parquet(f"{self.path}/files")
        return (self._rows().withColumn("file", F.col("_metadata.file_name")).join(files, "file")
                .select(F.col("number").alias("file"), "doc_id", "doc_no", "piece", "after", (F.col("start") + F.col("first_id")).alias("start"), "ids"))

    def digests(self) -> DataFrame:
        """Per document, from the files: its first id's place, the number and crc32 of its ids."""
        pieces = self.rows().mapInArrow(_digested, "file long, doc_no long, doc_id long, start long, n long, crc long")
        return (pieces.groupBy("file", "doc_no")
                .agg(F.max("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
                .select("doc_id", "start", "n_tokens", "ids_crc32"))

    def lookup(self, *doc_ids: int) -> DataFrame:
        """The pieces of some documents, by metadata."""
        return self.rows().where(F.col("doc_id").isin(*doc_ids))


_POLYNOMIAL = 0xEDB88320


def _byte_tables(images: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its images of single bits, as four tables of a byte each."""
    tables = np.zeros((4, 256), np.uint32)
    values = np.arange(256)
    for byte in range(4):
        for bit in range(8):
            tables[byte] ^= np.where(values >> bit & 1, images[8 * byte + bit], 0).astype(np.uint32)
    return tables


def _mapped(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0, crc & 255] ^ tables[1, crc >> 8 & 255] ^ tables[2, crc >> 16 & 255] ^ tables[3, crc >> 24]


class ZeroBytes:
    """What 2 ** k zero bytes at the end do to a crc32: the map of one byte, squared k times."""

    def __init__(self):
        images = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(8):
            images = images >> np.uint32(1) ^ np.where(images & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
        self.tables = [_byte_tables(images)]

    def power(self, k: int) -> np.ndarray:
        while len(self.tables) <= k:
            last = self.tables[-1]
            self.tables.append(_byte_tables(_mapped(last, _mapped(last, np.uint32(1) << np.arange(32, dtype=np.uint32)))))
        return self.tables[k]

    def moved(self, crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
        """Each crc moved over its number of zero bytes."""
        crc, left = crc.astype(np.uint32), zeros.astype(np.int64)
        k = 0
        while left.any():
            at = np.flatnonzero(left & 1)
            if len(at):
                crc[at] = _mapped(self.power(k), crc[at])
            left = left >> 1
            k += 1
        return crc


def _digested(batches):
    zero = ZeroBytes()
    for batch in batches:
        lists = batch.column("ids")
        offsets = lists.offsets.to_numpy()
        raw = lists.values.to_numpy().astype("<u4", copy=False)
        crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])), np.uint32, len(batch))
        crc = zero.moved(crc, 4 * batch.column("after").to_numpy())
        kept = ["file", "doc_no", "doc_id", "start"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc.astype(np.int64))],
                                         [*kept, "n", "crc"])


def token_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write token files below the shared folder and read the documents back."""
    spark = docs.sparkSession
    return TokenFiles(spark, f"{Scratch(spark, 'token-files').root}/tokens").write(docs, tokenizer_path).digests()
