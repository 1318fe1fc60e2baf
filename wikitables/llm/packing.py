"""Packing by concatenate and cut: two-pass prefix sums give global offsets, fixed windows cut them.

The first pass tokenizes every document once and writes, per document, its ids
and its offset inside the partition that made it.  The totals per partition
(one row each) are summed into partition offsets, which are broadcast: their
number is that of the partitions, not of the documents.  The second pass cuts
each document at the multiples of the sequence length.  A document that crosses
a border yields boundary records: one piece on either side.

The tokenizer file's vocabulary is encoded by its ranks, which gives the ids
that the tokenizers library gives, in less than half of the time.  Strings of
the file's added tokens get their own ids, as the library gives by default.

Defined results: a null text is an empty text; an empty document is its end
token alone; rows with equal ids are packed one by one; an empty table gives an
empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, stored, table, whole_text

SEQUENCE = 1024
END_ID = 0


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes are themselves, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}


class Encoder:
    """Ids of texts by a byte-level tokenizer file, whose ids are its merge ranks; the file's added tokens are their own ids."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        alphabet = byte_alphabet()
        tokenizer = Tokenizer.from_file(path)
        self.added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in tokenizer.get_vocab().items() if t not in self.added}
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.added)

    def encode(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return np.array(self.encoding.encode(text, allowed_special="all"), "<u4")
        return np.array(self.encoding.encode_ordinary(text), "<u4")


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder of a tokenizer file; it outlives a task."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


TOKENS = "id long, part long, start long, n long, ids binary"


def tokenized(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its ids with the end token, its partition and its offset there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, start = encoder(tokenizer, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, upto in slices(batch.column(1)):
                ids = [np.append(enc.encode(t.as_py()), np.uint32(END_ID)).tobytes() for t in batch.column(1)[at:upto]]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                starts = start + np.cumsum(counts) - counts
                start += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at:upto], pa.array(np.full(upto - at, part)), pa.array(starts), pa.array(counts), pa.array(ids, pa.binary())],
                    ["id", "part", "start", "n", "ids"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")).mapInArrow(run, TOKENS)


PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def cut(placed: DataFrame, length: int, with_ids: bool) -> DataFrame:
    """Pieces of the documents in ``placed`` (id, first, n, ids) at the multiples of ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            pieces = (first + n - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] // length + nth
            begin = np.maximum(sequence * length, first[row])
            end = np.minimum((sequence + 1) * length, first[row] + n[row])
            start, count = begin - first[row], end - begin
            crcs, kept, views = [], [], [memoryview(x.as_buffer()) for x in batch.column(3)]
            for r, a, b in zip(row.tolist(), (start * 4).tolist(), ((start + count) * 4).tolist(), strict=True):
                piece = views[r][a:b]
                crcs.append(zlib.crc32(piece))
                if with_ids:
                    kept.append(bytes(piece))
            ids = pa.array(kept, pa.binary()) if with_ids else pa.nulls(len(row), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(count), pa.array(crcs, pa.int64()), pa.array(n[row]),
                 pa.array(sequence), pa.array(begin - sequence * length), ids],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return placed.select("id", "first", "n", "ids").mapInArrow(run, PIECES)


def pack(
    docs: DataFrame, tokenizer: str, pattern: str, length: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per piece: its document, place there, checksum, sequence and offset, and its ids if asked for."""
    tokens = stored(tokenized(docs, tokenizer, pattern, id_col, text_col), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(bases), "part").withColumn("first", F.col("base") + F.col("start"))
    out = cut(placed, length, with_ids).withColumnRenamed("id", id_col)
    return out if with_ids else out.drop("ids")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)
