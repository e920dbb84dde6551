"""Packing of token ids into sequences: first-fit decreasing over a tournament tree.

Every document becomes its ids and an end id, cut into pieces of at most max_tokens.
Documents are dealt to random groups of about group_docs by a hash of doc_id and ids; in
each group their pieces are placed by decreasing length into the first sequence with room, which a
tournament tree over the sequences' free space finds in logarithmic time.

Edge cases: a null or empty text is the end id alone; rows that repeat are packed row by
row; a null doc_id stays null; an empty table gives no pieces; columns other than doc_id
and text are not looked at. Equal lengths are placed by doc_id, start and checksum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, parts, text_or_empty
from .token_counts import CHUNK_CHARS, MAX_TOKENS, spliced
from .wordbpe import word_bpe

END_ID = 1
GROUP_DOCS = 2048
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
DEALT = PIECE + ", doc_crc32 long"


class TournamentTree:
    """Free space of sequences 0, 1, ...; each inner node holds the most below it."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """The first sequence with that much room, and the room before placing."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < length:
                at += 1
        room = most[at]
        most[at] = room - length
        out = at - self.leaves
        while at > 1:
            at //= 2
            best = max(most[2 * at], most[2 * at + 1])
            if most[at] == best:
                break
            most[at] = best
        return out, room


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each length; the lengths must fall."""
    tree = TournamentTree(len(lengths), capacity)
    return [(k, capacity - room) for k, room in map(tree.place, lengths)]


def pieces(docs: DataFrame, vocabulary: str, max_tokens: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_bpe(vocabulary), np.array([END_ID], "<u4").tobytes()
        step = 4 * max_tokens
        for batch in batches:
            for part in parts(batch, 1):
                out: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = (encoder.ids(text) if len(text) <= CHUNK_CHARS else b"".join(spliced(encoder, text))) + end
                    total, crc = len(ids) // 4, zlib.crc32(ids)
                    for k in range(0, len(ids), step):
                        piece = ids[k : k + step]
                        out.append((doc_id, k // 4, len(piece) // 4, zlib.crc32(piece), total, crc))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_crc32"]
                )

    byte_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, DEALT)


def pack(docs: DataFrame, vocabulary: str, *, max_tokens: int = MAX_TOKENS, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    groups = max(1, -(-docs.count() // group_docs))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        placed = first_fit_decreasing(group["length"].tolist(), max_tokens)
        first = int(group["pack_group"].iloc[0]) << 32
        group["sequence_id"] = [first + k for k, _ in placed]
        group["offset"] = [offset for _, offset in placed]
        return group.drop(columns=["pack_group", "doc_crc32"])

    dealt = pieces(docs, vocabulary, max_tokens).withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "doc_crc32"), F.lit(groups)))
    null_id = F.lit(-(2**63))
    out = dealt.withColumn("doc_id", F.coalesce("doc_id", null_id)).groupBy("pack_group").applyInPandas(place, PIECE + ", sequence_id long, offset long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != null_id, F.col("doc_id")))
