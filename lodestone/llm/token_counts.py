"""Token counts of whole texts; huge texts in overlapping chunks that are spliced.

A text longer than chunk_chars is encoded as chunks that overlap. Two neighbouring
encodings are spliced at a position of the overlap where a token starts in both and the
character before it is white space to the vocabulary (to Python U+001C to U+001F are, too). Such a boundary is stable whatever stands on either
side: no piece of this tokenizer and no special string holds white space, and
normalisation does not compose across it. Where an overlap has no such position, it is
widened, twofold each time, and at last the chunks become one.

Edge cases: a null or empty text has 0 bytes and 0 tokens; rows that repeat are counted
row by row; a null doc_id stays null; an empty table gives an empty result; columns
other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, parts, text_or_empty
from .wordbpe import WordBpe, word_bpe

CHUNK_CHARS, OVERLAP_CHARS = 1 << 16, 256
MAX_TOKENS = 2048


def common_boundary(text: str, left: np.ndarray, right: np.ndarray, low: int, high: int) -> int | None:
    """The last position in (low, high) that starts a token in both encodings after white space."""
    both = np.intersect1d(left, right)
    for at in both[(both > low) & (both < high)][::-1].tolist():
        if text[at - 1].isspace() and not "\x1c" <= text[at - 1] <= "\x1f":
            return at
    return None


def spliced(encoder, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> Iterator[bytes]:
    """The ids of the text, as bytes, piece by piece."""
    if len(text) <= chunk_chars:
        yield encoder.ids(text)
        return
    begin, end = 0, chunk_chars
    starts, ids = encoder.starts(text[begin:end])
    starts = starts + begin
    while end < len(text):
        overlap, at = overlap_chars, None
        while at is None:
            low = max(begin, end - overlap)
            high = min(len(text), low + max(chunk_chars, 2 * overlap))
            next_starts, next_ids = encoder.starts(text[low:high])
            next_starts = next_starts + low
            at = common_boundary(text, starts, next_starts, low, end)
            if at is None and low == begin:  # nothing to splice at: one longer chunk
                break
            overlap *= 2
        if at is None:
            starts, ids, end = next_starts, next_ids, high
            if high == end and high < len(text):
                chunk_chars *= 2
            continue
        yield ids[: np.searchsorted(starts, at)].tobytes()
        k = np.searchsorted(next_starts, at)
        begin, end, starts, ids = at, high, next_starts[k:], next_ids[k:]
    yield ids.tobytes()


def count_tokens(encoder, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> int:
    return sum(len(part) for part in spliced(encoder, text, chunk_chars, overlap_chars)) // 4


def token_counts(
    docs: DataFrame, vocabulary: str, *, max_tokens: int = MAX_TOKENS, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder: WordBpe = word_bpe(vocabulary)
        for batch in batches:
            n = []
            for part in parts(batch, 1):
                n += [count_tokens(encoder, t, chunk_chars, overlap_chars) for t in part.column(1).to_pylist()]
            size = pc.cast(pc.binary_length(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > max_tokens for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    byte_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
