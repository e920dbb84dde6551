"""Media columns: signature sniffing of stored bytes.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass; a
validator for each format confirms structure and length from its headers. What is
confirmed at byte 0 and reaches the end is the column's true type and corrects a wrong
declared one; what is confirmed elsewhere is carved out as embedded media, inside other
confirmed media too: parent is the start of the innermost one that holds it whole, null
if none does. Of what is compressed only the outside is looked at.

Texts can be stored as media: their UTF-8 bytes, filled with spaces to a multiple of 192
bytes, become the samples of a WAV sound, the pixels of a BMP image or those of a PNG
image, 64 pixels of three samples to a row; which one follows from the payload's
checksum, so equal texts have equal media.

Edge cases: null bytes or text are empty ones; empty bytes are
application/octet-stream; rows that repeat are treated row by row; a null doc_id stays
null; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, parts, text_or_empty, worker_state

UNIT, ROW_PIXELS = 192, 64
UNKNOWN = "application/octet-stream"

# Magic bytes and the media types they stand for.
SIGNATURES = {
    b"RIFF": "audio/wav",
    b"BM": "image/bmp",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
    b"%PDF-": "application/pdf",
}


#: An end mark with the place of its table and the white space after it, and what stands at that place.
PDF_END = re.compile(rb"startxref\s+(\d{1,18})\s+%%EOF\s*")
PDF_TABLE = re.compile(rb"xref\b|\d+\s+\d+\s+obj\b")


class Ends:
    """The end marks of a payload, each kind looked for once, however many starts ask for it."""

    def __init__(self, data: bytes):
        self.data = data
        self.tables: dict[int, int] = {}

    def places(self, mark: bytes) -> list[int]:
        return [m.start() for m in re.finditer(re.escape(mark), self.data)]

    @cached_property
    def jpeg(self) -> list[int]:
        return self.places(b"\xff\xd9")

    @cached_property
    def zip(self) -> dict[int, int]:
        """Where an archive starts by the offsets of an end record, and the end of the first such record."""
        out: dict[int, int] = {}
        for end in self.places(b"PK\x05\x06"):
            if end > len(self.data) - 22:
                break
            size, offset, comment = struct.unpack_from("<IIH", self.data, end + 12)
            if end + 22 + comment <= len(self.data):
                out.setdefault(end - offset - size, end + 22 + comment)
        return out

    @cached_property
    def pdf_headers(self) -> list[int]:
        return self.places(b"%PDF-")

    @cached_property
    def pdf(self) -> tuple[list[int], list[int]]:
        """Starts and ends of end marks."""
        marks = [(m.start(), m.end()) for m in PDF_END.finditer(self.data)]
        return [m[0] for m in marks], [m[1] for m in marks]

    @cached_property
    def pdf_offsets(self) -> tuple[np.ndarray, list[list[int]]]:
        """The offsets that end marks name, falling, and the marks (by number) of each."""
        marks: dict[int, list[int]] = {}
        for n, m in enumerate(PDF_END.finditer(self.data)):
            marks.setdefault(min(int(m[1]), len(self.data)), []).append(n)
        falling = sorted(marks, reverse=True)
        return np.array(falling, np.int64), [marks[o] for o in falling]

    @cached_property
    def may_be_table(self) -> np.ndarray:
        """Of each byte whether a cross-reference table or an object may begin with it."""
        first = np.zeros(256, bool)
        first[list(b"x0123456789")] = True
        return first[np.frombuffer(self.data, np.uint8)]

    def table_end(self, at: int) -> int:
        """Where the beginning of a table or an object at this place is complete; past the payload if there is none."""
        if at not in self.tables:
            m = PDF_TABLE.match(self.data, at)
            self.tables[at] = m.end() if m else len(self.data) + 1
        return self.tables[at]

    def next_of(self, at: int, end: int, n: int) -> int | None:
        """The first end mark from number n on that leads from a start to a table after `end` and before the mark."""
        offsets, marks = self.pdf_offsets
        places = at + offsets[: np.searchsorted(-offsets, at - end, side="right")]
        found = None
        for k in np.flatnonzero((places < len(self.data)) & self.may_be_table[np.minimum(places, len(self.data) - 1)]).tolist():
            complete = self.table_end(int(places[k]))
            if complete < len(self.data):
                nth = bisect_left(marks[k], max(n, bisect_left(self.pdf[0], complete)))
                if nth < len(marks[k]) and (found is None or marks[k][nth] < found):
                    found = marks[k][nth]
        return found


def wav_length(b: bytes, at: int, ends: Ends) -> int:
    """Bytes of the sound at this place, 0 if there is none; so for the other formats."""
    if b[at + 8 : at + 16] != b"WAVEfmt " or len(b) < at + 44:
        return 0
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    fmt = struct.unpack_from("<I", b, at + 16)[0]
    data = at + 20 + fmt
    if at + size > len(b) or b[data : data + 4] != b"data":
        return 0
    return size if data + 8 + struct.unpack_from("<I", b, data + 4)[0] <= at + size else 0


def bmp_length(b: bytes, at: int, ends: Ends) -> int:
    if len(b) < at + 54:
        return 0
    size, zero, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or header != 40 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0:
        return 0
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    return size if offset >= 54 and offset + rows <= size and at + size <= len(b) else 0


def png_length(b: bytes, at: int, ends: Ends) -> int:
    k = at + 8
    while k + 12 <= len(b):
        n = struct.unpack_from(">I", b, k)[0]
        kind = b[k + 4 : k + 8]
        if k + 12 + n > len(b) or (k == at + 8 and (kind != b"IHDR" or n != 13)):
            return 0
        if zlib.crc32(b[k + 4 : k + 8 + n]) != struct.unpack_from(">I", b, k + 8 + n)[0]:
            return 0
        k += 12 + n
        if kind == b"IEND":
            return k - at
    return 0


def gif_length(b: bytes, at: int, ends: Ends) -> int:
    if len(b) < at + 14:
        return 0

    def blocks(k: int) -> int:
        while k < len(b) and b[k]:
            k += b[k] + 1
        return k + 1

    k = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while k < len(b):
        if b[k] == 0x3B:
            return k + 1 - at
        if b[k] == 0x21:
            k = blocks(k + 2)
        elif b[k] == 0x2C and k + 10 < len(b):
            k = blocks(k + 11 + (3 << ((b[k + 9] & 7) + 1) if b[k + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def jpeg_length(b: bytes, at: int, ends: Ends) -> int:
    k = at + 2
    while k + 4 <= len(b) and b[k] == 0xFF:
        n = struct.unpack_from(">H", b, k + 2)[0]
        if n < 2:
            return 0
        if b[k + 1] == 0xDA:
            nth = bisect_left(ends.jpeg, k + 2 + n)
            return ends.jpeg[nth] + 2 - at if nth < len(ends.jpeg) else 0
        k += 2 + n
    return 0


def zip_length(b: bytes, at: int, ends: Ends) -> int:
    """Up to the first end record that fits its own offsets: stored archives have end records of their own before it."""
    return max(0, ends.zip.get(at, 0) - at)


def gzip_length(b: bytes, at: int, ends: Ends) -> int:
    d = zlib.decompressobj(31)
    try:
        data = memoryview(b)[at:]
        while not d.eof and len(data):
            d.decompress(data, 1 << 20)
            data = d.unconsumed_tail
    except zlib.error:
        return 0
    return len(b) - at - len(d.unused_data) if d.eof else 0


def pdf_length(b: bytes, at: int, ends: Ends) -> int:
    """Up to the last end mark of this file, and the white space after it.

    Updates append further end marks. Past another header an end mark is this file's only if
    its startxref leads to a table or object that was appended too.
    """
    starts, stops = ends.pdf
    n, end = bisect_left(starts, at), 0
    while n < len(starts):
        if not end or bisect_left(ends.pdf_headers, end) == bisect_right(ends.pdf_headers, starts[n] - len("%PDF-")):
            # up to the next header all end marks are this file's
            header = bisect_left(ends.pdf_headers, stops[n])
            n = bisect_left(starts, ends.pdf_headers[header]) if header < len(ends.pdf_headers) else len(starts)
            end = stops[n - 1]
            continue
        taken = ends.next_of(at, end, n)
        if taken is None:
            break
        end, n = stops[taken], taken + 1
    return end - at if end else 0


VALIDATORS: dict[str, Callable[[bytes, int, Ends], int]] = {
    "audio/wav": wav_length,
    "image/bmp": bmp_length,
    "image/png": png_length,
    "image/gif": gif_length,
    "image/jpeg": jpeg_length,
    "application/zip": zip_length,
    "application/gzip": gzip_length,
    "application/pdf": pdf_length,
}


def automaton():
    state = worker_state()
    if not hasattr(state, "signatures"):
        import ahocorasick

        state.signatures = ahocorasick.Automaton()
        for magic, kind in SIGNATURES.items():
            state.signatures.add_word(magic.decode("latin-1"), (len(magic), kind))
        state.signatures.make_automaton()
    return state.signatures


def carve(data: bytes) -> list[tuple[int, int, str, int | None]]:
    """(start, length, type, start of the parent) of all confirmed media by start; the parent is None for those that lie in no other."""
    found, around, ends = [], [], Ends(data)
    for last, (n, kind) in automaton().iter(data.decode("latin-1")):
        at = last + 1 - n
        while around and around[-1][1] <= at:
            around.pop()
        length = VALIDATORS[kind](data, at, ends)
        if length and (not around or at + length <= around[-1][1]):
            found.append((at, length, kind, around[-1][0] if around else None))
            around.append((at, at + length))
    return found


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(start, length, type) of all confirmed media that lie in no other, by start."""
    return [(at, length, kind) for at, length, kind, parent in carve(data) if parent is None]


def true_type(data: bytes, found: list[tuple[int, int, str]]) -> str:
    return next((kind for at, length, kind in found if at == 0 and length == len(data)), UNKNOWN)


def sniff_media(media: DataFrame, *, column: str = "media", declared: str = "declared_type") -> DataFrame:
    """media with true_type, corrected and embedded (start, length, type and parent of what was carved) added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("parent", pa.int64())]))
        for whole in batches:
            for batch in parts(whole, whole.schema.get_field_index(column)):
                types, corrected, embedded = [], [], []
                for data, said in zip(batch.column(column).to_pylist(), batch.column(declared).to_pylist(), strict=True):
                    found = carve(data or b"")
                    types.append(true_type(data or b"", [(s, n, t) for s, n, t, parent in found if parent is None]))
                    corrected.append(types[-1] != said)
                    embedded.append([{"start": s, "length": n, "type": t, "parent": p} for s, n, t, p in found if n < len(data)])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(types, pa.string()), pa.array(corrected, pa.bool_()), pa.array(embedded, kind)],
                    names=[*batch.schema.names, "true_type", "corrected", "embedded"],
                )

    added = "true_type string, corrected boolean, embedded array<struct<start:bigint,length:bigint,type:string,parent:bigint>>"
    have = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    return media.mapInArrow(run, f"{have}, {added}")


def payload_of(raw: bytes) -> bytes:
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_wav(payload: bytes) -> bytes:
    rate = 8000
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    return media[44:]


def to_bmp(payload: bytes) -> bytes:
    head = struct.pack("<IIIIiiHHIIiiII", 54 + len(payload), 0, 54, 40, ROW_PIXELS, -(len(payload) // UNIT), 1, 24, 0, len(payload), 0, 0, 0, 0)
    return b"BM" + head + payload


def from_bmp(media: bytes) -> bytes:
    return media[54:]


def to_png(payload: bytes) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + payload[k : k + UNIT] for k in range(0, len(payload), UNIT))
    head = struct.pack(">IIBBBBB", ROW_PIXELS, len(payload) // UNIT, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    rows, k = b"", 8
    while k < len(media):
        n = struct.unpack_from(">I", media, k)[0]
        if media[k + 4 : k + 8] == b"IDAT":
            rows += media[k + 8 : k + 8 + n]
        k += 12 + n
    rows = zlib.decompress(rows)
    return b"".join(rows[k + 1 : k + 1 + UNIT] for k in range(0, len(rows), UNIT + 1))


# The three forms of storage, by payload checksum modulo 3.
FORMS = [("audio/wav", to_wav, from_wav), ("image/bmp", to_bmp, from_bmp), ("image/png", to_png, from_png)]


def texts_to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, declared_type (that of unknown bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, 1):
                sizes, media = [], []
                for text in batch.column(1).to_pylist():
                    raw = text.encode()
                    payload = payload_of(raw)
                    sizes.append(len(raw))
                    media.append(FORMS[zlib.crc32(payload) % 3][1](payload))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array([UNKNOWN] * len(media), pa.string())],
                    names=["doc_id", "n_bytes", "media", "declared_type"],
                )

    byte_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary, declared_type string")


def media_digest(sniffed: DataFrame) -> DataFrame:
    """Payload and features, read back from media whose type was sniffed."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = {kind: back for kind, _, back in FORMS}
        for whole in batches:
            for part in parts(whole, whole.schema.get_field_index("media")):
                out = []
                for row in part.to_pylist():
                    media = row["media"]
                    payload = read[row["true_type"]](media)
                    kinds = sorted(e["type"] for e in row["embedded"])
                    feature = f"type={row['true_type']};corrected={int(row['corrected'])};samples={len(payload)};mean={sum(payload) // len(payload)};peak={max(payload)};embedded={'+'.join(kinds) or 'none'}"
                    out.append((row["doc_id"], row["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in fields.split(", ")]
                )

    return sniffed.mapInArrow(run, fields)
