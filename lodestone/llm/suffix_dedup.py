"""Suffix-array dedup: every byte that a repeated string of `length` bytes covers goes.

A string of `length` bytes is named after its anchor, the position among its first half
whose 8-byte gram has the least hash; equal strings have their anchors at the same
offset. The `length` - reach + 1 bytes from the anchor on (reach: half the length) belong
to every string named after it, and their hash is the anchor's key. Keys that stand only
once in the corpus are dropped, in a stream over sorted keys, before any text is moved.

What is left is dealt out by key, each anchor with the bytes around it. A part's anchors,
each written as the name of its key and then the bytes after it in blocks of eight, form
a text whose suffix array (linear grouping construction) puts anchors with long common
continuations next to each other. From the common lengths of neighbours follow, for each
number l of bytes before the anchor, the stretches of anchors that agree in the
`length` - l bytes after it; inside a stretch, anchors that also agree in the l bytes before
it have a string in common.

Frequent keys: of the anchors of one task that agree in all bytes around them, the first
two go on and the others are settled there, as the same strings cover them; that happens
before keys are dealt out (within a slice of texts and, for what repeats there, within the
task) and once more when the bytes around are fetched. Which ones go on depends on the rows
alone, not on the order in which blocks arrive, so a task that runs again decides alike. A
key with more than many_anchors anchors is split by l: for each ten values of l, the bytes
that all strings of these l share, at least `length` - 9, are the key.

Edge cases: a null or empty text has no bytes; texts shorter than `length` stay whole;
rows equal in doc_id and text are two texts, so all of their strings repeat; a null
doc_id stays null; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_ID, ROW_KEY, byte_batches, keyed, parts
from .shingles import STEP, mixed, powers
from .suffix_array import suffix_array

LENGTH, GRAM = 200, 8
MANY_ANCHORS = 2_000
L_SPLIT = 10
PART_ANCHORS = 5_000
FREQUENT = 10_000
BLOCK = 8
LOW = np.uint64((1 << 40) - 1)
SALT = np.uint64(0xA0761D6478BD642F)
PLACE = [ROW_ID, ROW_KEY]


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    have, n = h, 1
    while 2 * n <= w:
        have = np.minimum(have[:-n], have[n:])
        n *= 2
    return np.minimum(have[: len(have) - (w - n)], have[w - n :]) if w > n else have


def gram_hashes(buf: bytes) -> np.ndarray:
    m = len(buf) - GRAM + 1
    out = np.empty(m, np.uint64)
    for k in range(min(GRAM, m)):
        part = np.frombuffer(buf, "<u8", count=(len(buf) - k) // GRAM, offset=k)
        out[k::GRAM] = part[: len(out[k::GRAM])]
    return mixed(out)


class Hashes:
    """Hashes of any range of a buffer."""

    def __init__(self, a: np.ndarray):
        self.up, self.down = powers(len(a) + 1)
        self.sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self.up[: len(a)], out=self.sums[1:])

    def of(self, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[start + n] - self.sums[start]) * self.down[start] + np.uint64(0) + np.asarray(n).astype(np.uint64))


def anchors_of(buf: bytes, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """doc, anchor, least l, greatest l, for all documents of a buffer; anchors are places in the buffer."""
    reach = length // 2
    if len(buf) < length:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    h = gram_hashes(buf)
    tagged = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_min(tagged, reach) & LOW).astype(np.int64)
    starts = np.arange(len(buf) - length + 1)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    fits = starts + length <= bounds[doc + 1]
    starts, doc, at = starts[fits], doc[fits], at[: len(fits)][fits]
    if not len(starts):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(at)])) - 1
    anchor = at[first]
    return doc[first], anchor, anchor - starts[last], anchor - starts[first]


def nth_of(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value how many equal ones stand before it, and how many there are."""
    by = np.argsort(whole, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], whole[by][1:] != whole[by][:-1])))[: len(by)]
    count = np.diff(np.concatenate((first, [len(by)])))
    nth, times = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
    nth[by], times[by] = np.arange(len(by)) - np.repeat(first, count), np.repeat(count, count)
    return nth, times


def all_around(hashes: Hashes, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Hash of all bytes that the strings named after an anchor cover, and of where it stands among them."""
    return hashes.of(anchor - high, high + length - low) ^ mixed((high << 8 | low).astype(np.uint64))


def spread(whole: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys that deal settled anchors evenly."""
    return mixed(whole + np.arange(len(whole), dtype=np.uint64) + ids.astype(np.uint64))


def anchor_keys(docs: DataFrame, length: int) -> DataFrame:
    """_row_id, _row_key, key, packed (anchor << 16 | least l << 8 | greatest l) for every anchor; for those settled here a random key and -1 - packed."""
    reach = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent: set[int] = set()  # of these, two have gone on already
        for whole in batches:
            for part in parts(whole, 2):
                texts = [t.encode() for t in part.column(2).to_pylist()]
                bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
                buf = b"".join(texts)
                doc, anchor, low, high = anchors_of(buf, bounds, length)
                hashes = Hashes(np.frombuffer(buf, np.uint8))
                key = hashes.of(anchor, length - reach + 1)
                packed = (anchor - bounds[doc]) << 16 | low << 8 | high
                ids = [part.column(k).to_numpy()[doc] for k in (0, 1)]
                around = all_around(hashes, anchor, low, high, length)
                nth, times = nth_of(around)
                settled = nth >= 2
                if frequent:
                    settled |= np.isin(around, np.fromiter(frequent, np.uint64, len(frequent)))
                if len(frequent) < FREQUENT:
                    frequent.update(around[(times > 2) & (nth == 0)].tolist())
                key = np.where(settled, spread(around, ids[0]), key)
                packed = np.where(settled, -1 - packed, packed)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*ids, key.view(np.int64), packed)], names=[*PLACE, "key", "packed"])

    return docs.mapInArrow(run, f"{ROW_ID} long, {ROW_KEY} long, key long, packed long")


def shared_keys(anchors: DataFrame, many: int) -> DataFrame:
    """Anchors whose key stands twice or more, and whether it stands more than many times; settled ones as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept(rows: list[np.ndarray]) -> pa.RecordBatch:
            key = rows[2]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            count = np.diff(np.concatenate((first, [len(key)])))
            n = np.repeat(count, count)
            goes = (n > 1) | (rows[3] < 0)
            return pa.RecordBatch.from_arrays([*(pa.array(r[goes]) for r in rows[:2]), pa.array(rows[3][goes]), pa.array((n[goes] > many) & (rows[3][goes] >= 0))], names=[*PLACE, "packed", "many"])

        rest: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            last = int(np.searchsorted(columns[2], columns[2][-1])) if batch.num_rows else 0
            if last:  # the last key may go on in the next batch
                yield kept([np.concatenate([*(r[k] for r in rest), c[:last]]) for k, c in enumerate(columns)])
                rest = []
            rest.append([c[last:] for c in columns])
        if rest:
            yield kept([np.concatenate([r[k] for r in rest]) for k in range(4)])

    return anchors.repartition("key").sortWithinPartitions("key").select(*PLACE, "key", "packed").mapInArrow(run, f"{ROW_ID} long, {ROW_KEY} long, packed long, many boolean")


FOUND = f"{ROW_ID} long, {ROW_KEY} long, start long, end long"
AROUND = f"{ROW_ID} long, {ROW_KEY} long, key long, anchor long, low int, high int, before binary, after binary"


def surroundings(docs: DataFrame, anchors: DataFrame, length: int) -> DataFrame:
    """Every anchor with key, l from low to high, and the bytes around it; those settled here have a random key and low -1."""
    reach = length // 2
    core = length - reach + 1
    # equal rows have equal anchors: each stands once in the list that all of them get
    lists = anchors.groupBy(*PLACE).agg(F.collect_set(F.col("packed") * 2 + F.col("many").cast("int")).alias("packed"))
    joined = docs.join(lists, PLACE).select(*PLACE, "text", "packed")

    def of_slice(part: pa.RecordBatch) -> list:
        """The columns of AROUND but for the bytes, the hash of all bytes around, whether settled before, the buffer, and where the bytes stand in it."""
        texts = [t.encode() for t in part.column(2).to_pylist()]
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        counts = pa.compute.list_value_length(part.column(3)).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(part.num_rows), counts)
        packed = part.column(3).flatten().to_numpy()
        packed, many = packed >> 1, packed & 1 == 1
        settled = packed < 0
        packed = np.where(settled, -1 - packed, packed)
        by = np.lexsort((~many, settled, packed, doc))  # lists come in any order
        doc, packed, settled, many = doc[by], packed[by], settled[by], many[by]
        once = np.ones(len(doc), bool)  # of an anchor that is settled in some of the equal rows only, the one that goes on
        once[1:] = (doc[1:] != doc[:-1]) | (packed[1:] != packed[:-1])
        doc, packed, settled, many = doc[once], packed[once], settled[once], many[once]
        buf = b"".join(texts)
        low, high, anchor = packed >> 8 & 255, packed & 255, (packed >> 16) + bounds[doc]
        hashes = Hashes(np.frombuffer(buf, np.uint8))
        # anchors of frequent keys once for each L_SPLIT values of l
        times = np.where(many, high // L_SPLIT - low // L_SPLIT + 1, 1)
        row = np.repeat(np.arange(len(packed)), times)
        k = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + (low // L_SPLIT)[row]
        split = many[row]
        l0 = np.where(split, np.maximum(low[row], k * L_SPLIT), low[row])
        l1 = np.where(split, np.minimum(high[row], k * L_SPLIT + L_SPLIT - 1), high[row])
        base, top = np.where(split, k * L_SPLIT, 0), np.where(split, np.minimum(k * L_SPLIT + L_SPLIT - 1, reach - 1), reach - 1)
        a = anchor[row]
        key = hashes.of(a - base, base + length - top) ^ mixed(base.astype(np.uint64))
        whole = all_around(hashes, a, l0, l1, length) ^ key
        return [part.column(0).to_numpy()[doc[row]], part.column(1).to_numpy()[doc[row]], key, a - bounds[doc[row]], l0, l1, whole, settled[row], buf, a]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        seen: dict[int, int] = {}
        for batch in batches:
            for part in parts(batch, 2):
                ids, keys, key, anchor, low, high, whole, settled, buf, at = of_slice(part)
                if len(seen) > 1_000_000:
                    seen = {}
                # the first two that agree in all go on and find each other; the rest are settled
                left = np.flatnonzero(~settled)
                of_left = whole[left]
                nth, _ = nth_of(of_left)
                first = left[nth + np.fromiter((seen.get(w, 0) for w in of_left.tolist()), np.int64, len(left)) < 2]
                for w in whole[first].tolist():
                    seen[w] = seen.get(w, 0) + 1
                told = np.ones(len(whole), bool)
                told[first] = False
                for rows, is_told in ((first, False), (np.flatnonzero(told), True)):
                    n = len(rows)
                    dealt = spread(whole[rows], ids[rows]) if is_told else key[rows]
                    none = [b""] * n
                    # the strings named after an anchor lie between these
                    before, after = at[rows] - high[rows], at[rows] + length - low[rows]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[rows]), pa.array(keys[rows]), pa.array(dealt.view(np.int64)), pa.array(anchor[rows]),
                            pa.array(np.where(is_told, -1 - low[rows], low[rows]).astype(np.int32)), pa.array(high[rows].astype(np.int32)),
                            pa.array(none if is_told else [buf[x:y] for x, y in zip(before.tolist(), at[rows].tolist(), strict=True)], pa.binary()),
                            pa.array(none if is_told else [buf[x:y] for x, y in zip((at[rows] + core).tolist(), after.tolist(), strict=True)], pa.binary()),
                        ],
                        names=[*PLACE, "key", "anchor", "low", "high", "before", "after"],
                    )

    return joined.mapInArrow(run, AROUND)


def padded(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)


def continuations(name: np.ndarray, right: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Anchors in the order of key and of the bytes after them: from the suffix array of the text in which each anchor is its key's name and its n_bytes bytes in blocks.

    Names of keys lie below those of blocks, so where the bytes of an anchor end, it comes before those that go on.
    """
    m, blocks = len(name), -(-n_bytes // BLOCK)
    wide = np.zeros((m, -(-right.shape[1] // BLOCK) * BLOCK), np.uint8)
    wide[:, : right.shape[1]] = right
    values = wide.view(">u8").astype(np.uint64)
    _, named = np.unique(values[np.arange(values.shape[1]) < blocks[:, None]], return_inverse=True)
    start = np.cumsum(blocks + 1) - blocks - 1
    text = np.zeros(int(blocks.sum()) + m + 1, np.int64)
    is_key = np.zeros(len(text), bool)
    is_key[start] = True
    inside = ~is_key
    inside[-1] = False
    text[start], text[inside] = name + 1, named + 1 + m
    anchor = np.where(is_key, np.cumsum(is_key) - 1, -1)
    order = anchor[np.array(suffix_array(text.tolist()))]
    return order[order >= 0]


def repeated_ls(key: np.ndarray, low: np.ndarray, high: np.ndarray, before: list[bytes], after: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest l of each anchor at which its string repeats here; -1 for none."""
    reach, m = length // 2, len(key)
    width = max(1, reach - 1)
    right = padded(after, width)
    _, name = np.unique(key, return_inverse=True)
    order = continuations(name, right, np.array([len(b) for b in after], np.int64))
    # bytes that neighbours in order have in common after the core, where both have them
    above, below = order[:-1], order[1:]
    unlike = right[above] != right[below]
    common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
    common = np.minimum(common, width)
    common[name[above] != name[below]] = -1
    left = padded([b[::-1] for b in before], width)
    least, most = np.full(m, -1), np.full(m, -1)
    hashes = np.zeros(m, np.uint64)
    low, high, left = low[order], high[order], left[order]
    with np.errstate(over="ignore"):
        for l in range(int(low.min()), reach) if m else ():  # noqa: E741
            if l == int(low.min()):
                for k in range(l):
                    hashes = mixed(hashes + left[:, k].astype(np.uint64) + np.uint64(1))
            elif l:
                hashes = mixed(hashes + left[:, l - 1].astype(np.uint64) + np.uint64(1))
            rows = np.flatnonzero((low <= l) & (l <= high))
            if len(rows) < 2:
                continue
            stretch = np.concatenate(([0], np.cumsum(common < reach - 1 - l)))[rows]
            both = mixed(mixed(hashes[rows] ^ SALT) * STEP + stretch.astype(np.uint64))
            by = np.argsort(both, kind="stable")
            same = both[by[1:]] == both[by[:-1]]
            hit = np.zeros(len(rows), bool)
            hit[by[1:][same]] = True
            hit[by[:-1][same]] = True
            found = order[rows[hit]]
            most[found] = l
            least[found[least[found] < 0]] = l
    return least, most


def repeated_spans(around: DataFrame, length: int) -> DataFrame:
    """Spans covered by repeated strings: _row_id, _row_key, start, end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(part: pa.Table) -> pa.RecordBatch:
            ids, keys, key, anchor, low, high = (part.column(k).to_numpy() for k in range(6))
            least, most = np.where(low < 0, -1 - low, -1).astype(np.int64), np.where(low < 0, high, -1).astype(np.int64)
            open_ = np.flatnonzero(low >= 0)
            if len(open_):
                sub = part.take(pa.array(open_))
                least[open_], most[open_] = repeated_ls(key[open_], low[open_].astype(np.int64), high[open_].astype(np.int64), sub.column(6).to_pylist(), sub.column(7).to_pylist(), length)
            hit = most >= 0
            return pa.RecordBatch.from_arrays([pa.array(c[hit]) for c in (ids, keys, anchor - most, anchor - least + length)], names=[*PLACE, "start", "end"])

        rest: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            key = batch.column(2).to_numpy()
            last = int(np.searchsorted(key, key[-1])) if batch.num_rows else 0
            if last and held + last >= PART_ANCHORS:  # whole keys only
                yield spans(pa.Table.from_batches([*rest, batch.slice(0, last)]))
                rest, held = [batch.slice(last)], batch.num_rows - last
            else:
                rest.append(batch)
                held += batch.num_rows
        if rest:
            yield spans(pa.Table.from_batches(rest))

    return around.repartition("key").sortWithinPartitions("key").mapInArrow(run, FOUND)


def suffix_dedup(docs: DataFrame, *, length: int = LENGTH, many_anchors: int = MANY_ANCHORS) -> DataFrame:
    """_row_id, _row_key, text and spans (start, end of merged repeated runs, in bytes) of every row of docs."""
    rows = keyed(docs)
    byte_batches(docs.sparkSession)
    anchors = shared_keys(anchor_keys(rows, length), many_anchors)
    spans = repeated_spans(surroundings(rows, anchors, length), length)
    by_doc = spans.groupBy(*PLACE).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return rows.join(by_doc, PLACE, "left")


def kept_bytes(raw: bytes, spans: list) -> tuple[bytes, int]:
    """What is left, and the number of merged runs."""
    out, at, runs = [], 0, 0
    for s in spans or []:
        start, end = s["start"], s["end"]
        if start > at or not runs:
            out.append(raw[at:start])
            runs += 1
        at = max(at, end)
    out.append(raw[at:])
    return b"".join(out), runs


def suffix_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of suffix_dedup."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, 1):
                out = []
                for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    raw = text.encode()
                    kept, runs = kept_bytes(raw, spans)
                    out.append((len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=names)

    doc_id = F.when(F.col(ROW_ID) != -(2**63), F.col(ROW_ID)).alias("doc_id")
    return found.select(doc_id, "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
