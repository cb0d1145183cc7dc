"""Suffix-array deduplication of byte strings that repeat anywhere in a corpus.

Every ``LENGTH``-byte window has a canonical anchor: the leftmost of its ``GRAM``-byte grams of least
hash, which its content alone decides, and so does the anchor's offset in it. Neighbouring windows
with one anchor and an offset in the same half of the possible ones form a segment. All windows of a
half hold one core: the anchor and the ``REACH`` bytes on one of its sides. Equal windows have equal
cores, so segments meet by the hash of their core:

1. segments that are equal as a whole (by a second 64-bit hash) collapse to their first occurrence; a
   batch of texts does so on its own before anything is shuffled, so a passage of very many copies is
   no hot key;
2. a core with several different segments sends the bytes of their first occurrences to one task. It
   builds a suffix array by two-stage sorting: of the suffixes that matter only those smaller than
   their successors are sorted, the others are induced by scans over the buckets of first bytes.
   Adjacent common prefixes of LENGTH bytes or more then join equal windows, and the first stays;
3. a core whose segments exceed the bytes of one array is split: each of its segments is cut into two
   halves of its range of offsets, and each half goes by the longer core its windows share. Windows
   are parted and never repeated, equal ones stay together, and at a range of one offset a core is
   the window itself, so that rows pass in order with nothing held.

Offsets are of the UTF-8 text, and all decisions are about the input, not about what is left.

Defined results: a null text counts as empty; texts shorter than LENGTH lose nothing. A null doc_id
comes after all others. Different texts of one doc_id, and all rows without one, are documents of
their own, in the order of a hash of their texts; rows that repeat both doc_id and text are one.
Columns besides doc_id and text stay as they are, except ``length_col``; names that begin with two
underscores are taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexmill.llm.scratch import Scratch
from lexmill.llm.shingles import mix

LENGTH, GRAM = 100, 24
GRAMS = LENGTH - GRAM + 1
#: Anchor offsets up to this one form the near half, the others the far half.
REACH = (LENGTH - GRAM) // 2
#: Bytes hashed at once; window starts of longer texts are dealt in runs of this many.
CHUNK = 1 << 20
#: Low bits of a gram's hash that give way to its position; enough for CHUNK and two windows.
PLACE_BITS = 21
#: Bytes of the segments of one suffix array.
ARRAY_BYTES = 2_000_000

_U = np.uint64
_P = _U(0xD1342543DE82EF95)
_P_INVERSE = _U(pow(int(_P), -1, 2**64))
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 4 * LENGTH)
        for name, base in (("up", _P), ("down", _P_INVERSE)):
            table = np.full(size, base, dtype=_U)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"], _powers["down"]


class Hashes:
    """Hashes of substrings of one byte array by prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U))


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one big-endian number; zeros follow the end."""
    out = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(_U)
    for width in (1, 2, 4):
        out = (out[:-width] << _U(8 * width)) | out[width:]
    return out[: len(data)]


def segments(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of all windows of the texts data[begins:ends], CHUNK bytes or a little more in all."""
    none = {k: np.zeros(0, dtype=np.int64) for k in ("lo", "hi", "text", "offset")} | {k: np.zeros(0, dtype=_U) for k in ("core", "whole")}
    if len(data) < LENGTH:
        return none
    eight = eights(data)
    n = len(data) - GRAM + 1
    gram = mix(eight[:n] * _P + mix(eight[8 : n + 8] * _P + mix(eight[16 : n + 16])))
    bits = _U(PLACE_BITS)  # the same cut in every batch, so equal windows agree on their anchor
    low = ((gram >> bits) << bits) | np.arange(n, dtype=_U)
    width = 1
    while width * 2 <= GRAMS:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < GRAMS:
        low = np.minimum(low[: -(GRAMS - width)], low[GRAMS - width :])
    at = (low & ((_U(1) << bits) - _U(1))).astype(np.int64)
    counts = np.maximum(ends - begins - LENGTH + 1, 0)
    total = int(counts.sum())
    if not total:
        return none
    text = np.repeat(np.arange(len(begins)), counts)
    start = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)
    anchor = at[start]
    far = anchor - start > REACH
    fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (far[1:] != far[:-1])]
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], total] - 1
    lo, hi, p, text, far = start[first], start[last], anchor[first], text[first], far[first]
    hashes = Hashes(data)
    core = hashes.of(np.where(far, p - REACH - 1, p), np.where(far, p + GRAM, p + LENGTH - REACH))
    return {"lo": lo, "hi": hi, "text": text, "offset": p - lo, "core": mix(core + far.astype(_U)), "whole": hashes.of(lo, hi + LENGTH)}


def _place(lo: np.ndarray, span: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Start, last window's distance and anchor's offset in one long that sorts by start."""
    return (lo << 14) | (span << 7) | offset


def _runs(ids: list[int], raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, begins, ends, id of each, offset of each) of CHUNK bytes or so; long texts in overlapping pieces."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def made():
        lengths = np.array([len(b) for *_, b in parts])
        ends = np.cumsum(lengths)
        return np.frombuffer(b"".join(b for *_, b in parts), dtype=np.uint8), ends - lengths, ends, np.array([i for i, *_ in parts]), np.array([o for _, o, _ in parts])

    for i, b in zip(ids, raw, strict=True):
        for at in range(0, max(len(b) - LENGTH + 1, 0), CHUNK):
            piece = b[at : at + CHUNK + LENGTH - 1]
            if size + len(piece) > CHUNK + LENGTH and parts:
                yield made()
                parts, size = [], 0
            parts.append((i, at, piece))
            size += len(piece)
    if parts:
        yield made()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, whole, doc, place): a segment by its core, or with null ``whole`` a range that goes for sure."""
    for batch in batches:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for data, begins, ends, doc, offset in _runs(batch.column(0).to_pylist(), [(t or "").encode() for t in batch.column(1).to_pylist()]):
            s = segments(data, begins, ends)
            own = s["text"]
            cols[0].append(s["core"].astype(np.int64))
            cols[1].append(s["whole"].astype(np.int64))
            cols[2].append(doc[own])
            cols[3].append(_place(s["lo"] - begins[own] + offset[own], s["hi"] - s["lo"], s["offset"]))
        if not cols[0]:
            continue
        key, whole, doc, place = map(np.concatenate, cols)
        order = np.lexsort((place, doc, whole, key))
        key, whole, doc, place = key[order], whole[order], doc[order], place[order]
        gone = later(key, whole, doc, place)
        key = np.where(gone, mix(doc.astype(_U)).astype(np.int64), key)
        for at in range(0, len(key), 50_000):
            cut = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(whole[cut], mask=gone[cut]), pa.array(doc[cut]), pa.array(place[cut])], ["key", "whole", "doc", "place"])


def later(key: np.ndarray, whole: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of rows sorted by all four: which have an equal segment at an earlier document or start."""
    if not len(key):
        return np.zeros(0, dtype=bool)
    first = np.r_[True, (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])]
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    return ~((doc == doc[head]) & (place == place[head]))


def _ranges(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lo = place >> 14
    return doc, lo, lo + ((place >> 7) & 127) + LENGTH, place & 127


RESOLVED = "kind string, key long, doc long, lo long, hi long, offset long"


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges to remove ("gone"), and first occurrences of the different segments of a core ("some").

    Rows come sorted by all columns. Two rows at most wait for the next batch: the first segment of
    the last core, until another one shows that it is needed, and the first row of the last segment.
    """
    names = ("key", "whole", "doc", "place")
    held = tuple(np.zeros(0, np.int64) for _ in range(4))
    told = np.zeros(0, dtype=bool)  # of the held rows: left before

    def emitted(kind: str, key, doc, place) -> pa.RecordBatch:
        cols = [pa.array(np.asarray(c, dtype=np.int64)) for c in (key, *_ranges(doc, place))]
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(key), pa.string()), *cols], ["kind", "key", "doc", "lo", "hi", "offset"])

    for batch in batches:
        sure = batch.column("whole").is_null().to_numpy(zero_copy_only=False)
        if sure.any():
            own = batch.filter(pa.array(sure))
            yield emitted("gone", *(own.column(n).to_numpy() for n in ("key", "doc", "place")))
        rest = batch.filter(pa.array(~sure))
        if not rest.num_rows:
            continue
        key, whole, doc, place = (np.concatenate([h, rest.column(n).to_numpy()]) for h, n in zip(held, names, strict=True))
        left = np.r_[told, np.zeros(rest.num_rows, dtype=bool)]
        gone = later(key, whole, doc, place)
        if gone.any():
            yield emitted("gone", key[gone], doc[gone], place[gone])
        # a row equal to its segment's first one is a repeated row of that document
        head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])])
        key, whole, doc, place, left = key[head], whole[head], doc[head], place[head], left[head]
        several = np.zeros(len(key), dtype=bool)
        same = key[1:] == key[:-1]
        several[1:] |= same
        several[:-1] |= same
        need = several & ~left
        if need.any():
            yield emitted("some", key[need], doc[need], place[need])
        waits = np.unique([int(np.searchsorted(key == key[-1], True)), len(key) - 1])
        held = tuple(c[waits] for c in (key, whole, doc, place))
        told = left[waits] | several[waits]


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffixes at ``wanted`` positions (all, if None) in the order of their first ``depth`` bytes.

    Larger suffixes need the ranks of the ones after them up to the next smaller one; those take part
    and are left out of the result.
    """
    n = len(text)
    eight = eights(text)
    step = np.sign(np.diff(text.astype(np.int16)))
    step = np.r_[step, -1]  # the last suffix is larger than the empty one after it
    known = np.flatnonzero(step)
    smaller = step[known[np.searchsorted(known, np.arange(n))]] > 0
    part = np.ones(n, dtype=bool)
    if wanted is not None:
        stops = np.r_[np.flatnonzero(smaller), n - 1]
        reach = np.zeros(n + 1, dtype=np.int64)
        at = np.flatnonzero(wanted)
        reach[at] += 1
        np.subtract.at(reach, stops[np.searchsorted(stops, at)] + 1, 1)
        part = np.cumsum(reach[:n]) > 0
    # stage one: sort the suffixes that are smaller than their successors
    own = np.flatnonzero(smaller & part)
    order = own[np.argsort(eight[own], kind="stable")]
    group = np.cumsum(np.r_[0, eight[order][1:] != eight[order][:-1]]) if len(order) else order
    slots = np.arange(len(order))
    for shift in range(8, depth, 8):
        # what is tied now was tied before
        same = group[slots][1:] == group[slots][:-1]
        tied = np.zeros(len(slots), dtype=bool)
        tied[1:] |= same
        tied[:-1] |= same
        slots = slots[tied]
        if not len(slots):
            break
        at = order[slots] + shift
        word = np.where(at < n, eight[np.minimum(at, n - 1)], 0)
        inner = np.lexsort((word, group[slots]))
        order[slots] = order[slots][inner]
        word, g = word[inner], group[slots]
        # group numbers are slots of first members, so splitting one leaves the others alone
        starts = np.r_[True, (word[1:] != word[:-1]) | (g[1:] != g[:-1])]
        group[slots] = slots[np.flatnonzero(starts)][np.cumsum(starts) - 1] + len(order) * (1 + shift)
    # stage two: scan the buckets of first bytes in ascending order. A suffix whose predecessor is larger
    # puts it at the end of the larger part of its bucket, which comes before the smaller part
    before = text[np.maximum(np.arange(n) - 1, 0)]
    induces = np.r_[False, ~smaller[:-1] & part[:-1]]
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and part[-1]:  # induced by the empty suffix
        waiting[int(text[-1])].append(np.array([n - 1]))

    def scan(placed: np.ndarray, byte: int) -> np.ndarray:
        """Deal the larger predecessors of placed suffixes to their buckets; return those of this one."""
        found = placed[induces[placed]]
        to = before[found]
        split = np.argsort(to, kind="stable")
        found, to = found[split] - 1, to[split]
        cuts = np.flatnonzero(np.diff(to)) + 1
        mine = np.zeros(0, dtype=np.int64)
        for chunk in np.split(found, cuts) if len(found) else []:
            if text[chunk[0]] == byte:
                mine = chunk
            else:
                waiting[int(text[chunk[0]])].append(chunk)
        return mine

    first_small = np.searchsorted(text[order], np.arange(257))
    out: list[np.ndarray] = []
    for byte in np.unique(text).tolist():
        wave = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, dtype=np.int64)
        while len(wave):
            out.append(wave)
            wave = scan(wave, byte)
        small = order[first_small[byte] : first_small[byte + 1]]
        if len(small):
            out.append(small)
            scan(small, byte)
    found = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
    return found if wanted is None else found[wanted[found]]


def common_prefixes(text: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Length, ``most`` rounded up to 8 at most, of the common prefix of each suffix and the one before it."""
    eight = eights(text)
    out = np.zeros(len(at), dtype=np.int64)
    open_ = np.arange(1, len(at))
    for shift in range(0, most, 8):
        a, b = at[open_] + shift, at[open_ - 1] + shift
        inside = (a < len(text)) & (b < len(text))
        differ = eight[np.minimum(a, len(text) - 1)] ^ eight[np.minimum(b, len(text) - 1)]
        whole = inside & (differ == 0)
        out[open_[whole]] += 8
        part = inside & ~whole
        if part.any():
            out[open_[part]] += sum((differ[part] < _U(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        open_ = open_[whole]
    return out


def repeated_windows(pieces: list[bytes], doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of windows that occur in an earlier piece or earlier in their own; adjacent ones as one range."""
    lengths = np.array([len(p) for p in pieces])
    # no UTF-8 text holds 0xFF; a common prefix with one can't make a valid window equal to another
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", dtype=np.uint8)
    begins = np.cumsum(lengths + 1) - lengths - 1
    valid = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(valid, begins, 1)
    np.subtract.at(valid, begins + np.maximum(lengths - LENGTH + 1, 0), 1)
    order = suffix_array(text, LENGTH, np.cumsum(valid[:-1]) > 0)
    piece = np.searchsorted(begins, order, side="right") - 1
    equal = common_prefixes(text, order, LENGTH) >= LENGTH
    group = np.cumsum(~equal)
    start = lo[piece] + order - begins[piece]
    by = np.lexsort((start, doc[piece], group))
    group, piece, start, order = group[by], piece[by], start[by], order[by]
    first = np.searchsorted(group, group)
    gone = (doc[piece] != doc[piece[first]]) | (start != start[first])
    at = np.sort(order[gone])
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    heads, tails = at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]]
    piece = np.searchsorted(begins, heads, side="right") - 1
    return doc[piece], lo[piece] + heads - begins[piece], lo[piece] + tails - begins[piece] + LENGTH


SORTED = "kind string, key long, doc long, lo long, hi long, offset int, first int, last int, bytes binary"


def split_segment(row: dict) -> Iterator[tuple]:
    """The two halves of a segment's range of offsets, each keyed by the core that its windows share."""
    data, anchor, windows = row["bytes"], row["offset"], len(row["bytes"]) - LENGTH + 1
    middle = (row["first"] + row["last"]) // 2
    for first, last in ((row["first"], middle), (middle + 1, row["last"])):
        low, high = max(anchor - last, 0), min(anchor - first, windows - 1)
        if low <= high:
            core = data[anchor - first : anchor - last + LENGTH]
            key = int.from_bytes(hashlib.blake2b(core, digest_size=8, person=bytes([first, last])).digest(), "little", signed=True)
            yield key, row["doc"], row["lo"] + low, anchor - low, first, last, data[low : high + LENGTH]


def _sorted_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges to remove among segments that come sorted by key, in arrays of whole keys.

    Segments of a key that outgrows an array leave as kind "split", by longer cores; a range of one
    offset needs no array, as all its rows are one window.
    """
    held: list[dict] = []
    sizes = [0, 0]  # bytes held, and those of the last key
    now, splits, single = None, False, False

    def ranges(doc, lo, hi) -> pa.RecordBatch:
        n = len(doc)
        none = lambda t: pa.nulls(n, t)
        return pa.RecordBatch.from_arrays(
            [pa.array(["gone"] * n, pa.string()), none(pa.int64()), *(pa.array(np.asarray(c, dtype=np.int64)) for c in (doc, lo, hi)), none(pa.int32()), none(pa.int32()), none(pa.int32()), none(pa.binary())],
            ["kind", "key", "doc", "lo", "hi", "offset", "first", "last", "bytes"],
        )

    def halves(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        parts = [p for r in rows for p in split_segment(r)]
        if parts:
            key, doc, lo, offset, first, last, data = zip(*parts, strict=True)
            n, int_, long_ = len(parts), pa.int32(), pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pa.array(["split"] * n), pa.array(key, long_), pa.array(doc, long_), pa.array(lo, long_), pa.nulls(n, long_), pa.array(offset, int_), pa.array(first, int_), pa.array(last, int_), pa.array(data, pa.binary())],
                ["kind", "key", "doc", "lo", "hi", "offset", "first", "last", "bytes"],
            )

    def settled(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield ranges(*repeated_windows([r["bytes"] for r in rows], np.array([r["doc"] for r in rows]), np.array([r["lo"] for r in rows])))

    for batch in batches:
        same: list[tuple[int, int]] = []
        more: list[dict] = []
        for row in batch.to_pylist():
            if row["key"] != now:
                yield from halves(more)
                more = []
                if sizes[0] > ARRAY_BYTES:
                    yield from settled(held)
                    held, sizes[0] = [], 0
                now, splits, single, sizes[1] = row["key"], False, row["first"] == row["last"], 0
                if single:
                    continue  # the first occurrence stays
            if single:
                same.append((row["doc"], row["lo"]))
            elif splits:
                more.append(row)
            else:
                held.append(row)
                sizes[0] += len(row["bytes"])
                sizes[1] += len(row["bytes"])
                if sizes[1] > ARRAY_BYTES:
                    splits = True
                    more = [r for r in held if r["key"] == now]
                    held = [r for r in held if r["key"] != now]
                    sizes[0] -= sizes[1]
        yield from halves(more)
        if same:
            doc, lo = (np.array(c) for c in zip(*same, strict=True))
            yield ranges(doc, lo, lo + LENGTH)
    yield from settled(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each asked range (doc, text, asked) as rows of CUT."""
    for batch in batches:
        for doc, text, asked in zip(*(batch.column(n).to_pylist() for n in ("doc", "text", "asked")), strict=True):
            raw = (text or "").encode()
            rows = [(a["key"], doc, a["lo"], a["offset"], *((REACH + 1, GRAMS - 1) if a["offset"] > REACH else (0, REACH)), raw[a["lo"] : a["hi"]]) for a in asked if a["hi"] <= len(raw)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "doc", "lo", "offset", "first", "last", "bytes"])


CUT = "key long, doc long, lo long, offset int, first int, last int, bytes binary"


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` plus __doc, a long that tells documents apart and ascends in their order.

    It is the doc_id if no other row has it. Else the rows are dealt by range and numbered in their
    order; only those that repeat both doc_id and text share a number.
    """
    own = F.col("doc_id").cast("bigint")
    if docs.select(own.alias("id")).groupBy("id").count().filter("id IS NULL OR count > 1").isEmpty():
        return docs.withColumn("__doc", own)
    keys, columns = ["__none", "__id", "__hash", "__row"], docs.columns
    schema = StructType([*docs.schema.fields, StructField("__doc", LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            places = []
            for key in zip(*(batch.column(k).to_pylist() for k in keys), strict=True):
                place, last = place + (key != last), key
                places.append(place)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in columns), pa.array(places, pa.int64())], [*columns, "__doc"])

    # rows without an id are told apart by where they come from, so very many equal ones are no hot key
    row = F.when(own.isNull(), F.monotonically_increasing_id())
    keyed = docs.select("*", own.isNull().alias("__none"), own.alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__hash"), row.alias("__row"))
    return scratch.write(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, schema), "numbered")


def repeated_ranges(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, lo, hi): byte ranges of each of the numbered documents that earlier strings of LENGTH bytes cover; they may overlap."""
    texts = docs.select(F.col("__doc").alias("doc"), "text")
    found = texts.mapInArrow(_scan, "key long, whole long, doc long, place long")
    met = found.repartition("key").sortWithinPartitions("key", "whole", "doc", "place")
    resolved = scratch.write(met.mapInArrow(_resolve, RESOLVED), "resolved")
    gone = [resolved.filter("kind = 'gone'").select("doc", "lo", "hi")]
    wanted = resolved.filter("kind = 'some'").groupBy("doc").agg(F.collect_set(F.struct("key", "lo", "hi", "offset")).alias("asked"))
    wanted = scratch.write(wanted, "asked")  # its size tells Spark whether the texts need a shuffle
    open_ = texts.join(wanted, "doc").select("doc", "text", "asked").mapInArrow(_cut, CUT)
    # each round halves a range of offsets, so log2(GRAMS) rounds end at single windows
    for k in range(GRAMS.bit_length() + 1):
        met = open_.repartition("key").sortWithinPartitions("key", "doc", "lo").mapInArrow(_sorted_arrays, SORTED)
        met = scratch.write(met, f"sorted{k}")
        gone.append(met.filter("kind = 'gone'").select("doc", "lo", "hi"))
        open_ = met.filter("kind = 'split'").select("key", "doc", "lo", "offset", "first", "last", "bytes")
        if open_.isEmpty():
            break
    every = gone[0]
    for more in gone[1:]:
        every = every.unionByName(more)
    return every


def merged(spans: list | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of (lo, hi) spans, within ``size`` bytes."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], min(s["hi"], size)) for s in spans or () if s["lo"] < size):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for lo, hi in runs:
        parts.append(raw[at:lo])
        at = hi
    return b"".join([*parts, raw[at:]])


def with_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` plus __spans, the list of its ranges to remove (null: none)."""
    docs = numbered(docs, scratch)
    ranges = repeated_ranges(docs, scratch)
    per_doc = scratch.write(ranges.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("__spans")), "spans")
    per_doc = per_doc.withColumnRenamed("doc", "__of")
    return docs.join(per_doc, F.col("__doc") == F.col("__of"), "left").drop("__doc", "__of")


def report(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                raw = (text or "").encode()
                runs = merged(spans, len(raw))
                rows.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(raw, runs)).hexdigest()))
            if rows:
                n, removed, spans, names = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(names)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_spans(docs.select("doc_id", "text"), scratch).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, scratch: Scratch, length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text``; a character that a cut divides goes with it."""
    spanned = with_spans(docs, scratch)

    @F.pandas_udf("string")
    def cut(text, spans):
        out = []
        for t, s in zip(text, spans, strict=True):
            if t is not None and s is not None and len(s):
                raw = t.encode()
                t = kept_bytes(raw, merged(list(s), len(raw))).decode("utf-8", "ignore")
            out.append(t)
        return pd.Series(out, dtype=object)

    changed = spanned.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(cut("text", "__spans"))).drop("__spans")
    if length_col in docs.columns:
        changed = changed.withColumn(length_col, F.length("text").cast(docs.schema[length_col].dataType))
    return changed.select(*docs.columns)
