"""Hashed word shingles of whole texts, computed over many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Texts per slice hold about this many characters.
SLICE_CHARS = 2_000_000
#: Bytes whose words are hashed at once, or one longer word.
PIECE_BYTES = 4_000_000

_U = np.uint64
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = _U(0xD1342543DE82EF95)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, with A-Z lower-cased, and how many each text has.

    Bytes are looked at in pieces of about PIECE_BYTES that end at a separator, so the arrays that
    hold several numbers a byte stay small also for one very long text.
    """
    raw = [b"" if t is None else t.encode().lower() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    out, per_text, at = [], np.zeros(len(raw), dtype=np.int64), 0
    while at < len(data):
        stop = at + PIECE_BYTES
        while stop < len(data) and not (more := np.flatnonzero(_SEPARATOR[data[stop - 1 : stop + PIECE_BYTES]])).size:
            stop += PIECE_BYTES
        stop = len(data) if stop >= len(data) else stop + int(more[0])
        found, starts = _piece_hashes(data[at:stop])
        out.append(found)
        np.add.at(per_text, np.searchsorted(ends, starts + at, side="right"), 1)
        at = stop
    return np.concatenate(out) if out else np.zeros(0, dtype=_U), per_text


def _piece_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in bytes that end with a separator, and where each begins."""
    inside = ~_SEPARATOR[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=_U), starts
    lengths = ends - starts
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    power = np.cumprod(np.full(int(lengths.max()), _BASE, dtype=_U))
    value = _BYTE[data[inside]] * power[at]
    return mix(np.add.reduceat(value, np.cumsum(lengths) - lengths) + lengths.astype(_U)), starts


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's set of shingle hashes, sorted; a text of fewer words is one shingle, no word none."""
    word, per_text = word_hashes(texts)
    folded = word.copy()
    for k in range(1, min(WORDS, len(word))):
        folded[: len(word) - k] = mix(folded[: len(word) - k] * _BASE + word[k:])
    out, at = [], 0
    for n in per_text.tolist():
        if n >= WORDS:
            out.append(np.unique(folded[at : at + n - WORDS + 1]))
        elif n:
            whole = word[at : at + 1]
            for k in range(1, n):
                whole = mix(whole * _BASE + word[at + k : at + k + 1])
            out.append(mix(whole + _U(n)))
        else:
            out.append(np.zeros(0, dtype=_U))
        at += n
    return out


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """(first index, whole texts) of about SLICE_CHARS characters each."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE_CHARS:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def set_name(shingles: np.ndarray) -> bytes:
    """A 128-bit name of a sorted set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
