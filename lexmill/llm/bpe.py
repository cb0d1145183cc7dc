"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The distinct words of a batch become one flat array of symbols. A round looks up every adjacent
pair by binary search over the sorted pair keys, takes each word's lowest rank, merges all
occurrences of it, and compacts the array; words without a known pair leave. Rounds end when no
word is left, so their number follows the longest word and not the number of words. Words of more
than ``LONG`` bytes, which would need very many rounds, go by rounds of one rank each, in ascending
order over all of them: a round touches the places of that rank and their neighbours only.

Defined results: a null text counts as empty (no ids, empty decoded text). Texts are never cut:
a batch is processed in slices of about ``SLICE_CHARS`` characters, each holding whole texts.
Repeated rows give repeated results. Columns besides the text and those to keep are not read; one
of the kept columns must not have the name of an output.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts per slice hold about this many characters, which bounds a worker's memory.
SLICE_CHARS = 2_000_000
#: Distinct words remembered between slices.
CACHE_WORDS = 600_000
#: Bytes of a word that rounds over whole words still suit.
LONG = 64

# Fixed value: the published byte-level pre-tokenizer pattern, with \s spelled as the Unicode property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """Tables of one vocabulary, read from a tokenizers JSON file; small and of fixed size."""

    def __init__(self, spec: str):
        doc = json.loads(spec)
        vocab, merges = doc["model"]["vocab"], doc["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[c] for c in symbols], dtype=np.int64)
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in merges]
        self.span = max([*vocab.values(), *self.special.values()]) + 1
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        key = left * self.span + right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank_of_key, self.made_by_rank = key[order], order.astype(np.int64), made
        # merging all occurrences of a word's lowest pair at once is exact only if a made symbol
        # never takes part in an earlier merge
        first = np.full(self.span, -1, dtype=np.int64)
        np.maximum.at(first, made, np.arange(len(made)))
        if (first[left] >= np.arange(len(left))).any() or (first[right] >= np.arange(len(right))).any():
            raise ValueError("merge ranks of this vocabulary are not ordered by construction")
        to_byte = {c: b for b, c in enumerate(symbols)}
        self.piece = [b""] * self.span
        for token, i in [*vocab.items(), *self.special.items()]:
            known = all(c in to_byte for c in token)
            self.piece[i] = bytes(to_byte[c] for c in token) if known else token.encode()
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("pattern", "cut", "cache")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache = {}

    def rank_of_pairs(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Merge rank of the pair that begins at each position, by binary search over the pair keys."""
        after = np.minimum(at + 1, symbol.size - 1)
        key = symbol[at] * self.span + symbol[after]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[found] == key) & (word[at] == word[after]) & (after > at)
        return np.where(hit, self.rank_of_key[found], len(self.made_by_rank))

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long:
            return self.merge_short(words)
        at = set(long)
        short = [i for i in range(len(words)) if i not in at]
        out: list[bytes] = [b""] * len(words)
        for chosen, merged in ((short, self.merge_short), (long, self.merge_long)):
            for i, ids in zip(chosen, merged([words[i] for i in chosen]), strict=True):
                out[i] = ids
        return out

    def merge_long(self, words: list[bytes]) -> list[bytes]:
        """The same by rounds of one rank each, over linked symbols.

        A merge makes pairs of higher ranks only, so each rank has its turn once.
        """
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbol = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ends = np.cumsum(sizes)
        n, none = symbol.size, len(self.made_by_rank)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        alive = np.ones(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def ranked(at: np.ndarray) -> np.ndarray:
            key = symbol[at] * self.span + symbol[after[at]]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return np.where(self.keys[found] == key, self.rank_of_key[found], none)

        def wait(at: np.ndarray) -> None:
            rank = ranked(at)
            at, rank = at[rank != none], rank[rank != none]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True) if len(at) else ():
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(part)

        wait(np.flatnonzero(after >= 0))
        while ranks:
            rank = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[alive[at] & (after[at] >= 0)]
            at = at[ranked(at) == rank]
            if not len(at):
                continue
            # of a run of equal symbols, every second pair merges, from the left
            run = np.cumsum(np.r_[True, after[at[:-1]] != at[1:]])
            at = at[(np.arange(at.size) - np.searchsorted(run, run)) % 2 == 0]
            right = after[at]
            symbol[at] = self.made_by_rank[rank]
            alive[right] = False
            beyond = after[right]
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            left = before[at]
            wait(np.unique(np.concatenate([at[inner], left[left >= 0]])))
        ids, left = symbol[alive].astype("<u4"), np.cumsum(np.r_[0, alive])
        return [ids[left[e - s] : left[e]].tobytes() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word by rounds over whole words."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbol = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        out: list[bytes] = [b""] * len(words)
        none = len(self.made_by_rank)
        rank = np.full(symbol.size, none, dtype=np.int64)
        stale = np.arange(max(symbol.size - 1, 0))
        while symbol.size:
            rank[stale] = self.rank_of_pairs(symbol, word, stale)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, starts)
            done = low == none
            lengths = np.diff(np.r_[starts, symbol.size])
            if done.any():
                ids = symbol.astype("<u4")
                for w, s, n in zip(word[starts[done]].tolist(), starts[done].tolist(), lengths[done].tolist(), strict=True):
                    out[w] = ids[s : s + n].tobytes()
            take = (rank == np.repeat(low, lengths)) & (rank != none)
            # of a run of equal symbols, every second pair merges, from the left
            if (take[1:] & take[:-1]).any():
                where = np.flatnonzero(take)
                run = np.cumsum(np.r_[True, np.diff(where) != 1])
                nth = np.arange(where.size) - np.searchsorted(run, run)
                take[where[nth % 2 == 1]] = False
            symbol[take] = self.made_by_rank[rank[take]]
            keep = np.repeat(~done, lengths)
            keep[1:] &= ~take[:-1]
            made = np.flatnonzero(take[keep])
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            # only pairs that touch a made symbol change their rank
            stale = np.concatenate([made, made - 1])
            stale = stale[stale >= 0]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split: list[list[list[str]]] = []
        fresh: set[str] = set()
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for text in texts:
            parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
            found = [[p] if i % 2 else self.pattern.findall(p) for i, p in enumerate(parts)]
            split.append(found)
            for i, piece in enumerate(found):
                if not i % 2:
                    fresh.update(piece)
        new = [w for w in fresh if w not in self.cache]
        if new:
            self.cache.update(zip(new, self.merge_words([w.encode() for w in new]), strict=True))
        get, special = self.cache.__getitem__, self.special
        return [
            b"".join(b"".join(map(get, piece)) if not i % 2 else special[piece[0]].to_bytes(4, "little") for i, piece in enumerate(found))
            for found in split
        ]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.piece.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def slices(texts: list[str]) -> Iterator[list[str]]:
    """Whole texts in runs of about SLICE_CHARS characters."""
    run: list[str] = []
    size = 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def load(path: str) -> ByteBpe:
    """Tables of the vocabulary file at ``path`` (read on the driver, then broadcast: a few MB)."""
    with open(path, encoding="utf-8") as file:
        return ByteBpe(file.read())


#: What ``encode`` can return of each text, and its type.
OUTPUTS = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def _outputs(ids: list[bytes], back: list[str], names: tuple[str, ...]) -> list[pa.Array]:
    def made(name: str) -> pa.Array:
        if name == "ids":
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32()))
        if name == "decoded":
            return pa.array(back, pa.string())
        if name == "n_tokens":
            return pa.array([len(x) // 4 for x in ids], pa.int64())
        return pa.array([hashlib.sha256(x).hexdigest() for x in (ids if name == "ids_sha256" else map(str.encode, back))], pa.string())

    return [made(name) for name in names]


def encode(spark: SparkSession, docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``keep`` columns plus those of OUTPUTS that are asked for, of every whole text."""
    tables = spark.sparkContext.broadcast(load(path))
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables.value
        for batch in batches:
            at = 0
            for texts in slices(batch.column(len(keep)).to_pylist()):
                ids = bpe.encode(texts)
                more = _outputs(ids, [bpe.decode(x) for x in ids], outputs)
                own = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*(own.column(i) for i in range(len(keep))), *more], [*keep, *outputs])
                at += len(texts)

    return source.mapInArrow(run, ", ".join([*kinds, *(f"{name} {OUTPUTS[name]}" for name in outputs)]))


def encode_digests(spark: SparkSession, docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    return encode(spark, docs, path, text_col, keep, ("n_tokens", "ids_sha256", "decoded_sha256"))
