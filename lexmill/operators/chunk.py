"""Splitting of long documents into chunks under a token budget."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.strings import TOKEN_CJK

_CJK = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), TOKEN_CJK))
_HEADING = re.compile(r"(?m)^(?=\[H[1-3]\] )")
_BLANK_LINE = re.compile(r"\n\s*\n")


def tokens_of(text: str) -> int:
    wide = len(_CJK.findall(text))
    return wide + -(-(len(text) - wide) // 4)


def _finer(piece: str, budget: int) -> list[str]:
    """Ever finer parts of a piece over budget: paragraphs, lines, then slices."""
    parts = [p for p in _BLANK_LINE.split(piece) if p.strip()]
    for split in (
        lambda p: [line for line in p.split("\n") if line.strip()],
        lambda p: [p[i : i + step] for i in range(0, len(p), step)],
    ):
        step = budget * max(1, len(piece) // max(1, tokens_of(piece)))
        parts = [q for p in parts for q in ([p] if tokens_of(p) <= budget else split(p))]
    return parts


def split_text(text: str, budget: int) -> list[str]:
    """Chunks of about ``budget`` tokens, cut at headings first and packed greedily."""
    if budget <= 0:
        raise ValueError("the token budget must be positive")
    if tokens_of(text) <= budget:
        return [text] if text else []
    sections = [p for p in _HEADING.split(text) if p.strip()]
    parts = [q for p in sections for q in ([p] if tokens_of(p) <= budget else _finer(p, budget))]
    chunks: list[str] = []
    used = 0
    for part in parts:
        cost = tokens_of(part)
        if chunks and chunks[-1] and used + cost <= budget:
            chunks[-1] += ("\n" if chunks[-1].endswith("\n") else "\n\n") + part
            used += cost + 1
        else:
            chunks.append(part)
            used = cost
    return [c for c in chunks if c]


def chunks(text: Column, budget: int) -> Column:
    """array<string> of a text's chunks."""
    if budget <= 0:
        raise ValueError("the token budget must be positive")

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t or "", budget))

    return F.pandas_udf(run, "array<string>")(text)


def explode_chunks(docs: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """One row a chunk, numbered from 0, with the other columns kept."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(chunks(F.col(text), budget)).alias("chunk", "chunk_text"))
