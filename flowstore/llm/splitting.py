"""Splitting oversized texts at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A longest run of letters and digits of any script, or one other character that is not white space.
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
#: Where a new unit may begin, from the coarsest level to the finest: sections, paragraphs, sentences and lines, words.
LEVELS = (
    re.compile(r"(?:(?<=\n)|^)(?=#{1,6}[ \t]|={3,}|-{3,}|\*{3,}|\f)|(?<=\f)", re.M),
    re.compile(r"(?<=\n)[ \t]*\r?\n\s*"),
    re.compile(r"(?<=[.!?。！？…])[\"'”’)\]]*\s+|\n"),
    re.compile(r"\s+"),
)
WORD, CHARACTER = 3, 4


def boundary_levels(text: str, starts: np.ndarray) -> np.ndarray:
    """For each token the coarsest level at whose boundary it begins (4: only at a character).

    A boundary is moved to the first token that begins at or after its end.
    """
    level = np.full(len(starts), CHARACTER, np.int8)
    for k in range(WORD, -1, -1):
        ends = np.fromiter((m.end() for m in LEVELS[k].finditer(text)), np.int64)
        at = np.searchsorted(starts, ends)
        level[at[at < len(starts)]] = k
    if len(level):
        level[0] = 0
    return level


def units(level: np.ndarray, room: int) -> list[tuple[int, int]]:
    """Runs of tokens of at most `room`, as coarse as possible: what is too long is split at the next finer level."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(level), 0)]
    while todo:
        lo, hi, k = todo.pop()
        if hi - lo <= room:
            out.append((lo, hi))
        elif k >= CHARACTER:
            out.extend((s, min(s + room, hi)) for s in range(lo, hi, room))
        else:
            cuts = lo + 1 + np.flatnonzero(level[lo + 1 : hi] <= k)
            edges = [lo, *cuts.tolist(), hi]
            todo.extend((s, e, k + 1) for s, e in reversed(list(zip(edges[:-1], edges[1:]))))
    return out


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(first character, last character + 1, tokens, tokens shared with the piece before) of each piece in order.

    Every piece has at most `limit` tokens; each but the first begins with the last
    `overlap` tokens of the one before (fewer where that would leave no room for a new
    one). Cut off the shared part, the pieces are the text. A text within the limit, or
    without any token, is one piece.
    """
    if limit < 1:
        raise ValueError("the limit must be positive")
    overlap = max(0, min(overlap, limit - 1))
    spans = [m.span() for m in TOKEN.finditer(text)] if len(text) > limit else []
    n = len(spans) if spans else sum(1 for _ in TOKEN.finditer(text))
    if n <= limit:
        return [(0, len(text), n, 0)]
    starts = np.fromiter((s for s, _ in spans), np.int64, n)
    pieces: list[tuple[int, int]] = []  # first own token, end
    for lo, hi in units(boundary_levels(text, starts), limit - overlap):
        # before the first piece there is nothing to share
        if pieces and hi - pieces[-1][0] + min(overlap, pieces[-1][0]) <= limit:
            pieces[-1] = (pieces[-1][0], hi)
        else:
            pieces.append((lo, hi))
    out = []
    for lo, hi in pieces:
        # the last tokens of the piece before, all of it if it has fewer
        shared = min(overlap, out[-1][2]) if out else 0
        begin = int(starts[lo - shared]) if out else 0
        end = len(text) if hi == n else int(starts[hi])
        out.append((begin, end, hi - lo + shared, shared))
    return out


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = []
        for key, text, limit, overlap in zip(df["key"], df["text"], df["limit"], df["overlap"]):
            for no, (a, b, tokens, shared) in enumerate(split_text(text, int(limit), int(overlap))):
                rows.append((key, no, text[a:b], a, b, tokens, shared))
        yield pd.DataFrame(rows, columns=["key", "piece_no", "piece", "begin", "end", "n_tokens", "n_shared"])


def split_oversized(rows: DataFrame, key: str, text: str, limit: str, overlap: str) -> DataFrame:
    """(key, piece_no, piece, begin, end, n_tokens, n_shared) of each row's text, cut into pieces within the limit.

    limit and overlap are columns, in tokens. Pieces are numbered from 0; begin and end
    are character offsets of the piece in the text; n_shared the tokens it shares with the
    piece before, always the overlap unless the piece before has fewer. A text is split at
    sections, then paragraphs, then sentences and lines, then words, then characters:
    only units too long for a piece are split at the next finer level. Units are packed
    greedily. A null text, a null limit or a limit below 1 gives no pieces; an empty or
    blank text is one piece of 0 tokens; a null or negative overlap is 0, one as large as
    the limit is the limit less 1. Repeated rows give repeated pieces; an empty table none.
    A text is handled in one task, whatever its length, and no text is moved by a shuffle.
    """
    picked = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{limit}`").cast("int").alias("limit"), F.coalesce(F.col(f"`{overlap}`").cast("int"), F.lit(0)).alias("overlap"))
    kind = dict(picked.dtypes)["key"]
    return picked.where("text is not null and limit >= 1").mapInPandas(_split, f"key {kind}, piece_no int, piece string, begin int, `end` int, n_tokens int, n_shared int")
