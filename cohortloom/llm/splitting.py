"""Splitting oversized items at natural boundaries (problem 10).

Method: agglomerative merging. A text is first taken apart into atomic segments at every paragraph, line and sentence
end (longer ones at words, the rest between characters); a heap holds the adjacent pairs, and the pair at the weakest
boundary merges first as long as both together, with the overlap, stay within the limit. What remains ends at the
strongest boundaries. Every piece but the first starts with the last tokens of the piece before it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.tokens import RANKS, encoder

LIMIT, OVERLAP = 2048, 128
#: Kinds of boundary by strength.
KINDS = ("character", "word", "sentence", "line", "paragraph")
PARAGRAPH, LINE = rb"\n[ \t\r]*\n\s*", rb"\r?\n|\r"
SENTENCE = rb"(?:[.!?;:]|\xe2\x80\xa6|\xe3\x80\x82)[\"')\]]*(?=\s)"
WORD = rb"(?=[ \t])"


def boundaries(raw: bytes, ends: np.ndarray) -> np.ndarray:
    """Strength of the boundary after each token: 0 to 4, or -1 inside a character. ends: byte ends of the tokens."""
    level = np.zeros(len(ends), np.int8)
    after = np.frombuffer(raw + b" ", np.uint8)[ends]
    level[(after & 0xC0) == 0x80] = -1
    for strength, pattern in ((1, WORD), (2, SENTENCE), (3, LINE), (4, PARAGRAPH)):
        at = np.fromiter((m.end() for m in regex.finditer(pattern, raw)), np.int64)
        if len(at):
            k = np.searchsorted(ends, at)  # the token that ends at or after the place
            k = k[k < len(ends)]
            level[k[level[k] >= 0]] = strength
    level[-1] = len(KINDS) - 1
    return level


def atoms(level: np.ndarray, most: int) -> np.ndarray:
    """Token positions that end an atomic segment; no segment is longer than most."""
    n = len(level)
    ends = list(np.flatnonzero(level >= 2) + 1)
    if not ends or ends[-1] != n:
        ends.append(n)
    out, start = [], 0
    for end in ends:
        while end - start > most:
            window = level[start : start + most]
            words = np.flatnonzero(window >= 1)
            chars = np.flatnonzero(window >= 0)
            step = int(words[-1]) + 1 if len(words) else int(chars[-1]) + 1 if len(chars) else most
            start += step
            out.append(start)
        if end > start:
            out.append(end)
            start = end
    return np.array(out, np.int64)


def merge(ends: np.ndarray, level: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces after merging neighbours, weakest boundary first, then the smaller sum, then from the left."""
    n = len(ends)
    start = np.concatenate([[0], ends[:-1]]).tolist()
    stop, nxt, prev, alive, stamp = ends.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, [0] * n
    heap: list[tuple[int, int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if i >= 0 and j < n:
            size = stop[j] - start[i]
            if size + (overlap if start[i] > 0 else 0) <= limit:
                heapq.heappush(heap, (int(level[stop[i] - 1]), size, i, j, stamp[i], stamp[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, _, i, j, si, sj = heapq.heappop(heap)
        if not (alive[i] and alive[j] and stamp[i] == si and stamp[j] == sj):
            continue
        stop[i], nxt[i], alive[j] = stop[j], nxt[j], False
        if nxt[j] < n:
            prev[nxt[j]] = i
        stamp[i] += 1
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    return [stop[i] for i in range(n) if alive[i]]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str = RANKS) -> list[tuple[str, int, int, int, str]]:
    """Pieces of a text over the limit as (text, tokens, of them repeated, start byte, kind of the end); else none.

    The repeated part has at least ``overlap`` tokens: up to three more where it would begin inside a character.
    Pieces are counted as they stand, too: should one tokenize longer on its own, the text is cut with more room.
    """
    enc, token_size = encoder(path)
    ids = enc.encode_ordinary(text)
    if len(ids) <= limit:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    ends = np.cumsum(token_size[np.array(ids)])
    level = boundaries(raw, ends)
    spare, slack = 3, max(4, limit // 64)
    while True:
        most = limit - overlap - spare
        if most < 1:
            raise ValueError(f"no cut of this text leaves pieces of {limit} tokens")
        cuts = merge(atoms(level, most), level, limit - spare, overlap)
        out, begin = [], 0
        for end in cuts:
            first = max(0, begin - overlap)
            while first > 0 and level[first - 1] < 0:
                first -= 1
            lo = int(ends[first - 1]) if first else 0
            out.append((raw[lo : int(ends[end - 1])].decode("utf-8", "surrogatepass"), end - first, begin - first, lo, KINDS[max(int(level[end - 1]), 0)] if end < len(ids) else "end"))
            begin = end
        if all(n <= limit - slack or len(enc.encode_ordinary(t)) <= limit for t, n, *_ in out) and all(n <= limit for _, n, *_ in out):
            return out
        spare += slack


def split(df: DataFrame, item: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str = RANKS) -> DataFrame:
    """Pieces of all texts over the limit, in order.

    Null, empty and short texts give no piece; a text of at most ``limit`` bytes cannot exceed the limit, since no
    token is shorter than a byte, and is not read further. Repeated texts are split alike under their own ids.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    kind = df.schema[item].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(item), []
            for i, t in enumerate(b.column(text).to_pylist()):
                rows += [(i, k, *p) for k, p in enumerate(split_text(t, limit, overlap, path))]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.string())],
                    [item, "piece_no", "piece", "n_tokens", "n_repeated", "start_byte", "ends_at"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(item, kind), T.StructField("piece_no", T.IntegerType()), T.StructField("piece", T.StringType()), T.StructField("n_tokens", T.IntegerType()),
                           T.StructField("n_repeated", T.IntegerType()), T.StructField("start_byte", T.LongType()), T.StructField("ends_at", T.StringType())])
    return df.select(item, text).where(F.octet_length(text) > limit).mapInArrow(cut, schema)
