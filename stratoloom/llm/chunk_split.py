"""Cutting oversized items at natural boundaries, with overlap.

Prefix sums of the byte lengths give the place where a piece must end at the latest; the sorted
boundaries of the best kind at hand are searched for the last one before it; the next piece
starts a little before that end.  Where no boundary fits, the cut is hard, between characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Cuts, map_frames

#: Boundaries from the most to the least natural: after a line end, after a sentence end, after a space.
_BOUNDARIES = (re.compile(r"\n"), re.compile(r"[.!?।](?:[\"'”»)\]]*)\s|[。！？](?:[」』”）]*)"), re.compile(r"\s"))


def byte_offsets(text: str) -> np.ndarray:
    """Prefix sums of the UTF-8 lengths of the characters, one more than there are characters."""
    # surrogates that stand alone take three bytes here
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
    return np.concatenate([[0], np.cumsum(width)])


def split_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """The (start, end) characters of pieces of at most ``limit`` bytes that cover the text.

    Adjacent pieces share between 1 and ``overlap`` characters (0 if ``overlap`` is 0); the shared
    stretch begins at a boundary where one lies within it.  Every piece ends after the last line
    end, else sentence end, else space that still lets the pieces move on; else before the
    character that would pass the limit.  A text within the limit is one piece.
    """
    if limit < 8:
        raise ValueError("two characters must fit a piece: the limit is at least 8 bytes")
    n = len(text)
    sums = byte_offsets(text)
    if sums[-1] <= limit:
        return [(0, n)]
    kinds = [np.array([m.end() for m in p.finditer(text)], dtype=np.int64) for p in _BOUNDARIES]
    pieces, start, reached = [], 0, 0
    while True:
        hard = int(np.searchsorted(sums, sums[start] + limit, side="right")) - 1
        if hard >= n:
            pieces.append((start, n))
            return pieces
        # a piece must reach beyond the one before
        least = reached + 1
        end = hard
        for ends in kinds:
            i = bisect_right(ends, hard) - 1
            if i >= 0 and ends[i] >= least and (2 * (ends[i] - start) >= hard - start or ends is kinds[-1]):
                end = int(ends[i])
                break
        pieces.append((start, end))
        reached = end
        if overlap <= 0:
            start = end
            continue
        # so far back that a character more than now still fits
        low = max(start + 1, end - overlap, int(np.searchsorted(sums, sums[end + 1] - limit, side="left")))
        nxt = low
        for ends in kinds:
            i = bisect_left(ends, low)
            if i < len(ends) and ends[i] < end:
                nxt = int(ends[i])
                break
        start = min(nxt, end - 1)


def split_oversized(chunks: DataFrame, limit: int = 4096, overlap: int = 200, key: str = "chunk_id") -> DataFrame:
    """The pieces of every chunk whose content has more than ``limit`` bytes.

    Returns ``chunk_id, file_id, old_index, piece, pieces, content, start_line, end_line,
    long_lines``: ``piece`` counts from 0, ``start_line`` and ``end_line`` are the lines in which
    the piece's first and last character lie (counted on from the chunk's ``start_line``, null if
    that is null), ``long_lines`` the number of the chunk's lines that alone pass the limit.
    Chunks with null content or within the limit give no rows; of rows that share a chunk_id one
    counts.  Only the oversized chunks are moved or leave the JVM; their texts are whole.
    """
    long = chunks.where(F.col(key).isNotNull() & (F.octet_length("content") > limit)).select(key, "file_id", "chunk_index", "content", "start_line")
    long = long.groupBy(key).agg(F.max(F.struct("file_id", "chunk_index", "content", "start_line")).alias("r")).select(key, "r.*")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for cid, fid, idx, text, line in b.itertuples(index=False):
                points = split_points(text, limit, overlap)
                sums = byte_offsets(text)
                breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4") == 10)
                # a line's bytes, without its line end
                starts = np.concatenate([[0], breaks + 1])
                ends = np.concatenate([breaks, [len(text)]])
                n_long = int(np.count_nonzero(sums[ends] - sums[starts] > limit))
                for p, (s, e) in enumerate(points):
                    first, last = (int(np.searchsorted(breaks, x)) for x in (s, max(s, e - 1)))
                    rows.append((cid, fid, idx, p, len(points), text[s:e], None if pd.isna(line) else int(line) + first, None if pd.isna(line) else int(line) + last, n_long))
            yield pd.DataFrame(rows, columns=names)

    names = [key, "file_id", "old_index", "piece", "pieces", "content", "start_line", "end_line", "long_lines"]
    return map_frames(long, cut, f"{key} long, file_id long, old_index int, piece int, pieces int, content string, start_line int, end_line int, long_lines int")


def rechunk(chunks: DataFrame, limit: int = 4096, overlap: int = 200, block: int = 1024) -> DataFrame:
    """All chunks, oversized ones in pieces, with a dense ``chunk_index`` per file.

    Returns ``file_id, chunk_index, chunk_id, piece, content, start_line, end_line``.  Chunks of a
    file keep their order (by old index, then id; a null index comes first).  Null contents stay
    as one chunk; of rows that share a chunk_id one counts; a null file_id is a file of its own.

    The index is a prefix sum in two levels: within blocks of ``block`` old indices (of ids where the
    index is null), and over the blocks of a file, so that a file with a third of all chunks is no
    single task's work.  Only keys are ranked; the contents stay where the chunks were gathered by id.
    """
    cuts = Cuts(chunks.sparkSession, "rechunk")
    one = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.max(F.struct("file_id", "chunk_index", "content", "start_line", "end_line")).alias("r")).select("chunk_id", "r.*")
    pieces = cuts.cut(split_oversized(one, limit, overlap).drop("long_lines"))
    small = one.where(F.coalesce(F.octet_length("content"), F.lit(0)) <= limit).select(
        "chunk_id", "file_id", F.col("chunk_index").alias("old_index"), F.lit(0).alias("piece"), F.lit(1).alias("pieces"), "content", "start_line", "end_line"
    )
    keys = ("chunk_id", "file_id", "old_index", "piece")
    known = F.col("old_index").isNotNull()
    narrow = cuts.cut(
        small.select(*keys).unionByName(pieces.select(*keys)).withColumns({"late": known, "block": F.floor(F.when(known, F.col("old_index")).otherwise(F.col("chunk_id")) / block)})
    )
    sizes = narrow.groupBy("file_id", "late", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file_id").orderBy("late", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("file_id").alias("f"), F.col("late").alias("l"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("file_id", "late", "block").orderBy("old_index", "chunk_id", "piece")
    ranked = narrow.withColumn("rank", F.row_number().over(inside))
    ranked = ranked.join(offsets, ranked.file_id.eqNullSafe(offsets.f) & (ranked.late == offsets.l) & (ranked.block == offsets.b)).select(
        F.col("chunk_id").alias("id"), F.col("piece").alias("p"), (F.col("offset") + F.col("rank") - 1).cast("int").alias("chunk_index")
    )
    out = ("file_id", "chunk_index", "chunk_id", "piece", "content", "start_line", "end_line")
    kept = small.join(ranked.where("p = 0"), F.col("chunk_id") == F.col("id"))
    cut = pieces.join(ranked, (F.col("chunk_id") == F.col("id")) & (F.col("piece") == F.col("p")))
    return kept.select(*out).unionByName(cut.select(*out))
