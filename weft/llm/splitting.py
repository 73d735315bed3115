"""Cutting oversized items into ordered pieces under a limit, at natural boundaries and with a fixed overlap.

Items are worked on by ranges, whatever their length. A range is read with a halo on both sides; near every border between
two ranges both neighbours find the same joint, the best boundary before the border, from the same few characters, so that
the boundary tables are stitched there without being brought together. The pieces of a range lie between its two joints and
are cut on its own boundary table; offsets are the lengths of the ranges before it, and a piece is emitted by offset from
the range that holds it. No worker needs more of an item than a range and its halo, and
nothing but the numbers of pieces per range is summed up along an item.

Positions are code points for table contents (``split_items``) and bytes for files (``split_files``, cuts never inside a
UTF-8 sequence).
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Code points of a range, at least, and how many limits it holds at least; and of the halo that tells what stands beside it.
RANGE, LIMITS, HALO = 65_536, 16, 64
#: Boundary levels: 4 blank line, 3 line end, 2 sentence or statement end, 1 white space; 0 would be any character.
_LEVELS = (
    (1, re.compile(r"\s+(?=\S)")),
    (2, re.compile(r"[.!?;,:)}\]](?:\s+)(?=\S)|[。！？；，、]")),
    (3, re.compile(r"(?:\r\n|\n|\r)(?!\n)")),
    (4, re.compile(r"(?:\r\n|\n){2,}")),
)


def boundaries(text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, levels) of the places p, start < p <= end, before which a piece can end naturally.

    ``text`` may reach over [start, end) on both sides; that halo decides what stands next to the borders.
    """
    best: dict[int, int] = {}
    for level, pattern in _LEVELS:
        for m in pattern.finditer(text):
            p = m.end()
            if start < p <= end:
                best[p] = level
    pos = np.array(sorted(best), dtype=np.int64)
    return pos, np.array([best[int(p)] for p in pos], dtype=np.int8)


def _best(pos: np.ndarray, level: np.ndarray, lo: int, hi: int) -> int | None:
    """The last of the highest boundaries p with lo <= p <= hi."""
    i, j = int(np.searchsorted(pos, lo, "left")), int(np.searchsorted(pos, hi, "right"))
    if i >= j:
        return None
    part = level[i:j]
    return int(pos[i + len(part) - 1 - int(np.argmax(part[::-1]))])


def bounds_of(limit: int, overlap: int) -> tuple[int, int]:
    """The limit and overlap that are used: at least 1, and an overlap of the limit or more is taken as limit - 1."""
    limit = max(1, int(limit))
    return limit, min(max(0, int(overlap)), limit - 1)


def cut(pos: np.ndarray, level: np.ndarray, n: int, limit: int, overlap: int, a: int = 0) -> list[tuple[int, int]]:
    """Pieces (start, end) that cover [a, n): each at most ``limit`` long, each next one starting ``overlap`` before the end.

    A piece ends at the highest boundary of the last half of its window, of equals the last; where that half has no
    boundary the first half is searched, and where the window has none it is cut at the limit. Pieces always move forward.
    """
    limit, overlap = bounds_of(limit, overlap)
    out = []
    while True:
        b = a + limit
        if b >= n:
            out.append((a, n))
            return out
        least = a + overlap + 1
        end = _best(pos, level, max(least, a + limit // 2), b)
        if end is None:
            end = _best(pos, level, least, b)
        if end is None:
            end = b
        out.append((a, end))
        a = end - overlap


def range_size(limit: int, least: int = RANGE) -> int:
    return max(least, LIMITS * max(1, int(limit)))


def context(limit: int, overlap: int) -> int:
    """How much before a range its worker must see: where the joint may lie, the overlap before it, and the halo."""
    limit, overlap = bounds_of(limit, overlap)
    return limit // 2 + overlap + HALO


def _joint(text: str, border: int, limit: int) -> tuple[int, bool]:
    """The end of the last piece before a border of two ranges (an index of ``text``), and whether it is a boundary; it is
    told by the same characters on both sides of the border: half a limit and the halo before it, the halo after it."""
    lo = border - limit // 2
    window = text[max(0, lo - HALO) : border + HALO]
    shift = max(0, lo - HALO)
    pos, level = boundaries(window, lo - shift, border - shift)
    p = _best(pos, level, lo - shift + 1, border - shift)
    return (border, False) if p is None else (p + shift, True)


def range_pieces(before: str, part: str, after: str, limit: int, overlap: int) -> list[tuple[int, int, bool, str]]:
    """(start, end, natural, text) of the pieces that end in a range; starts and ends count from the start of the range.

    ``before`` has the last ``context`` characters before it ('' for the first range), ``after`` the first of the halo
    behind it ('' for the last one).
    """
    limit, overlap = bounds_of(limit, overlap)
    text, at = before + part + after, len(before)
    start = 0
    if before:
        start = _joint(text, at, limit)[0] - overlap
    stop, natural = (at + len(part), True) if not after else _joint(text, at + len(part), limit)
    pos, level = boundaries(text, start, stop)
    known = set(pos.tolist())
    out = []
    for a, b in cut(pos, level, stop, limit, overlap, start):
        out.append((a - at, b - at, natural if b == stop else b in known, text[a:b]))
    return out


def split_text(text: str, limit: int, overlap: int, size: int | None = None) -> list[tuple[int, int]]:
    """The pieces of one text, by ranges as ``split_items`` takes them."""
    size, c = size or range_size(limit), context(limit, overlap)
    out = []
    for a in range(0, max(1, len(text)), size):
        out += [(a + s, a + e) for s, e, _, _ in range_pieces(text[max(0, a - c) : a], text[a : a + size], text[a + size : a + size + HALO], limit, overlap)]
    return out


def _cut_up(x: Column, size: Column) -> Column:
    most = F.least(size, F.lit((1 << 31) - 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(x) - 1) / size).cast("int"), F.lit(0))), lambda k: F.substring(x, (k * size + 1).cast("int"), most))


def ranges_of(items: DataFrame, least: int = RANGE) -> DataFrame:
    """(seq, id, maxlen, overlap, ranges, i, at, before, part, after): the ranges of the items longer than their limit.

    The JVM cuts contents into 1,024 ranges, those into 32 and those into one, so that no cut counts more than 32 times
    its own length of characters to get to its place; only a range and its halo go on from here.
    """
    big = items.select("seq", "id", "content", F.col("maxlen").cast("int").alias("maxlen"), F.coalesce(F.col("overlap"), F.lit(0)).cast("int").alias("overlap")).where("maxlen > 0 and length(content) > maxlen")
    sized = big.withColumn("size", F.greatest(F.lit(least).cast("long"), F.col("maxlen").cast("long") * LIMITS))
    # one level a step: what is one part already stays as it is
    s = F.col("size")
    parts = _cut_up(F.col("content"), s)
    deep = F.flatten(F.transform(_cut_up(F.col("content"), s * 1024), lambda y: F.flatten(F.transform(_cut_up(y, s * 32), lambda z: _cut_up(z, s)))))
    listed = sized.select("seq", "id", "maxlen", "overlap", "size", F.when(F.length("content") <= s, F.array("content")).when(F.length("content") <= s * 32, parts).otherwise(deep).alias("parts"))
    limit = F.col("maxlen")
    back = F.floor(limit / 2).cast("int") + F.least(F.greatest(F.col("overlap"), F.lit(0)), limit - 1) + HALO
    rows = F.transform("parts", lambda x, i: F.struct(
        i.alias("i"), (i.cast("long") * F.col("size")).alias("at"),
        F.when(i > 0, F.right(F.get("parts", i - 1), back)).otherwise("").alias("before"), x.alias("part"), F.coalesce(F.left(F.get("parts", i + 1), F.lit(HALO)), F.lit("")).alias("after"),
    ))
    return listed.select("seq", "id", "maxlen", "overlap", F.size("parts").alias("ranges"), F.explode(rows).alias("r")).select("seq", "id", "maxlen", "overlap", "ranges", "r.*")


CUT = "seq long, id string, ranges int, i int, nth int, start long, end long, natural boolean, text string"


def _emit(batches):
    for pdf in batches:
        rows = []
        base = pdf["base"] if "base" in pdf else [0] * len(pdf)
        for q, d, m, o, n, i, at, before, part, after, first in zip(*[pdf[c] for c in ("seq", "id", "maxlen", "overlap", "ranges", "i", "at", "before", "part", "after")], base):
            rows.extend((q, d, n, i, k, at + a, at + b, nat, t) for k, (a, b, nat, t) in enumerate(range_pieces(before, part, after, m, o), int(first)))
        yield pd.DataFrame(rows, columns=["seq", "id", "ranges", "i", "nth", "start", "end", "natural", "text"])


def _numbers(batches):
    for pdf in batches:
        n = [len(range_pieces(b, p, a, m, o)) for b, p, a, m, o in zip(pdf["before"], pdf["part"], pdf["after"], pdf["maxlen"], pdf["overlap"])]
        yield pdf[["seq", "i"]].assign(n=n)


def cut_items(items: DataFrame, least: int = RANGE) -> DataFrame:
    """(seq, id, ranges, i, nth, start, end, natural, text): the pieces in one pass and without a shuffle, numbered within
    their range; (seq, start) is their order. The ranges of an item follow each other in the task that read it."""
    return ranges_of(items, least).mapInPandas(_emit, CUT)


def split_items(items: DataFrame, least: int = RANGE) -> DataFrame:
    """(seq, id, piece, start, end, natural, text) of every item longer than its limit.

    ``items`` has seq (unique), id, content, maxlen, overlap. Items with null content, null or non-positive maxlen, or at
    most maxlen code points give no row; null overlap counts as 0, negative ones too. ``natural`` says that the piece ends at a
    boundary or at the end of the item. Ranges have max(``least``, 16 * maxlen) code points; the numbers of pieces before a range are
    summed up over counts alone; only ranges of items that have several are shuffled, by item and range, and run in parallel.
    """
    ranges = ranges_of(items, least)
    one = ranges.where("ranges = 1").mapInPandas(_emit, CUT).withColumn("piece", F.col("nth"))
    # ranges of giants are spread once over all tasks, for the counting and for the cutting alike
    many = ranges.where("ranges > 1").repartition("seq", "i")
    counts = many.mapInPandas(_numbers, "seq long, i int, n int")
    base = counts.select("seq", "i", F.coalesce(F.sum("n").over(Window.partitionBy("seq").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rest = many.join(base, ["seq", "i"]).mapInPandas(_emit, CUT).withColumn("piece", F.col("nth"))
    out = ["seq", "id", "piece", "start", "end", "natural", "text"]
    return one.select(*out).unionByName(rest.select(*out))


def split_files(spark: SparkSession, paths: list[str], limit: int, overlap: int, size: int = 8 << 20) -> DataFrame:
    """(path, piece, start, end, text) of files by byte ranges; limit and overlap in bytes, offsets on UTF-8 borders.

    The files lie in a folder that all workers share. Each range is read by seeking, with its halo; nothing reads a whole
    file, and only numbers of pieces are summed up. A piece may be up to three bytes shorter than asked where a sequence of
    bytes would be cut.
    """
    limit, overlap = bounds_of(limit, overlap)
    size, back = range_size(limit, size), context(limit, overlap)
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 2000)), "path")

    def measure(batches):
        for pdf in batches:
            yield pdf.assign(n=[os.path.getsize(p) for p in pdf["path"]])

    sized = files.mapInPandas(measure, "path string, n long")
    ranges = sized.where("n > 0").select("path", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(size).cast("long"))).alias("a")).repartition("path", "a")

    def pieces(p: str, a: int, n: int):
        lo, hi = max(0, a - back), min(n, a + size + HALO)
        with open(p, "rb") as f:
            f.seek(lo)
            raw = f.read(hi - lo)
            tail = f.read(3)
        text = raw.decode("latin-1")  # one character a byte keeps byte offsets
        k, e = a - lo, min(n, a + size) - lo
        for s, t, _, _ in range_pieces(text[:k], text[k:e], text[e:], limit, overlap):
            s, t = _border(raw + tail, k + s), _border(raw + tail, k + t)
            yield lo + s, lo + t, raw[s:t].decode("utf-8", "replace")

    def count(batches):
        for pdf in batches:
            yield pdf[["path", "a"]].assign(k=[sum(1 for _ in pieces(p, a, n)) for p, a, n in zip(pdf["path"], pdf["a"], pdf["n"])])

    def emit(batches):
        for pdf in batches:
            rows = [(p, int(b) + k, s, t, x) for p, a, n, b in zip(pdf["path"], pdf["a"], pdf["n"], pdf["base"]) for k, (s, t, x) in enumerate(pieces(p, a, n))]
            yield pd.DataFrame(rows, columns=["path", "piece", "start", "end", "text"])

    counts = ranges.mapInPandas(count, "path string, a long, k long")
    before = F.sum("k").over(Window.partitionBy("path").orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
    placed = ranges.join(counts.select("path", "a", F.coalesce(before, F.lit(0)).alias("base")), ["path", "a"])
    return placed.mapInPandas(emit, "path string, piece int, start long, end long, text string")


def _border(raw: bytes, at: int) -> int:
    """The last place at or before ``at`` that doesn't lie inside a UTF-8 sequence."""
    at = min(at, len(raw))
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at
