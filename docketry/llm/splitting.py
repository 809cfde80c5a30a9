"""Oversized items cut at natural boundaries (problem 5).

An item is worked on in ranges of its characters (a column) or bytes (a file).
Each range is cut with no more in sight than a halo of one piece on either side.
The place where one range's pieces end and the next one's begin, its anchor,
depends only on the first piece length of the next range, which both see; so the
ranges are cut independently, those of a file by different workers, none of which
ever holds a whole giant file. The number and length of each range's pieces form
a small boundary table per item; its prefix sums number the pieces and give their
offsets.

Cuts go, within the second half of what may still be taken, at the last heading,
else the last paragraph end, numbered item, line, sentence or clause, space, and
only at last between any two characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.runtime import checkpoint, spread, widen

#: Bytes of a file in one worker's range.
RANGE = 1 << 20
#: Characters of values whose pieces go to the JVM at once.
OUTPUT = 8 << 20

_HEADING = re.compile(
    r"(?:(?<=\n)|(?<=>))(?=[ \t]*(?:(?:PART|PARTIE|CHAPTER|CHAPITRE|TITLE|TITRE|SCHEDULE|ANNEXE?|TEIL|PARTE)\b[^\n]{0,80}(?:\n|$)|第[一二三四五六七八九十百\d]+[章部编編节節]|部分|<h[1-6]|#{1,6} |[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ0-9 ,’'&–—-]{3,79}\r?(?:\n|$)))"
)
_PARAGRAPH = re.compile(r"\n[ \t]*\r?\n\s*|</(?:p|div|li|tr|table|blockquote)>\s*|<br ?/?>\s*<br ?/?>\s*", re.I)
_ITEM = re.compile(r"(?<=\n)(?=[ \t]*(?:\[\d{1,4}\]|\(\w{1,4}\)|\d{1,4}[.)]\s|(?:Section|Article|Artículo|Artigo|Artikel|Clause|条款|§) ?\d|第\d+[条款]|[-*•] ))|(?<=[.;:。；：] )(?=\[\d{1,4}\] |\([a-z]{1,3}\) |(?:Section|Article) \d)")
_LINE = re.compile(r"\r?\n\s*|<br ?/?>\s*", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…][\"”’»)\]])\s+|(?<=[.!?…])\s+(?=[\[(\"“«A-ZÀ-ÖØ-Þ0-9<])|(?<=[。！？；])[”」』）]?\s*")
_CLAUSE = re.compile(r"(?<=[;:,])\s+|(?<=[，、：])")
_SPACE = re.compile(r"\s+")
_KINDS = (_HEADING, _PARAGRAPH, _ITEM, _LINE, _SENTENCE, _CLAUSE, _SPACE)


def boundary(text: str, low: int, high: int) -> int:
    """The best place to cut in (low, high]; high if there is no natural one.

    Text up to 200 characters before ``low`` and after ``high`` is looked at as
    context. The last boundary of the strongest kind found wins.
    """
    base = max(0, low - 200)
    seen = text[base : high + 200]
    for kind in _KINDS:
        best = 0
        for m in kind.finditer(seen, max(0, low - base)):
            at = m.end() + base
            if at > high:
                if kind is _HEADING or m.start() + base > high:
                    break
                at = high if m.start() + base <= high and seen[m.start() : high - base].isspace() else 0
            if low < at <= high:
                best = max(best, at)
        if best:
            return best
    if high < len(text) and text[high - 1 : high + 1] == "\r\n" and high - 1 > low:
        return high - 1
    return high


def cuts(text: str, start: int, end: int, limit: int, overlap: int, first: bool = True) -> list[int]:
    """Where the pieces of text[start:end] end; the last is ``end``.

    Each piece but an item's very first begins ``overlap`` characters before the
    end of the one before it; ``first`` says whether the piece at ``start`` is
    that first one.
    """
    out = []
    at = start
    lead = 0 if first else overlap
    while end - at > limit - lead:
        room = limit - lead
        cut = boundary(text, at + max(1, room // 2), at + room)
        out.append(cut)
        at, lead = cut, overlap
    return [*out, end] if end > at else out


def anchor(text: str, low: int, limit: int, overlap: int) -> int:
    """Where the pieces of a range that begins at ``low`` begin: the same for both workers that ask."""
    return boundary(text, low, min(len(text), low + max(2, (limit - overlap) // 2)))


def ranged_cuts(text: str, limit: int, overlap: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of a value begin and end, its overlaps included, cut range by range.

    Each range sees only itself and its halos, as in a file. Their boundary table
    (pieces of each range) gives the pieces' numbers by its prefix sums.
    """
    before, after = overlap + 200, limit + 200
    table: list[list[int]] = []
    starts: list[int] = []
    n = (len(text) - 1) // span + 1
    for k in range(n):
        base = max(0, k * span - before)
        part = text[base : (k + 1) * span + after]
        start = anchor(part, k * span - base, limit, overlap) if k else 0
        end = len(text) - base if k == n - 1 else anchor(part, (k + 1) * span - base, limit, overlap)
        starts.append(start + base)
        table.append([c + base for c in cuts(part, start, end, limit, overlap, first=k == 0)])
    first = np.concatenate([[0], np.cumsum([len(t) for t in table])])
    ends = np.empty(first[-1], dtype=np.int64)
    begins = np.empty(first[-1], dtype=np.int64)
    for k, t in enumerate(table):
        ends[first[k] : first[k + 1]] = t
        begins[first[k] : first[k + 1]] = [starts[k], *t[:-1]][: len(t)]
    begins[1:] -= overlap
    return begins, ends


def split_text(rows: DataFrame, keys: list[str], column: str, limit: int, overlap: int, span: int | None = None, pieces: bool = True) -> DataFrame:
    """Pieces of every value of ``column`` longer than ``limit`` characters (code points).

    Returns (keys, chunk_index, start, length, piece): chunk_index counts from 0
    without holes, start is the piece's offset in characters, its overlap
    included. Every piece has at most ``limit`` characters; each but the first
    starts with the last ``overlap`` characters of the one before; without the
    overlaps the pieces give back the value. Null, empty and short values give
    no row; repeated keys are cut each on their own; other columns are ignored.
    ``span`` is the characters of a range, 4 * ``limit`` unless given. Without
    ``pieces`` only numbers and offsets come out. One map, no shuffle: a value is
    on one worker anyway, which goes through its ranges.
    """
    span = span or 4 * limit
    if not 0 <= 2 * overlap < limit or span < 2 * limit:
        raise ValueError("need 2 * overlap < limit and 2 * limit <= span")
    names = [f"_k{i}" for i in range(len(keys))]
    picked = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(column).cast("string").alias("_text")).filter(F.length("_text") > limit)
    columns = ["chunk_index", "start", "length", *["piece"] * pieces]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list[pd.DataFrame] = []
            size = 0
            for at, text in enumerate(batch["_text"]):
                begins, ends = ranged_cuts(text, limit, overlap, span)
                out = pd.DataFrame({"chunk_index": np.arange(len(ends), dtype=np.int32), "start": begins, "length": (ends - begins).astype(np.int32)})
                if pieces:
                    out["piece"] = [text[x:y] for x, y in zip(begins.tolist(), ends.tolist())]
                for i, n in enumerate(names):
                    out.insert(i, n, [batch[n].iloc[at]] * len(out))
                held.append(out)
                size += len(text)
                if size > OUTPUT:
                    yield pd.concat(held)
                    held, size = [], 0
            if held:
                yield pd.concat(held)

    kinds = dict(picked.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", chunk_index int, start bigint, length int" + ", piece string" * pieces
    return widen(picked).mapInPandas(work, schema).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *columns)


def split_files(spark: SparkSession, paths: list[str], limit: int, overlap: int, span: int = RANGE) -> DataFrame:
    """Pieces of UTF-8 text files, read by byte ranges: (path, chunk_index, start, length, piece).

    Only the range and its halos of a file are ever read by a worker, so a file
    may be larger than any executor's memory. start counts characters: the
    ranges' lengths are summed like their piece counts. Bytes that are no UTF-8
    become U+FFFD. A file within ``limit`` gives one piece, an empty one none.
    """
    from pyarrow import fs

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for p in batch["path"]:
                system, inner = fs.FileSystem.from_uri(p) if "://" in p else (fs.LocalFileSystem(), p)
                found.append(system.get_file_info(inner).size)
            yield batch.assign(size=pd.Series(found, dtype="float64").fillna(0).astype("int64").to_numpy())

    # the listing is a job of its own; a row per range is then spread over the workers
    sized = checkpoint(spread(spark.createDataFrame([(p,) for p in paths], "path string")).mapInPandas(sizes, "path string, size bigint").filter("size > 0"))
    ranges = sized.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(size - 1) div {span}"))).alias("_range"))
    n = max(1, min(10_000, ranges.count()))
    before, after = 4 * (overlap + 200), 4 * (limit + 200)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                path, size, k = r[0], r[1], r[2]
                system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                low, high = max(0, k * span - before), min(size, (k + 1) * span + after)
                with system.open_input_file(inner) as f:
                    f.seek(low)
                    raw = f.read(high - low)
                skip = 0
                while low and skip < len(raw) and 0x80 <= raw[skip] < 0xC0:
                    skip += 1
                # a range owns the characters whose first byte lies in it
                own, nxt = _aligned(raw, k * span - low), _aligned(raw, min(size, (k + 1) * span) - low)
                lead_text = raw[skip:own].decode("utf-8", "replace")
                own_text = raw[own:nxt].decode("utf-8", "replace")
                text = lead_text + own_text + raw[nxt:].decode("utf-8", "ignore" if high < size else "replace")
                last = (k + 1) * span >= size
                here, there = len(lead_text), len(lead_text) + len(own_text)
                start = anchor(text, here, limit, overlap) if k else here
                end = len(text) if last else anchor(text, there, limit, overlap)
                begin = start
                for no, cut in enumerate(cuts(text, start, end, limit, overlap, first=k == 0)):
                    lead = overlap if no or k else 0
                    out.append((path, k, len(own_text), no, begin - lead - here, cut - begin + lead, text[begin - lead : cut]))
                    begin = cut
            if out:
                yield pd.DataFrame(out, columns=["path", "_range", "_chars", "_no", "_begin", "length", "piece"])

    pieces = ranges.repartition(n, "path", "_range").mapInPandas(work, "path string, _range bigint, _chars bigint, _no int, _begin bigint, length int, piece string")
    table = pieces.groupBy("path", "_range").agg((F.max("_no") + 1).alias("_n"), F.max("_chars").alias("_chars"))
    w = Window.partitionBy("path").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = table.select("path", "_range", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), F.coalesce(F.sum("_chars").over(w), F.lit(0)).alias("_from"))
    return pieces.join(offsets, ["path", "_range"]).select("path", (F.col("_no") + F.col("_before")).cast("int").alias("chunk_index"), (F.col("_begin") + F.col("_from")).alias("start"), "length", "piece")


def _aligned(raw: bytes, at: int) -> int:
    """The first place at or after ``at`` where a UTF-8 character begins."""
    while at < len(raw) and 0x80 <= raw[at] < 0xC0:
        at += 1
    return at
