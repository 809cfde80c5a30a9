"""Text that was decoded with the wrong encoding (problem 4).

Each run of non-ASCII characters is a state; its neighbours are what it becomes
by encoding it in one encoding and decoding the bytes in another, or by
unescaping entities. A best-first search with a hash set of visited states looks
for the cheapest reachable text: the cost of a text is how implausible its
characters are next to each other, plus a little per step. A run counts as
damaged if a decoding step makes it clearly more plausible, or if it holds
characters that only damage leaves (U+FFFD, C1 controls).

One map over the rows, no shuffle; every value is read whole.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.runtime import widen

#: Encodings text is taken for by mistake; "sloppy" is Windows-1252 with C1 controls in its holes.
TAKEN_FOR = ("sloppy", "latin-1", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "cp1253", "cp1254", "koi8_r", "cp866", "gb18030", "big5", "cp932", "cp949")
#: (wrong, right): text in encoding ``right`` was read as ``wrong``.
STEPS = (*((w, "utf-8") for w in TAKEN_FOR), ("sloppy", "gbk"), ("big5", "gbk"), ("cp1251", "gbk"), ("mac_roman", "gbk"), ("cp949", "gbk"), ("sloppy", "big5"), ("gb18030", "big5"), ("c1", "cp1252"))
#: What a step costs, and how much a search must gain.
STEP_COST, GAIN = 0.3, 0.5
#: States a search opens and steps of a path, at most. A run that needs more is left as it is;
#: on the test tables 10 times as many states and 8 steps give the same texts.
OPEN, MOST_STEPS = 24, 4
#: What it must gain for entities alone, which mostly are written on purpose (genuine signs beside &nbsp; gain up to 1.8).
ENTITY_GAIN = 2.5

_RUN = re.compile(r"(?:[^\x00-\x7f]|&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});)+")
_ENTITY = re.compile(r"&(?:#\d|#[xX]|[A-Za-z])")
_LOST = re.compile("[\x80-\x9f�]")
#: The most frequent syllables of Korean text (fixed values).
_KOREAN = frozenset("이다는의에을가하고지로기한사도리대인시자나어서스수정들그해일은를있부제것보으원장과전주구아상우여동조라공만유연게소경국신비성치면세학모중법적정안생오무위개계관문물방단재결회권")
#: Steps from one East Asian encoding to another, where nearly any bytes can be read.
_ALIKE = frozenset((("big5", "gbk"), ("cp949", "gbk"), ("gb18030", "big5")))

_HOLES = {0x81, 0x8D, 0x8F, 0x90, 0x9D}
_SLOPPY = {(chr(b) if b in _HOLES else bytes([b]).decode("cp1252")): b for b in range(0x80, 0x100)} | {chr(b): b for b in range(0x100)}


def _encode(text: str, how: str) -> bytes | None:
    try:
        if how == "sloppy":
            return bytes([_SLOPPY[c] for c in text])
        if how == "c1":
            return text.encode("latin-1") if _LOST.search(text) else None
        return text.encode(how)
    except (KeyError, UnicodeEncodeError):
        return None


@lru_cache(maxsize=70_000)
def _han(c: str) -> float:
    """How rare a Chinese character is: by its place in the two common character sets."""
    try:
        return 0.3 if c.encode("gb2312")[0] <= 0xD7 else 0.8
    except UnicodeEncodeError:
        pass
    try:
        return 1.2 if c.encode("big5")[0] <= 0xC6 else 2.0
    except UnicodeEncodeError:
        return 2.0


@lru_cache(maxsize=20_000)
def _hangul(c: str) -> float:
    """A syllable's cost: those outside the common Korean set hardly occur in Korean text."""
    try:
        c.encode("euc_kr")
        return 0.25
    except UnicodeEncodeError:
        return 1.2


@lru_cache(maxsize=70_000)
def _kind(c: str) -> tuple[str, float]:
    """A character's group and its cost among its like."""
    o = ord(c)
    if o < 0x80:
        return ("l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else " " if c.isspace() else "p"), 0.0
    if o < 0xA0:
        return "x", 6.0
    if o == 0xFFFD:
        return "x", 4.0
    if c in "‘’“”–—…«»•·‹›":
        return "q", 0.3
    if o == 0xA0 or o == 0x202F:
        return " ", 0.2
    if c in "ªº":
        return "s", 0.8
    if o in (0xAD, 0x200B, 0xFEFF):
        return "x", 2.0
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        if not c.isalpha():
            return "s", 0.8
        common = c.lower() in "àâäáãåæçéèêëíìîïñóòôöõøœúùûüýÿßšž"
        return ("L" if c.islower() else "U"), (0.3 if c.islower() else 0.6) if common else (0.9 if c.islower() else 1.0)
    if 0x370 <= o < 0x400:
        return "g", 0.5
    if 0x400 <= o < 0x460 or 0x490 <= o < 0x492:
        return "c", 0.5
    if 0x460 <= o < 0x530:
        return "c", 2.0
    if 0x4E00 <= o < 0xA000:
        return "h", _han(c)
    if 0x3000 <= o < 0x3020 or 0xFF00 <= o < 0xFF61:
        return "j", 0.2
    if 0x3040 <= o < 0x3100:
        return "k", 0.25
    if 0xFF61 <= o < 0xFFA0:
        return "k", 0.8
    if 0xAC00 <= o < 0xD7A4:
        return "w", _hangul(c)
    if 0x2500 <= o < 0x25A0:
        return "b", 0.6
    if 0x2000 <= o < 0x2070 or 0x2070 <= o < 0x2400 or 0x25A0 <= o < 0x2800:
        return "s", 0.8
    if c.isalpha():
        return "o", 2.0
    return "x", 2.5


def implausible(text: str, left: str = " ", right: str = " ") -> float:
    """The cost of ``text`` between two neighbours; 0 for ASCII."""
    total = 0.0
    n = len(text)
    kinds = [_kind(left)[0], *(_kind(c)[0] for c in text), _kind(right)[0]]
    for i, c in enumerate(text, 1):
        k, base = _kind(c)
        if k in "ludp" and ord(c) < 0x80:
            continue
        a, b = kinds[i - 1], kinds[i + 1]
        total += base
        if k == " ":
            total += 1.2 if a in "luLU" and b in "lL" else 0.0
        elif k == "U":
            total += 2.0 if a in "lL" else 0.0
            total += 0.5 if a not in "luLU" and b not in "luLU" else 0.0
        elif k == "s":
            total += 1.7 if a in "luLUgc" or b in "lLgc" or a == "s" and c != text[i - 2 : i - 1] else 0.0
        elif k == "q":
            total += 2.0 if c not in "’‘·–—" and a in "luLU" and b in "luLU" else 0.0
        elif k == "b":
            total += 3.0 if a in "luLUs" or b in "lLUs" else -0.5
        elif k in "gc":
            total += 3.0 if a in "luLU" else 0.0
            total += 3.0 if b in "luLU" else 0.0
            total += 2.0 if (k == "g" and "c" in (a, b)) or b == "s" or a == "s" else 0.0
            # beside its like a letter is usual, but not a capital after a small one
            total += (0.5 if c.isupper() and text[i - 2 : i - 1].islower() else -0.2) if a == k else -0.2 if b == k else 0.0
        elif k in "hjkw":
            total += 2.0 if k != "j" and (a in "luLU" or b in "luLU") else 0.0
            total += 0.8 if k == "w" and "h" in (a, b) else 0.0
            # a single kana or syllable among other signs is no word of its language
            total += 0.9 if k in "kw" and a not in "kwhj" and b not in "kwhj" else 0.0
            total += 2.0 if k == "j" and a in "lL" and b in "lL" else 0.0
        elif k == "o":
            # a letter beside one of its own script
            total -= 1.7 if text[max(0, i - 2) : i - 1] and ord(text[i - 2]) >> 8 == ord(c) >> 8 or i < n and ord(text[i]) >> 8 == ord(c) >> 8 else 0.0
        elif k == "L":
            total += 0.6 if a in "LU" and b in "LU" and i > 1 and i < n else 0.0
    return total


def _alike(text: str, wrong: str, korean: bool) -> bool:
    """Whether a run may be text of one East Asian encoding read in another: it must look like the one it was read in."""
    if wrong == "cp949":
        return not korean and sum("\uac00" <= c <= "\ud7a3" for c in text) > 1 and not is_korean(text)
    return 2 * sum(c >= "\u2e80" for c in text) > len(text)


def is_korean(text: str) -> bool:
    """Whether the Hangul of a text is made of the syllables frequent in Korean, not of any."""
    hangul = [c for c in text if "\uac00" <= c <= "\ud7a3"]
    return 5 * sum(c in _KOREAN for c in hangul) >= len(hangul) > 0


def _neighbours(text: str, korean: bool = False) -> Iterator[tuple[str, tuple[str, str]]]:
    if _ENTITY.search(text):
        yield html.unescape(text), ("", "unescape")
    for wrong, right in STEPS:
        if (wrong, right) in _ALIKE and not _alike(text, wrong, korean):
            continue
        raw = _encode(text, wrong)
        if raw is None:
            continue
        try:
            new = raw.decode(right)
        except UnicodeDecodeError:
            continue
        if new != text and "\x00" not in new:
            yield new, (wrong, right)


def search(text: str, left: str = " ", right: str = " ", korean: bool = False) -> tuple[str, float, tuple]:
    """The cheapest text reachable from a run, its cost and the steps to it; ``korean`` says that its Hangul is genuine."""
    first = implausible(text, left, right)
    best = (first, text, ())
    queue = [(first, 0, text, ())]
    seen = {hash(text)}
    opened = 0
    while queue and opened < OPEN:
        f, _, state, path = heapq.heappop(queue)
        opened += 1
        if f < best[0]:
            best = (f, state, path)
        if len(path) >= MOST_STEPS:
            continue
        for new, step in _neighbours(state, korean):
            if hash(new) in seen:
                continue
            seen.add(hash(new))
            heapq.heappush(queue, (implausible(new, left, right) + STEP_COST * (len(path) + 1), len(seen), new, (*path, step)))
    return best[1], best[0], best[2]


def _with_losses(run: str, left: str, right: str) -> str | None:
    """A run with U+FFFD decoded around its losses, if that makes it clearly more plausible."""
    best = (implausible(run, left, right) - GAIN, None)
    for wrong, right_ in (("gb18030", "utf-8"), ("big5", "gbk"), ("big5", "utf-8"), ("sloppy", "utf-8")):
        raw = [b"\xff" if c == "�" else _encode(c, wrong) for c in run]
        if None in raw:
            continue
        new = b"".join(raw).decode(right_, "replace")
        if (c := implausible(new, left, right)) < best[0]:
            best = (c, new)
    return best[1]


def _decodes(path: Iterable[tuple[str, str]]) -> bool:
    return any(right != "unescape" for _, right in path)


@lru_cache(maxsize=20_000)
def _cached(text: str, left: str, right: str, korean: bool) -> tuple[str, float, tuple, float]:
    return (*search(text, left, right, korean), implausible(text, left, right))


def _mend_run(text: str, left: str, right: str, korean: bool = False) -> tuple[str, float, tuple, float]:
    """As search, with the first cost; what long runs give is not remembered."""
    return (_cached if len(text) <= 64 else _cached.__wrapped__)(text, left, right, korean)


def _apply(text: str, path: Iterable[tuple[str, str]]) -> str | None:
    for wrong, right in path:
        if right == "unescape":
            text = html.unescape(text)
            continue
        raw = _encode(text, wrong)
        if raw is None:
            return None
        try:
            text = raw.decode(right)
        except UnicodeDecodeError:
            return None
    return text


def _calm(run: str, left: str, right: str, korean: bool = False) -> bool:
    """Runs that need no search: usual letters and quotes one by one, or usual Chinese text."""
    if len(run) == 1:
        o = ord(run)
        return not (0x80 <= o < 0xA0 or o == 0xFFFD) and not (0x2E80 <= o and (_kind(left)[0] == "l" or _kind(right)[0] == "l"))
    if run[0] >= "⺀" or run[-1] >= "⺀":
        if _kind(left)[0] == "l" or _kind(right)[0] == "l":
            return False
        if not korean and any("\uac00" <= c <= "\ud7a3" for c in run):
            return False
        costs = [_kind(c)[1] for c in run]
        return sum(costs) <= 0.45 * len(run) + 0.9 and max(costs) <= 1.2
    if all(_kind(c)[0] == "b" for c in run):
        return not {_kind(left)[0], _kind(right)[0]} & set("luLU")
    if run.isalpha() and len(run) > 2:
        kinds = {_kind(c)[0] for c in run}
        return len(kinds) == 1 and kinds <= {"g", "c"} and _kind(left)[0] not in "lu" and _kind(right)[0] not in "lu"
    return False


def mend(value: str) -> tuple[bool, str, bool]:
    """(damaged, the text as far as it can be restored, whether that is all of it)."""
    if value.isascii() and "&" not in value:
        return False, value, True
    damaged = False
    korean = is_korean(value)
    out: list[str] = []
    paths: set[tuple] = set()
    spans: list[tuple[int, int, str]] = []
    held: list[tuple[int, int, str, str, str]] = []
    for m in _RUN.finditer(value):
        a, b = m.span()
        run = m[0]
        left, right = value[a - 1] if a else " ", value[b] if b < len(value) else " "
        if run.isascii():
            # entities alone are damaged only if what they stand for is decoded further
            plain = html.unescape(run)
            if not plain.isascii() and not _calm(plain, left, right, korean):
                new, cost, path, first = _mend_run(plain, left, right, korean)
                if path and _decodes(path) and first - cost >= ENTITY_GAIN:
                    damaged = True
                    paths.add(path)
                    spans.append((a, b, new))
            continue
        if "�" in run:
            damaged = True
            # the bytes behind U+FFFD are gone, but what stands between them can be read
            if (whole := _with_losses(run, left, right)) is not None:
                spans.append((a, b, whole))
                continue
        elif _calm(run, left, right, korean):
            held.append((a, b, run, left, right))
            continue
        at = a
        for part in re.split("(�+)", run):
            end = at + len(part)
            if part and part[0] != "�":
                l2, r2 = value[at - 1] if at else " ", value[end] if end < len(value) else " "
                new, cost, path, first = _mend_run(part, " " if l2 == "�" else l2, " " if r2 == "�" else r2, korean)
                if path and _decodes(path) and first - cost >= GAIN:
                    damaged = True
                    paths.add(path)
                    spans.append((at, end, new))
                else:
                    held.append((at, end, part, l2, r2))
            at = end
    if _LOST.search(value):
        damaged = True
    if not damaged:
        return False, value, True
    for a, b, run, left, right in held:
        first = implausible(run, left, right)
        for path in sorted(paths):
            new = _apply(run, path)
            # a lone Chinese character among ASCII that is read as UTF-8 like the rest of the value was damaged with it
            lone = 2.5 if len(run) == 1 and run >= "\u2e80" and left < "\x80" and right < "\x80" and path[-1][1] == "utf-8" else 0.0
            if new is not None and new != run and implausible(new, left, right) < first + lone:
                spans.append((a, b, new))
                break
    at = 0
    for a, b, new in sorted(spans):
        out += [value[at:a], new]
        at = b
    text = "".join([*out, value[at:]])
    return True, text, not _LOST.search(text)


def restore(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The damaged values of ``column``: (keys, restored, complete).

    complete is false where lost characters remain. Null and empty values and ASCII
    ones without entities are never damaged and give no row; genuine foreign letters, symbols and HTML
    entities are left alone. Repeated keys give a row each. Other columns of
    ``rows`` are ignored.
    """
    picked = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(column).cast("string").alias("_text"))
    picked = widen(picked.filter(F.col("_text").rlike(r"[^\x00-\x7f]|&(?:#\d|#[xX]|[A-Za-z])")))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, r) for i, v in enumerate(batch["_text"]) if (r := mend(v))[0]]
            if found:
                at = [i for i, _ in found]
                part = {c: [batch[c].iloc[i] for i in at] for c in batch.columns if c != "_text"}
                yield pd.DataFrame(part | {"restored": [r[1] for _, r in found], "complete": [r[2] for _, r in found]})

    kinds = dict(picked.dtypes)
    schema = ", ".join(f"_k{i} {kinds[f'_k{i}']}" for i in range(len(keys))) + ", restored string, complete boolean"
    return picked.mapInPandas(look, schema).select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "restored", "complete")
