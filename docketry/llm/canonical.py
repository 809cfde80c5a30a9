"""Free-entered values mapped to a reference list (problem 1).

A symmetric-delete dictionary over the reference names is built once on the
driver, from a reference list whose size is checked first, and broadcast. Every
value is looked up by the deletes of the beginning of its own spelling (edit
distance up to 2) and the hits are ranked by a weighted Damerau-Levenshtein cost,
then by how often a reference row is linked already. A value that one row fits
is mapped to it; of several that fit equally well the first by that rank is
reported beside the miss. The pass over the values is a map: no shuffle, so a
value that holds a third of all rows costs nothing extra. A longer reference list
is worked through in blocks of the checked size, over distinct values; their
candidates are merged and chosen among as those of one dictionary are.

Names are compared by their core, the words without the kind of law, the year
and any remark; kind and year then choose among the rows that share a core.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.runtime import checkpoint, rows_up_to, widen

#: Reference rows that one broadcast dictionary may hold (about 6 KB each).
MAX_REFERENCE = 20_000
#: Distinct values a task remembers.
MEMORY = 50_000
#: Letters of a core of which deletes are made: two names within two edits have beginnings within two.
PREFIX = 16
#: Distinct words of a long reference list that the driver may hold.
MAX_WORDS = 2_000_000
#: Costs so close that kind and year decide between them.
CLOSE = 0.08
#: Parts into which the rows of one value are spread where results are joined to them.
SALTS = 32
#: How a value was read, the surest first: a whole name, a whole core, a misspelt core, a citation, a beginning.
WHOLE, CORE, NEAR, CITED, CUT = range(5)

#: Words for kinds of law, each with the kind it stands for.
KINDS = {
    "act": "act", "acts": "act", "loi": "act", "a": "act",
    "regulations": "regulation", "regulation": "regulation", "regs": "regulation", "reg": "regulation", "reglement": "regulation",
    "rules": "rule", "rule": "rule", "regles": "rule", "regle": "rule",
    "statute": "act", "statutes": "act", "code": "code", "decree": "decree", "decret": "decree", "order": "order",
    "ordinance": "ordinance", "bylaw": "bylaw", "bill": "bill", "law": "law",
}
#: Kind words long enough to be recognised although misspelt.
FUZZY_KINDS = ("regulations", "regulation", "reglement", "statute", "rules", "regles", "decree", "code", "act", "loi")
#: Letter pairs that scanners confuse, so that one for the other is a cheap edit.
CONFUSED = {frozenset(x) for x in ("il", "ij", "lt", "ft", "ec", "eo", "co", "ao", "uv", "vy", "hb", "nh", "nu", "mn", "rn", "ce", "ea", "gq", "sz")}

_LEAD = re.compile(
    r"^(?:(?:in )?(?:pursuant ?to|under|see also|see|cf|cited in|per|within the meaning of|as defined in|contrary to|selon|en vertu de|au sens de|aux termes de|vu)\b ?)?"
    r"(?:(?:ss?|sections?|sec|subsections?|subs|paragraphs?|para|articles?|art|rules?|clauses?|reg|par|schedule|part) ?\d[\d ]*(?: [a-z] )?(?:[a-z] )*(?:and \d+ |et \d+ )?)?"
    r"(?:(?:of|in|to|de|du|des|from|under) )?(?:(?:the|la|le|les|l|this|that|said) )?"
)
_TAIL = re.compile(
    r"(?: (?:and|et))?(?: (?:ss?|sections?|sec|subsections?|paragraphs?|para|articles?|art|clauses?|par|schedule|part) ?\d[\d ]*(?:[a-z]\b ?)*)+$"
    r"| (?:as amended(?: .*)?|as am|amended|tel que modifie.*|modifiee?|repealed|abroge|in force|consolidated|supra|ibid|see note|et seq|and regulations thereunder|note \d+)$"
)
_YEAR = re.compile(r"\b(1[89]\d\d|20\d\d)\b")
_CITE = re.compile(r"(?:[a-z0-9] ?){1,6}?(?:reg )?\d{2,4} ?(?:c ?)?\d{2,5}|sor ?\d+ ?\d+")
_RESPECTING = re.compile(r"^(an )?(\w+) (respecting|concerning|relating to|regarding|to provide for)\b ?(the )?")
_SPACE = re.compile(r" +")
_PLAIN = re.compile(r"[^a-z0-9()]+")


def plain(text: str) -> str:
    """Lower-case words without accents or punctuation; brackets stay."""
    if text.isascii():
        return _PLAIN.sub(" ", text.lower()).strip()
    text = unicodedata.normalize("NFKD", text.replace("’", "'").replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("æ", "ae").replace("œ", "oe"))
    text = "".join(c for c in text if not unicodedata.combining(c)).lower()
    return _SPACE.sub(" ", "".join(c if c.isalnum() or c in "()" else " " for c in text)).strip()


@lru_cache(maxsize=4096)
def _scan(word: str) -> str:
    """Digits that scanners put for letters set right."""
    return word.translate(str.maketrans("015|", "olsl")) if any(c.isalpha() for c in word) else word


def fold(word: str) -> str:
    """One spelling for letter pairs that scanners take for one letter."""
    return word.replace("rn", "m").replace("vv", "w").replace("ri", "n").replace("cl", "d").replace("ii", "u")


def squash(words: str) -> str:
    """The letters and digits of plain words, without spaces."""
    return words.replace(" ", "").replace("(", "").replace(")", "")


def cite_key(text: str) -> str:
    """A citation without spaces and points; letters that look like digits count as those."""
    return squash(plain(text)).translate(str.maketrans("oils", "0115"))


def cost(a: str, b: str, most: float = 2.0) -> float:
    """Weighted Damerau-Levenshtein cost of ``a`` against ``b``, or 9 beyond ``most``.

    A substitution costs 1, an insertion or deletion 0.9, a swap of neighbours 0.8, a
    doubled letter or a pair that scanners confuse 0.6.
    """
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > int(most / 0.6):
        return 9.0
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    older, old = [], [0.9 * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [0.9 * i]
        for j, y in enumerate(b, 1):
            if x == y:
                new.append(old[j - 1])
                continue
            c = min(
                old[j] + (0.6 if i > 1 and a[i - 2] == x else 0.9),
                new[j - 1] + (0.6 if j > 1 and b[j - 2] == y else 0.9),
                old[j - 1] + (0.6 if frozenset((x, y)) in CONFUSED else 1.0),
            )
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, older[j - 2] + 0.8)
            new.append(c)
        if min(new) > most:
            return 9.0
        older, old = old, new
    return old[-1] if old[-1] <= most else 9.0


def allowed(size: int) -> float:
    """The cost up to which a core of ``size`` letters is taken as misspelt."""
    return 0.0 if size < 5 else 1.0 if size < 8 else 2.0


def deletes(word: str, depth: int) -> set[str]:
    """``word`` and all it becomes by removing up to ``depth`` letters."""
    found = {word}
    edge = found
    for _ in range(depth):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        found = found | edge
    return found


def _hashes(words: Iterable[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64)


def _bag(word: str) -> np.ndarray:
    """How often each letter occurs, letters folded into 32 counts."""
    return np.bincount(np.frombuffer(word.encode("utf-32-le"), np.uint32) & 31, minlength=32).astype(np.int16)


@dataclass
class Parsed:
    """What a name says: cores (each with the cost of reading it so), kinds, years."""

    cores: dict[str, float] = field(default_factory=dict)
    bodies: dict[str, str] = field(default_factory=dict)
    kind: str = ""
    year: str = ""
    cut: str = ""


@lru_cache(maxsize=100_000)
def _kind_of(word: str) -> tuple[str, float]:
    if word in KINDS:
        return KINDS[word], 0.0
    if len(word) >= 3:
        for k in FUZZY_KINDS:
            most = 2.0 if len(k) >= 9 else 1.0 if len(k) >= 5 else 0.0
            if (c := cost(_scan(word), _scan(k), most)) <= most and word[0] == k[0]:
                return KINDS[k], c * 0.25
    return "", 0.0


def parse(text: str) -> Parsed:
    """Take a typed name apart: remarks off, inverted forms set right, kind and year apart."""
    out = Parsed()
    raw = text.strip()
    words = plain(raw)
    cut = bool(re.search(r"(\.\.\.|…)\s*[\"”']?\s*$", raw))
    if m := re.search(r"\((1[89]\d\d|20\d\d)\)", words):
        words = words.replace(m[0], " " + m[1])
    words = re.sub(r"\((as am\w*[^)]*|amended|repealed|abrogee?|consolidated|tel que modifie[^)]*)\)", " ", words)
    words = re.sub(r"(\d) ?\((\w+)\)", r"\1 \2 ", words)
    words = re.sub(r"(\d) ?\((\w+)\)", r"\1 \2 ", words)
    words = _SPACE.sub(" ", words).strip()
    words = re.sub(r"^pursuantto(?:the)?\b", "pursuant to", words)
    words = re.sub(r"\b(act|regulations|rules|reglement|regles|loi)(respecting|sur)\b", r"\1 \2", words)
    for _ in range(2):
        shorter = _LEAD.sub("", words, count=1).strip()
        words = shorter if len(squash(shorter)) >= 3 else words
    for _ in range(3):
        words = _TAIL.sub("", words).strip()
    years = _YEAR.findall(words)
    out.year = years[-1] if years else ""
    words = _SPACE.sub(" ", _YEAR.sub(" ", words)).strip()
    forms: list[tuple[str, str, float]] = []

    def add(body: str, kind: str, extra: float = 0.0) -> None:
        body = _SPACE.sub(" ", body).strip()
        if body:
            forms.append((body, kind, extra))

    inner = re.search(r"\(([^()]{3,})\)", words)
    outside = _SPACE.sub(" ", re.sub(r"\([^()]*\)", " ", words)).strip()
    if m := _RESPECTING.match(outside):
        kind, c = _kind_of(m[2])
        if kind:
            body = outside[m.end() :].strip()
            add(f"{inner[1]} {body}" if inner else body, kind, c)
    if inner:
        parts = outside.split()
        if parts:
            for at in (-1, 0):
                kind, c = _kind_of(parts[at])
                if kind:
                    rest = parts[:-1] if at else parts[1:]
                    add(f"{inner[1]} {' '.join(rest)}", kind, c)
        add(f"{inner[1]} {outside}", "", 0.0)
    flat = squash(words)
    spaced = words.replace("(", " ").replace(")", " ").split()
    if spaced:
        kind, c = _kind_of(spaced[-1])
        if kind and len(spaced) > 1:
            add(" ".join(spaced[:-1]), kind, c)
        kind, c = _kind_of(spaced[0])
        if kind and len(spaced) > 1:
            rest = spaced[1:]
            while rest and rest[0] in ("sur", "de", "du", "des", "la", "le", "les", "l", "respecting", "of", "the"):
                rest = rest[1:]
            add(" ".join(rest), kind, c)
    for k in ("regulations", "regulation", "regs", "rules", "act", "statute", "code", "decree"):
        if flat.endswith(k) and len(flat) > len(k) + 3:
            add(flat[: -len(k)], KINDS[k], 0.05)
    for k in ("regulations", "rules", "statute"):
        for size in (len(k), len(k) - 1, len(k) + 1):
            tail = flat[-size:]
            if len(flat) > size + 5 and tail[:1] == k[0] and tail != k and cost(tail, k, 2.0 if len(k) > 8 else 1.0) <= 2.0:
                add(flat[:-size], KINDS[k], 0.3)
    for k in ("loisur", "reglementsur", "reglessur"):
        if flat.startswith(k):
            body = flat[len(k) :]
            add(body, KINDS[k[:-3]], 0.05)
            add(re.sub(r"^(les|le|la|l)", "", body), KINDS[k[:-3]], 0.05)
    if len(spaced) == 1:
        for size in (2, 3, 4):
            if len(flat) > size + 6 and flat[-size] == "a":
                add(flat[:-size], "act", 0.6)
    if not any(k and e == 0 for _, k, e in forms):
        add(" ".join(spaced), "", 0.1)
    for body, kind, extra in list(forms):
        if body.startswith("the") and not body.startswith("the "):
            add(body[3:], kind, extra + 0.05)
    kinds: dict[str, float] = {}
    for body, kind, extra in forms:
        core = _scan_all(body)
        if len(core) >= 3 and (core not in out.cores or extra < out.cores[core]):
            out.cores[core], out.bodies[core] = extra, body
        if kind and extra < kinds.get(kind, 9.0):
            kinds[kind] = extra
    out.kind = min(kinds, key=lambda k: (kinds[k], k)) if kinds else ""
    out.cut = _scan(squash(" ".join(spaced))) if cut else ""
    return out


def _scan_all(body: str) -> str:
    return _scan(squash(body))


class Dictionary:
    """The reference rows as a symmetric-delete dictionary that can be pickled."""

    def __init__(self, rows: Iterable[tuple[int, list[str], list[str]]], linked: dict[int, int] | None = None, words: Iterable[str] = ()) -> None:
        """rows: (id, names, citations); linked: how many rows link to an id already; words: those of all names, if rows are not all."""
        self.linked = linked or {}
        self.exact: dict[str, set[int]] = defaultdict(set)
        self.whole: dict[str, set[int]] = defaultdict(set)
        self.cites: dict[str, set[int]] = defaultdict(set)
        self.kinds: dict[int, set[str]] = defaultdict(set)
        self.years: dict[int, set[str]] = defaultdict(set)
        self.words: set[str] = set(words)
        cores: dict[str, set[int]] = defaultdict(set)
        short: dict[str, set[int]] = defaultdict(set)
        for key, names, cites in rows:
            for c in cites:
                if c and c.strip():
                    self.cites[cite_key(c)].add(key)
            for name in names:
                if not name or not name.strip():
                    continue
                self.exact[_scan(squash(plain(name)))].add(key)
                p = parse(name)
                least = min(p.cores.values(), default=0.0)
                for core, extra in p.cores.items():
                    if extra == least and p.kind:
                        cores[core].add(key)
                        self.words.update(p.bodies[core].split())
                        *first, last = p.bodies[core].split()
                        for size in range(3, len(last)):
                            short[_scan_all(" ".join([*first, last[:size]]))].add(key)
                if p.kind:
                    self.kinds[key].add(p.kind)
                    self.whole[_scan(squash(plain(name)))].add(key)
                if p.year:
                    self.years[key].add(p.year)
        self.exact, self.whole, self.cites = dict(self.exact), dict(self.whole), dict(self.cites)
        self.kinds, self.years = dict(self.kinds), dict(self.years)
        for t in list(cores):
            cores[fold(t)] |= cores[t]
        for t in set(short) & set(cores):
            del short[t]
        #: After the whole cores come those whose last word is cut short; these bear one edit at most.
        self.terms = [*sorted(cores), *sorted(short)]
        self.whole_terms = len(cores)
        self.laws = [frozenset(cores.get(t) or short[t]) for t in self.terms]
        self.at = {t: i for i, t in enumerate(self.terms)}
        self.bags = np.stack([_bag(t) for t in self.terms]) if self.terms else np.zeros((0, 32), np.int16)
        self.names = sorted(self.whole)
        words, which = [], []
        for i, t in enumerate(self.terms):
            found = deletes(t[:PREFIX], int(min(allowed(len(t)), 2 if i < self.whole_terms else 1)))
            words.append(_hashes(found))
            which.append(np.full(len(words[-1]), i, dtype=np.int32))
        hashes = np.concatenate(words) if words else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.which = hashes[order], (np.concatenate(which)[order] if which else np.zeros(0, np.int32))
        self._memory: dict[str, tuple] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memory": {}}

    def known(self, core: str) -> bool:
        """Whether a core is made of words of the reference names, so that no word of it is misspelt."""
        ends = {0}
        for b in range(1, len(core) + 1):
            if any(core[a:b] in self.words for a in ends):
                ends.add(b)
        return len(core) in ends

    def near(self, core: str) -> dict[int, float]:
        """The terms within the allowed cost of a core, with their cost."""
        if core in self.at:
            i = self.at[core]
            return {i: 0.0 if i < self.whole_terms else 0.4}
        if self.known(core):
            return {}
        found = self._near(core)
        if not found and fold(core) != core:
            found = {i: c + 0.5 for i, c in self._near(fold(core)).items()}
        return found

    def _near(self, core: str) -> dict[int, float]:
        depth = int(allowed(len(core)))
        if not depth or not len(self.hashes):
            return {}
        keys = _hashes(deletes(core[:PREFIX], depth))
        lo = np.searchsorted(self.hashes, keys)
        there = self.hashes[np.minimum(lo, len(self.hashes) - 1)] == keys
        lo, hi = lo[there], np.searchsorted(self.hashes, keys[there], "right")
        hits = np.unique(np.concatenate([self.which[a:b] for a, b in zip(lo, hi)])) if len(lo) else self.which[:0]
        most = allowed(len(core))
        # an edit costs 0.6 at least and changes two counts of letters at most
        hits = hits[np.abs(self.bags[hits] - _bag(core)).sum(axis=1) <= 2 * int(most / 0.6)].tolist()
        found = {i: cost(core, self.terms[i], most if i < self.whole_terms else 1.0) + 0.4 * (i >= self.whole_terms) for i in hits}
        return {i: c for i, c in found.items() if c <= most}

    def candidates(self, value: str) -> list[tuple[int, float, int, int, bool, bool]]:
        """What may be meant: (how, cost, links, id, whether the value's year, its kind is the row's), not chosen among yet."""
        if value in self._memory:
            return self._memory[value]
        found = self._candidates(value)
        if len(self._memory) >= MEMORY:
            self._memory.clear()
        self._memory[value] = found
        return found

    def _candidates(self, value: str) -> list[tuple[int, float, int, int, bool, bool]]:
        words = plain(value)
        key = _scan(squash(words))
        if not key:
            return []

        def told(how: int, laws: dict[int, float], kind: str = "", year: str = "") -> list:
            least = min(laws.values())
            return [(how, c, self.linked.get(k, 0), k, bool(year) and year in self.years.get(k, ()), bool(kind) and kind in self.kinds.get(k, ())) for k, c in laws.items() if c <= least + CLOSE]

        if key in self.exact:
            return told(WHOLE, dict.fromkeys(self.exact[key], 0.0))
        p = parse(value)
        best: dict[int, float] = {}
        read = p.cores
        if sure := {c: e for c, e in read.items() if c in self.at and self.at[c] < self.whole_terms}:
            read = sure
        for core, extra in read.items():
            if core in self.exact and core not in self.at:
                for k in self._agreeing(self.exact[core], p.kind, p.year):
                    best[k] = min(best.get(k, 9.0), extra)
            for i, c in self.near(core).items():
                for k in self.laws[i]:
                    best[k] = min(best.get(k, 9.0), c + extra)
        if best:
            return told(CORE if sure else NEAR, best, p.kind, p.year)
        if cited := self._cited(words):
            return told(CITED, dict.fromkeys(cited, 0.0))
        if p.cut and len(p.cut) >= 6:
            at = bisect.bisect_left(self.names, p.cut)
            laws: set[int] = set()
            while at < len(self.names) and self.names[at].startswith(p.cut):
                laws |= self.whole[self.names[at]]
                at += 1
            if laws:
                return told(CUT, dict.fromkeys(laws, 0.5))
        return []

    def _agreeing(self, laws: Iterable[int], kind: str, year: str) -> set[int]:
        rows = [(NEAR, 0.0, 0, k, bool(year) and year in self.years.get(k, ()), bool(kind) and kind in self.kinds.get(k, ())) for k in laws]
        return {r[3] for r in fitting(rows)}

    def _cited(self, words: str) -> set[int]:
        """Rows whose citation ends or is a run of the value's words."""
        parts = words.replace("(", " ").replace(")", " ").split()
        found: set[int] = set()
        for a in range(len(parts)):
            key = ""
            for b in range(a, min(len(parts), a + 7)):
                key += cite_key(parts[b])
                if len(key) > 5 and key in self.cites:
                    found |= self.cites[key]
        return found


def fitting(found: Iterable[tuple[int, float, int, int, bool, bool]]) -> list[tuple[int, float, int, int, bool, bool]]:
    """Of candidates, of one dictionary or several, those that fit equally well, ranked by cost, links and id.

    The surest reading counts alone; within it, costs up to CLOSE above the
    least are alike, and rows that share the value's year, then its kind, go
    before the others.
    """
    rows = list(found)
    if not rows:
        return []
    how = min(r[0] for r in rows)
    rows = [r for r in rows if r[0] == how]
    least = min(r[1] for r in rows)
    rows = [r for r in rows if r[1] <= least + CLOSE]
    for agrees in (4, 5):
        if len(rows) > 1 and (same := [r for r in rows if r[agrees]]):
            rows = same
    return sorted(rows, key=lambda r: (r[1], -r[2], r[3]))


def reference_rows(laws: Iterable) -> list[tuple[int, list[str], list[str]]]:
    """(id, names, citations) of rows with title, normalized_title, citation, aliases_json.

    An alias that reads like the row's own citation counts as a citation; a
    broken JSON list counts as none.
    """
    out = []
    for r in laws:
        try:
            aliases = json.loads(r["aliases_json"]) if r["aliases_json"] else []
        except ValueError:
            aliases = []
        aliases = [a for a in aliases if isinstance(a, str)] if isinstance(aliases, list) else []
        cited = [a for a in aliases if re.search(r"\d", a) and not any(_kind_of(w)[0] and len(w) > 3 for w in plain(re.sub(r"\breg\b", "", a, flags=re.I)).split()) and not re.search(r"[a-z]{4}", plain(a)) and not re.search(r"\b(act|loi)\b", plain(a))]
        out.append((r["id"], [r["title"], r["normalized_title"], *[a for a in aliases if a not in cited]], [r["citation"], *cited]))
    return out


def _words(laws: Iterable) -> set[str]:
    """The words of the cores of all names of some reference rows."""
    return {w for row in reference_rows(laws) for name in row[1] if name and name.strip() and (p := parse(name)).kind for c, e in p.cores.items() if e == min(p.cores.values()) for w in p.bodies[c].split()}


_CANDIDATE = "array<struct<how: int, cost: double, links: bigint, id: bigint, year: boolean, kind: boolean>>"


def map_to_reference(values: DataFrame, reference: DataFrame, key: str, value: str, linked: DataFrame | None = None, max_reference: int = MAX_REFERENCE) -> DataFrame:
    """Map each row of ``values`` to the one reference row its value names.

    Returns (key, law_id, cost, n_fit, nearest): law_id is -1 and cost null where
    no reference row, or more than one equally good, fits; n_fit says how many
    did; nearest is the first of them by cost, by how often it is linked, and by
    id, or null. ``linked`` has (law_id, n), how often each reference row is linked.

    Null and blank values give no row. Repeated keys give a row each. A value of
    any length is parsed whole. An empty reference list leaves every value
    unmatched. Columns besides key and value are ignored, whatever their names.
    A reference list of any length gives the same; its distinct words must be
    MAX_WORDS at most.
    """
    spark = values.sparkSession
    rows = values.select(F.col(key).cast("bigint").alias("_key"), F.col(value).cast("string").alias("_value")).filter(F.regexp_replace(F.col("_value"), r"[\s\x{a0}\x{3000}\x{200b}]+", "") != "")
    columns = reference.select("id", "title", "normalized_title", "citation", "aliases_json")
    counts = linked.groupBy(F.col("law_id").alias("id")).agg(F.sum("n").alias("_n")) if linked is not None else columns.select("id", F.lit(0).cast("bigint").alias("_n")).limit(0)
    columns = columns.join(counts, "id", "left")
    told = "law_id bigint, cost double, n_fit int, nearest bigint"

    def verdict(found: list) -> tuple:
        fit = fitting(found)
        one = len(fit) == 1
        return (fit[0][3] if one else -1, fit[0][1] if one else None, len(fit), fit[0][3] if fit else None)

    def framed(data: dict, verdicts: list[tuple]) -> pd.DataFrame:
        law, c, n, nearest = zip(*verdicts) if verdicts else ((), (), (), ())
        return pd.DataFrame(data | {"law_id": pd.Series(law, dtype="int64"), "cost": pd.Series(c, dtype="float64"), "n_fit": pd.Series(n, dtype="int32"), "nearest": pd.Series(nearest, dtype="Int64")})

    def shipped(block: list, words: Iterable[str] = ()):
        return spark.sparkContext.broadcast(Dictionary(reference_rows(block), {r["id"]: r["_n"] for r in block if r["_n"]}, words))

    whole = rows_up_to(columns, max_reference)
    if whole is not None:
        one = shipped(whole)

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            d = one.value
            for batch in batches:
                best = {v: verdict(d.candidates(v)) for v in batch["_value"].unique()}
                yield framed({"_key": batch["_key"].to_numpy()}, [best[v] for v in batch["_value"]])

        return widen(rows).mapInPandas(look, f"_key bigint, {told}").withColumnRenamed("_key", key)

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"w": sorted(_words(batch.to_dict("records")))}, dtype=object)

    words = rows_up_to(columns.select("id", "title", "normalized_title", "citation", "aliases_json").mapInPandas(spell, "w string").distinct(), MAX_WORDS)
    if words is None:
        raise ValueError(f"the reference names have more than {MAX_WORDS} distinct words")
    # equal shares by hash, each within the bound
    n = 2 * -(-columns.count() // max_reference)
    names = checkpoint(widen(rows.select("_value").distinct()))
    parts = []
    for i in range(n):
        block = shipped(columns.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == i).collect(), [r["w"] for r in words])

        def gather(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [(v, c) for v in batch["_value"] if (c := block.value.candidates(v))]
                if found:
                    yield pd.DataFrame({"_value": [v for v, _ in found], "_found": [c for _, c in found]})

        parts.append(checkpoint(names.mapInPandas(gather, f"_value string, _found {_CANDIDATE}")))
        block.destroy()
    # of a block only what is within CLOSE of its best comes here
    merged = reduce(DataFrame.unionByName, parts).groupBy("_value").agg(F.flatten(F.collect_list("_found")).alias("_found"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield framed({"_value": batch["_value"].to_numpy()}, [verdict([tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in found]) for found in batch["_found"]])

    chosen = merged.mapInPandas(choose, f"_value string, {told}").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
    every = salted.join(chosen, ["_value", "_s"], "left")
    return every.select(F.col("_key").alias(key), F.coalesce("law_id", F.lit(-1)).cast("bigint").alias("law_id"), "cost", F.coalesce("n_fit", F.lit(0)).alias("n_fit"), "nearest")
