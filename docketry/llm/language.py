"""Languages of texts and of their lines (problem 8).

Segmentation-marginalised unigrams: each language has a probability for every
piece of a fixed public vocabulary, and a word's probability is the sum over all
its segmentations into pieces, by a forward algorithm. Pieces never cross a
space, so a text's score is the sum of its words' scores, and a word is scored
once per task. The probabilities are fitted by expectation maximisation on a
bounded sample of labelled rows; labels are cleaned on the way, as they are
sometimes wrong. Words are compared in lower case and without accents.

Scoring is one map over the rows; whole texts are read.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.tokens import TOKENIZERS
from docketry.runtime import widen

LANGUAGES = ("en", "fr", "zh", "es", "de", "pt")
#: Labelled rows to fit on, at most, and of each language; with fewer rows of a language all are used.
SAMPLE, SAMPLE_EACH = 2400, 400
LONGEST_SAMPLE = 20_000
VOCABULARY = "piece_bpe_32k.model"
#: Pieces of up to so many characters; what a character outside every piece costs in any language.
LONGEST, UNKNOWN = 16, 1e-7
#: Words from which a line tells its language by itself.
FEW = 4
#: Labels that say nothing.
NO_LABEL = ("", "und", "unknown", "mul", "mis", "zxx")
#: Words a task remembers.
MEMORY = 400_000

_WORD = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[^\W\d_㐀-䶿一-鿿豈-﫿]+")
_MARK = re.compile(r"[̀-ͯ]")
_MARKUP = re.compile(r"<[a-zA-Z/!][^<>]{0,300}>|&(?:#\d{1,7}|[A-Za-z]{2,8});|https?://\S+")
_ACCENTED = str.maketrans({"ß": "ss", "œ": "oe", "æ": "ae", "ø": "o"})


def normal(text: str) -> str:
    """Lower case, without accents and markup."""
    if "<" in text or "&" in text or "http" in text:
        text = _MARKUP.sub(" ", text)
    text = text.lower()
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFD", text)).translate(_ACCENTED)
    return text


def lines(text: str) -> list[str]:
    """The non-blank lines: split at LF, CR dropped."""
    return [x for x in text.replace("\r", "").split("\n") if x.strip()]


def label(code: str | None) -> str:
    """A label without case and region; '' where it says nothing."""
    code = re.split(r"[-_]", (code or "").strip().lower())[0]
    return "" if code in NO_LABEL else code


def pieces(folder: str = TOKENIZERS, name: str = VOCABULARY) -> dict[str, int]:
    """The vocabulary in lower case without accents: piece to number; a leading space is '▁'."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, name))
    out: dict[str, int] = {}
    for i in range(sp.get_piece_size()):
        if not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_byte(i):
            p = normal(sp.id_to_piece(i))
            if 0 < len(p) <= LONGEST and re.fullmatch(r"▁?[^\W\d_]+", p):
                out.setdefault(p, len(out))
    return out


class Model:
    """Piece probabilities of each language: probs[piece, language]."""

    def __init__(self, vocabulary: dict[str, int], probs: np.ndarray, languages: tuple[str, ...] = LANGUAGES) -> None:
        self.vocabulary, self.probs, self.languages = vocabulary, probs, languages
        self._words: dict[str, int] = {}
        self._table = np.zeros((1024, len(languages)), dtype=np.float64)

    def __getstate__(self) -> dict:
        return {"vocabulary": self.vocabulary, "probs": self.probs, "languages": self.languages}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def arcs(self, word: str) -> tuple[str, list[tuple[int, int, int]]]:
        """The word with its leading space, and its pieces as (from, to, piece)."""
        w = word if _is_han(word) else "▁" + word
        found = []
        for b in range(1, len(w) + 1):
            for a in range(max(0, b - LONGEST), b):
                if (p := self.vocabulary.get(w[a:b])) is not None:
                    found.append((a, b, p))
        return w, found

    def forward(self, word: str) -> np.ndarray:
        """The log probability of a word in every language, over all segmentations.

        Long words are summed in logarithms, as their probabilities are too small.
        """
        w, found = self.arcs(word)
        if len(w) > 40:
            return self._forward_log(len(w), found)
        at = np.zeros((len(w) + 1, len(self.languages)))
        at[0] = 1.0
        done = 0
        for a, b, p in found:
            while done < b - 1:
                done += 1
                at[done] += at[done - 1] * UNKNOWN
            at[b] += at[a] * self.probs[p]
        for k in range(done + 1, len(w) + 1):
            at[k] += at[k - 1] * UNKNOWN
        return np.log(np.maximum(at[-1], 1e-300))

    def _forward_log(self, size: int, found: list[tuple[int, int, int]]) -> np.ndarray:
        into: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for a, b, p in found:
            into[b].append((a, p))
        logs = np.log(np.maximum(self.probs, 1e-300))
        at = np.zeros((size + 1, len(self.languages)))
        for b in range(1, size + 1):
            ways = [at[b - 1] + np.log(UNKNOWN), *(at[a] + logs[p] for a, p in into[b])]
            at[b] = np.logaddexp.reduce(ways, axis=0)
        return at[-1]

    def number(self, word: str) -> int:
        """The row of the score table that holds a word's scores."""
        i = len(self._words)
        if i >= MEMORY:
            self._words.clear()
            i = 0
        if i >= len(self._table):
            self._table = np.concatenate([self._table, np.zeros_like(self._table)])
        self._table[i] = self.forward(word)
        self._words[word] = i
        return i

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The scores of each text in each language, and its number of words."""
        ids: list[int] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        known = self._words
        chunks: list[np.ndarray] = []
        for i, t in enumerate(texts):
            words = _WORD.findall(normal(t))
            counts[i] = len(words)
            if len(known) + len(words) >= MEMORY and ids:
                chunks.append(self._table[ids])
                ids = []
            if len(words) > MEMORY // 2:
                tally = Counter(words)
                total = sum(self.forward(w) * n for w, n in tally.items())
                chunks.append(self._table[ids] if ids else np.zeros((0, len(self.languages))))
                chunks.append(np.asarray(total)[None, :])
                counts[i] = -1
                ids = []
                continue
            for w in words:
                k = known.get(w)
                ids.append(self.number(w) if k is None else k)
        chunks.append(self._table[ids] if ids else np.zeros((0, len(self.languages))))
        flat = np.concatenate(chunks)
        rows = np.abs(counts)
        out = np.zeros((len(texts), len(self.languages)))
        if len(flat):
            ends = np.cumsum(rows)
            some = rows > 0
            out[some] = np.add.reduceat(flat, (ends - rows)[some], axis=0)
        return out, rows


def _is_han(word: str) -> bool:
    return len(word) == 1 and "㐀" <= word <= "﫿"


def fit(rows: Iterable[tuple[str, str]], vocabulary: dict[str, int], rounds: int = 2, languages: tuple[str, ...] = LANGUAGES) -> Model:
    """Fit piece probabilities to (text, label) rows.

    Each round counts the expected pieces of every language's words under the
    probabilities of the round before, then gives each line the language that
    scores best where that is clear, so wrong labels and mixed texts do not stay.
    """
    n = len(languages)
    texts: list[str] = []
    owner: list[int] = []
    doc: list[int] = []
    for d, (text, lang) in enumerate(rows):
        for x in lines(text or ""):
            texts.append(x)
            owner.append(languages.index(lang))
            doc.append(d)
    words = [_WORD.findall(normal(t)) for t in texts]
    owners, docs = np.array(owner, dtype=np.int64), np.array(doc, dtype=np.int64)
    assigned = owners
    model = Model(vocabulary, np.full((len(vocabulary), n), 1.0 / max(1, len(vocabulary))), languages)
    for step in range(rounds):
        by = [Counter() for _ in range(n)]
        for ws, k in zip(words, assigned.tolist()):
            by[k].update(ws)
        counts = np.zeros((len(vocabulary), n))
        for w in set().union(*by):
            _expect(model, w, np.array([c[w] for c in by], dtype=np.float64), counts)
        share = counts.sum(axis=1, keepdims=True) / max(1.0, counts.sum())
        probs = (counts + 200 * share + 0.02) / (counts.sum(axis=0, keepdims=True) + 200 + 0.02 * len(vocabulary))
        model = Model(vocabulary, probs, languages)
        if step < rounds - 1 and texts:
            scores, size = model.scores(texts)
            clear = _clear(scores, size)
            assigned = np.where(clear, scores.argmax(axis=1), owners)
            # a short line goes with the most of its text
            votes = np.zeros((docs[-1] + 1, n))
            np.add.at(votes, (docs[clear], assigned[clear]), 1.0)
            told = votes.sum(axis=1) > 0
            assigned = np.where(~clear & told[docs], votes.argmax(axis=1)[docs], assigned)
    return model


def _expect(model: Model, word: str, count: np.ndarray, into: np.ndarray) -> None:
    """Add a word's expected pieces, over all its segmentations, to ``into``; a long word counts in stretches."""
    if len(word) > 40:
        for i in range(0, len(word), 40):
            _expect(model, word[i : i + 40], count, into)
        return
    w, found = model.arcs(word)
    n = len(model.languages)
    if not found:
        return
    ahead = np.zeros((len(w) + 1, n))
    ahead[0] = 1.0
    by_end: dict[int, list] = defaultdict(list)
    for a, b, p in found:
        by_end[b].append((a, p))
    for b in range(1, len(w) + 1):
        ahead[b] = ahead[b - 1] * UNKNOWN
        for a, p in by_end[b]:
            ahead[b] += ahead[a] * model.probs[p]
    back = np.zeros((len(w) + 1, n))
    back[-1] = 1.0
    for b in range(len(w), 0, -1):
        back[b - 1] += back[b] * UNKNOWN
        for a, p in by_end[b]:
            back[a] += back[b] * model.probs[p]
    total = np.maximum(ahead[-1], 1e-300)
    for a, b, p in found:
        into[p] += count * ahead[a] * model.probs[p] * back[b] / total


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folder: str = TOKENIZERS, sample: int = SAMPLE, each: int = SAMPLE_EACH) -> Model:
    """Fit a model on at most ``sample`` labelled rows, an equal part of it and at most ``each`` of a language.

    The rows are those with the smallest hashes of their keys, so the same data
    give the same model. They are chosen from keys and labels alone; the texts
    are then read once, of the chosen rows only; texts over LONGEST_SAMPLE
    characters are left out. A language without labelled rows is never assigned.
    """
    each = min(each, max(1, sample // len(LANGUAGES)))
    known = F.lower(F.regexp_extract(F.trim(lang), r"^[A-Za-z]{2}(?=$|[-_])", 0))
    keyed = docs.select(F.col(key).alias("_key"), known.alias("_lang")).filter(F.col("_lang").isin(*LANGUAGES))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_key"), "_key"))
    chosen = keyed.withColumn("_r", rank).filter(F.col("_r") <= each).select("_key", "_lang")
    # at most ``each`` rows of each language
    texts = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_key").filter(F.length("_text") <= LONGEST_SAMPLE)
    rows = sorted((r["_lang"], r["_text"]) for r in texts.select("_lang", "_text").collect())
    return fit([(t, x) for x, t in rows], pieces(folder))


def _shares(scores: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Each language's share of a line: scores per word, made up to ten words, compared."""
    flat = scores * (np.minimum(words, 10) / np.maximum(words, 1))[:, None]
    flat = np.exp(flat - flat.max(axis=1, keepdims=True))
    return flat / flat.sum(axis=1, keepdims=True)


def _clear(scores: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Lines that tell their language by themselves: of FEW words or more, with a lead."""
    top = np.partition(scores, -2, axis=1)[:, -2:]
    return (words >= FEW) & (top.max(axis=1) - top.min(axis=1) > 4.0)


def decide(scores: np.ndarray, words: np.ndarray, sizes: np.ndarray, clear: np.ndarray, shares: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """(main language, confidence, language of each line, confidence of each line) of one text.

    A line of few words, a heading say, takes the language of the lines around it
    that fits its own words best; so it never makes a text mixed by itself. The
    main language is the one whose lines have the most characters; ties go to
    the first of the languages.
    """
    n = scores.shape[1]
    best = scores.argmax(axis=1)
    told = best[clear]
    if not len(told):
        got = np.full(len(words), int(scores.sum(axis=0).argmax()))
    elif told.min() == told.max():
        got = np.full(len(words), told[0])
    else:
        main = int(np.bincount(told, weights=sizes[clear], minlength=n).argmax())
        got = np.where(clear, best, -1)
        at = np.flatnonzero(clear)
        for i in np.flatnonzero(got < 0):
            k = int(np.searchsorted(at, i))
            around = [int(best[at[j]]) for j in (k, k - 1) if 0 <= j < len(at)] or [main]
            got[i] = max(around, key=lambda x: scores[i][x]) if words[i] else around[0]
    sure = np.where(words > 0, shares[np.arange(len(got)), got], 0.5)
    main = int(np.bincount(got, weights=sizes, minlength=n).argmax())
    mine = got == main
    return main, float((sure[mine] * sizes[mine]).sum() / max(1.0, sizes.sum())), got, sure


def detect(model: Model, text: str) -> tuple[int, float, np.ndarray, np.ndarray] | None:
    """``decide`` for one text; None without any word."""
    parts = lines(text)
    scores, words = model.scores(parts)
    if not words.sum():
        return None
    return decide(scores, words, np.array([len(p) for p in parts], dtype=np.float64), _clear(scores, words), _shares(scores, words))


def languages_of(docs: DataFrame, model: Model, key: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """The language of each text and, where they differ, of each of its lines.

    Returns (key, seg_no, lang, confidence, declared, n_chars): seg_no -1 is the
    whole text with its main language; seg_no 0 and on are its non-blank lines,
    given only for texts whose lines are not all in one language. declared is
    the row's label without case and region, '' if it says nothing.

    Null and blank texts, and texts without any word, give no row. Repeated keys
    give their rows each; other columns are ignored.
    """
    picked = widen(docs.select(F.col(key).alias("_key"), F.col(lang).cast("string").alias("_lang"), F.col(text).cast("string").alias("_text")).filter(F.col("_text").rlike(r"\p{L}")))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    columns = ["_key", "seg_no", "lang", "confidence", "declared", "n_chars"]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        for batch in batches:
            keys, labels = batch["_key"].tolist(), batch["_lang"].tolist()
            split = [lines(t) for t in batch["_text"]]
            for lo in range(0, len(batch), 500):
                out = []
                group = split[lo : lo + 500]
                flat = [x for parts in group for x in parts]
                if not flat:
                    continue
                scores, words = m.scores(flat)
                sizes = np.array([len(x) for x in flat], dtype=np.float64)
                clear, shares = _clear(scores, words), _shares(scores, words)
                at = 0
                for i, parts in enumerate(group, lo):
                    s = slice(at, at + len(parts))
                    at += len(parts)
                    if not words[s].any():
                        continue
                    main, sure, got, each = decide(scores[s], words[s], sizes[s], clear[s], shares[s])
                    declared = label(labels[i])
                    out.append((keys[i], -1, m.languages[main], sure, declared, int(sizes[s].sum())))
                    if got.min() != got.max():
                        out += [(keys[i], j, m.languages[x], float(c), declared, len(parts[j])) for j, (x, c) in enumerate(zip(got.tolist(), each))]
                if out:
                    yield pd.DataFrame(out, columns=columns).astype({"seg_no": "int32", "confidence": "float64", "n_chars": "int64"})

    kind = dict(picked.dtypes)["_key"]
    found = picked.mapInPandas(look, f"_key {kind}, seg_no int, lang string, confidence double, declared string, n_chars bigint")
    return found.withColumnRenamed("_key", key)
