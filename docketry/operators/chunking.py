"""Structure-aware chunking of legal texts and extraction of what they name."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.runtime import widen

#: Tokens a chunk is filled up to, and the most it may have (fixed values).
TARGET, MOST = 384, 512
#: How far back, in characters, a defined short name is looked for (fixed value).
LOOK_BACK = 6000

_HEAD = re.compile(r"^\s*(?:(?:PART|CHAPTER|SECTION|SCHEDULE|PARTIE|CHAPITRE)\b.{0,100}|[A-Z][A-Z0-9 ,.'&()–—-]{2,80}|#{1,6}\s+\S.{0,100}|第.{1,6}[章节部].{0,40})\s*$")
_NUMBERED = re.compile(r"^\s*(?:\[(\d{1,4})\]|(\d{1,4})[.)]|(?:Section|Article|Paragraph)\s+(\d{1,4}))\s*")
_STOP = re.compile(r"(?<=[.!?;。！？；])\s*(?=\S)")
_TOKEN = re.compile(r"[一-鿿]|[A-Za-zÀ-ÿ0-9_]+|[^\sA-Za-zÀ-ÿ0-9_一-鿿]")
_ALIAS = re.compile(r"([A-Z][\w.&'-]*(?:\s+[A-Z][\w.&'-]*){0,6})\s*\((?:the |collectively,? the )?[\"“]([A-Za-z][\w ]{1,40})[\"”]\)")

#: What every definition of a short name has, and few texts.
_DEFINED = re.compile(r"\((?:the |collectively,? the )?[\"“]")


def count_tokens(text: str) -> int:
    """CJK characters, words and other signs, each as one."""
    return len(_TOKEN.findall(text))


def _fit(text: str, most: int) -> list[str]:
    """A text in parts of at most ``most`` tokens: by sentences, then by words."""
    if count_tokens(text) <= most:
        return [text]
    parts: list[str] = []
    held, size = "", 0
    for s in _STOP.split(text):
        n = count_tokens(s)
        units = [(s, n)] if n <= most else [(u, count_tokens(u)) for u in (" ".join(w) for w in _windows(s.split() or [s], most))]
        # no token reaches over a blank, so the counts of parts add up
        for u, n in units:
            if held and size + n > most:
                parts.append(held)
                held, size = u, n
            else:
                held, size = f"{held} {u}".strip(), size + n
    return [*parts, held] if held else parts


def _windows(words: list[str], most: int) -> Iterator[list[str]]:
    held: list[str] = []
    n = 0
    for w in words:
        for piece in (w[i : i + 4 * most] for i in range(0, len(w), 4 * most)) if len(w) > 4 * most else (w,):
            k = count_tokens(piece)
            if k > most:
                for i in range(0, len(piece), most):
                    if held:
                        yield held
                        held, n = [], 0
                    yield [piece[i : i + most]]
                continue
            if held and n + k > most:
                yield held
                held, n = [], 0
            held.append(piece)
            n += k
    if held:
        yield held


def chunk_document(text: str, target: int = TARGET, most: int = MOST) -> list[dict]:
    """Chunks of one document: headings are hard limits, numbered paragraphs begin segments.

    Each chunk has chunk_index, section_id, section_title, paragraph_start and
    paragraph_end (None without numbers), text and token_count. No overlap.
    """
    section, title, number = 0, "", None
    segments: list[tuple[int, str, int | None, str]] = []
    held: list[str] = []

    def close() -> None:
        body = "\n".join(held).strip()
        if body:
            segments.append((section, title, number, body))
        held.clear()

    for line in text.replace("\r\n", "\n").split("\n"):
        m = _NUMBERED.match(line)
        if line.strip() and not m and _HEAD.match(line):
            close()
            section, title, number = section + 1, line.strip(), None
            held.append(line.strip())
        elif m:
            if "\n".join(held).strip() not in ("", title):
                close()
            number = int(next(g for g in m.groups() if g))
            held.append(line)
        else:
            held.append(line)
    close()
    out: list[dict] = []
    for sec, name, no, body in segments:
        for part in _fit(body, most):
            n = count_tokens(part)
            last = out[-1] if out else None
            if last and last["section_id"] == sec and last["token_count"] < target and last["token_count"] + n <= target:
                last["text"] += "\n" + part
                last["token_count"] += n
                last["paragraph_end"] = no if no is not None else last["paragraph_end"]
                last["paragraph_start"] = last["paragraph_start"] if last["paragraph_start"] is not None else no
            else:
                out.append({"chunk_index": len(out), "section_id": sec, "section_title": name, "paragraph_start": no, "paragraph_end": no, "token_count": n, "text": part})
    return out


def known_aliases(prior: str, text: str) -> dict[str, str]:
    """Short names defined before or in a text that it uses, with what they stand for.

    A short name that was given to two different names stays unresolved.
    """
    found: dict[str, set[str]] = {}
    seen = prior[-LOOK_BACK:] + "\n" + text
    if not _DEFINED.search(seen):
        return {}
    for m in _ALIAS.finditer(seen):
        found.setdefault(m[2].lower(), set()).add(m[1])
    return {k: next(iter(v)) for k, v in found.items() if len(v) == 1 and re.search(rf"\b{re.escape(k)}\b", text, re.I)}


SCHEMA = T.StructType(
    [T.StructField("_key", T.LongType())]
    + [T.StructField(n, T.IntegerType()) for n in ("chunk_index", "section_id")]
    + [T.StructField("section_title", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in ("paragraph_start", "paragraph_end", "token_count")]
    + [T.StructField(n, T.StringType()) for n in ("text", "context_prefix")]
)


def chunk_documents(docs: DataFrame, key: str, text: str, title: str, target: int = TARGET, most: int = MOST) -> DataFrame:
    """Chunks of every document in order, each with a prefix that names title, section and known short names."""
    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"), F.coalesce(F.col(title), F.lit("")).alias("_title")).filter(F.trim("_text") != "")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in SCHEMA.fields]
        for batch in batches:
            out = []
            for k, body, name in zip(batch["_key"], batch["_text"], batch["_title"]):
                prior = ""
                for c in chunk_document(body, target, most):
                    told = [f"Title: {name}"] if name.strip() else []
                    told += [f"Section: {c['section_title']}"] if c["section_title"] else []
                    told += [f"{a} = {b}" for a, b in sorted(known_aliases(prior, c["text"]).items())]
                    out.append({"_key": k, **c, "context_prefix": " | ".join(told)[:2400]})
                    prior = (prior + "\n" + c["text"])[-2 * LOOK_BACK :]
            if not out:
                continue
            frame = pd.DataFrame(out, columns=names)
            for n in ("chunk_index", "section_id", "paragraph_start", "paragraph_end", "token_count"):
                frame[n] = frame[n].astype("Int32")
            yield frame

    return widen(rows).mapInPandas(work, SCHEMA).withColumnRenamed("_key", key)


#: Families of named things, each with its pattern and confidence (fixed values).
FAMILIES = (
    ("Case", r"\b[A-Z][\w'’.&-]+(?: [A-Z][\w'’.&-]+){0,5} (?:v\.|c\.) [A-Z][\w'’.&-]+(?: [A-Z][\w'’.&-]+){0,5}", 0.9),
    ("Citation", r"\b(?:19|20)\d{2} [A-Z]{2,6} \d{1,5}\b", 0.99),
    ("Statute", r"\b[A-Z][a-z]+(?: [A-Z][a-z]+){0,5} (?:Act|Code|Regulations|Rules)\b", 0.96),
    ("Section", r"\b(?:section|s\.|ss\.|art\.|Article) ?\d+(?:\(\d+\))*(?:\([a-z]\))?", 0.94),
    ("Court", r"\b(?:Supreme Court|Court of Appeal|Federal Court|Superior Court|Provincial Court|Tribunal)(?: of [A-Z][a-z]+)?", 0.98),
    ("Organisation", r"\b[A-Z][\w'’&-]+(?: [A-Z&][\w'’&-]*){0,4} (?:Inc|Ltd|Ltée|LLP|Corp|ULC|Trust|Municipality|Board)\b", 0.93),
    ("Amount", r"\$ ?\d[\d,]*(?:\.\d\d)?", 0.9),
    ("Date", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, (?:19|20)\d{2}\b", 0.95),
)
ENTITY = T.ArrayType(T.StructType([T.StructField("entity_type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("confidence", T.DoubleType())]))
_COMPILED = [(n, re.compile(p), c) for n, p, c in FAMILIES]


@F.pandas_udf(ENTITY)
def entities(texts: pd.Series) -> pd.Series:
    """The named things of each text with their place and confidence, in order of place."""

    def one(text: str | None) -> list[dict]:
        found = [{"entity_type": n, "name": m[0], "start": m.start(), "confidence": c} for n, p, c in _COMPILED for m in p.finditer(text or "")]
        return sorted(found, key=lambda e: (e["start"], e["entity_type"]))

    return texts.map(one)
