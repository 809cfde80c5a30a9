"""Planning of one query on the driver: plain functions of its text, small dictionaries as data."""

from __future__ import annotations

import re
from collections.abc import Sequence

#: Law topics by the words that tell them, in order (own minimal dictionary).
DOMAINS = {
    "tenancy": ("tenant", "landlord", "lease", "rent", "eviction"),
    "employment": ("employee", "employer", "dismissal", "wages", "overtime"),
    "criminal": ("offence", "accused", "sentence", "charter", "bail"),
    "property": ("easement", "mortgage", "boundary", "zoning", "title"),
    "commercial": ("contract", "breach", "sale", "warranty", "guarantee"),
}
#: Places by their names and short names.
PLACES = {"ontario": "Ontario", "on": "Ontario", "alberta": "Alberta", "ab": "Alberta", "quebec": "Quebec", "qc": "Quebec", "british columbia": "British Columbia", "bc": "British Columbia", "manitoba": "Manitoba", "nova scotia": "Nova Scotia", "canada": "Canada", "federal": "Canada"}
#: Chinese terms with their English ones; longer terms come first when used.
GLOSSARY = {"租客": "tenant", "房东": "landlord", "租约": "lease", "驱逐": "eviction", "抵押": "mortgage", "合同": "contract", "违约": "breach", "雇员": "employee", "解雇": "dismissal", "法院": "court", "证据": "evidence", "上诉": "appeal", "抵押合同": "mortgage contract"}
SYNONYMS = {"tenant": ("lessee", "renter"), "landlord": ("lessor",), "eviction": ("termination of tenancy",), "dismissal": ("termination", "firing"), "mortgage": ("charge",), "contract": ("agreement",)}
COURTS = {"scc": "Supreme Court", "supreme court": "Supreme Court", "onca": "Ontario Court of Appeal", "ont. c.a.": "Ontario Court of Appeal", "onsc": "Ontario Superior Court", "superior court": "Ontario Superior Court", "fc": "Federal Court"}
GENERIC = frozenset("about after against also before between case cases court does from have into law laws legal must shall should that their them then there these they this under what when where which will with would your".split())
#: Weights of a term by how it came into a query (fixed values).
WEIGHTS = {"quoted": 1.35, "typed": 1.0, "expanded": 0.85, "domain": 0.65, "generic": 0.35}


def unique(values: Sequence[str], most: int | None = None) -> list[str]:
    """The first of each value, case and outer blanks ignored."""
    seen: dict[str, str] = {}
    for v in values:
        if v and v.strip():
            seen.setdefault(v.strip().lower(), v.strip())
    return list(seen.values())[:most]


def language_of(text: str) -> str:
    """zh, en or mixed by the share of CJK among letters."""
    han, latin = len(re.findall(r"[一-鿿]", text)), len(re.findall(r"[A-Za-z]", text))
    share = han / max(1, han + latin)
    return "zh" if share >= 0.6 else "en" if share <= 0.1 else "mixed"


def translate(text: str, most: int = 12) -> list[tuple[str, str]]:
    """The glossary's terms in a text, longest first; what a term covers is used up."""
    found = []
    for zh in sorted(GLOSSARY, key=lambda x: (-len(x), x)):
        if zh in text and len(found) < most:
            found.append((zh, GLOSSARY[zh]))
            text = text.replace(zh, " ")
    return found


def synonyms(terms: Sequence[str]) -> list[str]:
    """Terms with their synonyms after them."""
    return unique([x for t in terms for x in (t, *SYNONYMS.get(t.lower(), ()))])


def court(name: str) -> str:
    """A court's one name; unknown names stay as 'raw:' and the name."""
    key = re.sub(r"\s+", " ", name.strip().lower())
    return COURTS.get(key, f"raw:{name.strip()}")


def intent(text: str) -> str:
    """What a query wants: a citation looked up, a comparison, guidance, or a search."""
    low = text.lower()
    if re.search(r"\b(19|20)\d{2} [a-z]{2,6} \d+\b| v\.? | c\. ", low):
        return "lookup"
    if re.search(r"\b(compare|versus|difference)\b", low):
        return "compare"
    if re.search(r"\b(how|what|should|can i|may i)\b|\?", low):
        return "guidance"
    return "search"


def plan(query: str) -> dict:
    """Places, domains, terms with weights and the order of source kinds for one query."""
    english = " ".join([query, *(en for _, en in translate(query))])
    low = english.lower()
    places = unique([full for name, full in PLACES.items() if re.search(rf"(?<![a-z]){re.escape(name)}(?![a-z])", low)])
    words = unique(re.findall(r"[a-z][a-z'-]{2,}", low))
    domains = [d for d, marks in DOMAINS.items() if any(m in low for m in marks)]
    quoted = unique(re.findall(r'"([^"]+)"', query))
    weights = {w: WEIGHTS["generic"] if w in GENERIC else WEIGHTS["typed"] for w in words}
    for w in synonyms([w for w in words if w not in GENERIC]):
        weights.setdefault(w, WEIGHTS["expanded"])
    for d in domains:
        for w in DOMAINS[d][:3]:
            weights.setdefault(w, WEIGHTS["domain"])
    weights |= {q.lower(): WEIGHTS["quoted"] for q in quoted}
    laws_first = bool(re.search(r"\b(act|statute|section|regulation)s?\b", low))
    return {"language": language_of(query), "intent": intent(query), "places": places, "domains": domains, "terms": weights, "kinds": ["law", "case"] if laws_first else ["case", "law"]}


def clamp_limit(n: int | None, most: int = 100, default: int = 20) -> int:
    """A limit within 1 and ``most``."""
    return max(1, min(default if n is None else int(n), most))


def query_edges(query: str) -> list[tuple[str, str, str, float]]:
    """The query's own graph: (source, relation, target, weight) from it to its places, domains and terms."""
    p = plan(query)
    how = {WEIGHTS["quoted"]: "quoted", WEIGHTS["typed"]: "typed", WEIGHTS["expanded"]: "expanded", WEIGHTS["domain"]: "domain term"}
    edges = [("query", "place", x, 1.0) for x in p["places"]] + [("query", "domain", d, WEIGHTS["domain"]) for d in p["domains"]]
    return edges + [("query", how[w], x, w) for x, w in p["terms"].items() if w in how]
