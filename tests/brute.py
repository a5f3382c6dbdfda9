"""Plain Python versions of the operators, one text or pair at a time."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

from verbamatch.functions.text import STOPWORDS, contractions


def clean(t: str) -> str:
    t = re.sub(r"\\r\\n|\\rn|\\r|\\n|\\t|\r\n|\r|\n|\t", " ", t).lower()
    t = f" {t} "
    for short, full in contractions():
        t = t.replace(f" {short} ", f" {full} ")
    t = unicodedata.normalize("NFKD", t.strip()).encode("ascii", "ignore").decode()
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s$<>\-:.]", "", t)).strip()


def prepare(t: str) -> str:
    return " ".join(x for x in re.findall(r"<[^>]+>|[\w\-]+", clean(t)) if x.startswith("<") or x not in STOPWORDS)


def terms(t: str) -> list[str]:
    w = re.findall(r"\b\w\w+\b", t.lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def unit(v: dict) -> dict:
    n = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / n for k, x in v.items()} if n else {}


def tfidf(corpus: list[str], query: str) -> list[float]:
    rows = [Counter(terms(t)) for t in corpus]
    df = Counter(t for r in rows for t in r)
    idf = {t: math.log((1 + len(corpus)) / (1 + n)) + 1 for t, n in df.items()}
    q = unit({t: n * idf[t] for t, n in Counter(terms(query)).items() if t in idf})
    return [sum(x * q.get(t, 0) for t, x in unit({t: n * idf[t] for t, n in r.items()}).items()) for r in rows]


def bm25(corpus: list[str], query: str, k1: float = 1.2, b: float = 0.75) -> list[float]:
    rows = [Counter(t.split()) for t in corpus]
    df = Counter(t for r in rows for t in r)
    mean = sum(sum(r.values()) for r in rows) / max(len(rows), 1)
    out = []
    for r in rows:
        s = 0.0
        for t in query.split():
            if t in r:
                idf = math.log((len(rows) - df[t] + 0.5) / (df[t] + 0.5) + 1)
                s += idf * r[t] * (k1 + 1) / (r[t] + k1 * (1 - b + b * sum(r.values()) / max(mean, 1e-10)))
        out.append(s)
    return out


def dense(corpus: list[str], query: str, encoder) -> list[float]:
    def one(t: str) -> list[float]:
        v = encoder([t])[0]
        n = max(math.sqrt(sum(x * x for x in v)), 1e-10)
        return [x / n for x in v]

    q = one(query)
    return [min(1.0, max(0.0, sum(x * y for x, y in zip(q, one(t))))) for t in corpus]


def best(scores: list[float], top_n: int, least: float) -> list[tuple[int, float]]:
    rows = [(i, s) for i, s in enumerate(scores) if round(s, 9) >= least]
    return sorted(rows, key=lambda r: (-round(r[1], 9), r[0]))[:top_n]


def rerank(query: str, corpus: list[str], found: list[tuple[int, float]], weights: dict, fusion: str, k: int = 60) -> list[tuple[str, float]]:
    """(prepared text, score) of the retrieved ones by cosine and edit similarity; without semantic or entity scores."""
    rows = [(corpus[i], {"cosine": s, "edit": ratio(query, corpus[i])}) for i, s in found]
    if fusion == "linear":
        out = [(t, sum(w * s[n] for n, w in weights.items())) for t, s in rows]
        return sorted(out, key=lambda r: -round(r[1], 9))
    total: dict[str, float] = {}
    for n in weights:
        for rank, (t, _) in enumerate(sorted(rows, key=lambda r: -round(r[1][n], 9)), 1):
            total[t] = total.get(t, 0.0) + 1 / (k + rank)
    most = len(weights) / (k + 1)
    return [(t, min(1.0, s / most)) for t, s in total.items()]
