"""Entity extraction and tagging.

Regular expressions in the JVM don't give offsets, and which matches overlap decides
what is tagged, so extraction runs on Arrow batches with Python's `re`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .pieces import in_pieces

MATCHES = "array<struct<entity_type string, value string, start int, `end` int, text_matched string>>"

_ARROW = pa.list_(pa.struct([("entity_type", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text_matched", pa.string())]))


@dataclass(frozen=True)
class Entity:
    entity_type: str
    value: str | float | int
    start: int
    end: int
    text_matched: str


Extractor = Callable[[str, date], Iterable[Entity]]

_MONEY = re.compile(r"(?:R\$|BRL)\s*(?P<after>[\d.,]+)|(?P<before>[\d.,]+)\s+(?:reais|centavos|BRL)", re.I)
_SIZE = re.compile(r"(?P<n>\d+(?:[.,]\d+)?)\s*(?P<unit>kg|g|mg|m|cm|mm|l|ml)\b", re.I)
_DIGITS = re.compile(r"\b\d+(?:[.,]\d+)?\b")
_LETTERS = re.compile(r"\b[a-zA-ZçÇêÊ]+\b")
_MODEL = re.compile(r"\b(?:[A-Za-z]+-?\d+[A-Za-z\d]*|\d+-?[A-Za-z]+[A-Za-z\d]*)\b")
_DATES = (re.compile(r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"), re.compile(r"\b\d{1,2}\s+de\s+[A-Za-zçÇ]+\s+de\s+\d{2,4}\b", re.I), re.compile(r"\b(?:amanhã|ontem|hoje)\b", re.I))
_SPACED_MODEL = re.compile(r"\b([A-Za-z]{2,4})\s+((?=[A-Za-z\d]*\d)[A-Za-z\d]+(?:-[A-Za-z\d]+)*)\b")
_MONTHS = {m: i for i, m in enumerate("janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split(), 1)} | {"marco": 3}
NUMBER_WORDS = dict(zip("zero um dois três quatro cinco seis sete oito nove dez".split(), range(11))) | {"uma": 1, "duas": 2, "tres": 3, "cem": 100, "mil": 1000}


def money(text: str, today: date) -> Iterable[Entity]:
    for m in _MONEY.finditer(text):
        raw = m["after"] or m["before"]
        try:
            value = float(raw.replace(".", "").replace(",", ".") if "," in raw else raw)
        except ValueError:
            continue
        yield Entity("money", value, *m.span(), m.group())


def dimension(text: str, today: date) -> Iterable[Entity]:
    for m in _SIZE.finditer(text):
        yield Entity("dimension", f"{float(m['n'].replace(',', '.'))}:{m['unit'].lower()}", *m.span(), m.group())


def number(text: str, today: date) -> Iterable[Entity]:
    found = []
    for m in _DIGITS.finditer(text):
        value = float(m.group().replace(",", "."))
        found.append(Entity("number", int(value) if value.is_integer() else value, *m.span(), m.group()))
    for m in _LETTERS.finditer(text):
        if (word := m.group().lower()) in NUMBER_WORDS:
            found.append(Entity("number", NUMBER_WORDS[word], *m.span(), m.group()))
    return sorted(found, key=lambda e: e.start)


def product_model(text: str, today: date) -> Iterable[Entity]:
    return [Entity("productmodel", m.group().upper(), *m.span(), m.group()) for m in _MODEL.finditer(text)]


@lru_cache(1024)
def resolve_date(text: str, today: date) -> str | None:
    """ISO date of a Portuguese expression: day/month/year, 'd de mês de y', hoje, ontem, amanhã.

    Two-digit years fall within 1969 to 2068. Where only month/day order is possible, that is taken.
    """
    text = text.lower()
    near = {"hoje": 0, "ontem": -1, "amanhã": 1}
    if text in near:
        return (today + timedelta(near[text])).isoformat()
    parts = re.split(r"\s+de\s+|[/-]", text)
    if len(parts) != 3:
        return None
    month = _MONTHS.get(parts[1]) or next((n for m, n in _MONTHS.items() if len(parts[1]) == 3 and m.startswith(parts[1])), None)
    try:
        day, year = int(parts[0]), int(parts[2])
        month = month or int(parts[1])
    except ValueError:
        return None
    if year < 100:
        year += 1900 if year >= 69 else 2000
    if month > 12 >= day:
        day, month = month, day
    try:
        return date(year, month, day).isoformat()
    except ValueError:
        return None


def dates(text: str, today: date) -> Iterable[Entity]:
    seen = set()
    for pattern in _DATES:
        for m in pattern.finditer(text):
            value = resolve_date(m.group(), today)
            if value and m.span() not in seen:
                seen.add(m.span())
                yield Entity("date", value, *m.span(), m.group())


class Registry:
    """Extractors by name; user-defined ones are shipped to the workers inside the UDF."""

    def __init__(self):
        self._known: dict[str, Extractor] = {"date": dates, "dimension": dimension, "money": money, "number": number, "product_model": product_model}

    def register(self, name: str, extractor: Extractor) -> None:
        self._known[name] = extractor

    def get(self, name: str) -> Extractor:
        if name not in self._known:
            raise ValueError(f"extractor {name!r} is not registered")
        return self._known[name]

    def available(self) -> list[str]:
        return list(self._known)

    def choose(self, names: Iterable[str] | None) -> list[Extractor]:
        return [self.get(n) for n in (list(names or ()) or self.available())]


registry = Registry()


def inspect(text: str, extractors: list[Extractor], today: date) -> list[Entity]:
    """All matches by start; those of one start stay in the extractors' order."""
    return sorted((e for x in extractors for e in x(text, today)), key=lambda e: e.start)


def normalise(text: str, extractors: list[Extractor], today: date) -> str:
    """Text with tags in place of entities; of overlapping ones the first by start stays."""
    out, at, end = [], 0, 0
    for e in inspect(text, extractors, today):
        if e.start < end:
            continue
        out += [text[at : e.start], f"<{e.entity_type}:{e.value}>"]
        at = end = e.end
    return "".join([*out, text[at:]])


def collapse_models(col: Column) -> Column:
    """Join a short maker's code with the number after it: `GN 500` becomes `GN500`."""
    return F.regexp_replace(col, r"(?U)\b([A-Za-z]{2,4})\s+((?=[A-Za-z\d]*\d)[A-Za-z\d]+(?:-[A-Za-z\d]+)*)\b", "$1$2")


def extract(col: Column, names: Iterable[str] | None = None, as_of: date | None = None, known: Registry = registry) -> Column:
    """Array of MATCHES of each text. Dates relative to today resolve against `as_of`."""
    extractors, today = known.choose(names), as_of or date.today()

    def found(t: str) -> list[dict]:
        return [{"entity_type": e.entity_type, "value": str(e.value), "start": e.start, "end": e.end, "text_matched": e.text_matched} for e in inspect(t, extractors, today)]

    @F.arrow_udf(MATCHES)
    def run(texts: pa.Array) -> pa.Array:
        return in_pieces(texts, lambda piece: [None if t is None else found(t) for t in piece], _ARROW)

    return run(col)


def tag(col: Column, names: Iterable[str] | None = None, as_of: date | None = None, known: Registry = registry) -> Column:
    """Text with spaced models joined and entities replaced by tags."""
    extractors, today = known.choose(names), as_of or date.today()

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return in_pieces(texts, lambda piece: [None if t is None else normalise(_SPACED_MODEL.sub(r"\1\2", t), extractors, today) for t in piece], pa.string())

    return run(col)
