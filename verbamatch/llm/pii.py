"""Personal data and secrets behind disguises, reported at their place in the source.

Two transducers rewrite a text and keep, for every character they emit, the source
span it came from:

1. characters: homoglyphs (full-width forms, Cyrillic and Greek look-alikes, digits of
   other scripts) become ASCII, invisible characters vanish;
2. phrases: ``[at]``, ``(dot)``, ``name at host dot tld`` become ``@`` and ``.``, runs of at
   least three spelled digits (English, Spanish, French, German, Portuguese, with
   double and triple) become digits.

Identifiers are detected in the rewritten text and their spans mapped back.  Cards must
hold Luhn's check, IBANs theirs, and addresses in bare words a top-level domain or a word
such as "mail" before them.  A text goes through this only if it holds a digit, an @, a
character beyond Latin-1, one of the trigger words, or an at word along with a full stop
anywhere; without any of these no identifier can arise, so nothing is lost.

Defined results: null and empty texts hold nothing; overlapping findings keep the
leftmost, then the longest, then the first kind in KINDS (so ties can't arise); repeated
rows each report; doc_id may be null; an empty table gives nothing; extra columns of any
name don't matter.  Texts of any length are scanned whole.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table
from ._text import chunks, words

DIGITS = {
    0: "zero oh cero zéro null nul",
    1: "one uno un eins um",
    2: "two dos deux zwei zwo dois duas",
    3: "three tres trois drei três",
    4: "four cuatro quatre vier quatro",
    5: "five cinco cinq fünf fuenf",
    6: "six seis sechs",
    7: "seven siete sept sieben sete",
    8: "eight ocho huit acht oito",
    9: "nine nueve neuf neun nove",
}
WORD_DIGIT = {w: d for d, ws in DIGITS.items() for w in ws.split()}
TIMES = {"double": 2, "triple": 3}
AT = r"(?:\s*[\[({<]\s*(?:at|arroba|@)\s*[\])}>]\s*|\s+(?:at|arroba)\s+|\s*@\s*)"
DOT = r"(?:\s*[\[({<]\s*(?:dot|punto|ponto|punkt|point|\.)\s*[\])}>]\s*|\s+(?:dot|punto|ponto|punkt)\s+|\.)"
_NAME = r"[A-Za-z0-9_%+\-]+"
ADDRESS = re.compile(rf"(?<![\w]){_NAME}(?:{DOT}{_NAME})*{AT}{_NAME}(?:{DOT}{_NAME})+", re.I)
_WORDS = "|".join(sorted((*WORD_DIGIT, *TIMES), key=len, reverse=True))
SPELLED = re.compile(rf"(?<!\w)(?:{_WORDS}|\d)(?:[\s,.\-]{{1,3}}(?:{_WORDS}|\d(?!\d)))+(?!\w)", re.I)
# A disguise in bare words is prose unless its last label is a top-level domain (all countries' and the common generic
# ones, in lower case) or a word such as "mail" stands before it, and unless name or host is a function word.
TOP_LEVEL = frozenset(
    (
        "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz "
        "ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz "
        "la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa "
        "re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw "
        "com net org edu gov mil int arpa info biz name pro aero coop museum jobs mobi travel tel cat asia post xxx app dev page blog shop store online site website web tech cloud host email mail "
        "digital media news press live video studio design art agency group team company business services support help center network systems software solutions consulting marketing finance bank "
        "money capital fund insurance law legal health care clinic doctor school academy university education science research institute foundation community social chat email club fun games game "
        "world global international city town house homes land estate london paris berlin tokyo nyc xyz top icu vip win bid loan work works zone space today guru expert codes computer data domains "
        "engineer engineering events exchange express fit fitness food coffee pizza restaurant bar pub wine beer photo photos gallery pics link click download wiki ink moe one plus red blue green"
    ).split()
)
CUE = re.compile(r"\b(?:e-?mails?|mails?|contact\w*|contat\w*|kontakt\w*|write|reach|address|adresse|escrib\w*|escrev\w*|correo|schreib\w*|[ée]cri\w*)\b", re.I)
_FUNCTION = frozenset("a an the this that these those my our your his her their its it in on of to and or one some any all each no by from with as is was are were be been".split())
_UNIT = re.compile(rf"{_WORDS}|\d", re.I)

KINDS = {
    "email": re.compile(r"(?<![\w.%+\-])[A-Za-z0-9_%+\-]+(?:\.[A-Za-z0-9_%+\-]+)*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"),
    "secret": re.compile(r"(?<!\w)(?:AKIA[0-9A-Z]{16}(?!\w)|(?:password|passwd|pwd|token|secret|api[_-]?key)\s*[=:]\s*[\"']?[A-Za-z0-9_\-]{8,}[\"']?|-----BEGIN [A-Z ]*PRIVATE KEY-----)", re.I),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)"),
    "ip": re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"),
    "ssn": re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"),
    "card": re.compile(r"(?<![\w+\-])\d(?:[ \-]?\d){12,18}(?![\w\-])"),
    # +1 and area in front, other countries' prefixes, area in brackets, 3-3-4, a leading 0 with pairs or one group, ten or eleven digits on their own.
    "phone": re.compile(
        r"(?<![\w+\-])(?:\+?1[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}|\+(?!1)\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,5}(?:[ .\-]?\d{2,5}){1,5}"
        r"|\(\d{2,4}\)[ .\-]?\d{3,5}[ .\-]?\d{4}|\d{3}[ .\-]\d{3}[ .\-]\d{4}|0\d(?:[ .\-]\d{2}){4}|0\d{2,4}[ \-/]\d{5,8}|\d{10,11})(?![\w\-])"
    ),
}


@lru_cache(1)
def homoglyphs() -> dict[int, str]:
    """Characters that stand for one ASCII character, and invisible ones."""
    out: dict[int, str] = {}
    for c in range(0x250, sys.maxunicode + 1):
        s = chr(c)
        d = unicodedata.decimal(s, None)
        if d is not None:
            out[c] = str(d)
            continue
        if 0xFF01 <= c <= 0xFF5E or 0x2070 <= c <= 0x209C or 0x1D400 <= c <= 0x1D7FF or 0x2460 <= c <= 0x24FF:
            k = unicodedata.normalize("NFKC", s)
            if len(k) == 1 and k.isascii():
                out[c] = k
    look = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "З": "3", "ο": "o", "α": "a", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "ι": "i", "κ": "k", "Ο": "O", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z", "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", "﹒": "."}
    out |= {ord(k): v for k, v in look.items()}
    out |= {c: " " for c in (0x2000, 0x2001, 0x2002, 0x2003, 0x2007, 0x2009, 0x202F, 0x3000)}
    out |= {c: "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
    out[0xA0] = " "
    return out


class Rewritten:
    """A text rewritten by edits, each (start, end, replacement), with the way back."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self.at, self.src, at, last = [], [0], [(0, 0)], 0, 0
        for s, e, new in edits:
            parts += [text[last:s], new]
            at += s - last
            self._mark(at, s, e)
            at += len(new)
            self._mark(at, e, None)
            last = e
        parts.append(text[last:])
        self.text = "".join(parts)

    def _mark(self, at: int, src: int, end: int | None) -> None:
        if self.at[-1] == at:
            self.at.pop()
            self.src.pop()
        self.at.append(at)
        self.src.append((src, end if end is not None else -1))

    def _of(self, i: int) -> tuple[int, int]:
        """Source span of the rewritten character i."""
        k = bisect_right(self.at, i) - 1
        src, end = self.src[k]
        if k == 0 or end == -1:
            return src + i - self.at[k], src + i - self.at[k] + 1
        return src, end

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self._of(start)[0], self._of(end - 1)[1]


def _characters(text: str) -> Rewritten | None:
    table_ = homoglyphs()
    special = {c for c in set(text) if ord(c) in table_}
    if not special:
        return None
    pattern = re.compile("[" + "".join(map(re.escape, special)) + "]")
    return Rewritten(text, [(m.start(), m.end(), table_[ord(m.group())]) for m in pattern.finditer(text)])


_AT, _DOT = re.compile(AT, re.I), re.compile(DOT, re.I)


def _in_words(text: str, m: re.Match) -> bool:
    """Whether a disguise without brackets and signs is an address rather than prose."""
    labels = re.split(rf"{AT}|{DOT}", m.group(), flags=re.I)
    if _FUNCTION & {x.lower() for x in labels[:-1]}:
        return False
    return labels[-1] in TOP_LEVEL or bool(CUE.search(text, max(0, m.start() - 60), m.start()))


def _phrases(text: str) -> Rewritten | None:
    edits: list[tuple[int, int, str]] = []
    for m in ADDRESS.finditer(text):
        part = m.group()
        if "@" in part and not re.search(r"[\s\[({<]", part):
            continue  # a plain address
        if "@" not in part and not re.search(r"[\[({<]", part) and not _in_words(text, m):
            continue
        at = [x for x in _AT.finditer(part)]
        plain = [x for x in at if "@" in x.group()] or at
        for x in plain[:1]:
            edits.append((m.start() + x.start(), m.start() + x.end(), "@"))
            for y in _DOT.finditer(part):
                if y.group() != "." and (y.end() <= x.start() or y.start() >= x.end()):
                    edits.append((m.start() + y.start(), m.start() + y.end(), "."))
    for m in SPELLED.finditer(text):
        units = list(_UNIT.finditer(text, m.start(), m.end()))
        if sum(u.group().lower() in WORD_DIGIT for u in units) < 3:
            continue
        last, times, begin = m.start(), 1, None
        for u in units:
            word = u.group().lower()
            if begin is None:
                begin = u.start()
                if last < begin:
                    edits.append((last, begin, ""))
            if word in TIMES:
                times = TIMES[word]
                continue
            digit = word if word.isdigit() else str(WORD_DIGIT[word])
            edits.append((begin, u.end(), digit * times))
            last, times, begin = u.end(), 1, None
    if not edits:
        return None
    edits.sort()
    kept, end = [], 0
    for s, e, new in edits:
        if s >= end:
            kept.append((s, e, new))
            end = e
    return Rewritten(text, kept)


def _valid(kind: str, value: str) -> bool:
    if kind == "ip":
        return all(int(x) < 256 for x in value.split("."))
    if kind == "iban":
        v = value.replace(" ", "")
        return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
    if kind == "card":
        d = [int(c) for c in value if c.isdigit()][::-1]
        return d[-1] in (2, 3, 4, 5, 6) and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0
    if kind == "phone":
        return 8 <= sum(c.isdigit() for c in value) <= 15
    return True


def detect(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, rewritten value): spans are of characters of the source."""
    steps, now = [], text
    for step in (_characters, _phrases):
        done = step(now)
        if done is not None:
            steps.append(done)
            now = done.text
    found = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in pattern.finditer(now):
            if _valid(kind, m.group()):
                found.append((m.start(), -m.end(), rank, kind, m.group()))
    found.sort()
    out, end = [], 0
    for s, minus_e, _, kind, value in found:
        if s < end:
            continue
        end = -minus_e
        a, b = s, end
        for step in reversed(steps):
            a, b = step.back(a, b)
        out.append((kind, a, b, value))
    return out


_TRIGGER = np.zeros(256, bool)
for _b in b"0123456789@":
    _TRIGGER[_b] = True
_TRIGGER[0xC4:] = True


@lru_cache(1)
def _trigger_words() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]:
    def listed(names: list[str]):
        raw = np.frombuffer(" ".join(names).encode(), np.uint8)
        return words(raw, np.array([0, len(raw)]))

    digits = np.sort(listed([*WORD_DIGIT, *TIMES]).hash)
    names = np.sort(listed("dot punto ponto punkt point password passwd pwd token secret api key apikey begin".split()).hash)
    return digits, names, np.sort(listed(["at", "arroba"]).hash), listed(["akia" + 16 * "x"]).prefix_hash(np.array([0]), 4)[0]


def _isin(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    i = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[i] == h


def suspects(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Indices of the texts in which an identifier could arise."""
    n = len(offs) - 1
    hit = np.zeros(n, bool)
    at = np.flatnonzero(_TRIGGER[raw])
    hit[np.searchsorted(offs, at, "right") - 1] = True
    # Soft hyphens, hard spaces, and the two signs among the letters, beside which a word begins.
    pair = (raw[:-1] == 0xC2) & ((raw[1:] == 0xAD) | (raw[1:] == 0xA0)) | (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    soft = np.flatnonzero(pair)
    hit[np.searchsorted(offs, soft, "right") - 1] = True
    w = words(raw, offs)
    if len(w.hash):
        digits, names, at_words, akia = _trigger_words()
        doc = w.doc
        hit[doc[_isin(w.hash, names)]] = True
        # Any full stop counts: DOT also takes it in brackets, with white space around it.
        dotted = np.zeros(n, bool)
        dotted[np.searchsorted(offs, np.flatnonzero(raw == 46), "right") - 1] = True
        with_at = np.zeros(n, bool)
        with_at[doc[_isin(w.hash, at_words)]] = True
        hit |= dotted & with_at
        long = np.flatnonzero(w.end - w.start >= 20)
        hit[doc[long[w.prefix_hash(long, 4) == akia]]] = True
        d = _isin(w.hash, digits)
        run = np.flatnonzero(d[:-2] & d[1:-1] & d[2:])
        hit[doc[run[doc[run] == doc[run + 2]]]] = True
    return np.flatnonzero(hit)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, found, value): source characters start..end hold `found`, which reads `value`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for lo, _, raw, offs in chunks(batch.column(1)):
                for k in suspects(raw, offs).tolist():
                    text = raw[offs[k] : offs[k + 1]].tobytes().decode()
                    got = detect(text)
                    if got:
                        doc = batch.column(0)[lo + k].as_py()
                        rows += [(doc, kind, a, b, text[a:b], value) for kind, a, b, value in got]
            if rows:
                cols = list(zip(*rows))
                types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "kind", "start", "end", "found", "value"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, kind string, start int, end int, found string, value string")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


QUERIES = {"op8_pii": op8_pii}
ORACLE: dict[str, str] = {}
