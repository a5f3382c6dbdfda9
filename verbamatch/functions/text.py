"""Text normalisation as Column expressions: everything here stays in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Badly escaped control characters; the longer forms come first.
ESCAPED = "|".join([r"\\r\\n", r"\\rn", r"\\r", r"\\n", r"\\t"])
WHITE = r"(?U)[\s\x1c-\x1f]+"
# White space as Python's strip has it.
STRIPPED = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# In ASCII: runs of white space other than a single space, which needn't be replaced.
LONG_GAP = r"(?:[\t-\r\x1c-\x1f]| (?=[\t-\r\x1c- ]))[\t-\r\x1c- ]*"
# Word characters as Python's re has them: Java's \\w would leave out fractions and take in accents that stand alone.
WORD = r"\p{L}\p{N}_"
_ARTICLES = {"o": "o", "a": "a", "os": "os", "as": "as"}
_INDEFINITE = {"um": "um", "uma": "uma", "uns": "uns", "umas": "umas"}


def contractions() -> list[tuple[str, str]]:
    """Portuguese preposition-article contractions and what they stand for."""
    out = [(f"{short}{x}", f"{full} {x}") for short, full in (("d", "de"), ("n", "em"), ("pel", "por")) for x in _ARTICLES]
    out += [(f"n{x}", f"em {y}") for x, y in zip(("um", "uma", "ums", "umas"), _INDEFINITE)]
    out += [("ao", "a o"), ("aos", "a os"), ("à", "a a"), ("às", "a as")]
    return out


# Function words by kind, unaccented.
STOPWORDS = frozenset(
    " ".join(
        (
            "um uma o a os as ao aos num numa do no da na dos nos das nas pelo pela pelos pelas",
            "eu tu ele ela eles elas voce voces vos me te se lhe lhes quem qual que",
            "meu teu seu nosso meus teus seus nossos minha tua sua nossa minhas tuas suas nossas",
            "isto isso aquilo este esse aquele estes esses aqueles esta essa aquela estas essas aquelas",
            "dele dela deles delas de em por para com sem ate entre como quando depois",
            "e ou mas nem nao ja so mais muito mesmo tambem",
            "sou somos sao era eramos eram fui foi fomos foram fora foramos seja sejamos sejam",
            "fosse fossemos fossem for formos forem serei seremos seria seriamos seriam",
            "estou estive esteve estivemos estiveram",
            "estavamos estavam estivera estiveramos esteja estejamos estejam",
            "estivesse estivessemos estivessem estiver estivermos estiverem",
            "hei ha havemos hao houve houvemos houveram houvera houveramos haja hajamos hajam",
            "houvesse houvessemos houvessem houver houvermos houverem",
            "tenho tem temos tinha tinhamos tinham tive teve tivemos tiveram tivera tiveramos",
            "tenha tenhamos tenham tivesse tivessemos tivessem tiver tivermos tiverem",
            "terei tera teremos terao teria teriamos teriam",
        )
    ).split()
)


@lru_cache(1)
def folds() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one ASCII character (as two parallel strings), and those that fold to more."""
    one, to, many = [], [], {}
    for c in range(128, sys.maxunicode + 1):
        if 0xD800 <= c <= 0xDFFF:
            continue
        s = chr(c)
        ascii_ = "".join(x for x in unicodedata.normalize("NFKD", s) if x < "\x80")
        if len(ascii_) == 1:
            one.append(s)
            to.append(ascii_)
        elif ascii_:
            many[s] = ascii_
    return "".join(one), "".join(to), many


def strip_accents(col: Column) -> Column:
    """Compatibility decomposition, then ASCII only.

    One-to-one folds are a translate; the few hundred characters that fold to several
    are looked up character by character, in the rare texts that have one.
    """
    one, to, many = folds()
    lookup = F.create_map(*(F.lit(x) for kv in many.items() for x in kv))

    def fold(t: Column) -> Column:
        spelled = F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(lookup[c], c)), "")
        # A translate looks characters up by hash; a regular expression would try hundreds of them in turn.
        full = F.when(F.translate(t, "".join(many), "") != t, spelled).otherwise(t)
        folded = F.regexp_replace(F.translate(full, one, to), r"[^\x00-\x7F]", "")
        return F.when(t.rlike(r"[^\x00-\x7F]"), folded).otherwise(t)

    # The lambda binds the text, so that what leads to it stands and runs once instead of at each use.
    return F.transform(F.array(col), fold)[0]


def expand_contractions(col: Column) -> Column:
    out = F.concat(F.lit(" "), col, F.lit(" "))
    for short, full in contractions():
        out = F.replace(out, F.lit(f" {short} "), F.lit(f" {full} "))
    return F.btrim(out, F.lit(STRIPPED))


def plain_spaces(col: Column) -> Column:
    """Spaces in place of control characters, real or badly escaped; a carriage return with its newline gives one."""
    escaped = F.when(F.contains(col, F.lit("\\")), F.regexp_replace(col, ESCAPED, " ")).otherwise(col)
    for control in ("\r\n", "\r", "\n", "\t"):
        escaped = F.replace(escaped, F.lit(control), F.lit(" "))
    return escaped


def clean(col: Column, accents: bool = True, contracted: bool = True, punctuation: bool = True) -> Column:
    """Lower-cased text of letters, digits, spaces and ``$ < > - : .``; each step can be left out."""
    out = F.lower(plain_spaces(col))
    if contracted:
        out = expand_contractions(out)
    if accents:
        out = strip_accents(out)
    if accents:  # all ASCII from here on, so the patterns needn't look up Unicode's classes
        if punctuation:
            out = F.regexp_replace(out, r"[^a-z0-9\t-\r\x1c- $<>\-:.]+", "")
        return F.trim(F.regexp_replace(out, LONG_GAP, " "))
    if punctuation:
        out = F.regexp_replace(out, r"(?U)[^a-z0-9\s\x1c-\x1f$<>\-:.]", "")
    return F.trim(F.regexp_replace(out, WHITE, " "))


def tokenize(col: Column) -> Column:
    """Tags in angle brackets, and runs of word characters and hyphens."""
    return F.regexp_extract_all(col, F.lit(rf"(<[^>]+>|[{WORD}\-]+)"), F.lit(1))


def drop_stopwords(tokens: Column, use_default: bool = True, custom: Iterable[str] = ()) -> Column:
    words = sorted((STOPWORDS if use_default else frozenset()) | set(custom))
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(words) | t.startswith("<"))


def prepare(col: Column, use_default: bool = True, custom: Iterable[str] = ()) -> Column:
    """Clean, tokenize, drop stop words, join: the bag of words that is indexed and compared."""
    return F.array_join(drop_stopwords(tokenize(clean(col)), use_default, custom), " ")


def text_key(col: Column) -> Column:
    """SHA-256 of a text as it stands."""
    return F.sha2(col, 256)


_SOUNDS = [("ss", "s"), ("rr", "r"), ("ll", "l"), ("ce", "se"), ("ci", "si"), ("ch", "x"), ("qu", "k"), ("ge", "je"), ("gi", "ji"), ("lh", "l"), ("nh", "n")]


def phonetic(col: Column) -> Column:
    """Approximate Portuguese sound of every word of a text.

    Replacements are written in upper case, so a later one can't touch what an earlier
    one made: this equals replacing all digraphs in a single pass.
    """
    out = F.lower(strip_accents(F.array_join(F.filter(F.split(col, WHITE), lambda w: w != ""), " ")))
    for pair, sound in _SOUNDS:
        out = F.replace(out, F.lit(pair), F.lit(sound.upper()))
    out = F.lower(F.translate(out, "ch", "k"))
    return F.regexp_replace(out, r"m(?= |$)", "n")


def terms(col: Column) -> Column:
    """Words of two characters or more, and pairs of neighbouring ones, as TF-IDF counts them."""

    def counted(words: Column) -> Column:
        last = F.greatest(F.size(words) - 1, F.lit(0))
        return F.concat(words, F.zip_with(F.slice(words, 1, last), F.slice(words, 2, last), lambda a, b: F.concat_ws(" ", a, b)))

    # The lambda binds the words, which would be extracted again at each use otherwise.
    return F.flatten(F.transform(F.array(F.regexp_extract_all(F.lower(col), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))), counted))


def blank_tokens(col: Column) -> Column:
    """Split at white space, nothing empty."""
    return F.filter(F.split(col, WHITE), lambda t: t != "")
