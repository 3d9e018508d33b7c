"""Normalisation of Hindi and Marathi readings, rule by rule.

Canonical form and romanised words need Python (one Arrow UDF for both); every other rule is a column expression. Each rule
has an id, so a trace can say which of them changed a text."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VIRAMA, NUKTA, ANUSVARA, CHANDRABINDU = "्", "़", "ं", "ँ"

#: Characters without a sound, and the stops of each class nasal.
INVISIBLE = "\u200d\u200c\u200b\u2060\ufeff\u00ad"
NASAL_CLASSES = {"ङ": "कखगघ", "ञ": "चछजझ", "ण": "टठडढ", "न": "तथदध", "म": "पफबभ"}

#: Romanised consonants, and vowels as (letter, sign).
CONSONANTS = {
    "chh": "छ", "ksh": "क्ष", "kh": "ख", "gh": "घ", "ch": "च", "jh": "झ", "th": "थ", "dh": "ध", "ph": "फ", "bh": "भ", "sh": "श",
    "k": "क", "g": "ग", "c": "क", "j": "ज", "t": "त", "d": "द", "n": "न", "p": "प", "b": "ब", "m": "म", "y": "य", "r": "र", "l": "ल",
    "v": "व", "w": "व", "s": "स", "h": "ह", "f": "फ", "z": "ज", "q": "क", "x": "क्स",
}
VOWELS = {
    "aa": ("आ", "ा"), "ai": ("ऐ", "ै"), "au": ("औ", "ौ"), "ee": ("ई", "ी"), "ii": ("ई", "ी"), "oo": ("ऊ", "ू"), "uu": ("ऊ", "ू"),
    "a": ("अ", ""), "i": ("इ", "ि"), "u": ("उ", "ु"), "e": ("ए", "े"), "o": ("ओ", "ो"),
}

#: Hindi spellings of one word, words whose chandrabindu tells them from another, hesitation sounds.
SPELLINGS = {
    "गयी": "गई", "गये": "गए", "नयी": "नई", "आये": "आए", "लिये": "लिए", "दिये": "दिए", "किये": "किए", "हुये": "हुए",
    "चाहिये": "चाहिए", "जायेगा": "जाएगा", "जायेगी": "जाएगी",
}
PROTECTED = ("हँस", "हँसी", "हँसना")
FILLERS = {"hi": ("अ", "अं", "आं", "उम", "उम्म", "हम्म", "हं", "एं", "ऊं"), "mr": ("अ", "अं", "आं", "उम", "उम्म", "हम्म", "हं", "एं")}

TOKEN = re.compile("|".join(sorted([*CONSONANTS, *VOWELS], key=len, reverse=True)))
LATIN = re.compile("[A-Za-z]+")
ALIASES = {"hi": "hi", "hi-in": "hi", "hindi": "hi", "mr": "mr", "mr-in": "mr", "marathi": "mr"}


def profile(code: str) -> str:
    """The rulebook of a language code, locale or name."""
    if code.lower() not in ALIASES:
        raise ValueError(f"no rulebook for {code!r}")
    return ALIASES[code.lower()]


def from_latin(word: str) -> str:
    """A romanised word in Devanagari: a consonant carries the vowel after it, a doubled one is joined by a virama, and an `a`
    that ends a word of more than its own syllable is long."""
    tokens = TOKEN.findall(word.lower())
    out: list[str] = []
    carrier = False
    for k, t in enumerate(tokens):
        if t in CONSONANTS:
            doubled = carrier == "single" and CONSONANTS[t] == CONSONANTS[tokens[k - 1]]
            out += [VIRAMA, CONSONANTS[t]] if doubled else [CONSONANTS[t]]
            carrier = "double" if doubled else "single"
        else:
            letter, sign = VOWELS[t]
            final = t == "a" and k == len(tokens) - 1 and len(out) > 1
            out.append(("ा" if final else sign) if carrier else letter)
            carrier = False
    return "".join(out)


def canonical(text: str | None) -> str | None:
    if text is None:
        return None
    return LATIN.sub(lambda m: from_latin(m[0]), unicodedata.normalize("NFC", text))


def _canonical_column(text: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(canonical)

    return F.pandas_udf(run, "string")(text)


def romanised(text: Column) -> Column:
    """The words that `canonical` makes of Latin ones, as they stand in its result."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: sorted({from_latin(w) for w in LATIN.findall(t or "")} - {""}))

    return F.pandas_udf(run, "array<string>")(text)


def per_word(text: Column, rule) -> Column:
    return F.array_join(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), rule), " ")


def digits(text: Column) -> Column:
    return F.translate(text, "०१२३४५६७८९", "0123456789")


def stripped(text: Column) -> Column:
    """Without invisible characters; what is neither of the script nor a digit parts words."""
    seen = F.translate(text, INVISIBLE, "")
    return F.trim(F.regexp_replace(F.regexp_replace(seen, r"[^ऀ-ॣ०-९ॱ-ॿ\p{Nd}\p{No}]", " "), " +", " "))


def nukta(text: Column, lang: str) -> Column:
    """The dot is silent: dropped, in Hindi except where it makes a native sound."""
    return F.regexp_replace(text, f"(?<![डढ]){NUKTA}" if lang == "hi" else NUKTA, "")


def nasal_mark(text: Column, lang: str) -> Column:
    one = lambda w: F.replace(w, F.lit(CHANDRABINDU), F.lit(ANUSVARA))
    kept = [unicodedata.normalize("NFC", w) for w in PROTECTED]
    return per_word(text, lambda w: F.when(w.isin(kept), w).otherwise(one(w))) if lang == "hi" else one(text)


def class_nasal(text: Column) -> Column:
    """A nasal joined to a stop of its own class is the mark."""
    for letter, stops in NASAL_CLASSES.items():
        text = F.regexp_replace(text, f"{letter}{VIRAMA}(?=[{stops}])", ANUSVARA)
    return text


def one_code(text: Column) -> Column:
    return F.translate(text, "ॲऱ", "ऍर")


def spelling(text: Column) -> Column:
    table = F.create_map(*(F.lit(unicodedata.normalize("NFC", x)) for kv in SPELLINGS.items() for x in kv))
    return per_word(text, lambda w: F.coalesce(F.try_element_at(table, w), w))


def rules(lang: str) -> list[tuple[str, object]]:
    """(id, column -> column) in order."""
    name = profile(lang).upper()
    out = [
        (f"{name}-01", _canonical_column),
        (f"{name}-03", digits),
        (f"{name}-04", stripped),
        (f"{name}-05", lambda c: nukta(c, name.lower())),
        (f"{name}-06", lambda c: nasal_mark(c, name.lower())),
        (f"{name}-08", class_nasal),
        (f"{name}-09", one_code),
    ]
    return [*out, (f"{name}-10", spelling)] if name == "HI" else out


def normalize(text: Column, lang: str) -> Column:
    """The text after all rules; null is empty. Rule 02, romanised words, runs with rule 01."""
    out = F.coalesce(text, F.lit(""))
    for _, rule in rules(lang):
        out = rule(out)
    return out
