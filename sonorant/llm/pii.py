"""Personal data: exact base patterns, and spans that a character tagger adds.

The tagger reads windows of WINDOW characters, each half over the next; each window is decoded by its own Viterbi path, and
a document's window spans are reconciled by the heaviest choice of spans that don't overlap. All kinds hold a digit or an @,
so a window without either has nothing to give and is not decoded."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.llm import tagger
from sonorant.llm.common import read_table, shared_dir
from sonorant.llm.tagger import KINDS, Tagger

WINDOW, BATCH = 128, 256
#: Labelled examples for training, their characters, and training steps.
EXAMPLES, LENGTH, STEPS = 6000, 64, 500
#: To be raised when `labelled` or the training changes.
VERSION = 1

ANCHOR = re.compile(r"[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Possessive runs and a look-behind keep long digit runs linear; the matches are those of the plain patterns.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPAN = "array<struct<kind:string,start:int,stop:int,base:boolean>>"

Span = tuple[int, int, int]  # start, number of the kind, stop


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """All base matches, in order."""
    if not ANCHOR.search(text):
        return []
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, 0, end := m.end()))
        at = text.find("@", max(at + 1, end))
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def plausible(kind: int, text: str) -> bool:
    """What a span of the tagger must show besides its labels."""
    d = digits_of(text)
    if kind == 0:
        return bool(re.search(r"[A-Za-z0-9]\s?@\s?[A-Za-z0-9-]+\s?\.\s?[A-Za-z]{2}", text))
    if kind == 1:
        return len(parts := re.findall(r"[0-9]+", text)) == 4 and all(map(small, parts)) and text.count(".") == 3
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d) and not re.search(r"[A-Za-z]", text)
    return 9 <= len(d) <= 15 and bool(re.search(r"[ ().-]", text)) and not re.search(r"[A-Za-z]|[0-9]{4}-[0-9]{2}-[0-9]{2}", text)


# --- labelled examples


def labelled(n: int, seed: int) -> tuple[list[str], list[list[Span]]]:
    """n texts of LENGTH characters with their spans: invented words of letters from several alphabets around personal data
    in many spellings, and around numbers that are none."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("eeeeettttaaaooiinnsshhrrdlucmfwygpbvkqjxzéèçàüößñóí"))
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    one = lambda *x: x[rng.integers(len(x))]

    def word() -> str:
        w = "".join(rng.choice(letters, rng.integers(2, 10)))
        return w.capitalize() if rng.random() < 0.12 else w

    def ascii_word() -> str:
        return "".join(rng.choice(np.array(list("abcdefghijklmnopqrstuvwxyz")), rng.integers(2, 9)))

    def email() -> str:
        user = one(ascii_word(), f"{ascii_word()}.{ascii_word()}", f"{ascii_word()}{digits(2)}", f"{ascii_word()}.{digits(2)}")
        return f"{user}{one('@', '@', ' @ ')}{one(ascii_word(), f'mail{digits(1)}.{ascii_word()}')}.{one('com', 'org', 'net', 'de', 'fr', 'es', 'io')}"

    def ip() -> str:
        return one(".", ".", "[.]", " . ").join(str(rng.integers(0, 256)) for _ in range(4))

    def card() -> str:
        d = one("4", "5", "37", "6011") + digits(11)
        d = (d + digits(4))[: rng.integers(14, 16)]
        d += next(c for c in "0123456789" if luhn(d + c))
        return one("", " ", "-", ".").join(d[k : k + 4] for k in range(0, len(d), 4))

    def phone() -> str:
        return one(
            lambda: f"+{rng.integers(1, 99)} {digits(3)} {digits(3)} {digits(4)}",
            lambda: f"+{rng.integers(1, 99)}-{digits(3)}-{digits(7)}",
            lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
            lambda: f"{digits(3)}-{digits(3)}-{digits(4)}",
            lambda: f"0{digits(3)} {digits(3)} {digits(4)}",
            lambda: f"00{rng.integers(10, 99)} {digits(3)} {digits(6)}",
        )()

    def other() -> str:
        return one(
            lambda: f"{rng.integers(1, 3000)}",
            lambda: f"{rng.integers(1, 99)}.{digits(2)}",
            lambda: f"{rng.integers(1900, 2100)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}",
            lambda: f"{rng.integers(1, 13)}:{digits(2)}",
            lambda: f"v{rng.integers(1, 9)}.{digits(1)}.{digits(1)}",
            lambda: 'token = "' + "".join(rng.choice(list("0123456789abcdef"), 40)) + '"',
            lambda: "AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOP0123456789"), 16)),
            lambda: f"@{ascii_word()}",
            lambda: digits(rng.integers(5, 25)),
            lambda: one("&&&", "***", "$$$", "%%%", "###", "|"),
            lambda: f"{ascii_word()}-{digits(3)}-{digits(2)}",
        )()

    texts, spans = [], []
    for _ in range(n):
        text, own = "", []
        if rng.random() < 0.3:  # windows begin anywhere in a word
            text = word()[2:]
        while len(text) < LENGTH:
            text += one(" ", " ", " ", " ", ", ", ". ", "\n") if text else ""
            r = rng.random()
            if r < 0.13:
                k = int(rng.integers(4))
                own.append((len(text), k, len(text) + len(x := (email, ip, card, phone)[k]())))
                text += x
            else:
                text += other() if r < 0.3 else word()
        texts.append(text[:LENGTH])
        spans.append([(a, k, min(b, LENGTH)) for a, k, b in own if a < LENGTH])
    return texts, spans


def tags_of(spans: list[Span], n: int) -> np.ndarray:
    tags = np.zeros(n, np.int8)
    for a, k, b in spans:
        tags[a:b] = 2 * k + 2
        tags[a] = 2 * k + 1
    return tags


@lru_cache(maxsize=2)
def trained(examples: int = EXAMPLES, steps: int = STEPS) -> Tagger:
    texts, spans = labelled(examples, 1)
    return tagger.train(np.stack([tagger.encode(t) for t in texts]), np.stack([tags_of(s, LENGTH) for s in spans]), steps)


def stored(spark: SparkSession) -> Tagger:
    """The trained tagger. Its weights are kept in the shared folder under a hash of what shapes them, so sessions that share
    the folder train once."""
    setup = repr((VERSION, EXAMPLES, LENGTH, STEPS, tagger.HIDDEN, tagger.EMBED, tagger.SEED, KINDS))
    path = f"{shared_dir(spark)}/tagger-{hashlib.sha256(setup.encode()).hexdigest()[:16]}"
    try:
        rows = spark.read.parquet(path).collect()
    except AnalysisException as e:  # none yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    if rows:
        return Tagger({r.name: np.frombuffer(bytes(r.cells), np.float32).reshape(r["shape"]) for r in rows})
    model = trained()
    kept = [(k, list(v.shape), v.astype(np.float32).tobytes()) for k, v in model.w.items()]
    spark.createDataFrame(kept, "name string, shape array<int>, cells binary").coalesce(1).write.mode("ignore").parquet(path)
    return model


# --- windows


def window_spans(tags: np.ndarray, margin: np.ndarray, first: int, last: int) -> Iterator[tuple[int, int, int, float]]:
    """(start, kind, stop, weight) of a window's tagged spans, places counted in the window; first and last: whether it begins
    and ends the text. Spans that an inner edge may cut count for a tenth."""
    k, n = 0, len(tags)
    while k < n:
        if tags[k] % 2 == 1:
            kind, start = int(tags[k]) // 2, k
            k += 1
            while k < n and tags[k] == 2 * kind + 2:
                k += 1
            cut = start == 0 and not first or k == n and not last
            yield start, kind, k, float(margin[start:k].sum()) * (0.1 if cut else 1)
        else:
            k += 1


def reconcile(found: dict[Span, float]) -> list[Span]:
    """The spans without overlap that weigh most together: one pass in the order of their ends, with a bisection for each."""
    spans = sorted((s for s in found if found[s] > 0), key=lambda s: (s[2], s))
    ends: list[int] = []
    best: list[tuple[float, bool, int]] = [(0.0, False, 0)]  # weight; whether the last span is chosen; how many come before it
    for s in spans:
        j = bisect_right(ends, s[0])
        with_it = best[j][0] + found[s]
        best.append((with_it, True, j) if with_it > best[-1][0] else (best[-1][0], False, len(ends)))
        ends.append(s[2])
    out, k = [], len(spans)
    while k:
        _, chosen, before = best[k]
        if chosen:
            out.append(spans[k - 1])
        k = before
    return out[::-1]


def tagged_spans(texts: list[str], model: Tagger) -> list[dict[Span, float]]:
    """The tagger's spans of each text with their weights, summed over its windows."""
    where: list[tuple[int, int]] = []
    for i, text in enumerate(texts):
        half = WINDOW // 2
        last = max(0, -(-len(text) // half) - 2)
        starts = sorted({max(0, min(k, last)) for m in ANCHOR.finditer(text) for k in (m.start() // half - 1, m.start() // half)})
        where += [(i, k * half) for k in starts]
    found: list[dict[Span, float]] = [defaultdict(float) for _ in texts]
    for b in range(0, len(where), BATCH):
        part = where[b : b + BATCH]
        classes = np.zeros((len(part), WINDOW), np.int16)
        for r, (i, at) in enumerate(part):
            x = tagger.encode(texts[i][at : at + WINDOW])
            classes[r, : len(x)] = x
        tags, margin = model.decode(classes)
        for r in np.flatnonzero(tags.any(1)):
            i, at = part[r]
            for start, kind, stop, weight in window_spans(tags[r], margin[r], at == 0, at + WINDOW >= len(texts[i])):
                found[i][at + start, kind, at + stop] += weight
    return found


def free_of(base: list[Span]) -> Callable[[int, int], bool]:
    """Whether a span touches none of the base spans, which are sorted by start."""
    merged: list[list[int]] = []
    for a, _, b in base:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return not k or merged[k - 1][1] <= a

    return free


def added(text: str, found: dict[Span, float], base: list[Span]) -> list[Span]:
    """The tagger's spans that count beside the base ones. Marks at their ends are cut off, and what is implausible or touches a
    base span is gone before spans are reconciled, so that it can't displace a good one."""
    free, good = free_of(base), defaultdict(float)
    for (a, k, b), weight in found.items():
        while a < b and text[a] in " \n\t,;:":
            a += 1
        while b > a and text[b - 1] in " \n\t,;:.":
            b -= 1
        if a < b and free(a, b) and plausible(k, text[a:b]):
            good[a, k, b] += weight
    return reconcile(good)


def find_all(texts: list[str | None], model: Tagger) -> list[list[dict]]:
    """For each text, its base spans and the tagger's plausible ones that touch no base span; by start, then kind."""
    texts = [t or "" for t in texts]
    some = [i for i, t in enumerate(texts) if ANCHOR.search(t)]
    out: list[list[dict]] = [[] for _ in texts]
    for i, found in zip(some, tagged_spans([texts[i] for i in some], model), strict=True):
        base = base_spans(texts[i])
        more = added(texts[i], found, base)
        out[i] = [{"kind": KINDS[k], "start": a, "stop": b, "base": is_base} for a, k, b, is_base in sorted([(*s, True) for s in base] + [(*s, False) for s in more])]
    return out


def finder(model: Tagger) -> Callable:
    weights = model.w

    @F.pandas_udf(SPAN)
    def find(text: pd.Series) -> pd.Series:
        return pd.Series(find_all(list(text), Tagger(weights)))

    return find


def find(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """docs (any columns) with the column pii, an array of struct(kind, start, stop, base): code points, stop exclusive.

    Null and empty texts have none; repeated rows are searched each; an empty table gives an empty table; an input column
    pii is replaced."""
    return docs.withColumn("pii", finder(model or stored(docs.sparkSession))(F.col("text")))


def masked(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """docs with [KIND] in place of personal data in `text`; overlapping spans become one mask. Null stays null."""
    weights = (model or stored(docs.sparkSession)).w

    @F.pandas_udf("string")
    def mask(text: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(text, find_all(list(text), Tagger(weights)), strict=True):
            parts, at = [], 0
            for s in spans:
                if s["start"] >= at:
                    parts += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
                at = max(at, s["stop"])
            out.append(t if not spans else "".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", mask(F.col("text")))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])
    count = lambda kind: F.size(F.filter("pii", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    listed = F.array_join(F.transform(F.filter("pii", lambda x: x["base"]), text), ",")
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(listed, 256).alias("base_sha256"), F.array_join(F.transform("pii", text), ",").alias("spans"))
