"""Text of judges and providers: objects in loose text, language codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonorant.functions.text import let


def _object_pattern(depth: int) -> str:
    """An object of at most `depth` levels, anchored; outside of strings too a backslash goes with the character after it. All
    repeats are possessive, so a text is read once and without recursion."""
    out = ""
    for _ in range(depth):
        out = r'\{(?:[^"{}\\]++|\\.|"(?:[^"\\]++|\\.)*+"' + (f"|{out}" if out else "") + r")*+\}"
    return f"(?s)^{out}"


SHALLOW = _object_pattern(6)


def balanced_end(tail: Column) -> Column:
    """Where the braces of a text that begins with one balance, those in strings left out; 0 where they don't. One fold over
    tokens, so the work is linear."""
    tokens = F.regexp_extract_all(tail, F.lit(r'((?s)\\.|["{}\\]|[^"{}\\]+)'))

    def step(s: Column, t: Column) -> Column:
        quoted = s["quoted"]
        depth = F.when(quoted, s["depth"]).when(t == "{", s["depth"] + 1).when(t == "}", s["depth"] - 1).otherwise(s["depth"])
        at = s["at"] + F.length(t)
        end = F.when((s["end"] == 0) & ~quoted & (t == "}") & (depth == 0), at).otherwise(s["end"])
        return F.struct(depth.alias("depth"), at.alias("at"), end.alias("end"), F.when(t == '"', ~quoted).otherwise(quoted).alias("quoted"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit(False).alias("quoted"))
    return F.aggregate(tokens, start, step)["end"]


def balanced(text: Column) -> Column:
    """The first object in an answer whose braces balance, or null; a code fence around it does no harm. One expression finds an
    object of few levels, and only a text without one is folded."""

    def folded(tail: Column) -> Column:
        return let(balanced_end(tail), lambda end: F.when(end > 0, F.substring(tail, F.lit(1), end)))

    found = lambda tail: let(F.regexp_extract(tail, SHALLOW, 0), lambda o: F.when(o != "", o).when(F.instr(tail, "}") > 0, folded(tail)))
    return let(F.regexp_extract(text, r"(?s)\{.*", 0), found)


def json_object(text: Column) -> Column:
    """The JSON text of `balanced`, or null where it does not parse."""
    return let(balanced(text), lambda o: F.when(F.try_parse_json(o).isNotNull(), o))


def language_code(language: Column, overrides: dict[str, str]) -> Column:
    """The provider's own code of a language where it has one, else the code itself."""
    return reduce(lambda out, kv: F.when(language == kv[0], kv[1]).otherwise(out), overrides.items(), language)


def bare_code(code: Column) -> Column:
    return F.split_part(code, F.lit("-"), F.lit(1))


def letter_text(tokens: Column) -> Column:
    """Whether a text is one of letters: it has tokens, each of one character."""
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.length(t) == 1)
