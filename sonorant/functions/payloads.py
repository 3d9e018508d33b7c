"""JSON in and out: answers of judges and requests of readers as cleaned structs, with an error instead of an exception.

Texts are parsed once, as VARIANT; parts that are missing, null or of another kind have a defined reading. Values are taken as
text, cut at both ends; a null is empty; an element of a list that is no object is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonorant import dims
from sonorant.functions.text import let
from sonorant.functions.verdicts import balanced

#: The kinds of fields; any other is `other`.
FIELD_KINDS = ("number", "quantity", "identifier", "amount", "date", "time", "location", "name", "action", "other")


#: Unicode's white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def cut(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def said(v: Column, path: str) -> Column:
    return cut(F.try_variant_get(v, path, "string"))


def listed(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def not_a_list(v: Column, path: str) -> Column:
    """Whether there is a part that is neither a list nor null."""
    return let(F.try_variant_get(v, path, "variant"), lambda part: part.isNotNull() & ~F.is_variant_null(part) & ~F.schema_of_variant(part).startswith("ARRAY"))


def truth(v: Column, path: str, default: bool) -> Column:
    """A part as a truth value: the default where it is missing; null, 0, and empty texts, lists and objects are false."""
    text = F.try_variant_get(v, path, "string")

    def filled(kind: Column) -> Column:
        return F.when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean")).when(kind == "STRING", text != "").when(kind.rlike("^(ARRAY|OBJECT)"), F.length(text) > 2).otherwise(F.try_variant_get(v, path, "double") != 0)

    return let(F.try_variant_get(v, path, "variant"), lambda part: F.when(part.isNull(), F.lit(default)).when(F.is_variant_null(part), F.lit(False)).otherwise(let(F.schema_of_variant(part), filled)))


def unless(error: Column, parts: dict[str, Column]) -> Column:
    """struct(error, the parts), which are null where there is an error; the error is made once."""
    return let(error, lambda e: F.struct(e.alias("error"), *(F.when(e.isNull(), c).alias(k) for k, c in parts.items())))


def parsed(answer: Column) -> Column:
    """The first object of a loose text as VARIANT, or null."""
    return F.try_parse_json(balanced(answer))


def _field(x: Column) -> Column:
    kind = let(F.lower(said(x, "$.type")), lambda k: F.when(k.isin(*FIELD_KINDS), k).otherwise("other"))
    return F.struct(said(x, "$.name").alias("name"), kind.alias("type"), said(x, "$.why").alias("why"))


def requirements(answer: Column) -> Column:
    """struct(error, use_case, objective, summary, user_actions, critical_action, semantic_matters, exact_matters, fields) of what a
    judge says about an agent. Fields without a name and blank actions are dropped. Without an object, or with fields that are no
    list, only `error` is filled."""

    def made(v: Column) -> Column:
        error = F.when(v.isNull(), "no object").when(not_a_list(v, "$.fields"), "fields are no list").when(not_a_list(v, "$.user_actions"), "actions are no list")
        fields = F.filter(F.transform(listed(v, "$.fields"), _field), lambda x: x["name"] != "")
        actions = F.filter(F.transform(listed(v, "$.user_actions"), lambda x: said(x, "$")), lambda x: x != "")
        use = let(said(v, "$.use_case"), lambda u: F.when(u == "", "Unclassified").otherwise(u))
        parts = {
            "use_case": use, "objective": said(v, "$.objective"), "summary": said(v, "$.summary"), "user_actions": actions,
            "critical_action": said(v, "$.critical_action"), "semantic_matters": truth(v, "$.semantic_matters", True), "exact_matters": truth(v, "$.exact_transcription_matters", False), "fields": fields,
        }
        return unless(error, parts)

    return let(parsed(answer), made)


def scenario(answer: Column) -> Column:
    """struct(error, sentence, expected, notes) of a test sentence: `expected` has the (field, value) pairs with a name, in the order
    in which the names first come, each with its last value."""

    def made(v: Column) -> Column:
        error = F.when(v.isNull(), "no object").when(not_a_list(v, "$.values"), "values are no list")
        pairs = F.filter(F.transform(listed(v, "$.values"), lambda x: F.struct(said(x, "$.field").alias("field"), said(x, "$.value").alias("value"))), lambda p: p["field"] != "")
        last = lambda ps, f: F.element_at(F.filter(ps, lambda p: p["field"] == f), -1)
        expected = let(pairs, lambda ps: F.transform(F.array_distinct(F.transform(ps, lambda p: p["field"])), lambda f: last(ps, f)))
        parts = {"sentence": said(v, "$.sentence"), "expected": expected, "notes": said(v, "$.notes")}
        return unless(error, parts)

    return let(parsed(answer), made)


def reading_request(body: Column, threshold: float = -2.0) -> Column:
    """struct(error, level, text, typed, engine, threshold, audio_decides) of a request to score a reading. The body is one object and
    nothing else; a level that is left out is a paragraph, one that is unknown is an error, and so is a threshold that is no number."""

    def made(v: Column) -> Column:
        names = [n.upper() for n in dims.LEVELS]
        asked = said(v, "$.level")
        level = F.when(asked == "", "PARAGRAPH").otherwise(F.upper(asked))
        given, number = F.try_variant_get(v, "$.gop_threshold", "variant"), F.try_variant_get(v, "$.gop_threshold", "double")
        wrong = given.isNotNull() & ~F.is_variant_null(given) & number.isNull()
        error = F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "no object").when(~level.isin(names), F.concat(F.lit("unknown level: "), asked)).when(wrong, "threshold is no number")
        raw = lambda p: F.coalesce(F.try_variant_get(v, p, "string"), F.lit(""))
        parts = {"level": F.lower(level), "text": raw("$.text"), "typed": raw("$.typed"), "engine": raw("$.engine"), "threshold": F.coalesce(number, F.lit(threshold)), "audio_decides": truth(v, "$.audio_decides", True)}
        return unless(error, parts)

    return let(F.try_parse_json(body), made)


def document(value: Column) -> Column:
    """A struct as JSON text, nulls kept, letters as they are."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def divided(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with one) of a column that one of the functions above made."""
    failed = F.col(column)["error"].isNotNull()
    return rows.where(~failed), rows.where(failed)
