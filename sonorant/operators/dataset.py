"""Dataset checks: uploads against a truth table, language support, language mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validated(uploads: DataFrame, truth: DataFrame) -> DataFrame:
    """uploads (id, ordinal), truth (id, ordinal, text) -> a row for each id with its status.

    The first upload of an id counts; of the truth rows the first with text. Status: ok, duplicate_upload, no_transcript or
    no_audio."""
    u = uploads.groupBy("id").agg(F.count("*").alias("uploads"))
    t = truth.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("id").agg(F.min_by("text", "ordinal").alias("text"))
    both = u.join(t, "id", "full_outer")
    status = F.when(F.col("text").isNull(), "no_transcript").when(F.col("uploads").isNull(), "no_audio").when(F.col("uploads") > 1, "duplicate_upload").otherwise("ok")
    return both.select("id", status.alias("status"))


def accepted_rows(truth: DataFrame) -> DataFrame:
    """truth (id, ordinal, text) with reason: null for accepted rows, else empty_id, empty_text or duplicate_id. A row of empty
    text takes no id, so a later row of the same id can still be accepted."""
    good = (F.col("id") != "") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    first = F.min(F.when(good, F.col("ordinal"))).over(Window.partitionBy("id"))
    reason = F.when(F.coalesce("id", F.lit("")) == "", "empty_id").when(~good, F.when(F.col("ordinal") > first, "duplicate_id").otherwise("empty_text")).when(F.col("ordinal") > first, "duplicate_id")
    return truth.withColumn("reason", reason)


def supporting_all(support: DataFrame, in_use: DataFrame) -> DataFrame:
    """support (provider, language), in_use (language), a dimension -> providers that support every language in use."""
    used = in_use.select("language").distinct()
    have = support.join(F.broadcast(used), "language", "left_semi").groupBy("provider").agg(F.count_distinct("language").alias("n"))
    return have.join(F.broadcast(used.agg(F.count("*").alias("n"))), "n", "left_semi").select("provider")


def supported(asked: DataFrame, support: DataFrame) -> DataFrame:
    """asked (provider, language), support (provider, languages: an array) -> asked with `supported`: a provider without any
    language takes all, one that is not known takes none."""
    known = asked.join(support, "provider", "left")
    takes = (F.size("languages") == 0) | F.array_contains("languages", F.col("language"))
    return known.withColumn("supported", F.coalesce(takes, F.lit(False))).drop("languages")


def preferred(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """rows, a dimension of distinct names, with `place`: the names of the order first, the others after them by name."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    place = F.row_number().over(Window.orderBy(F.when(at == 0, len(order) + 1).otherwise(at), column))
    return rows.withColumn("place", place.cast("long"))


def language_mix(clips: DataFrame) -> DataFrame:
    """clips (lang, size) -> n and size of each language, and the share of all clips."""
    by = clips.groupBy("lang").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def overview(clips: DataFrame, by: str, run_language: str, named: int = 5) -> DataFrame:
    """clips (by, clip_id, language: an override or null, duration_seconds, upsampled, error: or null) -> of each dataset its
    clips and minutes, the languages it is transcribed in, whether it has more than one override, how many clips are shorter than
    0.2 s, its first upsampled clips by name, with the number of more, and whether it can run: it has clips and no errors."""
    override = F.when(F.col("language") != "", F.col("language"))
    out = clips.groupBy(by).agg(
        F.count_if(F.col("error").isNull()).alias("clips"),
        (F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("duration_seconds"))), F.lit(0.0)) / 60).alias("minutes"),
        F.count_distinct(F.coalesce(override, F.lit(run_language))).alias("languages"),
        (F.count_distinct(override) > 1).alias("multilingual"),
        F.count_if(F.col("duration_seconds") < 0.2).alias("too_short"),
        F.count_if("upsampled").alias("n_upsampled"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    # The rank's filter keeps `named` rows for each task before the shuffle.
    first = clips.where("upsampled").select(by, "clip_id", F.row_number().over(Window.partitionBy(by).orderBy("clip_id")).alias("n")).where(F.col("n") <= named)
    names = first.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.col("clip_id").cast("string"))), ", ").alias("names"))
    more = F.when(F.col("n_upsampled") > named, F.concat(F.lit(" and "), (F.col("n_upsampled") - named).cast("string"), F.lit(" more"))).otherwise("")
    runs = (F.col("clips") > 0) & (F.col("errors") == 0)
    return out.join(names, by, "left").select(by, "clips", "minutes", "languages", "multilingual", "too_short", F.concat("names", more).alias("upsampled"), runs.alias("runnable"))
