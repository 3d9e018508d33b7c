"""Metrics that follow from a judge's verdicts. The verdicts are a table; no call is made here.

Each function gives the fields of a metric: value, errors, length, reasoning."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sonorant.functions import batched
from sonorant.functions.text import TOKENS, error_rate


def metric(value: Column, errors: Column | None = None, length: Column | None = None, reasoning: Column | None = None, error: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        value.cast("double").alias("value"), (errors if errors is not None else none).cast("double").alias("errors"), (length if length is not None else none).cast("double").alias("length"),
        (reasoning if reasoning is not None else none).cast("string").alias("reasoning"), (error if error is not None else none).cast("string").alias("error"),
    )


def intent_entity(verdict: Column) -> Column:
    """verdict: struct(score, entities_total, entities_preserved, reasoning). The score within 0 and 1; counts come first in
    the reasoning where there are entities."""
    total, kept = verdict["entities_total"], verdict["entities_preserved"]
    why = F.trim(F.coalesce(verdict["reasoning"], F.lit("")))
    counted = F.when((total > 0) & kept.isNotNull(), F.concat(kept.cast("string"), F.lit("/"), total.cast("string"), F.lit(" key entities preserved. "), why)).otherwise(why)
    return metric(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(verdict["score"], F.lit(0.0)))), reasoning=counted)


def semantic_wer(verdict: Column, word_length: Column) -> Column:
    """verdict: struct(reference_words, semantic_errors, reasoning); without a word count the reference's own stands."""
    length = F.coalesce(F.nullif(verdict["reference_words"], F.lit(0)), word_length)
    errors = F.greatest(F.lit(0), F.coalesce(verdict["semantic_errors"], F.lit(0)))
    return metric(error_rate(errors, length), errors, length, F.trim(F.coalesce(verdict["reasoning"], F.lit(""))))


def semantic_match(same: Column, reasoning: Column) -> Column:
    return metric(F.when(same, 1.0).otherwise(0.0), reasoning=reasoning)


def judged(rows: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """rows (key, any others) with `told`, the numbers of their segments that verdicts (key, segment, equivalent) call equivalent."""
    told = verdicts.where("equivalent").groupBy(key).agg(F.collect_set(F.col("segment").cast("long")).alias("told"))
    return rows.join(told, key, "left")


def rescored(judged_pairs: DataFrame, key: str) -> DataFrame:
    """judged_pairs (key, r, h, told) -> key, forgiven, segments, llm_wer, llm_cer, as `forgiven_wer`."""
    counts = ("forgiven", "segments", "words", "letters", "n", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, h, told = (batch.column(c) for c in ("r", "h", "told"))
            held = sum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype("int64") for c in (r, h)).cumsum() // TOKENS
            cuts = [0, *(k for k in range(1, len(held)) if held[k] != held[k - 1]), len(held)] if len(held) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                found, none = batched.rescored(r[a:b], h[a:b], told[a:b]), pc.is_null(r[a:b]).to_numpy(zero_copy_only=False)
                # Without a reference there is nothing to score.
                yield pa.RecordBatch.from_arrays([batch.column(key)[a:b], *(pa.array(found[c], pa.int64(), mask=none if k > 1 else None) for k, c in enumerate(counts))], names=[key, *counts])

    pairs = judged_pairs.select(key, "r", "h", "told")
    a = pairs.mapInArrow(run, StructType([pairs.schema[key], *StructType.fromDDL(", ".join(f"{c} long" for c in counts))]))
    words, letters, n, m = (F.col(c) for c in ("words", "letters", "n", "m"))
    return a.select(key, "forgiven", "segments", metric(error_rate(words, n), words, n).alias("llm_wer"), metric(error_rate(letters, m), letters, m).alias("llm_cer"))


def forgiven_wer(pairs: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """pairs (key, r, h), verdicts (key, segment, equivalent) -> key, forgiven, segments, llm_wer, llm_cer.

    Differing segments are numbered from 0; those judged equivalent are replaced by the reference, those without a verdict are
    errors, and what results is scored again. Pairs without a difference need no verdict. Where the tokens are made from smaller
    rows, `judged` may come before that, so that the join moves less."""
    return rescored(judged(pairs, verdicts, key), key)


def critical_fields(fields: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """fields (keys, name, type), verdicts (keys, name, preserved, heard_as, reason) -> keys, critical_fields and `fields`, a
    map by name. A field without a verdict is lost: the judge has not reported it. The value is the share preserved, errors
    are the fields lost, so that pooling gives the share lost."""
    j = fields.join(verdicts, [*keys, "name"], "left")
    kept = F.coalesce("preserved", F.lit(False))
    row = F.struct(kept.alias("preserved"), F.coalesce("heard_as", F.lit("")).alias("heard_as"), F.coalesce("reason", F.lit("not reported by the judge")).alias("reason"), "type")
    g = j.groupBy(*keys).agg(F.count_if(kept).alias("k"), F.count("*").alias("n"), F.map_from_entries(F.collect_list(F.struct("name", row.alias("f")))).alias("fields"))
    return g.select(*keys, metric(F.col("k") / F.col("n"), F.col("n") - F.col("k"), F.col("n")).alias("critical_fields"), "fields")


def without_judge(metrics: list[str]) -> Column:
    """What asked-for judge metrics hold where there is no judge."""
    none = metric(F.lit(None), error=F.lit("No judge configured."))
    return F.create_map(*(x for m in metrics for x in (F.lit(m), none)))
