"""Text normalisation, tokens and edit counts as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from sonorant.functions import batched


def let(x: Column, body) -> Column:
    """body of x, with x evaluated once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """Unicode compatibility form. Spark has no such function: an Arrow UDF, only for texts that hold more than ASCII."""
    return F.pandas_udf(_nfkc, "string")(text)


def normalize(text: Column, compatibility: bool = False) -> Column:
    """Lower-case, with what is neither a letter, number, underscore, white space nor apostrophe as a space, white space
    collapsed and trimmed; null is empty. Combining marks count as neither, so vowel signs of Indic scripts fall away."""
    text = F.coalesce(text, F.lit(""))
    text = nfkc(text) if compatibility else text
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s']", " ")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def characters(normalized: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(normalized, r"(?U)\s", ""), ""), lambda x: x != "")


#: Tokens of the pairs whose distances are found together.
TOKENS = 250_000


def _distances(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    size = pc.list_value_length if pa.types.is_list(ref.type) else pc.utf8_length
    held = sum(pc.fill_null(size(c), 0).to_numpy(zero_copy_only=False).astype("int64") for c in (ref, hyp)).cumsum() // TOKENS
    cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(held)]
    counts = [batched.distances(ref[a:b], hyp[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.array(np.concatenate(counts), mask=~(pc.is_valid(ref).to_numpy(zero_copy_only=False) & pc.is_valid(hyp).to_numpy(zero_copy_only=False)))


def edit_count(ref: Column, hyp: Column) -> Column:
    """The least number of substitutions, deletions and insertions between token arrays or strings, of any length and with any
    number of distinct tokens."""
    return F.arrow_udf(_distances, "long")(ref, hyp)


def error_rate(errors: Column, length: Column) -> Column:
    """errors / length; over an empty reference 0 without errors, else 1."""
    return F.when(length > 0, errors / length).otherwise(F.when(errors > 0, 1.0).otherwise(0.0))


def english_list(items: Column) -> Column:
    """`a, b and c`; nothing for an empty list."""
    n = F.size(items)
    return F.when(n == 0, "nothing").when(n == 1, F.get(items, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(items, -1)))


def masked(secret: Column) -> Column:
    return F.when(F.length(secret) <= 8, "…").otherwise(F.concat(F.substring(secret, 1, 5), F.lit("…"), F.substring(secret, -4, 4)))
