"""Frames of log-probabilities: greedy decoding, blank detection, forced alignment and pronunciation scores.

Emissions have utt_id and log_probs, an array (frames) of arrays (tokens)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frames(flat: Column, tokens: int) -> Column:
    """A row-major array as frames of `tokens` values."""
    n = F.floor(F.size(flat) / tokens).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(flat, k * tokens + 1, tokens))


def best_tokens(log_probs: Column) -> Column:
    """Each frame's first best token."""
    return F.transform(log_probs, lambda f: (F.array_position(f, F.array_max(f)) - 1).cast("int"))


def collapsed(ids: Column, blank: int) -> Column:
    """Repeats once, blanks dropped."""
    changed = F.filter(ids, lambda x, k: (k == 0) | (x != F.get(ids, k - 1)))
    return F.filter(changed, lambda x: x != blank)


def most_frequent(emissions: DataFrame, column: str = "ids") -> DataFrame:
    """The token that is best in most frames of all utterances, ties to the smaller: what a model uses as its blank."""
    counts = emissions.select(F.explode(column).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("token", F.struct("n", -F.col("token"))).alias("blank"))


def best_states(log_probs: np.ndarray, targets: np.ndarray, blank: int) -> np.ndarray:
    """The best CTC path of each utterance of equal shape: (n, frames, tokens) and (n, places) -> states (n, frames). State 2k + 1
    is the k-th target, even states are blanks; a path that could end on the last blank or the last target at the same score
    ends on the blank."""
    n, t, _ = log_probs.shape
    labels = np.full((n, 2 * targets.shape[1] + 1), blank)
    labels[:, 1::2] = targets
    emitted = np.take_along_axis(log_probs, np.broadcast_to(labels[:, None, :], (n, t, labels.shape[1])), 2)
    # What a step from one or two states before costs beyond its score: nothing, or no such step. Both are by the state reached.
    steps = np.zeros((3, *labels.shape))
    steps[1, :, 0] = steps[2, :, :2] = -np.inf
    steps[2, :, 2:][labels[:, 2:] == labels[:, :-2]] = -np.inf
    before = lambda row: np.stack([row, np.roll(row, 1, 1), np.roll(row, 2, 1)]) + steps
    scores = np.full((t, *labels.shape), -np.inf)
    scores[0, :, :2] = emitted[:, 0, :2]
    for k in range(1, t):
        scores[k] = before(scores[k - 1]).max(0) + emitted[:, k]
    rows, states = np.arange(n), np.empty((n, t), np.int64)
    states[:, -1] = labels.shape[1] - 1 - scores[-1, :, ::-1][:, :2].argmax(1)
    for k in range(t - 1, 0, -1):  # the scores tell which step was best; none of them needs to be kept
        states[:, k - 1] = states[:, k] - before(scores[k - 1])[:, rows, states[:, k]].argmax(0)
    return states


def spans_of(states: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) frames (n, places) of each target."""
    own = states[:, :, None] == 2 * np.arange(places) + 1
    return own.argmax(1), states.shape[1] - 1 - own[:, ::-1].argmax(1)


def scores_of(log_probs: np.ndarray, targets: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean log-posterior, log-likelihood ratio, token heard), each (n, places): the ratio is the best frame's own value less the
    best other token's; the target is heard where it is above 0, else that frame's rival. Two best tokens of each frame suffice:
    a target's rival is the best of all, or the second where the target is the best."""
    n, t, _ = log_probs.shape
    padded = np.concatenate([log_probs, np.full((n, t, 1), -np.inf)], 2)
    two = np.argsort(-padded, 2, kind="stable")[:, :, :2]
    rival = np.where(two[:, None, :, 0] == targets[:, :, None], two[:, None, :, 1], two[:, None, :, 0])
    values = padded.transpose(0, 2, 1)
    own = np.take_along_axis(values, targets[:, :, None], 1)
    other = np.take_along_axis(padded[:, None], rival[..., None], 3)[..., 0]
    frame = np.arange(t)
    inside = (frame >= first[:, :, None]) & (frame <= last[:, :, None])
    gap = np.where(inside, own - other, -np.inf)
    at = gap.argmax(2)[:, :, None]
    ratio = np.take_along_axis(gap, at, 2)[..., 0]
    heard = np.where(ratio > 0, targets, np.take_along_axis(rival, at, 2)[..., 0])
    return np.where(inside, own, 0).sum(2) / inside.sum(2), ratio, heard


def align(emissions: DataFrame, blank: int = 0) -> DataFrame:
    """emissions (utt_id, log_probs, targets) -> a row for each target: place, token, first, last, gop, llr, heard; utterances
    without targets or too short for them give none. Utterances of a batch that have equal shapes are aligned together."""
    schema = "array<struct<place:int,token:int,first:int,last:int,gop:double,llr:double,heard:int>>"
    names = ("place", "token", "first", "last", "gop", "llr", "heard")

    @F.pandas_udf(schema)
    def run(log_probs: pd.Series, targets: pd.Series) -> pd.Series:
        out: list[list[dict]] = [[] for _ in log_probs]
        alike: dict[tuple[int, int], list[int]] = {}
        for k, (lp, tg) in enumerate(zip(log_probs, targets, strict=True)):
            tg = np.asarray(tg)
            if 0 < len(tg) and len(tg) + int((tg[1:] == tg[:-1]).sum()) <= len(lp):
                alike.setdefault((len(lp), len(tg)), []).append(k)
        for (_, n), members in alike.items():
            x = np.stack([np.stack(log_probs.iloc[k]) for k in members]).astype(float)
            t = np.stack([np.asarray(targets.iloc[k], np.int64) for k in members])
            first, last = spans_of(best_states(x, t, blank), n)
            columns = [c.tolist() for c in (t, first, last, *scores_of(x, t, first, last))]
            for row, k in enumerate(members):
                out[k] = [dict(zip(names, (place, *(c[row][place] for c in columns)), strict=True)) for place in range(n)]
        return pd.Series(out)

    return emissions.select("utt_id", F.explode(run("log_probs", "targets")).alias("t")).select("utt_id", "t.*")


def path_scores(log_probs: Column, forms: Column, blank: int = 0) -> Column:
    """The score of the best path that emits each form, an array of tokens; null for a null or empty form and one that is too
    long for the frames. Forms of equal shape of a batch are scored together."""

    @F.pandas_udf("array<double>")
    def run(log_probs: pd.Series, forms: pd.Series) -> pd.Series:
        out, alike = [[None] * len(own) for own in forms], {}
        for k, (frames_, own) in enumerate(zip(log_probs, forms, strict=True)):
            for place, form in enumerate(own):
                form = np.asarray([] if form is None else form, np.int64)
                if 0 < len(form) and len(form) + int((form[1:] == form[:-1]).sum()) <= len(frames_):
                    alike.setdefault((len(frames_), len(form)), []).append((k, place))
        for members in alike.values():
            x = np.stack([np.stack(log_probs.iloc[k]) for k, _ in members]).astype(float)
            targets = np.stack([np.asarray(forms.iloc[k][place], np.int64) for k, place in members])
            states = best_states(x, targets, blank)
            padded = np.concatenate([targets, np.full((len(members), 1), blank)], 1)
            tokens = np.where(states % 2 == 1, np.take_along_axis(padded, states // 2, 1), blank)
            total = np.take_along_axis(x, tokens[:, :, None], 2).sum((1, 2))
            for (k, place), score in zip(members, total.tolist(), strict=True):
                out[k][place] = score
        return pd.Series(out)

    return run(log_probs, forms)


def closed_set(emissions: DataFrame, blank: int = 0) -> DataFrame:
    """emissions with log_probs, expected and candidates, an array of struct(name, form: tokens, null if the model has not all of
    them), the expected one's first -> the other columns, expected, best, margin. A name with several forms counts by its best
    one. Ties go to the earlier candidate; the margin is infinite without a rival; best and margin are null where the expected
    name has no score."""
    scored = F.arrays_zip(F.col("candidates.name").alias("name"), path_scores(F.col("log_probs"), F.col("candidates.form"), blank).alias("score"))
    e = emissions.withColumn("scored", F.filter(scored, lambda x: x["score"].isNotNull())).drop("candidates", "log_probs")
    best = F.aggregate("scored", F.element_at("scored", 1), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    most = lambda own: F.array_max(F.transform(F.filter("scored", lambda x: (x["name"] == F.col("expected")) == own), lambda x: x["score"]))
    margin = F.when(most(True).isNotNull(), F.coalesce(most(True) - most(False), F.lit(float("inf"))))
    found = F.when(F.size("scored") > 0, best["name"])
    return e.withColumns({"best": F.when(most(True).isNotNull(), found), "margin": margin}).drop("scored")


def letter_decisions(emissions: DataFrame, blank: int = 0) -> DataFrame:
    """emissions (utt_id, log_probs, letters: array of struct(expected, candidates) as closed_set takes them) -> utt_id, place,
    expected, best, margin: the letters are aligned by the first form of each, and each one's window, out to the middle between it
    and its neighbours, decides. Utterances that cannot be aligned, or with a letter that has no first form, give no rows."""
    first = F.transform("letters", lambda x: F.get(x["candidates"], F.lit(0))["form"])
    able = emissions.where(F.forall(first, lambda f: F.coalesce(F.size(f) > 0, F.lit(False)))).withColumn("targets", F.flatten(first))
    # The targets' places of each letter: running sums of the sizes of the first forms.
    sizes = F.transform(first, F.size)
    stop = F.transform(sizes, lambda n, k: F.aggregate(F.slice(sizes, 1, k + 1), F.lit(0), lambda a, x: a + x))
    placed = align(able, blank).groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("place", "first", "last"))).alias("units"))
    spans = F.transform("stop", lambda e, k: F.struct(F.get("units", e - F.get("sizes", k))["first"].alias("start"), (F.get("units", e - 1)["last"] + 1).alias("end")))
    e = able.withColumns({"sizes": sizes, "stop": stop}).join(placed, "utt_id").withColumn("windows", windows(spans, F.size("log_probs")))
    each = e.select("utt_id", "log_probs", F.posexplode(F.arrays_zip("letters", "windows")).alias("place", "x"))
    cut = F.slice("log_probs", F.col("x.windows.lo") + 1, F.col("x.windows.hi") - F.col("x.windows.lo"))
    return closed_set(each.select("utt_id", "place", cut.alias("log_probs"), "x.letters.expected", "x.letters.candidates"), blank)


def target_rows(words: DataFrame, by: list[str], vocabulary: dict[str, int], delimiter: str | None = "|") -> DataFrame:
    """words (by, word: its place from 0, text) -> by, word, start, end, ids, unknown: the tokens of each word's letters, the
    letters that the vocabulary lacks, and the word's range among all of an utterance's tokens. A delimiter that the vocabulary
    has stands before each word but the first, also next to words without tokens."""
    known = F.create_map(*(F.lit(x) for kv in vocabulary.items() for x in kv))
    letters = F.filter(F.split("text", ""), lambda c: c != "")
    ids = F.transform(F.filter(letters, lambda c: F.map_contains_key(known, c)), lambda c: known[c])
    rows = words.select(*by, "word", ids.alias("ids"), F.filter(letters, lambda c: ~F.map_contains_key(known, c)).alias("unknown"))
    end = F.sum(F.size("ids")).over(Window.partitionBy(*by).orderBy("word")) + (F.col("word") if delimiter in vocabulary else F.lit(0))
    return rows.select(*by, "word", (end - F.size("ids")).alias("start"), end.alias("end"), "ids", "unknown")


def word_evidence(words: DataFrame, units: DataFrame, by: list[str], frame_seconds: float) -> DataFrame:
    """words (by, word), units (by, word, first, last, gop, llr), a row for each aligned unit -> by, word, start_s, end_s, and the
    gop and llr of the weakest unit; a word without units has nulls."""
    per = units.groupBy(*by, "word").agg((F.min("first") * frame_seconds).alias("start_s"), ((F.max("last") + 1) * frame_seconds).alias("end_s"), F.min("gop").alias("gop"), F.min("llr").alias("llr"))
    return words.join(per, [*by, "word"], "left")


def log_softmax(log_probs: Column) -> Column:
    def frame(f: Column) -> Column:
        total = F.log(F.aggregate(f, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double"))))
        return F.transform(f, lambda x: x.cast("double") - total)

    return F.transform(log_probs, frame)


def standardized(samples: Column) -> Column:
    """Samples less their mean, over the root of their variance plus 1e-7. The mean and the root are bound as elements of
    one-element arrays, so each is computed once for an array."""
    bound = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    centred = bound(total(samples) / F.size(samples), lambda m: F.transform(samples, lambda x: x - m))

    def scaled(c: Column) -> Column:
        root = F.sqrt(total(F.transform(c, lambda x: x * x)) / F.size(c) + 1e-7)
        return bound(root, lambda r: F.transform(c, lambda x: x / r))

    return bound(centred, scaled)


def windows(spans: Column, frames: Column) -> Column:
    """spans (start, end), one for each letter in order -> lo and hi of each: from the middle between it and the one before to
    the middle between it and the next, the first from 0 and the last to the end."""
    middle = lambda a, b: F.floor((a["end"] + b["start"]) / 2).cast("int")
    lo = lambda x, k: F.coalesce(middle(F.get(spans, k - 1), x), F.lit(0))
    hi = lambda x, k: F.coalesce(middle(x, F.get(spans, k + 1)), frames)
    return F.transform(spans, lambda x, k: F.struct(lo(x, k).alias("lo"), hi(x, k).alias("hi")))
