"""Predictions from logits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from answerframe.constants import FB_LABELS, FR_LABELS, YN_LABELS
from answerframe.functions.metrics import sigmoid


def argmax(logits: Column) -> Column:
    """0-based index of the largest value; the first one on a tie."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def decode_yn(logits: Column) -> Column:
    return F.array(F.get(F.array(*[F.lit(v) for v in YN_LABELS]), argmax(logits)))


def decode_co(logits: Column) -> Column:
    return F.array(argmax(logits).cast("string"))


def decode_fr(logits: Column, threshold: Column) -> Column:
    """Every relation at or over the threshold; the best one when none is.

    The result may mix DK with other relations, which the answer contract forbids:
    measure that with ``validate_labels``.
    """
    picked = F.array_compact(
        F.array(
            *[F.when(sigmoid(F.get(logits, F.lit(i))) >= threshold, F.lit(str(v))) for i, v in enumerate(FR_LABELS)]
        )
    )
    return F.when(F.size(picked) == 0, F.array(argmax(logits).cast("string"))).otherwise(picked)


def decode_fb(logits: Column, threshold: Column, candidates: Column) -> Column:
    """Candidates with a head of their own and a score at or over the threshold, in candidate order."""
    heads = F.array(*[F.lit(v) for v in FB_LABELS])
    none = F.array().cast("array<string>")
    considered = F.when(F.size(F.coalesce(candidates, none)) == 0, heads).otherwise(candidates)
    chosen = F.array_compact(
        F.array(*[F.when(sigmoid(F.get(logits, F.lit(i))) >= threshold, F.lit(v)) for i, v in enumerate(FB_LABELS)])
    )
    return F.filter(considered, lambda c: F.array_contains(chosen, c))


def decode(
    q_type: Column, yn: Column, co: Column, fr: Column, fb: Column, threshold: Column, candidates: Column
) -> Column:
    """The predicted labels of a row, by its task."""
    return (
        F.when(q_type == "YN", decode_yn(yn))
        .when(q_type == "CO", decode_co(co))
        .when(q_type == "FR", decode_fr(fr, threshold))
        .when(q_type == "FB", decode_fb(fb, threshold, candidates))
    )
