"""Label codes and multi-hot vectors for the four task heads."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from answerframe.constants import CO_NEITHER, FB_LABELS, FR_LABELS, NO_LABEL, YN_LABELS


def _zeros(n: int) -> Column:
    return F.array(*[F.lit(0.0).cast("float")] * n)


def _flags(n: int, test) -> Column:
    """An array of n floats, 1 where ``test(index)`` holds."""
    return F.array(*[F.when(test(i), F.lit(1.0)).otherwise(F.lit(0.0)).cast("float") for i in range(n)])


def encode_labels(q_type: Column, labels: Column, candidates: Column) -> Column:
    """Struct of codes, multi-hot vectors and masks for a labelled question.

    ``labels`` and ``candidates`` are arrays of strings. A NULL labels array counts as empty.
    """
    none = F.array().cast("array<string>")
    labels, candidates = F.coalesce(labels, none), F.coalesce(candidates, none)
    first = F.get(labels, F.lit(0))
    yn_known = F.array_position(F.array(*[F.lit(v) for v in YN_LABELS]), first).cast("int") - 1
    yn = F.when(q_type != "YN", NO_LABEL).when(F.size(labels) == 0, YN_LABELS.index("DK")).when(
        yn_known >= 0, yn_known
    ).otherwise(F.raise_error(F.concat(F.lit("unknown YN label: "), first)).cast("int"))
    co = F.when(q_type != "CO", NO_LABEL).when(F.size(labels) == 0, CO_NEITHER).otherwise(first.cast("int"))
    fr_known = F.size(F.array_except(labels, F.array(*[F.lit(str(v)) for v in FR_LABELS]))) == 0
    fr = (
        F.when(q_type != "FR", _zeros(len(FR_LABELS)))
        .when(fr_known, _flags(len(FR_LABELS), lambda i: F.array_contains(labels, str(FR_LABELS[i]))))
        .otherwise(F.raise_error(F.lit("FR label outside the inventory")).cast("array<float>"))
    )
    fr_mask = _flags(len(FR_LABELS), lambda i: q_type == "FR")
    fb = _flags(len(FB_LABELS), lambda i: (q_type == "FB") & F.array_contains(labels, FB_LABELS[i]))
    fb_mask = _flags(
        len(FB_LABELS),
        lambda i: (q_type == "FB") & ((F.size(candidates) == 0) | F.array_contains(candidates, FB_LABELS[i])),
    )
    return F.struct(
        yn.cast("int").alias("yn_label"),
        co.cast("int").alias("co_label"),
        fr.alias("fr_label"),
        fr_mask.alias("fr_mask"),
        fb.alias("fb_label"),
        fb_mask.alias("fb_mask"),
    )
