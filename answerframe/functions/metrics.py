"""Per-question scores and losses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from answerframe.constants import SINGLE_LABEL_TASKS


def set_jaccard(prediction: Column, gold: Column) -> Column:
    """|P ∩ G| / |P ∪ G| over distinct labels; 1 when both are empty."""
    union = F.size(F.array_union(prediction, gold))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(prediction, gold)) / union)


def answer_matches(q_type: Column, prediction: Column, gold: Column) -> Column:
    """List equality for the one-label tasks, set equality for the others."""
    return F.when(q_type.isin(*SINGLE_LABEL_TASKS), prediction == gold).otherwise(
        F.size(F.array_union(prediction, gold)) == F.size(F.array_intersect(prediction, gold))
    )


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double")))


def softmax_loss(logits: Column, label: Column) -> Column:
    """Cross entropy of one row, with the largest logit taken out first."""
    wide = logits.cast("array<double>")
    top = F.array_max(wide)
    total = F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return top + F.log(total) - F.element_at(wide, label + 1)


def binary_loss_sum(logits: Column, labels: Column, mask: Column) -> Column:
    """Masked sum of binary cross entropies of one row, stable for large logits."""
    terms = F.zip_with(
        logits.cast("array<double>"),
        labels,
        lambda x, y: F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x))),
    )
    return F.aggregate(F.zip_with(terms, mask, lambda t, m: t * m), F.lit(0.0), lambda acc, x: acc + x)
