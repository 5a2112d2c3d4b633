"""Removing secrets from error texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from answerframe.constants import BEARER_PATTERN, ERROR_TEXT_LIMIT, KEY_PATTERN, REDACTED


def redact(text: Column, secrets: Sequence[str] = (), limit: int | None = ERROR_TEXT_LIMIT) -> Column:
    """Replace secrets, then cut to ``limit`` characters (the other order could leave half a secret).

    ``secrets`` become literals of the plan; set ``spark.sql.redaction.string.regex`` where
    plans are logged. ``limit=None`` keeps the whole text.
    """
    for secret in secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit(REDACTED))
    # A plain search first: texts without a trace of a secret skip the regular expressions.
    text = F.when(
        F.contains(text, F.lit("sk-")) | F.contains(text, F.lit("sess-")),
        F.regexp_replace(text, "(?U)" + KEY_PATTERN, REDACTED),
    ).otherwise(text)
    text = F.when(
        F.contains(F.lower(text), F.lit("bearer")),
        F.regexp_replace(text, "(?iU)" + BEARER_PATTERN, f"Bearer {REDACTED}"),
    ).otherwise(text)
    return text if limit is None else F.substring(text, 1, limit)
