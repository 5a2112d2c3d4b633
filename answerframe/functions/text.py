"""Story, key and input-text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from answerframe.constants import CHOICES_WORD, QUESTION_WORD, STORY_WORD

# White space as Unicode defines it, with the four ASCII information separators.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(text: Column) -> Column:
    """Remove white space of any script from both ends (``trim`` knows only the blank)."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def join_story_parts(parts: Column) -> Column:
    """Strip each part, drop the blank ones and join the rest with one blank."""
    return F.array_join(F.filter(F.transform(parts, strip), lambda part: part != ""), " ")


def normalize_story(story: Column) -> Column:
    """One line of text from a variant that is a list of strings or one string."""
    parts = F.try_variant_get(story, "$", "array<string>")
    return F.when(parts.isNotNull(), join_story_parts(parts)).otherwise(
        strip(F.coalesce(F.try_variant_get(story, "$", "string"), F.lit("")))
    )


def question_key(story_index: Column, question_index: Column) -> Column:
    return F.concat_ws(":", story_index, question_index)


def format_input(
    story: Column,
    question: Column,
    candidates: Column,
    story_word: str = STORY_WORD,
    question_word: str = QUESTION_WORD,
    choices_word: str = CHOICES_WORD,
) -> Column:
    """Two labelled lines, and a third when the joined candidates are not empty.

    ``candidates`` is an array of strings.
    """
    choices = F.coalesce(F.array_join(candidates, " | "), F.lit(""))
    base = F.concat(F.lit(f"{story_word}: "), story, F.lit(f"\n{question_word}: "), question)
    return F.when(choices != "", F.concat(base, F.lit(f"\n{choices_word}: "), choices)).otherwise(base)
