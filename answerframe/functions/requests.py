"""Requests for a remote model: payload, reply schema and body."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from answerframe.constants import (
    CO_LABELS,
    FR_LABELS,
    REPLY_SCHEMA_NAME,
    YN_LABELS,
)


def payload(story: Column, question: Column, q_type: Column, candidates: Column) -> Column:
    """The four fields a model may see, and nothing else."""
    return F.struct(
        story.alias("story"),
        question.alias("question"),
        q_type.alias("q_type"),
        candidates.alias("candidate_answers"),
    )


# The wire format of a strict reply.
_REPLY = (
    '{"type":"json_schema","json_schema":{"name":"' + REPLY_SCHEMA_NAME + '","strict":true,"schema":{"type":"object","properties":'
    '{"reasoning":{"type":"string"},"answer":{"type":"array","items":{"type":"%s","enum":%s},"minItems":%d,"maxItems":%d}},'
    '"required":["reasoning","answer"],"additionalProperties":false}}}'
)
# Per task: type of a label, labels (None: the question's candidates), least and most of them (None: all).
_SHAPES = {
    "YN": ("string", YN_LABELS, 1, 1),
    "CO": ("integer", CO_LABELS, 1, 1),
    "FR": ("integer", FR_LABELS, 1, None),
    "FB": ("string", None, 0, None),
}


def response_schema(q_type: Column, candidates: Column) -> Column:
    """JSON text of the strict reply schema; null for an unknown task.

    Only FB, whose labels are the question's own candidates, depends on the row.
    ``candidates`` is an array of variants or of strings.
    """
    column = F
    for task, (kind, labels, least, most) in _SHAPES.items():
        enum = F.to_json(candidates) if labels is None else F.lit(json.dumps(labels, separators=(",", ":")))
        count = F.size(candidates) if labels is None else F.lit(most or len(labels))
        column = column.when(q_type == task, F.format_string(_REPLY, F.lit(kind), enum, F.lit(least), count))
    return column


def request_body(
    payload_json: Column, schema_json: Column, model: str, prompt: str, temperature: float, max_output_tokens: int
) -> Column:
    """JSON text of one request; ``payload_json`` becomes the user message."""

    def quoted(text: Column) -> Column:
        # to_json of a one-field struct, without its braces, is a correctly escaped JSON string.
        return F.regexp_extract(F.to_json(F.struct(text.alias("c"))), r'(?s)^\{"c":(.*)\}$', 1)

    head = json.dumps(
        {"model": model, "messages": [{"role": "system", "content": prompt}]}, ensure_ascii=False, separators=(",", ":")
    )[: -len("]}")]
    tail = json.dumps({"temperature": temperature, "max_completion_tokens": max_output_tokens}, separators=(",", ":"))
    return F.concat(
        F.lit(head + ',{"role":"user","content":'),
        quoted(payload_json),
        F.lit("}]," + tail[1:-1] + ',"response_format":'),
        schema_json,
        F.lit("}"),
    )
