"""Fixed values of the answer-set contract.

Everything in this file must equal the published task definition for results to be right;
nothing here is computed.
"""

# Task names, in contract order and in encoder-id order.
TASKS = ("YN", "FR", "FB", "CO")
ENCODER_TASKS = ("YN", "CO", "FR", "FB")

# Tasks scored by accuracy (one label) and by set comparison (several labels).
SINGLE_LABEL_TASKS = ("YN", "CO")
SET_TASKS = ("FR", "FB")
INTEGER_TASKS = ("FR", "CO")

# Label inventories.
YN_LABELS = ("Yes", "No", "DK")
CO_LABELS = (0, 1, 2, 3)
FR_LABELS = (0, 1, 2, 3, 4, 5, 6, 7)
FB_LABELS = ("A", "B", "C")
FR_DK = 7
CO_NEITHER = 3
NO_LABEL = -100

# Relation names, by FR index.
RELATIONS = ("left", "right", "above", "below", "near", "far", "touching")
DIRECTIONAL = ("left", "right", "above", "below")
INVERSE = {
    "left": "right", "right": "left", "above": "below", "below": "above",
    "near": "near", "far": "far", "touching": "touching",
}
# A relation is contradicted, for one ordered pair, by the one it maps to.
CONTRADICTS = {"left": "right", "right": "left", "above": "below", "below": "above", "near": "far", "far": "near"}

# Field names.
PAYLOAD_FIELDS = ("story", "question", "q_type", "candidate_answers")
USAGE_FIELDS = ("prompt_tokens", "completion_tokens", "total_tokens")
ERROR_FIELDS = ("message", "code", "param", "type")

# Words that introduce each line of the encoder input.
STORY_WORD = "Câu chuyện"
QUESTION_WORD = "Câu hỏi"
CHOICES_WORD = "Các lựa chọn"

# Error codes of attempts whose reply could not be used.
INCOMPLETE_REPLY = "RefusedOrIncompleteResponse"
INVALID_REPLY = "InvalidResponse"

# Redaction.
REDACTED = "[REDACTED]"
KEY_PATTERN = r"\b(?:sk|sess)-[A-Za-z0-9_-]+"
BEARER_PATTERN = r"Bearer\s+[^\s\"']+"
ERROR_TEXT_LIMIT = 1000

# Name of the reply schema in a request.
REPLY_SCHEMA_NAME = "spatial_answer"

