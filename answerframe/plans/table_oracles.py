"""The table queries in another engine's SQL, formulated independently where that is possible.

Label sets are bit masks here, so set scores are bit counts.
"""

from __future__ import annotations

_TASK = "(CASE {} % 4 WHEN 0 THEN 'YN' WHEN 1 THEN 'FR' WHEN 2 THEN 'FB' ELSE 'CO' END)"


def _mask(task: str, number: str) -> str:
    """One bit per label."""
    return (
        f"(CASE {task} WHEN 'YN' THEN CAST(1 AS BIGINT) << CAST({number} % 3 AS INT)"
        f" WHEN 'CO' THEN CAST(1 AS BIGINT) << CAST({number} % 4 AS INT) WHEN 'FB' THEN CAST({number} % 8 AS BIGINT)"
        f" ELSE CASE WHEN {number} % 128 = 0 THEN CAST(128 AS BIGINT) ELSE CAST({number} % 128 AS BIGINT) END END)"
    )


def _names(task: str, mask: str) -> str:
    """Comma-joined labels of a mask, as text in sorted order."""

    def bits(names: list[str]) -> str:
        parts = ", ".join(f"CASE WHEN {mask} & {1 << i} <> 0 THEN '{n}' END" for i, n in names)
        return f"concat_ws(',', {parts})"

    yn = bits([(2, "DK"), (1, "No"), (0, "Yes")])
    fb = bits(list(enumerate("ABC")))
    fr = bits(list(enumerate("01234567")))
    return f"(CASE {task} WHEN 'YN' THEN {yn} WHEN 'FB' THEN {fb} ELSE {fr} END)"


def _json_names(task: str, mask: str) -> str:
    """The same as JSON text, in the order of the inventory."""

    def bits(names: list[tuple[int, str]], quote: str) -> str:
        parts = ", ".join(f"CASE WHEN {mask} & {1 << i} <> 0 THEN '{quote}{n}{quote}' END" for i, n in names)
        return f"'[' || concat_ws(',', {parts}) || ']'"

    yn = bits([(0, "Yes"), (1, "No"), (2, "DK")], '"')
    fb = bits(list(enumerate("ABC")), '"')
    fr = bits(list(enumerate("01234567")), "")
    return f"(CASE {task} WHEN 'YN' THEN {yn} WHEN 'FB' THEN {fb} ELSE {fr} END)"


_ORDINAL = (
    "(((l_partkey * 10 + l_linenumber) * 4000 + date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) % 4000) * 10000"
    " + CAST(round(l_extendedprice * 100) AS BIGINT) % 10000)"
)

_GUESS = "(CASE WHEN l_quantity > 25 THEN l_suppkey ELSE l_suppkey + l_linenumber END)"

_QA = f"""qa AS (
  SELECT *, CAST(story_index AS VARCHAR) || ':' || CAST(question_index AS VARCHAR) AS key,
    CASE WHEN labelled THEN {_mask('q_type', 'g_number')} END AS g,
    CASE WHEN answered THEN {_mask('q_type', 'p_number')} END AS p
  FROM (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'human' ELSE 'auto' END AS dataset_name,
      CASE WHEN l_orderkey % 2 = 0 THEN 'human' ELSE 'auto' END || '-' || l_linestatus AS source_file,
      l_orderkey AS story_index, {_ORDINAL} AS question_index, {_TASK.format('l_partkey')} AS q_type,
      l_tax <> 0.08 AS labelled, l_returnflag <> 'R' AS answered, l_suppkey AS g_number, {_GUESS} AS p_number,
      l_suppkey AS run, l_linenumber AS epoch
    FROM lineitem))"""

_HIT = "CASE WHEN p IS NOT NULL AND p = g THEN 1.0 ELSE 0.0 END"
_JACCARD = (
    "CASE WHEN p IS NULL THEN 0.0 WHEN p | g = 0 THEN 1.0"
    " ELSE CAST(bit_count(p & g) AS DOUBLE) / CAST(bit_count(p | g) AS DOUBLE) END"
)


def _scores(by: str, missing: str, source: str = "qa", digits: int | None = 6) -> str:
    keep = "g IS NOT NULL" + (" AND p IS NOT NULL" if missing == "skip" else "")
    count = "CAST(count(*) AS DOUBLE)" if missing == "skip" else "count(*)"
    answered = "" if missing == "skip" else "count(p) AS answered,"
    lead = f"{by}, " if by else ""

    def r(x: str) -> str:
        return f"round({x}, {digits})" if digits is not None else x

    return f"""SELECT {lead}q_type, {count} AS count, {answered}
      {r(f"CASE WHEN q_type IN ('YN', 'CO') THEN avg({_HIT}) END")} AS accuracy,
      {r(f"CASE WHEN q_type IN ('FR', 'FB') THEN avg({_HIT}) END")} AS exact_match,
      {r(f"CASE WHEN q_type IN ('FR', 'FB') THEN avg({_JACCARD}) END")} AS jaccard
      FROM {source} WHERE {keep} GROUP BY {lead}q_type"""


_YES_NO = """yn AS (
  SELECT d.source AS dataset_name, d.lang, v.value, length(d.text) % 10 <> 0 AS answered,
    CASE WHEN v.question = 0 THEN length(d.text) > 500 ELSE NOT contains(d.text, chr(10)) END AS guess
  FROM labels l JOIN documents d USING (doc_id), LATERAL (VALUES (0, l.quality), (1, l.toxic)) AS v(question, value))"""

_CHAT_TASK = _TASK.format("(t.conv_id + t.turn)")
_CHAT = f"""chat AS (
  SELECT t.conv_id AS story_index, t.turn - 1 AS question_index,
    CAST(t.conv_id AS VARCHAR) || ':' || CAST(t.turn - 1 AS VARCHAR) AS key, {_CHAT_TASK} AS q_type,
    s.text AS story_text, t.text AS question, t.turn AS turn,
    (t.conv_id + t.turn) % 10 <> 0 AS labelled,
    CASE WHEN (t.conv_id + t.turn) % 10 <> 0 THEN {_mask(_CHAT_TASK, '(t.conv_id * 7 + t.turn)')} END AS g
  FROM conversations t JOIN conversations s ON s.conv_id = t.conv_id AND s.turn = 0 WHERE t.turn > 0)"""

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_EVENT_TASK = _TASK.format("event_id")
_LOG = f"""log AS (
  SELECT CAST(user_id AS VARCHAR) || ':' || CAST(event_id % 7 AS VARCHAR) AS key, event_id AS position, event_type,
    CASE WHEN event_type <> 'error' THEN {_K} END AS prompt_tokens,
    CASE WHEN event_type <> 'error' THEN event_id % 10 END AS completion_tokens,
    {_EVENT_TASK} AS answer_task,
    CASE WHEN event_type NOT IN ('error', 'signup') THEN {_mask(_EVENT_TASK, 'CAST(floor(value) AS BIGINT)')} END AS answer_mask
  FROM events),
last AS (
  SELECT key, position, answer_task, answer_mask FROM log WHERE answer_mask IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY position DESC) = 1)"""

# Labels that tasks share get one bit each, so that answers of one task can be held against gold of another.
# Bits: 0-7 the digits, 8-10 A B C, 11-13 Yes No DK.


def _wide(task: str, mask: str) -> str:
    return f"(CASE {task} WHEN 'YN' THEN {mask} << 11 WHEN 'FB' THEN {mask} << 8 ELSE {mask} END)"


_REPLIES = f"""replies AS (
  SELECT CAST(user_id AS VARCHAR) || ':' || CAST(event_id AS VARCHAR) AS key, {_EVENT_TASK} AS q_type, event_type, k, event_id,
    CASE WHEN event_type = 'purchase' AND k < 50 THEN 'length' ELSE 'stop' END AS finish_reason,
    CASE WHEN event_type = 'purchase' AND k >= 50 AND k < 75 THEN 'no' END AS refusal,
    CASE WHEN event_type = 'click' THEN
      CASE {_EVENT_TASK} WHEN 'YN' THEN '["yes"]' WHEN 'FR' THEN CASE WHEN k % 2 = 0 THEN '["1"]' ELSE '[7,1]' END
        WHEN 'FB' THEN '["A","A"]' ELSE CASE WHEN k % 2 = 0 THEN '[4]' ELSE '[true]' END END
    ELSE CASE {_EVENT_TASK} WHEN 'YN' THEN '["Yes"]' WHEN 'FR' THEN '[2,5]' WHEN 'FB' THEN '["A","B"]'
        ELSE '[' || CAST(k % 4 AS VARCHAR) || ']' END END AS answer_text,
    CASE WHEN event_type = 'signup' AND k % 3 = 0 THEN '5' ELSE '"seen"' END AS reasoning_text,
    CASE WHEN event_type = 'error' AND k % 2 = 0 THEN ' x' ELSE '' END AS junk
  FROM (SELECT *, {_K} AS k FROM events)),
judged AS (
  SELECT *, '{{"reasoning":' || reasoning_text || ',"answer":' || answer_text || '}}' || junk AS content,
    CAST(json_extract(answer_text, '$[*]') AS JSON[]) AS items
  FROM replies),
ruled AS (
  SELECT *, CASE
    WHEN q_type = 'YN' AND len(list_filter(items, lambda v: CAST(v AS VARCHAR) NOT IN ('"Yes"', '"No"', '"DK"'))) > 0 THEN 'invalid_label'
    WHEN q_type = 'FB' AND len(list_filter(items, lambda v: CAST(v AS VARCHAR) NOT IN ('"A"', '"B"'))) > 0 THEN 'invalid_label'
    WHEN q_type = 'FR' AND len(list_filter(items, lambda v: NOT regexp_matches(CAST(v AS VARCHAR), '^[0-7]$'))) > 0 THEN 'invalid_label'
    WHEN q_type = 'CO' AND len(list_filter(items, lambda v: NOT regexp_matches(CAST(v AS VARCHAR), '^[0-3]$'))) > 0 THEN 'invalid_label'
    WHEN len(list_distinct(list_transform(items, lambda v: CAST(v AS VARCHAR)))) < len(items) THEN 'duplicate_label'
    WHEN q_type IN ('YN', 'CO') AND len(items) <> 1 THEN 'needs_one_label'
    WHEN q_type = 'FR' AND len(items) = 0 THEN 'needs_a_relation'
    WHEN q_type = 'FR' AND len(items) > 1 AND list_contains(list_transform(items, lambda v: CAST(v AS VARCHAR)), '7') THEN 'dk_not_alone'
    END AS reason FROM judged)"""

_PARSED = """parsed AS (
  SELECT *, CASE WHEN finish_reason <> 'stop' OR refusal IS NOT NULL THEN 'RefusedOrIncompleteResponse'
    WHEN NOT json_valid(content) OR reason IS NOT NULL OR json_type(reasoning_text) <> 'VARCHAR' THEN 'InvalidResponse' END AS error
  FROM ruled)"""

def _heads(first: int, n: int) -> str:
    """Outputs of the fixed linear map: each the sum of every eighteenth dimension."""
    sums = ["+".join(f"CAST(embedding[{d + 1}] AS DOUBLE)" for d in range(h, 64, 18)) for h in range(first, first + n)]
    return "[" + ", ".join(f"CAST(CAST({s} AS FLOAT) AS DOUBLE)" for s in sums) + "]"



_VECTORS = f"""vectors AS (
  SELECT *, CAST(vec_id AS VARCHAR) AS key, {_TASK.format('vec_id')} AS q_type,
    {_heads(0, 3)} AS yn, {_heads(3, 4)} AS co, {_heads(7, 8)} AS fr,
    {_heads(15, 3)} AS fb,
    CASE vec_id % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['C', 'A'] ELSE ['B', 'D'] END AS candidates,
    {_mask(_TASK.format('vec_id'), '(vec_id * 7 + label)')} AS g
  FROM embeddings),
coded AS (
  SELECT *,
    CASE WHEN len(candidates) = 0 THEN 7 ELSE (CASE WHEN list_contains(candidates, 'A') THEN 1 ELSE 0 END)
      + (CASE WHEN list_contains(candidates, 'B') THEN 2 ELSE 0 END) + (CASE WHEN list_contains(candidates, 'C') THEN 4 ELSE 0 END) END AS fb_open,
    CASE q_type WHEN 'YN' THEN CASE g WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END ELSE -100 END AS yn_label,
    CASE q_type WHEN 'CO' THEN CASE g WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 3 END ELSE -100 END AS co_label
  FROM vectors)"""


def _bits_text(mask: str, n: int) -> str:
    return " || ".join(f"CAST(({mask} >> {i}) & 1 AS VARCHAR)" for i in range(n))


def _softmax(x: str, label: str) -> str:
    return f"ln(list_sum(list_transform({x}, lambda v: exp(v)))) - {x}[{label} + 1]"


def _bce(x: str, mask: str, weight: str, n: int) -> str:
    terms = [
        f"(({weight} >> {i}) & 1) * (greatest({x}[{i + 1}], 0) - {x}[{i + 1}] * (({mask} >> {i}) & 1) + ln(1 + exp(-abs({x}[{i + 1}]))))"
        for i in range(n)
    ]
    return "(" + " + ".join(terms) + ")"


_LOSSES = f"""losses AS (
  SELECT q_type, count(*) AS count, CASE q_type
    WHEN 'YN' THEN avg({_softmax('yn', 'yn_label')}) FILTER (q_type = 'YN')
    WHEN 'CO' THEN avg({_softmax('co', 'co_label')}) FILTER (q_type = 'CO')
    WHEN 'FR' THEN sum({_bce('fr', 'g', '255', 8)}) / greatest(sum(8), 1)
    ELSE sum({_bce('fb', 'g', 'fb_open', 3)}) / greatest(sum(bit_count(CAST(fb_open AS BIGINT))), 1) END AS loss
  FROM coded GROUP BY q_type)"""


def _picked(x: str, n: int, threshold: float) -> str:
    """Bit mask of the logits whose sigmoid reaches the threshold."""
    return "(" + " + ".join(f"CASE WHEN 1 / (1 + exp(-{x}[{i + 1}])) >= {threshold} THEN {1 << i} ELSE 0 END" for i in range(n)) + ")"


_ARGMAX = "(list_position({x}, list_max({x})) - 1)"

_DECODED = f"""decoded AS (
  SELECT *, CASE q_type
    WHEN 'YN' THEN CAST(1 AS BIGINT) << CAST({_ARGMAX.format(x='yn')} AS INT)
    WHEN 'CO' THEN CAST(1 AS BIGINT) << CAST({_ARGMAX.format(x='co')} AS INT)
    WHEN 'FR' THEN CASE WHEN {_picked('fr', 8, 0.5)} = 0 THEN CAST(1 AS BIGINT) << CAST({_ARGMAX.format(x='fr')} AS INT)
      ELSE CAST({_picked('fr', 8, 0.5)} AS BIGINT) END
    ELSE CAST({_picked('fb', 3, 0.5)} & fb_open AS BIGINT) END AS p
  FROM coded)"""

_SPACE = r"[\s\x{1c}-\x{1f}\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _story(text: str) -> str:
    return (
        f"array_to_string(list_filter(list_transform(string_split({text}, chr(10)), lambda part: {_strip('part')}),"
        " lambda part: part <> ''), ' ')"
    )


_CHOICES = "(CASE q_type WHEN 'FB' THEN 'A | B | C' WHEN 'FR' THEN '0 | 1 | 2 | 3 | 4 | 5 | 6 | 7' WHEN 'CO' THEN 'first | second | both | neither' ELSE '' END)"
_TOLD = f"md5(story_text) AS story_md5, md5(question) AS question_md5, q_type, replace({_CHOICES}, ' | ', ',') AS candidates"
_TEXT = (
    f"('Câu chuyện: ' || {_story('story_text')} || chr(10) || 'Câu hỏi: ' || question"
    f" || CASE WHEN {_CHOICES} <> '' THEN chr(10) || 'Các lựa chọn: ' || {_CHOICES} ELSE '' END)"
)
_BEFORE = f"('Câu chuyện: ' || {_story('story_text')} || chr(10) || 'Câu hỏi: ')"


def _words(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '[ \\t\\n\\r]+'), lambda w: w <> ''))"


_HALF_EVEN = "CAST(round_even(n * 0.2, 0) AS BIGINT)"
_SPLIT = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q_type ORDER BY md5('42:' || key), key) AS rank, count(*) OVER (PARTITION BY q_type) AS n FROM qa),
split AS (SELECT *, n > 1 AND rank <= greatest(1, {_HALF_EVEN}) AS is_eval FROM ranked)"""

_RELATION = "CASE l_suppkey % 7 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'above' WHEN 3 THEN 'below' WHEN 4 THEN 'near' WHEN 5 THEN 'far' ELSE 'touching' END"
_CONVERSE = "CASE rel WHEN 'left' THEN 'right' WHEN 'right' THEN 'left' WHEN 'above' THEN 'below' WHEN 'below' THEN 'above' ELSE rel END"
_STATED = f"""stated AS (
  SELECT DISTINCT l_orderkey AS story_id, 'L' || l_linenumber AS subj, {_RELATION} AS rel,
    'L' || ((l_linenumber + l_partkey % 6) % 7 + 1) AS obj
  FROM lineitem),
both_ways AS (SELECT * FROM stated UNION SELECT story_id, obj, {_CONVERSE}, subj FROM stated)"""

_SCENE = """present AS (SELECT DISTINCT l_orderkey AS story_id, l_linenumber AS n FROM lineitem),
ordered AS (SELECT story_id, n, lead(n) OVER (PARTITION BY story_id ORDER BY n) AS m FROM present)"""

# What follows from stated facts and block facts: paths that may go up through blocks before a fact and down after one.
_CLOSED = f"""given AS (SELECT DISTINCT l_orderkey AS story_id, 'L' || l_linenumber AS subj, {_RELATION} AS rel,
    'L' || ((l_linenumber + l_partkey % 6) % 7 + 1) AS obj FROM lineitem
  UNION SELECT o_orderkey, 'A', CASE o_orderstatus WHEN 'F' THEN 'right' ELSE 'left' END, 'N' FROM orders
  UNION SELECT o_orderkey, 'N', CASE o_orderstatus WHEN 'F' THEN 'below' ELSE 'above' END, 'R' FROM orders),
axes AS (SELECT DISTINCT story_id, CASE WHEN rel IN ('left', 'right') THEN 'left' ELSE 'above' END AS axis,
    CASE WHEN rel IN ('left', 'above') THEN subj ELSE obj END AS a, CASE WHEN rel IN ('left', 'above') THEN obj ELSE subj END AS b
  FROM given WHERE rel IN ('left', 'right', 'above', 'below')),
held AS (SELECT DISTINCT l_orderkey AS story_id, l_returnflag AS block, 'L' || l_linenumber AS item FROM lineitem),
moves AS (SELECT story_id, axis, a AS node, CAST(NULL AS INT) AS need, b AS dest, 1 AS after FROM axes
  UNION ALL SELECT story_id, axis, item, CAST(NULL AS INT), block, 0 FROM held, (VALUES ('left'), ('above')) v(axis)
  UNION ALL SELECT story_id, axis, block, 1, item, 1 FROM held, (VALUES ('left'), ('above')) v(axis)),
walk AS (SELECT story_id, axis, node AS origin, node, 0 AS state FROM (SELECT DISTINCT story_id, axis, node FROM moves WHERE node LIKE 'L%')
  UNION SELECT w.story_id, w.axis, w.origin, m.dest, m.after FROM walk w JOIN moves m
    ON m.story_id = w.story_id AND m.axis = w.axis AND m.node = w.node AND (m.need IS NULL OR m.need = w.state)),
follows AS (SELECT story_id, origin AS subj, axis AS rel, node AS obj FROM walk WHERE state = 1
  UNION SELECT story_id, subj, rel, obj FROM given WHERE rel IN ('near', 'far', 'touching')),
both_ways AS (SELECT * FROM follows UNION SELECT story_id, obj, {_CONVERSE}, subj FROM follows)"""

ORACLES: dict[str, str] = {
    "score_missing_wrong": f"WITH {_QA} {_scores('', 'wrong')}",
    "score_answered_only": f"WITH {_QA} {_scores('', 'skip')}",
    "pooled_score": f"WITH {_QA} {_scores('', 'skip')}",
    "per_file_score": f"WITH {_QA} {_scores('source_file', 'skip')}",
    "macro_score": f"""WITH {_QA}, per_set AS ({_scores('dataset_name', 'wrong', digits=None)})
        SELECT q_type, count(*) AS datasets, round(avg(accuracy), 6) AS accuracy, round(avg(exact_match), 6) AS exact_match,
          round(avg(jaccard), 6) AS jaccard FROM per_set GROUP BY q_type""",
    "macro_by_source": f"""WITH {_YES_NO}, per_set AS (
        SELECT dataset_name, avg(CASE WHEN answered AND guess = (value = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM yn GROUP BY dataset_name)
      SELECT 'YN' AS q_type, count(*) AS datasets, round(avg(accuracy), 6) AS accuracy FROM per_set""",
    "score_by_language": f"""WITH {_YES_NO} SELECT lang, 'YN' AS q_type, CAST(count(*) AS DOUBLE) AS count,
        round(avg(CASE WHEN guess = (value = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM yn WHERE answered GROUP BY lang""",
    "write_report": f"WITH {_QA} {_scores('source_file', 'wrong')}",
    "primary_score": f"""WITH {_QA}, per_set AS ({_scores('dataset_name', 'skip', digits=None)})
        SELECT dataset_name, round(avg(coalesce(accuracy, exact_match)), 6) AS primary_score FROM per_set GROUP BY dataset_name""",
    "run_report": f"""WITH {_CHAT}, {_LOG}, joined AS (
        SELECT c.q_type, {_wide('c.q_type', 'c.g')} AS g, {_wide('l.answer_task', 'l.answer_mask')} AS p
        FROM chat c LEFT JOIN last l USING (key)),
      m AS (SELECT q_type, count(*) AS n, count(p) AS answered, avg({_HIT}) AS hit, avg({_JACCARD}) AS jac
        FROM joined WHERE g IS NOT NULL GROUP BY q_type)
      SELECT (SELECT count(*) FROM joined) AS selected_questions, (SELECT count(p) FROM joined) AS answered_questions,
        (SELECT round(count(p) / count(*), 6) FROM joined) AS coverage,
        (SELECT CASE WHEN count(p) = count(*) THEN 'complete' ELSE 'partial' END FROM joined) AS status,
        (SELECT round(hit, 6) FROM m WHERE q_type = 'YN') AS yn_accuracy, (SELECT round(hit, 6) FROM m WHERE q_type = 'CO') AS co_accuracy,
        (SELECT round(hit, 6) FROM m WHERE q_type = 'FR') AS fr_exact_match, (SELECT round(jac, 6) FROM m WHERE q_type = 'FR') AS fr_jaccard,
        (SELECT round(hit, 6) FROM m WHERE q_type = 'FB') AS fb_exact_match, (SELECT round(jac, 6) FROM m WHERE q_type = 'FB') AS fb_jaccard,
        (SELECT n FROM m WHERE q_type = 'FB') AS fb_count, (SELECT answered FROM m WHERE q_type = 'FB') AS fb_answered,
        (SELECT CAST(sum(prompt_tokens) AS BIGINT) FROM log) AS prompt_tokens,
        (SELECT CAST(sum(completion_tokens) AS BIGINT) FROM log) AS completion_tokens,
        (SELECT CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) FROM log) AS total_tokens""",
    "set_jaccard_rows": f"""WITH {_QA} SELECT key, q_type, round({_JACCARD}, 6) AS jaccard FROM qa
        WHERE q_type IN ('FR', 'FB') AND g IS NOT NULL AND p IS NOT NULL""",
    "answer_match_rows": f"WITH {_QA} SELECT key, p = g AS matches FROM qa WHERE g IS NOT NULL AND p IS NOT NULL",
    "profile_by_task": f"WITH {_QA} SELECT dataset_name, q_type, count(*) AS questions FROM qa GROUP BY ALL",
    "profile_datasets": f"""WITH {_QA} SELECT dataset_name, count(DISTINCT (source_file, story_index)) AS stories, count(*) AS questions,
        count(*) FILTER (q_type = 'YN') AS yn, count(*) FILTER (q_type = 'FR') AS fr, count(*) FILTER (q_type = 'FB') AS fb,
        count(*) FILTER (q_type = 'CO') AS co, count(g) AS labelled FROM qa GROUP BY dataset_name""",
    "profile_labels": f"""WITH {_QA}, named AS (
        SELECT dataset_name, q_type, unnest(CASE WHEN g = 0 THEN ['(empty)'] ELSE string_split({_names('q_type', 'g')}, ',') END) AS label
        FROM qa WHERE g IS NOT NULL)
      SELECT dataset_name, q_type, label, count(*) AS questions FROM named GROUP BY ALL""",
    "profile_rollup": f"""WITH {_QA} SELECT dataset_name, q_type, CAST(grouping(dataset_name, q_type) AS INT) AS level, count(*) AS questions
        FROM qa GROUP BY ROLLUP (dataset_name, q_type)""",
    "labelled": f"WITH {_CHAT} SELECT key, q_type, false AS answer_is_null FROM chat WHERE labelled",
    "prefix_limit": f"""WITH {_QA} SELECT source_file, key, q_type FROM qa ORDER BY source_file, story_index, question_index LIMIT 1000""",
    "with_position": f"""WITH {_QA} SELECT key, row_number() OVER (ORDER BY source_file, story_index, question_index) AS position,
        count(*) OVER () AS selected FROM qa""",
    "stratified_split": f"WITH {_QA}, {_SPLIT} SELECT key, q_type, is_eval FROM split",
    "story_split": f"""WITH {_QA} SELECT dataset_name, q_type, count(*) AS questions,
        CAST('0x' || substr(md5('42:' || dataset_name || ':' || CAST(story_index AS VARCHAR)), 1, 8) AS BIGINT) < CAST(floor(0.2 * 4294967296) AS BIGINT) AS is_eval
        FROM qa GROUP BY ALL""",
    "split_overlap": f"""WITH {_QA}, {_SPLIT} SELECT dataset_name, story_index, count(*) FILTER (NOT is_eval) AS train_questions,
        count(*) FILTER (is_eval) AS eval_questions FROM split GROUP BY ALL
        HAVING count(*) FILTER (is_eval) > 0 AND count(*) FILTER (NOT is_eval) > 0""",
    "best_epoch": f"""WITH {_QA}, per_epoch AS ({_scores('run, epoch', 'skip', digits=None)}),
      epochs AS (SELECT run, epoch, round(avg(coalesce(accuracy, exact_match)), 6) AS primary_score FROM per_epoch GROUP BY run, epoch)
      SELECT run, epoch, primary_score FROM epochs QUALIFY row_number() OVER (PARTITION BY run ORDER BY primary_score DESC, epoch) = 1""",
    "latest_success": f"WITH {_LOG} SELECT key, {_names('answer_task', 'answer_mask')} AS answer, position FROM last",
    "pending_resume": f"""WITH {_CHAT}, {_LOG} SELECT key, q_type FROM chat
        WHERE NOT EXISTS (SELECT 1 FROM log WHERE log.key = chat.key AND answer_mask IS NOT NULL)""",
    "attach_predictions": f"""WITH {_CHAT}, {_LOG} SELECT c.key, c.q_type,
        CASE WHEN l.key IS NOT NULL THEN {_names('l.answer_task', 'l.answer_mask')} END AS prediction
        FROM chat c LEFT JOIN last l ON l.key = c.key""",
    "selected_successes": f"""WITH {_CHAT}, {_LOG} SELECT key, position FROM log
        WHERE answer_mask IS NOT NULL AND key IN (SELECT key FROM chat)""",
    "usage_totals": f"""WITH {_LOG} SELECT CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt_tokens,
        CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS completion_tokens,
        CAST(sum(coalesce(prompt_tokens + completion_tokens, 0)) AS BIGINT) AS total_tokens FROM log""",
    "attempt_summary": """SELECT CASE event_type WHEN 'error' THEN 'APIError' WHEN 'signup' THEN 'InvalidResponse' ELSE 'OK' END AS outcome,
        count(*) AS attempts FROM events GROUP BY 1""",
    "append_attempts": f"""WITH {_REPLIES}, {_PARSED} SELECT key, error, k + event_id % 10 AS total_tokens,
        CASE WHEN error IS NULL THEN answer_text END AS answer FROM parsed""",
    "config_drift": """WITH m AS (SELECT l_orderkey AS run, min(l_returnflag) <> max(l_returnflag) AS model,
          min(l_tax) <> max(l_tax) AS temperature, min(l_linestatus) <> max(l_linestatus) AS prompt FROM lineitem GROUP BY 1)
        SELECT run, 'model' AS field FROM m WHERE model UNION ALL SELECT run, 'temperature' FROM m WHERE temperature
        UNION ALL SELECT run, 'prompt' FROM m WHERE prompt""",
    "normalize_story": f"SELECT doc_id, md5({_story('text')}) AS story_md5 FROM documents",
    "format_input": f"WITH {_CHAT} SELECT key, md5({_TEXT}) AS text_md5, CAST(length({_TEXT}) AS INT) AS n_chars FROM chat",
    "payload_json": f"""WITH {_CHAT} SELECT key, 'story,question,q_type,candidate_answers' AS fields, q_type, question,
        CAST(len(string_split(story_text, chr(10))) AS INT) AS story_parts,
        CASE q_type WHEN 'FB' THEN 3 WHEN 'FR' THEN 8 WHEN 'CO' THEN 4 ELSE 0 END AS n_candidates FROM chat""",
    "answer_choices": f"""WITH {_VECTORS} SELECT key, q_type, CASE q_type WHEN 'YN' THEN 'Yes,No,DK' WHEN 'FR' THEN '0,1,2,3,4,5,6,7'
        WHEN 'CO' THEN '0,1,2,3' ELSE array_to_string(candidates, ',') END AS choices FROM vectors""",
    "validate_labels": f"""WITH {_QA} SELECT key, q_type, CASE
        WHEN run % 5 = 0 THEN CASE WHEN p = 0 THEN NULL ELSE 'duplicate_label' END
        WHEN run % 7 = 0 THEN CASE WHEN q_type = 'FR' THEN 'dk_not_alone' ELSE 'invalid_label' END END AS reason
        FROM qa WHERE p IS NOT NULL""",
    "validate_answer": f"WITH {_REPLIES} SELECT key, q_type, reason FROM ruled",
    "normalize_answer": f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN CAST({_K} AS VARCHAR) WHEN 2 THEN CAST({_K} AS VARCHAR)
        WHEN 3 THEN '1,0' WHEN 4 THEN CAST({_K} AS VARCHAR) || ',' || CAST(-{_K} AS VARCHAR) ELSE CAST({_K} AS VARCHAR) || ',' || CAST({_K} AS VARCHAR) END AS labels
        FROM events""",
    "response_schema": f"""WITH {_REPLIES} SELECT key, q_type, CASE WHEN q_type IN ('FR', 'CO') THEN 'integer' ELSE 'string' END AS item_type,
        CASE q_type WHEN 'YN' THEN '["Yes","No","DK"]' WHEN 'FR' THEN '[0,1,2,3,4,5,6,7]' WHEN 'FB' THEN '["A","B"]' ELSE '[0,1,2,3]' END AS enum,
        CASE WHEN q_type = 'FB' THEN 0 ELSE 1 END AS min_items,
        CASE q_type WHEN 'FR' THEN 8 WHEN 'FB' THEN 2 ELSE 1 END AS max_items, 'true' AS strict, 'false' AS extra FROM replies""",
    "build_requests": f"""WITH {_CHAT} SELECT key, 'example-model' AS model,
        md5('Answer only from the story.' || chr(10) || 'Return "reasoning" and "answer".') AS prompt_md5, {_TOLD},
        CASE q_type WHEN 'YN' THEN 'Yes,No,DK' WHEN 'CO' THEN '0,1,2,3' WHEN 'FR' THEN '0,1,2,3,4,5,6,7' ELSE 'A,B,C' END AS allowed,
        CASE q_type WHEN 'FB' THEN 0 ELSE 1 END AS fewest, CASE q_type WHEN 'FR' THEN 8 WHEN 'FB' THEN 3 ELSE 1 END AS most,
        1200 AS max_tokens, 'spatial_answer' AS schema_name FROM chat""",
    "write_requests": f"WITH {_CHAT} SELECT key, CAST(0 AS DOUBLE) AS temperature, 'user' AS role, 'example-model' AS model, {_TOLD} FROM chat",
    "leak_audit": f"""WITH {_CHAT} SELECT 'whole' AS form, field, count(*) AS requests FROM (
        SELECT unnest(list_filter(['q_id', CASE WHEN labelled THEN 'answer' END, CASE WHEN q_type = 'YN' THEN 'reasoning_type' END],
          lambda f: f IS NOT NULL)) AS field FROM chat) GROUP BY field""",
    "truncation_audit": f"""WITH {_CHAT} SELECT q_type, count(*) AS questions, count(*) FILTER ({_words(_TEXT)} > 126) AS truncated,
        count(*) FILTER ({_words(_BEFORE)} >= 126) AS question_lost, CAST(max({_words(_TEXT)}) AS BIGINT) AS longest FROM chat GROUP BY q_type""",
    "parse_replies": f"""WITH {_REPLIES}, {_PARSED} SELECT key, CASE WHEN error IS NULL THEN answer_text END AS answer,
        CASE WHEN error IS NULL THEN 'seen' END AS reasoning, error, k + event_id % 10 AS total_tokens FROM parsed""",
    "encode_labels": f"""WITH {_VECTORS} SELECT key, yn_label, co_label,
        CASE WHEN q_type = 'FR' THEN {_bits_text('g', 8)} ELSE '00000000' END AS fr_label,
        CASE WHEN q_type = 'FR' THEN '11111111' ELSE '00000000' END AS fr_mask,
        CASE WHEN q_type = 'FB' THEN {_bits_text('g', 3)} ELSE '000' END AS fb_label,
        CASE WHEN q_type = 'FB' THEN {_bits_text('fb_open', 3)} ELSE '000' END AS fb_mask FROM coded""",
    "decode_single": f"""WITH {_VECTORS} SELECT key, ['Yes', 'No', 'DK'][CAST({_ARGMAX.format(x='yn')} AS INT) + 1] AS yn,
        CAST({_ARGMAX.format(x='co')} AS INT) AS co FROM vectors""",
    "decode_fr": f"""WITH {_VECTORS}, picked AS (SELECT key, CASE WHEN {_picked('fr', 8, 0.55)} = 0
          THEN CAST(1 AS BIGINT) << CAST({_ARGMAX.format(x='fr')} AS INT) ELSE CAST({_picked('fr', 8, 0.55)} AS BIGINT) END AS p FROM vectors)
        SELECT key, {_names("'FR'", 'p')} AS fr, CASE WHEN p & 128 <> 0 AND p <> 128 THEN 'dk_not_alone' END AS broken_rule FROM picked""",
    "decode_fb": f"""WITH {_VECTORS}, picked AS (SELECT *, {_picked('fb', 3, 0.5)} AS p FROM vectors)
        SELECT key, array_to_string(list_filter(CASE WHEN len(candidates) = 0 THEN ['A', 'B', 'C'] ELSE candidates END,
          lambda c: (c = 'A' AND p & 1 <> 0) OR (c = 'B' AND p & 2 <> 0) OR (c = 'C' AND p & 4 <> 0)), ',') AS fb FROM picked""",
    "decode_score": f"WITH {_VECTORS}, {_DECODED} {_scores('', 'skip', source='decoded')}",
    "multitask_loss": f"WITH {_VECTORS}, {_LOSSES} SELECT q_type, count, round(loss, 6) AS loss FROM losses",
    "mean_loss": f"WITH {_VECTORS}, {_LOSSES} SELECT round(avg(loss), 6) AS loss FROM losses",
    "masked_mean_pool": """WITH cells AS (SELECT label, CAST(vec_id % 5 <> 0 AS INT) AS mask, unnest(embedding) AS x, unnest(range(1, 65)) AS dim FROM embeddings)
        SELECT label, CAST(dim AS INT) AS dim, round(sum(CAST(x AS DOUBLE) * mask) / greatest(sum(mask), 1), 6) AS value FROM cells GROUP BY label, dim""",
    "masked_mean_pool_rows": """WITH cells AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, 64)) AS i FROM embeddings)
        SELECT vec_id, CAST(i % 16 + 1 AS INT) AS dim, round(sum(CASE WHEN (vec_id >> CAST(i // 16 AS INT)) % 2 = 0 THEN CAST(x AS DOUBLE) ELSE 0 END)
          / greatest(max(CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN (vec_id >> 1) % 2 = 0 THEN 1 ELSE 0 END
            + CASE WHEN (vec_id >> 2) % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN (vec_id >> 3) % 2 = 0 THEN 1 ELSE 0 END), 1), 6) AS value
        FROM cells GROUP BY vec_id, i % 16""",
    "score_with_model": """WITH cells AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, 64)) AS d FROM embeddings),
        heads AS (SELECT unnest(range(0, 18)) AS head)
        SELECT vec_id, CAST(head AS INT) AS head, round(sum(CAST(x AS DOUBLE) * (((head * 64 + d) * 7) % 11 - 5) / 10.0), 3) AS logit
        FROM cells, heads GROUP BY vec_id, head""",
    "flatten": f"""WITH {_CHAT} SELECT key, q_type, md5(question) AS question_md5, replace({_CHOICES}, ' | ', ',') AS candidates,
        labelled AS has_answer_key, CASE WHEN labelled THEN {_json_names('q_type', 'g')} END AS answer FROM chat""",
    "flatten_rejects": f"""WITH {_CHAT} SELECT key, CASE
        WHEN story_index % 4 = 0 AND q_type = 'FR' THEN 'unsupported_task'
        WHEN story_index % 4 = 1 THEN 'missing_field:candidate_answers'
        WHEN story_index % 4 = 2 AND q_type = 'YN' AND g = 1 THEN 'invalid_gold:invalid_label' END AS reject_reason FROM chat""",
    "export_fresh": f"""WITH {_CHAT}, {_LOG} SELECT c.key, c.q_type, md5(question) AS question_md5,
        md5(to_json(string_split(story_text, chr(10)))) AS story_md5, c.question_index AS q_id, l.key IS NOT NULL AS has_answer_key,
        CASE WHEN l.key IS NOT NULL THEN regexp_replace(regexp_replace({_json_names('l.answer_task', 'l.answer_mask')}, '([0-7])', '"\\1"', 'g'), '""', '"', 'g') END AS answer
        FROM chat c LEFT JOIN last l ON l.key = c.key""",
    "export_overlay": f"""WITH {_CHAT}, {_LOG} SELECT c.key, c.q_type, md5(question) AS question_md5,
        md5(to_json(string_split(story_text, chr(10)))) AS story_md5, c.question_index AS q_id, l.key IS NOT NULL OR labelled AS has_answer_key,
        CASE WHEN l.key IS NOT NULL THEN regexp_replace(regexp_replace({_json_names('l.answer_task', 'l.answer_mask')}, '([0-7])', '"\\1"', 'g'), '""', '"', 'g')
          WHEN labelled THEN {_json_names('c.q_type', 'g')} END AS answer
        FROM chat c LEFT JOIN last l ON l.key = c.key""",
    "redact_text": r"""WITH texts AS (SELECT doc_id, 'key sk-' || CAST(doc_id AS VARCHAR) || '-x, Authorization: bEaReR  t' || CAST(doc_id AS VARCHAR)
          || '" ' || text || ' sess-' || source AS t FROM documents),
        clean AS (SELECT doc_id, regexp_replace(regexp_replace(replace(t, 'token = ', '[REDACTED]'), '\b(?:sk|sess)-[A-Za-z0-9_-]+', '[REDACTED]', 'g'),
          '(?i)Bearer\s+[^\s"'']+', 'Bearer [REDACTED]', 'g') AS t FROM texts)
        SELECT doc_id, md5(t) AS clean_md5, CAST(length(t) AS INT) AS n_chars FROM clean""",
    "clean_error": """SELECT event_id, CAST(400 + event_id % 100 AS INT) AS status_code, 'bad ' || event_type || ' [REDACTED] Bearer [REDACTED]' AS message,
        CAST(event_id % 7 AS VARCHAR) AS code, CASE WHEN event_id % 2 = 0 THEN 'True' END AS param, CAST(NULL AS VARCHAR) AS type FROM events""",
    "stream_tally": f"""WITH {_LOG} SELECT CASE event_type WHEN 'error' THEN 'APIError' WHEN 'signup' THEN 'InvalidResponse' ELSE 'OK' END AS outcome,
        count(*) AS attempts, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens,
        CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens,
        CAST(coalesce(sum(prompt_tokens + completion_tokens), 0) AS BIGINT) AS total_tokens FROM log GROUP BY 1""",
    "stream_latest": f"WITH {_LOG} SELECT key, {_names('answer_task', 'answer_mask')} AS answer, position FROM last",
    "relation_symmetry": f"WITH {_STATED} SELECT story_id, subj, rel, obj FROM both_ways",
    "relation_reach": f"""WITH {_SCENE} SELECT a.story_id, 'L' || a.n AS subj, 'left' AS rel, 'L' || b.n AS obj
        FROM present a JOIN present b ON b.story_id = a.story_id AND b.n > a.n JOIN orders o ON o.o_orderkey = a.story_id AND o.o_custkey % 7 + 1 = a.n""",
    "inherit_direction": """WITH holds AS (SELECT DISTINCT l_orderkey AS story_id, l_returnflag AS block, l_linenumber AS n FROM lineitem),
        asked AS (SELECT DISTINCT l_orderkey AS story_id, l_linenumber AS a, l_linenumber % 7 + 1 AS b FROM lineitem)
        SELECT DISTINCT q.story_id, 'L' || q.a AS subj, CASE WHEN x.block = 'A' THEN CASE WHEN o.o_orderstatus = 'F' THEN 'right' ELSE 'left' END
          ELSE CASE WHEN o.o_orderstatus = 'F' THEN 'below' ELSE 'above' END END AS rel, 'L' || q.b AS obj
        FROM asked q JOIN orders o ON o.o_orderkey = q.story_id
        JOIN holds x ON x.story_id = q.story_id AND x.n = q.a JOIN holds y ON y.story_id = q.story_id AND y.n = q.b
        WHERE (x.block = 'A' AND y.block = 'N') OR (x.block = 'N' AND y.block = 'R')""",
    "contradictions": f"""WITH {_STATED} SELECT DISTINCT f.story_id, least(f.subj, f.obj) AS a, greatest(f.subj, f.obj) AS b
        FROM stated f JOIN stated g ON g.story_id = f.story_id AND ((g.subj = f.subj AND g.obj = f.obj) OR (g.subj = f.obj AND g.obj = f.subj))
        WHERE f.rel = 'near' AND g.rel = 'far'""",
    "answer_from_facts": f"""WITH {_STATED},
      bits AS (SELECT story_id, subj, obj, bit_or(CASE rel WHEN 'left' THEN 1 WHEN 'right' THEN 2 WHEN 'above' THEN 4 WHEN 'below' THEN 8
          WHEN 'near' THEN 16 WHEN 'far' THEN 32 ELSE 64 END) AS mask FROM both_ways GROUP BY ALL),
      asked AS (SELECT l_orderkey AS story_id, CAST(l_orderkey AS VARCHAR) || ':' || CAST({_ORDINAL} AS VARCHAR) AS key, {_TASK.format('l_partkey')} AS q_type,
          CAST(1 << CAST(l_suppkey % 7 AS INT) AS INT) AS want,
          CASE l_suppkey % 7 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 8 WHEN 3 THEN 4 WHEN 4 THEN 32 WHEN 5 THEN 16 ELSE 0 END AS against,
          'L' || l_linenumber AS subj, 'L' || (l_linenumber % 7 + 1) AS obj,
          'L' || ((l_linenumber + 1) % 7 + 1) AS c1, 'L' || ((l_linenumber + 2) % 7 + 1) AS c2 FROM lineitem),
      tried AS (SELECT a.*, coalesce(s.mask, 0) AS s, coalesce(p.mask, 0) AS p, coalesce(q.mask, 0) AS q,
          coalesce(x.mask, 0) AS x, coalesce(y.mask, 0) AS y, coalesce(z.mask, 0) AS z FROM asked a
        LEFT JOIN bits s ON s.story_id = a.story_id AND s.obj = a.obj AND s.subj = a.subj
        LEFT JOIN bits p ON p.story_id = a.story_id AND p.obj = a.obj AND p.subj = a.c1
        LEFT JOIN bits q ON q.story_id = a.story_id AND q.obj = a.obj AND q.subj = a.c2
        LEFT JOIN bits x ON x.story_id = a.story_id AND x.obj = a.obj AND x.subj = 'L2'
        LEFT JOIN bits y ON y.story_id = a.story_id AND y.obj = a.obj AND y.subj = 'L4'
        LEFT JOIN bits z ON z.story_id = a.story_id AND z.obj = a.obj AND z.subj = 'L6')
      SELECT key, q_type, CASE q_type
        WHEN 'FR' THEN CASE WHEN s = 0 THEN '[7]' ELSE {_json_names("'FR'", 's')} END
        WHEN 'YN' THEN CASE WHEN s & want <> 0 THEN '["Yes"]' WHEN s & against <> 0 THEN '["No"]' ELSE '["DK"]' END
        WHEN 'CO' THEN CASE WHEN p & want <> 0 AND q & want <> 0 THEN '[2]' WHEN p & want <> 0 THEN '[0]' WHEN q & want <> 0 THEN '[1]' ELSE '[3]' END
        ELSE '[' || concat_ws(',', CASE WHEN x & want <> 0 THEN '"L2"' END, CASE WHEN y & want <> 0 THEN '"L4"' END, CASE WHEN z & want <> 0 THEN '"L6"' END) || ']'
        END AS answer FROM tried""",
}

# The same questions over all that follows.
ORACLES["answer_from_closed_facts"] = ORACLES["answer_from_facts"].replace(f"WITH {_STATED}", f"WITH RECURSIVE {_CLOSED}")
ORACLES["pair_reach"] = f"""WITH RECURSIVE {_STATED},
    steps AS (SELECT DISTINCT story_id, rel, subj, obj FROM stated WHERE rel IN ('left', 'right', 'above', 'below')),
    reach AS (SELECT * FROM steps UNION SELECT r.story_id, r.rel, r.subj, s.obj FROM reach r JOIN steps s ON s.story_id = r.story_id AND s.rel = r.rel AND s.subj = r.obj)
    SELECT DISTINCT story_id, subj, rel, obj FROM reach
    JOIN (SELECT DISTINCT l_orderkey AS story_id, 'L' || l_linenumber AS subj, 'L' || (l_linenumber % 7 + 1) AS obj FROM lineitem) USING (story_id, subj, obj)"""
ORACLES["inherit_nested"] = """WITH placed AS (SELECT c_custkey AS n, c_nationkey AS nation, n_regionkey AS region FROM customer JOIN nation ON n_nationkey = c_nationkey),
    both_placed AS (SELECT a.n, a.nation AS na, b.nation AS nb, a.region AS ra, b.region AS rb FROM placed a JOIN placed b ON b.n = a.n + 3)
    SELECT CAST(0 AS BIGINT) AS story_id, 'C' || n AS subj, 'left' AS rel, 'C' || (n + 3) AS obj FROM both_placed WHERE rb = ra + 1
    UNION ALL SELECT CAST(0 AS BIGINT), 'C' || n, 'above', 'C' || (n + 3) FROM both_placed WHERE nb = na + 7"""
# Positions of stories and questions in documents of a thousand conversations.
ORACLES["read_documents"] = f"""WITH {_CHAT},
    story_at AS (SELECT story_index, row_number() OVER (PARTITION BY story_index // 1000 ORDER BY story_index) - 1 AS place
      FROM (SELECT DISTINCT story_index FROM chat)),
    asked_at AS (SELECT *, row_number() OVER (PARTITION BY story_index ORDER BY question_index) - 1 AS pos FROM chat)
    SELECT 'chats-' || CAST(story_index // 1000 AS VARCHAR) AS document, CAST(place AS VARCHAR) || ':' || CAST(pos AS VARCHAR) AS key, q_type,
      md5(question) AS question_md5, md5(to_json(string_split(story_text, chr(10)))) AS story_md5, question_index AS q_id,
      CASE WHEN labelled THEN {_json_names('q_type', 'g')} END AS answer
    FROM asked_at JOIN story_at USING (story_index)"""
ORACLES["stream_resumed"] = ORACLES["stream_latest"]
