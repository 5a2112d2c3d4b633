"""Every operator as a query over the analytics test tables.

Outputs are scalars (label sets as joined text), so that other engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from answerframe.constants import DIRECTIONAL, USAGE_FIELDS
from answerframe.functions.answers import (
    answer_choices,
    candidate_texts,
    check_answers,
    labels_json,
    normalize_answer,
    validate_labels,
)
from answerframe.functions.decode import decode_co, decode_fb, decode_fr, decode_yn
from answerframe.functions.labels import encode_labels
from answerframe.functions.metrics import answer_matches, set_jaccard
from answerframe.functions.redact import redact
from answerframe.functions.requests import payload, response_schema
from answerframe.functions.text import format_input, join_story_parts, question_key
from answerframe.operators import relations as rules
from answerframe.operators.attempts import (
    attach_predictions,
    attempt_summary,
    clean_errors,
    config_drift,
    latest_success,
    pending,
    successes_of,
    usage_totals,
)
from answerframe.operators.audit import (
    count_by_task,
    label_audit,
    leak_audit,
    profile,
    task_rollup,
    truncation_audit,
)
from answerframe.operators.export import export_predictions
from answerframe.operators.infer import (
    apply_heads,
    fit_heads,
    masked_mean_pool,
    masked_mean_pool_tokens,
    score_with_model,
)
from answerframe.operators.replies import parse_replies
from answerframe.operators.runs import best_epoch
from answerframe.operators.score import (
    macro_score,
    mean_loss,
    multitask_loss,
    per_file_metrics,
    primary_score,
    run_report,
    score,
)
from answerframe.operators.select import prefix, with_position
from answerframe.operators.split import split_overlap, story_split, stratified_split
from answerframe.plans.encoder_run import predict
from answerframe.plans.remote_run import REPLY_SCHEMA, RunConfig, build_requests
from answerframe.session import new_folder, written
from answerframe.sources import bridge
from answerframe.sources.attempts import append_attempts, read_attempts
from answerframe.sources.fingerprint import fingerprint
from answerframe.sources.questions import flatten, labelled, read_documents, read_stories
from answerframe.sources.sinks import write_documents, write_report, write_requests, write_stories
from answerframe.streaming.log import read_latest, read_published, run_latest, run_tally, stream_attempts

_CONFIG = RunConfig(
    base_url="https://models.example/v1/",
    model="example-model",
    prompt="Answer only from the story.\nReturn \"reasoning\" and \"answer\".",
    input_sha256="0" * 64,
)


def _joined(labels: Column | str) -> Column:
    return F.array_join(F.sort_array(labels), ",")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- scoring -----------------------------------------------------------------------------


def score_missing_wrong(spark: SparkSession, folder: str) -> DataFrame:
    scores = score(bridge.questions_from_lineitem(spark, folder), missing="wrong")
    return _rounded(scores, "accuracy", "exact_match", "jaccard")


def score_answered_only(spark: SparkSession, folder: str) -> DataFrame:
    scores = score(bridge.questions_from_lineitem(spark, folder), missing="skip")
    return _rounded(scores, "accuracy", "exact_match", "jaccard")


def pooled_score(spark: SparkSession, folder: str) -> DataFrame:
    """Both datasets as one, each file keeping nothing of its own."""
    questions = bridge.questions_from_lineitem(spark, folder)
    human = questions.filter("dataset_name = 'human'")
    auto = questions.filter("dataset_name = 'auto'")
    return _rounded(score(human.unionByName(auto), missing="skip"), "accuracy", "exact_match", "jaccard")


def per_file_score(spark: SparkSession, folder: str) -> DataFrame:
    maps = per_file_metrics(bridge.questions_from_lineitem(spark, folder), missing="skip")
    rows = maps.select("source_file", F.explode("by_task").alias("q_type", "m"))
    return _rounded(
        rows.select("source_file", "q_type", "m.count", "m.accuracy", "m.exact_match", "m.jaccard"),
        "accuracy",
        "exact_match",
        "jaccard",
    )


def macro_scores(spark: SparkSession, folder: str) -> DataFrame:
    scores = macro_score(bridge.questions_from_lineitem(spark, folder), missing="wrong")
    return _rounded(scores, "accuracy", "exact_match", "jaccard")


def macro_by_source(spark: SparkSession, folder: str) -> DataFrame:
    scores = macro_score(bridge.questions_from_labels(spark, folder), missing="wrong")
    return _rounded(scores.select("q_type", "datasets", "accuracy"), "accuracy")


def score_by_language(spark: SparkSession, folder: str) -> DataFrame:
    scores = score(bridge.questions_from_labels(spark, folder), missing="skip", by=["lang"])
    return _rounded(scores.select("lang", "q_type", "count", "accuracy"), "accuracy")


def reports_written(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics per file as a JSON report, read back."""
    path = new_folder(spark, "report")
    write_report(per_file_metrics(bridge.questions_from_lineitem(spark, folder), missing="wrong"), path)
    metrics = "struct<count: bigint, answered: bigint, accuracy: double, exact_match: double, jaccard: double>"
    back = spark.read.schema(f"source_file string, by_task map<string, {metrics}>").json(path)
    rows = back.select("source_file", F.explode("by_task").alias("q_type", "m")).select("source_file", "q_type", "m.*")
    return _rounded(rows, "accuracy", "exact_match", "jaccard")


def primary_scores(spark: SparkSession, folder: str) -> DataFrame:
    scores = score(bridge.questions_from_lineitem(spark, folder), missing="skip", by=["dataset_name"])
    return _rounded(primary_score(scores, by=["dataset_name"]), "primary_score")


def run_reports(spark: SparkSession, folder: str) -> DataFrame:
    attempts = bridge.attempts_from_events(spark, folder)
    questions = attach_predictions(bridge.questions_from_conversations(spark, folder), attempts)
    report = run_report(questions, attempts)
    task = {t: F.col("by_task")[t] for t in ("YN", "FR", "FB", "CO")}
    return report.select(
        "selected_questions",
        "answered_questions",
        F.round("coverage", 6).alias("coverage"),
        "status",
        F.round(task["YN"]["accuracy"], 6).alias("yn_accuracy"),
        F.round(task["CO"]["accuracy"], 6).alias("co_accuracy"),
        F.round(task["FR"]["exact_match"], 6).alias("fr_exact_match"),
        F.round(task["FR"]["jaccard"], 6).alias("fr_jaccard"),
        F.round(task["FB"]["exact_match"], 6).alias("fb_exact_match"),
        F.round(task["FB"]["jaccard"], 6).alias("fb_jaccard"),
        task["FB"]["count"].alias("fb_count"),
        task["FB"]["answered"].alias("fb_answered"),
        *[F.col(f"usage_all_attempts.{f}").alias(f) for f in USAGE_FIELDS],
    )


def set_jaccard_rows(spark: SparkSession, folder: str) -> DataFrame:
    questions = bridge.questions_from_lineitem(spark, folder).filter("q_type in ('FR', 'FB')")
    both = questions.filter("gold is not null and prediction is not null")
    return both.select("key", "q_type", F.round(set_jaccard(F.col("prediction"), F.col("gold")), 6).alias("jaccard"))


def answer_match_rows(spark: SparkSession, folder: str) -> DataFrame:
    both = bridge.questions_from_lineitem(spark, folder).filter("gold is not null and prediction is not null")
    return both.select("key", answer_matches(F.col("q_type"), F.col("prediction"), F.col("gold")).alias("matches"))


# --- profiles, selection, splits ----------------------------------------------------------


def profile_by_task(spark: SparkSession, folder: str) -> DataFrame:
    return count_by_task(bridge.questions_from_lineitem(spark, folder), by=["dataset_name"])


def profile_datasets(spark: SparkSession, folder: str) -> DataFrame:
    return profile(bridge.questions_from_lineitem(spark, folder))


def profile_labels(spark: SparkSession, folder: str) -> DataFrame:
    return label_audit(bridge.questions_from_lineitem(spark, folder))


def profile_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return task_rollup(bridge.questions_from_lineitem(spark, folder))


def _own_key(questions: DataFrame) -> DataFrame:
    """Name questions by the id they carry, which holds where positions in a list may differ."""
    return questions.withColumn(
        "key", question_key(F.col("story_index"), F.variant_get("raw", "$.q_id", "bigint"))
    )


def labelled_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with an answer key, from nested stories."""
    questions = flatten(bridge.story_items_from_conversations(spark, folder))
    return _own_key(labelled(questions)).select("key", "q_type", "answer_is_null")


def prefix_limit(spark: SparkSession, folder: str) -> DataFrame:
    return prefix(bridge.questions_from_lineitem(spark, folder), 1000).select("source_file", "key", "q_type")


def positions(spark: SparkSession, folder: str) -> DataFrame:
    questions = bridge.questions_from_lineitem(spark, folder)
    return with_position(questions.select("source_file", "story_index", "question_index", "key")).select(
        "key", "position", "selected"
    )


def stratified(spark: SparkSession, folder: str) -> DataFrame:
    questions = bridge.questions_from_lineitem(spark, folder).select("key", "q_type")
    return stratified_split(questions, eval_ratio=0.2, seed=42, key=["key"])


def story_sides(spark: SparkSession, folder: str) -> DataFrame:
    questions = bridge.questions_from_lineitem(spark, folder)
    return story_split(questions).groupBy("dataset_name", "q_type", "is_eval").agg(F.count("*").alias("questions"))


def split_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Stories that a split by question, not by story, puts on both sides."""
    questions = bridge.questions_from_lineitem(spark, folder).select("key", "q_type", "dataset_name", "story_index")
    return split_overlap(stratified_split(questions, key=["key"]))


def best_epochs(spark: SparkSession, folder: str) -> DataFrame:
    scores = score(bridge.questions_from_lineitem(spark, folder), missing="skip", by=["run", "epoch"])
    # Scores are compared as rounded numbers, so that a tie is a tie on every engine.
    epochs = _rounded(primary_score(scores, by=["run", "epoch"]), "primary_score")
    return best_epoch(epochs)


# --- attempt log --------------------------------------------------------------------------


def latest_successes(spark: SparkSession, folder: str) -> DataFrame:
    last = latest_success(bridge.attempts_from_events(spark, folder), keep=["answer", "position"])
    return last.select("key", _joined("answer").alias("answer"), "position")


def pending_resume(spark: SparkSession, folder: str) -> DataFrame:
    questions = bridge.questions_from_conversations(spark, folder)
    return pending(questions, bridge.attempts_from_events(spark, folder)).select("key", "q_type")


def attached_predictions(spark: SparkSession, folder: str) -> DataFrame:
    joined = attach_predictions(
        bridge.questions_from_conversations(spark, folder), bridge.attempts_from_events(spark, folder)
    )
    return joined.select("key", "q_type", _joined("prediction").alias("prediction"))


def selected_successes(spark: SparkSession, folder: str) -> DataFrame:
    kept = successes_of(
        bridge.attempts_from_events(spark, folder), bridge.questions_from_conversations(spark, folder)
    )
    return kept.select("key", "position")


def usage_total(spark: SparkSession, folder: str) -> DataFrame:
    return usage_totals(bridge.attempts_from_events(spark, folder))


def attempt_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return attempt_summary(bridge.attempts_from_events(spark, folder))


def logged_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Append parsed replies to a log and read it back."""
    log = new_folder(spark, "log")
    append_attempts(parse_replies(bridge.replies_from_events(spark, folder)), log)
    return read_attempts(spark, log).select(
        "key", "error", F.col("usage.total_tokens").alias("total_tokens"), F.to_json("answer").alias("answer")
    )


def config_drifts(spark: SparkSession, folder: str) -> DataFrame:
    """Runs (here: orders) whose settings changed between two sessions (here: lines)."""
    lines = bridge.table(spark, folder, "lineitem")

    def manifest(which: str) -> DataFrame:
        one = F.min if which == "min" else F.max
        return lines.groupBy(F.col("l_orderkey").alias("run")).agg(
            one("l_returnflag").alias("model"), one("l_tax").alias("temperature"), one("l_linestatus").alias("prompt")
        )

    return config_drift(manifest("min"), manifest("max"), on=["run"])


# --- text, answers, requests, replies ------------------------------------------------------


def normalized_stories(spark: SparkSession, folder: str) -> DataFrame:
    documents = bridge.table(spark, folder, "documents")
    return documents.select("doc_id", F.md5(join_story_parts(F.split("text", "\n"))).alias("story_md5"))


def formatted_inputs(spark: SparkSession, folder: str) -> DataFrame:
    questions = bridge.questions_from_conversations(spark, folder)
    text = format_input(join_story_parts(F.col("story_parts")), F.col("question"), F.col("candidates"))
    return questions.select("key", F.md5(text).alias("text_md5"), F.length(text).alias("n_chars"))


def payload_json(spark: SparkSession, folder: str) -> DataFrame:
    questions = bridge.questions_from_conversations(spark, folder)
    packed = F.to_json(
        payload(F.col("story_parts"), F.col("question"), F.col("q_type"), F.col("candidates"))
    )
    return questions.select("key", packed.alias("j")).select(
        "key",
        F.array_join(F.json_object_keys("j"), ",").alias("fields"),
        F.get_json_object("j", "$.q_type").alias("q_type"),
        F.get_json_object("j", "$.question").alias("question"),
        F.json_array_length(F.get_json_object("j", "$.story")).alias("story_parts"),
        F.json_array_length(F.get_json_object("j", "$.candidate_answers")).alias("n_candidates"),
    )


def choices(spark: SparkSession, folder: str) -> DataFrame:
    rows = bridge.logits_from_embeddings(spark, folder)
    return rows.select("key", "q_type", F.array_join(answer_choices(F.col("q_type"), F.col("candidates")), ",").alias("choices"))


def validated_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of one task held against the rules of another, so that every rule breaks somewhere."""
    rows = bridge.questions_from_lineitem(spark, folder).filter("prediction is not null")
    tested = F.expr("case when run % 5 = 0 then concat(prediction, prediction) when run % 7 = 0 then array('7','1') else prediction end")
    return rows.select("key", "q_type", validate_labels(tested, F.col("q_type"), F.col("candidates")).alias("reason"))


def validated_answers(spark: SparkSession, folder: str) -> DataFrame:
    replies = bridge.replies_from_events(spark, folder)
    rows = replies.withColumn("answer", F.parse_json(F.get_json_object("content", "$.answer")))
    return check_answers(rows).select("key", "q_type", "reason")


def normalized_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Lenient answers of every shape: null, scalar, text number, boolean, fraction, list."""
    k = "cast(get_json_object(props, '$.k') as bigint)"
    raw = F.expr(
        f"case event_id % 6 when 0 then 'null' when 1 then cast({k} as string) when 2 then concat('[\" ', {k}, '\"]')"
        f" when 3 then '[true,false]' when 4 then concat('[', {k}, '.9,-', {k}, '.9]') else concat('[', {k}, ',', {k}, ']') end"
    )
    labels = normalize_answer(F.parse_json(raw), F.lit("FR"))
    return bridge.table(spark, folder, "events").select("event_id", F.array_join(labels, ",").alias("labels"))


def response_schemas(spark: SparkSession, folder: str) -> DataFrame:
    replies = bridge.replies_from_events(spark, folder)
    schema = F.parse_json(response_schema(F.col("q_type"), F.col("candidates")))
    answer = "$.json_schema.schema.properties.answer"
    return replies.select("key", "q_type", schema.alias("s")).select(
        "key",
        "q_type",
        F.variant_get("s", f"{answer}.items.type", "string").alias("item_type"),
        F.to_json(F.variant_get("s", f"{answer}.items.enum", "variant")).alias("enum"),
        F.variant_get("s", f"{answer}.minItems", "int").alias("min_items"),
        F.variant_get("s", f"{answer}.maxItems", "int").alias("max_items"),
        F.variant_get("s", "$.json_schema.strict", "string").alias("strict"),
        F.variant_get("s", "$.json_schema.schema.additionalProperties", "string").alias("extra"),
    )


def _conversation_requests(spark: SparkSession, folder: str) -> DataFrame:
    questions = bridge.questions_from_conversations(spark, folder)
    return build_requests(questions.withColumn("story", F.col("story_parts")), _CONFIG)


def _told(user: Column) -> list[Column]:
    """What a request's user message says: whole story, question, task and choices."""
    listed = lambda field: F.from_json(F.get_json_object(user, f"$.{field}"), "array<string>")
    return [
        F.md5(F.array_join(listed("story"), "\n")).alias("story_md5"),
        F.md5(F.get_json_object(user, "$.question")).alias("question_md5"),
        F.get_json_object(user, "$.q_type").alias("q_type"),
        F.array_join(listed("candidate_answers"), ",").alias("candidates"),
    ]


def requests_built(spark: SparkSession, folder: str) -> DataFrame:
    requests = _conversation_requests(spark, folder)
    user = F.get_json_object("body", "$.messages[1].content")
    answer = "$.response_format.json_schema.schema.properties.answer"
    return requests.select(
        "key",
        F.get_json_object("body", "$.model").alias("model"),
        F.md5(F.get_json_object("body", "$.messages[0].content")).alias("prompt_md5"),
        *_told(user),
        F.array_join(F.from_json(F.get_json_object("body", f"{answer}.items.enum"), "array<string>"), ",").alias("allowed"),
        F.get_json_object("body", f"{answer}.minItems").cast("int").alias("fewest"),
        F.get_json_object("body", f"{answer}.maxItems").cast("int").alias("most"),
        F.get_json_object("body", "$.max_completion_tokens").cast("int").alias("max_tokens"),
        F.get_json_object("body", "$.response_format.json_schema.name").alias("schema_name"),
    )


def requests_written(spark: SparkSession, folder: str) -> DataFrame:
    """Requests as JSON lines, read back."""
    path = new_folder(spark, "requests")
    write_requests(_conversation_requests(spark, folder), path)
    back = spark.read.schema("source_file STRING, key STRING, body VARIANT").json(path)
    return back.select(
        "key",
        F.variant_get("body", "$.temperature", "double").alias("temperature"),
        F.variant_get("body", "$.messages[1].role", "string").alias("role"),
        F.variant_get("body", "$.model", "string").alias("model"),
        *_told(F.variant_get("body", "$.messages[1].content", "string")),
    )


def leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Requests as built leak nothing; whole questions sent as they are would."""
    built = _conversation_requests(spark, folder).select(F.lit("built").alias("form"), "payload_json")
    whole = flatten(bridge.story_items_from_conversations(spark, folder)).select(
        F.lit("whole").alias("form"), F.to_json("raw").alias("payload_json")
    )
    return leak_audit(built.unionByName(whole), by=["form"])


def truncation(spark: SparkSession, folder: str) -> DataFrame:
    questions = bridge.questions_from_conversations(spark, folder)
    story = join_story_parts(F.col("story_parts"))
    texts = questions.select(
        "q_type",
        format_input(story, F.col("question"), F.col("candidates")).alias("text"),
        format_input(story, F.lit(""), F.array().cast("array<string>")).alias("before_question"),
    )
    return truncation_audit(texts, max_length=128)


def parsed_replies(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parse_replies(bridge.replies_from_events(spark, folder))
    return parsed.select(
        "key", F.to_json("answer").alias("answer"), "reasoning", "error", F.col("usage.total_tokens").alias("total_tokens")
    )


def redacted_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents with a key and a bearer token put in front."""
    documents = bridge.table(spark, folder, "documents")
    text = F.concat(
        F.lit("key sk-"), F.col("doc_id"), F.lit("-x, Authorization: bEaReR  t"), F.col("doc_id"), F.lit("\" "), F.col("text"),
        F.lit(" sess-"), F.col("source"),
    )
    clean = redact(text, secrets=["token = "], limit=None)
    return documents.select("doc_id", F.md5(clean).alias("clean_md5"), F.length(clean).alias("n_chars"))


def cleaned_errors(spark: SparkSession, folder: str) -> DataFrame:
    events = bridge.table(spark, folder, "events")
    inner = (
        "concat('{\"message\":\"bad ', event_type, ' sk-', user_id, ' Bearer t', event_id, '\",\"code\":', event_id % 7,"
        " ',\"param\":', case when event_id % 2 = 0 then 'true' else '1.5' end, ',\"headers\":{\"a\":\"private\"}}')"
    )
    body = F.expr(f"parse_json(case when event_id % 3 = 0 then {inner} else concat('{{\"error\":', {inner}, '}}') end)")
    errors = events.select("event_id", F.expr("400 + event_id % 100").alias("status_code"), body.alias("body"))
    details = clean_errors(errors).select("event_id", "error_details.*")
    return details.select("event_id", "status_code", "message", "code", "param", "type")


# --- labels, decoding, losses, pooling ------------------------------------------------------


def encoded_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = bridge.logits_from_embeddings(spark, folder)
    packed = rows.select("key", encode_labels(F.col("q_type"), F.col("gold"), F.col("candidates")).alias("e"))

    def text(column: str) -> Column:
        return F.array_join(F.col(column).cast("array<int>").cast("array<string>"), "").alias(column.split(".")[1])

    return packed.select(
        "key", "e.yn_label", "e.co_label", text("e.fr_label"), text("e.fr_mask"), text("e.fb_label"), text("e.fb_mask")
    )


def decoded_single(spark: SparkSession, folder: str) -> DataFrame:
    rows = bridge.logits_from_embeddings(spark, folder)
    return rows.select(
        "key", decode_yn(F.col("yn"))[0].alias("yn"), decode_co(F.col("co"))[0].cast("int").alias("co")
    )


def decoded_fr(spark: SparkSession, folder: str) -> DataFrame:
    rows = bridge.logits_from_embeddings(spark, folder)
    picked = decode_fr(F.col("fr"), F.lit(0.55))
    return rows.select(
        "key",
        F.array_join(picked, ",").alias("fr"),
        validate_labels(picked, F.lit("FR"), F.col("candidates")).alias("broken_rule"),
    )


def decoded_fb(spark: SparkSession, folder: str) -> DataFrame:
    rows = bridge.logits_from_embeddings(spark, folder)
    return rows.select("key", F.array_join(decode_fb(F.col("fb"), F.lit(0.5), F.col("candidates")), ",").alias("fb"))


def _labelled_logits(spark: SparkSession, folder: str) -> DataFrame:
    rows = bridge.logits_from_embeddings(spark, folder)
    return rows.withColumn("labels", encode_labels(F.col("q_type"), F.col("gold"), F.col("candidates")))


def task_losses(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(multitask_loss(_labelled_logits(spark, folder)), "loss")


def mean_task_loss(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(mean_loss(multitask_loss(_labelled_logits(spark, folder))), "loss")


def decoded_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Decode and score a logits table."""
    rows = predict(bridge.logits_from_embeddings(spark, folder), threshold=0.5)
    return _rounded(score(rows, missing="skip"), "accuracy", "exact_match", "jaccard")


def pooled_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector is a token of the example named by its label; every fifth is padding."""
    tokens = bridge.table(spark, folder, "embeddings").select(
        "label", F.col("embedding").alias("vector"), F.expr("cast(vec_id % 5 <> 0 as int)").alias("mask")
    )
    return _rounded(masked_mean_pool_tokens(tokens, key=["label"]), "value")


def pooled_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector is four tokens of sixteen dimensions."""
    rows = bridge.table(spark, folder, "embeddings").select(
        "vec_id",
        F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(4)]).alias("hidden"),
        F.array(*[F.expr(f"cast(shiftright(vec_id, {i}) % 2 = 0 as int)") for i in range(4)]).alias("mask"),
    )
    pooled = rows.select("vec_id", F.posexplode(masked_mean_pool("hidden", "mask")).alias("dim", "value"))
    return _rounded(pooled.withColumn("dim", F.col("dim") + 1), "value")


def modelled_logits(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed linear model run batch by batch."""

    def make_predict():
        import numpy as np

        grid = np.arange(18 * 64).reshape(18, 64)
        weights = ((grid * 7) % 11 - 5) / 10.0

        def run(vectors):
            out = vectors.astype("float64") @ weights.T
            return {"yn": out[:, :3], "co": out[:, 3:7], "fr": out[:, 7:15], "fb": out[:, 15:]}

        return run

    vectors = bridge.table(spark, folder, "embeddings").select("vec_id", "embedding")
    scored = score_with_model(vectors, make_predict, "embedding", width=64)
    flat = F.concat("yn", "co", "fr", "fb")
    return scored.select("vec_id", F.posexplode(flat).alias("head", "logit")).select(
        "vec_id", "head", F.round(F.col("logit").cast("double"), 3).alias("logit")
    )


def fitted_heads(spark: SparkSession, folder: str) -> DataFrame:
    """Heads fitted on the vectors, applied, decoded and scored."""
    rows = _labelled_logits(spark, folder).select("key", "q_type", "candidates", "gold", "labels", F.col("embedding").alias("features"))
    models = fit_heads(rows)
    return _rounded(score(predict(apply_heads(rows, models)), missing="skip"), "accuracy", "exact_match", "jaccard", digits=3)


# --- nested files --------------------------------------------------------------------------


def _stories(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "stories")
    write_stories(bridge.story_items_from_conversations(spark, folder), path)
    return read_stories(spark, path)


def flattened_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Stories written as nested JSON, read back and flattened."""
    questions = flatten(_stories(spark, folder))
    return _own_key(questions).select(
        "key",
        "q_type",
        F.md5("question").alias("question_md5"),
        F.array_join(candidate_texts(F.col("candidates")), ",").alias("candidates"),
        "has_answer_key",
        F.to_json("answer").alias("answer"),
    )


def documents_read(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as documents of up to a thousand each, their stories first cut into records of two questions.

    The documents are read back in blocks; keys are positions in their documents.
    """
    stories = bridge.story_items_from_conversations(spark, folder).withColumn(
        "source_file", F.concat(F.lit("chats-"), F.floor(F.col("story_index") / 1000).cast("string"))
    )
    nothing = stories.select("source_file", "story_index", F.lit(0).cast("bigint").alias("question_index"), F.col("item").alias("prediction")).limit(0)
    path = new_folder(spark, "documents")
    write_documents(export_predictions(stories, nothing, mode="overlay", per_record=2), path, whole=True)
    questions = flatten(read_documents(spark, f"{path}/*/*"))
    return questions.select(
        F.regexp_extract("source_file", "document=([^/]+)/", 1).alias("document"), "key", "q_type", F.md5("question").alias("question_md5"),
        F.md5(F.to_json("story")).alias("story_md5"), F.variant_get("raw", "$.q_id", "bigint").alias("q_id"), F.to_json("answer").alias("answer"),
    )


def rejected_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Stories with faults of every kind put in, flattened with rejects kept."""
    stories = _stories(spark, folder)
    broken = F.expr(
        "parse_json(case story_index % 4"
        " when 0 then replace(to_json(item), '\"q_type\":\"FR\"', '\"q_type\":\"XX\"')"
        " when 1 then replace(to_json(item), '\"candidate_answers\":', '\"candidates\":')"
        " when 2 then replace(to_json(item), '\"answer\":[\"Yes\"]', '\"answer\":[\"yes\"]')"
        " else to_json(item) end)"
    )
    rows = flatten(stories.withColumn("item", broken), on_error="reject")
    return _own_key(rows).select("key", "reject_reason")


def _exported(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    stories = _stories(spark, folder)
    last = latest_success(bridge.attempts_from_events(spark, folder))
    questions = _own_key(flatten(stories)).select("source_file", "story_index", "question_index", "key")
    predictions = questions.join(last, ["source_file", "key"]).select(
        "source_file", "story_index", "question_index",
        F.parse_json(F.to_json("answer")).alias("prediction"),
    )
    exported = export_predictions(stories, predictions, mode=mode)
    back = _own_key(flatten(exported, validate_gold=False))
    return back.select(
        "key", "q_type", F.md5("question").alias("question_md5"), F.md5(F.to_json("story")).alias("story_md5"),
        F.variant_get("raw", "$.q_id", "bigint").alias("q_id"), "has_answer_key", F.to_json("answer").alias("answer"),
    )


def export_fresh(spark: SparkSession, folder: str) -> DataFrame:
    return _exported(spark, folder, "fresh")


def export_overlay(spark: SparkSession, folder: str) -> DataFrame:
    return _exported(spark, folder, "overlay")


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint(spark, f"{folder}/lineitem.parquet").select("bytes", "sha256")


# --- streams ---------------------------------------------------------------------------------


def _logged(spark: SparkSession, folder: str) -> str:
    log = new_folder(spark, "log")
    attempts = bridge.attempts_from_events(spark, folder)
    append_attempts(
        attempts.select(
            "source_file", "key", "usage", F.parse_json(F.to_json("answer")).alias("answer"), "error",
            F.col("position").alias("seq"),
        ),
        log,
    )
    return log


def stream_tallies(spark: SparkSession, folder: str) -> DataFrame:
    table, checkpoint = new_folder(spark, "tally"), new_folder(spark, "tally-checkpoint")
    run_tally(stream_attempts(spark, _logged(spark, folder)), table, checkpoint)
    return read_published(spark, table)


def stream_latests(spark: SparkSession, folder: str) -> DataFrame:
    table, checkpoint = new_folder(spark, "latest"), new_folder(spark, "latest-checkpoint")
    run_latest(stream_attempts(spark, _logged(spark, folder), files_per_trigger=2), table, checkpoint, position="seq")
    latest = read_latest(spark, table, keep=["answer", "seq"], position="seq")
    return latest.select(
        "key", _joined(F.variant_get("answer", "$", "array<string>")).alias("answer"), F.col("seq").alias("position")
    )


def stream_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """A log without numbers, grown in three sessions, with the stream started anew after each.

    Attempts of one key and session are in one file in order, as one asker leaves them.
    """
    log, table, checkpoint = (new_folder(spark, name) for name in ("log", "latest", "latest-checkpoint"))
    attempts = bridge.attempts_from_events(spark, folder)
    ends = attempts.agg(F.min("position").alias("a"), F.max("position").alias("b")).first()
    third = (ends["b"] - ends["a"]) // 3 + 1
    session = F.floor((F.col("position") - ends["a"]) / third)
    for k in range(3):
        part = attempts.filter(session == k).repartition("key").sortWithinPartitions("position")
        append_attempts(
            part.select("source_file", "key", F.col("position").cast("string").alias("response_id"), F.parse_json(F.to_json("answer")).alias("answer"), "error"),
            log,
        )
        run_latest(stream_attempts(spark, log), table, checkpoint, keep=("answer", "response_id"))
    latest = read_latest(spark, table, keep=("answer", "response_id"))
    return latest.select(
        "key", _joined(F.variant_get("answer", "$", "array<string>")).alias("answer"), F.col("response_id").cast("bigint").alias("position")
    )


# --- relations -------------------------------------------------------------------------------


def relation_symmetry(spark: SparkSession, folder: str) -> DataFrame:
    return rules.relation_symmetry(bridge.stated_relations_from_lineitem(spark, folder))


def relation_reach(spark: SparkSession, folder: str) -> DataFrame:
    """The closure from the objects asked about only: here the line number an order's key points to."""
    asked = bridge.table(spark, folder, "orders").selectExpr(
        "o_orderkey as story_id", "concat('L', o_custkey % 7 + 1) as subj"
    )
    return rules.relation_closure(bridge.scene_relations_from_lineitem(spark, folder), sources=asked)


def inherited_directions(spark: SparkSession, folder: str) -> DataFrame:
    return rules.inherit_direction(
        bridge.block_relations_from_orders(spark, folder),
        bridge.containment_from_lineitem(spark, folder),
        bridge.asked_pairs_from_lineitem(spark, folder),
    )


def nested_directions(spark: SparkSession, folder: str) -> DataFrame:
    """Directions of customers, inherited from nations and from the regions that hold these."""
    return rules.inherit_direction(
        bridge.block_relations_from_nations(spark, folder),
        bridge.nested_containment_from_customers(spark, folder),
        bridge.asked_pairs_from_customers(spark, folder),
    )


def reached_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Which asked pairs of line numbers are connected by stated facts of one direction."""
    asked = bridge.asked_pairs_from_lineitem(spark, folder).withColumn("rel", F.array(*map(F.lit, DIRECTIONAL)))
    return rules.pair_reach(bridge.stated_relations_from_lineitem(spark, folder), asked, scene_rows=rules.SCENE_ROWS)


def answers_from_closed_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Answers from facts, their converses, what follows from them and what blocks hand down."""
    facts = bridge.stated_relations_from_lineitem(spark, folder).unionByName(bridge.block_relations_from_orders(spark, folder))
    answers = rules.answer_from_closed_facts(
        bridge.asked_questions_from_lineitem(spark, folder), facts, bridge.containment_from_lineitem(spark, folder)
    )
    return answers.select("key", "q_type", labels_json(F.col("answer"), F.col("q_type")).alias("answer"))


def contradictions(spark: SparkSession, folder: str) -> DataFrame:
    return rules.contradictions(bridge.stated_relations_from_lineitem(spark, folder))


def answers_from_facts(spark: SparkSession, folder: str) -> DataFrame:
    facts = rules.with_converses(bridge.stated_relations_from_lineitem(spark, folder))
    answers = rules.answer_from_facts(bridge.asked_questions_from_lineitem(spark, folder), facts)
    return answers.select("key", "q_type", labels_json(F.col("answer"), F.col("q_type")).alias("answer"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "score_missing_wrong": score_missing_wrong,
    "score_answered_only": score_answered_only,
    "pooled_score": pooled_score,
    "per_file_score": per_file_score,
    "macro_score": macro_scores,
    "macro_by_source": macro_by_source,
    "score_by_language": score_by_language,
    "write_report": reports_written,
    "primary_score": primary_scores,
    "run_report": run_reports,
    "set_jaccard_rows": set_jaccard_rows,
    "answer_match_rows": answer_match_rows,
    "profile_by_task": profile_by_task,
    "profile_datasets": profile_datasets,
    "profile_labels": profile_labels,
    "profile_rollup": profile_rollup,
    "labelled": labelled_questions,
    "prefix_limit": prefix_limit,
    "with_position": positions,
    "stratified_split": stratified,
    "story_split": story_sides,
    "split_overlap": split_overlaps,
    "best_epoch": best_epochs,
    "latest_success": latest_successes,
    "pending_resume": pending_resume,
    "attach_predictions": attached_predictions,
    "selected_successes": selected_successes,
    "usage_totals": usage_total,
    "attempt_summary": attempt_outcomes,
    "append_attempts": logged_attempts,
    "config_drift": config_drifts,
    "normalize_story": normalized_stories,
    "format_input": formatted_inputs,
    "payload_json": payload_json,
    "answer_choices": choices,
    "validate_labels": validated_labels,
    "validate_answer": validated_answers,
    "normalize_answer": normalized_answers,
    "response_schema": response_schemas,
    "build_requests": requests_built,
    "write_requests": requests_written,
    "leak_audit": leaks,
    "truncation_audit": truncation,
    "parse_replies": parsed_replies,
    "redact_text": redacted_texts,
    "clean_error": cleaned_errors,
    "encode_labels": encoded_labels,
    "decode_single": decoded_single,
    "decode_fr": decoded_fr,
    "decode_fb": decoded_fb,
    "decode_score": decoded_scores,
    "multitask_loss": task_losses,
    "mean_loss": mean_task_loss,
    "masked_mean_pool": pooled_tokens,
    "masked_mean_pool_rows": pooled_rows,
    "score_with_model": modelled_logits,
    "fit_heads": fitted_heads,
    "flatten": flattened_questions,
    "read_documents": documents_read,
    "flatten_rejects": rejected_questions,
    "export_fresh": export_fresh,
    "export_overlay": export_overlay,
    "fingerprint": fingerprints,
    "stream_tally": stream_tallies,
    "stream_latest": stream_latests,
    "stream_resumed": stream_resumed,
    "relation_symmetry": relation_symmetry,
    "relation_reach": relation_reach,
    "pair_reach": reached_pairs,
    "inherit_direction": inherited_directions,
    "inherit_nested": nested_directions,
    "contradictions": contradictions,
    "answer_from_facts": answers_from_facts,
    "answer_from_closed_facts": answers_from_closed_facts,
}
