"""Question, log, logits and fact tables derived from the analytics test tables.

The test tables hold no question files, so these map their rows, all of them, to the
inputs the operators expect. Every column is a plain expression of one row, save for the
join of a conversation's later turns with its first.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from answerframe.constants import FB_LABELS, YN_LABELS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _array_sql(values) -> str:
    return "array(" + ",".join(f"'{v}'" for v in values) + ")" if values else "cast(array() as array<string>)"


def _bits(mask: int, names) -> list[str]:
    return [str(name) for i, name in enumerate(names) if mask >> i & 1]


_FR_BY_MASK = "array(" + ",".join(_array_sql(_bits(m, range(7)) or ["7"]) for m in range(128)) + ")"
_FB_BY_MASK = "array(" + ",".join(_array_sql(_bits(m, FB_LABELS)) for m in range(8)) + ")"
_YN = _array_sql(YN_LABELS)


def labels_from_mask(q_type: str, mask: str) -> Column:
    """Labels a bit mask (SQL text) stands for: set bits for FR and FB, a remainder for YN and CO."""
    return F.expr(
        f"case {q_type} when 'YN' then array(get({_YN}, cast({mask} % 3 as int)))"
        f" when 'CO' then array(cast({mask} % 4 as string))"
        f" when 'FB' then get({_FB_BY_MASK}, cast({mask} % 8 as int))"
        f" else get({_FR_BY_MASK}, cast({mask} % 128 as int)) end"
    )


def candidates_of(q_type: str) -> Column:
    return F.expr(
        f"case {q_type} when 'FB' then array('A','B','C') when 'FR' then array('0','1','2','3','4','5','6','7')"
        f" when 'CO' then array('first','second','both','neither') else cast(array() as array<string>) end"
    )


_TASK_BY_REMAINDER = "case {} % 4 when 0 then 'YN' when 1 then 'FR' when 2 then 'FB' else 'CO' end"

# A number made from the row's own content: no window, so no order key can end up in one task.
_LINE_ORDINAL = (
    "(((l_partkey * 10 + l_linenumber) * 4000 + unix_date(cast(l_shipdate as date)) % 4000) * 10000"
    " + cast(round(l_extendedprice * 100) as bigint) % 10000)"
)


def questions_from_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """A question per line: story = order, gold and prediction from the supplier key.

    Lines with return flag R have no prediction and lines taxed 0.08 have no gold.
    """
    lines = table(spark, folder, "lineitem").withColumn("q_type", F.expr(_TASK_BY_REMAINDER.format("l_partkey")))
    guess = "(case when l_quantity > 25 then l_suppkey else l_suppkey + l_linenumber end)"
    return lines.select(
        F.expr("concat(case when l_orderkey % 2 = 0 then 'human' else 'auto' end, '-', l_linestatus)").alias("source_file"),
        F.expr("case when l_orderkey % 2 = 0 then 'human' else 'auto' end").alias("dataset_name"),
        F.col("l_orderkey").alias("story_index"),
        F.expr(_LINE_ORDINAL).alias("question_index"),
        F.expr(f"concat(l_orderkey, ':', {_LINE_ORDINAL})").alias("key"),
        "q_type",
        candidates_of("q_type").alias("candidates"),
        F.expr("l_tax <> 0.08D").alias("has_answer_key"),
        F.when(F.expr("l_tax <> 0.08D"), labels_from_mask("q_type", "l_suppkey")).alias("gold"),
        F.when(F.expr("l_returnflag <> 'R'"), labels_from_mask("q_type", guess)).alias("prediction"),
        F.col("l_suppkey").alias("run"),
        F.col("l_linenumber").alias("epoch"),
    )


def questions_from_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Story = first turn of a conversation, split at line ends; questions = its later turns."""
    turns = table(spark, folder, "conversations")
    stories = turns.filter("turn = 0").select("conv_id", F.col("text").alias("story_text"))
    later = turns.filter("turn > 0").withColumn("q_type", F.expr(_TASK_BY_REMAINDER.format("(conv_id + turn)")))
    return later.join(stories, "conv_id").select(
        F.lit("conversations").alias("source_file"),
        F.lit("conversations").alias("dataset_name"),
        F.col("conv_id").alias("story_index"),
        (F.col("turn") - 1).alias("question_index"),
        F.expr("concat(conv_id, ':', turn - 1)").alias("key"),
        "q_type",
        F.col("story_text"),
        F.split("story_text", "\n").alias("story_parts"),
        F.col("text").alias("question"),
        candidates_of("q_type").alias("candidates"),
        F.expr("(conv_id + turn) % 10 <> 0").alias("has_answer_key"),
        F.when(F.expr("(conv_id + turn) % 10 <> 0"), labels_from_mask("q_type", "(conv_id * 7 + turn)")).alias("gold"),
    )


def questions_from_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Yes/No questions about documents: is it of quality, is it toxic. The prediction is a rule on the text.

    One dataset per document source. Documents without a label have no question.
    """
    documents = table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("dataset_name"), "lang", F.length("text").alias("length"), F.contains("text", F.lit("\n")).alias("lines")
    )
    asked = table(spark, folder, "labels").select(
        "doc_id",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("question_index"), F.col("quality").alias("value")),
                F.struct(F.lit(1).alias("question_index"), F.col("toxic").alias("value")),
            )
        ).alias("q"),
    )
    guess = F.when(F.col("q.question_index") == 0, F.col("length") > 500).otherwise(~F.col("lines"))
    return asked.join(documents, "doc_id").select(
        "dataset_name",
        "lang",
        F.col("doc_id").alias("story_index"),
        F.col("q.question_index").alias("question_index"),
        F.lit("YN").alias("q_type"),
        F.array(F.when(F.col("q.value") == 1, "Yes").otherwise("No")).alias("gold"),
        F.when(F.col("length") % 10 != 0, F.array(F.when(guess, "Yes").otherwise("No"))).alias("prediction"),
    )


def story_items_from_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The same questions as nested stories, in the layout ``read_stories`` reads."""
    from answerframe.functions.answers import labels_json
    from answerframe.operators.export import group_questions

    q = questions_from_conversations(spark, folder)
    candidates = F.when(F.col("q_type") == "FR", F.to_json(F.col("candidates").cast("array<int>"))).otherwise(
        F.to_json("candidates")
    )
    raw = F.to_json(
        F.struct(
            F.col("question_index").alias("q_id"),
            "q_type",
            "question",
            F.parse_json(candidates).alias("candidate_answers"),
            F.when(F.col("has_answer_key"), F.parse_json(labels_json(F.col("gold"), F.col("q_type")))).alias("answer"),
            F.when(F.col("q_type") == "YN", "Quantifier").alias("reasoning_type"),
        )
    )
    story = F.parse_json(F.to_json(F.struct(F.col("story_parts").alias("story"))))
    return group_questions(q.select("source_file", "dataset_name", "story_index", "question_index", raw.alias("raw_json"), story.alias("item")))


def attempts_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """The attempt log: ``error`` events are exceptions, ``signup`` events unusable replies, the rest answers."""
    k = "cast(get_json_object(props, '$.k') as bigint)"
    answered = "event_type not in ('error', 'signup')"
    return table(spark, folder, "events").select(
        F.lit("conversations").alias("source_file"),
        F.expr("concat(user_id, ':', event_id % 7)").alias("key"),
        F.col("event_id").alias("position"),
        F.expr(
            f"case when event_type <> 'error' then named_struct('prompt_tokens', {k},"
            f" 'completion_tokens', event_id % 10, 'total_tokens', {k} + event_id % 10) end"
        ).alias("usage"),
        F.when(
            F.expr(answered), labels_from_mask(_TASK_BY_REMAINDER.format("event_id"), "cast(floor(value) as bigint)")
        ).alias("answer"),
        F.expr("case event_type when 'error' then 'APIError' when 'signup' then 'InvalidResponse' end").alias("error"),
        "event_type",
    )


def replies_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """Raw model replies, good and broken, one per event."""
    k = "cast(get_json_object(props, '$.k') as bigint)"
    task = _TASK_BY_REMAINDER.format("event_id")
    good = (
        f"case {task} when 'YN' then '[\"Yes\"]' when 'FR' then '[2,5]' when 'FB' then '[\"A\",\"B\"]'"
        f" else concat('[', {k} % 4, ']') end"
    )
    bad = (
        f"case {task} when 'YN' then '[\"yes\"]' when 'FR' then case when {k} % 2 = 0 then '[\"1\"]' else '[7,1]' end"
        f" when 'FB' then '[\"A\",\"A\"]' else case when {k} % 2 = 0 then '[4]' else '[true]' end end"
    )
    reasoning = f"case when event_type = 'signup' and {k} % 3 = 0 then '5' else '\"seen\"' end"
    answer = f"case when event_type = 'click' then {bad} else {good} end"
    return table(spark, folder, "events").select(
        F.lit("events").alias("source_file"),
        F.expr("concat(user_id, ':', event_id)").alias("key"),
        F.expr(task).alias("q_type"),
        F.expr(
            f"transform(case when {task} = 'FB' then array('A','B') else cast(array() as array<string>) end,"
            " c -> cast(c as variant))"
        ).alias("candidates"),
        F.expr(f"case when event_type = 'purchase' and {k} < 50 then 'length' else 'stop' end").alias("finish_reason"),
        F.expr(f"case when event_type = 'purchase' and {k} >= 50 and {k} < 75 then 'no' end").alias("refusal"),
        F.expr(
            f"concat('{{\"reasoning\":', {reasoning}, ',\"answer\":', {answer}, '}}',"
            f" case when event_type = 'error' and {k} % 2 = 0 then ' x' else '' end)"
        ).alias("content"),
        F.expr(
            f"named_struct('prompt_tokens', {k}, 'completion_tokens', event_id % 10,"
            f" 'total_tokens', {k} + event_id % 10)"
        ).alias("usage"),
        F.expr("concat('r', event_id)").alias("response_id"),
        F.lit("m").alias("response_model"),
    )


def logits_from_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Head outputs of a fixed linear map of all 64 dimensions, with a label for each row.

    Output h is the sum of every eighteenth dimension from h on, added in that order.
    """

    def outputs(first: int, n: int) -> Column:
        dims = [[F.element_at("embedding", d + 1).cast("double") for d in range(h, 64, 18)] for h in range(first, first + n)]
        return F.array(*[functools.reduce(operator.add, cells).cast("float") for cells in dims])

    vectors = table(spark, folder, "embeddings").withColumn("q_type", F.expr(_TASK_BY_REMAINDER.format("vec_id")))
    mask = "(vec_id * 7 + label)"
    return vectors.select(
        F.lit("embeddings").alias("source_file"),
        F.col("vec_id").cast("string").alias("key"),
        "vec_id",
        "q_type",
        outputs(0, 3).alias("yn"),
        outputs(3, 4).alias("co"),
        outputs(7, 8).alias("fr"),
        outputs(15, 3).alias("fb"),
        F.expr(
            "case vec_id % 3 when 0 then cast(array() as array<string>) when 1 then array('C','A') else array('B','D') end"
        ).alias("candidates"),
        labels_from_mask("q_type", mask).alias("gold"),
        "embedding",
        "label",
    )


def scene_relations_from_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of a scene per order: each line number present is left of the next one present.

    Entities are line numbers of any size; duplicate lines meet before the shuffle.
    """
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("story_id"), F.col("l_linenumber").alias("n")).distinct()
    following = F.lead("n").over(W.partitionBy("story_id").orderBy("n"))
    return lines.withColumn("m", following).filter("m is not null").select(
        "story_id",
        F.concat(F.lit("L"), F.col("n")).alias("subj"),
        F.lit("left").alias("rel"),
        F.concat(F.lit("L"), F.col("m")).alias("obj"),
    )


def stated_relations_from_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """One stated fact per line, of any of the seven kinds, between two line numbers of its order; with repeats."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("story_id"),
        F.expr("concat('L', l_linenumber)").alias("subj"),
        F.expr(
            "get(array('left','right','above','below','near','far','touching'), cast(l_suppkey % 7 as int))"
        ).alias("rel"),
        # Never the line's own number, so that every line states a fact.
        F.expr("concat('L', (l_linenumber + l_partkey % 6) % 7 + 1)").alias("obj"),
    )


def containment_from_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of a scene are the return flags; a line number may lie in several."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("story_id"),
        F.col("l_returnflag").alias("container"),
        F.expr("concat('L', l_linenumber)").alias("item"),
    ).distinct()


def block_relations_from_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Two block facts per order: A left of N and N above R; the other way round for finished orders."""
    finished = "o_orderstatus = 'F'"
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("story_id"),
        F.explode(
            F.expr(
                f"array(named_struct('subj', 'A', 'rel', if({finished}, 'right', 'left'), 'obj', 'N'),"
                f" named_struct('subj', 'N', 'rel', if({finished}, 'below', 'above'), 'obj', 'R'))"
            )
        ).alias("f"),
    ).select("story_id", "f.subj", "f.rel", "f.obj")


def asked_pairs_from_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of objects a question is about: each line number and the one after it."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("story_id"),
        F.expr("concat('L', l_linenumber)").alias("subj"),
        F.expr("concat('L', l_linenumber % 7 + 1)").alias("obj"),
    ).distinct()


def asked_questions_from_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Questions over the stated facts, one per line, of all four kinds."""
    lines = table(spark, folder, "lineitem").withColumn("q_type", F.expr(_TASK_BY_REMAINDER.format("l_partkey")))
    return lines.select(
        F.col("l_orderkey").alias("story_id"),
        F.expr(f"concat(l_orderkey, ':', {_LINE_ORDINAL})").alias("key"),
        "q_type",
        F.expr("concat('L', l_linenumber)").alias("subj"),
        F.expr(
            "get(array('left','right','above','below','near','far','touching'), cast(l_suppkey % 7 as int))"
        ).alias("rel"),
        F.expr("concat('L', l_linenumber % 7 + 1)").alias("obj"),
        F.expr(
            "case when l_partkey % 4 = 3 then array(concat('L', (l_linenumber + 1) % 7 + 1), concat('L', (l_linenumber + 2) % 7 + 1),"
            " 'both', 'neither') when l_partkey % 4 = 2 then array('L2','L4','L6') else cast(array() as array<string>) end"
        ).alias("candidates"),
    )


def nested_containment_from_customers(spark: SparkSession, folder: str) -> DataFrame:
    """One scene: regions hold nations, nations hold customers."""
    region, nation, customer = F.expr("concat('R', n_regionkey)"), F.expr("concat('N', n_nationkey)"), F.expr("concat('N', c_nationkey)")
    return (
        table(spark, folder, "nation").select(F.lit(0).cast("bigint").alias("story_id"), region.alias("container"), nation.alias("item"))
        .unionByName(
            table(spark, folder, "customer").select(
                F.lit(0).cast("bigint").alias("story_id"), customer.alias("container"), F.expr("concat('C', c_custkey)").alias("item")
            )
        )
    )


def block_relations_from_nations(spark: SparkSession, folder: str) -> DataFrame:
    """Each region is left of the next one; each nation is above the nation numbered seven more."""
    story = F.lit(0).cast("bigint").alias("story_id")
    regions = table(spark, folder, "region").select(
        story, F.expr("concat('R', r_regionkey)").alias("subj"), F.lit("left").alias("rel"), F.expr("concat('R', r_regionkey + 1)").alias("obj")
    )
    nations = table(spark, folder, "nation").select(
        story, F.expr("concat('N', n_nationkey)").alias("subj"), F.lit("above").alias("rel"), F.expr("concat('N', n_nationkey + 7)").alias("obj")
    )
    return regions.unionByName(nations)


def asked_pairs_from_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer and the one numbered three more."""
    return table(spark, folder, "customer").select(
        F.lit(0).cast("bigint").alias("story_id"), F.expr("concat('C', c_custkey)").alias("subj"), F.expr("concat('C', c_custkey + 3)").alias("obj")
    )
