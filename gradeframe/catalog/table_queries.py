"""Queries over prompts, runs, logs, JSON text and rollout groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gradeframe.catalog import oracle
from gradeframe.catalog.math_queries import rounded
from gradeframe.catalog.registry import query
from gradeframe.catalog.rollouts import (
    LINE_ORDER, MATH_COLUMNS, MATH_OUTPUT, MATH_PARTS, MATH_SQL, math_rollouts,
)
from gradeframe.functions import prompts
from gradeframe.operators import layout, prompting, rollouts, scoring
from gradeframe.plans.math_eval import judged_samples
from gradeframe.sources import discovery, jsonl, logs
from gradeframe.sources.tables import spread, table

_MODE = "CASE conv_id % 2 WHEN 0 THEN 'think' ELSE 'nothink' END"
_SUFFIX = "CASE conv_id % 2 WHEN 0 THEN '/think' ELSE '/no_think' END"
_BENCH = """CASE conv_id % 5 WHEN 0 THEN 'aime24' WHEN 1 THEN 'aime25' WHEN 2 THEN 'math500'
  WHEN 3 THEN 'olympiadbench' ELSE 'other' END"""
_USER_TURNS = "(SELECT * FROM conversations WHERE role = 'user')"


def _user_turns(spark: SparkSession, folder: str) -> DataFrame:
    return (table(spark, folder, "conversations").where("role = 'user'")
            .selectExpr("conv_id", "turn", "text AS question", f"{_MODE} AS mode",
                        f"{_BENCH} AS benchmark"))


@query(f"""SELECT conv_id, turn, 'user' AS role, text || ' ' || {_SUFFIX} AS content
  FROM {_USER_TURNS}""")
def prompt_messages(spark: SparkSession, folder: str) -> DataFrame:
    message = F.element_at(prompts.chat_messages("question", "mode"), 1)
    return _user_turns(spark, folder).select(
        "conv_id", "turn", message["role"].alias("role"), message["content"].alias("content"))


_TEXTS = "[p_brand, p_type] || string_split(p_name, ' ') || [p_brand, p_type]"


@query(f"""SELECT p_partkey, p_name || chr(10) || chr(10) || array_to_string(list_transform(
    list_zip(['A', 'B', 'C', 'D', 'E'], ({_TEXTS})[1:p_size % 6 + 1], true),
    lambda z: z[1] || '. ' || z[2]), chr(10)) || chr(10) || chr(10)
    || 'Answer with only the letter (A, B, C, D, or E). /no_think' AS content FROM part""")
def choice_prompt(spark: SparkSession, folder: str) -> DataFrame:
    texts = "slice(concat(array(p_brand, p_type), split(p_name, ' '), array(p_brand, p_type)), 1, p_size % 6 + 1)"
    parts = table(spark, folder, "part").selectExpr(
        "p_partkey", "p_name", "split('A,B,C,D,E', ',') AS labels", f"{texts} AS texts")
    messages = prompts.choice_messages("p_name", "labels", "texts", F.lit("nothink"))
    return parts.select("p_partkey", F.element_at(messages, 1)["content"].alias("content"))


@query("SELECT page_id, string_split(rtrim(url, '/'), '/')[-1] AS model FROM pages")
def model_name(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", prompts.model_name("url").alias("model"))


_PARAMS = """CASE conv_id % 2 WHEN 0 THEN 0.6 ELSE 0.7 END::DOUBLE AS temperature,
  CASE conv_id % 2 WHEN 0 THEN 0.95 ELSE 0.8 END::DOUBLE AS top_p, 20 AS top_k,
  CASE conv_id % 2 WHEN 0 THEN 0.0 ELSE 1.5 END::DOUBLE AS presence_penalty"""


@query(f"""SELECT conv_id, turn, {_MODE} AS mode, {_BENCH} AS benchmark, {_PARAMS}, 16 AS n,
  CASE WHEN conv_id % 5 <= 1 THEN 38912 ELSE 32768 END AS max_tokens FROM {_USER_TURNS}""")
def sampling_params(spark: SparkSession, folder: str) -> DataFrame:
    turns = _user_turns(spark, folder).drop("question")
    return prompting.with_math_sampling(turns, k=16)


@query(f"""SELECT conv_id, turn, {_MODE} AS mode, {_PARAMS}, 8 AS n, 8192 AS max_tokens
  FROM {_USER_TURNS}""")
def choice_sampling_params(spark: SparkSession, folder: str) -> DataFrame:
    turns = _user_turns(spark, folder).drop("question", "benchmark")
    return prompting.with_choice_sampling(turns, k=8)


@query(f"""SELECT conv_id, turn, unnest(range(0, 4))::INT AS sample_idx FROM {_USER_TURNS}""")
def sample_fanout(spark: SparkSession, folder: str) -> DataFrame:
    return prompting.fan_out(_user_turns(spark, folder).select("conv_id", "turn"), k=4)


@query(f"""SELECT conv_id, turn, sample_idx,
    'Answer: ' || (length(text || ' ' || {_SUFFIX}) + sample_idx) AS output
  FROM (SELECT *, unnest(range(0, 3))::INT AS sample_idx FROM {_USER_TURNS})""")
def generate_stub(spark: SparkSession, folder: str) -> DataFrame:
    turns = _user_turns(spark, folder).select(
        "conv_id", "turn", prompts.user_content("question", "mode").alias("prompt"))

    def make_generator():
        return lambda texts: [[f"Answer: {len(t) + i}" for i in range(3)] for t in texts]

    return prompting.generate(turns, make_generator, batch_size=64)


@query("""SELECT lang, mode, first_prompt, examples, 4 AS samples_per_example,
    examples * 4 AS generations
  FROM (SELECT lang, mode, arg_min(text, doc_id) AS first_prompt, count(*) AS examples
    FROM (SELECT *, CASE doc_id % 2 WHEN 0 THEN 'think' ELSE 'nothink' END AS mode FROM documents)
    GROUP BY lang, mode)""")
def run_config(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").selectExpr(
        "doc_id", "lang", "CASE doc_id % 2 WHEN 0 THEN 'think' ELSE 'nothink' END AS mode", "text")
    return prompting.run_config(documents, ["lang", "mode"], 4, prompt="text", order_by="doc_id")


# Rollout groups: a supplier is a question, the line number is the training step.

_GROUP_KEYS = ["question_id", "step"]
_GROUP_COLUMNS = {
    "question_id": "l_suppkey",
    "step": "l_linenumber",
    "source": "CASE l_partkey % 2 WHEN 0 THEN 'explorer' ELSE 'learner' END",
}
_GROUP_ORDER = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"]
_MIX, _SIZE = 5, 8
_EXPLORERS = f"""CASE WHEN step <= {_MIX}
  THEN CAST(ceil(round((1 - (step - 1) / ({_MIX} - 1)) * {_SIZE}, 9)) AS INT) ELSE 0 END"""


@query(f"""SELECT step, CASE WHEN step <= {_MIX} THEN 1 - (step - 1) / ({_MIX} - 1) ELSE 0 END::DOUBLE
    AS alpha, {_EXPLORERS} AS explorer_quota, {_SIZE} - {_EXPLORERS} AS learner_quota, samples
  FROM (SELECT l_linenumber AS step, count(*) AS samples FROM lineitem GROUP BY l_linenumber)""")
def mixture_schedule(spark: SparkSession, folder: str) -> DataFrame:
    steps = (table(spark, folder, "lineitem").groupBy(F.col("l_linenumber").alias("step"))
             .agg(F.count(F.lit(1)).alias("samples")))
    return rollouts.with_quotas(steps, _MIX, _SIZE)


_GROUP_SELECT = ", ".join(
    f"{e} AS {n}" for n, e in {**_GROUP_COLUMNS, **MATH_COLUMNS, **MATH_PARTS}.items() if n != "step")
_MIXED = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, step, source
      ORDER BY {', '.join(_GROUP_ORDER)}) AS rank
    FROM (SELECT *, {MATH_OUTPUT} AS output
      FROM (SELECT {_GROUP_SELECT}, l_linenumber AS step, {', '.join(_GROUP_ORDER)} FROM lineitem)))
  WHERE rank <= CASE source WHEN 'explorer' THEN {_EXPLORERS} ELSE {_SIZE} - {_EXPLORERS} END)"""


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", *LINE_ORDER)
    grouped = lines.selectExpr(*[f"{e} AS {n}" for n, e in _GROUP_COLUMNS.items()],
                               "l_orderkey", *LINE_ORDER)
    return rollouts.mixed_group(grouped, _GROUP_KEYS, _GROUP_ORDER, _MIX, _SIZE)


@query(f"SELECT question_id, step, source, l_orderkey, l_partkey FROM {_MIXED}")
def mixed_group(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder).select(*_GROUP_KEYS, "source", "l_orderkey", "l_partkey")


@query(f"""SELECT question_id, step, source, least(count(*), CASE source WHEN 'explorer' THEN {_EXPLORERS}
    ELSE {_SIZE} - {_EXPLORERS} END)::BIGINT AS kept
  FROM (SELECT {_GROUP_SELECT}, l_linenumber AS step FROM lineitem) GROUP BY question_id, step, source
  HAVING CASE source WHEN 'explorer' THEN {_EXPLORERS} ELSE {_SIZE} - {_EXPLORERS} END > 0""")
def mixed_group_seeded(spark: SparkSession, folder: str) -> DataFrame:
    """How many rollouts a seeded draw keeps of each source and group."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", *LINE_ORDER)
    grouped = lines.selectExpr(*[f"{e} AS {n}" for n, e in _GROUP_COLUMNS.items()],
                               "l_orderkey", *LINE_ORDER)
    drawn = rollouts.mixed_group(grouped, _GROUP_KEYS, _GROUP_ORDER, _MIX, _SIZE, seed=7)
    return drawn.groupBy(*_GROUP_KEYS, "source").agg(F.count(F.lit(1)).alias("kept"))


def _advantage_sql(source: str, keys: str, deviation: str) -> str:
    return f"""(SELECT *, CASE WHEN coalesce(sd, 0) < 1e-12 THEN 0.0
        ELSE round((reward - mean) / sd, 6) END AS advantage
      FROM (SELECT *, avg(reward) OVER (PARTITION BY {keys}) AS mean,
          {deviation}(reward) OVER (PARTITION BY {keys}) AS sd
        FROM (SELECT *, is_correct::INT::DOUBLE AS reward FROM {source})))"""


_MIXED_JUDGED = oracle.judged(
    f"(SELECT *, {oracle.answer('output')} AS answer_text FROM {_MIXED})", "answer_text", "gold")


@query(f"""SELECT question_id, step, source, l_orderkey, l_partkey, reward, advantage
  FROM {_advantage_sql(_MIXED_JUDGED, 'question_id, step', 'stddev_pop')}""")
def group_advantage(spark: SparkSession, folder: str) -> DataFrame:
    # Quotas come first, so rewards are computed for the kept rollouts only.
    kept = _mixed(spark, folder)
    parts = {n: F.expr(e) for n, e in MATH_PARTS.items()}
    texts = (kept.withColumns(parts).withColumn("output", F.expr(MATH_OUTPUT))
             .withColumn("gold", F.expr(MATH_COLUMNS["gold"])))
    rewarded = judged_samples(texts).withColumn("reward", F.col("is_correct").cast("double"))
    scored = rollouts.group_advantage(rewarded, _GROUP_KEYS, bounded=True)
    return scored.select(*_GROUP_KEYS, "source", "l_orderkey", "l_partkey", "reward",
                         *[c.alias(n) for n, c in rounded("advantage").items()])


_ALL_JUDGED = oracle.judged(
    f"(SELECT *, {oracle.answer('output')} AS answer_text FROM {MATH_SQL})", "answer_text", "gold")


@query(f"""SELECT example_id, line_no, part_key, supp_key, reward, advantage
  FROM {_advantage_sql(_ALL_JUDGED, 'example_id', 'stddev_samp')}""")
def example_advantage(spark: SparkSession, folder: str) -> DataFrame:
    rewarded = (judged_samples(math_rollouts(spark, folder))
                .select("example_id", "line_no", "part_key", "supp_key",
                        F.col("is_correct").cast("double").alias("reward")))
    return rollouts.group_advantage(rewarded, ["example_id"], std="samp").withColumns(
        rounded("advantage"))


# JSON text is built from table rows and read back with the JSON readers.

_LACKS = """CASE p_partkey % 4 WHEN 0 THEN NULL ELSE p_name END AS question,
  CASE p_partkey % 6 WHEN 1 THEN NULL ELSE 'A' END AS answer_key,
  CASE p_partkey % 8 WHEN 0 THEN NULL ELSE p_brand END AS choice"""


@query(f"""SELECT id, array_to_string(list_filter([CASE WHEN question IS NULL THEN 'question' END,
    CASE WHEN choice IS NULL THEN 'choices' END, CASE WHEN answer_key IS NULL THEN 'answerKey' END],
    lambda x: x IS NOT NULL), ',') AS missing
  FROM (SELECT CAST(p_partkey AS VARCHAR) AS id, {_LACKS} FROM part)
  WHERE question IS NULL OR choice IS NULL OR answer_key IS NULL""")
def dataset_rejects(spark: SparkSession, folder: str) -> DataFrame:
    item = """to_json(named_struct('id', CAST(p_partkey AS STRING), 'question', question,
      'choices', CASE WHEN choice IS NOT NULL THEN named_struct('label', array('A'),
        'text', array(choice)) END, 'answerKey', answer_key))"""
    text = (table(spark, folder, "part").selectExpr("p_partkey", *[
        f"{e}" for e in _LACKS.split(",\n")]).selectExpr(f"{item} AS value"))
    items = text.select(F.from_json("value", jsonl.CHOICE_SCHEMA).alias("item")).select("item.*")
    bad = jsonl.rejects(items, ["question", "choices", "answerKey"])
    return bad.select("id", F.array_join("missing", ",").alias("missing"))


_LINE = """CASE o_orderkey % 7
  WHEN 0 THEN '{"answer":"' || g || '","predicted_answers":["' || v || '","9",null]}'
  WHEN 1 THEN '{"answer":' || g || ',"predicted_answers":' || v || '}'
  WHEN 2 THEN '{"answer":"' || g || '","predicted_answers":null}'
  WHEN 3 THEN '{"answer":"' || g || '"}'
  WHEN 4 THEN '{"predicted_answers":["","' || v || '"]}'
  WHEN 5 THEN '{"answer":' || g || ',"predicted_answers":[' || v || ',1.0,true,"' || g || '"]}'
  ELSE ' \u3000\u00a0 ' END"""
_LINE_PARTS = ("CAST(o_orderkey % 4 AS STRING) AS v", "CAST(o_custkey % 4 AS STRING) AS g")


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 1
    WHEN 3 THEN 0 WHEN 4 THEN 2 ELSE 4 END::BIGINT AS n,
    CASE o_orderkey % 7 WHEN 0 THEN same WHEN 1 THEN same WHEN 4 THEN 1
      WHEN 5 THEN same + (o_custkey % 4 = 1)::INT + 1 ELSE 0 END::BIGINT AS c
  FROM (SELECT *, (o_orderkey % 4 = o_custkey % 4)::INT AS same FROM orders)
  WHERE o_orderkey % 7 < 6""")
def score_scan_json(spark: SparkSession, folder: str) -> DataFrame:
    lines = (spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
             .selectExpr("o_orderkey", *_LINE_PARTS)
             .select("o_orderkey", F.expr(_LINE).alias("value")))
    answers = jsonl.parse_answers(lines).withColumnRenamed("answer", "gold")
    samples = layout.explode_samples(answers, "predicted_answers", "answer_text", keep_empty=True)
    return scoring.example_scores(scoring.judge(samples), ["o_orderkey"], position="sample_idx")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (
    PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank
    FROM events WHERE regexp_matches(event_type, 'view|click|sign')) WHERE rank <= 10""")
def log_tail(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type")
    tail = logs.log_tail(events, "view|click|sign", 10, ["user_id"], ["ts", "event_id"],
                         "event_type")
    return tail.select("user_id", "event_id", "event_type")


@query("""SELECT checkpoint, step, parts, row_number() OVER (ORDER BY run, step, checkpoint) AS place
  FROM (SELECT 'run' || (p_partkey % 12) || '_v2_step_' || p_size AS checkpoint, p_size::BIGINT AS step,
      p_partkey % 12 AS run, count(*) AS parts FROM part GROUP BY ALL)""")
def checkpoint_order(spark: SparkSession, folder: str) -> DataFrame:
    """Checkpoints with two numbers in their names, in natural order; one row per checkpoint."""
    names = table(spark, folder, "part").selectExpr(
        "concat('run', p_partkey % 12, '_v2_step_', p_size) AS checkpoint")
    order = Window.orderBy(discovery.natural_order("checkpoint"))
    return (names.groupBy("checkpoint").agg(F.count(F.lit(1)).alias("parts"))
            .withColumn("step", discovery.checkpoint_step("checkpoint"))
            .withColumn("place", F.row_number().over(order).cast("long")))


@query("""SELECT DISTINCT p_brand AS strategy, p_size AS step_name, p_brand || '_' || p_size AS checkpoint
  FROM part WHERE p_brand || '_' || p_size NOT IN
    (SELECT p_brand || '_' || p_size FROM part WHERE p_partkey % 3 = 0)""")
def skipped_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    steps = parts.selectExpr("p_brand AS strategy", "p_size AS step_name").distinct()
    found = parts.where("p_partkey % 3 = 0").select(
        discovery.expected_checkpoint("p_brand", "p_size").alias("checkpoint"))
    return discovery.skipped_checkpoints(steps, found)
