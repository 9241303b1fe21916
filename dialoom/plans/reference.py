"""The named queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom import schemas, sinks, sources
from dialoom.functions import ellipsis, fixed
from dialoom.operators import checkpoints, dialogue, evaluate, infer, pipeline, split, stats
from dialoom.session import scratch
from dialoom.sources import table

Query = Callable[[SparkSession, str], DataFrame]

# Literal listings for the checkpoint queries.
CHECKPOINT_NAMES = ["checkpoint-500", "checkpoint-1000", "checkpoint-1500", "runs", "images", "checkpoint-best"]


def _conv(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations")


def _turns(s: SparkSession, d: str) -> DataFrame:
    return dialogue.delivered_once(_conv(s, d)).select("conv_id", "turn", "role", "content")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return dialogue.qa_turns(_conv(s, d))


def _samples(s: SparkSession, d: str) -> DataFrame:
    return dialogue.samples(_conv(s, d))


def _sample_ids(s: SparkSession, d: str) -> DataFrame:
    return dialogue.samples(_conv(s, d), texts=False)


def _answers(s: SparkSession, d: str) -> DataFrame:
    return stats.value_counts(stats.assistant_texts(_turns(s, d)), "value", ["conv_id", "turn"])


def qa_pairs(s: SparkSession, d: str) -> DataFrame:
    return _samples(s, d).select("id", "conv_id", "turn", "question", "answer")


def qa_pairs_drop_empty(s: SparkSession, d: str) -> DataFrame:
    return dialogue.qa_turns(_conv(s, d), keep_empty_question=False)


def nested(s: SparkSession, d: str) -> DataFrame:
    """The corpus as it was nested: one row per dialogue."""
    turns = _turns(s, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("t"))
    return turns.select(F.col("conv_id").alias("id"), F.transform("t", lambda x: F.struct(x.role.alias("role"), x.content.alias("content"))).alias("conversations"))


def pair_count_variants(s: SparkSession, d: str) -> DataFrame:
    turns = _turns(s, d)
    floor = stats.dialogue_sizes(turns).agg(F.sum("n_pairs").alias("floor_pairs"))
    state = _pairs(s, d).agg(F.count("*").alias("state_machine_pairs"))
    kinds = dialogue.positional(turns).agg(F.count_if(F.col("kind") == "question").alias("positional_questions"), F.count_if(F.col("kind") == "answer").alias("positional_answers"))
    return floor.join(F.broadcast(state)).join(F.broadcast(kinds))


def _positional_hist(kind: str) -> Query:
    return lambda s, d: stats.equal_width_histogram(dialogue.positional(_turns(s, d)).where(F.col("kind") == kind), F.length("content"))


def training_records(s: SparkSession, d: str) -> DataFrame:
    r = dialogue.training_records(_samples(s, d))
    at = lambda i: F.get("conversations", F.lit(i))
    return r.select("id", "image", at(0)["from"].alias("from_0"), at(0).value.alias("value_0"), at(1)["from"].alias("from_1"), at(1).value.alias("value_1"))


def message_records(s: SparkSession, d: str) -> DataFrame:
    a = dialogue.message_records(_samples(s, d))
    first, second = (F.get("conversations", F.lit(i)).content for i in (0, 1))
    flat = a.withColumns({"type_0": F.get(first, F.lit(0)).type, "question": F.get(first, F.lit(1)).text, "answer": F.get(second, F.lit(0)).text, "path": F.col("image")})
    b = dialogue.messages_to_records(flat, "path", "original_index", "type_0", "question", "answer")
    value = lambda i: F.get("conversations", F.lit(i)).value
    return b.select("id", F.col("path").alias("image"), "original_index", "type_0", "question", "answer", F.col("image").alias("file"), value(0).alias("prompt"), value(1).alias("record_answer"))


def exact_match_by_source(s: SparkSession, d: str) -> DataFrame:
    p = evaluate.scored(table(s, d, "predictions"))
    return p.select("pred_id", "id", "exact_match")


def _stub():
    """An answerer without a model: knows one kind of question, fails on none at all, turns the others round."""

    def answer(image, question):
        if not question:
            raise ValueError("no question")
        return "4" if "bao nhiêu chiếc xe" in question else question[::-1]

    return answer


def batch_infer_stub(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "val").select("row_id", "image", F.get("conversations", F.lit(0)).value.alias("question"))
    return infer.batch_infer(q, _stub).select("row_id", "prediction", "error")


def batch_evaluation(s: SparkSession, d: str) -> DataFrame:
    return pipeline.batch_evaluate(table(s, d, "val"), _stub, position="row_id")[0]


def batch_evaluation_file(s: SparkSession, d: str) -> DataFrame:
    """The predictions as read back from the file they were written to."""
    path = scratch(s, "predictions", ".json")
    pipeline.batch_evaluate(table(s, d, "val"), _stub, path, position="row_id")
    return s.read.schema(schemas.PREDICTION).option("multiLine", True).json(path)


def model_evaluation(s: SparkSession, d: str) -> DataFrame:
    """The report over the first 100 records, as read back from its file, one row a result."""
    path = scratch(s, "report", ".json")
    pipeline.evaluate_model(table(s, d, "val"), _stub, "checkpoint-500", output=path)
    report = s.read.schema("checkpoint string, num_samples bigint, exact_match double, results array<struct<id string, question string, ground_truth string, prediction string, exact_match boolean>>").option("multiLine", True).json(path)
    return report.select("checkpoint", "num_samples", F.round("exact_match", 6).alias("exact_match_pct"), F.posexplode("results").alias("pos", "r")).select("checkpoint", "num_samples", "exact_match_pct", F.col("pos").cast("bigint").alias("pos"), "r.id", "r.question", "r.ground_truth", "r.prediction", "r.exact_match")


def eval_report(s: SparkSession, d: str) -> DataFrame:
    """The evaluation report, one row a result."""
    r = evaluate.eval_report(evaluate.scored(table(s, d, "predictions"), with_similarity=True), "checkpoint-500")
    return r.select("checkpoint", "num_samples", *(F.round(c, 6).alias(c + "_pct") for c in ("exact_match", "avg_similarity")), F.explode("results").alias("r")).select("checkpoint", "num_samples", "exact_match_pct", "avg_similarity_pct", "r.pred_id", "r.id", "r.exact_match", "r.similarity")


def similarity_eval(s: SparkSession, d: str) -> DataFrame:
    r = evaluate.similarity_report(evaluate.scored(table(s, d, "predictions"), with_similarity=True))
    return r.withColumn("avg_similarity_pct", F.round("avg_similarity_pct", 6))


def _flat_records(df: DataFrame) -> DataFrame:
    at = lambda i, f: F.get("conversations", F.lit(i))[f]
    return df.select("id", "image", at(0, "from").alias("from_0"), at(0, "value").alias("value_0"), at(1, "from").alias("from_1"), at(1, "value").alias("value_1"))


def records_round_trip(s: SparkSession, d: str) -> DataFrame:
    """The training records as read back from JSON Lines."""
    path = scratch(s, "records", ".jsonl")
    sinks.write_json_lines(table(s, d, "train").select("id", "image", "conversations"), path)
    return _flat_records(sources.records(s, path))


def records_array_round_trip(s: SparkSession, d: str) -> DataFrame:
    """The evaluation records as read back from one JSON array."""
    path = scratch(s, "records", ".json")
    sinks.write_json_array(table(s, d, "val").select("id", "image", "conversations"), path)
    return _flat_records(sources.records(s, path))


def images_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Pictures as stored and read back: name and bytes."""
    folder = scratch(s, "images")
    sinks.write_images(table(s, d, "dataset"), folder.removeprefix("file://").removeprefix("file:"), encoder=bytes).agg(F.count_if("image_ok")).collect()
    return sources.images(s, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.length("content").cast("bigint").alias("n_bytes"))


def prepared_once(s: SparkSession, d: str) -> DataFrame:
    """Both record files prepared twice: the second time they are there."""
    folder = scratch(s, "prepared")
    files = {n: table(s, d, n).select("id", "image", "conversations") for n in ("train", "val")}
    runs = [(i, *(r := sinks.prepare_once(files, folder)).values()) for i in range(2) for _ in (0,)]
    return s.createDataFrame(runs, "run bigint, train bigint, val bigint, status string")


def listed_checkpoints(s: SparkSession, d: str) -> DataFrame:
    counts = {"train": table(s, d, "train"), "val": table(s, d, "val"), "images": table(s, d, "dataset").where(F.col("image").isNotNull()).select("id")}
    r = checkpoints.status_report(counts, s.createDataFrame([(n,) for n in CHECKPOINT_NAMES], "name string"))
    return r.select("train", "val", "images", F.array_join("checkpoints", ",").alias("checkpoints"))


QUERIES: dict[str, Query] = {
    "qa_pairs": qa_pairs,
    "qa_pairs_drop_empty": qa_pairs_drop_empty,
    "qa_pairs_nested": lambda s, d: dialogue.qa_pairs_nested(nested(s, d)),
    "turns_exploded": lambda s, d: dialogue.explode_turns(nested(s, d)).groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"), F.count("content").alias("n_contents")),
    "items_with_dialogue": lambda s, d: table(s, d, "dataset").join(_turns(s, d).select(F.col("conv_id").alias("id")).distinct(), "id", "left_semi").agg(F.count("*").alias("n_items")),
    "pair_count_variants": pair_count_variants,
    "turn_stats": lambda s, d: stats.turn_stats(_turns(s, d)),
    "qa_length_stats": lambda s, d: stats.qa_length_stats(_turns(s, d)),
    "pairs_per_item_hist": lambda s, d: stats.pairs_histogram(_turns(s, d)),
    "question_length_hist50": _positional_hist("question"),
    "answer_length_hist50": _positional_hist("answer"),
    "description_length_stats": lambda s, d: stats.length_stats(table(s, d, "dataset"), "description"),
    "description_length_shown": lambda s, d: stats.length_stats(table(s, d, "dataset"), "description").select(fixed("avg_len", 2).alias("avg_shown"), fixed("avg_len", 1, 9).alias("avg_padded")),
    "description_length_hist50": lambda s, d: stats.equal_width_histogram(table(s, d, "dataset"), F.length("description")),
    "answer_cardinality": lambda s, d: stats.cardinality(stats.assistant_texts(_turns(s, d)), "value"),
    "top20_answers": lambda s, d: stats.top_k(_answers(s, d)),
    "top20_display": lambda s, d: stats.top_k(_answers(s, d)).select("rank", ellipsis("value", 80).alias("shown"), "n"),
    "top_values_lang": lambda s, d: stats.top_k(stats.value_counts(table(s, d, "documents"), "lang", ["doc_id"])),
    "vocab_coverage": lambda s, d: stats.coverage(_answers(s, d).drop("first")),
    "rank_frequency": lambda s, d: stats.rank_frequency(_answers(s, d).drop("first")),
    "training_records": training_records,
    "message_records": message_records,
    "train_val_split": lambda s, d: split.shuffle_split(_sample_ids(s, d)).select("id", "split"),
    "split_summary": lambda s, d: split.split_summary(split.shuffle_split(_sample_ids(s, d))),
    "head_100": lambda s, d: split.head(_pairs(s, d), 100, "conv_id", "turn"),
    "extract_prompt": lambda s, d: evaluate.prompts_by_role(table(s, d, "train").select("row_id", "id", "conversations")),
    "extract_prompt_positional": lambda s, d: evaluate.prompts_by_position(table(s, d, "train")),
    "exact_match_rows": exact_match_by_source,
    "exact_match_eval": lambda s, d: evaluate.exact_match_report(evaluate.scored(table(s, d, "predictions"))),
    "exact_match_requested": lambda s, d: evaluate.exact_match_report(evaluate.scored(table(s, d, "predictions")), "requested"),
    "exact_match_last_per_id": lambda s, d: evaluate.exact_match_report(evaluate.scored(evaluate.best_per_id(table(s, d, "predictions")))),
    "similarity_rows": lambda s, d: evaluate.scored(table(s, d, "predictions"), with_similarity=True).select("pred_id", "similarity"),
    "similarity_eval": similarity_eval,
    "eval_report": eval_report,
    "latest_checkpoint": lambda s, d: checkpoints.latest(s.createDataFrame([(n,) for n in CHECKPOINT_NAMES], "name string")),
    "latest_checkpoint_numeric": lambda s, d: checkpoints.latest(s.createDataFrame([(n,) for n in CHECKPOINT_NAMES], "name string"), numeric=True),
    "status_counts": lambda s, d: checkpoints.status({"train": table(s, d, "train"), "val": table(s, d, "val"), "images": table(s, d, "dataset").where(F.col("image").isNotNull()).select("id"), "predictions": table(s, d, "predictions")}),
    "batch_infer_stub": batch_infer_stub,
    "batch_evaluation": batch_evaluation,
    "batch_evaluation_report": lambda s, d: pipeline.batch_evaluate(table(s, d, "val"), _stub)[1],
    "batch_evaluation_file": batch_evaluation_file,
    "model_evaluation": model_evaluation,
    "records_round_trip": records_round_trip,
    "records_array_round_trip": records_array_round_trip,
    "images_round_trip": images_round_trip,
    "prepared_once": prepared_once,
    "listed_checkpoints": listed_checkpoints,
    "split_selection": lambda s, d: sources.corpus(s, f"{d}/val.parquet", "test").select("row_id", "id", "split"),
    "row_at_7": lambda s, d: sources.row_at(table(s, d, "dataset"), 7, "id").select("id", "description"),
    "pairs_with_image": lambda s, d: dialogue.qa_turns(_conv(s, d).join(dialogue.with_image(table(s, d, "dataset").select(F.col("id").alias("conv_id"), F.col("image").isNotNull().alias("image_ok"))), "conv_id", "left_semi")),
}

_TURNS = """turns AS (SELECT conv_id, turn, role, content FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY loaded_at NULLS LAST, msg_id) AS rn
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) WHERE rn = 1)"""
_PAIRS = """kept AS (SELECT *, lag(CASE WHEN role IN ('user','human') THEN content END) OVER (PARTITION BY conv_id ORDER BY turn) AS question
  FROM turns WHERE role IN ('user','human','assistant','gpt')),
pairs AS (SELECT conv_id, turn, question, content AS answer FROM kept WHERE role IN ('assistant','gpt') AND question IS NOT NULL)"""
_SAMPLES = "samples AS (SELECT conv_id::VARCHAR || '_' || (row_number() OVER (ORDER BY conv_id, turn) - 1)::VARCHAR AS id, * FROM pairs)"
_SIZES = "sizes AS (SELECT conv_id, count(*)::BIGINT AS n_turns, (count(*) // 2)::BIGINT AS n_pairs FROM turns GROUP BY conv_id)"
_POS = """pos AS (SELECT *, CASE WHEN turn % 2 = 0 AND role IN ('user','human') THEN 'question' WHEN turn % 2 = 1 AND role IN ('assistant','gpt') THEN 'answer' END AS kind FROM turns)"""
_ANSWERS = """answers AS (SELECT content AS value, count(*)::BIGINT AS n, min({'c': conv_id, 't': turn}) AS first FROM turns
  WHERE role IN ('assistant','gpt') AND content IS NOT NULL GROUP BY content)"""
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || " + " || ".join(f"chr({c})" for c in [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_SCORED = f"scored AS (SELECT *, trim(prediction, {_WS}) = trim(ground_truth, {_WS}) AS exact_match FROM predictions)"
_REPORT = """SELECT count(*)::BIGINT AS n_requested, count(exact_match)::BIGINT AS n_scored, count(*) FILTER (exact_match)::BIGINT AS n_match,
  coalesce((count(*) FILTER (exact_match))::DOUBLE / nullif({n}, 0) * 100, 0.0) AS exact_match_pct FROM {t}"""


_VALUE = "list_filter(conversations, lambda t: t['from'] = '{r}')[1]['value']"
_ASKED = f"asked AS (SELECT row_id, id, trim(replace(coalesce({_VALUE.format(r='human')}, ''), '<image>' || chr(10), ''), {_WS}) AS question, coalesce({_VALUE.format(r='gpt')}, '') AS ground_truth FROM val)"
_ASKED_AT = "asked AS (SELECT row_id, id, replace(conversations[1]['value'], '<image>' || chr(10), '') AS question, conversations[2]['value'] AS ground_truth FROM val ORDER BY row_id LIMIT 100)"
_ANSWERED = f"answered AS (SELECT *, CASE WHEN coalesce(question, '') = '' THEN NULL WHEN contains(question, 'bao nhiêu chiếc xe') THEN '4' ELSE array_to_string(list_reverse(regexp_split_to_array(question, '')), '') END AS prediction FROM asked)"
_JUDGED = f"scored AS (SELECT *, trim(prediction, {_WS}) = trim(ground_truth, {_WS}) AS exact_match FROM answered)"
_FLAT = "SELECT id, image, conversations[1]['from'] AS from_0, conversations[1]['value'] AS value_0, conversations[2]['from'] AS from_1, conversations[2]['value'] AS value_1 FROM "


# The similarity of two texts as a recursion over segments: the longest common run of two segments (the
# earliest in the first, then in the second) splits them in two. Runs lie on diagonals, which are spelled
# as strings of ones and zeros. (From 200 characters of truth on, frequent characters start no run; that
# rule isn't in the SQL.)
_BEST = """list_max(list_transform(range(blo - ahi + 1, bhi - alo), lambda d: list_extract(list_transform(
  [array_to_string(list_transform(range(greatest(alo, blo - d), least(ahi, bhi - d)), lambda i: CASE WHEN a[i + 1] = b[i + d + 1] THEN '1' ELSE '0' END), '')],
  lambda f: list_extract(list_transform([coalesce(list_max(list_transform(regexp_extract_all(f, '1+'), lambda r: length(r))), 0)],
    lambda k: {'k': k, 'i': -(greatest(alo, blo - d) + strpos(f, repeat('1', k)) - 1), 'j': -(greatest(alo, blo - d) + strpos(f, repeat('1', k)) - 1 + d)}), 1)), 1)))"""
_ALIKE = f"""chars AS (SELECT pred_id, string_split(lower(prediction), '') AS a, string_split(lower(ground_truth), '') AS b FROM predictions WHERE prediction <> '' AND ground_truth <> ''),
seg AS (SELECT pred_id, a, b, 0::BIGINT AS alo, len(a)::BIGINT AS ahi, 0::BIGINT AS blo, len(b)::BIGINT AS bhi, 0::BIGINT AS k FROM chars
UNION ALL
SELECT t.pred_id, t.a, t.b, c.alo, c.ahi, c.blo, c.bhi, c.k FROM (SELECT seg.*, {_BEST} AS m FROM seg WHERE ahi > alo AND bhi > blo) t,
 unnest([{{'alo': alo, 'ahi': -m.i, 'blo': blo, 'bhi': -m.j, 'k': m.k}}, {{'alo': m.k - m.i, 'ahi': ahi, 'blo': m.k - m.j, 'bhi': bhi, 'k': 0}}]) u(c) WHERE m.k > 0),
ratios AS (SELECT pred_id, sum(k)::DOUBLE * 2 / (any_value(len(a)) + any_value(len(b))) AS similarity FROM seg GROUP BY pred_id),
alike AS (SELECT pred_id, CASE WHEN prediction IS NULL OR ground_truth IS NULL THEN NULL WHEN prediction = '' AND ground_truth = '' THEN 1.0 ELSE coalesce(similarity, 0.0) END AS similarity FROM predictions LEFT JOIN ratios USING (pred_id))"""


def _with(*parts: str) -> str:
    return ("WITH RECURSIVE " if _ALIKE in parts else "WITH ") + ",\n".join(parts) + "\n"


def _hist(source: str) -> str:
    return f"""v AS (SELECT length(x)::BIGINT AS v FROM ({source}) WHERE x IS NOT NULL),
b AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5::DOUBLE ELSE min(v)::DOUBLE END AS lo, CASE WHEN min(v) = max(v) THEN max(v) + 0.5::DOUBLE ELSE max(v)::DOUBLE END AS hi FROM v HAVING count(*) > 0),
h AS (SELECT least(floor((v - lo) * 50 / (hi - lo))::BIGINT, 49) AS bin, count(*)::BIGINT AS n FROM v, b GROUP BY 1)
SELECT r.bin::BIGINT AS bin, coalesce(h.n, 0)::BIGINT AS n FROM (SELECT unnest(range(50)) AS bin FROM b) r LEFT JOIN h ON h.bin = r.bin"""


_TOP20 = "SELECT row_number() OVER (ORDER BY n DESC, first)::BIGINT AS rank, {v}, n FROM {t} QUALIFY rank <= 20"

ORACLE: dict[str, str] = {
    "qa_pairs": _with(_TURNS, _PAIRS, _SAMPLES) + "SELECT id, conv_id, turn, question, answer FROM samples",
    "qa_pairs_drop_empty": _with(_TURNS, _PAIRS) + "SELECT * FROM pairs WHERE question <> ''",
    "qa_pairs_nested": _with(_TURNS, _PAIRS) + "SELECT * FROM pairs",
    "turns_exploded": _with(_TURNS) + "SELECT conv_id, count(*)::BIGINT AS n_turns, max(turn)::BIGINT AS last_turn, count(content)::BIGINT AS n_contents FROM turns GROUP BY conv_id",
    "items_with_dialogue": _with(_TURNS) + "SELECT count(*)::BIGINT AS n_items FROM dataset WHERE id IN (SELECT conv_id FROM turns)",
    "pair_count_variants": _with(_TURNS, _PAIRS, _SIZES, _POS) + "SELECT (SELECT sum(n_pairs)::BIGINT FROM sizes) AS floor_pairs, (SELECT count(*)::BIGINT FROM pairs) AS state_machine_pairs, (SELECT count(*)::BIGINT FROM pos WHERE kind = 'question') AS positional_questions, (SELECT count(*)::BIGINT FROM pos WHERE kind = 'answer') AS positional_answers",
    "turn_stats": _with(_TURNS, _SIZES) + "SELECT count(*)::BIGINT AS n_dialogues, avg(n_turns) AS avg_turns, min(n_turns)::BIGINT AS min_turns, max(n_turns)::BIGINT AS max_turns, avg(n_pairs) AS avg_pairs, sum(n_pairs)::BIGINT AS total_pairs FROM sizes",
    "qa_length_stats": _with(_TURNS, _POS) + "SELECT " + ", ".join(f"count(length(content)) FILTER (kind = '{k}')::BIGINT AS n_{k}s, avg(length(content)) FILTER (kind = '{k}') AS avg_{k}_len, min(length(content)) FILTER (kind = '{k}')::BIGINT AS min_{k}_len, max(length(content)) FILTER (kind = '{k}')::BIGINT AS max_{k}_len" for k in ("question", "answer")) + " FROM pos",
    "pairs_per_item_hist": _with(_TURNS, _SIZES) + "SELECT r.bin::BIGINT AS bin, count(s.conv_id)::BIGINT AS n FROM (SELECT unnest(range((SELECT max(n_pairs) + 1 FROM sizes))) AS bin) r LEFT JOIN sizes s ON s.n_pairs = r.bin GROUP BY 1",
    "question_length_hist50": _with(_TURNS, _POS) + ", " + _hist("SELECT content AS x FROM pos WHERE kind = 'question'"),
    "answer_length_hist50": _with(_TURNS, _POS) + ", " + _hist("SELECT content AS x FROM pos WHERE kind = 'answer'"),
    "description_length_stats": "SELECT count(description)::BIGINT AS n, avg(length(description)) AS avg_len, min(length(description))::BIGINT AS min_len, max(length(description))::BIGINT AS max_len FROM dataset",
    "description_length_shown": "SELECT printf('%.2f', avg(length(description))) AS avg_shown, printf('%9.1f', avg(length(description))) AS avg_padded FROM dataset",
    "description_length_hist50": "WITH " + _hist("SELECT description AS x FROM dataset"),
    "answer_cardinality": _with(_TURNS) + "SELECT count(content)::BIGINT AS total, count(DISTINCT content)::BIGINT AS distinct_values FROM turns WHERE role IN ('assistant','gpt')",
    "top20_answers": _with(_TURNS, _ANSWERS) + _TOP20.format(v="value", t="answers"),
    "top20_display": _with(_TURNS, _ANSWERS) + _TOP20.format(v="CASE WHEN length(value) > 80 THEN value[1:80] || '...' ELSE value END AS shown", t="answers"),
    "top_values_lang": "WITH l AS (SELECT lang AS value, count(*)::BIGINT AS n, min(doc_id) AS first FROM documents WHERE lang IS NOT NULL GROUP BY lang) " + _TOP20.format(v="value", t="l"),
    "vocab_coverage": _with(_TURNS, _ANSWERS, "run AS (SELECT row_number() OVER (ORDER BY n DESC) AS k, sum(n) OVER (ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS covered FROM answers)") + "SELECT k::BIGINT AS k, covered::DOUBLE / (SELECT sum(n) FROM answers) * 100 AS pct FROM run WHERE k IN (100, 500, 1000, 2000, 5000, 10000)",
    "rank_frequency": _with(_TURNS, _ANSWERS) + "SELECT row_number() OVER (ORDER BY n DESC)::BIGINT AS rank, n FROM answers QUALIFY rank <= 5000",
    "training_records": _with(_TURNS, _PAIRS, _SAMPLES) + "SELECT id, 'image_' || conv_id::VARCHAR || '.jpg' AS image, 'human' AS from_0, '<image>' || chr(10) || question AS value_0, 'gpt' AS from_1, answer AS value_1 FROM samples",
    "message_records": _with(_TURNS, _PAIRS, _SAMPLES) + "SELECT id, 'images/image_' || conv_id::VARCHAR || '.jpg' AS image, conv_id AS original_index, 'image' AS type_0, question, answer, 'image_' || conv_id::VARCHAR || '.jpg' AS file, '<image>' || chr(10) || question AS prompt, answer AS record_answer FROM samples",
    "train_val_split": _with(_TURNS, _PAIRS, _SAMPLES) + "SELECT id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || id), id) <= floor((SELECT count(*) FROM samples) * 0.9) THEN 'train' ELSE 'val' END AS split FROM samples",
    "split_summary": _with(_TURNS, _PAIRS, _SAMPLES) + ", s AS (SELECT CASE WHEN row_number() OVER (ORDER BY md5('42:' || id), id) <= floor((SELECT count(*) FROM samples) * 0.9) THEN 'train' ELSE 'val' END AS split FROM samples) SELECT split, count(*)::BIGINT AS n, count(*)::DOUBLE / (SELECT count(*) FROM s) * 100 AS pct FROM s GROUP BY split",
    "head_100": _with(_TURNS, _PAIRS) + "SELECT * FROM pairs ORDER BY conv_id, turn LIMIT 100",
    "extract_prompt": f"SELECT id, trim(replace(coalesce(list_filter(conversations, lambda t: t['from'] = 'human')[1]['value'], ''), '<image>' || chr(10), ''), {_WS}) AS question, coalesce(list_filter(conversations, lambda t: t['from'] = 'gpt')[1]['value'], '') AS truth FROM train",
    "extract_prompt_positional": "SELECT id, replace(conversations[1]['value'], '<image>' || chr(10), '') AS question, conversations[2]['value'] AS truth FROM train",
    "exact_match_rows": _with(_SCORED) + "SELECT pred_id, id, exact_match FROM scored",
    "exact_match_eval": _with(_SCORED) + _REPORT.format(n="count(exact_match)", t="scored"),
    "exact_match_requested": _with(_SCORED) + _REPORT.format(n="count(*)", t="scored"),
    "exact_match_last_per_id": _with(_SCORED, "last AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY id ORDER BY scored_at DESC NULLS LAST, pred_id DESC) = 1)") + _REPORT.format(n="count(exact_match)", t="last"),
    "latest_checkpoint": "SELECT max(name) AS name FROM (VALUES " + ", ".join(f"('{n}')" for n in CHECKPOINT_NAMES) + ") v(name) WHERE starts_with(name, 'checkpoint-')",
    "latest_checkpoint_numeric": "SELECT arg_max(name, try_cast(substring(name, 12) AS BIGINT)) AS name FROM (VALUES " + ", ".join(f"('{n}')" for n in CHECKPOINT_NAMES) + ") v(name) WHERE starts_with(name, 'checkpoint-')",
    "batch_infer_stub": _with("asked AS (SELECT row_id, conversations[1]['value'] AS question FROM val)", _ANSWERED) + "SELECT row_id, prediction, CASE WHEN prediction IS NULL THEN 'ValueError: no question' END AS error FROM answered",
    "batch_evaluation": _with(_ASKED, _ANSWERED) + "SELECT row_id, id, question, ground_truth, prediction FROM answered WHERE prediction IS NOT NULL",
    "batch_evaluation_file": _with(_ASKED, _ANSWERED) + "SELECT id, question, ground_truth, prediction FROM answered WHERE prediction IS NOT NULL",
    "batch_evaluation_report": _with(_ASKED, _ANSWERED, _JUDGED) + _REPORT.format(n="count(exact_match)", t="scored"),
    "model_evaluation": _with(_ASKED_AT, _ANSWERED, _JUDGED, "good AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM scored WHERE exact_match IS NOT NULL)") + "SELECT 'checkpoint-500' AS checkpoint, (SELECT count(*) FROM good) AS num_samples, (SELECT round(avg(exact_match::INT) * 100, 6) FROM good) AS exact_match_pct, pos, id, question, ground_truth, prediction, exact_match FROM good WHERE pos < 20",
    "similarity_rows": _with(_ALIKE) + "SELECT pred_id, similarity FROM alike",
    "similarity_eval": _with(_ALIKE) + "SELECT count(similarity) AS n_scored, round(coalesce(avg(similarity) * 100, 0), 6) AS avg_similarity_pct FROM alike",
    "eval_report": _with(_ALIKE, _SCORED, "good AS (SELECT * FROM scored JOIN alike USING (pred_id) WHERE exact_match IS NOT NULL)") + "SELECT 'checkpoint-500' AS checkpoint, (SELECT count(*) FROM good) AS num_samples, (SELECT round(avg(exact_match::INT) * 100, 6) FROM good) AS exact_match_pct, (SELECT round(avg(similarity) * 100, 6) FROM good) AS avg_similarity_pct, pred_id, id, exact_match, similarity FROM good ORDER BY pred_id LIMIT 20",
    "records_round_trip": _FLAT + "train",
    "records_array_round_trip": _FLAT + "val",
    "images_round_trip": "SELECT 'image_' || id || '.jpg' AS name, octet_length(image)::BIGINT AS n_bytes FROM dataset WHERE image IS NOT NULL",
    "prepared_once": "SELECT r::BIGINT AS run, (SELECT count(*) FROM train) AS train, (SELECT count(*) FROM val) AS val, s AS status FROM (VALUES (0, 'prepared'), (1, 'cached')) v(r, s)",
    "listed_checkpoints": "SELECT (SELECT count(*) FROM train) AS train, (SELECT count(*) FROM val) AS val, (SELECT count(image) FROM dataset) AS images, (SELECT string_agg(name, ',' ORDER BY name) FROM (VALUES " + ", ".join(f"('{n}')" for n in CHECKPOINT_NAMES) + ") v(name) WHERE starts_with(name, 'checkpoint-')) AS checkpoints",
    "split_selection": "SELECT row_id, id, split FROM val WHERE split = 'test'",
    "row_at_7": "SELECT id, description FROM dataset WHERE id = 7",
    "pairs_with_image": "WITH turns AS (SELECT conv_id, turn, role, content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY loaded_at NULLS LAST, msg_id) AS rn FROM conversations WHERE conv_id IN (SELECT id FROM dataset WHERE image IS NOT NULL) AND turn IS NOT NULL) WHERE rn = 1),\n" + _PAIRS + " SELECT * FROM pairs",
    "status_counts": "SELECT 'train' AS what, count(*)::BIGINT AS n FROM train UNION ALL SELECT 'val', count(*) FROM val UNION ALL SELECT 'images', count(image) FROM dataset UNION ALL SELECT 'predictions', count(*) FROM predictions",
}
