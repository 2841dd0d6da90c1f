"""Queries that judge, score, calibrate and summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import metrics as m
from ..operators.aggregate import endpoint_load, grid_summary
from ..sources.tables import read
from . import sql as s

PREDICTION = ["test_row_id", "dataset", "method", "seed", "true_label", "pred_label"]
LEXICON = ["garden", "office", "lantern", "invoice", "passport"]


def _ruled(spark: SparkSession, d: str, words: list[str]) -> DataFrame:
    rows = read(spark, d, "test", "row_id", "dataset", "text", "label").filter(F.col("label").isin(*t.LABELS) & F.col("text").isNotNull())
    pred = F.when(t.has_word(F.col("text"), words), t.LABELS[1]).otherwise(t.LABELS[0])
    return rows.select("row_id", "dataset", F.col("label").alias("true_label"), pred.alias("pred_label"))


def rule_judge_predictions(spark: SparkSession, d: str) -> DataFrame:
    return _ruled(spark, d, t.FIRST_PERSON).withColumn("correct", F.col("true_label") == F.col("pred_label"))


def rule_judge_metrics(spark: SparkSession, d: str) -> DataFrame:
    return m.judged(_ruled(spark, d, t.FIRST_PERSON), ["dataset"])


def lexicon_judge_metrics(spark: SparkSession, d: str) -> DataFrame:
    return m.judged(_ruled(spark, d, LEXICON), ["dataset"])


def aux_first_person(spark: SparkSession, d: str) -> DataFrame:
    """The narrower flag of the trainer, as 0 or 1."""
    flag = t.has_word(F.col("text"), t.FIRST_PERSON_SINGULAR).cast("int")
    return read(spark, d, "train", "row_id", "text").filter("text is not null").select("row_id", flag.alias("aux"))


def strict_label_parse(spark: SparkSession, d: str) -> DataFrame:
    label = t.strict_label(F.col("raw_response"))
    rows = read(spark, d, "judge_predictions", "method", "raw_response").withColumn("label", F.coalesce(label, F.lit(t.PARSE_FAILED)))
    return rows.groupBy("method", "raw_response", "label").agg(F.count(F.lit(1)).alias("n"))


def judge_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per run of a judge; repeated rows count once, rows without a valid true label don't count."""
    rows = read(spark, d, "judge_predictions", *PREDICTION).distinct().filter(F.col("true_label").isin(*t.LABELS))
    return m.judged(rows, ["dataset", "method", "seed"])


def macro_f1_observed(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "judge_predictions", *PREDICTION).distinct().filter(F.col("true_label").isin(*t.LABELS) & F.col("pred_label").isin(*t.LABELS))
    score = m.macro_f1_observed(F.col("true_label"), F.col("pred_label"))
    return rows.groupBy("dataset", "method", "seed").agg(F.round(score, 9).alias("macro_f1"))


def judge_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Calls and mean attempts by outcome."""
    rows = read(spark, d, "judge_predictions", "method", "parse_failed", "attempts")
    return rows.groupBy("method", "parse_failed").agg(F.count("attempts").alias("calls"), F.sum("attempts").alias("attempts"), F.round(F.avg("attempts"), 9).alias("mean_attempts"))


def support_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Examples of each label that judges were shown."""
    rows = read(spark, d, "judge_predictions", "method", "support").select("method", F.explode("support").alias("s"))
    return rows.groupBy("method", F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _logits(spark: SparkSession, d: str, name: str) -> DataFrame:
    z = (F.pmod(F.col("row_id") * 7919, F.lit(1000)) - 500) / 100.0
    rows = read(spark, d, name, "row_id", "dataset", "label").filter(F.col("label").isin(*t.LABELS))
    shift = F.when(F.col("label") == t.LABELS[1], 1.5).otherwise(-1.5)
    return rows.withColumn("logits", F.array(F.lit(0.0), z + shift))


def softmax_margin(spark: SparkSession, d: str) -> DataFrame:
    rows = _logits(spark, d, "valid").withColumn("probs", m.softmax(F.col("logits")))
    return rows.select("row_id", F.round(F.get("probs", F.lit(1)), 9).alias("p1"), F.round(m.margin(F.col("probs")), 9).alias("margin"), m.argmax(F.col("logits")).alias("pred"))


def _scores(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A score in thousandths, so that equal scores are common."""
    score = F.pmod(F.col("row_id") * 7919, F.lit(1000)) / 2000.0 + F.when(F.col("label") == t.LABELS[1], 0.25).otherwise(0.0)
    rows = read(spark, d, name, "row_id", "dataset", "label").filter(F.col("label").isin(*t.LABELS))
    return rows.select("row_id", "dataset", "label", score.alias("score"), (F.col("label") == t.LABELS[1]).alias("positive"))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    swept = m.threshold_sweep(_scores(spark, d, "valid"), ["dataset"])
    return swept.select("dataset", F.round("threshold", 9).alias("threshold"), F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    best = m.best_threshold(_scores(spark, d, "valid"), ["dataset"])
    return best.select("dataset", F.round("threshold", 9).alias("threshold"), F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


def calibrated_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Test metrics at the thresholds found on the validation split."""
    best = m.best_threshold(_scores(spark, d, "valid"), ["dataset"]).select("dataset", "threshold")
    rows = _scores(spark, d, "test").join(best, "dataset")
    pred = F.when(F.col("score") >= F.col("threshold"), t.LABELS[1]).otherwise(t.LABELS[0])
    return m.judged(rows.select("dataset", F.col("label").alias("true_label"), pred.alias("pred_label")), ["dataset"])


def early_stop_replay(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a method in order of finishing, as if they were epochs with a patience of one."""
    rows = read(spark, d, "run_results", "dataset", "method", "seed", "accuracy", "finished_at").filter("accuracy is not null").distinct()
    rows = rows.groupBy("dataset", "method", "finished_at").agg(F.max("accuracy").alias("accuracy"))
    return m.best_so_far(rows, ["dataset", "method"], "finished_at", "accuracy", 1).select("dataset", "method", "accuracy", F.col("step").cast("bigint").alias("step"), "improved", F.col("waited").cast("bigint").alias("waited"), "stopped")


def failure_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "judge_predictions", "test_row_id", "dataset", "method", "seed", "parse_failed", "correct").groupBy("dataset", "method", "seed", "test_row_id").agg(F.max("parse_failed").alias("failed"), F.max("correct").alias("correct"))
    rows = rows.withColumn("failed", F.coalesce("failed", F.lit(False))).withColumn("accepted", ~F.col("failed"))
    runs = m.failure_runs(rows, ["dataset", "method", "seed"], "test_row_id", "failed", "accepted")
    return runs.groupBy("dataset", "method", "seed").agg(F.max("run").alias("longest"))


def aggregate_summary(spark: SparkSession, d: str) -> DataFrame:
    results = read(spark, d, "run_results", "dataset", "method", "seed", "accuracy", "macro_f1").distinct()
    return grid_summary(results)


def grid_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the grid dataset x method x seed without a usable result."""
    rows = read(spark, d, "run_results", "dataset", "method", "seed", "accuracy")
    axes = [rows.select(c).filter(f"{c} is not null").distinct() for c in ("dataset", "method", "seed")]
    grid = axes[0].crossJoin(axes[1]).crossJoin(axes[2])  # names of runs, a fixed small grid
    done = rows.filter("accuracy is not null").select("dataset", "method", "seed").distinct()
    return grid.join(done, ["dataset", "method", "seed"], "left_anti")


def endpoint_loads(spark: SparkSession, d: str) -> DataFrame:
    """Load sums of a metrics page made of the run table; rows of the named model win over all rows."""
    rows = read(spark, d, "run_results", "method", "dataset", "n_eval").filter("n_eval is not null and method is not null")
    kind = F.when(F.col("dataset") == "spy", "waiting").otherwise("running")
    line = F.concat(F.lit("vllm:num_requests_"), kind, F.lit('{model_name="'), F.col("method"), F.lit('"} '), F.col("n_eval").cast("string"))
    return endpoint_load(rows.select(line.alias("line")), "fewshot")


QUERIES = {f.__name__: f for f in (rule_judge_predictions, rule_judge_metrics, lexicon_judge_metrics, aux_first_person, strict_label_parse, judge_metrics, macro_f1_observed, judge_attempts, support_sizes, softmax_margin, threshold_sweep, best_threshold, calibrated_metrics, early_stop_replay, failure_runs, aggregate_summary, grid_completeness, endpoint_loads)}

_IN = "IN ('Non-sensitive', 'Sensitive')"
_METRICS = f"count(*) AS n_eval, count(*) FILTER (pred_label = '__PARSE_FAILED__') AS parse_failed, round(count(*) FILTER (true_label = pred_label) / count(*), 9) AS accuracy, round({s.macro_f1('true_label', 'pred_label')}, 9) AS macro_f1"
_DISTINCT = f"(SELECT DISTINCT {', '.join(PREDICTION)} FROM judge_predictions WHERE true_label {_IN})"


def _rule(words: list[str]) -> str:
    return f"(SELECT row_id, dataset, label AS true_label, CASE WHEN {s.has_word('text', words)} THEN 'Sensitive' ELSE 'Non-sensitive' END AS pred_label FROM test WHERE label {_IN} AND text IS NOT NULL)"


def _scored(name: str) -> str:
    return f"(SELECT row_id, dataset, label, (row_id * 7919) % 1000 / 2000.0::DOUBLE + CASE WHEN label = 'Sensitive' THEN 0.25 ELSE 0.0 END::DOUBLE AS score FROM {name} WHERE label {_IN})"


_SWEEP = f"""
  s AS (SELECT dataset, label = 'Sensitive' AS pos, score FROM {_scored('valid')}), u AS (SELECT DISTINCT dataset, score FROM s),
  th AS (SELECT dataset, -1e-12::DOUBLE AS threshold FROM u GROUP BY dataset UNION ALL SELECT dataset, (1 + 1e-12)::DOUBLE FROM u GROUP BY dataset
    UNION ALL SELECT * FROM (SELECT dataset, (score + lead(score) OVER (PARTITION BY dataset ORDER BY score)) / 2 AS m FROM u) WHERE m IS NOT NULL),
  c AS (SELECT th.dataset, threshold, count(*) FILTER (pos AND score >= threshold) AS tp, count(*) FILTER (NOT pos AND score >= threshold) AS fp,
    count(*) FILTER (pos AND score < threshold) AS fn, count(*) FILTER (NOT pos AND score < threshold) AS tn FROM th JOIN s ON s.dataset IS NOT DISTINCT FROM th.dataset GROUP BY ALL),
  sw AS (SELECT dataset, threshold, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
    (CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2.0 * tn / (2 * tn + fp + fn) ELSE 0 END)::DOUBLE
    / ((tp + fp + fn > 0)::INT + (tn + fp + fn > 0)::INT) AS macro_f1 FROM c)"""
_BEST = "b AS (SELECT * FROM sw QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY macro_f1 DESC, accuracy DESC, threshold) = 1)"
_ROUNDED = "round(threshold, 9) AS threshold, round(accuracy, 9) AS accuracy, round(macro_f1, 9) AS macro_f1"

SQL = {
    "rule_judge_predictions": f"SELECT *, true_label = pred_label AS correct FROM {_rule(t.FIRST_PERSON)}",
    "rule_judge_metrics": f"SELECT dataset, {_METRICS} FROM {_rule(t.FIRST_PERSON)} GROUP BY dataset",
    "lexicon_judge_metrics": f"SELECT dataset, {_METRICS} FROM {_rule(LEXICON)} GROUP BY dataset",
    "aux_first_person": f"SELECT row_id, {s.has_word('text', t.FIRST_PERSON_SINGULAR)}::INT AS aux FROM train WHERE text IS NOT NULL",
    "strict_label_parse": f"SELECT method, raw_response, CASE WHEN {s.strip('raw_response')} {_IN} THEN {s.strip('raw_response')} ELSE '__PARSE_FAILED__' END AS label, count(*) AS n FROM judge_predictions GROUP BY ALL",
    "judge_metrics": f"SELECT dataset, method, seed, {_METRICS} FROM {_DISTINCT} GROUP BY ALL",
    "macro_f1_observed": f"""
    SELECT dataset, method, seed, round((CASE WHEN a > 0 THEN 2.0 * an / a ELSE 0 END + CASE WHEN b > 0 THEN 2.0 * bn / b ELSE 0 END) / ((a > 0)::INT + (b > 0)::INT), 9) AS macro_f1
    FROM (SELECT dataset, method, seed, count(*) FILTER (true_label = 'Sensitive') + count(*) FILTER (pred_label = 'Sensitive') AS a, count(*) FILTER (true_label = 'Sensitive' AND pred_label = 'Sensitive') AS an,
      count(*) FILTER (true_label = 'Non-sensitive') + count(*) FILTER (pred_label = 'Non-sensitive') AS b, count(*) FILTER (true_label = 'Non-sensitive' AND pred_label = 'Non-sensitive') AS bn
      FROM {_DISTINCT} WHERE pred_label {_IN} GROUP BY ALL)""",
    "judge_attempts": "SELECT method, parse_failed, count(attempts) AS calls, sum(attempts)::BIGINT AS attempts, round(avg(attempts), 9) AS mean_attempts FROM judge_predictions GROUP BY ALL",
    "support_sizes": "SELECT method, s.label AS label, count(*) AS n FROM (SELECT method, unnest(support) AS s FROM judge_predictions) GROUP BY ALL",
    "softmax_margin": f"""
    SELECT row_id, round(1 / (1 + exp(-z)), 9) AS p1, round(abs(2 / (1 + exp(-z)) - 1), 9) AS margin, (z > 0)::INT AS pred
    FROM (SELECT row_id, ((row_id * 7919) % 1000 - 500) / 100.0::DOUBLE + CASE WHEN label = 'Sensitive' THEN 1.5 ELSE -1.5 END::DOUBLE AS z FROM valid WHERE label {_IN})""",
    "threshold_sweep": f"WITH {_SWEEP} SELECT dataset, {_ROUNDED} FROM sw",
    "best_threshold": f"WITH {_SWEEP}, {_BEST} SELECT dataset, {_ROUNDED} FROM b",
    "calibrated_metrics": f"""
    WITH {_SWEEP}, {_BEST}, p AS (SELECT t.dataset, t.label AS true_label, CASE WHEN t.score >= b.threshold THEN 'Sensitive' ELSE 'Non-sensitive' END AS pred_label FROM {_scored('test')} t JOIN b ON t.dataset = b.dataset)
    SELECT dataset, {_METRICS} FROM p GROUP BY dataset""",
    "early_stop_replay": """
    WITH r AS (SELECT dataset, method, finished_at, max(accuracy) AS accuracy FROM run_results WHERE accuracy IS NOT NULL GROUP BY ALL),
    a AS (SELECT *, row_number() OVER w AS step, coalesce(accuracy > max(accuracy) OVER (PARTITION BY dataset, method ORDER BY finished_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM r WINDOW w AS (PARTITION BY dataset, method ORDER BY finished_at)),
    b AS (SELECT *, step - coalesce(max(CASE WHEN improved THEN step END) OVER (PARTITION BY dataset, method ORDER BY finished_at), 0) AS waited FROM a)
    SELECT dataset, method, accuracy, step, improved, waited, max((waited >= 1)::INT) OVER (PARTITION BY dataset, method ORDER BY finished_at) = 1 AS stopped FROM b""",
    "failure_runs": """
    WITH r AS (SELECT dataset, method, seed, test_row_id, coalesce(bool_or(parse_failed), false) AS failed FROM judge_predictions GROUP BY ALL),
    a AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY dataset, method, seed ORDER BY test_row_id) AS island FROM r)
    SELECT dataset, method, seed, max(k)::BIGINT AS longest FROM (SELECT dataset, method, seed, island, sum(failed::INT) AS k FROM a GROUP BY ALL) GROUP BY ALL""",
    "aggregate_summary": """
    WITH r AS (SELECT DISTINCT dataset, method, seed, accuracy * 100 AS a, macro_f1 * 100 AS f FROM run_results),
    g AS (SELECT * FROM (SELECT DISTINCT dataset FROM r WHERE dataset IS NOT NULL), (SELECT DISTINCT method FROM r WHERE method IS NOT NULL))
    SELECT g.dataset, g.method, CASE WHEN g.method IN ('first_person_rule', 'oneshot_judge', 'fewshot_judge') THEN 'direct_judge' ELSE 'trained_classifier' END AS run_type,
      coalesce(string_agg(CASE WHEN a IS NOT NULL THEN seed::VARCHAR END, ' ' ORDER BY seed, a), '') AS seeds, count(a) AS n,
      round(avg(a), 6) AS accuracy_mean, round(CASE WHEN count(a) = 1 THEN 0 ELSE stddev_samp(a) END, 6) AS accuracy_sd,
      round(avg(f), 6) AS macro_f1_mean, round(CASE WHEN count(f) = 1 THEN 0 ELSE stddev_samp(f) END, 6) AS macro_f1_sd
    FROM g LEFT JOIN r ON g.dataset = r.dataset AND g.method = r.method GROUP BY g.dataset, g.method""",
    "grid_completeness": """
    SELECT * FROM (SELECT DISTINCT dataset FROM run_results WHERE dataset IS NOT NULL), (SELECT DISTINCT method FROM run_results WHERE method IS NOT NULL), (SELECT DISTINCT seed FROM run_results WHERE seed IS NOT NULL)
    EXCEPT SELECT dataset, method, seed FROM run_results WHERE accuracy IS NOT NULL""",
    "endpoint_loads": """
    WITH r AS (SELECT CASE WHEN dataset = 'spy' THEN 'waiting' ELSE 'running' END AS kind, method = 'fewshot' AS mine, n_eval FROM run_results WHERE n_eval IS NOT NULL AND method IS NOT NULL)
    SELECT kind, CASE WHEN bool_or(mine) THEN sum(n_eval) FILTER (mine) ELSE sum(n_eval) END::DOUBLE AS load FROM r GROUP BY kind""",
}
