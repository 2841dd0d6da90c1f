"""Queries that draw, allot, enumerate and prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import contexts as c
from ..operators import sampling as sp
from ..operators.draw import seeded
from ..sources.tables import read

SEEDS = [42, 123, 456]
PER_LABEL = 5
TARGET = 2000


def _labelled(spark: SparkSession, d: str, name: str = "train", *columns: str) -> DataFrame:
    return read(spark, d, name, "row_id", "dataset", "label", *columns).filter(F.col("label").isin(*t.LABELS))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d, "train", "text").withColumn("text", t.strip(F.col("text"))).filter("text <> ''")
    return sp.seed_pool(rows, SEEDS, PER_LABEL, ["dataset"])


def seed_pool(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d).select("dataset", "seed", "label", F.col("rank").cast("bigint").alias("rank"), "row_id", "text")


def support_records(spark: SparkSession, d: str) -> DataFrame:
    return c.support_records(_pool(spark, d), ["dataset", "seed"]).select("dataset", "seed", "support_id", "label", "line")


def support_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The records of each label as one text."""
    records = c.support_records(_pool(spark, d), ["dataset", "seed"])
    return records.groupBy("dataset", "seed", "label").agg(c.joined_lines(F.col("line"), F.col("rank")).alias("block"))


def fewshot_examples(spark: SparkSession, d: str) -> DataFrame:
    """The i-th Sensitive and the i-th Non-sensitive example side by side; the shorter list decides."""
    pool = _pool(spark, d)
    sides = [pool.filter(F.col("label") == label).select("dataset", "seed", "rank", F.col("row_id").alias(name)) for label, name in zip(t.LABELS, ("non_sensitive_id", "sensitive_id"), strict=True)]
    return sides[0].join(sides[1], ["dataset", "seed", "rank"]).select("dataset", "seed", F.col("rank").cast("bigint").alias("rank"), "non_sensitive_id", "sensitive_id")


def fewshot_prompts(spark: SparkSession, d: str) -> DataFrame:
    pool = _pool(spark, d)
    lines = pool.groupBy("dataset", "seed").agg(c.joined_lines(F.concat("label", F.lit(": <<<"), "text", F.lit(">>>")), F.struct("rank", "label")).alias("examples"))
    label = F.explode(F.array(*map(F.lit, t.LABELS)))
    return lines.withColumn("label", label).select("dataset", "seed", "label", c.fewshot_prompt(F.col("examples"), F.col("label")).alias("prompt"))


def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A prompt per test text, with the examples of the first seed of its dataset."""
    pool = _pool(spark, d).filter(F.col("seed") == SEEDS[0])
    lines = pool.groupBy("dataset").agg(c.joined_lines(F.concat(F.lit("<<<"), "text", F.lit(">>>: "), "label"), F.struct("label", "rank")).alias("examples"))
    rows = read(spark, d, "test", "row_id", "dataset", "text").filter("text is not null").join(lines, "dataset")
    return rows.select("row_id", F.md5(c.judge_prompt(F.col("examples"), F.col("text")).cast("binary")).alias("prompt_md5"))


def stratified_sample_judge(spark: SparkSession, d: str) -> DataFrame:
    return sp.stratified(_labelled(spark, d, "test"), 50, 42, ["dataset"], trim=False).select("dataset", "label", "row_id")


def stratified_sample_trainer(spark: SparkSession, d: str) -> DataFrame:
    return sp.stratified(_labelled(spark, d, "valid"), 30, 7, ["dataset"], trim=True).select("dataset", "label", "row_id")


def train_valid_split(spark: SparkSession, d: str) -> DataFrame:
    return sp.train_valid_split(_labelled(spark, d), 0.1, 42, ["dataset"]).select("row_id", "dataset", "part")


def balanced_targets(spark: SparkSession, d: str) -> DataFrame:
    """Rows wanted per label of each method and dataset, and rows there."""
    rows = read(spark, d, "synthetic_data", "dataset", "_method", "label")
    grid = rows.select("dataset", "_method").distinct().select("dataset", "_method", F.posexplode(F.array(F.lit("Sensitive"), F.lit("Non-sensitive"))).alias("i", "label"))
    there = rows.groupBy("dataset", "_method", "label").agg(F.count(F.lit(1)).alias("n"))
    same = [F.col(f"g.{x}").eqNullSafe(F.col(f"h.{x}")) for x in ("dataset", "_method", "label")]
    target = sp.balanced(2, F.col("i"), F.lit(TARGET + 1))
    joined = grid.alias("g").join(there.alias("h"), same, "left").select("g.dataset", "g._method", "g.label", target.alias("target"), F.coalesce("h.n", F.lit(0)).alias("present"))
    return joined.withColumn("missing", F.greatest(F.col("target") - F.col("present"), F.lit(0).cast("bigint"))).withColumn("overfull", F.col("present") > F.col("target"))


def rubric_quota(spark: SparkSession, d: str) -> DataFrame:
    """Pairs wanted per rubric, pairs accepted, what is missing, and the attempts that leaves."""
    rows = read(spark, d, "synthetic_data", "_rubric_id", "_pair_id", "_pair_role").filter("_rubric_id is not null")
    done = rows.groupBy("_rubric_id").agg(F.count_distinct(F.when(F.col("_pair_role") == "Sensitive", F.col("_pair_id"))).alias("accepted"))
    one = Window.partitionBy()  # a row per rubric: tens
    placed = done.withColumn("i", F.row_number().over(one.orderBy("_rubric_id")) - 1).withColumn("k", F.count(F.lit(1)).over(one))
    base = F.floor(F.lit(TARGET) / F.col("k")) + (F.col("i") < F.lit(TARGET) % F.col("k")).cast("bigint")
    quota = placed.select("_rubric_id", base.alias("quota"), "accepted")
    missing = F.greatest(F.col("quota") - F.col("accepted"), F.lit(0).cast("bigint"))
    return quota.withColumn("missing", missing).withColumn("attempts", F.col("missing") * 5)


def pending_queue(spark: SparkSession, d: str) -> DataFrame:
    """One work item per missing pair and rubric, in seeded order within the queue's first round."""
    lacking = rubric_quota(spark, d).filter("missing > 0")
    items = lacking.select("_rubric_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("missing"))).alias("item"))
    return items.withColumn("position", seeded(42, "_rubric_id", "item"))


def rubric_contexts(spark: SparkSession, d: str) -> DataFrame:
    return c.rubric_contexts(c.support_records(_pool(spark, d), ["dataset", "seed"]), ["dataset", "seed"], 25, 42)


def adaptive_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of one example per label, from the first example of each label alone: fewer than the calls."""
    few = _pool(spark, d).filter("rank <= 2")
    return c.rubric_contexts(c.support_records(few, ["dataset", "seed"]), ["dataset", "seed"], 7, 42, size=1)


def fullshot_contexts(spark: SparkSession, d: str) -> DataFrame:
    """All records in every context."""
    records = c.support_records(_pool(spark, d), ["dataset", "seed"])
    ids = [F.array_sort(F.collect_list(F.when(F.col("label") == label, F.col("support_id")))).alias(name) for label, name in ((t.LABELS[1], "positive_ids"), (t.LABELS[0], "negative_ids"))]
    per = records.groupBy("dataset", "seed").agg(*ids)
    return per.select("dataset", "seed", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("context_index"), "positive_ids", "negative_ids")


def duplicate_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The seed pool repeated in turn to the wanted size."""
    pool = _pool(spark, d).withColumn("place", F.concat("label", F.lpad(F.col("rank").cast("string"), 3, "0")))
    return sp.cyclic(pool.select("dataset", "seed", "place", "row_id", "label"), ["dataset", "seed"], "place", 203).select("dataset", "seed", "index", "row_id", "label")


def run_plan_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the grid dealt out to two devices in turn."""
    runs = read(spark, d, "run_results", "dataset", "method", "seed").filter("dataset is not null and method is not null and seed is not null").distinct()
    at = F.row_number().over(Window.partitionBy().orderBy("dataset", "method", "seed")) - 1  # a row per run
    return runs.select((at % 2).cast("bigint").alias("gpu"), "dataset", "method", "seed")


def instruction_demonstrations(spark: SparkSession, d: str) -> DataFrame:
    """Per dataset up to six instructions of the first prompt and up to two others, in seeded order."""
    rows = read(spark, d, "synthetic_data", "dataset", "_instruction").filter("_instruction is not null and dataset is not null").distinct()
    marked = rows.withColumn("human", F.length("_instruction") % 2 == 0)
    picked = sp.ranked(marked, ["dataset", "human"], 42, ["_instruction"], 6)
    return picked.filter("human or rank <= 2").select("dataset", "_instruction", "human")


def label_interleave(spark: SparkSession, d: str) -> DataFrame:
    """Missing rows of each label in turn, Non-sensitive first: the schedule of a batch."""
    lacking = balanced_targets(spark, d).filter("missing > 0 and dataset is not null and _method is not null").select("dataset", "_method", "label", F.least("missing", F.lit(4).cast("bigint")).alias("k"))
    slots = lacking.select("dataset", "_method", "label", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("k"))).alias("turn"))
    at = F.row_number().over(Window.partitionBy("dataset", "_method").orderBy("turn", "label"))
    return slots.select("dataset", "_method", "label", at.cast("bigint").alias("position"))


def id_formats(spark: SparkSession, d: str) -> DataFrame:
    """Running pair ids per dataset over accepted pairs."""
    pairs = read(spark, d, "synthetic_data", "dataset", "_pair_id").filter("_pair_id is not null and dataset is not null").groupBy("dataset", "_pair_id").agg(F.count(F.lit(1)).alias("rows"))
    counts = pairs.groupBy("dataset").agg(F.count(F.lit(1)).alias("pairs"), F.sum("rows").alias("rows"))
    return counts.select("dataset", F.concat("dataset", F.lit("_pair"), F.lpad(F.col("pairs").cast("string"), 6, "0")).alias("next_id"), "pairs", "rows")


QUERIES = {f.__name__: f for f in (seed_pool, support_records, support_blocks, fewshot_examples, fewshot_prompts, judge_prompts, stratified_sample_judge, stratified_sample_trainer, train_valid_split, balanced_targets, rubric_quota, pending_queue, rubric_contexts, adaptive_contexts, fullshot_contexts, duplicate_baseline, run_plan_round_robin, instruction_demonstrations, label_interleave, id_formats)}

from . import sql as s  # noqa: E402

_IN = "label IN ('Non-sensitive', 'Sensitive')"
_POOL = f"""
  p0 AS (SELECT row_id, dataset, label, {s.strip('text')} AS text FROM train WHERE {_IN}),
  pool AS (SELECT dataset, seed, label, row_id, text, row_number() OVER (PARTITION BY seed, dataset, label ORDER BY md5(seed || ':' || row_id), row_id) AS rank
    FROM p0, (SELECT unnest([42, 123, 456]) AS seed) WHERE text <> '' QUALIFY rank <= 5),
  rec AS (SELECT dataset, seed, label, rank, (CASE WHEN label = 'Sensitive' THEN 'S' ELSE 'N' END) || rank AS support_id, text FROM pool),
  lines AS (SELECT dataset, seed, support_id, label, rank, support_id || ': <<<' || {s.strip("replace(replace(text, '<<<', ''), '>>>', '')")} || '>>>' AS line FROM rec)"""
_FEW = "Write one new text with the label {label} in the manner of these examples, between <<< and >>>.\n\n"
_JUDGE = "Decide for one text whether it is Sensitive or Non-sensitive.\nAnswer with one of these two labels and nothing else.\n\n"


def _stratified(name: str, size: int, seed: int, trim: bool) -> str:
    cut = "- (base > 1 AND down <= -missing)::INT" if trim else ""
    return f"""
    WITH r AS (SELECT dataset, label, row_id FROM {name} WHERE {_IN}), n AS (SELECT dataset, label, count(*) AS n FROM r GROUP BY ALL),
    a AS (SELECT *, sum(n) OVER w AS total, count(*) OVER w AS labels, {size}.0::DOUBLE * n / sum(n) OVER w AS exact FROM n WINDOW w AS (PARTITION BY dataset)),
    b AS (SELECT *, exact - trunc(exact) AS rest, least(CASE WHEN trunc(exact) = 0 AND {size} >= labels THEN 1 ELSE trunc(exact) END, n) AS base FROM a),
    c AS (SELECT *, {size} - sum(base) OVER (PARTITION BY dataset) AS missing, sum((base < n)::INT) OVER (PARTITION BY dataset ORDER BY rest DESC, label DESC) AS up, sum((base > 1)::INT) OVER (PARTITION BY dataset ORDER BY rest, label) AS down FROM b),
    q AS (SELECT dataset, label, CASE WHEN total <= {size} THEN n ELSE base + (base < n AND up <= missing)::INT {cut} END AS quota FROM c)
    SELECT r.dataset, r.label, r.row_id FROM r JOIN q ON q.dataset = r.dataset AND q.label = r.label
    QUALIFY row_number() OVER (PARTITION BY r.dataset, r.label ORDER BY md5('{seed}:' || row_id)) <= quota"""


def _contexts(records: str, size: int, calls: int) -> str:
    def side(label: str, name: str) -> str:
        ids = ", ".join(f"r{i}.support_id" for i in range(size))
        tables = ", ".join(f"{records} r{i}" for i in range(size))
        same = " AND ".join([f"r0.label = '{label}'"] + [f"r{i}.label = '{label}' AND r{i}.dataset = r0.dataset AND r{i}.seed = r0.seed AND r{i - 1}.rank < r{i}.rank" for i in range(1, size)])
        return f"{name} AS (SELECT r0.dataset, r0.seed, [{ids}] AS ids FROM {tables} WHERE {same})"

    return f"""
    {side('Sensitive', 'sp')}, {side('Non-sensitive', 'sn')},
    x AS (SELECT sp.dataset, sp.seed, sp.ids AS p, sn.ids AS n, array_to_string(sp.ids, ',') || ',' || array_to_string(sn.ids, ',') AS k FROM sp JOIN sn ON sp.dataset = sn.dataset AND sp.seed = sn.seed),
    y AS (SELECT *, row_number() OVER (PARTITION BY dataset, seed ORDER BY md5('42:' || k), k) - 1 AS i, count(*) OVER (PARTITION BY dataset, seed) AS c FROM x),
    z AS (SELECT unnest(range(0, {calls})) AS j)
    SELECT dataset, seed, (j + 1)::BIGINT AS context_index, 'R' || lpad((j + 1)::VARCHAR, 3, '0') AS context_id, list_sort(p) AS positive_ids, list_sort(n) AS negative_ids FROM y JOIN z ON z.j % y.c = y.i"""


_BALANCED = """
  r AS (SELECT dataset, _method, label FROM synthetic_data), g AS (SELECT DISTINCT dataset, _method, l.label, l.target FROM r, (VALUES ('Sensitive', 1001), ('Non-sensitive', 1000)) l(label, target)),
  bt AS (SELECT g.dataset, g._method, g.label, g.target::BIGINT AS target, (SELECT count(*) FROM r WHERE r.dataset IS NOT DISTINCT FROM g.dataset AND r._method IS NOT DISTINCT FROM g._method AND r.label = g.label) AS present FROM g),
  b AS (SELECT *, greatest(target - present, 0) AS missing, present > target AS overfull FROM bt)"""
_QUOTA = """
  a AS (SELECT _rubric_id, count(DISTINCT _pair_id) FILTER (_pair_role = 'Sensitive') AS accepted FROM synthetic_data WHERE _rubric_id IS NOT NULL GROUP BY 1),
  b AS (SELECT *, row_number() OVER (ORDER BY _rubric_id) - 1 AS i, count(*) OVER () AS k FROM a),
  q AS (SELECT _rubric_id, 2000 // k + (i < 2000 % k)::INT AS quota, accepted FROM b), rq AS (SELECT *, greatest(quota - accepted, 0) AS missing, greatest(quota - accepted, 0) * 5 AS attempts FROM q)"""

SQL = {
    "seed_pool": f"WITH {_POOL} SELECT dataset, seed, label, rank, row_id, text FROM pool",
    "support_records": f"WITH {_POOL} SELECT dataset, seed, support_id, label, line FROM lines",
    "support_blocks": f"WITH {_POOL} SELECT dataset, seed, label, string_agg(line, chr(10) ORDER BY rank) AS block FROM lines GROUP BY ALL",
    "fewshot_examples": f"WITH {_POOL} SELECT n.dataset, n.seed, n.rank, n.row_id AS non_sensitive_id, s.row_id AS sensitive_id FROM pool n JOIN pool s ON n.dataset = s.dataset AND n.seed = s.seed AND n.rank = s.rank WHERE n.label = 'Non-sensitive' AND s.label = 'Sensitive'",
    "fewshot_prompts": f"""
    WITH {_POOL}, e AS (SELECT dataset, seed, string_agg(label || ': <<<' || text || '>>>', chr(10) ORDER BY rank, label) AS ex FROM pool GROUP BY ALL)
    SELECT dataset, seed, label, replace({s.quoted(_FEW)}, '{{label}}', label) || ex || chr(10) || chr(10) || label || ': <<<' AS prompt FROM e, (SELECT unnest(['Sensitive', 'Non-sensitive']) AS label) WHERE dataset IS NOT DISTINCT FROM dataset""",
    "judge_prompts": f"""
    WITH {_POOL}, e AS (SELECT dataset, string_agg('<<<' || text || '>>>: ' || label, chr(10) ORDER BY label, rank) AS ex FROM pool WHERE seed = 42 GROUP BY ALL)
    SELECT t.row_id, md5({s.quoted(_JUDGE)} || ex || chr(10) || chr(10) || '<<<' || t.text || '>>>:') AS prompt_md5 FROM test t JOIN e ON e.dataset = t.dataset WHERE t.text IS NOT NULL""",
    "stratified_sample_judge": _stratified("test", 50, 42, False),
    "stratified_sample_trainer": _stratified("valid", 30, 7, True),
    "train_valid_split": f"""
    SELECT row_id, dataset, CASE WHEN dataset IS NOT NULL AND row_number() OVER (PARTITION BY dataset ORDER BY md5('42:' || row_id)) <= trunc(count(*) OVER (PARTITION BY dataset) * 0.1::DOUBLE) THEN 'valid' ELSE 'train' END AS part FROM train WHERE {_IN}""",
    "balanced_targets": f"WITH {_BALANCED} SELECT * FROM b",
    "rubric_quota": f"WITH {_QUOTA} SELECT * FROM rq",
    "pending_queue": f"WITH {_QUOTA}, i AS (SELECT _rubric_id, unnest(range(1, missing + 1)) AS item FROM rq WHERE missing > 0) SELECT _rubric_id, item, md5('42:' || _rubric_id || ':' || item) AS position FROM i",
    "rubric_contexts": f"WITH {_POOL}, {_contexts('rec', 3, 25)}",
    "adaptive_contexts": f"WITH {_POOL}, rec2 AS (SELECT * FROM rec WHERE rank <= 2), {_contexts('rec2', 1, 7)}",
    "fullshot_contexts": f"""
    WITH {_POOL} SELECT dataset, seed, context_index, coalesce(list_sort(list(support_id) FILTER (label = 'Sensitive')), []) AS positive_ids, coalesce(list_sort(list(support_id) FILTER (label = 'Non-sensitive')), []) AS negative_ids
    FROM rec, (SELECT unnest(range(1, 4)) AS context_index) GROUP BY ALL""",
    "duplicate_baseline": f"""
    WITH {_POOL}, o AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY dataset, seed) AS c FROM pool WINDOW w AS (PARTITION BY dataset, seed ORDER BY label || lpad(rank::VARCHAR, 3, '0')))
    SELECT dataset, seed, j AS index, row_id, label FROM o JOIN (SELECT unnest(range(0, 203)) AS j) ON j % c = i""",
    "run_plan_round_robin": """
    SELECT (row_number() OVER (ORDER BY dataset, method, seed) - 1) % 2 AS gpu, dataset, method, seed
    FROM (SELECT DISTINCT dataset, method, seed FROM run_results WHERE dataset IS NOT NULL AND method IS NOT NULL AND seed IS NOT NULL)""",
    "instruction_demonstrations": """
    WITH r AS (SELECT DISTINCT dataset, _instruction, length(_instruction) % 2 = 0 AS human FROM synthetic_data WHERE _instruction IS NOT NULL AND dataset IS NOT NULL)
    SELECT dataset, _instruction, human FROM r QUALIFY row_number() OVER (PARTITION BY dataset, human ORDER BY md5('42:' || _instruction), _instruction) <= CASE WHEN human THEN 6 ELSE 2 END""",
    "label_interleave": f"""
    WITH {_BALANCED}, k AS (SELECT dataset, _method, label, unnest(range(1, least(missing, 4) + 1)) AS turn FROM b WHERE missing > 0 AND dataset IS NOT NULL AND _method IS NOT NULL)
    SELECT dataset, _method, label, row_number() OVER (PARTITION BY dataset, _method ORDER BY turn, label) AS position FROM k""",
    "id_formats": """
    SELECT dataset, dataset || '_pair' || lpad(count(DISTINCT _pair_id)::VARCHAR, 6, '0') AS next_id, count(DISTINCT _pair_id) AS pairs, count(*) AS rows
    FROM synthetic_data WHERE _pair_id IS NOT NULL AND dataset IS NOT NULL GROUP BY dataset""",
}
