"""Queries that number, merge and rate generated rows, and refuse contrastive pairs by every gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..functions import text as t
from ..operators import curate, merge
from ..operators.sampling import seed_pool
from ..sources.tables import read
from . import sql as s
from .curation_queries import _CARD, _INCOMPLETE, _PAIR_ROWS, CONTRASTIVE, INSTRUCT, _clean, _norm, _pairs

# Prompts whose runs may be resumed, as the rows name them.
PROMPTS = {CONTRASTIVE: "pair_v3", INSTRUCT: "inst_v2"}
#: Reasons of a verdict that count as refusal, and as no verdict, where none but the reason is kept.
REFUSING, UNREADABLE = "accepted after a second look", "no copy of the seeds"
SEED_ROUGE = 0.95


def item_ids(spark: SparkSession, d: str) -> DataFrame:
    """Running ids of the instruct rows, by dataset and label, in order of arrival."""
    rows = read(spark, d, "synthetic_data", "row_id", "dataset", "label", "_method").filter((F.col("_method") == INSTRUCT) & F.col("dataset").isNotNull() & F.col("label").isin(*t.LABELS))
    numbered = merge.running_numbers(rows, ["dataset", "label"], "row_id")
    return numbered.select("row_id", merge.numbered_id(F.concat("dataset", F.lit("_"), "label", F.lit("_")), F.col("number")).alias("item_id"))


def pair_ids(spark: SparkSession, d: str) -> DataFrame:
    """Running ids of the complete pairs of a dataset, in order of arrival."""
    numbered = merge.running_numbers(_pairs(spark, d).select("dataset", "_pair_id", "row_id"), ["dataset"], "row_id")
    return numbered.select("dataset", "_pair_id", merge.numbered_id(F.concat("dataset", F.lit("_pair")), F.col("number")).alias("pair_id"))


def zipped_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Test rows side by side with the verdicts of the rule on them; every row has one."""
    rows = read(spark, d, "test", "row_id", "dataset", "label").filter(F.col("label").isin(*t.LABELS))
    texts = read(spark, d, "test", "row_id", "text", "label").filter(F.col("label").isin(*t.LABELS))
    hit = F.coalesce(t.has_word(F.col("text"), t.FIRST_PERSON), F.lit(False))
    both = merge.zipped(rows, texts.select("row_id", F.when(hit, t.LABELS[1]).otherwise(t.LABELS[0]).alias("pred_label")), "row_id")
    return both.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("pred_label")).alias("correct"))


def _first_cards(rows: DataFrame) -> DataFrame:
    """Each rubric as its first complete row tells it."""
    return rows.groupBy("_rubric_id").agg(F.min(F.struct("row_id", "batch_no", "_rubric_context_index", *_CARD[:2])).alias("r")).select("_rubric_id", "r.*")


def rubric_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rubrics of later batches merged into those of the first, which win, in order of context and id."""
    rows = read(spark, d, "synthetic_data", "row_id", "batch_no", "_rubric_id", "_rubric_context_index", *_CARD[:2]).filter("_rubric_id is not null and batch_no is not null")
    existing, new = _first_cards(rows.filter("batch_no = 0")), _first_cards(rows.filter("batch_no > 0"))
    merged = merge.upserted(existing, new, "_rubric_id")
    place = merged.select("_rubric_id", F.coalesce("_rubric_context_index", F.lit(0)).alias("context"), F.col("batch_no").alias("from_batch"), F.col(_CARD[0]).alias("condition"))
    return place.orderBy("context", "_rubric_id")


def string_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of strings read from values that are lists, single strings or neither."""
    listed, single = F.to_json(F.struct(F.col(_CARD[2]).alias("v"))), F.to_json(F.struct(F.col(_CARD[0]).alias("v")))
    shape = F.when(F.col("row_id") % 3 == 0, listed).when(F.col("row_id") % 3 == 1, single).otherwise(F.lit('{"v": 5}'))
    rows = read(spark, d, "synthetic_data", "row_id", _CARD[0], _CARD[2]).filter(F.col(_CARD[0]).isNotNull() & F.col(_CARD[2]).isNotNull())
    return rows.select("row_id", F.array_join(parse.string_list(shape, "v"), ",").alias("values"))


def rendered_examples(spark: SparkSession, d: str) -> DataFrame:
    """The seed pool of every dataset as the lines that an instruction prompt shows."""
    rows = read(spark, d, "train", "row_id", "dataset", "label", "text").filter("dataset is not null and text is not null")
    pool = seed_pool(rows, [42], 5, ["dataset"])
    return pool.select("dataset", "label", "rank", F.concat(F.lit("- <<<"), "text", F.lit(">>>")).alias("line"))


def weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    """Mean loss of judge runs as training reports it: the mean of each batch of 16 rows, weighted by its rows."""
    rows = read(spark, d, "judge_predictions", "test_row_id", "dataset", "method", "seed", "true_label", "pred_label").filter(F.col("true_label").isNotNull()).distinct()
    wrong = F.when(F.col("true_label") == F.col("pred_label"), F.lit(0.1)).otherwise(F.lit(2.3))
    batches = rows.groupBy("dataset", "method", "seed", F.floor(F.col("test_row_id") / 16).alias("batch")).agg(F.avg(wrong).alias("loss"), F.count(F.lit(1)).alias("n"))
    return batches.groupBy("dataset", "method", "seed").agg(F.round(F.sum(F.col("loss") * F.col("n")) / F.sum("n"), 9).alias("loss"))


def rates(spark: SparkSession, d: str) -> DataFrame:
    """Completion, acceptance, rubric completion and padding of the contrastive and paraphrase rows of each dataset."""
    rows = read(spark, d, "synthetic_data", "dataset", "_method", "_pair_id", "_pair_role", "_rubric_id", "_retry_count", "text", "seed").filter("dataset is not null")
    pairs = rows.filter((F.col("_method") == CONTRASTIVE) & F.col("_pair_id").isNotNull()).groupBy("dataset", "_pair_id").agg(F.count_distinct("_pair_role").alias("roles"), F.max("_retry_count").alias("retries"), F.max("_rubric_id").alias("rubric"))
    whole = F.col("roles") == 2
    of_rubric = pairs.filter("rubric is not null").groupBy("dataset", "rubric").agg(F.max(whole.cast("int")).alias("any"))
    rubrics = of_rubric.groupBy("dataset").agg(F.round(F.try_divide(F.sum("any"), F.count(F.lit(1))), 9).alias("rubric_completion"))
    attempts = F.sum(F.coalesce("retries", F.lit(0)) + 1)
    of_pairs = pairs.groupBy("dataset").agg(F.round(F.try_divide(F.count_if(whole), F.count(F.lit(1))), 9).alias("completion"), F.round(F.try_divide(F.count_if(whole), attempts), 9).alias("acceptance"))
    again = rows.filter("_method = 'paraphrase' and text is not null").groupBy("dataset", F.md5(F.col("text").cast("binary")).alias("key")).agg(F.count(F.lit(1)).alias("c"))
    padding = again.groupBy("dataset").agg(F.round(F.try_divide(F.sum(F.col("c") - 1), F.sum("c")), 9).alias("padding"))
    return of_pairs.join(rubrics, "dataset", "full").join(padding, "dataset", "full").select("dataset", "completion", "acceptance", "rubric_completion", "padding")


def resume_blockers(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each dataset and run that keep it from being resumed: of another prompt or method, without pair or rubric, of a wrong role."""
    rows = read(spark, d, "synthetic_data", "dataset", "_method", "_prompt_id", "_pair_id", "_rubric_id", "_pair_role", "_item_id").filter("dataset is not null")
    paired = F.col("_method") == CONTRASTIVE
    checks = {
        "wrong_prompt": ~F.coalesce(F.col("_prompt_id") == PROMPTS[CONTRASTIVE], F.lit(False)),
        "no_pair": F.col("_pair_id").isNull(),
        "no_rubric": F.col("_rubric_id").isNull(),
        "bad_role": ~F.coalesce(F.col("_pair_role").isin(*t.LABELS), F.lit(False)),
    }
    counts = [F.count_if(paired & c).alias(n) for n, c in checks.items()]
    foreign = F.col("_item_id").isNotNull() & ~F.coalesce(F.col("_method") == INSTRUCT, F.lit(False))
    kept = F.count_if(paired)
    whole = rows.groupBy("dataset").agg(kept.alias("rows"), *counts, F.count_if(foreign).alias("foreign_method"), (kept % 2 == 1).alias("odd"))
    blocked = F.col("odd") | (F.col("wrong_prompt") + F.col("no_pair") + F.col("no_rubric") + F.col("bad_role") + F.col("foreign_method") > 0)
    return whole.withColumn("resumable", ~blocked)


def gate_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Contrastive pairs of each dataset by the first of all gates that refuses them.

    The gates of the loop in their order: parsing, completeness, the pair's own texts, copies of training texts, copies of
    earlier pairs, likeness to the seed pool, likeness to another pair, the verdict's reading and the verdict. Where rows keep
    only a verdict's reason, one of them stands for an unreadable and one for a refusing verdict.
    """
    pairs = _pairs(spark, d).select("dataset", F.col("row_id").alias("id"), t.clean_pair_text(F.col("sensitive")).alias("a"), t.clean_pair_text(F.col("neutral")).alias("b"), "reason")
    key = lambda c: F.unhex(F.md5(t.normalise(F.col(c)).cast("binary")))
    curate.ensure_checkpoint(spark)
    keyed = pairs.select("*", key("a").alias("ka"), key("b").alias("kb"), (t.incomplete_reason(F.col("a")).isNotNull() | t.incomplete_reason(F.col("b")).isNotNull()).alias("cut")).checkpoint()
    sides = keyed.select("dataset", "id", F.posexplode(F.array(F.struct(F.col("a").alias("text"), F.col("ka").alias("key")), F.struct(F.col("b").alias("text"), F.col("kb").alias("key")))).alias("side", "x")).select("dataset", "id", "side", "x.*").filter("key is not null")
    known = read(spark, d, "train", "text").filter("text is not null").select(key("text").alias("key")).distinct()
    copied = sides.select("id", "key").join(known, "key", "left_semi")
    first = sides.groupBy("dataset", "key").agg(F.min("id").alias("first"))
    seen = sides.select("dataset", "id", "key").join(first, ["dataset", "key"]).filter("first < id")
    rows = read(spark, d, "train", "row_id", "dataset", "label", "text").filter("dataset is not null and text is not null")
    refs = seed_pool(rows, [42], 5, ["dataset"]).select("dataset", F.col("text").alias("ref"))
    near = curate.like_reference(sides.select("dataset", "id", "text"), refs, ["dataset"], SEED_ROUGE)
    tokens = sides.select("dataset", (F.col("id") * 2 + F.col("side")).alias("id"), t.tokens(F.col("text")).alias("tokens"))
    edges = curate.rouge_edges(tokens, ["dataset"], SEED_ROUGE).select(F.floor(F.col("a") / 2).alias("x"), F.floor(F.col("b") / 2).alias("y")).filter("x <> y")
    like = edges.select(F.greatest("x", "y").alias("id"))
    # of the gates that compare with other texts, only the first that refuses a pair counts; texts stay out of the join
    hits = reduce(DataFrame.union, (part.select("id", F.lit(i).alias("hit")) for i, part in enumerate((copied, seen, near, like))))
    own = keyed.select("dataset", "id", (F.col("a").isNull() | F.col("b").isNull()).alias("unread"), "cut", (F.col("ka") == F.col("kb")).alias("equal"), "reason")
    whole = own.join(hits.groupBy("id").agg(F.min("hit").alias("hit")), "id", "left")
    gates = [
        ("pair_parse_failed", F.col("unread")),
        ("incomplete_rejected", F.col("cut")),
        ("pair_duplicate_rejected", F.col("equal")),
        ("seed_copy_rejected", F.col("hit") == 0),
        ("duplicate_rejected", F.col("hit") == 1),
        ("rouge_l_seed_copy_rejected", F.col("hit") == 2),
        ("rouge_l_generated_duplicate_rejected", F.col("hit") == 3),
        ("verifier_parse_failed", F.col("reason").isNull() | (F.col("reason") == UNREADABLE)),
        ("verifier_rejected", F.col("reason") == REFUSING),
    ]
    return whole.groupBy("dataset", F.coalesce(curate.first_failing(gates), F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (item_ids, pair_ids, zipped_predictions, rubric_upsert, string_lists, rendered_examples, weighted_loss, rates, resume_blockers, gate_outcomes)}

def lcs_steps(source: str, name: str) -> str:
    """CTE ``name`` (pid, lcs): longest common subsequences of the token lists (pid, a, b) of ``source``, a row of the table
    at a time: each cell is the greatest of the cells above it so far, and of those left above where tokens match."""
    cell = "list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k + 1], r[k] + CASE WHEN a[i + 1] = b[k] THEN 1 ELSE 0 END)))"
    return f"""{name}_r AS (SELECT pid, a, b, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0::BIGINT) AS r FROM {source}
      UNION ALL SELECT pid, a, b, i + 1, list_prepend(0::BIGINT, list_transform(range(1, len(b) + 1), lambda j: {cell}))::BIGINT[] FROM {name}_r WHERE i < len(a)),
    {name} AS (SELECT pid, r[-1] AS lcs FROM {name}_r WHERE i = len(a))"""


#: the harmonic mean in the order of operations that decides ties at a threshold
_F1 = "CASE WHEN lcs > 0 THEN 2.0::DOUBLE * (lcs::DOUBLE / m) * (lcs::DOUBLE / n) / (lcs::DOUBLE / m + lcs::DOUBLE / n) ELSE 0.0 END"


def pool_sql() -> str:
    """CTE pool (dataset, label, rank, text): the seed pool of seed 42 with five texts per label and dataset."""
    return f"""
    pool AS (SELECT dataset, label, rank, text FROM (SELECT *, row_number() OVER (PARTITION BY dataset, label ORDER BY h, row_id) AS rank FROM (
      SELECT dataset, label, text, row_id, md5('42:' || row_id) AS h FROM train WHERE dataset IS NOT NULL AND text IS NOT NULL AND label IN ('Non-sensitive', 'Sensitive'))) WHERE rank <= 5)"""


SQL = {
    "item_ids": f"""
    SELECT row_id, dataset || '_' || label || '_' || lpad((row_number() OVER (PARTITION BY dataset, label ORDER BY row_id))::VARCHAR, 6, '0') AS item_id
    FROM synthetic_data WHERE _method = '{INSTRUCT}' AND dataset IS NOT NULL AND label IN ('Non-sensitive', 'Sensitive')""",
    "zipped_predictions": f"""
    SELECT dataset, count(*) AS n, count(*) FILTER (label = CASE WHEN coalesce({s.has_word('text', t.FIRST_PERSON)}, false) THEN 'Sensitive' ELSE 'Non-sensitive' END) AS correct
    FROM test WHERE label IN ('Non-sensitive', 'Sensitive') GROUP BY dataset""",
    "rubric_upsert": """
    WITH f AS (SELECT *, batch_no > 0 AS late FROM synthetic_data WHERE _rubric_id IS NOT NULL AND batch_no IS NOT NULL),
    c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY _rubric_id ORDER BY late, row_id) = 1)
    SELECT _rubric_id, coalesce(_rubric_context_index, 0) AS context, batch_no AS from_batch, _sensitive_condition AS condition FROM c""",
    "string_lists": f"""
    SELECT row_id, CASE row_id % 3 WHEN 0 THEN array_to_string(list_filter(list_transform(_support_sensitive, lambda x: {s.strip('x')}), lambda x: x <> ''), ',') WHEN 1 THEN _sensitive_condition ELSE '' END AS values
    FROM synthetic_data WHERE _sensitive_condition IS NOT NULL AND _support_sensitive IS NOT NULL""",
    "weighted_loss": """
    SELECT dataset, method, seed, round(sum(loss * n) / sum(n), 9) AS loss FROM (
      SELECT dataset, method, seed, floor(test_row_id / 16) AS batch, avg(CASE WHEN true_label = pred_label THEN 0.1::DOUBLE ELSE 2.3::DOUBLE END) AS loss, count(*) AS n
      FROM (SELECT DISTINCT test_row_id, dataset, method, seed, true_label, pred_label FROM judge_predictions WHERE true_label IS NOT NULL) GROUP BY ALL) GROUP BY ALL""",
    "rates": f"""
    WITH p AS (SELECT dataset, _pair_id, count(DISTINCT _pair_role) AS roles, max(_retry_count) AS r, max(_rubric_id) AS rubric FROM synthetic_data WHERE _method = '{CONTRASTIVE}' AND _pair_id IS NOT NULL AND dataset IS NOT NULL GROUP BY ALL),
    a AS (SELECT dataset, round(count(*) FILTER (roles = 2) / count(*), 9) AS completion, round(count(*) FILTER (roles = 2) / sum(coalesce(r, 0) + 1), 9) AS acceptance FROM p GROUP BY dataset),
    b AS (SELECT dataset, round(sum(any_) / count(*), 9) AS rubric_completion FROM (SELECT dataset, rubric, max(CASE WHEN roles = 2 THEN 1 ELSE 0 END) AS any_ FROM p WHERE rubric IS NOT NULL GROUP BY ALL) GROUP BY dataset),
    c AS (SELECT dataset, round((count(*) - count(DISTINCT text)) / count(*), 9) AS padding FROM synthetic_data WHERE _method = 'paraphrase' AND text IS NOT NULL AND dataset IS NOT NULL GROUP BY dataset)
    SELECT dataset, completion, acceptance, rubric_completion, padding FROM a FULL JOIN b USING (dataset) FULL JOIN c USING (dataset)""",
    "resume_blockers": f"""
    SELECT *, NOT (odd OR wrong_prompt + no_pair + no_rubric + bad_role + foreign_method > 0) AS resumable FROM (
      SELECT dataset, count(*) FILTER (_method = '{CONTRASTIVE}') AS rows, count(*) FILTER (_method = '{CONTRASTIVE}' AND (_prompt_id IS NULL OR _prompt_id <> '{PROMPTS[CONTRASTIVE]}')) AS wrong_prompt,
        count(*) FILTER (_method = '{CONTRASTIVE}' AND _pair_id IS NULL) AS no_pair, count(*) FILTER (_method = '{CONTRASTIVE}' AND _rubric_id IS NULL) AS no_rubric,
        count(*) FILTER (_method = '{CONTRASTIVE}' AND (_pair_role IS NULL OR _pair_role NOT IN ('Sensitive', 'Non-sensitive'))) AS bad_role,
        count(*) FILTER (_item_id IS NOT NULL AND (_method IS NULL OR _method <> '{INSTRUCT}')) AS foreign_method, count(*) FILTER (_method = '{CONTRASTIVE}') % 2 = 1 AS odd
      FROM synthetic_data WHERE dataset IS NOT NULL GROUP BY dataset)""",
    "rendered_examples": f"WITH {pool_sql()} SELECT dataset, label, rank, '- <<<' || text || '>>>' AS line FROM pool",
}


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[{t.WORD}]+|[^{t.WORD}{t.SPACE}]')"


def _edges_sql(items: str, threshold: float) -> str:
    """CTEs it (dataset, id, k) -> prs, lc, edges (dataset, a, b, f1) of all pairs of ``threshold`` or more. Pairs that lengths
    or missing tokens rule out aren't scored: what a text has and the other lacks is in no common subsequence."""
    short = "len(list_filter(list_distinct({0}.k), lambda v: NOT list_contains({1}.k, v)))"
    bound = f"2.0 * least(len(x.k) - {short.format('x', 'y')}, len(y.k) - {short.format('y', 'x')}) / (len(x.k) + len(y.k)) >= {threshold} - 1e-9"
    return f"""
    prs AS (SELECT row_number() OVER () AS pid, x.dataset, x.id AS xid, y.id AS yid, x.k AS a, y.k AS b, len(x.k) AS m, len(y.k) AS n FROM {items} x JOIN {items} y ON x.dataset = y.dataset AND x.id < y.id
      AND 2.0 * least(len(x.k), len(y.k)) / (len(x.k) + len(y.k)) >= {threshold} - 1e-9 WHERE {bound}),
    {lcs_steps('prs', 'lc')},
    edges AS (SELECT dataset, xid AS a, yid AS b, {_F1} AS f1 FROM prs JOIN lc USING (pid) WHERE {_F1} >= {threshold})"""


#: CTE acc: ids accepted in order, of those that have an edge
_GREEDY = """
    nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS k, coalesce((SELECT list(a) FROM edges WHERE b = id), []) AS earlier FROM (SELECT a AS id FROM edges UNION SELECT b FROM edges)),
    walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS acc UNION ALL SELECT walk.k + 1, CASE WHEN list_has_any(nodes.earlier, walk.acc) THEN walk.acc ELSE list_append(walk.acc, nodes.id) END FROM walk JOIN nodes ON nodes.k = walk.k + 1),
    kept AS (SELECT acc FROM walk ORDER BY k DESC LIMIT 1)"""
_FREE = "(id NOT IN (SELECT id FROM nodes) OR list_contains((SELECT acc FROM kept), id))"
_INSTRUCT_ITEMS = f"it AS (SELECT dataset, min(row_id) AS id, k FROM (SELECT coalesce(dataset, '') AS dataset, row_id, {_tokens('text')} AS k FROM synthetic_data WHERE _method = '{INSTRUCT}' AND text IS NOT NULL) WHERE len(k) > 0 GROUP BY dataset, k)"
_INSTRUCTION = s.strip(s.strip_chars(s.strip(s.squash("_instruction")), "\"'"))
_CUT = f"coalesce({_INCOMPLETE}, false)"

SQL |= {
    "near_dup_edges": f"WITH RECURSIVE {_INSTRUCT_ITEMS}, {_edges_sql('it', 0.95)} SELECT dataset, a AS first_id, b AS second_id, round(f1, 9) AS f1 FROM edges",
    "near_dup_accept": f"WITH RECURSIVE {_INSTRUCT_ITEMS}, {_edges_sql('it', 0.95)}, {_GREEDY} SELECT id AS row_id FROM it WHERE {_FREE}",
    "instruction_novelty": f"""
    WITH RECURSIVE c AS (SELECT x AS text, min(row_id) AS id FROM (SELECT row_id, {_INSTRUCTION} AS x FROM synthetic_data) WHERE length(x) BETWEEN 20 AND 300 AND lower(x) LIKE 'decide whether%' GROUP BY x),
    it AS (SELECT 'all' AS dataset, min(id) AS id, k FROM (SELECT id, {_tokens('text')} AS k FROM c) GROUP BY k), {_edges_sql('it', 0.70)}, {_GREEDY}
    SELECT c.text AS instruction, c.id AS first_row FROM c WHERE id IN (SELECT id FROM it WHERE {_FREE})""",
    "rouge_vs_seeds": f"""
    WITH RECURSIVE {pool_sql()}, r AS (SELECT row_id, coalesce(dataset, '') AS dataset, {_tokens('text')} AS k FROM synthetic_data WHERE _method = '{INSTRUCT}' AND text IS NOT NULL),
    q AS (SELECT DISTINCT dataset, k FROM r), f AS (SELECT dataset, {_tokens('text')} AS k FROM pool),
    prs AS (SELECT row_number() OVER () AS pid, q.dataset, q.k AS a, f.k AS b, len(q.k) AS m, len(f.k) AS n FROM q JOIN f ON q.dataset = f.dataset),
    {lcs_steps('prs', 'lc')}, best AS (SELECT dataset, a AS k, max({_F1}) AS best FROM prs JOIN lc USING (pid) GROUP BY ALL)
    SELECT row_id, round(coalesce(best, 0.0), 9) AS best FROM r LEFT JOIN best ON r.dataset = best.dataset AND r.k = best.k""",
    "pair_ids": f"""
    WITH {_PAIR_ROWS} SELECT dataset, _pair_id, dataset || '_pair' || lpad((row_number() OVER (PARTITION BY dataset ORDER BY row_id))::VARCHAR, 6, '0') AS pair_id FROM pairs""",
    "gate_outcomes": f"""
    WITH RECURSIVE {_PAIR_ROWS}, {_clean('pairs', 'row_id', 'sensitive', 'cs')}, {_clean('pairs', 'row_id', 'neutral', 'cn')},
    v AS (SELECT p.dataset, p.row_id AS id, p.reason, cs.clean AS a, cn.clean AS b, {_norm('cs.clean')} AS ka, {_norm('cn.clean')} AS kb FROM pairs p JOIN cs ON cs.row_id = p.row_id JOIN cn ON cn.row_id = p.row_id),
    sides AS (SELECT dataset, id, 0 AS side, a AS text, ka AS key FROM v WHERE a IS NOT NULL UNION ALL SELECT dataset, id, 1, b, kb FROM v WHERE b IS NOT NULL),
    incomplete AS (SELECT DISTINCT id FROM (SELECT id, text AS x FROM (SELECT id, {s.strip('text')} AS text FROM sides)) WHERE {_CUT}),
    copied AS (SELECT DISTINCT id FROM sides WHERE key IN (SELECT {_norm('text')} FROM train WHERE text IS NOT NULL)),
    firsts AS (SELECT dataset, key, min(id) AS f FROM sides GROUP BY ALL), seen AS (SELECT DISTINCT id FROM sides JOIN firsts ON sides.dataset = firsts.dataset AND sides.key = firsts.key WHERE f < id),
    {pool_sql()}, ref AS (SELECT dataset, {_tokens('text')} AS k FROM pool),
    it AS (SELECT dataset, min(id * 2 + side) AS id, k FROM (SELECT dataset, id, side, {_tokens('text')} AS k FROM sides) WHERE len(k) > 0 GROUP BY dataset, k),
    sq AS (SELECT row_number() OVER () AS pid, sides.id, {_tokens('sides.text')} AS a, ref.k AS b, len({_tokens('sides.text')}) AS m, len(ref.k) AS n FROM sides JOIN ref ON sides.dataset = ref.dataset
      WHERE 2.0 * least(len({_tokens('sides.text')}), len(ref.k)) / (len({_tokens('sides.text')}) + len(ref.k)) >= {SEED_ROUGE} - 1e-9),
    {lcs_steps('sq', 'sl')}, seedlike AS (SELECT DISTINCT id FROM sq JOIN sl USING (pid) WHERE {_F1} >= {SEED_ROUGE}),
    {_edges_sql('it', SEED_ROUGE)}, pairlike AS (SELECT DISTINCT greatest(a // 2, b // 2) AS id FROM edges WHERE a // 2 <> b // 2)
    SELECT dataset, CASE WHEN a IS NULL OR b IS NULL THEN 'pair_parse_failed' WHEN id IN (FROM incomplete) THEN 'incomplete_rejected' WHEN ka = kb THEN 'pair_duplicate_rejected' WHEN id IN (FROM copied) THEN 'seed_copy_rejected'
      WHEN id IN (FROM seen) THEN 'duplicate_rejected' WHEN id IN (FROM seedlike) THEN 'rouge_l_seed_copy_rejected' WHEN id IN (FROM pairlike) THEN 'rouge_l_generated_duplicate_rejected'
      WHEN reason IS NULL OR reason = '{UNREADABLE}' THEN 'verifier_parse_failed' WHEN reason = '{REFUSING}' THEN 'verifier_rejected' ELSE 'accepted' END AS outcome, count(*) AS n FROM v GROUP BY ALL""",
}
