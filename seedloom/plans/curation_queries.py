"""Queries that parse responses, apply gates, remove duplicates and audit generated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..functions import similarity as sim
from ..functions import text as t
from ..operators import curate
from ..operators.sampling import seed_pool
from ..sources.tables import read
from . import sql as s

# Methods as the rows name them.
CONTRASTIVE = "rubric_guided_contrastive_synthesis"
INSTRUCT = "self_instruct_faithful_neutral"


def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First row of every normalised text within its dataset."""
    rows = read(spark, d, "synthetic_data", "row_id", "dataset", "text").filter("text is not null and dataset is not null")
    return curate.first_by_key(rows, ["dataset"], "row_id", t.normalise(F.col("text"))).select("row_id", "dataset")


def seed_copy_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Generated rows that equal a training text but for case and white space."""
    key = F.md5(t.normalise(F.col("text")).cast("binary")).alias("key")
    rows = read(spark, d, "synthetic_data", "row_id", "text").filter("text is not null").select("row_id", key)
    known = read(spark, d, "train", "text").filter("text is not null").select(key).distinct()
    return rows.join(known, "key", "left_semi").select("row_id")


def _instruct_items(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "synthetic_data", "row_id", "dataset", "_method", "text").filter((F.col("_method") == INSTRUCT) & F.col("text").isNotNull())
    return rows.select(F.coalesce("dataset", F.lit("")).alias("dataset"), F.col("row_id").alias("id"), "text")


def near_dup_accept(spark: SparkSession, d: str) -> DataFrame:
    """Instruct rows accepted in order when ROUGE-L of 0.95 or more to an accepted one of the dataset refuses."""
    return curate.near_duplicate_accept(_instruct_items(spark, d), ["dataset"], 0.95).select(F.col("id").alias("row_id"))


def near_dup_edges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different instruct texts of a dataset with ROUGE-L of 0.95 or more, by their first rows."""
    items = _instruct_items(spark, d).select("dataset", "id", t.tokens(F.col("text")).alias("tokens"))
    return curate.rouge_edges(items, ["dataset"], 0.95).select("dataset", F.col("a").alias("first_id"), F.col("b").alias("second_id"), F.round("f1", 9).alias("f1"))


def rouge_vs_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Greatest ROUGE-L of each instruct row over the seed pool of its dataset."""
    rows = read(spark, d, "train", "row_id", "dataset", "label", "text").filter("dataset is not null and text is not null")
    refs = seed_pool(rows, [42], 5, ["dataset"]).select("dataset", F.col("text").alias("ref"))
    best = curate.best_reference(_instruct_items(spark, d), refs, ["dataset"])
    return best.select(F.col("id").alias("row_id"), F.round("best", 9).alias("best"))


def instruction_novelty(spark: SparkSession, d: str) -> DataFrame:
    """Instructions accepted in order of first use if below 0.70 to all accepted ones."""
    rows = read(spark, d, "synthetic_data", "row_id", "_instruction").select("row_id", t.clean_instruction(F.col("_instruction")).alias("text"))
    items = rows.filter("text is not null").groupBy("text").agg(F.min("row_id").alias("id")).withColumn("all", F.lit(1))
    accepted = curate.near_duplicate_accept(items, ["all"], 0.70)
    return items.join(accepted, "id").select(F.col("text").alias("instruction"), F.col("id").alias("first_row"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """First text of each role of a contrastive pair."""
    rows = read(spark, d, "synthetic_data", "row_id", "dataset", "_pair_id", "_pair_role", "text", "_retry_count", "_verifier_reason").filter("_pair_id is not null and text is not null and dataset is not null")
    first = {role: F.min(F.when(F.col("_pair_role") == role, F.struct("row_id", "text", "_retry_count", "_verifier_reason"))) for role in t.LABELS}
    pairs = rows.groupBy("dataset", "_pair_id").agg(first[t.LABELS[1]].alias("s"), first[t.LABELS[0]].alias("n")).filter("s is not null and n is not null")
    return pairs.select("dataset", "_pair_id", F.col("s.row_id").alias("row_id"), F.col("s.text").alias("sensitive"), F.col("n.text").alias("neutral"), F.col("s._retry_count").alias("retries"), F.col("s._verifier_reason").alias("reason"))


def pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    """3-gram similarity and equality of the two texts of a pair."""
    a, b = F.col("sensitive"), F.col("neutral")
    return _pairs(spark, d).select("dataset", "_pair_id", F.round(sim.jaccard_trigrams(a, b), 9).alias("jaccard"), (t.normalise(a) == t.normalise(b)).alias("equal"))


def incomplete_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "synthetic_data", "dataset", "_pair_id", "_pair_role").filter("_pair_id is not null and dataset is not null")
    roles = rows.groupBy("dataset", "_pair_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("_pair_role").alias("roles"))
    return roles.filter("roles < 2")


def resume_audit(spark: SparkSession, d: str) -> DataFrame:
    """What would keep a run of the contrastive method from being resumed."""
    rows = read(spark, d, "synthetic_data", "row_id", "dataset", "_method", "_prompt_id", "_pair_id", "_rubric_id", "_pair_role").filter(F.col("_method") == CONTRASTIVE)
    checks = {"prompt_missing": F.col("_prompt_id").isNull(), "pair_missing": F.col("_pair_id").isNull(), "rubric_missing": F.col("_rubric_id").isNull(), "bad_role": ~F.coalesce(F.col("_pair_role").isin(*t.LABELS), F.lit(False))}
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) % 2 == 1).alias("odd"), *(F.count_if(c).alias(n) for n, c in checks.items()))


def reject_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    """Contrastive rows by the first gate that refuses them."""
    rows = read(spark, d, "synthetic_data", "row_id", "dataset", "_method", "text").filter((F.col("_method") == CONTRASTIVE) & F.col("dataset").isNotNull())
    keyed = rows.withColumn("clean", t.clean_pair_text(F.col("text"))).withColumn("key", F.md5(t.normalise(F.col("clean")).cast("binary")))
    known = read(spark, d, "train", "text").filter("text is not null").select(F.md5(t.normalise(F.col("text")).cast("binary")).alias("key")).distinct().withColumn("seed_copy", F.lit(True))
    first = keyed.filter("key is not null").groupBy("dataset", "key").agg(F.min("row_id").alias("first_id"))
    joined = keyed.join(known, "key", "left").join(first, ["dataset", "key"], "left")
    gates = [("pair_parse_failed", F.col("clean").isNull()), ("incomplete_rejected", t.incomplete_reason(F.col("clean")).isNotNull()), ("seed_copy_rejected", F.col("seed_copy")), ("duplicate_rejected", F.col("row_id") > F.col("first_id"))]
    return joined.groupBy("dataset", F.coalesce(curate.first_failing(gates), F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counters of all datasets as maps: rows per method."""
    counts = read(spark, d, "synthetic_data", "dataset", "_method").groupBy("dataset", "_method").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("dataset").agg(F.count(F.lit(1)).alias("methods"), F.sum("n").alias("rows"), F.max("n").alias("most"))


def completion_rates(spark: SparkSession, d: str) -> DataFrame:
    """Accepted pairs per attempt, by rubric."""
    rows = read(spark, d, "synthetic_data", "_rubric_id", "_pair_id", "_retry_count").filter("_rubric_id is not null")
    per = rows.groupBy("_rubric_id", "_pair_id").agg(F.max("_retry_count").alias("retries"))
    attempts = F.sum(F.coalesce("retries", F.lit(0)) + 1)
    return per.groupBy("_rubric_id").agg(F.count(F.lit(1)).alias("pairs"), attempts.alias("attempts"), F.round(F.try_divide(F.count(F.lit(1)), attempts), 9).alias("rate"))


_CARD = ["_sensitive_condition", "_nonsensitive_condition", "_support_sensitive", "_support_nonsensitive"]


def _rubrics(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "synthetic_data", "row_id", "_rubric_id", "_rubric_context_index", *_CARD).filter("_rubric_id is not null and _sensitive_condition is not null and _nonsensitive_condition is not null")
    rows = rows.filter("size(_support_sensitive) > 0 and size(_support_nonsensitive) > 0")
    return rows.groupBy("_rubric_id").agg(F.min(F.struct("row_id", "_rubric_context_index", *_CARD)).alias("r")).select("_rubric_id", "r.*")


def rubrics_from_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each rubric as its first complete row tells it."""
    return _rubrics(spark, d).select("_rubric_id", "_rubric_context_index", *_CARD[:2], F.array_join("_support_sensitive", ",").alias("sensitive_ids"), F.array_join("_support_nonsensitive", ",").alias("nonsensitive_ids"))


def _json(c: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def rubric_text(spark: SparkSession, d: str) -> DataFrame:
    """Rubrics as JSON with sorted keys, as prompts show them."""
    def listed(c: str) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(c, _json), ", "), F.lit("]"))

    parts = [("nonsensitive_condition", _json(F.col(_CARD[1]))), ("rubric_id", _json(F.col("_rubric_id"))), ("sensitive_condition", _json(F.col(_CARD[0]))), ("support_nonsensitive", listed(_CARD[3])), ("support_sensitive", listed(_CARD[2]))]
    body = F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), v) for k, v in parts))
    return _rubrics(spark, d).select("_rubric_id", F.concat(F.lit("{"), body, F.lit("}")).alias("json"))


def support_in_context(spark: SparkSession, d: str) -> DataFrame:
    """Support ids of each rubric that belong to an allowed set."""
    allowed = F.array(*map(F.lit, ("S1", "S2", "S3", "N1", "N2", "N3")))
    both = F.concat("_support_sensitive", "_support_nonsensitive")
    kept = F.filter(both, lambda x: F.array_contains(allowed, t.strip(x)))
    return _rubrics(spark, d).select("_rubric_id", F.array_join(kept, ",").alias("kept"), F.size(F.array_except(both, allowed)).cast("bigint").alias("outside"))


def _wrapped(json_text: Column, turn: Column) -> Column:
    """A response as models give it: bare, fenced, after prose, or with a tail."""
    fenced, prose, tail = (F.concat(F.lit(a), json_text, F.lit(b)) for a, b in (("```json\n", "\n```"), ("Here it is (as asked): ", ""), ("", "\nDone.")))
    return F.when(turn == 0, json_text).when(turn == 1, fenced).when(turn == 2, prose).otherwise(tail)


def parse_pair(spark: SparkSession, d: str) -> DataFrame:
    """Generated pairs read from the four shapes of a response."""
    raw = _wrapped(F.to_json(F.struct(F.col("sensitive").alias("sensitive_text"), F.col("neutral").alias("nonsensitive_text"))), F.col("row_id") % 4)
    rows = _pairs(spark, d).withColumn("payload", parse.json_payload(raw)).withColumn("pair", parse.generated_pair(F.col("payload")))
    return rows.select("dataset", "_pair_id", "pair.sensitive_text", "pair.nonsensitive_text")


def parse_verification(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts read from responses in which flags are native, words or, of every fifth, a number."""
    copied = F.when(F.coalesce(F.col("retries"), F.lit(0)) % 2 == 1, "true").otherwise("false")
    third = F.when(F.col("row_id") % 5 == 0, "1").otherwise('"True "')
    body = F.concat(F.lit('{"sensitive_label_correct": true, "nonsensitive_label_correct": "true", "matched_pair": '), third, F.lit(', "copied_from_support": '), copied, F.lit(', "accept": true, "reason": '), F.coalesce(_json(F.col("reason")), F.lit("null")), F.lit("}"))
    rows = _pairs(spark, d).withColumn("payload", parse.json_payload(_wrapped(body, F.col("row_id") % 4))).withColumn("v", parse.pair_verdict(F.col("payload")))
    return rows.select("dataset", "_pair_id", F.col("v").isNotNull().alias("parsed"), parse.accepts_pair(F.col("v")).alias("accepted"), F.col("v.reason").alias("reason"))


def parse_instance(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "synthetic_data", "row_id", "_method", "text").filter((F.col("_method") == INSTRUCT) & F.col("text").isNotNull())
    raw = _wrapped(F.to_json(F.struct("text")), F.col("row_id") % 4)
    return rows.withColumn("payload", parse.json_payload(raw)).select("row_id", parse.instance_text(F.col("payload")).alias("text"))


def parse_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Rewrites read from a list, a list after prose, and numbered lines."""
    a, b = (t.strip(t.squash(F.regexp_replace(F.col(c), r"[\[\]\"'<>]", ""))) for c in ("text", "reason"))
    listed = F.to_json(F.array(a, b))
    raw = F.when(F.col("row_id") % 3 == 0, listed).when(F.col("row_id") % 3 == 1, F.concat(F.lit("Sure: "), listed, F.lit(" ok"))).otherwise(F.concat(F.lit("1. "), a, F.lit("\n- "), b, F.lit("\n")))
    rows = read(spark, d, "synthetic_data", "row_id", "text", F.col("_verifier_reason").alias("reason")).filter("text is not null and reason is not null")
    return rows.select("row_id", F.array_join(parse.rewrites(raw), " | ").alias("rewrites"))


def parse_rubrics(spark: SparkSession, d: str) -> DataFrame:
    """Cards read from responses under either key or as a bare list; supports outside the context drop out."""
    card = F.to_json(F.struct(F.col("_rubric_id").alias("rubric_id"), F.col(_CARD[0]).alias("sensitive_condition"), F.col(_CARD[1]).alias("nonsensitive_condition"), F.col(_CARD[2]).alias("support_sensitive"), F.col(_CARD[3]).alias("support_nonsensitive")))
    shape = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit('{"rubrics": ['), card, F.lit("]}"))).when(F.col("row_id") % 3 == 1, F.concat(F.lit('{"cards": ['), card, F.lit("]}"))).otherwise(F.concat(F.lit("["), card, F.lit("]")))
    rows = _rubrics(spark, d).withColumn("payload", parse.json_payload(_wrapped(shape, F.col("row_id") % 4))).select(F.explode(parse.rubric_cards(F.col("payload"))).alias("c"))
    allowed = F.array(*(F.lit(f"{x}{i}") for x in "SN" for i in range(1, 4)))
    kept = {n: F.filter(f"c.{n}", lambda x: F.array_contains(allowed, x)) for n in ("support_sensitive", "support_nonsensitive")}
    rows = rows.select("c.rubric_id", "c.sensitive_condition", "c.nonsensitive_condition", *(F.array_join(v, ",").alias(n) for n, v in kept.items()))
    return rows.filter("support_sensitive <> '' and support_nonsensitive <> '' and sensitive_condition <> '' and nonsensitive_condition <> ''")


QUERIES = {f.__name__: f for f in (exact_dedup, seed_copy_rejects, near_dup_accept, near_dup_edges, rouge_vs_seeds, instruction_novelty, pair_similarity, incomplete_pairs, resume_audit, reject_reason_counts, outcome_counts, completion_rates, rubrics_from_rows, rubric_text, support_in_context, parse_pair, parse_verification, parse_instance, parse_rewrites, parse_rubrics)}

_QUOTES = "\"'"


def _norm(x: str) -> str:
    return f"lower({s.strip(s.squash(x))})"


def _clean(source: str, key: str, x: str, name: str) -> str:
    """CTEs that end in ``name``: key columns and ``clean``."""
    unquote = lambda v: s.strip(s.strip_chars(s.strip(v), _QUOTES))
    unwrap = f"CASE WHEN x LIKE '<<<%' AND x LIKE '%>>>' THEN {unquote('substr(x, 4, length(x) - 6)')} ELSE x END"
    return f"""{name}1 AS (SELECT {key}, {unquote(s.squash(x))} AS x FROM {source}), {name}2 AS (SELECT {key}, {unwrap} AS x FROM {name}1),
    {name}3 AS (SELECT {key}, {unwrap} AS x FROM {name}2), {name} AS (SELECT {key}, {s.kept('x')} AS clean FROM {name}3)"""


_PAIR_ROWS = """
  pr AS (SELECT * FROM synthetic_data WHERE _pair_id IS NOT NULL AND text IS NOT NULL AND dataset IS NOT NULL AND _pair_role IN ('Sensitive', 'Non-sensitive')),
  fr AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY dataset, _pair_id, _pair_role ORDER BY row_id) = 1),
  pairs AS (SELECT s.dataset, s._pair_id, s.row_id, s.text AS sensitive, n.text AS neutral, s._retry_count AS retries, s._verifier_reason AS reason FROM fr s JOIN fr n ON s.dataset = n.dataset AND s._pair_id = n._pair_id WHERE s._pair_role = 'Sensitive' AND n._pair_role = 'Non-sensitive')"""
_RUBRIC_ROWS = """
  rub AS (SELECT * FROM synthetic_data WHERE _rubric_id IS NOT NULL AND _sensitive_condition IS NOT NULL AND _nonsensitive_condition IS NOT NULL AND len(_support_sensitive) > 0 AND len(_support_nonsensitive) > 0
    QUALIFY row_number() OVER (PARTITION BY _rubric_id ORDER BY row_id) = 1)"""
_INCOMPLETE = "x = '' OR x LIKE '%...' OR (length(x) - length(replace(x, '\"', ''))) % 2 = 1 OR right(x, 1) NOT IN ('.', '?', '!', '\"', '''', ')', ']') OR length(x) - length(replace(replace(x, '(', ''), '[', '')) > length(x) - length(replace(replace(x, ')', ''), ']', '')) OR len(regexp_extract_all(lower(x), '[a-z'']+')) = 0 OR regexp_extract_all(lower(x), '[a-z'']+')[-1] IN (" + ", ".join(map(s.quoted, t.DANGLING_WORDS)) + ")"


_PLAIN = "regexp_replace({x}, '[\\[\\]\"''<>]', '', 'g')"

SQL = {
    "exact_dedup": f"SELECT row_id, dataset FROM synthetic_data WHERE text IS NOT NULL AND dataset IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset, {_norm('text')} ORDER BY row_id) = 1",
    "seed_copy_rejects": f"SELECT row_id FROM synthetic_data WHERE {_norm('text')} IN (SELECT {_norm('text')} FROM train WHERE text IS NOT NULL)",
    "pair_similarity": f"""
    WITH {_PAIR_ROWS}, v AS (SELECT dataset, _pair_id, lower({s.squash('sensitive')}) AS a, lower({s.squash('neutral')}) AS b, {_norm('sensitive')} = {_norm('neutral')} AS equal FROM pairs),
    g AS (SELECT DISTINCT dataset, _pair_id, side, substr(x, i, 3) AS gram FROM (SELECT dataset, _pair_id, side, x, unnest(range(1, length(x) - 1)) AS i FROM (SELECT dataset, _pair_id, 1 AS side, a AS x FROM v UNION ALL SELECT dataset, _pair_id, 2, b FROM v))),
    k AS (SELECT dataset, _pair_id, gram, count(*) AS c, min(side) AS one FROM g GROUP BY ALL),
    n AS (SELECT dataset, _pair_id, count(*) FILTER (c = 2) AS shared, count(*) AS total FROM k GROUP BY ALL)
    SELECT dataset, _pair_id, round(coalesce(shared / total, 0), 9) AS jaccard, equal FROM v LEFT JOIN n USING (dataset, _pair_id)""",
    "incomplete_pairs": "SELECT dataset, _pair_id, count(*) AS rows, count(DISTINCT _pair_role) AS roles FROM synthetic_data WHERE _pair_id IS NOT NULL AND dataset IS NOT NULL GROUP BY ALL HAVING count(DISTINCT _pair_role) < 2",
    "resume_audit": f"""
    SELECT dataset, count(*) AS rows, count(*) % 2 = 1 AS odd, count(*) FILTER (_prompt_id IS NULL) AS prompt_missing, count(*) FILTER (_pair_id IS NULL) AS pair_missing, count(*) FILTER (_rubric_id IS NULL) AS rubric_missing,
      count(*) FILTER (_pair_role IS NULL OR _pair_role NOT IN ('Sensitive', 'Non-sensitive')) AS bad_role FROM synthetic_data WHERE _method = '{CONTRASTIVE}' GROUP BY dataset""",
    "reject_reason_counts": f"""
    WITH {_clean(f"(SELECT row_id, dataset, text FROM synthetic_data WHERE _method = '{CONTRASTIVE}' AND dataset IS NOT NULL)", 'row_id, dataset', 'text', 'c')},
    k AS (SELECT row_id, dataset, clean, clean AS x, {_norm('clean')} AS key, row_number() OVER (PARTITION BY dataset, {_norm('clean')} ORDER BY row_id) AS nth FROM c)
    SELECT dataset, CASE WHEN clean IS NULL THEN 'pair_parse_failed' WHEN {_INCOMPLETE} THEN 'incomplete_rejected' WHEN key IN (SELECT {_norm('text')} FROM train WHERE text IS NOT NULL) THEN 'seed_copy_rejected'
      WHEN nth > 1 THEN 'duplicate_rejected' ELSE 'kept' END AS outcome, count(*) AS n FROM k GROUP BY ALL""",
    "outcome_counts": "SELECT dataset, count(*) AS methods, sum(n)::BIGINT AS rows, max(n) AS most FROM (SELECT dataset, _method, count(*) AS n FROM synthetic_data GROUP BY ALL) GROUP BY dataset",
    "completion_rates": """
    SELECT _rubric_id, count(*) AS pairs, sum(coalesce(r, 0) + 1)::BIGINT AS attempts, round(count(*) / sum(coalesce(r, 0) + 1), 9) AS rate
    FROM (SELECT _rubric_id, _pair_id, max(_retry_count) AS r FROM synthetic_data WHERE _rubric_id IS NOT NULL GROUP BY ALL) GROUP BY _rubric_id""",
    "rubrics_from_rows": f"WITH {_RUBRIC_ROWS} SELECT _rubric_id, _rubric_context_index, _sensitive_condition, _nonsensitive_condition, array_to_string(_support_sensitive, ',') AS sensitive_ids, array_to_string(_support_nonsensitive, ',') AS nonsensitive_ids FROM rub",
    "rubric_text": f"""
    WITH {_RUBRIC_ROWS} SELECT _rubric_id, '{{"nonsensitive_condition": ' || to_json(_nonsensitive_condition) || ', "rubric_id": ' || to_json(_rubric_id) || ', "sensitive_condition": ' || to_json(_sensitive_condition)
      || ', "support_nonsensitive": [' || array_to_string(list_transform(_support_nonsensitive, lambda v: to_json(v)::VARCHAR), ', ') || '], "support_sensitive": [' || array_to_string(list_transform(_support_sensitive, lambda v: to_json(v)::VARCHAR), ', ') || ']}}' AS json FROM rub""",
    "support_in_context": f"""
    WITH {_RUBRIC_ROWS}, b AS (SELECT _rubric_id, list_concat(_support_sensitive, _support_nonsensitive) AS v FROM rub)
    SELECT _rubric_id, array_to_string(list_filter(v, lambda x: trim(x) IN ('S1', 'S2', 'S3', 'N1', 'N2', 'N3')), ',') AS kept, len(list_distinct(list_filter(v, lambda x: x NOT IN ('S1', 'S2', 'S3', 'N1', 'N2', 'N3')))) AS outside FROM b""",
    "parse_pair": f"""
    WITH {_PAIR_ROWS}, {_clean('pairs', 'dataset, _pair_id', 'sensitive', 'cs')}, {_clean('pairs', 'dataset, _pair_id', 'neutral', 'cn')}
    SELECT cs.dataset, cs._pair_id, CASE WHEN cn.clean IS NOT NULL THEN cs.clean END AS sensitive_text, CASE WHEN cs.clean IS NOT NULL THEN cn.clean END AS nonsensitive_text FROM cs JOIN cn ON cs.dataset = cn.dataset AND cs._pair_id = cn._pair_id""",
    "parse_verification": f"""
    WITH {_PAIR_ROWS} SELECT dataset, _pair_id, row_id % 5 <> 0 AS parsed, row_id % 5 <> 0 AND coalesce(retries, 0) % 2 = 0 AS accepted, CASE WHEN row_id % 5 <> 0 THEN {s.strip(s.squash("coalesce(reason, '')"))} END AS reason FROM pairs""",
    "parse_instance": f"WITH {_clean(f'''(SELECT row_id, text FROM synthetic_data WHERE _method = '{INSTRUCT}' AND text IS NOT NULL)''', 'row_id', 'text', 'c')} SELECT row_id, clean AS text FROM c",
    "parse_rewrites": f"""
    WITH a AS (SELECT row_id, {s.strip(s.squash(_PLAIN.format(x='text')))} AS a, {s.strip(s.squash(_PLAIN.format(x='_verifier_reason')))} AS b FROM synthetic_data WHERE text IS NOT NULL AND _verifier_reason IS NOT NULL)
    SELECT row_id, array_to_string(list_filter([a, b], lambda x: x <> ''), ' | ') AS rewrites FROM a""",
    "parse_rubrics": f"""
    WITH {_RUBRIC_ROWS}, k AS (SELECT _rubric_id AS rubric_id, {s.strip(s.squash('_sensitive_condition'))} AS sensitive_condition, {s.strip(s.squash('_nonsensitive_condition'))} AS nonsensitive_condition,
      array_to_string(list_filter(_support_sensitive, lambda x: x IN ('S1', 'S2', 'S3', 'N1', 'N2', 'N3')), ',') AS support_sensitive, array_to_string(list_filter(_support_nonsensitive, lambda x: x IN ('S1', 'S2', 'S3', 'N1', 'N2', 'N3')), ',') AS support_nonsensitive FROM rub)
    SELECT * FROM k WHERE support_sensitive <> '' AND support_nonsensitive <> '' AND sensitive_condition <> '' AND nonsensitive_condition <> ''""",
}
