"""Queries that validate, normalise, clean and scan texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.tables import read, splits
from . import sql as s

SECRETS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("path", r"/(?:home|Users)/[A-Za-z0-9._-]+"), ("address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"), ("user", r"@[A-Za-z0-9_]{3,}")]


def validate_examples(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the strict reader refuses, with the first reason."""
    reason = F.when(F.coalesce(t.strip(F.col("text")), F.lit("")) == "", "blank_text").when(~F.coalesce(F.col("label").isin(*t.LABELS), F.lit(False)), "bad_label")
    return splits(spark, d, "row_id", "text", "label").withColumn("reason", reason).filter("reason is not null").select("split", "row_id", "reason")


def valid_examples(spark: SparkSession, d: str) -> DataFrame:
    rows = splits(spark, d, "row_id", "text", "label").filter(F.col("label").isin(*t.LABELS)).withColumn("text", t.strip(F.col("text")))
    return rows.filter("text <> ''")


def split_profile(spark: SparkSession, d: str) -> DataFrame:
    counts = [F.count_if(F.col("label") == name).alias(column) for name, column in zip(t.LABELS, ("non_sensitive", "sensitive"), strict=True)]
    return splits(spark, d, "row_id", "label").groupBy("split").agg(F.count(F.lit(1)).alias("n"), *counts)


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    """Both labels of every dataset and split, those without rows as zero."""
    counted = splits(spark, d, "label", "dataset").filter(F.col("label").isin(*t.LABELS)).groupBy("split", "dataset", "label").agg(F.count(F.lit(1)).alias("n"))
    grid = splits(spark, d, "dataset").select("split", "dataset").distinct().withColumn("label", F.explode(F.array(*map(F.lit, t.LABELS))))
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("split", "dataset", "label")]
    return grid.alias("g").join(counted.alias("c"), same, "left").select("g.split", "g.dataset", "g.label", F.coalesce("n", F.lit(0)).alias("n"))


def trainable_datasets(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "train", "dataset", "label").filter(F.col("label").isin(*t.LABELS))
    return rows.groupBy("dataset").agg((F.count_distinct("label") == 2).alias("trainable"))


def normalized_texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "train", "row_id", "text").select("row_id", t.normalise(F.col("text")).alias("norm"))


def rouge_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = t.tokens(F.col("text"))
    return read(spark, d, "train", "row_id", "text").select("row_id", F.size(tokens).cast("bigint").alias("n_tokens"), F.array_join(tokens, " ").alias("tokens")).filter("n_tokens >= 0")


def char_trigrams(spark: SparkSession, d: str) -> DataFrame:
    grams = t.trigrams(F.col("text"))
    return read(spark, d, "test", "row_id", "text").filter("text is not null").select("row_id", F.size(grams).cast("bigint").alias("n"), F.coalesce(F.array_min(grams), F.lit("")).alias("least"))


def clean_generated(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "synthetic_data", "row_id", "text").select("row_id", t.clean_generated(F.col("text")).alias("cleaned"))


def clean_pair_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "synthetic_data", "row_id", "text").select("row_id", t.clean_pair_text(F.col("text")).alias("cleaned"))


def clean_instruction(spark: SparkSession, d: str) -> DataFrame:
    """Kept and refused instructions with their uses."""
    cleaned = t.clean_instruction(F.col("_instruction"))
    rows = read(spark, d, "synthetic_data", "_instruction").filter("_instruction is not null")
    return rows.groupBy(cleaned.alias("instruction")).agg(F.count(F.lit(1)).alias("uses"))


def looks_incomplete(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "synthetic_data", "row_id", "text").filter("text is not null")
    return rows.select("row_id", t.incomplete_reason(F.col("text")).alias("reason")).filter("reason is not null")


def artifact_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = splits(spark, d, "row_id", "text")
    return rows.select("row_id", F.coalesce(t.has_artifact(F.col("text")), F.lit(False)).alias("artifact"), F.coalesce(t.fits(F.col("text")), F.lit(False)).alias("fits"))


def short_value(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", t.short_value(F.col("text")).alias("short"))


def scrubbed_lines(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("S"), F.col("row_id").cast("string"))
    return read(spark, d, "valid", "row_id", "text").filter("text is not null").select("row_id", t.scrubbed_line(key, F.col("text")).alias("line"))


def leak_scan(spark: SparkSession, d: str) -> DataFrame:
    """Matches of the secret patterns in documents, by line."""
    lines = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    found = F.array(*(F.struct(F.lit(name).alias("pattern"), F.regexp_extract_all("line", F.lit(f"({rx})"), F.lit(1)).alias("m")) for name, rx in SECRETS))
    each = lines.select("doc_id", (F.col("at") + 1).cast("bigint").alias("line_no"), F.explode(found).alias("f"))
    return each.select("doc_id", "line_no", "f.pattern", F.explode("f.m").alias("match"))


def file_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Characters and lines per source of documents, as a release walk reports them."""
    lines = F.size(F.split("text", "\n"))
    return read(spark, d, "documents", "source", "text").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(lines).alias("lines"), F.sum(F.length("text")).alias("chars"))


QUERIES = {f.__name__: f for f in (validate_examples, valid_examples, split_profile, label_counts, trainable_datasets, normalized_texts, rouge_tokens, char_trigrams, clean_generated, clean_pair_text, clean_instruction, looks_incomplete, artifact_flags, short_value, scrubbed_lines, leak_scan, file_kinds)}

_IN = "label IN ('Non-sensitive', 'Sensitive')"
_DANGLING = ", ".join(map(s.quoted, t.DANGLING_WORDS))


def _generated() -> str:
    step = s.strip(f"regexp_replace(regexp_replace(x, '{s.MARKER_PREFIX}', ''), '{s.LABEL_PREFIX}', '')")
    head = s.strip(f"CASE WHEN contains(text, '>>>') THEN split_part(text, '>>>', 1) ELSE {s.first_line('text')} END")
    return f"""
    WITH a AS (SELECT row_id, {head} AS x FROM synthetic_data), b AS (SELECT row_id, {step} AS x FROM a),
    c AS (SELECT row_id, {step} AS x FROM b), e AS (SELECT row_id, {step} AS x FROM c),
    f AS (SELECT row_id, {s.strip(s.strip_chars('x', chr(34) + chr(39) + '<>'))} AS x FROM e)
    SELECT row_id, {s.kept('x')} AS cleaned FROM f"""


def _pair() -> str:
    quotes = "\"'"
    unquote = lambda x: s.strip(s.strip_chars(s.strip(x), quotes))
    unwrap = f"CASE WHEN x LIKE '<<<%' AND x LIKE '%>>>' THEN {unquote('substr(x, 4, length(x) - 6)')} ELSE x END"
    return f"""
    WITH a AS (SELECT row_id, {unquote(s.squash('text'))} AS x FROM synthetic_data),
    b AS (SELECT row_id, {unwrap} AS x FROM a), c AS (SELECT row_id, {unwrap} AS x FROM b)
    SELECT row_id, {s.kept('x')} AS cleaned FROM c"""


def _count(char: str) -> str:
    return f"(length(x) - length(replace(x, {s.quoted(char)}, '')))"


SQL = {
    "validate_examples": f"""
    SELECT split, row_id, CASE WHEN {s.strip("coalesce(text, '')")} = '' THEN 'blank_text' ELSE 'bad_label' END AS reason
    FROM ({s.splits('row_id, text, label')}) WHERE {s.strip("coalesce(text, '')")} = '' OR label IS NULL OR NOT {_IN}""",
    "valid_examples": f"SELECT * FROM (SELECT split, row_id, {s.strip('text')} AS text, label FROM ({s.splits('row_id, text, label')}) WHERE {_IN}) WHERE text <> ''",
    "split_profile": f"SELECT split, count(*) AS n, count(*) FILTER (label = 'Non-sensitive') AS non_sensitive, count(*) FILTER (label = 'Sensitive') AS sensitive FROM ({s.splits('label')}) GROUP BY split",
    "label_counts": f"""
    WITH r AS ({s.splits('dataset, label')}), g AS (SELECT DISTINCT split, dataset, unnest(['Non-sensitive', 'Sensitive']) AS label FROM r)
    SELECT g.split, g.dataset, g.label, (SELECT count(*) FROM r WHERE r.split = g.split AND r.dataset IS NOT DISTINCT FROM g.dataset AND r.label = g.label) AS n FROM g""",
    "trainable_datasets": f"SELECT dataset, count(DISTINCT label) = 2 AS trainable FROM train WHERE {_IN} GROUP BY dataset",
    "normalized_texts": f"SELECT row_id, lower({s.strip(s.squash('text'))}) AS norm FROM train",
    "rouge_tokens": f"SELECT row_id, len(k)::BIGINT AS n_tokens, array_to_string(k, ' ') AS tokens FROM (SELECT row_id, regexp_extract_all(lower(text), '[{t.WORD}]+|[^{t.WORD}{t.SPACE}]') AS k FROM train WHERE text IS NOT NULL)",
    "char_trigrams": f"""
    WITH x AS (SELECT row_id, lower({s.squash('text')}) AS v FROM test WHERE text IS NOT NULL),
    g AS (SELECT row_id, substr(v, i, 3) AS g FROM (SELECT row_id, v, unnest(range(1, length(v) - 1)) AS i FROM x))
    SELECT x.row_id, count(DISTINCT g) AS n, coalesce(min(g), '') AS least FROM x LEFT JOIN g USING (row_id) GROUP BY x.row_id""",
    "clean_generated": _generated(),
    "clean_pair_text": _pair(),
    "clean_instruction": f"""
    WITH a AS (SELECT {s.strip(s.strip_chars(s.strip(s.squash('_instruction')), chr(34) + chr(39)))} AS x FROM synthetic_data WHERE _instruction IS NOT NULL)
    SELECT CASE WHEN length(x) BETWEEN 20 AND 300 AND lower(x) LIKE 'decide whether%' THEN x END AS instruction, count(*) AS uses FROM a GROUP BY 1""",
    "looks_incomplete": f"""
    WITH a AS (SELECT row_id, {s.strip('text')} AS x FROM synthetic_data WHERE text IS NOT NULL), b AS (SELECT *, regexp_extract_all(lower(x), '[a-z'']+') AS w FROM a)
    SELECT * FROM (SELECT row_id, CASE WHEN x = '' THEN 'blank' WHEN x LIKE '%...' THEN 'ellipsis' WHEN {_count(chr(34))} % 2 = 1 THEN 'open_quote'
      WHEN right(x, 1) IN (',', ';', ':', '-', '(', '[') THEN 'open_end' WHEN right(x, 1) NOT IN ('.', '?', '!', '"', '''', ')', ']') THEN 'no_end'
      WHEN {_count('(')} + {_count('[')} > {_count(')')} + {_count(']')} THEN 'open_bracket' WHEN len(w) = 0 THEN 'no_word'
      WHEN w[-1] IN ({_DANGLING}) THEN 'dangling_word' END AS reason FROM b) WHERE reason IS NOT NULL""",
    "artifact_flags": f"SELECT row_id, coalesce(regexp_matches(text, '{s.ARTIFACT}'), false) AS artifact, coalesce(length(text) BETWEEN 10 AND 500, false) AS fits FROM ({s.splits('row_id, text')})",
    "short_value": f"""
    WITH a AS (SELECT doc_id, {s.strip(s.squash('text'))} AS x FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN length(x) <= 700 THEN x ELSE regexp_replace(substr(x, 1, 697), '[{t.SPACE}]+$', '') || '...' END AS short FROM a""",
    "scrubbed_lines": f"SELECT row_id, 'S' || row_id || ': <<<' || {s.strip('''replace(replace(text, '<<<', ''), '>>>', '')''')} || '>>>' AS line FROM valid WHERE text IS NOT NULL",
    "leak_scan": f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
    p AS (SELECT * FROM (VALUES {', '.join(f"('{n}', '{rx}')" for n, rx in SECRETS)}) v(pattern, rx))
    {' UNION ALL '.join(f"SELECT doc_id, line_no::BIGINT AS line_no, '{n}' AS pattern, unnest(regexp_extract_all(line, '{rx}')) AS match FROM l" for n, rx in SECRETS)}""",
    "file_kinds": "SELECT source, count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source",
}
