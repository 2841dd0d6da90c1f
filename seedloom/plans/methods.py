"""The generation methods as loops of micro-batches over a provider, with all state in DataFrames.

A loop's driver holds counts per label or rubric only. Answers are checkpointed before gates use them.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..functions import text as t
from ..operators import contexts as c
from ..operators import curate
from ..operators.merge import upserted
from ..operators.provider import Provider, answered, breaker_open
from ..operators.sampling import cyclic

ROWS = "text string, label string"
#: ROUGE-L from which a new instruction is too like a known one.
NOVEL = 0.7


@dataclass(frozen=True)
class Limits:
    size: int = 20
    batch: int = 16
    attempts: int = 400
    failures: int = 50


def balanced_targets(size: int) -> dict[str, int]:
    """Rows per label; an odd one is Sensitive."""
    return {t.LABELS[1]: size - size // 2, t.LABELS[0]: size // 2}


def duplicate(pool: DataFrame, limits: Limits) -> DataFrame:
    """The pool (label, rank, text) repeated in turn to the size."""
    rows = pool.withColumn("all", F.lit(1)).withColumn("place", F.concat("label", F.lpad(F.col("rank").cast("string"), 3, "0")))
    return cyclic(rows.select("all", "place", "text", "label"), ["all"], "place", limits.size).select("text", "label")


def _requests(spark: SparkSession, schedule: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(schedule, "label string, turn int")


def fewshot(pool: DataFrame, provider: Provider, limits: Limits) -> DataFrame:
    """Completions of prompts with the pool's examples, cleaned, as many per label as wanted; no duplicates removed."""
    spark = pool.sparkSession
    curate.ensure_checkpoint(spark)
    lines = _examples(pool)
    need, out, asked = balanced_targets(limits.size), [], 0
    while any(need.values()) and asked < limits.attempts:
        turns = [(label, asked + i) for i, label in enumerate([x for x, n in need.items() for _ in range(min(n, limits.batch))])]
        asked += len(turns)
        prompts = _requests(spark, turns).crossJoin(lines)  # one row of examples
        prompts = prompts.select("label", "turn", F.concat(c.fewshot_prompt(F.col("examples"), F.col("label")), F.lit("\n#"), F.col("turn").cast("string")).alias("prompt"))
        kept = answered(prompts, provider, 3).select(t.clean_generated(F.col("response")).alias("text"), "label").filter("text is not null").checkpoint()
        for r in kept.groupBy("label").count().collect():
            need[r["label"]] = max(0, need[r["label"]] - r["count"])
        out.append(kept)
    if any(need.values()):
        raise RuntimeError(f"short after {asked} requests: {need}")
    return _union(out, spark)


def _union(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    whole = spark.createDataFrame([], ROWS)
    for part in parts:
        whole = whole.unionByName(part.select("text", "label"))
    return whole


def accepted_rewrites(candidates: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Of candidates (seed_id, seed_text, at, text) those at most ``threshold`` similar, by 3-grams, to their seed and to
    each accepted before of the same seed. A seed has about a hundred candidates, which one call sees together."""

    def grams(text: str) -> set[str]:
        squashed = re.sub(r"\s+", " ", text.lower())  # not stripped: a space at an end counts
        return {squashed[i : i + 3] for i in range(len(squashed) - 2)}

    def accept(frame: pd.DataFrame) -> pd.DataFrame:
        kept, seen = [], [grams(frame["seed_text"].iloc[0])]
        for row in frame.sort_values("at").itertuples():
            mine = grams(row.text)
            if all(not (mine and s) or len(mine & s) / len(mine | s) <= threshold for s in seen):
                kept.append((row.seed_id, row.at, row.text))
                seen.append(mine)
        return pd.DataFrame(kept, columns=["seed_id", "at", "text"])

    return candidates.groupBy("seed_id").applyInPandas(accept, "seed_id string, at bigint, text string")


def padded(seeds: DataFrame, accepted: DataFrame, per_seed: int) -> DataFrame:
    """Exactly ``per_seed`` rows per seed (seed_id, text, label): its accepted rewrites in order, then its own text."""
    numbered = curate_rank(accepted).filter(F.col("n") <= per_seed)
    slots = seeds.select("seed_id", "label", F.col("text").alias("own"), F.explode(F.sequence(F.lit(1), F.lit(per_seed))).alias("n"))
    return slots.join(numbered.select("seed_id", "n", "text"), ["seed_id", "n"], "left").select("seed_id", F.coalesce("text", "own").alias("text"), "label", F.col("text").isNull().alias("padding"))


def curate_rank(accepted: DataFrame) -> DataFrame:
    return accepted.withColumn("n", F.row_number().over(Window.partitionBy("seed_id").orderBy("at")))


def _rewritten(seeds: DataFrame, provider: Provider, batch: int, first: int, last: int) -> DataFrame:
    """Candidates (seed_id, seed_text, at, text) of the requests ``first`` to ``last`` for each seed, in order."""
    ask = F.concat(F.lit(f"Rewrite this sentence in {batch} ways that keep its meaning and all identifiers; answer with a JSON list of strings.\n\n"), F.col("text"), F.lit("\n#"), F.col("turn").cast("string"))
    turns = seeds.withColumn("turn", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("prompt", ask)
    answers = answered(turns, provider, 3).checkpoint()
    each = answers.filter("response is not null").select("seed_id", F.col("text").alias("seed_text"), "turn", F.posexplode(F.slice(parse.rewrites(F.col("response")), 1, batch)).alias("p", "raw"))
    return each.select("seed_id", "seed_text", (F.col("turn") * 1000 + F.col("p")).cast("bigint").alias("at"), t.clean_generated(F.col("raw")).alias("text")).filter("text is not null")


def paraphrased(pool: DataFrame, provider: Provider, limits: Limits, per_seed: int = 4, batch: int = 10, factor: float = 0.5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows, report): rewrites of every pool text, filtered against their seed and each other.

    ``batch`` rewrites are asked for at a time, ``factor`` times as many as wanted at first, and two more batches for the
    seeds that are short after that; what then is missing is padded with the seed's text. Rows are cut to the size in a
    seeded order. The report tells accepted and padded rows per seed text.
    """
    curate.ensure_checkpoint(pool.sparkSession)
    seeds = pool.select(F.concat("label", F.lit(":"), F.col("rank").cast("string")).alias("seed_id"), "text", "label")
    rounds = max(1, math.ceil(max(batch, per_seed * factor) / batch))
    candidates = _rewritten(seeds, provider, batch, 1, rounds)
    done = accepted_rewrites(candidates).groupBy("seed_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= per_seed)
    short = seeds.join(done, "seed_id", "left_anti").checkpoint()
    candidates = candidates.unionByName(_rewritten(short, provider, batch, rounds + 1, rounds + 2)).checkpoint()
    whole = padded(seeds, accepted_rewrites(candidates), per_seed).checkpoint()
    report = whole.groupBy("seed_id", "label").agg(F.count_if(~F.col("padding")).alias("accepted"), F.count_if("padding").alias("padding"))
    place = F.row_number().over(Window.partitionBy("seed_id").orderBy("text"))  # a seed's few rows
    shuffled = whole.withColumn("place", place).withColumn("order", F.md5(F.concat_ws(":", F.lit(str(seed)), "seed_id", F.col("place").cast("string")).cast("binary")))
    return shuffled.orderBy("order").limit(limits.size).select("text", "label"), report


def paraphrase(pool: DataFrame, provider: Provider, limits: Limits, per_seed: int = 4) -> DataFrame:
    """The rows of ``paraphrased``."""
    return paraphrased(pool, provider, limits, per_seed)[0]


def _examples(pool: DataFrame) -> DataFrame:
    return pool.agg(c.joined_lines(F.concat("label", F.lit(": <<<"), "text", F.lit(">>>")), F.struct("rank", "label")).alias("examples"))


def verified_instances(texts: DataFrame, pool: DataFrame, verifier: Provider) -> DataFrame:
    """Of texts (label, .., text) those whose label the verifier confirms, with all four flags of its verdict right."""
    ask = F.concat(
        F.lit("Examples:\n"), "examples", F.lit("\n\nIs the answer of this text "), "label", F.lit("?\n<<<"), "text",
        F.lit('>>>\nAnswer with JSON {"label_correct": bool, "natural": bool, "copied_from_support": bool, "accept": bool, "reason": ...}.'),
    )
    asked = texts.crossJoin(_examples(pool)).withColumn("prompt", ask).drop("examples")  # one row of examples
    return answered(asked, verifier).filter(parse.accepts_instance(parse.json_payload(F.col("response")))).select(*texts.columns)


def expanded(spark: SparkSession, instructions: list[str], made: list[str], provider: Provider, turn: int) -> list[str]:
    """New instructions that one request adds to the pool: of the asked form, and unlike the pool and each other.

    Six given and two made instructions are shown, others in every turn.
    """
    shown = [pool[(turn * n + i) % len(pool)] for pool, n in ((instructions, 6), (made, 2)) for i in range(min(n, len(pool)))]
    prompt = "Write new neutral instructions like these, as JSON {\"instructions\": [...]}.\n" + "\n".join(f"- {x}" for x in shown) + f"\n#{turn}"
    answer = answered(spark.createDataFrame([(prompt,)], "prompt string"), provider)
    listed = answer.select(parse.instructions(parse.json_payload(F.col("response"))).alias("texts")).first()["texts"] or []
    if not listed:
        return []
    new = spark.createDataFrame([(1, i, x) for i, x in enumerate(listed)], "all int, id bigint, text string")
    refs = spark.createDataFrame([(1, x) for x in instructions + made], "all int, ref string")
    far = new.join(curate.best_reference(new, refs, ["all"]).filter(F.col("best") < NOVEL).select("id"), "id").select("all", "id", "text").checkpoint()
    return [listed[r["id"]] for r in curate.near_duplicate_accept(far, ["all"], NOVEL).select("id").orderBy("id").collect()]  # one answer's worth


def instruct(pool: DataFrame, instructions: list[str], provider: Provider, limits: Limits, verifier: Provider | None = None) -> DataFrame:
    """Instances of neutral instructions, accepted unless they copy a seed or an accepted one.

    The pool of instructions grows by one request a round. Each instance must pass ``verifier``, usually the provider
    itself; without one, instances are not verified.
    """
    spark = pool.sparkSession
    curate.ensure_checkpoint(spark)
    seeds = pool.select(F.lit(1).alias("all"), F.col("text").alias("ref"))
    need, out, asked, rounds = balanced_targets(limits.size), [], 0, 0
    made: list[str] = []
    while any(need.values()) and asked < limits.attempts:
        made += expanded(spark, instructions, made, provider, rounds)
        rounds += 1
        turns = [(label, asked + i) for i, label in enumerate([x for x, n in need.items() for _ in range(min(n, limits.batch))])]
        asked += len(turns)
        known_tasks = instructions + made
        chosen = F.element_at(F.array(*map(F.lit, known_tasks)), (F.col("turn") % len(known_tasks) + 1).cast("int"))
        prompts = _requests(spark, turns).select("label", "turn", F.concat(chosen, F.lit("\nWrite one text whose answer is "), "label", F.lit(', as JSON {"text": ...}.\n#'), F.col("turn").cast("string")).alias("prompt"))
        texts = answered(prompts, provider).select("label", F.col("turn").cast("bigint").alias("id"), parse.instance_text(parse.json_payload(F.col("response"))).alias("text")).filter("text is not null").withColumn("all", F.lit(1)).checkpoint()
        if verifier is not None:
            texts = verified_instances(texts, pool, verifier).checkpoint()
        refs = seeds if not out else seeds.unionByName(_union(out, spark).select(F.lit(1).alias("all"), F.col("text").alias("ref")))
        known = refs.select(t.normalise(F.col("ref")).alias("key")).distinct()
        fresh = texts.withColumn("key", t.normalise(F.col("text"))).join(known, "key", "left_anti")
        like = curate.like_known(fresh.select("all", "id", "text"), refs, ["all"], 0.95)
        ready = fresh.join(like.select("id"), "id", "left_anti").checkpoint()
        kept = ready.join(curate.near_duplicate_accept(ready.select("all", "id", "text"), ["all"], 0.95), "id").checkpoint()
        for r in kept.groupBy("label").count().collect():
            need[r["label"]] = max(0, need[r["label"]] - r["count"])
        out.append(kept)
        if breaker_open(sum(balanced_targets(limits.size).values()) - sum(need.values()), asked, 0, limits.failures):
            break
    return _union(out, spark)


def extracted_rubrics(pool: DataFrame, provider: Provider, calls: int, per_context: int, seed: int, known: DataFrame | None = None) -> DataFrame:
    """(rubric_id, context_index, sensitive_condition, nonsensitive_condition, support_sensitive, support_nonsensitive,
    prompt) of the rubrics that one request per context finds; those ``known``, from an earlier run, win over new ones
    of the same id. Ids are those of the context and the rubric's own; in order of the context and the id."""
    curate.ensure_checkpoint(pool.sparkSession)
    records = c.support_records(pool.withColumn("all", F.lit(1)), ["all"]).checkpoint()
    contexts = c.rubric_contexts(records, ["all"], calls, seed)
    lines = records.groupBy("all").agg(F.map_from_entries(F.collect_list(F.struct("support_id", "line"))).alias("lines"))  # a pool's few records

    def shown(ids: str | Column) -> Column:
        return F.array_join(F.transform(ids, lambda x: F.element_at("lines", x)), "\n")

    ask = F.concat(
        F.lit("Sensitive examples:\n"), shown("positive_ids"), F.lit("\n\nNon-sensitive examples:\n"), shown("negative_ids"),
        F.lit(f'\n\nTell what makes the difference, as JSON {{"rubrics": [{{"rubric_id", "sensitive_condition", "nonsensitive_condition", "support_sensitive": [ids], "support_nonsensitive": [ids]}}]}}; {per_context} at most.'),
    )
    asked = contexts.join(F.broadcast(lines), "all").withColumn("prompt", ask)  # one row of lines
    read = answered(asked, provider).checkpoint()
    cards = parse.parsed_rubrics(parse.rubric_cards(parse.json_payload(F.col("response"))), F.col("positive_ids"), F.col("negative_ids"), per_context)
    found = read.select("context_index", "context_id", F.explode(cards).alias("r")).select(F.concat_ws("_", "context_id", "r.rubric_id").alias("rubric_id"), "context_index", *(f"r.{n}" for n in RUBRIC[2:]))
    whole = upserted(known.select(*RUBRIC), found.select(*RUBRIC), "rubric_id") if known is not None else found
    task = F.concat(
        F.lit("Write a pair of texts that differ in this only.\nSensitive: "), "sensitive_condition", F.lit("\nNon-sensitive: "), "nonsensitive_condition",
        F.lit("\n\nSensitive examples:\n"), shown("support_sensitive"), F.lit("\n\nNon-sensitive examples:\n"), shown("support_nonsensitive"),
        F.lit('\n\nAnswer with JSON {"sensitive_text": ..., "nonsensitive_text": ...}.'),
    )
    return whole.crossJoin(lines.select("lines")).select(*RUBRIC, task.alias("prompt")).orderBy("context_index", "rubric_id").checkpoint()  # one row of lines


RUBRIC = ("rubric_id", "context_index", "sensitive_condition", "nonsensitive_condition", "support_sensitive", "support_nonsensitive")
PAIRS = ("rubric_id", "pair_id", "sensitive_text", "nonsensitive_text", "reason")


def contrastive(rubrics: DataFrame, seeds: DataFrame, provider: Provider, limits: Limits, verifier: Provider | None = None) -> DataFrame:
    """Pairs per rubric (rubric_id, prompt), gated in order, with the reason of refusal of the others.

    (rubric_id, pair_id, sensitive_text, nonsensitive_text, reason): ``reason`` is null for accepted pairs. A pair is
    checked as a whole against seeds and pairs before it; its own two texts may be alike, only not equal.

    The rubrics share ``limits.size`` texts, two a pair, and the attempts evenly. A rubric short of its quota is asked
    again, ``limits.batch`` times a round, while it has attempts left; pairs beyond a quota are refused. A run of failed
    answers without an accepted pair stops the loop with an error. Each pair must pass ``verifier``, usually the
    provider itself; without one, pairs are not verified.
    """
    spark = rubrics.sparkSession
    curate.ensure_checkpoint(spark)
    ids = [r["rubric_id"] for r in rubrics.select("rubric_id").distinct().orderBy("rubric_id").collect()]  # counts per rubric only
    wanted = (limits.size + 1) // 2
    need = {x: wanted // len(ids) + (i < wanted % len(ids)) for i, x in enumerate(ids)}
    asked, budget = dict.fromkeys(ids, 0), max(1, limits.attempts // max(1, len(ids)))
    fields = f"rubric_id {rubrics.schema['rubric_id'].dataType.simpleString()}, first int, last int"
    out: list[DataFrame] = []
    accepted = failed = run = 0
    while turns := [(x, asked[x] + 1, min(asked[x] + limits.batch, budget), need[x]) for x in ids if need[x] and asked[x] < budget]:
        schedule = spark.createDataFrame(turns, f"{fields}, need int")
        asked |= {x: last for x, _, last, _ in turns}
        earlier = _accepted_texts(out, spark)
        judged = _judged_pairs(rubrics.join(schedule, "rubric_id"), seeds, earlier, provider, verifier).checkpoint()
        place = F.row_number().over(Window.partitionBy("rubric_id", F.col("reason").isNull()).orderBy("pair_id"))  # one round of a rubric
        judged = judged.join(schedule.select("rubric_id", "need"), "rubric_id").withColumn("reason", F.when(F.col("reason").isNull() & (place > F.col("need")), "quota_full").otherwise(F.col("reason"))).select(*PAIRS).checkpoint()
        out.append(judged)
        fresh = {r["rubric_id"]: r["count"] for r in judged.filter("reason is null").groupBy("rubric_id").count().collect()}
        need |= {x: need[x] - n for x, n in fresh.items()}
        broken = judged.filter(F.col("reason").isin("pair_parse_failed", "verifier_parse_failed")).count()
        accepted, failed, run = accepted + sum(fresh.values()), failed + broken, 0 if fresh else run + broken
        if breaker_open(accepted, failed, run, limits.failures):
            raise RuntimeError(f"{run} failed answers in a row, {failed} in all")
    whole = spark.createDataFrame([], f"rubric_id {rubrics.schema['rubric_id'].dataType.simpleString()}, pair_id string, sensitive_text string, nonsensitive_text string, reason string")
    if out:
        whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def _accepted_texts(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    """Both texts of all accepted pairs."""
    whole = spark.createDataFrame([], "text string")
    for part in parts:
        whole = whole.unionByName(part.filter("reason is null").select(F.explode(F.array("sensitive_text", "nonsensitive_text")).alias("text")))
    return whole


def _judged_pairs(rubrics: DataFrame, seeds: DataFrame, earlier: DataFrame, provider: Provider, verifier: Provider | None) -> DataFrame:
    """The pairs of one round (rubric_id, prompt, first, last) with the reason of refusal."""
    turns = rubrics.withColumn("turn", F.explode(F.sequence("first", "last")))
    asked = turns.select("rubric_id", "turn", F.col("prompt").alias("rubric"), F.concat("prompt", F.lit("\n#"), F.col("turn").cast("string")).alias("prompt"))
    raw = answered(asked, provider).checkpoint()
    pairs = raw.select("rubric_id", "rubric", "turn", parse.generated_pair(parse.json_payload(F.col("response"))).alias("p")).select("rubric_id", "rubric", "turn", "p.*", F.concat("rubric_id", F.lit("_pair"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("pair_id"))
    a, b = F.col("sensitive_text"), F.col("nonsensitive_text")
    keyed = pairs.withColumn("ka", t.normalise(a)).withColumn("kb", t.normalise(b))
    keys = keyed.select("pair_id", F.explode(F.array("ka", "kb")).alias("key"))

    def known(texts: DataFrame) -> DataFrame:
        return keys.join(texts.select(t.normalise(F.col("text")).alias("key")).distinct(), "key", "left_semi").select("pair_id").distinct()

    copies = known(seeds).withColumn("copied", F.lit(True))
    first = keys.filter("key is not null").groupBy("key").agg(F.min("pair_id").alias("first"))
    seen = keys.join(first, "key").filter("first < pair_id").select("pair_id").union(known(earlier)).distinct().withColumn("seen", F.lit(True))
    gates = [
        ("pair_parse_failed", a.isNull()),
        ("incomplete_rejected", t.incomplete_reason(a).isNotNull() | t.incomplete_reason(b).isNotNull()),
        ("pair_duplicate_rejected", F.col("ka") == F.col("kb")),
        ("seed_copy_rejected", F.col("copied")),
        ("duplicate_rejected", F.col("seen")),
    ]
    judged = keyed.join(copies, "pair_id", "left").join(seen, "pair_id", "left").withColumn("reason", curate.first_failing(gates)).drop("copied", "seen", "ka", "kb").checkpoint()
    judged = _refused(judged, _like(judged, seeds), "rouge_l_seed_duplicate_rejected")
    judged = _refused(judged, _like(judged, earlier), "rouge_l_generated_duplicate_rejected").checkpoint()
    if verifier is not None:
        judged = _verified_pairs(judged, verifier).checkpoint()
    ready = judged.filter("reason is null").select(F.lit(1).alias("all"), F.col("pair_id"), F.explode(F.array("sensitive_text", "nonsensitive_text")).alias("text"))
    far = _pair_independent(ready)
    return judged.join(far.withColumn("far", F.lit(True)), "pair_id", "left").select("rubric_id", "pair_id", "sensitive_text", "nonsensitive_text", F.coalesce("reason", F.when(F.col("far").isNull(), "rouge_l_generated_duplicate_rejected")).alias("reason"))


def _refused(judged: DataFrame, ids: DataFrame, reason: str) -> DataFrame:
    return judged.join(ids.withColumn("hit", F.lit(True)), "pair_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("hit"), reason))).drop("hit")


def _like(judged: DataFrame, texts: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Ids of the pairs, not refused yet, of which a text is as similar as ``threshold`` to one of ``texts``."""
    mine = judged.filter("reason is null").select("pair_id", F.posexplode(F.array("sensitive_text", "nonsensitive_text")).alias("side", "text"))
    mine = mine.select("pair_id", F.lit(1).alias("all"), F.xxhash64("pair_id", "side").alias("id"), "text")
    like = curate.like_known(mine.select("all", "id", "text"), texts.select(F.lit(1).alias("all"), F.col("text").alias("ref")), ["all"], threshold)
    return mine.join(like.select("id"), "id").select("pair_id").distinct()


def _verified_pairs(judged: DataFrame, verifier: Provider) -> DataFrame:
    """The verifier is asked about the pairs not refused yet."""
    ask = F.concat(
        "rubric", F.lit("\nIs this pair right?\nSensitive: <<<"), "sensitive_text", F.lit(">>>\nNon-sensitive: <<<"), "nonsensitive_text",
        F.lit('>>>\nAnswer with JSON {"sensitive_label_correct": bool, "nonsensitive_label_correct": bool, "matched_pair": bool, "copied_from_support": bool, "accept": bool, "reason": ...}.'),
    )
    asked = judged.filter("reason is null").select("pair_id", ask.alias("prompt"))
    verdict = parse.pair_verdict(parse.json_payload(F.col("response")))
    read = answered(asked, verifier).select("pair_id", verdict.alias("verdict")).checkpoint()
    why = F.when(F.col("verdict").isNull(), "verifier_parse_failed").when(~parse.accepts_pair(F.col("verdict")), "verifier_rejected")
    return judged.join(read, "pair_id", "left").withColumn("reason", F.when(F.col("reason").isNull(), why).otherwise(F.col("reason"))).drop("verdict")


def _pair_independent(texts: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Ids of pairs accepted in order when any text of an accepted pair refuses any similar text of a later pair."""
    items = texts.select("all", "pair_id", t.tokens(F.col("text")).alias("tokens"), F.xxhash64("pair_id", "text").alias("id")).distinct()
    owners = items.select("id", "pair_id", F.md5(F.concat_ws("\x1f", "tokens").cast("binary")).alias("same"))
    edges = curate.rouge_edges(items.select("all", "id", "tokens"), ["all"], threshold)
    near = edges.join(owners.select(F.col("id").alias("a"), F.col("pair_id").alias("pa")), "a").join(owners.select(F.col("id").alias("b"), F.col("pair_id").alias("pb")), "b")
    # few: what is equal after normalising was refused before, these differ in white space between tokens only
    equal = owners.alias("x").join(owners.alias("y"), "same").select(F.col("x.pair_id").alias("pa"), F.col("y.pair_id").alias("pb"))
    both = near.select("pa", "pb").union(equal).filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
    return curate.greedy_accept(items.select("pair_id").distinct(), both, "pair_id")


def drawn_examples(pool: DataFrame, rows: DataFrame, per_label: int, seed: int, key: str = "row_id") -> DataFrame:
    """``rows`` with ``support``, ``per_label`` examples of each label drawn anew for every row: an array of (text, label),
    Non-sensitive first, in the order drawn. A pool without one of the labels is an error."""
    every = pool.agg(*(F.collect_list(F.when(F.col("label") == x, F.struct("rank", "text", "label"))).alias(f"_{i}") for i, x in enumerate(t.LABELS)))
    both = rows.crossJoin(every)  # one row, of a pool of a few examples per label

    def some(i: int) -> Column:
        keyed = F.transform(f"_{i}", lambda e: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), e["label"], e["rank"].cast("string")).cast("binary")).alias("o"), e["text"].alias("text"), e["label"].alias("label")))
        taken = F.transform(F.slice(F.array_sort(keyed), 1, per_label), lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label")))
        missing = F.raise_error(F.lit(f"no {t.LABELS[i]} examples")).cast("array<struct<text: string, label: string>>")
        return F.when(F.size(f"_{i}") > 0, taken).otherwise(missing)

    return both.select(*rows.columns, F.concat(some(0), some(1)).alias("support"))


def is_label(response: str) -> bool:
    return response.strip() in t.LABELS


def judged_by(rows: DataFrame, examples: DataFrame, provider: Provider, tries: int = 3, per_label: int = 5, seed: int = 42) -> DataFrame:
    """Judge predictions of rows (row_id, text, label): a prompt with examples drawn for the row, asked again until the
    response is a label and nothing else, ``tries`` times at most; else a failed parse."""
    line = lambda e: F.concat(F.lit("<<<"), e["text"], F.lit(">>>: "), e["label"])
    shown = F.array_join(F.transform("support", line), "\n")
    prompts = drawn_examples(examples, rows, per_label, seed).withColumn("prompt", c.judge_prompt(shown, F.col("text")))
    read = answered(prompts, provider, tries, wanted=is_label).withColumn("pred_label", F.coalesce(t.strict_label(F.col("response")), F.lit(t.PARSE_FAILED)))
    return read.select("row_id", "text", F.col("label").alias("true_label"), "pred_label", (F.col("label") == F.col("pred_label")).alias("correct"), (F.col("pred_label") == t.PARSE_FAILED).alias("parse_failed"), F.col("response").alias("raw_response"), "attempts", "support", "prompt")


#: Custom methods by name: callables of (pool, provider, limits).
CUSTOM: dict[str, object] = {}


def custom(path: str):
    """The callable named 'module:function'."""
    import importlib

    module, _, name = path.partition(":")
    if not module or not name:
        raise ValueError(f"not of the form module:function: {path}")
    return getattr(importlib.import_module(module), name)
