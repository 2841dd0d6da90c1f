"""Sampling, metrics, acceptance, loops, sources and streams against brute force and hand-made cases."""

import hashlib
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from seedloom.functions.similarity import lcs
from seedloom.operators import aggregate, contexts, curate, draw, merge, metrics, provider, sampling, train
from seedloom.plans import methods, pipeline
from seedloom.sources import config, files, jsonl
from seedloom.streaming.curate import accept_stream
from test_functions import plain_lcs


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_first_per_group_is_exact_for_any_quota(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g")).withColumn("o", draw.seeded(1, "id"))
    quotas = spark.createDataFrame([("hot", 1777), ("cold", 5)], "g string, quota bigint")
    got = {r.id for r in draw.first_per_group(rows, ["g"], quotas, "o").collect()}
    want = set()
    for g, q in (("hot", 1777), ("cold", 5)):
        members = [i for i in range(5000) if (i % 3 > 0) == (g == "hot")]
        want |= set(sorted(members, key=lambda i: md5(f"1:{i}"))[:q])
    assert got == want


def reference_quotas(sizes, size, trim):
    total = sum(sizes.values())
    if total <= size:
        return dict(sizes)
    quota, rest = {}, []
    for label in sorted(sizes):
        raw = size * sizes[label] / total
        q = int(raw)
        if q == 0 and size >= len(sizes):
            q = 1
        quota[label] = min(q, sizes[label])
        rest.append((raw - int(raw), label))
    for _, label in sorted(rest, reverse=True):
        if sum(quota.values()) < size and quota[label] < sizes[label]:
            quota[label] += 1
    for _, label in sorted(rest):
        if trim and sum(quota.values()) > size and quota[label] > 1:
            quota[label] -= 1
    return quota


def test_stratified_quotas_equal_the_sequential_rule(spark):
    rng = random.Random(3)
    cases = [{chr(97 + k): rng.randrange(1, 60) for k in range(rng.randrange(1, 5))} for _ in range(25)]
    counts = spark.createDataFrame([(i, label, n) for i, c in enumerate(cases) for label, n in c.items()], "case int, label string, n bigint")
    for trim in (False, True):
        got = {(r.case, r.label): r.quota for r in draw.stratified_quotas(counts, 12, trim, ["case"]).collect()}
        want = {(i, label): q for i, c in enumerate(cases) for label, q in reference_quotas(c, 12, trim).items()}
        assert got == want


def test_cyclic_and_contexts(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "g int, x string")
    assert [r.x for r in sampling.cyclic(items, ["g"], "x", 7).orderBy("index").collect()] == list("abcabca")
    records = spark.createDataFrame([(1, f"{p}{i}", label, i) for p, label in (("S", "Sensitive"), ("N", "Non-sensitive")) for i in range(1, 6)], "g int, support_id string, label string, rank int")
    rows = contexts.rubric_contexts(records, ["g"], 120, 1).collect()
    assert len(rows) == 120 and len({(tuple(r.positive_ids), tuple(r.negative_ids)) for r in rows}) == 100


def test_metrics_on_small_cases(spark):
    rows = [("Sensitive", "Sensitive"), ("Sensitive", "__PARSE_FAILED__"), ("Non-sensitive", "Non-sensitive"), ("Non-sensitive", "Sensitive")]
    df = spark.createDataFrame([(1, *r) for r in rows], "g int, true_label string, pred_label string")
    r = metrics.judged(df, ["g"]).first()
    assert (r.n_eval, r.parse_failed, r.accuracy) == (4, 1, 0.5)
    assert r.macro_f1 == pytest.approx((2 / 4 + 2 / 3) / 2)
    one = df.filter("true_label = 'Sensitive' and pred_label = 'Sensitive'")
    assert one.groupBy("g").agg(metrics.macro_f1_observed(F.col("true_label"), F.col("pred_label")).alias("f")).first().f == 1.0


def test_threshold_equals_brute_force(spark):
    rng = random.Random(5)
    cases = [[(rng.randrange(6) / 5, rng.random() < 0.5) for _ in range(rng.randrange(1, 15))] for _ in range(15)]
    df = spark.createDataFrame([(i, float(s), p) for i, c in enumerate(cases) for s, p in c], "case int, score double, positive boolean")
    got = {r.case: (r.threshold, r.accuracy, r.macro_f1) for r in metrics.best_threshold(df, ["case"]).collect()}
    for i, c in enumerate(cases):
        scores = sorted({float(s) for s, _ in c})
        best = None
        for th in [-1e-12, *((a + b) / 2 for a, b in zip(scores, scores[1:], strict=False)), 1 + 1e-12]:
            pred = [s >= th for s, _ in c]
            true = [p for _, p in c]
            acc = statistics.mean(a == b for a, b in zip(pred, true, strict=True))
            f1s = []
            for cls in (True, False):
                hit, size = sum(a == b == cls for a, b in zip(pred, true, strict=True)), pred.count(cls) + true.count(cls)
                if size:
                    f1s.append(2 * hit / size)
            if best is None or (statistics.mean(f1s), acc) > (best[2], best[1]):
                best = (th, acc, statistics.mean(f1s))
        assert got[i] == pytest.approx(best)


def test_runs_and_early_stop(spark):
    rows = spark.createDataFrame([(1, i, f, not f) for i, f in enumerate([True, True, False, True, True, True])], "g int, i int, failed boolean, accepted boolean")
    assert [r.run for r in metrics.failure_runs(rows, ["g"], "i", "failed", "accepted").orderBy("i").collect()] == [1, 2, 0, 1, 2, 3]
    history = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.5, 0.6, 0.6, 0.55, 0.7])], "g int, epoch int, acc double")
    assert [r.stopped for r in metrics.best_so_far(history, ["g"], "epoch", "acc", 2).orderBy("epoch").collect()] == [False, False, False, True, True]


def test_summary_rules(spark):
    rows = spark.createDataFrame([("d", "m", 1, 0.5, 0.4), ("d", "m", 2, 0.7, None), ("d", "x_judge", 1, 0.25, 0.2), ("e", "m", 1, None, None)], "dataset string, method string, seed bigint, accuracy double, macro_f1 double")
    got = {(r.dataset, r.method): r.asDict() for r in aggregate.grid_summary(rows).collect()}
    assert len(got) == 4 and got["e", "x_judge"]["n"] == 0 and got["d", "m"]["seeds"] == "1 2"
    assert got["d", "m"]["accuracy_sd"] == pytest.approx(statistics.stdev([50, 70]), abs=1e-6) and got["d", "x_judge"]["accuracy_sd"] == 0.0
    lines = aggregate.markdown_lines([got["d", "m"], got["d", "x_judge"], got["e", "m"]])
    assert "60.00 +/- 14.14" in lines[2] and "25.00 (n=1)" in lines[3] and "| - |" in lines[4]


def test_endpoint_load_prefers_the_model(spark):
    page = ['vllm:num_requests_running{model_name="a"} 2', 'vllm:num_requests_running{model_name="b"} 3', "vllm:num_requests_waiting 4.0", "other 9"]
    lines = spark.createDataFrame([(x,) for x in page], "line string")
    assert {r.kind: r.load for r in aggregate.endpoint_load(lines, "a").collect()} == {"running": 2.0, "waiting": 4.0}
    assert {r.kind: r.load for r in aggregate.endpoint_load(lines, None).collect()} == {"running": 5.0, "waiting": 4.0}
    assert not provider.has_capacity(aggregate.endpoint_load(lines, "a")) and provider.has_capacity(aggregate.endpoint_load(lines, "a"), 9, 9)
    assert provider.endpoint_page("http://host:1/v1/") == "http://host:1/metrics"


def texts_with_edits(rng, n):
    words = [f"w{i}" for i in range(40)]
    base = [rng.choices(words, k=rng.randrange(3, 40)) for _ in range(max(1, n // 4))]
    out = []
    for _ in range(n):
        x = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            kind, at = rng.randrange(3), rng.randrange(len(x))
            if kind == 0:
                x[at] = rng.choice(words)
            elif kind == 1:
                x.insert(at, rng.choice(words))
            elif len(x) > 1:
                x.pop(at)
        out.append(" ".join(x))
    return out


def f1(a, b):
    common = plain_lcs(a, b)
    if not common:
        return 0.0
    p, r = common / len(a), common / len(b)
    return 2 * p * r / (p + r)


@pytest.mark.parametrize("threshold", [0.95, 0.9, 0.7])
def test_near_duplicate_acceptance_equals_the_sequential_rule(spark, threshold):
    texts = texts_with_edits(random.Random(int(threshold * 100)), 60)
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "g int, id bigint, text string")
    accepted = []
    for i, x in enumerate(texts):
        if all(f1(x.split(), texts[j].split()) < threshold for j in accepted):
            accepted.append(i)
    assert sorted(r.id for r in curate.near_duplicate_accept(df, ["g"], threshold).collect()) == accepted


def test_edges_lose_no_pair(spark):
    texts = texts_with_edits(random.Random(8), 80)
    df = spark.createDataFrame([(1, i, x.split()) for i, x in enumerate(texts)], "g int, id bigint, tokens array<string>")
    firsts = {}
    for i, x in enumerate(texts):
        firsts.setdefault(x, i)
    ids = sorted(firsts.values())
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if f1(texts[a].split(), texts[b].split()) >= 0.8}
    assert {(r.a, r.b) for r in curate.rouge_edges(df, ["g"], 0.8).collect()} == want


def test_acceptance_of_nothing(spark):
    empty = spark.createDataFrame([], "g int, id bigint, text string")
    assert curate.near_duplicate_accept(empty, ["g"], 0.95).count() == 0


def test_rewrites_are_filtered_and_padded(spark):
    seeds = spark.createDataFrame([("s1", "the cat sat on the mat", "Sensitive"), ("s2", "alone", "Non-sensitive")], "seed_id string, text string, label string")
    rows = [("s1", "the cat sat on the mat", i, x) for i, x in enumerate(["the cat sat on the mat", "a dog ran in the park", "a dog ran in the park!", "birds fly over the sea"])]
    candidates = spark.createDataFrame(rows, "seed_id string, seed_text string, at bigint, text string")
    kept = methods.accepted_rewrites(candidates)
    assert {r.at for r in kept.collect()} == {1, 3}
    out = methods.padded(seeds, kept, 3).collect()
    assert len(out) == 6 and sum(r.padding for r in out) == 4


POOL = [("Sensitive", 1, "My phone is 0123."), ("Sensitive", 2, "I am Ann."), ("Non-sensitive", 1, "The sky is blue."), ("Non-sensitive", 2, "Doors open.")]


def test_loops_over_the_offline_provider(spark):
    pool = spark.createDataFrame(POOL, "label string, rank int, text string")
    limits = methods.Limits(size=9, batch=6)
    plain = provider.Stub(("The {0} {1} stood by the {2} {3} in {n}.>>>",))
    rows = methods.fewshot(pool, plain, limits).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in rows} == {"Sensitive": 5, "Non-sensitive": 4}
    assert methods.duplicate(pool, limits).count() == 9
    listed = provider.Stub(('["The {0} {1} by the {2} at {n}.", "A {3} {4} under some {5}."]',))
    assert methods.paraphrase(pool, listed, methods.Limits(size=16), 4).count() == 16
    instance = provider.Stub(('{{"text": "The {0} {1} of {2} met {3} {4} {5} on day {n}."}}',))
    made = methods.instruct(pool, ["Decide whether a person is named.", "Decide whether it is private."], instance, limits)
    assert made.select("text").distinct().count() == made.count() > 0
    refuses = provider.Stub(("no",), broken=0)
    with pytest.raises(RuntimeError, match="short"):
        methods.fewshot(pool, refuses, methods.Limits(size=2, batch=2, attempts=4))


def test_contrastive_gates(spark):
    pairs = provider.Stub(('{{"sensitive_text": "My {0} is {1} at {2} and {3}, number {n}.", "nonsensitive_text": "The {0} is {1} at {2} and {3}, number {n}."}}',), broken=5)
    rubrics = spark.createDataFrame([("R1", "write"), ("R2", "compose")], "rubric_id string, prompt string")
    seeds = spark.createDataFrame([("The sky is blue.",)], "text string")
    rows = methods.contrastive(rubrics, seeds, pairs, methods.Limits(batch=12)).collect()
    assert len(rows) == 24 and {r.reason for r in rows} >= {None, "pair_parse_failed"}
    kept = [r.sensitive_text for r in rows if r.reason is None]
    assert len(kept) == len(set(kept)) > 0


INSTANCE = provider.Stub(('{{"text": "The {0} {1} of {2} met {3} {4} {5} on day {n}."}}',), broken=0)
PAIR = provider.Stub(('{{"sensitive_text": "My {0} is {1} at {2} and {3}, number {n}.", "nonsensitive_text": "The {0} is {1} at {2} and {3}, number {n}."}}',), broken=0)


def verdict(accept, *flags):
    return provider.Stub(("{{" + "".join(f'"{f}": true, ' for f in flags) + f'"copied_from_support": false, "accept": {accept}' + "}}",), broken=0)


def test_instances_pass_the_verifier(spark):
    pool = spark.createDataFrame(POOL, "label string, rank int, text string")
    made = lambda accept: methods.instruct(pool, ["Decide whether a person is named."], INSTANCE, methods.Limits(size=4, batch=4, attempts=8), verdict(accept, "label_correct", "natural"))
    assert made("false").count() == 0
    assert made("true").count() == 4


def test_instruction_pool_grows(spark):
    known = ["Decide whether a person is named."]
    listed = provider.Stub(('{{"instructions": ["Decide whether a person is named.", "Decide whether some secret bank details occur here.", "Say no."]}}',), broken=0)
    new = methods.expanded(spark, known, [], listed, 0)
    assert new == ["Decide whether some secret bank details occur here."]
    assert methods.expanded(spark, known, new, listed, 1) == []


def test_contrastive_is_a_quota_loop_with_verifier_and_breaker(spark):
    rubrics = spark.createDataFrame([("R1", "write"), ("R2", "compose")], "rubric_id string, prompt string")
    seeds = spark.createDataFrame([("The sky is blue.",)], "text string")
    flags = ("sensitive_label_correct", "nonsensitive_label_correct", "matched_pair")
    rows = methods.contrastive(rubrics, seeds, PAIR, methods.Limits(size=10, batch=2), verdict("true", *flags)).collect()
    kept = [r.rubric_id for r in rows if r.reason is None]
    assert (kept.count("R1"), kept.count("R2")) == (3, 2)
    refused = methods.contrastive(rubrics, seeds, PAIR, methods.Limits(size=4, batch=2, attempts=8), verdict("false", *flags)).collect()
    assert len(refused) == 8 and {r.reason for r in refused} == {"verifier_rejected"}
    with pytest.raises(RuntimeError, match="failed answers"):
        methods.contrastive(rubrics, seeds, provider.Stub(("no",), broken=0), methods.Limits(batch=2, failures=4)).collect()


def test_pairs_may_be_alike_inside(spark):
    rows = [(1, "p1", "a b c d e f g h i j k l m n o p q r s t x"), (1, "p1", "a b c d e f g h i j k l m n o p q r s t y"), (1, "p2", "a b c d e f g h i j k l m n o p q r s t z"), (1, "p3", "something else altogether here now")]
    df = spark.createDataFrame(rows, "all int, pair_id string, text string")
    assert {r.pair_id for r in methods._pair_independent(df).collect()} == {"p1", "p3"}


def test_judge_reads_labels_strictly(spark):
    pool = spark.createDataFrame(POOL, "label string, rank int, text string")
    rows = spark.createDataFrame([(i, f"text {i}", "Sensitive") for i in range(12)], "row_id bigint, text string, label string")
    out = methods.judged_by(rows, pool, provider.Stub((" Sensitive\n", "Label: Sensitive"), broken=0)).collect()
    assert {r.pred_label for r in out} == {"Sensitive", "__PARSE_FAILED__"} and all(r.parse_failed == (r.pred_label == "__PARSE_FAILED__") for r in out)


def test_breaker_and_custom_methods():
    assert provider.breaker_open(0, 5, 1, 5) and provider.breaker_open(3, 9, 5, 5) and not provider.breaker_open(1, 9, 4, 5)
    assert methods.custom("math:sqrt")(9) == 3
    with pytest.raises(ValueError, match="module:function"):
        methods.custom("math")


def test_files_and_stages(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    for name, n in (("train", 40), ("valid", 20), ("test", 20)):
        lines = [f'{{"text": " {"my secret" if i % 2 else "the weather"} {i} {name} ", "label": "{"Sensitive" if i % 2 else "Non-sensitive"}", "k": 1}}' for i in range(n)]
        (folder / f"{name}.jsonl").write_text("\n\n".join(lines) + "\n")
    rows = jsonl.load_validated(spark, f"{folder}/train.jsonl")
    assert rows.count() == 40 and rows.filter("text like ' %'").count() == 0
    assert jsonl.count_lines(spark, f"{folder}/train.jsonl") == 40 and jsonl.count_lines(spark, f"{folder}/none") == 0
    assert [r.line_no for r in jsonl.read_physical_lines(spark, f"{folder}/valid.jsonl").orderBy("line_no").limit(2).collect()] == [1, 3]
    (folder / "bad.jsonl").write_text('{"text": "x", "label": "other"}\n')
    with pytest.raises(ValueError, match="refused"):
        jsonl.load_validated(spark, f"{folder}/bad.jsonl")
    (folder / "broken.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_jsonl(spark, f"{folder}/broken.jsonl").collect()
    meta = pipeline.prepare(spark, str(folder), [1, 2], 3)
    assert meta["splits"]["train"]["label_counts"] == {"Non-sensitive": 20, "Sensitive": 20}
    assert jsonl.read_jsonl(spark, f"{folder}/seed_pools", "seed int, label string, rank int, text string").count() == 12
    run = jsonl.run_folder(str(tmp_path / "out"), "data", "official_train", 1)
    splits = [jsonl.load_validated(spark, f"{folder}/{name}.jsonl") for name in ("train", "valid", "test")]
    assert pipeline.train_eval(*splits, str(run), "official_train", 1)["best"]["in_test_acc"] > 0.9 and pipeline.evaluated(str(run))
    summary = pipeline.aggregate(spark, str(tmp_path / "out")).collect()
    assert summary[0].n == 1 and (tmp_path / "out/summary.md").read_text().count("|") > 10
    assert jsonl.discovered(str(tmp_path / "out"), ["data"]) == [("data", "official_train")]
    assert jsonl.selected("all", ["a"], ["a"]) == ["a"] and jsonl.label_ids(["b", "a"]) == {"b": 0, "a": 1}
    with pytest.raises(ValueError, match="unknown"):
        jsonl.selected("a,z", ["a"], ["a"])


def test_stream_accepts_each_text_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "accepted")
    for k, rows in enumerate([[(1, "A b"), (2, "c"), (3, "a  B")], [(4, "C"), (5, "d"), (6, None)]]):
        spark.createDataFrame([(i, x, "Sensitive") for i, x in rows], "id bigint, text string, label string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id bigint, text string, label string").parquet(source)
        accept_stream(stream, target, str(tmp_path / "state")).awaitTermination(120)
        assert {r.id for r in spark.read.parquet(target).collect()} == ({1, 2} if k == 0 else {1, 2, 5})


def test_sides_are_zipped_and_merged(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "at bigint, x string")
    right = spark.createDataFrame([(2, "q"), (1, "p")], "at bigint, y string")
    assert {(r.at, r.x, r.y) for r in merge.zipped(left, right, "at").collect()} == {(1, "a", "p"), (2, "b", "q")}
    with pytest.raises(Exception, match="only one side has place"):
        merge.zipped(left, right.filter("at = 1"), "at").collect()
    with pytest.raises(ValueError, match="several rows"):
        merge.zipped(left.union(left), right, "at")
    new = spark.createDataFrame([(1, "new"), (3, "c")], "at bigint, x string")
    assert {(r.at, r.x) for r in merge.upserted(left, new, "at").collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_numbers_run_over_spans(spark, monkeypatch):
    monkeypatch.setattr(merge, "SPAN", 10)
    rows = spark.range(95).select("id", (F.col("id") % 3).alias("g"))
    got = {(r.g, r.id): r.number for r in merge.running_numbers(rows, ["g"], "id", 5).collect()}
    assert all(n == i // 3 + 5 for (_, i), n in got.items()) and len(got) == 95


def test_settings_have_defaults_for_every_key(tmp_path):
    (tmp_path / "c.json").write_text('{"seeds": [7], "generation": {"n_samples": 3}, "seed_pool": null, "datasets": {"d": {"display_name": "D"}, "e": null}, "methods": {"train": ["official_train"]}, "custom_methods": {"m": "x:y"}}')
    got = config.load_config(tmp_path / "c.json")
    assert got.seeds == [7] and got.of("generation", "n_samples") == 3 and got.of("generation", "attempt_cap") == 20000
    assert got.of("seed_pool", "per_label") == 10 and got.of("methods", "direct_judge") == [] and got.methods == ["official_train", "m"]
    assert (got.datasets["d"].display_name, got.datasets["e"].display_name) == ("D", "e")
    assert got.datasets["d"].split("train") == str(tmp_path / "data/d/train.jsonl")
    with pytest.raises(ValueError, match="mapping"):
        config.with_defaults([1])


def test_label_maps_and_incomplete_runs(tmp_path):
    assert config.label_map(None) == {"Non-sensitive": 0, "Sensitive": 1} == config.label_map(tmp_path / "none.json")
    (tmp_path / "m.json").write_text('{"Sensitive": 5}')
    (tmp_path / "l.json").write_text("[1]")
    assert config.label_map(tmp_path / "m.json") == {"Sensitive": 5}
    with pytest.raises(ValueError, match="no mapping"):
        config.label_map(tmp_path / "l.json")
    assert config.allows_incomplete("x_100x", {"generation_status": "incomplete_card_budget"}) and not config.allows_incomplete("x", {"generation_status": "incomplete_card_budget"})
    assert not config.allows_incomplete("x_100x", {"allow_incomplete_training_data": False, "generation_status": "incomplete_card_budget"})
    assert config.seeds_of("first_person_rule", [1, 2]) == [0] and config.seeds_of("fewshot", [1, 2]) == [1, 2]


def test_release_walk_and_removal(spark, tmp_path):
    for name, text in (("a/b.py", "x = 1\nmail me@host.org\n"), ("data/c.py", "me@host.org"), (".gitignore", "/home/ann\n"), ("a/d.bin", "me@host.org"), ("a/.venv/e.py", "me@host.org"), ("a/f.md", "fine\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    lines = files.release_files(spark, str(tmp_path))
    assert {r.path for r in lines.select("path").collect()} == {"a/b.py", ".gitignore", "a/f.md"}
    hits = {(r.path, r.line_no, r.pattern, r.match) for r in files.findings(lines, [("mail", r"\w+@\w+\.org"), ("home", r"/home/\w+")]).collect()}
    assert hits == {("a/b.py", 2, "mail", "me@host.org"), (".gitignore", 1, "home", "/home/ann")}
    assert files.release_scan(spark, str(tmp_path), [("mail", r"\w+@\w+\.org")]) == 1 and files.release_scan(spark, str(tmp_path), [("none", "zzz")]) == 0
    (tmp_path / "model").mkdir()
    for name in ("w.safetensors", "vocab.json", "metrics.json"):
        (tmp_path / "model" / name).write_text("{}")
    assert files.remove_model_files(spark, str(tmp_path / "model")) == 2 and [p.name for p in (tmp_path / "model").iterdir() if p.suffix != ".crc"] == ["metrics.json"]
    files.copy(spark, str(tmp_path / "a/f.md"), str(tmp_path / "a/g.txt"))
    files.copy(spark, str(tmp_path / "a/g.txt"), str(tmp_path / "a/g.txt"))
    assert (tmp_path / "a/g.txt").read_text() == "fine\n"
    files.remove(spark, str(tmp_path / "a"))
    files.remove(spark, str(tmp_path / "a"))
    assert not (tmp_path / "a").exists()


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(f'{{"text": "{"x" * 90} {i}", "label": "Sensitive"}}\n' + ("\n" if i % 7 == 0 else "") for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = jsonl.read_physical_lines(spark, str(tmp_path / "big.jsonl"))
        assert rows.rdd.getNumPartitions() > 1
        got = {int(r.row.text.split()[-1]): r.line_no for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: i + 1 + -(-i // 7) for i in range(3000)}


def test_judges_draw_examples_for_every_row_and_ask_until_a_label_comes(spark):
    pool = spark.createDataFrame(POOL, "label string, rank int, text string")
    rows = spark.createDataFrame([(i, f"text {i}", "Sensitive") for i in range(30)], "row_id bigint, text string, label string")
    drawn = methods.drawn_examples(pool, rows, 1, 42).collect()
    assert all([e.label for e in r.support] == ["Non-sensitive", "Sensitive"] for r in drawn) and len({tuple(r.support) for r in drawn}) > 1
    out = methods.judged_by(rows, pool, provider.Stub((" Sensitive\n", "Label: Sensitive"), broken=0), tries=2).collect()
    assert all(r.attempts == 2 for r in out if r.parse_failed) and {1, 2} == {r.attempts for r in out if not r.parse_failed}
    with pytest.raises(Exception, match="no Sensitive examples"):
        methods.drawn_examples(pool.filter("label = 'Non-sensitive'"), rows, 1, 42).collect()


def test_like_known_equals_brute_force(spark):
    rng = random.Random(3)
    words = "one two three four five six seven eight nine ten".split()
    known = [" ".join(rng.choices(words, k=20)) for _ in range(15)]
    items = {i: " ".join(w if rng.random() > 0.04 else "zero" for w in rng.choice(known).split()) for i in range(40)} | {99: known[0], 98: known[0]}
    f1 = lambda a, b: 2 * lcs(a.split(), b.split()) / (len(a.split()) + len(b.split()))
    want = {i for i, x in items.items() if any(f1(x, k) >= 0.95 for k in known)}
    df = spark.createDataFrame([(1, i, x) for i, x in items.items()], "all int, id bigint, text string")
    refs = spark.createDataFrame([(1, k) for k in known], "all int, ref string")
    got = {r.id for r in curate.like_known(df, refs, ["all"], 0.95).collect()}
    assert got == want and 1 < len(want) < len(items)


def test_replicates_differ_and_repeat(spark):
    rows = spark.createDataFrame([(f"text {i}", "Sensitive") for i in range(2000)], "text string, label string")
    one, two, again = ([r.weight for r in train.resampled(rows, s).orderBy("text").collect()] for s in (1, 2, 1))
    assert one == again != two and 0.9 < sum(one) / 2000 < 1.1 and max(one) >= 4


RUBRICS = provider.Stub(('{{"rubrics": [{{"rubric_id": "A", "sensitive_condition": "names {0}", "nonsensitive_condition": "names none", "support_sensitive": ["S1", "S2", "S3"], "support_nonsensitive": ["N1", "N2", "N3"]}}, {{"rubric_id": "A", "sensitive_condition": "again", "nonsensitive_condition": "no", "support_sensitive": ["S1"], "support_nonsensitive": ["N1"]}}]}}',), broken=0)


def test_rubrics_are_extracted_per_context_and_merged(spark):
    pool = spark.createDataFrame([(x, i, f"{x} text {i}") for x in ("Sensitive", "Non-sensitive") for i in range(1, 5)], "label string, rank int, text string")
    got = methods.extracted_rubrics(pool, RUBRICS, 5, 3, 42).collect()
    assert [r.rubric_id for r in got] == [f"R{i:03d}_A" for i in range(1, 6)] and all(2 <= len(r.support_sensitive) <= 3 for r in got)
    assert all("Sensitive text 1" in r.prompt or "S1" not in r.support_sensitive for r in got)
    known = spark.createDataFrame([got[1]]).withColumn("sensitive_condition", F.lit("kept"))
    again = methods.extracted_rubrics(pool, RUBRICS, 5, 3, 42, known).collect()
    assert [r.sensitive_condition == "kept" for r in again] == [False, True, False, False, False]


def test_paraphrases_report_their_padding(spark):
    pool = spark.createDataFrame(POOL, "label string, rank int, text string")
    stub = provider.Stub(('["The {0} {1} stood by the {2} all day long {n}.", "A {3} and a {4} were seen near {5} at {n}."]',), broken=0)
    rows, report = methods.paraphrased(pool, stub, methods.Limits(size=len(POOL) * 3), 3)
    per = report.collect()
    assert rows.count() == len(POOL) * 3 and all(r.accepted + r.padding == 3 for r in per) and sum(r.accepted for r in per) > len(POOL)
    none, report = methods.paraphrased(pool, provider.Stub(("",), broken=0), methods.Limits(size=4), 2)
    assert none.count() == 4 and all((r.accepted, r.padding) == (0, 2) for r in report.collect())


def test_all_stages_of_a_grid(spark, tmp_path):
    for name, n in (("train", 40), ("valid", 20), ("test", 20)):
        place = tmp_path / "data/d" / f"{name}.jsonl"
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text("\n".join(f'{{"text": "{"my secret" if i % 2 else "the weather"} {i} {name}", "label": "{"Sensitive" if i % 2 else "Non-sensitive"}"}}' for i in range(n)) + "\n")
    (tmp_path / "c.json").write_text('{"seeds": [1, 2], "seed_pool": {"per_label": 2}, "methods": {"train": ["official_train", "duplicate", "oneshot"], "direct_judge": ["first_person_rule", "oneshot_judge"]}, "generation": {"n_samples": 8}, "trainer": {"eval_valid_size": 10}, "datasets": {"d": {"display_name": "Data"}}}')
    settings = config.load_config(tmp_path / "c.json")
    stub = provider.Stub(("My {0} {1} was left near the {2} on day {n}.>>>", "Sensitive"), broken=0)
    planned = pipeline.run_stages(spark, settings, "all", provider=stub, dry_run=True)
    assert planned[0] == "prepare d" and "generate d oneshot 2" in planned and not (tmp_path / "outputs").exists()
    done = pipeline.run_stages(spark, settings, "all", chosen="official_train,duplicate,first_person_rule,oneshot_judge", provider=stub, at_once=3)
    assert done[-1] == "aggregate" and "direct_judge d first_person_rule 0" in done
    summary = json.loads((tmp_path / "outputs/runs/summary.json").read_text())
    assert [(r["method"], r["n"], r["run_type"], r["display_name"]) for r in summary] == [
        ("official_train", 2, "trained_classifier", "Data"), ("duplicate", 2, "trained_classifier", "Data"), ("first_person_rule", 1, "direct_judge", "Data"), ("oneshot_judge", 2, "direct_judge", "Data")]
    assert pipeline.run_stages(spark, settings, "generate", chosen="oneshot", seeds=[1], provider=stub) == ["generate d oneshot 1"]
    folder = tmp_path / "outputs/runs/d/oneshot/seed_1"
    assert jsonl.count_lines(spark, f"{folder}/train.jsonl") == 8 and json.loads((folder / "generation_meta.json").read_text())["num_written"] == 8
    assert json.loads((tmp_path / "outputs/runs/d/official_train/seed_1/results/adv_results.json").read_text())["config"]["train_data"].endswith("data/d/train.jsonl")
    with pytest.raises(FileNotFoundError, match="no rows to train on"):
        pipeline.run_stages(spark, settings, "train_eval", chosen="oneshot", seeds=[2])
    with pytest.raises(ValueError, match="unknown"):
        pipeline.run_stages(spark, settings, "all", chosen="none")
    with pytest.raises(ValueError, match="no test accuracy"):
        pipeline.run_stages(spark, settings, "eval", chosen="oneshot", seeds=[1])


@pytest.mark.parametrize("threshold", [0.95, 0.9])
def test_close_edges_of_texts_of_all_lengths_equal_brute_force(spark, threshold):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(30)]
    texts = texts_with_edits(rng, 80) + ["w1", "w2 w1", "w1 w2"]
    for n in (19, 20, 21, 40, 60, 130):
        base = rng.choices(words, k=n)
        for edits in (1, 1, 2, 3, 6):
            x = list(base)
            for _ in range(edits):
                at = rng.randrange(len(x))
                x[at : at + rng.randrange(2)] = rng.choices(words, k=rng.randrange(2))
            texts.append(" ".join(x))
        texts += [" ".join(base), " ".join(base[n // 2 :] + base[: n // 2])]
    df = spark.createDataFrame([(i % 2, i, x.split()) for i, x in enumerate(texts)], "g int, id bigint, tokens array<string>")
    firsts = {}
    for i, x in enumerate(texts):
        firsts.setdefault((i % 2, x), i)
    ids = sorted(firsts.values())
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if a % 2 == b % 2 and f1(texts[a].split(), texts[b].split()) >= threshold}
    assert len(want) > 20 and {(r.a, r.b) for r in curate.rouge_edges(df, ["g"], threshold).collect()} == want


def shuffle_bytes(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(blocks.apply(i).length() for i in range(blocks.size()))


def test_close_edges_shuffle_little(spark):
    rng = random.Random(22)
    words = [f"w{i}" for i in range(500)]
    texts = [rng.choices(words, k=57) for _ in range(1000)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([*texts, [*texts[0][1:], "w0"]])], "g int, id bigint, tokens array<string>")
    before, edges = shuffle_bytes(spark), curate.rouge_edges(df, ["g"], 0.95)
    assert [(r.a, r.b) for r in edges.collect()] == [(0, 1000)]
    assert shuffle_bytes(spark) - before < 500 * len(texts)


def test_like_reference_equals_brute_force(spark):
    rng = random.Random(23)
    words = "one two three four five six seven eight nine ten".split()
    refs = {g: [" ".join(rng.choices(words, k=k)) for k in (1, 20, 22, 40)] for g in (1, 2)}
    items = [(g, " ".join(w if rng.random() > 0.03 else "zero" for w in rng.choice(refs[1 + (g > 1)]).split())) for g in (1, 2, 3) for _ in range(40)] + [(1, " "), (1, refs[1][0]), (2, refs[2][3] + " one")]
    df = spark.createDataFrame([(g, i, x) for i, (g, x) in enumerate(items)], "g int, id bigint, text string")
    known = spark.createDataFrame([(g, x) for g, xs in refs.items() for x in xs], "g int, ref string")
    want = {i for i, (g, x) in enumerate(items) if any(f1(x.split(), y.split()) >= 0.95 for y in refs.get(g, []))}
    got = [r.id for r in curate.like_reference(df, known, ["g"], 0.95).collect()]
    assert sorted(got) == sorted(want) and 10 < len(want) < 80
