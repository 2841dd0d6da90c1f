"""Proportional samples, packing, mixing and exact draws."""

import random
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seedloom.llm import draw, mixing, packing, proportions, token_counts


def test_draws_are_exact_and_repeatable(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"))
    quota = spark.createDataFrame([("hot", 1234), ("cold", 7), ("none", 5)], "g string, quota bigint")
    one, two = ({r.id for r in draw.draw(rows, ["g"], quota, [F.col("id")], 3).collect()} for _ in range(2))
    assert one == two and Counter("hot" if i % 3 else "cold" for i in one) == {"hot": 1234, "cold": 7}
    more = spark.createDataFrame([("hot", 9999)], "g string, quota bigint")
    assert draw.draw(rows, ["g"], more, [F.col("id")], 3).count() == 2000


def test_draws_tell_equal_rows_apart(spark):
    rows = spark.range(100).select(F.lit(5).alias("id"), F.lit("g").alias("g"))
    assert draw.draw(rows, ["g"], spark.createDataFrame([("g", 40)], "g string, quota bigint"), [F.col("id")], 1).count() == 40


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(1, 20), st.integers(0, 200), st.integers(0, 15)), min_size=1, max_size=8, unique_by=lambda c: c[:2]), st.integers(0, 150))
def test_quotas_respect_floors_and_availability(raw, total):
    weight = sum(c[2] for c in raw)
    cells = [{"row": a, "column": b, "share": w / weight, "floor": f, "available": n} for a, b, w, n, f in raw]
    quota, short = proportions.quotas(cells, total)
    assert sum(quota) == min(total, sum(c["available"] for c in cells))
    for c, q, s in zip(cells, quota, short, strict=True):
        assert 0 <= q <= c["available"]
        wanted = max(c["share"] * total, c["floor"])
        assert (s > 0) == (c["available"] < wanted - 1e-6)
    floors = [min(c["floor"], c["available"]) for c in cells]
    if sum(floors) <= total:
        assert all(q >= f for q, f in zip(quota, floors, strict=True))


def test_whole_numbers_add_up():
    for seed in range(50):
        shares = [0.2, 0.3, 0.25, 0.25]
        out = proportions._whole(shares, 7, seed)
        assert sum(out) == 7 and all(abs(o - s * 7) < 1 for o, s in zip(out, shares, strict=True))


def targets(spark, rows):
    return spark.createDataFrame(rows, "table_name string, dataset string, label string, target_share double, min_rows bigint, sample_rows bigint")


def test_sample_and_report(spark):
    rows = [(i, "d" if i % 2 else "e", "A" if i % 5 else "B", 1) for i in range(400)] + [(None, None, "A", 1), (7, "d", None, 1)]
    df = spark.createDataFrame(rows, "row_id bigint, dataset string, label string, quota int")
    want = targets(spark, [("t", "d", "A", 0.5, 5, 100), ("t", "d", "B", 0.3, 5, 100), ("t", "e", "A", 0.1, 20, 100), ("t", "e", "C", 0.1, 5, 100)])
    sample, report = proportions.proportional_sample(df, want)
    got = {(r.dataset, r.label): r for r in report.collect()}
    assert (got["e", "C"].shortfall, got["e", "C"].quota) == (10, 0) and got["e", "A"].quota >= 20
    assert Counter((r.dataset, r.label) for r in sample.collect()) == {k: r.quota for k, r in got.items() if r.quota}
    assert sum(r.quota for r in got.values()) == 100 and sum(r.reached_share for r in got.values()) == pytest.approx(1)


def test_samples_of_nothing(spark):
    df = spark.createDataFrame([], "row_id bigint, dataset string, label string")
    sample, report = proportions.proportional_sample(df, targets(spark, [("t", "d", "A", 1.0, 1, 10)]))
    assert sample.count() == 0 and [(r.shortfall, r.reached_share) for r in report.collect()] == [(10, None)]
    sample, report = proportions.proportional_sample(df, targets(spark, []))
    assert sample.count() == 0 and report.count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 8))
def test_packer_never_overfills(sizes, limit):
    p = packing.Packer(50, limit)
    fill = Counter()
    for s in sizes:
        fill[p.place(s)] += s
        assert len(p.open) <= limit
    assert all(v <= 50 for v in fill.values())


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(1)
    sizes = {i: max(1, int(rng.lognormvariate(4.3, 0.9))) for i in range(3000)}
    df = spark.createDataFrame([*sizes.items(), (None, 5), (1, 6), (9000, 0), (9001, None)], "doc_id bigint, n_tokens bigint").withColumn("pack", F.lit("x"))
    packs = spark.createDataFrame([("a", 256), ("b", 1000), ("c", None), ("d", 0)], "pack_name string, capacity_tokens bigint")
    rows = packing.packed(df, packs, "doc_id").collect()
    for name, capacity in (("a", 256), ("b", 1000)):
        mine = [r for r in rows if r.pack_name == name]
        fill = Counter()
        for r in mine:
            fill[r.container_id] += r.n_tokens
        assert max(fill.values()) <= capacity and sum(fill.values()) == sum(sizes.values()) + 11
        assert sum(fill.values()) / (capacity * len(fill)) > 0.97
        pieces = Counter(r.doc_id for r in mine)
        assert all(pieces[i] == max(1, -(-n // capacity)) for i, n in sizes.items() if i != 1) and pieces[None] == 1
    assert {r.pack_name for r in rows} == {"a", "b"}
    assert packing.packed(df.limit(0), packs, "doc_id").count() == 0 and packing.packed(df, packs.limit(0), "doc_id").count() == 0


def test_every_pack_is_filled_however_many(spark, monkeypatch):
    monkeypatch.setattr(packing, "PASS", 500)
    items = spark.createDataFrame([(i, 3 + i) for i in range(4)], "doc_id bigint, n_tokens bigint")
    packs = spark.createDataFrame([(f"p{i}", 10 + i // 2) for i in range(2400)], "pack_name string, capacity_tokens bigint")
    rows = packing.packed(items, packs, "doc_id").collect()
    assert {r.pack_name for r in rows} == {f"p{i}" for i in range(2400)} and len(rows) == 4 * 2400


def test_many_cells_are_planned_quickly():
    rng = random.Random(5)
    cells = [{"row": i % 100, "column": i // 100, "share": 1 / 30_000, "floor": rng.randrange(3), "available": rng.randrange(60)} for i in range(30_000)]
    began = time.time()
    quota, short = proportions.quotas(cells, 600_000)
    assert sum(quota) == 600_000 and time.time() - began < 120
    assert all((s > 0) == (c["available"] < max(20, c["floor"])) and q <= c["available"] for c, q, s in zip(cells, quota, short, strict=True))


def test_tokens_of_blank_and_long_texts(spark):
    df = spark.createDataFrame([(1, "Hello world", 5), (2, None, 5), (3, " \n ", 5), (4, "word " * 20_000, 5)], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and set(got) == {1, 4} and got[4] >= 20_000


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=6), st.integers(0, 200))
def test_fitting_is_as_near_as_can_be(counts, budget):
    lengths = sorted(counts)
    take = mixing.fitted_counts(lengths, [counts[n] for n in lengths], budget)
    assert all(0 <= k <= counts[n] for n, k in zip(lengths, take, strict=True))
    total = sum(n * k for n, k in zip(lengths, take, strict=True))
    everything = sum(n * c for n, c in counts.items())
    assert total <= max(budget, 0) or total == everything <= budget
    if everything <= budget:
        assert total == everything


def test_fitting_hits_reachable_sums():
    assert mixing.fitted_counts([3, 5], [4, 4], 0) == [0, 0]
    for budget in range(0, 33):
        best = max(3 * a + 5 * b for a in range(5) for b in range(5) if 3 * a + 5 * b <= budget)
        take = mixing.fitted_counts([3, 5], [4, 4], budget)
        assert 3 * take[0] + 5 * take[1] >= best - 5


def test_mix_meets_targets_and_caps(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["big", "big", "big", "small", "other", None]), rng.randrange(5, 60)) for i in range(3000)]
    rows += [(90_000 + i, "tiny", 10) for i in range(3)] + [(99_999, "big", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").withColumn("target_share", F.lit(1))
    want = spark.createDataFrame([("big", 0.5, 1, 20_000), ("small", 0.4, 4, 20_000), ("tiny", 0.05, 3, 20_000), ("absent", 0.05, 2, 20_000)], "source string, target_share double, max_repeats bigint, budget_tokens bigint")
    use, report = mixing.mixed(df, want)
    times, got = use.collect(), {r.source: r for r in report.collect()}
    assert got["big"].actual_tokens == 10_000 and got["small"].actual_tokens == 8_000
    assert (got["tiny"].actual_tokens, got["tiny"].shortfall_tokens, got["absent"].actual_tokens) == (90, 910, 0)
    assert max(r.times for r in times if r.source == "big") == 1 and {r.times for r in times if r.source == "tiny"} == {3}
    used = Counter()
    for r in times:
        used[r.source] += r.times * r.n_tokens
    assert all(used[s] == r.actual_tokens for s, r in got.items())
    empty, shares = mixing.mixed(df.limit(0), want)
    assert empty.count() == 0 and all(r.actual_tokens == 0 and r.actual_share is None for r in shares.collect())
    assert mixing.mixed(df, want.limit(0))[0].count() == 0
