"""The training-data queries: rows equal to their SQL on the smallest tables; reports agree with what they report on."""

import os
from collections import Counter, defaultdict

import pytest

from differential import connect, differences
from seedloom.llm import queries, similar_sql

SF = "/root/testdata/sf0.001"
QUERIES = queries.queries()
SQL = queries.oracle_sql() | {"p1_found": similar_sql.P1_FOUND_SQL, "p2_found": similar_sql.P2_FOUND_SQL}


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, SQL[name]) == []


def test_reached_shares_are_those_of_the_sample(spark, con):
    drawn = Counter((r.table_name, r.dataset, r.label) for r in QUERIES["p4_sample"](spark, SF).collect())
    shares = QUERIES["p4_shares"](spark, SF).collect()
    assert {(r.table_name, r.dataset, r.label): r.quota for r in shares if r.quota} == dict(drawn)
    for name in ("synthetic_data", "test"):
        assert sum(r.reached_share for r in shares if r.table_name == name) == pytest.approx(1)


def test_redaction_replaces_what_was_found(spark, con):
    found = defaultdict(list)
    for r in QUERIES["p5_found"](spark, SF).collect():
        found[r.table_name, r.row_id].append(r.pii_kind)
    original = {(t, i): text for t in ("train", "synthetic_data") for i, text in con.execute(f"SELECT row_id, text FROM {t}").fetchall()}
    out = {(r.table_name, r.row_id): r.redacted for r in QUERIES["p5_redacted"](spark, SF).collect()}
    assert set(out) == set(original) and len(found) > 50
    assert all(text == original[k] for k, text in out.items() if k not in found)
    assert all(out[k].count(f"[{kind.upper()}]") >= found[k].count(kind) for k in found for kind in found[k])


def test_containers_hold_every_token_and_none_too_many(spark, con):
    capacity = dict(con.execute("SELECT pack_name, capacity_tokens FROM pack_sizes").fetchall())
    fill, tokens, docs = Counter(), Counter(), defaultdict(set)
    for r in QUERIES["p6_packing"](spark, SF).collect():
        fill[r.pack_name, r.container_id] += r.n_tokens
        tokens[r.pack_name] += r.n_tokens
        docs[r.pack_name].add(r.doc_id)
    assert len(set(tokens.values())) == 1 == len({frozenset(d) for d in docs.values()}) and set(tokens) == set(capacity)
    assert all(n <= capacity[p] for (p, _), n in fill.items())
    report = {r.pack_name: r for r in QUERIES["p6_fill_report"](spark, SF).collect()}
    assert all((r.tokens, r.containers, r.documents) == (tokens[p], sum(k[0] == p for k in fill), len(docs[p])) for p, r in report.items())


def test_mixed_shares_are_those_of_the_mix(spark, con):
    targets = {r[0]: r for r in con.execute("SELECT source, target_share, max_repeats, budget_tokens FROM mix_targets").fetchall()}
    used, most = Counter(), Counter()
    for r in QUERIES["p7_mix"](spark, SF).collect():
        used[r.source] += r.n_tokens * r.times
        most[r.source] = max(most[r.source], r.times)
    assert all(n <= targets[s][2] for s, n in most.items())
    shares = QUERIES["p7_shares"](spark, SF).collect()
    assert {r.source: r.actual_tokens for r in shares if r.actual_tokens} == dict(used)
    assert all(r.actual_tokens <= r.target_tokens and r.actual_tokens + r.shortfall_tokens == r.target_tokens for r in shares)


def test_restored_documents_are_those_found(spark, con):
    found = {r.doc_id for r in QUERIES["p8_found"](spark, SF).collect()}
    restored = QUERIES["p8_restored"](spark, SF).collect()
    assert found == {r.doc_id for r in restored} and found
    original = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    assert all(r.restored != original[r.doc_id] and r.channels for r in restored)
