"""Queries over all their rows: small tables against plain restatements."""

import datetime
import random

import pytest

from anchorage.operators import links
from anchorage.plans import catalogue


@pytest.fixture
def run(spark, tmp_path):
    """Writes tables of (schema, rows) and collects a query over them."""

    def over(name, **found):
        for table, (schema, rows) in found.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        return catalogue.QUERIES[name](spark, str(tmp_path)).collect()

    return over


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_dup_ids_of_all_customers(run):
    names = [(k, f"Customer#{k:09d}") for k in [*range(295, 315), 1300, 15000]] + [(20000, "Customer#00000301"), (20001, "Brand#1")]
    got = run("near_dup_ids", customer=("c_custkey long, c_name string", names), part=("p_brand string", [("Brand#11",), ("Brand#12",), ("Brand#11",)]))
    ids = {n for _, n in names} | {"Brand#11", "Brand#12"}
    want = {(a, b) for a in ids for b in ids if a < b and _distance(a, b) <= 1}
    assert ("Customer#000000301", "Customer#000000302") in want
    assert sorted(map(tuple, got)) == sorted(want)


def test_near_ids_by_brute_force(spark):
    rng = random.Random(7)
    ids = {"".join(rng.choice("aabcé𝄞") for _ in range(rng.randint(0, 5))) for _ in range(150)} | {"", "a"}
    rows = [(v,) for v in [*ids, *list(ids)[:40], None, None]]
    got = links.one_edit_apart(spark.createDataFrame(rows, "v string"), "v")
    want = sorted((a, b) for a in ids for b in ids if a < b and _distance(a, b) <= 1)
    assert {len(b) - len(a) for a, b in want} == {-1, 0, 1} and ("", "a") in want
    assert sorted(map(tuple, got.collect())) == want


def test_near_ids_are_never_broadcast(spark):
    """Forms are many times their ids: sizes of a small file once let the join broadcast them, and 900,000 names failed."""
    got = links.one_edit_apart(spark.range(1000).selectExpr("cast(id as string) as v"), "v")
    assert len(got.collect()) > 1000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pool_match_of_all_parts(run):
    part = [(10, "green bolt", "LARGE TIN"), (11, "green bolt", "SMALL TIN"), (12, "blue rod", "LARGE STEEL"), (21, "odd nut", "ECONOMY BRASS"), (30, "blue rod", "LARGE STEEL")]
    got = dict(map(tuple, run("pool_match", part=("p_partkey long, p_name string, p_type string", part))))
    words, pool = {}, {t for _, _, t in part}
    for _, name, kind in part:
        words.setdefault(name, set()).update(f"{name} {kind}".lower().split())
    want = {}
    for name, own in words.items():
        score = {t: len(own & set(t.lower().split())) for t in pool}
        best = [t for t in pool if score[t] == max(score.values()) > 0]
        want[name] = best[0] if len(best) == 1 else None
    assert want == {"green bolt": None, "blue rod": "LARGE STEEL", "odd nut": "ECONOMY BRASS"}
    assert got == want


def test_denorm_consistency_of_all_orders(run):
    got = run(
        "denorm_consistency",
        orders=("o_orderkey long, o_custkey long, o_orderstatus string", [(1, 1, "F"), (2, 1, "O"), (3, 2, "P"), (4, 2, "F")]),
        customer=("c_custkey long, c_nationkey int", [(1, 5), (2, 6)]),
        supplier=("s_suppkey long, s_nationkey int", [(1, 5), (2, 6)]),
        lineitem=("l_orderkey long, l_linenumber int, l_suppkey long", [(1, 1, 1), (1, 2, 2), (2, 1, 2), (3, 1, 1), (4, 1, 2)]),
    )
    assert sorted(map(tuple, got)) == [(1, 2, 6, 5), (2, 1, 6, 5), (3, 1, 5, 6)]


def test_wide_to_long_of_all_lines(run):
    schema = "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    lines = [(1, 1, "R", 1.0, 2.0, 0.1, 0.2), (1, 2, "A", 3.0, 4.0, 0.3, 0.4), (2, 1, "N", 5.0, 6.0, 0.5, 0.6)]
    got = run("wide_to_long", lineitem=(schema, lines))
    assert {tuple(r) for r in got} == {(o, n, m, v) for o, n, _, *vs in lines for m, v in zip(("quantity", "price", "discount", "tax"), vs)}
    assert len(got) == 12


def test_round_trip_of_all_documents(run):
    got = run("round_trip", documents=("doc_id long, text string", [(n, "") for n in range(1, 7)]), labels=("doc_id long", [(2,), (3,), (9,)]))
    assert dict(map(tuple, got)) == {1: "only_text", 2: "both", 3: "both", 4: "only_text", 5: "only_text", 6: "only_text", 9: "only_label"}
    assert len(got) == 7


def test_latest_by_field_of_all_events(run):
    at = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    events = [(1, 7, "view", 1.0, at[0]), (3, 7, "view", 2.0, at[1]), (6, 7, "click", 3.0, at[0]), (4, 8, "view", 4.0, at[2]), (9, 8, "view", 5.0, at[2])]
    got = run("latest_by_field", events=("event_id long, user_id long, event_type string, value double, ts timestamp", events))
    assert sorted((r.user_id, r.event_type, r.event_id, r.value) for r in got) == [(7, "click", 6, 3.0), (7, "view", 3, 2.0), (8, "view", 9, 5.0)]


def test_polygon_norm_of_all_coordinates(run):
    vectors = {1: [float(n) for n in range(64)], 2: [612.0, -306.0], 3: [1.0] * 5}
    got = run("polygon_norm", embeddings=("vec_id long, embedding array<float>", list(vectors.items())))
    assert {(r.vec_id, r.i): r.x for r in got} == {(k, i): round(x / 612, 9) for k, v in vectors.items() for i, x in enumerate(v)}
    assert len(got) == 71


def test_typed_signals_know_letters_beyond_ascii(run):
    got = {r.doc_id: r for r in run("typed_signals", documents=("doc_id long, text string", [(1, "a señr se"), (2, "a señr"), (3, "maïs sown in May 2003"), (4, ""), (5, None)]))}
    assert [got[i].statistic for i in (1, 2, 4, 5)] == [True, False, False, None]
    assert got[3].management_verb and got[3].date and not got[3].doi
