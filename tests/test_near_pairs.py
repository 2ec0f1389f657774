"""Near pairs and greedy dedupe: both ways of search against brute force, and nothing broadcast that can outgrow its estimate."""

import random
from itertools import combinations

import pytest

from framesift.catalog import QUERIES, _hashes
from framesift.operators import choose

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most, rows", [(10, 10**7), (3, 10**5), (18, 10**5), (18, 3000)])
def test_near_pairs_of_groups_either_way(spark, most, rows):
    rnd = random.Random(most)
    hashes = [(rnd.choice([None, 1, 2]), rnd.getrandbits(64)) for _ in range(60)]
    hashes += [(g, h ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 24)))) for g, h in hashes for _ in range(3)]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    df = spark.createDataFrame([(i, g, signed(h)) for i, (g, h) in enumerate(hashes)], "id long, g int, hash long")
    want = sorted((i, j, (a ^ b).bit_count()) for (i, (f, a)), (j, (g, b)) in combinations(enumerate(hashes), 2) if f == g and (a ^ b).bit_count() <= most)
    for way in (choose.keyed_pairs, choose.compared_pairs):
        assert sorted(map(tuple, way(df, most, ("g",), rows if way is choose.compared_pairs else 100).collect())) == want, way
    assert sorted(map(tuple, choose.near_pairs(df, most, ("g",), rows if most < 18 else None).collect())) == want


def test_keys_are_taken_where_they_pay():
    assert choose.keys_pay(10**7, 10) and choose.keys_pay(10**5, 3)
    assert not choose.keys_pay(10**4, 10) and not any(choose.keys_pay(10**k, 18) for k in range(7))


def test_pairs_are_never_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan(QUERIES["near_pairs"](spark, DATA))
    assert "BroadcastExchange" not in plan(choose.keyed_pairs(_hashes(spark, DATA), 10, (), 10**6))


def test_arcs_of_the_greedy_pass_are_never_broadcast(spark, monkeypatch):
    from framesift.sources import shared

    plans, cut = [], shared.cut_lineage
    monkeypatch.setattr(shared, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    QUERIES["greedy_dedupe"](spark, DATA)
    assert len(plans) > 3 and not any("BroadcastExchange" in plan for plan in plans)
