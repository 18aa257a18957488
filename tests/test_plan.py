"""Plan operators: hand-worked cases, invariants, plain sequential sums."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skupulse.operators import plan as pl

D = dt.date(2018, 3, 25)


CELLS = "scenario string, date date, sku_cluster_ID int, warehouse int, demand double, inventory double"
ROUTES = "source_warehouse int, destination_warehouse int, route_feasible int, lead_time_hours double"


def test_rule_transfers_by_hand(spark):
    # warehouse 1 lacks 5, warehouse 2 lacks 3; 3 spares 4 and 4 spares 3
    cells = [("o", D, 1, w, dem, inv) for w, dem, inv in [(1, 7.0, 2.0), (2, 3.0, 0.0), (3, 0.0, 4.0), (4, 1.0, 4.0)]]
    routes = [(3, 1, 1, 9.0), (4, 1, 1, 2.0), (3, 2, 1, 1.0), (4, 2, 0, 1.0)]
    got = pl.rule_transfers(spark.createDataFrame(cells, CELLS), spark.createDataFrame(routes, ROUTES)).collect()
    # the larger deficit goes first, by the shorter route; 2 gets what 3 has left
    assert sorted((r.source_warehouse, r.destination_warehouse, r.transfer_units) for r in got) == [(3, 1, 2.0), (3, 2, 2.0), (4, 1, 3.0)]


def test_rule_transfers_invariants(spark):
    rnd = random.Random(7)
    wh = list(range(6))
    feasible = {(a, b): rnd.random() < 0.7 for a in wh for b in wh if a != b}
    stock = {(s, j): (float(rnd.randint(0, 9)), float(rnd.randint(0, 9))) for s in range(5) for j in wh}
    cells = spark.createDataFrame([("o", D, s, j, d, i) for (s, j), (d, i) in stock.items()], CELLS)
    routes = spark.createDataFrame([(a, b, int(f), float(rnd.randint(1, 40))) for (a, b), f in feasible.items()], ROUTES)
    moved_in, moved_out = {}, {}
    for r in pl.rule_transfers(cells, routes).collect():
        assert feasible[r.source_warehouse, r.destination_warehouse] and r.transfer_units > 0
        for book, j in ((moved_out, r.source_warehouse), (moved_in, r.destination_warehouse)):
            key = (r.sku_cluster_ID, j)
            book[key] = book.get(key, 0.0) + r.transfer_units
    spare = {k: max(i - d, 0.0) - moved_out.get(k, 0.0) for k, (d, i) in stock.items()}
    lack = {k: max(d - i, 0.0) - moved_in.get(k, 0.0) for k, (d, i) in stock.items()}
    assert min(spare.values()) >= 0 and min(lack.values()) >= 0
    # nothing feasible is left undone
    assert not [1 for s in range(5) for (a, b), f in feasible.items() if f and spare[s, a] > 1e-8 and lack[s, b] > 1e-8]


def test_replay_closed_form_matches_loop(spark):
    rnd = random.Random(3)
    days = [D + dt.timedelta(days=i) for i in range(7)]
    i0 = 4.0
    proc = [float(rnd.randint(0, 5)) for _ in days]
    act = [float(rnd.randint(0, 9)) for _ in days]
    pos = spark.createDataFrame([("s", d, 0, 1, i0, p, 0.0, 0.0) for d, p in zip(days, proc)],
                                "scenario string, date date, sku_cluster_ID int, warehouse int, inventory double, "
                                "procurement_units double, incoming double, outgoing double")
    actual = spark.createDataFrame([(d, 0, 1, a) for d, a in zip(days, act)],
                                   "date date, sku_cluster_ID int, warehouse int, demand double")
    got = [r.replayed_inventory for r in pl.replay_plan(pos, actual).orderBy("date").collect()]
    inv, want = i0, []
    for p, a in zip(proc, act):
        inv = max(inv + p - a, 0.0)
        want.append(inv)
    assert got == pytest.approx(want)


def test_capacity_trim_cheapest_first(spark):
    rows = [("s", D, 0, 1, 5.0, 1.0), ("s", D, 1, 1, 4.0, 3.0), ("s", D, 2, 1, 6.0, 2.0)]
    r = spark.createDataFrame(rows, "scenario string, date date, sku_cluster_ID int, warehouse int, "
                                    "realized_ending_inventory double, p_s double")
    cap = spark.createDataFrame([(1, 8.0)], "warehouse int, C_j double")
    out = {x.sku_cluster_ID: (x.realized_ending_inventory, x.realized_capacity_overflow)
           for x in pl.capacity_trim(r, cap).collect()}
    # overflow 7: cluster 0 (price 1) loses 5, cluster 2 (price 2) loses 2, cluster 1 keeps 4
    assert out == {0: (0.0, 5.0), 2: (4.0, 2.0), 1: (4.0, 0.0)}
