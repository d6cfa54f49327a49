"""Flex patterns against a plain loop over random line-ups; schemas, slugs and repeated names on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from boardloom.operators import dimensions as dm
from boardloom.operators import lineups as lu


def brute(pool, carry):
    """Members of each pattern with its shell, straight from the rule."""
    left, out = sorted(pool, key=lambda x: (-pool[x], x)), []
    while left:
        anchor, best = left[0], None
        for unit in set(anchor) - {carry}:
            shell = list(anchor)
            shell.remove(unit)
            members = [m for m in left if len(m) == len(anchor) and any(sorted([*shell, u]) == list(m) for u in set(m) - {carry})]
            rank = (-len(members), -sum(pool[m] for m in members), shell)
            if len(members) > 1 and (best is None or rank < best[0]):
                best = rank, members
        members = best[1] if best else [anchor]
        out.append((best[0][2] if best else None, sorted(members, key=lambda x: (-pool[x], x))))
        left = [m for m in left if m not in members]
    return out


@pytest.mark.parametrize("carry", [None, "a"])
def test_patterns(spark, carry):
    rng = random.Random(5)
    rows, pools = [], {}
    for w in ("w1", "w2"):
        for size in (3, 4):
            pool = {tuple(sorted(rng.choice("abcde") for _ in range(size))): rng.randint(2, 6) for _ in range(25)}
            pool = {x: n for x, n in pool.items() if carry is None or carry in x}
            pools[w, size] = pool
            rows += [(w, 7, carry, list(x), n) for x, n in pool.items()]
    table = spark.createDataFrame(rows, "balance_window string, level int, carry string, lineup array<string>, boards long")
    got = {}
    for r in lu.board_patterns(table, "carry" if carry else None).collect():
        got.setdefault((r.balance_window, r.size), {}).setdefault(r.pattern, []).append((r.place, tuple(r.lineup), r.shell))
    for key, pool in pools.items():
        want = [(shell, members) for shell, members in brute(pool, carry)]
        found = [(p[0][2], [m for _, m, _ in p]) for _, p in sorted((k, sorted(v)) for k, v in got[key].items())]
        assert found == want


def test_schema_gate(spark):
    rows = spark.createDataFrame([(1, "x")], "id long, name string")
    dm.schema_gate({"t": rows}, {"t": {"id": "bigint", "name": "string"}})
    with pytest.raises(ValueError, match="t.cost: missing; t.id: bigint is not string; u.a: missing"):
        dm.schema_gate({"t": rows}, {"t": {"cost": "int", "id": "string"}, "u": {"a": "int"}})


def test_breakpoints_without_effects(spark):
    rows = spark.createDataFrame([("a", None, None, None), ("b", 0, 2, 3), ("b", 1, 4, 9)], "trait_id string, pos int, low int, high int")
    got = {r.trait_id: (r.breakpoints, r.rejected) for r in dm.trait_breakpoints(rows).collect()}
    assert got == {"a": (None, "no effects listed"), "b": ([2, 4], None)}


def test_name_keys(spark):
    from boardloom.functions.rules import id_key, name_key

    rows = spark.createDataFrame([("Kha'Zix",), ("Éß ﬁ ①Å",), (None,), ("TFT_Item_InfinityEdge",), ("DA_18_Fiddle18",), ("TFT9_Lux_AP",)], "t string")
    got = rows.select(name_key(F.col("t")).alias("n"), id_key(F.col("t")).alias("i")).collect()
    assert [r.n for r in got] == ["khazix", "efi1a", "", "tftiteminfinityedge", "da18fiddle18", "tft9luxap"]
    assert [r.i for r in got][3:] == ["infinityedge", "fiddle", "lux"]
