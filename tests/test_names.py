"""Texts made of ids, and orders that rest on names."""

from pyspark.sql import functions as F

from boardloom.functions import rules
from boardloom.operators import evidence as ev

SHOWN = {
    "DA_Artifact_LichBane": "Lich Bane",
    "DA_EdgeOfNightRadiant": "Edge of Night",
    "TFT_Item_GuinsoosRageblade": "Guinsoos Rageblade",
    "TFT12_Item_HTTPServerOfDoom": "HTTP Server of Doom",
    "TFT_Item_12_BladeOfTheKing": "Blade of the King",
    "DA_7_Foo2Bar_bazQux": "Foo2 Bar baz Qux",
    "TheSwordAndABow": "The Sword and a Bow",
    "TFT_Item_": "TFT_Item_",
    "Radiant": "Radiant",
    "": "",
    "TFT": "TFT",
}


def test_readable_ids(spark):
    rows = spark.createDataFrame([(k,) for k in SHOWN], "id string")
    assert {r["id"]: r["shown"] for r in rows.select("id", rules.readable_id(F.col("id")).alias("shown")).collect()} == SHOWN
    assert spark.createDataFrame([(None,)], "id string").select(rules.readable_id(F.col("id")).alias("x")).first()["x"] is None


def test_item_kinds(spark):
    rows = spark.createDataFrame([("DA_Artifact_A", "artifact"), ("Artifact", "artifact"), ("MyArtifacts", "standard"), ("XRadiant", "radiant"), ("TFT_Item_FooEmblemItem", "emblem"), (None, "standard")], "id string, kind string")
    got = rows.select("kind", rules.item_kind(F.col("id"), F.lit(None).cast("boolean"), F.lit(True)).alias("k")).collect()
    assert [r["k"] for r in got] == [r["kind"] for r in got]


def test_recurrence_by_name(spark):
    rows = [("w", "c1", 1, 10), ("w", "c2", 1, 10), ("w", "c3", 2, 10), ("w", "c3", 1, 10), ("w", "c4", 1, 30), ("w", "zz", 1, 10), ("v", "c1", 1, 5)]
    stats = spark.createDataFrame(rows, "balance_window string, character_id string, cost int, commitment_games long")
    names = spark.createDataFrame([("c1", "Zed"), ("c2", "Ahri"), ("c3", "Ahri"), ("c4", "Yone"), ("c9", "Lux")], "character_id string, name string")
    shown = dict(names.collect())
    for up in (False, True):
        got = ev.recurrence_order(stats, up, names)
        assert got.columns == [*stats.columns, "place"]
        order = sorted((r for r in rows if r[0] == "w"), key=lambda r: (r[3] if up else -r[3], shown.get(r[1], r[1]), r[1], r[2]))
        assert [(r["character_id"], r["cost"]) for r in got.where("balance_window = 'w'").orderBy("place").collect()] == [r[1:3] for r in order]
