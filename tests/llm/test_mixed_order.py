"""The mixed order survives to the pipeline's rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_brute_force import check_packing

import corpus_pipeline
from boardloom.llm import mixing, packing


@pytest.fixture(scope="module")
def skewed(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = F.pmod(F.col("doc_id"), F.lit(12))
    return docs.withColumn("source", F.when(at < 8, "a").when(at < 11, "b"))


def test_mixed_rows_stand_in_schedule_order(skewed):
    placed = mixing.schedule(skewed, block_chars=20_000).collect()
    expected = [r["doc_id"] for r in sorted(placed, key=lambda r: (r["slot"], r["block_offset"], r["doc_id"]))]
    assert [r["doc_id"] for r in mixing.mixed(skewed, block_chars=20_000).collect()] == expected


def test_source_shares_in_prefixes_of_the_stream(spark, skewed, sf_dir):
    source = {r["doc_id"]: r["source"] or "\0" for r in skewed.select("doc_id", "source").collect()}
    mixed = skewed.orderBy("n_chars").repartition(5)
    pieces = dict(corpus_pipeline.STAGES)["packing"](spark, mixed, sf_dir)
    rows = pieces.collect()
    check_packing(skewed, pieces)
    assert [(r["sequence_id"], r["offset"]) for r in rows] == sorted((r["sequence_id"], r["offset"]) for r in rows)
    of_sequence = {}
    for r in rows:
        assert of_sequence.setdefault(r["sequence_id"], source[r["doc_id"]]) == source[r["doc_id"]]

    weights = mixing.target_weights(skewed)
    period = mixing.SLOTS * len(weights)
    shares = mixing.whole_shares(weights, period)
    total, block = Counter(), packing.BLOCK_TOKENS
    for r in rows:
        total[source[r["doc_id"]]] += r["length"]
    done, at, checked = Counter(), 0, 0
    for slot in range(1, period + 1):
        while at < len(rows) and rows[at]["sequence_id"] < slot * block:
            done[source[rows[at]["doc_id"]]] += rows[at]["length"]
            at += 1
        for s, n in shares.items():
            due = n * slot * block / period
            if due + block < total[s]:
                assert abs(done[s] - due) <= block + packing.WINDOW
                checked += 1
    assert checked > 30
    assert at == len(rows)


def test_packing_follows_what_mixing_decided(spark, skewed, tmp_path):
    """Weights and order of mixing show in the packed rows, and files make no difference to rows that were not written."""
    weights = {"a": 1.0, "b": 1.0, "\0": 6.0}
    mixed = mixing.mixed(skewed, weights=weights)
    mixed.write.parquet(str(tmp_path / "mixed"))
    written = spark.read.parquet(str(tmp_path / "mixed"))
    assert written.columns == skewed.columns
    place = {r["doc_id"]: (r["source"] or "\0", i) for i, r in enumerate(mixed.collect())}
    pieces = packing.pack(written, source_col="source")
    check_packing(skewed, pieces)
    rows = [tuple(r) for r in pieces.collect()]
    assert rows == [tuple(r) for r in packing.pack(mixed, source_col="source").collect()]

    first = {}
    for doc, _, _, _, _, sequence, offset in rows:
        if offset == 0:
            first.setdefault(place[doc][0], []).append(place[doc][1])
    assert all(len(x) > 2 and x == sorted(x) for x in first.values())
    by_id = [tuple(r) for r in packing.pack(skewed, source_col="source").collect()]
    assert [r[0] for r in by_id] != [r[0] for r in rows]

    shares, block = mixing.whole_shares(weights, mixing.SLOTS * 3), packing.BLOCK_TOKENS
    due = {(s, t % 384) for t, (s, _) in enumerate(mixing.pfair_period(shares))}
    assert all((place[r[0]][0], r[5] // block % 384) in due for r in rows)
