"""Retrieval packing over the whole table: statistics, search and shards."""

import math
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_brute_force import check_packing

from boardloom.llm import packing, tokens


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain_order(docs, window):
    n, df = len(docs), Counter(t for d in docs for t in set(d.tolist()))
    mean = sum(map(len, docs)) / n

    def bm25(q, d):
        tf = Counter(docs[d].tolist())
        return sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) for t in set(docs[q].tolist()) & set(tf))

    left, order, filled, seed = set(range(n)), [], 0, None
    while left:
        d = min(left) if seed is None else max(sorted(left), key=lambda d: bm25(seed, d))
        seed = d if seed is None else seed
        order.append(d)
        left.remove(d)
        before, filled = filled // window, filled + len(docs[d])
        if filled // window > before:
            seed = d if filled % window else None
    return order


def test_order_is_bm25_over_all_terms():
    rng = np.random.default_rng(5)
    docs = [rng.integers(2, 400, rng.integers(40, 160)).astype(np.uint16) for _ in range(60)]
    assert packing.fill_order(docs, 512) == plain_order(docs, 512)


def test_result_does_not_follow_files(docs):
    rows = lambda df: Counter(map(tuple, packing.pack(df).collect()))
    assert rows(docs.repartition(1)) == rows(docs.orderBy(F.desc("doc_id")).repartition(37))


def test_statistics_and_shards(docs, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 100_000)
    texts = docs.where("n_chars between 1500 and 6000").limit(40).select("doc_id", "text")
    table = docs.select("doc_id", "text").union(texts.withColumn("doc_id", F.col("doc_id") + 10_000_000)).repartition(50, "doc_id")
    rows = packing.tokenised(table.withColumn("grp", F.lit("")), None)
    ids = [np.frombuffer(r["ids"], "<u2") for r in rows.select("ids").collect()]
    got, expected = packing.statistics_of(rows), packing.Statistics.of(ids)
    assert (got.idf == expected.idf).all() and got.mean == expected.mean
    shards = {r["doc_id"]: r["shard"] for r in packing.sharded(rows, got).collect()}
    copies = [r["doc_id"] for r in texts.collect()]
    assert len(set(shards.values())) >= 5
    assert sum(shards[d] == shards[d + 10_000_000] for d in copies) >= 0.9 * len(copies)
    pieces = packing.pack(table)
    check_packing(table, pieces)


def test_copies_of_one_row_do_not_share_a_shard(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 20_000)
    table = spark.range(1).select(F.lit(7).alias("doc_id"), F.explode(F.array_repeat(F.lit("one two three " * 60), 600)).alias("text"))
    pieces = packing.pack(table)
    sizes = defaultdict(int)
    for p in pieces.collect():
        sizes[p["sequence_id"] >> packing.SHARD_BITS] += p["length"]
    assert max(sizes.values()) <= 40_000
    check_packing(table, pieces)


def test_used_documents_leave_the_sums(monkeypatch):
    """Sums run over the documents that are left, and neither rows nor lists nor leaving changes a score."""
    rng = np.random.default_rng(6)
    docs = [np.minimum(rng.zipf(1.3, rng.integers(40, 160)) + 1, 3000).astype(np.uint16) for _ in range(200)]
    statistics = packing.Statistics.of(docs)
    index, one = packing.Bm25(docs, statistics), [packing.Bm25([d], statistics) for d in docs]
    expected = np.array([[sum(dict(zip(x.term.tolist(), x.rows[:, 0].tolist())).get(t, 0.0) for t in packing.term_counts(docs[q])[0].tolist()) for x in one] for q in (0, 7, 199)])
    unused = rng.random(200) < 0.5
    assert [index.scores(q).tolist() for q in (0, 7, 199)] == expected.tolist()
    index.keep(unused)
    assert [index.scores(q).tolist() for q in (0, 7, 199)] == expected[:, unused].tolist()

    summed, scores = [], packing.Bm25.scores
    monkeypatch.setattr(packing.Bm25, "scores", lambda self, d: summed.append(len(out := scores(self, d))) or out)
    assert packing.fill_order(docs, 256, statistics) == plain_order(docs, 256)
    assert sum(summed) < 0.65 * len(summed) * len(docs)


def test_shared_words_are_encoded_once(monkeypatch):
    """Ids are the library's whatever the white space and the block, and the encoder sees a word of a block once."""
    rng = random.Random(7)
    parts = [" ", "\n", "  ", "\n\n", " \n", "a", "The", "'s", "'", "'ll", "12", "é", "—", "...", "<|endoftext|>", "<|endof", "text|>", "\t", "日本", "²"]
    texts = [None, "", " ", "\n", *("".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(3000))]
    encoder = tokens.Encoder()
    expected = [encoder.library.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
    for size, part, words in ((1, 1, 1), (50, 10, 1), (10_000, 700, 7), (500, 1_000, 100), (32_000_000, 4_000_000, 1 << 16)):
        monkeypatch.setattr(tokens, "BLOCK_CHARS", size)
        monkeypatch.setattr(tokens, "PART_CHARS", part)
        monkeypatch.setattr(tokens, "SLICE_WORDS", words)
        assert [x.tolist() for x in encoder.encode_all(texts)] == expected

    class Counted:
        seen = 0

        def __getattr__(self, name):
            def encode(text, *args, **more):
                Counted.seen += len(text)
                return getattr(plain, name)(text, *args, **more)

            return encode

    plain, init = encoder.plain, tokens.Encoder.__init__

    def counted(self, *args):
        init(self, *args)
        self.plain = Counted()

    monkeypatch.setattr(tokens.Encoder, "__init__", counted)
    words = [f"word{i}" for i in range(300)]
    table = pd.DataFrame({"doc_id": range(200), "text": [" ".join(rng.choices(words, k=400)) for _ in range(200)], "grp": ""})
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(packing, "staged", lambda rows: rows)
    (rows,) = packing.tokenised(SimpleNamespace(mapInPandas=lambda f, schema: f(iter([table]))), None)
    assert [np.frombuffer(x, "<u2").tolist() for x in rows["ids"]] == [[*plain.encode_ordinary(t), packing.END_ID] for t in table["text"]]
    assert Counted.seen < 0.02 * table["text"].str.len().sum() + 200 * 8
