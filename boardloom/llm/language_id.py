"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; digits, white space and symbols fold to one character each. All 1- to
3-grams of a text are hashed into 2**16 buckets; a bucket's feature is its share of the text's
n-grams times its inverse document frequency. Weights are learned by follow-the-regularised-leader
with an elastic net (the L1 part leaves most of them zero); a temperature fitted on held-back
training rows then calibrates the probabilities.

Languages are numbered by name and stand in a tree of at most ``fanout`` children a node, so up to
``fanout`` of them share one regression; with more, each node has its own, and a language's probability is the
product along its path, of which a prediction takes the best child at each node.

Document frequencies are counted over all training rows. A regression is fitted on a bounded
sample: about ``per_language`` rows of each child, chosen by a hash of doc_id and text, and fewer
where their n-grams would exceed ``NODE_NGRAMS`` in all. A node's sample is one task's work; its
features, not its texts, travel there. The driver sees the root's weights alone, the sparse table
of one node. A prediction reads the text alone, and the whole of it.

Cases: null text, or one without a letter, is ``und`` with score 0. Rows with a null lang teach
nothing and are predicted like others. Without any training row everything is ``und``; with
one language, every text with a letter is that one. Repeated rows give equal results, one for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardloom.operators.ranks import spread_row_number

from ._common import discard, staged

BUCKETS = 1 << 16
ORDERS = 3
PER_LANGUAGE = 600
FANOUT = 256
#: N-grams of a node's sample at the most, in expectation: 6 bytes each in its task.
NODE_NGRAMS = 1 << 26
#: Texts of a node that are judged together below the root.
ROWS_PER_SLICE = 2048
CALIBRATION_SHARE = 0.2
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.5, 1e-3
SCALE = 100.0
UNKNOWN = "und"
CHUNK = 1 << 16


def _fold_table() -> np.ndarray:
    """Code points below 2**16 to what an n-gram sees: letters stay, the rest folds to three classes."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for c in range(0x2100):
        s = chr(c)
        if not s.isalpha():
            table[c] = 1 if s.isspace() else 2 if s.isdigit() else 3
    return table


FOLD = _fold_table()


def ngram_buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the bucket of every n-gram start over the joined texts, and text lengths.

    A text gets one blank at its end, so that no text is shorter than one n-gram; n-grams that
    would reach over the end take the next text's blank-separated start with them only in the last
    ORDERS - 1 places, which are masked to the blank.
    """
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    points = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 1 << 16, FOLD[np.minimum(points, 0xFFFF)], points)
    ends = np.cumsum(sizes)
    out = []
    gram = np.zeros(len(points), np.uint32)
    for order in range(ORDERS):
        shifted = np.full(len(points), 1, np.uint32)
        shifted[: len(points) - order] = points[order:]
        for back in range(1, order + 1):
            shifted[ends - back] = 1
        gram = gram * np.uint32(0x9E3779B1) + shifted + np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)
        out.append(((gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.uint16))
    return out, sizes


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = load = 0
    for i, t in enumerate(texts):
        load += len(t) + 1
        if load >= CHUNK or i == len(texts) - 1:
            yield start, i + 1
            start, load = i + 1, 0


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents of ``texts`` (text) that hold each bucket, and how many there are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        mark = np.full(BUCKETS, -1, np.int64)
        for batch in batches:
            for text in batch["text"]:
                own = np.concatenate(ngram_buckets([text])[0])
                mark[own] = np.arange(len(own))
                df[own[mark[own] == np.arange(len(own))]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(df[at], n)})

    rows = texts.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(BUCKETS), 0
    for r in rows:
        if r["bucket"] < 0:
            n = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return df, n


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    own = np.concatenate(ngram_buckets([text])[0])
    counts = np.bincount(own, minlength=0)
    at = np.flatnonzero(counts)
    return at, counts[at] / len(own)


class Ftrl:
    """FTRL-proximal for a softmax over ``k`` classes with per-coordinate rates."""

    def __init__(self, dims: int, k: int):
        self.z, self.n = np.zeros((dims, k)), np.zeros((dims, k))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fitted_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return -np.log(np.maximum(p, 1e-12)).mean()

    a, b, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def numbered_languages(labelled: DataFrame, fanout: int) -> tuple[DataFrame, int]:
    """(lang, place, n, ngrams), places from 0 by name, and the height of the tree."""
    ngrams = F.sum(F.least(F.lit(BUCKETS), ORDERS * (F.length("text") + 1)).cast("long"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), ngrams.alias("ngrams"))
    langs = staged(spread_row_number(counts, [], [F.col("lang")], "place").withColumn("place", F.col("place").cast("long") - 1))
    height, room, n = 1, fanout, langs.count()
    while room < n:
        height, room = height + 1, room * fanout
    return langs, height if n else 0


def tree_nodes(langs: DataFrame, height: int, fanout: int) -> DataFrame:
    """(height, node, first, k, names): a node's children are ``first`` .. ``first + k - 1``, those at height 1 languages; ``names`` are the first language of each."""
    out = None
    for h in range(1, height + 1):
        child = F.floor(F.col("place") / fanout ** (h - 1))
        kids = langs.groupBy(child.alias("child")).agg(F.min("lang").alias("lang"))
        # a node has at most fanout children
        own = kids.groupBy(F.floor(F.col("child") / fanout).alias("node")).agg(F.min("child").alias("first"), F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_list("lang")).alias("names"))
        own = own.select(F.lit(h).alias("height"), "node", "first", "k", "names")
        out = own if out is None else out.unionByName(own)
    return out


def node_samples(labelled: DataFrame, langs: DataFrame, height: int, fanout: int, per_language: int) -> DataFrame:
    """(height, node, k, label, id, lang, text): the rows that each node learns from.

    Equal rows have one coin: without them a child has about ``per_language`` rows.
    """
    shares = []
    for h in range(1, height + 1):
        child, node = (F.floor(F.col("place") / fanout**x) for x in (h - 1, h))
        kids = langs.groupBy(child.alias("child")).agg(F.count(F.lit(1)).alias("members"))
        sizes = kids.groupBy(F.floor(F.col("child") / fanout).alias("node")).agg(F.count(F.lit(1)).alias("k"), F.min("child").alias("first"))
        placed = langs.withColumns({"child": child, "node": node}).join(kids, "child").join(sizes, "node")
        rows, grams = F.lit(float(per_language)) / F.col("n") / F.col("members"), F.lit(float(NODE_NGRAMS)) / F.col("k") / F.col("members") / F.col("ngrams")
        shares.append(placed.select("lang", F.lit(h).alias("height"), "node", "k", (F.col("child") - F.col("first")).cast("int").alias("label"), F.least(F.lit(1.0), rows, grams).alias("share")))
    table = shares[0]
    for more in shares[1:]:
        table = table.unionByName(more)
    coin = F.pmod(F.xxhash64("id", "text", F.lit(17)), F.lit(1_000_000)) / 1_000_000.0
    picked = labelled.withColumn("coin", coin).join(table, "lang").where("coin < share")
    return picked.select("height", "node", "k", "label", "id", "lang", "text").distinct()


def fitted(rows: pd.DataFrame, k: int, idf: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (bucket, child) and temperature of one node from (id, lang, label, at, tf)."""
    order = sorted(range(len(rows)), key=lambda i: (rows["no_id"][i], rows["id"][i], rows["lang"][i], rows["at"][i], rows["tf"][i]))
    data = [(np.frombuffer(rows["at"][i], np.uint16), np.frombuffer(rows["tf"][i], np.float32), int(rows["label"][i])) for i in order]

    def example(i: int) -> tuple[np.ndarray, np.ndarray, int]:
        at, tf, label = data[i]
        return at.astype(np.int64), SCALE * tf * idf[at], label

    shuffled = np.random.default_rng(7).permutation(len(data))
    held = int(len(data) * CALIBRATION_SHARE)
    model = Ftrl(BUCKETS, k)
    for _ in range(EPOCHS):
        for i in shuffled[held:]:
            model.learn(*example(i))
    w = model.weights()
    logits, truth = np.zeros((held, k)), np.zeros(held, int)
    for j, i in enumerate(shuffled[:held]):
        at, x, truth[j] = example(i)
        logits[j] = x @ w[at]
    return (SCALE * idf[:, None] * w).astype(np.float32), fitted_temperature(logits, truth)


def train(labelled: DataFrame, *, per_language: int = PER_LANGUAGE, fanout: int = FANOUT) -> tuple[DataFrame, int]:
    """The nodes of the model from (id, text, lang), and the tree's height (0: nothing to learn from).

    A node is (height, node, first, k, names, buckets, labels, weights, temperature); its weights
    are those that are not zero.
    """
    langs, height = numbered_languages(labelled, fanout)
    if not height:
        return langs, 0
    df, n = document_frequencies(labelled.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1.0

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [_features(t) for t in batch.pop("text")]
            yield batch.assign(at=[a.astype(np.uint16).tobytes() for a, _ in got], tf=[x.astype(np.float32).tobytes() for _, x in got])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        table, temperature = fitted(rows, int(rows["k"][0]), idf)
        buckets, labels = np.nonzero(table)
        return pd.DataFrame({"height": rows["height"][:1], "node": rows["node"][:1], "buckets": [buckets.astype(np.uint16).tobytes()], "labels": [labels.astype(np.uint16).tobytes()], "weights": [table[buckets, labels].tobytes()], "temperature": [temperature]})

    sample = node_samples(labelled, langs, height, fanout, per_language)
    sample = sample.withColumns({"no_id": F.col("id").isNull(), "id": F.coalesce("id", F.lit(0).cast("long"))})
    kept = "height int, node long, k long, label int, id long, lang string, no_id boolean"
    learned = sample.select(*[c.split()[0] for c in kept.split(", ")], "text").mapInPandas(features, f"{kept}, at binary, tf binary")
    learned = learned.groupBy("height", "node").applyInPandas(fit, "height int, node long, buckets binary, labels binary, weights binary, temperature double")
    # a node whose rows all escaped the sample knows its children and no more
    model = staged(tree_nodes(langs, height, fanout).join(learned, ["height", "node"], "left"))
    discard(langs)
    return model, height


def node_table(node) -> np.ndarray:
    """Weights of a node as (bucket, child)."""
    table = np.zeros((BUCKETS, int(node["k"])), np.float32)
    if node["buckets"] is not None:
        table[np.frombuffer(node["buckets"], np.uint16), np.frombuffer(node["labels"], np.uint16)] = np.frombuffer(node["weights"], np.float32)
    return table


def judged(texts: list[str], table: np.ndarray, temperature: float | None) -> tuple[np.ndarray, np.ndarray]:
    """The best child for each whole lower-cased text, and its calibrated probability."""
    best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for a, b in _runs(texts):
        orders, sizes = ngram_buckets(texts[a:b])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        logits = sum(np.add.reduceat(table[g], starts, axis=0, dtype=np.float64) for g in orders)
        p = softmax(logits / (ORDERS * sizes[:, None]) / (1.0 if temperature is None else temperature))
        best[a:b] = p.argmax(axis=1)
        score[a:b] = p[np.arange(b - a), best[a:b]]
    return best, score


JUDGED = "id string, text string, held_out boolean, name string, child long, score double"


def from_root(cols: DataFrame, root: dict, keep_text: bool) -> DataFrame:
    """(id, text, held_out, name, child, score) of each text from the root; a row without a letter has no name and child -1."""

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = node_table(root)
        for batch in batches:
            live = np.flatnonzero(batch.pop("known").to_numpy(bool))
            best, p = judged(batch["text"].iloc[live].tolist(), table, root["temperature"])
            names, child, score = np.full(len(batch), None, object), np.full(len(batch), -1, np.int64), np.zeros(len(batch))
            names[live], child[live], score[live] = np.array(root["names"], object)[best], root["first"] + best, p
            batch = batch if keep_text else batch.assign(text=None)
            yield batch.assign(name=names, child=child, score=score)

    return cols.mapInPandas(predict, JUDGED)


def from_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` as :func:`from_root` gives them, each judged once more by the node that is its child.

    A node's rows are dealt to slices by their place in the written table, and each slice has the
    node's weights beside it, so neither a frequent node nor copies nor the number of nodes bear on a task.
    """
    rows = staged(rows.withColumn("at", F.monotonically_increasing_id()))
    live = rows.where("child >= 0")
    slices = staged(live.groupBy("child").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_SLICE).cast("int").alias("slices")))
    dealt = live.join(slices, "child").withColumn("slice", F.pmod(F.xxhash64("at"), F.col("slices")).cast("int")).drop("slices", "at")
    beside = nodes.withColumnRenamed("node", "child").drop("height").join(slices, "child").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")

    def predict(texts: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        texts = texts.drop(columns="slice")
        if texts.empty:
            return texts
        node = model.to_dict("records")[0]
        best, p = judged(texts["text"].tolist(), node_table(node), None if pd.isna(node["temperature"]) else node["temperature"])
        return texts.assign(name=np.array(list(node["names"]), object)[best], child=node["first"] + best, score=texts["score"].to_numpy() * p)

    keys = ("child", "slice")
    told = dealt.groupBy(*keys).cogroup(beside.groupBy(*keys)).applyInPandas(predict, JUDGED)
    return told.unionByName(rows.where("child < 0").drop("at"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: Column | None = None, per_language: int = PER_LANGUAGE, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the rows that ``held`` leaves."""
    held = held_out(F.col(id_col)) if held is None else held
    text = F.col(text_col).cast("string")
    cols = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(text).alias("text"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("known"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(held, F.lit(False)).alias("held_out"))
    nodes, height = train(cols.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("known")).select("id", "text", "lang"), per_language=per_language, fanout=fanout)
    if not height:
        return cols.select(F.col("id").alias("doc_id"), "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    root = nodes.where(F.col("height") == height).collect()[0].asDict()
    # as text, so that pandas has no reason to turn ids beside a null into floats
    found = from_root(cols.select(F.col("id").cast("string").alias("id"), "text", "known", "held_out"), root, keep_text=height > 1)
    for h in range(height - 1, 0, -1):
        found = from_nodes(found, nodes.where(F.col("height") == h))
    return found.select(F.col("id").cast("long").alias("doc_id"), "held_out", F.coalesce("name", F.lit(UNKNOWN)).alias("lang_pred"), "score")
