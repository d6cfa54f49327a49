"""Spelling variants, near-duplicate vectors and token alignment against plain Python."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardloom.llm import alignment, embedding_dedup, queries, spelling

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def rows_by(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


# --- spelling variants -------------------------------------------------------------------------


def slipped(doc_id, run):
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]


def one_edit(word):
    """Patterns that two words share when they differ by one replaced or one deleted code point."""
    return [word[:i] + "\0" + word[i + 1 :] for i in range(len(word))], [word[:i] + word[i + 1 :] for i in range(len(word))]


def variants_by_hand(documents):
    n = Counter(slipped(i, r.translate(ASCII_LOWER)) for i, t in documents for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near, holes = defaultdict(set), defaultdict(set)
    for w in n:
        replaced, deleted = one_edit(w)
        for p in replaced:
            holes[p].add(w)
        for p in set(deleted) & n.keys():
            near[w].add(p)
            near[p].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: min(near[w], key=lambda o: (-n[o], o)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items()), key=repr)


SPELLING = ("word", "form", "root", "n", "n_near", "form_n")


def test_spelling_query(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert rows_by(queries.op11_spelling(spark, sf_dir), *SPELLING) == variants_by_hand(documents)


def test_spelling_of_made_up_words(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeÉé×") for _ in range(rng.randint(6, 13))) for _ in range(60)]
    words = []
    for w in base:
        words += [w] * rng.randint(5, 200)
        for _ in range(4):
            i, c = rng.randrange(len(w)), rng.choice("abcdeÉé")
            words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])] * rng.randint(4, 30)
    words += ["shared" + c for c in "abcdefghijklmnopqrstuvwxyz" for _ in range(5)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa"] * 6
    rng.shuffle(words)
    documents = [(i if i % 7 else None, " ".join(words[i::40]).upper() if i % 3 else " ".join(words[i::40])) for i in range(40)]
    documents += [(50, None), (51, ""), (52, "×÷ 1 2"), *documents[:2]]
    frame = spark.createDataFrame([(*d, "x", 3) for d in documents], "doc_id long, text string, word string, n long")
    found = spelling.variant_groups(spelling.counted(spelling.with_slips(spelling.runs(frame))))
    assert rows_by(found, *SPELLING) == variants_by_hand(documents)


def test_spelling_of_nothing(spark):
    frame = spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")
    assert spelling.variant_groups(spelling.counted(spelling.with_slips(spelling.runs(frame)))).count() == 0
    lone = spark.createDataFrame([("apples", 9), ("oranges", 7)], "word string, n long")
    assert rows_by(spelling.variant_groups(lone), *SPELLING) == [("apples", None, "apples", 9, 0, None), ("oranges", None, "oranges", 7, 0, None)]


@pytest.mark.parametrize("least_points", [2, 4])
def test_pairs_of_short_words(spark, least_points):
    """Every two words of a small alphabet, down to two letters."""
    words = [a + b + c + d for a in "ab" for b in "ab" for c in ("", "a", "b") for d in ("", "a", "b", "ab")]
    words = sorted({w for w in words if len(w) >= least_points})
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    expected = set()
    for w in words:
        for o in words:
            if w != o and (set(one_edit(w)[0]) & set(one_edit(o)[0]) or w in one_edit(o)[1] or o in one_edit(w)[1]):
                expected.add(frozenset((w, o)))
    found = [frozenset((r.a, r.b)) for r in spelling.near_pairs(frame, least_points=least_points).collect()]
    assert len(found) == len(set(found))
    assert set(found) == expected


# --- near-duplicate vectors --------------------------------------------------------------------


def linked_by_hand(rows, least=0.98):
    """Sorted (vec_id, n_links, component_id, kept) by definition."""
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = Counter(), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for at, i in enumerate(good):
        for j in good[at + 1 :]:
            (_, v, label), (_, w, other) = rows[i], rows[j]
            if label == other and len(v) == len(w):
                a, b = np.array(v, float) / np.abs(v).max(), np.array(w, float) / np.abs(w).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r[0])
    first = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((r[0], links[i], first[root(i)], r[0] == first[root(i)]) for i, r in enumerate(rows)), key=repr)


VECTORS = ("vec_id", "n_links", "component_id", "kept")
VECTOR_SCHEMA = "vec_id long, embedding array<double>, label int, node long, links long, kept boolean"


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, 5, 6, False) for r in rows], VECTOR_SCHEMA)


def test_vector_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert rows_by(queries.op12_embedding_dedup(spark, sf_dir), *VECTORS) == linked_by_hand(rows)


@pytest.mark.parametrize(("dims", "tile"), [(64, 4096), (20, 40), (3, 16), (1, 4096)])
def test_vectors_near_the_limit(spark, dims, tile):
    """Chains and clusters around the limit, copies, and rows that take no part."""
    rng = np.random.default_rng(dims)
    rows, centres = [], rng.standard_normal((6, dims))
    for k in range(240):
        centre = centres[k % 6] / np.linalg.norm(centres[k % 6])
        noise = rng.standard_normal(dims)
        v = centre + noise / np.linalg.norm(noise) * (0.02 + 0.3 * (k % 11) / 11)
        rows.append((k if k % 50 else None, (v * 10.0 ** rng.integers(-3, 4)).tolist(), int(k % 6 % 2) if k % 17 else None))
    rows += [(1000 + k, rows[1][1], 1) for k in range(5)] + [rows[2], rows[2]]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * dims, 1), (2003, [None] * dims, 1), (2004, [float("nan")] * dims, 0), (2005, [float("inf")] * dims, 0), (2006, [1.0] * (dims + 1), 1), (2007, [1.0] * (dims + 1), 1)]
    found = embedding_dedup.near_vectors(vectors_of(spark, rows), tile=tile)
    assert rows_by(found, *VECTORS) == linked_by_hand(rows)


def test_no_vectors(spark):
    assert embedding_dedup.near_vectors(vectors_of(spark, [])).count() == 0


def test_every_pair_is_in_one_leaf():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((700, 8)), np.zeros((300, 8))]).astype(np.float32)
    y = rng.standard_normal((500, 8)).astype(np.float32)
    for other, same in ((x, True), (y, False)):
        seen = Counter()
        for left, right in embedding_dedup._leaves(x, other, np.float32(1.5), same):
            assert len(left) * len(right) <= max(embedding_dedup.LEAF, 16 * len(right))
            for i in left:
                seen.update((int(i), int(j)) for j in right if not same or i < j)
        assert max(seen.values()) == 1
        near = ((x[:, None, :].astype(float) - other[None]) ** 2).sum(-1) <= 1.5**2
        if same:
            near &= np.tri(len(x), k=-1, dtype=bool).T
        assert set(zip(*(a.tolist() for a in np.nonzero(near)), strict=True)) <= set(seen)


# --- alignment of tokenizers -------------------------------------------------------------------


@pytest.fixture(scope="module")
def plain_tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        names = {int(i): base64.b64decode(t) for t, i in map(bytes.split, f)}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and b.is_byte(i) else p.replace("▁", " ").encode()

    def encode(text):
        if not text:
            return [], []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        told = (" " + text).encode()
        if b"".join(names.get(i, b"<|endoftext|>") for i in x) != told or b"".join(map(b_bytes, y)) != told:
            return [], []
        return [(i, len(names[i])) for i in x], [(i, len(b_bytes(i))) for i in y]

    return encode


def spans(tokens):
    at = 0
    for i, n in tokens:
        yield i, at, at + n
        at += n


def aligned_by_hand(documents, encode):
    told, counts = [], Counter()
    for doc_id, text in documents:
        a, b = encode(text)
        a, b = list(spans(a)), list(spans(b))
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        links, j = [], 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        groups, low = [], 0
        ga, gb = defaultdict(list), defaultdict(list)
        for tokens, of in ((a, ga), (b, gb)):
            k = 0
            for i, s, _ in tokens:
                while cuts[k] <= s:
                    k += 1
                of[cuts[k]].append(str(i))
        groups = [f"{','.join(ga[c])}|{','.join(gb[c])}" for c in cuts]
        counts.update(set(links))
        told.append((doc_id, len(a), len(b), links, groups))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for doc_id, n_a, n_b, links, groups in told:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out, key=repr)


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_query(spark, sf_dir, plain_tokenizers):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert rows_by(queries.op13_alignment(spark, sf_dir), *ALIGNED) == aligned_by_hand(documents, plain_tokenizers)


@pytest.mark.parametrize("block_bytes", [1, 300, 1 << 22])
def test_alignment_of_odd_texts(spark, plain_tokenizers, block_bytes):
    texts = ["a", " ", "  two  spaces ", "\t\ttabs\n\n\nlines\r\n", "café naïve Été", "日本語の文章 \U0001f600\U0001f468‍\U0001f469", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ block ▁", "\x00 nul \x01"]
    texts += ["a" * 3000, "ab" * 999 + " ", " " * 50, "words " * 400, "é combining", "ﬁ ligature ½ Ａ", "x = [1,2,3]; // code\n    return 0", None, "", "a", "a"]
    rng = random.Random(9)
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 1000), rng.randint(0x4E00, 0x4F00), 32, 10])) for _ in range(300)) for _ in range(12)]
    documents = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(*d, 1, "p") for d in documents], "doc_id long, text string, block long, pairs string").coalesce(2)
    assert rows_by(alignment.align(frame, block_bytes=block_bytes), *ALIGNED) == aligned_by_hand(documents, plain_tokenizers)


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows_by(alignment.align(blank), *ALIGNED) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_groups_by_halves():
    """Cuts found from the middle outwards are all cuts, however the ends lie."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        sizes = rng.integers(1, 40, rng.integers(1, 5))
        a_ends, b_ends, a_first, b_first, at = [], [], [0], [0], 0
        for n in sizes:
            for ends, first in ((a_ends, a_first), (b_ends, b_first)):
                ends += sorted({*(at + 1 + np.flatnonzero(rng.random(n) < rng.random())).tolist(), int(at + n)})
                first.append(len(ends))
            at += int(n)
        starts_a, starts_b = alignment.group_starts(*map(np.array, (a_ends, b_ends, a_first, b_first)))
        cuts = sorted(set(a_ends) & set(b_ends))[:-1]
        assert starts_a.tolist() == [0] + [a_ends.index(c) + 1 for c in cuts]
        assert starts_b.tolist() == [0] + [b_ends.index(c) + 1 for c in cuts]
