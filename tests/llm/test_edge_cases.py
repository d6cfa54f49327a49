"""Odd, empty and clashing tables for every corpus operator and pipeline stage, values against plain Python."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1
#: Columns that operators use or return, as columns of the input.
CLASH = "block long, slot long, block_offset long, n_lines long, n_removed long, kept_text string, word string, n long, doc long, twin long, node long, bucket long, component_id long, kept boolean, grp string, shard long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
CLASHING = (-1, -2, -3, -4, -5, "t", "w", 7, 8, 9, 10, 11, 12, False, "g", 13)


def prose(rng, n, words=400):
    return " ".join(f"{rng.choice('bcdfghklmnprst')}{rng.choice('aeiou')}{rng.randint(0, words)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, blank, short and very long texts, copies, near copies, repeated rows, columns that clash."""
    rng = random.Random(3)
    base, other = prose(rng, 220), prose(rng, 180)
    near = base.split()
    near[20], near[150] = "changed", "twice"
    line = "\n".join(prose(rng, 12) for _ in range(6))
    long = " ".join(f"word{i % 97} item{i % 89}" for i in range(20_000))
    texts = [
        (1, base), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, "one two three four"), (7, " ".join(near)), (8, other), (None, base), (None, other), (9, long), (10, long),
        (11, f"{prose(rng, 60)}\n{line}\n{prose(rng, 30)}"), (12, f"{prose(rng, 40)}\n{line}"), (13, line), (14, "Été <|endoftext|> naïve 日本語 " * 30), (15, "#*$%&|<> " * 30), (16, "²½ 12 ①"), (17, base.upper()), (1, base), (None, None),
    ]
    rows = [(i, t, None if k % 3 == 2 else "xx", None if k % 4 == 3 else f"s{k % 2}", None, *CLASHING) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(3)


def shingles(text):
    words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(text or "")]
    return frozenset(zip(*[words[i:] for i in range(5)])) if len(words) >= 5 else frozenset([tuple(words)]) if words else frozenset()


def near_groups(rows):
    """component_id of each row by definition: rows with equal sets are one, null ids count last."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            parent[root(j)] = root(i)
    least = defaultdict(lambda: LAST)
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least[root(i)], LAST if doc is None else doc)
    return [(doc, len(sets[i]), (doc if not sets[i] else least[root(i)] if least[root(i)] != LAST else None)) for i, (doc, _) in enumerate(rows)]


def test_near_duplicates(odd):
    from boardloom.llm.minhash_dedup import keep_representatives, near_duplicate_components

    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    expected = Counter((d, n, c, d == c if c is not None else True) for d, n, c in near_groups(rows))
    assert Counter(tuple(r) for r in near_duplicate_components(odd).collect()) == expected
    kept = keep_representatives(odd)
    assert kept.columns == odd.columns
    assert {tuple(r)[5:] for r in kept.collect()} == {CLASHING}
    words = [r for r in kept.collect() if shingles(r["text"])]
    assert len(words) == len({c if c is not None else (d, n) for d, n, c in near_groups(rows) if n})
    assert sorted(r["doc_id"] for r in words) == [1, 5, 6, 8, 9, 11, 12, 13, 14, 15, 16]
    assert kept.count() == len(words) + sum(not shingles(t) for _, t in rows)
    assert near_duplicate_components(odd.limit(0)).count() == keep_representatives(odd.limit(0)).count() == 0


def test_near_duplicates_that_share_a_passage(spark):
    """Many unlike texts in common buckets, and chains of close ones among them: no link is lost."""
    from boardloom.llm.minhash_dedup import near_duplicate_components

    rng = random.Random(11)
    passage, rows = prose(rng, 200, 10**6).split(), []
    for _ in range(150):
        rows.append(passage + prose(rng, rng.randint(30, 120), 10**6).split())
    for start in range(0, 30, 3):
        chain = rows[start]
        for _ in range(4):
            chain = list(chain)
            at = rng.randrange(210, len(chain))
            chain[at - 8 : at] = prose(rng, 8, 10**6).split()
            rows.append(chain)
    rng.shuffle(rows)
    rows = [(i, " ".join(x)) for i, x in enumerate(rows)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = {d: c for d, _, c in near_groups(rows)}
    assert got == expected
    assert 1 < len(set(expected.values())) < len(rows)


def kept_words(rows, width):
    """op5's rule by definition; equal (id, text) rows are one document."""
    docs = sorted({(LAST if d is None else d, h, t) for d, h, t in rows})
    seen, out = {}, {}
    for d, h, t in docs:
        words = WORD.findall(t or "")
        gone = set()
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if seen.setdefault(window, (d, h, i)) != (d, h, i):
                gone.update(range(i, i + width))
        out[d, h] = (len(words), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("split", [2_000, 3])
def test_substring_dedup(odd, split, monkeypatch):
    from boardloom.llm import substring_dedup as sd

    monkeypatch.setattr(sd, "HOT_SEGMENTS", split)
    rows = [tuple(r) for r in odd.select("doc_id", F.xxhash64("text"), "text").collect()]
    expected = kept_words(rows, 20)
    want = Counter((d, *expected[LAST if d is None else d, h]) for d, h, _ in rows)
    got = sd.removed_words(odd)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == want
    cut = sd.without_repeats(odd)
    assert cut.columns == odd.columns
    digest = Counter(hashlib.sha256(" ".join(WORD.findall(r["text"] or "")).encode()).hexdigest() for r in cut.collect())
    assert digest == Counter(x[3] for x in want.elements())
    assert sd.removed_words(odd.limit(0)).count() == 0


def kept_lines(rows, least=50):
    """op3's rule by definition: shortest windows of ``least`` words from each line, later copies go."""
    docs = sorted({(LAST if d is None else d, h, t) for d, h, t in rows if t is not None})
    first, out = {}, {}
    for d, h, t in docs:
        lines = t.split("\n")
        size, gone, windows = [len(WORD.findall(x)) for x in lines], set(), set()
        for i in range(len(lines)):
            for a, b in ((i, next((j for j in range(i, len(lines)) if sum(size[i : j + 1]) >= least), None)), (next((j for j in range(i, -1, -1) if sum(size[j : i + 1]) >= least), None), i)):
                if a is not None and b is not None:
                    windows.add((a, b))
        for a, b in sorted(windows):
            if first.setdefault(tuple(lines[a : b + 1]), (d, h, a)) != (d, h, a):
                gone.update(range(a, b + 1))
        out[d, h] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup(odd):
    from boardloom.llm.line_dedup import drop_repeated_lines, with_kept_text

    rows = [tuple(r) for r in odd.select("doc_id", F.xxhash64("text"), "text").collect()]
    expected = kept_lines(rows)
    want = Counter((d, *(expected[LAST if d is None else d, h] if t is not None else (0, 0, None))) for d, h, t in rows)
    got = with_kept_text(odd)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_lines", "n_removed", "kept_text").collect()) == want
    assert sum(n > 0 for _, _, n, _ in want) > 3
    cut = drop_repeated_lines(odd)
    assert cut.columns == odd.columns
    assert {tuple(r)[5:] for r in cut.collect()} == {CLASHING}
    assert Counter((r["doc_id"], r["text"]) for r in cut.collect()) == Counter((d, t) for d, lines, n, t in want.elements() if n == 0 or n < lines)
    assert with_kept_text(odd.limit(0)).count() == drop_repeated_lines(odd.limit(0)).count() == 0


def test_top_k(spark):
    from boardloom.llm import topk_search as tk

    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=6).astype("float32")]) for i in range(400)]
    rows += [(0, rows[0][1]), (7, None), (8, [1.0, None, 2.0]), (9, [float("nan")] * 6), (10, [float("inf")] * 6), (None, [1.0] * 6), (401, [0.5, 0.25]), (402, rows[3][1]), (403, rows[3][1]), (50, rows[60][1])]
    table = spark.createDataFrame([(*r, -1, "x") for r in rows], "vec_id long, embedding array<float>, score long, block string")
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    expected = Counter()
    for q, v in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        best = sorted(((-dot(v, w), c) for c, w in good if c != q))[:5]
        expected.update((q, k + 1, c, -s) for k, (s, c) in enumerate(best))
    for small, block in ((4096, 32768), (64, 100)):
        tk.SMALL_BLOCK, keep_small, keep_block = small, tk.SMALL_BLOCK, tk.BLOCK
        tk.BLOCK = block
        try:
            got = Counter(tuple(r) for r in tk.top_k(table, table.where("vec_id % 50 = 0")).collect())
        finally:
            tk.SMALL_BLOCK, tk.BLOCK = keep_small, keep_block
        assert got == expected
    few = table.where("vec_id in (1, 2, 3)")
    assert tk.top_k(few, few.where("vec_id = 1")).count() == 2
    assert tk.top_k(table.limit(0), table.limit(0)).count() == tk.top_k(table, table.limit(0)).count() == 0


def mined_by_hand(baskets, blocked, min_pages, confidence):
    """Kept rules as {tokens: confidence}: every set of tokens of blocked pages, pruned by its parts."""
    support = lambda s, rows: sum(s <= r for r in rows)
    bad = [b for b, x in zip(baskets, blocked) if x]
    rules = {}
    for s in {frozenset(c) for b in bad for n in range(1, len(b) + 1) for c in itertools.combinations(sorted(b), n)}:
        hit = support(s, bad)
        if hit >= min_pages and hit / support(s, baskets) >= confidence:
            rules[s] = hit / support(s, baskets)
    return {s: c for s, c in rules.items() if not any(p < s and rules[p] >= c for p in rules)}


def test_mined_url_rules(spark):
    from boardloom.llm.url_rules import judge_urls, mined_rules

    rng = random.Random(2)
    urls = [f"https://{rng.choice(['spam', 'news', 'shop'])}.{rng.choice(['net', 'info'])}/{rng.choice(['a', 'b'])}/{rng.choice(['x', 'y', 'z'])}" for _ in range(120)]
    pages = [(i, u, None) for i, u in enumerate(urls)] + [(500, None, "x"), (501, "no scheme", "x"), (502, "HTTP://Sub.Example.ORG/es/1?q", "x"), (503, "ftp://spam.net", "x"), (None, "https://spam.net/a/x", "x"), (3, urls[3], "x")]
    labels = [(i, int(not ("spam" in u and "/x" in u) and rng.random() < 0.8), 0) for i, u in enumerate(urls)] + [(None, 0, 1), (999, 0, 0)]
    table = spark.createDataFrame([(*p, "v", "r") for p in pages], "page_id long, url string, html string, verdict string, rule string")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    mined = mined_rules(table, told, blocked=bad, min_pages=5)

    def tokens(url):
        host, _, path = url.split("://")[1].partition("/")
        return frozenset({f"h{i}:{x}" for i, x in enumerate(reversed(host.lower().split(".")))} | {f"p:{x}" for x in re.split("[^a-z0-9]+", path.lower()) if x and not x.isdigit()})

    verdict = {i: q == 0 for i, q, _ in labels if i is not None}
    seen = [(p, tokens(u)) for p, u, _ in pages if u and "://" in u and p in verdict]
    baskets = [t - {"h0:"} for _, t in seen]
    expected = mined_by_hand(baskets, [verdict[p] for p, _ in seen], 5, 0.6)
    assert {frozenset(r["tokens"]): round(r["confidence"], 9) for r in mined.collect()} == {s: round(c, 9) for s, c in expected.items()}
    assert len(expected) >= 2
    assert mined_rules(table, told, blocked=bad, min_pages=5000).count() == 0
    got = judge_urls(table, mined).collect()
    assert len(got) == len(pages)
    for r in got:
        if r["rule"] is None:
            own = tokens(f"x://{r['host']}{r['path']}") if r["host"] else frozenset()
            assert r["verdict"] == ("block" if any(s <= own for s in expected) else "allow")
    assert {r["page_id"]: (r["host"], r["path"], r["verdict"]) for r in got if r["page_id"] in (500, 501, 502)} == {500: ("", "", "allow"), 501: ("", "", "allow"), 502: ("sub.example.org", "/es/1", "block")}
    assert judge_urls(table.limit(0), mined_rules(table.limit(0), told.limit(0), blocked=bad)).count() == 0


def test_ftrl_by_hand():
    """The model's weights after each row, against the update rule written out for single numbers."""
    from boardloom.llm import language_id as li

    rng, model = np.random.default_rng(1), li.Ftrl(5, 3)
    z, n = np.zeros((5, 3)), np.zeros((5, 3))

    def weight(i, c):
        if abs(z[i, c]) <= li.L1:
            return 0.0
        return -(z[i, c] - math.copysign(li.L1, z[i, c])) / ((li.BETA + math.sqrt(n[i, c])) / li.ALPHA + li.L2)

    for _ in range(40):
        at, label = np.sort(rng.choice(5, 3, replace=False)), int(rng.integers(3))
        x = rng.random(3)
        model.learn(at, x, label)
        logits = [sum(x[k] * weight(i, c) for k, i in enumerate(at)) for c in range(3)]
        p = [math.exp(v) / sum(map(math.exp, logits)) for v in logits]
        step = [[x[k] * (p[c] - (c == label)) for c in range(3)] for k in range(3)]
        old = {(i, c): weight(i, c) for i in at for c in range(3)}
        for k, i in enumerate(at):
            for c in range(3):
                g = step[k][c]
                sigma = (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / li.ALPHA
                z[i, c] += g - sigma * old[i, c]
                n[i, c] += g * g
    assert np.allclose(model.weights(), [[weight(i, c) for c in range(3)] for i in range(5)])
    logits = rng.normal(size=(200, 3)) * 5
    labels = np.where(rng.random(200) < 0.7, logits.argmax(axis=1), rng.integers(0, 3, 200))
    loss = lambda t: -np.log(li.softmax(logits / t)[np.arange(200), labels]).mean()
    best = li.fitted_temperature(logits, labels)
    assert all(loss(best) <= loss(t) + 1e-6 for t in (best / 2, best * 0.95, best * 1.05, best * 2))


def test_language_id_odd(spark, odd):
    from boardloom.llm.language_id import identify

    rows = {(r["doc_id"]): r for r in identify(odd).collect()}
    assert identify(odd).count() == odd.count()
    assert [rows[i]["lang_pred"] for i in (2, 3, 4, 15, 16)] == ["und"] * 5
    assert {rows[i]["lang_pred"] for i in (1, 5, 9, 14)} == {"xx"}
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert identify(odd.limit(0)).count() == 0
    none = identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_packing_order(odd):
    """Each window's documents by BM25 from its seed, scores written out."""
    from boardloom.llm.packing import B, K1, fill_order

    rng = random.Random(9)
    docs = [np.array([rng.randint(0, 60) for _ in range(rng.randint(5, 60))], np.uint32) for _ in range(40)]
    df, mean = Counter(t for d in docs for t in set(d.tolist())), sum(map(len, docs)) / len(docs)

    def score(q, d):
        tf = Counter(d.tolist())
        return sum(math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (K1 + 1) / (tf[t] + K1 * (1 - B + B * len(d) / mean)) for t in set(q.tolist()) if t in tf)

    order, filled, left = [], 0, list(range(len(docs)))
    seed = None
    while left:
        if seed is None:
            d = seed = left[0]
        else:
            ranked = [(score(docs[seed], docs[j]), -j) for j in left]
            if max(ranked)[0] <= 0:
                seed = None
                continue
            d = max(left, key=lambda j: (round(score(docs[seed], docs[j]), 4), -j))
        order.append(d)
        left.remove(d)
        before, filled = filled // 128, filled + len(docs[d])
        if filled // 128 > before:
            seed = d if filled % 128 else None
    assert fill_order(docs, 128) == order


def test_packing_and_tokens_on_empty_tables(odd):
    from boardloom.llm.packing import pack
    from boardloom.llm.quality_rules import judge_documents, keep_good
    from boardloom.llm.token_counts import count_tokens, truncate_to_budget

    none = odd.limit(0)
    assert pack(none).count() == pack(none, source_col="source").count() == count_tokens(none).count() == judge_documents(none).count() == keep_good(none).count() == 0
    assert truncate_to_budget(none, 5).columns == odd.columns


def test_truncation(odd):
    from boardloom.llm.token_counts import truncate_to_budget
    from boardloom.llm.tokens import Encoder

    library = Encoder().library
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    whole = {r["doc_id"]: r["text"] for r in odd.where("doc_id in (1, 5, 6, 7, 14, 16)").collect()}
    for r in truncate_to_budget(odd.where("doc_id in (1, 5, 6, 7, 14, 16)"), 7).collect():
        text = whole[r["doc_id"]]
        longest = max(j for j in range(len(text[:400]) + 1) if n(text[:j]) <= 7)
        assert r["text"] == text[:longest]


@pytest.mark.parametrize(
    "text",
    ["Été naïve 日本語  \n\n don't 12३४ \u3000x <|endoftext|> y", "<|endoftext|>", "a!!<|endoftext|><|endoftext|>  <|endof", "we'll  \t it's\xa0\x85 <|endo", "ß\u200bẞ ﬁ 👩‍👩‍👧 ¼½ \x1c\x1f z", "  \u2003 a\u0301e\u0301 '"],
)
def test_prefix_tables_of_any_text(text):
    """Every prefix as the library counts it, without asking the library."""
    from boardloom.llm.token_counts import PrefixTable

    table = PrefixTable()
    library = table.encoder.library
    n = [len(library.encode(text[:j], add_special_tokens=False).ids) for j in range(len(text) + 1)]
    assert list(table.text_counts(text)) == n
    assert [table.total(text[:j]) for j in range(len(text) + 1)] == n


def test_token_caches_stay_bounded(monkeypatch):
    from boardloom.llm import token_counts as tc

    monkeypatch.setattr(tc, "CACHE", 500)
    table = tc.PrefixTable()
    for i in range(300):
        text = f"word{i}x  other{i}y  tail{i}z" if i % 2 else f"word{i}x other{i}y tail{i}z"
        assert table.total(text) == len(table.encoder.encode(text))
        assert len(table.of_word) + len(table.of_piece) + len(table.stays) < 700


def schedule_by_hand(rows, block, slots_each):
    """(row number, slot, offset) by definition: EDF over single slots until every block is placed."""
    from boardloom.llm.mixing import TEMPERATURE, whole_shares

    source = lambda r: r["source"] if r["source"] is not None else "\0"
    size = lambda r: len(r["text"] or "") + 1
    total = Counter()
    for r in rows:
        total[source(r)] += size(r)
    shares = whole_shares({s: n**TEMPERATURE for s, n in total.items()}, slots_each * len(total))
    period = sum(shares.values())
    slot_of, done = {}, Counter()
    for t in range(period * 4):
        ready = [(math.ceil((done[s] + 1) * period / n), -math.ceil((done[s] + 2) * period / n), s) for s, n in shares.items() if done[s] * period // n <= t]
        if ready:
            s = min(ready)[2]
            slot_of[s, done[s]] = t
            done[s] += 1
    out, at = {}, Counter()
    for r in sorted(rows, key=lambda r: (source(r), r["h"] % 2**64, r["doc_id"] is not None, r["doc_id"] or 0)):
        s = source(r)
        out.setdefault((r["doc_id"], r["text"]), []).append((slot_of[s, at[s] // block], at[s] % block))
        at[s] += size(r)
    return out


def test_schedule(odd):
    from boardloom.llm.mixing import SLOTS, mixed, schedule

    rows = odd.where("coalesce(doc_id, 0) not in (9, 10)")
    hashed = rows.select("doc_id", "text", "source", F.xxhash64("doc_id", "text").alias("h")).collect()
    expected = schedule_by_hand(hashed, 500, SLOTS)
    got = schedule(rows, block_chars=500)
    assert got.columns == [*[c for c in odd.columns if c not in ("block", "slot", "block_offset")], "block", "slot", "block_offset"]
    found = defaultdict(list)
    for r in got.collect():
        found[r["doc_id"], r["text"]].append((r["slot"], r["block_offset"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    out = mixed(odd)
    assert out.columns == odd.columns
    assert {tuple(r)[5:] for r in out.collect()} == {CLASHING}
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter((r["doc_id"], r["text"]) for r in odd.collect())
    assert schedule(odd.limit(0)).count() == mixed(odd.limit(0)).count() == 0


def test_many_sources(spark):
    from boardloom.llm import mixing

    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.concat(F.lit("s"), F.col("id") % 700).alias("source"))
    got = mixing.schedule(rows, block_chars=20).collect()
    assert len(got) == 3000
    slots = defaultdict(set)
    for r in got:
        slots[r["slot"]].add((r["source"], r["block"]))
    assert all(len(x) == 1 for x in slots.values())
    with pytest.raises(ValueError):
        mixing.schedule(rows.withColumn("source", F.col("doc_id").cast("string")).unionByName(rows.select(F.col("doc_id"), "text", F.concat(F.lit("x"), "doc_id").alias("source"))))


def judged_by_hand(rows):
    """kept by definition: base rules, then distances to references counted over all rows with a lang."""
    from boardloom.llm import quality_rules as qr

    def js(p, q):
        if not sum(p) or not sum(q):
            return float(bool(sum(p)) != bool(sum(q)))
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
        return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))

    words, chars = defaultdict(Counter), defaultdict(lambda: np.zeros(9))
    for lang, text in rows:
        if lang is not None and text:
            words[lang].update(WORD.findall(text))
            chars[lang] += qr.char_histogram(text.encode())
    common = {s: sorted(w for w, n in c.items() if qr.COMMON * n >= c.total()) for s, c in words.items()}
    out = []
    for _, text in rows:
        own = WORD.findall(text or "")
        grams = Counter(zip(own, own[1:], own[2:]))
        cover = {i + j for i in range(len(own) - 2) if grams[tuple(own[i : i + 3])] > 1 for j in range(3)}
        kept = len(own) >= 50 and 100 * len(cover) <= 50 * len(own)
        if kept and words:
            count = Counter(own)
            rest = lambda s: [words[s][w] for w in common[s]] + [words[s].total() - sum(words[s][w] for w in common[s])]
            mine = lambda s: [count[w] for w in common[s]] + [len(own) - sum(count[w] for w in common[s])]
            far = min(js(mine(s), rest(s)) for s in words) > qr.WORD_LIMIT
            if len(text.encode()) >= qr.MIN_CHARS:
                far |= min(js(qr.char_histogram(text.encode()), chars[s]) for s in words) > qr.CHAR_LIMIT
            kept = not far
        out.append(kept)
    return out


@pytest.mark.parametrize("kept_counters", [None, 410])
def test_quality_verdicts(spark, odd, sf_dir, monkeypatch, kept_counters):
    from boardloom.llm import quality_rules as qr

    if kept_counters:  # counters overflow in every task
        monkeypatch.setattr(qr, "KEPT", kept_counters)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(250).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars")).repartition(7)
    rows = docs.select("doc_id", "lang", "text").collect()
    verdicts = judged_by_hand([(r["lang"], r["text"]) for r in rows])
    expected = Counter((r["doc_id"], hashlib.md5((r["text"] or "-").encode()).hexdigest(), k) for r, k in zip(rows, verdicts))
    assert Counter((r["doc_id"], r["kept"]) for r in qr.judge_documents(docs).collect()) == Counter((d, k) for d, _, k in expected.elements())
    kept = qr.keep_good(odd)
    assert kept.columns == odd.columns and {tuple(r)[5:] for r in kept.collect()} <= {CLASHING}
    assert 0 < sum(verdicts) < len(verdicts)


def test_pipeline_on_odd_tables(spark, odd, tmp_path):
    """All stages on the odd table, each against its definition, with every column of the input kept; then on an empty one."""
    from boardloom.llm.quality_rules import judge_documents

    steps = dict(corpus_pipeline.STAGES)
    table = odd
    for name in ("quality", "line_dedup", "near_dedup", "mixing"):
        path = str(tmp_path / name)
        steps[name](spark, table, "").write.parquet(path)
        before, table = table, spark.read.parquet(path)
        assert table.columns == odd.columns
        assert {tuple(r)[5:] for r in table.collect()} <= {CLASHING}
        rows = [tuple(r) for r in before.select("doc_id", F.xxhash64("text"), "text").collect()]
        got = Counter((r["doc_id"], r["text"]) for r in table.collect())
        if name == "quality":
            assert sum(got.values()) == judge_documents(before).where("kept").count()
        elif name == "line_dedup":
            lines = kept_lines(rows)
            cut = [(d, lines[LAST if d is None else d, h]) for d, h, t in rows]
            assert got == Counter((d, t) for d, (n, gone, t) in cut if gone == 0 or gone < n)
        elif name == "near_dedup":
            groups = near_groups([(d, t) for d, _, t in rows])
            assert sum(got.values()) == len({c if c is not None else (d, n) for d, n, c in groups})
        else:
            assert got == Counter((d, t) for d, _, t in rows)
    assert steps["packing"](spark, table, "").count() >= table.count()
    empty = str(tmp_path / "none")
    odd.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
