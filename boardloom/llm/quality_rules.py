"""Quality rules by distribution divergence.

Every document has a histogram of character classes and one of its language's common words. Both
are compared with references counted over the whole corpus, by Jensen-Shannon distance (base 2,
so between 0 and 1). A document is rejected when even the nearest language is too far away. The
guards skip a distance that a short text can't support.

A language's common words are all words that make up at least ``1 / COMMON`` of its words, found
exactly in two passes. In pass 1 each task keeps KEPT counters a language; when there are more
words, the count of the first one too many is taken off all of them (Misra and Gries, 1982). Spark
sums what is left, and a word whose sum and all that may have been taken off fall short of the
share is out. So fewer than ``1 / (1 / COMMON - 1 / KEPT)`` words a language (457) reach the driver,
whatever the number of documents and tasks. Pass 2 counts those everywhere.

Cases: null, empty or blank text has no word and fails the base rule. A null or unknown lang adds
to no reference; the document is judged by the nearest of all references. With no reference at
all the base rule alone decides. Repeated rows are judged alike, one result for each row.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import column_or_null, discard, split_words, staged

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COMMON = 400
KEPT = 8 * COMMON
MIN_WORDS = 50
MIN_CHARS = 200
CHAR_LIMIT = 0.30
WORD_LIMIT = 0.42


def _byte_classes() -> np.ndarray:
    """Class of each UTF-8 byte; continuation bytes fall in the last class, which is not used."""
    table = np.full(256, 9, np.int64)
    for b in range(128):
        c = chr(b)
        table[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in SPACE else 4 if c in ".,;:!?'\"-()" else 5 if c in SYMBOLS else 6
    table[0xC2:0xC6] = 7  # Latin letters beyond ASCII
    table[0xC6:] = 8
    return table


CLASSES = _byte_classes()


def char_histogram(data: bytes) -> np.ndarray:
    return np.bincount(CLASSES[np.frombuffer(data, np.uint8)], minlength=10)[:9] if data else np.zeros(9, np.int64)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors; 1 when just one of them is empty."""
    if not p.sum() or not q.sum():
        return float(bool(p.sum()) != bool(q.sum()))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.nansum(p * np.log2(p / m)) + np.nansum(q * np.log2(q / m))
    return float(np.sqrt(max(0.0, total / 2)))


def _repeat_words(ids: np.ndarray, kinds: int) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    if kinds < 1 << 21:
        key = (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:]
    else:
        pair = np.unique(ids[:-2] * kinds + ids[1:-1], return_inverse=True)[1]
        key = pair * kinds + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(ids), bool)
    for j in range(3):
        cover[j : j + len(again)] |= again
    return int(cover.sum())


def _base_row(text: str | None) -> tuple[list[int], list[bytes], dict[bytes, int], np.ndarray, bytes]:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    row = [
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeat_words(ids, len(seen)),
    ]
    return row, words, seen, ids, data


def _by_language(batch: pd.DataFrame) -> Iterator[tuple[str, list[str]]]:
    for lang, texts in batch.loc[batch["lang"].notna()].groupby("lang")["text"]:
        yield lang, [t for t in texts if t]


class Frequent:
    """Counters of the words of one language that may be common, and what was taken off them."""

    def __init__(self):
        self.counts: Counter = Counter()
        self.total = self.lost = 0

    def add(self, words: Counter) -> None:
        self.total += words.total()
        self.counts.update(words)
        if len(self.counts) > 8 * KEPT:
            self.shrink()

    def shrink(self) -> None:
        if len(self.counts) > KEPT:
            least = sorted(self.counts.values(), reverse=True)[KEPT]
            self.counts = Counter({w: n - least for w, n in self.counts.items() if n > least})
            self.lost += least


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[np.ndarray, list[bytes], np.ndarray]]:
    """lang -> (character-class counts, common words, their counts with all other words last)."""
    cols = docs.select(column_or_null(docs, lang_col, "string").cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null")

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Frequent] = defaultdict(Frequent)
        for batch in batches:
            for lang, texts in _by_language(batch):
                for i in range(0, len(texts), 256):
                    found[lang].add(Counter(w for t in texts[i : i + 256] for w in split_words(t)))
        for lang, frequent in found.items():
            frequent.shrink()
            rows = [(w, n, 0, 0) for w, n in frequent.counts.items()] + [(None, 0, frequent.total, frequent.lost)]
            yield pd.DataFrame(rows, columns=["word", "n", "total", "lost"]).assign(lang=lang)

    kept = staged(cols.mapInPandas(candidates, "lang string, word binary, n long, total long, lost long"))
    sums = kept.where("word is null").groupBy("lang").agg(F.sum("total").alias("total"), F.sum("lost").alias("lost"))
    maybe = kept.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("n")).join(sums, "lang")
    listed: dict[str, set[bytes]] = defaultdict(set)
    for r in maybe.where(COMMON * (F.col("n") + F.col("lost")) >= F.col("total")).select("lang", "word").collect():
        listed[r["lang"]].add(bytes(r["word"]))
    discard(kept)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for lang, texts in _by_language(batch):
                hist = sum((char_histogram(t.encode("utf-8", "surrogatepass")) for t in texts), np.zeros(9, np.int64))
                total.update({(lang, "class", str(i).encode()): int(n) for i, n in enumerate(hist)})
                words = Counter(w for t in texts for w in split_words(t))
                total[lang, "all", b""] += words.total()
                for w in listed.get(lang, ()):
                    if w in words:
                        total[lang, "word", w] += words[w]
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["lang", "kind", "item", "n"])

    got = cols.mapInPandas(counts, "lang string, kind string, item binary, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    chars, words, everything = defaultdict(lambda: np.zeros(9)), defaultdict(dict), {}
    for lang, kind, item, n in got.collect():
        if kind == "class":
            chars[lang][int(item)] = n
        elif kind == "word":
            words[lang][bytes(item)] = n
        else:
            everything[lang] = n
    out = {}
    for lang in sorted(everything):
        common = sorted(w for w, n in words[lang].items() if COMMON * n >= everything[lang])
        own = [words[lang][w] for w in common]
        out[lang] = (chars[lang], common, np.array([*own, everything[lang] - sum(own)], float))
    return out


def _judged(text: str | None, references: dict, char_limit: float, word_limit: float) -> tuple:
    base, _, seen, ids, data = _base_row(text)
    n_words, n_repeat = base[0], base[4]
    char_js = word_js = None
    if references and n_words >= MIN_WORDS:
        per_word = np.bincount(ids, minlength=1)
        if len(data) >= MIN_CHARS:
            hist = char_histogram(data)
            char_js = min(js_distance(hist, r[0]) for r in references.values())
        word_js = 1.0
        for _, common, ref in references.values():
            own = np.array([per_word[seen[w]] if w in seen else 0 for w in common] + [0], float)
            own[-1] = n_words - own.sum()
            word_js = min(word_js, js_distance(own, ref))
    failed = n_words < MIN_WORDS or 100 * n_repeat > 50 * n_words
    far = (char_js or 0) > char_limit or (word_js or 0) > word_limit
    return (*base, failed, not failed and not far, char_js, word_js)


def judge_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """Base counts, the two distances to the nearest reference and the verdict, a row for each document."""
    references = language_references(docs, text_col, lang_col)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_js", "word_js"]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_judged(t, references, char_limit, word_limit) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInPandas(judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_js double, word_js double")


def keep_good(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; a filter row by row, without a join."""
    references = language_references(docs, text_col, lang_col)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series([_judged(t, references, char_limit, word_limit)[6] for t in texts], dtype=bool)

    return docs.where(good(F.col(text_col).cast("string")))
