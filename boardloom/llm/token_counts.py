"""Token counts by prefix dynamic programming.

For a run of bytes the table holds, at every prefix, the last token of the prefix's encoding and
so its token count: the last token is the one vocabulary entry that ends there and whose pair with
the last token of the shorter prefix is left alone by the merges. The splitting pattern cuts a
text into pieces that never merge, so counts add up: a document's table is the running total over
its pieces plus the piece's own table. It answers "how many tokens has this prefix", "where do I
cut for a budget" and "is it over the limit" without encoding anything again.

Tables of pieces are kept and shared between documents, so a piece is worked out once for each
task; a document costs one look-up for each of its words.

Texts of plain Latin are split by the pattern, all others by the library's own splitter, so that its
Unicode tables hold; the pieces' tables are worked out here in both cases. The special string is one
token wherever it stands, and pieces do not reach over it.

Cases: null text is empty and has no token. Repeated rows get equal results, one for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import SPECIAL, Encoder, is_plain, single_spaced

LIMIT = 1024
#: White space of the splitting pattern.
WHITE = set(" \t\n\x0b\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
#: A task's tables of words, pieces and pairs are emptied when they hold more than this together.
CACHE = 1_200_000


class PrefixTable:
    """Exact token counts at every prefix of pieces and texts."""

    def __init__(self, encoder: Encoder | None = None):
        import regex

        self.encoder = encoder or Encoder()
        self.ranks = self.encoder.ranks
        self.longest = max(map(len, self.ranks))
        self.merged = self.encoder.plain._encode_single_piece
        self.split = regex.compile(self.encoder.pattern)
        self.stays: dict[tuple[bytes, bytes], bool] = {}
        self.of_word: dict[str, int] = {}
        self.of_piece: dict[str, int] = {}

    def _left_alone(self, a: bytes, b: bytes) -> bool:
        """Whether the merges turn the bytes of a and b into just the tokens a and b."""
        key = (a, b)
        if (known := self.stays.get(key)) is None:
            known = self.stays[key] = self.merged(a + b) == [self.ranks[a], self.ranks[b]]
        return known

    def piece_counts(self, piece: bytes) -> list[int]:
        """Tokens of ``piece[:j]`` for j = 0 to its length, each prefix taken as one piece."""
        last: list[bytes] = [b""]
        counts = [0]
        ranks, longest = self.ranks, self.longest
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = piece[start:end]
                if token in ranks and (start == 0 or self._left_alone(last[start], token)):
                    last.append(token)
                    counts.append(counts[start] + 1)
                    break
        return counts

    def pieces(self, text: str) -> list[str]:
        """``text`` (without the special string) as the library splits it."""
        if is_plain(text):
            return self.split.findall(text)
        return [text[a:b] for _, (a, b) in self.encoder.library.pre_tokenizer.pre_tokenize_str(text)]

    def _whole(self, text: str) -> int:
        return sum(self.piece_counts(p.encode())[-1] for p in self.pieces(text))

    def text_counts(self, text: str) -> np.ndarray:
        """Tokens of ``text[:j]`` for every j from 0 to its length, as the library counts them."""
        out, at, done = np.zeros(len(text) + 1, np.int64), 0, 0
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                # a prefix that ends inside the special string has its start as ordinary text
                for j in range(1, len(SPECIAL)):
                    out[at + j] = before + self._whole(last + SPECIAL[:j])
                at, done = at + len(SPECIAL), done + 1
                out[at] = done
            counts, last_start = self._part_counts(part)
            out[at + 1 : at + 1 + len(part)] = done + counts[1:]
            last, before = part[last_start:], done + int(counts[last_start])
            at, done = at + len(part), done + int(counts[-1])
        return out

    def _part_counts(self, text: str) -> tuple[np.ndarray, int]:
        """Tokens at every prefix of a text without the special string, and where its last piece starts."""
        out = np.zeros(len(text) + 1, np.int64)
        done = at = last = 0
        for piece in self.pieces(text):
            counts = np.array(self.piece_counts(piece.encode()))
            out[at + 1 : at + 1 + len(piece)] = done + counts[np.cumsum([len(c.encode()) for c in piece])]
            if piece[0] == "'" and piece[1:].isalpha():  # a part of a contraction is split otherwise
                for j in range(2, len(piece)):
                    out[at + j] = done + self._whole(piece[:j])
            done += int(counts[-1])
            last, at = at, at + len(piece)
        # a prefix that ends in white space has that whole run as its last piece
        at = 0
        while at < len(text):
            end = at
            while end < len(text) and text[end] in WHITE:
                end += 1
            if end > at + 1:
                run = text[at:end]
                counts = np.array(self.piece_counts(run.encode()))
                out[at + 1 : end + 1] = out[at] + counts[np.cumsum([len(c.encode()) for c in run])]
            at = max(end, at + 1)
        return out, last

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        fits = np.flatnonzero(self.text_counts(text) <= budget)
        return text[: int(fits[-1])]

    def _pieces(self, text: str) -> int:
        total = 0
        for piece in self.pieces(text):
            if (n := self.of_piece.get(piece)) is None:
                n = self.of_piece[piece] = self.piece_counts(piece.encode())[-1]
            total += n
        return total

    def total(self, text: str | None) -> int:
        """The last entry of :meth:`text_counts`.

        Where single spaces and line breaks separate the words, no piece reaches over two words,
        so a word with the white space before it is looked up whole.
        """
        if not text:
            return 0
        if len(self.of_word) + len(self.of_piece) + len(self.stays) > CACHE:
            for kept in (self.of_word, self.of_piece, self.stays):
                kept.clear()
        if not is_plain(text):
            parts = text.split(SPECIAL)
            return len(parts) - 1 + sum(map(self._pieces, parts))
        if not single_spaced(text):
            return self._pieces(text)
        of_word = self.of_word
        first, *rest = text.replace("\n", " \n").split(" ")
        got = list(map(of_word.get, rest))
        if None in got:
            for i, n in enumerate(got):
                if n is None:
                    word = rest[i]
                    if (n := of_word.get(word)) is None:
                        n = of_word[word] = self._pieces(word if word[0] == "\n" else f" {word}")
                    got[i] = n
        return sum(got) + self._pieces(first)


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each document.

    ``vocabulary`` is the path of the tokenizer file, on every executor; by default the public one.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = PrefixTable(Encoder(vocabulary))
        for batch in batches:
            n = np.array([table.total(t) for t in batch["text"]], np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": n, "over_limit": n > limit})

    text = F.col(text_col).cast("string")
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return cols.mapInPandas(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def truncate_to_budget(docs: DataFrame, budget: int, *, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with each text cut to its longest prefix of at most ``budget`` tokens."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = PrefixTable(Encoder(vocabulary))
        for texts in batches:
            yield texts.map(lambda t: t if t is None else table.truncate(t, budget))

    return docs.withColumn(text_col, cut(F.col(text_col).cast("string")))
