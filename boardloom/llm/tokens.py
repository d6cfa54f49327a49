"""Token ids of the byte-level vocabulary, exactly as the tokenizers library gives them.

tiktoken holds the same vocabulary as ranks, splits with the same pattern and is several times
faster, so it encodes texts of plain Latin letters and punctuation when ids are asked for. All other texts (other
alphabets, where the two libraries' Unicode tables could differ, odd white space, the special
string, which the library turns into its id) go to the tokenizers library whole.
Many texts are encoded together: words that plain ones share are encoded once.
"""

from __future__ import annotations

import base64
import os
import re
from functools import cached_property

import numpy as np
import pyarrow as pa

VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
#: Characters on which both libraries agree for certain: ASCII, Latin letters, general punctuation.
_PLAIN = re.compile("[ -~\n\xa1-ɏ‐-‧]*")
#: Plain texts are taken together until they have so many characters; within them a word is encoded once.
BLOCK_CHARS = 32_000_000
#: Ids are looked up for so many characters at a time.
PART_CHARS = 4_000_000
#: Different words are encoded in strings of so many words.
SLICE_WORDS = 1 << 16


def vocabulary_path(name: str = f"{VOCABULARY}.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def is_plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None and SPECIAL not in text


def single_spaced(text: str) -> bool:
    return not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1] in " \n")


def _white(byte: np.ndarray) -> np.ndarray:
    """Which bytes are white space of plain texts."""
    return (byte == 32) | (byte == 10)


def _words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Words of plain texts, with the white space before them, and which word is each text's first."""
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    data = b"".join(raw)
    white = _white(np.frombuffer(data, np.uint8))
    opens = white.copy()
    opens[1:] &= ~white[:-1]
    opens[0] = opens[ends[:-1]] = True
    at = np.append(np.flatnonzero(opens), len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
    return words, np.searchsorted(at, ends - [len(r) for r in raw])


class Encoder:
    """Encodes texts as the tokenizers library does for ``path``, without added special tokens."""

    def __init__(self, path: str | None = None, ranks_path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or vocabulary_path())
        with open(ranks_path or vocabulary_path(f"{VOCABULARY}.tiktoken"), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = public_tokenizers.PATTERN
        self.plain = tiktoken.Encoding("plain", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if is_plain(text):
            return self.plain.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def encode_plain(self, text: str) -> list[int]:
        """As ``encode`` with the special string as ordinary text; the library must have ``encode_special_tokens`` set."""
        if _PLAIN.fullmatch(text):
            return self.plain.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    @cached_property
    def sizes(self) -> np.ndarray:
        """Bytes of each token."""
        out = np.zeros(max(self.ranks.values()) + 1, np.int64)
        out[list(self.ranks.values())] = [len(token) for token in self.ranks]
        return out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """``encode`` for each of ``texts``; a word that plain texts of a block share is encoded once."""
        out = [None] * len(texts)
        block, part, size, left = [], [], 0, BLOCK_CHARS
        for i, text in enumerate(texts):
            if not text or len(text) >= BLOCK_CHARS or not is_plain(text):
                out[i] = np.array(self.encode(text), np.uint32)
                continue
            part.append(i)
            size += len(text)
            if size >= PART_CHARS:
                block.append(part)
                part, size, left = [], 0, left - size
            if size >= left:
                self._encode_block(texts, [*block, part], out)
                block, part, size, left = [], [], 0, BLOCK_CHARS
        self._encode_block(texts, [*block, part], out)
        return out

    def _encode_block(self, texts: list[str], parts: list[list[int]], out: list) -> None:
        """Ids of the plain texts of a block.

        A word is a run of white space and what follows up to the next one. No piece of the pattern
        holds white space behind anything else, so a word's ids are the same wherever it stands,
        and different words can be encoded in one string. Words without white space before or
        anything behind it (the first and last of a text) are encoded alone.
        """
        parts = [part for part in parts if part]
        if not parts:
            return
        cut = [_words([texts[i] for i in part]) for part in parts]
        words = pa.chunked_array([w for w, _ in cut]).dictionary_encode()
        firsts = [first for _, first in cut]
        del cut
        start, count, ids = self._encode_words(words.chunk(0).dictionary)
        for part, chunk, first in zip(parts, words.chunks, firsts):
            word = chunk.indices.to_numpy()
            n = count[word]
            done = np.cumsum(n, dtype=np.int32)
            found = ids[np.repeat(start[word] - done + n, n) + np.arange(done[-1], dtype=np.int32)]
            for i, own in zip(part, np.split(found, done[first[1:] - 1])):
                out[i] = own

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word's ids start, how many it has, and the ids."""
        at = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1)
        byte = np.frombuffer(words.buffers()[2], np.uint8, at[-1])
        white, size = _white(byte), np.diff(at)
        joined = white[at[:-1]] & ~white[at[1:] - 1]
        text, ends = byte[np.repeat(joined, size)].tobytes(), np.cumsum(size[joined])
        cuts = [0, *ends[SLICE_WORDS - 1 :: SLICE_WORDS].tolist(), len(text)]
        ids = np.concatenate([np.array(self.plain.encode_ordinary(text[a:b].decode()), np.uint32) for a, b in zip(cuts, cuts[1:])])
        alone = np.flatnonzero(~joined)
        others = [self.plain.encode_ordinary(words[i].as_py().decode()) for i in alone.tolist()]

        count = np.zeros(len(words), np.int32)
        last = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
        count[joined] = np.diff(last, prepend=0)
        count[alone] = [len(x) for x in others]
        order = np.concatenate((np.flatnonzero(joined), alone))
        start = np.empty(len(words), np.int32)
        start[order] = np.cumsum(count[order]) - count[order]
        return start, count, np.concatenate((ids, np.array([x for own in others for x in own], np.uint32)))
