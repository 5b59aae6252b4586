"""Encoders that turn texts into token-id bytes inside Spark tasks, and file access for tasks."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow.fs as pafs


def id_type(vocabulary: int) -> np.dtype:
    """Smallest little-endian unsigned type that holds every id."""
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def byte_characters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others
    for the characters from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """Ids of one ASCII-space-separated word at a time, remembered.

    Right for lower-casing byte-level tokenizers that drop white space and split letters from
    marks: no token spans two words, so a text's ids are its words' ids in a row.  Each known word
    costs one dictionary lookup.  A new word of letters only is one unit of the vocabulary's merge
    model, which is called directly; any other goes through the whole tokenizer.  A word counts as
    letters by its normalised form (lower-casing can add a mark, as for U+0130).  The memory is
    emptied when it holds ``limit`` bytes; a worker's next task goes on with it (learning words anew
    for each task costs a third more time than the rest)."""

    def __init__(self, path: str, limit: int = 96 << 20):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normal, self.model = self.tokenizer.normalizer, self.tokenizer.model
        self.bytes = byte_characters()
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        self.limit, self.held = limit, 0

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def _letters(self, word: str) -> str | None:
        """Normalised word, if both it and the word are letters only."""
        if not word.isalpha():
            return None
        normal = word.lower() if word.isascii() else self.normal.normalize_str(word)
        return normal if normal.isalpha() else None

    def _ids(self, word: str) -> bytes:
        if normal := self._letters(word):
            unit = normal if normal.isascii() else "".join(map(self.bytes.__getitem__, normal.encode()))
            ids = [t.id for t in self.model.tokenize(unit)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.array(ids, dtype=self.dtype).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if self.held >= self.limit:
            self.forget()
        text = word.decode("utf-8")
        if text[-1] in ",." and self._letters(text[:-1]):
            ids = self[word[:-1]] + self[word[-1:]]
        elif word.isalpha() and (low := word.lower()) != word:
            ids = self[low]
        else:
            ids = self._ids(text)
        if len(word) <= 64:
            self[word] = ids
            self.held += 180 + len(word) + len(ids)
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=2)
def rank_encoder(path: str):
    """tiktoken encoder of a file of ranks; texts cannot produce ids beyond the ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(
        os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder such as ``file:/x``, ``hdfs://...`` or ``s3://...``."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
