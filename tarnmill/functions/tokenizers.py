"""Tokenizers as column functions. Each gives ids with exactly one end id, and their number; the end counts."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import word_tokens


class Tokenizer(Protocol):
    """What a corpus build needs of a tokenizer. size: ids lie below it."""

    name: str
    size: int

    def ids(self, text: Column) -> Column: ...

    def count(self, text: Column) -> Column: ...


@dataclass(frozen=True)
class HashedWords:
    """Separated words, numbered by their digests; the end is 0."""

    name: str = "words"
    size: int = 1 << 28

    def ids(self, text: Column) -> Column:
        words = word_tokens(text)
        number = lambda w: F.conv(F.substring(F.sha2(w, 256), 1, 7), 16, 10).cast("int")
        return F.concat(F.transform(F.slice(words, F.lit(1), F.size(words) - 1), number), F.array(F.lit(0)))

    def count(self, text: Column) -> Column:
        return F.size(word_tokens(text)).cast("long")


@dataclass(frozen=True)
class Characters:
    """Runs of `width` characters, numbered by their digests; the end is 0."""

    width: int = 4
    name: str = "characters"
    size: int = 1 << 28

    def ids(self, text: Column) -> Column:
        n = F.ceil(F.length(text) / self.width).cast("int")
        starts = F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
        piece = lambda i: F.conv(F.substring(F.sha2(F.substring(text, i * self.width + 1, F.lit(self.width)), 256), 1, 7), 16, 10).cast("int")
        return F.concat(F.transform(starts, piece), F.array(F.lit(0)))

    def count(self, text: Column) -> Column:
        return (F.ceil(F.length(text) / self.width) + 1).cast("long")


@dataclass(frozen=True)
class FileTokenizer:
    """A tokenizer file, read by the `tokenizers` package in Arrow batches; no special tokens but the end."""

    path: str
    end: int
    size: int
    name: str = "file"

    def ids(self, text: Column) -> Column:
        import pandas as pd

        path, end, size = self.path, self.end, self.size
        loaded = []

        def encode(texts):
            from tokenizers import Tokenizer as Engine

            if not loaded:
                loaded.append(Engine.from_file(path))
            out = [[*loaded[0].encode(t, add_special_tokens=False).ids, end] for t in texts]
            if any(i >= size for ids in out for i in ids):
                raise ValueError(f"{path} gives ids of {size} or more")
            return pd.Series(out)

        return F.pandas_udf(encode, "array<int>")(text)

    def count(self, text: Column) -> Column:
        return F.size(self.ids(text)).cast("long")
