"""Token ids of whole texts by a public byte-level BPE tokenizer, as a tree of joins.

A text is halved until its parts are leaves, leaves are encoded, and neighbours are joined on the way up. The encoding
of a part is an element of a monoid: its ids and where its last two pre-token pieces begin. Two elements are joined by
encoding a growing window about the seam again, until the ids outside provably are those of the joined text; only the
ids under the window are replaced, so a join costs its window, not the parts.

Why that is exact: the pre-tokenizer's pattern consumes the text from left to right, and a piece depends on nothing
before it. (1) All pieces of the left part but its last two end, with the characters looked ahead at, inside the left
part, so they stay as they are whatever follows. The window therefore begins where the second last piece begins.
(2) If a piece of the window ends exactly where a piece of the right part begins, the pattern stands at the same place
of the same text from there on, so all further pieces are the right part's. The window grows, doubling, until that
happens at a place that is safe in the window and in the right part by (1), or until it is all that is left.
Each piece is merged on its own, so ids follow the pieces, and a piece's bytes tell how many ids it has at an end.
Decoding concatenates bytes up the same tree.

Defined results: an empty or null text has no ids (an empty list); strings of special tokens are ordinary text; lone
surrogates cannot occur in Spark's strings; equal texts have equal ids, encoded once in each Arrow batch; extra columns are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.plans.shared import ship

#: The folder of the public tokenizers' files, unless the session names one in TOKENIZERS_CONF.
TOKENIZERS = "/opt/tokenizers"
TOKENIZERS_CONF = "spark.timberline.tokenizers"
#: Characters of a leaf at most.
LEAF = 256
#: Characters behind the seam that a join looks at first.
WINDOW = 32

#: Fixed value: the pre-tokenizer of the public byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get(TOKENIZERS_CONF, TOKENIZERS)}/{name}.tiktoken"


@dataclass(slots=True)
class Part:
    """The encoding of text[start:end] taken alone: its ids, and where its last two pieces (or fewer) begin."""

    start: int
    end: int
    ids: list[int]
    last: list[int]


class ByteBpe:
    """Pieces and ids of a vocabulary of ranks."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self.pieces = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def piece_ids(self, piece: str) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            ids = self.encoding.encode_ordinary(piece)
            if len(self.known) < 200_000 and len(piece) < 40:
                self.known[piece] = ids
        return ids

    def starts(self, text: str, start: int, end: int) -> list[int]:
        """Where the pieces of text[start:end], taken alone, begin."""
        return [m.start() for m in self.pieces.finditer(text, start, end)]

    def leaf(self, text: str, start: int, end: int) -> Part:
        return Part(start, end, self.encoding.encode_ordinary(text[start:end]), self.last_starts(text, start, end))

    def last_starts(self, text: str, start: int, end: int) -> list[int]:
        """The last two of ``starts``, without a scan of the whole part.

        A blank between two letters or digits begins a piece wherever the text begins: no piece but one of white space has
        a blank behind its first character, and one of white space alone ends before the blank in front of a word.
        """
        at = end
        for _ in range(3):
            at = text.rfind(" ", start + 1, at)
            if at < 0:
                return self.starts(text, start, end)[-2:]
            if at + 1 < end and text[at - 1].isalnum() and text[at + 1].isalnum():
                found = self.starts(text, at, end)
                if len(found) > 1:
                    return found[-2:]
        return self.starts(text, start, end)[-2:]

    def join(self, text: str, left: Part, right: Part) -> Part:
        """The encoding of both parts together; ``left`` is used up."""
        if not left.ids or not right.ids:
            return right if right.ids else left
        begin, seam, width = left.last[0], right.start, WINDOW
        while True:
            stop = min(right.end, seam + width)
            window = self.starts(text, begin, stop)
            if stop == right.end:
                # the window reaches the end: all its pieces are those of the joined text
                meet = stop
                break
            # in window and right part alike the last two pieces may change with what follows
            safe = self.starts(text, seam, stop)[:-2]
            meet = next((s for s in window[:-2] if s in safe), None)
            if meet is not None:
                window = [s for s in window if s < meet]
                break
            width *= 2
        ids = left.ids
        del ids[len(ids) - self.covering(reversed(ids), text[begin:seam]) :]
        for a, b in zip(window, [*window[1:], meet]):
            ids += self.piece_ids(text[a:b])
        ids += right.ids[self.covering(right.ids, text[seam:meet]) :]
        return Part(left.start, right.end, ids, [*window, *(s for s in right.last if s >= meet)][-2:])

    def covering(self, ids, text: str) -> int:
        """How many of the ids make up the bytes of ``text``, which ends with one of them."""
        left, n = len(text.encode()), 0
        for i in ids:
            if left <= 0:
                break
            left -= self.sizes[i]
            n += 1
        return n

    def tree(self, text: str, start: int, end: int) -> Part:
        """The encoding of text[start:end], by halves."""
        if end - start <= LEAF:
            return self.leaf(text, start, end)
        middle = (start + end) // 2
        return self.join(text, self.tree(text, start, middle), self.tree(text, middle, end))

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return self.tree(text, 0, len(text)).ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are concatenated up the tree, then read as UTF-8."""

        def tree(a: int, b: int) -> bytes:
            return self.encoding.decode_bytes(ids[a:b]) if b - a <= LEAF else tree(a, (a + b) // 2) + tree((a + b) // 2, b)

        return tree(0, len(ids)).decode("utf-8", errors="replace")

    def encode_all(self, texts: pd.Series) -> list[list[int]]:
        """The ids of many texts, each different one encoded once."""
        codes, different = pd.factorize(texts, use_na_sentinel=True)
        ids = [self.encode(t) if t else [] for t in different]
        return [ids[c] if c >= 0 else [] for c in codes]


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """The tokenizer of a file, once per worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def token_ids(spark: SparkSession, text: Column, name: str = "byte_bpe_50k") -> Column:
    """The ids of a text column."""
    path = tokenizer_path(ship(spark), name)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path)
        for s in batches:
            yield pd.Series(bpe.encode_all(s), index=s.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>")(text)


def token_counts(spark: SparkSession, text: Column, name: str = "byte_bpe_50k") -> Column:
    """The number of ids of a text column."""
    path = tokenizer_path(ship(spark), name)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path)
        for s in batches:
            yield pd.Series([len(x) for x in bpe.encode_all(s)], index=s.index, dtype="int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "long")(text)


def texts_of(spark: SparkSession, ids: Column, name: str = "byte_bpe_50k") -> Column:
    """The texts of ids."""
    path = tokenizer_path(ship(spark), name)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path)
        for s in batches:
            yield pd.Series([bpe.decode(list(x)) if x is not None else None for x in s], index=s.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(ids)


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k") -> DataFrame:
    """The key and ids of each row."""
    return df.select(key, token_ids(df.sparkSession, F.col(text), name).alias("ids"))
