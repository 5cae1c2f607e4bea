"""Problem 8: encoding of the whole corpus with a public byte-level BPE tokenizer.

Method: per-prefix dynamic programming. In the encoding of any prefix of a piece of text the last token is unique: it is the longest
token ending there that is compatible with the unique last token of the prefix before it. The tokens that end at a position come from an
automaton over the reversed vocabulary; two neighbours are compatible if the pair's own encoding is just that pair, which is
tested by undoing their merges in the order of ranks. Following the last tokens backwards gives the exact ids of the whole piece in
linear time, without simulating merges.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import load

TOKENIZER_DIR = os.environ.get("GLEANERY_TOKENIZERS", "/opt/tokenizers")
# The pre-tokenization pattern of the byte_bpe family, as the tokenizer's own package states it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PrefixEncoder:
    """Exact BPE encoding of byte strings by last tokens of prefixes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = 1 + max(ranks.values(), default=-1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.length = {i: len(t) for t, i in ranks.items()}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (pair := self._halves(token, i)):
                self.parts[i] = pair
                self.merged[pair] = i
        # The automaton: a trie over reversed tokens; walking back from a position passes all tokens that end there.
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, i in ranks.items():
            state = 0
            for byte in reversed(token):
                nxt = self.children[state].get(byte)
                if nxt is None:
                    nxt = self.children[state][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                state = nxt
            self.token_at[state] = i
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one: what its bytes are just before the merge of this rank."""
        pieces = [bytes([b]) for b in token]
        while len(pieces) > 2:
            best = min(range(len(pieces) - 1), key=lambda k: self.ranks.get(pieces[k] + pieces[k + 1], rank))
            if self.ranks.get(pieces[best] + pieces[best + 1], rank) >= rank:
                return None
            pieces[best : best + 2] = [pieces[best] + pieces[best + 1]]
        return self.ranks[pieces[0]], self.ranks[pieces[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of left + right is these two tokens.

        It is unless some merge across the border would come first. The later made of the two is undone again and again; a pair
        across the border that merges, at a rank below the merges that were undone, breaks them up.
        """
        limit = self.size
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < limit:
                return False
            if left > right:  # the left one was made later
                limit = left
                if left not in self.parts:
                    return True
                left = self.parts[left][1]
            else:
                # of equal ranks the left merge comes first, so the border pair may still win at this rank
                limit = right + 1 if right in self.parts else limit
                if right not in self.parts:
                    if left not in self.parts:
                        return True
                    limit = left
                    left = self.parts[left][1]
                else:
                    right = self.parts[right][0]

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        known = self.cache.get(piece)
        if known is not None:
            return known
        n = len(piece)
        last = [-1] * (n + 1)
        length, children, token_at = self.length, self.children, self.token_at
        for end in range(1, n + 1):
            state, at, found = 0, end, []
            while at > 0:
                state = children[state].get(piece[at - 1], -1)
                if state < 0:
                    break
                at -= 1
                if token_at[state] >= 0:
                    found.append((token_at[state], at))
            for token, start in reversed(found):
                if start == 0 or (last[start] >= 0 and self.compatible(last[start], token)):
                    last[end] = token
                    break
        out, at = [], n
        while at > 0:
            out.append(last[at])
            at -= length[last[at]]
        result = tuple(reversed(out))
        if n <= 64:
            if len(self.cache) > 400_000:  # memory bound of the cache only; results don't depend on it
                self.cache.clear()
            self.cache[piece] = result
        return result


@lru_cache(2)
def encoder(path: str) -> PrefixEncoder:
    """The encoder of a ranks file, built once in each Python worker."""
    with open(path, "rb") as f:
        return PrefixEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


@lru_cache(1)
def _splitter():
    import regex

    return regex.compile(PATTERN)


def encode_text(text: str | None, enc: PrefixEncoder, seen: dict[str, tuple[int, ...]]) -> list[int]:
    """Ids of a text; null and empty: none. seen: ids of pieces met before."""
    out: list[int] = []
    if text:
        for piece in _splitter().findall(text):
            ids = seen.get(piece)
            if ids is None:
                ids = enc.encode(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(seen) > 400_000:
                        seen.clear()
                    seen[piece] = ids
            out.extend(ids)
    return out


def _encode_batches(path: str, counts_only: bool):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        enc, seen = encoder(path), {}
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            step = 512
            for at in range(0, len(texts), step):
                rows = [encode_text(t, enc, seen) for t in texts[at : at + step]]
                sizes = np.fromiter(map(len, rows), np.int32, len(rows))
                if counts_only:
                    result = pa.array(sizes)
                else:
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    flat = np.fromiter((i for r in rows for i in r), np.int32, int(ends[-1]))
                    result = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(rows)), result], ["key", "result"])

    return run


def ranks_path(directory: str | None = None, name: str = "byte_bpe_50k.tiktoken") -> str:
    return os.path.join(directory or TOKENIZER_DIR, name)


def encode(df: DataFrame, key: str, text: str, path: str | None = None, out: str = "ids") -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens; null and empty texts have the empty list.

    One narrow pass, no shuffle; rows are neither dropped nor merged (repeats stay), other columns are not read. Every executor needs the
    ranks file under the same path.
    """
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_encode_batches(path or ranks_path(), False), f"key {kind}, result array<int>").select(F.col("key").alias(key), F.col("result").alias(out))


def count_tokens(df: DataFrame, key: str, text: str, path: str | None = None, out: str = "tokens") -> DataFrame:
    """(key, tokens): the number of token ids of each text, 0 for null and empty ones."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_encode_batches(path or ranks_path(), True), f"key {kind}, result int").select(F.col("key").alias(key), F.col("result").alias(out))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text of documents."""
    return encode(load(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
