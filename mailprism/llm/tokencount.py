"""Token counts: greedy longest-match word pieces counted by a linear automaton, without building pieces."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
START = "▁"  # stands before each word, as in the vocabulary
CACHED = 400_000  # words whose count a worker keeps


class Automaton:
    """Trie of the vocabulary whose nodes know where to go on and how many tokens that completes.

    A node stands for text read since the last completed token. ``fail[v]`` is the node that stands for what
    remains of v after its greedy tokens have been taken off, ``popped[v]`` how many those are. Reading a
    character follows an edge or pops; each pop shortens the pending text, so a word takes linear time. A
    character that no piece covers costs its UTF-8 bytes, as with byte fallback.
    """

    def __init__(self, vocabulary: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        cost: list[int] = [0]  # of the token that ends here, 0: none

        def add(piece: str, price: int) -> None:
            at = 0
            for c in piece:
                if c not in self.edges[at]:
                    self.edges[at][c] = len(self.edges)
                    self.edges.append({})
                    cost.append(0)
                at = self.edges[at][c]
            cost[at] = cost[at] or price

        for piece in vocabulary:
            if piece:
                add(piece, 1)
        for c in {c for piece in vocabulary for c in piece}:
            add(c, len(c.encode("utf-8", "surrogatepass")))
        size = len(self.edges)
        self.fail, self.popped, self.rest = [0] * size, [0] * size, [0] * size
        queue = deque((0, c, v) for c, v in self.edges[0].items())
        while queue:
            above, c, v = queue.popleft()
            if cost[v]:
                to, count = 0, cost[v]
            else:  # every single character has a price, so some edge is found at the root at the latest
                to, count = self.fail[above], self.popped[above]
                while c not in self.edges[to]:
                    to, count = self.fail[to], count + self.popped[to]
                to = self.edges[to][c]
            self.fail[v], self.popped[v] = to, count
            self.rest[v] = count + self.rest[to]
            queue.extend((v, d, w) for d, w in self.edges[v].items())

    def count(self, word: str) -> int:
        """Number of greedy longest-match tokens."""
        edges, fail, popped = self.edges, self.fail, self.popped
        at = total = 0
        for c in word:
            to = edges[at].get(c)
            while to is None and at:
                total += popped[at]
                at = fail[at]
                to = edges[at].get(c)
            if to is None:  # a character of no piece
                total += len(c.encode("utf-8", "surrogatepass"))
                to = 0
            at = to
        return total + self.rest[at]


class Counts(dict):
    """Token count by word; forgets everything when full."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.count = automaton.count

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        n = self[word] = self.count(START + word)
        return n


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[str, ...]:
    """Pieces of a public tokenizer, without its control, unknown and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(model.id_to_piece(i) for i in range(model.get_piece_size())
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))


@lru_cache(maxsize=2)
def counts_of(path: str) -> Counts:
    return Counts(Automaton(list(vocabulary(path))))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per row: key, ``n_words`` (between white space), ``n_tokens`` (greedy pieces over each word after its start mark).

    Whole texts are counted; null, empty and blank texts have 0 words and 0 tokens; repeated rows are counted
    each; an empty table gives no rows; other columns are not looked at. ``path``: the tokenizer's file.
    """
    place = path or public_tokenizers.path(MODEL)

    @F.pandas_udf("n_words long, n_tokens long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = counts_of(place)
        for batch in batches:
            words = [x.split() if x else [] for x in batch]
            yield pd.DataFrame({"n_words": [len(x) for x in words], "n_tokens": [sum(map(known.__getitem__, x)) for x in words]})

    return docs.select(F.col(key).alias("key"), count(F.col(text)).alias("n")).select(F.col("key").alias(key), "n.n_words", "n.n_tokens")
