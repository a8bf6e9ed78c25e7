"""Counts of word pieces by greedy longest match, in time linear in the text.

The vocabulary is a trie with failure links (the linear MaxMatch automaton). Reading a character for which a node has no
child pops the pieces that are certain by then and goes on from the node that stands for the rest; each node holds how
many tokens its failure pops, so that lengths come out without any piece being built.

A word starts with the marker; further pieces have none. A character that no piece covers counts as its UTF-8 bytes
(byte fallback), so every text has a count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import ship
from .shingles import BoundedCache

MARK = "▁"


class LongestMatch:
    """The automaton over a vocabulary of pieces; ``MARK`` stands for the start of a word."""

    def __init__(self, pieces: Iterable[str]):
        self.child: list[dict[str, int]] = [{}]
        weight = [0]  # tokens of the node's own string, 0 if it is none
        alphabet = set()
        for piece in pieces:
            if piece and MARK not in piece[1:]:
                weight[self._node(piece, weight)] = 1
                alphabet.update(piece)
        for c in sorted(alphabet):  # single characters that are no pieces fall back to bytes
            node = self._node(c, weight)
            weight[node] = weight[node] or len(c.encode())
        self.fail, self.popped = [-1] * len(weight), [0] * len(weight)
        queue = [0]
        for u in queue:
            for c, v in self.child[u].items():
                queue.append(v)
                if weight[v]:
                    self.fail[v], self.popped[v] = 0, weight[v]
                    continue
                z, tokens = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.child[z]:
                    z, tokens = self.fail[z], tokens + self.popped[z]
                # every character of the trie is a child of the root, so z is a node
                self.fail[v], self.popped[v] = self.child[z][c], tokens

    def _node(self, piece: str, weight: list[int]) -> int:
        u = 0
        for c in piece:
            v = self.child[u].get(c)
            if v is None:
                v = self.child[u][c] = len(self.child)
                self.child.append({})
                weight.append(0)
            u = v
        return u

    def count(self, word: str) -> int:
        """Tokens of one word, without its marker in the text."""
        child, fail, popped = self.child, self.fail, self.popped
        u = tokens = 0
        for c in MARK + word:
            v = child[u].get(c)
            while v is None:
                if not u:
                    tokens += len(c.encode())  # no piece covers it
                    v = 0
                else:
                    tokens += popped[u]
                    u = fail[u]
                    v = child[u].get(c)
            u = v
        while u:
            tokens += popped[u]
            u = fail[u]
        return tokens


def read_vocabulary(path: str) -> list[str]:
    """The plain pieces of a sentencepiece model (no control, unknown or byte tokens)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


@lru_cache(2)
def _words(path: str) -> BoundedCache:
    return BoundedCache(LongestMatch(read_vocabulary(path)).count)


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_words, n_tokens`` for every row of ``docs``, and the columns ``carry`` of it.

    ``vocabulary`` is the path of a sentencepiece model on every worker. Words are split at white space. A null or empty
    text has 0 words and 0 tokens; repeated rows and null ids are counted row by row; other columns are ignored. There
    is no shuffle, and a worker's memory is the automaton, a bounded cache of word counts and one Arrow batch.
    """

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType()), *(rows.schema[c] for c in carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _words(vocabulary)
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").split()
                n_words.append(len(words))
                n_tokens.append(sum(map(count.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), *batch.columns[2:]], ["doc_id", "n_words", "n_tokens", *carry])

    return rows.mapInArrow(run, schema)
