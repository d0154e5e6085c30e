"""Token counts by a unigram model, with forward scores shared along a trie.

A vocabulary's pieces get Zipf scores from their ranks, log p = -log(rank + SHIFT):
no public vocabulary at hand has unigram scores, and none is trained here, so the
counts are those of this model and of no tokenizer. A pre-token's count is the
number of pieces on its best path (of equal scores, the fewest pieces).

Each distinct pre-token of a task is inserted in a trie once. A node stands for a
prefix and holds its forward state, the best score and the pieces used for it,
which is computed when the node is made and shared by all pre-tokens below it.
Where a pre-token ends, the node's state is its count, stored as the terminal
count by which texts are summed. The trie begins anew when it has NODES nodes
(distinct pre-tokens in the meantime are scored again, with the same counts), and
goes when the task ends.

Pre-tokens are words with at most one space before them, and other white space
singly; all bytes must be pieces, so that every text has a path.

Defined results: null and empty texts have no pre-tokens and count 0; repeated
rows stay; an empty table gives an empty table; a pre-token of any length has a
count (a node for each byte); columns of the new names are replaced, others,
whatever their names, carried along.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from math import inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sheaf.llm.batches import ddl, mapped, place, plainly
from sheaf.llm.words import buffers, text_column

#: Zipf's shift, nodes of a trie, and bytes of text whose distinct pre-tokens are inserted at once.
SHIFT, NODES, AT_ONCE = 10, 400_000, 1 << 21
_PRE = re.compile(rb"\x20?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Unigram:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes {missing[:5]} are no pieces")
        self.ends: dict = {}  # a trie of the reversed pieces; None leads to a piece's score
        for piece, rank in ranks.items():
            node = self.ends
            for b in reversed(piece):
                node = node.setdefault(b, {})
            node[None] = -log(rank + SHIFT)
        self._begin()

    def _begin(self) -> None:
        """An empty trie. child: (node, byte) in one number to node; best and used: a node's forward state."""
        self.child: dict[int, int] = {}
        self.best, self.used = [0.0], [0]
        self.terminal: dict[bytes, int] = {}

    def insert(self, word: bytes) -> int:
        """The count of a pre-token; nodes that its prefix shares with earlier ones keep their state."""
        child, best, used, ends = self.child, self.best, self.used, self.ends
        path = [0]
        for j, b in enumerate(word):
            key = path[j] << 8 | b
            node = child.get(key)
            if node is None:
                at, i = ends, j
                top, pieces = -inf, 0
                while i >= 0:
                    at = at.get(word[i])
                    if at is None:
                        break
                    own = at.get(None)
                    if own is not None:
                        s, n = best[path[i]] + own, used[path[i]] + 1
                        if s > top or (s == top and n < pieces):
                            top, pieces = s, n
                    i -= 1
                node = child[key] = len(best)
                best.append(top)
                used.append(pieces)
            path.append(node)
        self.terminal[word] = n = used[path[-1]]
        return n

    def score_all(self, words: Iterable[bytes]) -> dict[bytes, int]:
        """Counts of distinct words."""
        return {w: self.insert(w) for w in words}

    def count(self, texts: list[bytes]) -> tuple[list[int], list[int]]:
        """(pre-tokens, tokens) of each text."""
        split = [_PRE.findall(t) for t in texts]
        if len(self.best) > NODES:
            self._begin()
        for w in {w for s in split for w in s}.difference(self.terminal):
            self.insert(w)
        get = self.terminal.__getitem__
        return [len(s) for s in split], [sum(map(get, s)) for s in split]


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs with n_pretokens and n_tokens. vocabulary: the path of a tiktoken file, read by the driver and sent to the tasks."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    new = ["n_pretokens", "n_tokens"]
    named, names = plainly(docs, new)
    t = place(names, text)
    out_names = [*named.columns, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram(ranks.value)
        for batch in batches:
            at = 0
            while at < len(batch):
                places, data = buffers(text_column(batch.slice(at), t))
                n = max(1, int(np.searchsorted(places, places[0] + AT_ONCE, "right")) - 1)
                part = batch.slice(at, n)
                pre, tokens = model.count([data[a:b].tobytes() for a, b in zip(places[:n], places[1 : n + 1], strict=True)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pre, pa.int64()), pa.array(tokens, pa.int64())], names=out_names)
                at += n

    return mapped(named, run, ddl(named.schema) + ", n_pretokens long, n_tokens long").toDF(*names, *new)
