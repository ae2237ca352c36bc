"""Word-piece counts by a linear longest-match automaton, without building pieces.

The vocabulary is a trie: pieces that begin a word hang below one root, pieces that continue it below
another. Each node has a failure link: what is left to match after greedy longest matching has taken
pieces off the front of the node's text, and the number of pieces it took. A word is read once, left
to right; where no edge fits, the node's count is added and the failure link followed. As every link
shortens the text in hand, the steps are at most twice the word's length, whatever the pieces are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlife.llm.words import slices

MARK = "▁"
CACHED = 400_000
_BLANKS = str.maketrans({c: " " for c in "\t\n\v\f\r"})


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word and pieces that continue one, from a SentencePiece model file.

    Begin pieces are those with a leading word mark (taken off here); control, unknown and byte
    pieces are left out.
    """
    from loanlife.llm.pieces import Model, read_model
    pieces = Model(read_model(path)).ids
    return (sorted(p[1:] for p in pieces if p[:1] == MARK and p[1:] and MARK not in p[1:]),
            sorted(p for p in pieces if MARK not in p))


class Automaton:
    """Trie with failure links and popped-piece counts.

    Node 0 stands for the start of a word, node 1 for its continuation. A word some part of which no
    piece matches counts as one unknown piece.
    """

    def __init__(self, begin: list[str], go_on: list[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        final, depth = [False, False], [0, 0]
        for root, pieces in ((0, begin), (1, go_on)):
            for piece in pieces:
                node = root
                for c in piece:
                    node = self._child(node, c, final, depth)
                final[node] = True
        self.link = [-1] * len(final)    # -1: nothing matches from here on
        self.popped = [0] * len(final)
        # Links of shallow nodes first; the parent's link is where a child's search starts.
        level = [0, 1]
        while level:
            after = []
            for node in level:
                for c, child in self.edges[node].items():
                    after.append(child)
                    if final[child]:
                        self.link[child], self.popped[child] = 1, 1
                        continue
                    at, count = self.link[node], self.popped[node]
                    while at >= 0 and c not in self.edges[at]:
                        count += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[child], self.popped[child] = self.edges[at][c], count
            level = after

    def _child(self, node: int, c: str, final: list[bool], depth: list[int]) -> int:
        child = self.edges[node].get(c)
        if child is None:
            child = self.edges[node][c] = len(self.edges)
            self.edges.append({})
            final.append(False)
            depth.append(depth[node] + 1)
        return child

    def count(self, word: str) -> int:
        """Number of greedy pieces; 0 if the word cannot be matched as a whole."""
        edges, link, popped = self.edges, self.link, self.popped
        node = total = 0
        for c in word:
            following = edges[node].get(c)
            while following is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 0
                following = edges[node].get(c)
            node = following
        while node != 1:
            total += popped[node]
            node = link[node]
            if node < 0:
                return 0
        return total


def greedy(word: str, begin: set[str], go_on: set[str]) -> list[str] | None:
    """The pieces themselves by direct search, for tests: None if the word cannot be matched."""
    out, at = [], 0
    while at < len(word):
        known = go_on if at else begin
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return None
        out.append(word[at:end])
        at = end
    return out


class Counter(dict):
    """Pieces per word, looked up or counted; emptied when full."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word)
        if len(word) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[word] = n
        return n


def token_counts(docs: DataFrame, begin: list[str], go_on: list[str]) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_words, n_tokens, n_unknown,
    longest`` (most pieces in a word).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A word that the vocabulary cannot spell is
    one token and counted in ``n_unknown``. Null and empty texts have zeros; null ids and repeated
    rows give rows like any other; other columns are ignored. The vocabulary is a list of a fixed
    size, known to the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Automaton(begin, go_on))
        for batch in batches:
            for i, j in slices(batch.column(1)):
                rows = []
                for text in batch.column(1).slice(i, j - i).to_pylist():
                    words = list(filter(None, (text or "").translate(_BLANKS).split(" ")))
                    pieces = list(map(counter.__getitem__, words))
                    unknown = pieces.count(0)
                    rows.append((len(words), sum(pieces) + unknown, unknown,
                                 max(max(pieces, default=0), 1 if words else 0)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i),
                     *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4))],
                    names=["doc_id", "n_words", "n_tokens", "n_unknown", "longest"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, n_tokens long, n_unknown long, longest long")
