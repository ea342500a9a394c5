"""Token counts of greedy longest-match word pieces, by one linear automaton.

The vocabulary is a trie; continuing pieces hang below a second root. Each node has a failure link, to the node
that stands for what is left of it once the pieces that certainly end inside it are popped, and the number of those
pieces. Reading a word character by character, the automaton follows edges, and where there is none it adds the popped count
and follows the link. A word takes time in proportion to its length, and no piece is ever built.

Words are runs of letters, marks, digits and underscores, and single other characters, in lower case.
A word that cannot be cut is one unknown token. Words seen before are looked up; the table of known ones is halved
when it is full, which changes nothing but time.

Defined cases: a NULL, empty or blank text has no words and no tokens. Words of any length are read whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from millrace.llm.bpe import byte_symbols

CONTINUES = "##"
WORDS = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"
KNOWN = 400_000
LONGEST_KNOWN = 64
_FIELD = 40  # bits of each count in a packed number


class Automaton:
    """Counts word pieces. ``vocabulary`` has pieces; those that continue a word begin with ``##``."""

    def __init__(self, vocabulary: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        whole, order = set(), []
        for piece in vocabulary:
            node, rest = (1, piece[len(CONTINUES) :]) if piece.startswith(CONTINUES) and piece != CONTINUES else (0, piece)
            for c in rest:
                child = self.edges[node].get(c)
                if child is None:
                    child = self.edges[node][c] = len(self.edges)
                    self.edges.append({})
                    order.append((node, c, child))
                node = child
            if rest:
                whole.add(node)
        # Parents come before their children, but a link leads to shorter strings: go by depth.
        depth = [0] * len(self.edges)
        for node, _, child in order:
            depth[child] = depth[node] + 1
        self.link, self.popped = [-1] * len(self.edges), [0] * len(self.edges)
        for node, c, child in sorted(order, key=lambda e: depth[e[2]]):
            if child in whole:
                self.link[child], self.popped[child] = 1, 1
                continue
            at, popped = self.link[node], self.popped[node]
            while at >= 0 and c not in self.edges[at]:
                popped += self.popped[at]
                at = self.link[at]
            if at >= 0:
                self.link[child], self.popped[child] = self.edges[at][c], popped

    def count(self, word: str) -> int:
        """The number of pieces of a word, 0 if it cannot be cut."""
        node, n, edges, link, popped = 0, 0, self.edges, self.link, self.popped
        for c in word:
            to = edges[node].get(c)
            while to is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return 0
                to = edges[node].get(c)
            node = to
        while node != 1:
            n += popped[node]
            node = link[node]
            if node < 0:
                return 0
        return n


def vocabulary_of(source: str) -> list[str]:
    """Word pieces from a byte-level vocabulary file: a leading space begins a word, all else continues one."""
    place = {c: b for b, c in enumerate(byte_symbols())}
    out = []
    for token in json.loads(source)["model"]["vocab"]:
        raw = bytes(place[c] for c in token if c in place)
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        starts = text.startswith(" ")
        text = text.removeprefix(" ")
        if text and not text.isspace():
            out.append(text if starts else CONTINUES + text)
    return out


class PieceCounter:
    """Counts of words, tokens and unknown words of texts."""

    def __init__(self, vocabulary: Iterable[str]):
        self.automaton, self.words, self.known = Automaton(vocabulary), regex.compile(WORDS), {}

    def _packed(self, chunk: str) -> int:
        words = tokens = unknown = 0
        for word in (chunk,) if chunk.isalpha() else self.words.findall(chunk):
            n = self.automaton.count(word)
            words, tokens, unknown = words + 1, tokens + (n or 1), unknown + (not n)
        return words << 2 * _FIELD | unknown << _FIELD | tokens

    def counts(self, text: str | None) -> tuple[int, int, int]:
        """Words, tokens, and unknown words."""
        if len(self.known) > KNOWN:
            self.known = dict(islice(self.known.items(), KNOWN // 2))
        known, total = self.known, 0
        chunks = (text or "").lower().split()
        got = list(map(known.get, chunks))
        if None in got:
            for i, packed in enumerate(got):
                if packed is None:
                    got[i] = packed = known.get(chunks[i]) or self._packed(chunks[i])
                    if len(chunks[i]) <= LONGEST_KNOWN:
                        known[chunks[i]] = packed
        total, mask = sum(got), (1 << _FIELD) - 1
        return total >> 2 * _FIELD, total & mask, total >> _FIELD & mask


def token_counts(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` for each row of ``docs`` (``doc_id``, ``text``)."""
    # A list, so that the first task of each Python worker can add the automaton built from it.
    shared = docs.sparkSession.sparkContext.broadcast([vocabulary])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(shared.value) == 1:
            shared.value.append(PieceCounter(shared.value[0]))
        counter = shared.value[1]
        for batch in batches:
            found = np.array([counter.counts(x.as_py()) for x in batch.column(1)], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(found[:, i].copy()) for i in range(3))], names=["doc_id", "n_words", "n_tokens", "n_unknown"]
            )

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return made.mapInArrow(count, "doc_id long, n_words long, n_tokens long, n_unknown long")
