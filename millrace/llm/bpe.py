"""Byte-level BPE with word ends: encoding by a segment tree over adjacent pair ranks, and decoding.

A word's symbols are leaves; each leaf holds the merge rank of the pair that begins there, with its place
below, and every inner node the least of its children. The root names the leftmost pair of the lowest rank.
Merging it changes three leaves and their paths, and goes on until no pair can be merged. Trees of many short words
advance together as arrays; a long word has a tree of its own.

The tokenizer file is JSON with ``model.vocab`` and ``model.merges``; it is read once on the driver and sent
to the tasks, since its size is that of the vocabulary. Words seen before are looked up; the table of known words is
emptied when it is full, which changes nothing but time.

Defined cases: a NULL text counts as empty and has no tokens. The strings of the added tokens become
their ids wherever they stand.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

KNOWN_WORDS = 400_000
LONGEST_KNOWN = 64
LONGEST_BATCHED = 256
BATCH_CHARS = 1 << 20
_NONE = np.uint32(0xFFFFFFFF)

# Fixed values of the tokenizer's normaliser and pre-tokenizer: white space, pattern of the pieces, word end.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"
WORD_END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Codec:
    """Encodes and decodes texts. ``source`` is the text of the tokenizer file."""

    def __init__(self, source: str):
        parsed = json.loads(source)
        vocab = dict(parsed["model"]["vocab"])
        added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in chain(vocab.items(), added.items()):
            self.tokens[i] = token
        self.digits = [str(i) for i in range(len(self.tokens))]
        merges = [m if isinstance(m, list) else m.split(" ") for m in parsed["model"]["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges], np.uint32) for i in (0, 1))
        pairs = left << np.uint32(16) | right
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.uint32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.rank_of = dict(zip(pairs.tolist(), range(len(pairs)), strict=True))
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.final = np.array([vocab[c + WORD_END] for c in symbols], np.int64)
        self.added = added
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.pieces = regex.compile(PIECES)
        self.spaced = regex.compile(f"[^{SPACE}]+")
        self.known: dict[str, tuple[int, ...]] = {}

    # Trees of many words

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], np.uint32(0xFFFF))

    def _batch(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of words of 2 to ``LONGEST_BATCHED`` bytes, all of about the same length."""
        count, n = len(words), np.array([len(w) for w in words])
        width = 1 << int(int(n.max()) - 1).bit_length() if n.max() > 1 else 1
        symbol = np.zeros((count, width + 1), np.int64)
        held = np.arange(width + 1) < n[:, None]
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbol[held] = self.inner[flat]
        rows = np.arange(count)
        symbol[rows, n - 1] = self.final[flat[np.cumsum(n) - 1]]
        after = np.tile(np.arange(1, width + 2), (count, 1))
        before = np.tile(np.arange(-1, width), (count, 1))
        tree = np.full((count, 2 * width), _NONE, np.uint32)

        def leaf(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
            return np.where(rank < 0xFFFF, rank << np.uint32(16) | place.astype(np.uint32), _NONE)

        pair = held[:, 1:]
        ranks = np.full((count, width), np.uint32(0xFFFF))
        ranks[pair] = self._rank(symbol[:, :-1][pair], symbol[:, 1:][pair])
        tree[:, width:] = leaf(ranks, np.broadcast_to(np.arange(width), (count, width)))
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half

        def put(row: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
            node = place + width
            tree[row, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        alive = held.copy()
        row = rows[tree[:, 1] != _NONE]
        while len(row):
            root = tree[row, 1]
            i = (root & np.uint32(0xFFFF)).astype(np.int64)
            new = self.merged[root >> np.uint32(16)]
            j = after[row, i]
            k = after[row, j]
            symbol[row, i] = new
            alive[row, j] = False
            after[row, i] = k
            more = k < n[row]
            before[row[more], k[more]] = i[more]
            put(row, j[:], np.full(len(row), _NONE)) if width > 1 else None
            rank = np.full(len(row), np.uint32(0xFFFF))
            rank[more] = self._rank(new[more], symbol[row[more], k[more]])
            put(row, i, leaf(rank, i))
            p = before[row, i]
            has = p >= 0
            if has.any():
                r, q = row[has], p[has]
                put(r, q, leaf(self._rank(symbol[r, q], new[has]), q))
            row = row[tree[row, 1] != _NONE]
        ends = np.cumsum(alive.sum(axis=1))
        ids = symbol[alive].tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    # The tree of one long word

    def _single(self, word: bytes) -> tuple[int, ...]:
        symbol = self.inner[np.frombuffer(word, np.uint8)].tolist()
        symbol[-1] = int(self.final[word[-1]])
        n, rank_of, none = len(symbol), self.rank_of, 1 << 60
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
        width = 1 << max(0, n - 1).bit_length()
        tree = [none] * (2 * width)

        def value(i: int, j: int) -> int:
            rank = rank_of.get(symbol[i] << 16 | symbol[j]) if 0 <= i and j < n else None
            return none if rank is None else rank << 32 | i

        for i in range(n - 1):
            tree[width + i] = value(i, i + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] != none:
            rank, i = tree[1] >> 32, tree[1] & 0xFFFFFFFF
            j = after[i]
            k = after[j]
            symbol[i], alive[j], after[i] = int(self.merged[rank]), 0, k
            if k < n:
                before[k] = i
            changed = [(j, none), (i, value(i, k))]
            if before[i] >= 0:
                changed.append((before[i], value(before[i], i)))
            for place, new in changed:
                node = width + place
                tree[node] = new
                node >>= 1
                while node:
                    least = min(tree[2 * node], tree[2 * node + 1])
                    if tree[node] == least:
                        break
                    tree[node] = least
                    node >>= 1
        return tuple(s for s, a in zip(symbol, alive, strict=True) if a)

    def pieces_ids(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct pieces."""
        out: dict[str, tuple[int, ...]] = {}
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if len(raw) == 1:
                out[piece] = (int(self.final[raw[0]]),)
            elif len(raw) > LONGEST_BATCHED:
                out[piece] = self._single(raw)
            else:
                by_width.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for group in by_width.values():
            for low in range(0, len(group), 8192):
                part = group[low : low + 8192]
                out.update(zip((p for p, _ in part), self._batch([raw for _, raw in part]), strict=True))
        return out

    def _segments(self, text: str) -> list[list[str] | int]:
        """White-space separated, normalised words, and ids of added tokens between them."""
        parts = self.split_added.split(text) if self.split_added and "<|" in text else [text]
        out: list[list[str] | int] = []
        for part in parts:
            if part in self.added:
                out.append(self.added[part])
                continue
            if not part.isascii():
                # Lower case goes letter by letter: a capital sigma has one form, wherever it stands.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            odd = any(c in part for c in "\x1c\x1d\x1e\x1f")
            out.append(self.spaced.findall(part) if odd else part.split())
        return out

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        batch, size = [], 0
        for text in texts:
            batch.append(text)
            size += len(text)
            if size >= BATCH_CHARS:
                yield from self._encode(batch)
                batch, size = [], 0
        yield from self._encode(batch)

    def _encode(self, texts: list[str]) -> Iterator[list[int]]:
        if len(self.known) > KNOWN_WORDS:
            # The first half holds what came up first, and so the frequent words.
            self.known = dict(islice(self.known.items(), KNOWN_WORDS // 2))
        known, missing, looked = self.known, set(), []
        for text in texts:
            parts = []
            for part in self._segments(text):
                if isinstance(part, int):
                    parts.append((None, [(part,)]))
                    continue
                got = list(map(known.get, part))
                new = None in got
                if new:
                    missing.update(w for w, ids in zip(part, got, strict=True) if ids is None)
                parts.append((part if new else None, got))
            looked.append(parts)
        found = self._words(missing)
        for parts in looked:
            out: list[int] = []
            for part, got in parts:
                if part is not None:
                    got = [found[w] if ids is None else ids for w, ids in zip(part, got, strict=True)]
                out.extend(chain.from_iterable(got))
            yield out
        # Long words are not kept, they hardly come again.
        known.update((w, ids) for w, ids in found.items() if len(w) <= LONGEST_KNOWN)

    def _words(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of unknown words, and of their unknown pieces."""
        known = self.known
        split = {word: (word,) if word.isalpha() else self.pieces.findall(word) for word in words}
        found = self.pieces_ids(set(chain.from_iterable(split.values())).difference(known))
        for word, pieces in split.items():
            if word not in found:
                found[word] = tuple(chain.from_iterable(found[p] if p in found else known[p] for p in pieces))
        return found

    def ids_text(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.digits.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by single spaces, as the file names no decoder. Ids without a token are left out."""
        return " ".join(filter(None, map(self.tokens.__getitem__, ids)))


def _source(spark: SparkSession, path: str):
    """A broadcast list with the tokenizer file; the first task of each Python worker adds the codec made of it."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast([file.read()])


def _codec(shared: list) -> Codec:
    if len(shared) == 1:
        shared.append(Codec(shared[0]))
    return shared[1]


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows)


def encoded(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """``docs`` with ``token_ids array<int>`` in place of ``text``; its other columns stay.

    With ``decode`` also ``text``, decoded from the ids within the same task.
    """
    source = _source(docs.sparkSession, path)
    rest = [c for c in docs.columns if c not in ("text", "token_ids")]
    names = [*rest, "token_ids", *(["text"] if decode else [])]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(source.value)
        for whole in batches:
            for batch in _slices(whole):
                flat, ends, texts = array("i"), [0], []
                for ids in codec.encode(_texts(batch.column(len(rest)))):
                    flat.extend(ids)
                    ends.append(len(flat))
                    if decode:
                        texts.append(codec.decode(ids))
                values = pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                columns = [*batch.columns[:-1], lists, *([pa.array(texts, pa.string())] if decode else [])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    made = docs.select(*rest, F.col("text").cast("string").alias("text"))
    fields = [*made.drop("text").schema, StructField("token_ids", ArrayType(IntegerType()))]
    return made.mapInArrow(encode, StructType([*fields, *([StructField("text", StringType())] if decode else [])]))


def with_decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``text`` decoded from their ``token_ids``; NULL ids decode to an empty text."""
    source = _source(rows.sparkSession, path)
    made = rows.drop("text")
    names, at = made.columns, made.columns.index("token_ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(source.value)
        for whole in batches:
            for batch in _slices(whole):
                texts = [codec.decode(ids or ()) for ids in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    return made.mapInArrow(decode, StructType([*made.schema, StructField("text", StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text encoded and decoded again within one task."""
    source = _source(docs.sparkSession, path)

    def both_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(source.value)
        for whole in batches:
            n, ids_, texts = [], [], []
            for batch in _slices(whole):
                for ids in codec.encode(_texts(batch.column(1))):
                    n.append(len(ids))
                    ids_.append(sha256(codec.ids_text(ids).encode()).hexdigest())
                    texts.append(sha256(codec.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [whole.column(0), pa.array(n, pa.int64()), pa.array(ids_, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return made.mapInArrow(both_ways, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
