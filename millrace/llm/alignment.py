"""Alignment of two tokenizers' tokens over a corpus, by external spill counting.

Both tokenizers cut the same bytes. Where tokens of both end at one byte, a group ends; every token of A in a group is linked
with every token of B in it. How many documents link an id pair is counted over the corpus, and each document learns
from the counts of its links.

Method. A task encodes its texts once and gathers records ``(pair, document, links)``. A full buffer is spilled: sorted
side-major (by A id, then B id), radix-partitioned by the A id and compressed with zstd, block by block. One spill's part is a
run; runs are kept in the shared folder. A unit is one radix part of a bounded number of spills. In a unit a k-way heap merge
over the blocks of its runs counts each pair; Spark sums the counts of units. In side-major order an A id's pairs stand together, which
yields their highest count. Then each unit streams its runs again, beside the totals of their pairs, and sends every document its sums.

Scale. A unit holds at most about ``GROUP_SPILLS`` spills' share of one part, however large the corpus and however common a pair
is; a pair that all documents have is counted within units first. Only counts of distinct pairs and sums of documents are
shuffled beside the compressed runs. Encoding, which costs most, happens once.

Defined cases: NULL and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens: zeros and
an empty digest. Every row is a document, equal rows and rows without an id too. A group of very many tokens is
counted by its distinct ids, so that a text without common ends does not list all its links. Other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.bytes_ import chunks, text_bytes
from millrace.llm.store import Scratch

RADIX = 16
SPILL_RECORDS = 1 << 22
BLOCK_PAIRS = 1 << 14
GROUP_SPILLS = 64
CHUNK_BYTES = 1 << 20
#: A group with more links than this is counted by its distinct ids.
LARGE_GROUP = 1 << 12


@dataclass
class Side:
    """One tokenizer: ``encode`` gives a list of ids for each text, ``tokens`` the bytes of each id."""

    encode: object
    tokens: list[bytes]

    def lengths(self) -> np.ndarray:
        return np.array([len(t) for t in self.tokens], np.int64)


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level(text: str) -> Side:
    """A byte-level BPE from the text of its JSON file; texts get a space before them.

    Where the merges stand in the order of the ids they make, ids are ranks, and tiktoken gives the same ids several times
    faster. Other files are encoded by the tokenizers library itself.
    """
    spec = json.loads(text)
    alphabet = _byte_of_char()
    special = {t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
    vocabulary = spec["model"]["vocab"]
    tokens = [b""] * (1 + max(vocabulary.values()))
    for token, i in vocabulary.items():
        tokens[i] = token.encode() if i in special else bytes(alphabet[c] for c in token)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    made = [vocabulary[x + y] for x, y in merges]
    cut = spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec.get("normalizer")
    if plain and all(x < y for x, y in zip(made, made[1:])) and set(made) | {vocabulary[c] for c in alphabet} == set(vocabulary.values()) - special:
        import public_tokenizers
        import tiktoken

        ranks = {t: i for i, t in enumerate(tokens) if i not in special and t}
        quick = tiktoken.Encoding("side-a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Side(lambda texts: [quick.encode_ordinary(" " + t) for t in texts], tokens)
    from tokenizers import Tokenizer

    slow = Tokenizer.from_str(text)
    slow.encode_special_tokens = True
    slow.no_truncation()
    slow.no_padding()
    return Side(lambda texts: [e.ids for e in slow.encode_batch([" " + t for t in texts], add_special_tokens=False)], tokens)


def pieces(proto: bytes) -> Side:
    """A sentencepiece model, from the bytes of its file, that puts a space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=proto)

    def content(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return Side(lambda texts: model.encode(texts, num_threads=1), [content(i) for i in range(model.get_piece_size())])


@dataclass
class Aligned:
    """Documents of one chunk that have tokens, and their records, one for each document and linked pair."""

    rows: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    pair: np.ndarray
    doc: np.ndarray  # index into rows
    links: np.ndarray


class Aligner:
    """Links between the tokens of two tokenizers, for chunks of texts."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.len_a, self.len_b = a.lengths(), b.lengths()
        self.n, self.m = len(a.tokens), len(b.tokens)
        ids_a, ids_b = [str(i) for i in range(self.n)], [str(i) for i in range(self.m)]
        self.shown = [*(x + "," for x in ids_a), *(x + "|" for x in ids_a), *(x + "," for x in ids_b), *(x + ";" for x in ids_b)]

    def __call__(self, texts: list[str | None]) -> Aligned:
        full = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in full]
        rows, ids_a, ids_b = [], [], []
        for i, text, x, y in zip(full, some, self.a.encode(some), self.b.encode(some), strict=True):
            raw = (" " + text).encode()
            if b"".join(map(self.a.tokens.__getitem__, x)) == raw and b"".join(map(self.b.tokens.__getitem__, y)) == raw:
                rows.append(i)
                ids_a.append(np.array(x, np.int64))
                ids_b.append(np.array(y, np.int64))
        none = np.zeros(0, np.int64)
        if not rows:
            return Aligned(none, none, none, none, none, [], none, none, none)
        n_a, n_b = np.array([len(x) for x in ids_a]), np.array([len(x) for x in ids_b])
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        ends_a, ends_b = self.len_a[a].cumsum(), self.len_b[b].cumsum()
        at = np.zeros(ends_a[-1] + 1, bool)
        at[ends_b] = True
        last_a = at[ends_a]  # this A token ends a group
        at[ends_b] = False
        at[ends_a] = True
        last_b = at[ends_b]
        of_a, of_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1  # where groups end, in tokens
        in_a, in_b = np.diff(of_a, prepend=0), np.diff(of_b, prepend=0)
        to_a, to_b = n_a.cumsum(), n_b.cumsum()  # where documents end, in tokens
        to_group = np.searchsorted(of_a, to_a) + 1
        n_groups = np.diff(to_group, prepend=0)
        n_links = np.add.reduceat(in_a * in_b, to_group - n_groups)
        digests = self._digests(a, b, last_a, last_b, of_a - in_a, of_b - in_b, in_a, in_b, to_a + to_b)
        doc_of = np.repeat(np.arange(len(rows)), n_groups)
        pair, doc, links = self._records(a, b, of_a - in_a, of_b - in_b, in_a, in_b, doc_of)
        return Aligned(np.array(rows), n_a, n_b, n_groups, n_links, digests, pair, doc, links)

    def _digests(self, a, b, last_a, last_b, from_a, from_b, in_a, in_b, to) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each document."""
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.repeat(from_b, in_a)] = a + self.n * last_a
        codes[np.arange(len(b)) + np.repeat(from_a + in_a, in_b)] = 2 * self.n + b + self.m * last_b
        out, start = [], 0
        for end in to.tolist():
            out.append(sha256("".join(map(self.shown.__getitem__, codes[start:end].tolist()))[:-1].encode()).hexdigest())
            start = end
        return out

    def _records(self, a, b, from_a, from_b, in_a, in_b, doc_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair, document and number of links, each pair of a document once."""
        size = in_a * in_b
        small = size <= LARGE_GROUP
        g = np.flatnonzero(small)
        # All links of small groups: the i-th link of a group joins its A token i // in_b and its B token i % in_b.
        count = size[g]
        within = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count)
        wide = np.repeat(in_b[g], count)
        i, j = np.divmod(within.astype(np.int32), wide.astype(np.int32))
        pair = a[np.repeat(from_a[g], count) + i] * self.m + b[np.repeat(from_b[g], count) + j]
        keys = [(np.repeat(doc_of[g], count) * (self.n * self.m) + pair, None)]
        for h in np.flatnonzero(~small).tolist():
            x, nx = np.unique(a[from_a[h] : from_a[h] + in_a[h]], return_counts=True)
            y, ny = np.unique(b[from_b[h] : from_b[h] + in_b[h]], return_counts=True)
            key = doc_of[h] * (self.n * self.m) + (x[:, None] * self.m + y).ravel()
            keys.append((key, (nx[:, None] * ny).ravel()))
        key = np.sort(keys[0][0])
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, links = key[first], np.diff(first, append=len(key))
        if len(keys) > 1:
            key = np.concatenate([key, *(k for k, _ in keys[1:])])
            links = np.concatenate([links, *(n for _, n in keys[1:])])
            by = np.argsort(key, kind="stable")
            key, links = key[by], links[by]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            key, links = key[first], np.add.reduceat(links, first)
        doc, pair = np.divmod(key, self.n * self.m)
        return pair, doc, links


def _packed(values: np.ndarray) -> bytes:
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(values) or values.max() <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def block(pair: np.ndarray, doc: np.ndarray, links: np.ndarray) -> bytes:
    """Records in the order of pairs, as one zstd frame: pairs by differences, documents of each, documents, links."""
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    many = np.diff(first, append=len(pair))
    parts = [_packed(x) for x in (np.diff(pair[first], prepend=0), many, doc, links)]
    head = np.array([len(p) for p in parts], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def records(frame: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, how many documents each has, then documents and links."""
    raw, out, at = zstandard.ZstdDecompressor().decompress(frame), [], 32
    for length in np.frombuffer(raw[:32], np.int64).tolist():
        kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[raw[at]]
        out.append(np.frombuffer(raw[at + 1 : at + length], kind).astype(np.int64))
        at += length
    return out[0].cumsum(), out[1], out[2], out[3]


def runs(pair: np.ndarray, doc: np.ndarray, links: np.ndarray, side: int, n_docs: int) -> Iterator[tuple[int, list[bytes]]]:
    """A spill's records as one run for each radix part: blocks in side-major order."""
    part = pair // side % RADIX
    by = np.argsort((part * (pair.max() + 1) + pair) * n_docs + doc)
    pair, doc, links, part = pair[by], doc[by], links[by], part[by]
    ends = np.searchsorted(part, np.arange(RADIX + 1))
    for p in range(RADIX):
        lo, hi = ends[p], ends[p + 1]
        if lo == hi:
            continue
        first = lo + np.flatnonzero(np.diff(pair[lo:hi], prepend=-1))
        cuts = [*first[::BLOCK_PAIRS].tolist(), hi]
        yield p, [block(pair[x:y], doc[x:y], links[x:y]) for x, y in zip(cuts, cuts[1:])]


def merged(run_blocks: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in ascending order with the number of their documents, from runs in that order.

    The heap holds each run's block in hand by its last pair. Up to the least of these all runs are known, so that
    stretch is summed and handed on; then the run that ended there opens its next block.
    """
    hand: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    following = [iter(b) for b in run_blocks]
    heap: list[tuple[int, int]] = []

    def open_next(r: int) -> None:
        frame = next(following[r], None)
        if frame is None:
            hand.pop(r, None)
        else:
            hand[r] = records(frame)[:2]
            heapq.heappush(heap, (int(hand[r][0][-1]), r))

    for r in range(len(run_blocks)):
        open_next(r)
    while heap:
        bound, ended = heapq.heappop(heap)
        pairs, counts = [], []
        for r, (p, c) in list(hand.items()):
            cut = int(np.searchsorted(p, bound, side="right"))
            if cut:
                pairs.append(p[:cut])
                counts.append(c[:cut])
                hand[r] = (p[cut:], c[cut:])
        open_next(ended)
        if not pairs:  # another run ended at the same pair
            continue
        p, c = np.concatenate(pairs), np.concatenate(counts)
        by = np.argsort(p, kind="stable")
        p, c = p[by], c[by]
        first = np.flatnonzero(np.diff(p, prepend=-1))
        yield p[first], np.add.reduceat(c, first)


_ENCODED = (
    "kind byte, spill long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "part int, blocks array<binary>"
)
_FIELDS = pa.schema(
    [("kind", pa.int8()), ("spill", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("part", pa.int32()), ("blocks", pa.list_(pa.binary()))]
)


def _table(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FIELDS], schema=_FIELDS
    )


def _encoder(files: Broadcast, spill_records: int):
    """``files`` has the contents of both files; the first task of each Python worker adds the aligner made of them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(files.value) == 2:
            files.value.append(Aligner(byte_level(files.value[0]), pieces(files.value[1])))
        align = files.value[2]
        spill, buffer, held, slots = TaskContext.get().partitionId() << 32, [], 0, 0

        def spilled() -> Iterator[pa.RecordBatch]:
            pair, doc, links = (np.concatenate(x) for x in zip(*buffer, strict=True))
            for part, blocks in runs(pair, doc, links, align.m, slots):
                yield _table(1, kind=[1], spill=[spill], part=[part], blocks=[blocks])

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low, high in chunks(text_bytes(texts)[1], CHUNK_BYTES):
                size = high - low
                found = align(texts.slice(low, size).to_pylist())
                slot = np.full(size, -1, np.int32)
                slot[found.rows] = slots + np.arange(len(found.rows))
                columns = {}
                for name in ("n_a", "n_b", "n_groups", "n_links"):
                    columns[name] = np.zeros(size, np.int64)
                    columns[name][found.rows] = getattr(found, name)
                digest = [""] * size
                for i, d in zip(found.rows.tolist(), found.digests, strict=True):
                    digest[i] = d
                yield _table(
                    size, kind=np.zeros(size, np.int8), spill=np.full(size, spill), slot=slot, doc_id=ids.slice(low, size), groups_sha256=digest, **columns
                )
                if len(found.pair):
                    buffer.append((found.pair, found.doc + slots, found.links))
                    held += len(found.pair)
                    slots += len(found.rows)
                if held >= spill_records:
                    yield from spilled()
                    spill, buffer, held, slots = spill + 1, [], 0, 0
        if buffer:
            yield from spilled()

    return encode


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``part, unit, blocks`` in the order of units to ``part, unit, pair, n``."""
    key, held = None, []

    def counted() -> Iterator[pa.RecordBatch]:
        for pair, n in merged(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pair), k, np.int32)) for k in key] + [pa.array(pair), pa.array(n)], names=["part", "unit", "pair", "n"]
            )

    for batch in batches:
        for part, unit, blocks in zip(*(batch.column(i) for i in range(3)), strict=True):
            now = (part.as_py(), unit.as_py())
            if now != key:
                if held:
                    yield from counted()
                key, held = now, []
            held.append(blocks.as_py())
    if held:
        yield from counted()


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``part, unit, spill, blocks, pair, n, highest``, a unit's totals before its runs, to ``spill, slot, best, total``."""
    key, pieces_, totals = None, [], None
    for batch in batches:
        part, unit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        spill, blocks = batch.column(2), batch.column(3)
        change = np.flatnonzero((part[1:] != part[:-1]) | (unit[1:] != unit[:-1])) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(part)]):
            if lo == hi:
                continue
            if (part[lo], unit[lo]) != key:
                key, pieces_, totals = (part[lo], unit[lo]), [], None
            runs_from = lo + spill.slice(lo, hi - lo).null_count
            if runs_from > lo:
                pieces_.append([batch.column(c).slice(lo, runs_from - lo).to_numpy(zero_copy_only=False) for c in (4, 5, 6)])
            for i in range(runs_from, hi):
                if totals is None:
                    totals = [np.concatenate(x) for x in zip(*pieces_, strict=True)]
                    pieces_ = []
                best = total = np.zeros(0, np.int64)
                for frame in blocks[i].as_py():
                    pair, many, doc, links = records(frame)
                    at = np.repeat(np.searchsorted(totals[0], pair), many)
                    if doc.max() >= len(best):
                        more = np.zeros(int(doc.max()) + 1 - len(best), np.int64)
                        best, total = np.concatenate([best, more]), np.concatenate([total, more])
                    np.add.at(total, doc, totals[1][at] * links)
                    np.add.at(best, doc, totals[2][at] * links)
                slot = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), spill[i].as_py())), pa.array(slot.astype(np.int32)), pa.array(best[slot]), pa.array(total[slot])],
                    names=["spill", "slot", "best", "total"],
                )


def alignment(
    docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text: str = "text", spill_records: int = SPILL_RECORDS, group_spills: int = GROUP_SPILLS
) -> tuple[DataFrame, DataFrame]:
    """Documents and pairs.

    Documents: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row each. Pairs: ``id_a, id_b, n_docs,
    highest``, where ``highest`` marks those with the most documents among the pairs of their ``id_a``.
    """
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        contents = [a.read(), b.read()]
    side = len(pieces(contents[1]).tokens)
    scratch, files = Scratch(docs.sparkSession, "alignment"), docs.sparkSession.sparkContext.broadcast(contents)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    encoded = scratch.write(rows.mapInArrow(_encoder(files, spill_records), _ENCODED), "encoded")
    spilled = encoded.filter("kind = 1").select("spill", "part", "blocks")
    units = max(1, -(-spilled.select("spill").distinct().count() // group_spills))
    dealt = spilled.withColumn("unit", F.pmod(F.xxhash64("spill"), F.lit(units)).cast("int"))
    tasks = 4 * RADIX * units
    in_order = dealt.select("part", "unit", "blocks").repartition(tasks, "part", "unit").sortWithinPartitions("part", "unit")
    counted = scratch.write(in_order.mapInArrow(_counts, "part int, unit int, pair long, n long"), "counted")
    sums = counted.groupBy("pair").agg(F.sum("n").alias("n_docs"))
    of_a = Window.partitionBy(F.expr(f"pair div {side}"))
    totals = scratch.write(sums.withColumn("highest", F.col("n_docs") == F.max("n_docs").over(of_a)), "totals")
    known = counted.join(totals, "pair").select(
        "part", "unit", F.lit(None).cast("long").alias("spill"), F.lit(None).cast("array<binary>").alias("blocks"), "pair", "n_docs", F.col("highest").cast("long").alias("highest")
    )
    none = F.lit(None).cast("long")
    both = known.union(dealt.select("part", "unit", "spill", "blocks", none.alias("pair"), none.alias("n_docs"), none.alias("highest")))
    both = both.repartition(tasks, "part", "unit").sortWithinPartitions("part", "unit", F.asc_nulls_first("spill"), "pair")
    sent = both.mapInArrow(_contributions, "spill long, slot int, best long, total long")
    sent = sent.groupBy("spill", "slot").agg(F.sum("best").alias("best"), F.sum("total").alias("total"))
    found = encoded.filter("kind = 0").drop("kind", "part", "blocks").join(sent, ["spill", "slot"], "left")
    zero = F.lit(0).cast("long")
    documents = found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("best", zero).alias("n_best"), F.coalesce("total", zero).alias("count_sum"), "groups_sha256"
    )
    pairs = totals.select(F.expr(f"pair div {side}").alias("id_a"), F.expr(f"pair % {side}").alias("id_b"), "n_docs", "highest")
    return documents, pairs
