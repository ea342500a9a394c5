"""Alignment of two tokenizers against a plain count of all links."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sides():
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        return alignment.byte_level(a.read()), alignment.pieces(b.read())


DOCS = "doc_id long, text string, n_a string"


def plain(rows):
    """The contract's rows, from the libraries and loops over all links."""
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = alignment._byte_of_char()

    def content(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    docs = []
    for doc_id, text in rows:
        a, b = [], []
        if text:
            a = library.encode(" " + text, add_special_tokens=False).ids
            b = model.encode(text)
        bytes_a = [bytes(alphabet[c] for c in library.id_to_token(i)) for i in a]
        bytes_b = [content(i) for i in b]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            docs.append((doc_id, [], [], []))
            continue
        groups, i, j, end_a, end_b, ga, gb = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if end_a <= end_b and i < len(a):
                ga.append(a[i])
                end_a += len(bytes_a[i])
                i += 1
            else:
                gb.append(b[j])
                end_b += len(bytes_b[j])
                j += 1
            if end_a == end_b:
                groups.append((ga, gb))
                ga, gb = [], []
        docs.append((doc_id, a, b, groups))
    count = Counter()
    for *_, groups in docs:
        count.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = []
    for doc_id, a, b, groups in docs:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        best = sum(count[x] == highest[x[0]] for x in links)
        digest = sha256(shown.encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), best, sum(count[x] for x in links), digest))
    return sorted(out, key=repr), count


def found(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(([tuple(r[n] for n in names) for r in df.collect()]), key=repr)


def made_up(n, seed):
    r = random.Random(seed)
    words = ["the", "Tokenizer", "naïve", "über", "日本語", "🙂🙂", "x" * 40, "<|endoftext|>", "<s>", "<0x41>", "a\tb", "don't", "  ", "\n\n", "1234567", "▁", "é" * 7, "\x00", "ﬁ", "Á"]
    texts = [" ".join(r.choice(words) if r.random() < 0.3 else f"w{r.randrange(50)}" for _ in range(r.randrange(60))) for _ in range(n)]
    texts += [None, "", " ", "a", "the " * 3000, "the " * 3000, "ab" * 30000, texts[0], texts[0]]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "the end"), (1, "the end"), (1, "the end")]


@pytest.mark.parametrize(("spill", "group"), [(1 << 22, 64), (50, 2)])
def test_against_all_links(spark, spill, group, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 2000)
    rows = made_up(150, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS).repartition(5)
    documents, pairs = alignment.alignment(docs, A, B, spill_records=spill, group_spills=group)
    want, count = plain(rows)
    assert found(documents) == want
    assert {(r.id_a, r.id_b): r.n_docs for r in pairs.collect()} == dict(count)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(alignment.alignment(docs, A, B)[0]) == plain(rows)[0]


def test_no_documents(spark):
    documents, pairs = alignment.alignment(spark.createDataFrame([], DOCS), A, B)
    assert documents.collect() == [] and pairs.collect() == []
    empty = spark.createDataFrame([(1, None, "x"), (2, "", "y")], DOCS)
    assert found(alignment.alignment(empty, A, B)[0]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_large_groups_are_counted_alike(monkeypatch):
    texts = ["".join(random.Random(i).choice("abcdefgh") for _ in range(4000)) for i in range(5)] + ["the quick brown fox"]
    align = alignment.Aligner(*sides())
    by_links = align(texts)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 3)
    by_ids = align(texts)
    for name in ("pair", "doc", "links", "n_links"):
        assert np.array_equal(getattr(by_links, name), getattr(by_ids, name))


def test_quick_ids_are_those_of_the_library():
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    quick = sides()[0]
    r = random.Random(11)
    tokens = [t for t in quick.tokens if t]
    texts = [b"".join(r.choice(tokens) for _ in range(r.randrange(1, 60))).decode("utf-8", "ignore") for _ in range(4000)]
    texts += ["".join(chr(r.choice([r.randrange(1, 0x250), r.randrange(0x3000, 0x3100), r.randrange(0x10000, 0x10FFFF)])) for _ in range(30)) for _ in range(500)]
    assert quick.encode(texts) == [e.ids for e in library.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_merged_runs_are_the_counts_of_all_records():
    r = np.random.default_rng(5)
    spills, want = [], Counter()
    for _ in range(7):
        key = np.unique(r.integers(0, 300 * 50, 900))
        pair, doc = key // 50, key % 50
        want.update(pair.tolist())
        spills.append(dict(alignment.runs(pair, doc, np.ones(len(pair), np.int64), 8, 50)))
    got = Counter()
    for part in range(alignment.RADIX):
        last = -1
        for pair, n in alignment.merged([s[part] for s in spills if part in s]):
            assert pair[0] > last and (np.diff(pair) > 0).all() and (pair // 8 % alignment.RADIX == part).all()
            last = pair[-1]
            got.update(dict(zip(pair.tolist(), n.tolist())))
    assert got == want
