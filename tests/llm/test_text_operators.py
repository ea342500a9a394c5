"""Operators on single texts: languages, tokens, word pieces, chat and archives."""

import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import WordPiece

from millrace.llm import bpe, bytes_, chat, langid, warc, wordpiece
from millrace.session import scratch_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Codec(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


# Words


def test_word_hashes_depend_on_the_word_only():
    texts = ["Hello wörld", "", None, "x hello\tWÖRLD  ", "hello" * 9000 + " hello", "\n\r\x0b\x0c ", "ab ba"]
    found = {}
    for limit in (10, 1 << 20):
        rows = []
        for chunk in bytes_.words(pa.array(texts), limit):
            rows += [chunk.hashes[a:b].tolist() for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True)]
        found[limit] = rows
    assert found[10] == found[1 << 20]
    rows = found[10]
    assert [len(r) for r in rows] == [2, 0, 0, 3, 2, 0, 2]
    assert rows[0][0] == rows[3][1] == rows[4][1]
    assert rows[0][1] != rows[3][2]  # only A-Z are folded
    assert rows[6][0] != rows[6][1]


# BPE


def test_encoding_equals_the_library(codec, library, sf, spark):
    r = random.Random(5)
    letters = "abcdefgh    \n\t'sStTéÉΣσςñ中文🙂12 ́  \x1c\x85<|>!?.,"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(500)]
    texts += ["", " \n", "a<|endoftext|>b<|startoftext|>", "x" * 3000, "the" * 3000, "ΑΣ Σ's İ", "<|EndOfText|>"]
    texts += [row["text"] for row in spark.read.parquet(f"{sf}/documents.parquet").limit(100).collect()]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert list(codec.encode(texts)) == expected
    assert [codec.decode(ids) for ids in expected] == [library.decode(ids, skip_special_tokens=False) for ids in expected]


def test_long_and_short_trees_agree(codec):
    r = random.Random(6)
    for n in [2, 3, 7, 16, 17, 100, 256]:
        word = "".join(r.choice("theandioxz") for _ in range(n)).encode()
        assert codec._single(word) == codec._batch([word])[0]


def test_known_words_may_be_forgotten(codec, monkeypatch):
    texts = ["alpha beta gamma delta", "beta epsilon", "alpha zeta, beta!"] * 3
    whole = list(codec.encode(texts))
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 2)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 5)
    assert list(codec.encode(texts)) == whole


def test_encoded_and_decoded_tables(spark, library):
    rows = [(1, "Hello there", 7), (1, "Hello there", 7), (None, None, None), (3, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids int")
    out = bpe.with_decoded(bpe.encoded(docs, PATH), PATH).collect()
    ids = library.encode("Hello there", add_special_tokens=False).ids
    assert sorted((r["doc_id"] or 0, r["token_ids"], r["text"]) for r in out) == [
        (0, [], ""), (1, ids, "hello</w> there</w>"), (1, ids, "hello</w> there</w>"), (3, [], "")
    ]
    assert bpe.digests(docs.limit(0), PATH).count() == 0


# Word pieces


def greedy(word, vocabulary):
    """Longest match by trying every end."""
    at = n = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if ("##" if at else "") + word[at:end] in vocabulary:
                break
        else:
            return 0
        at, n = end, n + 1
    return n


def test_automaton_counts_as_greedy_matching_does():
    r = random.Random(7)
    for _ in range(30):
        pieces = {("##" if r.random() < 0.6 else "") + "".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 15))}
        automaton = wordpiece.Automaton(sorted(pieces))
        for _ in range(200):
            word = "".join(r.choice("abcd" if r.random() < 0.1 else "abc") for _ in range(r.randint(1, 12)))
            assert automaton.count(word) == greedy(word, pieces), (pieces, word)


def test_counts_equal_the_library(spark, sf):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        vocabulary = wordpiece.vocabulary_of(file.read())
    model = Tokenizer(WordPiece({p: i for i, p in enumerate([*dict.fromkeys(vocabulary), "[UNK]"])}, unk_token="[UNK]", max_input_chars_per_word=10**6))
    counter = wordpiece.PieceCounter(vocabulary)
    for row in spark.read.parquet(f"{sf}/documents.parquet").limit(30).collect():
        words = counter.words.findall(row["text"].lower())
        tokens = [t for w in words for t in model.encode(w).tokens]
        assert counter.counts(row["text"]) == (len(words), len(tokens), tokens.count("[UNK]"))


def test_word_piece_table(spark):
    docs = spark.createDataFrame([(1, "ab abc  x"), (None, None), (2, ""), (2, "ab"), (3, "ab" * 5000)], "doc_id long, text string")
    out = wordpiece.token_counts(docs.withColumn("n_words", F.lit("clash")), ["ab", "##c", "##ab"]).collect()
    found = sorted((r["doc_id"] or 0, r["n_words"], r["n_tokens"], r["n_unknown"]) for r in out)
    assert found == [(0, 0, 0, 0), (1, 3, 4, 1), (2, 0, 0, 0), (2, 1, 1, 0), (3, 1, 5000, 0)]
    assert wordpiece.token_counts(docs.limit(0), ["ab"]).count() == 0


# Languages


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    training = langid.in_training(F.col("doc_id"))
    model = langid.learn(docs.filter(training))
    out = langid.identified(docs.filter(~training).withColumn("score", F.lit("clash")), model)
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.98
    assert out.filter("score < 0 or score > 1 or score is null").count() == 0


def test_filter_names_all_languages_of_an_ngram(spark):
    rows = [(i, t, lang) for i in range(5) for t, lang in [("alpha shared", "a"), ("beta shared", "b")]]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    (hashes, _), _ = langid.Grams().of(["sha"])[1]
    assert model.masks(hashes, 0)[1] == 3  # "sha" without spaces is in both
    (hashes, _), _ = langid.Grams().of(["pha"])[1]
    assert model.masks(hashes, 0)[1] == 1


def test_language_edge_cases(spark):
    rows = [(1, "Das ist ein Haus " * 4, "de"), (2, "this is the house " * 4, "en"), (3, None, "en"), (4, "", None), (5, "1234 !!", "de")]
    docs = spark.createDataFrame(rows * 4, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    asked = [(1, "ein haus"), (2, "THE HOUSE"), (3, None), (4, "123 ..."), (None, "qqq www"), (6, "ein haus " * 200_000)]
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identified(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert out[1][0] == "de" and out[2][0] == "en" and out[6][0] == "de" and out[6][1] > 0.9
    assert out[3] == out[4] == ("und", 0.0)
    assert out[None] == ("de", 0.0)  # as many rows in both, the first by name
    nothing = langid.learn(docs.limit(0))
    assert langid.identified(docs, nothing).filter("lang_pred <> 'und'").count() == 0
    assert langid.identified(docs.limit(0), model).count() == 0


# Chat


def rendered(turns):
    """One conversation in plain Python: speaker -> text and masks of the whole."""
    out = {}
    for speaker in {t[1] for t in turns} - {"system"}:
        text, masks = "", []
        for _, name, said in turns:
            who = "assistant" if name == speaker else "system" if name == "system" else f"user name={name}"
            text += f"<|im_start|>{who}\n"
            if name == speaker:
                masks.append((len(text), len(text) + len(said) + len("<|im_end|>")))
            text += f"{said}<|im_end|>\n"
        out[speaker] = (text, masks)
    return out


def test_every_speaker_is_the_assistant_once(spark):
    r = random.Random(8)
    turns = [(i, r.choice(["ann", "bob", "system", "cy"]), "word 🙂 " * r.randint(0, 3)) for i in range(150)]
    rows = [(1, *t) for t in turns]
    r.shuffle(rows)
    out = chat.rotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_turns=16).collect()
    for speaker, (text, masks) in rendered(turns).items():
        parts = sorted((p for p in out if p["speaker"] == speaker), key=lambda p: p["part"])
        assert "".join(p["text"] for p in parts) == text
        offsets = [sum(len(q["text"]) for q in parts[:i]) for i in range(len(parts))]
        assert [(m["start"] + o, m["end"] + o) for p, o in zip(parts, offsets, strict=True) for m in p["masks"]] == masks


def test_chat_edge_cases(spark):
    rows = [(1, 0, "system", "only"), (2, None, None, None), (2, 1, "a", "x<|im_end|>y"), (None, 0, "a", "no id"), (3, 1, "a", "same"), (3, 1, "a", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    out = {(r["conv_id"], r["speaker"]): r for r in chat.rotations(turns).collect()}
    assert set(out) == {(2, "a"), (2, "unknown"), (None, "a"), (3, "a")}
    assert out[2, "a"]["text"] == "<|im_start|>assistant\nx< |im_end|>y<|im_end|>\n<|im_start|>user name=unknown\n<|im_end|>\n"
    assert out[3, "a"]["n_turns"] == 2 and len(out[3, "a"]["masks"]) == 2
    assert chat.rotations(turns.limit(0)).count() == 0


# WARC


def test_archives_round_trip(spark):
    long = "<p>" + "repeated text " * 50
    rows = [(5, "http://a/", long), (3, "http://b/\r\nX: y", long), (9, None, "short"), (8, "http://c/", "short"), (7, "http://d/", None),
            (None, "http://e/", long), (6, "http://f/", "é" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(2, "page_id")
    path = scratch_dir(spark, "warc-test")
    warc.write(pages, path)
    out = {r["page_id"]: r for r in warc.read(spark, path, payloads=True).collect()}
    assert len(out) == len(rows)
    for page_id, url, html in rows:
        raw, r = (html or "").encode(), out[page_id]
        revisit = html == long and page_id != 3
        assert (r["payload_bytes"], r["record_type"], r["refers_to"]) == (len(raw), "revisit" if revisit else "response", 3 if revisit else None)
        assert r["payload"] == (None if revisit else raw)
        assert r["url"] == (url and url.replace("\r\n", "%0D%0A"))
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect() if r["length"]]
    for content in files:
        magic, size = struct.unpack("<II", content[:8])
        assert magic == 0x184D2A5D
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size]))
        # Any record can be read alone, from its own frame.
        frames = content[8 + size :].split(warc.EMPTY_FRAME.encode())[1:-1]
        for frame in frames:
            assert unpack.decompressobj().decompress(frame).startswith(b"WARC/1.1\r\n")


def test_trained_dictionary_helps(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(200).collect()
    samples = [warc.record(p["page_id"], p["url"], p["html"].encode(), "0" * 64, None, False) for p in pages]
    made = warc.dictionary(samples)
    assert made.dict_id() != 0
    small = [zstandard.ZstdCompressor(level=3, dict_data=d) if d else zstandard.ZstdCompressor(level=3) for d in (made, None)]
    assert sum(len(small[0].compress(s)) for s in samples) < sum(len(small[1].compress(s)) for s in samples)


def test_empty_archive(spark):
    path = scratch_dir(spark, "warc-test")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0
