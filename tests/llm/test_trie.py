"""Prefix trie of rebuilt conversations, against sequences of whole turns."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from millrace.llm import trie

TURNS = "conv_id long, turn long, role string, text string, depth string, head int"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(text):
    return sha256(text.encode()).hexdigest()


def plain(rows, base, head):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, digest(role or ""), digest(text or ""), (role or "", text or "")))
    turns = {c: [t[-1] for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {c: tuple(turns.get(base(c), [])[: head(c)] + t[head(c) :]) for c, t in turns.items()}
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[n] for n in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[n] for n in children[node])
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if rebuilt[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), len(children[node]), leaves[node], saved[node], digest(ends)))
    return sorted(out, key=repr)


def base(c):
    return c - (abs(c) % 10 if c >= 0 else -(abs(c) % 10))


def head(c):
    return zlib.crc32(str(c).encode()) % 6


def found(spark, rows, head_sql="crc32(cast(cast(conv_id AS string) AS binary)) % 6"):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(3)
    got = trie.prefix_trie(df, F.expr("conv_id - conv_id % 10"), F.expr(head_sql))
    return sorted((tuple(r[n] for n in NAMES) for r in got.collect()), key=repr)


def made_up(n, seed, words=3):
    r = random.Random(seed)
    rows = []
    for c in range(-15, n):
        if r.random() < 0.1:
            continue
        for turn in range(r.choice([1, 2, 2, 4, 9])):
            rows.append((c, None if r.random() < 0.1 else turn, r.choice(["user", "assistant", None, ""]), r.choice(["a", "bé", "🙂", None, "", "ab"][: words + 1])))
    rows += [(None, 0, "user", "a"), (7, 3, "user", "a"), (7, 3, "user", "a"), (7, 3, "user", "b")]
    return rows


def test_against_sequences(spark):
    rows = made_up(120, 1)
    assert found(spark, rows) == plain(rows, base, head)


def test_long_conversations_in_segments(spark, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 4)
    monkeypatch.setattr(trie, "PIECE", 3)
    r = random.Random(2)
    rows = made_up(60, 3) + [(c, t, "user", r.choice("ab") if t > 20 else "same") for c in (200, 201, 202, 203) for t in range(30)]
    rows += [(c, t, "user", "copy" * 100) for c in range(300, 340) for t in range(9)]
    assert found(spark, rows) == plain(rows, base, head)
    # A negative head counts as none.
    assert found(spark, rows, "conv_id % 40") == plain(rows, base, lambda c: c % 40 if c >= 0 else 0)


def test_heads_longer_than_a_segment(spark, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 4)
    rows = [(c, t, "user", f"{c // 2} {t}") for c in range(20) for t in range(c + 3)]
    assert found(spark, rows, "conv_id") == plain(rows, base, lambda c: c)


def test_turnless_and_empty(spark):
    rows = [(105, 0, "user", "gone"), (213, None, None, None)]
    assert found(spark, rows) == plain(rows, base, head)
    assert found(spark, rows, "CAST(9 AS long)") == [(105, 0, None, 2, 0, 1, 0, digest("105,213"))]
    assert found(spark, []) == []


def test_equal_digests_of_unequal_turns_start_again(spark, monkeypatch):
    rows, tried = made_up(40, 4), []

    def weak(turns, attempt):
        tried.append(attempt)
        if attempt == 0:
            return turns.withColumn("k1", F.length("text").cast("long")).withColumn("k2", F.lit(1).cast("long"))
        return turns.withColumn("k1", F.xxhash64("role", "text")).withColumn("k2", F.xxhash64("text", "role"))

    monkeypatch.setattr(trie, "_digests", weak)
    assert found(spark, rows) == plain(rows, base, head)
    assert tried == [0, 1]
    monkeypatch.setattr(trie, "_digests", lambda turns, attempt: weak(turns, 0))
    with pytest.raises(RuntimeError):
        found(spark, rows)


def test_unequal_prefixes_of_one_fingerprint_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(trie, "PRIME", 7)
    with pytest.raises(RuntimeError):
        found(spark, made_up(80, 5))


def test_very_long_text_and_reference(spark):
    rows = [(100, 0, "user", "x" * 300_000), (100, 1, "user", "end"), (101, 0, "user", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    got = trie.prefix_trie(df, F.lit(None).cast("long"), F.lit(0))
    assert sorted((r.depth, r.conv_id, r.saved_tokens, r.ref_conv_id, r.ref_position) for r in got.collect()) == [
        (0, 100, 300_000, None, None), (1, 100, 300_000, 100, 1), (2, 100, 0, 100, 2)
    ]
