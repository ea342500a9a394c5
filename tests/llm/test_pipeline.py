"""The pipeline against a plain version, and the registered queries."""

import random
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from millrace.llm.queries import QUERIES
from tests.llm.test_table_operators import near_groups, targets_of, words
from tests.oracle_check import connect, difference

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(9)
    syllables = {"aa": ["ba", "do", "ki", "lu", "me"], "bb": ["sch", "ung", "ein", "tz", "ach"]}
    rows = []
    for i in range(160):
        lang = r.choice(["aa", "bb"])
        text = " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(30, 90)))
        rows.append([i, text, lang if i % 3 else None, r.choice(["s0"] * 5 + ["s1", "s2", None])])
    for i in range(160, 180):
        rows.append([i, rows[r.randrange(60)][1], "aa", "s1"])  # exact copies
    for i in range(180, 200):
        rows.append([i, rows[r.randrange(60, 160)][1] + " dodo", "bb", "s0"])  # near copies
    rows += [[200, None, "aa", "s0"], [201, "12 34 !?", None, "s0"], [202, "xyz qqq " * 20, None, "s2"], [203, "", "bb", None]]
    return [(*row, len(row[1] or "")) for row in rows]


def test_stages_against_a_plain_version(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    tables, docs = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        tables[name] = [r.asDict() for r in docs.collect()]
        assert docs.columns[:1] == ["doc_id"] and (name == "BPE" or docs.columns == [c.split()[0] for c in SCHEMA.split(", ")])
    ids = {name: sorted(r["doc_id"] for r in found) for name, found in tables.items()}
    assert ids["language ID"] == list(range(200))  # neither texts without letters nor in an unknown language
    last = defaultdict(int)
    for i, text, *_ in rows[:200]:
        last[text] = max(last[text], i)
    assert ids["exact dedup"] == sorted(last.values())
    groups = near_groups([(i, text) for text, i in last.items()], 5, 80)
    kept = {i for i, (_, component) in groups.items() if i == component}
    assert ids["near dedup"] == sorted(kept) and len(kept) < len(last)
    sizes, taken, text_of = Counter(), Counter(), {row[0]: row[1] for row in rows}
    for row in rows:
        if row[0] in kept:
            sizes[row[3]] += len(words(row[1]))
    for r in tables["mixing"]:
        taken[r["source"]] += len(words(r["text"]))
    assert max(Counter(ids["mixing"]).values()) <= 2 and set(ids["mixing"]) <= kept
    for source, target in targets_of(sizes).items():
        assert abs(taken[source] - target) <= 0.1 * target + 100
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert Counter(ids["BPE"]) == Counter(ids["mixing"])
    for r in tables["BPE"]:
        expected = library.encode(text_of[r["doc_id"]], add_special_tokens=False).ids
        assert r["token_ids"] == expected and r["n_tokens"] == len(expected)
        assert r["text"] == library.decode(expected, skip_special_tokens=False)


def test_run_is_repeatable_and_takes_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    docs.repartition(2).write.parquet(str(tmp_path / "a/documents.parquet"))
    docs.repartition(5).write.parquet(str(tmp_path / "b/documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "c/documents.parquet"))
    a, b, c = (Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / d)).collect()) for d in "abc")
    assert a == b and a and not c


def test_each_operator_has_its_query():
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(names) == set(QUERIES) and "pipeline" in queries()


def test_queries_equal_their_sql(spark, sf):
    con = connect(sf)
    for name in QUERIES:
        if name in oracle_sql():
            assert difference(queries()[name](spark, sf), con, oracle_sql()[name]) is None, name


def test_language_id_leaves_columns_of_its_names_alone(spark, tmp_path):
    rows = [(*row, row[0] / 8, "mine") for row in corpus()]
    docs = spark.createDataFrame(rows, SCHEMA + ", Score double, lang_pred string")
    kept = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    found = kept.collect()
    assert sorted(r.doc_id for r in found) == list(range(200)) and all(r.Score == r.doc_id / 8 and r.lang_pred == "mine" for r in found)
