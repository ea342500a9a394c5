import pytest
from pyspark.sql import functions as F

from millrace import Datasets
from millrace.functions import params, text


def test_last_publication_wins_and_views_follow(spark):
    data = Datasets(spark)
    data.publish("a.b", spark.range(3))
    data.publish("a.b", spark.range(5))
    assert data.ref("a.b").count() == 5
    assert data.sql("SELECT count(*) AS n FROM `a.b`").first().n == 5


def test_outputs_by_name(spark):
    data = Datasets(spark)
    data.publish("load", {"x": spark.range(1), "y": spark.range(2)})
    data.publish("load.other_task", spark.range(9))
    assert data.ref("load", "y").count() == 2
    with pytest.raises(ValueError, match="outputs"):
        data.ref("load")
    data.publish("load", spark.range(4))
    assert data.ref("load").count() == 4
    assert data.ref("load.other_task").count() == 9
    with pytest.raises(ValueError):
        data.ref("load", "y")


@pytest.mark.parametrize("output", [None, {}, {"x": None}, {"x": 3}])
def test_a_step_must_yield_frames(spark, output):
    with pytest.raises(ValueError):
        Datasets(spark).publish("step", output)


def test_unknown_reference(spark):
    with pytest.raises(ValueError, match="nowhere"):
        Datasets(spark).ref("nowhere")


def test_step_feeds_step(spark):
    data = Datasets(spark)
    data.publish("one", spark.range(10))
    data.step("two", lambda df: df.filter("id > 5"), "one")
    assert data.ref("two").count() == 4
    with pytest.raises(ValueError, match="no rows"):
        data.step("three", lambda df: df.filter("id > 50"), "one", require_rows=True)


def test_parameters_override_and_default(spark):
    data = Datasets(spark, {"low": 3, "unused": "x"})
    assert data.sql("SELECT count(*) AS n FROM {r} WHERE id >= :low", r=spark.range(10)).first().n == 7
    assert data.sql("SELECT count(*) AS n FROM {r} WHERE id >= :low", {"low": 9}, r=spark.range(10)).first().n == 1
    assert data.param("low") == 3 and data.param("missing", "d") == "d"
    assert params.merged_parameters({"a": 1, "b": 1}, {"b": 2}) == {"a": 1, "b": 2}


def test_map_parameters(spark):
    df = spark.sql("SELECT map('a', '1', 'b', CAST(NULL AS STRING)) AS m, map('b', '2', 'c', '3') AS n")
    row = df.select(
        params.ctx_merge(F.col("m"), F.col("n")).alias("merged"),
        params.ctx_merge(F.col("m"), F.lit(None).cast("map<string,string>")).alias("only_base"),
        params.ctx_lookup(F.col("m"), "a", "d").alias("a"),
        params.ctx_lookup(F.col("m"), "b", "d").alias("b"),
        params.ctx_lookup(F.col("m"), "z", "d").alias("z"),
    ).first()
    assert row.merged == {"a": "1", "b": "2", "c": "3"}
    assert row.only_base == {"a": "1", "b": None}
    assert (row.a, row.b, row.z) == ("1", None, "d")


def test_stringified_values(spark):
    df = spark.sql("SELECT map('t', true, 'f', false, 'n', NULL) AS flags, map('i', 7, 'n', NULL) AS numbers")
    row = df.select(
        params.ctx_stringify(F.col("flags")).alias("flags"), params.ctx_stringify(F.col("numbers")).alias("numbers")
    ).first()
    assert row.flags == {"t": "True", "f": "False", "n": "None"}
    assert row.numbers == {"i": "7", "n": "None"}


def test_bad_json(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": [1]}}',), ("nonsense",), ("{}",)], "t string")
    rows = [r.m for r in df.select(params.json_to_map(F.col("t")).alias("m")).collect()]
    assert rows == [{"a": "1", "b": '{"c":[1]}'}, None, {}]
    with pytest.raises(Exception, match="(?i)malformed"):
        df.select(params.json_to_map(F.col("t"), strict=True).alias("m")).collect()


def test_text_functions(spark):
    df = spark.createDataFrame([("Hello from task 1!", "abc", "Jane Van Doe", "a/b/c.py", "x.py")], "s string, t string, n string, p string, q string")
    row = df.select(
        text.text_append(F.col("s"), F.lit("Hello from task 2!")).alias("joined"),
        text.string_tail(F.col("s"), 5).alias("tail"),
        text.string_tail(F.col("t"), 5).alias("short"),
        text.file_slug(F.col("n")).alias("slug"),
        text.path_parts(F.col("p")).alias("deep"),
        text.path_parts(F.col("q")).alias("flat"),
    ).first()
    assert row.joined == "Hello from task 1!\nHello from task 2!"
    assert (row.tail, row.short, row.slug) == ("sk 1!", "abc", "jane_van_doe.txt")
    assert tuple(row.deep) == ("a/b/c", "a/b", "c", 3)
    assert tuple(row.flat) == ("x", None, "x", 1)


def test_registries_with_the_same_names(spark):
    from millrace import Datasets

    a, b = Datasets(spark), Datasets(spark)
    a.publish("t", spark.range(1))
    b.publish("t", spark.range(5))
    assert a.sql("SELECT count(*) AS n FROM t").first().n == a.ref("t").count() == 1
    assert b.sql("SELECT count(*) AS n FROM t").first().n == 5
