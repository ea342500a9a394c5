import datetime as dt
import subprocess
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from millrace.operators import materialize as m
from millrace.plans import storage
from millrace.session import scratch_dir
from millrace.sinks.files import write, write_by_key
from millrace.sources import files, jdbc, sketches
from millrace.sources.custom import register_format

TRICKY = [
    (1, "plain", 1.5, dt.datetime(2024, 1, 2, 3, 4, 5, 678901)),
    (2, ' "quoted", with comma ', -0.0001, None),
    (3, "two\nlines and a \\ backslash", None, dt.datetime(1999, 12, 31, 23, 59, 59)),
    (4, "", 1e300, dt.datetime(2024, 1, 1)),
    (5, None, 0.1, dt.datetime(2024, 1, 1)),
    (6, "tab\tand ümläut ─", float("inf"), dt.datetime(2024, 6, 1, 12)),
]
SCHEMA = "id bigint, s string, x double, at timestamp_ntz"


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet", "orc"])
def test_what_is_read_back_is_what_was_written(spark, fmt):
    df = spark.createDataFrame(TRICKY, SCHEMA).repartition(3)
    options = {"nullValue": "\\N"} if fmt == "csv" else {}
    back = m.materialize(df, scratch_dir(spark, "tricky"), fmt, **options)
    assert [f.dataType for f in back.schema] == [f.dataType for f in df.schema]
    assert sorted(map(tuple, back.collect())) == TRICKY


def test_csv_options_are_used_for_reading_back_too(spark):
    df = spark.createDataFrame([(1, "a;b"), (2, None), (3, "")], "k int, v string")
    back = m.materialize(df, scratch_dir(spark, "semi"), "csv", sep=";")
    assert sorted(map(tuple, back.collect())) == [(1, "a;b"), (2, None), (3, None)]


def test_csv_inference_and_options(spark):
    path = scratch_dir(spark, "opts")
    write(spark.createDataFrame([(1, "a;b")], "k int, v string").coalesce(1), path, "csv", sep=";", compression="gzip")
    assert files.read_csv(spark, path, sep=";").collect() == [(1, "a;b")]
    assert files.discover_files(spark, path, "*.csv.gz").count() == 1


def test_text_by_line_and_whole(spark):
    path = scratch_dir(spark, "text")
    write(spark.createDataFrame([("one",), ("two",)], "v string").coalesce(1), path, "text")
    assert [r.value for r in files.read_text(spark, path).collect()] == ["one", "two"]
    assert [r.value for r in files.read_text(spark, path, whole=True).collect()] == ["one\ntwo\n"]


def test_json_document(spark):
    path = scratch_dir(spark, "doc")
    text = '[{"people":\n [{"name": "Ann Lee"}]}]'
    write(spark.createDataFrame([(text,)], "v string").coalesce(1), path, "text")
    doc = files.read_json(spark, path, "people array<struct<name:string>>", document=True)
    assert [p.name for r in doc.collect() for p in r.people] == ["Ann Lee"]


def test_matrix(spark, tmp_path):
    source = tmp_path / "m.txt"
    source.write_text("# head\n1 2.5\n  3e-3\t-4  # tail\n\n")
    assert [r["values"] for r in files.read_matrix(spark, str(source), columns=2).collect()] == [[1, 2.5], [0.003, -4]]
    with pytest.raises(Exception, match="3 numbers"):
        files.read_matrix(spark, str(source), columns=3).collect()
    source.write_text("1 x\n")
    with pytest.raises(Exception, match="not a number: x"):
        files.read_matrix(spark, str(source)).collect()
    with pytest.raises(ValueError):
        write(spark.range(3), scratch_dir(spark, "no"), "matrix")
    exact = [[0.1, 1 / 3, 1e-310, 123456789.123456789]]
    path = write(spark.createDataFrame([(exact[0],)], "v array<double>"), scratch_dir(spark, "exact"), "matrix")
    assert [r["values"] for r in files.read_matrix(spark, path).collect()] == exact


def test_discovery(spark, tmp_path):
    for name in ("func_0.py", "func_1.py", "hello.py", "world.py", "nested/foo.py", "notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    found = {r.relative_path for r in files.discover_files(spark, str(tmp_path)).collect()}
    assert found == {"func_0.py", "func_1.py", "hello.py", "world.py", "nested/foo.py"}
    texts = {r.relative_path: r.text for r in files.read_sources(spark, str(tmp_path)).collect()}
    assert texts["nested/foo.py"] == "# nested/foo.py\n" and len(texts) == 5


def test_warehouse_options():
    assert jdbc.postgres("h", 5432, "d", "u", "p") == {
        "url": "jdbc:postgresql://h:5432/d", "driver": "org.postgresql.Driver", "user": "u", "password": "p",
    }
    assert jdbc.redshift("h", 5439, "d", "u", "p")["url"] == "jdbc:redshift://h:5439/d"
    flake = jdbc.snowflake("acc", "u", "p", role="r", warehouse="w h", database="d", schema="s")
    assert flake["url"] == "jdbc:snowflake://acc.snowflakecomputing.com/?warehouse=w+h&role=r&db=d&schema=s"
    assert "OAuthPvtKeyPath=/k.json" in jdbc.bigquery("proj", "a@b", "/k.json")["url"]
    assert jdbc.trino("h", 443, "u", "p", "c", "s")["url"] == "jdbc:trino://h:443/c/s?SSL=true"
    assert jdbc.trino("h", 443, "u", "p")["url"] == "jdbc:trino://h:443?SSL=true"
    assert jdbc.presto("h", 80, "u", "p", "c", http_scheme="http")["url"] == "jdbc:presto://h:80/c?SSL=false"


@pytest.mark.parametrize("build", [jdbc.trino, jdbc.presto])
def test_schema_needs_catalog(build):
    with pytest.raises(ValueError, match="catalog"):
        build("h", 1, "u", "p", schema="s")


def test_unknown_connection(spark):
    with pytest.raises(ValueError, match="nope"):
        jdbc.Connections(spark, {"pg": {}}).execute_sql("nope", "SELECT 1")


def test_options_reach_the_jdbc_reader(spark):
    """Without a driver jar Spark stops at its class name, before any connection."""
    options = jdbc.trino("nowhere.invalid", 443, "u", "p")
    with pytest.raises(Exception, match="io.trino.jdbc.TrinoDriver"):
        jdbc.Connections(spark, {"t": options}).execute_sql("t", "SELECT 1;")
    with pytest.raises(Exception, match="org.postgresql.Driver"):
        pg = jdbc.postgres("nowhere.invalid", 1, "d", "u", "p")
        jdbc.Connections(spark, {"pg": pg}).scan("pg", "public.us500", ["1 = 1"])


@pytest.mark.parametrize("bounds", [[], [5], [0, 3, 3, 9], jdbc.stride_bounds(-4, 14, 6)])
def test_each_row_is_in_one_scan_partition(spark, bounds):
    df = spark.range(-20, 20).union(spark.sql("SELECT CAST(NULL AS BIGINT)")).withColumnRenamed("id", "k")
    predicates = jdbc.range_predicates("k", bounds)
    hits = sum((F.coalesce(F.expr(f"({p})").cast("int"), F.lit(0)) for p in predicates), F.lit(0))
    assert df.filter(hits != 1).count() == 0


def test_quantile_bounds_balance_a_skewed_column(spark):
    skewed = spark.range(1000).select((F.col("id") * F.col("id") * F.col("id")).alias("k"))
    cuts = jdbc.quantile_bounds(skewed, "k", 4)
    sizes = [skewed.filter(p).count() for p in jdbc.range_predicates("k", cuts)]
    assert len(sizes) == 4 and max(sizes) < 350


def test_bounds_from_sketches_of_loads(spark, tmp_path):
    path = str(tmp_path / "sketches")
    skewed = spark.range(40_000).selectExpr("id % 4 AS load", "CAST(pow(id / 1000, 4) AS bigint) AS k", "IF(id % 10 = 0, NULL, id) AS n")
    for load in range(4):
        for _ in range(2):  # recorded again, it counts once
            sketches.record_load(skewed.filter(f"load = {load}"), path, str(load), ["k", "n"])
    for column in ("k", "n"):
        bounds = sketches.sketched_bounds(spark, path, column, 10)
        predicates = jdbc.range_predicates(column, bounds)
        known = skewed.filter(f"{column} IS NOT NULL")
        sizes = [known.filter(p).count() for p in predicates]
        assert sum(sizes) == known.count() and len(sizes) == 10
        assert max(sizes) <= 1.1 * known.count() / 10 and min(sizes) >= 0.9 * known.count() / 10
    assert sketches.sketched_bounds(spark, path, "absent", 4) == [] and sketches.sketched_bounds(spark, path, "k", 1) == []


def test_fan_out_checks(spark):
    with pytest.raises(ValueError, match="string"):
        write_by_key(spark.range(3), "id", scratch_dir(spark, "f"))
    with pytest.raises(Exception, match="NULL in the fan-out key"):
        write_by_key(spark.createDataFrame([("a", 1), (None, 2)], "k string, v int"), "k", scratch_dir(spark, "f"))


def test_a_key_with_most_of_the_data_is_written_by_several_tasks(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "64kb")
    try:
        key = F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50))
        df = spark.range(60_000, numPartitions=6).select(key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        path = write_by_key(df, "k", scratch_dir(spark, "hot"))
    finally:
        spark.conf.set(name, before)
    named = spark.read.parquet(path).select("k", F.input_file_name().alias("file")).distinct()
    files_of = {r.k: r["count"] for r in named.groupBy("k").count().collect()}
    # Keys that share the hot key's shuffle partition are split with it; no key has more files.
    assert files_of["hot"] == max(files_of.values()) > 4 and len(files_of) == 6
    assert spark.read.parquet(path).count() == 60_000


def test_fan_out_is_done_once(spark):
    path = scratch_dir(spark, "fan")

    def keys_after(rows, **how):
        df = spark.createDataFrame(rows, "k string, v int")
        assert m.fan_out(df, "k", path, "json", **how) == path
        return {(r.k, r.v) for r in spark.read.schema(df.schema).json(path).collect()}

    assert keys_after([("a/b", 1), ("c", 2), ("10", 3)]) == {("a/b", 1), ("c", 2), ("10", 3)}
    assert keys_after([("z", 9)]) == {("a/b", 1), ("c", 2), ("10", 3)}
    assert keys_after([("z", 9)], done=lambda: False) == {("z", 9)}
    assert keys_after([("y", 8)], full_refresh=True) == {("y", 8)}


def test_targets_and_outputs_must_match(spark):
    with pytest.raises(ValueError, match="2 outputs for 1"):
        m.materialize_many([spark.range(1), spark.range(2)], [(scratch_dir(spark, "x"), "parquet")])


def test_first_output_goes_to_first_target(spark):
    targets = {"a": (scratch_dir(spark, "a"), "csv"), "b": (scratch_dir(spark, "b"), "parquet")}
    m.materialize_many([spark.range(1), spark.range(2)], list(targets.values()))
    back = m.read_many(spark, targets, {"a": "id bigint"})
    assert (back["a"].count(), back["b"].count()) == (1, 2)


def test_read_or_compute(spark):
    path, calls = scratch_dir(spark, "roc"), []

    def compute():
        calls.append(1)
        return spark.range(len(calls))

    with pytest.raises(ValueError, match="not run"):
        m.read_or_compute(spark, path, None)
    assert m.read_or_compute(spark, path, compute).count() == 1
    assert m.read_or_compute(spark, path, compute).count() == 1
    assert m.read_or_compute(spark, path, compute, done=lambda: False).count() == 2
    assert m.read_or_compute(spark, path, compute, done=lambda: True).count() == 2
    assert m.read_or_compute(spark, path, compute, full_refresh=True).count() == 3
    assert m.read_or_compute(spark, path, None).count() == 3
    with pytest.raises(ValueError, match="no output"):
        m.read_or_compute(spark, scratch_dir(spark, "none"), lambda: None)


def test_append_is_repeatable_also_with_null_keys(spark):
    path = scratch_dir(spark, "inc")
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "k int, v string")
    for _ in range(2):
        got = m.append_missing(df, path, ["k"])
    assert got.count() == 3


def test_partition_refresh_leaves_the_others(spark):
    path = scratch_dir(spark, "parts")
    m.refresh_partitions(spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "k int, p string"), path, "p")
    got = m.refresh_partitions(spark.createDataFrame([(9, "y")], "k int, p string"), path, "p")
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (9, "y")]


def test_custom_format_without_functions(spark):
    register_format(spark, "half_made", "id bigint")
    with pytest.raises(Exception, match="no function for that direction"):
        spark.range(3).write.format("half_made").mode("append").save(scratch_dir(spark, "half"))


def test_scratch_folder_is_the_configured_one(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_custom_functions_need_no_package_on_the_workers():
    payload = cloudpickle.dumps((storage.save_feather, storage.open_parquet, storage.count_row_groups))
    code = "import pickle, sys; print(len(pickle.load(sys.stdin.buffer)), 'millrace' in sys.modules)"
    result = subprocess.run([sys.executable, "-I", "-c", code], input=payload, capture_output=True, timeout=60)
    assert result.stdout.split() == [b"3", b"False"], result.stderr


def test_custom_source_over_a_folder(spark, tmp_path):
    for i in range(3):
        pq.write_table(pa.table({"id": pa.array(range(i * 10, i * 10 + 10))}), tmp_path / f"{i}.pq", row_group_size=4)
    (tmp_path / "_ignored.pq").write_text("")
    (tmp_path / "other.txt").write_text("")
    register_format(spark, "pieces", "id bigint", storage.open_parquet, count_pieces=storage.count_row_groups, suffix=".pq")
    df = spark.read.format("pieces").load(str(tmp_path))
    assert sorted(r.id for r in df.collect()) == list(range(30))
    assert df.rdd.getNumPartitions() == 9


def test_second_read_has_the_types_of_the_first(spark, tmp_path):
    df = spark.sql("SELECT 7L AS n, '007' AS code, TIMESTAMP_NTZ '2024-01-02 03:04:05.000006' AS at, 'a' AS z")
    for fmt in ("csv", "json", "parquet", "orc"):
        path = str(tmp_path / fmt)
        first = m.read_or_compute(spark, path, lambda: df, fmt)
        second = m.read_or_compute(spark, path, None, fmt)
        assert first.schema == second.schema and first.collect() == second.collect() == df.collect(), fmt


def test_line_breaks_in_csv_are_known_when_reading(spark, tmp_path):
    plain, broken = str(tmp_path / "plain"), str(tmp_path / "broken")
    m.materialize(spark.createDataFrame([("a",)], "s string"), plain, "csv")
    df = spark.createDataFrame([("a\nb",), ("c",)], "s string")
    m.materialize(df, broken, "csv")
    assert sorted(r.s for r in m.read_back(spark, broken, "csv").collect()) == ["a\nb", "c"]
    from millrace.sinks.files import layout

    assert layout(spark, broken)["line_breaks"] and not layout(spark, plain)["line_breaks"]
    m.append_missing(spark.createDataFrame([("x",)], "s string"), broken, ["s"], "csv")
    assert m.read_back(spark, broken, "csv").count() == 3


def test_appending_without_a_marker(spark, tmp_path):
    path = str(tmp_path / "t")
    source = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    assert m.append_missing(source, path, ["k"]).count() == 2
    (tmp_path / "t/_SUCCESS").unlink()
    assert m.append_missing(source, path, ["k"]).count() == 2


def test_a_batch_that_broke_off_is_published_again(spark, tmp_path, monkeypatch):
    from millrace.streaming import refresh

    landing, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "k string, p string, n int"

    def run():
        stream = refresh.arriving_files(spark, f"{landing}/load=*", schema)
        refresh.keep_latest(stream, table, checkpoint, ["k"], ["n"], "p").awaitTermination()

    spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("c", "y", 1)], schema).coalesce(1).write.parquet(f"{landing}/load=0")
    run()
    spark.createDataFrame([("a", "x", 2)], schema).coalesce(1).write.parquet(f"{landing}/load=1")
    whole = refresh.refresh_partitions

    def broken(*args):
        for part in (tmp_path / "out/p=x").iterdir():  # as a commit that stops between delete and rename
            part.unlink()
        raise RuntimeError("lost")

    monkeypatch.setattr(refresh, "refresh_partitions", broken)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(refresh, "refresh_partitions", whole)
    run()
    assert sorted(tuple(r) for r in spark.read.schema(schema).parquet(table).select("k", "n").collect()) == [("a", 2), ("b", 1), ("c", 1)]


def test_changes_are_compacted(spark, tmp_path, monkeypatch):
    from millrace.streaming import refresh

    monkeypatch.setattr(refresh, "COMPACT_EVERY", 2)
    landing, changes, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "k string, n int, status string"
    for i in range(5):
        spark.createDataFrame([("a", i, f"s{i}"), (f"b{i}", i, "x")], schema).coalesce(1).write.parquet(f"{landing}/load={i}")
        stream = refresh.arriving_files(spark, f"{landing}/load=*", schema)
        refresh.latest_status_changes(stream, changes, checkpoint, ["k"], ["n"]).awaitTermination()
    # The last batch folded 2 and 3, whose folders go with the next one; 0 and 1 are gone.
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if "=" in p.name) == ["_upto=1", "_upto=3", "batch_id=2", "batch_id=3", "batch_id=4"]
    got = {r.k: r.status for r in refresh.read_latest_changes(spark, changes, ["k"]).collect()}
    assert got == {"a": "s4", **{f"b{i}": "x" for i in range(5)}}
    assert refresh.read_latest_changes(spark, str(tmp_path / "none"), ["k"], "k string, status string").count() == 0


def test_custom_source_reads_the_columns_asked_for(spark):
    from millrace.sources.custom import arrow_uri

    df = spark.range(10).selectExpr("id", "id * 2 AS twice", "cast(id AS string) AS name")
    schema = "id bigint, twice bigint, name string"
    register_format(spark, "arrow_test", schema, storage.open_feather, storage.save_feather, storage.count_feather_batches, ".arrow")
    register_format(spark, "arrow_whole", schema, lambda stream, piece: storage.open_feather(stream, piece, ["id", "twice", "name"]), count_pieces=storage.count_feather_batches, suffix=".arrow")
    path = scratch_dir(spark, "arrow")
    df.write.format("arrow_test").mode("append").save(path)
    for name in ("arrow_test", "arrow_whole"):
        got = spark.read.format(name).option("columns", "name, id").load(path)
        assert got.columns == ["name", "id"] and sorted(got.collect()) == sorted(df.select("name", "id").collect())
    assert spark.read.format("arrow_test").load(path).columns == df.columns
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("arrow_test").option("columns", "x").load(path).collect()
    assert arrow_uri("s3a://bucket/a") == "s3://bucket/a" and arrow_uri("/tmp/s3a://x") == "/tmp/s3a://x"
