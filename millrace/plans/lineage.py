"""Lineage operators over graphs derived from the part and page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.lineage import build, checks, order, reach
from millrace.plans import inputs
from millrace.plans.catalog import registered
from millrace.session import read_table


@registered(
    "ref_edges",
    f"""
    WITH {inputs.DAG_SQL}
    SELECT 'task-' || source_id AS source_id, 'task-' || target_id AS target_id,
           row_number() OVER (PARTITION BY target_id ORDER BY source_id DESC) - 1 AS place
    FROM dag
    """,
)
def ref_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = build.ref_edges(inputs.task_sources(spark, sf_dir))
    return found.withColumn("place", F.col("place").cast("bigint"))


@registered(
    "unclear_refs",
    """
    SELECT 'task-' || p_partkey AS id, 1 + (p_size % 2) AS n_calls, p_size % 2 AS n_clear FROM part WHERE p_type = 'SMALL'
    """,
)
def unclear_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of small parts call with two arguments or with a name; those of odd size also have a clear call."""
    small = inputs.parts(spark, sf_dir)
    odd = F.when(F.col("p_size") % 2 == 1, F.lit('CurrentRun.ref("task-0")\n')).otherwise("")
    bad = F.when(F.col("p_type") != "SMALL", "").when(F.col("p_size") % 3 == 0, "CurrentRun.ref(name)\n").otherwise('CurrentRun.ref("task-0", "task-1")\n')
    sources = small.select(F.concat(F.lit("task-"), "p_partkey").alias("id"), F.concat(odd, bad).alias("text"))
    return build.unclear_refs(sources)


@registered(
    "html_link_edges",
    """
    SELECT page_id AS source_id, UNNEST(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target_id FROM pages
    """,
)
def html_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.link_edges(read_table(spark, sf_dir, "pages"), "page_id", "html")


@registered(
    "default_node_id",
    """
    SELECT p_partkey, CASE WHEN p_size = 1 THEN 'custom-' || p_partkey
        ELSE 'parts/' || lower(p_type) || '.' || replace(p_name, ' ', '') END AS id
    FROM part
    """,
)
def default_node_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("parts/"), F.lower("p_type"), F.lit(".py"))
    explicit = F.when(F.col("p_size") == 1, F.concat(F.lit("custom-"), F.col("p_partkey")))
    name = F.replace("p_name", F.lit(" "), F.lit(""))
    return inputs.parts(spark, sf_dir).select("p_partkey", build.node_id(path, name, explicit).alias("id"))


@registered(
    "nodes_edges",
    """
    WITH l AS (SELECT page_id, UNNEST(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
    e AS (SELECT DISTINCT 'page-' || page_id AS source_id, href AS target_id FROM l),
    n AS (SELECT 'page-' || page_id AS id FROM pages UNION SELECT source_id FROM e UNION SELECT target_id FROM e)
    SELECT 'node' AS kind, id AS source_id, NULL AS target_id FROM n
    UNION ALL SELECT 'edge', source_id, target_id FROM e
    """,
)
def nodes_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    page = F.concat(F.lit("page-"), F.col("page_id"))
    links = build.link_edges(pages, "page_id", "html").withColumn("source_id", F.concat(F.lit("page-"), "source_id"))
    nodes, edges = build.nodes_and_edges(pages.select(page.alias("id")), links)
    listed = nodes.select(
        F.lit("node").alias("kind"), F.col("id").alias("source_id"), F.lit(None).cast("string").alias("target_id")
    )
    return listed.unionByName(edges.select(F.lit("edge").alias("kind"), "source_id", "target_id"))


@registered(
    "adjacency",
    f"""
    WITH {inputs.DAG_SQL}, {inputs.TASKS_SQL},
    e AS (SELECT 'task-' || source_id AS source_id, 'task-' || target_id AS target_id FROM dag)
    SELECT id, CAST(0 AS BIGINT) AS page,
           coalesce(string_agg(source_id, ',' ORDER BY source_id), '') AS refs
    FROM tasks LEFT JOIN e ON id = target_id GROUP BY id
    """,
)
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = build.adjacency(inputs.tasks(spark, sf_dir), inputs.task_edges(spark, sf_dir))
    return lists.withColumn("refs", F.array_join("refs", ","))


@registered(
    "duplicate_ids",
    """
    WITH m AS (SELECT p_name AS id, p_brand AS module, count(*) AS n_rows FROM part GROUP BY ALL),
    d AS (SELECT id, count(*) AS n_modules FROM m GROUP BY id HAVING sum(n_rows) > 1)
    SELECT m.id, m.module, m.n_rows, d.n_modules FROM m JOIN d ON m.id = d.id
    """,
)
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = inputs.parts(spark, sf_dir).select(F.col("p_name").alias("id"), F.col("p_brand").alias("module"))
    return checks.duplicate_ids(declared)


@registered(
    "dangling_refs",
    f"""
    WITH {inputs.DAG_SQL}
    SELECT source_id, count(*) AS n_refs FROM dag
    WHERE source_id NOT IN (SELECT p_partkey FROM part WHERE p_size <> 7) GROUP BY source_id
    """,
)
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = inputs.parts(spark, sf_dir).filter("p_size <> 7").select(F.col("p_partkey").alias("id"))
    return checks.dangling_refs(nodes, inputs.dag_edges(spark, sf_dir))


@registered(
    "unknown_seeds",
    """
    SELECT DISTINCT l_partkey AS id FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size >= 25)
    """,
)
def unknown_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = inputs.parts(spark, sf_dir).filter("p_size >= 25").select(F.col("p_partkey").alias("id"))
    seeds = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"))
    return checks.unknown_seeds(nodes, seeds)


UPSTREAM_SQL = "up(id) AS (SELECT id FROM seeds UNION SELECT source_id FROM up JOIN dag ON target_id = id)"
DOWNSTREAM_SQL = "down(id) AS (SELECT id FROM seeds UNION SELECT target_id FROM down JOIN dag ON source_id = id)"


@registered(
    "upstream_closure",
    f"""
    WITH RECURSIVE {inputs.DAG_SQL}, {inputs.SEEDS_SQL},
    up(id, d) AS (SELECT id, 0 FROM seeds UNION SELECT source_id, d + 1 FROM up JOIN dag ON target_id = id)
    SELECT id, CAST(min(d) AS BIGINT) AS distance FROM up GROUP BY id
    """,
)
def upstream_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = reach.upstream(inputs.dag_edges(spark, sf_dir), inputs.seed_nodes(spark, sf_dir))
    return reached.select("id", F.col("distance").cast("bigint").alias("distance"))


@registered(
    "downstream_closure",
    f"""
    WITH RECURSIVE {inputs.DAG_SQL}, {inputs.SEEDS_SQL}, {DOWNSTREAM_SQL} SELECT id FROM down
    """,
)
def downstream_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach.downstream(inputs.dag_edges(spark, sf_dir), inputs.seed_nodes(spark, sf_dir)).select("id")


@registered(
    "selection",
    f"""
    WITH RECURSIVE {inputs.DAG_SQL}, {inputs.SEEDS_SQL}, {UPSTREAM_SQL}, {DOWNSTREAM_SQL}
    SELECT id FROM up UNION SELECT id FROM down
    """,
)
def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = inputs.part_nodes(spark, sf_dir), inputs.dag_edges(spark, sf_dir)
    return reach.select_nodes(nodes, edges, inputs.seed_nodes(spark, sf_dir), with_downstream=True)


@registered(
    "selection_status",
    f"""
    WITH RECURSIVE {inputs.DAG_SQL}, {inputs.SEEDS_SQL}, {UPSTREAM_SQL}
    SELECT id, CASE WHEN id IN (SELECT id FROM seeds) THEN 'EXPLICIT' ELSE 'UPSTREAM_ONLY' END AS status FROM up
    """,
)
def selection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = inputs.part_nodes(spark, sf_dir), inputs.dag_edges(spark, sf_dir)
    seeds = inputs.seed_nodes(spark, sf_dir)
    return reach.selection_status(reach.select_nodes(nodes, edges, seeds), seeds)


@registered(
    "glob_selection",
    f"""
    WITH {inputs.TASKS_SQL} SELECT id, path FROM tasks
    WHERE split_part(path, '/', 2) IN (SELECT lower(p_type) FROM part WHERE p_retailprice > 900 GROUP BY p_type
                                       HAVING lower(p_type) > 'm')
    """,
)
def glob_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = inputs.parts(spark, sf_dir).filter("p_retailprice > 900 AND lower(p_type) > 'm'")
    globs = kinds.select(F.concat(F.lit("parts/"), F.lower("p_type"), F.lit("/*")).alias("glob")).distinct()
    return reach.select_by_glob(inputs.tasks(spark, sf_dir), globs)


@registered(
    "induced_subgraph",
    f"""
    WITH RECURSIVE {inputs.DAG_SQL}, {inputs.SEEDS_SQL}, {UPSTREAM_SQL}
    SELECT source_id, target_id FROM dag
    WHERE source_id IN (SELECT id FROM up) AND target_id IN (SELECT id FROM up)
    """,
)
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = inputs.dag_edges(spark, sf_dir)
    return reach.induced_subgraph(edges, reach.upstream(edges, inputs.seed_nodes(spark, sf_dir)))


@registered(
    "cyclic_components",
    f"""
    WITH RECURSIVE {inputs.CYCLIC_SQL},
    r(a, b) AS (SELECT source_id, target_id FROM cyclic UNION SELECT a, target_id FROM r JOIN cyclic ON source_id = b)
    SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a
    """,
)
def cyclic_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.cyclic_components(inputs.cyclic_edges(spark, sf_dir))


LEVEL_SQL = f"""
    {inputs.DAG_SQL},
    w(id, level) AS (
        SELECT p_partkey, 0 FROM part WHERE p_partkey NOT IN (SELECT target_id FROM dag)
        UNION SELECT target_id, level + 1 FROM w JOIN dag ON source_id = id
    ),
    levels AS (SELECT id, CAST(max(level) AS BIGINT) AS level FROM w GROUP BY id)
"""


@registered(
    "topo_level",
    f"WITH RECURSIVE {LEVEL_SQL} SELECT id, level, row_number() OVER (ORDER BY level, id) AS position FROM levels",
)
def topo_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.topological_order(inputs.part_nodes(spark, sf_dir), inputs.dag_edges(spark, sf_dir))


@registered(
    "topo_violations",
    f"WITH {inputs.DAG_SQL} SELECT count(*) AS n_edges, CAST(0 AS BIGINT) AS n_violations FROM dag",
)
def topo_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = inputs.dag_edges(spark, sf_dir)
    return order.order_check(edges, order.topological_order(inputs.part_nodes(spark, sf_dir), edges))


@registered(
    "position_of_total",
    f"""
    WITH {inputs.LEDGER_SQL}, t AS (SELECT DISTINCT run_slug, task_id FROM ledger)
    SELECT run_slug, task_id, row_number() OVER (PARTITION BY run_slug ORDER BY task_id) AS position,
           count(*) OVER (PARTITION BY run_slug) AS total
    FROM t
    """,
)
def position_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = inputs.ledger(spark, sf_dir).select("run_slug", "task_id").distinct()
    return build.position_of_total(tasks, ["task_id"], ["run_slug"])


@registered(
    "manifest_json",
    f"""
    WITH {inputs.DAG_SQL}, {inputs.TASKS_SQL},
    placed AS (
        SELECT id, 'parts/' || split_part(path, '/', 2) || '/' AS folder,
               regexp_replace(split_part(path, '/', 3), '\\.py$', '') AS module
        FROM tasks
    ),
    items AS (
        SELECT 'refs' AS section, 'task-' || target_id AS task_id, 'task-' || source_id AS item FROM dag
        UNION SELECT 'targets', 'task-' || p_partkey, 'out/' || p_name || '.csv' FROM part WHERE p_type = 'SMALL'
    )
    SELECT 'tasks' AS section, folder, module, NULL AS task_id, CAST((n - 1) // 1000 AS BIGINT) AS page,
           CAST(to_json(list(id ORDER BY id)) AS VARCHAR) AS items
    FROM (SELECT *, row_number() OVER (PARTITION BY folder, module ORDER BY id) AS n FROM placed)
    GROUP BY folder, module, (n - 1) // 1000
    UNION ALL
    SELECT s.section, folder, module, id, CAST(0 AS BIGINT),
           coalesce(CAST(to_json(list(item ORDER BY item) FILTER (item IS NOT NULL)) AS VARCHAR), '[]')
    FROM placed CROSS JOIN (VALUES ('refs'), ('targets')) s(section)
    LEFT JOIN items i ON i.section = s.section AND i.task_id = id
    GROUP BY s.section, folder, module, id
    """,
)
def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = inputs.parts(spark, sf_dir).filter("p_type = 'SMALL'")
    loc = F.concat(F.lit("out/"), F.col("p_name"), F.lit(".csv"))
    targets = small.select(inputs.task_name("p_partkey").alias("task_id"), loc.alias("loc"))
    return build.manifest(inputs.tasks(spark, sf_dir), inputs.task_edges(spark, sf_dir), targets)


@registered(
    "manifest_tree",
    f"""
    WITH RECURSIVE {inputs.DAG_SQL},
    placed AS (
        SELECT 'task-' || p_partkey AS id, 'parts/' || lower(p_type) || '/s' || p_size || '/' AS folder, replace(lower(p_brand), '#', '_') AS module
        FROM part
    ),
    counted AS (
        SELECT folder, module, (SELECT count(*) FROM dag WHERE 'task-' || target_id = p.id) AS n_refs,
               (SELECT count(DISTINCT p_name) FROM part WHERE p_type = 'SMALL' AND 'task-' || p_partkey = p.id) AS n_targets
        FROM placed p
    ),
    up(folder, module_folder, module, n_refs, n_targets) AS (
        SELECT folder, folder, module, n_refs, n_targets FROM counted
        UNION ALL
        SELECT regexp_replace(folder, '[^/]+/$', ''), module_folder, module, n_refs, n_targets FROM up WHERE folder <> ''
    ),
    totals AS (
        SELECT folder, len(folder) - len(replace(folder, '/', '')) AS depth, count(*) AS n_tasks, count(DISTINCT (module_folder, module)) AS n_modules,
               CAST(sum(n_refs) AS BIGINT) AS n_refs, CAST(sum(n_targets) AS BIGINT) AS n_targets
        FROM up GROUP BY folder
    ),
    inside AS (
        SELECT DISTINCT regexp_replace(folder, '[^/]+/$', '') AS folder, regexp_extract(folder, '[^/]+/$') AS item FROM totals WHERE folder <> ''
        UNION SELECT folder, module FROM placed
    )
    SELECT folder, depth, CAST(0 AS BIGINT) AS page, n_tasks, n_modules, n_refs, n_targets, CAST(to_json(list(item ORDER BY item)) AS VARCHAR) AS items
    FROM totals JOIN inside USING (folder) GROUP BY ALL
    """,
)
def manifest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = inputs.parts(spark, sf_dir)
    brand = F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_"))
    path = F.concat(F.lit("parts/"), F.lower("p_type"), F.lit("/s"), F.col("p_size"), F.lit("/"), brand, F.lit(".py"))
    tasks = parts.select(inputs.task_name("p_partkey").alias("id"), path.alias("path"))
    loc = F.concat(F.lit("out/"), F.col("p_name"), F.lit(".csv"))
    targets = parts.filter("p_type = 'SMALL'").select(inputs.task_name("p_partkey").alias("task_id"), loc.alias("loc"))
    return build.manifest_tree(tasks, inputs.task_edges(spark, sf_dir), targets)


@registered(
    "task_module_counts",
    f"WITH {inputs.TASKS_SQL} SELECT count(id) AS n_tasks, count(DISTINCT path) AS n_modules FROM tasks",
)
def task_module_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.task_module_counts(inputs.tasks(spark, sf_dir))
