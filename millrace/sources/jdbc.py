"""SQL warehouses through Spark's JDBC reader: option builders and partitioned scans.

A connection is a plain dict of reader options, so anything Spark's JDBC source accepts can be
added to it. Driver jars are the user's to provide (``spark.jars``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession

# Driver classes and default ports of the supported warehouses.
DRIVERS = {
    "bigquery": "com.simba.googlebigquery.jdbc.Driver",
    "postgres": "org.postgresql.Driver",
    "presto": "com.facebook.presto.jdbc.PrestoDriver",
    "redshift": "com.amazon.redshift.jdbc.Driver",
    "snowflake": "net.snowflake.client.jdbc.SnowflakeDriver",
    "trino": "io.trino.jdbc.TrinoDriver",
}


def postgres(host: str, port: int, database: str, user: str, password: str) -> dict[str, str]:
    return _options("postgres", f"jdbc:postgresql://{host}:{port}/{database}", user, password)


def redshift(host: str, port: int, database: str, user: str, password: str) -> dict[str, str]:
    return _options("redshift", f"jdbc:redshift://{host}:{port}/{database}", user, password)


def snowflake(
    account: str, user: str, password: str, role: str, warehouse: str, database: str, schema: str
) -> dict[str, str]:
    session = urlencode({"warehouse": warehouse, "role": role, "db": database, "schema": schema})
    url = f"jdbc:snowflake://{account}.snowflakecomputing.com/?{session}"
    return _options("snowflake", url, user, password)


def bigquery(project: str, service_account: str, key_file: str) -> dict[str, str]:
    url = (
        "jdbc:bigquery://https://www.googleapis.com/bigquery/v2:443;"
        f"ProjectId={project};OAuthType=0;OAuthServiceAcctEmail={service_account};OAuthPvtKeyPath={key_file}"
    )
    return {"url": url, "driver": DRIVERS["bigquery"]}


def trino(
    host: str, port: int, user: str, password: str,
    catalog: str | None = None, schema: str | None = None, http_scheme: str = "https",
) -> dict[str, str]:
    url = _namespaced(f"jdbc:trino://{host}:{port}", catalog, schema, http_scheme)
    return _options("trino", url, user, password)


def presto(
    host: str, port: int, user: str, password: str,
    catalog: str | None = None, schema: str | None = None, http_scheme: str = "https",
) -> dict[str, str]:
    url = _namespaced(f"jdbc:presto://{host}:{port}", catalog, schema, http_scheme)
    return _options("presto", url, user, password)


def _options(kind: str, url: str, user: str, password: str) -> dict[str, str]:
    return {"url": url, "driver": DRIVERS[kind], "user": user, "password": password}


def _namespaced(url: str, catalog: str | None, schema: str | None, http_scheme: str) -> str:
    if schema is not None and catalog is None:
        raise ValueError("a schema needs a catalog")
    if http_scheme not in ("http", "https"):
        raise ValueError(f"http_scheme must be http or https, not {http_scheme!r}")
    path = "".join(f"/{part}" for part in (catalog, schema) if part is not None)
    return f"{url}{path}?{urlencode({'SSL': str(http_scheme == 'https').lower()})}"


class Connections:
    """Connections by id; SQL text sent to one of them comes back as a lazy DataFrame."""

    def __init__(self, spark: SparkSession, connections: Mapping[str, Mapping[str, str]] | None = None):
        self.spark = spark
        self._connections = dict(connections or {})

    def add(self, connection_id: str, options: Mapping[str, str]) -> None:
        self._connections[connection_id] = dict(options)

    def options(self, connection_id: str) -> dict[str, str]:
        try:
            return dict(self._connections[connection_id])
        except KeyError:
            raise ValueError(f"no connection with id {connection_id!r}") from None

    def execute_sql(self, connection_id: str, sql: str, **extra: str) -> DataFrame:
        """The warehouse runs ``sql``; Spark sees its result as one partition."""
        return query(self.spark, self.options(connection_id) | extra, sql)

    def scan(self, connection_id: str, table: str, predicates: Sequence[str], **extra: str) -> DataFrame:
        """A parallel scan, one partition per predicate."""
        return scan(self.spark, self.options(connection_id) | extra, table, predicates)


def query(spark: SparkSession, options: Mapping[str, str], sql: str) -> DataFrame:
    return spark.read.format("jdbc").options(**options).option("query", sql.rstrip().rstrip(";")).load()


def scan(spark: SparkSession, options: Mapping[str, str], table: str, predicates: Sequence[str]) -> DataFrame:
    rest = dict(options)
    return spark.read.jdbc(rest.pop("url"), table, predicates=list(predicates), properties=rest)


def range_predicates(column: str, bounds: Sequence[int]) -> list[str]:
    """Predicates that split a table at ascending ``bounds``; each row meets exactly one of them.

    Rows below the first bound, above the last one, and with a NULL have their place, so the bounds
    decide balance only, never the result. Quantiles of the column (see :func:`quantile_bounds`)
    balance a skewed column, which equal strides would not.
    """
    cuts = sorted(set(bounds))
    if not cuts:
        return ["1 = 1"]
    middle = [f"{column} >= {low} AND {column} < {high}" for low, high in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *middle, f"{column} >= {cuts[-1]}"]


def stride_bounds(lower: int, upper: int, partitions: int) -> list[int]:
    """Equal strides between two known bounds, for an evenly spread column."""
    if partitions < 1 or upper < lower:
        raise ValueError("need partitions >= 1 and lower <= upper")
    return sorted({lower + (upper - lower) * i // partitions for i in range(1, partitions)})


def quantile_bounds(sample: DataFrame, column: str, partitions: int) -> list[int]:
    """Quantiles of a column Spark can already read, such as an earlier load of the same table."""
    probabilities = [i / partitions for i in range(1, partitions)]
    return sorted({int(q) for q in sample.approxQuantile(column, probabilities, 1 / (10 * partitions))})
