"""Relational source and sink through Spark's JDBC data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Connect timeout in seconds and rows per insert batch.
CONNECT_TIMEOUT = 30
INSERT_BATCH = 1000


def sql_server_url(server: str, database: str, port: int = 1433) -> str:
    return (
        f"jdbc:sqlserver://{server}:{port};databaseName={database};"
        f"encrypt=true;trustServerCertificate=false;loginTimeout={CONNECT_TIMEOUT}"
    )


def read_options(
    url: str,
    table: str,
    *,
    split_on: str | None = None,
    lower: str | None = None,
    upper: str | None = None,
    splits: int = 1,
    fetch_rows: int = 10_000,
    **login: str,
) -> dict[str, str]:
    """Options of a parallel read: ``splits`` range queries on ``split_on``."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_rows), **login}
    if split_on is not None:
        if lower is None or upper is None:
            raise ValueError("a split read needs lower and upper bounds")
        options |= {
            "partitionColumn": split_on,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(splits),
        }
    return options


def read_table(spark: SparkSession, url: str, table: str, **options: object) -> DataFrame:
    return spark.read.format("jdbc").options(**read_options(url, table, **options)).load()


def append_table(df: DataFrame, url: str, table: str, **login: str) -> None:
    """Bulk append in batches; each partition writes over its own connection."""
    (
        df.write.format("jdbc").mode("append")
        .options(url=url, dbtable=table, batchsize=str(INSERT_BATCH), **login)
        .save()
    )
