"""The four stored tables as one bundle, and catalog helpers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from haulscope import schemas


@dataclass(frozen=True)
class FreightTables:
    """Physical tables; column names as in ``haulscope.schemas``."""

    shipments: DataFrame
    charges: DataFrame
    carriers: DataFrame
    facilities: DataFrame

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> FreightTables:
        """Folder layout ``<folder>/<table>``, one Parquet data set per table."""
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
        return cls(
            shipments=read("shipments", schemas.SHIPMENTS),
            charges=read("accessorial_charges", schemas.CHARGES),
            carriers=read("carriers", schemas.CARRIERS),
            facilities=read("facilities", schemas.FACILITIES),
        )

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str | None = None) -> FreightTables:
        """Tables named in the session catalog (temporary views included)."""
        prefix = f"{database}." if database else ""
        return cls(
            shipments=spark.table(f"{prefix}shipments"),
            charges=spark.table(f"{prefix}accessorial_charges"),
            carriers=spark.table(f"{prefix}carriers"),
            facilities=spark.table(f"{prefix}facilities"),
        )


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of the stored tables (no views), sorted; empty if the database is unknown."""
    if database and not spark.catalog.databaseExists(database):
        return []
    return sorted(
        table.name
        for table in spark.catalog.listTables(database)
        if table.tableType in ("MANAGED", "EXTERNAL")
    )


def preview(spark: SparkSession, name: str, rows: int = 500) -> DataFrame:
    """Any ``rows`` rows of a table. The name is resolved as an identifier, never pasted into SQL."""
    return spark.table(name).limit(rows)


def or_else(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """``primary`` unless it has no rows (runs a one-row job)."""
    return fallback if primary.isEmpty() else primary
