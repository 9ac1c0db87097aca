"""Collections as tables of Spark's catalog: a database for each tenant, a table for each collection."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class CatalogError(ValueError):
    """A collection or tenant is missing, exists already, or has a name or schema that can't be used."""


_NAME = re.compile(r"[A-Za-z0-9_]+")


class Catalog:
    """Creates, finds and drops collections; `prefix` keeps the tenants' databases apart from others."""

    def __init__(self, spark: SparkSession, prefix: str = "tenant_"):
        self.spark, self.prefix = spark, prefix

    def _database(self, tenant: str) -> str:
        if not _NAME.fullmatch(tenant):
            raise CatalogError(f"bad tenant name {tenant!r}")
        return self.prefix + tenant.lower()

    def _held(self, tenant: str, name: str) -> str:
        """The table's full name; the collection must exist."""
        database = self._database(tenant)
        if not self.spark.catalog.databaseExists(database):
            raise CatalogError(f"no tenant {tenant!r}")
        if not _NAME.fullmatch(name) or not self.spark.catalog.tableExists(f"{database}.{name}"):
            raise CatalogError(f"no collection {name!r}")
        return f"{database}.{name}"

    def create(self, tenant: str, name: str, schema: StructType) -> DataFrame:
        """An empty collection; column names must differ, in any case, and not be blank."""
        database, names = self._database(tenant), [f.name.strip().lower() for f in schema.fields]
        if not _NAME.fullmatch(name) or not names or "" in names or len(set(names)) < len(names):
            raise CatalogError(f"bad name or schema of collection {name!r}")
        self.spark.sql(f"create database if not exists `{database}`")
        if self.spark.catalog.tableExists(f"{database}.{name}"):
            raise CatalogError(f"collection {name!r} exists")
        return self.spark.catalog.createTable(f"{database}.{name}", schema=schema, source="parquet")

    def drop(self, tenant: str, name: str) -> None:
        self.spark.sql(f"drop table {self._held(tenant, name)}")

    def table(self, tenant: str, name: str) -> DataFrame:
        return self.spark.table(self._held(tenant, name))

    def insert(self, tenant: str, name: str, rows: DataFrame, key: str = "id") -> None:
        """Adds the rows whose key isn't held yet, one of each key."""
        held = self._held(tenant, name)
        table = self.spark.table(held)
        rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns).write.insertInto(held)

    def names(self, tenant: str) -> list[str]:
        """A tenant's collections; an unknown tenant has none."""
        database = self._database(tenant)
        return sorted(t.name for t in self.spark.catalog.listTables(database) if not t.isTemporary) if self.spark.catalog.databaseExists(database) else []

    def tenants(self) -> list[str]:
        return sorted(d.name.removeprefix(self.prefix) for d in self.spark.catalog.listDatabases() if d.name.startswith(self.prefix))
