"""Inputs in the shape of the operators, derived from the driver's tables.

Each is a list of SQL expressions that both engines run, so a query and its
oracle start from the same rows: processes from ``events``, tracked versions
from ``orders``, catalogue rows from ``part``/``nation``, checksums from
``lineitem``, and so on. They read every row of their table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetlens.plans.registry import Tables

PROCESSES = {
    "event_id": "event_id",
    "server": "'s' || CAST(user_id % 4 AS STRING)",
    "ts": "ts",
    "id": "user_id",
    "user": "CASE WHEN event_id % 17 = 0 THEN 'system user' ELSE 'u' || CAST(user_id % 7 AS STRING) END",
    "host": "'h' || CAST(user_id % 5 AS STRING) || ':' || CAST(3000 + event_id % 100 AS STRING)",
    "db": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'db' || CAST(event_id % 3 AS STRING) END",
    "command": "CASE event_id % 5 WHEN 0 THEN 'Sleep' WHEN 1 THEN 'Connect' WHEN 2 THEN 'Binlog Dump' ELSE 'Query' END",
    "time": "CAST(floor(value) AS BIGINT)",
    "state": "CASE event_id % 4 WHEN 0 THEN 'Locked' WHEN 1 THEN 'Sending data' WHEN 2 THEN '' ELSE NULL END",
    "info": "CASE WHEN event_id % 5 < 3 THEN NULL ELSE 'SELECT ' || event_type END",
}

VERSIONS = {
    "id": "o_orderkey",
    "server": "'s' || CAST(o_custkey % 5 AS STRING)",
    "database_name": "CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE 'db' || CAST(o_custkey % 20 AS STRING) END",
    "table_name": "CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE 't' || CAST(o_custkey AS STRING) END",
    "data_length": "CASE WHEN o_orderkey % 50 = 7 OR o_orderkey % 10 = 3 THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS BIGINT) % 4 * 16384 END",
    "index_length": "CASE WHEN o_orderkey % 50 = 7 OR o_orderkey % 10 = 3 THEN NULL ELSE o_orderkey % 2 * 1024 END",
    "data_free": "CASE WHEN o_orderkey % 50 = 7 OR o_orderkey % 10 = 3 THEN NULL ELSE 0 END",
    "create_syntax": "CASE WHEN o_orderkey % 50 = 7 OR o_orderkey % 10 = 3 THEN NULL ELSE 'CREATE ' || o_orderstatus END",
    "run_time": "o_orderdate",
}

CATALOG = {
    "id": "p_partkey",
    "server": "'s' || CAST(p_size % 5 AS STRING)",
    "database_name": "CASE p_partkey % 9 WHEN 0 THEN 'mysql' ELSE p_brand END",
    "table_name": "p_type || CAST(p_partkey AS STRING)",
    "engine": "CASE WHEN p_partkey % 3 = 0 THEN 'MyISAM' ELSE 'InnoDB' END",
    "data_length": "CAST(floor(p_retailprice * 10000) AS BIGINT)",
    "index_length": "p_size * 10000",
    "data_free": "p_partkey % 7 * 1000000",
}

STATUS_VALUES = {
    "server": "'s' || CAST(user_id % 4 AS STRING)",
    "ts": "ts",
    "name": "event_type",
    "value": "value",
    "event_id": "event_id",
}


def sql_of(columns: dict[str, str], table: str, where: str = "") -> str:
    """The derived rows as a sub-select for an oracle."""
    listed = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return f"(SELECT {listed} FROM {table}{' WHERE ' + where if where else ''})"


def rows_of(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    return table.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def processes(t: Tables) -> DataFrame:
    return rows_of(t.events, PROCESSES)


def versions(t: Tables) -> DataFrame:
    return rows_of(t.orders, VERSIONS)


def catalog(t: Tables) -> DataFrame:
    return rows_of(t.part, CATALOG)


def status_values(t: Tables) -> DataFrame:
    return rows_of(t.events, STATUS_VALUES)


PROC_SQL = sql_of(PROCESSES, "events")
VERSION_SQL = sql_of(VERSIONS, "orders")
CATALOG_SQL = sql_of(CATALOG, "part")
STATUS_SQL = sql_of(STATUS_VALUES, "events")
