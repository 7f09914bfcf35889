"""Tables and their schemas; seeds that are inserted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import CALL_SCHEMA

#: Schemas of the stores' tables.
SCHEMAS = {
    "method_call": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CALL_SCHEMA),
    "applications_home_subcluster": "application_id string, home_sub_cluster string, create_time timestamp, application_context binary",
    "membership": "sub_cluster_id string, am_rm_service_address string, client_rm_service_address string, rm_admin_service_address string, rm_web_service_address string, last_heart_beat timestamp, state string, last_start_time bigint, capability string",
    "policies": "queue string, policy_type string, params binary",
    "tokens": "sequence_num bigint, token_ident binary, token_info binary, modified_time timestamp",
    "delegation_keys": "key_id bigint, delegation_key binary, modified_time timestamp",
    "last_sequence_num": "sequence_num bigint",
    "last_delegation_key_id": "key_id bigint",
}


def create(spark: SparkSession, table: str, replace: bool = True) -> None:
    if replace:
        drop(spark, table)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({SCHEMAS[table]}) USING parquet")


def drop(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def seed(spark: SparkSession, table: str, value: int = 0) -> bool:
    """One row with the value, if the table is empty."""
    if not spark.table(table).isEmpty():
        return False
    spark.sql(f"INSERT INTO {table} VALUES ({int(value)})")
    return True


def insert_missing(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows whose key isn't there."""
    return new.join(existing.select(F.col(key)), key, "left_anti")
