"""Servers, clusters and their cross references; backup chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import lineage

# --- Fixed values: keys every entry must have. ---------------------------------------
SERVER_KEYS = ("active", "version", "readfor", "writefor")
CLUSTER_KEYS = ("active", "schemas", "primary", "failover", "servers")
# --------------------------------------------------------------------------------------


def missing_references(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, rule: str) -> DataFrame:
    """Children naming an unknown parent, one violation row each."""
    known = parents.select(F.col(parent_key).alias(child_key))
    gone = children.filter(F.col(child_key).isNotNull()).join(known, child_key, "left_anti")
    return gone.select(F.lit(rule).alias("rule"), *[c for c in children.columns])


def referential_violations(servers: DataFrame, clusters: DataFrame) -> DataFrame:
    """All broken rules between servers and clusters: (rule, server, cluster).

    ``servers``: server, active, version, readfor, writefor arrays. ``clusters``:
    cluster, active, schemas, primary, failover, servers array.
    """
    def missing(df: DataFrame, keys, server: Column, cluster: Column) -> DataFrame:
        absent = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in keys]))
        return df.select(
            F.explode(absent).alias("_key"), server.alias("server"), cluster.alias("cluster")
        ).select(F.concat(F.lit("MissingKey:"), F.col("_key")).alias("rule"), "server", "cluster")

    none = F.lit(None).cast("string")
    # Both primary and failover NULL is a read-only cluster.
    required = [k for k in CLUSTER_KEYS if k not in ("primary", "failover")]
    absent = missing(servers, SERVER_KEYS, F.col("server"), none).unionByName(missing(clusters, required, none, F.col("cluster")))
    both = F.array_distinct(F.array_compact(F.concat(F.coalesce("writefor", F.array()), F.coalesce("readfor", F.array()))))
    claims = servers.select("server", F.explode(both).alias("cluster"))
    unknown = claims.join(clusters.select("cluster"), "cluster", "left_anti").select(
        F.lit("UnknownCluster").alias("rule"), "server", "cluster")
    member = clusters.select("cluster", F.explode("servers").alias("server"))
    known = claims.join(clusters.select("cluster"), "cluster", "left_semi")
    mismatch = known.join(member, ["server", "cluster"], "left_anti").select(F.lit("ClusterMismatch").alias("rule"), "server", "cluster")

    def role(column: str, list_col: str, rule: str) -> DataFrame:
        wanted = clusters.filter(F.col(column).isNotNull()).select("cluster", F.col(column).alias("server"))
        has = servers.select("server", F.explode(list_col).alias("cluster"))
        return wanted.join(has, ["server", "cluster"], "left_anti").select(F.lit(rule).alias("rule"), "server", "cluster")

    parts = [absent, unknown, mismatch, role("primary", "writefor", "PrimaryMismatch"), role("failover", "readfor", "FailoverMismatch")]
    return reduce(lambda a, b: a.unionByName(b), parts)


def hosts_for(servers: DataFrame, role: str, cluster: str | None = None) -> DataFrame:
    """Active servers reading (``readfor``) or writing (``writefor``) for each cluster, or one."""
    active = servers.filter(F.lower(F.col("active").cast("string")).isin("true", "yes", "y", "1", "on"))
    out = active.select(F.explode(role).alias("cluster"), "server")
    return out if cluster is None else out.filter(F.col("cluster") == cluster)


def backup_chain(backups: DataFrame, key: str = "backup_directory", last: str = "last_backup", level: str = "backup_level",
                 group: list[str] = ()) -> DataFrame:
    """The full backup each backup rests on, by following ``last`` until level 0.

    Every round doubles the distance (pointer jumping), so the number of joins is
    the logarithm of the longest chain. Only rows still under way go into the next
    round and are written again. No chain is longer than the number of rows: who is
    under way after so many steps is in a circle. A chain without a full backup (or
    one in a circle) has ``complete`` false and a NULL ``full_backup``.
    """
    g = list(group)
    full = F.col(level) == 0
    cur = backups.select(
        *g, F.col(key).alias("backup"), F.when(full, F.col(key)).otherwise(F.col(last)).alias("_to"),
        F.when(full, 0).otherwise(1).alias("steps"), F.when(full, True).when(F.col(last).isNull(), False).alias("complete"),
    )
    cur = lineage.written(cur, "backup-chain")
    ended, left, reached = [cur.filter("complete is not null")], cur.filter("complete is null"), 1
    going = left.count()
    most = backups.count() if going else 0
    ahead = cur.select(*g, F.col("backup").alias("_to"), F.col("_to").alias("_far"), F.col("steps").alias("_more"), F.col("complete").alias("_done"), F.lit(True).alias("_known"))
    while going and reached <= most:
        moved = left.join(ahead, [*g, "_to"], "left").select(
            *g, "backup", F.col("_far").alias("_to"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"),
            F.when(F.col("_known").isNull(), False).otherwise(F.col("_done")).alias("complete"),
        )
        moved = lineage.written(moved, "backup-chain")
        ended.append(moved.filter("complete is not null"))
        left = moved.filter("complete is null")
        # Rows that ended stay where others may meet them.
        done = reduce(lambda a, b: a.unionByName(b), ended)
        ahead = done.unionByName(left).select(*g, F.col("backup").alias("_to"), F.col("_to").alias("_far"), F.col("steps").alias("_more"), F.col("complete").alias("_done"), F.lit(True).alias("_known"))
        going, reached = left.count(), reached * 2
    cur = reduce(lambda a, b: a.unionByName(b), [*ended, left])
    ok = F.coalesce("complete", F.lit(False))
    return cur.select(*g, "backup", F.when(ok, F.col("_to")).alias("full_backup"), F.when(ok, F.col("steps")).alias("steps"), ok.alias("complete"))
