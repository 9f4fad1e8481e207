"""The inventory model (connectors, assets, components, usages, findings, relationships) as views over flat tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Inventory:
    """Views of one folder of tables. Every view is lazy, reads only the columns that a query needs, and holds no state."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def connectors(self) -> DataFrame:
        region = F.broadcast(self.table("region"))  # a fixed code list of five rows
        joined = self.table("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("connector_type"), F.when(F.col("n_nationkey") % 4 == 0, "disabled").otherwise("enabled").alias("status"))

    @cached_property
    def assets(self) -> DataFrame:
        balance = F.col("c_acctbal")
        status = F.when(balance < 0, "inactive").otherwise("active")
        scan = F.when(F.col("c_custkey") % 7 == 0, "discovered").when(F.col("c_custkey") % 11 == 0, "failed").otherwise("scanned")
        return self.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("asset_type"), F.col("c_nationkey").cast("long").alias("connector_id"), status.alias("status"), scan.alias("scan_status"), balance.alias("score"))

    @cached_property
    def components(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("version"), F.col("p_type").alias("ecosystem"), F.col("p_brand").alias("package_manager"))

    @cached_property
    def usages(self) -> DataFrame:
        source = F.when(F.col("l_returnflag") == "A", "repo_scan").when((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 4 != 0), "repo_sbom").otherwise("image_scan")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        joined = self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select(F.col("o_custkey").alias("asset_id"), F.col("l_partkey").alias("component_id"), source.alias("source"), F.col("l_linenumber").alias("evidence_path"), F.col("l_shipdate").alias("last_seen_at"), F.col("l_suppkey").alias("layer"), F.col("l_orderkey").alias("batch"))

    @cached_property
    def findings(self) -> DataFrame:
        first = self.table("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("component_id"))
        priority = F.col("o_orderpriority")
        severity = F.when(priority == "1-URGENT", "critical").when(priority == "2-HIGH", "high").when(priority == "3-MEDIUM", "medium").when(priority == "5-LOW", "low").otherwise("unknown")
        status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "open").otherwise("triaged")
        key = F.col("o_orderkey")
        kind = F.when(key % 3 == 0, "cve").when(key % 3 == 1, "malware").otherwise("shadow_deployment")
        joined = self.table("orders").join(first, key == F.col("l_orderkey"), "left")
        return joined.select(key.alias("id"), F.col("o_custkey").alias("affected_asset_id"), "component_id", severity.alias("severity"), status.alias("status"), kind.alias("finding_type"), F.col("o_orderdate").alias("last_seen_at"))

    @cached_property
    def relationships(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        kind = F.when(F.col("l_linestatus") == "O", "runs_in").otherwise("belongs_to")
        joined = self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select(F.col("o_custkey").alias("source_asset_id"), kind.alias("relationship_type"), F.col("l_suppkey").alias("target_asset_id")).distinct()

    @cached_property
    def specs(self) -> DataFrame:
        """Advisories of malicious packages: a name, an ecosystem (may be empty), versions or all of them."""
        key = F.col("p_partkey")
        versions = F.array(F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string"))
        return self.table("part").select(key.alias("advisory_id"), F.col("p_name").alias("package"), F.when(key % 100 == 0, "").otherwise(F.col("p_type")).alias("ecosystem"), versions.alias("versions"), (key % 250 == 0).alias("all_versions"))

    @cached_property
    def heartbeats(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("runner_id"), F.col("event_type").alias("job_type"), F.col("ts").alias("seen_at"), "value", "props")


#: The same views as SQL, for checks by another engine.
VIEWS_SQL = """
v_connectors AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, r_name AS connector_type, CASE WHEN n_nationkey % 4 = 0 THEN 'disabled' ELSE 'enabled' END AS status FROM nation JOIN region ON n_regionkey = r_regionkey),
v_assets AS (SELECT c_custkey AS id, c_name AS display_name, c_mktsegment AS asset_type, CAST(c_nationkey AS BIGINT) AS connector_id, CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status, CASE WHEN c_custkey % 7 = 0 THEN 'discovered' WHEN c_custkey % 11 = 0 THEN 'failed' ELSE 'scanned' END AS scan_status, c_acctbal AS score FROM customer),
v_components AS (SELECT p_partkey AS id, p_name AS name, CAST(p_size AS VARCHAR) AS version, p_type AS ecosystem, p_brand AS package_manager FROM part),
v_usages AS (SELECT o_custkey AS asset_id, l_partkey AS component_id, CASE WHEN l_returnflag = 'A' THEN 'repo_scan' WHEN l_returnflag = 'R' AND l_partkey % 4 <> 0 THEN 'repo_sbom' ELSE 'image_scan' END AS source, l_linenumber AS evidence_path, l_shipdate AS last_seen_at, l_suppkey AS layer, l_orderkey AS batch FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v_findings AS (SELECT o_orderkey AS id, o_custkey AS affected_asset_id, component_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'unknown' END AS severity, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' ELSE 'triaged' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'cve' WHEN 1 THEN 'malware' ELSE 'shadow_deployment' END AS finding_type, o_orderdate AS last_seen_at FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS component_id FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey),
v_relationships AS (SELECT DISTINCT o_custkey AS source_asset_id, CASE WHEN l_linestatus = 'O' THEN 'runs_in' ELSE 'belongs_to' END AS relationship_type, l_suppkey AS target_asset_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v_specs AS (SELECT p_partkey AS advisory_id, p_name AS package, CASE WHEN p_partkey % 100 = 0 THEN '' ELSE p_type END AS ecosystem, [CAST(p_size AS VARCHAR), CAST(p_size + 1 AS VARCHAR)] AS versions, p_partkey % 250 = 0 AS all_versions FROM part),
v_heartbeats AS (SELECT event_id AS id, user_id AS runner_id, event_type AS job_type, ts AS seen_at, value, props FROM events)
"""
