"""Analytic queries of the inventory: lists, roll-ups, dashboards, graph and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.scalars import contains_any, severity_order, severity_rank
from lodestack.operators import alerts as alerts_of
from lodestack.operators.boms import advisory_hits
from lodestack.operators.relational import counted_apart, counts_by, keep_first, merge_last, page, with_count
from lodestack.plans.registry import query

ORDER_SQL = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END"
RANK_SQL = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"


def unresolved(inv) -> DataFrame:
    return inv.findings.where("status <> 'resolved'")


# Dashboard


@query("agg_assets_by_type", "SELECT asset_type, count(*) AS n FROM v_assets GROUP BY asset_type")
def assets_by_type(inv):
    return inv.assets.groupBy("asset_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg_findings_by_severity", "SELECT severity, count(*) AS n FROM v_findings WHERE status <> 'resolved' GROUP BY severity")
def findings_by_severity(inv):
    return unresolved(inv).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("agg_totals", "SELECT (SELECT count(*) FROM v_components) AS components, (SELECT count(*) FROM v_connectors) AS connectors, (SELECT count(*) FROM v_assets) AS assets")
def totals(inv):
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n)).withColumn("_k", F.lit(1))
    return one(inv.components, "components").join(one(inv.connectors, "connectors"), "_k").join(one(inv.assets, "assets"), "_k").drop("_k")


@query("agg_scan_status", "SELECT count(*) AS total, count(*) FILTER (scan_status = 'scanned') AS scanned, count(*) FILTER (scan_status IN ('discovered', 'scanning')) AS pending, count(*) FILTER (scan_status = 'failed') AS failed FROM v_assets")
def scan_status(inv):
    s = F.col("scan_status")
    return inv.assets.agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "scanned").alias("scanned"), F.count_if(s.isin("discovered", "scanning")).alias("pending"), F.count_if(s == "failed").alias("failed"))


STATUS_SQL = f"""status_rows AS (SELECT component_id, count(*) AS n, max({RANK_SQL}) AS worst, max(last_seen_at) AS checked_at FROM v_findings WHERE finding_type = 'cve' AND component_id IS NOT NULL GROUP BY component_id),
v_status AS (SELECT c.id AS component_id, CASE WHEN s.n > 0 THEN 'vulnerable' WHEN c.id % 13 = 0 THEN 'failed' ELSE 'clean' END AS status, coalesce(s.n, 0) AS vulnerability_count, coalesce(s.worst, 0) AS worst, s.checked_at FROM v_components c LEFT JOIN status_rows s ON s.component_id = c.id)"""


def vulnerability_status(inv) -> DataFrame:
    """One row per component: vulnerable, clean or failed, with its number of advisories and the worst rank."""
    cves = inv.findings.where("finding_type = 'cve' and component_id is not null")
    found = cves.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.max(severity_rank(F.col("severity"))).alias("worst"), F.max("last_seen_at").alias("checked_at"))
    joined = inv.components.select(F.col("id").alias("component_id")).join(found, "component_id", "left")
    status = F.when(F.col("n") > 0, "vulnerable").when(F.col("component_id") % 13 == 0, "failed").otherwise("clean")
    return joined.select("component_id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("vulnerability_count"), F.coalesce("worst", F.lit(0)).alias("worst"), "checked_at")


@query("agg_vuln_status", f"WITH {STATUS_SQL} SELECT count(*) AS checked_packages, CAST(sum(CASE WHEN status = 'vulnerable' THEN 1 ELSE 0 END) AS BIGINT) AS vulnerable_packages, CAST(sum(CASE WHEN status = 'clean' THEN 1 ELSE 0 END) AS BIGINT) AS clean_packages, CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed_packages, max(checked_at) AS last_checked_at FROM v_status")
def vulnerability_summary(inv):
    s = F.col("status")
    total = lambda x: F.sum(F.when(s == x, 1).otherwise(0))
    return vulnerability_status(inv).agg(F.count(F.lit(1)).alias("checked_packages"), total("vulnerable").alias("vulnerable_packages"), total("clean").alias("clean_packages"), total("failed").alias("failed_packages"), F.max("checked_at").alias("last_checked_at"))


@query("agg_vuln_rollup", f"SELECT component_id, count(*) AS vulnerability_count, arg_max(severity, {RANK_SQL}) AS max_severity FROM v_findings WHERE finding_type = 'cve' AND component_id IS NOT NULL GROUP BY component_id")
def vulnerability_rollup(inv):
    cves = inv.findings.where("finding_type = 'cve' and component_id is not null")
    return cves.groupBy("component_id").agg(F.count(F.lit(1)).alias("vulnerability_count"), F.max_by("severity", severity_rank(F.col("severity"))).alias("max_severity"))


@query("agg_top_components", "SELECT c.id, c.name, c.version, c.ecosystem, count(u.asset_id) AS asset_count FROM v_components c JOIN v_usages u ON u.component_id = c.id GROUP BY ALL ORDER BY asset_count DESC, c.name ASC, c.id LIMIT 8")
def top_components(inv):
    used = counts_by(inv.usages, "component_id", "asset_count")
    joined = inv.components.join(used, F.col("id") == F.col("component_id"))
    return joined.select("id", "name", "version", "ecosystem", "asset_count").orderBy(F.desc("asset_count"), "name", "id").limit(8)


def finding_rows(inv, found: DataFrame) -> DataFrame:
    """Findings with the names of their asset and component; either may be missing."""
    assets = inv.assets.select(F.col("id").alias("_a"), F.col("display_name").alias("asset_name"), "asset_type", "connector_id")
    parts = inv.components.select(F.col("id").alias("_c"), F.col("name").alias("component_name"), F.col("version").alias("component_version"), "ecosystem")
    return found.join(assets, F.col("affected_asset_id") == F.col("_a"), "left").join(parts, F.col("component_id") == F.col("_c"), "left").drop("_a", "_c")


FINDING_SQL = "SELECT f.*, a.display_name AS asset_name, a.asset_type, a.connector_id, c.name AS component_name, c.version AS component_version, c.ecosystem FROM v_findings f LEFT JOIN v_assets a ON a.id = f.affected_asset_id LEFT JOIN v_components c ON c.id = f.component_id"


@query("agg_latest_findings", f"SELECT id, severity, status, asset_name, component_name FROM ({FINDING_SQL}) ORDER BY {ORDER_SQL}, last_seen_at DESC, id LIMIT 8")
def latest_findings(inv):
    first = inv.findings.orderBy(severity_order(F.col("severity")), F.desc("last_seen_at"), "id").limit(8)
    return finding_rows(inv, first).select("id", "severity", "status", "asset_name", "component_name")


SCANNED, DECLARED = 1, 2


@query("agg_ghost", """WITH scanned AS (SELECT DISTINCT component_id FROM v_usages WHERE source = 'repo_scan'), declared AS (SELECT DISTINCT component_id FROM v_usages WHERE source = 'repo_sbom'),
numbers AS (SELECT (SELECT count(*) FROM (FROM scanned UNION FROM declared)) AS n, (SELECT count(*) FROM (FROM scanned EXCEPT FROM declared)) AS g)
SELECT n AS repo_packages, g AS ghost_packages, if(n = 0, 0.0, round(100.0 * g / n, 1)) AS percent FROM numbers""")
def ghost(inv):
    """Packages seen in sources that no declared bill of materials names: of the bits of its sources, a component has the first alone."""
    bit = F.when(F.col("source") == "repo_scan", SCANNED).when(F.col("source") == "repo_sbom", DECLARED)
    bits = inv.usages.select("component_id", bit.alias("bit")).where("bit is not null").groupBy("component_id").agg(F.bit_or("bit").alias("bits"))
    out = bits.agg(F.count(F.lit(1)).alias("repo_packages"), F.count_if(F.col("bits") == SCANNED).alias("ghost_packages"))
    share = F.round(100.0 * F.try_divide("ghost_packages", "repo_packages"), 1)
    return out.withColumn("percent", F.coalesce(share, F.lit(0.0)).cast("double"))


@query("set_ghost_diff", "SELECT component_id FROM v_usages WHERE source = 'repo_scan' EXCEPT SELECT component_id FROM v_usages WHERE source = 'repo_sbom'")
def ghost_difference(inv):
    by = lambda s: inv.usages.where(F.col("source") == s).select("component_id")
    return by("repo_scan").subtract(by("repo_sbom"))


@query("agg_share_by_type", "SELECT asset_type, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS share FROM v_assets GROUP BY asset_type")
def share_by_type(inv):
    by = inv.assets.groupBy("asset_type").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


# Lists


@query("q_list_assets", f"""SELECT a.id, a.display_name, a.asset_type, a.status, k.name AS connector_name, coalesce(u.n, 0) AS component_count, coalesce(f.n, 0) AS finding_count
FROM v_assets a LEFT JOIN v_connectors k ON k.id = a.connector_id LEFT JOIN (SELECT asset_id, count(*) AS n FROM v_usages GROUP BY asset_id) u ON u.asset_id = a.id
LEFT JOIN (SELECT affected_asset_id, count(*) AS n FROM v_findings WHERE status <> 'resolved' GROUP BY affected_asset_id) f ON f.affected_asset_id = a.id
WHERE EXISTS (SELECT 1 FROM v_findings v WHERE v.affected_asset_id = a.id AND v.finding_type = 'cve' AND v.status <> 'resolved') AND a.display_name ILIKE '%customer%'""")
def list_assets(inv):
    """All vulnerable assets with their counts."""
    vulnerable = unresolved(inv).where("finding_type = 'cve'").select(F.col("affected_asset_id").alias("id")).distinct()
    rows = inv.assets.where(contains_any("customer", F.col("display_name"))).join(vulnerable, "id", "left_semi")
    rows = with_count(rows, "id", counts_by(inv.usages, "asset_id", "component_count"), "asset_id", "component_count")
    rows = with_count(rows, "id", counts_by(unresolved(inv), "affected_asset_id", "finding_count"), "affected_asset_id", "finding_count")
    names = inv.connectors.select(F.col("id").alias("connector_id"), F.col("name").alias("connector_name"))
    return rows.join(names, "connector_id", "left").select("id", "display_name", "asset_type", "status", "connector_name", "component_count", "finding_count")


@query("q_get_asset", "SELECT a.id, a.display_name, (SELECT count(*) FROM v_usages u WHERE u.asset_id = a.id) AS component_count, (SELECT count(*) FROM v_findings f WHERE f.affected_asset_id = a.id) AS finding_count, (SELECT count(*) FROM v_findings f WHERE f.affected_asset_id = a.id AND f.finding_type = 'cve') AS cve_count, (SELECT count(*) FROM v_findings f WHERE f.affected_asset_id = a.id AND f.status <> 'resolved') AS open_count FROM v_assets a WHERE a.id = 10")
def get_asset(inv, asset: int = 10):
    mine = inv.findings.where(F.col("affected_asset_id") == asset)
    counts = mine.agg(F.count(F.lit(1)).alias("finding_count"), F.count_if(F.col("finding_type") == "cve").alias("cve_count"), F.count_if(F.col("status") != "resolved").alias("open_count"))
    used = inv.usages.where(F.col("asset_id") == asset).agg(F.count(F.lit(1)).alias("component_count"))
    return inv.assets.where(F.col("id") == asset).crossJoin(F.broadcast(used)).crossJoin(F.broadcast(counts)).select("id", "display_name", "component_count", "finding_count", "cve_count", "open_count")


@query("q_asset_components", "SELECT u.component_id, u.source, u.evidence_path, u.layer, c.name, c.version, c.ecosystem, (SELECT count(*) FROM v_findings f WHERE f.affected_asset_id = 10 AND f.component_id = u.component_id AND f.status <> 'resolved') AS finding_count FROM v_usages u JOIN v_components c ON c.id = u.component_id WHERE u.asset_id = 10")
def asset_components(inv, asset: int = 10):
    rows = inv.usages.where(F.col("asset_id") == asset).join(inv.components, F.col("component_id") == F.col("id"))
    open_ = counts_by(unresolved(inv).where(F.col("affected_asset_id") == asset), "component_id", "finding_count")
    return with_count(rows, "component_id", open_, "component_id", "finding_count").select("component_id", "source", "evidence_path", "layer", "name", "version", "ecosystem", "finding_count")


@query("q_asset_findings", f"SELECT id, severity, finding_type, component_name, component_version, ecosystem FROM ({FINDING_SQL}) WHERE affected_asset_id = 10 ORDER BY {ORDER_SQL}, last_seen_at DESC, id LIMIT 500")
def asset_findings(inv, asset: int = 10):
    rows = finding_rows(inv, inv.findings.where(F.col("affected_asset_id") == asset))
    return rows.orderBy(severity_order(F.col("severity")), F.desc("last_seen_at"), "id").limit(500).select("id", "severity", "finding_type", "component_name", "component_version", "ecosystem")


@query("q_list_components", "SELECT c.id, c.name, c.version, c.ecosystem, coalesce(u.n, 0) AS asset_count, coalesce(f.n, 0) AS finding_count FROM v_components c LEFT JOIN (SELECT component_id, count(DISTINCT asset_id) AS n FROM v_usages GROUP BY component_id) u ON u.component_id = c.id LEFT JOIN (SELECT component_id, count(*) AS n FROM v_findings WHERE status <> 'resolved' GROUP BY component_id) f ON f.component_id = c.id ORDER BY asset_count DESC, c.name, c.id LIMIT 500")
def list_components(inv):
    rows = with_count(inv.components, "id", counts_by(inv.usages, "component_id", "asset_count", distinct="asset_id"), "component_id", "asset_count")
    rows = with_count(rows, "id", counts_by(unresolved(inv), "component_id", "finding_count"), "component_id", "finding_count")
    return rows.select("id", "name", "version", "ecosystem", "asset_count", "finding_count").orderBy(F.desc("asset_count"), "name", "id").limit(500)


@query("q_sbom_packages", """SELECT c.name, coalesce(nullif(c.ecosystem, ''), 'unknown') AS ecosystem, coalesce(nullif(c.package_manager, ''), '') AS package_manager, count(DISTINCT c.id) AS component_count, count(DISTINCT coalesce(nullif(c.version, ''), 'unknown')) AS version_count, min(c.id) AS sample, count(DISTINCT u.asset_id) AS asset_count
FROM v_components c LEFT JOIN v_usages u ON u.component_id = c.id GROUP BY lower(c.name), 1, 2, 3""")
def sbom_packages(inv, search: str = "", ecosystem: str = "") -> DataFrame:
    """The whole package roll-up, after an optional search in names and an ecosystem; pages of it are taken by `sbom_page`."""
    packages = inv.components.withColumns({"ecosystem": F.coalesce(F.expr("nullif(ecosystem, '')"), F.lit("unknown")), "package_manager": F.coalesce(F.expr("nullif(package_manager, '')"), F.lit("")), "version": F.coalesce(F.expr("nullif(version, '')"), F.lit("unknown"))})
    packages = packages.where(contains_any(search, F.col("name"))) if search else packages
    packages = packages.where(F.col("ecosystem") == ecosystem) if ecosystem else packages
    keys = ["name", "ecosystem", "package_manager"]
    used = inv.usages.select("component_id", "asset_id").distinct()
    return counted_apart(packages, used, keys, "id", {"component_count": "id", "version_count": "version"}, {"sample": F.min("id")})


@query("q_sbom_page", """SELECT c.name, c.ecosystem, count(DISTINCT c.id) AS component_count, count(DISTINCT u.asset_id) AS asset_count FROM v_components c LEFT JOIN v_usages u ON u.component_id = c.id
WHERE c.name ILIKE '%widget%' GROUP BY c.name, c.ecosystem, c.package_manager ORDER BY asset_count DESC, c.name, c.ecosystem, c.package_manager LIMIT 50 OFFSET 50""")
def sbom_page(inv, search: str = "widget", number: int = 2) -> DataFrame:
    """One page of the packages that a search finds, the most used first."""
    rows = sbom_packages(inv, search).orderBy(F.desc("asset_count"), "name", "ecosystem", "package_manager")
    return page(rows.select("name", "ecosystem", "component_count", "asset_count"), number=number)


NAME = "(SELECT min(name) FROM v_components)"


def named(inv) -> DataFrame:
    """Components of the first name, without regard to case."""
    least = F.broadcast(inv.components.agg(F.lower(F.min("name")).alias("_name")))
    return inv.components.join(least, F.lower("name") == F.col("_name")).drop("_name")


@query("q_sbom_versions", f"SELECT c.version, count(DISTINCT c.id) AS component_count, count(DISTINCT u.asset_id) AS asset_count, count(DISTINCT f.id) AS finding_count FROM v_components c LEFT JOIN v_usages u ON u.component_id = c.id LEFT JOIN v_findings f ON f.component_id = c.id AND f.status <> 'resolved' WHERE lower(c.name) = lower({NAME}) GROUP BY c.version")
def sbom_versions(inv):
    parts = named(inv).select("id", "version")
    assets = parts.join(inv.usages, F.col("id") == F.col("component_id"), "left").groupBy("version").agg(F.countDistinct("id").alias("component_count"), F.countDistinct("asset_id").alias("asset_count"))
    open_ = parts.join(unresolved(inv).select("component_id", F.col("id").alias("finding")), F.col("id") == F.col("component_id"), "left").groupBy("version").agg(F.count("finding").alias("finding_count"))
    return assets.join(open_, "version")


@query("q_sbom_assets", f"SELECT a.id, a.asset_type, a.display_name, u.source, u.evidence_path, c.version FROM v_usages u JOIN v_assets a ON a.id = u.asset_id JOIN v_components c ON c.id = u.component_id WHERE lower(c.name) = lower({NAME})")
def sbom_assets(inv):
    used = inv.usages.join(named(inv).select(F.col("id").alias("component_id"), "version"), "component_id")
    return used.join(inv.assets, F.col("asset_id") == F.col("id")).select("id", "asset_type", "display_name", "source", "evidence_path", "version")


@query("q_vuln_status", f"WITH {STATUS_SQL} SELECT s.component_id, c.name, s.status, s.vulnerability_count, s.worst, coalesce(u.n, 0) AS target_count FROM v_status s JOIN v_components c ON c.id = s.component_id LEFT JOIN (SELECT component_id, count(DISTINCT asset_id) AS n FROM v_usages GROUP BY component_id) u ON u.component_id = s.component_id")
def list_vulnerability_status(inv):
    rows = vulnerability_status(inv).join(inv.components.select(F.col("id").alias("component_id"), "name"), "component_id")
    rows = with_count(rows, "component_id", counts_by(inv.usages, "component_id", "target_count", distinct="asset_id"), "component_id", "target_count")
    return rows.select("component_id", "name", "status", "vulnerability_count", "worst", "target_count")


@query("q_list_findings", f"SELECT f.id, f.severity, f.status, f.finding_type, f.asset_name, f.component_name, k.name AS connector_name FROM ({FINDING_SQL}) f LEFT JOIN v_connectors k ON k.id = f.connector_id")
def list_findings(inv):
    names = inv.connectors.select(F.col("id").alias("connector_id"), F.col("name").alias("connector_name"))
    return finding_rows(inv, inv.findings).join(names, "connector_id", "left").select("id", "severity", "status", "finding_type", "asset_name", "component_name", "connector_name")


@query("q_vulnerabilities", f"SELECT id, severity, status, asset_name, component_name, component_version, last_seen_at FROM ({FINDING_SQL}) WHERE finding_type = 'cve' AND severity = 'high' AND component_name ILIKE '%ring%' ORDER BY {ORDER_SQL}, last_seen_at DESC, id LIMIT 500")
def vulnerabilities(inv):
    rows = finding_rows(inv, inv.findings.where("finding_type = 'cve' and severity = 'high'")).where(contains_any("ring", F.col("component_name")))
    return rows.orderBy(severity_order(F.col("severity")), F.desc("last_seen_at"), "id").limit(500).select("id", "severity", "status", "asset_name", "component_name", "component_version", "last_seen_at")


@query("q_connectors", "SELECT k.id, k.name, k.connector_type, (SELECT count(*) FROM v_assets a WHERE a.connector_id = k.id) AS asset_count, (SELECT count(*) FROM supplier s WHERE s.s_nationkey = k.id) AS job_count FROM v_connectors k")
def connectors(inv):
    rows = with_count(inv.connectors, "id", counts_by(inv.assets, "connector_id", "asset_count"), "connector_id", "asset_count")
    return with_count(rows, "id", counts_by(inv.table("supplier"), "s_nationkey", "job_count"), "s_nationkey", "job_count").select("id", "name", "connector_type", "asset_count", "job_count")


@query("q_scanner_config", "SELECT connector_type, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM v_connectors WHERE status = 'enabled' AND connector_type IN ('ASIA', 'EUROPE', 'AMERICA') GROUP BY connector_type")
def scanner_config(inv):
    on = inv.connectors.where("status = 'enabled'").where(F.col("connector_type").isin("ASIA", "EUROPE", "AMERICA"))
    return on.groupBy("connector_type").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


@query("q_findings_page", f"SELECT id, severity, status, asset_name, component_name FROM ({FINDING_SQL}) WHERE severity = 'high' AND status <> 'resolved' AND finding_type = 'cve' AND (component_name ILIKE '%ring%' OR asset_name ILIKE '%ring%') ORDER BY {ORDER_SQL}, last_seen_at DESC, id LIMIT 25 OFFSET 25")
def findings_page(inv, severity: str = "high", kind: str = "cve", search: str = "ring", limit: int = 25, number: int = 2) -> DataFrame:
    """One page of the open findings of a severity and kind that a search finds, the worst and latest first."""
    rows = unresolved(inv).where((F.col("severity") == severity) & (F.col("finding_type") == kind))
    rows = finding_rows(inv, rows).where(contains_any(search, F.col("component_name"), F.col("asset_name")))
    return page(rows.orderBy(severity_order(F.col("severity")), F.desc("last_seen_at"), "id").select("id", "severity", "status", "asset_name", "component_name"), limit, number=number)


@query("q_assets_page", "SELECT a.id, a.display_name, k.name AS connector FROM v_assets a LEFT JOIN v_connectors k ON k.id = a.connector_id WHERE a.asset_type = 'MACHINERY' AND a.status = 'active' AND a.scan_status = 'scanned' AND a.display_name ILIKE '%1%' ORDER BY a.score DESC, a.id LIMIT 50")
def assets_page(inv, asset_type: str = "MACHINERY", status: str = "active", scan_status: str = "scanned", search: str = "1") -> DataFrame:
    """The first page of the assets that four filters leave, the highest score first."""
    rows = inv.assets.where((F.col("asset_type") == asset_type) & (F.col("status") == status) & (F.col("scan_status") == scan_status) & contains_any(search, F.col("display_name")))
    named = inv.connectors.select(F.col("id").alias("connector_id"), F.col("name").alias("connector"))
    return page(rows.join(named, "connector_id", "left").orderBy(F.desc("score"), "id").select("id", "display_name", "connector"))


@query("q_components_page", "SELECT c.id, c.name, c.version, count(DISTINCT u.asset_id) AS asset_count FROM v_components c LEFT JOIN v_usages u ON u.component_id = c.id WHERE c.ecosystem ILIKE '%e%' AND c.name ILIKE '%bolt%' GROUP BY ALL ORDER BY asset_count DESC, c.name, c.id LIMIT 50")
def components_page(inv, ecosystem: str = "e", search: str = "bolt") -> DataFrame:
    """The first page of the components that a search and an ecosystem leave, the most used first."""
    rows = inv.components.where(contains_any(ecosystem, F.col("ecosystem")) & contains_any(search, F.col("name")))
    used = inv.usages.join(rows.select(F.col("id").alias("component_id")), "component_id", "left_semi")
    rows = with_count(rows, "id", counts_by(used, "component_id", "asset_count", distinct="asset_id"), "component_id", "asset_count")
    return page(rows.select("id", "name", "version", "asset_count").orderBy(F.desc("asset_count"), "name", "id"))


@query("lim_paginate", f"SELECT id, severity, last_seen_at FROM v_findings ORDER BY {ORDER_SQL}, last_seen_at DESC, id LIMIT 50 OFFSET 100")
def third_page(inv):
    return page(inv.findings.select("id", "severity", "last_seen_at").orderBy(severity_order(F.col("severity")), F.desc("last_seen_at"), "id"), number=3)


@query("lim_page_envelope", "SELECT count(*) AS total, 50 AS \"limit\", 100 AS \"offset\", ceil(count(*) / 50.0)::BIGINT AS pages FROM v_findings")
def page_envelope(inv):
    n = F.count(F.lit(1))
    return inv.findings.agg(n.alias("total"), F.lit(50).alias("limit"), F.lit(100).alias("offset"), F.ceil(n / 50).alias("pages"))


# Filters and joins


@query("flt_kind_split", "SELECT CASE WHEN finding_type = 'cve' THEN 'cve' ELSE 'ghost' END AS kind, count(*) AS n FROM v_findings GROUP BY 1")
def kind_split(inv):
    return inv.findings.groupBy(F.when(F.col("finding_type") == "cve", "cve").otherwise("ghost").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_stale_assets", "SELECT id, display_name FROM v_assets WHERE status IN ('inactive', 'deleted', 'unknown')")
def stale_assets(inv):
    return inv.assets.where(F.col("status").isin("inactive", "deleted", "unknown")).select("id", "display_name")


@query("flt_like_any", "SELECT id, name, ecosystem FROM v_components WHERE name ILIKE '%ring%' OR ecosystem ILIKE '%ring%' OR version ILIKE '%ring%'")
def like_any(inv):
    return inv.components.where(contains_any("ring", F.col("name"), F.col("ecosystem"), F.col("version"))).select("id", "name", "ecosystem")


@query("jn_component_fanout", "SELECT c.id, count(DISTINCT u.asset_id) AS assets, count(DISTINCT f.id) AS findings FROM v_components c LEFT JOIN v_usages u ON u.component_id = c.id LEFT JOIN v_findings f ON f.component_id = c.id AND f.status <> 'resolved' GROUP BY c.id")
def component_fanout(inv):
    rows = with_count(inv.components.select("id"), "id", counts_by(inv.usages, "component_id", "assets", distinct="asset_id"), "component_id", "assets")
    return with_count(rows, "id", counts_by(unresolved(inv), "component_id", "findings"), "component_id", "findings")


@query("jn_self_edges", "SELECT r.source_asset_id, s.display_name AS source_name, r.relationship_type, r.target_asset_id, t.display_name AS target_name FROM v_relationships r JOIN v_assets s ON s.id = r.source_asset_id JOIN v_assets t ON t.id = r.target_asset_id")
def self_edges(inv):
    names = lambda side: inv.assets.select(F.col("id").alias(f"{side}_asset_id"), F.col("display_name").alias(f"{side}_name"))
    return inv.relationships.join(names("source"), "source_asset_id").join(names("target"), "target_asset_id").select("source_asset_id", "source_name", "relationship_type", "target_asset_id", "target_name")


@query("jn_finding_component_resolve", "SELECT f.id, coalesce(f.component_id, (SELECT min(u.component_id) FROM v_usages u WHERE u.asset_id = f.affected_asset_id)) AS resolved FROM v_findings f")
def resolved_components(inv):
    """The component of a finding, else the first one of its asset."""
    first = inv.usages.groupBy("asset_id").agg(F.min("component_id").alias("other"))
    return inv.findings.join(first, F.col("affected_asset_id") == F.col("asset_id"), "left").select("id", F.coalesce("component_id", "other").alias("resolved"))


@query("jn_spec_component", "SELECT s.advisory_id, c.id AS component_id, c.version FROM v_specs s JOIN v_components c ON c.name = s.package AND (s.ecosystem = '' OR c.ecosystem = '' OR s.ecosystem = c.ecosystem) AND (s.all_versions OR list_contains(s.versions, c.version))")
def malicious_components(inv):
    return advisory_hits(inv.specs, inv.components).select("advisory_id", "component_id", "version")


HITS_SQL = "hits AS (SELECT s.advisory_id, s.package, c.id AS component_id, c.version, c.ecosystem FROM v_specs s JOIN v_components c ON c.name = s.package AND (s.ecosystem = '' OR s.ecosystem = c.ecosystem) AND (s.all_versions OR list_contains(s.versions, c.version)))"


@query("agg_alert_group", f"WITH {HITS_SQL} SELECT h.advisory_id, h.package, h.version, h.ecosystem, count(DISTINCT h.component_id) AS components, count(DISTINCT u.asset_id) AS asset_count FROM hits h LEFT JOIN v_usages u ON u.component_id = h.component_id GROUP BY ALL")
def alert_groups(inv):
    """Alerts by advisory, package, version and ecosystem; one without affected assets is an alert too."""
    return alerts_of.alert_groups(inv.specs, inv.components, inv.usages.select("component_id", "asset_id"))


@query("q_alerts", f"WITH {HITS_SQL} SELECT advisory_id, package, version, ecosystem, count(DISTINCT component_id) AS components FROM hits GROUP BY ALL ORDER BY package, advisory_id, version, ecosystem LIMIT 500")
def alerts(inv):
    rows = alerts_of.alert_components(inv.specs, inv.components)
    return rows.orderBy("package", "advisory_id", "version", "ecosystem").limit(500)


@query("jn_ai_proximity", "SELECT f.id FROM v_findings f WHERE f.finding_type = 'malware' AND NOT EXISTS (SELECT 1 FROM v_findings g WHERE g.finding_type = 'cve' AND g.affected_asset_id = f.affected_asset_id AND g.severity = f.severity AND abs(g.id - f.id) <= 1)")
def proximity(inv):
    """Findings without another kind's one on the same place and severity, one apart at most."""
    cve = inv.findings.where("finding_type = 'cve'").select(F.col("id").alias("_id"), F.col("affected_asset_id").alias("_a"), F.col("severity").alias("_s"))
    near = (F.col("affected_asset_id") == F.col("_a")) & (F.col("severity") == F.col("_s")) & (F.abs(F.col("id") - F.col("_id")) <= 1)
    return inv.findings.where("finding_type = 'malware'").join(cve, near, "left_anti").select("id")


# Windows and merges


@query("win_topk_repo", "SELECT asset_id, component_id, last_seen_at FROM v_usages QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY last_seen_at DESC, component_id, layer, batch, evidence_path) <= 3")
def newest_of_each(inv):
    return keep_first(inv.usages, ["asset_id"], F.desc("last_seen_at"), F.col("component_id"), F.col("layer"), F.col("batch"), F.col("evidence_path"), n=3).select("asset_id", "component_id", "last_seen_at")


@query("win_keep_first_finding", "SELECT affected_asset_id, severity, min(id) AS id FROM v_findings GROUP BY ALL")
def first_findings(inv):
    return inv.findings.groupBy("affected_asset_id", "severity").agg(F.min("id").alias("id"))


@query("win_keep_last_upsert", "SELECT batch, evidence_path, arg_max(component_id, (last_seen_at, component_id, layer)) AS component_id, arg_max(source, (last_seen_at, component_id, layer)) AS source, min(last_seen_at) AS first_seen_at, bool_or(source = 'repo_scan') AS scanned FROM v_usages GROUP BY batch, evidence_path")
def merged_usages(inv):
    rows = inv.usages.withColumn("scan", F.col("source") == "repo_scan")
    done = merge_last(rows, ["batch", "evidence_path"], ["last_seen_at", "component_id", "layer"], first={"first_seen_at": "last_seen_at"}, latch={"scanned": F.col("scan")})
    return done.select("batch", "evidence_path", "component_id", "source", "first_seen_at", "scanned")


@query("ups_asset", "SELECT asset_id, max(last_seen_at) AS last_seen_at, min(last_seen_at) AS first_seen_at, bool_or(source = 'repo_sbom') AS latched, arg_max(component_id, (last_seen_at, component_id, layer, batch, evidence_path)) AS last_component FROM v_usages GROUP BY asset_id")
def merged_assets(inv):
    done = merge_last(inv.usages, ["asset_id"], ["last_seen_at", "component_id", "layer", "batch", "evidence_path"], first={"first_seen_at": "last_seen_at"}, latch={"latched": F.col("source") == "repo_sbom"})
    return done.select("asset_id", "last_seen_at", "first_seen_at", "latched", F.col("component_id").alias("last_component"))


@query("win_first_last_seen", "SELECT component_id, min(last_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at FROM v_usages GROUP BY component_id")
def seen(inv):
    return inv.usages.groupBy("component_id").agg(F.min("last_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


@query("ups_heartbeat", "SELECT runner_id, job_type, max(seen_at) AS last_seen_at FROM v_heartbeats GROUP BY runner_id, job_type")
def heartbeats(inv):
    return inv.heartbeats.groupBy("runner_id", "job_type").agg(F.max("seen_at").alias("last_seen_at"))


@query("win_latest_run", "SELECT runner_id, arg_max(id, seen_at) AS id, max(seen_at) AS seen_at FROM v_heartbeats GROUP BY runner_id")
def latest_runs(inv):
    return inv.heartbeats.groupBy("runner_id").agg(F.max_by("id", "seen_at").alias("id"), F.max("seen_at").alias("seen_at"))


@query("win_oldest_queued", "SELECT job_type, arg_min(id, seen_at) AS id FROM v_heartbeats WHERE value > 50 GROUP BY job_type")
def oldest_queued(inv):
    return inv.heartbeats.where("value > 50").groupBy("job_type").agg(F.min_by("id", "seen_at").alias("id"))


@query("win_nearest_prior", "SELECT id, last_value(CASE WHEN job_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY runner_id ORDER BY seen_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM v_heartbeats")
def nearest_prior(inv):
    """The last assignment before each row of its runner."""
    before = Window.partitionBy("runner_id").orderBy("seen_at").rowsBetween(Window.unboundedPreceding, -1)
    return inv.heartbeats.select("id", F.last(F.when(F.col("job_type") == "purchase", F.col("value")), ignorenulls=True).over(before).alias("prior"))


@query("win_batch_number", "SELECT asset_id, component_id, batch, evidence_path, layer, (row_number() OVER w - 1) // 5 + 1 AS batch_index FROM v_usages WINDOW w AS (PARTITION BY asset_id ORDER BY batch, evidence_path, component_id, layer, last_seen_at)")
def batch_numbers(inv):
    at = F.row_number().over(Window.partitionBy("asset_id").orderBy("batch", "evidence_path", "component_id", "layer", "last_seen_at"))
    return inv.usages.select("asset_id", "component_id", "batch", "evidence_path", "layer", (F.floor((at - 1) / 5).cast("long") + 1).alias("batch_index"))


@query("agg_package_digest", """WITH lines AS (SELECT asset_id, component_id // 100 AS part, component_id || '@' || evidence_path AS line FROM v_usages),
parts AS (SELECT asset_id, part, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM lines GROUP BY ALL)
SELECT asset_id, sha256(string_agg(d, chr(10) ORDER BY part)) AS digest FROM parts GROUP BY asset_id""")
def package_digest(inv):
    """A digest of the packages of every asset: that of the digests of their lines by ranges of components, so no task holds all lines of an asset."""
    line = F.concat_ws("@", F.col("component_id").cast("string"), F.col("evidence_path").cast("string"))
    digest = lambda texts: F.sha2(F.array_join(texts, "\n").cast("binary"), 256)
    parts = inv.usages.groupBy("asset_id", F.floor(F.col("component_id") / 100).alias("part")).agg(digest(F.array_sort(F.collect_list(line))).alias("d"))
    whole = parts.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("part", "d"))).alias("ds"))
    return whole.select("asset_id", digest(F.transform("ds", lambda x: x["d"])).alias("digest"))


@query("agg_pkg_occurrences", "SELECT component_id, count(*) AS occurrences, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, CASE WHEN bool_or(source = 'repo_sbom') THEN 'repo_sbom' WHEN bool_or(source = 'repo_scan') THEN 'repo_scan' ELSE 'image_scan' END AS main_source FROM v_usages GROUP BY component_id")
def package_occurrences(inv):
    sources = F.array_sort(F.collect_set("source"))
    out = inv.usages.groupBy("component_id").agg(F.count(F.lit(1)).alias("occurrences"), sources.alias("s"))
    main = F.when(F.array_contains("s", "repo_sbom"), "repo_sbom").when(F.array_contains("s", "repo_scan"), "repo_scan").otherwise("image_scan")
    return out.select("component_id", "occurrences", F.array_join("s", ",").alias("sources"), main.alias("main_source"))


@query("agg_grouped_report", f"SELECT component_id, finding_type, count(*) AS n, min({ORDER_SQL}) AS worst FROM v_findings WHERE component_id IS NOT NULL GROUP BY ALL")
def grouped_report(inv):
    return inv.findings.where("component_id is not null").groupBy("component_id", "finding_type").agg(F.count(F.lit(1)).alias("n"), F.min(severity_order(F.col("severity"))).alias("worst"))


@query("agg_identity_diff", "SELECT count(*) AS rows_, count(DISTINCT (name, version, ecosystem)) AS by_version, count(DISTINCT (name, ecosystem)) AS by_name FROM v_components")
def identity_difference(inv):
    return inv.components.agg(F.count(F.lit(1)).alias("rows_"), F.countDistinct("name", "version", "ecosystem").alias("by_version"), F.countDistinct("name", "ecosystem").alias("by_name"))


# Graph


@query("grf_topology", "SELECT a.id, a.display_name, a.asset_type, count(DISTINCT f.id) AS finding_count FROM v_assets a LEFT JOIN v_findings f ON f.affected_asset_id = a.id GROUP BY ALL ORDER BY a.asset_type, a.display_name, a.id LIMIT 500")
def graph_nodes(inv):
    rows = with_count(inv.assets.select("id", "display_name", "asset_type"), "id", counts_by(inv.findings, "affected_asset_id", "finding_count"), "affected_asset_id", "finding_count")
    return rows.orderBy("asset_type", "display_name", "id").limit(500)


@query("flt_graph_edges", "WITH nodes AS (SELECT id FROM v_assets ORDER BY asset_type, display_name, id LIMIT 500) SELECT r.* FROM v_relationships r WHERE source_asset_id IN (SELECT id FROM nodes) AND target_asset_id IN (SELECT id FROM nodes)")
def graph_edges(inv):
    nodes = inv.assets.orderBy("asset_type", "display_name", "id").limit(500)
    keep = lambda c: F.broadcast(nodes.select(F.col("id").alias(c)))  # noqa: E731  500 rows at most
    return inv.relationships.join(keep("source_asset_id"), "source_asset_id", "left_semi").join(keep("target_asset_id"), "target_asset_id", "left_semi").select("source_asset_id", "relationship_type", "target_asset_id")


@query("grf_neighbors", "SELECT * FROM v_relationships WHERE source_asset_id = 10 OR target_asset_id = 10")
def neighbors(inv, asset: int = 10):
    return inv.relationships.where((F.col("source_asset_id") == asset) | (F.col("target_asset_id") == asset))


@query("grf_blast_radius", "WITH c AS (SELECT id FROM v_components ORDER BY name, id LIMIT 1), touched AS (SELECT DISTINCT asset_id FROM v_usages WHERE component_id = (SELECT id FROM c)) SELECT a.id, a.display_name, (SELECT count(*) FROM v_findings f WHERE f.component_id = (SELECT id FROM c) AND f.affected_asset_id = a.id) AS findings, (SELECT count(*) FROM v_relationships r WHERE r.source_asset_id = a.id OR r.target_asset_id = a.id) AS edges FROM v_assets a WHERE a.id IN (SELECT asset_id FROM touched)")
def blast_radius(inv):
    """One hop from the first component by name: assets that use it, its findings there, and their edges."""
    part = F.broadcast(inv.components.orderBy("name", "id").limit(1).select(F.col("id").alias("component_id")))
    assets = inv.usages.join(part, "component_id").select(F.col("asset_id").alias("id")).distinct()
    found = counts_by(inv.findings.join(part, "component_id"), "affected_asset_id", "findings")
    ends = inv.relationships.select(F.explode(F.array_distinct(F.array("source_asset_id", "target_asset_id"))).alias("node"))
    rows = inv.assets.join(assets, "id", "left_semi").select("id", "display_name")
    rows = with_count(rows, "id", found, "affected_asset_id", "findings")
    return with_count(rows, "id", counts_by(ends, "node", "edges"), "node", "edges")


@query("del_connector", "SELECT id, CASE WHEN connector_id = 3 THEN NULL ELSE connector_id END AS connector_id FROM v_assets")
def assets_after_delete(inv, gone: int = 3):
    """Assets after a connector is deleted: they stay, without it."""
    left = inv.connectors.where(F.col("id") != gone).select(F.col("id").alias("connector_id"), F.col("id").alias("kept"))
    return inv.assets.join(left, "connector_id", "left").select("id", F.col("kept").alias("connector_id"))


# Queue and presence


@query("str_presence", "SELECT runner_id, max(seen_at) AS last_seen, max(seen_at) >= (SELECT max(seen_at) FROM v_heartbeats) - INTERVAL 1 DAY AS live FROM v_heartbeats GROUP BY runner_id")
def presence(inv):
    now = F.broadcast(inv.heartbeats.agg(F.max("seen_at").alias("now")))
    return inv.heartbeats.groupBy("runner_id").agg(F.max("seen_at").alias("last_seen")).crossJoin(now).select("runner_id", "last_seen", (F.col("last_seen") >= F.expr("now - interval 1 day")).alias("live"))


@query("str_reap", "SELECT id, seen_at, CASE WHEN job_type = 'click' AND seen_at < (SELECT max(seen_at) FROM v_heartbeats) - INTERVAL 1 HOUR THEN 'failed' ELSE 'running' END AS state FROM v_heartbeats")
def reaped(inv):
    now = F.broadcast(inv.heartbeats.agg(F.max("seen_at").alias("now")))
    late = (F.col("job_type") == "click") & (F.col("seen_at") < F.expr("now - interval 1 hour"))
    return inv.heartbeats.crossJoin(now).select("id", "seen_at", F.when(late, "failed").otherwise("running").alias("state"))


@query("str_tumbling_presence", "SELECT job_type, time_bucket(INTERVAL 1 HOUR, seen_at) AS hour, count(DISTINCT runner_id) AS runners FROM v_heartbeats GROUP BY ALL")
def hourly_presence(inv):
    return inv.heartbeats.groupBy("job_type", F.date_trunc("hour", "seen_at").alias("hour")).agg(F.countDistinct("runner_id").alias("runners"))


@query("q_scan_runs", "SELECT id, runner_id, job_type, seen_at FROM v_heartbeats ORDER BY seen_at DESC, id LIMIT 200")
def scan_runs(inv):
    return inv.heartbeats.select("id", "runner_id", "job_type", "seen_at").orderBy(F.desc("seen_at"), "id").limit(200)


@query("nrm_json_decode", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", views=False)
def decoded(inv):
    return inv.heartbeats.select("id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
