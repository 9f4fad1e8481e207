"""Filters, joins, aggregations, merges and incremental queries over the inventory views.

Sides of joins are aggregated to one row per key first, so that no join multiplies rows. Code lists are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.functions.scalars import allowed, any_glob, ecosystems_match, severity_order, severity_rank
from lodestack.operators.relational import counts_by, keep_first, merge_last, numbered, with_count
from lodestack.operators.runs import run_states
from lodestack.operators.text_rules import checked_patterns
from lodestack.plans.registry import query

#: Advisories are sent to all tasks only if they are measured to be at most this large.
BROADCAST_BYTES = 48 << 20

SEVERITY_ORDER_SQL = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END"
RANK_SQL = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"


# Filters


def equal(df, **wanted):
    """Rows whose columns equal the wanted values; an empty or missing value filters nothing."""
    for name, value in wanted.items():
        if value not in (None, ""):
            df = df.where(F.col(name) == value)
    return df


@query("flt_eq", "SELECT id FROM v_findings WHERE severity = 'high' AND finding_type = 'cve'")
def filtered(inv):
    return equal(inv.findings, severity="high", finding_type="cve", status="").select("id")


@query("flt_exists_vulnerable", "SELECT id FROM v_assets a WHERE EXISTS (SELECT 1 FROM v_findings f WHERE f.affected_asset_id = a.id AND finding_type = 'cve' AND status = 'open')")
def vulnerable_assets(inv):
    hit = inv.findings.where("finding_type = 'cve' and status = 'open'").select(F.col("affected_asset_id").alias("id"))
    return inv.assets.join(hit, "id", "left_semi").select("id")


@query("flt_not_resolved", "SELECT affected_asset_id, count(*) AS n_all, count(*) FILTER (status <> 'resolved') AS n_open FROM v_findings GROUP BY affected_asset_id")
def unresolved(inv):
    return inv.findings.groupBy("affected_asset_id").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("status") != "resolved").alias("n_open"))


@query("flt_name_ci", "SELECT id FROM v_components WHERE lower(name) = lower('COLD Widget') AND coalesce(version, 'unknown') <> 'unknown'")
def named(inv, name: str = "COLD Widget"):
    return inv.components.where((F.lower("name") == name.lower()) & (F.coalesce("version", F.lit("unknown")) != "unknown")).select("id")


@query("flt_tag_allowed", "SELECT id FROM v_components WHERE version LIKE '1%' AND NOT version LIKE '%5'")
def allowed_tags(inv):
    return inv.components.where(allowed(F.col("version"), ["1*"], ["*5"])).select("id")


@query("flt_repo_allowed", "SELECT id FROM v_components WHERE (name LIKE '% widget' OR package_manager || '/' || name LIKE 'Brand#1%') AND version <> '7'")
def allowed_repositories(inv):
    return inv.components.where((any_glob(F.col("name"), ["* widget"]) | any_glob(F.concat_ws("/", "package_manager", "name"), ["Brand#1*"])) & (F.col("version") != "7")).select("id")


@query("flt_push_window", "SELECT id FROM v_findings WHERE coalesce(date_diff('day', CAST(last_seen_at AS DATE), DATE '1998-12-01') <= 365, true)")
def recent(inv, today: str = "1998-12-01", days: int = 365):
    """At most so many days old; a missing date passes."""
    return inv.findings.where(F.coalesce(F.datediff(F.lit(today).cast("date"), F.col("last_seen_at").cast("date")) <= days, F.lit(True))).select("id")


@query("flt_ignore_rules", "SELECT id FROM v_components WHERE NOT regexp_matches(name, '^cold|ring$')")
def not_ignored(inv, patterns: tuple[str, ...] = ("^cold", "ring$")):
    """Names that no pattern matches; over 100 patterns, or one over 512 characters, are an error."""
    return inv.components.where(~F.col("name").rlike("|".join(f"(?:{p})" for p in checked_patterns(patterns)))).select("id")


@query("flt_ecosystems_match", "SELECT s.advisory_id, count(*) AS n FROM v_specs s JOIN v_components c ON c.name = s.package AND (s.ecosystem = '' OR s.ecosystem = c.ecosystem) GROUP BY s.advisory_id")
def ecosystem_matches(inv):
    """Advisories by the components of their name and ecosystem: components are counted by both first, so pairs are few."""
    known = inv.components.groupBy(F.col("name").alias("package"), F.col("ecosystem").alias("eco")).agg(F.count(F.lit(1)).alias("k"))
    both = inv.specs.select("advisory_id", "package", "ecosystem").join(known, "package").where(ecosystems_match(F.col("ecosystem"), F.col("eco")))
    return both.groupBy("advisory_id").agg(F.sum("k").alias("n"))


# Joins


@query("jn_asset_connector", "SELECT a.id, a.display_name, c.name AS connector, c.connector_type FROM v_assets a LEFT JOIN v_connectors c ON c.id = a.connector_id")
def assets_with_connectors(inv):
    side = inv.connectors.select(F.col("id").alias("connector_id"), F.col("name").alias("connector"), "connector_type")
    return inv.assets.join(side, "connector_id", "left").select("id", "display_name", "connector", "connector_type")


@query("jn_finding_asset_component", "SELECT f.id, a.display_name AS asset, c.name AS component FROM v_findings f LEFT JOIN v_assets a ON a.id = f.affected_asset_id LEFT JOIN v_components c ON c.id = f.component_id")
def named_findings(inv):
    assets = inv.assets.select(F.col("id").alias("affected_asset_id"), F.col("display_name").alias("asset"))
    parts = inv.components.select(F.col("id").alias("component_id"), F.col("name").alias("component"))
    return inv.findings.join(assets, "affected_asset_id", "left").join(parts, "component_id", "left").select("id", "asset", "component")


@query("jn_usage_asset_component", "SELECT a.asset_type, c.ecosystem, count(*) AS n FROM v_usages u JOIN v_assets a ON a.id = u.asset_id JOIN v_components c ON c.id = u.component_id GROUP BY ALL")
def usages_by_kind(inv):
    assets = inv.assets.select(F.col("id").alias("asset_id"), "asset_type")
    parts = inv.components.select(F.col("id").alias("component_id"), "ecosystem")
    counted = inv.usages.groupBy("asset_id", "component_id").agg(F.count(F.lit(1)).alias("k"))
    return counted.join(assets, "asset_id").join(parts, "component_id").groupBy("asset_type", "ecosystem").agg(F.sum("k").alias("n"))


def worst_status(inv):
    """Per component the count of its vulnerabilities and the worst severity."""
    cves = inv.findings.where("finding_type = 'cve' and component_id is not null")
    return cves.groupBy("component_id").agg(F.count(F.lit(1)).alias("vulnerabilities"), F.max(severity_rank(F.col("severity"))).alias("worst"))


@query("jn_component_vuln", f"SELECT c.id, (SELECT count(DISTINCT asset_id) FROM v_usages u WHERE u.component_id = c.id) AS targets, v.vulnerabilities, v.worst FROM v_components c LEFT JOIN (SELECT component_id, count(*) AS vulnerabilities, max({RANK_SQL}) AS worst FROM v_findings WHERE finding_type = 'cve' GROUP BY component_id) v ON v.component_id = c.id")
def component_status(inv):
    rows = with_count(inv.components.select("id"), "id", counts_by(inv.usages, "component_id", "targets", distinct="asset_id"), "component_id", "targets")
    return rows.join(worst_status(inv).withColumnRenamed("component_id", "id"), "id", "left").select("id", "targets", "vulnerabilities", "worst")


@query("ups_vuln_status", f"SELECT component_id, count(*) AS vulnerabilities, max({RANK_SQL}) AS worst FROM v_findings WHERE finding_type = 'cve' AND component_id IS NOT NULL GROUP BY component_id")
def vulnerability_status(inv):
    return worst_status(inv)


@query("jn_connector_counts", "SELECT c.id, count(DISTINCT a.id) AS assets, count(DISTINCT j.id) AS jobs FROM v_connectors c LEFT JOIN v_assets a ON a.connector_id = c.id LEFT JOIN v_heartbeats j ON j.runner_id = c.id GROUP BY c.id")
def connector_counts(inv):
    rows = with_count(inv.connectors.select("id"), "id", counts_by(inv.assets, "connector_id", "assets"), "connector_id", "assets")
    return with_count(rows, "id", counts_by(inv.heartbeats, "runner_id", "jobs"), "runner_id", "jobs")


@query("jn_correlated_counts", "SELECT id, (SELECT count(*) FROM v_usages u WHERE u.asset_id = a.id) AS components, (SELECT count(*) FROM v_findings f WHERE f.affected_asset_id = a.id AND status <> 'resolved') AS findings FROM v_assets a")
def asset_counts(inv):
    rows = with_count(inv.assets.select("id"), "id", counts_by(inv.usages, "asset_id", "components"), "asset_id", "components")
    return with_count(rows, "id", counts_by(inv.findings.where("status <> 'resolved'"), "affected_asset_id", "findings"), "affected_asset_id", "findings")


@query("jn_run_connector", "SELECT h.id, h.job_type, c.name AS connector FROM v_heartbeats h LEFT JOIN v_connectors c ON c.id = h.runner_id")
def runs_with_connectors(inv):
    side = inv.connectors.select(F.col("id").alias("runner_id"), F.col("name").alias("connector"))
    return inv.heartbeats.join(side, "runner_id", "left").select("id", "job_type", "connector")


@query("jn_ref_resolve", "SELECT DISTINCT r.target_asset_id AS ref, coalesce(a.display_name, CAST(r.target_asset_id AS VARCHAR)) AS resolved FROM v_relationships r LEFT JOIN v_assets a ON a.id = r.target_asset_id AND a.status = 'active'")
def resolved_references(inv):
    """Known references become names, others pass through."""
    known = inv.assets.where("status = 'active'").select(F.col("id").alias("ref"), "display_name")
    return inv.relationships.select(F.col("target_asset_id").alias("ref")).distinct().join(known, "ref", "left").select("ref", F.coalesce("display_name", F.col("ref").cast("string")).alias("resolved"))


@query("jn_provenance", "SELECT i.id, min(a.id) AS origin FROM v_components i JOIN v_components a ON (a.name = i.name OR a.package_manager = i.name) AND a.id <> i.id GROUP BY i.id")
def provenance(inv):
    """The least other row that has the name, or is managed by it: two joins on equality in place of one on a disjunction.

    Each side holds its two least ids per key, as one of them may be the row itself.
    """
    least = lambda key: keep_first(inv.components.select(F.col(key).alias("name"), F.col("id").alias("origin")), ["name"], F.col("origin"), n=2)
    both = [inv.components.select("id", "name").join(least(k), "name").where("origin <> id").select("id", "origin") for k in ("name", "package_manager")]
    return both[0].unionByName(both[1]).groupBy("id").agg(F.min("origin").alias("origin"))


@query("jn_mirror_details", "SELECT a.id, coalesce(r.place, a.asset_type) AS place FROM v_assets a LEFT JOIN (SELECT source_asset_id, max(target_asset_id) AS place_id, CAST(max(target_asset_id) AS VARCHAR) AS place FROM v_relationships WHERE relationship_type = 'runs_in' GROUP BY source_asset_id) r ON r.source_asset_id = a.id")
def mirrored(inv):
    """Edges update a column of their source; the last edge wins, without one the old value stays."""
    last = inv.relationships.where("relationship_type = 'runs_in'").groupBy(F.col("source_asset_id").alias("id")).agg(F.max("target_asset_id").cast("string").alias("place"))
    return inv.assets.join(last, "id", "left").select("id", F.coalesce("place", "asset_type").alias("place"))


@query("jn_hit_assets", "SELECT DISTINCT s.advisory_id, u.asset_id FROM v_specs s JOIN v_components c ON c.name = s.package JOIN v_usages u ON u.component_id = c.id WHERE s.all_versions")
def hit_assets(inv):
    """Assets by advisory. The assets of a name are told apart once, not for each of its advisories; then pairs of one advisory and name need no shuffle.

    An advisory of several names may meet an asset twice; only the pairs of such advisories are compared. Advisories that are measured
    to be few go to all tasks, so assets stay where they were told apart; else both are dealt out.
    """
    named = inv.specs.where("all_versions and package is not null").select("advisory_id", F.col("package").alias("name")).distinct()
    several = named.groupBy("advisory_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("advisory_id")
    wanted = named.select("name").distinct()
    known = inv.components.join(wanted, "name", "left_semi").select("name", F.col("id").alias("component_id"))
    assets = known.join(inv.usages.select("component_id", "asset_id"), "component_id").select("name", "asset_id").distinct()
    size = named.agg(F.sum(F.lit(64) + F.octet_length("name"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        meet = lambda some: F.broadcast(some).join(assets, "name").select("advisory_id", "asset_id")
    else:
        # a few names have most assets: each is dealt over the parts of its own assets
        parts = int(inv.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = assets.withColumn("part", F.pmod(F.xxhash64("asset_id"), F.lit(parts)))
        meet = lambda some: some.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(dealt, ["name", "part"]).select("advisory_id", "asset_id")
    return meet(named.join(several, "advisory_id", "left_anti")).unionByName(meet(named.join(several, "advisory_id", "left_semi")).distinct())


@query("jn_edge_keys", "SELECT DISTINCT coalesce(s.display_name, CAST(source_asset_id AS VARCHAR)) AS from_key, coalesce(t.display_name, CAST(target_asset_id AS VARCHAR)) AS to_key FROM v_relationships LEFT JOIN v_assets s ON s.id = source_asset_id AND s.status = 'active' LEFT JOIN v_assets t ON t.id = target_asset_id AND t.status = 'active' WHERE source_asset_id <> target_asset_id")
def edge_keys(inv):
    names = lambda c: inv.assets.where("status = 'active'").select(F.col("id").alias(c), F.col("display_name").alias(f"{c}_name"))
    edges = inv.relationships.where("source_asset_id <> target_asset_id").select("source_asset_id", "target_asset_id").distinct()
    for c in edges.columns:
        edges = edges.join(names(c), c, "left")
    key = lambda c: F.coalesce(f"{c}_name", F.col(c).cast("string"))
    return edges.select(key("source_asset_id").alias("from_key"), key("target_asset_id").alias("to_key")).distinct()


@query("jn_reference_follow", "SELECT DISTINCT target_asset_id AS id FROM v_relationships WHERE target_asset_id IN (SELECT id FROM v_assets) AND target_asset_id NOT IN (SELECT affected_asset_id FROM v_findings WHERE severity = 'critical')")
def followed(inv):
    """Referenced, listed, and not followed yet: without a critical finding."""
    wanted = inv.relationships.select(F.col("target_asset_id").alias("id")).distinct()
    return wanted.join(inv.assets, "id", "left_semi").join(inv.findings.where("severity = 'critical'").select(F.col("affected_asset_id").alias("id")), "id", "left_anti")


@query("jn_registry_auth", "SELECT id, CASE WHEN name LIKE 'cold%' THEN 1 WHEN name LIKE '% widget' THEN 2 WHEN name LIKE '%' THEN 3 END AS entry FROM v_components")
def registry_entries(inv, globs: tuple[str, ...] = ("cold*", "* widget", "*")):
    """The first entry of a configured list whose glob matches; one expression in place of a join."""
    entry = F.lit(None).cast("int")
    for k in range(len(globs), 0, -1):
        entry = F.when(any_glob(F.col("name"), [globs[k - 1]]), F.lit(k)).otherwise(entry)
    return inv.components.select("id", entry.alias("entry"))


# Aggregations, orders, sets


@query("agg_ingest_counters", "SELECT 'assets' AS what, count(*) AS n FROM v_assets UNION ALL SELECT 'components', count(*) FROM v_components UNION ALL SELECT 'findings', count(*) FROM v_findings UNION ALL SELECT 'relationships', count(*) FROM v_relationships")
def ingest_counters(inv):
    parts = [getattr(inv, name).agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n")) for name in ("assets", "components", "findings", "relationships")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("agg_summary_severity", "SELECT severity, finding_type, count(*) AS n FROM v_findings GROUP BY GROUPING SETS ((severity), (finding_type))")
def summary(inv):
    """Counts by severity and by kind in one pass."""
    pair = F.explode(F.array(F.struct(F.col("severity"), F.lit(None).cast("string").alias("finding_type")), F.struct(F.lit(None).cast("string").alias("severity"), F.col("finding_type"))))
    return inv.findings.select(pair.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).select("k.*", "n")


@query("agg_k8s_summary", "SELECT asset_type, status, scan_status, count(*) AS n FROM v_assets GROUP BY ALL")
def cluster_summary(inv):
    return inv.assets.groupBy("asset_type", "status", "scan_status").agg(F.count(F.lit(1)).alias("n"))


@query("agg_pipeline_summary", "SELECT count(*) FILTER (scan_status = 'scanned') AS ok, count(*) FILTER (scan_status = 'failed') AS failed, round(sum(score), 2) AS score FROM v_assets")
def pipeline_summary(inv):
    return inv.assets.agg(F.count_if(F.col("scan_status") == "scanned").alias("ok"), F.count_if(F.col("scan_status") == "failed").alias("failed"), F.round(F.sum(F.col("score").cast("decimal(18,2)")), 2).cast("double").alias("score"))


@query("agg_enrich_group", "SELECT ecosystem, name, count(*) AS n, (row_number() OVER (PARTITION BY ecosystem ORDER BY name) - 1) // 10 AS batch FROM v_components GROUP BY ecosystem, name")
def enrichment_groups(inv):
    """Names of an ecosystem in batches of ten."""
    groups = inv.components.groupBy("ecosystem", "name").agg(F.count(F.lit(1)).alias("n"))
    return numbered(groups, ["ecosystem"], "name", "at").select("ecosystem", "name", "n", F.floor(F.col("at") / 10).cast("long").alias("batch"))


@query("agg_oldest_full", "SELECT job_type, min(last) AS oldest FROM (SELECT job_type, runner_id, max(seen_at) AS last FROM v_heartbeats GROUP BY ALL) GROUP BY job_type")
def oldest_full(inv):
    return inv.heartbeats.groupBy("job_type", "runner_id").agg(F.max("seen_at").alias("last")).groupBy("job_type").agg(F.min("last").alias("oldest"))


@query("srt_severity_case", f"SELECT id, severity, last_seen_at FROM v_findings ORDER BY {SEVERITY_ORDER_SQL}, last_seen_at DESC, id LIMIT 200")
def worst_first(inv):
    return inv.findings.orderBy(severity_order(F.col("severity")), F.desc("last_seen_at"), "id").select("id", "severity", "last_seen_at").limit(200)


@query("lim_count_pushdown", "SELECT count(*) AS total FROM v_findings f LEFT JOIN v_assets a ON a.id = f.affected_asset_id WHERE f.severity = 'high'")
def total_alone(inv):
    """The total of a list is counted without the joins that only add columns."""
    return inv.findings.where("severity = 'high'").agg(F.count(F.lit(1)).alias("total"))


@query("set_union_sources", "SELECT component_id, min(p) AS source FROM (SELECT component_id, 1 AS p FROM v_usages WHERE source = 'repo_sbom' UNION ALL SELECT component_id, 2 FROM v_usages WHERE source = 'repo_scan' UNION ALL SELECT component_id, 3 FROM v_usages WHERE source = 'image_scan') GROUP BY component_id")
def first_source(inv):
    """Each target by the first source that gives it."""
    order = F.when(F.col("source") == "repo_sbom", 1).when(F.col("source") == "repo_scan", 2).otherwise(3)
    return inv.usages.groupBy("component_id").agg(F.min(order).alias("source"))


@query("set_diff_scanned", "SELECT DISTINCT component_id FROM v_usages EXCEPT SELECT component_id FROM v_findings")
def not_scanned(inv):
    return inv.usages.select("component_id").distinct().join(inv.findings.select("component_id"), "component_id", "left_anti")


@query("set_unique_edges", "SELECT DISTINCT asset_id, component_id FROM v_usages")
def unique_edges(inv):
    return inv.usages.select("asset_id", "component_id").distinct()


# Merges and incremental queries


@query("ups_usage", "SELECT batch, evidence_path, arg_max(component_id, (last_seen_at, component_id, layer)) AS component_id, max(last_seen_at) AS last_seen_at FROM v_usages GROUP BY batch, evidence_path")
def last_usages(inv):
    return merge_last(inv.usages, ["batch", "evidence_path"], ["last_seen_at", "component_id", "layer"]).select("batch", "evidence_path", "component_id", "last_seen_at")


@query("ups_finding", "SELECT affected_asset_id, finding_type, arg_max(id, (last_seen_at, id)) AS id, arg_max(status, (last_seen_at, id)) AS status FROM v_findings GROUP BY ALL")
def last_findings(inv):
    return merge_last(inv.findings, ["affected_asset_id", "finding_type"], ["last_seen_at", "id"]).select("affected_asset_id", "finding_type", "id", "status")


@query("win_cursor", "SELECT job_type, coalesce(max(CASE WHEN value > 100 THEN seen_at END), max(seen_at) - INTERVAL 1 DAY) AS since FROM v_heartbeats GROUP BY job_type")
def cursors(inv):
    """The last successful run, else a look-back."""
    return inv.heartbeats.groupBy("job_type").agg(F.coalesce(F.max(F.when(F.col("value") > 100, F.col("seen_at"))), F.max("seen_at") - F.expr("interval 1 day")).alias("since"))


RUNS_SQL = "log AS (SELECT id // 4 AS run, id, job_type FROM v_heartbeats), k AS (SELECT run, min(id) FILTER (job_type = 'signup') AS c, min(id) FILTER (job_type = 'error') AS x, max(id) FILTER (job_type = 'purchase') AS d FROM log GROUP BY run)"


@query("str_complete", f"WITH {RUNS_SQL} SELECT run, CASE WHEN c IS NOT NULL AND (x IS NULL OR c < x) AND d > c THEN 'succeeded' WHEN x IS NOT NULL THEN 'canceled' WHEN c IS NOT NULL THEN 'running' ELSE 'queued' END AS state FROM k")
def states(inv):
    """Claims, cancellations and completions folded to states."""
    action = F.when(F.col("job_type") == "signup", "claim").when(F.col("job_type") == "error", "cancel").when(F.col("job_type") == "purchase", "complete").otherwise("none")
    return run_states(inv.heartbeats.select(F.floor(F.col("id") / 4).cast("long").alias("run"), "id", action.alias("action")), ["run"], "id")


@query("str_change_gate", "SELECT id, CASE WHEN p IS NULL OR seen_at - p >= INTERVAL 7 DAY THEN 'forced' WHEN value > 100 THEN 'changed' ELSE 'unchanged' END AS gate FROM (SELECT *, lag(seen_at) OVER (PARTITION BY runner_id ORDER BY seen_at) AS p FROM v_heartbeats)")
def change_gate(inv):
    last = F.lag("seen_at").over(Window.partitionBy("runner_id").orderBy("seen_at"))
    rows = inv.heartbeats.withColumn("p", last)
    return rows.select("id", F.when(F.expr("p is null or seen_at >= p + interval 7 day"), "forced").when(F.col("value") > 100, "changed").otherwise("unchanged").alias("gate"))


@query("str_staleness_contract", "SELECT runner_id, greatest(max(seen_at) FILTER (job_type = 'purchase'), max(seen_at) FILTER (job_type = 'click')) AS fresh FROM v_heartbeats GROUP BY runner_id")
def freshness(inv):
    """The later of the last batch and the last beat."""
    last = lambda kind: F.max(F.when(F.col("job_type") == kind, F.col("seen_at")))
    return inv.heartbeats.groupBy("runner_id").agg(F.greatest(last("purchase"), last("click")).alias("fresh"))


@query("str_batch_accumulate", "SELECT runner_id, count(DISTINCT props) AS batches FROM v_heartbeats GROUP BY runner_id")
def accumulated(inv):
    """Batches of each source; a repeated delivery changes nothing."""
    return inv.heartbeats.select("runner_id", "props").distinct().groupBy("runner_id").agg(F.count(F.lit(1)).alias("batches"))
