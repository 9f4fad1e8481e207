"""Listings of registries, predicates, merges by key, orders and queue states, each with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.functions.scalars import any_glob
from lodestack.operators.listings import advisory_feed, first_tag, one_per_digest, tag_targets, version_targets
from lodestack.operators.relational import counted_apart, counts_by, keep_first, merge_last, with_count
from lodestack.plans.registry import query

# Sources. Suppliers stand for registries, parts for repositories, order lines for pushed images.


def pushes(inv):
    line = inv.table("lineitem")
    return line.select(F.col("l_suppkey").alias("repository"), F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("tag"), F.col("l_shipdate").alias("pushed_at"), F.col("l_linestatus").alias("state"), F.concat(F.lit("sha256:"), F.col("l_partkey").cast("string")).alias("digest"))


PUSHES_SQL = "pushes AS (SELECT l_suppkey AS repository, l_orderkey || '.' || l_linenumber AS tag, l_shipdate AS pushed_at, l_linestatus AS state, 'sha256:' || l_partkey AS digest FROM lineitem)"


@query("src_dockerhub", f"WITH {PUSHES_SQL} SELECT repository, tag, pushed_at FROM pushes WHERE NOT tag LIKE '%.1' QUALIFY row_number() OVER (PARTITION BY repository ORDER BY pushed_at DESC, tag) <= 3", views=False)
def newest_tags(inv, most: int = 3):
    return tag_targets(pushes(inv), ["repository"], ~any_glob(F.col("tag"), ["*.1"]), "pushed_at", most).select("repository", "tag", "pushed_at")


def versions(inv):
    """Versions with two tags, one or none."""
    of = F.col("state")
    tags = F.when(of == "O", F.array("tag", F.lit("latest"))).when(F.col("repository") % 2 == 0, F.array("tag")).otherwise(F.array().cast("array<string>"))
    return pushes(inv).withColumn("tags", tags).withColumn("digest", F.concat("digest", F.lit("-"), "tag")).drop("tag")


VERSIONS_SQL = f"{PUSHES_SQL}, versions AS (SELECT repository, pushed_at, digest || '-' || tag AS digest, CASE WHEN state = 'O' THEN [tag, 'latest'] WHEN repository % 2 = 0 THEN [tag] ELSE [] END AS tags FROM pushes)"


@query("src_ghcr", f"WITH {VERSIONS_SQL} SELECT repository, digest, unnest(tags) AS tag FROM (SELECT * FROM versions WHERE len(tags) > 0 QUALIFY row_number() OVER (PARTITION BY repository ORDER BY pushed_at DESC, digest) <= 2)", views=False)
def tagged_versions(inv, most: int = 2):
    return version_targets(versions(inv), ["repository"], "pushed_at", most).select("repository", "digest", "tag")


@query("src_harbor", f"WITH {VERSIONS_SQL} SELECT repository, digest, unnest(CASE WHEN len(tags) = 0 THEN [NULL] ELSE tags END) AS tag FROM (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY repository ORDER BY pushed_at DESC, digest) <= 2)", views=False)
def all_versions(inv, most: int = 2):
    """Untagged artifacts too; they are named by their digest."""
    return version_targets(versions(inv), ["repository"], "pushed_at", most, untagged=True).select("repository", "digest", "tag")


@query("src_ecr", f"WITH {VERSIONS_SQL} SELECT repository, [t FOR t IN tags IF t LIKE '%.2' OR t = 'latest'][1] AS tag, 'repo/' || repository || '@' || digest AS reference FROM versions WHERE pushed_at >= DATE '1997-01-01' AND len([t FOR t IN tags IF t LIKE '%.2' OR t = 'latest']) > 0 QUALIFY row_number() OVER (PARTITION BY repository ORDER BY pushed_at DESC, digest) <= 2", views=False)
def pushed_since(inv, since: str = "1997-01-01", most: int = 2):
    """Pushed in the window, with the first allowed tag, named by digest."""
    named = versions(inv).where(F.col("pushed_at") >= F.lit(since).cast("date")).withColumn("tag", first_tag(F.col("tags"), ["*.2", "latest"])).where("tag IS NOT NULL")
    newest = keep_first(named, ["repository"], F.desc("pushed_at"), F.col("digest"), n=most)
    return newest.select("repository", "tag", F.concat(F.lit("repo/"), F.col("repository").cast("string"), F.lit("@"), "digest").alias("reference"))


@query("src_ecs", "SELECT DISTINCT o_custkey AS cluster, 'image/' || l_partkey AS reference FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'", views=False)
def running_images(inv):
    """Images of running tasks, once for each cluster."""
    tasks = inv.table("orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cluster"))
    images = inv.table("lineitem").select("l_orderkey", F.concat(F.lit("image/"), F.col("l_partkey").cast("string")).alias("reference"))
    return tasks.join(images, "l_orderkey").select("cluster", "reference").distinct()


@query("src_image_discover", f"WITH {PUSHES_SQL} SELECT source, count(*) AS images FROM (SELECT digest, min(CASE WHEN state = 'O' THEN 0 ELSE 1 END) AS source FROM pushes GROUP BY digest) GROUP BY source", views=False)
def discovered(inv):
    """All sources together; a digest counts for the first source that has it."""
    rows = pushes(inv)
    of = lambda state, at: rows.where(F.col("state") == state).select(F.lit(at).alias("source"), "digest", F.col("tag").alias("reference"))
    return one_per_digest(of("O", 0).unionByName(of("F", 1)), ["source", "reference"]).groupBy("source").agg(F.count(F.lit(1)).alias("images"))


@query("src_repo_filter", "SELECT p_partkey AS id FROM part WHERE (p_name LIKE '% widget' OR p_brand || '/' || p_name LIKE 'Brand#2%') AND p_size % 10 <> 0 ORDER BY p_partkey LIMIT 25", views=False)
def selected_repositories(inv, most: int = 25):
    """Repositories by name or owner/name, not archived, the first so many."""
    chosen = any_glob(F.col("p_name"), ["* widget"]) | any_glob(F.concat_ws("/", "p_brand", "p_name"), ["Brand#2*"])
    return inv.table("part").where(chosen & (F.col("p_size") % 10 != 0)).select(F.col("p_partkey").alias("id")).orderBy("id").limit(most)


@query("src_osv_feed", "SELECT 'MAL-' || o_orderkey AS advisory_id, o_orderdate AS changed_at FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate > DATE '1996-01-01' ORDER BY o_orderdate DESC, 'MAL-' || o_orderkey LIMIT 5000) WHERE o_orderkey % 7 <> 0", views=False)
def feed(inv, since: str = "1996-01-01"):
    orders = inv.table("orders")
    name = F.concat(F.when(F.col("o_orderstatus") == "P", "GHSA-").otherwise("MAL-"), F.col("o_orderkey").cast("string")).alias("advisory_id")
    known = orders.select(name, F.when(F.col("o_orderkey") % 7 == 0, "yes").alias("withdrawn"))
    return advisory_feed(orders.select(name, F.col("o_orderdate").alias("changed_at")), known, F.lit(since).cast("date")).select("advisory_id", "changed_at")


# Predicates


@query("flt_exists_endpoint", "SELECT id FROM v_assets a WHERE EXISTS (SELECT 1 FROM v_connectors d WHERE d.id = a.connector_id AND connector_type ILIKE '%asia%')")
def assets_by_detail(inv, part: str = "asia"):
    """Assets whose detail row contains the text, whatever its case."""
    detail = inv.connectors.where(F.lower("connector_type").contains(part.lower())).select(F.col("id").alias("connector_id"))
    return inv.assets.join(detail, "connector_id", "left_semi").select("id")


@query("flt_category", f"SELECT finding_type, count(*) AS n, bool_or(severity IN ('critical', 'high')) AS fails FROM v_findings WHERE severity IN ('critical', 'high', 'medium') AND finding_type IN ('cve', 'malware') GROUP BY finding_type")
def gate(inv):
    """Findings of the chosen categories at or above a severity, and whether one reaches the threshold."""
    kept = inv.findings.where(F.col("severity").isin("critical", "high", "medium") & F.col("finding_type").isin("cve", "malware"))
    return kept.groupBy("finding_type").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("severity").isin("critical", "high")).alias("fails"))


# Joins


@query("jn_usage_component", "SELECT u.batch, u.evidence_path, c.name, c.version FROM v_usages u JOIN v_components c ON c.id = u.component_id")
def used_components(inv):
    return inv.usages.join(inv.components, F.col("component_id") == F.col("id")).select("batch", "evidence_path", "name", "version")


@query("jn_name_prefilter", "SELECT id FROM v_components WHERE name IN (SELECT package FROM v_specs)")
def named_by_spec(inv):
    return inv.components.join(inv.specs.select(F.col("package").alias("name")), "name", "left_semi").select("id")


@query("jn_malware_payload", "SELECT h.l_orderkey AS hit, h.l_linenumber AS line, coalesce(p.p_partkey, n.id) AS component_id FROM lineitem h LEFT JOIN part p ON h.l_linenumber % 2 = 0 AND p.p_partkey = h.l_partkey LEFT JOIN (SELECT p_name, CAST(p_size AS VARCHAR) AS version, min(p_partkey) AS id FROM part GROUP BY ALL) n ON n.p_name = 'cold widget' AND n.version = CAST(h.l_linenumber AS VARCHAR)", views=False)
def hit_components(inv):
    """Hits find their component by url, else by name and version; both sides hold a key once, so rows never multiply."""
    url = lambda c: F.concat(F.lit("pkg:npm/"), c.cast("string"))
    hits = inv.table("lineitem").select(F.col("l_orderkey").alias("hit"), F.col("l_linenumber").alias("line"), F.when(F.col("l_linenumber") % 2 == 0, url(F.col("l_partkey"))).alias("purl"), F.lit("cold widget").alias("name"), F.col("l_linenumber").cast("string").alias("version"))
    by_url = inv.components.groupBy(url(F.col("id")).alias("purl")).agg(F.min("id").alias("first"))
    by_name = inv.components.groupBy("name", "version").agg(F.min("id").alias("second"))
    return hits.join(by_url, "purl", "left").join(by_name, ["name", "version"], "left").select("hit", "line", F.coalesce("first", "second").alias("component_id"))


@query("jn_osv_positional", "SELECT l_orderkey AS batch, l_linenumber AS place, l_partkey AS asked, l_suppkey AS answered FROM lineitem", views=False)
def by_place(inv):
    """Arrays of questions and answers of one batch are matched by place, without a join."""
    row = inv.table("lineitem").groupBy(F.col("l_orderkey").alias("batch")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    both = F.arrays_zip(F.col("x.l_linenumber").alias("place"), F.col("x.l_partkey").alias("asked"), F.col("x.l_suppkey").alias("answered"))
    return row.select("batch", F.inline(both).alias("place", "asked", "answered"))


@query("jn_batch_edges", "SELECT DISTINCT source_asset_id, relationship_type, target_asset_id FROM v_relationships WHERE source_asset_id IN (SELECT id FROM v_assets WHERE scan_status = 'failed')")
def batch_edges(inv):
    """Edges that start at a member of the batch."""
    batch = inv.assets.where("scan_status = 'failed'").select(F.col("id").alias("source_asset_id"))
    return inv.relationships.join(batch, "source_asset_id", "left_semi").select("source_asset_id", "relationship_type", "target_asset_id")


# Aggregations


SBOM_SQL = "s AS (SELECT lower(c.name) AS package, coalesce(c.ecosystem, 'unknown') AS ecosystem, coalesce(c.package_manager, '') AS manager, c.version, c.id, u.asset_id, u.last_seen_at FROM v_usages u JOIN v_components c ON c.id = u.component_id WHERE u.source = 'repo_sbom')"


def packages(inv):
    """Component attributes beside (component, asset) pairs that are distinct already, with the latest sight."""
    pairs = inv.usages.where("source = 'repo_sbom'").groupBy("component_id", "asset_id").agg(F.max("last_seen_at").alias("last_seen_at"))
    named = inv.components.select(F.col("id").alias("component_id"), F.lower("name").alias("package"), F.coalesce("ecosystem", F.lit("unknown")).alias("ecosystem"), F.coalesce("package_manager", F.lit("")).alias("manager"), "version")
    return pairs.join(named, "component_id")


@query("agg_sbom_packages", f"WITH {SBOM_SQL} SELECT package, ecosystem, manager, count(DISTINCT version) AS versions, count(DISTINCT id) AS components, count(DISTINCT asset_id) AS assets FROM s GROUP BY package, ecosystem, manager")
def sbom_packages(inv):
    pairs = packages(inv)
    used = pairs.select("component_id", "package", "ecosystem", "manager", "version").distinct()
    rows = counted_apart(used, pairs.select("component_id", "asset_id"), ["package", "ecosystem", "manager"], "component_id", {"versions": "version", "components": "component_id"})
    return rows.withColumnRenamed("asset_count", "assets")


@query("agg_sbom_versions", f"WITH {SBOM_SQL} SELECT version, count(DISTINCT id) AS components, count(DISTINCT asset_id) AS assets, max(last_seen_at) AS last_seen_at FROM s WHERE package = 'cold widget' GROUP BY version")
def sbom_versions(inv, package: str = "cold widget"):
    return packages(inv).where(F.col("package") == package.lower()).groupBy("version").agg(F.countDistinct("component_id").alias("components"), F.countDistinct("asset_id").alias("assets"), F.max("last_seen_at").alias("last_seen_at"))


@query("agg_graph_nodes", "SELECT a.id, count(DISTINCT f.id) AS findings FROM v_assets a LEFT JOIN v_findings f ON f.affected_asset_id = a.id GROUP BY a.id")
def node_findings(inv):
    """Findings of every node, whatever their status."""
    return with_count(inv.assets, "id", counts_by(inv.findings, "affected_asset_id", "findings"), "affected_asset_id", "findings").select("id", "findings")


# Windows and orders


@query("win_keep_first_filedep", "SELECT batch, component_id, min(evidence_path) AS line FROM v_usages GROUP BY batch, component_id")
def first_per_file(inv):
    """The first line of each (file, dependency)."""
    return inv.usages.groupBy("batch", "component_id").agg(F.min("evidence_path").alias("line"))


@query("win_active_run", "SELECT affected_asset_id, arg_max(id, (last_seen_at, id)) AS run FROM v_findings WHERE status IN ('open', 'triaged') GROUP BY affected_asset_id")
def active_run(inv):
    """The latest run of each connector that has not ended."""
    return inv.findings.where(F.col("status").isin("open", "triaged")).groupBy("affected_asset_id").agg(F.max_by("id", F.struct("last_seen_at", "id")).alias("run"))


@query("win_severity_escalate", "SELECT doc_id, CASE WHEN contains(text, 'password') THEN 'critical' WHEN contains(text, 'token') THEN 'high' ELSE 'medium' END AS severity FROM documents WHERE contains(text, '=')", views=False)
def escalated(inv):
    """The first sub-pattern found raises the severity."""
    text = F.col("text")
    return inv.table("documents").where(text.contains("=")).select("doc_id", F.when(text.contains("password"), "critical").when(text.contains("token"), "high").otherwise("medium").alias("severity"))


@query("srt_assets", "SELECT id, row_number() OVER (ORDER BY last_seen_at DESC NULLS LAST, display_name) AS place FROM (SELECT a.id, a.display_name, (SELECT max(last_seen_at) FROM v_findings f WHERE f.affected_asset_id = a.id) AS last_seen_at FROM v_assets a) ORDER BY place LIMIT 200")
def ordered_assets(inv, most: int = 200):
    """One page, latest seen first, then by name."""
    seen = inv.findings.groupBy(F.col("affected_asset_id").alias("id")).agg(F.max("last_seen_at").alias("last_seen_at"))
    top = inv.assets.join(seen, "id", "left").orderBy(F.desc_nulls_last("last_seen_at"), "display_name").limit(most)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc_nulls_last("last_seen_at"), "display_name")).alias("place"))


@query("lim_graph", "SELECT id FROM v_assets ORDER BY asset_type, display_name LIMIT 500")
def graph_page(inv, limit: int | None = None):
    """Nodes of a graph: 500 unless asked otherwise, between 1 and 5,000."""
    return inv.assets.orderBy("asset_type", "display_name").limit(max(1, min(5000, limit or 500))).select("id")


# Merges


@query("ups_connector", "SELECT runner_id AS id, arg_max(job_type, (seen_at, id)) AS status, max(seen_at) AS last_sync_at FROM v_heartbeats GROUP BY runner_id")
def merged_connectors(inv):
    """A sync writes everything, the latest wins."""
    return merge_last(inv.heartbeats.select("runner_id", "seen_at", F.col("id").alias("n"), F.col("job_type").alias("status")), ["runner_id"], ["seen_at", "n"]).select(F.col("runner_id").alias("id"), "status", F.col("seen_at").alias("last_sync_at"))


@query("ups_connector_ui", "SELECT runner_id AS id, arg_max(value, (seen_at, id)) AS setting, max(seen_at) FILTER (job_type <> 'click') AS last_sync_at FROM v_heartbeats GROUP BY runner_id")
def edited_connectors(inv):
    """An edit (here a click) sets values but never the time of the last sync."""
    return inv.heartbeats.groupBy(F.col("runner_id").alias("id")).agg(F.max_by("value", F.struct("seen_at", "id")).alias("setting"), F.max(F.when(F.col("job_type") != "click", F.col("seen_at"))).alias("last_sync_at"))


@query("ups_component", "SELECT component_id, min(last_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, arg_max(layer, (last_seen_at, batch, evidence_path)) AS layer FROM v_usages GROUP BY component_id")
def merged_components(inv):
    rows = inv.usages.withColumn("first_seen_at", F.col("last_seen_at"))
    return merge_last(rows, ["component_id"], ["last_seen_at", "batch", "evidence_path"], first={"first_seen_at": "last_seen_at"}).select("component_id", "first_seen_at", "last_seen_at", "layer")


@query("ups_relationship", "SELECT asset_id, layer, arg_max(source, (last_seen_at, batch, evidence_path)) AS source FROM v_usages GROUP BY asset_id, layer")
def merged_relationships(inv):
    return merge_last(inv.usages, ["asset_id", "layer"], ["last_seen_at", "batch", "evidence_path"]).select("asset_id", "layer", "source")


@query("ups_setting", "SELECT job_type AS key, arg_max(value, (seen_at, id)) AS value FROM v_heartbeats GROUP BY job_type")
def merged_settings(inv):
    return merge_last(inv.heartbeats, ["job_type"], ["seen_at", "id"]).select(F.col("job_type").alias("key"), "value")


@query("ups_backfill", "SELECT id, coalesce(CASE WHEN scan_status <> 'failed' THEN scan_status END, CASE WHEN status = 'active' THEN 'scanned' ELSE 'discovered' END) AS scan_status FROM v_assets")
def backfilled(inv):
    """A missing scan status is derived once; a given one stays."""
    given = F.when(F.col("scan_status") != "failed", F.col("scan_status"))
    return inv.assets.select("id", F.coalesce(given, F.when(F.col("status") == "active", "scanned").otherwise("discovered")).alias("scan_status"))


# Queues


@query("str_enqueue_dedup", "SELECT runner_id, job_type, min(id) AS id FROM v_heartbeats GROUP BY runner_id, job_type")
def enqueued(inv):
    """A job waits once; the first request stays."""
    return inv.heartbeats.groupBy("runner_id", "job_type").agg(F.min("id").alias("id"))


@query("str_claim", "SELECT job_type, arg_min(id, (seen_at, id)) AS id FROM v_heartbeats GROUP BY job_type")
def claimed(inv):
    """The oldest waiting job of each kind."""
    return inv.heartbeats.groupBy("job_type").agg(F.min_by("id", F.struct("seen_at", "id")).alias("id"))


@query("str_fixed_window_counter", "SELECT runner_id, time_bucket(INTERVAL 1 MINUTE, seen_at) AS minute, count(*) AS n, count(*) > 1 AS over FROM v_heartbeats GROUP BY ALL")
def rate(inv, most: int = 1):
    """Requests of a client in fixed windows of a minute, and whether they pass the limit."""
    n = inv.heartbeats.groupBy("runner_id", F.date_trunc("minute", "seen_at").alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("runner_id", F.col("minute").cast("timestamp_ntz").alias("minute"), "n", (F.col("n") > most).alias("over"))


@query("str_heartbeat", "SELECT job_type, count(DISTINCT runner_id) AS runners, max(seen_at) AS last_seen_at FROM v_heartbeats GROUP BY job_type")
def pulses(inv):
    return inv.heartbeats.groupBy("job_type").agg(F.countDistinct("runner_id").alias("runners"), F.max("seen_at").alias("last_seen_at"))
