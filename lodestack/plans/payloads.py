"""Queries over ingest payloads. Their input is made as JSON from orders, line items and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions.scalars import ecosystem_name, first_value, osv_ecosystem
from lodestack.operators import boms, clusters, payloads
from lodestack.plans.clusters import BASE, each
from lodestack.plans.registry import query


def endpoint_docs(inv):
    """One batch per order: its parts as packages, and a vulnerability for each whose key is divisible by 5."""
    k, text = F.col("l_orderkey"), lambda p, c: F.concat(F.lit(p), c.cast("string"))

    def package(x):
        pk = x["l_partkey"]
        return F.struct(
            text("p", pk).alias("name"), F.lit("1").alias("version"), F.when(pk % 2 == 0, text("pkg:npm/p", pk)).alias("purl"), F.when(pk % 4 == 1, text("key", pk)).alias("key"), F.lit("npm").alias("type"),
            F.when(pk % 3 == 0, "js").alias("language"), F.array(F.lit("MIT"), text("L", pk % 2)).alias("licenses"), F.array(text("/srv/", x["l_linenumber"])).alias("locations"),
        )

    def flaw(x):
        pk = x["l_partkey"]
        return F.struct(text("CVE-", pk).alias("id"), text("p", pk).alias("name"), F.lit("1").alias("version"), F.when(pk % 2 == 0, text("pkg:npm/p", pk)).otherwise(text("pkg:gem/v", pk)).alias("purl"), F.lit("Moderate").alias("severity"), F.when(pk % 3 == 0, "2").alias("fix"))

    # rows are gathered as they are and written out as packages behind the shuffle
    rows = inv.table("lineitem").groupBy(k.alias("batch")).agg(F.collect_list(F.struct("l_partkey", "l_linenumber")).alias("rs"))
    flawed = F.filter("rs", lambda x: x["l_partkey"] % 5 == 0)
    rows = rows.select("batch", F.transform("rs", package).alias("packages"), F.transform(flawed, flaw).alias("vulnerabilities"))
    b = F.col("batch")
    host = F.struct(F.when(b % 2 == 0, text("e", b)).alias("id"), F.when(b % 3 != 0, text("h", b)).alias("hostname"), F.lit("linux").alias("os"))
    return rows.select("batch", F.to_json(F.struct(host.alias("endpoint"), F.struct(F.lit("syft").alias("name"), F.lit("1.0").alias("version")).alias("scanner"), "packages", "vulnerabilities")).alias("doc"))


REF = "CASE WHEN l_partkey % 2 = 0 THEN 'pkg:npm/p' || l_partkey WHEN l_partkey % 4 = 1 THEN 'key' || l_partkey ELSE 'npm:p' || l_partkey || ':1' END"
MANAGER = "CASE WHEN l_partkey % 3 = 0 THEN 'js' ELSE 'npm' END"


@query("src_endpoint_batch", """SELECT o.l_orderkey AS batch, 'endpoint:' || e AS external_id, h AS display_name FROM (SELECT DISTINCT l_orderkey FROM lineitem) o,
LATERAL (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'e' || l_orderkey WHEN l_orderkey % 3 <> 0 THEN 'h' || l_orderkey ELSE 'unknown-endpoint' END AS e) x, LATERAL (SELECT CASE WHEN l_orderkey % 3 <> 0 THEN 'h' || l_orderkey ELSE e END AS h) y""", views=False)
def endpoint_assets(inv):
    return payloads.endpoint_assets(payloads.batches(endpoint_docs(inv))).select("batch", "external_id", "display_name")


@query("nrm_endpoint_batch", f"""SELECT DISTINCT l_orderkey AS batch, {REF} AS ref, 'p' || l_partkey AS name, '1' AS version, 'npm' AS ecosystem, {MANAGER} AS package_manager, CASE WHEN l_partkey % 2 = 0 THEN 'pkg:npm/p' || l_partkey ELSE '' END AS purl, 'MIT, L' || (l_partkey % 2) AS license FROM lineitem
UNION SELECT l_orderkey, 'pkg:gem/v' || l_partkey, 'p' || l_partkey, '1', 'gem', 'gem', 'pkg:gem/v' || l_partkey, '' FROM lineitem WHERE l_partkey % 5 = 0 AND l_partkey % 2 = 1""", views=False)
def endpoint_components(inv):
    return payloads.endpoint_components(payloads.batches(endpoint_docs(inv)))


@query("nrm_syft_endpoint", f"SELECT l_orderkey AS batch, {REF} AS component_ref, 'endpoint_scan' AS source, '/srv/' || l_linenumber AS evidence_path, {MANAGER} AS package_manager FROM lineitem", views=False)
def endpoint_usages(inv):
    return payloads.endpoint_usages(payloads.batches(endpoint_docs(inv)))


FLAW = "CASE WHEN l_partkey % 2 = 0 THEN 'pkg:npm/p' ELSE 'pkg:gem/v' END || l_partkey"


@query("nrm_image_findings", f"SELECT l_orderkey AS batch, {FLAW} AS component_ref, 'cve' AS finding_type, 'medium' AS severity, 'CVE-' || l_partkey AS title, 'CVE-' || l_partkey || ' affects p' || l_partkey || ' 1' AS description, CASE WHEN l_partkey % 3 = 0 THEN 'Upgrade p' || l_partkey || ' to 2' ELSE '' END AS fix_recommendation FROM lineitem WHERE l_partkey % 5 = 0", views=False)
def endpoint_findings(inv):
    return payloads.endpoint_findings(payloads.batches(endpoint_docs(inv)))


@query("nrm_flatten_report", "SELECT l_orderkey AS batch, 'CVE-' || l_partkey AS id, 'medium' AS severity, 'p' || l_partkey AS package, '1' AS version FROM lineitem WHERE l_partkey % 5 = 0", views=False)
def flat_report(inv):
    parsed = payloads.batches(endpoint_docs(inv))
    return payloads.flat_vulnerabilities(payloads.endpoint_findings(parsed).withColumn("component_ref", F.concat("component_ref", F.lit("?arch=x"))), payloads.endpoint_components(parsed), "batch")


@query("nrm_grype_endpoint", "SELECT DISTINCT l_orderkey AS batch, 'CVE-' || (l_partkey % 5) AS id, '' AS purl, 'p' || l_suppkey AS name, '1' AS version, 'Unknown' AS severity, '1,2' AS fix FROM lineitem", views=False)
def endpoint_vulnerabilities(inv):
    match = F.struct(
        F.struct(F.concat(F.lit("CVE-"), (F.col("l_partkey") % 5).cast("string")).alias("id"), F.struct(F.array(F.lit("1"), F.lit("2")).alias("versions")).alias("fix")).alias("vulnerability"),
        F.struct(F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("name"), F.lit("1").alias("version")).alias("artifact"),
    )
    reports = inv.table("lineitem").groupBy(F.col("l_orderkey").alias("batch")).agg(F.to_json(F.struct(F.collect_list(match).alias("matches"))).alias("report"))
    return payloads.minimal_vulnerabilities(reports, "batch")


def subject_docs(inv):
    """Bills of materials of parts: the subject has a purl, an id property or a name alone; odd keys are wrapped with an asset."""
    k = F.col("p_partkey")
    text = lambda p: F.concat(F.lit(p), k.cast("string"))
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    props = F.array(pair("asset_id", F.lit("first")), pair("lodestack:details.team", text("t")), pair("other", F.lit("x")), pair("asset_id", F.when(k % 3 == 0, text("id")).otherwise(F.lit(""))))
    subject = F.struct(F.col("p_name").alias("name"), F.when(k % 3 == 1, text("pkg:npm/p")).alias("purl"), props.alias("properties"))
    bom = F.struct(F.lit("CycloneDX").alias("bomFormat"), text("s").alias("serialNumber"), F.struct(subject.alias("component")).alias("metadata"))
    given = F.struct(F.when(k % 5 == 0, text("given")).alias("external_id"), F.lit("me").alias("owner"), F.create_map(F.lit("team"), F.lit("old"), F.lit("room"), F.lit("1")).alias("details"))
    wrapped = F.to_json(F.struct(bom.alias("bom"), given.alias("asset"), F.lit("prod").alias("environment")))
    return inv.table("part").select(k.alias("id"), F.when(k % 2 == 1, wrapped).otherwise(F.to_json(bom)).alias("doc"))


@query("nrm_asset_cdx", """SELECT p_partkey AS id, 'repository' AS asset_type, 'git' AS provider,
  CASE WHEN p_partkey % 2 = 1 AND p_partkey % 5 = 0 THEN 'given' || p_partkey WHEN p_partkey % 3 = 0 THEN 'id' || p_partkey WHEN p_partkey % 3 = 1 THEN 'pkg:npm/p' || p_partkey ELSE p_name END AS external_id,
  p_name AS display_name, CASE WHEN p_partkey % 2 = 1 THEN 'me' ELSE '' END AS owner, CASE WHEN p_partkey % 2 = 1 THEN 'prod' ELSE '' END AS environment, 'active' AS status, '' AS tags,
  't' || p_partkey AS team, CASE WHEN p_partkey % 2 = 1 THEN '1' END AS room FROM part""", views=False)
def described_assets(inv):
    got = payloads.bom_asset(subject_docs(inv), "git", "repository")
    return got.withColumns({"team": F.try_element_at("details", F.lit("team")), "room": F.try_element_at("details", F.lit("room"))}).drop("details")


@query("nrm_props", "SELECT p_partkey AS id, CAST(3 AS INTEGER) AS n, CASE WHEN p_partkey % 3 = 0 THEN 'id' || p_partkey ELSE '' END AS asset_id FROM part", views=False)
def subject_properties(inv):
    props = payloads.properties_map(F.from_json(F.coalesce(F.get_json_object("doc", "$.metadata.component.properties"), F.get_json_object("doc", "$.bom.metadata.component.properties")), "array<struct<name:string,value:string>>"))
    return subject_docs(inv).select("id", F.size(props).alias("n"), props["asset_id"].alias("asset_id"))


@query("nrm_first_value", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE 'none' END AS v FROM part", views=False)
def first_values(inv):
    k = F.col("p_partkey")
    return inv.table("part").select(k.alias("id"), first_value(F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, ""), F.when(k % 3 == 1, F.col("p_size")), default="none").alias("v"))


@query("nrm_cpe", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 2 THEN '' ELSE 'cpe:' || p_partkey END AS cpe FROM part", views=False)
def first_cpes(inv):
    k, c = F.col("p_partkey"), F.concat(F.lit("cpe:"), F.col("p_partkey").cast("string"))
    return inv.table("part").select(k.alias("id"), boms.cpe(F.when(k % 3 == 0, c).when(k % 3 == 1, F.to_json(F.array(F.lit(""), c, F.lit("z"))))).alias("cpe"))


@query("nrm_ecosystem_canon", "SELECT p_partkey AS id, ['pypi', 'golang', 'gem', 'debian', '', 'swift', 'cargo'][p_partkey % 7 + 1] AS name, ['PyPI', 'Go', 'RubyGems', '', '', '', 'crates.io'][p_partkey % 7 + 1] AS label FROM part", views=False)
def ecosystems(inv):
    given = F.get(F.array(*map(F.lit, ("PyPI", " go", "RubyGems:x", "Debian:11", "", "SwiftURL", "crates.io"))), (F.col("p_partkey") % 7).cast("int"))
    return inv.table("part").select(F.col("p_partkey").alias("id"), ecosystem_name(given).alias("name"), osv_ecosystem(given).alias("label"))


FOUND_SQL = """
fs AS (SELECT l_orderkey AS k, l_linenumber AS pos, CASE l_linenumber % 3 WHEN 0 THEN 'cicd_tool' WHEN 1 THEN 'mcp_server' ELSE 'cdn' END AS category,
  CASE l_linenumber % 3 WHEN 0 THEN 'acme/act' || (l_suppkey % 3) || '@v1' WHEN 1 THEN 'tool ' || (l_suppkey % 3) ELSE 'https://x/' || (l_suppkey % 3) END AS dep FROM lineitem),
cs AS (SELECT *, CASE l WHEN 0 THEN 'pkg:githubactions/' || dep WHEN 1 THEN 'pkg:generic/' || replace(dep, ' ', '-') ELSE 'pkg:generic/' || replace(replace(dep, '/', '%2F'), ':', '%3A') END AS ref,
  CASE l WHEN 0 THEN split_part(dep, '@', 1) ELSE dep END AS name, CASE l WHEN 0 THEN 'v1' ELSE '' END AS version, CASE l WHEN 0 THEN 'githubactions' WHEN 1 THEN 'npm' ELSE 'generic' END AS ecosystem FROM (SELECT *, pos % 3 AS l FROM fs))
"""


def found(inv):
    k, s = F.col("l_linenumber") % 3, (F.col("l_suppkey") % 3).cast("string")
    category = F.when(k == 0, "cicd_tool").when(k == 1, "mcp_server").otherwise("cdn")
    dep = F.when(k == 0, F.concat(F.lit("acme/act"), s, F.lit("@v1"))).when(k == 1, F.concat(F.lit("tool "), s)).otherwise(F.concat(F.lit("https://x/"), s))
    return inv.table("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("at"), category.alias("category"), dep.alias("dependency"))


@query("nrm_repo_component", f"WITH {FOUND_SQL} SELECT k, pos AS n, ref, name, version, ecosystem, ref AS purl FROM cs", views=False)
def repository_component(inv):
    return found(inv).select("k", F.col("at").alias("n"), payloads.repository_component(F.col("category"), F.col("dependency")).alias("c")).select("k", "n", "c.*")


@query("nrm_repo_payload", f"""WITH {FOUND_SQL} SELECT k, ref, any_value(name) AS name, any_value(version) AS version, any_value(ecosystem) AS ecosystem, ref AS purl, true AS phantom FROM cs GROUP BY k, ref
UNION ALL SELECT DISTINCT l_orderkey, 'pkg:npm/p' || l_partkey, 'p' || l_partkey, '1', 'npm', 'pkg:npm/p' || l_partkey, false FROM lineitem
UNION ALL SELECT DISTINCT l_orderkey, 'pkg:generic/tool-0', 'declared', '', 'npm', 'pkg:generic/tool-0', false FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.k = l.l_orderkey AND cs.ref = 'pkg:generic/tool-0')""", views=False)
def repository_payload(inv):
    number = F.col("l_partkey").cast("string")
    ref = F.concat(F.lit("pkg:npm/p"), number)
    own = F.struct(ref.alias("ref"), F.concat(F.lit("p"), number).alias("name"), F.lit("1").alias("version"), F.lit("npm").alias("ecosystem"), ref.alias("purl"))
    same = F.lit("pkg:generic/tool-0")
    shared = F.struct(same.alias("ref"), F.lit("declared").alias("name"), F.lit("").alias("version"), F.lit("npm").alias("ecosystem"), same.alias("purl"))
    declared = inv.table("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("at"), F.explode(F.array(own, shared)).alias("c")).select("k", "at", "c.*")
    return payloads.repository_components(found(inv), declared, ["k"])


IMAGE = "registry || '/' || repository || CASE WHEN digest <> '' THEN '@' || digest WHEN tag <> '' THEN ':' || tag ELSE '' END"
PROVIDER = "CASE registry WHEN 'docker.io' THEN 'dockerhub' WHEN 'ghcr.io' THEN 'ghcr' WHEN 'quay.io' THEN 'quay' ELSE 'other' END"


@query("nrm_image_payload", f"WITH {BASE} SELECT DISTINCT {PROVIDER} AS provider, {IMAGE} AS external_id, repository || CASE WHEN tag <> '' THEN ':' || tag ELSE '' END || CASE WHEN digest <> '' THEN '@' || digest[1:19] ELSE '' END AS display_name, 'scanned' AS scan_status FROM xs", views=False)
def image_payload(inv):
    return payloads.image_assets(each(inv).select("registry", "repository", "tag", "digest").distinct()).select("provider", "external_id", "display_name", "scan_status")


@query("nrm_image_discovery", f"WITH {BASE} SELECT DISTINCT {IMAGE} AS external_id, 'discovered' AS scan_status FROM xs", views=False)
def image_discovery(inv):
    return payloads.image_assets(each(inv).select("registry", "repository", "tag", "digest").distinct(), discovery=True).select("external_id", "scan_status")


@query("nrm_align_identity", f"""WITH {BASE} SELECT 'cluster:c1' AS ref, 'k8s_cluster' AS asset_type, 'kubernetes' AS provider, 'c1' AS external_id UNION ALL SELECT 'wl:' || external, 'k8s_workload', 'kubernetes', external FROM xs
UNION ALL SELECT DISTINCT 'img:' || reference, 'container_image', {PROVIDER}, {IMAGE} FROM xs""", views=False)
def aligned_assets(inv):
    return payloads.aligned(clusters.assets(each(inv)))


@query("nrm_run_decode", "SELECT o_orderkey AS id, o_orderpriority AS runner_id, CASE o_orderkey % 4 WHEN 0 THEN 'own' WHEN 1 THEN 'configured' WHEN 2 THEN 'after:colon' END AS source_type FROM orders", views=False)
def decoded_runs(inv):
    k = F.col("o_orderkey")
    rows = inv.table("orders").select(k.alias("id"), F.col("o_orderpriority").alias("claimed_by"), F.col("o_orderdate").alias("claimed_at"), F.when(k % 4 == 0, "own").alias("source_type"), F.when(k % 4 <= 1, '{"source_type":"configured"}').alias("connector_config"), F.when(k % 4 != 3, "sync:after:colon").alias("connector_type"))
    return payloads.decoded_runs(rows).select("id", "runner_id", "source_type")


@query("nrm_alert_decode", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size || ',' || p_name ELSE '' END AS versions FROM part", views=False)
def decoded_alerts(inv):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.to_json(F.array(F.col("p_size").cast("string"), "p_name"))).when(k % 3 == 1, "not json")
    return payloads.decoded_alerts(inv.table("part").select(k.alias("id"), text.alias("versions")), ("versions",)).withColumn("versions", F.array_join("versions", ","))


@query("flt_secret_like", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'connection.auth.api_key,connection.password' WHEN 1 THEN 'connection.deep.er.Token' ELSE '' END AS paths FROM part", views=False)
def secret_fields(inv):
    k = F.col("p_partkey")
    config = F.when(k % 3 == 0, '{"password":"x","auth":{"api_key":"y","user":"z"}}').when(k % 3 == 1, '{"deep":{"er":{"Token":1}},"auth":{"token":"t"}}').otherwise('{"url":"x"}')
    return inv.table("part").select(k.alias("id"), F.array_join(payloads.secret_fields(config, allowed=("connection.auth.token",)), ",").alias("paths"))
