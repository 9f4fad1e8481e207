"""Queries that decode documents: bills of materials, scanner reports, advisories, references. Their input is made as JSON from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions.scalars import image_reference, normalize_severity, registry_type, safe_url, severity_rank, stable_id
from lodestack.operators import boms
from lodestack.plans.registry import query


def bom_documents(inv):
    """One wrapped document per order: its parts as components, and a vulnerability if its key is divisible by 3."""
    line = inv.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    part = inv.table("part").select("p_partkey", "p_name", "p_size", "p_type", "p_brand")
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    licence = lambda id=F.lit(None).cast("string"), name=F.lit(None).cast("string"): F.struct(F.struct(id.alias("id"), name.alias("name")).alias("license"))

    def component(x):
        number, path = x["p_partkey"].cast("string"), F.concat(F.lit("/srv/"), x["l_linenumber"].cast("string"))
        return F.struct(
            number.alias("bom-ref"), F.lit("library").alias("type"), x["p_name"].alias("name"), x["p_size"].cast("string").alias("version"),
            F.when(x["p_partkey"] % 2 == 0, F.concat(F.lit("pkg:npm/p"), number, F.lit("@1"))).alias("purl"),
            F.struct(x["p_brand"].alias("name")).alias("supplier"),
            F.array(licence(id=x["p_type"]), licence(name=F.lit("MIT"))).alias("licenses"),
            F.array(F.struct(F.lit("SHA-1").alias("alg"), F.sha1(number.cast("binary")).alias("content"))).alias("hashes"),
            F.array(pair("location", path), pair("package_manager", x["p_brand"])).alias("properties"),
        )

    # rows are gathered as they are and written out as components behind the shuffle
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.struct("p_partkey", "l_linenumber", "p_name", "p_size", "p_type", "p_brand").alias("r"))
    docs = rows.groupBy("l_orderkey").agg(F.collect_list("r").alias("rs")).select("l_orderkey", F.transform("rs", component).alias("components"), F.array_min(F.transform("rs", lambda x: x["p_partkey"])).cast("string").alias("ref"))
    flaw = F.struct(F.concat(F.lit("CVE-"), F.col("l_orderkey").cast("string")).alias("id"), F.array(F.struct(F.lit("Moderate").alias("severity"))).alias("ratings"), F.array(F.struct("ref")).alias("affects"))
    flaws = F.when(F.col("l_orderkey") % 3 == 0, F.array(flaw)).otherwise(F.slice(F.array(flaw), 1, 0))
    bom = F.struct(F.lit("CycloneDX").alias("bomFormat"), "components", flaws.alias("vulnerabilities"))
    return docs.select(F.col("l_orderkey").alias("batch"), F.when(F.col("l_orderkey") % 2 == 0, F.to_json(bom)).otherwise(F.to_json(F.struct(bom.alias("sbom")))).alias("doc"))


PARTS_SQL = "FROM lineitem JOIN part ON l_partkey = p_partkey"


@query("nrm_unwrap_cdx", "SELECT l_orderkey AS batch, count(*) AS n_components FROM lineitem GROUP BY l_orderkey", views=False)
def unwrapped(inv):
    return boms.parsed(bom_documents(inv)).select("batch", F.size("bom.components").cast("long").alias("n_components"))


@query("nrm_component_cdx", f"SELECT l_orderkey AS batch, CAST(p_partkey AS VARCHAR) AS ref, p_name AS name, CAST(p_size AS VARCHAR) AS version, CASE WHEN p_partkey % 2 = 0 THEN 'npm' ELSE 'library' END AS ecosystem, p_brand AS package_manager, p_brand AS supplier, p_type AS license {PARTS_SQL}", views=False)
def bom_components(inv):
    return boms.components(boms.parsed(bom_documents(inv))).select("batch", "ref", "name", "version", "ecosystem", "package_manager", "supplier", "license")


@query("nrm_usage_cdx", f"SELECT l_orderkey AS batch, CAST(p_partkey AS VARCHAR) AS ref, '/srv/' || l_linenumber AS evidence_path, p_brand AS usage_manager {PARTS_SQL}", views=False)
def bom_usages(inv):
    return boms.components(boms.parsed(bom_documents(inv))).select("batch", "ref", "evidence_path", "usage_manager")


@query("nrm_license_join", f"SELECT p_partkey AS id, count(*) AS n, p_type || ', MIT' AS licenses {PARTS_SQL} GROUP BY p_partkey, p_type", views=False)
def bom_licences(inv):
    return boms.components(boms.parsed(bom_documents(inv))).groupBy(F.col("ref").cast("long").alias("id"), "licenses").agg(F.count(F.lit(1)).alias("n"))


@query("nrm_hashes", "SELECT DISTINCT l_partkey AS id, sha1(CAST(l_partkey AS VARCHAR)) AS sha1 FROM lineitem", views=False)
def bom_hashes(inv):
    return boms.components(boms.parsed(bom_documents(inv))).select(F.col("ref").cast("long").alias("id"), F.col("hashes")["SHA-1"].alias("sha1")).distinct()


@query("nrm_findings_cdx", "SELECT l_orderkey AS batch, 'CVE-' || l_orderkey AS title, 'medium' AS severity, CAST(min(l_partkey) AS VARCHAR) AS component_ref FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey", views=False)
def bom_findings(inv):
    return boms.findings(boms.parsed(bom_documents(inv))).select("batch", "title", "severity", "component_ref")


@query("nrm_grype_matches", "SELECT l_orderkey AS batch, 'CVE-' || (l_partkey % 5) AS vulnerability_id, 'pkg:npm/p' || l_suppkey AS purl, 'info' AS severity, '1, 2' AS fixed_in FROM lineitem GROUP BY ALL", views=False)
def scanner_matches(inv):
    match = F.struct(
        F.struct(F.concat(F.lit("CVE-"), (F.col("l_partkey") % 5).cast("string")).alias("id"), F.lit("Unknown").alias("severity"), F.struct(F.array(F.lit("1"), F.lit("2")).alias("versions")).alias("fix")).alias("vulnerability"),
        F.struct(F.concat(F.lit("pkg:npm/p"), F.col("l_suppkey").cast("string")).alias("purl")).alias("artifact"),
    )
    reports = inv.table("lineitem").groupBy(F.col("l_orderkey").alias("batch")).agg(F.to_json(F.struct(F.collect_list(match).alias("matches"))).alias("report"))
    return boms.match_findings(reports, "batch")


@query("nrm_advisory", "SELECT 'MAL-' || p_partkey AS advisory_id, p_name AS package, 'pypi' AS ecosystem, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS versions, p_partkey % 4 = 1 AS all_versions FROM part WHERE p_partkey % 5 <> 0", views=False)
def advisories(inv):
    key = F.col("p_partkey")
    events = F.when(key % 4 == 1, F.lit('[{"introduced":"0"}]')).otherwise('[{"introduced":"0"},{"fixed":"9"}]')
    versions = F.when(key % 2 == 0, F.concat(F.lit('[" '), F.col("p_size").cast("string"), F.lit('",""]'))).otherwise("[]")
    text = F.format_string('{"id":"MAL-%d",%s"affected":[{"package":{"name":"%s","ecosystem":"PyPI:x"},"versions":%s,"ranges":[{"events":%s}]}]}', key, F.when(key % 5 == 0, '"withdrawn":"2024-01-01",').otherwise(""), "p_name", versions, events)
    specs = boms.advisory_specs(inv.table("part").select(text.alias("record")))
    return specs.withColumn("versions", F.array_join("versions", ","))


@query("nrm_severity_platform", "SELECT o_orderpriority AS given, CASE o_orderpriority WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'unknown' END AS platform, CASE o_orderpriority WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'info' END AS scanner, CASE o_orderpriority WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 2 ELSE 0 END AS rank, count(*) AS n FROM orders GROUP BY o_orderpriority", views=False)
def severities(inv):
    """Both normalizers: the inventory keeps unknown, scanners make it info."""
    named = F.upper(F.concat(F.lit(" "), F.substring("o_orderpriority", 3, 20), F.lit(" ")))
    platform = normalize_severity(named)
    rows = inv.table("orders").groupBy(F.col("o_orderpriority")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("o_orderpriority").alias("given"), platform.alias("platform"), normalize_severity(named, "info").alias("scanner"), severity_rank(platform).alias("rank"), "n")


@query("nrm_image_ref", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'docker.io' WHEN 1 THEN 'ghcr.io' ELSE 'localhost:5000' END AS registry, CASE p_partkey % 3 WHEN 0 THEN 'library/p' || p_partkey WHEN 1 THEN 'team/p' || p_partkey ELSE 'p' || p_partkey END AS repository, CASE p_partkey % 3 WHEN 0 THEN 'latest' WHEN 1 THEN CAST(p_size AS VARCHAR) END AS tag, CASE WHEN p_partkey % 3 = 2 THEN 'sha256:ab' || p_size END AS digest, CASE p_partkey % 3 WHEN 0 THEN 'dockerhub' WHEN 1 THEN 'ghcr' ELSE 'other' END AS kind FROM part", views=False)
def image_references(inv):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(key % 3 == 0, F.concat(F.lit("p"), key.cast("string"))).when(key % 3 == 1, F.concat(F.lit("ghcr.io/team/p"), key.cast("string"), F.lit(":"), size)).otherwise(F.concat(F.lit("localhost:5000/p"), key.cast("string"), F.lit("@sha256:ab"), size))
    return inv.table("part").select(key.alias("id"), image_reference(text).alias("r")).select("id", "r.*", registry_type(F.col("r.registry")).alias("kind"))


@query("nrm_safe_url", "SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN url ELSE '' END AS url FROM pages", views=False)
def safe_urls(inv):
    return inv.table("pages").select("page_id", safe_url(F.col("url")).alias("url"))


@query("nrm_parse_iso", "SELECT event_id AS id, ts AS seen_at FROM events", views=False)
def parsed_times(inv):
    """Times written with nine digits of a second and a Z; text that is no time gives null."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z"))
    short = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    return inv.table("events").select(F.col("event_id").alias("id"), F.try_to_timestamp(short).cast("timestamp_ntz").alias("seen_at"))


@query("nrm_stable_id", """SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uid
FROM (SELECT id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('lodestack:component:' || coalesce(name, '') || ':' || coalesce(version, ''))) AS h FROM v_components)""")
def stable_ids(inv):
    """Name-based identities; their equality with uuid5 is tested."""
    return inv.components.select("id", stable_id("component", F.col("name"), F.col("version")).alias("uid"))
