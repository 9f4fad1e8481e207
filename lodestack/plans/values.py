"""Queries over scalar expressions by family, and over single decoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions.scalars import any_glob, contains_any, first_value, image_reference, normalize_severity, percent_encoded, purl_ecosystem, registry_type, severity_order, severity_rank
from lodestack.operators import boms
from lodestack.operators.relational import counts_by, with_count
from lodestack.plans.decoding import PARTS_SQL, bom_documents
from lodestack.plans.registry import query

def key():
    return F.col("p_partkey")


def parts(inv, *columns):
    return inv.table("part").select(key().alias("id"), *columns)


@query("string", "SELECT p_partkey AS id, lower(p_name) AS low, p_name ILIKE '%ring%' AS found, coalesce(nullif(p_type, ''), 'none') || '/' || p_name AS joined, trim('  ' || p_name || ' ') AS bare, split_part(p_name, ' ', 1) AS head, starts_with(p_name, 'b') AS starts, substr(p_name, 1, 5) AS cut FROM part", views=False)
def strings(inv):
    name = F.col("p_name")
    return parts(inv, F.lower(name).alias("low"), contains_any("ring", name).alias("found"), F.concat(first_value(F.col("p_type"), default="none"), F.lit("/"), name).alias("joined"), F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("bare"), F.split_part(name, F.lit(" "), F.lit(1)).alias("head"), name.startswith("b").alias("starts"), F.substring(name, 1, 5).alias("cut"))


@query("regex", r"SELECT page_id AS id, regexp_matches(url, '^https?://') AS web, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, CAST(len(regexp_extract_all(url, '[0-9]+')) AS INTEGER) AS n, regexp_replace(url, '^([a-z]+)://([^/]+)', '\2 by \1') AS turned FROM pages", views=False)
def patterns(inv):
    url = F.col("url")
    return inv.table("pages").select(F.col("page_id").alias("id"), url.rlike("^https?://").alias("web"), F.regexp_extract(url, "^[a-z]+://(?<host>[^/]+)", 1).alias("host"), F.size(F.regexp_extract_all(url, F.lit("[0-9]+"), F.lit(0))).alias("n"), F.regexp_replace(url, "^([a-z]+)://([^/]+)", "$2 by $1").alias("turned"))


@query("glob", "SELECT p_partkey AS id, regexp_matches(p_name, '^[a-m]') AS early, regexp_matches(p_name, '^[^a-m]') AS late, regexp_matches(p_name, '^.[aeiou].*g$') AS shaped FROM part", views=False)
def globs(inv):
    name = F.col("p_name")
    return parts(inv, any_glob(name, ["[a-m]*"]).alias("early"), any_glob(name, ["[!a-m]*"]).alias("late"), any_glob(name, ["?[aeiou]*g", "no*such"]).alias("shaped"))


@query("url", "SELECT p_partkey AS id, url_encode(p_name || '/+*~é') AS slug, 'h' || p_partkey AS host, 'https' AS scheme FROM part", views=False)
def urls(inv):
    link = F.concat(F.lit("https://h"), key().cast("string"), F.lit("/x?y=1"))
    return parts(inv, percent_encoded(F.concat("p_name", F.lit("/+*~é"))).alias("slug"), F.try_parse_url(link, F.lit("HOST")).alias("host"), F.try_parse_url(link, F.lit("PROTOCOL")).alias("scheme"))


@query("hash", "SELECT p_partkey AS id, sha256(p_name) AS sha256, sha1(p_name) AS sha1, md5(p_name) AS md5, sha256(unhex(sha256(p_name))) AS twice FROM part", views=False)
def digests(inv):
    return parts(inv, F.sha2("p_name", 256).alias("sha256"), F.sha1("p_name").alias("sha1"), F.md5("p_name").alias("md5"), F.sha2(F.unhex(F.sha2("p_name", 256)), 256).alias("twice"))


@query("date", "SELECT event_id AS id, date_trunc('second', ts) AS whole, ts - INTERVAL 30 MINUTE AS before, ts + INTERVAL 90 SECOND AS after, CAST(date_diff('day', CAST(ts AS DATE), DATE '2030-01-01') AS INTEGER) AS age, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS written FROM events", views=False)
def dates(inv):
    ts = F.col("ts").cast("timestamp_ntz")
    second = F.date_trunc("second", F.col("ts"))
    return inv.table("events").select(F.col("event_id").alias("id"), second.cast("timestamp_ntz").alias("whole"), (ts - F.expr("interval 30 minutes")).alias("before"), (ts + F.expr("interval 90 seconds")).alias("after"), F.datediff(F.lit("2030-01-01").cast("date"), ts.cast("date")).alias("age"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("written"))


@query("math", "SELECT p_brand AS brand, CAST(sum(p_size) AS BIGINT) AS total, max(least(greatest(p_size, 10), 40)) AS clamped, CAST(sum(p_size // 7) AS BIGINT) AS sevens, round(100.0 * count(*) FILTER (p_size > 25) / count(*), 1) AS share, arg_max(p_partkey, p_size * 1000000 + p_partkey) AS largest FROM part GROUP BY p_brand", views=False)
def sums(inv):
    size = F.col("p_size")
    share = F.round(F.lit(100.0) * F.count(F.when(size > 25, 1)) / F.count(F.lit(1)), 1)
    return inv.table("part").groupBy(F.col("p_brand").alias("brand")).agg(F.sum(size).cast("long").alias("total"), F.max(F.least(F.greatest(size, F.lit(10)), F.lit(40))).alias("clamped"), F.sum(F.floor(size / 7)).cast("long").alias("sevens"), share.alias("share"), F.max_by(key(), size.cast("long") * 1000000 + key()).alias("largest"))


@query("array", """SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(w)), ',') AS words, CAST(len(w) AS INTEGER) AS n, array_to_string(w[1:2], ',') AS two, CAST(coalesce(list_position(w, w[2]), 0) AS INTEGER) AS place, len(list_filter(w, lambda x: x LIKE 'b%')) > 0 AS some, len(list_filter(w, lambda x: length(x) <= 3)) = 0 AS every
FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""", views=False)
def arrays(inv):
    w = F.split("p_name", " ")
    return parts(inv, F.array_join(F.sort_array(F.array_distinct(w)), ",").alias("words"), F.size(w).alias("n"), F.array_join(F.slice(w, 1, 2), ",").alias("two"), F.coalesce(F.array_position(w, F.get(w, F.lit(1))), F.lit(0)).cast("int").alias("place"), F.exists(w, lambda x: x.startswith("b")).alias("some"), F.forall(w, lambda x: F.length(x) > 3).alias("every"))


@query("map", "SELECT p_partkey AS id, p_brand AS a, 'none' AS b, 'a,c' AS names, CASE WHEN p_size > 25 THEN 'x.a' ELSE 'x.c' END AS turned FROM part", views=False)
def maps(inv):
    own = F.create_map(F.lit("x.a"), F.col("p_brand"), F.lit("x.c"), F.lit("1"), F.lit("y"), F.lit("2"))
    inner = F.transform_keys(F.map_filter(own, lambda k, _: k.startswith("x.")), lambda k, _: F.substring(k, 3, 100))
    turned = F.map_from_arrays(F.map_values(own), F.map_keys(own))
    wanted = F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("1")
    return parts(inv, F.try_element_at(inner, F.lit("a")).alias("a"), F.coalesce(F.try_element_at(inner, F.lit("b")), F.lit("none")).alias("b"), F.array_join(F.sort_array(F.map_keys(inner)), ",").alias("names"), F.try_element_at(turned, wanted).alias("turned"))


@query("json", """SELECT p_partkey AS id, '{"a":' || p_size || ',"b":"' || p_brand || '"}' AS written, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS a, p_partkey % 2 = 0 AS valid FROM part""", views=False)
def jsons(inv):
    """Keys in order when written; text that is no JSON reads as null; comments are allowed."""
    written = F.to_json(F.struct(F.col("p_size").alias("a"), F.col("p_brand").alias("b")))
    given = F.when(key() % 2 == 0, F.concat(F.lit("/* odd */ "), written)).otherwise("{a")
    read = F.from_json(given, "a int, b string", {"allowComments": "true"})
    return parts(inv, written.alias("written"), read["a"].alias("a"), read["a"].isNotNull().alias("valid"))


@query("conditional", "SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'critical' WHEN p_size > 20 THEN 'medium' ELSE 'other' END AS grade, CASE WHEN p_size > 40 THEN 1 WHEN p_size > 20 THEN 3 ELSE 5 END AS place FROM part", views=False)
def conditions(inv):
    grade = F.when(F.col("p_size") > 40, "critical").when(F.col("p_size") > 20, "medium").otherwise("other")
    return parts(inv, grade.alias("grade"), severity_order(grade).alias("place"))


# Decoders one by one.


@query("nrm_prop_first", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS v, '' AS missing FROM part", views=False)
def first_properties(inv):
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    props = F.array(pair("a", F.lit("early")), pair("b", F.col("p_type")), pair("a", F.when(key() % 2 == 0, F.col("p_brand")).otherwise("")))
    return parts(inv, boms.property_value(props, "a", "b").alias("v"), boms.property_value(props, "c").alias("missing"))


@query("nrm_ecosystem_purl", "SELECT p_partkey AS id, ['npm', 'PyPI', 'given'][p_partkey % 3 + 1] AS eco, ['npm', 'pypi', 'given'][p_partkey % 3 + 1] AS low FROM part", views=False)
def purl_ecosystems(inv):
    purl = F.when(key() % 3 == 0, "pkg:npm/a@1").when(key() % 3 == 1, "pkg:PyPI/b").otherwise("b")
    eco = purl_ecosystem(purl, F.lit("given"))
    return parts(inv, eco.alias("eco"), F.lower(eco).alias("low"))


@query("nrm_license_first", "SELECT p_partkey AS id, ['MIT', 'Own', 'plain', ''][p_partkey % 4 + 1] AS licence FROM part", views=False)
def first_licences(inv):
    given = F.when(key() % 4 == 0, '{"license":{"id":"MIT","name":"x"}}').when(key() % 4 == 1, '{"license":{"name":"Own"}}').when(key() % 4 == 2, "plain")
    return parts(inv, boms.licence(F.when(given.isNotNull(), F.array(given, F.lit("Later")))).alias("licence"))


@query("nrm_supplier", "SELECT p_partkey AS id, ['N', 'https://u', 'text', ''][p_partkey % 4 + 1] AS supplier FROM part", views=False)
def suppliers(inv):
    given = F.when(key() % 4 == 0, '{"name":"N","url":"x"}').when(key() % 4 == 1, '{"url":"https://u"}').when(key() % 4 == 2, "text")
    return parts(inv, boms.supplier(given).alias("supplier"))


def grades():
    return F.get(F.array(*map(F.lit, (" Critical", "MODERATE", "negligible", "", "weird"))), (key() % 5).cast("int"))


@query("nrm_severity_scanner", "SELECT p_partkey AS id, ['critical', 'medium', 'low', 'info', 'info'][p_partkey % 5 + 1] AS severity FROM part", views=False)
def scanner_severities(inv):
    return parts(inv, normalize_severity(grades(), "info").alias("severity"))


@query("nrm_severity_rank", "SELECT p_partkey AS id, [5, 3, 2, 1, 0][p_partkey % 5 + 1] AS rank FROM part", views=False)
def severity_ranks(inv):
    return parts(inv, severity_rank(normalize_severity(grades())).alias("rank"))


@query("nrm_registry_type", "SELECT p_partkey AS id, ['ecr', 'ghcr', 'dockerhub', 'quay', 'gcr', 'acr', 'other'][p_partkey % 7 + 1] AS kind FROM part", views=False)
def registry_types(inv):
    hosts = ("1.dkr.ecr.eu-west-1.amazonaws.com", "ghcr.io", "docker.io", "quay.io", "eu.gcr.io", "x.azurecr.io", "localhost:5000")
    return parts(inv, registry_type(F.get(F.array(*map(F.lit, hosts)), (key() % 7).cast("int"))).alias("kind"))


@query("nrm_image_ref_split", "SELECT p_partkey AS id, 'p' || p_partkey AS repository, CASE p_partkey % 3 WHEN 0 THEN 'latest' WHEN 1 THEN 'v' || p_size END AS tag, CASE p_partkey % 3 WHEN 2 THEN 'sha256:ab' || p_size END AS digest FROM part", views=False)
def split_references(inv):
    """Without the default folder of the hub."""
    size = F.col("p_size").cast("string")
    tail = F.when(key() % 3 == 0, "").when(key() % 3 == 1, F.concat(F.lit(":v"), size)).otherwise(F.concat(F.lit("@sha256:ab"), size))
    r = image_reference(F.concat(F.lit("p"), key().cast("string"), tail), library=False)
    return parts(inv, r["repository"].alias("repository"), r["tag"].alias("tag"), r["digest"].alias("digest"))


@query("nrm_sbom_components", f"SELECT l_orderkey AS batch, CAST(p_partkey AS VARCHAR) AS ref, p_name AS name, CAST(p_size AS VARCHAR) AS version {PARTS_SQL}", views=False)
def repository_components(inv):
    return boms.components(boms.parsed(bom_documents(inv))).select("batch", "ref", "name", "version")


@query("nrm_sbom_findings", "SELECT l_orderkey AS batch, CAST(min(l_partkey) AS VARCHAR) AS component_ref, 'CVE-' || l_orderkey AS title, 'medium' AS severity FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey", views=False)
def repository_findings(inv):
    return boms.findings(boms.parsed(bom_documents(inv))).select("batch", "component_ref", "title", "severity")


@query("nrm_image_components", f"SELECT l_orderkey AS batch, p_name AS name, CAST(p_size AS VARCHAR) AS version, p_type AS license, '/srv/' || l_linenumber AS evidence_path {PARTS_SQL}", views=False)
def image_components(inv):
    return boms.components(boms.parsed(bom_documents(inv))).select("batch", "name", "version", "license", "evidence_path")


@query("nrm_cdx_payload", f"SELECT l_orderkey AS batch, count(*) AS n_components, CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n_findings {PARTS_SQL} GROUP BY l_orderkey", views=False)
def bom_payload(inv):
    """Counts of what one document gives, from one reading of it."""
    rows = boms.counts(boms.parsed(bom_documents(inv))).groupBy("batch").agg(F.sum("n_components").alias("n_components"), F.sum("n_findings").cast("int").alias("n_findings"))
    return rows.where("n_components > 0")


@query("agg_vuln_rows", "SELECT c.id, c.name, count(DISTINCT u.asset_id) AS target_count FROM v_components c LEFT JOIN v_usages u ON u.component_id = c.id GROUP BY c.id, c.name")
def targets(inv):
    return with_count(inv.components, "id", counts_by(inv.usages, "component_id", "target_count", distinct="asset_id"), "component_id", "target_count").select("id", "name", "target_count")


@query("srt_components", "SELECT c.id, row_number() OVER (ORDER BY coalesce(u.n, 0) DESC, c.name, c.id) AS place FROM v_components c LEFT JOIN (SELECT component_id, count(DISTINCT asset_id) AS n FROM v_usages GROUP BY component_id) u ON u.component_id = c.id ORDER BY place LIMIT 100")
def most_used(inv):
    """The first 100 of the list, numbered after the limit, so the window sees those alone."""
    rows = with_count(inv.components, "id", counts_by(inv.usages, "component_id", "n", distinct="asset_id"), "component_id", "n")
    top = rows.orderBy(F.desc("n"), "name", "id").limit(100)
    return top.selectExpr("id", "cast(row_number() over (order by n desc, name, id) as bigint) as place")


@query("agg_summary_category", "SELECT finding_type AS category, count(*) AS n FROM v_findings GROUP BY finding_type")
def by_category(inv):
    return inv.findings.groupBy(F.col("finding_type").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("grf_provenance", "SELECT DISTINCT 'component:' || u.component_id AS source, 'discovered_in' AS kind, 'asset:' || u.asset_id AS target FROM v_usages u WHERE u.source <> 'image_scan' UNION ALL SELECT DISTINCT 'component:' || component_id, 'built_from', 'asset:' || asset_id FROM v_usages WHERE source = 'image_scan'")
def provenance_edges(inv):
    """Edges from components to where they were found, or what they were built from; each once."""
    kind = F.when(F.col("source") == "image_scan", "built_from").otherwise("discovered_in")
    pairs = inv.usages.select("component_id", kind.alias("kind"), "asset_id").distinct()
    return pairs.select(F.concat(F.lit("component:"), F.col("component_id").cast("string")).alias("source"), "kind", F.concat(F.lit("asset:"), F.col("asset_id").cast("string")).alias("target"))
