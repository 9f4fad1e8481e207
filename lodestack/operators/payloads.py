"""Ingest payloads: endpoint batches, scanner reports, repositories and images to assets, components, usages and findings.

Each function takes rows and returns rows; a JSON document is parsed once by from_json. Null fields read as empty, null or
broken documents give no rows, repeated documents give what one gives where rows are merged by reference.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.text_rules import redact
from lodestack.functions.scalars import first_value, normalize_severity, registry_type
from lodestack.operators import boms

_PACKAGE = "struct<name:string,version:string,purl:string,key:string,type:string,language:string,licenses:array<string>,locations:array<string>,found_by:string,dependency_kind:string,occurrence_count:int>"
_FLAW = "struct<id:string,vulnerability:string,name:string,version:string,purl:string,severity:string,fix:string>"
BATCH = (
    "endpoint struct<id:string,hostname:string,username:string,os:string,kernel:string,arch:string>, scanner struct<name:string,version:string>, source struct<name:string>, "
    f"scan_id string, batch_index int, batch_count int, scanned_at string, packages array<{_PACKAGE}>, vulnerabilities array<{_FLAW}>"
)

# The ecosystem of a finding's category (others: generic), and the statuses that a discovery leaves.
CATEGORY_ECOSYSTEM = {"cicd_tool": "githubactions", "container_image": "docker", "mcp_server": "npm"}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def batches(docs: DataFrame, text: str = "doc") -> DataFrame:
    """docs with the column b of an endpoint batch in place of the text."""
    # from a generator: conditions are not moved in front of it, where the text would be read once more for each
    return docs.select(*(c for c in docs.columns if c != text), F.explode_outer(F.array(F.from_json(text, BATCH))).alias("b")).where("b is not null")


def endpoint_assets(parsed: DataFrame) -> DataFrame:
    """One asset row per batch; batches of one endpoint share its external id."""
    e = F.col("b.endpoint")
    name = first_value(e["id"], e["hostname"], default="unknown-endpoint")
    scanner = F.trim(F.concat(first_value(F.col("b.scanner.name"), default="syft"), F.lit(" "), _text(F.col("b.scanner.version"))))
    return parsed.select(
        *(c for c in parsed.columns if c != "b"), F.lit("endpoint-collector").alias("provider"), F.lit("endpoint").alias("asset_type"),
        F.concat(F.lit("endpoint:"), name).alias("external_id"), first_value(e["hostname"], name).alias("display_name"), _text(e["os"]).alias("os_name"), _text(e["kernel"]).alias("os_version"),
        _text(e["arch"]).alias("architecture"), scanner.alias("scanner_version"), first_value(F.col("b.source.name"), default="endpoint-collector").alias("connector"),
    )


def _packages(parsed: DataFrame) -> DataFrame:
    keys = [c for c in parsed.columns if c != "b"]
    p = F.col("p")
    default = F.concat_ws(":", _text(p["type"]), _text(p["name"]), _text(p["version"]))
    rows = parsed.select(*keys, F.posexplode("b.packages").alias("at", "p"))
    return rows.withColumn("ref", F.coalesce(F.nullif(p["purl"], F.lit("")), F.nullif(p["key"], F.lit("")), default)).withColumn("manager", first_value(p["language"], p["type"]))


def _flaws(parsed: DataFrame) -> DataFrame:
    keys = [c for c in parsed.columns if c != "b"]
    v = F.col("v")
    rows = parsed.select(*keys, F.posexplode("b.vulnerabilities").alias("at", "v"))
    return rows.withColumn("ref", F.coalesce(F.nullif(v["purl"], F.lit("")), F.concat_ws(":", _text(v["name"]), _text(v["version"]))))


def endpoint_components(parsed: DataFrame) -> DataFrame:
    """One row per batch and reference: the last package that has it, or else the first vulnerability's package."""
    keys = [c for c in parsed.columns if c != "b"]
    p, v = F.col("p"), F.col("v")
    made = lambda name, version, eco, manager, purl, licence: F.struct(name.alias("name"), version.alias("version"), eco.alias("ecosystem"), manager.alias("package_manager"), purl.alias("purl"), licence.alias("license"))
    own = _packages(parsed).select(*keys, "ref", F.col("at").alias("rank"), made(_text(p["name"]), _text(p["version"]), _text(p["type"]), F.col("manager"), _text(p["purl"]), F.array_join(F.coalesce(p["licenses"], F.array().cast("array<string>")), ", ")).alias("c"))
    eco = F.regexp_extract(_text(v["purl"]), r"^pkg:([^/]*)", 1)
    other = _flaws(parsed).select(*keys, "ref", (-1 - F.col("at")).alias("rank"), made(_text(v["name"]), _text(v["version"]), eco, eco, _text(v["purl"]), F.lit("")).alias("c"))
    return own.unionByName(other).groupBy(*keys, "ref").agg(F.max_by("c", "rank").alias("c")).select(*keys, "ref", "c.*")


def endpoint_usages(parsed: DataFrame) -> DataFrame:
    """One usage per package, with its first location."""
    keys = [c for c in parsed.columns if c != "b"]
    p = F.col("p")
    return _packages(parsed).select(*keys, F.col("ref").alias("component_ref"), F.lit("endpoint_scan").alias("source"), F.coalesce(F.get(p["locations"], F.lit(0)), F.lit("")).alias("evidence_path"), F.col("manager").alias("package_manager"))


def endpoint_findings(parsed: DataFrame) -> DataFrame:
    """One finding per vulnerability, on the component of its package."""
    keys = [c for c in parsed.columns if c != "b"]
    v = F.col("v")
    vid = first_value(v["id"], v["vulnerability"], default="UNKNOWN")
    fix = F.when(_text(v["fix"]) != "", F.concat(F.lit("Upgrade "), _text(v["name"]), F.lit(" to "), v["fix"])).otherwise("")
    return _flaws(parsed).select(*keys, F.col("ref").alias("component_ref"), F.lit("cve").alias("finding_type"), normalize_severity(v["severity"]).alias("severity"), vid.alias("title"), F.trim(F.concat(vid, F.lit(" affects "), _text(v["name"]), F.lit(" "), _text(v["version"]))).alias("description"), fix.alias("fix_recommendation"))


def minimal_vulnerabilities(reports: DataFrame, key: str, text: str = "report") -> DataFrame:
    """Matches of a scanner report as minimal records, one of each (id, purl, name, version), fix versions joined by a comma."""
    m = F.col("m")
    rows = reports.select(key, F.posexplode(F.from_json(text, boms.MATCHES)["matches"]).alias("at", "m"))
    a, v = m["artifact"], m["vulnerability"]
    rows = rows.select(key, "at", _text(v["id"]).alias("id"), _text(a["purl"]).alias("purl"), _text(a["name"]).alias("name"), _text(a["version"]).alias("version"), F.coalesce(v["severity"], F.lit("Unknown")).alias("severity"), F.array_join(F.coalesce(v["fix"]["versions"], F.array().cast("array<string>")), ",").alias("fix"))
    first = rows.groupBy(key, "id", "purl", "name", "version").agg(F.min_by(F.struct("severity", "fix"), "at").alias("f"))
    return first.select(key, "id", "purl", "name", "version", "f.*")


def properties_map(properties: Column) -> Column:
    """Name-value pairs as a map; of a repeated name the last counts, nameless pairs are left out."""
    named = F.filter(properties, lambda p: p["name"] != "")
    names = F.array_distinct(F.transform(named, lambda p: p["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: _text(F.element_at(F.filter(named, lambda p: p["name"] == n), -1)["value"])))


_SUBJECT = "struct<metadata:struct<component:struct<name:string,purl:string,`bom-ref`:string,properties:array<struct<name:string,value:string>>>>,serialNumber:string,version:string>"
_GIVEN = "struct<asset_type:string,external_id:string,id:string,display_name:string,name:string,provider:string,owner:string,environment:string,status:string,tags:array<string>,details:map<string,string>>"


def bom_asset(docs: DataFrame, source: str, asset_type: str, text: str = "doc", prefix: str = "lodestack") -> DataFrame:
    """The asset that a bill of materials describes: what its wrapper says, then its properties, then its subject.

    details are the wrapper's and, over them, the properties named prefix:details.*, without that prefix.
    """
    keys = [c for c in docs.columns if c != text]
    rows = docs.withColumn("d", F.from_json(boms.unwrap(F.col(text)), _SUBJECT)).where("d is not null")
    rows = rows.withColumn("w", F.from_json(text, f"struct<asset:{_GIVEN},provider:string,owner:string,environment:string,tags:array<string>>"))
    a, w, subject = F.col("w.asset"), F.col("w"), F.col("d.metadata.component")
    props = F.coalesce(properties_map(subject["properties"]), F.create_map().cast("map<string,string>"))
    prop = lambda *names: first_value(*(F.try_element_at(props, F.lit(n)) for n in names))
    external = first_value(a["external_id"], a["id"], prop(f"{prefix}:asset_id", "asset_id"), subject["purl"], subject["bom-ref"], subject["name"], F.col("d.serialNumber"), default=f"{source}:unknown")
    mark = f"{prefix}:details."
    own = F.transform_keys(F.map_filter(props, lambda k, v: k.startswith(mark)), lambda k, v: F.substring(k, len(mark) + 1, 1 << 20))
    given = F.map_filter(F.coalesce(a["details"], F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(own), k))
    rows = rows.withColumn("external_id", external)
    return rows.select(
        *keys, first_value(a["asset_type"], default=asset_type).alias("asset_type"), first_value(a["provider"], w["provider"], default=source).alias("provider"), "external_id",
        first_value(a["display_name"], a["name"], prop(f"{prefix}:display_name", "display_name"), subject["name"], F.col("external_id")).alias("display_name"),
        first_value(a["owner"], w["owner"]).alias("owner"), first_value(a["environment"], w["environment"]).alias("environment"), first_value(a["status"], default="active").alias("status"),
        F.array_join(F.coalesce(a["tags"], w["tags"], F.array().cast("array<string>")), ",").alias("tags"), F.map_concat(given, own).alias("details"),
    )


def repository_component(category: Column, dependency: Column) -> Column:
    """The component of a finding: an action of a workflow (owner/name@ref), or a generic package named by the dependency."""
    name = F.trim(F.coalesce(F.nullif(dependency, F.lit("")), F.lit("unknown")))
    action = (category == "cicd_tool") & name.rlike(r"^[\w.-]+/[\w.-]+@\S+$")
    slug = F.replace(F.url_encode(F.substring(F.regexp_replace(name, r"\s+", "-"), 1, 200)), F.lit("+"), F.lit("%20"))
    purl = F.when(action, F.concat(F.lit("pkg:githubactions/"), name)).otherwise(F.concat(F.lit("pkg:generic/"), slug))
    eco = F.lit("generic")
    for c, e in CATEGORY_ECOSYSTEM.items():
        eco = F.when(category == c, F.lit(e)).otherwise(eco)
    part = lambda k: F.split_part(name, F.lit("@"), F.lit(k))
    return F.struct(purl.alias("ref"), F.when(action, part(1)).otherwise(name).alias("name"), F.when(action, part(2)).otherwise("").alias("version"), eco.alias("ecosystem"), purl.alias("purl"))


def repository_components(found: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Components of a repository, the first of each reference: those of findings (category, dependency, at) before those of its
    bill of materials (ref, name, version, ecosystem, purl, at)."""
    columns = ["ref", "name", "version", "ecosystem", "purl"]
    own = found.withColumn("c", repository_component(F.col("category"), F.col("dependency"))).select(*keys, F.lit(0).alias("rank"), "at", "c.*")
    rows = own.unionByName(declared.select(*keys, F.lit(1).alias("rank"), "at", *columns))
    return rows.groupBy(*keys, "ref").agg(F.min_by(F.struct(*columns[1:], "rank"), F.struct("rank", "at")).alias("c")).select(*keys, "ref", "c.name", "c.version", "c.ecosystem", "c.purl", (F.col("c.rank") == 0).alias("phantom"))


def image_assets(images: DataFrame, discovery: bool = False) -> DataFrame:
    """images: (registry, repository, tag, digest). Asset rows: provider, external_id (registry, repository and the digest or else
    the tag), display_name, scan status; a discovery only proves that the image is there."""
    tag, digest = _text(F.col("tag")), _text(F.col("digest"))
    provider = registry_type(F.col("registry"))
    external = F.concat("registry", F.lit("/"), "repository", F.when(digest != "", F.concat(F.lit("@"), digest)).when(tag != "", F.concat(F.lit(":"), tag)).otherwise(""))
    display = F.concat(F.col("repository"), F.when(tag != "", F.concat(F.lit(":"), tag)).otherwise(""), F.when(digest != "", F.concat(F.lit("@"), F.substring(digest, 1, 19))).otherwise(""))
    return images.withColumns({"asset_type": F.lit("container_image"), "provider": provider, "external_id": external, "display_name": display, "scan_status": F.lit("discovered" if discovery else "scanned")})


def aligned(assets: DataFrame) -> DataFrame:
    """Assets with container images under the provider and external id that image_assets gives, so both sources meet in one.

    details: JSON with registry, repository, tag and digest.
    """
    d = lambda name: F.coalesce(F.get_json_object("details", f"$.{name}"), F.lit(""))
    image = image_assets(assets.select("*", *(d(c).alias(f"_{c}") for c in ("registry", "repository", "tag", "digest"))).withColumnsRenamed({f"_{c}": c for c in ("registry", "repository", "tag", "digest")}).withColumnsRenamed({"asset_type": "_type", "external_id": "_external", "display_name": "_display"}))
    own = F.col("_type") == "container_image"
    return image.select("ref", F.col("_type").alias("asset_type"), F.when(own, F.col("provider")).otherwise(F.lit("kubernetes")).alias("provider"), F.when(own, F.col("external_id")).otherwise(F.col("_external")).alias("external_id"))


def flat_vulnerabilities(findings: DataFrame, components: DataFrame, key: str) -> DataFrame:
    """Findings of vulnerabilities with their component's name and version, found by reference or else by purl without qualifiers."""
    bare = lambda c: F.split_part(c, F.lit("?"), F.lit(1))
    by_ref = components.select(key, F.col("ref").alias("look"), "name", "version", F.lit(0).alias("rank"))
    by_purl = components.where("purl <> ''").select(key, bare(F.col("purl")).alias("look"), "name", "version", F.lit(1).alias("rank"))
    known = by_ref.unionByName(by_purl).groupBy(key, "look").agg(F.min_by(F.struct("name", "version"), F.struct("rank", "name", "version")).alias("c"))
    rows = findings.where("finding_type = 'cve'").withColumn("bare", bare(F.col("component_ref")))
    rows = rows.join(known.select(key, F.col("look").alias("component_ref"), F.col("c").alias("c1")), [key, "component_ref"], "left").join(known.select(key, F.col("look").alias("bare"), F.col("c").alias("c2")), [key, "bare"], "left")
    c = F.coalesce("c1", "c2")
    return rows.select(key, F.col("title").alias("id"), "severity", _text(c["name"]).alias("package"), _text(c["version"]).alias("version"))


def decoded_runs(runs: DataFrame) -> DataFrame:
    """Scan runs under the names of the interface: runner_id, started_at, and a source type from the run, its connector's
    configuration or its connector's type (what stands after the first colon)."""
    kind = first_value(F.col("source_type"), F.get_json_object("connector_config", "$.source_type"), F.regexp_replace(F.coalesce("connector_type", F.lit("")), "^[^:]*:", ""))
    return runs.withColumns({"runner_id": F.col("claimed_by"), "started_at": F.col("claimed_at"), "source_type": F.nullif(kind, F.lit(""))}).drop("connector_config", "connector_type")


def decoded_alerts(alerts: DataFrame, columns: tuple[str, ...] = ("versions", "asset_ids")) -> DataFrame:
    """Alerts with JSON columns as arrays of text; null and broken ones are empty."""
    return alerts.withColumns({c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")) for c in columns})


def secret_fields(config: Column, pattern: str = r"(?i)(password|passwd|secret|token|api_?key|private_?key|credential)", allowed: tuple[str, ...] = (), depth: int = 4) -> Column:
    """Paths of a JSON configuration whose last name looks like a secret, down to a depth; allowed: whole paths that are fine."""
    level = F.array(F.struct(F.lit("connection").alias("path"), config.alias("json")))
    found = []
    for _ in range(depth):
        def children(x: Column) -> Column:
            at = F.coalesce(F.from_json(x["json"], "map<string,string>"), F.create_map().cast("map<string,string>"))
            return F.transform(F.map_entries(at), lambda e: F.struct(F.concat(x["path"], F.lit("."), e["key"]).alias("path"), e["value"].alias("json")))

        level = F.flatten(F.transform(level, children))
        found.append(F.transform(F.filter(level, lambda x: F.regexp_extract(x["path"], r"([^.]*)$", 1).rlike(pattern) & (~x["path"].isin(*allowed) if allowed else F.lit(True))), lambda x: x["path"]))
    return F.array_sort(reduce(F.concat, found))


def discovery_payload(full_name: Column, default_branch: Column, source: str, scanner: str = "lodestack discovery") -> Column:
    """The payload, as JSON, of a repository that was listed but neither fetched nor scanned: its asset and connector alone, credentials masked."""
    none, text = F.array().cast("array<string>"), F.lit
    asset = F.struct(
        text("repository").alias("asset_type"), text("github").alias("provider"), full_name.alias("external_id"), full_name.alias("display_name"), text("discovered").alias("scan_status"),
        F.struct(full_name.alias("full_name"), F.split_part(full_name, text("/"), text(1)).alias("org"), default_branch.alias("default_branch")).alias("details"),
    )
    connector = F.struct(text(source).alias("name"), text("github").alias("connector_type"))
    meta = F.struct(text(scanner).alias("scanner_version"), F.lit(0).alias("component_count"), F.lit(0).alias("finding_count"))
    whole = F.struct(text(source).alias("source_name"), connector.alias("connector"), F.lit(True).alias("discovery_only"), meta.alias("scan_metadata"), F.array(asset).alias("assets"), none.alias("components"), none.alias("component_usages"), none.alias("findings"))
    return redact(F.to_json(whole))
