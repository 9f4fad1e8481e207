"""Decoders of bills of materials, scanner matches and advisories: JSON text to rows, by one from_json per document.

Fields that may be text or an object (supplier, cpe, licences) are read as text and told apart by their first character.
A document that is no JSON, or of another format, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.scalars import ecosystem_name, first_value, normalize_severity, purl_ecosystem

_PAIR = "array<struct<name:string,value:string>>"
_COMPONENT = f"struct<`bom-ref`:string,type:string,name:string,version:string,purl:string,scope:string,cpe:string,supplier:string,licenses:array<string>,hashes:array<struct<alg:string,content:string>>,properties:{_PAIR}>"
_VULNERABILITY = "struct<id:string,`bom-ref`:string,description:string,recommendation:string,ratings:array<struct<severity:string>>,affects:array<struct<ref:string>>>"
BOM = f"bomFormat: string, components: array<{_COMPONENT}>, vulnerabilities: array<{_VULNERABILITY}>"
ADVISORY = "id string, withdrawn string, affected array<struct<package:struct<name:string,ecosystem:string>,versions:array<string>,ranges:array<struct<events:array<map<string,string>>>>>>"
MATCHES = "matches array<struct<vulnerability:struct<id:string,severity:string,fix:struct<versions:array<string>>>,artifact:struct<name:string,version:string,purl:string>>>"

# Keys under which a wrapper holds its document.
WRAPPERS = ("cyclonedx", "bom", "sbom", "document")


def unwrap(text: Column) -> Column:
    """The document itself, or the first that a wrapper key holds; null if there is none."""
    out = F.when(F.get_json_object(text, "$.bomFormat") == "CycloneDX", text)
    for key in WRAPPERS:
        out = out.when(F.get_json_object(text, f"$.{key}.bomFormat") == "CycloneDX", F.get_json_object(text, f"$.{key}"))
    return out


def property_value(properties: Column, *names: str) -> Column:
    """The first of these properties that is not empty; of a repeated name the last counts. Empty if there is none."""
    last = lambda n: F.try_element_at(F.filter(properties, lambda p: p["name"] == n), F.lit(-1))["value"]
    return first_value(*(last(n) for n in names))


def licence(licences: Column, joined: bool = False) -> Column:
    """Id or name of the first licence, or of all, joined by a comma."""
    one = lambda x: F.when(x.startswith("{"), first_value(F.get_json_object(x, "$.license.id"), F.get_json_object(x, "$.license.name"))).otherwise(x)
    names = F.transform(F.coalesce(licences, F.array().cast("array<string>")), one)
    return F.array_join(F.filter(names, lambda x: x != ""), ", ") if joined else F.coalesce(F.get(names, F.lit(0)), F.lit(""))


def supplier(value: Column) -> Column:
    """Name or address of a supplier object, or the text."""
    return F.when(value.startswith("{"), first_value(F.get_json_object(value, "$.name"), F.get_json_object(value, "$.url"))).otherwise(F.coalesce(value, F.lit("")))


def cpe(value: Column) -> Column:
    """The text, or the first entry of a list that is not empty."""
    entries = F.filter(F.from_json(value, "array<string>"), lambda x: x != "")
    return F.when(value.startswith("["), F.coalesce(F.get(entries, F.lit(0)), F.lit(""))).otherwise(F.coalesce(value, F.lit("")))


def hashes(value: Column) -> Column:
    """Map of algorithm to content; of a repeated algorithm the last counts."""
    full = F.filter(F.coalesce(value, F.array().cast("array<struct<alg:string,content:string>>")), lambda h: (h["alg"] != "") & (h["content"] != ""))
    names = F.array_distinct(F.transform(full, lambda h: h["alg"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.try_element_at(F.filter(full, lambda h: h["alg"] == n), F.lit(-1))["content"]))


def parsed(docs: DataFrame, text: str = "doc") -> DataFrame:
    """docs with the column bom in place of the text, without those that hold none: the document itself, or the first that a wrapper key holds.

    One from_json reads the text with all its wrappers. The rows come from a generator, so that conditions on them are not
    moved in front of it, where Spark would read the text once more for each.
    """
    wrapped = f"struct<{BOM}>"
    read = docs.withColumn("_read", F.from_json(text, f"struct<{BOM}, {', '.join(f'{k}: {wrapped}' for k in WRAPPERS)}>"))
    is_bom = lambda at: F.col(f"{at}.bomFormat") == "CycloneDX"
    bom = F.when(is_bom("_read"), F.struct(*(F.col(f"_read.{c}").alias(c) for c in ("bomFormat", "components", "vulnerabilities"))))
    for key in WRAPPERS:
        bom = bom.when(is_bom(f"_read.{key}"), F.col(f"_read.{key}"))
    return read.select(*(c for c in docs.columns if c != text), F.explode_outer(F.array(bom)).alias("bom")).where("bom is not null")


def counts(boms: DataFrame) -> DataFrame:
    """How many components and findings each document gives, as components and findings would: the columns before bom, n_components, n_findings."""
    refs = lambda v: F.size(F.filter(v["affects"], lambda a: a["ref"] != ""))
    flaws = F.coalesce("bom.vulnerabilities", F.array().cast(f"array<{_VULNERABILITY}>"))
    found = F.aggregate(flaws, F.lit(0), lambda n, v: n + F.greatest(F.lit(1), F.coalesce(refs(v), F.lit(0))))
    return boms.select(*(c for c in boms.columns if c != "bom"), F.greatest(F.lit(0), F.coalesce(F.size("bom.components"), F.lit(0))).alias("n_components"), found.alias("n_findings"))


def components(boms: DataFrame, prefix: str = "lodestack") -> DataFrame:
    """One row per component with the columns of boms before: ref, name, version, ecosystem, ... and evidence_path."""
    keys = [c for c in boms.columns if c != "bom"]
    rows = boms.select(*keys, F.posexplode_outer("bom.components").alias("_at", "c")).where("_at is not null")
    c, at = F.col("c"), F.concat(F.lit("component-"), F.col("_at").cast("string"))
    purl, props = F.coalesce(c["purl"], F.lit("")), c["properties"]
    by_purl = purl_ecosystem(purl, F.lit(""))
    eco = first_value(property_value(props, f"{prefix}:ecosystem", "ecosystem"), by_purl, c["type"])
    manager = property_value(props, f"{prefix}:package_manager", "package_manager")
    ref = first_value(c["bom-ref"], purl, c["name"], at)
    # fixed values: names of the properties that hold a path
    paths = [f"{prefix}:path", f"{prefix}:evidence_path", "evidence_path", "path", "filePath", "location", "cdx:location:path", "syft:location:0:path"]
    return rows.select(
        *keys, ref.alias("ref"), first_value(c["name"], purl, ref).alias("name"), first_value(c["version"]).alias("version"), eco.alias("ecosystem"),
        first_value(manager, eco).alias("package_manager"), purl.alias("purl"), cpe(c["cpe"]).alias("cpe"), supplier(c["supplier"]).alias("supplier"),
        licence(c["licenses"]).alias("license"), licence(c["licenses"], joined=True).alias("licenses"), hashes(c["hashes"]).alias("hashes"),
        property_value(props, *paths).alias("evidence_path"), first_value(manager, by_purl).alias("usage_manager"),
    )


def findings(boms: DataFrame) -> DataFrame:
    """One row per vulnerability and affected reference; one without references has a null component_ref."""
    keys = [c for c in boms.columns if c != "bom"]
    v = F.col("v")
    refs = F.filter(F.transform(v["affects"], lambda a: a["ref"]), lambda r: r != "")
    rows = boms.select(*keys, F.posexplode_outer("bom.vulnerabilities").alias("_at", "v")).where("_at is not null").select(*keys, "v", F.explode_outer(refs).alias("component_ref"))
    severity = normalize_severity(F.get(v["ratings"], F.lit(0))["severity"])
    return rows.select(*keys, "component_ref", severity.alias("severity"), first_value(v["id"], v["bom-ref"], default="Vulnerability").alias("title"), first_value(v["description"]).alias("description"), first_value(v["recommendation"]).alias("fix_recommendation"))


def match_findings(reports: DataFrame, key: str, text: str = "report") -> DataFrame:
    """Vulnerabilities of scanner reports, the first of each (id, package url) in a report, fix versions joined."""
    rows = reports.select(key, F.posexplode(F.from_json(text, MATCHES)["matches"]).alias("at", "m"))
    m = F.col("m")
    rows = rows.select(key, "at", m["vulnerability"]["id"].alias("vulnerability_id"), F.coalesce(m["artifact"]["purl"], F.lit("")).alias("purl"), normalize_severity(m["vulnerability"]["severity"], "info").alias("severity"), F.array_join(m["vulnerability"]["fix"]["versions"], ", ").alias("fixed_in"))
    first = rows.groupBy(key, "vulnerability_id", "purl").agg(F.min_by(F.struct("severity", "fixed_in"), "at").alias("f"))
    return first.select(key, "vulnerability_id", "purl", "f.*")


def advisory_specs(advisories: DataFrame, text: str = "record") -> DataFrame:
    """One row per affected package of advisories that are not withdrawn: package, ecosystem, versions, all_versions.

    All versions are meant if none is listed and a range starts at 0 without an end.
    """
    rows = advisories.select(F.from_json(text, ADVISORY).alias("r")).where("r.id is not null and r.withdrawn is null").select(F.col("r.id").alias("advisory_id"), F.explode("r.affected").alias("a"))
    a = F.col("a")
    trimmed = F.filter(F.transform(F.coalesce(a["versions"], F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")
    versions = F.sort_array(F.array_distinct(trimmed))
    ends = lambda e: F.arrays_overlap(F.map_keys(e), F.array(F.lit("fixed"), F.lit("last_affected"), F.lit("limit")))
    open_range = lambda r: F.exists(r["events"], lambda e: F.try_element_at(e, F.lit("introduced")) == "0") & ~F.exists(r["events"], ends)
    every = (F.size(versions) == 0) & F.coalesce(F.exists(a["ranges"], open_range), F.lit(False))
    name = F.trim(a["package"]["name"])
    return rows.where(F.coalesce(name, F.lit("")) != "").select("advisory_id", name.alias("package"), ecosystem_name(a["package"]["ecosystem"]).alias("ecosystem"), versions.alias("versions"), every.alias("all_versions"))


def component_classes(components: DataFrame) -> DataFrame:
    """What advisories can tell apart: the distinct (package, version, ecosystem) of components (name, version, ecosystem)."""
    return components.select(F.col("name").alias("package"), "version", "ecosystem").where("package is not null").distinct()


def same_class(left: str, right: str) -> Column:
    """Whether rows of two aliases are of one class; versions and ecosystems may be null."""
    return (F.col(f"{left}.package") == F.col(f"{right}.package")) & F.col(f"{left}.version").eqNullSafe(F.col(f"{right}.version")) & F.col(f"{left}.ecosystem").eqNullSafe(F.col(f"{right}.ecosystem"))


def advisory_classes(specs: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes (package, version, ecosystem, ...) that advisories name: the columns of specs without the last three, and those of the classes.

    Listed versions are part of the join's key, so only specs of all versions meet every class of their name. Ecosystems
    are normalised once on each side, and match if equal or if one is empty.
    """
    own = [c for c in specs.columns if c not in ("package", "ecosystem", "versions", "all_versions")]
    kept = [*own, *classes.columns]
    specs = specs.withColumn("_eco", ecosystem_name(F.col("ecosystem"))).drop("ecosystem")
    known = classes.withColumn("_own", ecosystem_name(F.col("ecosystem")))
    listed = specs.where("not all_versions").withColumn("version", F.explode(F.array_distinct("versions"))).join(known, ["package", "version"])
    every = specs.where("all_versions").join(known, "package")
    rows = listed.select(*kept, "_eco", "_own").unionByName(every.select(*kept, "_eco", "_own"))
    return rows.where("_eco = '' or _own = '' or _eco = _own").drop("_eco", "_own")


def advisory_hits(specs: DataFrame, components: DataFrame) -> DataFrame:
    """Components that advisories name: the columns of specs (package, ecosystem, versions, all_versions, ...) without the last three, component_id, version, ecosystem.

    Advisories meet classes first, then the components of these, so no component is read that an advisory does not name, and
    the many components of one name lie in many tasks.
    """
    own = [c for c in specs.columns if c not in ("ecosystem", "versions", "all_versions")]
    named = advisory_classes(specs, component_classes(components))
    # few rows that stand for many hits: dealt out, so that no task has most of these
    named = named.repartition(int(specs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "package", "version", "ecosystem", *(c for c in own if c == "advisory_id")).alias("n")
    known = components.select(F.col("id").alias("component_id"), F.col("name").alias("package"), "version", "ecosystem").alias("k")
    return named.join(known, same_class("n", "k")).select(*(f"n.{c}" for c in own), "k.component_id", "k.version", "k.ecosystem")
