"""Cluster inventories: raw resources as JSON to workloads, containers, verdicts, findings, edges and payloads.

Everything is one from_json per resource and array expressions over its columns; containers are exploded once. A
resource that is no JSON, of another kind, or without containers gives no rows. Null fields read as empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.scalars import any_glob, first_value, image_reference, registry_type

# Kinds of workloads; marks of sanctioned delivery and of people at a client; tags that move; severities.
KINDS = ("Deployment", "StatefulSet", "DaemonSet", "CronJob", "Job", "ReplicaSet", "Pod")
AUTOMATION = (
    "argocd", "argo-cd", "application-controller", "flux", "kustomize-controller", "helm-controller", "source-controller", "helm", "terraform", "pulumi",
    "spinnaker", "fleet", "rancher", "operator", "kube-controller-manager", "cronjob-controller", "job-controller", "deployment-controller",
    "replicaset-controller", "statefulset-controller", "daemonset-controller",
)
INTERACTIVE = ("kubectl", "k9s", "lens", "octant")
ANNOTATION_MARKS = ("argocd.argoproj.io", "fluxcd.io", "kustomize.toolkit.fluxcd.io", "helm.toolkit.fluxcd.io", "meta.helm.sh")
LABEL_MARKS = ("argocd.argoproj.io/instance", "kustomize.toolkit.fluxcd.io/name", "helm.toolkit.fluxcd.io/name")
MANAGED_BY = ("helm", "flux", "argocd", "kustomize", "terraform", "pulumi", "spinnaker")
LAST_APPLIED = "kubectl.kubernetes.io/last-applied-configuration"
MUTABLE_TAGS = ("latest", "main", "master", "stable", "edge", "dev", "develop", "devel", "nightly", "rolling", "head", "snapshot", "current")
SHADOW_SEVERITY = {"high": "critical", "medium": "high", "low": "medium"}

_CONTAINERS = "array<struct<name:string,image:string>>"
_POD = f"containers:{_CONTAINERS},initContainers:{_CONTAINERS},ephemeralContainers:{_CONTAINERS},serviceAccountName:string,serviceAccount:string,nodeName:string"
_TEMPLATE = f"template:struct<spec:struct<{_POD}>>"
_STATUS = "array<struct<name:string,imageID:string>>"
RESOURCE = (
    "apiVersion string, kind string, metadata struct<name:string,namespace:string,uid:string,labels:map<string,string>,annotations:map<string,string>,"
    "ownerReferences:array<struct<kind:string>>,managedFields:array<struct<manager:string>>>, "
    f"spec struct<{_POD},{_TEMPLATE},jobTemplate:struct<spec:struct<{_TEMPLATE}>>,replicas:int>, "
    f"status struct<containerStatuses:{_STATUS},initContainerStatuses:{_STATUS},ephemeralContainerStatuses:{_STATUS}>"
)


def flattened(docs: DataFrame, text: str = "doc", depth: int = 3) -> DataFrame:
    """One row per resource: the items of lists, and of lists in lists down to a depth, take the place of the list."""
    # a name can be written with escapes; most texts are told apart by bytes
    may = F.contains(text, F.lit("items")) | F.contains(text, F.lit("\\u"))
    is_list = F.col(text).isNotNull() & may & F.get_json_object(text, "$.items").isNotNull() & F.coalesce(F.get_json_object(text, "$.kind"), F.lit("")).endswith("List")
    for _ in range(depth):
        items = F.from_json(F.get_json_object(text, "$.items"), "array<string>")
        docs = docs.withColumn(text, F.explode(F.when(is_list, items).otherwise(F.array(text))))
    return docs


def digest_of_image_id(image_id: Column) -> Column:
    """The digest that a runtime reports: what stands after an @, or the whole if it is a digest; else empty."""
    image_id = F.coalesce(image_id, F.lit(""))
    return F.when(image_id.contains("@"), F.regexp_extract(image_id, r"^[^@]*@(.*)$", 1)).when(image_id.startswith("sha256:"), image_id).otherwise("")


def pod_spec(kind: Column, spec: Column) -> Column:
    """Where a kind keeps its pod: at the top, in the template of its job template, or in its template."""
    top = F.struct(*(spec[c].alias(c) for c in ("containers", "initContainers", "ephemeralContainers", "serviceAccountName", "serviceAccount", "nodeName")))
    return F.when(kind == "Pod", top).when(kind == "CronJob", spec["jobTemplate"]["spec"]["template"]["spec"]).otherwise(spec["template"]["spec"])


def containers(pod: Column, kind: Column, status: Column) -> Column:
    """The containers of all three groups: name, group, image reference, resolved digest (which a reference without one takes)."""
    empty = F.array().cast(_STATUS)
    seen = F.concat(*(F.coalesce(status[c], empty) for c in ("containerStatuses", "initContainerStatuses", "ephemeralContainerStatuses")))
    seen = F.when(kind == "Pod", F.filter(seen, lambda x: (x["name"] != "") & (digest_of_image_id(x["imageID"]) != ""))).otherwise(empty)

    def one(group: str):
        def made(c: Column) -> Column:
            name = F.coalesce(c["name"], F.lit(""))
            resolved = F.coalesce(digest_of_image_id(F.try_element_at(F.filter(seen, lambda x: x["name"] == name), F.lit(-1))["imageID"]), F.lit(""))
            return F.struct(name.alias("name"), F.lit(group).alias("group"), F.coalesce(c["image"], F.lit("")).alias("image"), resolved.alias("resolved"))

        return made

    groups = (("containers", "container"), ("initContainers", "init"), ("ephemeralContainers", "ephemeral"))
    return F.concat(*(F.transform(F.coalesce(pod[c], F.array().cast(_CONTAINERS)), one(g)) for c, g in groups))


def workloads(docs: DataFrame, text: str = "doc", cluster: str = "cluster", include_owned: bool = False, error: str | None = None) -> DataFrame:
    """One row per workload with containers: the columns of docs before, namespace, kind, name, service_account, ..., containers.

    Workloads that another workload owns are left out unless include_owned. Rows with a value in the column error (a resource
    that could not be read, its text null) stay beside the workloads, without containers.
    """
    keys = [c for c in docs.columns if c != text]
    failed = F.col(error).isNotNull() if error else F.lit(False)
    # from a generator: conditions are not moved in front of it, where the text would be read once more for each
    r = flattened(docs, text).select(*keys, F.explode(F.array(F.from_json(text, RESOURCE))).alias("r")).where(F.col("r.kind").isin(*KINDS) | failed)
    m, kind = F.col("r.metadata"), F.col("r.kind")
    owners = F.filter(F.transform(F.coalesce(m["ownerReferences"], F.array().cast("array<struct<kind:string>>")), lambda o: o["kind"]), lambda k: k != "")
    managers = F.filter(F.transform(F.coalesce(m["managedFields"], F.array().cast("array<struct<manager:string>>")), lambda o: o["manager"]), lambda k: k != "")
    none = F.create_map().cast("map<string,string>")
    rows = r.withColumn("pod", pod_spec(kind, F.col("r.spec"))).select(
        *keys, F.lit(cluster).alias("cluster"), F.coalesce(m["namespace"], F.lit("default")).alias("namespace"), kind.alias("kind"), F.coalesce(m["name"], F.lit("")).alias("name"),
        F.coalesce(F.col("pod.serviceAccountName"), F.col("pod.serviceAccount"), F.lit("")).alias("service_account"), F.coalesce(F.col("pod.nodeName"), F.lit("")).alias("node_name"),
        F.coalesce(m["labels"], none).alias("labels"), F.coalesce(m["annotations"], none).alias("annotations"), managers.alias("managers"), owners.alias("owner_kinds"),
        F.col("r.spec.replicas").alias("replicas"), F.trim(F.concat_ws(" ", F.coalesce(F.col("r.apiVersion"), F.lit("")), kind)).alias("raw_kind_path"),
        containers(F.col("pod"), kind, F.col("r.status")).alias("containers"),
    )
    rows = rows.where((F.size("containers") > 0) | failed)
    return rows if include_owned else rows.where(~F.exists("owner_kinds", lambda k: k.isin(*KINDS)))


def assessed(rows: DataFrame) -> DataFrame:
    """Workloads with provenance, is_shadow, confidence and reasons: whether they came by a sanctioned path."""
    any_of = lambda words: "|".join(map(re.escape, words))
    automation = F.filter("managers", lambda m: F.lower(m).rlike(any_of(AUTOMATION)))
    interactive = F.filter("managers", lambda m: F.lower(m).rlike(f"^(?:{any_of(INTERACTIVE)})") & ~F.lower(m).rlike(any_of(AUTOMATION)))
    marked = F.filter(F.map_keys("annotations"), lambda k: k.rlike(any_of(ANNOTATION_MARKS)))
    labelled = F.filter(F.map_keys("labels"), lambda k: k.isin(*LABEL_MARKS))
    by = F.lower(F.coalesce(F.try_element_at("labels", F.lit("app.kubernetes.io/managed-by")), F.lit("")))
    none = F.array().cast("array<string>")
    provenance = F.concat(
        F.transform(marked, lambda k: F.concat(F.lit("annotation:"), k)), F.transform(labelled, lambda k: F.concat(F.lit("label:"), k)),
        F.when(by.isin(*MANAGED_BY), F.array(F.concat(F.lit("managed-by:"), by))).otherwise(none),
        F.when(F.size(automation) > 0, F.array(F.concat(F.lit("manager:"), F.get(automation, F.lit(0))))).otherwise(none),
    )
    rows = rows.withColumn("provenance", provenance).withColumn("_by_hand", F.get(interactive, F.lit(0))).withColumn("_applied", F.array_contains(F.map_keys("annotations"), LAST_APPLIED))
    shadow = F.size("provenance") == 0
    bare = (F.col("kind") == "Pod") & (F.size("owner_kinds") == 0)
    reason = (
        F.when(F.col("_by_hand").isNotNull(), F.concat(F.lit("changed by "), F.col("_by_hand"))).when(bare, "pod without a controller").when(F.col("_applied"), "applied without provenance")
        .when(F.size("managers") == 0, "no provenance metadata").otherwise("no sanctioned path")
    )
    reasons = F.concat(F.array(reason), F.when(F.col("_applied") & (reason != "applied without provenance"), F.array(F.lit("last applied by a client"))).otherwise(none))
    confidence = F.when(~shadow, "low").when(F.col("_by_hand").isNotNull() | bare, "high").otherwise("medium")
    return rows.select(*(c for c in rows.columns if c[0] != "_"), shadow.alias("is_shadow"), confidence.alias("confidence"), F.when(shadow, reasons).otherwise(none).alias("reasons"))


def exploded(rows: DataFrame) -> DataFrame:
    """One row per container of each workload, with its image: registry, repository, tag, digest, reference, asset and image refs."""
    c = F.col("c")
    # from a generator: the reference is taken apart once, not for each of its parts
    rows = rows.select("*", F.posexplode("containers").alias("at", "c")).select("*", F.explode(F.array(image_reference(c["image"]))).alias("i"))
    tag, digest = F.coalesce(F.col("i.tag"), F.lit("")), F.coalesce(F.nullif(F.col("i.digest"), F.lit("")), c["resolved"], F.lit(""))
    reference = F.concat(F.col("i.registry"), F.lit("/"), F.col("i.repository"), F.when(tag != "", F.concat(F.lit(":"), tag)).otherwise(""), F.when(digest != "", F.concat(F.lit("@"), digest)).otherwise(""))
    external = F.concat_ws("/", "cluster", "namespace", "kind", "name", c["name"])
    return rows.withColumns({"container": c["name"], "container_group": c["group"], "registry": F.col("i.registry"), "repository": F.col("i.repository"), "tag": tag, "digest": digest, "reference": reference, "asset_ref": F.concat(F.lit("wl:"), external), "image_ref": F.concat(F.lit("img:"), reference)}).drop("i", "c")


def image_findings(each: DataFrame, trusted: list[str] | None = None) -> DataFrame:
    """Findings of containers: images without a digest (high if the tag moves, else medium), and registries that no glob trusts.

    Without a list of trusted registries none is untrusted.
    """
    moves = F.lower("tag").isin(*MUTABLE_TAGS) | (F.col("tag") == "")
    loose = F.when(F.col("digest") == "", F.struct(F.lit("unpinned_image").alias("finding_type"), F.when(moves, "high").otherwise("medium").alias("severity")))
    foreign = F.when(~any_glob(F.col("registry"), trusted), F.struct(F.lit("untrusted_registry").alias("finding_type"), F.lit("high").alias("severity"))) if trusted else F.lit(None).cast("struct<finding_type:string,severity:string>")
    return each.select("*", F.explode(F.array_compact(F.array(loose, foreign))).alias("f")).select("*", "f.*").drop("f")


def shadow_findings(each: DataFrame) -> DataFrame:
    """One finding per shadow workload, on its first container."""
    severity = F.lit("high")
    for confidence, s in SHADOW_SEVERITY.items():
        severity = F.when(F.col("confidence") == confidence, F.lit(s)).otherwise(severity)
    return each.where("is_shadow and at = 0").withColumns({"finding_type": F.lit("shadow_deployment"), "severity": severity})


def edges(each: DataFrame) -> DataFrame:
    """belongs_to edges of containers to their cluster, and runs_in edges of images to containers."""
    edge = lambda s, kind, t: F.struct(s.alias("source_ref"), F.lit(kind).alias("relationship_type"), t.alias("target_ref"))
    both = F.array(edge(F.col("asset_ref"), "belongs_to", F.concat(F.lit("cluster:"), F.col("cluster"))), edge(F.col("image_ref"), "runs_in", F.col("asset_ref")))
    return each.select(F.explode(both).alias("e")).select("e.*")


def assets(each: DataFrame) -> DataFrame:
    """The clusters, the containers, and every image once: ref, asset_type, external_id, display_name, owner, details as JSON."""
    shadow = F.col("is_shadow")
    own = each.select(
        F.col("asset_ref").alias("ref"), F.lit("k8s_workload").alias("asset_type"), F.substring("asset_ref", 4, 1 << 20).alias("external_id"),
        F.concat("namespace", F.lit("/"), "name", F.lit(":"), "container").alias("display_name"), F.when(shadow, "unknown").otherwise("").alias("owner"),
        F.to_json(F.struct("cluster", "namespace", "kind", "name", "container", "service_account", F.col("reference").alias("image_reference"), F.col("digest").alias("image_digest"), "node_name")).alias("details"),
    )
    # clusters and images are both made of one list of distinct pairs, so resources are read once for them
    pairs = each.select("cluster", "image_ref", "reference", "registry", "repository", "tag", "digest").distinct()
    name = F.element_at(F.split("repository", "/"), -1)
    image = F.struct(
        F.col("image_ref").alias("ref"), F.lit("container_image").alias("asset_type"), F.col("reference").alias("external_id"),
        F.when(F.col("tag") != "", F.concat("repository", F.lit(":"), "tag")).otherwise(F.col("repository")).alias("display_name"), F.lit("").alias("owner"),
        F.to_json(F.struct(registry_type(F.col("registry")).alias("registry_type"), "registry", "repository", name.alias("image_name"), "tag", "digest")).alias("details"),
    )
    cluster = F.struct(F.concat(F.lit("cluster:"), "cluster").alias("ref"), F.lit("k8s_cluster").alias("asset_type"), F.col("cluster").alias("external_id"), F.col("cluster").alias("display_name"), F.lit("").alias("owner"), F.lit("{}").alias("details"))
    return own.unionByName(pairs.select(F.explode(F.array(cluster, image)).alias("a")).select("a.*").distinct())


def listed(each: DataFrame, kinds: list[str] | None = None, namespaces: list[str] | None = None, exclude_tags: list[str] | None = None) -> DataFrame:
    """Image references to scan, each once per cluster, after filters on kind, namespace and tag (globs)."""
    keep = F.lit(True)
    if kinds:
        keep &= F.col("kind").isin(*kinds)
    if namespaces:
        keep &= any_glob(F.col("namespace"), namespaces)
    if exclude_tags:
        keep &= ~any_glob(F.col("tag"), exclude_tags)
    return each.where(keep).groupBy("cluster", "reference").agg(F.count(F.lit(1)).alias("n_containers"), F.min(first_value(F.col("namespace"))).alias("namespace"))
