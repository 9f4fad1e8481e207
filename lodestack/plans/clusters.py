"""Queries over cluster resources. Their input is made as JSON from the customers: one resource each, half of them in lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import clusters
from lodestack.plans.registry import query

HEX = "ab" * 32


def resources(inv):
    """One JSON document per customer with an odd key; a list of one resource for even keys."""
    k = F.col("c_custkey")
    text = lambda p: F.concat(F.lit(p), k.cast("string"))
    kind = F.element_at(F.array(*map(F.lit, (*clusters.KINDS, "Service"))), (k % 8 + 1).cast("int"))
    image = F.element_at(F.array(F.lit("nginx"), F.lit("ghcr.io/team/app:1.2"), F.lit("quay.io/x/y:stable"), F.lit(f"registry.local:5000/app@sha256:{HEX}")), (k % 4 + 1).cast("int"))
    main = F.struct(F.lit("main").alias("name"), image.alias("image"))
    init = F.when(k % 3 == 0, F.array(F.struct(F.lit("init").alias("name"), F.lit("busybox:1").alias("image"))))
    pod = F.struct(F.when(k % 10 != 0, F.array(main)).alias("containers"), init.alias("initContainers"), text("sa").alias("serviceAccountName"))
    template = F.struct(F.struct(pod.alias("spec")).alias("template"))
    spec = F.struct(
        *(F.when(kind == "Pod", pod[c]).alias(c) for c in ("containers", "initContainers", "serviceAccountName")),
        F.when(~kind.isin("Pod", "CronJob"), template["template"]).alias("template"), F.when(kind == "CronJob", F.struct(template.alias("spec"))).alias("jobTemplate"),
    )
    manager = lambda *names: F.array(*(F.struct(F.lit(n).alias("manager")) for n in names))
    owner = F.when(k % 9 == 0, F.array(F.struct(F.lit("Deployment").alias("kind")))).when(k % 9 == 1, F.array(F.struct(F.lit("Node").alias("kind"))))
    annotations = F.when(k % 7 == 0, F.create_map(F.lit("meta.helm.sh/release-name"), F.lit("x"))).when(k % 7 == 1, F.create_map(F.lit(clusters.LAST_APPLIED), F.lit("{}")))
    managers = F.when(k % 6 == 0, manager("argocd-controller")).when(k % 6 == 1, manager("kubectl-edit")).when(k % 6 == 2, manager("some-tool")).when(k % 6 == 3, manager("kubectl-client-side-apply", "Helm"))
    meta = F.struct(text("w").alias("name"), F.when(k % 5 != 0, F.concat(F.lit("ns"), (k % 5).cast("string"))).alias("namespace"), F.when(k % 11 == 0, F.create_map(F.lit("app.kubernetes.io/managed-by"), F.lit("Helm"))).alias("labels"), annotations.alias("annotations"), owner.alias("ownerReferences"), managers.alias("managedFields"))
    status = F.when(k % 16 == 6, F.struct(F.array(F.struct(F.lit("main").alias("name"), F.lit(f"docker-pullable://x@sha256:{HEX}").alias("imageID"))).alias("containerStatuses")))
    one = F.to_json(F.struct(F.lit("v1").alias("apiVersion"), kind.alias("kind"), meta.alias("metadata"), spec.alias("spec"), status.alias("status")))
    listed = F.concat(F.lit('{"kind":"List","items":['), one, F.lit("]}"))
    # a few keys to a file become long texts: they are dealt to all cores first
    keys = inv.table("customer").select("c_custkey").repartition(4 * inv.spark.sparkContext.defaultParallelism, "c_custkey")
    return keys.select(k.alias("id"), F.when(k % 2 == 0, listed).otherwise(one).alias("doc"))


#: The same workloads from the keys alone; n: containers, by: what delivered them.
BASE = f"""
ks AS (SELECT c_custkey AS k, ['Deployment', 'StatefulSet', 'DaemonSet', 'CronJob', 'Job', 'ReplicaSet', 'Pod', 'Service'][c_custkey % 8 + 1] AS kind FROM customer),
ws AS (SELECT k AS id, k, kind, CASE WHEN k % 5 = 0 THEN 'default' ELSE 'ns' || (k % 5) END AS namespace, 'w' || k AS name, CASE WHEN k % 10 = 0 THEN 0 ELSE 1 END + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS n,
    k % 7 = 0 OR k % 11 = 0 OR k % 6 = 0 OR k % 6 = 3 AS delivered
  FROM ks WHERE kind <> 'Service' AND k % 9 <> 0 AND NOT (k % 10 = 0 AND k % 3 <> 0)),
vs AS (SELECT *, NOT delivered AS is_shadow, CASE WHEN delivered THEN 'low' WHEN k % 6 = 1 OR (kind = 'Pod' AND k % 9 <> 1) THEN 'high' ELSE 'medium' END AS confidence FROM ws),
cs AS (SELECT *, unnest(CASE WHEN k % 10 = 0 THEN ['init'] WHEN k % 3 = 0 THEN ['main', 'init'] ELSE ['main'] END) AS container FROM vs),
es AS (SELECT *, CASE WHEN container = 'init' THEN 'docker.io' ELSE ['docker.io', 'ghcr.io', 'quay.io', 'registry.local:5000'][k % 4 + 1] END AS registry,
    CASE WHEN container = 'init' THEN 'library/busybox' ELSE ['library/nginx', 'team/app', 'x/y', 'app'][k % 4 + 1] END AS repository,
    CASE WHEN container = 'init' THEN '1' ELSE ['latest', '1.2', 'stable', ''][k % 4 + 1] END AS tag,
    CASE WHEN container = 'main' AND (k % 4 = 3 OR (k % 16 = 6 AND kind = 'Pod')) THEN 'sha256:{HEX}' ELSE '' END AS digest FROM cs),
xs AS (SELECT *, registry || '/' || repository || CASE WHEN tag <> '' THEN ':' || tag ELSE '' END || CASE WHEN digest <> '' THEN '@' || digest ELSE '' END AS reference,
    'c1/' || namespace || '/' || kind || '/' || name || '/' || container AS external FROM es)
"""


def base(inv):
    return clusters.assessed(clusters.workloads(resources(inv), cluster="c1"))


def each(inv):
    return clusters.exploded(base(inv))


@query("src_k8s_json", "SELECT c_custkey AS id, ['Deployment', 'StatefulSet', 'DaemonSet', 'CronJob', 'Job', 'ReplicaSet', 'Pod', 'Service'][c_custkey % 8 + 1] AS kind FROM customer", views=False)
def flat_resources(inv):
    return clusters.flattened(resources(inv)).select("id", F.get_json_object("doc", "$.kind").alias("kind"))


@query("nrm_workloads", f"WITH {BASE} SELECT id, namespace, kind, name, CAST(n AS INTEGER) AS n_containers FROM ws", views=False)
def all_workloads(inv):
    return base(inv).select("id", "namespace", "kind", "name", F.size("containers").alias("n_containers"))


@query("nrm_pod_spec", f"WITH {BASE} SELECT id, kind, 'sa' || k AS service_account FROM ws", views=False)
def service_accounts(inv):
    return base(inv).select("id", "kind", "service_account")


@query("nrm_containers", f"WITH {BASE} SELECT id, container, CASE container WHEN 'main' THEN 'container' ELSE 'init' END AS container_group, registry, repository, tag, digest FROM xs", views=False)
def all_containers(inv):
    return each(inv).select("id", "container", "container_group", "registry", "repository", "tag", "digest")


@query("nrm_digest_image_id", f"SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'sha256:{HEX}' WHEN 1 THEN 'sha256:1' ELSE '' END AS digest FROM customer", views=False)
def runtime_digests(inv):
    k = F.col("c_custkey")
    given = F.when(k % 3 == 0, f"docker-pullable://x@sha256:{HEX}").when(k % 3 == 1, "sha256:1").when(k % 2 == 0, "x:1")
    return inv.table("customer").select(k.alias("id"), clusters.digest_of_image_id(given).alias("digest"))


@query("k8s_shadow", f"WITH {BASE} SELECT id, is_shadow, confidence FROM vs", views=False)
def verdicts(inv):
    return base(inv).select("id", "is_shadow", "confidence")


@query("k8s_image_findings", f"WITH {BASE} SELECT id, container, 'unpinned_image' AS finding_type, CASE WHEN tag IN ('latest', 'stable') THEN 'high' ELSE 'medium' END AS severity FROM xs WHERE digest = '' UNION ALL SELECT id, container, 'untrusted_registry', 'high' FROM xs WHERE registry NOT IN ('docker.io', 'ghcr.io')", views=False)
def container_findings(inv):
    return clusters.image_findings(each(inv), ["docker.io", "ghcr.*"]).select("id", "container", "finding_type", "severity")


@query("flt_registry_trusted", f"WITH {BASE} SELECT id, container, registry FROM xs WHERE registry IN ('docker.io', 'quay.io', 'ghcr.io')", views=False)
def trusted_registries(inv):
    from lodestack.functions.scalars import any_glob

    return each(inv).where(any_glob(F.col("registry"), ["*.io"])).select("id", "container", "registry")


@query("k8s_shadow_finding", f"WITH {BASE} SELECT id, CASE WHEN k % 10 = 0 THEN 'init' ELSE 'main' END AS container, CASE confidence WHEN 'high' THEN 'critical' ELSE 'high' END AS severity FROM vs WHERE is_shadow", views=False)
def shadow_workloads(inv):
    return clusters.shadow_findings(each(inv)).select("id", "container", "severity")


@query("grf_build_k8s", f"WITH {BASE} SELECT 'wl:' || external AS source_ref, 'belongs_to' AS relationship_type, 'cluster:c1' AS target_ref FROM xs UNION ALL SELECT 'img:' || reference, 'runs_in', 'wl:' || external FROM xs", views=False)
def cluster_edges(inv):
    return clusters.edges(each(inv))


@query("src_k8s_emit", f"WITH {BASE} SELECT 'c1' AS cluster, reference, count(*) AS n_containers, min(namespace) AS namespace FROM xs WHERE kind IN ('Deployment', 'Pod') AND namespace LIKE 'ns%' AND tag <> 'stable' GROUP BY reference", views=False)
def images_to_scan(inv):
    return clusters.listed(each(inv), ["Deployment", "Pod"], ["ns*"], ["sta*"])


#: Details of containers and of images as JSON.
DETAILS_SQL = """'{"cluster":"c1","namespace":"' || namespace || '","kind":"' || kind || '","name":"' || name || '","container":"' || container || '","service_account":"sa' || k || '","image_reference":"' || reference || '","image_digest":"' || digest || '","node_name":""}'"""
IMAGE_SQL = """'{"registry_type":"' || CASE registry WHEN 'docker.io' THEN 'dockerhub' WHEN 'ghcr.io' THEN 'ghcr' WHEN 'quay.io' THEN 'quay' ELSE 'other' END || '","registry":"' || registry || '","repository":"' || repository || '","image_name":"' || string_split(repository, '/')[-1] || '","tag":"' || tag || '","digest":"' || digest || '"}'"""


@query("nrm_k8s_payload", f"""WITH {BASE}
SELECT 'cluster:c1' AS ref, 'k8s_cluster' AS asset_type, 'c1' AS external_id, 'c1' AS display_name, '' AS owner, '{{}}' AS details UNION ALL
SELECT 'wl:' || external, 'k8s_workload', external, namespace || '/' || name || ':' || container, CASE WHEN is_shadow THEN 'unknown' ELSE '' END, {DETAILS_SQL} FROM xs UNION ALL
SELECT DISTINCT 'img:' || reference, 'container_image', reference, CASE WHEN tag <> '' THEN repository || ':' || tag ELSE repository END, '', {IMAGE_SQL} FROM xs""", views=False)
def cluster_assets(inv):
    """Assets of a payload with their details; its edges are the rows of grf_build_k8s, its findings those of k8s_image_findings and k8s_shadow_finding."""
    return clusters.assets(each(inv))
