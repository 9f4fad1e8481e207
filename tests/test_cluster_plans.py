"""Assets of clusters: each once, from resources that are read once for the containers and once for what they share."""

import json

from pyspark.sql import functions as F

from lodestack.functions.scalars import image_reference
from lodestack.operators import clusters


def test_clusters_and_images_come_once_from_one_reading(spark):
    pod = lambda name, *images: json.dumps({"apiVersion": "v1", "kind": "Pod", "metadata": {"name": name}, "spec": {"containers": [{"name": f"c{k}", "image": i} for k, i in enumerate(images)]}})
    docs = spark.createDataFrame([(1, pod("a", "nginx", "x.io/y:1")), (2, pod("b", "nginx")), (3, pod("none")), (4, "no"), (5, None)], "id int, doc string")
    one, two = (clusters.exploded(clusters.assessed(clusters.workloads(docs, cluster=c))) for c in ("k1", "k2"))
    rows = clusters.assets(one.unionByName(two)).collect()
    kinds = lambda kind: sorted(r["external_id"] for r in rows if r["asset_type"] == kind)
    assert kinds("k8s_cluster") == ["k1", "k2"] and kinds("container_image") == ["docker.io/library/nginx:latest", "x.io/y:1"]
    assert kinds("k8s_workload") == [f"{k}/default/Pod/{w}" for k in ("k1", "k2") for w in ("a/c0", "a/c1", "b/c0")]
    plan = clusters.assets(one)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(apiVersion") + plan.count("from_json(StructField(kind") == 2


def test_a_reference_is_taken_apart_once(spark):
    docs = spark.createDataFrame([(1, "{}")], "id int, doc string")
    rows = clusters.exploded(clusters.workloads(docs)).select("registry", "repository", "tag", "digest", "reference")
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("|localhost)/")
    assert count(rows) == count(docs.select(image_reference(F.col("doc")).alias("i")))


def test_the_payload_holds_the_details_of_its_assets(spark):
    """The details were dropped behind the operator, so they were never made."""
    from lodestack import plans

    rows = {(r["asset_type"], r["external_id"]): json.loads(r["details"]) for r in plans.QUERIES["nrm_k8s_payload"](spark, "/root/testdata/sf0.001").collect()}
    assert rows["k8s_cluster", "c1"] == {} and len(rows) > 100
    one = rows["k8s_workload", "c1/ns3/Deployment/w8/main"]
    assert one == {"cluster": "c1", "namespace": "ns3", "kind": "Deployment", "name": "w8", "container": "main", "service_account": "sa8", "image_reference": "docker.io/library/nginx:latest", "image_digest": "", "node_name": ""}
    assert rows["container_image", "ghcr.io/team/app:1.2"] == {"registry_type": "ghcr", "registry": "ghcr.io", "repository": "team/app", "image_name": "app", "tag": "1.2", "digest": ""}
