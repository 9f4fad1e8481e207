"""Queries over sources and sinks at the edge: recorded listings, pushed payloads, bounded bodies, overlays, walks of folders, and the upload queue."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lodestack.operators import clusters, payloads
from lodestack.plans.registry import query
from lodestack.sources import push, recorded, walk
from lodestack.sources.shared import shared_path
from lodestack.streaming import retry

#: Pages of an owner: customers of a nation by ranges of 500 keys. Owner 3 refuses, owner 7 breaks off after a page.
PAGES_SQL = """ps AS (SELECT DISTINCT c_nationkey AS n, c_custkey // 500 AS b FROM customer), nth AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY b) AS page FROM ps),
seen AS (SELECT n, b FROM nth WHERE n % 10 <> 3 AND (n % 10 <> 7 OR page = 1))"""


@query("src_github_repos", f"""WITH {PAGES_SQL} SELECT 'n' || c_nationkey AS owner, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS position, c_name AS name, CAST(NULL AS VARCHAR) AS error
FROM customer JOIN seen ON n = c_nationkey AND b = c_custkey // 500
UNION ALL SELECT DISTINCT 'n' || c_nationkey, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), 'status 403' FROM customer WHERE c_nationkey % 10 = 3""", views=False)
def repositories(inv):
    """Repositories of every owner, by a source that follows recorded pages; owners that refuse give their error."""
    path = shared_path(inv.spark, "recorded")
    n, block = F.col("c_nationkey"), F.floor(F.col("c_custkey") / 500)
    # a page holds the customers of one nation in 500 keys
    pages = inv.table("customer").groupBy(n.alias("n"), block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.col("c_name").alias("name")))).alias("items"))
    order = Window.partitionBy("n").orderBy("block")
    first = F.row_number().over(order)
    url = lambda block: F.concat(F.lit("https://api.example/orgs/n"), F.col("n").cast("string"), F.lit("/repos?per_page=100&type=all"), F.when(block.isNotNull(), F.concat(F.lit("&page="), block.cast("string"))).otherwise(""))
    pages = pages.withColumn("page", first).withColumn("after", F.lead("block").over(order))
    link = F.when(F.col("after").isNotNull(), F.concat(F.lit('<https://api.example/first>; rel="first", <'), url(F.col("after")), F.lit('>; rel="next"')))
    status = F.when(F.col("n") % 10 == 3, 403).when((F.col("n") % 10 == 7) & (F.col("page") > 1), 500).otherwise(200)
    answers = pages.select(url(F.when(F.col("page") > 1, F.col("block"))).alias("request"), status.alias("status"), F.create_map(F.lit("Link"), link).alias("headers"), F.to_json("items").alias("body"))
    recorded.record(answers, path)
    recorded.register(inv.spark)
    owners = ",".join(f"n{r[0]}" for r in inv.table("nation").select("n_nationkey").orderBy("n_nationkey").collect())  # a fixed code list
    found = inv.spark.read.format("repository_listing").options(path=path, owners=owners).load()
    return found.where("error is null or error <> 'status 404'").select("owner", "position", F.get_json_object("repository", "$.name").alias("name"), "error")


@query("src_eks", """SELECT r_name AS region, n_name AS cluster, 'w' || s_suppkey AS name, 'ns' || (s_suppkey % 7) AS namespace FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE n_name LIKE '%A%' OR n_name LIKE '_R_N'""", views=False)
def region_clusters(inv):
    """Workloads of the clusters of all regions whose names fit a glob: a dump per cluster, listed by region."""
    path = shared_path(inv.spark, "recorded")
    code = F.broadcast(inv.table("nation").join(inv.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"))  # a fixed code list
    held = inv.table("supplier").join(code, F.col("s_nationkey") == F.col("n_nationkey"))
    container = F.array(F.struct(F.lit("c").alias("name"), F.lit("nginx:1").alias("image")))
    meta = F.struct(F.concat(F.lit("w"), F.col("s_suppkey").cast("string")).alias("name"), F.concat(F.lit("ns"), (F.col("s_suppkey") % 7).cast("string")).alias("namespace"))
    item = F.struct(F.lit("v1").alias("apiVersion"), F.lit("Pod").alias("kind"), meta.alias("metadata"), F.struct(container.alias("containers")).alias("spec"))
    # a cluster's dump is one document
    dumps = held.groupBy("r_name", "n_name").agg(F.collect_list(item).alias("items")).select(F.concat_ws("/", "r_name", "n_name").alias("request"), F.to_json(F.struct(F.lit("List").alias("kind"), "items")).alias("body"))
    lists = code.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("clusters")).select(F.concat("r_name", F.lit("/list-clusters")).alias("request"), F.to_json(F.struct("clusters")).alias("body"))
    none = F.create_map().cast("map<string,string>")
    recorded.record(dumps.unionByName(lists).select("request", F.lit(200).alias("status"), none.alias("headers"), "body"), path)
    recorded.register(inv.spark)
    regions = ",".join(r[0] for r in inv.table("region").select("r_name").orderBy("r_name").collect())
    found = inv.spark.read.format("cluster_listing").options(path=path, regions=regions, clusters="*A*,?R?N").load()
    return clusters.workloads(found.where("error is null").select("region", F.col("cluster").alias("listed"), "doc")).select("region", F.col("listed").alias("cluster"), "name", "namespace")


#: A document as a payload.
PAYLOAD_SQL = "'{\"doc_id\":' || doc_id || ',\"n\":' || length(coalesce(text, '')) || ',\"pad\":\"' || repeat('x', length(coalesce(text, ''))) || '\"}'"


def _payload():
    n = F.length(F.coalesce("text", F.lit("")))
    return F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.lit(',"n":'), n.cast("string"), F.lit(',"pad":"'), F.repeat(F.lit("x"), n), F.lit('"}'))


@query("src_sink_push", f"""WITH p AS (SELECT doc_id, text, {PAYLOAD_SQL} AS body FROM documents) SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN strlen(body) > 3000 THEN 413 ELSE 200 END AS status, strlen(body) AS bytes,
CASE WHEN strlen(body) <= 3000 THEN length(coalesce(text, '')) END AS received FROM p""", views=False)
def pushed(inv):
    """Payloads pushed twice (the second time changes nothing), what became of each, and what the receiver reads of those that arrived."""
    path = shared_path(inv.spark, "pushed")
    rows = inv.table("documents").select(F.col("doc_id").cast("string").alias("key"), _payload().alias("payload"))
    push.push(rows, path, most_body=3000)
    told = push.received(push.push(rows, path, most_body=3000), path)
    return told.select("key", "status", "bytes", F.get_json_object("body", "$.n").cast("int").alias("received"))


@F.pandas_udf(BinaryType())
def _gzipped(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in bodies:
        yield some.map(lambda b: gzip.compress(b.encode(), mtime=0))


@query("src_gzip_json", f"""WITH p AS (SELECT doc_id, text, {PAYLOAD_SQL} AS body FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'cut off' WHEN 2 THEN 'no gzip' ELSE CASE WHEN strlen(body) - CASE WHEN doc_id % 5 = 3 THEN 1 ELSE 0 END > 3000 THEN 'too large' WHEN doc_id % 5 = 3 THEN 'no JSON' END END AS error,
CASE WHEN doc_id % 5 IN (0, 4) AND strlen(body) <= 3000 THEN length(coalesce(text, '')) END AS n FROM p WHERE doc_id % 5 <> 1 OR strlen(body) <= 3000""", views=False)
def bodies(inv):
    """Compressed bodies, read within 3,000 bytes: whole ones, cut ones, ones that aren't compressed, and ones that aren't JSON."""
    k = F.col("doc_id") % 5
    body = F.when(k == 3, F.substr(_payload(), F.lit(2))).otherwise(_payload())
    rows = inv.table("documents").where((k != 1) | (F.octet_length(_payload()) <= 3000)).select("doc_id", k.alias("k"), _gzipped(body).alias("z"), body.alias("body"))
    sent = F.when(F.col("k") == 1, F.substr("z", F.lit(1), F.octet_length("z") - 6)).when(F.col("k") == 2, F.encode("body", "UTF-8")).otherwise(F.col("z"))
    read = rows.select("doc_id", sent.alias("sent")).withColumn("r", push.gzip_json(F.col("sent"), most_inflated=3000))
    return read.select("doc_id", "r.error", F.get_json_object("r.json", "$.n").cast("int").alias("n"))


@query("nrm_deep_merge", """SELECT o_orderkey AS id, o_orderpriority AS priority, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'base' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'flat' ELSE CAST(o_custkey AS VARCHAR) END AS deep,
CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'kept' END AS beside, CASE WHEN o_orderkey % 5 = 0 THEN '[9]' ELSE '[1,2]' END AS list FROM orders""", views=False)
def merged(inv):
    """Settings laid over others at three depths: objects merge, everything else is replaced."""
    k = F.col("o_orderkey")
    base = F.to_json(F.struct(F.lit("base").alias("status"), F.array(F.lit(1), F.lit(2)).alias("list"), F.struct(F.struct(F.lit("old").alias("c"), F.lit("kept").alias("k")).alias("b"), F.col("o_orderpriority").alias("p")).alias("a")))
    deep = F.when(k % 2 == 0, F.concat(F.lit('"a":{"b":"flat"}'))).otherwise(F.concat(F.lit('"a":{"b":{"c":"'), F.col("o_custkey").cast("string"), F.lit('"}}')))
    over = F.concat(F.lit("{"), F.concat_ws(",", deep, F.when(k % 3 == 0, F.concat(F.lit('"status":"'), "o_orderstatus", F.lit('"'))), F.when(k % 5 == 0, F.lit('"list":[9]'))), F.lit("}"))
    rows = inv.table("orders").select(k.alias("id"), push.deep_merge(base, over).alias("m"))
    at = lambda p: F.get_json_object("m", p)
    return rows.select("id", at("$.a.p").alias("priority"), at("$.status").alias("status"), F.coalesce(at("$.a.b.c"), at("$.a.b")).alias("deep"), at("$.a.b.k").alias("beside"), at("$.list").alias("list"))


@query("nrm_repo_discovery", "SELECT c_custkey AS id, 'n' || c_nationkey || '/' || c_name AS external_id, true AS discovery_only, CAST(0 AS INTEGER) AS components, CAST(1 AS INTEGER) AS assets FROM customer", views=False)
def discovered(inv):
    """Payloads of repositories that are listed only: the asset and its connector, without components, usages or findings."""
    full = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/"), "c_name")
    rows = inv.table("customer").select(F.col("c_custkey").alias("id"), full.alias("full_name"), F.lit("main").alias("default_branch"))
    p = rows.select("id", payloads.discovery_payload(F.col("full_name"), F.col("default_branch"), "repos").alias("p"))
    at = lambda path: F.get_json_object("p", path)
    size = lambda path: F.size(F.from_json(at(path), "array<string>"))
    return p.select("id", at("$.assets[0].external_id").alias("external_id"), at("$.discovery_only").cast("boolean").alias("discovery_only"), size("$.components").alias("components"), size("$.assets").alias("assets"))


#: Files of a repository: orders under folders by their keys, some of which are never read.
FILES_SQL = "fs AS (SELECT o_custkey % 40 AS f, o_orderkey % 3 AS kind, count(*) AS n FROM orders GROUP BY ALL)"


def _written(inv) -> str:
    """The orders as files in folders, by a partitioned write: files of orders by customer, beside folders that are skipped."""
    path = shared_path(inv.spark, "files")
    top = F.get(F.array(*map(F.lit, ("src", "node_modules", "tools"))), (F.col("o_orderkey") % 3).cast("int"))
    rows = inv.table("orders").select(F.col("o_orderkey").cast("string").alias("value"), top.alias("kind"), (F.col("o_custkey") % 40).alias("f"))
    parts = rows.repartition("kind", "f")
    for kind in ("src", "node_modules", "tools"):
        parts.where(F.col("kind") == kind).drop("kind").write.partitionBy("f").text(f"{path}/{kind}")
    return path


@query("src_repo_walk", f"WITH {FILES_SQL} SELECT CASE kind WHEN 0 THEN 'src' ELSE 'tools' END || '/f=' || f AS folder, n AS lines FROM fs WHERE kind <> 1", views=False)
def walked(inv):
    """The files of a folder tree, folders that are skipped left unopened, and the lines that were read of them."""
    path = _written(inv)
    files = walk.walk(inv.spark, path).where("path like '%.txt'")
    read = walk.contents(inv.spark, path, files).where("reason is null")
    lines = F.length(F.decode("content", "UTF-8")) - F.length(F.replace(F.decode("content", "UTF-8"), F.lit("\n"), F.lit("")))
    return read.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), lines.cast("long").alias("lines")).groupBy("folder").agg(F.sum("lines").alias("lines"))


@query("src_binaries", "SELECT 'lib/payloads/' || sha1(CAST(s_suppkey AS VARCHAR)) || '.WHL' AS path FROM supplier WHERE s_suppkey % 3 = 0", views=False)
def binary_files(inv):
    """Binaries by the endings of their names, found by a walk that opens none: suppliers as archives, records, and archives in a folder that is skipped."""
    path = shared_path(inv.spark, "binaries")
    rows = inv.table("supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("payload"), (F.col("s_suppkey") % 3).alias("k"))
    for k, (folder, ending) in enumerate((("lib", ".WHL"), ("lib", ".json.gz"), ("node_modules", ".whl"))):
        push.push(rows.where(F.col("k") == k), f"{path}/{folder}", ending=ending)
    return walk.binaries(walk.walk(inv.spark, path)).select("path")


#: What the server answers while a collector runs.
RUNS_SQL = "rs AS (SELECT runner_id AS endpoint, id AS payload, seen_at AS at_, CASE job_type WHEN 'error' THEN 503 WHEN 'signup' THEN 429 ELSE 200 END AS code FROM v_heartbeats)"


@query("str_queue_retry", f"""WITH {RUNS_SQL} SELECT endpoint, payload, CASE code WHEN 200 THEN 'sent' ELSE 'queued' END AS outcome, at_ AS tried FROM rs
UNION ALL SELECT f.endpoint, f.payload, 'resent', min(s.at_) FROM rs f JOIN rs s ON s.endpoint = f.endpoint AND s.code = 200 AND (s.at_ > f.at_ OR s.at_ = f.at_ AND s.payload > f.payload) WHERE f.code <> 200 GROUP BY f.endpoint, f.payload""")
def queue(inv):
    """A stream of collector runs: payloads sent, those that wait because the server refuses, and when these are sent after all."""
    spark, path = inv.spark, shared_path(inv.spark, "queue")
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        # a stream reads folders: the glob makes one of a single file
        events = spark.readStream.schema(inv.table("events").schema).parquet(f"{inv.folder}/events.parque[t]")
        code = F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "signup", 429).otherwise(200)
        runs = events.select(F.col("user_id").alias("endpoint"), F.col("event_id").alias("payload"), F.floor("value").alias("bytes"), code.alias("code"), F.col("ts").cast("timestamp").alias("at"))
        limits = retry.Limits(payloads=1_000_000, bytes=1 << 40, retries=1_000_000, seconds=100 * 365 * 24 * 3600)
        stream = retry.retried(runs, limits).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        stream.awaitTermination(3600)
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return spark.read.schema(retry.OUTPUT).parquet(f"{path}/out").select("endpoint", "payload", "outcome", F.col("at").cast("timestamp_ntz").alias("tried"))
