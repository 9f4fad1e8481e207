"""Queries over the job queue, merges of ingest tables, deletes, and what is left of the graph and the advisory feed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.operators.relational import emptied, merge_last
from lodestack.operators.runs import changed_roots, due, run_table, runner_presence
from lodestack.plans.registry import query
from lodestack.sources.shared import shared_path

NOW = "2024-01-20"

LOG = "log AS (SELECT id // 6 AS run, id AS o, seen_at AS ts, runner_id AS who, CASE job_type WHEN 'signup' THEN 'claim' WHEN 'error' THEN 'cancel' WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'fail' ELSE '' END AS a FROM v_heartbeats)"
TABLE = f"""{LOG},
c AS (SELECT run, min(o) AS co, arg_min(ts, o) AS c_at, arg_min(who, o) AS c_by FROM log WHERE a = 'claim' GROUP BY run),
x AS (SELECT run, min(o) AS xo, arg_min(ts, o) AS x_at FROM log WHERE a = 'cancel' GROUP BY run),
d AS (SELECT run, max(o) AS do_, arg_max(ts, o) AS d_at, arg_max(a, o) AS d_a FROM log WHERE a IN ('complete', 'fail') GROUP BY run),
j AS (SELECT *, co IS NOT NULL AND (xo IS NULL OR co < xo) AS held FROM (SELECT DISTINCT run FROM log) LEFT JOIN c USING (run) LEFT JOIN x USING (run) LEFT JOIN d USING (run)),
t AS (SELECT *, held AND coalesce(do_ > co, false) AS done FROM j),
s AS (SELECT run, CASE WHEN done THEN CASE d_a WHEN 'complete' THEN 'succeeded' ELSE 'failed' END WHEN xo IS NOT NULL THEN 'canceled' WHEN held AND c_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR THEN 'failed' WHEN held THEN 'running' ELSE 'queued' END AS state,
  CASE WHEN held THEN c_by END AS claimed_by, CASE WHEN held THEN c_at END AS claimed_at, CASE WHEN done THEN d_at WHEN xo IS NOT NULL THEN x_at END AS finished_at FROM t)"""


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def runs(inv):
    job = F.col("job_type")
    action = F.when(job == "signup", "claim").when(job == "error", "cancel").when(job == "purchase", "complete").when(job == "click", "fail").otherwise("")
    log = inv.heartbeats.select(F.floor(F.col("id") / 6).cast("long").alias("run"), "id", F.col("seen_at").cast("timestamp_ntz").alias("seen_at"), "runner_id", action.alias("action"))
    return run_table(log, ["run"], "id", "seen_at", "runner_id", now())


@query("str_claim_state", f"WITH {TABLE} SELECT run, state, claimed_by, claimed_at FROM s")
def claims(inv):
    return runs(inv).select("run", "state", "claimed_by", "claimed_at")


@query("str_cancel", f"WITH {TABLE} SELECT run, finished_at FROM s WHERE state = 'canceled'")
def canceled(inv):
    return runs(inv).where("state = 'canceled'").select("run", "finished_at")


@query("str_late_semantics", f"WITH {TABLE} SELECT s.run, s.state FROM s JOIN t USING (run) WHERE t.xo < t.do_ AND done")
def late_ends(inv):
    """Runs that were canceled and ended later all the same: the end holds."""
    at = lambda *names: F.max(F.when(F.col("job_type").isin(*names), F.col("id")))
    late = inv.heartbeats.groupBy(F.floor(F.col("id") / 6).cast("long").alias("run")).agg(F.min(F.when(F.col("job_type") == "error", F.col("id"))).alias("x"), at("purchase", "click").alias("d")).where("x < d")
    return runs(inv).where("state in ('succeeded', 'failed') and finished_at is not null").join(late.select("run"), "run").select("run", "state")


@query("str_presence_state", f"WITH {TABLE}, b AS (SELECT run % 5 AS job_type, ts FROM log) SELECT job_type, bool_or(beat OR busy) AS available, bool_or(busy) AS busy FROM (SELECT job_type, ts >= TIMESTAMP '{NOW}' - INTERVAL 60 SECOND AS beat, false AS busy FROM b UNION ALL SELECT run % 5, false, state = 'running' AND coalesce(claimed_at >= TIMESTAMP '{NOW}' - INTERVAL 1800 SECOND, false) FROM s) GROUP BY job_type")
def presence_state(inv):
    beats = inv.heartbeats.select((F.floor(F.col("id") / 6).cast("long") % 5).alias("job_type"), F.col("seen_at").cast("timestamp_ntz").alias("seen_at"))
    return runner_presence(beats, runs(inv).withColumn("job_type", F.col("run") % 5), now())


@query("str_schedule", f"WITH {TABLE} SELECT run // 3 AS source, max(coalesce(finished_at, claimed_at)) AS last FROM s GROUP BY run // 3 HAVING NOT bool_or(state IN ('queued', 'running')) AND max(coalesce(finished_at, claimed_at)) <= TIMESTAMP '{NOW}' - INTERVAL 60 SECOND")
def scheduled(inv):
    return due(runs(inv).select(F.floor(F.col("run") / 3).cast("long").alias("source"), F.coalesce("finished_at", "claimed_at").alias("at"), "state"), "source", "at", now())


@query("str_sweep", "SELECT e.runner_id AS root, m.marker IS NULL OR max(e.seen_at) > m.marker AS changed FROM v_heartbeats e LEFT JOIN (SELECT runner_id, max(seen_at) AS marker FROM v_heartbeats WHERE id % 3 = 0 GROUP BY runner_id) m USING (runner_id) GROUP BY e.runner_id, m.marker")
def swept(inv):
    files = inv.heartbeats.select(F.col("runner_id").alias("root"), "seen_at", "id")
    return changed_roots(files, "root", "seen_at", files.where("id % 3 = 0").groupBy("root").agg(F.max("seen_at").alias("marker")))


@query("ups_scan_job", "SELECT runner_id * 10 + id % 10 AS job, arg_max(value, id) AS value, count(*) AS n, min(seen_at) AS first_seen FROM v_heartbeats GROUP BY job")
def scan_jobs(inv):
    rows = inv.heartbeats.select((F.col("runner_id") * 10 + F.col("id") % 10).alias("job"), "id", "value", "seen_at")
    state = merge_last(rows, ["job"], ["id"], first={"first_seen": "seen_at"})
    return state.join(rows.groupBy("job").agg(F.count(F.lit(1)).alias("n")), "job").select("job", "value", "n", "first_seen")


@query("ups_payload_connector", "SELECT o_orderkey AS payload, coalesce(k.id, 1000 + o_custkey % 7) AS connector_id FROM orders LEFT JOIN v_connectors k ON k.id = o_orderkey % 40")
def payload_connectors(inv):
    """The configured connector that a payload names, or else the one of its source name."""
    rows = inv.table("orders").select(F.col("o_orderkey").alias("payload"), (F.col("o_orderkey") % 40).alias("id"), (1000 + F.col("o_custkey") % 7).alias("own"))
    return rows.join(inv.connectors.select("id", F.col("id").alias("known")), "id", "left").select("payload", F.coalesce("known", "own").alias("connector_id"))


@query("ups_asset_details", "SELECT o_custkey AS asset_id, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS detail FROM orders JOIN v_assets a ON a.id = o_custkey WHERE a.asset_type = 'MACHINERY' GROUP BY o_custkey")
def asset_details(inv):
    """Details of the assets of one type: the last delivery of each asset counts."""
    rows = inv.table("orders").select(F.col("o_custkey").alias("asset_id"), "o_orderdate", "o_orderkey", F.col("o_orderpriority").alias("detail"))
    rows = rows.join(inv.assets.where("asset_type = 'MACHINERY'").select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
    return merge_last(rows, ["asset_id"], ["o_orderdate", "o_orderkey"]).select("asset_id", "detail")


@query("ins_raw_sbom", "SELECT l_orderkey AS batch, sha256(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey)) AS document FROM lineitem GROUP BY l_orderkey", views=False)
def raw_documents(inv):
    """Every delivered document is appended under its digest."""
    return inv.table("lineitem").groupBy(F.col("l_orderkey").alias("batch")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l_partkey")).cast("array<string>"), ","), 256).alias("document"))


@query("del_connector_cascade", """SELECT 'assets' AS part, count(*) AS rows, count(connector_id) FILTER (connector_id <> 3) AS linked FROM v_assets
UNION ALL SELECT 'jobs', count(*), count(*) FILTER (s_nationkey <> 3) FROM supplier UNION ALL SELECT 'runs', count(*), count(*) FROM v_heartbeats WHERE runner_id % 25 <> 3""")
def deleted_connector(inv, gone: int = 3):
    """A connector goes: assets and jobs stay without it, its runs go with it."""
    kept = lambda df, name: df.withColumn(name, F.when(F.col(name) != gone, F.col(name)))
    count = lambda df, part, name: df.agg(F.count(F.lit(1)).alias("rows"), F.count(name).alias("linked")).select(F.lit(part).alias("part"), "rows", "linked")
    runs = inv.heartbeats.select((F.col("runner_id") % 25).alias("connector_id")).where(F.col("connector_id") != gone)
    return count(kept(inv.assets.select("connector_id"), "connector_id"), "assets", "connector_id").unionByName(count(kept(inv.table("supplier").select("s_nationkey"), "s_nationkey"), "jobs", "s_nationkey")).unionByName(count(runs, "runs", "connector_id"))


@query("del_reset", """SELECT 'findings' AS name, count(*) AS before, 0 AS rows FROM v_findings UNION ALL SELECT 'usages', count(*), 0 FROM v_usages UNION ALL SELECT 'components', count(*), 0 FROM v_components UNION ALL SELECT 'assets', count(*), 0 FROM v_assets""")
def reset(inv):
    """Stored tables before and after a reset, which empties them one after another, those that refer to others first."""
    path = shared_path(inv.spark, "reset")
    tables = {"findings": inv.findings.select("id", "affected_asset_id"), "usages": inv.usages.select("asset_id", "component_id"), "components": inv.components.select("id", "name"), "assets": inv.assets.select("id", "display_name")}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    # the driver holds one number for each table
    before = {name: inv.spark.read.schema(df.schema).parquet(f"{path}/{name}").count() for name, df in tables.items()}
    emptied(inv.spark, {f"{path}/{name}": df.schema for name, df in tables.items()})
    out = None
    for name, df in tables.items():
        rows = inv.spark.read.schema(df.schema).parquet(f"{path}/{name}").agg(F.count(F.lit(1)).cast("int").alias("rows"))
        rows = rows.select(F.lit(name).alias("name"), F.lit(before[name]).cast("long").alias("before"), "rows")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("agg_malware_active", "SELECT count(*) AS active FROM v_findings WHERE finding_type = 'malware' AND status <> 'resolved'")
def active_malware(inv):
    return inv.findings.where("finding_type = 'malware' and status <> 'resolved'").agg(F.count(F.lit(1)).alias("active"))


@query("jn_config_secret_fields", "SELECT k.id, coalesce(string_agg(DISTINCT 's' || (s_suppkey % 3), ',' ORDER BY 's' || (s_suppkey % 3)), '') AS fields FROM v_connectors k LEFT JOIN supplier ON s_nationkey = k.id AND s_suppkey % 2 = 0 GROUP BY k.id")
def secret_field_names(inv):
    fields = inv.table("supplier").where("s_suppkey % 2 = 0").groupBy(F.col("s_nationkey").cast("long").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("s"), (F.col("s_suppkey") % 3).cast("string")))), ",").alias("fields"))
    return inv.connectors.select("id").join(fields, "id", "left").select("id", F.coalesce("fields", F.lit("")).alias("fields"))


@query("jn_npm_root_names", "SELECT DISTINCT l.l_orderkey AS lock, l.l_partkey AS package, EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = l.l_orderkey AND r.l_linenumber = 1 AND r.l_partkey = l.l_partkey) AS direct FROM lineitem l", views=False)
def direct_packages(inv):
    """Packages of a lock file, direct if its root entry names them; both are one aggregation by lock and name."""
    return inv.table("lineitem").groupBy(F.col("l_orderkey").alias("lock"), F.col("l_partkey").alias("package")).agg(F.bool_or(F.col("l_linenumber") == 1).alias("direct"))


@query("set_local_accumulate", "SELECT l_orderkey AS batch, l_partkey AS package FROM lineitem WHERE l_linenumber <= 2 UNION ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber >= 2", views=False)
def accumulated_roots(inv):
    """Packages of two roots after one another; what both have stays twice."""
    rows = inv.table("lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_partkey").alias("package"), "l_linenumber")
    return rows.where("l_linenumber <= 2").unionByName(rows.where("l_linenumber >= 2")).drop("l_linenumber")


@query("grf_dependency_edges", "SELECT DISTINCT batch, parent, child FROM (SELECT l_orderkey AS batch, l_partkey AS parent, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS child FROM lineitem) WHERE child IS NOT NULL", views=False)
def dependency_edges(inv):
    """Edges between packages of one batch: each package names the next."""
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    pairs = inv.table("lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_partkey").alias("parent"), after.alias("child"))
    return pairs.where("child is not null").distinct()


@query("q_scan_runs_filtered", f"WITH {TABLE} SELECT run, state, claimed_by FROM s WHERE state = 'failed' AND run % 5 = 2 ORDER BY run DESC LIMIT 50 OFFSET 50")
def filtered_runs(inv, status: str = "failed", job_type: int = 2, number: int = 2):
    """The second page of the failed runs of one type, the last first."""
    from lodestack.operators.relational import page

    rows = runs(inv).where((F.col("state") == status) & (F.col("run") % 5 == job_type)).orderBy(F.desc("run"))
    return page(rows.select("run", "state", "claimed_by"), number=number)


@query("q_summary", "SELECT 'assets' AS name, count(*) AS n FROM v_assets UNION ALL SELECT 'components', count(*) FROM v_components UNION ALL SELECT 'findings', count(*) FROM v_findings UNION ALL SELECT 'critical', count(*) FROM v_findings WHERE severity = 'critical' UNION ALL SELECT 'malware', count(*) FROM v_findings WHERE finding_type = 'malware' AND status <> 'resolved' UNION ALL SELECT 'pending', count(*) FROM v_assets WHERE scan_status <> 'scanned' UNION ALL SELECT 'connectors', count(*) FROM v_connectors")
def summary(inv):
    """The numbers of the dashboard: one aggregation per table."""
    when = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0)).cast("long")
    parts = [
        inv.assets.agg(F.count(F.lit(1)).alias("assets"), when("scan_status <> 'scanned'").alias("pending")),
        inv.components.agg(F.count(F.lit(1)).alias("components")),
        inv.findings.agg(F.count(F.lit(1)).alias("findings"), when("severity = 'critical'").alias("critical"), when("finding_type = 'malware' and status <> 'resolved'").alias("malware")),
        inv.connectors.agg(F.count(F.lit(1)).alias("connectors")),
    ]
    out = None
    for p in parts:
        rows = p.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in p.columns))))
        out = rows if out is None else out.unionByName(rows)
    return out
