"""Sources and sinks at the edge on small cases: recorded listings, pushes, bounded bodies, overlays, walks, and the upload queue against a replay."""

import datetime
import gzip
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestack.sources import push, recorded, walk
from lodestack.streaming import malware, retry

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def answers(spark, path, rows):
    recorded.record(spark.createDataFrame([(r, s, h, json.dumps(b)) for r, s, h, b in rows], "request string, status int, headers map<string,string>, body string"), path)
    recorded.register(spark)


def test_next_link():
    assert recorded.next_link('<https://h/a?x=1,2>; rel="prev", <https://h/b>; rel="next"') == "https://h/b"
    assert recorded.next_link('<https://h/b>; title="x"; rel=next') == "https://h/b"
    assert recorded.next_link('<https://h/b>; rel="last"') is None and recorded.next_link(None) is None and recorded.next_link("") is None


def test_pages_are_followed(spark, tmp_path):
    url = lambda o, p="": f"https://api.example/orgs/{o}/repos?per_page=100&type=all{p}"
    link = lambda o, p: {"LINK": f'<{url(o, p)}>; rel="next"'}
    path = str(tmp_path / "r")
    answers(spark, path, [(url("a"), 200, link("a", "&page=2"), [{"n": 1}, {"n": 2}]), (url("a", "&page=2"), 200, {}, [{"n": 3}]), (url("b"), 200, link("b", "&page=2"), [{"n": 1}]), (url("b", "&page=2"), 502, {}, []), (url("c"), 403, {}, {"message": "no"}), (url("x%20y"), 200, {}, {"not": "a list"}), (url("loop"), 200, link("loop", ""), [])])
    read = lambda owners: sorted((r["owner"], r["position"], r["repository"], r["error"]) for r in spark.read.format("repository_listing").options(path=path, owners=owners).load().collect())
    assert read("a, b,x y") == [("a", 0, '{"n":1}', None), ("a", 1, '{"n":2}', None), ("a", 2, '{"n":3}', None), ("b", 0, '{"n":1}', None)]
    assert read("c") == [("c", None, None, "status 403")] and read("unknown") == [("unknown", None, None, "status 404")]
    assert spark.read.format("repository_listing").options(path=path, owners="a,b,c").load().rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="more than"):
        read("loop")


def test_clusters_by_glob(spark, tmp_path):
    path = str(tmp_path / "c")
    answers(spark, path, [("r1/list-clusters", 200, {}, {"clusters": ["prod-a", "prod-b", "dev"]}), ("r1/prod-a", 200, {}, {"kind": "Pod"}), ("r1/dev", 200, {}, {"kind": "Job"}), ("r2/list-clusters", 500, {}, {})])
    read = lambda clusters: sorted((r["region"], r["cluster"] or "", r["doc"] or "", r["error"] or "") for r in spark.read.format("cluster_listing").options(path=path, regions="r1,r2", clusters=clusters).load().collect())
    assert read("prod-*") == [("r1", "prod-a", '{"kind": "Pod"}', ""), ("r1", "prod-b", "", "status 404"), ("r2", "", "", "status 500")]
    assert read("dev") == [("r1", "dev", '{"kind": "Job"}', ""), ("r2", "dev", "", "status 404")]
    assert read("nothing?") == [("r2", "", "", "status 500")]


def test_pushes_are_recorded_and_may_be_repeated(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.createDataFrame([("a", '{"x":1}'), ("b", "y" * 50), ("c", None), ("a/../b", '{"x":2}')], "key string, payload string")
    for _ in range(2):
        got = {r["key"]: (r["status"], r["bytes"], r["error"]) for r in push.push(rows, path, most_body=40).collect()}
    assert got == {"a": (200, 7, None), "b": (413, 50, "more than 40 bytes"), "c": (200, 0, None), "a/../b": (200, 7, None)}
    files = sorted(os.listdir(f"{path}/payloads"))
    assert len(files) == 3 and {gzip.open(f"{path}/payloads/{f}").read() for f in files} == {b'{"x":1}', b"", b'{"x":2}'}
    assert json.load(open(f"{path}/_receipt.json"))["failed"] == 1
    assert push.push(rows.limit(0), str(tmp_path / "q")).count() == 0
    # a place that can't be written: the job goes on, and the payload is recorded
    os.mkdir(f"{tmp_path}/s")
    os.makedirs(f"{tmp_path}/s/payloads/{hashlib.sha1(b'a').hexdigest()}.json.gz")
    assert {r["key"]: r["status"] for r in push.push(rows.where("key < 'b'"), f"{tmp_path}/s").collect()} == {"a": 503, "a/../b": 200}


def test_what_arrived_is_read_without_listing_it(spark, tmp_path, monkeypatch):
    """The driver listed every payload, one file each, to read them back."""
    from lodestack import plans

    df = plans.QUERIES["src_sink_push"](spark, "/root/testdata/sf0.001")
    assert df.count() > 100 and not any("/payloads/" in f for f in df.inputFiles())
    monkeypatch.setattr(push, "GATHERED", 10)
    path = str(tmp_path / "p")
    rows = spark.createDataFrame([("a", '{"x":1}'), ("b", "y" * 50), ("c", None), (None, "{}"), ("d", "é" * 10), ("e", "z" * 40), ("f", '{"x":2}')], "key string, payload string").coalesce(1)
    told = push.push(rows, path, most_body=40)
    os.remove(f"{path}/payloads/{hashlib.sha1(b'f').hexdigest()}.json.gz")
    for few, want in ((10, None), (push.MOST_INFLATED, "z" * 40)):
        got = {r["key"]: (r["status"], r["body"]) for r in push.received(told, path, most_inflated=few).collect()}
        assert got == {"a": (200, '{"x":1}'), "b": (413, None), "c": (200, ""), None: (200, "{}"), "d": (200, None if few == 10 else "é" * 10), "e": (200, want), "f": (200, None)}


def test_bodies_are_bounded(spark):
    whole = gzip.compress(b'{"a": 1}')
    bomb = gzip.compress(b"0" * 50_000_000)
    assert push.inflated(bomb, 1_000_000) == (None, "too large") and len(bomb) < 60_000
    assert push.inflated(gzip.compress(b"x" * 100), 100) == ("x" * 100, None) and push.inflated(gzip.compress(b"x" * 101), 100) == (None, "too large")
    rows = [(0, whole), (1, bomb), (2, whole[:-4]), (3, b"plain"), (4, None), (5, b""), (6, gzip.compress(b"{")), (7, gzip.compress(b"\xff")), (8, gzip.compress(os.urandom(2000)))]
    df = spark.createDataFrame([(k, bytearray(b) if b is not None else None) for k, b in rows], "id int, body binary")
    got = {r["id"]: tuple(r["r"]) for r in df.select("id", push.gzip_json(F.col("body"), most_body=1500 + len(bomb), most_inflated=1000).alias("r")).collect()}
    assert got == {0: ('{"a": 1}', None), 1: (None, "too large"), 2: (None, "cut off"), 3: (None, "no gzip"), 4: (None, "empty"), 5: (None, "empty"), 6: (None, "no JSON"), 7: (None, "no UTF-8"), 8: (None, "too large")}


def test_overlays(spark):
    deep = lambda n, leaf: json.dumps(leaf) if n == 0 else f'{{"k":{deep(n - 1, leaf)}}}'
    rows = [(0, '{"a":{"b":1,"c":2},"d":[1]}', '{"a":{"b":{"x":1}},"d":[2,3]}'), (1, '{"a":{"b":1}}', '{"a":null}'), (2, '{"a":1}', '{"a":{"b":2}}'), (3, '{"a":1}', None), (4, None, '{"a":"é"}'), (5, "[1]", "{}"), (6, deep(60, 1), deep(59, {"z": 2})), (7, deep(60, {"y": 1}), deep(60, {"z": 2}))]
    got = {r["id"]: r["m"] for r in spark.createDataFrame(rows, "id int, a string, b string").select("id", push.deep_merge(F.col("a"), F.col("b")).alias("m")).collect()}
    assert {k: json.loads(v) if v else v for k, v in got.items()} == {0: {"a": {"b": {"x": 1}, "c": 2}, "d": [2, 3]}, 1: {"a": None}, 2: {"a": {"b": 2}}, 3: {"a": 1}, 4: {"a": "é"}, 5: None, 6: json.loads(deep(59, {"k": 1, "z": 2})), 7: json.loads(deep(60, {"y": 1, "z": 2}))}


def test_walk(spark, tmp_path):
    root, outside = tmp_path / "root", tmp_path / "outside"
    for name, body in (("root/a.txt", "a"), ("root/src/deep/er/b.py", "bb"), ("root/node_modules/x/c.js", "c"), ("root/.git/config", "g"), ("root/lib/d.SO", "\0"), ("root/src/big.bin", "z" * 100), ("outside/secret", "s")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    os.symlink(outside, root / "out")
    os.symlink(outside / "secret", root / "src" / "secret")
    os.symlink(root / "a.txt", root / "src" / "inside.txt")
    os.symlink(root / "src" / "deep", root / "again")
    os.symlink(tmp_path / "root2", root / "broken")
    files = walk.walk(spark, str(root))
    got = {r["path"]: r["reason"] for r in files.collect()}
    assert got == {"a.txt": None, "src/deep/er/b.py": None, "again/er/b.py": None, "src/inside.txt": None, "lib/d.SO": None, "src/big.bin": None, "node_modules": "skipped", ".git": "skipped", "out": "outside", "src/secret": "outside"}
    read = {r["path"]: (bytes(r["content"]) if r["content"] is not None else None, r["reason"]) for r in walk.contents(spark, str(root), files, limit=50).collect()}
    assert read["src/deep/er/b.py"] == (b"bb", None) and read["src/big.bin"] == (None, "too large") and "src/secret" not in read and len(read) == 6
    assert {r["path"] for r in walk.binaries(files).collect()} == {"lib/d.SO", "src/big.bin"}
    (tmp_path / "empty").mkdir()
    assert walk.walk(spark, str(tmp_path / "empty")).count() == 0


T = datetime.datetime(2024, 1, 1)
RUN = "endpoint long, payload long, bytes long, code int, at timestamp"


def replayed(runs, limits):
    """What becomes of payloads, by plain lists of one endpoint at a time."""
    out = []
    for endpoint in sorted({r[0] for r in runs}):
        queue = []
        for _, payload, size, code, at in sorted((r for r in runs if r[0] == endpoint), key=lambda r: (r[4], r[1])):
            if code == 200:
                for _ in range(limits.retries):
                    if queue:
                        out.append((endpoint, queue.pop(0)[0], "resent", at))
                out.append((endpoint, payload, "sent", at))
            elif len(queue) + 1 > limits.payloads or sum(s for _, s in queue) + size > limits.bytes:
                out.append((endpoint, payload, "dropped", at))
            else:
                queue.append((payload, size))
                out.append((endpoint, payload, "queued", at))
    return sorted(out)


def streamed(spark, tmp_path, limits, parts):
    """Every part is a micro-batch of a stream of its own that goes on from the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for rows in parts:
            spark.createDataFrame(rows, RUN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = retry.retried(spark.readStream.schema(RUN).parquet(str(tmp_path / "in")), limits, late="0 seconds")
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return sorted(map(tuple, spark.read.schema(retry.OUTPUT).parquet(str(tmp_path / "out")).collect()))


def test_queue_matches_a_replay_over_restarts(spark, tmp_path):
    rnd = random.Random(5)
    runs = [(rnd.randint(1, 3), k, rnd.randint(1, 60), rnd.choice([200, 429, 503, 503]), T + datetime.timedelta(minutes=k)) for k in range(90)]
    limits = retry.Limits(payloads=4, bytes=120, retries=2, seconds=10**7)
    got = streamed(spark, tmp_path, limits, [runs[:30], runs[30:60], runs[60:]])
    assert got == replayed(runs, limits) and {o for _, _, o, _ in got} == {"sent", "resent", "queued", "dropped"}


def test_what_waits_too_long_is_evicted(spark, tmp_path):
    at = lambda m: T + datetime.timedelta(minutes=m)
    got = streamed(spark, tmp_path, retry.Limits(seconds=600), [[(1, 1, 5, 503, at(0)), (1, 2, 5, 503, at(8))], [(2, 3, 5, 200, at(15))], [(1, 4, 5, 200, at(16)), (2, 5, 5, 200, at(40))]])
    assert [(p, o) for e, p, o, _ in got if e == 1] == [(1, "expired"), (1, "queued"), (2, "queued"), (2, "resent"), (4, "sent")]


def test_alerts_and_cursor_are_one_commit(spark, tmp_path):
    path = str(tmp_path / "m")
    components = spark.createDataFrame([(1, "p", "1", "npm"), (2, "q", "1", "npm"), (3, "q", "2", "pypi")], "id long, name string, version string, ecosystem string")
    used = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "component_id long, asset_id long")
    ntz = lambda d: T + datetime.timedelta(days=d)
    feed = lambda *rows: spark.createDataFrame([(a, ntz(d), n, e, v, not v) for a, d, n, e, v in rows], "advisory_id long, modified timestamp_ntz, package string, ecosystem string, versions array<string>, all_versions boolean")
    run = malware.match_into(path, components, used)
    alerts = lambda: {(r["advisory_id"], r["package"], r["version"]): (r["asset_count"], r["alert_count"], r["first_batch"], r["last_batch"]) for r in malware.alerts_of(spark, path).collect()}
    run(feed((100, 1, "p", "npm", ["1"]), (101, 2, "nobody", "", [])), 0)
    assert alerts() == {(100, "p", "1"): (2, 1, 0, 0)} and malware.cursor_of(spark, path) == ntz(2)
    second = feed((100, 1, "p", "npm", ["1"]), (102, 2, "q", "", []), (103, 3, "q", "", []), (100, 4, "p", "", ["1", "9"]))
    for _ in range(3):  # the advisory as old as the cursor was read before; a batch that is run again changes nothing
        run(second, 1)
    want = {(100, "p", "1"): (2, 2, 0, 1), (103, "q", "1"): (1, 1, 1, 1), (103, "q", "2"): (0, 1, 1, 1)}
    assert alerts() == want and malware.cursor_of(spark, path) == ntz(4)
    # a batch that broke off before its commit: findings without a version of alerts don't count
    spark.createDataFrame([(999, 1, 10)], "advisory_id long, component_id long, asset_id long").write.parquet(f"{path}/findings/batch=2")
    assert {(r["advisory_id"], r["asset_id"]) for r in malware.findings_of(spark, path).collect()} == {(100, 10), (100, 11), (103, 10)}
    run(feed(), 2)
    assert alerts() == want and malware.cursor_of(spark, path) == ntz(4) and malware.findings_of(spark, path).where("advisory_id = 999").count() == 0


def test_feed_as_a_stream(spark, tmp_path):
    path, schema = str(tmp_path / "m"), "advisory_id long, modified timestamp_ntz, package string, ecosystem string, versions array<string>, all_versions boolean"
    components = spark.createDataFrame([(1, "p", "1", "npm")], "id long, name string, version string, ecosystem string")
    used = spark.createDataFrame([(1, 10)], "component_id long, asset_id long")
    for k in (1, 2, 3):
        spark.createDataFrame([(7, T + datetime.timedelta(days=k), "p", "npm", ["1"], False)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(malware.match_into(path, components, used)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert [(r["alert_count"], r["first_batch"], r["last_batch"]) for r in malware.alerts_of(spark, path).collect()] == [(3, 0, 2)]
