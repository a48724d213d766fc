"""Sources, sinks, dimension tables and streams."""

import json
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltstone import config as C
from siltstone.operators import requests as R
from siltstone.operators import search as S
from siltstone.operators import state as ST
from siltstone.plans import catalogue, lineage
from siltstone.sources import requests as Q
from siltstone.streaming import cache as T

CONFIG = C.ProxyConfig(routes=[C.Route("/a", "http://t")], forward_url="http://t/")


def drained(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def access_lines(tmp_path):
    rows = [{"request_id": k, "ts": f"2024-01-01T00:0{k}:00Z", "method": "GET" if k % 2 else "BREW", "url": f"http://h/p{k}", "path": f"/p{k}", "raw_query": "", "headers": {"A": ["b"]}, "remote_addr": "r"} for k in range(4)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/x.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(tmp_path / "log")


def test_access_log_batch_and_stream(spark, tmp_path):
    path = access_lines(tmp_path)
    batch = R.decide(Q.access_log(spark, path), CONFIG).select("request_id", "target", "status", "ts")
    want = [(0, None, 400), (1, "http://t/p1", 200), (2, None, 400), (3, "http://t/p3", 200)]
    assert sorted(tuple(r)[:3] for r in batch.collect()) == want
    stream = T.decide_stream(Q.access_log(spark, path, stream=True), CONFIG).select("request_id", "target", "status", "ts")
    assert sorted(tuple(r)[:3] for r in drained(stream, tmp_path, "decided").collect()) == want


def test_errors_per_window(spark, tmp_path):
    decided = T.decide_stream(Q.access_log(spark, access_lines(tmp_path), stream=True), CONFIG)
    q = T.errors_per_window(decided).writeStream.format("memory").outputMode("complete").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["status"], r["n"]) for r in spark.table("windows").collect()) == [(200, 1), (200, 1), (400, 1), (400, 1)]


def test_send_each(spark):
    rows = [(1, "GET", "ok", "static", 200), (2, "GET", "slow", "static", 200), (3, "GET", "down", "static", 200), (4, "GET", "bad", "static", 200), (5, "GET", "slow", "header", 200), (6, "GET", "bad", "dynamic", 200), (7, "GET", "down", "dynamic", 200), (8, "BREW", None, "static", 400)]

    def send(method, target):
        if target == "ok":
            return 204
        raise {"slow": TimeoutError, "down": ConnectionRefusedError, "bad": ValueError}[target]

    got = Q.send_each(spark.createDataFrame(rows, "request_id long, method string, target string, strategy string, status int"), send).collect()
    assert {r["request_id"]: r["status"] for r in got} == {1: 204, 2: 504, 3: 503, 4: 500, 5: 502, 6: 500, 7: 502, 8: 400}


def test_live_ports(spark):
    rows = [("a", "x", {"Host": ["h"], "T": ["1"]}), ("a", "x", {"T": ["1"]}), ("b", "x", {}), ("c", "x", None), ("d", "x", {}), ("e&f", "x", {}), ("g", "x", {})]

    def fetch(url, headers):
        client = url.split("clientId=")[1].split("&appName=")[0]
        if client == "d":
            raise ConnectionError("no")
        return {"a": (200, '{"mappingPort":81}' if headers == {"T": ["1"]} else "{}"), "b": (500, '{"mappingPort":1}'), "c": (500, "oops"), "e&f": (200, '{"mappingPort":82}'), "g": (200, "[1]")}[client]

    requests = spark.createDataFrame(rows, "client_id string, app_name string, headers map<string,array<string>>")
    ports = Q.fetch_ports(requests, "http://pm", fetch)
    got = {r["client_id"]: (r["port"], r["error"] and r["error"].split(":")[0]) for r in ports.collect()}
    assert got == {"a": (81, None), "b": (None, "unexpected status code"), "c": (None, "failed to decode response"), "d": (None, "failed to fetch port"), "e&f": (82, None), "g": (None, "failed to decode response")}
    assert R.port_lookup(requests, ports).where("port = 81").count() == 2


def test_envelopes_and_uploads(spark, tmp_path):
    df = spark.createDataFrame([(1, "bad", None), (2, None, "d"), (3, None, None)], "id int, error string, data string")
    Q.write_envelopes(df.select("id", R.envelope(F.col("error"), F.col("data")).alias("body")), str(tmp_path / "e"))
    bodies = {r["id"]: json.loads(r["body"]) for r in spark.read.json(str(tmp_path / "e")).collect()}
    assert bodies == {1: {"code": -1, "message": "bad", "success": False}, 2: {"code": 0, "message": "ok", "success": True, "data": "d"}, 3: {"code": 0, "message": "ok", "success": True}}
    assert df.select(F.to_json(R.proxy_error(F.lit("PROXY_TIMEOUT"), F.col("data"))).alias("x")).first()["x"] == '{"code":"PROXY_TIMEOUT","message":"Request timeout"}'
    files = spark.createDataFrame([("c1", "/a/./b", "x"), ("c1", "c//d", "y")], "client string, path string, content string")
    for _ in range(2):
        S.store_upload(files, str(tmp_path / "u"), "client")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "u")).select("client", "path", "content").collect())) == sorted([("c1", "/a/b", "x"), ("c1", "c/d", "y")] * 2)


def test_dimension_tables_and_yaml(spark):
    c = C.ProxyConfig(routes=[C.Route("/a", "u", timedelta(seconds=5))], rules=[("/x", "/y")], header_forward=C.HeaderForward(True, "V", [C.HeaderForwardPath("/p", "w", "o")]))
    assert [tuple(r) for r in c.route_table(spark).collect()] == [(0, "/a", "u", timedelta(seconds=5))]
    assert [tuple(r) for r in c.rule_table(spark).collect()] == [(0, "/x", "/y")] and [tuple(r) for r in c.header_table(spark).collect()] == [(0, "/p", "w", "o")]
    text = "proxy_config:\n  mode: full_path\n  routes:\n  - path_prefix: /a\n    target: {url: '$TARGET', timeout: 5s}\n"
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(C.ConfigError):
            C.load_yaml(text)
    else:
        assert C.load_yaml(text, {"TARGET": "http://t"}).validated().routes[0] == C.Route("/a", "http://t", timedelta(seconds=5))


def test_cache_state_ends_and_late_rows_go(spark, tmp_path):
    def write(k, minutes):
        spark.createDataFrame([("k", datetime(2024, 1, 1) + timedelta(minutes=m)) for m in minutes], "key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    q = T.cache_stream(stream, "key", "ts", 300, "10 minutes").writeStream.format("memory").queryName("ttl_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    held = []
    for k, minutes in enumerate(([0, 1, 4, 6], [60], [61, 30], [120], [200])):
        write(k, minutes)
        q.processAllAvailable()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    q.stop()
    got = sorted((int((r["ts"] - datetime(2024, 1, 1)).total_seconds()) // 60, r["hit"]) for r in spark.table("ttl_rows").collect())
    assert got == [(0, False), (1, True), (4, True), (6, False), (60, False), (61, True), (120, False), (200, False)]  # 30 came too late
    assert max(held) == 1


def test_allocator_stream_matches_the_replay(spark, sf, tmp_path):
    log = spark.read.parquet(f"{sf}/events.parquet").where("event_type IN ('signup', 'error')").select("event_id", (F.col("user_id") % 3).alias("pool"), F.when(F.col("event_type") == "signup", "acquire").otherwise("release").alias("action"), (8000 + F.col("user_id") % 9).cast("int").alias("slot"))
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    got = drained(T.allocator_stream(stream, "pool", "event_id", "action", "slot", 7), tmp_path, "slots")
    want = ST.allocator_replay(log, "pool", ["event_id"], "action", "slot", 7)
    assert sorted(tuple(r) for r in got.select(F.col("at").alias("event_id"), "result", F.coalesce("allocated", F.lit(-1))).collect()) == sorted(tuple(r) for r in want.select("event_id", "result", F.coalesce("allocated", F.lit(-1))).collect())


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, k, default=None):
            return default

    class Context:
        master, folder = "spark://host:7077", None

        def getCheckpointDir(self):
            return self.folder

        def getConf(self):
            return Conf()

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        lineage.ensure_checkpoint_dir(Session())
    Session.sparkContext.master = "local[4]"
    lineage.ensure_checkpoint_dir(Session())
    assert Session.sparkContext.folder


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_a_cut_leaves_no_shuffle_files(spark):
    """The rows are written, so the shuffles behind them go at once; the session's setting stays, and a forgotten cut's rows go too."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}

    before, setting = files(), spark.conf.get(lineage.CLEANUP)
    counted = spark.range(1000).groupBy((F.col("id") % 50).alias("k")).count()
    rows = lineage.cut(counted.join(counted.withColumnRenamed("count", "n").hint("merge"), "k"))
    until = time.time() + 20
    while files() - before and time.time() < until:  # the executors remove them on their own
        time.sleep(0.2)
    assert not files() - before and rows.count() == 50 and spark.conf.get(lineage.CLEANUP) == setting
    written = Path(rows._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:"))
    assert written.exists()
    lineage.forget(rows)
    assert not written.exists()
