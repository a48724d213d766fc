import json
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.config import ConfigError, HeaderForward, HeaderForwardPath, PortLookup, ProxyConfig, Route, default_config, from_dict, validate_service
from siltstone.functions import headers as H
from siltstone.functions import identity as I
from siltstone.functions import paths as P
from siltstone.functions import text as X
from siltstone.functions.durations import parse_duration
from siltstone.operators import requests as R
from siltstone.operators import state as ST

# Golden cases.
UNIX = [("a//b/c", "a/b/c"), ("a/./b/c", "a/b/c"), ("a/b/../c", "a/c"), ("/a/b/c", "/a/b/c"), (".", "."), ("..", ".."), ("../../a/./b//c/..", "../../a/b"), ("", "."), ("/..", "/"), ("a/..", ".")]
CHILD = [
    ("a", "a/b.txt", True), ("a/", "a/b.txt", True), ("a", "a/b/c.txt", True), ("a", "a", False), ("a", "b.txt", False), ("a/b/", "b/a/b.txt", False), ("a/b", "a/b/c/d.txt", True),
    ("a/b", "a/b/c/../d.txt", True), ("/a", "/a/b", True), ("a", "a/./b", True), (".", "a", True), ("/", "/a", True), ("/", "a", False), ("a", "a/..foo", False), ("a", "/a/b", False), (".", "../x", False),
]
HIDDEN = [
    (".gitignore", True), ("./.test", True), ("/home/user/.config", True), ("README.md", False), ("./dir/file.txt", False), ("/../.cache/file", True), ("//dir//.hidden//", True), ("/", False),
    ("..", False), ("./", False), ("...hidden", True), ("../x", True),
]


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_golden_paths(spark):
    assert [r[0] for r in values(spark, UNIX, "a string, w string", P.to_unix_path(F.col("a")))] == [w for _, w in UNIX]
    assert one(spark, P.to_unix_path(F.lit("a\\b\\c"))) == "a\\b\\c"
    assert one(spark, P.to_unix_path(F.lit("a\\b\\c"), windows=True)) == "a/b/c"
    assert [r[0] for r in values(spark, CHILD, "p string, c string, w boolean", P.is_child(F.col("p"), F.col("c")))] == [w for *_, w in CHILD]
    assert [r[0] for r in values(spark, HIDDEN, "p string, w boolean", P.is_hidden(F.col("p")))] == [w for _, w in HIDDEN]


@pytest.mark.parametrize("path,want", [("", "/"), ("/", "/"), ("a", "/a"), ("//a//b/", "/a/b"), ("/a/", "/a"), ("///", "/")])
def test_clean_url_path(spark, path, want):
    assert one(spark, P.clean_url_path(F.lit(path))) == want
    assert one(spark, P.clean_url_path(P.clean_url_path(F.lit(path)))) == want


def test_url_pieces(spark):
    base = lambda b, p: one(spark, P.join_base(F.lit(b), F.lit(p)))
    assert [base("", "/x"), base("", "x"), base("http://b", "x"), base("http://b//", "/x"), base("http://b", "")] == ["/x", "x", "http://b/x", "http://b/x", "http://b/"]
    full = lambda b, p: one(spark, P.full_path_url(F.lit(b), F.lit(p)))
    assert [full("http://t", "a"), full("http://t", ""), full("http://t/x%20y/", "a b/é%"), full("http://t/b?q#f", "/../c"), full("http://t/%zz", "a")] == ["http://t/a", "http://t/", "http://t/x%20y/a%20b/%C3%A9%25", "http://t/c", None]
    assert one(spark, P.encoded_path(F.lit("/a$&+,:;=@~-._!*'()[]?#"))) == "/a$&+,:;=@~-._%21%2A%27%28%29%5B%5D%3F%23"
    assert one(spark, P.drop_legacy_prefix(F.lit("/éééééétail"))) == "tail"
    assert one(spark, P.path_equal(F.lit("a\\b"), F.lit("a/b"), windows=True)) and not one(spark, P.path_equal(F.lit("a\\b"), F.lit("a/b")))
    assert one(spark, P.strip_proxy_prefix(F.lit("/proxyfoo"))) == "foo"
    assert one(spark, P.full_path_url(F.lit("http://h:1/b?x=1"), F.lit("/a/../c/"))) == "http://h:1/b/c"
    assert one(spark, P.join_once(F.lit("h/"), F.lit("/p"))) == "h//p"
    assert one(spark, P.join_once(F.lit("h"), F.lit("p"))) == "h/p"
    assert one(spark, P.drop_legacy_prefix(F.lit("/not/the/same/path"))) == "/not/the/same/path"[13:]
    assert one(spark, P.drop_legacy_prefix(F.lit("/api/v1/proxy"))) == "/api/v1/proxy"
    assert one(spark, P.first_rule(F.lit("/a/b"), [])) == "/a/b"


def test_header_rules(spark):
    m = F.create_map(F.lit("X-Internal-Id"), F.array(F.lit("1")), F.lit("authorization"), F.array(F.lit("b")), F.lit("Connection"), F.array(F.lit("X-Drop, keep-alive")), F.lit("X-Drop"), F.array(F.lit("d")), F.lit("Empty"), F.array().cast("array<string>"))
    got = one(spark, H.filtered(m, ["X-Internal-*", "Authorization"], {"Connection": "x", "X-Internal-Id": "again"}))
    assert got == {"authorization": ["b"], "X-Drop": ["d"], "Empty": [], "X-Internal-Id": ["again"]}
    assert one(spark, H.filtered(m, ["*"], {})) == {}
    assert "authorization" not in one(spark, H.filtered(m, ["Authorization"], {}, ignore_case=True))
    assert set(one(spark, H.without_connection_tokens(m))) == {"X-Internal-Id", "authorization", "Empty"}
    assert one(spark, H.header(m, "Empty")) == "" and one(spark, H.header(m, "None")) == ""
    assert one(spark, H.size_of(F.create_map(F.lit("ab"), F.array(F.lit("c"), F.lit("dé"))))) == 2 + 1 + 3
    assert one(spark, H.excluded(F.lit("X--Id-1"), ["X-*-Id"])) is True
    assert one(spark, H.canonical(F.lit("x-api-KEY"))) == "X-Api-Key"
    assert one(spark, F.lit(None).isNull()) and one(spark, H.is_sensitive(F.lit("COOKIE")))


def test_text_traps(spark):
    assert one(spark, X.split_lines(F.lit(""))) == []
    assert one(spark, X.split_lines(F.lit("a\n"))) == ["a", ""]
    assert [one(spark, X.count_lines(F.lit(t))) for t in ("", "a", "a\n", "a\nb", "\n")] == [0, 1, 1, 2, 1]
    assert one(spark, X.line_slice(F.lit("a\nb\nc"), 2, -1)) == "b\nc"
    assert one(spark, X.line_slice(F.lit("a\nb\nc"))) == "a\nb\nc"
    assert [one(spark, X.is_blank(F.lit(t))) for t in ("", " \t  ", "x ")] == [True, True, False]
    assert [one(spark, X.decode_base64(F.lit(t))) for t in ("aGk=", "aGk", "%%%", "aG\nk=", "")] == ["hi", "aGk", "%%%", "hi", ""]
    assert one(spark, X.truncate_error(F.lit("a" * 201))) == "a" * 200 + "..."
    assert [one(spark, X.truncate_error(F.lit(t))) for t in ("é" * 150, "x" + "é" * 150, "é" * 100, "世" * 67)] == ["é" * 100 + "...", "x" + "é" * 99 + "...", "é" * 100, "世" * 66 + "..."]
    assert one(spark, X.truncate_error(F.lit(None).cast("string"))) == ""
    assert one(spark, X.ordered_timestamps(F.array(*map(F.lit, [" 7", "9" * 20, "-" + "9" * 20, "+8", "1\n"])))) == [-(2**63), 0, 8, 2**63 - 1]
    assert one(spark, X.join_lines(X.split_lines(F.lit("a\n\nb")))) == "a\n\nb" and one(spark, X.map_values_sorted(F.create_map(F.lit(1), F.lit("z"), F.lit(2), F.lit("a")))) == ["a", "z"]
    assert one(spark, X.distinct_in_order(F.array(*map(F.lit, "baab")))) == ["b", "a"]
    assert one(spark, X.ordered_timestamps(F.array(*map(F.lit, ["10", "abc", "2", "0"])))) == [0, 2, 10]


def test_identity(spark):
    h = F.create_map(F.lit("Clientid"), F.array(F.lit("h")))
    bodies = [('{"clientId":"b"}', "b"), ('{"clientId":5}', "h"), ("{}", "h"), ("oops", "h"), ("[1]", "h"), ('{"clientId":""}', "h")]
    assert [one(spark, I.client_id(F.lit("POST"), F.lit(""), F.lit(b), h)) for b, _ in bodies] == [w for _, w in bodies]
    assert one(spark, I.client_id(F.lit("GET"), F.lit("x=1&clientId=q&clientId=r"), F.lit(""), h)) == "q"
    queries = [("clientId=a%20b", "a b"), ("clientId=a+b", "a b"), ("client%49d=z", "z"), ("clientId=%zz&clientId=r", "r"), ("clientId=a;b", "h"), ("clientId", "h"), ("clientId=a=b", "a=b"), ("", "h")]
    assert [one(spark, I.client_id(F.lit("GET"), F.lit(q), F.lit(""), h)) for q, _ in queries] == [w for _, w in queries]
    assert one(spark, I.mapped_port(F.lit('{"mappingPort":81}'))) == 81 and one(spark, I.mapped_port(F.lit("{}"))) == 0
    token = lambda doc: F.base64(F.encode(F.lit(doc), "UTF-8"))
    docs = [('{"name":"n","email":"a@b"}', "na"), ('{"email":"@b"}', ""), ('{"email":{"name":"x","email":"y@z"}}', "xy"), ('{"name":1}', ""), ("5", "")]
    assert [one(spark, I.user_of_token(token(d))) for d, _ in docs] == [w for _, w in docs]


def test_durations():
    assert parse_duration("") == timedelta(seconds=30) and parse_duration("1m30s") == timedelta(seconds=90) and parse_duration("-1.5h") == timedelta(hours=-1.5)
    for bad in ("5", "s", "1x", "1s 2s"):
        with pytest.raises(ValueError):
            parse_duration(bad)


def test_config_rules():
    ok = lambda **k: ProxyConfig(routes=[Route("/a", "http://t")], **k)
    assert ok().validated().mode == "rewrite" and ok().validated().routes[0].timeout == timedelta(seconds=30)
    c = ProxyConfig(dynamic_port=True, legacy_lookup_url="http://pm", lookup=PortLookup(forward_url="http://f")).validated()
    assert c.lookup.url == "http://pm" and c.lookup.cache_exp == timedelta(minutes=5) and (c.lookup.max_idle, c.lookup.max_idle_per_host) == (10, 5)
    assert not ok(mode="full_path", rewrite_enabled=True).validated().rewrite_enabled
    bad = [ok(mode="x"), ProxyConfig(), ProxyConfig(dynamic_port=True), ProxyConfig(dynamic_port=True, legacy_lookup_url="http://pm"), ProxyConfig(routes=[Route("", "u")]), ProxyConfig(routes=[Route("/a")]), ok(rules=[("", "x")])]
    bad += [ok(header_forward=HeaderForward(True, *x)) for x in (("",), ("H", []), ("H", [HeaderForwardPath("p", "", "w")]))]
    for b in bad:
        with pytest.raises(ConfigError):
            b.validated()
    with pytest.raises(ConfigError):
        validate_service("", ok())
    assert default_config().routes[0].path_prefix == "/"
    raw = {"routes": [{"path_prefix": "/a", "target": {"url": "u", "timeout": "5s"}}], "rewrite": {"enabled": True, "rules": [{"from": "/a", "to": ""}]}, "headers": {"exclude": ["A"]}}
    assert from_dict(raw).validated().routes[0].timeout == timedelta(seconds=5)


def test_request_checks(spark):
    heads = F.create_map(F.lit("K"), F.array(F.lit("v")))
    big = F.create_map(F.lit("K"), F.array(F.repeat(F.lit("v"), F.lit(1 << 20))))
    check = lambda url, h, m: one(spark, R.request_error(url, h, F.lit(m)))
    assert check(F.repeat(F.lit("u"), F.lit(65536)), heads, "GET") is None
    assert check(F.repeat(F.lit("u"), F.lit(65537)), big, "get") == "PROXY_URL_TOO_LONG"
    assert check(F.lit("u"), big, "get") == "PROXY_HEADERS_TOO_LARGE"
    assert check(F.lit("u"), heads, "get") == "PROXY_METHOD_NOT_ALLOWED"
    assert one(spark, R.body_status(F.lit("POST"), F.lit("abc").cast("binary"), 3)) == 413
    assert one(spark, R.body_status(F.lit("GET"), F.lit("abc").cast("binary"), 3)) is None


def route_rows(df):
    return sorted(map(tuple, df.select("path", "path_prefix", "target_url").collect()), key=repr)


def test_routes_of_many_lengths_match_like_few(spark, monkeypatch):
    routes = ProxyConfig(routes=[Route("/a", "1"), Route("/a/b", "2"), Route("/a", "3"), Route("", "4")]).route_table(spark)
    paths = spark.createDataFrame([("/a/bc", 1), ("/ax", 1), ("/b", 1), ("", 1), ("/a/b", 1), (None, 1)], "path string, target_url int").drop("target_url")
    few = route_rows(R.longest_prefix_route(paths, routes))
    monkeypatch.setattr(R, "PROBES", 0)
    assert few == route_rows(R.longest_prefix_route(paths, routes))
    assert ("/ax", "/a", "3") in few and ("/b", None, None) in few and ("/a/b", "/a/b", "2") in few and (None, None, None) in few
    assert R.longest_prefix_route(paths, routes.limit(0)).where("path_prefix IS NULL").count() == 6


@pytest.mark.parametrize("n", [1_000, 50_000])
def test_very_many_routes(spark, n):
    routes = spark.range(n).select(F.lit(1).alias("pos"), F.concat(F.lit("/r/"), F.col("id").cast("string")).alias("path_prefix"), F.concat(F.lit("http://h"), F.col("id").cast("string")).alias("target_url"))
    paths = spark.range(2000).select(F.concat(F.lit("/r/"), (F.col("id") * 7).cast("string"), F.lit("/x")).alias("path"))
    began = time.time()
    got = route_rows(R.longest_prefix_route(paths, routes))
    assert time.time() - began < 5
    known = {f"/r/{k}" for k in range(n)}
    for path, prefix, target in got:
        assert prefix == next((path[:k] for k in range(len(path), 0, -1) if path[:k] in known), None)
        assert target == (prefix and "http://h" + prefix[3:])


def test_very_many_header_paths(spark):
    rules = HeaderForward(True, "V", [HeaderForwardPath(f"/p{k % 990}", f"with{k}", f"without{k}") for k in range(1_000)])
    df = spark.createDataFrame([("/p989", "x"), ("/p0", ""), ("/p990", "x")], "path string, v string")
    got = df.select(R.header_forward_target(F.col("path"), F.create_map(F.lit("V"), F.array("v")), rules).alias("t")).collect()
    assert [r["t"] for r in got] == ["with989", "without0", None]
    assert one(spark, R.header_forward_target(F.lit("/p0"), F.create_map(F.lit("V"), F.array(F.lit("v"))), HeaderForward(False))) is None


def test_allocator_sequence(spark):
    log = [(1, "acquire", None), (2, "acquire", None), (3, "acquire", None), (4, "release", 8000), (5, "release", 8000), (6, "acquire", None)]
    df = spark.createDataFrame([("p", *x) for x in log], "pool string, n int, action string, slot int")
    got = sorted(ST.allocator_replay(df, "pool", ["n"], "action", "slot", 2).collect(), key=lambda r: r["n"])
    assert [(r["result"], r["allocated"]) for r in got] == [("ok", 8000), ("ok", 8001), ("quota", None), ("released", None), ("released", None), ("ok", 8000)]


def test_cache_stream_matches_the_replay(spark, sf, tmp_path):
    from siltstone.streaming.cache import cache_stream

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = cache_stream(stream, "user_id", "ts", 300).writeStream.format("memory").queryName("cache_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = ST.cache_replay(events, "user_id", "ts", 300, "event_id").groupBy("key").agg(F.count_if("hit").alias("h"))
    stream_hits = spark.table("cache_rows").groupBy("key").agg(F.count_if("hit").alias("h"))
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream_hits.collect()))
