"""The registered queries over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import FULL_PATH, HeaderForward, HeaderForwardPath, PortLookup, ProxyConfig, Route
from siltstone.functions import headers as H
from siltstone.functions import identity as I
from siltstone.functions import paths as P
from siltstone.functions import text as X
from siltstone.operators import requests as R
from siltstone.operators import search as S
from siltstone.operators import state as ST
from siltstone.sources.requests import METHOD_CYCLE, requests_of_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ROUTES = [("/en", "http://old"), ("/en/1", "http://one"), ("/fr/", "http://fr"), ("/de/2", "http://de2"), ("/en", "http://en"), ("/e", "http://e")]
RULES = [("/en/1", "/first"), ("/en", "/english"), ("/fr/", "/"), ("/en/1", "/never"), ("/d", "")]
HEADER_PATHS = [("/en/414", "http://with/a", "http://without/a"), ("/en/685", "http://with/b", "http://without/b"), ("/en/414", "http://never", "http://never")]
EXCLUDE, OVERRIDE = ["X-Internal-*", "Authorization"], {"X-Forwarded-Proto": "https"}
TTL_SECONDS, QUOTA = 300, 40
BASE = "http://target.example.com/base/"

CONFIG = ProxyConfig(
    mode="rewrite", routes=[Route(a, b) for a, b in ROUTES], rewrite_enabled=True, rules=RULES, exclude=EXCLUDE, override=OVERRIDE, forward_url=BASE,
    header_forward=HeaderForward(True, "X-Client-Version", [HeaderForwardPath(*p) for p in HEADER_PATHS]), lookup=PortLookup(forward_url="http://192.0.2.1"),
)

_ROUTES = ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(ROUTES))
_RULES = " ".join(f"WHEN starts_with(path, '{a}') THEN '{b}' || substr(path, {len(a) + 1})" for a, b in RULES)
_REQ = f"""req AS (
    SELECT page_id AS request_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
           regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS raw_query, [{", ".join(f"'{m}'" for m in METHOD_CYCLE)}][page_id % 8 + 1] AS method,
           CASE WHEN page_id % 5 = 0 THEN '1.2' ELSE '' END AS version
    FROM pages)"""
_HEADERS = """heads AS (
    SELECT request_id, 'Accept' AS name, '*/*' AS value FROM req
    UNION ALL SELECT request_id, 'Authorization', 'Bearer ' || request_id FROM req WHERE request_id % 3 = 0
    UNION ALL SELECT request_id, 'X-Internal-Trace', request_id::VARCHAR FROM req WHERE request_id % 2 = 0
    UNION ALL SELECT request_id, 'X-Client-Version', CASE WHEN request_id % 5 = 0 THEN '1.2' ELSE '' END FROM req WHERE request_id % 5 < 2
    UNION ALL SELECT request_id, 'Connection', 'keep-alive' FROM req WHERE request_id % 7 = 0
    UNION ALL SELECT request_id, 'Host', 'edge.example.com' FROM req)"""
_CLEAN = "CASE WHEN r = '/' THEN r ELSE regexp_replace(r, '/$', '') END"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return requests_of_pages(_t(spark, d, "pages").select("page_id", "url"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- paths and targets --------------------------------------------------------------------------------------------

@query(f"""WITH {_REQ}, r(pos, p, t) AS (VALUES {_ROUTES}), best AS (
    SELECT request_id, arg_max(p, length(p) * 100 + pos) AS path_prefix, arg_max(t, length(p) * 100 + pos) AS target_url FROM req JOIN r ON starts_with(path, p) GROUP BY 1)
    SELECT request_id, path, path_prefix, target_url FROM req LEFT JOIN best USING (request_id)""")
def longest_prefix_route(spark, d):
    return R.longest_prefix_route(_requests(spark, d), CONFIG.route_table(spark)).select("request_id", "path", "path_prefix", "target_url")


@query(f"WITH {_REQ} SELECT request_id, CASE {_RULES} ELSE path END AS rewritten FROM req")
def first_rule_rewrite(spark, d):
    return _requests(spark, d).select("request_id", P.first_rule(F.col("path"), RULES).alias("rewritten"))


@query(f"WITH {_REQ}, x AS (SELECT request_id, regexp_replace('/' || replace(path, '/', '//') || '/', '/{{2,}}', '/', 'g') AS r FROM req) SELECT request_id, {_CLEAN} AS cleaned FROM x")
def clean_path(spark, d):
    return _requests(spark, d).select("request_id", P.clean_url_path(F.concat(F.replace(F.col("path"), F.lit("/"), F.lit("//")), F.lit("/"))).alias("cleaned"))


@query(f"""WITH {_REQ}, g AS (SELECT *, ['http://b.example.com/x//', '', 'http://b'][request_id % 3 + 1] AS base, CASE WHEN request_id % 2 = 0 THEN path ELSE substr(path, 2) END AS p FROM req)
    SELECT request_id, CASE WHEN base = '' THEN p ELSE rtrim(base, '/') || CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END END AS joined, path || CASE WHEN raw_query = '' THEN '' ELSE '?' || raw_query END AS with_query FROM g""")
def join_path_and_query(spark, d):
    rid, path = F.col("request_id"), F.col("path")
    base = F.get(F.array(F.lit("http://b.example.com/x//"), F.lit(""), F.lit("http://b")), F.pmod(rid, F.lit(3)))
    given = F.when(rid % 2 == 0, path).otherwise(F.substring(path, 2, 9999))
    return _requests(spark, d).select("request_id", P.join_base(base, given).alias("joined"), P.append_query(path, F.col("raw_query")).alias("with_query"))


@query(f"""WITH {_REQ}, g AS (SELECT request_id, ['/proxy', '/proxyx', '/PROXY', '', '/proxy/proxy'][request_id % 5 + 1] || path AS g FROM req)
    SELECT request_id, CASE WHEN starts_with(g, '/proxy') THEN substr(g, 7) ELSE g END AS stripped FROM g""")
def strip_proxy_prefix(spark, d):
    given = F.concat(F.get(F.array(*map(F.lit, ["/proxy", "/proxyx", "/PROXY", "", "/proxy/proxy"])), F.pmod(F.col("request_id"), F.lit(5))), F.col("path"))
    return _requests(spark, d).select("request_id", P.strip_proxy_prefix(given).alias("stripped"))


_SAFE = P.PATH_SAFE + "+"
_ODD_PATHS = ["", "a", "/a b", "/é%/x", "x;y=1/@z", "/(a)!*'", "/a+b//", "/./a/."]
_ODD_SQL = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in _ODD_PATHS) + "]"
_ENCODED = "url_encode(c)"
for _c in _SAFE:
    _ENCODED = f"replace({_ENCODED}, '%{ord(_c):02X}', '{_c}')"


@query(f"""WITH {_REQ}, g AS (SELECT request_id, {_ODD_SQL}[request_id % 8 + 1] || CASE WHEN request_id % 3 = 0 THEN '' ELSE path END AS p FROM req),
    c AS (SELECT request_id, regexp_replace(regexp_replace(regexp_replace('/ba se/' || p, '(/[.])+(/|$)', '/', 'g'), '/+', '/', 'g'), '/$', '') AS c FROM g)
    SELECT request_id, 'http://t.example.com' || {_ENCODED} AS full_url FROM c""")
def full_path_url(spark, d):
    rid = F.col("request_id")
    given = F.concat(F.get(F.array(*map(F.lit, _ODD_PATHS)), F.pmod(rid, F.lit(8))), F.when(rid % 3 == 0, "").otherwise(F.col("path")))
    return _requests(spark, d).select("request_id", P.full_path_url(F.lit("http://t.example.com/ba%20se/?drop=1"), given).alias("full_url"))


@query(f"""WITH {_REQ}, g AS (SELECT *, CASE WHEN request_id % 2 = 0 THEN path ELSE '/éééééé' || path END AS p, CASE WHEN request_id % 3 = 0 THEN path ELSE substr(path, 2) END AS q FROM req)
    SELECT request_id, CASE WHEN starts_with(q, '/') THEN 'http://b' || q ELSE 'http://b/' || q END AS once, CASE WHEN octet_length(encode(p)) > 13 THEN decode(unhex(substr(hex(encode(p)), 27))) ELSE p END AS legacy,
    'http://f:' || (8000 + request_id % 1000) AS ported, regexp_replace(path, '/$', '') AS trimmed FROM g""")
def url_forms(spark, d):
    rid, path = F.col("request_id"), F.col("path")
    wide = F.when(rid % 2 == 0, path).otherwise(F.concat(F.lit("/éééééé"), path))
    bare = F.when(rid % 3 == 0, path).otherwise(F.substring(path, 2, 9999))
    return _requests(spark, d).select("request_id", P.join_once(F.lit("http://b"), bare).alias("once"), P.drop_legacy_prefix(wide).alias("legacy"), P.with_port(F.lit("http://f"), 8000 + rid % 1000).alias("ported"), P.trim_one_slash(path).alias("trimmed"))


@query(f"""WITH {_REQ}, w AS (SELECT request_id, raw_query, CASE {_RULES} ELSE path END AS p FROM req), c AS (SELECT *, regexp_replace('/' || p, '/{{2,}}', '/', 'g') AS r FROM w)
    SELECT request_id, 'http://target.example.com/base' || {_CLEAN} || CASE WHEN raw_query = '' THEN '' ELSE '?' || raw_query END AS target FROM c""")
def static_target(spark, d):
    return _requests(spark, d).select("request_id", R.static_target(F.concat(F.lit("/proxy"), F.col("path")), F.col("raw_query"), CONFIG, BASE).alias("target"))


@query(f"WITH {_REQ} SELECT request_id, 'http://t' || regexp_replace(path, '/$', '') || CASE WHEN raw_query = '' THEN '' ELSE '?' || raw_query END AS target FROM req")
def full_path_target(spark, d):
    return _requests(spark, d).select("request_id", R.static_target(F.col("path"), F.col("raw_query"), ProxyConfig(mode=FULL_PATH), "http://t").alias("target"))


_BELOW = ["/a/b", "", "/a/..", "x", "/..", "/./c"]


@query(f"""WITH {_REQ}, g AS (SELECT *, path || CASE WHEN request_id % 3 = 0 THEN '/.cfg/x' ELSE '/./cfg/x' END AS dotted, regexp_replace(path, '/$', '') AS above, {_BELOW!r}[request_id % 6 + 1] AS tail FROM req),
    k AS (SELECT *, regexp_replace(regexp_replace(path || tail, '/a/[.][.]$', ''), '/[^/]*/+[.][.]$', '') AS reached FROM g)
    SELECT request_id, regexp_replace(path, '/$', '') || '/y' AS cleaned, len(list_filter(string_split(dotted, '/'), lambda s: starts_with(s, '.') AND s NOT IN ('.', '..'))) > 0 AS hidden,
    starts_with(reached, above || '/') AND length(rtrim(regexp_replace(reached, '/[.]/', '/'), '/')) > length(above) AS child, path = path || CASE WHEN request_id % 2 = 0 THEN '' ELSE 'x' END AS same FROM k""")
def path_predicates(spark, d):
    path, rid = F.col("path"), F.col("request_id")
    dotted = F.concat(path, F.when(rid % 3 == 0, "/.cfg/x").otherwise("/./cfg/x"))
    below = F.concat(path, F.get(F.array(*map(F.lit, _BELOW)), F.pmod(rid, F.lit(6))))
    other = F.concat(F.replace(path, F.lit("/"), F.lit("\\")), F.when(rid % 2 == 0, "").otherwise("x"))
    return _requests(spark, d).select("request_id", P.to_unix_path(F.concat(path, F.lit("/./x/../y"))).alias("cleaned"), P.is_hidden(dotted).alias("hidden"), P.is_child(path, below).alias("child"), P.path_equal(path, other, windows=True).alias("same"))


# --- validation, dispatch, routing --------------------------------------------------------------------------------

@query(f"""WITH {_REQ}, g AS (SELECT request_id, method, CASE WHEN request_id % 11 = 0 THEN repeat('u', 65536 + request_id % 2) ELSE url END AS u, CASE WHEN request_id % 13 = 0 THEN repeat('v', 1048574 + request_id % 4) ELSE 'v' END AS v FROM req)
    SELECT request_id, CASE WHEN strlen(u) > 65536 THEN 'PROXY_URL_TOO_LONG' WHEN strlen(v) + 1 > 1048576 THEN 'PROXY_HEADERS_TOO_LARGE' WHEN method NOT IN ('GET', 'POST', 'PUT', 'DELETE', 'PATCH', 'HEAD', 'OPTIONS') THEN 'PROXY_METHOD_NOT_ALLOWED' END AS error FROM g""")
def validate_request(spark, d):
    rid = F.col("request_id")
    url = F.when(rid % 11 == 0, F.repeat(F.lit("u"), (65536 + rid % 2).cast("int"))).otherwise(F.col("url"))
    headers = F.create_map(F.lit("K"), F.array(F.when(rid % 13 == 0, F.repeat(F.lit("v"), (1048574 + rid % 4).cast("int"))).otherwise("v")))
    return _requests(spark, d).select("request_id", R.request_error(url, headers, F.col("method")).alias("error"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) >= 5000 AND doc_id % 2 = 1 THEN 413 END AS status FROM documents")
def body_limit(spark, d):
    method = F.when(F.col("doc_id") % 2 == 1, "POST").otherwise("GET")
    return _t(spark, d, "documents").select("doc_id", R.body_status(method, F.encode("text", "UTF-8"), 5000).alias("status"))


_FORWARD = " ".join(f"WHEN path = '{p}' THEN CASE WHEN version <> '' THEN '{a}' ELSE '{b}' END" for p, a, b in HEADER_PATHS)


@query(f"WITH {_REQ} SELECT request_id, CASE {_FORWARD} END AS forward, CASE WHEN path IN ('/en/414', '/en/685') THEN 'header' WHEN version <> '' THEN 'dynamic' ELSE 'static' END AS strategy FROM req")
def dispatch_strategy(spark, d):
    path, headers = F.col("path"), F.col("headers")
    return _requests(spark, d).select("request_id", R.header_forward_target(path, headers, CONFIG.header_forward).alias("forward"), R.strategy(path, headers, CONFIG).alias("strategy"))


_PATHS = "'/en/685', '/en/676', '/en/770', '/fr/825', '/es/533/'"


@query(f"WITH {_REQ} SELECT request_id, method, path FROM req WHERE method <> 'TRACE' AND path IN ({_PATHS})")
def method_route_exact(spark, d):
    routes = spark.createDataFrame([(p.strip(" '"),) for p in _PATHS.split(",")], "path_prefix string")
    return R.registered(_requests(spark, d), routes).select("request_id", "method", "path")


@query(f"WITH {_REQ} SELECT request_id, method, path FROM req WHERE NOT (method <> 'TRACE' AND path IN ({_PATHS}))")
def unmatched_routes(spark, d):
    routes = spark.createDataFrame([(p.strip(" '"),) for p in _PATHS.split(",")], "path_prefix string")
    return R.registered(_requests(spark, d), routes, "left_anti").select("request_id", "method", "path")


# --- headers ------------------------------------------------------------------------------------------------------

def _flat(df: DataFrame, headers) -> DataFrame:
    return df.select("request_id", F.explode(headers).alias("name", "vs")).select("request_id", "name", F.array_join("vs", ",").alias("value"))


@query(f"""WITH {_REQ}, {_HEADERS} SELECT request_id, name, value FROM heads WHERE name NOT IN ('Authorization', 'X-Internal-Trace', 'Connection', 'Host')
    UNION ALL SELECT request_id, 'X-Forwarded-Proto', 'https' FROM req UNION ALL SELECT request_id, 'Host', 'target' FROM req""")
def filter_headers_flat(spark, d):
    return _flat(_requests(spark, d), H.filtered(F.col("headers"), EXCLUDE, OVERRIDE, F.lit("target")))


@query(f"WITH {_REQ}, {_HEADERS} SELECT request_id, name, value FROM heads WHERE name NOT IN ('Connection')")
def hop_by_hop(spark, d):
    return _flat(_requests(spark, d), H.without(F.col("headers"), H.HOP_BY_HOP_LONG))


_NAMES = [*H.SENSITIVE, "Content-Length", "HOST", "X-API-KEY", "Cookie2", "Accept"]


@query(f"""WITH {_REQ} SELECT request_id, name, lower(name) IN {H.SENSITIVE} AS sensitive FROM req, (SELECT unnest({_NAMES}) AS name) WHERE lower(name) NOT IN ('host', 'content-length')""")
def sensitive_headers(spark, d):
    headers = F.create_map(*[x for n in _NAMES for x in (F.lit(n), F.array(F.col("path")))])
    return _flat(_requests(spark, d), H.lookup_headers(headers)).select("request_id", "name", H.is_sensitive(F.col("name")).alias("sensitive"))


@query(f"WITH {_REQ}, {_HEADERS} SELECT request_id, sum(octet_length(encode(name)) + octet_length(encode(value)))::BIGINT AS bytes FROM heads GROUP BY 1")
def header_size(spark, d):
    return _requests(spark, d).select("request_id", H.size_of(F.col("headers")).alias("bytes"))


@query(f"WITH {_REQ}, {_HEADERS} SELECT request_id, name, CASE WHEN name = 'Accept' THEN value || ',text/html' ELSE value END AS value FROM heads UNION ALL SELECT request_id, 'Via', 'edge' FROM req")
def merged_headers(spark, d):
    more = F.create_map(F.lit("Accept"), F.array(F.lit("text/html")), F.lit("Via"), F.array(F.lit("edge")))
    return _flat(_requests(spark, d), H.merged(F.col("headers"), more))


# --- identity and lookups -----------------------------------------------------------------------------------------

# GET reads the query: plain, an escaped value, a plus, an escaped key, a broken pair before a good one, a semicolon, an empty value
_QUERIES = ["a=1&clientId=q", "clientId=a%20b", "x&clientId=a+b%2B", "client%49d=z", "clientId=%zz&clientId=ok", "clientId=a;b&b=1", "clientId=&clientId=no", "clientid=no"]
_DECODED = ["q", "a b", "a b+", "z", "ok", None, None, None]


@query(f"""WITH q AS (SELECT event_id, user_id, {_QUERIES!r}[event_id // 2 % 8 + 1] AS q, event_id % 2 = 0 AS get FROM events),
    p AS (SELECT event_id, unnest(string_split(q, '&')) AS part, generate_subscripts(string_split(q, '&'), 1) AS i FROM q WHERE get),
    s AS (SELECT event_id, i, replace(string_split(part, '=')[1], '+', ' ') AS k, replace(coalesce(string_split(part, '=')[2], ''), '+', ' ') AS v FROM p WHERE NOT contains(part, ';')),
    f AS (SELECT event_id, arg_min(url_decode(v), i) AS v FROM s WHERE url_decode(k) = 'clientId' AND NOT regexp_matches(v, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') GROUP BY 1)
    SELECT event_id, CASE WHEN get AND coalesce(v, '') <> '' THEN v WHEN NOT get AND event_id % 5 = 1 THEN 'b' || user_id ELSE 'h' || user_id END AS client_id FROM q LEFT JOIN f USING (event_id)""")
def client_id_extract(spark, d):
    user = F.col("user_id").cast("string")
    method = F.when(F.col("event_id") % 2 == 0, "GET").otherwise("POST")
    body = F.when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"clientId":"b'), user, F.lit('"}'))).when(F.col("event_id") % 5 == 2, F.concat(F.lit('{"clientId":'), user, F.lit("}"))).when(F.col("event_id") % 5 == 3, "{broken").otherwise(F.col("props"))
    headers = F.create_map(F.lit("Clientid"), F.array(F.concat(F.lit("h"), user)))
    query_ = F.get(F.array(*map(F.lit, _QUERIES)), F.expr("event_id div 2 % 8").cast("int"))
    return _t(spark, d, "events").select("event_id", I.client_id(method, query_, body, headers).alias("client_id"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name || 'u' || c_custkey WHEN 1 THEN c_name WHEN 2 THEN 'n' || c_custkey || 'm' WHEN 3 THEN '' ELSE '' END AS username FROM customer""")
def user_identity(spark, d):
    key, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 5
    doc = (
        F.when(k == 0, F.concat(F.lit('{"name":"'), F.col("c_name"), F.lit('","email":"u'), key, F.lit('@x.org"}')))
        .when(k == 1, F.concat(F.lit('{"name":"'), F.col("c_name"), F.lit('","email":"@x.org"}')))
        .when(k == 2, F.concat(F.lit('{"name":5,"email":{"name":"n'), key, F.lit('","email":"m@x"}}')))
        .otherwise('{"other":1}')
    )
    token = F.when(k == 4, "%%%").otherwise(F.base64(F.encode(doc, "UTF-8")))
    return _t(spark, d, "customer").select("c_custkey", I.user_of_token(token).alias("username"))


@query("""SELECT event_id, 'http://192.0.2.1:' || (8000 + user_id % 1000) || '/x' AS url FROM events WHERE user_id % 3 <> 0
    UNION ALL SELECT event_id, NULL FROM events WHERE user_id % 3 = 0""")
def port_lookup_url(spark, d):
    events = _t(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("client_id"), F.lit("app").alias("app_name"))
    mapping = _t(spark, d, "events").where("user_id % 3 <> 0").select(F.col("user_id").cast("string").alias("client_id"), F.lit("app").alias("app_name"), (8000 + F.col("user_id") % 1000).cast("int").alias("port"), F.col("ts").alias("fetched_at"))
    return R.port_lookup(events, mapping).select("event_id", R.dynamic_target("http://192.0.2.1/", F.col("port"), F.lit("/x"), F.lit("")).alias("url"))


@query(f"""WITH RECURSIVE f AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1
    UNION ALL SELECT user_id, nxt FROM (SELECT f.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = f.user_id AND e.ts >= f.ts + INTERVAL {TTL_SECONDS} SECOND) AS nxt FROM f) WHERE nxt IS NOT NULL),
    n AS (SELECT e.user_id, count(*) AS n FROM events e GROUP BY 1), m AS (SELECT user_id, count(*) AS m FROM f GROUP BY 1)
    SELECT user_id::VARCHAR AS key, (n - m)::BIGINT AS hits, m::BIGINT AS misses FROM n JOIN m USING (user_id)""")
def ttl_cache_hits(spark, d):
    return ST.cache_replay(_t(spark, d, "events"), "user_id", "ts", TTL_SECONDS, "event_id").groupBy("key").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query(f"""WITH RECURSIVE log AS (
        SELECT event_id, ts, user_id % 4 AS pool, CASE WHEN event_type = 'signup' THEN 'acquire' ELSE 'release' END AS action, (8000 + user_id % 40)::INTEGER AS slot,
               row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('signup', 'error')),
    run AS (
        SELECT pool, 0::BIGINT AS n, []::INTEGER[] AS held, NULL::VARCHAR AS result, NULL::INTEGER AS allocated FROM (SELECT DISTINCT pool FROM log)
        UNION ALL
        SELECT pool, n, CASE WHEN result = 'ok' THEN list_append(held, allocated) WHEN result = 'released' THEN list_filter(held, lambda h: h <> slot) ELSE held END, result, CASE WHEN result = 'ok' THEN allocated END
        FROM (SELECT l.pool, l.n, held, slot, CASE WHEN action = 'release' THEN 'released' WHEN len(held) >= {QUOTA} THEN 'quota' WHEN len(held) >= 1000 THEN 'exhausted' ELSE 'ok' END AS result,
                     list_filter(range(8000, 9000), lambda s: NOT list_contains(held, s::INTEGER))[1]::INTEGER AS allocated
              FROM run JOIN log l ON l.pool = run.pool AND l.n = run.n + 1))
    SELECT event_id, pool, action, slot, result, allocated FROM run JOIN log USING (pool, n)""")
def port_allocate(spark, d):
    log = _t(spark, d, "events").where("event_type IN ('signup', 'error')").select("event_id", "ts", (F.col("user_id") % 4).alias("pool"), F.when(F.col("event_type") == "signup", "acquire").otherwise("release").alias("action"), (8000 + F.col("user_id") % 40).cast("int").alias("slot"))
    return ST.allocator_replay(log, "pool", ["ts", "event_id"], "action", "slot", QUOTA).select("event_id", "pool", "action", "slot", "result", "allocated")


# --- errors and health --------------------------------------------------------------------------------------------

_CODES = ["PROXY_TIMEOUT", "PROXY_TARGET_UNREACHABLE", "PROXY_BAD_REQUEST", "PROXY_INTERNAL_ERROR", "OTHER"]
_CODE_SQL = f"[{', '.join(repr(c) for c in _CODES)}][event_id % 5 + 1]"


@query(f"""SELECT event_id, {_CODE_SQL} AS code, {[R.STATUS.get(c, 500) for c in _CODES]}[event_id % 5 + 1] AS status, {[R.MESSAGES.get(c, "Bad request") for c in _CODES]}[event_id % 5 + 1] AS message,
    [400, 413, 500, 502, 500][event_id % 5 + 1] AS dynamic_status, [500, 500, 500, 502, 500][event_id % 5 + 1] AS header_status, 500 AS static_status FROM events""")
def error_classify(spark, d):
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), F.pmod(F.col("event_id"), F.lit(5)))
    code = pick(_CODES)
    return _t(spark, d, "events").select("event_id", code.alias("code"), R.error_status(code).alias("status"), R.proxy_error(code, F.lit("d"))["message"].alias("message"), *(R.stage_status(F.lit(s), pick(["port", "size", "build", "send", "none"])).alias(f"{s}_status") for s in ("dynamic", "header", "static")))


@query("""SELECT event_id, ['invalid request params: ' || event_type || ' ' || user_id, event_type || ' not found by ' || user_id, 'missing required param: ' || event_type, 'read timeout', NULL][event_id % 5 + 1] AS message,
    [404, 501, 503, NULL, NULL][event_id % 5 + 1] AS status FROM events""")
def error_messages(spark, d):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    pick = lambda xs: F.get(F.array(*xs), F.pmod(F.col("event_id"), F.lit(5)))
    text = pick([R.invalid_param(kind, user), R.record_not_found(kind, user), R.missing_param(kind), R.sentinel(F.lit("ReadTimeout")), R.sentinel(kind)])
    return _t(spark, d, "events").select("event_id", text.alias("message"), R.handler_status(pick(list(map(F.lit, ["no_route", "not_configured", "no_handler", "other", None])))).alias("status"))


@query(f"""WITH {_REQ}, {_HEADERS} SELECT request_id, (200 + request_id % 5)::INTEGER AS status, name, CASE WHEN name = 'Accept' THEN 'own,' || value ELSE value END AS value, octet_length(encode(url)) AS n_body FROM heads JOIN req USING (request_id)""")
def copied_response(spark, d):
    own = F.create_map(F.lit("Accept"), F.array(F.lit("own")))
    rows = _requests(spark, d).withColumn("r", R.copied_response((200 + F.col("request_id") % 5).cast("int"), F.col("headers"), F.encode("url", "UTF-8"), own))
    return rows.select("request_id", "r.status", F.octet_length("r.body").cast("long").alias("n_body"), F.explode("r.headers").alias("name", "vs")).select("request_id", "status", "name", F.array_join("vs", ",").alias("value"), "n_body")


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN '{"code":' || user_id || ',"message":"bad ' || event_id || '","success":false}' WHEN event_id % 2 = 0 THEN '{"code":-1,"message":"bad ' || event_id || '","success":false}'
    WHEN event_id % 7 = 0 THEN '{"code":0,"message":"ok","success":true}' ELSE '{"code":0,"message":"ok","success":true,"data":"' || event_type || '"}' END AS body FROM events""")
def error_envelope(spark, d):
    error = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("bad "), F.col("event_id").cast("string")))
    code, data = F.when(F.col("event_id") % 6 == 0, F.col("user_id").cast("int")), F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    return _t(spark, d, "events").select("event_id", R.envelope(error, data, code).alias("body"))


@query("""SELECT event_type, count(*) AS n_probes, count(*) FILTER (WHERE event_id % 7 <> 0 AND 150 + event_id % 200 BETWEEN 200 AND 299) AS n_ok,
    count(*) FILTER (WHERE event_id % 7 <> 0 AND NOT 150 + event_id % 200 BETWEEN 200 AND 299) AS n_unhealthy, count(*) FILTER (WHERE event_id % 7 = 0) AS n_error FROM events GROUP BY 1""")
def health_summary(spark, d):
    probes = _t(spark, d, "events").select("event_type", (150 + F.col("event_id") % 200).alias("status"), F.when(F.col("event_id") % 7 == 0, "refused").alias("error"))
    return R.health_summary(probes, "event_type")


@query("SELECT event_type, 'e' || event_id % 14 AS error, count(*) AS n_probes FROM events WHERE event_id % 7 = 0 GROUP BY ALL")
def health_errors(spark, d):
    probes = _t(spark, d, "events").select("event_type", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("e"), (F.col("event_id") % 14).cast("string"))).alias("error"))
    return R.health_errors(probes, "event_type")


@query("""SELECT '{"status":"ok","target":"http://q\\"x","reachable":true,"response_time_ms":0}' AS body""")
def constant_health(spark, d):
    return spark.range(1).select(R.constant_health(ProxyConfig(routes=[Route("/", 'http://q"x')])).alias("body"))


@query(f"""WITH r(pos, path_prefix, target_url) AS (VALUES {_ROUTES}), p AS (SELECT '/' || event_type AS path_prefix, event_id, 150 + event_id % 200 AS status, event_id % 7 = 0 AS bad FROM events), q AS (SELECT DISTINCT path_prefix, 'http://' || substr(path_prefix, 2) AS target_url FROM p)
    SELECT path_prefix, count(*) FILTER (WHERE NOT bad AND status BETWEEN 200 AND 299) AS n_healthy, (sum(event_id) FILTER (WHERE NOT bad))::BIGINT AS duration_ms FROM p JOIN q USING (path_prefix) GROUP BY 1""")
def route_health(spark, d):
    events = _t(spark, d, "events")
    name = F.concat(F.lit("/"), F.col("event_type")).alias("path_prefix")
    probes = events.select(name, (150 + F.col("event_id") % 200).alias("status"), F.when(F.col("event_id") % 7 == 0, "refused").alias("error"), F.col("event_id").alias("duration_ms"))
    routes = events.select(name, F.concat(F.lit("http://"), F.col("event_type")).alias("target_url")).distinct()
    return R.route_health(routes, probes).groupBy("path_prefix").agg(F.count_if("healthy").alias("n_healthy"), F.sum("duration_ms").alias("duration_ms"))


# --- text ---------------------------------------------------------------------------------------------------------

@query("SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END)::BIGINT AS n_lines, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_split, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS middle FROM documents")
def lines(spark, d):
    text = F.col("text")
    return _t(spark, d, "documents").select("doc_id", X.count_lines(text).alias("n_lines"), F.size(X.split_lines(text)).cast("long").alias("n_split"), X.line_slice(text, 2, 3).alias("middle"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN left(source, 40) WHEN doc_id % 3 = 1 THEN 'aGk' ELSE 'no base64!' END AS decoded, doc_id % 4 = 0 AS blank,
    CASE WHEN strlen(t) > 200 THEN left(t, list_max(list_filter(range(201), lambda n: strlen(left(t, n::INTEGER)) <= 200))::INTEGER) || '...' ELSE t END AS short, doc_id || ',7' AS joined, source || ',x' AS map_values, source || chr(10) || lang AS rejoined
    FROM (SELECT *, repeat('é', (doc_id % 3)::INTEGER) || 'x' || CASE WHEN doc_id % 2 = 0 THEN repeat('é世', 60) ELSE text END AS t FROM documents)""")
def text_functions(spark, d):
    k = F.col("doc_id")
    encoded = F.when(k % 3 == 0, F.base64(F.encode(F.left("source", F.lit(40)), "UTF-8"))).when(k % 3 == 1, "aGk").otherwise("no base64!")
    blank = F.when(k % 4 == 0, "  \t\n ").otherwise(" x ")
    long = F.concat(F.repeat(F.lit("é"), (k % 3).cast("int")), F.lit("x"), F.when(k % 2 == 0, F.repeat(F.lit("é世"), F.lit(60))).otherwise(F.col("text")))
    values = F.array_join(X.map_values_sorted(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.col("source"))), ",")
    rejoined = X.join_lines(F.array("source", "lang"))
    return _t(spark, d, "documents").select("doc_id", X.decode_base64(encoded).alias("decoded"), X.is_blank(blank).alias("blank"), X.truncate_error(long).alias("short"), X.join_numbers(F.array(k, F.lit(7).cast("long"))).alias("joined"), values.alias("map_values"), rejoined.alias("rejoined"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents), f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY 1, 2)
    SELECT doc_id, count(*) AS n_distinct, md5(string_agg(w, ' ' ORDER BY i)) AS in_order FROM f GROUP BY 1""")
def dedup_words(spark, d):
    words = X.distinct_in_order(F.split("text", " "))
    return _t(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("n_distinct"), F.md5(F.encode(F.array_join(words, " "), "UTF-8")).alias("in_order"))


_ITEMS = ["abc", " 7", "+8", "-9", "99999999999999999999", "-99999999999999999999", "", "1_0", "9223372036854775807", "1.5"]


@query(f"""WITH x AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN {_ITEMS!r}[event_id // 3 % 10 + 1] ELSE (event_id % 50)::VARCHAR END AS s FROM events),
    v AS (SELECT user_id, CASE WHEN NOT regexp_full_match(s, '[+-]?[0-9]+') THEN 0 ELSE coalesce(try_cast(s AS BIGINT), CASE WHEN starts_with(s, '-') THEN -9223372036854775808 ELSE 9223372036854775807 END) END AS v FROM x)
    SELECT DISTINCT user_id, v::BIGINT AS at FROM v""")
def ordered_timestamps(spark, d):
    odd = F.get(F.array(*map(F.lit, _ITEMS)), F.expr("event_id div 3 % 10").cast("int"))
    item = F.when(F.col("event_id") % 3 == 0, odd).otherwise((F.col("event_id") % 50).cast("string"))
    return X.ordered_timestamps_by(_t(spark, d, "events").select("user_id", item.alias("item")), "user_id", "item")


# --- code search --------------------------------------------------------------------------------------------------

@query("""WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.e), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.e) DESC, vec_id LIMIT 10""")
def semantic_topk(spark, d):
    vectors = _t(spark, d, "embeddings")
    first = vectors.where("vec_id = 0").select("embedding").first()
    return S.semantic_top_k(vectors, list(first["embedding"]) if first else [0.0]).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT 'd/' || doc_id AS path, md5(text) AS hash FROM documents")
def hash_list(spark, d):
    return S.file_hashes(_t(spark, d, "documents"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")), F.col("text"))


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 10 = 1 THEN 'added' WHEN doc_id % 10 = 2 THEN 'deleted' ELSE 'modified' END AS change FROM documents WHERE doc_id % 10 IN (1, 2, 3)""")
def hash_diff(spark, d):
    docs = _t(spark, d, "documents")
    path = F.col("doc_id").cast("string")
    client = S.file_hashes(docs.where("doc_id % 10 <> 2"), path, F.col("text"))
    server = S.file_hashes(docs.where("doc_id % 10 <> 1"), path, F.when(F.col("doc_id") % 10 == 3, F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text")))
    return S.hash_diff(client, server)


@query(f"""WITH {_REQ}, f AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS p, length(url) AS size FROM req), g AS (SELECT p, size, unnest(range(1, len(p) + 1)) AS depth FROM f)
    SELECT '/' || array_to_string(p[1:depth], '/') AS path, CASE WHEN depth = 1 THEN '/' ELSE '/' || array_to_string(p[1:depth - 1], '/') END AS parent, depth::INTEGER AS depth, bool_or(depth < len(p)) AS is_dir, count(*) AS n_files, sum(size)::BIGINT AS size FROM g GROUP BY 1, 2, 3""")
def directory_tree(spark, d):
    return S.directory_tree(_requests(spark, d).select("path", F.length("url").alias("size")))


@query(f"""WITH {_REQ}, f AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS p, length(url) AS size FROM req), b AS (SELECT p[2:] AS p, size FROM f WHERE p[1] = 'en' AND len(p) > 1)
    SELECT '/en/' || p[1] AS path, '/en' AS parent, 1 AS depth, true AS is_dir, count(*) AS n_files, sum(size)::BIGINT AS size FROM b WHERE len(p) > 1 GROUP BY 1""")
def directory_subtree(spark, d):
    return S.directory_tree(_requests(spark, d).select("path", F.length("url").alias("size")), depth=1, include_files=False, sub_dir="/en/")


@query("SELECT count(*) AS total_files, sum(length(url))::BIGINT AS total_size FROM pages")
def tree_totals(spark, d):
    return S.tree_totals(_t(spark, d, "pages").select(F.length("url").alias("size")))


@query("SELECT lang, count(DISTINCT doc_id) AS total_files, sum(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN right(text, 1) <> chr(10) THEN 1 ELSE 0 END END)::BIGINT AS total_chunks, max(doc_id) AS last_id FROM documents GROUP BY 1")
def index_summary(spark, d):
    return S.index_summary(_t(spark, d, "documents"), "lang", "text", "doc_id")


@query("""SELECT a.conv_id, a.turn AS asked, b.turn AS found FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn * 10 <= a.turn * 10 + 12 AND b.turn * 10 + 9 >= a.turn * 10 + 5""")
def definition_overlap(spark, d):
    turns = _t(spark, d, "conversations")
    symbols = turns.select(F.col("conv_id").alias("path"), F.col("turn").alias("found"), (F.col("turn") * 10).alias("start_line"), (F.col("turn") * 10 + 9).alias("end_line"))
    wanted = turns.select(F.col("conv_id").alias("path"), F.col("turn").alias("asked"), (F.col("turn") * 10 + 5).alias("from_line"), (F.col("turn") * 10 + 12).alias("to_line"))
    return S.definitions(symbols, wanted).select(F.col("path").alias("conv_id"), "asked", "found")


@query("""WITH s AS (SELECT DISTINCT event_type AS name, 'f/' || event_type AS path FROM events), r AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || '(signup, x' || user_id || '.' || event_type || ')' ELSE 'x' || event_type END AS snippet FROM events)
    SELECT DISTINCT event_id, name, path FROM r JOIN s ON list_contains(regexp_extract_all(snippet, '[a-z_][a-z_0-9]*'), name)""")
def definition_by_snippet(spark, d):
    events = _t(spark, d, "events")
    snippet = F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit("(signup, x"), F.col("user_id").cast("string"), F.lit("."), F.col("event_type"), F.lit(")"))).otherwise(F.concat(F.lit("x"), F.col("event_type")))
    symbols = events.select(F.col("event_type").alias("name"), F.concat(F.lit("f/"), F.col("event_type")).alias("path")).distinct()
    return S.definitions_of_snippets(symbols, events.select("event_id", snippet.alias("snippet"))).select("event_id", "name", "path")


@query("""SELECT CASE WHEN doc_id % 4 < 3 THEN left(sha256('{"index_type":"' || kind || '","files":[{"key":"a' || doc_id || '","value":"' || lang || '"},{"key":"b","value":"x"}]}'), 32) END AS task_id, kind AS index_type, doc_id
    FROM (SELECT *, ['embedding', 'codegraph', 'all', 'other'][doc_id % 4 + 1] AS kind FROM documents)""")
def index_tasks(spark, d):
    kind = F.get(F.array(*map(F.lit, ["embedding", "codegraph", "all", "other"])), F.pmod(F.col("doc_id"), F.lit(4)))
    rows = _t(spark, d, "documents").select(kind.alias("index_type"), F.create_map(F.lit("b"), F.lit("x"), F.concat(F.lit("a"), F.col("doc_id").cast("string")), F.col("lang")).alias("files"))
    return S.index_tasks(rows).select("task_id", "index_type", F.substring(F.array_min(F.map_keys("files")), 2, 20).cast("long").alias("doc_id"))


@query("""SELECT 'r' || r_regionkey AS root, r_name AS content, 'definition' AS node_type, 0 AS layer, r_regionkey::INTEGER AS start_line FROM region
    UNION ALL SELECT 'r' || n_regionkey, n_name, 'reference', 1, n_nationkey::INTEGER FROM nation""")
def relation_nodes(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    region, nation = _t(spark, d, "region"), _t(spark, d, "nation")
    place = lambda key: [F.col(key).cast("int").alias("start_line"), *(F.lit(0).alias(c) for c in ("start_column", "end_line", "end_column"))]
    nodes = region.select(name("r", "r_regionkey").alias("node"), F.lit("definition").alias("node_type"), F.lit("f").alias("path"), *place("r_regionkey"), F.col("r_name").alias("content"))
    nodes = nodes.unionByName(nation.select(name("n", "n_nationkey").alias("node"), F.lit("reference").alias("node_type"), F.lit("f").alias("path"), *place("n_nationkey"), F.col("n_name").alias("content")))
    tree = S.relation_tree(nation.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")), region.select(name("r", "r_regionkey").alias("root")))
    return S.with_nodes(tree, nodes, content=True).select("root", "content", "node_type", "layer", F.col("position.start_line").alias("start_line"))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3")
def file_structure(spark, d):
    turns = _t(spark, d, "conversations").withColumn("path", F.col("conv_id"))
    return S.structure(turns, F.lit(3)).select("conv_id", "turn", "role")


@query("""SELECT 'r' || r_regionkey AS root, layer, count(*) AS n FROM (
    SELECT r_regionkey, 0 AS layer FROM region UNION ALL SELECT n_regionkey, 1 FROM nation UNION ALL SELECT n_regionkey, 2 FROM nation JOIN customer ON c_nationkey = n_nationkey
    UNION ALL SELECT n_regionkey, 3 FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey) GROUP BY 1, 2""")
def relation_tree(spark, d):
    t = lambda n: _t(spark, d, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = t("nation").select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"))
    edges = edges.unionByName(t("customer").select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child"))).unionByName(t("orders").select(name("c", "o_custkey").alias("parent"), name("o", "o_orderkey").alias("child")))
    roots = t("region").select(name("r", "r_regionkey").alias("root"))
    return S.relation_tree(edges, roots, 4).groupBy("root", "layer").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_index(spark, d):
    gone = _t(spark, d, "labels").where("toxic = 1").select("doc_id")
    return S.without_deleted(_t(spark, d, "documents").select("doc_id", "lang"), gone, "doc_id")


@query(f"""WITH {_REQ}, w AS (SELECT *, CASE {_RULES} ELSE path END AS p, CASE WHEN raw_query = '' THEN '' ELSE '?' || raw_query END AS q, CASE {_FORWARD} END AS fwd FROM req),
    c AS (SELECT *, regexp_replace('/' || p, '/{{2,}}', '/', 'g') AS r FROM w)
    SELECT request_id, CASE WHEN method = 'TRACE' THEN 'PROXY_METHOD_NOT_ALLOWED' END AS error, CASE WHEN fwd IS NOT NULL THEN 'header' WHEN version <> '' THEN 'dynamic' ELSE 'static' END AS strategy,
    CASE WHEN method = 'TRACE' THEN NULL WHEN fwd IS NOT NULL THEN fwd || q WHEN version <> '' THEN 'http://192.0.2.1:' || (8000 + request_id % 1000) || path || q ELSE 'http://target.example.com/base' || {_CLEAN} || q END AS target,
    CASE WHEN method = 'TRACE' THEN 400 ELSE 200 END AS status FROM c""")
def decide_requests(spark, d):
    rows = _requests(spark, d).withColumns({"client_id": F.col("request_id").cast("string"), "app_name": F.lit("app")})
    mapping = rows.select("client_id", "app_name", (8000 + F.col("request_id") % 1000).cast("int").alias("port"), F.lit(None).cast("timestamp").alias("fetched_at"))
    return R.decide(rows, CONFIG, mapping).select("request_id", "error", "strategy", "target", "status")
