"""Request decisions: validation, dispatch, routing, targets, errors and health over a DataFrame of request rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.config import FULL_PATH, HeaderForward, ProxyConfig
from siltstone.functions import headers as H
from siltstone.functions import paths as P

MAX_URL, MAX_HEADERS, MAX_BODY = 65536, 1 << 20, 100 << 20
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
#: Routes of up to so many different lengths are probed once for each length; of more, each path is expanded to its prefixes.
PROBES = 32


# --- validation ---------------------------------------------------------------------------------------------------

def request_error(url: Column, headers: Column, method: Column) -> Column:
    """FLT-01..04: the code of the first check that fails, null if none does."""
    return (
        F.when(F.octet_length(url) > MAX_URL, "PROXY_URL_TOO_LONG")
        .when(H.size_of(headers) > MAX_HEADERS, "PROXY_HEADERS_TOO_LARGE")
        .when(~F.coalesce(method.isin(*METHODS), F.lit(False)), "PROXY_METHOD_NOT_ALLOWED")
    )


def body_status(method: Column, body: Column, limit: int = MAX_BODY) -> Column:
    """FLT-05, SRC-06: 413 for a body that reaches the limit; GET bodies are not read."""
    return F.when((method != "GET") & (F.octet_length(body) >= limit), 413)


# --- dispatch -----------------------------------------------------------------------------------------------------

def header_forward_target(path: Column, headers: Column, rules: HeaderForward) -> Column:
    """JON-05: the first rule of exactly this path gives one of two URLs by the header's presence."""
    first: dict = {}
    for p in rules.paths if rules.enabled else []:
        first.setdefault(p.path, p)
    given = H.header(headers, rules.header_name) != ""
    pick = lambda url: lookup(path, {k: url(p) for k, p in first.items()}, None)
    return F.when(given, pick(lambda p: p.with_url)).otherwise(pick(lambda p: p.without_url))


def strategy(path: Column, headers: Column, config: ProxyConfig, version_header: str = "X-Client-Version") -> Column:
    """DSP-01: forwarding by header, then the version header, then a fixed target if there is one, else dynamic."""
    forwarded = header_forward_target(path, headers, config.header_forward).isNotNull()
    fallback = "static" if config.forward_url else "dynamic"
    return F.when(forwarded, "header").when(H.header(headers, version_header) != "", "dynamic").otherwise(fallback)


# --- routing ------------------------------------------------------------------------------------------------------

def last_route_wins(routes: DataFrame) -> DataFrame:
    """JON-02: of equal prefixes the last in the list; the empty prefix never wins a match."""
    return routes.where("path_prefix <> ''").groupBy("path_prefix").agg(F.max_by("target_url", "pos").alias("target_url"))


def longest_prefix_route(requests: DataFrame, routes: DataFrame, path: str = "path") -> DataFrame:
    """JON-01, AGG-02: adds path_prefix and target_url of the longest route that is a string prefix; null where none is.

    The path's prefix of each length that routes have is joined with the routes by equality.  While the routes are small, Spark broadcasts them once
    for all these joins, so requests are not shuffled; how many routes there are changes the joins' kind, not their number.  Routes of more than
    PROBES lengths are joined once with the exploded prefixes instead, with the same rows.
    """
    known = last_route_wins(routes)
    lengths = sorted((r["n"] for r in known.select(F.length("path_prefix").alias("n")).distinct().limit(PROBES + 1).collect()), reverse=True)
    named = F.struct("path_prefix", "target_url")
    if len(lengths) <= PROBES:
        rows = requests
        for n in lengths:
            # a shorter path has a shorter prefix, which may be a route of its own: the lengths tell
            one = known.select(F.col("path_prefix").alias("__p"), named.alias(f"__r{n}"))
            rows = rows.join(one, F.substring(F.col(path), 1, n) == F.col("__p"), "left").drop("__p")
        rows = rows.withColumn("__r", F.coalesce(*[F.col(f"__r{n}") for n in lengths], F.lit(None).cast("struct<path_prefix:string,target_url:string>")))
    else:
        longest = known.agg(F.max(F.length("path_prefix"))).first()[0]
        rows = requests.withColumn("__id", F.monotonically_increasing_id())
        prefixes = rows.select("__id", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length(path), F.lit(longest))), lambda n: F.substring(F.col(path), F.lit(1), n))).alias("p"))
        best = prefixes.where("p <> ''").join(known, F.col("p") == F.col("path_prefix")).groupBy("__id").agg(F.max_by(named, F.length("p")).alias("__r"))
        rows = rows.join(best, "__id", "left")
    return rows.select(*requests.columns, "__r.path_prefix", "__r.target_url")


def registered(requests: DataFrame, routes: DataFrame, how: str = "inner") -> DataFrame:
    """JON-06: requests whose method and whole path are registered (left_anti: that are not)."""
    known = routes.select(F.col("path_prefix").alias("__p")).distinct()
    return requests.join(known, (F.col("path") == F.col("__p")) & F.col("method").isin(*METHODS), how if how != "inner" else "left_semi")


# --- targets ------------------------------------------------------------------------------------------------------

def static_target(path: Column, query: Column, config: ProxyConfig, target: str | Column) -> Column:
    """URL-10: the whole target URL of a statically forwarded request."""
    base = F.lit(target) if isinstance(target, str) else target
    if config.mode == FULL_PATH:
        return P.append_query(P.full_path_url(base, path), query)
    own = P.strip_proxy_prefix(path)
    own = P.first_rule(own, config.rules) if config.rewrite_enabled else own
    return P.append_query(P.join_base(base, P.clean_url_path(own)), query)


def dynamic_target(forward_url: str, port: Column, path: Column, query: Column) -> Column:
    """URL-08, URL-09."""
    return P.append_query(F.concat(P.with_port(P.trim_one_slash(F.lit(forward_url)), port), path), query)


def port_lookup(requests: DataFrame, mapping: DataFrame) -> DataFrame:
    """SRC-05, JON-07: adds the port of (client_id, app_name), null where there is none; of several the latest fetched."""
    latest = mapping.groupBy("client_id", "app_name").agg(F.max_by("port", F.struct("fetched_at", "port")).alias("port"))
    return requests.join(latest, ["client_id", "app_name"], "left")


# --- errors -------------------------------------------------------------------------------------------------------

# Codes, statuses and messages.
STATUS = {"PROXY_TIMEOUT": 504, "PROXY_TARGET_UNREACHABLE": 503, "PROXY_BAD_REQUEST": 400}
MESSAGES = {"PROXY_TIMEOUT": "Request timeout", "PROXY_TARGET_UNREACHABLE": "Target service unreachable", "PROXY_INTERNAL_ERROR": "Internal server error"}
DYNAMIC_STATUS = {"body": 400, "port": 400, "size": 413, "build": 500, "send": 502}
HEADER_STATUS = {"body": 500, "build": 500, "send": 502}
NO_ROUTE, NOT_CONFIGURED, NO_HANDLER = 404, 501, 503
INVALID_PARAM, NOT_FOUND, MISSING_PARAM = "invalid request params: %s %s", "%s not found by %s", "missing required param: %s"
SENTINELS = {"FileNotFound": "file or directory not found", "ReadTimeout": "read timeout", "RunTimeout": "run timeout"}


def lookup(key: Column, table: dict, default) -> Column:
    """One flat chain, however long the table is."""
    chain = list(table.items())
    if not chain:
        return F.lit(default)
    out = F.when(key == chain[0][0], chain[0][1])
    for k, v in chain[1:]:
        out = out.when(key == k, v)
    return out.otherwise(default)


def error_status(code: Column) -> Column:
    """ERR-01: unknown and missing codes are 500."""
    return lookup(code, STATUS, 500)


def stage_status(strategy_: Column, stage: Column) -> Column:
    """ERR-01, ERR-04, ERR-05: by strategy and the stage that failed."""
    return F.when(strategy_ == "dynamic", lookup(stage, DYNAMIC_STATUS, 500)).when(strategy_ == "header", lookup(stage, HEADER_STATUS, 500)).otherwise(500)


def proxy_error(code: Column, details: Column, at: Column | None = None) -> Column:
    """ERR-02, ERR-03: the error struct; an unset time is null."""
    return F.struct(code.alias("code"), lookup(code, MESSAGES, "Bad request").alias("message"), details.alias("details"), (at if at is not None else F.lit(None).cast("timestamp")).alias("timestamp"))


def invalid_param(name: Column, value: Column) -> Column:
    """ERR-08."""
    return F.format_string(INVALID_PARAM, name, value)


def record_not_found(name: Column, value: Column) -> Column:
    """ERR-09."""
    return F.format_string(NOT_FOUND, name, value)


def missing_param(name: Column) -> Column:
    """ERR-10."""
    return F.format_string(MISSING_PARAM, name)


def sentinel(name: Column) -> Column:
    """ERR-06: the message of a named error, null for an unknown name."""
    return lookup(name, SENTINELS, None)


def handler_status(failure: Column) -> Column:
    """SNK-01, SNK-03: 404 without a route, 501 without a configured target, 503 without a handler, null without a failure."""
    return lookup(failure, {"no_route": NO_ROUTE, "not_configured": NOT_CONFIGURED, "no_handler": NO_HANDLER}, None)


def code_text(code: Column, message: Column) -> Column:
    """ERR-07: an error with a code of its own, as text."""
    return F.format_string("code: %d, message: %s", code, message)


def envelope(error: Column, data: Column, code: Column | None = None) -> Column:
    """ERR-07, SNK-08: JSON of the error's own code, else -1, and its text; or of code 0, "ok", success and the data, which is left out if null."""
    bad = F.to_json(F.struct((F.coalesce(code, F.lit(-1)) if code is not None else F.lit(-1)).alias("code"), error.alias("message"), F.lit(False).alias("success")))
    return F.when(error.isNotNull(), bad).otherwise(F.to_json(F.struct(F.lit(0).alias("code"), F.lit("ok").alias("message"), F.lit(True).alias("success"), data.alias("data"))))


def copied_response(status: Column, headers: Column, body: Column, own: Column | None = None) -> Column:
    """SNK-02: the response that goes to the client: status and body as they came, headers added to those that it has already."""
    return F.struct(status.alias("status"), (H.merged(own, headers) if own is not None else headers).alias("headers"), body.alias("body"))


# --- health -------------------------------------------------------------------------------------------------------

def probe_state(status: Column, error: Column) -> Column:
    """HLT-02, HLT-03: error, ok for 2xx, else unhealthy."""
    return F.when(error.isNotNull(), "error").when(status.between(200, 299), "ok").otherwise("unhealthy")


def route_health(routes: DataFrame, probes: DataFrame) -> DataFrame:
    """HLT-05, JON-08: a row for each route that was probed; a duration only without an error."""
    joined = routes.join(probes, "path_prefix")
    return joined.select("path_prefix", "target_url", (probe_state(F.col("status"), F.col("error")) == "ok").alias("healthy"), F.when(F.col("error").isNull(), F.col("duration_ms")).alias("duration_ms"), "error")


def health_summary(probes: DataFrame, by: str) -> DataFrame:
    """HLT-03, HLT-04, AGG-04 from probe rows: counts of each state, by a column."""
    state = probe_state(F.col("status"), F.col("error"))
    return probes.groupBy(by).agg(F.count("*").alias("n_probes"), *(F.count_if(state == s).alias(f"n_{s}") for s in ("ok", "unhealthy", "error")))


def health_errors(probes: DataFrame, by: str) -> DataFrame:
    """AGG-03: each distinct error with its number of probes, by a column; rows, so a group with very many errors stays bounded."""
    return probes.where("error IS NOT NULL").groupBy(by, "error").agg(F.count("*").alias("n_probes"))


def constant_health(config: ProxyConfig) -> Column:
    """HLT-01: the JSON of the always reachable first route, escaped properly."""
    target = config.routes[0].target_url if config.routes else ""
    return F.to_json(F.struct(F.lit("ok").alias("status"), F.lit(target).alias("target"), F.lit(True).alias("reachable"), F.lit(0).alias("response_time_ms")))


# --- the whole decision -------------------------------------------------------------------------------------------

def decide(requests: DataFrame, config: ProxyConfig, mapping: DataFrame | None = None, version_header: str = "X-Client-Version") -> DataFrame:
    """Each request's error, strategy and target URL in one plan: no shuffle but that of the port lookup, where that is not broadcast.

    requests: method, url, path, raw_query, headers and, with mapping, client_id and app_name.
    """
    path, query, headers = F.col("path"), F.col("raw_query"), F.col("headers")
    rows = port_lookup(requests, mapping) if mapping is not None else requests.withColumn("port", F.lit(None).cast("int"))
    rows = rows.withColumns({"error": request_error(F.col("url"), headers, F.col("method")), "strategy": strategy(path, headers, config, version_header)})
    by_header = P.append_query(header_forward_target(path, headers, config.header_forward), query)
    dynamic = dynamic_target(config.lookup.forward_url, F.col("port"), path, query)
    target = F.when(F.col("error").isNotNull(), None).when(F.col("strategy") == "header", by_header).when(F.col("strategy") == "dynamic", dynamic).otherwise(static_target(path, query, config, config.forward_url))
    status = F.when(F.col("error").isNotNull(), 400).when((F.col("strategy") == "dynamic") & F.col("port").isNull(), 400).otherwise(200)
    return rows.withColumns({"target": target, "status": status})
