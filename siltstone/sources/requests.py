"""Sources and sinks of request rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions.headers import lookup_headers
from siltstone.functions.paths import url_parts

#: What the derived requests use, by page_id mod 8; the last is not allowed on purpose.
METHOD_CYCLE = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "TRACE")


def access_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """SRC-01: request rows from JSON lines, at once or as they arrive."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.REQUEST).json(path)


def derived_headers(key: Column) -> Column:
    """A header multimap from a number, with every kind of header that the operators treat differently."""
    one = lambda name, value: F.struct(F.lit(name).alias("k"), F.array(value).alias("v"))
    entries = F.array(
        one("Accept", F.lit("*/*")),
        F.when(key % 3 == 0, one("Authorization", F.concat(F.lit("Bearer "), key.cast("string")))),
        F.when(key % 2 == 0, one("X-Internal-Trace", key.cast("string"))),
        F.when(key % 5 < 2, one("X-Client-Version", F.when(key % 5 == 0, F.lit("1.2")).otherwise(F.lit("")))),
        F.when(key % 7 == 0, one("Connection", F.lit("keep-alive"))),
        one("Host", F.lit("edge.example.com")),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))


def requests_of_pages(pages: DataFrame) -> DataFrame:
    """Request rows derived from crawled pages: path and query of the URL, method and headers from page_id."""
    host, path, query = url_parts(F.col("url"))
    method = F.get(F.array(*map(F.lit, METHOD_CYCLE)), F.pmod(F.col("page_id"), F.lit(len(METHOD_CYCLE))))
    return pages.select(F.col("page_id").alias("request_id"), method.alias("method"), "url", host.alias("host"), path.alias("path"), query.alias("raw_query"), derived_headers(F.col("page_id")).alias("headers"))


def send_each(batch: DataFrame, send: Callable[[str, str], int]) -> DataFrame:
    """SNK-01, SNK-03, SNK-04: the egress of decided requests; returns request_id and status.

    send(method, target) is called on the executors.  Where it fails, a static target gives 504 for a time-out, 503 for an unreachable target and 500
    otherwise; the other strategies give 500 for a request that can't be built (ValueError) and 502 for one that can't be sent.  A request
    without a target keeps the status it has.
    """
    import pyarrow as pa

    def status(method, target, strategy, own):
        if target is None:
            return own
        try:
            return send(method, target)
        except TimeoutError:
            return 504 if strategy == "static" else 502
        except OSError:
            return 503 if strategy == "static" else 502
        except ValueError:
            return 500

    def run(batches):
        for b in batches:
            out = [status(*r) for r in zip(*(b.column(c).to_pylist() for c in ("method", "target", "strategy", "status")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("request_id"), pa.array(out, pa.int32())], ["request_id", "status"])

    return batch.select("request_id", "method", "target", "strategy", "status").mapInArrow(run, "request_id long, status int")


def lookup_url(base: Column, client: Column, app: Column) -> Column:
    """SRC-05: the port look-up's URL; its values are not escaped."""
    return F.concat(base, F.lit("/tunnel-manager/api/v1/ports?clientId="), client, F.lit("&appName="), app)


def fetch_ports(requests: DataFrame, base: str, fetch: Callable[[str, dict], tuple[int, str]]) -> DataFrame:
    """SRC-05 live: rows for operators.requests.port_lookup, (client_id, app_name, port, fetched_at, error), one fetch for each client and app.

    fetch(url, headers) is called on the executors and gives status and body.  The body is read before the status is looked at, so a
    broken one is the error that counts.  Headers are those of any one request of the client, without host and content-length.
    """
    import json

    import pyarrow as pa

    keys = requests.groupBy("client_id", "app_name").agg(F.to_json(F.any_value(lookup_headers(F.col("headers")))).alias("headers"))
    keys = keys.withColumn("url", lookup_url(F.lit(base), F.col("client_id"), F.col("app_name")))

    def one(url, headers):
        try:
            status, body = fetch(url, json.loads(headers or "{}"))
        except OSError as e:
            return None, f"failed to fetch port: {e}"
        try:
            port = int(json.loads(body).get("mappingPort") or 0)
        except (ValueError, AttributeError, TypeError) as e:
            return None, f"failed to decode response: {e}"
        return (port, None) if status == 200 else (None, f"unexpected status code: {status}")

    def run(batches):
        for b in batches:
            got = [one(*r) for r in zip(b.column("url").to_pylist(), b.column("headers").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("client_id"), b.column("app_name"), pa.array([p for p, _ in got], pa.int32()), pa.array([e for _, e in got], pa.string())], ["client_id", "app_name", "port", "error"])

    fetched = keys.mapInArrow(run, "client_id string, app_name string, port int, error string")
    return fetched.withColumn("fetched_at", F.current_timestamp())


def write_envelopes(df: DataFrame, path: str, mode: str = "append") -> None:
    """SNK-08, SNK-09, SNK-11: one JSON line for each row."""
    df.write.mode(mode).json(path)
