"""Client and user identity from JSON bodies, queries, headers and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.headers import header
from siltstone.functions.text import _BASE64

EXTENSION = "email"


def json_string(doc: Column, key: str) -> Column:
    """JSN-01: the member if it is a JSON string, else null; numbers and the like do not count as strings."""
    member = F.try_variant_get(F.try_parse_json(doc), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(member) == "STRING", F.try_variant_get(F.try_parse_json(doc), f"$.{key}", "string"))


def query_value(query: Column, key: str) -> Column:
    """The first value of a decoded key in a raw query, null without one.  Pairs with a semicolon or a broken escape are skipped."""

    def pair(part: Column) -> Column:
        cut = F.instr(part, "=")
        name = F.when(cut > 0, F.substring(part, F.lit(1), cut - 1)).otherwise(part)
        value = F.when(cut > 0, F.substring(part, cut + 1, F.length(part))).otherwise(F.lit(""))
        return F.struct(F.try_url_decode(name).alias("name"), F.try_url_decode(value).alias("value"))

    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: ~F.contains(p, F.lit(";"))), pair)
    return F.get(F.filter(pairs, lambda p: (p["name"] == key) & p["value"].isNotNull()), F.lit(0))["value"]


def client_id(method: Column, query: Column, body: Column, headers: Column, key: str = "clientId", header_name: str = "Clientid") -> Column:
    """DSP-03: GET reads the query, other methods the JSON body; an empty answer falls back to the header."""
    given = F.when(method == "GET", query_value(query, key)).otherwise(json_string(body, key))
    return F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(header(headers, header_name))


def token_payload(token: Column) -> Column:
    """JSN-02: the whole value is base64 of JSON; null where it is not.  No signature is checked."""
    return F.when(token.rlike(_BASE64), F.try_to_binary(token, F.lit("base64")).cast("string"))


def user_of_token(token: Column) -> Column:
    """JSN-03: name and the part of email before a later "@"; if neither is a string, the same inside the member "email"."""
    doc = token_payload(token)

    def named(prefix: str) -> tuple[Column, Column]:
        name, mail = json_string(doc, f"{prefix}name"), json_string(doc, f"{prefix}email")
        local = F.when(F.instr(mail, "@") > 1, F.substring_index(mail, "@", 1)).otherwise(F.lit(""))
        return F.concat(F.coalesce(name, F.lit("")), F.coalesce(local, F.lit(""))), name.isNotNull() | mail.isNotNull()

    outer, found = named("")
    inner, _ = named(f"{EXTENSION}.")
    return F.coalesce(F.when(found, outer).otherwise(inner), F.lit(""))


def mapped_port(body: Column) -> Column:
    """JSN-04: 0 where the answer has no port."""
    return F.coalesce(F.from_json(body, "mappingPort INT")["mappingPort"], F.lit(0))
