"""Driver-side configuration: validated and defaulted once, then compiled into plans or small dimension tables."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from siltstone import schemas
from siltstone.functions.durations import parse_duration

REWRITE, FULL_PATH = "rewrite", "full_path"


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass
class Route:
    path_prefix: str = ""
    target_url: str = ""
    timeout: timedelta = timedelta(0)


@dataclass
class HeaderForwardPath:
    path: str = ""
    with_url: str = ""
    without_url: str = ""


@dataclass
class HeaderForward:
    enabled: bool = False
    header_name: str = "X-Client-Version"
    paths: list[HeaderForwardPath] = field(default_factory=list)


@dataclass
class PortLookup:
    url: str = ""
    forward_url: str = ""
    timeout: timedelta = timedelta(0)
    cache_exp: timedelta = timedelta(0)
    max_idle: int = 0
    max_idle_per_host: int = 0
    idle_timeout: timedelta = timedelta(0)

    def defaulted(self) -> None:
        """FLT-16, ST-06: what is not positive gets its default."""
        none = timedelta(0)
        self.timeout = self.timeout if self.timeout > none else timedelta(seconds=10)
        self.cache_exp = self.cache_exp if self.cache_exp > none else timedelta(minutes=5)
        self.idle_timeout = self.idle_timeout if self.idle_timeout > none else timedelta(seconds=30)
        self.max_idle = self.max_idle if self.max_idle > 0 else 10
        self.max_idle_per_host = self.max_idle_per_host if self.max_idle_per_host > 0 else 5


@dataclass
class ProxyConfig:
    mode: str = ""
    dynamic_port: bool = False
    routes: list[Route] = field(default_factory=list)
    rewrite_enabled: bool = False
    rules: list[tuple[str, str]] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    override: dict[str, str] = field(default_factory=dict)
    forward_url: str = ""
    legacy_lookup_url: str = ""
    lookup: PortLookup = field(default_factory=PortLookup)
    header_forward: HeaderForward = field(default_factory=HeaderForward)

    def validated(self) -> ProxyConfig:
        """FLT-16: the checks in their order; the first that fails raises.  Missing values get their defaults."""
        self.mode = self.mode or REWRITE
        if self.mode not in (REWRITE, FULL_PATH):
            raise ConfigError(f"mode {self.mode!r} is neither {REWRITE} nor {FULL_PATH}")
        if self.dynamic_port:
            self.lookup.url = self.lookup.url or self.legacy_lookup_url
            if not self.lookup.url:
                raise ConfigError("dynamic ports need the lookup's url")
            if not self.lookup.forward_url:
                raise ConfigError("dynamic ports need the lookup's forward url")
            self.lookup.defaulted()
        if not self.routes and not self.dynamic_port:
            raise ConfigError("without dynamic ports at least one route is needed")
        for k, r in enumerate(self.routes):
            for name in ("path_prefix", "target_url"):
                if not getattr(r, name):
                    raise ConfigError(f"route {k} has no {name}")
            r.timeout = r.timeout if r.timeout > timedelta(0) else timedelta(seconds=30)
        if self.mode == FULL_PATH:
            self.rewrite_enabled = False
        if any(not a for a, _ in self.rules):
            raise ConfigError("a rewrite rule has no source")
        h = self.header_forward
        if h.enabled:
            if not h.header_name:
                raise ConfigError("forwarding by header needs a header name")
            if not h.paths:
                raise ConfigError("forwarding by header needs paths")
            for k, p in enumerate(h.paths):
                for name in ("path", "with_url", "without_url"):
                    if not getattr(p, name):
                        raise ConfigError(f"header path {k} has no {name}")
        return self

    # Dimension tables, each as long as its configuration list.
    def route_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, r.path_prefix, r.target_url, r.timeout) for k, r in enumerate(self.routes)], schemas.ROUTE)

    def rule_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(self.rules)], schemas.REWRITE_RULE)

    def header_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, p.path, p.with_url, p.without_url) for k, p in enumerate(self.header_forward.paths)], schemas.HEADER_FORWARD)


def default_config() -> ProxyConfig:
    """LIF-03: one route for everything, no target yet."""
    return ProxyConfig(mode=REWRITE, routes=[Route("/", "", timedelta(seconds=30))])


def validate_service(name: str, proxy: ProxyConfig) -> ProxyConfig:
    """FLT-15."""
    if not name:
        raise ConfigError("the service has no name")
    return proxy.validated()


def from_dict(raw: dict) -> ProxyConfig:
    """A parsed YAML mapping with snake_case keys as a ProxyConfig; not yet validated."""
    seconds = lambda d, k: parse_duration(str(d[k])) if d.get(k) else timedelta(0)
    pm, hf, hd, rw = (raw.get(k) or {} for k in ("port_manager", "header_based_forward", "headers", "rewrite"))
    return ProxyConfig(
        mode=raw.get("mode", ""),
        dynamic_port=bool(raw.get("dynamic_port")),
        routes=[Route(r.get("path_prefix", ""), (t := r.get("target") or {}).get("url", ""), seconds(t, "timeout")) for r in raw.get("routes") or []],
        rewrite_enabled=bool(rw.get("enabled")),
        rules=[(r.get("from", ""), r.get("to", "")) for r in rw.get("rules") or []],
        exclude=list(hd.get("exclude") or []),
        override=dict(hd.get("override") or {}),
        forward_url=raw.get("forward_url", ""),
        legacy_lookup_url=raw.get("port_manager_url", ""),
        lookup=PortLookup(pm.get("url", ""), pm.get("forward_url", ""), seconds(pm, "timeout"), seconds(pm, "cache_exp"), int(pm.get("max_idle_conns") or 0), int(pm.get("max_idle_conns_per_host") or 0), seconds(pm, "idle_conn_timeout")),
        header_forward=HeaderForward(bool(hf.get("enabled")), hf.get("header_name", ""), [HeaderForwardPath(p.get("path", ""), p.get("with_header_url", ""), p.get("without_header_url", "")) for p in hf.get("paths") or []]),
    )


def load_yaml(text: str, env: dict[str, str] | None = None) -> ProxyConfig:
    """SRC-02: YAML text with $NAME taken from the environment.  Needs a YAML parser on the driver."""
    import re

    try:
        import yaml
    except ImportError as e:
        raise ConfigError("no YAML parser is installed; use from_dict") from e
    known = os.environ if env is None else env
    text = re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: known.get(m[1] or m[2], ""), text)
    return from_dict((yaml.safe_load(text) or {}).get("proxy_config") or {})
