"""Durations in the text form 1h2m3.5s."""

from __future__ import annotations

import re
from datetime import timedelta

DEFAULT = timedelta(seconds=30)
# Units in seconds.
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)")


def parse_duration(text: str) -> timedelta:
    """DAT-01: empty is 30 seconds, "0" is none, anything malformed raises ValueError."""
    if text == "":
        return DEFAULT
    sign, body = (-1, text[1:]) if text[0] == "-" else (1, text[1:] if text[0] == "+" else text)
    if body == "0":
        return timedelta(0)
    if not body or "".join(m[0] for m in _PART.finditer(body)) != body:
        raise ValueError(f"bad duration {text!r}")
    return sign * timedelta(seconds=sum(float(m[1]) * UNITS[m[2]] for m in _PART.finditer(body)))
