"""Driver-side helpers: paths, durations, sizes, settings. Plain Python on single values."""

from __future__ import annotations

import hashlib
import os
import re

# Units of durations and sizes.
SECONDS = {"": 1, "s": 1, "sec": 1, "second": 1, "seconds": 1, "m": 60, "min": 60, "minute": 60, "minutes": 60, "h": 3600, "hr": 3600, "hour": 3600, "hours": 3600,
           "d": 86400, "day": 86400, "days": 86400, "w": 604800, "week": 604800, "weeks": 604800}
BYTES = {"": 1, "b": 1, "k": 1024, "kb": 1024, "m": 1024**2, "mb": 1024**2, "g": 1024**3, "gb": 1024**3}
# Largest chunk by service level and the share of the context it may fill, as a fraction.
LEVELS = {"free": (2048, 1, 8), "1": (4096, 1, 6), "2": (8192, 1, 4), "3": (16384, 4, 5)}
# How the service levels multiply the basic rate, and the safety margin.
RATES = {"free": 1, "1": 1, "2": 2, "3": 3}
MARGIN = 0.9


def canonical_path(path: str) -> str:
    """An absolute path without trailing slash; links are resolved as far as the path exists."""
    if not os.path.isabs(path):
        raise ValueError(f"not an absolute path: {path}")
    head, tail = path, []
    while not os.path.exists(head) and head != "/":
        head, part = os.path.split(head.rstrip("/"))
        tail.insert(0, part)
    out = os.path.join(os.path.realpath(head), *tail)
    return out.rstrip("/") or "/"


def parse_duration(text: str) -> int:
    """Seconds of "90", "5m", "1h 30m", "2 days"."""
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*([a-zA-Z]*)", text)
    if not parts or re.sub(r"(\d+(?:\.\d+)?)\s*([a-zA-Z]*)", "", text).strip(" ,"):
        raise ValueError(f"not a duration: {text!r}")
    try:
        return round(sum(float(n) * SECONDS[u.lower()] for n, u in parts))
    except KeyError as e:
        raise ValueError(f"unknown unit {e}") from None


def format_duration(seconds: int) -> str:
    out = []
    for unit, size in (("d", 86400), ("h", 3600), ("m", 60), ("s", 1)):
        n, seconds = divmod(seconds, size)
        if n:
            out.append(f"{n}{unit}")
    return " ".join(out) or "0s"


def parse_size(text: str) -> int:
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-zA-Z]*)\s*", text)
    if not m or m[2].lower() not in BYTES:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * BYTES[m[2].lower()])


def parse_range(text: str) -> tuple[int, int]:
    """Two whole numbers "min,max" in order."""
    lo, _, hi = text.partition(",")
    out = int(lo), int(hi)
    if out[0] > out[1]:
        raise ValueError(f"empty range: {text!r}")
    return out


def chunk_limit(level: str | None, context: int, own: int = 512) -> int:
    """Largest chunk in tokens for a service level and a model's context; a setting other than 512 caps it."""
    if level is None:
        return own
    most, a, b = LEVELS[level]
    size = min(most, context * a // b)
    return size if own == 512 else min(size, own)


def rate_limit(base: int, level: str) -> int:
    return int(base * RATES[level] * MARGIN)


def backoff_seconds(attempt: int) -> int:
    return min(2**attempt, 60)


def retryable(status: int | None) -> bool:
    """HTTP states worth another try; None stands for a connection that failed."""
    return status is None or status in (429, 500, 502, 503, 504)


def hash_vector(text: str, width: int = 64) -> list[float]:
    """A vector that follows from the text: bytes of its digest over 255 in the first 32 places, then zeros."""
    d = hashlib.sha256(text.encode()).digest()
    return [d[i] / 255.0 if i < len(d) else 0.0 for i in range(width)]
