"""Settings: defaults, a TOML file, then ``TIDEMARK__SECTION__KEY`` variables. Unknown keys are refused."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass


# fixed values: the defaults that users of such an engine expect
@dataclass
class Divergence:
    threshold: str = "0.03"
    freshness_s: int = 60
    debounce_s: int = 10
    widening: str = "0.01"


@dataclass
class Matcher:
    close_window_h: int = 48
    exact_guard_h: int = 72
    shortlist: float = 0.35
    review: float = 0.55
    missing_close_penalty: float = 0.85
    high: float = 0.9
    adjudicated_review: float = 0.6
    batch: int = 16


@dataclass
class Sink:
    flush_ms: int = 500
    batch_rows: int = 5000
    buffer_rows: int = 100_000


@dataclass
class Mirror:
    flush_ms: int = 250
    ttl_s: int = 3600


@dataclass
class Config:
    divergence: Divergence = field(default_factory=Divergence)
    matcher: Matcher = field(default_factory=Matcher)
    sink: Sink = field(default_factory=Sink)
    mirror: Mirror = field(default_factory=Mirror)


def _fill(target, values: dict, where: str) -> None:
    known = {f.name for f in fields(target)}
    for key, value in values.items():
        if key not in known:
            raise ValueError(f"unknown setting {where}{key}")
        now = getattr(target, key)
        if is_dataclass(now):
            _fill(now, value, f"{where}{key}.")
        else:
            setattr(target, key, type(now)(value))


def load(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    out = Config()
    if path:
        with open(path, "rb") as f:
            _fill(out, tomllib.load(f), "")
    for name, value in (os.environ if env is None else env).items():
        if name.startswith("TIDEMARK__"):
            section, _, key = name[len("TIDEMARK__") :].lower().partition("__")
            _fill(out, {section: {key: value}}, "")
    return out


def backoff(n: int, base_s: float = 0.5, cap_s: float = 30.0, jitter=None) -> float:
    """Delay before attempt ``n`` (from 0): doubles up to the cap; ``jitter`` maps it to the delay used."""
    delay = min(cap_s, base_s * 2**n)
    return jitter(delay) if jitter else delay
