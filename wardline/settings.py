"""Settings: defaults, then a YAML or JSON file, then environment variables."""

from __future__ import annotations

import dataclasses
import json
import os
import typing
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

PREFIX = "WARDLINE_"

NORMALIZATION_MODES = ("rewrite", "block", "log")
LEAK_ACTIONS = ("redact", "block")


def _thresholds(block: float, warn: float) -> None:
    for name, value in (("block_threshold", block), ("warn_threshold", warn)):
        if not 0.0 <= value <= 1.0:  # also false for NaN
            raise ValueError(f"{name} must be within [0, 1], got {value!r}")
    if warn > block:
        raise ValueError(f"warn_threshold ({warn}) must not exceed block_threshold ({block})")


@dataclass(frozen=True)
class Normalization:
    mode: str = "rewrite"
    unicode: bool = True
    base64: bool = True
    hex: bool = True
    rot13: bool = True
    delimiters: bool = True

    def __post_init__(self):
        if self.mode not in NORMALIZATION_MODES:
            raise ValueError(f"normalization mode must be one of {NORMALIZATION_MODES}, got {self.mode!r}")


@dataclass(frozen=True)
class FastPath:
    enabled: bool = True
    block_threshold: float = 0.75
    warn_threshold: float = 0.4

    def __post_init__(self):
        _thresholds(self.block_threshold, self.warn_threshold)


@dataclass(frozen=True)
class DeepPath:
    enabled: bool = False
    model_path: str = "models/classifier"
    block_threshold: float = 0.65
    warn_threshold: float = 0.5
    max_chars: int = 6000

    def __post_init__(self):
        _thresholds(self.block_threshold, self.warn_threshold)
        if self.max_chars <= 0:
            raise ValueError(f"max_chars must be positive, got {self.max_chars!r}")


@dataclass(frozen=True)
class Canary:
    enabled: bool = True
    secret: str | None = None
    action: str = "redact"
    add_missing_system: bool = False

    def __post_init__(self):
        if self.action not in LEAK_ACTIONS:
            raise ValueError(f"canary action must be one of {LEAK_ACTIONS}, got {self.action!r}")


@dataclass(frozen=True)
class RateLimit:
    enabled: bool = True
    requests_per_minute: int = 60
    burst: int = 20

    def __post_init__(self):
        if self.burst < 1 or self.requests_per_minute <= 0:
            raise ValueError("burst must be at least 1 and requests_per_minute positive")


@dataclass(frozen=True)
class Audit:
    enabled: bool = False
    path: str = "stdout"
    include_text: bool = False
    access_log: bool = False


@dataclass(frozen=True)
class Settings:
    max_body_bytes: int = 1_048_576
    normalization: Normalization = field(default_factory=Normalization)
    fast_path: FastPath = field(default_factory=FastPath)
    deep_path: DeepPath = field(default_factory=DeepPath)
    canary: Canary = field(default_factory=Canary)
    rate_limit: RateLimit = field(default_factory=RateLimit)
    audit: Audit = field(default_factory=Audit)

    def __post_init__(self):
        if self.max_body_bytes <= 0:
            raise ValueError("max_body_bytes must be positive")


#: Environment names that are shorter than section and key.
SHORT = {("rate_limit", "requests_per_minute"): "RATE_LIMIT_RPM"}


def _coerced(value, kind, name: str):
    if kind is bool:
        word = str(value).strip().lower()
        if word in ("1", "true", "yes", "on"):
            return True
        if word in ("0", "false", "no", "off"):
            return False
        raise ValueError(f"invalid boolean for {name}: {value!r}")
    if kind in (int, float):
        try:
            return kind(value)
        except (TypeError, ValueError) as e:
            raise ValueError(f"invalid number for {name}: {value!r}") from e
    text = str(value).strip()
    if name.endswith(("_MODE", "_ACTION")):
        text = text.lower()
    return text or None


def _read(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML settings need the yaml package; JSON works without it") from e
    return yaml.safe_load(text) or {}


def load(path: str | None = None, environ: Mapping[str, str] | None = None) -> Settings:
    env = os.environ if environ is None else environ
    path = path or env.get(PREFIX + "CONFIG_PATH")
    given = _read(path) if path else {}
    if not isinstance(given, dict):
        raise ValueError("settings must be a mapping")

    def fill(cls, values, section: str):
        if not isinstance(values, dict):
            raise ValueError(f"{section} must be a mapping")
        hints = typing.get_type_hints(cls)
        out = {}
        for f in dataclasses.fields(cls):
            kind = hints[f.name]
            if dataclasses.is_dataclass(kind):
                out[f.name] = fill(kind, values.get(f.name) or {}, f.name)
                continue
            name = SHORT.get((section, f.name)) or "_".join(x for x in (section, f.name) if x).upper()
            value = env.get(PREFIX + name) or values.get(f.name)
            if value is not None:
                plain = next(t for t in (bool, int, float, str) if t is kind or t in typing.get_args(kind))
                out[f.name] = _coerced(value, plain, name)
        return cls(**out)

    return fill(Settings, given, "")
