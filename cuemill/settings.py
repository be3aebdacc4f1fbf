"""Settings that change what the operators compute; secrets and paths are never part of a rendered settings text."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass

#: Fixed value: what is never part of a rendered settings text: secrets, addresses and paths.
MASKED = ("key", "base_url", "input_file", "folders")


@dataclass
class ReEncode:
    enabled: bool = False
    fps: float = 1.0
    height: int = 360
    bitrate_kb: int = 35
    threshold_mb: int = 20
    duration_tolerance_ms: int = 100
    encoder: str | None = None


@dataclass
class Split:
    max_seconds: int = 300
    start_offset_min: float = 0.0
    re_encode: ReEncode = field(default_factory=ReEncode)


@dataclass
class Checks:
    validation_buffer_ms: int = 2000
    gap_seconds: int = 60
    gap_retries: int = 1
    ignore_start: bool = True
    ignore_end: bool = True


@dataclass
class Limits:
    requests_per_minute: int = 4
    tokens_per_minute: int = 250_000
    search_qps: float = 0.3
    search_max_length: int = 4096
    search_timeout: float = 60.0
    max_storage_gb: float = 18.0
    list_ttl: int = 10
    key: str | None = None
    base_url: str | None = None


@dataclass
class Retry:
    per_run: int = 5
    max_runs: int = 3
    multiplier: float = 2.0
    min_wait_seconds: float = 30.0
    max_wait_seconds: int = 300


@dataclass
class SearchRetry:
    retries: int = 3
    multiplier: float = 2.0
    min_wait_seconds: float = 1.0
    max_wait_seconds: float = 10.0


@dataclass
class Threads:
    uploads: int = 4
    re_encode: int = 2
    lyrics: int = 4
    subtitles: int = 4


@dataclass
class Folders:
    tmp: str | None = None
    out: str | None = None


@dataclass
class Settings:
    model_subtitles: str = "gemini-flash"
    model_lyrics: str = "gemini-flash-lite"
    input_file: str | None = None
    split: Split = field(default_factory=Split)
    checks: Checks = field(default_factory=Checks)
    limits: Limits = field(default_factory=Limits)
    retry: Retry = field(default_factory=Retry)
    search_retry: SearchRetry = field(default_factory=SearchRetry)
    threads: Threads = field(default_factory=Threads)
    folders: Folders = field(default_factory=Folders)


def _apply(target, values: Mapping[str, object]) -> None:
    known = {f.name: f for f in fields(target)}
    for k, v in values.items():
        k = k.lower()
        if k not in known or v is None:
            continue  # unknown keys are ignored
        now = getattr(target, k)
        if is_dataclass(now):
            _apply(now, v)
        elif isinstance(now, bool):
            setattr(target, k, v if isinstance(v, bool) else str(v).lower() in ("1", "true", "yes", "on"))
        elif isinstance(now, (int, float)):
            setattr(target, k, type(now)(v))
        else:
            setattr(target, k, str(v).strip().strip('"').strip("'") if k == "key" else str(v))


def read_env(path: str | os.PathLike) -> dict[str, str]:
    """``NAME=value`` lines of a file, without comments, ``export`` and quotes; empty if there is no such file."""
    try:
        lines = open(path, encoding="utf-8").read().splitlines()
    except FileNotFoundError:
        return {}
    out = {}
    for line in lines:
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and not name.startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def load(arguments: Mapping[str, object] | None = None, environment: Mapping[str, str] | None = None, prefix: str = "CUEMILL_", env_file: str | os.PathLike | None = ".env") -> Settings:
    """Arguments win over the environment (``PREFIX`` and names joined by ``__``), which wins over the file ``env_file`` of the same
    names, which wins over the defaults."""
    s = Settings()
    for source in (read_env(env_file) if env_file else {}, os.environ if environment is None else environment):
        nested: dict = {}
        for k, v in source.items():
            if k.startswith(prefix):
                at = nested
                *path, last = k[len(prefix) :].lower().split("__")
                for p in path:
                    at = at.setdefault(p, {})
                at[last] = v
        _apply(s, nested)
    _apply(s, arguments or {})
    positive = {"max_seconds": s.split.max_seconds, "search_qps": s.limits.search_qps, "requests_per_minute": s.limits.requests_per_minute, "tokens_per_minute": s.limits.tokens_per_minute, "gap_seconds": s.checks.gap_seconds, "fps": s.split.re_encode.fps}
    if bad := [k for k, v in positive.items() if v <= 0]:
        raise ValueError(f"must be positive: {', '.join(bad)}")
    return s


def masked_json(s: Settings) -> str:
    def drop(x):
        return {k: drop(v) for k, v in x.items() if k not in MASKED} if isinstance(x, dict) else x

    return json.dumps(drop(asdict(s)), ensure_ascii=False, indent=2)
