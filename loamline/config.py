"""Settings from environment variables, checked.  Tables are folders below ``LAKE_DIR``."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field


def paths(text: str) -> list[str]:
    """Folders divided by ``;`` or ``,``."""
    return [p.strip() for p in text.replace(";", ",").split(",") if p.strip()]


@dataclass
class Settings:
    lake: str = "lake"
    log_dirs: list[str] = field(default_factory=list)
    trace_dirs: list[str] = field(default_factory=list)
    retention_days: int = 30
    read_only: bool = False
    deduplicate: bool = False
    max_workers: int = 4
    batch_flush_ms: int = 1000
    port: int = 8080
    cluster_map: str = "configs/cluster_map.yaml"
    trace_config_dir: str = "configs/techlog"
    retry_attempts: int = 3
    retry_first_ms: int = 100
    retry_most_ms: int = 5000
    retry_factor: float = 2.0
    log_level: str = "error"

    def checked(self) -> Settings:
        if not self.lake:
            raise ValueError("LAKE_DIR is required")
        if self.retention_days < 1:
            raise ValueError("LOG_RETENTION_DAYS must be at least 1")
        if not 0 < self.port < 1 << 16:
            raise ValueError("MCP_PORT must be between 1 and 65535")
        return self


#: Environment variable of each setting.
NAMES = {
    "lake": "LAKE_DIR", "log_dirs": "LOG_DIRS", "trace_dirs": "TECHLOG_DIRS", "retention_days": "LOG_RETENTION_DAYS", "read_only": "READ_ONLY", "deduplicate": "ENABLE_DEDUPLICATION",
    "max_workers": "MAX_WORKERS", "batch_flush_ms": "BATCH_FLUSH_TIMEOUT", "port": "MCP_PORT", "cluster_map": "CLUSTER_MAP_PATH", "trace_config_dir": "TECHLOG_CONFIG_DIR",
    "retry_attempts": "RETRY_MAX_ATTEMPTS", "retry_first_ms": "RETRY_INITIAL_DELAY", "retry_most_ms": "RETRY_MAX_DELAY", "retry_factor": "RETRY_MULTIPLIER", "log_level": "LOG_LEVEL",
}


def load(environment: Mapping[str, str] = os.environ) -> Settings:
    """Settings with what the environment holds; a number that is none leaves the default."""
    out = Settings()
    for name, variable in NAMES.items():
        if (text := environment.get(variable)) is None:
            continue
        default = getattr(out, name)
        if isinstance(default, list):
            value = paths(text)
        elif isinstance(default, bool):
            value = text.strip().lower() in ("1", "t", "true")
        elif isinstance(default, str):
            value = text
        else:
            try:
                value = type(default)(text)
            except ValueError:
                value = default
        setattr(out, name, value)
    return out.checked()
