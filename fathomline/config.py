"""Settings: fixed values that decide results, overridable from the environment where a deployment would."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    embed_batch: int = 100
    embed_width: int = 2560
    top_k: int = 8
    agent_rounds: int = 3
    citation_chars: int = 400
    error_chars: int = 500
    max_upload_mb: int = 20
    upload_dir: str = "uploads"
    retries: int = 1
    retry_seconds: int = 10
    poll_seconds: int = 2

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "FATHOMLINE_") -> Settings:
        env = dict(os.environ) if env is None else env
        given = {f.name: env[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in env}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in given.items()})

    @property
    def max_upload_bytes(self) -> int:
        return self.max_upload_mb * 1024 * 1024


def origins(value: str) -> list[str]:
    """Allowed origins: split at commas, nothing trimmed."""
    return value.split(",")
