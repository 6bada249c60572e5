"""Job configuration: a TOML file over defaults, and identity files. Read on the driver; nothing of it is a column."""

from __future__ import annotations

import os
import secrets
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

from . import constants as C
from .functions.crypto import public_key


@dataclass(frozen=True)
class Config:
    data_dir: str = "~/.cairnspark"
    network_key: str = ""
    identity: str = ""
    memory_bytes: int = C.CACHE_BYTES
    disk_bytes: int = C.DISK_BYTES
    bucket_size: int = C.K
    parallelism: int = C.ALPHA
    record_ttl_ms: int = C.RECORD_TTL_MS
    stale_seconds: int = C.STALE_SECONDS
    maintenance_seconds: int = 60
    min_replicas: int = C.POLICIES["default"][0]
    lease_ttl_ms: int = C.LEASE_TTL_MS


def load(path: str | None = None) -> Config:
    """Defaults without a file; unknown names are an error, a leading ``~`` is expanded."""
    out = Config()
    if path and Path(path).expanduser().exists():
        found = tomllib.loads(Path(path).expanduser().read_text(encoding="utf-8"))
        if unknown := set(found) - {f.name for f in fields(Config)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        out = replace(out, **found)
    return replace(out, data_dir=os.path.expanduser(out.data_dir), identity=os.path.expanduser(out.identity))


def new_identity(path: str) -> bytes:
    """Writes a new signing key, readable by its owner only, and gives the public key."""
    seed = secrets.token_bytes(32)
    with open(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600), "w", encoding="utf-8") as f:
        f.write(f"private: {seed.hex()}\npublic: {public_key(seed).hex()}\n")
    return public_key(seed)


def read_identity(path: str) -> bytes:
    """The signing key of an identity file."""
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, _, value = line.partition(":")
        if name.strip() == "private":
            seed = bytes.fromhex(value.strip())
            if len(seed) == 32:
                return seed
    raise ValueError("no key of 32 bytes in the identity file")
