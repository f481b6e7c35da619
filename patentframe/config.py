"""Settings: defaults, then JSON or YAML files in their order, then PATENTFRAME_ environment variables, then command-line overrides."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    input: str = ""
    output: str = "out"
    existing: str = ""
    reject_scope: str = "row"
    max_depth: int = 5
    chunk_size: int = 1000
    chunk_overlap: int = 200
    split_claims: bool = True
    strict_compat: bool = False
    base_url: str = ""
    products: str = ""
    parallel: int = 5
    retries: int = 3
    timeout: int = 30
    skip_exists: bool = True
    verify_sha1: bool = True
    file_url: str = ""
    file_name: str = ""
    splitter: str = "recursive"
    partition_by: str = ""
    log: str = ""

    def __post_init__(self):
        if self.reject_scope not in ("row", "file"):
            raise ValueError("reject_scope must be row or file")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be below chunk_size")
        if self.max_depth < 0:
            raise ValueError("max_depth must not be negative")
        if not 1 <= self.parallel <= 30:
            raise ValueError("parallel must be between 1 and 30")
        if self.retries < 0 or self.timeout < 1:
            raise ValueError("retries must not be negative, and timeout at least 1 second")
        if unknown := set(self.partitions()) - {"filing_year", "decision"}:
            raise ValueError(f"partition_by must name filing_year or decision, not {', '.join(sorted(unknown))}")
        if not all(x.strip().isdigit() for x in self.products.split(",") if x.strip()):
            raise ValueError("products must be numbers, separated by commas")

    def partitions(self) -> tuple[str, ...]:
        return tuple(x.strip() for x in self.partition_by.split(",") if x.strip())


def _typed(name: str, kind: str, value):
    if isinstance(value, str) and kind == "bool":
        if value.lower() not in ("true", "false", "1", "0"):
            raise ValueError(f"{name} must be true or false")
        return value.lower() in ("true", "1")
    return int(value) if kind == "int" else value


def load(paths: str | list[str] | None = None, overrides: dict | None = None, environ=os.environ) -> Config:
    """Later sources win; unknown names are errors."""
    kinds = {f.name: f.type for f in fields(Config)}
    given: dict = {}
    for path in [paths] if isinstance(paths, str) else paths or []:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yml", ".yaml")):
            import yaml

            given |= yaml.safe_load(text) or {}
        else:
            given |= json.loads(text)
    given |= {k.removeprefix("PATENTFRAME_").lower(): v for k, v in environ.items() if k.startswith("PATENTFRAME_")}
    given |= {k: v for k, v in (overrides or {}).items() if v is not None}
    if unknown := given.keys() - kinds.keys():
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Config(**{k: _typed(k, kinds[k], v) for k, v in given.items()})


def shown(config: Config) -> str:
    return json.dumps(asdict(config), indent=2)
