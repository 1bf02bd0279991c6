"""Options, from defaults, a YAML file and the environment (the last wins)."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

PREFIX = "SYMBOLWEAVE_"


@dataclass(frozen=True)
class Options:
    data_dir: str = "~/.symbolweave"
    log_level: str = "INFO"
    languages: list[str] = field(default_factory=lambda: ["python", "typescript", "go"])
    use_scip: bool = False
    watch_debounce_ms: int = 500
    watch_extensions: list[str] = field(default_factory=list)
    max_context_nodes: int = 30
    buckets: int = 256

    @property
    def graph_dir(self) -> str:
        folder = os.path.expanduser(self.data_dir) if self.data_dir.startswith("~") else self.data_dir
        return f"{folder.rstrip('/')}/graph"


def _typed(value: str, default):
    if isinstance(default, bool):
        return value.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(default, int):
        return int(value)
    if isinstance(default, list):
        return [part.strip() for part in value.strip("[] ").replace('"', "").split(",") if part.strip()]
    return value


def load_options(path: str | None = None) -> Options:
    options = Options()
    known = {f.name for f in fields(Options)}
    if path and os.path.exists(path):
        import yaml

        with open(path) as handle:
            told = yaml.safe_load(handle) or {}
        options = replace(options, **{k: v for k, v in told.items() if k in known})
    for name in known:
        value = os.environ.get(PREFIX + name.upper())
        if value is not None:
            options = replace(options, **{name: _typed(value, getattr(Options(), name))})
    return options
