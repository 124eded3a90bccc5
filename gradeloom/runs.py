"""Paths and configs of runs. Plain Python: no data passes through here."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path


def run_folder(root: str, run_id: str, experiment: str | None = None) -> str:
    """Where a run writes: root/run_id, or root/experiment/runs/run_id."""
    if not run_id:
        raise ValueError("a run needs an id")
    return str(Path(root, experiment, "runs", run_id) if experiment else Path(root, run_id))


def retry_path(path: str) -> str:
    """The file beside ``path`` for the records that are tried again."""
    p = Path(path)
    return str(p.with_name(f"{p.stem}_retry{p.suffix}"))


def sibling(path: str, name: str) -> str:
    return str(Path(path).with_name(name))


def overridden(config: Mapping, given: Mapping) -> dict:
    """``config`` with values from the command line: dotted names, those of None left alone."""
    out = {k: dict(v) if isinstance(v, Mapping) else v for k, v in config.items()}
    for name, value in given.items():
        if value is None:
            continue
        *path, last = name.split(".")
        at = out
        for key in path:
            at[key] = dict(at.get(key) or {})
            at = at[key]
        at[last] = value
    return out


def capped(config: Mapping, tokens: int, name: str = "generation.max_tokens") -> dict:
    """``config`` with a forced limit of tokens."""
    return overridden(config, {name: tokens})
