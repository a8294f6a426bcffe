"""Where a job's data lies: a JSON file found beside the caller or above it."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

#: The file's name, and how many folders above the start are tried.
NAME, ABOVE = "config.json", 3


@dataclass(frozen=True)
class JobPaths:
    """Addresses for spark.read and the sinks. Those in the file are taken from the
    file's folder unless they are absolute or name a store (as in "s3a://bucket/x")."""

    root: str
    dataset_root: str
    scaler_path: str
    runs_dir: str
    checkpoints_dir: str


def load_paths(start: str, name: str = NAME) -> JobPaths:
    """Reads the nearest file: in start (a folder, or a file's own), then above it.
    Raises FileNotFoundError if none is there, KeyError if it lacks an entry."""
    here = Path(start).resolve()
    folders = [here, *here.parents] if here.is_dir() else [*here.parents]
    root = next((x for x in folders[: ABOVE + 1] if (x / name).is_file()), None)
    if root is None:
        raise FileNotFoundError(f"no {name} in {folders[0]} or {ABOVE} folders above it")
    found = json.loads((root / name).read_text(encoding="utf-8"))
    full = lambda x: x if "://" in x else str(root / x)
    return JobPaths(str(root), *[full(found[f.name]) for f in fields(JobPaths)[1:]])
