"""Run settings: defaults, reading, merging, validation and the hash of what was written."""

from __future__ import annotations

import hashlib
import json
import os

from tallyrail.functions.keys import canonical, merge

#: Settings that hold where a file says nothing.
DEFAULTS = {
    "metrics": ["recompilable", "behavioral_pass"],
    "postprocessors": ["markdown_fence"],
    "executor": {"type": "local", "require_linux": True, "memory_mb": 2048, "max_file_mb": 64},
    "preflight": {"mode": "strict"},
    "output": {"root": "experiments/results", "cache": "experiments/cache"},
}
#: What settings must be: a path (``[]`` is every row of a list), a rule, and what the rule asks for.
RULES = (
    ("datasets", "rows", None),
    ("decompilers", "rows", None),
    ("datasets[].id", "filled", None),
    ("datasets[].type", "filled", None),
    ("datasets[].path", "filled", None),
    ("datasets[].id", "unique", None),
    ("datasets[].evaluation_protocol", "kind", (str, dict)),
    ("datasets[].limit", "without", "selection_manifest"),
    ("decompilers[].id", "filled", None),
    ("decompilers[].type", "filled", None),
    ("decompilers[].id", "unique", None),
    ("metrics", "kind", (list,)),
    ("postprocessors", "kind", (list,)),
    ("executor", "kind", (dict,)),
    ("output", "kind", (dict,)),
    ("preflight.mode", "one of", ("strict", "warn", "off")),
)


def parse(text: str, name: str = "settings.json") -> dict:
    """Settings from JSON, or from YAML where its reader is installed."""
    if name.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as missing:
            raise ValueError("YAML settings need the yaml package; JSON needs nothing") from missing
        return yaml.safe_load(text) or {}
    return json.loads(text) if text.strip() else {}


def _places(settings: dict, path: str) -> list[tuple[str, dict, str]]:
    """(name, mapping, key) of every place that a path names; rows and parents that are no mappings have none."""
    head, _, key = path.rpartition(".")
    if head.endswith("[]"):
        rows = settings.get(head[:-2])
        return [(f"{head[:-2]}[{i}].{key}", row, key) for i, row in enumerate(rows if isinstance(rows, list) else []) if isinstance(row, dict)]
    parent = settings.get(head) if head else settings
    return [(path, parent, key)] if isinstance(parent, dict) else [(path, {}, key)]


def problems(settings: object) -> list[str]:
    """What is wrong with settings, rule by rule; empty if nothing is."""
    if not isinstance(settings, dict):
        return ["the settings are no mapping"]
    out = []
    for path, rule, wanted in RULES:
        seen = []
        for name, place, key in _places(settings, path):
            value = place.get(key)
            if rule == "rows":
                if not isinstance(value, list) or not value:
                    out.append(f"{name}: a list with at least one row is needed")
                out += [f"{name}[{i}]: no mapping" for i, row in enumerate(value if isinstance(value, list) else []) if not isinstance(row, dict)]
            elif rule == "filled" and not value:
                out.append(f"{name}: no value")
            elif rule == "unique" and value:
                if value in seen:
                    out.append(f"{name}: {value!r} is there twice")
                seen.append(value)
            elif rule == "kind" and value is not None and not isinstance(value, wanted):
                out.append(f"{name}: {type(value).__name__} instead of {' or '.join(k.__name__ for k in wanted)}")
            elif rule == "without" and value is not None and place.get(wanted):
                out.append(f"{name}: not together with {wanted}")
            elif rule == "one of" and value not in wanted:
                out.append(f"{name}: {value!r} is none of {', '.join(wanted)}")
    return out


def complete(raw: object) -> dict:
    """Settings with the defaults, checked, and with the hash of ``raw``."""
    settings = merge(DEFAULTS, raw) if isinstance(raw, dict) else raw
    if wrong := problems(settings):
        raise ValueError("settings that cannot be used:\n- " + "\n- ".join(wrong))
    return settings | {"_config_hash": hashlib.sha256(canonical(raw).encode()).hexdigest()}


def read(path: str) -> dict:
    """Settings of a file on the driver."""
    with open(path, encoding="utf-8") as f:
        return complete(parse(f.read(), path)) | {"_config_path": os.path.abspath(path)}


def resolve_path(path: str, base: str) -> str:
    """An absolute path, or one below ``base``."""
    return path if os.path.isabs(path) or "://" in path else os.path.join(base, path)
