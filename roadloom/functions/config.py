"""Parameters in layers, with templates and overrides; plain Python on the driver."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping, Sequence
from typing import Any


def merged(first: Mapping[str, Any], second: Mapping[str, Any]) -> dict[str, Any]:
    """Both, nested; where both have a value, the first one's."""
    out = dict(second)
    for k, v in first.items():
        out[k] = merged(v, out[k]) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def layered(layers: Sequence[Mapping[str, Any] | str]) -> dict[str, Any]:
    """Dicts and JSON files, earlier ones prevailing."""
    out: dict[str, Any] = {}
    for layer in layers:
        if isinstance(layer, str):
            with open(layer, encoding="utf-8") as f:
                layer = json.load(f)
        out = merged(out, layer)
    return out


def overridden(params: Mapping[str, Any], options: Sequence[str]) -> dict[str, Any]:
    """params with 'a:b=value' options put in; a value is JSON where it can be read so, else text."""
    out = merged({}, params)
    for option in options:
        path, _, text = option.partition("=")
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        nested: dict[str, Any] = {}
        at = nested
        *heads, last = path.split(":")
        for k in heads:
            at = at.setdefault(k, {})
        at[last] = value
        out = merged(nested, out)
    return out


def flat(params: Mapping[str, Any], head: str = "") -> dict[str, Any]:
    """One level, keys joined by dots."""
    out: dict[str, Any] = {}
    for k, v in params.items():
        out |= flat(v, f"{head}{k}.") if isinstance(v, Mapping) else {f"{head}{k}": v}
    return out


def resolved(params: Any, values: Mapping[str, Any] | None = None, rounds: int = 20) -> Any:
    """params with {name} in texts replaced by parameters of that (dotted) name, until nothing changes; names that
    aren't known stay."""
    known = {**flat(params), **(values or {})} if isinstance(params, Mapping) else dict(values or {})

    def text(t: str) -> str:
        for _ in range(rounds):
            new = re.sub(r"\{([\w.]+)\}", lambda m: str(known.get(m[1], m[0])), t)
            if new == t:
                break
            t = new
        return t

    if isinstance(params, Mapping):
        return {k: resolved(v, known, rounds) for k, v in params.items()}
    if isinstance(params, list):
        return [resolved(v, known, rounds) for v in params]
    return text(params) if isinstance(params, str) else params


def setting(name: str, default: Any, prefix: str = "ROADLOOM_") -> Any:
    """An environment variable in the default's type, else the default."""
    raw = os.environ.get(prefix + name)
    if raw is None:
        return default
    return raw.lower() in ("1", "true", "yes") if isinstance(default, bool) else type(default)(raw)
