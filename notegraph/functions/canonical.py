"""Canonical JSON, digests, and the loose form that filters compare."""

from __future__ import annotations

import hashlib
import json
from typing import Any


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: Any) -> str:
    return "sha256:" + hashlib.sha256(canonical(value).encode("utf-8", "surrogatepass")).hexdigest()


def text_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def loosened(value: Any) -> Any:
    """Booleans and integral floats become integers, so that true, 1 and 1.0 are equal; all the way down."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float) and value == value and abs(value) != float("inf") and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return [loosened(v) for v in value]
    if isinstance(value, dict):
        return {k: loosened(v) for k, v in value.items()}
    return value


def loose(value: Any) -> str:
    return canonical(loosened(value))


def json_type(value: Any) -> str:
    if value is None:
        return "null"
    for kind, name in ((bool, "boolean"), (int, "integer"), (float, "number"), (str, "string"), (list, "list"), (dict, "object")):
        if isinstance(value, kind):
            return name
    return "string"
