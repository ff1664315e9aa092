"""The manifest: kinds, fields, relations, search, context and merge policy of a collection, checked on load."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .errors import ManifestError
from .functions.canonical import digest

MANIFEST_NAME = "manifest.json"
#: Folders that never hold notes, besides the one the manifest lies in.
BUILTIN_IGNORES = (".git/**",)
ZONE_SOURCES = ("title", "firstHeading", "stem", "path", "tags", "property", "properties", "headings", "body")
FIELD_TYPES = ("string", "integer", "number", "boolean", "object", "list")
# Zones, limits and freshness used where a manifest says nothing.
DEFAULT_ZONES = (
    {"source": "stem", "weight": 12, "phraseWeight": 20, "countCap": 1},
    {"source": "title", "weight": 9, "phraseWeight": 25, "countCap": 1},
    {"source": "path", "weight": 8, "phraseWeight": 15, "countCap": 1},
    {"source": "tags", "weight": 7, "phraseWeight": 0, "countCap": 1},
    {"source": "properties", "weight": 4, "phraseWeight": 0, "countCap": 1},
    {"source": "headings", "weight": 4, "phraseWeight": 0, "countCap": 1},
    {"source": "body", "weight": 1, "phraseWeight": 8, "countCap": 6},
)
SEARCH_LIMITS, CONTEXT_LIMITS = (20, 100), (8, 20)


def find_root(explicit: str | Path | None = None, start: str | Path | None = None) -> Path:
    """The explicit root, or the nearest folder upwards that holds a manifest in one of its dot-folders."""
    if explicit is not None:
        root = Path(explicit).expanduser().resolve()
        if _manifest_file(root) is None:
            raise ManifestError(f"no manifest under {root}")
        return root
    here = Path(start or ".").resolve()
    for folder in (here, *here.parents):
        if _manifest_file(folder) is not None:
            return folder
    raise ManifestError(f"no manifest above {here}")


def _manifest_file(root: Path) -> Path | None:
    return min((p for p in root.glob(f".*/{MANIFEST_NAME}") if p.is_file()), default=None)


# -- a small schema language: each rule returns the problems it finds --------------------------------


def _text(pattern: str = ".+"):
    return lambda v, at: [] if isinstance(v, str) and re.search(f"^(?:{pattern})$", v, re.S) else [f"{at} must be a string like {pattern}"]


def _one_of(*values: Any):
    return lambda v, at: [] if any(type(v) is type(x) and v == x for x in values) else [f"{at} must be one of {', '.join(map(str, values))}"]


def _number(low: float, high: float, whole: bool = True, above: bool = False):
    def check(v: Any, at: str) -> list[str]:
        kind = isinstance(v, int) if whole else isinstance(v, (int, float))
        good = kind and not isinstance(v, bool) and (low < v if above else low <= v) and v <= high
        return [] if good else [f"{at} must be {'an integer' if whole else 'a number'} from {low} to {high}"]

    return check


def _flag(v: Any, at: str) -> list[str]:
    return [] if isinstance(v, bool) else [f"{at} must be true or false"]


def _list(item, least: int = 0, unique: bool = False):
    def check(v: Any, at: str) -> list[str]:
        if not isinstance(v, list):
            return [f"{at} must be a list"]
        out = [p for i, x in enumerate(v) for p in item(x, f"{at}[{i}]")]
        if len(v) < least:
            out.append(f"{at} needs at least {least} item")
        if unique and len({json.dumps(x, sort_keys=True) for x in v}) < len(v):
            out.append(f"{at} repeats an item")
        return out

    return check


def _record(fields: dict, required: tuple[str, ...] = (), least: int = 0, extra=None):
    def check(v: Any, at: str) -> list[str]:
        if not isinstance(v, dict):
            return [f"{at} must be an object"]
        out = [f"{at}.{k} is not allowed" for k in v if k not in fields]
        out += [f"{at}.{k} is required" for k in required if k not in v]
        out += [p for k, rule in fields.items() if k in v for p in rule(v[k], f"{at}.{k}")]
        if len(v) < least:
            out.append(f"{at} must not be empty")
        return out + (extra(v, at) if extra else [])

    return check


def _map(item, least: int = 0):
    def check(v: Any, at: str) -> list[str]:
        if not isinstance(v, dict):
            return [f"{at} must be an object"]
        return ([f"{at} must not be empty"] if len(v) < least else []) + [p for k, x in v.items() for p in item(x, f"{at}.{k}")]

    return check


_NAME = _text()
_ZONE = _record({"source": _one_of(*ZONE_SOURCES), "field": _NAME, "weight": _number(0, 1000), "phraseWeight": _number(0, 1000), "countCap": _number(1, 100)}, ("source", "weight"), extra=lambda v, at: [] if (v.get("source") == "property") == ("field" in v) else [f"{at}: property zones, and only they, have a field"])
_BOOST = _record({"kind": _NAME, "path": _NAME, "weight": _number(0, 1000)}, ("weight",), extra=lambda v, at: [] if ("kind" in v) != ("path" in v) else [f"{at} needs either kind or path"])
_GROUPING = _record({"fields": _list(_NAME, 1, True), "pathToken": _one_of("ticket"), "keyCase": _one_of("preserve", "upper", "lower"), "statusField": _NAME, "inactiveStatuses": _list(_NAME, 0, True), "freshnessFields": _list(_NAME, 1, True), "notesPerGroup": _number(1, 100)}, extra=lambda v, at: [] if "fields" in v or "pathToken" in v else [f"{at} needs fields or pathToken"])
_KIND = _record({"selectors": _list(_record({"path": _NAME, "type": _NAME, "tag": _NAME, "hasField": _NAME}, least=1), 1), "fields": _map(_record({"type": _one_of(*FIELD_TYPES), "required": _flag, "enum": _list(lambda v, at: [], 1, True)}, ("type",)))}, ("selectors",))
_RELATION = _record({"field": _NAME, "cardinality": _one_of("0..1", "0..*"), "targetKinds": _list(_NAME, 1, True), "acyclic": _flag}, ("field", "cardinality", "targetKinds"))
_SEARCH = _record({"zones": _list(_ZONE, 1), "boosts": _list(_BOOST), "stopWords": _list(_NAME, 0, True), "useDefaultStopWords": _flag, "defaultLimit": _number(1, 1000), "maxLimit": _number(1, 1000), "freshness": _record({"halfLifeDays": _number(0, float("inf"), False, True), "weight": _number(0, 10, False)}), "stemming": _record({"enabled": _flag})})
_CONTEXT = _record({"defaultLimit": _number(1, 1000), "maxLimit": _number(1, 1000), "maxCharacters": _number(256, 1_000_000), "snippetLines": _number(0, 20), "snippetCharacters": _number(32, 4000), "fallbackToTitle": _flag, "outputFields": _list(_NAME, 0, True), "grouping": _GROUPING})
_MERGE = _record({"defaultFieldStrategy": _one_of("manual", "scalar"), "fields": _map(_record({"strategy": _one_of("manual", "scalar", "set")}, ("strategy",))), "bodyStrategy": _one_of("manual")})
_MANIFEST = _record(
    {"$schema": _NAME, "apiVersion": _text("[a-z][a-z0-9-]*/v1"), "vaultId": _text("[a-z][a-z0-9-]{2,63}"), "defaultKind": _NAME, "ignore": _list(_NAME, 0, True), "capabilities": _list(_text("[a-z][a-z0-9-]*"), 0, True), "frontmatter": _record({"allowLegacyColonScalars": _flag}), "search": _SEARCH, "context": _CONTEXT, "merge": _MERGE, "nodeKinds": _map(_KIND, 1), "relations": _map(_RELATION)},
    ("$schema", "apiVersion", "vaultId", "nodeKinds"),
)


def check_manifest(raw: Any) -> list[str]:
    """All problems of a manifest; the rules that span sections only once each section is sound."""
    problems = _MANIFEST(raw, "manifest")
    if problems:
        return problems
    kinds = raw["nodeKinds"]
    if "defaultKind" in raw and raw["defaultKind"] not in kinds:
        problems.append("defaultKind isn't a declared kind")
    for name, relation in raw.get("relations", {}).items():
        problems += [f"relations.{name}: target kind {k} isn't declared" for k in relation["targetKinds"] if k not in kinds]
    problems += [f"search.boosts: kind {b['kind']} isn't declared" for b in raw.get("search", {}).get("boosts", []) if "kind" in b and b["kind"] not in kinds]
    for section, (default, most) in (("search", SEARCH_LIMITS), ("context", CONTEXT_LIMITS)):
        got = raw.get(section, {})
        if got.get("defaultLimit", default) > got.get("maxLimit", most):
            problems.append(f"{section}.defaultLimit is above maxLimit")
    return problems


@dataclass(frozen=True)
class Manifest:
    root: Path
    raw: dict[str, Any] = field(repr=False)
    folder: str = ".notegraph"

    @property
    def vault_id(self) -> str:
        return self.raw["vaultId"]

    @property
    def kinds(self) -> dict[str, dict]:
        return self.raw["nodeKinds"]

    @property
    def relations(self) -> dict[str, dict]:
        return self.raw.get("relations", {})

    @property
    def default_kind(self) -> str | None:
        return self.raw.get("defaultKind")

    @property
    def ignores(self) -> list[str]:
        return [*BUILTIN_IGNORES, f"{self.folder}/**", *self.raw.get("ignore", [])]

    @property
    def capabilities(self) -> list[str]:
        return self.raw.get("capabilities", [])

    @property
    def legacy_colons(self) -> bool:
        return self.raw.get("frontmatter", {}).get("allowLegacyColonScalars", False)

    @property
    def zones(self) -> list[dict]:
        return list(self.raw.get("search", {}).get("zones") or DEFAULT_ZONES)

    @property
    def search(self) -> dict:
        return self.raw.get("search", {})

    @property
    def context(self) -> dict:
        return self.raw.get("context", {})

    @property
    def digest(self) -> str:
        return digest(self.raw)

    def limit(self, section: str, asked: int | None) -> int:
        default, most = SEARCH_LIMITS if section == "search" else CONTEXT_LIMITS
        config = self.raw.get(section, {})
        value = config.get("defaultLimit", default) if asked is None else asked
        if value <= 0 or value > config.get("maxLimit", most):
            from .errors import QueryError

            raise QueryError(f"{section} limit must be from 1 to {config.get('maxLimit', most)}")
        return value


def load_manifest(root: str | Path) -> Manifest:
    root = Path(root).resolve()
    at = _manifest_file(root)
    if at is None:
        raise ManifestError(f"no manifest under {root}")
    try:
        raw = json.loads(at.read_text("utf-8"))
    except (OSError, ValueError) as e:
        raise ManifestError(f"can't read {at}: {e}") from None
    problems = check_manifest(raw)
    if problems:
        raise ManifestError("; ".join(problems))
    return Manifest(root, raw, at.parent.name)
