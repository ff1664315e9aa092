"""YAML with the 1.2 core schema and unique keys, on PyYAML's parser."""

from __future__ import annotations

import datetime
import re
from typing import Any

import yaml

from ..errors import ParseError


class _Loader(yaml.SafeLoader):
    pass


# The core schema's scalars; dates and times are kept as YAML 1.1 has them.
_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("null", r"~|null|Null|NULL|", ["~", "n", "N", ""]),
    ("bool", r"true|True|TRUE|false|False|FALSE", list("tTfF")),
    ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", list("-+0123456789")),
    ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", list("-+0123456789.")),
    ("timestamp", r"\d{4}-\d{2}-\d{2}|\d{4}-\d{1,2}-\d{1,2}(?:[Tt]|[ \t]+)\d{1,2}:\d{2}:\d{2}(?:\.\d*)?(?:[ \t]*(?:Z|[-+]\d{1,2}(?::?\d{2})?))?", list("0123456789")),
    ("merge", r"<<", ["<"]),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(rf"^(?:{_pattern})$"), _first)


def _integer(loader: _Loader, node: yaml.ScalarNode) -> int:
    text = node.value
    sign, digits = (-1 if text[0] == "-" else 1), text.lstrip("+-")
    base = {"0o": 8, "0x": 16}.get(digits[:2].lower(), 10)
    return sign * int(digits[2:] if base != 10 else digits, base)


def _number(loader: _Loader, node: yaml.ScalarNode) -> float:
    text = node.value.lower()
    return float(text.replace(".inf", "inf").replace(".nan", "nan")) if "inf" in text or "nan" in text else float(text)


def _mapping(loader: _Loader, node: yaml.MappingNode) -> dict:
    loader.flatten_mapping(node)
    out: dict = {}
    for key_node, value_node in node.value:
        key = loader.construct_object(key_node, deep=True)
        try:
            if key in out:
                raise ParseError(f"duplicate key {key!r}")
        except TypeError:
            raise ParseError(f"unusable key {key!r}") from None
        out[key] = loader.construct_object(value_node, deep=True)
    return out


_Loader.add_constructor("tag:yaml.org,2002:int", _integer)
_Loader.add_constructor("tag:yaml.org,2002:float", _number)
_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)


def plain(value: Any) -> Any:
    """Keys as strings, sequences as lists, dates in ISO form, anything else unknown as text."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if isinstance(value, (datetime.date, datetime.datetime, datetime.time)):
        return value.isoformat()
    return str(value)


def load(text: str) -> Any:
    try:
        return yaml.load(text, Loader=_Loader)
    except ParseError:
        raise
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        raise ParseError(f"invalid YAML frontmatter: {e}") from None


_CONSTANTS = {"null": None, "Null": None, "NULL": None} | {w: w[0] in "tT" for w in ("true", "True", "TRUE", "false", "False", "FALSE")}
_WORDS = r"[^\W\d][\w./-]*(?: [\w./-]+)*"
_QUOTED = r"'(?:[^'\x00-\x1f\x7f-\xa0\u2028\u2029\ud800-\udfff\ufeff-\uffff]|'')*'"
_NUMBER = r"-?[0-9]{1,18}(?:\.[0-9]{1,18})?"
_ONE = rf"(?:{_WORDS}|{_QUOTED}|{_NUMBER})"
_SIMPLE_LINE = re.compile(rf"([A-Za-z_][A-Za-z0-9_-]{{0,99}}): ({_ONE}|\[(?:{_ONE}(?:, {_ONE})*)?\])")
_ITEM = re.compile(_ONE)


def _one(text: str) -> Any:
    first = text[0]
    if first == "'":
        return text[1:-1].replace("''", "'")
    if first == "-" or "0" <= first <= "9":
        return float(text) if "." in text else int(text)
    return _CONSTANTS.get(text, text)


def _simple_mapping(text: str) -> dict | None:
    """What the parser makes of lines of the commonest forms, twenty times as fast; null if any other form is among them."""
    out: dict = {}
    lines = text.split("\n")
    if lines.pop():
        return None
    for line in lines:
        m = _SIMPLE_LINE.fullmatch(line)
        if m is None or m[1] in out or m[1] in _CONSTANTS:
            return None
        value = m[2]
        out[m[1]] = [_one(x) for x in _ITEM.findall(value[1:-1])] if value[0] == "[" else _one(value)
    return out


def load_mapping(text: str) -> dict:
    """The frontmatter's mapping; a document that is false in Python counts as empty."""
    simple = _simple_mapping(text)
    if simple is not None:
        return simple
    value = load(text) or {}
    if not isinstance(value, dict):
        raise ParseError("frontmatter must be a mapping")
    return plain(value)


_KEY_LINE = re.compile(r"([A-Za-z_][A-Za-z0-9_-]*):([ \t]*)(.*)\Z", re.S)


def quote_colons(text: str) -> str:
    """Top-level scalars with an unquoted ``: `` inside are put in quotes, structured values left alone."""
    out = []
    for line in text.split("\n"):
        m = _KEY_LINE.match(line)
        value = m[3].rstrip("\r") if m else ""
        if m and m[2] and value and ": " in value and value[0] not in "\"'[{>|!&*":
            line = f"{m[1]}:{m[2]}'" + value.replace("'", "''") + "'"
        out.append(line)
    return "\n".join(out)
