import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notegraph.errors import ManifestError, ParseError
from notegraph.functions import targets, yaml12
from notegraph.functions.canonical import canonical, digest, loose
from notegraph.functions.globs import path_matches, tail_regex
from notegraph.functions.stem import english, russian, stem
from notegraph.functions.targets import clean_target, relative_target
from notegraph.manifest import check_manifest, load_manifest
from notegraph.operators import mutate
from notegraph.operators.parse import parse_bytes, split_frontmatter
from tests.conftest import base_manifest


@pytest.mark.parametrize("text, value", [("yes", "yes"), ("012", 12), ("1:30", "1:30"), ("1e3", 1000.0), ("0o17", 15), ("0x1f", 31), ("true", True), ("~", None), ("", None), ("2024-01-02", "2024-01-02"), (".inf", float("inf")), ("-3", -3), ("null", None), ("'1'", "1")])
def test_yaml_scalars(text, value):
    assert yaml12.load_mapping(f"a: {text}\n") == {"a": value}


def test_yaml_shapes():
    assert yaml12.load_mapping("") == {} and yaml12.load_mapping("[]") == {} and yaml12.load_mapping("0") == {}
    assert yaml12.load_mapping("1: [a, {b: 2024-01-02}]") == {"1": ["a", {"b": "2024-01-02"}]}
    for bad in ("a: 1\na: 2", "- a", "a: [", "x"):
        with pytest.raises(ParseError):
            yaml12.load_mapping(bad)


def test_legacy_colons():
    text = b"---\ntitle: a: b\nlist: [1]\n---\nbody"
    with pytest.raises(ParseError):
        parse_bytes(text)
    assert parse_bytes(text, legacy_colons=True) == ({"title": "a: b", "list": [1]}, "body")


def test_frontmatter_split():
    assert split_frontmatter("no head") == (None, "no head")
    assert split_frontmatter("---\na: 1\n...\nbody\n") == ("a: 1\n", "body\n")
    assert split_frontmatter(" --- \r\na: 1\r\n---\r\nx") == ("a: 1\r\n", "x")
    with pytest.raises(ParseError):
        split_frontmatter("---\na: 1\n")
    with pytest.raises(ParseError):
        parse_bytes(b"\xff\xfe")


def test_equalities():
    assert loose(True) == loose(1) == loose(1.0) and canonical(True) != canonical(1) != canonical(1.0)
    assert loose([True, {"a": 2.0}]) == loose([1, {"a": 2}]) and loose([1, 2]) != loose([2, 1])
    assert digest({"a": 1, "b": "é"}) == digest({"b": "é", "a": 1})


@pytest.mark.parametrize("path, glob, hit", [("notes/a/b.md", "notes/**", True), ("b.md", "**/b.md", True), ("a/b.md", "*.md", False), ("a/b.md", "a/?.md", True), ("a+b.md", "a+b.md", True), ("x/notes/b.md", "notes/**", False)])
def test_path_globs(path, glob, hit):
    assert path_matches(path, glob) is hit


@pytest.mark.parametrize("path, hit", [("x/notes/a/README.md", True), ("notes/a/README.md", True), ("notes/README.md", False), ("notes/a/b/README.md", False)])
def test_tail_globs(path, hit):
    assert bool(re.fullmatch(tail_regex("notes/**/README.md"), path)) is hit


@pytest.mark.parametrize("raw, syntax, target", [("a|alias", "wikilink", "a"), (r"a\|alias", "wikilink", "a"), ("a.md#part", "wikilink", "a"), ("../x.md", "markdown", "../x"), ("<a b.md>", "markdown", "a b"), ('a.md "title"', "markdown", "a"), ("a%20b.md", "markdown", "a b"), ("./a//b.md?x=1", "markdown", "a/b"), ("[[a|b]]", "frontmatter", "a"), ("[t](a.md)", "frontmatter", "a")])
def test_targets(raw, syntax, target):
    assert clean_target(raw, syntax)[0] == target


@pytest.mark.parametrize("raw, syntax", [("https://x.invalid/a.md", "markdown"), ("/a.md", "markdown"), ("Note: x", "wikilink"), ("a.png", "markdown"), ("//[b", "wikilink"), ("#part", "markdown"), ("mailto:a@b", "markdown")])
def test_dropped_targets(raw, syntax):
    assert clean_target(raw, syntax) is None


def test_relative_targets():
    assert relative_target("notes/a/b", "../c") == "notes/c" and relative_target("a", "b") == "b"
    assert relative_target("a", "../b") is None


def test_stems():
    assert [english(w) for w in ("plans", "planning", "planned", "hopping", "hoping", "flies", "relational", "happy", "news")] == ["plan", "plan", "plan", "hop", "hope", "fli", "relat", "happi", "news"]
    assert russian("созвоны") == russian("созвон") == "созвон" and russian("заметки") == russian("заметка")
    assert stem("123") == "123" and stem("größe") == english("größe")


@given(st.text(max_size=12))
@settings(max_examples=300, deadline=None)
def test_stems_never_fail(word):
    assert isinstance(stem(word.lower()), str)


def test_manifest_problems(make_vault):
    assert check_manifest(base_manifest()) == []
    assert check_manifest(base_manifest(search={"zones": [{"source": "property", "weight": 1}]}))
    assert check_manifest(base_manifest(search={"zones": [{"source": "body", "weight": 1, "field": "x"}]}))
    assert check_manifest(base_manifest(defaultKind="other")) and check_manifest(base_manifest(extra=1)) and check_manifest(base_manifest(vaultId="A"))
    assert check_manifest(base_manifest(search={"defaultLimit": 50, "maxLimit": 10})) and check_manifest(base_manifest(context={"defaultLimit": 21}))
    assert check_manifest(base_manifest(search={"boosts": [{"weight": 1}]})) and check_manifest(base_manifest(search={"boosts": [{"kind": "none", "weight": 1}]}))
    assert check_manifest(base_manifest(relations={"r": {"field": "f", "cardinality": "1", "targetKinds": ["document"]}}))
    root = make_vault({})
    assert load_manifest(root).vault_id == "test-vault"
    with pytest.raises(ManifestError):
        load_manifest(root / "notes")


def test_common_forms_need_no_parser(monkeypatch):
    """Frontmatter, properties and targets of the commonest forms come out as from the whole parser, without it."""
    import yaml

    values = ["open", "a b", "x/y-1.z", "2024-01-02", "[[x/y|seen from here]]", "[a note](b.md#top)", 7, -3, ["a", "[[b]]", 5], []]
    odd = ["yes", "No", "y", "null", "True", "a: b", "a #b", " a", "a ", "1_000", "12:30", "'", "é", "", True, None, 2.5, [None, "a,b"], {"k": 1}, "x" * 2000]
    slow = lambda v: yaml.safe_dump({"k": v}, allow_unicode=True, sort_keys=False, default_flow_style=None if isinstance(v, (list, dict)) else False, width=1_000_000)
    dumped = {repr(v): slow(v) for v in values + odd}
    assert all(mutate._dump("k", v) == dumped[repr(v)] for v in values + odd)
    assert mutate._dump("yes", "a") == "'yes': a\n"
    heads = [*dumped.values(), "k: it''s\n", "k: 'it''s'\n", "k: TRUE\nm: ~\n", "k: 1\nk: 2\n", "true: 1\n", "k: 007\n", "k: 1.50\n", "k: a  b\n", "k: a\n b\n", "k: a\r\n", "k: [a, null]\n", "k: a", "k: 0x1\n", "k: 2024-01-02\n"]
    for head in heads:
        try:
            want = repr(yaml12.plain(yaml12.load(head)))
        except ParseError:
            want = None
        got = yaml12._simple_mapping(head)
        assert got is None or repr(got) == want
    monkeypatch.setattr(yaml, "load", None)
    monkeypatch.setattr(yaml, "safe_dump", None)
    for v in values:
        assert mutate._dump("k", v) == dumped[repr(v)] and yaml12.load_mapping(dumped[repr(v)]) == {"k": v}
    monkeypatch.setattr(targets, "urlsplit", None)
    assert targets.clean_target("a/b-1.md", "markdown") == ("a/b-1", "markdown", False) and targets.clean_target("[[b|x]]", "frontmatter") == ("b", "wikilink", False)
    assert targets.relative_target("x/y/z", "a/b") == "x/y/a/b" and targets.relative_target("z", "b") == "b"
