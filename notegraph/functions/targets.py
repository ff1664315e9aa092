"""From the raw text of a link to the ids it may mean."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import unquote, urlsplit


# Paths that need no cleaning: names of letters, digits and hyphens, and perhaps the suffix of a note.
_SIMPLE_PATHS = re.compile(r"[A-Za-z0-9_-]+(?:/[A-Za-z0-9_-]+)*")
_SIMPLE = re.compile(rf"({_SIMPLE_PATHS.pattern})(?:\.md)?")


def _norm(path: str) -> str:
    path = posixpath.normpath(path.lstrip("/")) if path.strip("/") else ""
    return "" if path == "." else path


def clean_target(raw: str, syntax: str) -> tuple[str, str, bool] | None:
    """(target, syntax, foreign) or null for links that lead out of the collection.

    ``syntax`` is wikilink, markdown or frontmatter; a frontmatter value written as a link takes that syntax.
    ``foreign`` tells that the target has a suffix that isn't Markdown.
    """
    text = raw.strip()
    if syntax == "frontmatter":
        inner = re.fullmatch(r"!?\[\[(.+)\]\]", text, re.S)
        link = re.fullmatch(r"\[[^\]]*\]\((.+)\)", text, re.S)
        text, syntax = (inner[1], "wikilink") if inner else (link[1], "markdown") if link else (text, syntax)
    if syntax == "wikilink":
        text = re.split(r"\\?\|", text, maxsplit=1)[0].strip()
    elif syntax == "markdown":
        text = text.strip()
        if text.startswith("<") and ">" in text:
            text = text[1 : text.index(">")]
        else:
            text = re.split(r"[ \t]+[\"'(]", text, maxsplit=1)[0].strip()
    if simple := _SIMPLE.fullmatch(text):
        return simple[1], syntax, False
    try:
        parts = urlsplit(text)
    except ValueError:
        return None
    if parts.scheme or parts.netloc or (syntax == "markdown" and parts.path.startswith("/")):
        return None
    path = unquote(parts.path)
    suffix = posixpath.splitext(path)[1].lower()
    foreign = bool(suffix) and suffix != ".md"
    if foreign and syntax == "markdown":
        return None
    if suffix == ".md":
        path = path[:-3]
    target = _norm(path) if not path.startswith("../") and "/../" not in path and path != ".." else posixpath.normpath(path)
    return (target, syntax, foreign) if target else None


def relative_target(source_id: str, target: str) -> str | None:
    """The target as seen from the folder of ``source_id``; null if that leads out of the collection."""
    if _SIMPLE_PATHS.fullmatch(source_id) and _SIMPLE_PATHS.fullmatch(target):
        return source_id[: source_id.rfind("/") + 1] + target
    joined = posixpath.normpath(posixpath.join(posixpath.dirname(source_id), target))
    return None if joined == ".." or joined.startswith("../") else joined
