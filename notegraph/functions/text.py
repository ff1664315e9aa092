"""Text expressions that run in the JVM: whitespace, lines, headings, masking, links, tags, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters Python calls whitespace, as a Java character class.
WS = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Line ends as str.splitlines knows them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TOKEN = r"[\p{L}\p{N}]+"
# The built-in stop words.
STOP_WORDS = ("a", "an", "and", "for", "in", "of", "or", "the", "to", "в", "и", "на", "по", "для")


def lit_regex(pattern: str) -> Column:
    return F.lit(pattern)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?d)\\A{WS}+|{WS}+\\z", "")


def lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def headings(body: Column) -> Column:
    """All headings, code included, each stripped; a heading of blanks only is an empty string."""
    return F.transform(F.regexp_extract_all(body, lit_regex(f"(?md)^#{{1,6}}{WS}+(.+?){WS}*$"), F.lit(1)), strip)


def title(body: Column, stem: Column) -> Column:
    found = F.regexp_extract_all(body, lit_regex(f"(?md)^#{WS}+(.+?){WS}*$"), F.lit(1))
    return F.when(F.size(found) > 0, strip(F.get(found, F.lit(0)))).otherwise(stem)


def masked(body: Column) -> Column:
    """The body without fenced blocks, inline code and comments."""
    text = F.regexp_replace(body, r"(?msd)^ {0,3}(?:```|~~~).*?^ {0,3}(?:```|~~~)[ \t]*$", "")
    text = F.regexp_replace(text, r"`+[^`\n]*`+", "")
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def body_tags(mask: Column) -> Column:
    return F.regexp_extract_all(mask, lit_regex(r"(?<![\p{L}\p{N}_])#([A-Za-z0-9_/-]+)"), F.lit(1))


def wikilinks(mask: Column) -> Column:
    return F.regexp_extract_all(mask, lit_regex(r"!?\[\[([^\]]+)\]\]"), F.lit(1))


def markdown_links(mask: Column) -> Column:
    return F.regexp_extract_all(mask, lit_regex(r"(?<!!)\[[^\]]+\]\(([^)]+)\)"), F.lit(1))


def clean_tags(tags: Column) -> Column:
    """Stripped, without leading number signs, the first of equal ones kept."""
    tidy = F.transform(tags, lambda t: F.regexp_replace(strip(t), r"\A#+", ""))
    return F.array_distinct(F.filter(tidy, lambda t: t != ""))


def all_tags(frontmatter_tags: Column, mask: Column) -> Column:
    return clean_tags(F.concat(F.coalesce(frontmatter_tags, F.array().cast("array<string>")), body_tags(mask)))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters or digits, of two characters or more, with repeats."""
    return F.filter(F.regexp_extract_all(F.lower(text), lit_regex(TOKEN), F.lit(0)), lambda t: F.length(t) > 1)


def occurrences(text: Column, part: str) -> Column:
    """How often ``part`` stands in ``text``, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")


def humanised(stem: Column) -> Column:
    return F.translate(stem, "-_", "  ")
