"""Markup residue: HTML, MediaWiki and LaTeX out of Markdown texts, structure kept.

A text goes through three steps. Code (fenced, indented, inline) is set aside untouched. The
constructs of each foreign system are replaced by the Markdown that says the same (headings,
lists, tables, code) or dropped when they only carry layout; formulas stay as they are. What was stripped tells
which systems stand in the text. Then the line-block distribution decides which lines are kept: over windows
of lines the lengths of the stripped text, that of HTML's links left out, are summed; a region of text begins where the sum surges
and ends where it dives to nothing; and what lies outside of any region (menus, footers, leftovers of templates) goes.
Lines that no construct was stripped from are the collection's own text and always make a region.

Nulls give null text and no systems, empty texts an empty text. Texts of any length are processed
whole, in time linear in their length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, obsolete ones included.
HTML_ELEMENTS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script search section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
# Attributes of HTML that stand without a value.
BARE_ATTRIBUTES = "async|autofocus|autoplay|checked|compact|controls|defer|disabled|download|hidden|loop|multiple|muted|nohref|noshade|novalidate|nowrap|open|readonly|required|reversed|selected"
# Tags that MediaWiki adds.
WIKI_TAGS = "nowiki|ref|references|gallery|syntaxhighlight|noinclude|includeonly|onlyinclude|poem|math|timeline"
# Behaviour switches of MediaWiki.
WIKI_SWITCHES = "TOC|NOTOC|FORCETOC|NOEDITSECTION|NEWSECTIONLINK|NONEWSECTIONLINK|NOGALLERY|HIDDENCAT|EXPECTUNUSEDCATEGORY|INDEX|NOINDEX|NOTITLECONVERT|NOTC|NOCONTENTCONVERT|NOCC|STATICREDIRECT|START|END"
# MediaWiki's namespaces of categories, files and other pages, English and the languages of the collection.
WIKI_SPACES = "Category|File|Image|Media|Template|User|Talk|Special|Help|MediaWiki|Wikipedia|Portal|Kategorie|Datei|Bild|Vorlage|Catégorie|Fichier|Modèle|Categoría|Archivo|Plantilla|Categoria|Ficheiro|Imagem|Predefinição|Categorie|Bestand|Afbeelding|Sjabloon|Категория|Файл|Изображение|Шаблон|Категорія|Зображення"
# LaTeX commands that stand without an argument.
LATEX_BARE = "item|maketitle|tableofcontents|noindent|newline|newpage|clearpage|pagebreak|linebreak|par|bigskip|medskip|smallskip|hline|toprule|midrule|bottomrule|centering|raggedright|appendix|ldots|dots|cdots|cdot|times|quad|qquad|LaTeX|TeX|textbackslash|today|hfill|vfill|large|Large|small|footnotesize|normalsize|bfseries|itshape|alpha|beta|gamma|delta|epsilon|lambda|mu|pi|sigma|tau|phi|omega|sum|prod|int|infty|partial|le|ge|leq|geq|neq|approx|rightarrow|leftarrow|Rightarrow|to|in|log|ln|sin|cos|tan|exp|min|max|lim"
# LaTeX environments that hold formulas.
MATH_ENVIRONMENTS = "equation|align|gather|multline|eqnarray|math|displaymath|flalign|alignat|cases|split|array|matrix|pmatrix|bmatrix"

_ATTR = rf"""(?:\s+(?:[A-Za-z_:@][-\w:.@]*\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=`]+)|(?:{BARE_ATTRIBUTES})(?=[\s/>])))*"""
TAG = re.compile(rf"<(/?)([A-Za-z][A-Za-z0-9]*)({_ATTR})\s*/?>")
COMMENT = re.compile(r"<!--.*?-->", re.S)
DOCTYPE = re.compile(r"<!DOCTYPE\s[^<>]*>|<!\[CDATA\[|\]\]>", re.I)
HIDDEN = re.compile(rf"<(script|style)\b{_ATTR}\s*>.*?</\1\s*>", re.S | re.I)
PRE = re.compile(rf"<pre\b{_ATTR}\s*>(.*?)</pre\s*>", re.S | re.I)
#: An ampersand escaped any number of times before what may be an entity: each round would take one level off.
AMPERSANDS = re.compile(r"&(?:(?:amp|#38|#x26);)+(?=(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});)")
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")

WIKI_QUOTES = re.compile(r"'{2,}|\n")
WIKI_HEADING = re.compile(r"^[ \t]*(={1,6})[ \t]*([^=\s](?:[^\n]*?[^=\s])?)[ \t]*\1[ \t]*$", re.M)
WIKI_TABLE = re.compile(r"^[ \t]*\{\|[^\n]*\n(.*?)^[ \t]*\|\}[ \t]*$", re.M | re.S)
WIKI_SPACE_LINK = re.compile(rf"\[\[\s*:?(?:{WIKI_SPACES})\s*:[^\[\]]*\]\]", re.I)
WIKI_URL = re.compile(r"\[(?<!\[\[)(?:https?|ftp|mailto)://?[^\s\[\]]+(?:[ \t]+([^\[\]\n]+))?\](?![(\]])")
WIKI_SWITCH = re.compile(rf"__(?:{WIKI_SWITCHES})__")
WIKI_TAG = re.compile(rf"</?(?:{WIKI_TAGS})(?:\s[^<>]*)?/?>", re.I)
WIKI_REDIRECT = re.compile(r"^#REDIRECT[ \t]*\[\[([^\]\n]+)\]\]", re.M | re.I)
TEMPLATE = re.compile(r"\{\{\{[\w ]+(?:\|[^{}]*)?\}\}\}|\{\{(?:[^\s{}|#][^{}|\n]*(?:\n?[ \t]*\|[^{}]*)?|#\w+:[^{}]*|[ \t]*[^\s{}|][^{}|\n]*\|[^{}]*)\}\}")

BRACES = re.compile(r"\{\{|\}\}")

ENVIRONMENT = re.compile(r"\\(begin|end)\{([A-Za-z]+)\*?\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})*")
COMMAND = re.compile(r"\\[{}]|\\(?<![\\:]\\)([A-Za-z]+)\*?(?:\[[^\]\n]*\])*\{|[{}]")
BARE = re.compile(rf"\\(?<![\w\\:/]\\)(?:{LATEX_BARE})(?![A-Za-z\\.])(?:\[[^\]\n]*\])?")
DISPLAY = re.compile(r"\$\$(?<![\\$]\$\$)(?=[^$]*\S)[^$]+?\$\$")
MATH_SYMBOLS = re.compile(r"\\[A-Za-z]|[=^_+<>]")
PAREN = re.compile(r"\\(?<!\\\\)\((.+?)\\\)", re.S)
BRACKET = re.compile(r"\\(?<!\\\\)\[(.+?)\\\]", re.S)
INLINE = re.compile(r"\$(?<![\w$\\]\$)(?=\S)([^$\n]*?[^\s$\\])\$(?![\w$])")
MATH_ENVIRONMENT = re.compile(rf"\\begin\{{((?:{MATH_ENVIRONMENTS})\*?)\}}.*?\\end\{{\1\}}", re.S)
SECTION_LEVEL = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
LATEX_DROPPED = frozenset("cite citep citet ref label pageref eqref index vspace hspace usepackage documentclass input include includegraphics bibliography bibliographystyle pagestyle setlength newcommand".split())

FENCE = re.compile(r"^((?:[ ]{0,3}>[ ]?)*[ ]{0,3})(`{3,}(?=[^`\n]*$)|~{3,})[^\n]*(?:\n(?:.*\n)*?[ \t>]*\2[`~]*[ \t]*$|(?:\n.*)*\Z)", re.M)
INDENTED = re.compile(r"(?:\A|(?<=\n)(?<!\S\n)[ \t]*\n)((?:(?: {4}|\t)[^\n]*(?:\n|\Z))+)")
TICKS = re.compile(r"`(`*)(?!`)((?:[^`\n]|\n(?![ \t]*\n)|(?!`\1(?!`))(?<!`)`+)+?)(?<!`)`\1(?!`)")
LIST_LINE = re.compile(r"^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]")
#: What's left of a construct: only brackets, bars and the like.
RESIDUE = re.compile(r"[\s{}|<>\[\]&;=\\'/!]*|\s*\|[-+]\s*")
LINK_BEGINS, LINK_ENDS = "\ue002", "\ue003"
LINKED = re.compile("\ue002[^\ue003]*(?:\ue003|\\Z)|\\A[^\ue002\ue003]*\ue003")
PRIVATE = re.compile("[\ue000-\ue003]")
STRUCTURE = re.compile(r"[ \t]*(?:#{1,6}[ \t]|[-*+][ \t]|\d{1,9}[.)][ \t]|\||>)")
HELD = re.compile("\ue000(\\d+)\ue001")
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset head header hr html iframe legend main menu nav noscript ol optgroup option p section select summary table tbody tfoot thead title tr ul".split())


def _may_hold_markup(text: str) -> bool:
    """False only if no foreign construct can stand in the text."""
    if "<" in text or "&" in text or "\\" in text or "$" in text or "''" in text or "{{" in text or "{|" in text or "__" in text:
        return True
    if "\n=" in text or "\n\t=" in text or "\n =" in text or text.lstrip(" \t").startswith("="):
        return True
    if "[" in text and ("[http" in text or "[ftp" in text or "[mailto" in text or ("[[" in text and WIKI_SPACE_LINK.search(text) is not None)):
        return True
    return "#R" in text or "#r" in text


class _Hold:
    """Takes pieces out of a text and puts them back."""

    def __init__(self) -> None:
        self.pieces: list[str] = []

    def put(self, piece: str) -> str:
        self.pieces.append(piece)
        return f"\ue000{len(self.pieces) - 1}\ue001"

    def back(self, text: str) -> str:
        while "\ue000" in text:
            changed = HELD.sub(lambda m: self.pieces[int(m[1])] if int(m[1]) < len(self.pieces) else "", text)
            if changed == text:
                break
            text = changed
        return text


def _closed(pattern: re.Pattern, closer: str, replace, text: str) -> str:
    """``pattern.sub`` up to the last ``closer`` (lower case): without it no match can end, and each
    opener would be followed to the end of the text."""
    last = text.lower().rfind(closer) if closer.isalpha() or "/" in closer else text.rfind(closer)
    if last < 0:
        return text
    last = text.find(">", last) + 1 or len(text) if closer.startswith("</") else last + len(closer)
    return pattern.sub(replace, text[:last]) + text[last:]


def _hold_code(text: str, hold: _Hold) -> str:
    if "```" in text or "~~~" in text:
        text = FENCE.sub(lambda m: hold.put(m[0]), text)
    if "\n    " in text or "\n\t" in text or text[:4] == "    " or text[:1] == "\t":
        text = _hold_indented(text, hold)
    if "`" in text:
        text = TICKS.sub(lambda m: m[0] if m.string[m.start() - 1 : m.start()] == "\\" else hold.put(m[0]), text)
    return text


def _hold_indented(text: str, hold: _Hold) -> str:
    """Indented code begins after an empty line, outside of a list."""
    out: list[str] = []
    block: list[str] = []
    blank, in_list = True, False
    for line in text.split("\n"):
        if line.strip() and (line.startswith("    ") or line.startswith("\t")) and (block or (blank and not in_list)):
            block.append(line)
            continue
        if block:
            out.append(hold.put("\n".join(block)))
            block = []
        blank = not line.strip()
        if LIST_LINE.match(line):
            in_list = True
        elif not blank and not line[0].isspace():
            in_list = False
        out.append(line)
    if block:
        out.append(hold.put("\n".join(block)))
    return "\n".join(out)


def _commands(text: str, replace) -> str:
    """``text`` with each command and its argument replaced, inner ones first, in one pass over the braces.

    ``replace`` takes the name and the argument, without the braces of groups in it. Braces outside of commands stay.
    """
    out: list[str] = []
    opened: list[tuple[int, str | None]] = []
    pos = 0
    for m in COMMAND.finditer(text):
        out.append(text[pos : m.start()])
        pos = m.end()
        if m[0] == "}" and opened:
            at, name = opened.pop()
            if name is None:
                out.append("}")
            else:
                argument = "".join(out[at + 1 :])
                out[at:] = [replace(name, argument.replace("{", "").replace("}", "") if "{" in argument else argument)]
            continue
        if m[0] == "{" or m[1]:
            opened.append((len(out), m[1]))
        out.append(m[0])
    out.append(text[pos:])
    return "".join(out)


def _templates(text: str, replace) -> str:
    """``text`` without its templates and parameters, inner ones first, in one pass over the double braces."""
    out: list[str] = []
    opened: list[list] = []  # where it began, and whether braces that are no template lie within
    pos = 0
    while m := BRACES.search(text, pos):
        out.append(text[pos : m.start()])
        pos = m.end()
        if m[0] == "{{":
            opened.append([len(out), False])
        out.append(m[0])
        if m[0] == "{{" or not opened:
            continue
        at, foreign = opened.pop()
        whole = "" if foreign else "".join(out[at:])
        if whole.startswith("{{{") and text[pos : pos + 1] == "}" and TEMPLATE.fullmatch(whole + "}"):
            pos += 1
        elif not whole or not TEMPLATE.fullmatch(whole):
            if opened:
                opened[-1][1] = True
            continue
        out[at:] = [replace()]
    out.append(text[pos:])
    return "".join(out)


def _unquoted(text: str) -> str:
    """``text`` without MediaWiki's quotes (2, 3 or 5 apostrophes), pair by pair within a line, in one pass.

    A run opens before a character and closes after one, never within a word. One more apostrophe than the run
    that is open belongs to the word before it.
    """
    cuts: list[tuple[int, int]] = []
    opened: dict[int, list[int]] = {2: [], 3: [], 5: []}
    for m in WIKI_QUOTES.finditer(text):
        begin, end = m.span()
        size = end - begin
        if m[0] == "\n":
            for x in opened.values():
                x.clear()
            continue
        before, after = text[begin - 1 : begin], text[end : end + 1]
        in_word = before.isalnum() or before == "_"
        if before.strip() and not (after.isalnum() or after == "_"):
            for own in (size, size - 1 if in_word and size in (3, 4) else size):
                if opened.get(own):
                    at = opened[own].pop()
                    cuts += [(at, at + own), (end - own, end)]
                    break
            else:
                own = 0
            if own:
                continue
        if size in opened and not in_word and after.strip():
            opened[size].append(begin)
    out, pos = [], 0
    for begin, end in sorted(cuts):
        out.append(text[pos:begin])
        pos = end
    return "".join([*out, text[pos:]])


def _is_formula(content: str) -> bool:
    """Prices also stand between two dollar signs: a formula is a symbol, or has operators."""
    body = content.strip()
    if body[:1].isdigit():
        return bool(re.search(r"[\\^_={]", body))
    return bool(re.fullmatch(r"[A-Za-z]{1,2}'?|[A-Za-z]\d?", body)) or bool(re.search(r"[\\^_={}<>+*/|()-]", body) and re.search(r"[A-Za-z]", body))


def _latex(text: str, hold: _Hold) -> tuple[str, bool]:
    found = False

    def formula(m: re.Match) -> str:
        nonlocal found
        found = True
        return hold.put(m[0])

    def delimited(m: re.Match) -> str:
        content = m[1]
        return formula(m) if MATH_SYMBOLS.search(content) or re.fullmatch(r"\s*[A-Za-z]\s*", content) else m[0]

    if "$" in text:
        text = DISPLAY.sub(formula, text)
        text = INLINE.sub(lambda m: formula(m) if _is_formula(m[1]) else m[0], text)
    if "\\" not in text:
        return text, found
    if "~\\" in text:  # a tie before a citation goes with it
        text = text.replace("~\\cite", "\\cite").replace("~\\ref", "\\ref")
    text = _closed(MATH_ENVIRONMENT, "}", formula, text) if "\\end" in text else text
    text = _closed(PAREN, "\\)", delimited, text)
    text = _closed(BRACKET, "\\]", delimited, text)

    def environment(m: re.Match) -> str:
        nonlocal found
        found = True
        return ""

    def command(name: str, content: str) -> str:
        nonlocal found
        found = True
        content = content.strip()
        if name in SECTION_LEVEL:
            return "\n" + "#" * SECTION_LEVEL[name] + " " + content + "\n"
        if name in LATEX_DROPPED:
            return ""
        return f" ({content})" if name in ("footnote", "footnotetext") else content

    def bare(m: re.Match) -> str:
        nonlocal found
        found = True
        return "-" if m[0].startswith("\\item") else ("…" if "dots" in m[0] else "")

    text = _commands(ENVIRONMENT.sub(environment, text), command)
    return BARE.sub(bare, text), found


def _cells(line: str) -> list[str]:
    """The cells of one line of a MediaWiki table."""
    parts = re.split(r"\|\||!!", line[1:])
    return [c.split("|", 1)[1].strip() if re.match(r'\s*[\w-]+\s*=\s*"?[^|]*\|', c) else c.strip() for c in parts]


def _wiki(text: str) -> tuple[str, bool]:
    found = False

    def hit(result: str) -> str:
        nonlocal found
        found = True
        return result

    def table(m: re.Match) -> str:
        rows: list[list[str]] = [[]]
        for line in m[1].split("\n"):
            line = line.strip()
            if line.startswith("|-"):
                rows.append([])
            elif line.startswith("|+"):
                rows.append([line[2:].strip()])
            elif line[:1] in ("|", "!"):
                rows[-1].extend(_cells(line))
        return hit("\n".join("| " + " | ".join(r) + " |" for r in rows if r))

    if "{" in text:
        text = _closed(WIKI_TABLE, "|}", table, text)
        if "{{" in text:
            text = _templates(text, lambda: hit(""))
    if "''" in text and (bare := _unquoted(text)) != text:
        text = hit(bare)
    if "=" in text and (text.lstrip(" \t").startswith("=") or re.search(r"\n[ \t]*=", text)):
        text = WIKI_HEADING.sub(lambda m: hit("#" * len(m[1]) + " " + m[2]), text)
    if "__" in text:
        text = WIKI_SWITCH.sub(lambda m: hit(""), text)
    if "[" in text:
        if "#R" in text or "#r" in text:
            text = WIKI_REDIRECT.sub(lambda m: hit(m[1]), text)
        if "[[" in text:
            text = WIKI_SPACE_LINK.sub(lambda m: hit(""), text)
        text = WIKI_URL.sub(lambda m: hit(m[1] or ""), text)
    if "<" in text:
        text = WIKI_TAG.sub(lambda m: hit(""), text)
    return text, found


def _html(text: str, hold: _Hold) -> tuple[str, bool]:
    found = False

    def hit(result: str) -> str:
        nonlocal found
        found = True
        return result

    def code(m: re.Match) -> str:
        return hit("\n" + hold.put("```\n" + html.unescape(TAG.sub("", m[1])).strip("\n") + "\n```") + "\n")

    def tag(m: re.Match) -> str:
        name, closing = m[2].lower(), bool(m[1])
        if name not in HTML_ELEMENTS:
            return m[0]
        if name == "br":
            return hit("\n")
        if name == "li":
            return hit("" if closing else "\n- ")
        if name == "a":
            return hit(LINK_ENDS if closing else LINK_BEGINS)
        if name in ("td", "th"):
            return hit(" |" if closing else " ")
        if name == "tr":
            return hit("\n" if closing else "\n|")
        if len(name) == 2 and name[0] == "h" and name[1].isdigit():
            return hit("\n" if closing else "\n" + "#" * int(name[1]) + " ")
        return hit("\n" if name in BLOCK_TAGS else "")

    def entity(m: re.Match) -> str:
        char = html.unescape(m[0])
        return m[0] if char == m[0] or char.endswith(";") and m[0] != "&semi;" and len(char) > 2 else hit(" " if char == "\xa0" else char)

    while True:  # a further round is for tags written as entities
        if "<" in text:
            text = _closed(COMMENT, "-->", lambda m: hit(""), text)
            if "<!" in text:
                text = DOCTYPE.sub(lambda m: hit(""), text)
            text = _closed(HIDDEN, "</s", lambda m: hit(""), text)
            text = _closed(PRE, "</pre", code, text)
            text = TAG.sub(tag, text)
        if "&" not in text:
            break
        changed = ENTITY.sub(entity, AMPERSANDS.sub("&", text))
        if changed == text:
            break
        text = changed
    return text, found


def line_blocks(lengths: list[int], window: int, surge: int) -> list[bool]:
    """Which lines lie in a region of text, by the line-block distribution.

    A block is ``window`` lines from a line on, its size the sum of their lengths. A region begins at a
    line with text whose block reaches ``surge`` (or the largest block there is, if none does), and ends where a block is empty.
    """
    n = len(lengths)
    sums = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        sums[i] = sums[i + 1] + lengths[i]
    block = [sums[i] - sums[min(n, i + window)] for i in range(n)]
    surge = min(surge, max(block, default=0))
    keep, inside = [False] * n, False
    for i in range(n):
        if not inside:
            inside = lengths[i] > 0 and block[i] >= surge
        elif block[i] == 0:
            inside = False
        keep[i] = inside
    return keep


def _length(line: str, own: set[str], surge: int) -> int:
    """What a stripped line adds to its blocks: nothing if only residue or links are left of it, its length without
    blanks else; native lines and those of a structure weigh as much as makes a region."""
    text = LINKED.sub("", line) if LINK_BEGINS in line or LINK_ENDS in line else line
    mark = STRUCTURE.match(text)
    if RESIDUE.fullmatch(text, mark.end() if mark else 0):
        return 0
    n = len(text) - text.count(" ")
    return max(n, surge) if mark or line in own or "\ue000" in text else n


def _stripped(body: str, hold: _Hold) -> tuple[str, list[str], set[str]]:
    """The text without foreign constructs, the systems stripped from it, and the lines it had before."""
    if not _may_hold_markup(body) or not _may_hold_markup(text := _hold_code(body, hold)):
        return body, [], set()
    own = set(text.split("\n"))
    text, latex = _latex(text, hold)
    text, wiki = _wiki(text)
    text, tags = _html(text, hold)
    return text, [name for name, stripped in (("html", tags), ("latex", latex), ("wiki", wiki)) if stripped], own


def _unified(body: str) -> str:
    if "\r" in body:
        body = body.replace("\r\n", "\n").replace("\r", "\n")
    return PRIVATE.sub("", body) if not body.isascii() and PRIVATE.search(body) else body


def _joined(lines: list[str], keep: list[bool], hold: _Hold) -> str:
    out: list[str] = []
    for line, kept in zip(lines, keep):
        line = line.replace(LINK_BEGINS, "").replace(LINK_ENDS, "")
        if kept and not RESIDUE.fullmatch(line):
            out.append(re.sub(r"(?<=\S) {2,}", " ", line).rstrip())
        elif out and out[-1] and not line.strip():
            out.append("")
    return hold.back("\n".join(out)).strip("\n")


def strip(body: str) -> str:
    """All text of ``body`` without foreign constructs; no line with text of its own is left out."""
    body, hold = _unified(body), _Hold()
    text, systems, _ = _stripped(body, hold)
    if not systems:
        return body
    lines = text.split("\n")
    return _joined(lines, [True] * len(lines), hold)


def clean(body: str, window: int = 3, surge: int = 40) -> tuple[str, list[str]]:
    """The clean text, and the foreign systems stripped from ``body`` outside of code.

    ``surge`` is the number of characters without blanks in ``window`` lines at which a region of text begins.
    """
    body, hold = _unified(body), _Hold()
    text, systems, own = _stripped(body, hold)
    if not systems:
        return body, systems
    lines = text.split("\n")
    return _joined(lines, line_blocks([_length(x, own, surge) for x in lines], window, surge), hold), systems


SCHEMA = "id string, clean_text string, clean_headings array<string>, markup array<string>"


def clean_nodes(nodes: DataFrame, window: int = 3, surge: int = 40) -> DataFrame:
    """Clean text and headings of the current row of each path, with the systems found in its body.

    Columns: id, clean_text, clean_headings, markup. Cleaning takes place before rows are compared, so
    that each text is read once; ``nodes`` may have other columns. One row per non-null path.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [clean(b, window, surge) if b is not None else (None, []) for b in f["body"]]
            yield pd.DataFrame(
                {
                    "path": f["path"],
                    "indexed_at": f["indexed_at"],
                    "source_hash": f["source_hash"],
                    "id": f["id"],
                    "clean_text": pd.Series([x[0] for x in done], dtype=object),
                    "clean_headings": pd.Series([None if h is None else [clean(x)[0] if x else x for x in h] for h in f["headings"]], dtype=object),
                    "markup": pd.Series([x[1] for x in done], dtype=object),
                }
            )

    from ..operators.current import latest

    rows = nodes.select("path", "indexed_at", "source_hash", "id", "body", "headings").mapInPandas(run, "path string, indexed_at timestamp, source_hash string, " + SCHEMA)
    return latest(rows, "path", "indexed_at", "source_hash", "id", "clean_text", "clean_headings", "markup").select("id", "clean_text", "clean_headings", "markup")


def markup_found(nodes: DataFrame) -> DataFrame:
    """Each current node with each foreign system in its body: id, markup. The texts don't leave Python."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame(
                {
                    "path": f["path"],
                    "indexed_at": f["indexed_at"],
                    "source_hash": f["source_hash"],
                    "id": f["id"],
                    "markup": pd.Series([clean(b)[1] if b is not None else [] for b in f["body"]], dtype=object),
                }
            )

    from ..operators.current import latest

    rows = nodes.select("path", "indexed_at", "source_hash", "id", "body").mapInPandas(run, "path string, indexed_at timestamp, source_hash string, id string, markup array<string>")
    return latest(rows, "path", "indexed_at", "source_hash", "id", "markup").select("id", F.explode("markup").alias("markup")).where(F.col("id").isNotNull()).distinct()
