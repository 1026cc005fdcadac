"""The static-site dialect's own marks, found by scanning and changed as range edits: each rule gives edits, ``spliced`` puts them in.

Lines are walked once with the state of the fence that they stand in; what lies within a fence is never touched by the rules of lines.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator

from .edits import spliced

Edit = tuple[int, int, str]
#: Kinds of admonitions, marks that make a title quoted, endings of images, folders of themes and snippets.
ADMONITIONS = {"note": "Note", "tip": "Tip", "info": "Info", "warning": "Warning", "caution": "Warning", "danger": "Danger", "success": "Check"}
QUOTED = set(":#[]{}&*!|>'\"%@`,")
IMAGES = {".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".avif", ".ico"}
THEMES = ("@theme/", "@docusaurus/")
SNIPPETS = "_snippets"
BLANK = " \t\r\n\f\v"


def lines(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, fenced) of each line; a fence's own lines count as fenced."""
    at, inside = 0, False
    while True:
        end = text.find("\n", at)
        stop = len(text) if end < 0 else end
        edge = text.startswith("```", at)
        yield at, stop, inside or edge
        inside ^= edge
        if end < 0:
            return
        at = end + 1


def admonition_edits(text: str) -> Iterator[Edit]:
    """``:::kind[Title]`` up to ``:::``; fences between them stay as they are."""
    name = None
    for start, end, fenced in lines(text):
        row = text[start:end].rstrip(BLANK)
        if fenced or not row.startswith(":::"):
            continue
        kind, bracket, rest = row[3:].partition("[")
        if name is None and kind.isascii() and kind.replace("_", "a").isalnum() and (not bracket or len(rest) > 1 and rest.endswith("]")):
            name = ADMONITIONS.get(kind.lower(), "Note")
            yield start, end, f"<{name}>" + (f"\n**{rest[:-1]}**\n" if bracket else "")
        elif name is not None and row == ":::":
            yield start, end, f"</{name}>"
            name = None


def accordion_edits(text: str) -> Iterator[Edit]:
    """A summary on the line after its details becomes the title; every end of details becomes one of an accordion."""
    at = text.find("<details>")
    while at >= 0:
        inner = at + len("<details>")
        body = len(text) - len(text[inner:].lstrip(BLANK))
        close = text.find("</summary>", body)
        if "\n" in text[inner:body] and text.startswith("<summary>", body) and close >= 0:
            title = text[body + len("<summary>") : close].strip(BLANK)
            yield at, close + len("</summary>"), '<Accordion title="{}">'.format(title.replace('"', "&quot;"))
            inner = close
        at = text.find("<details>", inner)
    for m in re.finditer("</details>", text):
        yield m.start(), m.end(), "</Accordion>"


def targets(text: str) -> Iterator[tuple[int, int]]:
    """Where the targets of links stand: after ``](`` up to the bracket, and in ``href`` up to the quote."""
    for mark, ends in (("](", ")"), ('href="', "\"'"), ("href='", "\"'")):
        at = text.find(mark)
        while at >= 0:
            start = at + len(mark)
            stop = min((p for p in (text.find(e, start) for e in ends) if p >= 0), default=-1)
            if stop >= 0:
                yield start, stop
            at = text.find(mark, start)


def extension_edits(text: str) -> Iterator[Edit]:
    """Targets lose ``.md`` or ``.mdx`` before their fragment."""
    for start, stop in targets(text):
        path = text[start:stop].split("#", 1)[0]
        bare = path.removesuffix(".mdx") if path.endswith(".mdx") else path.removesuffix(".md")
        if bare and bare != path and not set(bare) & {'"', "'"}:
            yield start + len(bare), start + len(path), ""


def import_parts(row: str) -> tuple[int, int, str] | None:
    """Of ``import name from 'target'``: where the quoted target begins and ends, and the target; None for other lines."""
    words = row.split(None, 3)
    if len(words) < 4 or words[0] != "import" or words[2] != "from" or words[3][0] not in "'\"" or not row.startswith("import"):
        return None
    begin = row.rindex(words[3])
    quote = re.compile(r"""['"]""").search(row, begin + 1)
    if not quote or row[quote.end() :].strip(BLANK) not in ("", ";"):
        return None
    return begin, quote.end(), row[begin + 1 : quote.start()]


def theme_import_edits(text: str) -> Iterator[Edit]:
    """Imports from themes go, with the empty lines after them; one at the very end without a line end stays."""
    for start, end, _ in lines(text):
        found = import_parts(text[start:end])
        if found and end < len(text) and any(found[2].startswith(t) and found[2] != t for t in THEMES):
            rest = len(text) - len(text[end:].lstrip(BLANK))
            yield start, text.rindex("\n", end, max(rest, end + 1)) + 1, ""


def is_snippet(path: str) -> bool:
    """A file whose name begins with an underscore, or that lies below a folder of snippets."""
    *folders, name = path.split("/")
    return name.startswith("_") or SNIPPETS in folders


def snippet_path(path: str) -> str:
    """Where a document is written: snippets below ``snippets/``, markdown as MDX."""
    whole = f"snippets/{path}" if is_snippet(path) else path
    return whole[:-3] + ".mdx" if whole.endswith(".md") else whole


def snippet_import_edits(text: str, path: str) -> Iterator[Edit]:
    """Relative imports of snippets name them from the root."""
    for start, end, _ in lines(text):
        found = import_parts(text[start:end])
        if found and found[2].startswith("."):
            target = posixpath.normpath(posixpath.join(posixpath.dirname(path), found[2]))
            if is_snippet(target):
                quote = text[start + found[0]]
                yield start + found[0], end, f"{quote}/snippets/{target[:-3] + '.mdx' if target.endswith('.md') else target}{quote}"


def image_target(src: str, path: str, in_docs: Callable[[str], bool], in_static: Callable[[str], bool]) -> str:
    """Where an image of the document at ``path`` is found: beside the documents as it is, else below ``/static``."""
    if re.match(r"https?://|data:|//|/static/", src):
        return src
    if src.startswith("/"):
        return "/static" + src
    bare, mark, fragment = src.partition("#")
    ending = posixpath.splitext(bare)[1].lower()
    if ending and ending not in IMAGES or in_docs(posixpath.normpath(posixpath.join(posixpath.dirname(path), bare))):
        return src
    below = re.sub(r"^(?:\.\./)+", "", bare).removeprefix("./")
    return f"/static/{below}{mark}{fragment}" if below else src


def image_edits(text: str, path: str, in_docs: Callable[[str], bool], in_static: Callable[[str], bool] = lambda p: False) -> Iterator[Edit]:
    """Images are framed, unless they are, and named by where they are found."""
    image = re.compile(r"!\[([^\]]*)\]\(([^)]+)\)")
    for start, end, fenced in lines(text):
        for m in () if fenced else image.finditer(text, start, end):
            if not text.startswith("<Frame>", m.start() - 7) or m.start() - 7 < start:
                yield m.start(), m.end() + (8 if text.startswith("</Frame>", m.end()) else 0), f"<Frame>![{m[1]}]({image_target(m[2], path, in_docs, in_static)})</Frame>"


def heading_edits(text: str) -> Iterator[Edit]:
    """Headings that name their anchor."""
    for start, end, fenced in lines(text):
        row = text[start:end].rstrip(BLANK)
        level = len(row) - len(row.lstrip("#"))
        if fenced or not 1 <= level <= 6 or not row.endswith("}") or row[level : level + 1] not in tuple(" \t"):
            continue
        shown, mark, anchor = row[level:].lstrip(BLANK).partition("{#")
        if mark and shown != shown.rstrip(BLANK) and anchor[:-1] and "}" not in anchor[:-1]:
            yield start, end, f'<Heading level="{level}" id="{anchor[:-1]}">{shown.rstrip(BLANK)}</Heading>'


def placeholder_edits(text: str) -> Iterator[Edit]:
    """References to code become comments that say so, references to documents become links; marks may be escaped."""
    form = re.compile(r"""\\?\{@(?:codeBlock\\?:\s*(?P<code>[^}\\]+?)|doc\\?:\s*"(?P<label>[^|"]+)\|(?P<link>[^"]+)")\\?\}""")
    for m in form.finditer(text):
        yield m.start(), m.end(), f"{{/* TODO: codeBlock: {m['code'].strip()} */}}" if m["code"] else f"[{m['label']}]({m['link']})"


def title_value(value: str) -> str:
    """A title as front matter has it: quoted where a mark asks for it."""
    return '"{}"'.format(value.replace('"', '\\"')) if QUOTED & set(value) else value


def changed(rule: Callable[..., Iterator[Edit]], *more) -> Callable[[str], str]:
    """The rule as text to text."""
    return lambda text: spliced(text, rule(text, *more))[0]
