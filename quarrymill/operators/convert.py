"""HTML pages to MDX: scope, remove, components, tables, images, code, markdown, cleaning, front matter. One map over rows, no shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from .html_tree import Node, parse, select
from .rewrite import VOID_TAGS, mapped

#: Components for kinds of callouts, and what tells a code block's language.
CALLOUTS = {"note": "Note", "info": "Info", "tip": "Tip", "hint": "Tip", "warning": "Warning", "caution": "Warning", "danger": "Danger", "error": "Danger", "success": "Check", "check": "Check"}
LANGUAGE_PREFIXES = ["language-", "lang-", "highlight-"]


@dataclass
class Config:
    """What to convert and how. ``components`` are generic definitions; ``pre`` and ``post`` are hooks on tree and text."""

    content_selector: str = "body"
    title_selector: str = "h1"
    remove: list[str] = field(default_factory=list)
    preserve: list[str] = field(default_factory=lambda: ["table", "iframe"])
    components: list[dict] = field(default_factory=list)
    callouts: dict[str, str] = field(default_factory=dict)
    image_strategy: str = "keep_remote"
    image_folder: str = "images"
    language_prefixes: list[str] = field(default_factory=lambda: list(LANGUAGE_PREFIXES))
    pre: list[Callable] = field(default_factory=list)
    post: list[Callable] = field(default_factory=list)


class Store:
    """Finished text that markdown rendering and cleaning must not touch, by a marker each; numbered, so results are repeatable."""

    def __init__(self) -> None:
        self.held: list[str] = []

    def put(self, text: str) -> str:
        self.held.append(text)
        return f"\x02{len(self.held) - 1}\x03"

    def restore(self, text: str) -> str:
        while re.search("\x02\\d+\x03", text):
            text = re.sub("\x02(\\d+)\x03", lambda m: self.held[int(m[1])], text)
        return text


def absolute(src: str, page: str) -> str:
    try:
        return urljoin(page, src)
    except ValueError:
        return src


def image_path(src: str, page: str, strategy: str = "keep_remote", folder: str = "images") -> str:
    """Where an image is referred to: its own address, a local folder by its path, or by its name."""
    full = absolute(src, page)
    path = urlsplit(full).path
    if strategy == "keep_remote" or not path:
        return full
    return f"/{folder}{path}" if strategy == "preserve_path" else f"/{folder}/{path.rsplit('/', 1)[-1]}"


def is_simple_table(table: Node) -> bool:
    return not any(n.tag in ("ul", "ol", "pre", "blockquote", "table", "div") for n in table.walk())


def table_to_gfm(table: Node | str) -> str | None:
    """Rows of trimmed cells, padded to the widest; the line under the head only where there is one; null without rows."""
    if isinstance(table, str):
        found = select(parse(table), "table")
        if not found:
            return None
        table = found[0]
    rows = []
    for tr in (n for n in table.walk() if n.tag == "tr"):
        cells = [re.sub(r"\s+", " ", c.text().strip().replace("|", "\\|")) for c in tr.children if isinstance(c, Node) and c.tag in ("th", "td")]
        if cells:
            rows.append(cells)
    if not rows:
        return None
    first = next(n for n in table.walk() if n.tag == "tr")
    head = any(n.tag == "thead" for n in table.walk()) or any(isinstance(c, Node) and c.tag == "th" for c in first.children)
    width = max(map(len, rows))
    out = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    if head:
        out.insert(1, "| " + " | ".join(["---"] * width) + " |")
    return "\n".join(out)


def code_language(pre: Node, prefixes: list[str]) -> str:
    from ..functions.text import LANGUAGES

    nodes = [pre, *(c for c in pre.walk() if c.tag == "code"), *([pre.parent] if pre.parent is not None else [])]
    for n in nodes:
        names = [n.attrs.get("data-lang") or n.attrs.get("data-language") or "", *(c[len(p) :] for c in n.classes() for p in prefixes if c.startswith(p))]
        for name in names:
            if name:
                return LANGUAGES.get(name.lower(), name.lower())
    return ""


# --- components -------------------------------------------------------------------------------


def props_text(props: dict[str, str]) -> str:
    return "".join(f' {k}="{v.replace(chr(34), "&quot;")}"' for k, v in props.items() if v)


def take_prop(node: Node, how) -> str:
    """A property: ``@attr`` or {"attr"} of the element, a selector's text (which is consumed), {"selector", "attr"}, or {"value"}."""
    if isinstance(how, str):
        how = {"attr": how[1:]} if how.startswith("@") else {"selector": how}
    if "value" in how:
        return str(how["value"])
    target = node
    if how.get("selector"):
        found = select(node, how["selector"])
        if not found:
            return ""
        target = found[0]
    if how.get("attr"):
        return target.attrs.get(how["attr"], "").strip()
    text = target.text().strip()
    if target is not node:
        target.replace()
    return text


def generic_components(root: Node, definitions: list[dict], write: Callable[[Node], str], store: Store) -> None:
    """Replace elements by component tags; elements of a ``group`` that follow one another are wrapped together."""
    for d in definitions:
        found = [n for n in select(root, d["selector"]) if n.parent is not None]
        made: dict[int, Node] = {}
        for n in found:
            props = {k: take_prop(n, how) for k, how in d.get("props", {}).items()}
            inner = n
            if d.get("content"):
                inner = next(iter(select(n, d["content"])), n)
            body = write(inner).strip()
            mark = Node("x-done", {"group": d.get("group", {}).get("wrapper", "")}, n.parent)
            mark.children = [store.put(f"<{d['name']}{props_text(props)}>\n{body}\n</{d['name']}>")]
            n.replace(mark)
            made[id(mark)] = mark
        wrapper = d.get("group", {}).get("wrapper")
        if wrapper:
            wrap_runs([m for m in made.values()], wrapper, store)


def wrap_runs(marks: list[Node], wrapper: str, store: Store) -> None:
    """Put marks that are neighbours, but for white space, into one wrapper."""
    left = list(marks)
    while left:
        run = [left.pop(0)]
        siblings = run[0].parent.children
        at = next(i for i, c in enumerate(siblings) if c is run[0])
        end = at + 1
        while end < len(siblings):
            c = siblings[end]
            if isinstance(c, Node) and any(c is m for m in left):
                run.append(c)
                left = [m for m in left if m is not c]
            elif not (isinstance(c, str) and not c.strip()):
                break
            end += 1
        whole = Node("x-done", {}, run[0].parent)
        whole.children = [store.put(f"<{wrapper}>\n" + "\n".join("".join(map(str, m.children)) for m in run) + f"\n</{wrapper}>")]
        siblings[at:end] = [whole]


def builtin_components(root: Node, config: Config, write: Callable[[Node], str], store: Store) -> None:
    """Callouts by class, details as accordions (runs of them grouped), tabs of known shapes."""
    for selector, name in config.callouts.items():
        for n in select(root, selector):
            kind = CALLOUTS.get(name.lower(), name)
            mark = Node("x-done", {}, n.parent)
            mark.children = [store.put(f"<{kind}>\n{write(n).strip()}\n</{kind}>")]
            n.replace(mark)
    marks = []
    for n in reversed(select(root, "details")):
        title = next((c for c in n.children if isinstance(c, Node) and c.tag == "summary"), None)
        text = title.text().strip() if title is not None else "Details"
        if title is not None:
            title.replace()
        mark = Node("x-done", {}, n.parent)
        mark.children = [store.put(f"<Accordion{props_text({'title': text})}>\n{write(n).strip()}\n</Accordion>")]
        n.replace(mark)
        marks.insert(0, mark)
    attached = [m for m in marks if any(c is m for c in m.parent.children)]
    groups: dict[int, list[Node]] = {}
    for m in attached:
        groups.setdefault(id(m.parent), []).append(m)
    for same in groups.values():
        if len(same) > 1:
            wrap_runs(same, "AccordionGroup", store)


# --- markdown ---------------------------------------------------------------------------------

INLINE_MARKS = {"strong": "**", "b": "**", "em": "_", "i": "_", "del": "~~", "s": "~~"}
DROPPED = {"script", "style", "noscript", "head", "template", "title"}


class Writer:
    """Markdown with ``#`` headings, ``-`` lists and fenced code."""

    def __init__(self, config: Config, page: str, store: Store) -> None:
        self.config, self.page, self.store = config, page, store

    def inline(self, node: Node | str) -> str:
        if isinstance(node, str):
            return re.sub(r"[ \t\r\n]+", " ", node)
        inner = lambda: "".join(self.inline(c) for c in node.children)
        t = node.tag
        if t in DROPPED:
            return ""
        if t == "x-done":
            return "".join(map(str, node.children))
        if t == "br":
            return "  \n"
        if t == "code":
            text = node.text()
            fence = "``" if "`" in text else "`"
            return self.store.put(f"{fence}{text}{fence}") if text else ""
        if t == "img":
            return self.image(node)
        if t == "a":
            text, href = inner().strip(), node.attrs.get("href", "")
            return f"[{text}]({href})" if href else text
        if t in INLINE_MARKS:
            text = inner()
            bare = text.strip()
            return text if not bare else text.replace(bare, f"{INLINE_MARKS[t]}{bare}{INLINE_MARKS[t]}", 1)
        return self.block(node) if t in ("table", "pre", "ul", "ol", "iframe") else inner()

    def image(self, node: Node) -> str:
        src = node.attrs.get("src", "").strip()
        if not src:
            return ""
        path = image_path(src, self.page, self.config.image_strategy, self.config.image_folder)
        alt = node.attrs.get("alt", "")
        inside = node.parent
        while inside is not None:
            if inside.tag in ("table", "p", "a", "li"):
                return f"![{alt}]({path})"
            inside = inside.parent
        return self.store.put(f"<Frame>\n![{alt}]({path})\n</Frame>")

    def children(self, node: Node) -> str:
        out, run = [], []

        def flush():
            text = "".join(run).strip()
            if text:
                out.append(re.sub(r" *\n *", lambda m: m[0] if m[0].startswith("  ") else "\n", text))
            run.clear()

        for c in node.children:
            if isinstance(c, Node) and (c.tag in BLOCK_TAGS or c.tag == "img" and node.tag not in FLOWING or any(d.tag in BLOCK_TAGS for d in c.walk()) and c.tag != "a"):
                flush()
                text = self.block(c)
                if text.strip():
                    out.append(text.strip("\n"))
            else:
                run.append(self.inline(c))
        flush()
        return "\n\n".join(out)

    def block(self, node: Node) -> str:
        t = node.tag
        if t in DROPPED:
            return ""
        if m := re.fullmatch(r"h([1-6])", t):
            text = re.sub(r"\s+", " ", "".join(self.inline(c) for c in node.children)).strip()
            return f"{'#' * int(m[1])} {text}" if text else ""
        if t == "pre":
            text = node.text().strip("\n")
            return self.store.put(f"```{code_language(node, self.config.language_prefixes)}\n{text}\n```")
        if t == "hr":
            return "---"
        if t == "blockquote":
            return "\n".join(f"> {x}".rstrip() for x in self.children(node).split("\n"))
        if t in ("ul", "ol"):
            out = []
            for k, li in enumerate((c for c in node.children if isinstance(c, Node) and c.tag == "li"), int(node.attrs.get("start") or 1) if (node.attrs.get("start") or "1").isdigit() else 1):
                lead = f"{k}. " if t == "ol" else "- "
                body = re.sub(r"\n\n(?=\s*(?:-|\d+\.) )", "\n", self.children(li))
                out.append(lead + body.replace("\n", "\n" + " " * len(lead)))
            return "\n".join(out)
        if t == "table":
            if "table" in self.config.preserve or not is_simple_table(node):
                return self.store.put(node.html())
            made = table_to_gfm(node)
            return self.store.put(made) if made else ""
        if t in self.config.preserve:
            return self.store.put(node.html())
        if t == "x-done":
            return "".join(map(str, node.children))
        return self.image(node) if t == "img" else self.children(node)


BLOCK_TAGS = set("address article aside blockquote body details dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html iframe li main nav ol p pre section table ul x-done".split())
#: Where an image stands among words.
FLOWING = set("p a li td th span b strong em i h1 h2 h3 h4 h5 h6 figcaption".split())


# --- cleaning ---------------------------------------------------------------------------------


def outside_fences(text: str, rule: Callable[[str], str]) -> str:
    parts = re.split(r"(```[\s\S]*?```)", text)
    return "".join(p if i % 2 else rule(p) for i, p in enumerate(parts))


def strip_heading_anchors(text: str) -> str:
    text = re.sub(r"^(#{1,6}\s+.*?)\s*\[[^\]]*\]\(#[^)]*\)\s*$", r"\1", text, flags=re.M)
    return re.sub(r"^(#{1,6}\s+)\[([^\]]+)\]\(#[^)]*\)", r"\1\2", text, flags=re.M)


def strip_title_heading(text: str, title: str) -> str:
    """The first ``#`` heading goes if it is the title, in any case of letters."""
    m = re.search(r"^# (.+)$", text, re.M)
    return text[: m.start()] + text[m.end() :] if title and m and m[1].strip().lower() == title.strip().lower() else text


def space_components(text: str) -> str:
    """Blank lines around component tags."""
    text = re.sub(r"(</[A-Z][a-zA-Z]*>)[ \t]+(<[A-Z][a-zA-Z]*[\s>])", r"\1\n\n\2", text)
    text = re.sub(r"([^\n])\n(<[A-Z][a-zA-Z]*[\s>])", r"\1\n\n\2", text)
    return re.sub(r"(</[A-Z][a-zA-Z]*>)\n([^\n])", r"\1\n\n\2", text)


def space_blocks(text: str) -> str:
    text = re.sub(r"([^\n])(<(?:table|iframe)[\s>])", r"\1\n\n\2", text, flags=re.I)
    return re.sub(r"(</(?:table|iframe)>)[^\n]*\n(?!\n)", r"\1\n\n", text)


def react_styles(text: str) -> str:
    """Inline styles as objects, outside fences."""

    def one(m: re.Match) -> str:
        pairs = (d.split(":", 1) for d in m[1].split(";") if ":" in d)
        return "style={{" + ", ".join(f'{re.sub("-([a-z])", lambda c: c[1].upper(), k.strip())}: "{v.strip()}"' for k, v in pairs) + "}}"

    return outside_fences(text, lambda t: re.sub(r'\bstyle="([^"]*)"', one, t))


def close_void(text: str) -> str:
    tags = "|".join([*VOID_TAGS, "param"])
    return outside_fences(text, lambda t: re.sub(rf"<({tags})(\s[^>]*?)?\s*/?>", lambda m: f"<{m[1]}{(m[2] or '').rstrip()}/>", t, flags=re.I))


def squeeze(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def escape_brackets(text: str) -> str:
    """Bare angle brackets outside fences as entities."""
    return outside_fences(text, lambda t: re.sub(r"""(?<![a-zA-Z"'=\w])>""", "&gt;", re.sub(r"<(?![a-zA-Z/!?])", "&lt;", t)) if not t.startswith(">") else t)


def clean(text: str, title: str = "") -> str:
    return squeeze(close_void(react_styles(space_blocks(space_components(strip_title_heading(strip_heading_anchors(text), title))))))


def yaml_scalar(value: str) -> str:
    return f'"{value}"' if '"' not in value else f"'{value}'" if "'" not in value else '"' + value.replace('"', '\\"') + '"'


def front_matter(title: str, values: dict[str, str]) -> str:
    rows = [f"title: {yaml_scalar(title)}"]
    rows += [f"{yaml_scalar(k) if ':' in k else k}: {yaml_scalar(str(v))}" for k, v in values.items() if v not in (None, "")]
    return "---\n" + "\n".join(rows) + "\n---"


def convert_page(html: str, url: str = "", config: Config | None = None, title: str = "", extra: dict[str, str] | None = None) -> str:
    """One page as MDX; without the content area a document that says so."""
    config = config or Config()
    tree = parse(html or "")
    if not title:
        found = next(iter(select(tree, config.title_selector)), None)
        title = found.text().strip() if found is not None else ""
        if not title:
            tag = next(iter(select(tree, "title")), None)
            title = tag.text().strip() if tag is not None else ""
        title = title.split(" | ")[0].strip()
    values = dict(extra or {})
    if url:
        values["permalink"] = url
    for name in ("og:title", "og:description", "og:image"):
        for n in select(tree, "meta"):
            if n.attrs.get("property") == name and n.attrs.get("content"):
                values[name] = n.attrs["content"]
                break
    areas = select(tree, config.content_selector)
    if not areas and config.content_selector == "body":
        areas = [tree]
    if not areas:
        return front_matter(title, {}) + "\n\n<!-- No content found -->"
    area = areas[0]
    for selector in config.remove:
        try:
            for n in select(area, selector):
                if n.parent is not None and any(c is n for c in n.parent.children):
                    n.replace()
        except ValueError:
            continue
    store = Store()
    for hook in config.pre:
        hook(area, url, config, store)
    writer = Writer(config, url, store)
    generic_components(area, config.components, writer.children, store)
    builtin_components(area, config, writer.children, store)
    text = store.restore(escape_brackets(writer.children(area)))
    text = clean(text, title)
    for hook in config.post:
        new = hook(text, url, config)
        text = new if isinstance(new, str) else text
    return front_matter(title, values) + "\n\n" + text


def convert_pages(pages: DataFrame, config: Config | None = None) -> DataFrame:
    """(page_id, mdx), a row for each page; a null page is an empty one."""
    return mapped(pages, ["page_id", "url", "html"], "page_id long, mdx string", [pa.int64(), pa.string()], lambda i, u, h: (i, convert_page(h or "", u or "", config)))


def tables_to_gfm(pages: DataFrame) -> DataFrame:
    """(page_id, table, gfm): every table of every page; null where it has no rows."""
    from pyspark.sql import functions as F

    def rule(i: int, h: str) -> tuple:
        return i, [table_to_gfm(t) for t in select(parse(h or ""), "table")]

    made = mapped(pages, ["page_id", "html"], "page_id long, tables array<string>", [pa.int64(), pa.list_(pa.string())], rule)
    return made.select("page_id", F.posexplode("tables").alias("table", "gfm"))


def content_images(pages: DataFrame, selector: str = "div.mdx-content img") -> DataFrame:
    """(page_id, srcs): sources of images within the content area, without inline data."""

    def rule(i: int, h: str) -> tuple:
        return i, [n.attrs["src"] for n in select(parse(h or ""), selector) if n.attrs.get("src") and not n.attrs["src"].startswith("data:")]

    return mapped(pages, ["page_id", "html"], "page_id long, srcs array<string>", [pa.int64(), pa.list_(pa.string())], rule)


def sidebar_tree(html: str, selector: str = "nav") -> list[dict]:
    """A menu's sections and pages from its HTML: sections are headings with lists, external links keep their address."""

    def items(node: Node) -> list:
        out = []
        for li in (c for c in node.children if isinstance(c, Node) and c.tag == "li"):
            link = next((n for n in li.walk() if n.tag == "a" and n.attrs.get("href")), None)
            sub = next((n for n in li.walk() if n.tag in ("ul", "ol")), None)
            if sub is not None:
                first = next((n for n in li.walk() if n.tag not in ("ul", "ol", "li") and n.text().strip()), None)
                out.append({"group": (first.text() if first is not None else "").strip(), "pages": items(sub)})
            elif link is not None:
                href = link.attrs["href"]
                out.append(href if re.match("https?://", href) else href.removeprefix("/"))
        return out

    found = select(parse(html), selector)
    lists = [n for n in found[0].walk() if n.tag in ("ul", "ol")] if found else []
    return items(lists[0]) if lists else []
