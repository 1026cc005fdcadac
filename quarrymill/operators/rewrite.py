"""Rewriting markdown documents: each rule is a function from text to text and a count, run over Arrow batches; what plain expressions can say stays in expressions.

Nothing is changed in place: results are new rows, and ``changed`` says which differ.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from . import edits
from .edits import spliced
from .mdx_links import blanked

#: Tags without content, and components that need no import.
VOID_TAGS = "area base br col embed hr img input link meta source track wbr".split()
BUILT_IN = set("Heading Note Warning Info Tip Danger Callout Card CardGroup CardBody Tabs Tab Steps Step Accordion AccordionGroup Frame Tooltip Check CodeGroup CodeBlock Icon Update ResponseField Expandable ParamField RequestExample ResponseExample Columns Badge".split())
VOID = rf"<(?:{'|'.join(VOID_TAGS)})(?:\s[^>]*)?>"
MD_IMAGE, HTML_IMAGE = r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)", r"""(?i)<img[^>]+src=["']([^"']+)["']"""
INLINE_IMPORT = 'import { InlineImage } from "/snippets/InlineImage.jsx";'

CODE = re.compile(r"`[^`]+`")
REGION = {
    "frame": r"(?is:<Frame(?:\s[^>]*)?>.*?</Frame>)",
    "table": r"(?is:<table(?:\s[^>]*)?>.*?</table>)",
    "pipes": r"(?m:^(?:\|[^\n]*\n)+(?:\|[^\n]*)?)",
}
IMAGE_MD, IMAGE_HTML = re.compile(r"!\[([^\]\n]*)\]\(([^)\n]+)\)"), re.compile(r"<img\b([^>\n]*?)\s*/?>", re.I)


def fences(text: str) -> Iterator[tuple[int, int]]:
    """Where fenced blocks lie: from a line of three or more backticks or tildes to one at least as long of the same kind, or the end."""
    at, opened = 0, None
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        mark = re.match(r"`{3,}|~{3,}", bare)
        if opened is None:
            if mark:
                opened = at, mark[0]
        elif mark and bare == mark[0] and mark[0][0] == opened[1][0] and len(mark[0]) >= len(opened[1]):
            yield opened[0], at + len(line.rstrip("\n"))
            opened = None
        at += len(line)
    if opened:
        yield opened[0], at


def spared(text: str, spans: Iterable[tuple[int, int]], rule: Callable[[str], tuple[str, int]]) -> tuple[str, int]:
    """Apply ``rule`` to what lies between the spans; overlapping spans count as one."""
    out, at, total = [], 0, 0
    for a, b in sorted(spans):
        if b <= at:
            continue
        if a > at:
            part, n = rule(text[at:a])
            out.append(part)
            total += n
        out.append(text[max(a, at) : b])
        at = b
    part, n = rule(text[at:])
    return "".join([*out, part]), total + n


def segments(text: str) -> list[tuple[str, bool]]:
    """The text in order as (part, protected)."""
    out, at = [], 0
    for a, b in fences(text):
        if a > at:
            out.append((text[at:a], False))
        out.append((text[a:b], True))
        at = b
    if at < len(text):
        out.append((text[at:], False))
    return out


def void_tags(text: str) -> tuple[str, int]:
    """Close tags without content, but for inline code."""
    n = 0

    def close(m: re.Match) -> str:
        nonlocal n
        if m[0].rstrip().endswith("/>"):
            return m[0]
        n += 1
        return f"{m[0][:-1].rstrip()} />"

    return spared(text, (m.span() for m in CODE.finditer(text)), lambda t: (re.sub(VOID, close, t), 0))[0], n


TAG = re.compile(r"`[^`]+`|</[a-zA-Z][a-zA-Z0-9]*\s*>|<[a-zA-Z][a-zA-Z0-9]*(?:\s[^>]*)?\s*/?>|<!--[\s\S]*?-->|<[^>]*>")


def angle_brackets(text: str) -> tuple[str, int]:
    """Escape angle brackets in running text: ``<`` that begins no tag, ``>`` that neither quotes a line nor ends something tag-like."""

    def rule(part: str) -> tuple[str, int]:
        part, n = re.subn(r"<(?![a-zA-Z/!])", "&lt;", part)
        out = []
        for i, c in enumerate(part):
            if c == ">":
                head = part[part.rfind("\n", 0, i) + 1 : i].lstrip()
                near, two, after = part[i - 1 : i] if i else "", part[max(0, i - 2) : i], part[i + 1 : i + 2]
                quote = not head.strip(">")
                word = bool(re.match(r"[a-zA-Z0-9\"'/-]", near))
                if not quote and (not word or (two[:1].isspace() and re.match(r"[\s\w]", after))):
                    out.append("&gt;")
                    n += 1
                    continue
            out.append(c)
        return "".join(out), n

    return spared(text, (m.span() for m in TAG.finditer(text)), rule)


def parse_fixes(text: str) -> tuple[str, int]:
    """Void tags, then stray angle brackets, outside fences."""

    def rule(part: str) -> tuple[str, int]:
        part, a = void_tags(part)
        part, b = angle_brackets(part)
        return part, a + b

    return spared(text, fences(text), rule)


def flags(tokens: list[str], lines: int, threshold: int = 15, expandable: bool = True, add: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> list[str]:
    """Tokens of a fence: ``expandable`` above ``threshold`` lines and not below (at it, as it was); others added or dropped."""
    out = list(tokens)
    if expandable and lines < threshold:
        out = [t for t in out if t != "expandable"]
    elif expandable and lines > threshold and "expandable" not in out:
        out.append("expandable")
    out += [t for t in add if t not in out]
    return [t for t in out if t not in drop or t in add]


def fence_flags(text: str, **options) -> tuple[str, int]:
    """Set the flags of every backtick fence; one that isn't closed is edited too."""
    lines, out, i, n = text.splitlines(keepends=True), [], 0, 0
    while i < len(lines):
        body = lines[i].rstrip("\r\n")
        m = re.fullmatch(r"([ \t]*)(`{3,})(.*)", body)
        if not m:
            out.append(lines[i])
            i += 1
            continue
        j = i + 1
        while j < len(lines) and not ((c := re.fullmatch(r"[ \t]*(`{3,})[ \t]*", lines[j].rstrip("\r\n"))) and len(c[1]) >= len(m[2])):
            j += 1
        old = m[3].split()
        new = flags(old, j - i - 1, **options)
        n += len(set(old) ^ set(new))
        out += [m[1] + m[2] + " ".join(new) + lines[i][len(body) :], *lines[i + 1 : j + 1]]
        i = j + 1
    return "".join(out), n


fence_flags_default = partial(fence_flags, threshold=15)


def kept_regions(text: str) -> list[tuple[int, int]]:
    """Frames, tables and fences, which image rules leave alone."""
    return [*fences(text), *(m.span() for p in REGION.values() for m in re.finditer(p, text))]


def frame_images(text: str) -> tuple[str, int]:
    """Put a frame around images that have a line of their own."""
    alone = re.compile(r"^([ \t]*)(!\[[^\]\n]*\]\([^)\n]+\)|<img\b[^>\n]*/?>)[ \t]*$", re.M)
    return spared(text, kept_regions(text), lambda t: alone.subn(r"\1<Frame>\n\1\2\n\1</Frame>", t))


def inline_tag(attributes: str) -> str:
    return f"<InlineImage{attributes.rstrip().rstrip('/').rstrip()} />"


def inline_images(text: str) -> tuple[str, int]:
    """Images that share a line with text become inline components, and the component is imported once."""
    n = 0
    frame = re.compile(r"<Frame(?:\s[^>]*)?><img\b([^>]*?)\s*/?></Frame>", re.I)

    def unframe(line: str) -> str:
        nonlocal n
        if re.search("<Frame", line, re.I) and re.sub(r"(?i)<Frame(?:\s[^>]*)?>.*?</Frame>", "", line).strip():

            def one(m: re.Match) -> str:
                nonlocal n
                if "src" not in m[1]:
                    return m[0]
                n += 1
                return inline_tag(m[1])

            return frame.sub(one, line)
        return line

    text = "\n".join(map(unframe, text.split("\n")))

    def markdown(m: re.Match) -> str:
        alt = f' alt="{m[1].strip()}"' if m[1].strip() else ""
        return f'<InlineImage src="{m[2]}"{alt} />'

    def line_rule(line: str) -> tuple[str, int]:
        bare = CODE.sub("x", line)
        if not (IMAGE_MD.search(CODE.sub("", line)) or IMAGE_HTML.search(CODE.sub("", line))) or not IMAGE_HTML.sub("", IMAGE_MD.sub("", bare)).strip():
            return line, 0

        def rule(part: str) -> tuple[str, int]:
            part, a = re.subn(r"(?<!\[)!\[([^\]\n]*)\]\(([^)\n]+)\)", markdown, part)
            b = sum("src" in m[1] for m in IMAGE_HTML.finditer(part))
            return IMAGE_HTML.sub(lambda m: inline_tag(m[1]) if "src" in m[1] else m[0], part), a + b

        return spared(line, (m.span() for m in CODE.finditer(line)), rule)

    def block(part: str) -> tuple[str, int]:
        done = [line_rule(x) for x in part.split("\n")]
        return "\n".join(d[0] for d in done), sum(d[1] for d in done)

    text, more = spared(text, kept_regions(text), block)
    n += more
    return (with_import(text, INLINE_IMPORT) if n else text), n


FRONT = re.compile(r"---\r?\n[\s\S]*?\r?\n---\r?\n?")


def with_import(text: str, line: str) -> str:
    """``text`` with an import line after the front matter, or at the top; as it is if it has the line."""
    if line in text:
        return text
    m = FRONT.match(text)
    return f"{text[: m.end()]}\n{line}\n\n{text[m.end() :].lstrip(chr(10))}" if m else f"{line}\n\n{text}"


def components(text: str) -> set[str]:
    """Names of components used outside code and comments."""
    bare = "".join(p for p, kept in segments(text) if not kept)
    bare = re.sub(r"`[^`\n]+`|\{/\*[\s\S]*?\*/\}|<!--[\s\S]*?-->", "", bare)
    return set(re.findall(r"</?([A-Z][a-zA-Z0-9]*)\b", bare))


def imported(text: str) -> dict[str, str]:
    """Path of each name that is imported outside fences: default, named and renamed."""
    bare, out = "".join(p for p, kept in segments(text) if not kept), {}
    for clause, path in re.findall(r"""^import\s+([\s\S]+?)\s+from\s+['"]([^'"]+)['"]""", bare, re.M):
        for group in re.findall(r"\{([^}]+)\}", clause):
            out |= {re.split(r"\s+as\s+", x.strip())[-1].strip(): path for x in group.split(",") if x.strip()}
        head = re.split(r"[,{]", clause.strip())[0].strip()
        if re.fullmatch(r"[a-zA-Z_$][\w$]*", head):
            out[head] = path
    return out


def insert_imports(text: str, lines: list[str]) -> str:
    """Import lines after the last import of the head, else after the front matter and a blank line, else at the top."""
    if not lines:
        return text
    m = re.match(r"---\r?\n[\s\S]*?\r?\n---\r?\n", text)
    start = m.end() if m else 0
    rest = text[start:].split("\n")
    last, at, fenced = -1, 0, None
    while at < len(rest):
        row = rest[at]
        if mark := re.match(r"[ \t]*(`{3,}|~{3,})", row):
            fenced = mark[1] if fenced is None else None if row.strip().startswith(fenced) else fenced
        elif fenced is None:
            if re.match(r"import\s", row):
                while at < len(rest) and not re.search(r"""from\s+['"]""", rest[at]):
                    at += 1
                last = min(at, len(rest) - 1)
            elif last >= 0 and row.strip():
                break
        at += 1
    if last >= 0:
        rest[last + 1 : last + 1] = lines
    else:
        rest[:0] = ["", *lines] if m else lines
    return text[:start] + "\n".join(rest)


def import_line(name: str, path: str) -> str:
    return f'import {name} from "{path}";' if path.endswith(".mdx") else f'import {{ {name} }} from "{path}";'


SAMPLE_TABS = '\n<Tabs>\n<Tab title="Node">\n```js\nrun()\n```\n</Tab>\n<Tab title="Py">\n```python\nrun()\n```\n</Tab>\n</Tabs>\n'
TAB = re.compile(r'<Tab title="([^"]+)">\n([\s\S]*?)\n</Tab>')
ONE_FENCE = re.compile(r"```(\S*)\n([\s\S]*?)\n```")


def tabs_to_code_group(text: str) -> tuple[str, int]:
    """Tabs of which each holds one fence and nothing else become a code group."""
    n = 0

    def block(m: re.Match) -> str:
        nonlocal n
        tabs = TAB.findall(m[1])
        parts = [ONE_FENCE.fullmatch(body.strip()) for _, body in tabs]
        rest = TAB.sub("", m[1])
        if not tabs or rest.strip() or not all(parts):
            return m[0]
        n += 1
        inner = [f"```{p[1]} {title}\n{p[2]}\n```" for (title, _), p in zip(tabs, parts, strict=True)]
        return "\n".join(["<CodeGroup>", *inner, "</CodeGroup>"])

    return re.sub(r"<Tabs>\n([\s\S]*?)\n</Tabs>", block, text), n


def meta_upsert(text: str, values: dict[str, str]) -> tuple[str, list[str], list[str]]:
    """Front matter with the values set: keys there already are rewritten in place, others added. Text without front matter is left."""
    m = re.match(r"---\r?\n([\s\S]*?)\r?\n---\r?\n?", text)
    if not m:
        return text, [], []
    lines, updated, added = m[1].split("\n"), [], []
    for key, value in values.items():
        quote = f'"{value}"' if '"' not in value else f"'{value}'" if "'" not in value else '"' + value.replace('"', '\\"') + '"'
        row = f'"{key}": {quote}' if ":" in key else f"{key}: {quote}"
        at = next((i for i, x in enumerate(lines) if re.match(rf"""(?:{re.escape(key)}|"{re.escape(key)}"|'{re.escape(key)}')\s*:""", x)), None)
        if at is None:
            lines.append(row)
            added.append(key)
        else:
            lines[at] = row
            updated.append(key)
    return "---\n" + "\n".join(lines) + "\n---\n" + text[m.end() :], updated, added


def lint_errors(text: str) -> list[str]:
    """What a structural reading of the markup finds wrong: void tags left open, tags closed out of order or never, braces without a partner. An approximation of a compiler."""
    bare = "".join(p for p, kept in segments(FRONT.sub("", text, count=1)) if not kept)
    bare = re.sub(r"`[^`\n]+`|\{/\*[\s\S]*?\*/\}", "", bare)
    found, stack = [], []
    for m in re.finditer(r"<(/?)([A-Za-z][\w.-]*)((?:\s[^<>]*?)?)(/?)>", bare):
        closing, name, _, alone = m.groups()
        if name.lower() in VOID_TAGS:
            if not alone:
                found.append(f"<{name}> must be self-closing")
        elif closing:
            if stack and stack[-1] == name:
                stack.pop()
            else:
                found.append(f"unexpected </{name}>")
        elif not alone:
            stack.append(name)
    found += [f"<{name}> is never closed" for name in stack]
    depth = 0
    for c in bare:
        depth += (c == "{") - (c == "}")
        if depth < 0:
            break
    if depth:
        found.append("braces don't match")
    if re.search(r"<(?![a-zA-Z/!])", bare):
        found.append("stray <")
    return found


# --- over DataFrames --------------------------------------------------------------------------


#: Documents that are held as Python objects at a time.
SLICE = 64


def mapped(docs: DataFrame, columns: list[str], schema: str, kinds: list[pa.DataType], rule: Callable[..., tuple]) -> DataFrame:
    """``rule`` of each row's columns, over Arrow batches, a few documents at a time; null texts are read as empty."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            rows = [rule(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

    return docs.select(*columns).mapInArrow(run, schema)


def apply(docs: DataFrame, rule: Callable[[str], tuple[str, int]]) -> DataFrame:
    """(path, content, changes) after ``rule``."""
    return mapped(docs, ["path", "content"], "path string, content string, changes long", [pa.string(), pa.string(), pa.int64()], lambda p, t: (p, *rule(t or "")))


#: A target in a document: what stands between a quote or bracket and an end, with its fragment.
TARGET = r"""["'(][^()"'#\s]*(?:#[^()"'\s]*)?(?=[)"'#\s])"""


def resolved_targets(targets: DataFrame, table: DataFrame) -> DataFrame:
    """(target, final, hops) of the targets (target) that redirects (ord, source, destination) lead on.

    A redirect takes a target with its fragment, or without, which then stays. Redirects apply in order, each once, so a chain goes on only to a
    later one; of two with one source the first counts. Every round joins the targets that still move, and there are as many as the longest chain has links.
    """
    rules = cut(table.filter("source is not null and source <> '' and destination is not null").select("ord", "source", "destination"))
    moving, rounds = targets.select("target", F.col("target").alias("now"), F.lit(None).cast("long").alias("last")).distinct(), []
    while True:
        head = F.substring_index("now", "#", 1)
        keys = F.array_distinct(F.array("now", head))
        each = moving.select("target", "now", "last", F.explode(keys).alias("source")).join(rules, "source").filter("last is null or ord > last")
        tail = F.when(F.col("source") == F.col("now"), "").otherwise(F.expr("substring(now, length(source) + 1)"))
        # By its whole before its head, should one redirect be given twice.
        step = each.groupBy("target").agg(F.min(F.struct("ord", F.length(tail), F.concat("destination", tail).alias("now"))).alias("s"))
        moving = cut(step.select("target", "s.now", F.col("s.ord").cast("long").alias("last")))
        if moving.isEmpty():
            break
        rounds.append(moving.select("target", "now", F.lit(len(rounds) + 1).cast("long").alias("hops")))
    found = reduce(DataFrame.unionByName, rounds, targets.select("target", F.lit("").alias("now"), F.lit(0).cast("long").alias("hops")).limit(0))
    return found.groupBy("target").agg(F.max_by("now", "hops").alias("final"), F.max("hops").alias("hops"))


def redirects_from(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(path, content, replacements) of documents (path, content) whose targets are led on by redirects (ord, source, destination), a table of any size.

    Sources with quotes, brackets, blanks or a second ``#`` stand in no target and are never met. Null content stays null.
    """
    found = edits.matches(docs, TARGET).select("path", (F.col("start") + 1).alias("start"), "end", F.expr("substring(found, 2)").alias("target")).filter("target <> ''")
    final = resolved_targets(found.select("target").distinct(), table)
    moved = cut(found.join(final, "target").select("path", "start", "end", F.col("final").alias("put"), "hops"))
    counts = moved.groupBy("path").agg(F.sum("hops").alias("replacements"))
    done = edits.apply(docs, moved.select("path", "start", "end", "put"))
    return done.join(counts, "path", "left").select("path", "content", F.coalesce("replacements", F.lit(0)).cast("long").alias("replacements"))


def redirects(docs: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``redirects_from`` of a list of (source, destination), in its order."""
    return redirects_from(docs, docs.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "ord long, source string, destination string"))


def duplicate_h1(docs: DataFrame) -> DataFrame:
    """(path, content, changed): a first heading that repeats the title goes, with the blank line after it."""
    shape = r"(?s)^(---\n.*?\n---\n)(\s*)# ([^\n]+)\n\n?(.*)$"
    title = F.regexp_extract("content", r'(?m)^title: "([^"]*)"', 1)
    hit = F.col("content").rlike(shape) & (F.trim(F.regexp_extract("content", shape, 3)) == title)
    return docs.select("path", F.when(hit, F.regexp_replace("content", shape, "$1$2$4")).otherwise(F.col("content")).alias("content"), hit.alias("changed"))


def void_tag_counts(docs: DataFrame) -> DataFrame:
    bare = F.regexp_replace(blanked(F.col("content"), True), "`[^`]+`", "")
    return docs.select("path", F.size(F.filter(F.regexp_extract_all(bare, F.lit(VOID), 0), lambda x: ~x.endswith("/>"))).cast("long").alias("void_tags"))


def image_srcs(docs: DataFrame) -> DataFrame:
    found = F.concat(F.regexp_extract_all("content", F.lit(MD_IMAGE), 1), F.regexp_extract_all("content", F.lit(HTML_IMAGE), 1))
    return docs.select(F.explode(found).alias("src")).distinct()


def anchor_edits(content: str, todo: list[dict]) -> list[tuple[int, int, str, str]]:
    """(start, end, put, label) for failed links (line, kind, href, new_anchor): of several on one line with one target each takes the next occurrence."""
    starts = [0, *(m.end() for m in re.finditer("\n", content))]
    ends = [*(s - 1 for s in starts[1:]), len(content)]
    out, searched = [], {}
    for f in todo:
        i, new = f["line"] - 1, f"{f['href'].split('#')[0]}#{f['new_anchor']}"
        quoted = [('href="', '"'), ("href='", "'")]
        for before, after in {"markdown": [("(", ")")], "html": quoted, "jsx": quoted}.get(f["kind"], [("(", ")"), *quoted]):
            if not 0 <= i < len(starts) or new == f["href"]:
                continue
            old = f"{before}{f['href']}{after}"
            at = content.find(old, searched.get((i, old), starts[i]), ends[i])
            if at >= 0:
                searched[i, old] = at + len(old)
                out.append((at, at + len(old), f"{before}{new}{after}", f"{f['line']}:{new}"))
                break
    return out


def anchors(docs: DataFrame, failures: DataFrame) -> DataFrame:
    """(path, fixes, changed, content) from failed links (path, line, href, new_anchor, and kind if it is known): targets are rewritten on their lines, first occurrence each, all of a document's in one pass."""
    kind = F.col("kind") if "kind" in failures.columns else F.lit(None).cast("string")
    todo = failures.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "href", "new_anchor", kind.alias("kind")))).alias("todo"))

    def rule(path: str, content: str, todo: list[dict]) -> tuple:
        made = anchor_edits(content or "", todo)
        return path, len(made), " ".join(m[3] for m in made), spliced(content or "", [m[:3] for m in made])[0]

    return mapped(docs.join(todo, "path"), ["path", "content", "todo"], "path string, fixes long, changed string, content string", [pa.string(), pa.int64(), pa.string(), pa.string()], rule)


def missing_imports(docs: DataFrame, snippets: DataFrame) -> DataFrame:
    """(path, content, added, unresolved): components used but neither built in nor imported are imported from the snippet of that name, in Pascal, kebab or lower case."""
    used = mapped(docs, ["path", "content"], "path string, names array<string>", [pa.string(), pa.list_(pa.string())], lambda p, t: (p, sorted(components(t or "") - BUILT_IN - set(imported(t or "")))))
    each = used.select("path", F.explode("names").alias("name"))
    kebab = F.lower(F.regexp_replace("name", "(?<!^)([A-Z])", "-$1"))
    variants = each.select("path", "name", F.explode(F.array_distinct(F.array("name", kebab, F.lower("name")))).alias("_key"))
    named = snippets.select(F.regexp_extract("path", r"([^/]+)\.(?:mdx|jsx|tsx|js|ts)$", 1).alias("_key"), F.col("path").alias("snippet"))
    best = variants.join(named, "_key").groupBy("path", "name").agg(F.min("snippet").alias("snippet"))
    found = each.join(best, ["path", "name"], "left").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("name", "snippet"))).alias("found"))

    def rule(path: str, content: str, found: list[dict] | None) -> tuple:
        hits = [(f["name"], f["snippet"]) for f in found or []]
        return path, insert_imports(content or "", [import_line(n, s) for n, s in hits if s]), [n for n, s in hits if s], [n for n, s in hits if not s]

    return mapped(docs.join(found, "path", "left"), ["path", "content", "found"], "path string, content string, added array<string>, unresolved array<string>", [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())], rule)


def upsert_meta(docs: DataFrame) -> DataFrame:
    """(path, content, updated, added) from (path, content, meta map)."""
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
    return mapped(docs, ["path", "content", "meta"], "path string, content string, updated array<string>, added array<string>", kinds, lambda p, t, m: (p, *meta_upsert(t or "", dict(m or []))))


def lint(docs: DataFrame) -> DataFrame:
    """(path, status, errors)."""

    def rule(path: str, text: str) -> tuple:
        found = lint_errors(text or "")
        return path, "error" if found else "valid", found

    return mapped(docs, ["path", "content"], "path string, status string, errors array<string>", [pa.string(), pa.string(), pa.list_(pa.string())], rule)
