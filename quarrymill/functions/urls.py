"""URL expressions. Both engines' forms stand side by side so that each rule is stated once."""

from __future__ import annotations

from pyspark.sql import functions as F

from .dual import Dual, both, first, named, quoted, replaced, test
from .patterns import NON_DOC_EXTENSIONS, NON_DOC_PATHS


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def lower(x: Dual) -> Dual:
    return Dual(lambda: F.lower(x.column), f"lower({x.sql})")


def concat(*parts: Dual) -> Dual:
    return Dual(lambda: F.concat(*[p.column for p in parts]), "(" + " || ".join(p.sql for p in parts) + ")")


def host(url: str = "url") -> Dual:
    """The host, lower-cased, without a port."""
    return replaced(lower(first(HOST, 1, url)), r":[0-9]*$", "")


def origin(url: str = "url") -> Dual:
    """Scheme and host as a URL object has them: lower case, default ports dropped; what isn't a web URL is returned as it is."""
    whole = lower(first(r"^([Hh][Tt][Tt][Pp][Ss]?://[^/?#]+)", 1, url))
    bare = replaced(replaced(whole, r"^(http://[^:]*):80$", r"$1"), r"^(https://[^:]*):443$", r"$1")
    sql = f"regexp_replace(regexp_replace({whole.sql}, '^(http://[^:]*):80$', '\\1'), '^(https://[^:]*):443$', '\\1')"
    return Dual(lambda: F.when(bare.column != "", bare.column).otherwise(F.col(url)), f"CASE WHEN {sql} <> '' THEN {sql} ELSE {url} END")


def path(url: str = "url") -> Dual:
    found = first(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1, url)
    return Dual(lambda: F.when(found.column == "", "/").otherwise(found.column), f"CASE WHEN {found.sql} = '' THEN '/' ELSE {found.sql} END")


def normalized(url: str = "url") -> Dual:
    """For finding pages twice: lower-case path without index.html, .html, query, fragment and doubled or final slashes."""
    p = lower(path(url))
    p = replaced(replaced(replaced(p, r"/index\.html$", ""), r"\.html$", ""), "/+", "/")
    p = replaced(p, r"^/?", "/")
    whole = concat(origin(url), p)
    short = replaced(whole, "/$", "")
    is_web = test(r"(?i)^https?://[^/?#]+", url)
    column = lambda: F.when(~is_web.column, F.col(url)).when(F.length(p.column) > 1, short.column).otherwise(whole.column)
    return Dual(column, f"CASE WHEN NOT {is_web.sql} THEN {url} WHEN length({p.sql}) > 1 THEN {short.sql} ELSE {whole.sql} END")


def link_normalized(url: str) -> Dual:
    """For link targets, another rule: one final /index.mdx or else /index goes, then all final slashes."""
    return replaced(replaced(named(url), r"/index(?:\.mdx)?$", ""), r"/+$", "")


def is_non_doc(url: str = "url") -> Dual:
    """Whether path or extension never lead to documentation."""
    p = lower(path(url))
    pattern = "|".join([*NON_DOC_PATHS, NON_DOC_EXTENSIONS])
    return Dual(lambda: p.column.rlike(pattern), f"regexp_matches({p.sql}, {quoted(pattern)})")


def scope_prefix(url: str = "url") -> Dual:
    p = replaced(replaced(path(url), "/+", "/"), "/+$", "")
    return concat(origin(url), p)


def label(url: str = "url") -> Dual:
    """The host if it has more than two labels, else without its last."""
    h = host(url)
    cut = replaced(h, r"\.[^.]*$", "")
    many = f"length({h.sql}) - length(replace({h.sql}, '.', '')) >= 2"
    column = lambda: F.when(F.length(h.column) - F.length(F.replace(h.column, F.lit("."), F.lit(""))) >= 2, h.column).otherwise(cut.column)
    return Dual(column, f"CASE WHEN {many} THEN {h.sql} ELSE {cut.sql} END")


def project_name(url: str = "url") -> Dual:
    """The host less its last label if it has more than two, else its first; ``project`` where there is none."""
    h = host(url)
    cut, head = replaced(h, r"\.[^.]*$", ""), replaced(h, r"\..*$", "")
    dots = lambda: F.length(h.column) - F.length(F.replace(h.column, F.lit("."), F.lit("")))
    column = lambda: F.when(h.column == "", "project").when(dots() >= 2, cut.column).otherwise(head.column)
    many = f"length({h.sql}) - length(replace({h.sql}, '.', '')) >= 2"
    return Dual(column, f"CASE WHEN {h.sql} = '' THEN 'project' WHEN {many} THEN {cut.sql} ELSE {head.sql} END")


def page_slug(url: str = "url") -> Dual:
    """Where a converted page is stored: the path without slashes at its ends, ``index`` for the root."""
    p = replaced(replaced(path(url), "^/+", ""), "/+$", "")
    return Dual(lambda: F.when(p.column == "", "index").otherwise(p.column), f"CASE WHEN {p.sql} = '' THEN 'index' ELSE {p.sql} END")


def is_external(href: str) -> Dual:
    return test("^https?://", href)


def is_anchor(href: str) -> Dual:
    return test("^#", href)


def image_url(src: str, page: str) -> Dual:
    """An image's address as checked: absolute, protocol-relative, from the root, or appended to the page's own."""
    root = origin(page)
    tail = replaced(named(page), "/+$", "")
    column = lambda: F.when(F.col(src).rlike("^https?://"), F.col(src)).when(F.col(src).startswith("//"), F.concat(F.lit("https:"), src)).when(F.col(src).startswith("/"), F.concat(root.column, F.col(src))).otherwise(F.concat(tail.column, F.lit("/"), F.col(src)))
    sql = f"CASE WHEN regexp_matches({src}, '^https?://') THEN {src} WHEN starts_with({src}, '//') THEN 'https:' || {src} WHEN starts_with({src}, '/') THEN {root.sql} || {src} ELSE {tail.sql} || '/' || {src} END"
    return Dual(column, sql)


def without_dots(p: Dual) -> Dual:
    """A path from the root without ``.`` and ``..`` parts: a fold over its parts; what would rise above the root stays there."""

    def column():
        parts = F.split(p.column, "/", -1)
        last = F.element_at(parts, -1)
        step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
        folded = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), step)
        return F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded), "/"))

    parts = f"string_split({p.sql}, '/')"
    folded = f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({parts}[2:], lambda s: [s])), lambda a, x: CASE WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 0)] WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END)"
    return Dual(column, f"('/' || array_to_string(CASE WHEN {parts}[-1] IN ('.', '..') THEN list_append({folded}, '') ELSE {folded} END, '/'))")


SCHEME, AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.-]*:)", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"


def resolved(href: str, page: str) -> Dual:
    """A link's target as its page's address gives it: absolute, by scheme, from the root, below the page's folder, its query or fragment; dot parts are removed."""
    h = named(href)
    raw = first(AUTHORITY + r"([^?#]*)", 1, page)  # the page's path as it is written
    page_path = Dual(lambda: F.when(raw.column == "", "/").otherwise(raw.column), f"CASE WHEN {raw.sql} = '' THEN '/' ELSE {raw.sql} END")
    folder, tail = replaced(page_path, "[^/]*$", ""), first(r"([?#].*)$", 1, href)
    own = replaced(h, r"[?#].*$", "")
    top = first(AUTHORITY, 0, page)
    query = first(r"^[^?#]*([?][^#]*)", 1, page)
    scheme = first(SCHEME, 1, page)
    under = lambda base: concat(top, without_dots(base), tail)
    web = first(AUTHORITY, 0, href)
    web_path = first(AUTHORITY + r"([^?#]*)", 1, href)
    absolute = Dual(lambda: F.when(web_path.column == "", F.concat(web.column, F.lit("/"), tail.column)).otherwise(F.concat(web.column, without_dots(web_path).column, tail.column)), f"CASE WHEN {web_path.sql} = '' THEN {web.sql} || '/' || {tail.sql} ELSE {web.sql} || {without_dots(web_path).sql} || {tail.sql} END")
    rows = [
        (test(r"(?i)^https?://", href), absolute), (test(SCHEME, href), h), (test("^//", href), concat(scheme, h)), (test("^/", href), under(own)), (test("^#", href), concat(top, page_path, query, h)),
        (test(r"^\?", href), concat(top, page_path, h)), (Dual(lambda: F.col(href) == "", f"{href} = ''"), concat(top, page_path, query)), (both("TRUE"), under(concat(folder, own))),
    ]
    column = lambda: F.coalesce(*[F.when(when.column, then.column) for when, then in rows])
    return Dual(column, "CASE " + " ".join(f"WHEN {when.sql} THEN {then.sql}" for when, then in rows) + " END")
