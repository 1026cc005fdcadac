"""Rewriting rules on single texts: what they change, what they leave, and that a second pass changes nothing."""

import pytest

from quarrymill.operators import convert as C
from quarrymill.operators import dialects as D
from quarrymill.operators import rewrite as R
from quarrymill.operators.html_tree import parse, select


def test_segments_give_the_text_back():
    for text in ("plain", "a\n```js\nx\n```\nb", "~~~\nx\n```\n~~~\n", "```\nnever closed", "````\n```\n````\nafter"):
        parts = R.segments(text)
        assert "".join(p for p, _ in parts) == text
    assert [k for _, k in R.segments("a\n```\nx\n```\nb")] == [False, True, False]


@pytest.mark.parametrize(
    ("text", "want", "n"),
    [("a<br>b", "a<br />b", 1), ("<hr/>", "<hr/>", 0), ('<img src="x">', '<img src="x" />', 1), ("`<br>`", "`<br>`", 0), ("<br><br>", "<br /><br />", 2), ("<broken>", "<broken>", 0)],
)
def test_void_tags(text, want, n):
    assert R.void_tags(text) == (want, n)


@pytest.mark.parametrize(
    ("text", "want", "n"),
    [("3 < 10", "3 &lt; 10", 1), ("> quote", "> quote", 0), ("<b>x</b>", "<b>x</b>", 0), ("a => b", "a =&gt; b", 1), ("x > y", "x &gt; y", 1), ("`a < b`", "`a < b`", 0), ("<!-- < -->", "<!-- < -->", 0)],
)
def test_angle_brackets(text, want, n):
    assert R.angle_brackets(text) == (want, n)


def test_fence_flags():
    long, short = "```js\n" + "x\n" * 16 + "```\n", "```js expandable\nx\n```\n"
    assert R.fence_flags(long) == (long.replace("```js", "```js expandable"), 1)
    assert R.fence_flags(short) == ("```js\nx\n```\n", 1)
    same = "```js\n" + "x\n" * 15 + "```\n"
    assert R.fence_flags(same) == (same, 0)
    assert R.fence_flags(long, expandable=False) == (long, 0)
    assert R.fence_flags(short, add=("lines",), expandable=False)[0].startswith("```js expandable lines\n")
    assert R.fence_flags("```js lines wrap\nx\n```", drop=("lines",))[0] == "```js wrap\nx\n```"
    assert R.fence_flags("```js\n" + "x\n" * 20)[0].startswith("```js expandable")


def test_images():
    text = "![a](x.png)\n\ntext ![b](y.png) more\n\n<Frame>\n![c](z.png)\n</Frame>\n\n```\n![d](w.png)\n```\n| ![e](v.png) |\n"
    framed, n = R.frame_images(text)
    assert n == 1 and framed.startswith("<Frame>\n![a](x.png)\n</Frame>\n") and R.frame_images(framed) == (framed, 0)
    inline, n = R.inline_images(text)
    assert n == 1 and '<InlineImage src="y.png" alt="b" />' in inline and inline.startswith(R.INLINE_IMPORT) and "![d](w.png)" in inline and "![e](v.png)" in inline
    assert R.inline_images(inline) == (inline, 0)
    assert R.inline_images("see [![l](a.png)](b) here")[1] == 0
    assert R.inline_images('t <img src="a.png" width="3"> u')[0].endswith('t <InlineImage src="a.png" width="3" /> u')
    assert R.inline_images("x <Frame><img src='q'/></Frame> y")[1] == 1


def test_imports():
    text = "---\ntitle: x\n---\n\nimport A from '/a.mdx'\nimport { B, C as D } from \"/b.jsx\"\n\n<A/> <D/> <Chart/> <Note/>\n```\n<Hidden/>\n```\n`<Code/>` {/* <No/> */}\n"
    assert R.components(text) == {"A", "D", "Chart", "Note"}
    assert R.imported(text) == {"A": "/a.mdx", "B": "/b.jsx", "D": "/b.jsx"}
    assert R.insert_imports(text, ["import X"]).split("\n")[5:8] == ['import { B, C as D } from "/b.jsx"', "import X", ""]
    assert R.insert_imports("---\na: b\n---\nx", ["import X"]) == "---\na: b\n---\n\nimport X\nx"
    assert R.insert_imports("x", ["import X"]) == "import X\nx"
    assert R.import_line("A", "/s/a.mdx") == 'import A from "/s/a.mdx";' and R.import_line("A", "/s/a.jsx") == 'import { A } from "/s/a.jsx";'


def test_tabs():
    assert R.tabs_to_code_group(R.SAMPLE_TABS) == ("\n<CodeGroup>\n```js Node\nrun()\n```\n```python Py\nrun()\n```\n</CodeGroup>\n", 1)
    mixed = R.SAMPLE_TABS.replace("```python\nrun()\n```", "words")
    assert R.tabs_to_code_group(mixed) == (mixed, 0)


def test_meta():
    text = '---\ntitle: x\n"og:title": "old"\n---\nbody'
    new, updated, added = R.meta_upsert(text, {"og:title": 'A "b"', "lang": "de"})
    assert new == "---\ntitle: x\n\"og:title\": 'A \"b\"'\nlang: \"de\"\n---\nbody" and (updated, added) == (["og:title"], ["lang"])
    assert R.meta_upsert(new, {"lang": "de"})[0] == new and R.meta_upsert("no", {"a": "b"}) == ("no", [], [])


def test_lint():
    assert R.lint_errors("# fine\n\n<Card>x</Card> {a}\n\n```\n<br>\n```") == []
    assert R.lint_errors("<br>") and R.lint_errors("<Card>") and R.lint_errors("</Card>") and R.lint_errors("{a") and R.lint_errors("a < b")


def test_tree_and_selectors():
    root = parse('<div id="m" class="a b"><p>one<p>two <b>x</p><ul><li>1<li>2</ul><table><tr><td>c<td>d</table></div>')
    assert [n.text().strip() for n in select(root, "p")] == ["one", "two x"]
    assert [n.text() for n in select(root, "#m > ul li")] == ["1", "2"] and len(select(root, ".a.b td")) == 2 and len(select(root, "td, li")) == 4
    with pytest.raises(ValueError):
        select(root, "p::before")


def test_tables():
    assert C.table_to_gfm("<table><tr><th>A</th><th>B|C</th></tr><tr><td> x  y </td></tr><tr></tr></table>") == "| A | B\\|C |\n| --- | --- |\n| x y |  |"
    assert C.table_to_gfm("<table><tr><td>1</td></tr></table>") == "| 1 |" and C.table_to_gfm("<table></table>") is None and C.table_to_gfm("<p>") is None


def test_cleaning():
    assert C.strip_heading_anchors("## Head [​](#head)\n## [All](#all) x") == "## Head\n## All x"
    assert C.strip_title_heading("# Title\n\nx\n# Title", "title") == "\n\nx\n# Title"
    assert C.react_styles('<p style="font-size: 14px; color: red">\n```\nstyle="a: b"\n```') == '<p style={{fontSize: "14px", color: "red"}}>\n```\nstyle="a: b"\n```'
    assert C.close_void('<img src="x"><br/>\n```\n<br>\n```') == '<img src="x"/><br/>\n```\n<br>\n```'
    assert C.squeeze("\n\na\n\n\n\nb\n") == "a\n\nb"
    assert C.space_components("a\n<Card>\nb\n</Card>\nc") == "a\n\n<Card>\nb\n</Card>\n\nc"


def test_page():
    html = '<html><head><title>Guide | Site</title><meta property="og:title" content="G"></head><body><main><h1>Guide</h1><p>Hello <b>bold</b> and <a href="/x">link</a>, 1 < 2.</p><pre class="lang-py">a\nb</pre><ul><li>one</li><li>two</li></ul><details><summary>More</summary><p>in</p></details><details><summary>Yet</summary>more</details><img src="/i.png" alt="I"><div class="ad">no</div></main></body></html>'
    mdx = C.convert_page(html, "https://e.org/a/b", C.Config(content_selector="main", remove=["div.ad", "::bad"]))
    assert mdx.startswith('---\ntitle: "Guide"\npermalink: "https://e.org/a/b"\n"og:title": "G"\n---\n\n')
    for part in ("Hello **bold** and [link](/x)", "```python\na\nb\n```", "- one\n- two", '<AccordionGroup>\n<Accordion title="More">', "![I](https://e.org/i.png)", "1 &lt; 2"):
        assert part in mdx.replace("\n\n", "\n"), (part, mdx)  # cleaning puts blank lines around components
    assert "# Guide" not in mdx and "no" not in mdx.split("---\n\n")[1].split()
    assert "No content found" in C.convert_page("<p>x</p>", "", C.Config(content_selector=".none"))
    cards = C.Config(components=[{"name": "Card", "selector": ".c", "props": {"title": "h3", "href": "@href"}, "group": {"wrapper": "CardGroup"}}])
    made = C.convert_page('<body><a class="c" href="/1"><h3>T</h3>x</a> <a class="c" href="/2"><h3>U</h3>y</a></body>', "", cards)
    assert '<CardGroup>\n<Card title="T" href="/1">\nx\n</Card>' in made.replace("\n\n", "\n") and made.count("<CardGroup>") == 1
    hooked = C.Config(post=[lambda t, u, c: t + "!", lambda t, u, c: None])
    assert C.convert_page("<body>x</body>", "", hooked).endswith("x!") and C.convert_page("", "")


def test_dialects():
    assert D.hub_callouts('<Callout icon="👍" theme="default">\nx\n</Callout>') == "<Tip>\nx\n</Tip>" and D.hub_callouts('<Callout theme="error">x</Callout>').startswith("<Warning>")
    assert D.quote_callouts("> 📘 Note it\n>\n> body\n\n> plain") == "<Info>\n**Note it**\n\nbody\n</Info>\n\n> plain"
    assert D.hub_links("[a](doc:x#y) [b](ref:z) [c](changelog:w)") == "[a](/docs/x#y) [b](/docs/z) [c](/changelog/w)"
    assert D.code_groups("```js\na\n```\n```curl\nb\n```") == "<CodeGroup>\n```javascript\na\n```\n```bash curl\nb\n```\n</CodeGroup>"
    assert D.hub_front_matter('---\ntitle: "T"\nexcerpt: say "hi"\nhidden: no\n---\nx') == '---\ntitle: "T"\ndescription: "say \\"hi"\n---\nx'
    assert D.admonitions(":::caution[T]\nb\n:::\n```\n:::note\n:::\n```") == "<Warning>\n**T**\n\nb\n</Warning>\n```\n:::note\n:::\n```"
    assert D.site_tabs('<Tabs x="1"><TabItem value="v" label="L">a</TabItem><TabItem value="w">b</TabItem></Tabs>') == '<Tabs><Tab title="L">a</Tab><Tab title="w">b</Tab></Tabs>'
    assert D.accordions("<details>\n<summary>S</summary>\nx\n</details>") == '<Accordion title="S">\nx\n</Accordion>'
    assert D.link_extensions('[a](./b.md#c) <a href="d.mdx">') == '[a](./b#c) <a href="d">'
    assert D.site_title("# Hi: there\n\nx") == '---\ntitle: "Hi: there"\n---\n\nx'
    assert D.site_title("---\ntitle: Old\n---\n# New\n\nx") == "---\ntitle: New\nsidebarTitle: Old\n---\nx" and D.site_title("---\ntitle: A\n---\n# A\nx") == "---\ntitle: A\n---\nx"
    assert D.site_front_matter("---\nsidebar_label: S\n---\nx") == "---\nsidebarTitle: S\n---\nx"
    assert D.theme_imports("import T from '@theme/Tabs';\nx") == "x" and D.comments("<!-- a -->\n```\n<!-- b -->\n```") == "{/* a */}\n```\n<!-- b -->\n```"
    assert D.slug_of("---\nid: a\nslug: /b\n---\n") == "/b" and D.slug_of("x") is None


def test_site_dialect_steps():
    from quarrymill.operators import site_dialect as S

    fenced = ":::note\n```js\n:::tip\n:::\n```\nafter\n:::\n:::Odd_1[a [b]]  \nx\n:::\n::: note\n:::warn[\n:::tip\nopen"
    assert D.admonitions(fenced) == "<Note>\n```js\n:::tip\n:::\n```\nafter\n</Note>\n<Note>\n**a [b]**\n\nx\n</Note>\n::: note\n:::warn[\n<Tip>\nopen"
    assert D.accordions('<details>\n  <summary> a "b"\nc </summary>x</details><details><summary>same line</summary></details>') == '<Accordion title="a &quot;b&quot;\nc">x</Accordion><details><summary>same line</summary></Accordion>'
    assert D.link_extensions("[a](x.mdx) [b](.md) [c](y.mdx#s) [d](z.md?q) <A href='u.md#v'> [e](http://h/w.md)") == "[a](x) [b](.md) [c](y#s) [d](z.md?q) <A href='u#v'> [e](http://h/w)"
    assert D.theme_imports("import A from '@theme/A';\n\n \nimport B from \"./b\"\nimport C from '@docusaurus/C'") == "import B from \"./b\"\nimport C from '@docusaurus/C'"
    assert D.placeholders('\\{@codeBlock\\: Foo.bar \\} {@codeBlock: X} {@doc: "L|u://v"} {@other: y}') == '{/* TODO: codeBlock: Foo.bar */} {/* TODO: codeBlock: X */} [L](u://v) {@other: y}'
    assert D.heading_anchors("## A b {#x-y}\n```\n# c {#d}\n```\n####### e {#f}\n#g {#h}\n### i {#}\n# {#j}\n# k{#l}") == '<Heading level="2" id="x-y">A b</Heading>\n```\n# c {#d}\n```\n####### e {#f}\n#g {#h}\n### i {#}\n# {#j}\n# k{#l}'
    assert [S.snippet_path(p) for p in ("a/_b.md", "_snippets/c.mdx", "d/_snippets/e/f.md", "g/h.md", "i.png")] == ["snippets/a/_b.mdx", "snippets/_snippets/c.mdx", "snippets/d/_snippets/e/f.mdx", "g/h.mdx", "i.png"]
    imports = "import A from './_a.md';\nimport B from \"../_snippets/b.mdx\"\nimport C from './c.md'\nimport D from 'pkg'"
    assert S.changed(S.snippet_import_edits, "x/y/doc.md")(imports) == "import A from '/snippets/x/y/_a.md x'\n".replace("_a.md x", "_a.mdx") + "import B from \"/snippets/x/_snippets/b.mdx\"\nimport C from './c.md'\nimport D from 'pkg'"
    images = "![a](/i.png) <Frame>![b](c.png)</Frame> ![d](../../e.png#f) ![g](h.png) ![k](l.md) ![m](https://n/o.png)\n```\n![p](/q.png)\n```"
    got = S.changed(S.image_edits, "x/doc.md", lambda p: p == "x/h.png")(images)
    assert got == "<Frame>![a](/static/i.png)</Frame> <Frame>![b](c.png)</Frame> <Frame>![d](/static/e.png#f)</Frame> <Frame>![g](h.png)</Frame> <Frame>![k](l.md)</Frame> <Frame>![m](https://n/o.png)</Frame>\n```\n![p](/q.png)\n```"
    assert D.from_site("# T\n\n:::tip\nx\n:::\n", "a.md") == ("---\ntitle: T\n---\n\n<Tip>\nx\n</Tip>\n", 2)
