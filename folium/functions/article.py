"""Articles in the HTML that LaTeXML writes, as typed blocks.

A row comes out for each block: key, ord, type (sec, sub, ssub, p, eq, fig, tab), n, section, text, latex, caption, urls, panels,
fallback, anchor. What a block can't keep (a grid of panels, tables within tables, pictures among text) makes it a placeholder with a
reason in `fallback`, if it is in a figure or table; elsewhere, or without a paragraph, the whole article is refused: one row, of type
refused. The first row of an article that is read, of type meta, has its title as text and its authors as caption.
Cells of tables are read by operators.tables from the HTML of `table`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape, unescape
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements without an end, drawn ones, markup that texts keep, what replaces other markup, elements that are no content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DRAWN = {"img", "svg", "object", "embed", "canvas", "video", "picture"}
KEPT = {"b", "i", "sub", "sup", "code", "br"}
RENAMED = {"strong": "b", "mark": "b", "em": "i"}
OPAQUE = {"script", "style", "nav", "iframe"}
#: Classes of parts that are told elsewhere, of headings by depth, of equations.
SKIPPED = {"ltx_authors", "ltx_title_document", "ltx_date", "ltx_note", "ltx_page_footer"}
HEADINGS = {"ltx_title_section": 0, "ltx_title_subsection": 1, "ltx_title_subsubsection": 2}
NAMED = {"ltx_title_abstract": "Abstract", "ltx_title_bibliography": "References"}
EQUATION = {"ltx_equation", "ltx_equationgroup"}
#: Fixed value: how a caption without a marked label begins.
LABEL = re.compile(r"(Figure|Fig\.|Table)\s*(\d+[a-z]?)(?=[\s:.)]|$)", re.I)


#: Blocks of a batch that a task gives back.
BATCH = 4096


class Refused(ValueError):
    pass


class Node:
    __slots__ = ("attrs", "kids", "names", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.names = set((attrs.get("class") or "").split())

    def below(self) -> Iterator[Node]:
        todo = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [k for k in reversed(node.kids) if isinstance(k, Node)]

    def all(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.below() if test(n)]

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.below() if test(n)), None)

    def over(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def text(self) -> str:
        parts: list[str] = []
        todo: list = [self]
        while todo:
            k = todo.pop()
            if isinstance(k, str):
                parts.append(k)
            else:
                todo += reversed(k.kids)
        return "".join(parts)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.kids.append(data)


#: A tag without oddities, or text; its attributes; elements whose content is read by rules of their own; references that end as they should.
_PLAIN = re.compile(r"""<(/?)([a-z][a-z0-9]*)((?:\s+[a-z]+=(?:'[^'<>]*'|"[^"<>]*"))*)>|([^<\0]+)""")
_ATTRIBUTE = re.compile(r"""([a-z]+)=(?:'([^']*)'|"([^"]*)")""")
_OWN_RULES = re.compile("<(?:style|title|textarea|xmp|iframe|noembed|noframes|noscript|plaintext|script(?!>[^<]*</script>))")
_REFERENCE = re.compile(r"&(?!(?:[a-zA-Z]+|#[0-9]+);)")


def _tree(html: str) -> Node:
    """The elements of a page. Pages of plain tags alone are told to the same handlers without the general parser, which takes several times as long."""
    tree = _Tree()
    found = [] if _OWN_RULES.search(html) else list(_PLAIN.finditer(html))
    if sum(m.end() - m.start() for m in found) != len(html) or any(m[3] and _REFERENCE.search(m[3]) for m in found):
        tree.feed(html)
        tree.close()
        return tree.root
    raw = False
    for m in found:
        end, tag, attributes, data = m.groups()
        if data is not None:
            tree.handle_data(unescape(data) if "&" in data and not raw else data)
        elif end:
            tree.handle_endtag(tag)
        else:
            tree.handle_starttag(tag, [(n, unescape(a or b)) for n, a, b in _ATTRIBUTE.findall(attributes)] if attributes else ())
        raw = tag == "script" and not end
    return tree.root


def _latex(math: Node) -> str:
    """The TeX that a formula was made of; presentation markup alone loses its structure."""
    if (told := (math.attrs.get("alttext") or "").strip()):
        return told
    for note in math.all(lambda n: n.tag == "annotation" and re.fullmatch(r"application/x-(la)?tex|text/x-tex", (n.attrs.get("encoding") or "").lower()) is not None):
        if told := note.text().strip():
            return told
    raise Refused


def _inline(node: Node, leave: Node | None = None) -> str:
    """The text of a node with the markup that texts keep; formulas as TeX in brackets."""
    if node.tag == "math":
        return escape(rf"\({_latex(node)}\)", quote=False)
    parts = []
    for k in node.kids:
        if isinstance(k, str):
            parts.append(escape(k, quote=False))
        elif k is leave or k.tag in OPAQUE or k.names & {"ltx_note", "ltx_ERROR"}:
            continue
        elif k.tag in {"figure", "table"} or k.names & EQUATION:
            raise Refused
        else:
            tag = "b" if "ltx_font_bold" in k.names else RENAMED.get(k.tag, k.tag)
            inner = _inline(k)
            parts.append("<br/>" if tag == "br" else f"<{tag}>{inner}</{tag}>" if tag in KEPT else inner)
    return "".join(parts)


def _content(node: Node, leave: Node | None = None) -> str:
    return _inline(node, leave).strip()


class _Reader:
    def __init__(self, article: Node):
        self.rows: list[dict] = []
        self.path: list[str] = []
        self.seen: set[int] = set()
        drawn = article.all(lambda n: n.tag in DRAWN)
        for v in drawn:
            up = list(v.over())
            in_caption = any(n.tag in ("figcaption", "caption") for n in up)
            plain = v.tag == "img" and "ltx_graphics" in v.names and any(n.tag == "figure" for n in up) and not in_caption
            owner = next((n for n in up if n.tag == "figure"), None) or next((n for n in up if n.tag == "table"), None)
            if not plain and (owner is None or in_caption or owner.names & EQUATION):
                raise Refused
        self.walk(article)
        if self.seen != {id(v) for v in drawn} or not any(r["type"] == "p" for r in self.rows):
            raise Refused

    def add(self, kind: str, node: Node, **values) -> None:
        self.rows.append({"type": kind, "section": list(self.path), "anchor": node.attrs.get("id"), **values})

    def walk(self, node: Node) -> None:
        for k in node.kids:
            if isinstance(k, str) or k.tag in OPAQUE or k.names & SKIPPED:
                continue
            if "ltx_title" in k.names:
                self.heading(k)
            elif k.names & EQUATION:
                self.equation(k)
            elif k.tag == "figure":
                self.figure(k)
            elif k.tag == "table":
                self.table(k)
            elif k.tag == "math":
                told = _latex(k)
                self.add(*(("eq", k) if k.attrs.get("display") == "block" else ("p", k)), **({"latex": told, "text": told} if k.attrs.get("display") == "block" else {"text": _content(k)}))
            elif k.tag in ("p", "pre") or "ltx_bibitem" in k.names:
                if text := _content(k):
                    self.add("p", k, text=text)
            else:
                self.walk(k)

    def heading(self, node: Node) -> None:
        named = next((v for c, v in NAMED.items() if c in node.names), None)
        depth = 0 if named else next((d for c, d in HEADINGS.items() if c in node.names), None)
        if depth is None:  # a title within the running text
            if text := _content(node):
                self.add("p", node, text=f"<b>{text}</b>")
            return
        tag = next(iter(node.all(lambda n: "ltx_tag" in n.names)), None) if not named else None
        number = named or (tag.text().strip().strip(".") if tag else "")
        text = named or _content(node, tag)
        self.path = [*self.path[:depth], number or re.sub(r"<[^>]+>", "", text)]
        self.add(("sec", "sub", "ssub")[depth], node, n=number or None, text=text)

    def equation(self, node: Node) -> None:
        latex = [_latex(m) for m in node.all(lambda n: n.tag == "math")]
        tag = next(iter(node.all(lambda n: n.names & {"ltx_tag_equation", "ltx_tag_equationgroup"} != set())), None)
        lines = [" ".join(_latex(m) for m in row.all(lambda n: n.tag == "math")) for row in node.all(lambda n: n.tag == "tr" and "ltx_eqn_row" in n.names)]
        if not latex or not all(x.strip() for x in lines):
            raise Refused
        whole = rf"\begin{{aligned}}{r'\\'.join(lines)}\end{{aligned}}" if len(lines) > 1 else " ".join(latex)
        self.add("eq", node, n=tag.text().strip() if tag else None, latex=whole, text=" ".join(latex))

    def labelled(self, node: Node, caption: Node | None) -> tuple[str | None, str]:
        tag = next(iter(caption.all(lambda n: n.names & {"ltx_tag_table", "ltx_tag_figure"} != set())), None) if caption else None
        label = tag.text().strip().rstrip(": .") if tag else None
        if not label and caption and (m := LABEL.match(re.sub(r"<[^>]+>", "", _content(caption)).strip())):
            label = ("Table " if m[1].lower() == "table" else "Figure ") + m[2]
        return label, "tab" if "ltx_table" in node.names or (label or "").lower().startswith("table ") else "fig"

    def placeholder(self, node: Node, kind: str, caption: Node | None, label: str | None) -> None:
        name = "figcaption" if node.tag == "figure" else "caption"
        captions = ([caption] if caption else []) + [c for c in node.all(lambda n: n.tag == name) if c is not caption]
        images = node.all(lambda n: n.tag == "img")
        self.add(kind, node, n=label, caption="<br>".join(_content(c) for c in captions), fallback="html_structure", urls=[i.attrs["src"] for i in images if i.attrs.get("src")], panels=len(images))
        self.seen |= {id(v) for v in node.all(lambda n: n.tag in DRAWN)}

    def figure(self, node: Node) -> None:
        own = lambda n: next((o for o in n.over() if o.tag == "figure"), None) is node
        captions = node.all(lambda n: n.tag == "figcaption" and own(n))
        caption = captions[0] if captions else None
        label, kind = self.labelled(node, caption)
        drawn = node.all(lambda n: n.tag in DRAWN)
        inner = node.all(lambda n: n.tag == "figure")
        if inner and not captions and not any(own(v) for v in drawn):
            return self.walk(node)
        graphics = [v for v in drawn if v.tag == "img" and "ltx_graphics" in v.names]
        tables = node.all(lambda n: n.tag == "table" and "ltx_tabular" in n.names) if kind == "tab" else []
        urls = [g.attrs["src"] for g in graphics if g.attrs.get("src")]
        rest = "".join(t for t in self._besides(node)).strip()
        other = node.all(lambda n: n.tag in ("table", "math") or n.names & EQUATION != set())
        alone = caption is not None and not rest and not drawn and not other
        broken = (
            bool(inner) or len(captions) > 1 or len(graphics) > 1 or len(drawn) != len(graphics)
            or (kind == "fig" and bool(rest or [o for o in other if not any(u is caption for u in o.over())]))
            or (bool(tables) and (bool(graphics) or len(tables) > 1 or not _one_table(tables[0]))) or not (tables or urls or alone)
        )
        if broken:
            return self.placeholder(node, kind, caption, label)
        self.add(kind, node, n=label, caption=_content(caption) if caption else "", urls=urls if not tables else [], table=_source(tables[0]) if tables else None)
        self.seen |= {id(v) for v in drawn}

    @staticmethod
    def _besides(node: Node) -> Iterator[str]:
        """Text of a figure outside of captions and pictures."""
        for k in node.kids:
            if isinstance(k, str):
                yield k
            elif k.tag not in DRAWN | OPAQUE | {"figcaption"}:
                yield from _Reader._besides(k)

    def table(self, node: Node) -> None:
        caption = next(iter(node.all(lambda n: n.tag == "caption")), None)
        label, _ = self.labelled(node, caption)
        if node.all(lambda n: n.tag in DRAWN) or not _one_table(node):
            return self.placeholder(node, "tab", caption, label)
        self.add("tab", node, n=label, caption=_content(caption) if caption else "", table=_source(node))


def _one_table(node: Node) -> bool:
    try:
        for m in node.all(lambda n: n.tag == "math"):
            _latex(m)
    except Refused:
        return False
    return not node.all(lambda n: n.tag == "table")


def _source(node: Node) -> str:
    """A table as HTML again, formulas as TeX (plain numbers without brackets)."""
    if node.tag == "math":
        told = _latex(node)
        return escape(told if re.fullmatch(r"[−+\-]?\d+(?:\.\d+)?%?", told) else rf"\({told}\)", quote=False)
    inner = "".join(escape(k, quote=False) if isinstance(k, str) else _source(k) for k in node.kids)
    attrs = "".join(f' {a}="{escape(node.attrs[a])}"' for a in ("class", "colspan", "rowspan") if node.attrs.get(a))
    return f"<{node.tag}{attrs}>" + (inner + f"</{node.tag}>" if node.tag not in VOID else "")


def read_article(html: str | None) -> list[dict]:
    """Rows of one article, or a refusal."""
    root = _tree(html or "")
    try:
        article = root.first(lambda n: n.tag == "article" and "ltx_document" in n.names)
        if article is None:
            raise Refused
        rows = _Reader(article).rows
        title = article.first(lambda n: "ltx_title_document" in n.names)
        authors = article.first(lambda n: "ltx_authors" in n.names)
        meta = {"type": "meta", "text": _content(title) if title else None, "caption": " ".join(authors.text().split()) if authors else ""}
        return [meta, *rows]
    except (Refused, RecursionError):  # an article nested hundreds of levels deep is refused too
        return [{"type": "refused"}]


_FIELDS = [("ord", pa.int64()), ("type", pa.string()), ("n", pa.string()), ("section", pa.list_(pa.string())), ("text", pa.string()), ("latex", pa.string()), ("caption", pa.string()), ("urls", pa.list_(pa.string())), ("panels", pa.int32()), ("fallback", pa.string()), ("anchor", pa.string()), ("table", pa.string())]
_SCHEMA = "ord bigint, type string, n string, section array<string>, text string, latex string, caption string, urls array<string>, panels int, fallback string, anchor string, table string"


def articles(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key and the blocks of each article, ord from -1 (meta, or the refusal)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = ((i, n, r) for i, text in enumerate(b.column(1).to_pylist()) for n, r in enumerate(read_article(text), -1))
            while some := list(islice(made, BATCH)):
                at, ords, rows = zip(*some, strict=True)
                told = (pa.array(ords if n == "ord" else [r.get(n) for r in rows], t) for n, t in _FIELDS)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *told], [key, *(n for n, _ in _FIELDS)])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, {_SCHEMA}")


def asset_versions(paper: Column, urls: Column, base: str) -> Column:
    """The versions of a paper (its id, with or without one) that pictures are taken from; relative addresses are under the paper's own."""
    bare = F.regexp_replace(paper, r"v[1-9]\d*$", "")
    full = F.transform(urls, lambda u: F.when(u.rlike("^https?://"), u).when(u.startswith("/"), F.concat(F.regexp_extract(F.lit(base), r"^https?://[^/]+", 0), u)).otherwise(F.concat(F.lit(base), u)))
    trusted = F.filter(full, lambda u: u.startswith(base) & ~u.rlike(r"(^|/)\.\.(/|$)"))
    named = F.transform(trusted, lambda u: F.split(F.substring(u, len(base) + 1, 1 << 30), "/")[0])
    return F.array_sort(F.array_distinct(F.filter(named, lambda v: F.regexp_replace(v, r"v[1-9]\d*$", "").eqNullSafe(bare) & (v != bare))))


def imported(papers: DataFrame, blocks: DataFrame, resolved: DataFrame, base: str) -> DataFrame:
    """paper, source, kind (html, mixed or pdf), reason: where each paper's blocks come from.

    papers: paper (id, with or without a version), html (null if there is none); blocks: paper and the blocks of articles();
    resolved: paper, ord of placeholders that were found in the PDF. An article counts if it was read, its pictures are of one version (of
    the asked one, if the id names one), and every placeholder was found; else the PDF counts, and the reason says why.
    """
    urls = blocks.filter("size(urls) > 0").groupBy("paper").agg(F.flatten(F.collect_list("urls")).alias("urls"))
    pending = blocks.filter("fallback IS NOT NULL").select("paper", "ord").join(resolved.select("paper", "ord", F.lit(True).alias("found")), ["paper", "ord"], "left")
    open_ = pending.groupBy("paper").agg(F.count("*").alias("holders"), F.count_if(F.col("found").isNull()).alias("missing"))
    refused = blocks.filter("type = 'refused'").select("paper", F.lit(True).alias("refused"))
    p = papers.join(urls, "paper", "left").join(open_, "paper", "left").join(refused, "paper", "left")
    versions = asset_versions(F.col("paper"), F.coalesce("urls", F.array().cast("array<string>")), base)
    pinned = F.col("paper").rlike(r"v[1-9]\d*$")
    p = p.withColumn("versions", versions)
    others = F.when(pinned, F.size(F.array_except("versions", F.array("paper"))) > 0).otherwise(F.size("versions") > 1)
    source = F.when(~pinned & (F.size("versions") == 1), F.col("versions")[0]).otherwise(F.col("paper"))
    # without a version, nothing says which PDF the placeholders are to be found in
    unfound = (F.coalesce("missing", F.lit(0)) > 0) | ((F.coalesce("holders", F.lit(0)) > 0) & ~source.rlike(r"v[1-9]\d*$"))
    reason = F.when(F.col("html").isNull(), "html_unavailable").when(F.coalesce("refused", F.lit(False)), "html_structure").when(others, "html_images").when(unfound, "html_structure")
    told = p.withColumn("reason", reason).withColumn("source", F.when(reason.isNull() | ~others, source).otherwise(F.col("paper")))
    kind = F.when(F.col("reason").isNotNull(), "pdf").when(F.coalesce("holders", F.lit(0)) > 0, "mixed").otherwise("html")
    return told.select("paper", F.when(F.col("html").isNull() | F.coalesce("refused", F.lit(False)), F.col("paper")).otherwise(F.col("source")).alias("source"), kind.alias("kind"), "reason")
