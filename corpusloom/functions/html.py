"""Statement pages: a tolerant HTML reader in Arrow batches, and the canonical Markdown of a record.

The reader keeps a stack of open elements; an end tag closes the nearest open element of its name and is
ignored where there is none. Text of scripts and styles is dropped, but for scripts that hold JSON.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements without content, elements that stand on lines of their own, and headings of sections.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote div dl dt dd fieldset footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table tr ul".split())
SECTIONS = {
    "statement": ("题目描述", "题面", "description", "problem statement"),
    "input": ("输入格式", "输入", "input", "input format"),
    "output": ("输出格式", "输出", "output", "output format"),
    "constraints": ("说明/提示", "提示", "数据范围", "note", "constraints", "hint"),
}
#: Fixed value: the schema of a parsed page.
_TEXTS = ("title", "statement", "input", "output", "constraints")
PAGE = T.StructType([*(T.StructField(n, T.StringType()) for n in _TEXTS), T.StructField("samples", T.ArrayType(T.StructType([T.StructField("input", T.StringType()), T.StructField("output", T.StringType())]))), T.StructField("url_id", T.StringType())])
#: Titles of the canonical Markdown.
HEADINGS = {"statement": "题目描述", "input": "输入格式", "output": "输出格式", "constraints": "数据范围"}


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self):
        yield self
        for child in self.children:
            if isinstance(child, Element):
                yield from child.walk()

    def has_class(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "").split()


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        element = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        top = self.open[-1]
        if top.tag == "style" or top.tag == "script" and "json" not in top.attrs.get("type", ""):
            return
        top.children.append(data)


def parse(page: str) -> Element:
    reader = _Reader()
    reader.feed(page)
    reader.close()
    return reader.root


def text_of(element: Element, skip_headings: bool = False) -> str:
    """Text with lines where blocks and breaks are; preformatted text as it is; white space elsewhere collapsed."""
    parts: list[str] = []

    def visit(node: Element, pre: bool) -> None:
        for child in node.children:
            if isinstance(child, str):
                parts.append(child if pre else re.sub(r"[ \t\r\n\f\v]+", " ", child))
            elif child.tag == "br":
                parts.append("\n")
            elif child.tag == "img":
                parts.append(child.attrs.get("alt", ""))
            elif child.tag in ("script", "style") or skip_headings and re.fullmatch("h[1-6]", child.tag):
                continue
            else:
                block = child.tag in BLOCK
                parts.append("\n" if block else "")
                visit(child, pre or child.tag == "pre")
                parts.append("\n" if block else "")

    visit(element, element.tag == "pre")
    lines = [line.rstrip() for line in "".join(parts).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n ")


def _json_samples(content: dict) -> list[dict]:
    """Samples from any of the places an embedded record keeps them in."""
    for key in ("samples", "examples", "cases"):
        found = content.get(key)
        if isinstance(found, list) and found:
            pairs = [(s[0], s[1]) if isinstance(s, (list, tuple)) and len(s) > 1 else (s.get("input", ""), s.get("output", "")) if isinstance(s, dict) else None for s in found]
            return [{"input": str(a), "output": str(b)} for p in pairs if p for a, b in [p]]
    return []


def _embedded(root: Element) -> dict | None:
    """The record of a JSON script, if it looks like a problem."""
    for element in root.walk():
        if element.tag == "script" and "json" in element.attrs.get("type", ""):
            try:
                value = json.loads("".join(c for c in element.children if isinstance(c, str)))
            except ValueError:
                continue
            stack = [value]
            while stack:
                here = stack.pop()
                if isinstance(here, dict):
                    if "title" in here and ("description" in here or "inputFormat" in here or "content" in here):
                        return here.get("content") | {"title": here["title"]} if isinstance(here.get("content"), dict) else here
                    stack += here.values()
                elif isinstance(here, list):
                    stack += here
    return None


def parse_statement(page: str) -> dict:
    """Title, sections and samples of a page: from its embedded record, its classes or its headings, in this order."""
    root = parse(page)
    elements = list(root.walk())
    out = {"title": "", "statement": "", "input": "", "output": "", "constraints": "", "samples": [], "url_id": ""}
    if record := _embedded(root):
        out |= {k: str(record.get(n) or "") for k, n in (("title", "title"), ("statement", "description"), ("input", "inputFormat"), ("output", "outputFormat"), ("constraints", "hint"))}
        out["samples"] = _json_samples(record)
        out["url_id"] = str(record.get("pid") or "")
        return out
    by_class = {name: next((e for e in elements if e.has_class(name)), None) for name in ("problem-statement", "input-specification", "output-specification", "note", "title")}
    if (body := by_class["problem-statement"]) is not None:
        if by_class["title"] is not None:
            out["title"] = text_of(by_class["title"])
        plain = [c for c in body.children if isinstance(c, Element) and not c.attrs.get("class")]
        out["statement"] = "\n\n".join(filter(None, map(text_of, plain)))
        for key, name in (("input", "input-specification"), ("output", "output-specification"), ("constraints", "note")):
            if by_class[name] is not None:
                heading = [e for e in by_class[name].walk() if e.has_class("section-title")]
                for h in heading:
                    h.children = []
                out[key] = text_of(by_class[name])
        pres = {side: [text_of(p) for e in elements if e.has_class(side) for p in e.walk() if p.tag == "pre"] for side in ("input", "output")}
        out["samples"] = [{"input": a, "output": b} for a, b in zip(pres["input"], pres["output"])]
        return out
    out["title"] = next((text_of(e) for e in elements if e.tag == "h1"), "")
    names = {n: key for key, values in SECTIONS.items() for n in values}
    holder = next((e for e in elements if e.tag == "article"), root)
    section, pres = None, []
    for child in [c for e in holder.walk() for c in e.children if isinstance(c, Element) and e.tag in ("", "html", "body", "article", "section", "main", "div")]:
        if re.fullmatch("h[2-6]", child.tag):
            section = names.get(text_of(child).strip().lower())
        elif child.tag == "pre":
            pres.append(text_of(child))
        elif section and child.tag not in ("section", "div", "article", "main", "h1"):
            out[section] = "\n\n".join(filter(None, (out[section], text_of(child))))
    out["samples"] = [{"input": a, "output": b} for a, b in zip(pres[::2], pres[1::2])]
    return out


@F.arrow_udf(PAGE)
def statement_page(pages: pa.Array) -> pa.Array:
    """``parse_statement`` of every page; null for null."""
    kind = pa.struct([(n, pa.string()) for n in _TEXTS] + [("samples", pa.list_(pa.struct([("input", pa.string()), ("output", pa.string())]))), ("url_id", pa.string())])
    return pa.array([None if p is None else parse_statement(p) for p in pages.to_pylist()], kind)


def statement_markdown(title: Column, statement: Column, given: Column, wanted: Column, constraints: Column, samples: Column) -> Column:
    """Canonical Markdown: a title, three sections, constraints where there are any, numbered samples."""

    def section(name: str, body: Column) -> Column:
        return F.concat(F.lit(f"\n\n## {HEADINGS[name]}\n\n"), body)

    numbered = F.transform(samples, lambda s, i: F.concat(F.lit("\n\n## 样例 "), (i + 1).cast("string"), F.lit("\n\n```input\n"), s["input"], F.lit("\n```\n\n```output\n"), s["output"], F.lit("\n```")))
    return F.concat(F.lit("# "), title, section("statement", statement), section("input", given), section("output", wanted), F.when(F.coalesce(constraints, F.lit("")) == "", "").otherwise(section("constraints", constraints)), F.array_join(numbered, ""), F.lit("\n"))
