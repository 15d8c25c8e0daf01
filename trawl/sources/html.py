"""HTML pages as Markdown (A3, K6): a small event-driven writer inside Arrow batches.

The parser's events close over a stack of open elements; each element turns into Markdown as
soon as it ends, so no tree is kept. Null html gives null, broken markup what the parser reports.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SILENT = frozenset({"script", "style", "head", "title", "template", "noscript"})
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("p div section article main header footer nav aside ul ol li blockquote pre table h1 h2 h3 h4 h5 h6 body html form figure".split())


def _flat(text: str) -> str:
    return re.sub(r"[ \t\r\n]+", " ", text).strip()


def _inline(parts: list[tuple[str, object]]) -> str:
    return "".join(str(v) for k, v in parts if k in ("text", "block", "list"))


def _document(parts: list[tuple[str, object]]) -> str:
    """Blocks and runs of inline text, one blank line between them."""
    out, run = [], []
    for kind, value in [*parts, ("block", "")]:
        if kind == "text":
            run.append(str(value))
            continue
        if text := _flat("".join(run)):
            out.append(text)
        run = []
        if kind in ("block", "list", "item") and str(value).strip():
            out.append(str(value).strip())
    return "\n\n".join(out)


def table_markdown(rows: list[list[str]]) -> str:
    """K6: a pipe table; short rows are padded, bars and line ends in cells are escaped."""
    if not rows:
        return ""
    width = max(map(len, rows))
    cells = [[_flat(c).replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in rows]
    line = lambda r: f"| {' | '.join(r)} |"
    return "\n".join([line(cells[0]), line(["---"] * width), *map(line, cells[1:])])


def table_cells(line: str) -> list[str]:
    """K6: the cells of a pipe row; an escaped bar is part of its cell."""
    body = line.strip().removeprefix("|")
    body = body[:-1] if body.endswith("|") and not body.endswith("\\|") else body
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", body)]


class _Writer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict, list]] = [("", {}, [])]
        self.silent = 0

    @property
    def parts(self) -> list:
        return self.stack[-1][2]

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(("text", data))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        known = {k: v or "" for k, v in attrs}
        if tag == "br":
            self.parts.append(("text", "\n"))
        elif tag == "img":
            alt, src = known.get("alt", "").strip(), known.get("src", "").strip()
            if alt or src:
                self.parts.append(("text", f"![{alt}]({src})"))
        elif tag not in _VOID:
            if tag in _BLOCK and any(t == "p" for t, _, _ in self.stack):
                self.handle_endtag("p")  # a block ends an open paragraph
            elif tag in ("li", "tr", "td", "th") and self.stack[-1][0] in ({"td", "th"} if tag in ("td", "th") else {tag}):
                self.handle_endtag(self.stack[-1][0])
            self.silent += tag in _SILENT
            self.stack.append((tag, known, []))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.stack[1:]):
            return
        while True:
            name, attrs, parts = self.stack.pop()
            self.silent -= name in _SILENT
            if name not in _SILENT:
                self._close(name, attrs, parts)
            if name == tag:
                return

    def _close(self, tag: str, attrs: dict, parts: list) -> None:
        add = self.parts.append
        text = _flat(_inline(parts))
        if re.fullmatch("h[1-6]", tag):
            add(("block", f"{'#' * int(tag[1])} {text}" if text else ""))
        elif tag == "p":
            add(("block", text))
        elif tag in ("b", "strong", "i", "em"):
            mark = "**" if tag in ("b", "strong") else "*"
            add(("text", f"{mark}{text}{mark}" if text else ""))
        elif tag == "code" and not any(t == "pre" for t, _, _ in self.stack):
            add(("text", f"`{_inline(parts).strip()}`"))
        elif tag == "a":
            href = attrs.get("href", "").strip()
            add(("text", f"[{text}]({href})" if text and href else text))
        elif tag == "pre":
            raw = _inline(parts).strip("\n")
            add(("block", f"```\n{raw}\n```" if raw else ""))
        elif tag == "li":
            own = _flat("".join(str(v) for k, v in parts if k in ("text", "block")))
            add(("item", (own, [v for k, v in parts if k == "list"])) if self.stack[-1][0] in ("ul", "ol") else ("block", text))
        elif tag in ("ul", "ol"):
            lines, n = [], 1
            for own, nested in (v for k, v in parts if k == "item"):
                if own:
                    lines.append(f"{n}. {own}" if tag == "ol" else f"- {own}")
                    n += 1
                lines += [f"  {x}" for block in nested for x in str(block).splitlines() if x.strip()]
            add(("list", "\n".join(lines)))
        elif tag == "blockquote":
            add(("block", "\n".join(f"> {x}" for x in _document(parts).splitlines())))
        elif tag in ("td", "th"):
            add(("cell", _inline(parts)))
        elif tag == "tr":
            add(("row", [v for k, v in parts if k == "cell"]))
        elif tag in ("thead", "tbody", "tfoot"):
            self.parts.extend(p for p in parts if p[0] == "row")
        elif tag == "table":
            add(("block", table_markdown([v for k, v in parts if k == "row" and v])))
        elif tag in _BLOCK:
            add(("block", _document(parts)))
        else:
            self.parts.extend(parts)


def markdown(html: str) -> str:
    writer = _Writer()
    writer.feed(html)
    writer.close()
    while len(writer.stack) > 1:
        writer.handle_endtag(writer.stack[-1][0])
    return _document(writer.parts).strip()


def parsed(rows: DataFrame, parse: Callable[[str], str] = markdown) -> DataFrame:
    """A3, L4: (id, html) as (id, content, error); a page that fails gives its error, no content."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for html in batch.column(1).to_pylist():
                try:
                    out.append(None if html is None else parse(html))
                    errors.append(None)
                except Exception as e:  # a bad document must not fail the job
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(errors, pa.string())], names=["id", "content", "error"])

    return rows.select(F.col("id").cast("string").alias("id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "id string, content string, error string")
