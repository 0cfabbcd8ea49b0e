"""Main content of HTML pages as text with headings and list items."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements left out, and elements that hold the main content.
SKIPPED = frozenset({"script", "style", "noscript", "svg", "nav", "header", "footer", "form"})
MAIN = frozenset({"main", "article"})
BLOCKS = frozenset({"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "br", "pre", "blockquote", "figure"})
VOID = frozenset({"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"})


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # tag, left out, main
        self.all: list[str] = []
        self.main: list[str] = []
        self.title: list[str] = []

    def _put(self, text: str) -> None:
        self.all.append(text)
        if any(m for _, _, m in self.open):
            self.main.append(text)

    def handle_starttag(self, tag, attrs):
        main = tag in MAIN or dict(attrs).get("role") == "main"
        if tag not in VOID:
            self.open.append((tag, tag in SKIPPED, main))
        if any(s for _, s, _ in self.open):
            return
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self._put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self._put("\n- ")
        elif tag in BLOCKS:
            self._put("\n")

    def handle_endtag(self, tag):
        if not any(t == tag for t, _, _ in self.open):
            return
        hidden = any(s for _, s, _ in self.open)
        if not hidden and (tag in BLOCKS or len(tag) == 2 and tag[0] == "h"):
            self._put("\n")
        while self.open and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        if any(t == "title" for t, _, _ in self.open):
            self.title.append(data)
        elif not any(s for _, s, _ in self.open):
            self._put(data)


def _tidy(text: str) -> str:
    lines = [" ".join(line.split()) for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    out: list[str] = []
    for line in lines:
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip()


def clean(html: str | None) -> tuple[str, str]:
    """(title, content) of a page: the main elements if they hold text, else the whole page, under the title as a heading."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    title, content = " ".join("".join(reader.title).split()), _tidy("".join(reader.main)) or _tidy("".join(reader.all))
    if title and not content.startswith(f"# {title}"):
        content = f"# {title}\n\n{content}" if content else f"# {title}"
    return title, content


def cleaned(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, title, content) of every page."""

    @F.pandas_udf("title string, content string")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clean(v) for v in values], columns=["title", "content"])

    return pages.select(id_col, run(F.col(html_col)).alias("x")).select(id_col, "x.*")
