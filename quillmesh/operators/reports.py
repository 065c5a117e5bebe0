"""Small HTML pages from result tables. A page holds at most ``rows`` rows of a table and says how many there are."""

from __future__ import annotations

import re
from html import escape

from pyspark.sql import DataFrame


def html_table(df: DataFrame, title: str, rows: int = 50) -> str:
    total = df.count()
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
    return f"<section><h2>{escape(title)}</h2><p>{total:,} rows</p><table><tr>{head}</tr>{body}</table></section>"


def fragment(markdown: str) -> str:
    """Headings, lists, fenced code and paragraphs of a Markdown text as HTML."""
    out, listing, fence = [], False, None
    for line in markdown.splitlines():
        if line.startswith("```"):
            if fence is None:
                fence = []
            else:
                out.append("<pre><code>" + escape("\n".join(fence)) + "</code></pre>")
                fence = None
            continue
        if fence is not None:
            fence.append(line)
            continue
        item = re.match(r"[-*] (.+)", line)
        if listing and not item:
            out.append("</ul>")
            listing = False
        if heading := re.match(r"(#{1,6}) (.+)", line):
            n = len(heading[1])
            out.append(f"<h{n}>{escape(heading[2])}</h{n}>")
        elif item:
            out += [] if listing else ["<ul>"]
            listing = True
            out.append(f"<li>{escape(item[1])}</li>")
        elif line.strip():
            out.append(f"<p>{escape(line.strip())}</p>")
    if listing:
        out.append("</ul>")
    if fence is not None:
        out.append("<pre><code>" + escape("\n".join(fence)) + "</code></pre>")
    return "\n".join(out)


def page(title: str, sections: list[str]) -> str:
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{''.join(sections)}</body></html>"


def dashboard(title: str, wanted: list[str], figures: dict[str, str]) -> tuple[str, list[str]]:
    """A page of the wanted figures (HTML by name) in order, and the names of those that are missing, which it lists too."""
    missing = [n for n in wanted if n not in figures]
    parts = [f"<section id='{escape(n.lower().replace(' ', '-'))}'><h2>{escape(n)}</h2>{figures[n]}</section>" for n in wanted if n in figures]
    if missing:
        parts.append("<section><h2>Missing</h2><ul>" + "".join(f"<li>{escape(n)}</li>" for n in missing) + "</ul></section>")
    return page(title, parts), missing
