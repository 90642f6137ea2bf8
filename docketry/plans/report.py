"""A report in Markdown from small ranked results. Only cut tables reach the driver."""

from __future__ import annotations

import html
import re
from datetime import date

from pyspark.sql import DataFrame

#: Most rows of a list, and of the typical cases, in a report.
MOST_ROWS, MOST_TYPICAL = 300, 40


def typical(representatives: DataFrame, n: int = MOST_TYPICAL) -> DataFrame:
    """The typical cases that a report shows: the first of the kinds in order, n at most."""
    return representatives.orderBy("violation", "rank").limit(min(n, MOST_TYPICAL))


def table(df: DataFrame, title: str, n: int = 20) -> str:
    """One section: a numbered Markdown table of the first n rows, MOST_ROWS at most."""
    rows = df.limit(min(n, MOST_ROWS)).collect()
    lines = [f"## {title}", ""]
    if not rows:
        return "\n".join([*lines, "(none)", ""])
    lines += ["| # | " + " | ".join(df.columns) + " |", "|---" * (len(df.columns) + 1) + "|"]
    cell = lambda v: str("—" if v in (None, "") else v).replace("|", "\\|").replace("\n", " ")
    lines += [f"| {k} | " + " | ".join(cell(v) for v in r) + " |" for k, r in enumerate(rows, 1)]
    return "\n".join([*lines, ""])


def report(title: str, sections: dict[str, DataFrame], advice: str = "", day: date | None = None) -> str:
    """A heading, one numbered section a table, and the advice if there is any."""
    parts = [f"# {title}", f"_{day or date.today():%Y-%m-%d}_", ""]
    parts += [table(df, f"{k}. {name}") for k, (name, df) in enumerate(sections.items(), 1)]
    if len(advice) >= 100:
        parts += [f"## {len(sections) + 1}. Advice", "", advice, ""]
    return "\n".join(parts)


def to_html(text: str) -> str:
    """Headings, tables, lists, bold and paragraphs of Markdown as HTML; everything else is escaped."""
    out, in_list, in_table = [], False, False
    bold = lambda s: re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", html.escape(s))
    for line in text.split("\n"):
        item, row = line.startswith("- "), line.startswith("|")
        if in_list and not item:
            out.append("</ul>")
        if in_table and not row:
            out.append("</table>")
        if item and not in_list:
            out.append("<ul>")
        if row and not in_table:
            out.append("<table>")
        in_list, in_table = item, row
        if m := re.match(r"(#{1,6}) (.*)", line):
            out.append(f"<h{len(m[1])}>{bold(m[2])}</h{len(m[1])}>")
        elif item:
            out.append(f"<li>{bold(line[2:])}</li>")
        elif row:
            if not re.fullmatch(r"[|\-: ]+", line):
                out.append("<tr>" + "".join(f"<td>{bold(c.strip())}</td>" for c in line.strip("|").split("|")) + "</tr>")
        elif line.strip():
            out.append(f"<p>{bold(line)}</p>")
    return "\n".join(out + ["</ul>"] * in_list + ["</table>"] * in_table)
