"""Evaluation reports: a few aggregated rows as JSON and Markdown.  Never texts."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

#: Rows of one section, at most: sections are aggregates.
MAX_ROWS = 10_000


def section(df: DataFrame) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in df.limit(MAX_ROWS + 1).collect()]
    if len(rows) > MAX_ROWS:
        raise ValueError(f"a report section has more than {MAX_ROWS} rows; aggregate first")
    return rows


def _cell(value) -> str:
    if value is None:
        return "-"
    return f"{value:g}" if isinstance(value, float) else str(value).replace("|", "\\|")


def markdown(title: str, sections: dict[str, list[dict]]) -> str:
    out = [f"# {title}", ""]
    for name, rows in sections.items():
        out += [f"## {name}", ""]
        if not rows:
            out += ["No rows.", ""]
            continue
        columns = list(rows[0])
        out += ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
        out += ["| " + " | ".join(_cell(r[c]) for c in columns) + " |" for r in rows]
        out.append("")
    return "\n".join(out)


def write(path: str, title: str, frames: dict[str, DataFrame]) -> dict[str, list[dict]]:
    """``path``.json and ``path``.md of the given aggregates; returns their rows."""
    sections = {name: section(df) for name, df in frames.items()}
    Path(f"{path}.json").write_text(json.dumps(sections, sort_keys=True, indent=1, default=str), encoding="utf-8")
    Path(f"{path}.md").write_text(markdown(title, sections), encoding="utf-8")
    return sections
