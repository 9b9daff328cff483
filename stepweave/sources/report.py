"""A static HTML page of bounded tables."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS = 500


def _cell(value) -> str:
    return html.escape("" if value is None else str(value))


def table(title: str, df: DataFrame, most: int = MOST_ROWS) -> str:
    """The first ``most`` rows of an ordered table, escaped."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    rows = "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in row) + "</tr>" for row in df.limit(most).collect())
    return f"<section><h2>{html.escape(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{rows}</tbody></table></section>"


def details(title: str, rows: DataFrame, sites: DataFrame, key: str = "pattern", steps: str = "canonical_text_seq", most: int = MOST_ROWS) -> str:
    """The first ``most`` rows of an ordered table, each with a fold-out of its
    ``steps`` and of its few ``sites`` (key, site, place, start, texts)."""
    kept = rows.limit(most)
    facts = [c for c in rows.columns if c != steps]
    held = sites.join(kept.select(key), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("site", "place", "start", "texts"))).alias("_sites"))
    found = {r[key]: r["_sites"] for r in held.collect()}  # as bounded as the table
    out = []
    for row in kept.collect():
        head = "".join(f"<td>{_cell(row[c])}</td>" for c in facts)
        places = "".join(f"<p>{_cell(s['place'])} from step {s['start'] + 1}</p>{_list(s['texts'], s['start'] + 1)}" for s in found.get(row[key], []))
        out.append(f"<tbody><tr>{head}</tr><tr><td colspan='{len(facts)}'><details><summary>steps and places</summary>{_list(row[steps])}{places or '<p>no places</p>'}</details></td></tr></tbody>")
    names = "".join(f"<th>{html.escape(c)}</th>" for c in facts)
    return f"<section><h2>{html.escape(title)}</h2><table><thead><tr>{names}</tr></thead>{''.join(out)}</table></section>"


def _list(texts, first: int = 1) -> str:
    return f"<ol start='{first}'>" + "".join(f"<li>{_cell(t)}</li>" for t in texts or []) + "</ol>"


#: Sorts a table by the heading that is clicked, the other way round at the next
#: click. Rows with a fold-out are a body of their own, and move as one.
_SORT = """<script>addEventListener('click', e => {
  const head = e.target.closest('th'); if (!head) return;
  const table = head.closest('table'), many = table.tBodies.length > 1, turn = head.dataset.turn = head.dataset.turn === '1' ? -1 : 1;
  const value = x => (many ? x.rows[0] : x).cells[head.cellIndex].textContent;
  const order = (a, b) => { const x = value(a), y = value(b); return turn * (x !== '' && y !== '' && !isNaN(x) && !isNaN(y) ? x - y : x.localeCompare(y)); };
  [...(many ? table.tBodies : table.tBodies[0].rows)].sort(order).forEach(x => x.parentNode.append(x));
});</script>"""


def write_html(spark: SparkSession, tables: dict[str, DataFrame | tuple[DataFrame, DataFrame]], path: str, title: str = "Report", most: int = MOST_ROWS) -> None:
    """One page with a section per table, which its headings sort; each is cut at
    ``most`` rows on Spark. A table with its call sites has fold-outs."""
    parts = [table(t, df, most) if isinstance(df, DataFrame) else details(t, *df, most=most) for t, df in tables.items()]
    page = f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title>{''.join(parts)}{_SORT}"
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(path)
