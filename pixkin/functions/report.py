"""Reports: columns for pages that tasks write, and JSON, HTML and terminal output of few rows."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixkin.functions.scores import BADGES, COLDEST, HEAT, LIGHTEST, SHADES

SCORES = ("hash_ensemble", "sector_grid", "dct_spectrum", "global_semantic", "patch_spatial")


def json_report(rows: Iterable[dict]) -> str:
    return json.dumps(list(rows), indent=2, default=str)


def bar(score: float, width: int = 20) -> str:
    full = round(max(0.0, min(1.0, score)) * width)
    return "█" * full + "░" * (width - full)


def heatmap(cells: list[list[float]], colour: bool = True) -> str:
    def one(v: float) -> str:
        if not colour:
            return next((s for cut, s in SHADES if v >= cut), LIGHTEST)
        return f"\x1b[48;5;{next((c for cut, c in HEAT if v >= cut), COLDEST)}m  \x1b[0m"

    return "\n".join("".join(map(one, row)) + "  " + " ".join(f"{v:.2f}" for v in row) for row in cells)


#: From here on a cell isn't called out as the coldest.
COLD_BELOW = 0.80


def coldest(cells: list[list[float]]) -> tuple[int, int, float] | None:
    """The first cell, row by row, within 1e-6 of the least one, if that is below COLD_BELOW."""
    least = min(map(min, cells))
    if least >= COLD_BELOW:
        return None
    return next((i, j, v) for i, row in enumerate(cells) for j, v in enumerate(row) if abs(v - least) < 1e-6)


def shortened(text: str, most: int = 100) -> str:
    return text if len(text) <= most else text[:most] + "…"


def terminal_report(row: dict, colour: bool = False) -> str:
    lines = [f"{row['id_a']} ~ {row['id_b']}: {row['verdict']} {row['composite']:.4f}"]
    lines += [f"  {s:16} {bar(row[s])} {row[s]:.4f}" for s in SCORES if row.get(s) is not None]
    if row.get("grid_matrix"):
        lines.append(heatmap(row["grid_matrix"], colour))
        if cold := coldest(row["grid_matrix"]):
            lines.append(f"  coldest cell ({cold[0]}, {cold[1]}): {cold[2]:.3f}, a difference in one place")
    if row.get("align_applied") is not None:
        used = [f"scale {row['align_scale']:.4f}", f"rotation {row['align_rotation_deg']:+.2f} degrees", f"{row['align_inliers']} inliers"] if row["align_applied"] else [row.get("align_reason") or "not applied"]
        lines.append("  alignment: " + ", ".join(used))
    if row.get("stages_run"):
        lines.append("  stages: " + ", ".join(row["stages_run"]))
    if row.get("ocr_text_a"):
        lines.append("  text: " + shortened(row["ocr_text_a"]))
    return "\n".join(lines)


def html_report(rows: list[dict], title: str = "Near duplicates") -> str:
    """A table of matches, best first, that can be filtered; all text is escaped."""
    best = f"{max(r['composite'] for r in rows):.4f}" if rows else "—"
    cell = lambda x: f"<td>{html.escape(str(x))}</td>"
    body = "".join(
        f"<tr>{cell(i)}{cell(r.get('label_a', r['id_a']))}{cell(r.get('label_b', r['id_b']))}<td>{r['composite']:.4f}</td>"
        f"<td style='background:{BADGES.get(r['verdict'], BADGES['DISTINCT'])}'>{html.escape(r['verdict'].replace('_', ' '))}</td>"
        + "".join(f"<td>{r[s]:.4f}</td>" if r.get(s) is not None else "<td></td>" for s in SCORES)
        + "</tr>"
        for i, r in enumerate(sorted(rows, key=lambda r: -r["composite"]), 1)
    )
    body = body or f"<tr><td colspan='{5 + len(SCORES)}'>No near duplicates found</td></tr>"
    head = "".join(f"<th>{h}</th>" for h in ("#", "a", "b", "composite", "verdict", *SCORES))
    find = "for(const r of document.querySelectorAll('tbody tr'))r.hidden=!r.textContent.toLowerCase().includes(this.value.toLowerCase())"
    return f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><p>{len(rows)} pairs, best {best}</p><input oninput=\"{find}\" placeholder='filter'><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def _escaped(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def _heat_cells(matrix: Column) -> Column:
    """A grid's cells as a small table, shaded from red to green."""
    colour = lambda v: F.format_string("<td style='background:hsl(%d,70%%,50%%)' title='%.2f'></td>", F.floor(120 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))).cast("int"), v)
    row = lambda cells: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, colour), ""), F.lit("</tr>"))
    return F.coalesce(F.concat(F.lit("<table class=grid>"), F.array_join(F.transform(matrix, row), ""), F.lit("</table>")), F.lit(""))


TABLE_HEAD = "<table id=pairs><thead><tr>" + "".join(f"<th onclick='order({i})'>{h}</th>" for i, h in enumerate(("#", "a", "b", "composite", "verdict", *SCORES, "alignment", "grid"))) + "</tr></thead><tbody>"


def table_row(columns: list[str]) -> Column:
    """A match as a row of a page, from the columns that it has; thumb_a and thumb_b are addresses of images."""
    has = lambda name, value: value if name in columns else F.lit("")
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    number = lambda name: has(name, F.coalesce(F.format_string("%.4f", F.col(name)), F.lit("")))
    badge = F.lit(BADGES["DISTINCT"])
    for code, colour in BADGES.items():
        badge = F.when(F.col("verdict") == code, colour).otherwise(badge)
    picture = lambda s: has(f"thumb_{s}", F.concat(F.lit("<img loading=lazy width=120 src='"), _escaped(F.col(f"thumb_{s}")), F.lit("'> ")))
    label = lambda s: _escaped(F.coalesce(F.col(f"label_{s}") if f"label_{s}" in columns else F.lit(None), F.col(f"id_{s}").cast("string")))
    turn = F.format_string("scale %.3f, %.1f degrees", F.col("align_scale"), F.col("align_rotation_deg")) if "align_scale" in columns and "align_rotation_deg" in columns else F.lit("")
    aligned = has("align_applied", F.when(F.col("align_applied") if "align_applied" in columns else F.lit(False), turn).otherwise(has("align_reason", _escaped(F.col("align_reason")) if "align_reason" in columns else F.lit(""))))
    verdict = F.concat(F.lit("<td style='background:"), badge, F.lit("'>"), _escaped(F.replace(F.col("verdict"), F.lit("_"), F.lit(" "))), F.lit("</td>"))
    grid = _heat_cells(F.col("grid_matrix")) if "grid_matrix" in columns else F.lit("")
    return F.concat(F.lit("<tr>"), cell(F.col("place").cast("string")), cell(F.concat(picture("a"), label("a"))), cell(F.concat(picture("b"), label("b"))), cell(number("composite")), verdict, *[cell(number(s)) for s in SCORES], cell(F.coalesce(aligned, F.lit(""))), cell(grid), F.lit("</tr>"))


def page_frame(title: str, rows: int, best: float | None) -> tuple[str, str]:
    """What stands before and after a page's links and table: its rows can be filtered, and sorted by a column."""
    title, most = html.escape(title), "—" if best is None else f"{best:.4f}"
    find = "for(const r of document.querySelectorAll('#pairs>tbody>tr'))r.hidden=!r.textContent.toLowerCase().includes(this.value.toLowerCase())"
    sort = "function order(i){const b=document.querySelector('#pairs>tbody'),n=x=>{const t=x.cells[i].textContent,f=parseFloat(t);return isNaN(f)?t:f};const up=b.dataset.by==i;b.dataset.by=up?'':i;[...b.rows].sort((x,y)=>{const p=n(x),q=n(y);return(p<q?-1:p>q?1:0)*(up?1:-1)}).forEach(r=>b.appendChild(r))}"
    head = f"<!DOCTYPE html><meta charset='utf-8'><title>{title}</title><style>.grid td{{width:6px;height:6px;padding:0}}</style><script>{sort}</script><h1>{title}</h1><p>{rows} pairs, best {most}</p><input oninput=\"{find}\" placeholder='filter'>"
    return head, "</tbody></table>"


def page_links(page: Column, pages: int) -> Column:
    """To the page before and the page after."""
    link = lambda n, text: F.concat(F.lit("<a href='../page="), n.cast("string"), F.lit(f"/'>{text}</a> "))
    return F.concat(F.lit("<p>"), F.when(page > 1, link(page - 1, "before")).otherwise(""), F.concat(F.lit("page "), page.cast("string"), F.lit(f" of {pages} ")), F.when(page < pages, link(page + 1, "after")).otherwise(""), F.lit("</p>"))
