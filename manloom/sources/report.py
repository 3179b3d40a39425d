"""A run as one page of HTML, as numbered lines.

Sorted by section and place the lines are the page.  Rows of tables are numbered over tasks and
headings count by aggregates, so a report of any size is written by sorting; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..scratch import keep, placed
from .sinks import escaped

HEAD, FIRMWARE, STATE, MISSING, UNSEEN, CONFIGURATION, GAPS, CONTEXTS, EXECUTED, FOOT = range(10)
_LAST = 1 << 62

_STYLE = """<style>
body { margin: 2rem auto; max-width: 70rem; padding: 0 1rem; font: 1rem/1.45 sans-serif; color-scheme: light dark }
table { border-collapse: collapse; width: 100% } td, th { border-bottom: 1px solid gray; padding: .4rem; text-align: left }
.good { border-left: 4px solid green; padding: .6rem } .bad { border-left: 4px solid orange; padding: .6rem }
</style>"""
_SEARCH = """<script>
const box = document.querySelector("#find"), found = document.querySelectorAll("tr[data-says]");
if (box) box.addEventListener("input", () => { for (const row of found) row.hidden = !row.dataset.says.includes(box.value.trim().toLowerCase()); });
</script>"""


def _says(of: DataFrame, section: int, lines: list[tuple[int, Column | str]]) -> DataFrame:
    """Lines made of a row; those that are null are left out."""
    made = [F.struct(F.lit(place).cast("long").alias("place"), (F.lit(html) if isinstance(html, str) else html).alias("html")) for place, html in lines]
    told = of.select(F.explode(F.array(*made)).alias("l"))
    return told.select(F.lit(section).alias("section"), "l.place", "l.html").where("html IS NOT NULL")


def _shown(value: Column | str) -> Column:
    return escaped(F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit("")))


def _code(value: Column | str) -> Column:
    return F.concat(F.lit("<code>"), _shown(value), F.lit("</code>"))


def _table(rows: DataFrame, section: int, title: str, columns: list[str], cells: list[Column], order: list[Column], *, empty: str | None, says: Column | None = None, note: str | None = None) -> DataFrame:
    """A heading with the number of rows, and a numbered table of them, or what is said of none (null:
    no section at all)."""
    n = rows.agg(F.count("*").alias("n"))
    some = F.col("n") > 0
    heads = "".join(f"<th>{c}</th>" for c in ["#", *columns])
    heading = F.concat(F.lit(f"<h2>{title} <span>"), F.col("n").cast("string"), F.lit("</span></h2>"))
    frame = [(-3, heading if empty is not None else F.when(some, heading)), (-1, F.when(some, F.lit(f"<table><thead><tr>{heads}</tr></thead><tbody>"))), (_LAST, F.when(some, F.lit("</tbody></table>")))]
    if note is not None:
        frame.append((-2, F.when(some, F.lit(f'<p class="bad">{note}</p>'))))
    if empty is not None:
        frame.append((0, F.when(~some, F.lit(f"<p>{empty}</p>"))))
    lead = F.lit("<tr><td>") if says is None else F.concat(F.lit('<tr data-says="'), says, F.lit('"><td>'))
    row = F.concat(lead, F.concat_ws("</td><td>", F.col("place").cast("string"), *cells), F.lit("</td></tr>"))
    return _says(n, section, frame).unionByName(placed(rows, order).select(F.lit(section).alias("section"), F.col("place").cast("long").alias("place"), row.alias("html")))


def context_state(given: set[str]) -> Column:
    """Why a context is incomplete, the gravest first; ``given`` are the columns there are."""
    known = lambda name, kind: F.coalesce(F.col(name) if name in given else F.lit(None).cast(kind), F.lit(0 if kind == "long" else False) if kind != "array<string>" else F.array().cast(kind))
    tokens, text = known("skipped_parameters", "array<string>"), lambda c: c.cast("string")
    more = F.when(F.size(tokens) > 4, F.concat(F.lit(" and "), text(F.size(tokens) - 4), F.lit(" more"))).otherwise("")
    why = F.concat_ws(
        "; ",
        F.when(known("mismatched", "long") > 0, F.concat(F.lit("copied branches that weren't confirmed: "), text(known("mismatched", "long")))),
        F.when(known("truncated", "boolean"), F.lit("copying reached its bound")),
        F.when(F.size(tokens) > 0, F.concat(F.lit("no sample for "), F.array_join(F.slice(tokens, 1, 4), ", "), more)),
        F.when(known("skipped_denied", "long") > 0, F.concat(F.lit("branches refused: "), text(known("skipped_denied", "long")))),
        F.when(known("skipped_depth", "long") > 0, F.concat(F.lit("too deep: "), text(known("skipped_depth", "long")))),
    )
    return F.when(known("complete", "boolean"), F.lit("complete")).when(why == "", F.lit("incomplete")).otherwise(F.concat(F.lit("incomplete: "), why))


def report_lines(
    catalog: DataFrame, mode: str = "compare", *, complete: bool, queries: int = 0, generated_at: str = "", firmware: DataFrame | None = None, coverage: DataFrame | None = None,
    gaps: DataFrame | None = None, contexts: DataFrame | None = None, executed: DataFrame | None = None,
) -> DataFrame:
    """``(section, place, html)``: the page of a reconciled catalog, ``(command, description, sources, status)``.

    ``firmware(command, output, error)`` are version answers, or why there is none.  ``coverage`` and
    ``gaps`` are those of ``operators.config``.  ``contexts(name, fingerprint, entry_path, commands,
    complete)`` may also have ``mismatched, truncated, skipped_parameters, skipped_denied,
    skipped_depth``.  ``executed(n, command)`` is all that was entered, in order.  What isn't given has
    no section.  Only ``compare`` has findings: what is missing for certain, and what the walk didn't
    reach.  Values are escaped, null is empty.  An empty catalog gives the page with its counts at 0.
    """
    catalog = keep(catalog.select("command", "description", "sources", "status"), "report-catalog")
    sums = catalog.agg(
        F.count_if(C.on_device(F.col("sources"))).alias("device"), F.count_if(C.documented(F.col("sources"))).alias("manuals"),
        F.count_if(F.col("status").isin("missing_on_device", "not_observed")).alias("findings"),
    )
    stats = F.concat(F.lit("<p>on the device: <b>"), F.col("device").cast("string"), F.lit("</b>, in manuals: <b>"), F.col("manuals").cast("string"), F.lit(f"</b>, queries: <b>{queries}</b></p>"))
    whole = "complete" if complete else "incomplete"
    parts = [_says(sums, HEAD, [(0, f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Commands by mode {mode}</title>{_STYLE}</head><body>'), (1, f"<h1>Commands</h1><p>mode {mode}, walk {whole}</p>"), (2, stats)])]
    if firmware is not None:
        got = F.trim(F.coalesce("output", F.lit(""))) != ""
        answer = F.when(got, F.concat(F.lit("<pre>"), _shown("output"), F.lit("</pre>"))).otherwise(F.concat(F.lit("no answer: "), _shown(F.coalesce("error", F.lit("empty")))))
        parts.append(_table(firmware, FIRMWARE, "Firmware", ["Command", "Answer"], [_code("command"), answer], [F.col("command")], empty=None))
    n_gaps = (gaps if gaps is not None else catalog.limit(0)).agg(F.count("*").alias("gaps"))
    if mode == "compare":
        if complete:
            clean = F.when(F.col("gaps") > 0, F.lit('<p class="bad">The walk is complete, but the configuration holds commands that it did not find.</p>')).otherwise('<p class="good">The walk is complete and confirms no difference from the manuals.</p>')
            state = F.when(F.col("findings") > 0, F.lit("<p>The walk is complete. These are the differences.</p>")).otherwise(clean)
        else:
            state = F.lit('<p class="bad">The walk is incomplete: parts of the device were not seen, so what follows is not exhaustive.</p>')
        search = F.when(F.col("findings") > 0, F.lit('<input id="find" type="search" aria-label="Search commands and descriptions">'))
        both = sums.unionByName(n_gaps, allowMissingColumns=True).agg(F.max("findings").alias("findings"), F.max("gaps").alias("gaps"))
        parts.append(_says(both, STATE, [(0, state), (1, search)]))
        told = [_code("command"), F.when(F.trim(F.coalesce("description", F.lit(""))) == "", F.lit("-")).otherwise(_shown("description"))]
        says = escaped(F.lower(F.concat_ws(" ", "command", "description")))
        order = [F.col("command")]
        parts.append(_table(catalog.where("status = 'missing_on_device'"), MISSING, "Missing on the device", ["Command", "Description"], told, order, empty="No commands.", says=says))
        parts.append(_table(catalog.where("status = 'not_observed'"), UNSEEN, "Not observed", ["Command", "Description"], told, order, empty=None, says=says, note="The walk did not reach these branches; it can't be said that the device lacks them."))
    else:
        parts.append(_says(sums, STATE, [(0, f"<p>Mode {mode} compares nothing, so it can't tell what is missing.</p>")]))
    if coverage is not None:
        digits = F.round(F.col("coverage") * 10000).cast("long")
        share = F.format_string("%d.%02d%%", F.floor(digits / 100), digits % 100)
        cells = [_shown("device"), _shown("lines"), _shown(F.col("matched") + F.col("matched_elsewhere")), _shown("unmatched"), share]
        parts.append(_table(coverage, CONFIGURATION, "Configurations", ["Device", "Lines", "Explained", "Not in the catalog", "Share"], cells, [F.col("device")], empty="No configuration."))
    if gaps is not None:
        cells = [_shown("device"), _code("command"), _shown("occurrences")]
        parts.append(_table(gaps, GAPS, "Configured but not in the catalog", ["Device", "Command", "Lines"], cells, [F.col("device"), F.desc("occurrences"), F.col("command")], empty="Every configured line is explained."))
    if contexts is not None:
        path = F.when(F.size(F.coalesce("entry_path", F.array().cast("array<string>"))) > 0, F.array_join("entry_path", " / ")).otherwise("root")
        cells = [_code("fingerprint"), _shown(path), _shown("commands"), _shown(context_state(set(contexts.columns)))]
        parts.append(_table(contexts, CONTEXTS, "Contexts", ["Prompt", "Entered by", "Commands", "Walk"], cells, [F.col("name")], empty=None))
    if executed is not None:
        parts.append(_table(executed, EXECUTED, "Commands entered", ["Command"], [_code("command")], [F.col("n"), F.col("command")], empty="Nothing was entered; only help was asked for."))
    parts.append(_says(sums, FOOT, [(0, f"{_SEARCH}<footer>{generated_at}</footer></body></html>")]))
    page = parts[0]
    for more in parts[1:]:
        page = page.unionByName(more)
    return page


def write_report(lines: DataFrame, path: str) -> None:
    """The page as text files that give the whole when read by name."""
    lines.orderBy("section", "place").select("html").write.mode("overwrite").text(path)
