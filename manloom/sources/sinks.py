"""Catalogs and reports written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C


def write_catalog(catalog: DataFrame, path: str, form: str = "json") -> None:
    """All commands in catalog order, one record each."""
    C.ordered(catalog).write.mode("overwrite").format(form).save(path)


def human_list(catalog: DataFrame, mode: str) -> DataFrame:
    """``(command, description)`` in order: what the device has, or for ``docs`` what manuals tell."""
    wanted = C.documented(F.col("sources")) if mode == "docs" else C.on_device(F.col("sources"))
    return catalog.where(wanted).select("command", "description").orderBy("command")


def escaped(text: Column) -> Column:
    """Text for HTML."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def html_rows(catalog: DataFrame) -> DataFrame:
    """One table row of HTML per command, escaped, to be framed by whoever shows them."""
    cells = [escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("command", "status", "description")]
    return C.ordered(catalog).select(F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>")).alias("html"))


def block_markdown(blocks: DataFrame) -> DataFrame:
    """``(name, entry_path, commands, complete, listed, more)`` -> ``(name, file, markdown)``: one
    report per context."""
    state = F.when(F.col("complete"), "parsed").when(F.col("commands") > 0, "topped").otherwise("unknown")
    rows = F.array_join(F.transform("listed", lambda c: F.concat(F.lit("- `"), c, F.lit("`"))), "\n")
    rest = F.when(F.col("more") > 0, F.concat(F.lit("\n- and "), F.col("more").cast("string"), F.lit(" more"))).otherwise("")
    label = T.block_label(F.col("name"))
    entry = F.when(F.size("entry_path") > 0, F.array_join("entry_path", " / ")).otherwise("-")
    text = F.concat(F.lit("# "), label, F.lit("\n\n- context: `"), F.col("name"), F.lit("`\n- entered by: `"), entry, F.lit("`\n- state: "), state, F.lit("\n\n## Commands\n\n"), rows, rest, F.lit("\n"))
    return blocks.select("name", F.concat(T.safe_name(label), F.lit(".md")).alias("file"), text.alias("markdown"))


def config_tree(matched: DataFrame) -> DataFrame:
    """``(device, seq, depth, label, status)``: the configuration as an annotated tree in order.
    Lines that repeat under one view carry their number."""
    from pyspark.sql import Window

    same = Window.partitionBy("device", "path").orderBy("seq")
    label = F.when(F.row_number().over(same) > 1, F.concat("text", F.lit(" (line "), F.col("number").cast("string"), F.lit(")"))).otherwise(F.col("text"))
    return matched.select("device", "seq", (F.size("path") - 1).alias("depth"), label.alias("label"), "status")


def read_catalog(spark, path: str, form: str = "json") -> DataFrame | None:
    """A written catalog, or None where there is none that can be read."""
    from pyspark.errors import AnalysisException

    try:
        held = spark.read.format(form).load(path)
    except AnalysisException:
        return None
    return held if {"command", "description"} <= set(held.columns) else None


def _yaml_key(text: Column) -> Column:
    """A mapping key: as it stands where YAML reads that as a string, else in double quotes."""
    plain = text.rlike(r"^[A-Za-z_][A-Za-z0-9_./-]*$") & ~F.lower(text).isin("y", "n", "yes", "no", "on", "off", "true", "false", "null")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(plain, text).otherwise(quoted)


def tree_lines(catalog: DataFrame, mode: str = "audit") -> DataFrame:
    """``(path, line)``: the commands' words as a nested YAML mapping, one node a line.

    Sorted by path a node stands right before what is below it, so a tree of any size is written by
    sorting: no node gathers its children.
    """
    wanted = C.documented(F.col("sources")) if mode == "docs" else C.on_device(F.col("sources"))
    nodes = C.token_tree(catalog.where(wanted)).select(F.split("prefix", " ").alias("path"), "token")
    return nodes.select("path", F.concat(F.repeat(F.lit("  "), F.size("path") - 1), _yaml_key(F.col("token")), F.lit(":")).alias("line"))


def config_lines_yaml(matched: DataFrame) -> DataFrame:
    """``(device, seq, line)``: configurations nested as their views are, in their own order; lines
    that the catalog doesn't explain are remarked on in place."""
    told = config_tree(matched)
    remark = F.when(F.col("status") == "unmatched", "  # not in the catalog").otherwise("")
    return told.select("device", "seq", F.concat(F.repeat(F.lit("  "), F.col("depth")), _yaml_key(F.col("label")), F.lit(":"), remark).alias("line"))


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """The lines as text files that give the whole when read by name."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
