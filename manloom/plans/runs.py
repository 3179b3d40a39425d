"""The runs: manuals to a catalog, a recorded device to a catalog, and the two held together."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.grammar import expand_syntax
from ..operators import catalog as C
from ..operators import config as G
from ..operators import crawl as W
from ..operators import manuals as M
from ..operators import marking as K
from ..operators import paged as Q
from ..operators import profiles as P
from ..operators import tables as B
from ..scratch import keep, placed
from ..sources import documents as D
from ..sources import recordings as R


@dataclass(frozen=True)
class CardProfile:
    """How a manual prints its cards: heading pattern, titles of their parts, and how regular a
    document must be to be read so."""

    heading: str = r"^#+\s*\d+(?:\.\d+)+\s+(.+?)\s*$"
    syntax: tuple[str, ...] = ("command syntax", "syntax", "format")
    parameters: tuple[str, ...] = ("parameters", "parameter", "parameter description")
    purpose: tuple[str, ...] = ("purpose", "function", "description", "command purpose")
    min_cards: int = 20
    min_share: float = 0.9

    def as_profile(self, name: str = "given") -> dict:
        """The same as a profile that is tried first, with the words of an English manual."""
        titles = lambda names: [t for n in names for t in dict.fromkeys((n, n.capitalize(), n.title()))]
        english = json.loads((P.BUILT_IN / "english.json").read_text(encoding="utf-8"))
        return english | {
            "name": name, "rank": -1, "heading": self.heading, "syntax_sections": titles(self.syntax), "parameter_sections": titles(self.parameters), "purpose_sections": titles(self.purpose),
            "min_cards": self.min_cards, "min_conforming": self.min_share,
        }


@dataclass
class Run:
    catalog: DataFrame
    totals: dict
    skipped: DataFrame | None = None
    coverage: DataFrame | None = None
    gaps: DataFrame | None = None
    records: DataFrame | None = None
    contexts: DataFrame | None = None
    executed: DataFrame | None = None
    firmware: DataFrame | None = None


def read_manuals(spark: SparkSession, root: str, profile: CardProfile | None = None, preferred: str | None = None, *, profiles: str | Path = P.BUILT_IN) -> Run:
    """All commands that the manuals below ``root`` document.

    Each document is tried with every profile of the folder ``profiles``, and with ``profile`` before
    them if it is given.  The first that it is regular enough for reads it card by card: welded words
    repaired, damaged tables read, its words told apart, its syntax expanded.  Any other document is
    read by its formats or line by line.  Those that gave nothing are listed with a reason.
    """
    told = P.profiles(spark, profiles)
    if profile is not None:
        told = told.unionByName(spark.createDataFrame([P.profile_row(profile.as_profile())], P.SCHEMA))
    files = D.scan_documents(spark, root)
    paragraphs = keep(D.docx_paragraphs(files), "paragraphs")  # word files are unpacked once
    ordered = D.reading_order(paragraphs.where("skipped IS NULL"), footer=r"^\s*\d+\s*$")
    texts = D.texts(files)
    lines = texts.select("doc", (F.col("suffix") == "txt").alias("plain"), F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("n", "line"))
    lines = keep(lines.unionByName(ordered.select("doc", F.lit(None).cast("boolean").alias("plain"), F.col("place").alias("n"), F.col("text").alias("line"))), "manual-lines")
    columns = ["doc", "name", "card", "command", "n", "part", "line", "had_syntax", "had_parameters"]
    by_page = Q.paged_cards(paragraphs.where("skipped IS NULL"), told)
    read = keep(P.cards_by_profile(lines, told).select(columns).unionByName(by_page.select(columns)), "cards")
    chosen = keep(P.picked(read, told), "chosen-profiles")
    words = chosen.join(F.broadcast(told), "name")
    parts = read.join(chosen, ["doc", "name"]).where("part <> 'heading'").select("doc", "card", "command", "n", "part", "line")
    forms = M.joined_wraps(parts.where("part = 'syntax'").select("doc", "card", "n", "line"), ["doc", "card"]).withColumn("line", T.command_form(F.col("line"))).where("line IS NOT NULL")
    heads = parts.groupBy("doc", "card").agg(F.min("command").alias("command"))
    syntax = _repaired(forms, parts).join(heads, ["doc", "card"]).select("doc", "card", "command", "n", F.lit("syntax").alias("part"), "line")
    whole = syntax.unionByName(parts.where("part = 'parameters'")).join(words.select("doc", "parameter_header", "header_tail"), "doc")
    whole = keep(whole, "card-lines")
    rows = keep(B.parameter_rows(whole, headerless=True), "parameter-rows")
    marked = K.marked_lines(whole, K.marks(whole, rows, words))
    purpose = M.purposes(parts)
    by_card = expand_syntax(marked, F.col("marked")).join(purpose, ["doc", "card"], "left").select("doc", (F.col("n") * 1000 + F.col("pos")).cast("long").alias("n"), "command", F.coalesce("description", F.lit("")).alias("description"))
    loose = lines.join(chosen, "doc", "left_anti").where("plain IS NOT NULL")
    formats = keep(M.structured_syntax(loose.where("plain").select("doc", "n", "line")), "formats")
    by_format = expand_syntax(formats, F.col("syntax")).select("doc", (F.col("n") * 1000 + F.col("pos")).cast("long").alias("n"), "command", F.lit("").alias("description"))
    loose = loose.join(formats.select("doc").distinct(), "doc", "left_anti")  # read by its formats instead
    by_line = M.line_commands(loose).select("doc", F.col("n").cast("long").alias("n"), "command", "description")
    toc = M.contents_commands(loose).select("doc", F.col("n").cast("long").alias("n"), "command", F.lit("").alias("description"))
    found = keep(by_card.unionByName(by_format).unionByName(by_line).unionByName(toc), "documented")
    written = F.when(F.col("description").rlike("[Ѐ-ӿ]"), "ru").otherwise("en")
    spoken = found.join(words.select("doc", F.nullif("language", F.lit("")).alias("language")), "doc", "left").select("command", "description", F.coalesce("language", written).alias("language"), F.struct("doc", "n").alias("place"))
    spoken = C.described(spoken, preferred)
    entries = found.select("command", F.lit("").alias("description"), F.lit(True).alias("executable"), F.concat(F.lit("documentation:"), F.col("doc")).alias("source"), F.lit(0).alias("rank"))
    catalog = C.source_union(entries).drop("description").join(spoken.select("command", "description"), "command", "left").withColumn("description", F.coalesce("description", F.lit("")))
    reasons = files.where("skipped IS NOT NULL").select(F.col("path").alias("doc"), "skipped").unionByName(paragraphs.where("skipped IS NOT NULL").select("doc", "skipped"))
    silent = files.where("skipped IS NULL").select(F.col("path").alias("doc")).join(found.select("doc").distinct(), "doc", "left_anti").join(reasons.select("doc"), "doc", "left_anti")
    return Run(catalog, {"complete": True, "queries": 0}, reasons.unionByName(silent.withColumn("skipped", F.lit("no commands found"))), records=K.card_records(whole, rows, K.marks(whole, rows, words)))


def _repaired(forms: DataFrame, parts: DataFrame) -> DataFrame:
    """Syntax lines with welded words split, each document its own dictionary."""
    words = forms.select("doc", F.posexplode(F.split("line", " ")).alias("i", "token"), "card", "n")
    counts = words.where("token <> ''").groupBy("doc", "token").agg(F.count("*").alias("seen"))
    heads = parts.select("doc", F.explode(F.split("command", " ")).alias("token")).distinct()
    fixes = M.weld_repairs(counts, headings=heads, by=("doc",)).select("doc", "token", "repaired")
    done = words.join(fixes, ["doc", "token"], "left").withColumn("token", F.coalesce("repaired", "token"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]), " ")
    return done.groupBy("doc", "card", "n").agg(line.alias("line"))


def read_device(help_rows: DataFrame, limits: W.Limits = W.Limits(), *, manuals: DataFrame | None = None, verify: int = 0, dumps: DataFrame | None = None, contexts: DataFrame | None = None) -> Run:
    """A device's recorded help as a catalog, against the manuals if they are given.

    Documented commands are held first, so that their descriptions stay; up to ``verify`` of them
    (0: all) are looked up by themselves.  Configuration that the catalog doesn't explain makes
    the run incomplete.
    """
    asked: DataFrame | list[str] = []
    if manuals is not None:
        asked = manuals.select("command").orderBy("command").limit(verify) if verify else manuals.select("command")
    walked = W.walk(help_rows, verify=asked, limits=limits)
    return _held_against(walked, manuals, dumps, contexts)


def _held_against(walked: W.Walk, manuals: DataFrame | None, dumps: DataFrame | None, contexts: DataFrame | None) -> Run:
    entries = walked.commands.select("command", "description", "executable", F.lit("cli").alias("source"), F.lit(1).alias("rank"))
    if manuals is not None:
        held = manuals.select("command", "description", F.lit(False).alias("executable"), F.explode("sources").alias("source"), F.lit(0).alias("rank"))
        entries = entries.unionByName(held)
    catalog = C.source_union(entries)
    totals = dict(walked.totals)
    coverage = gaps = None
    if dumps is not None:
        device = catalog.where(C.on_device(F.col("sources"))).select("command", F.col("command").alias("place"))
        views = G.view_prefixes(contexts if contexts is not None else dumps.sparkSession.createDataFrame([], "name string, entry_path array<string>"))
        matched = G.correlate(G.config_lines(dumps), device, views)
        coverage, gaps = G.coverage(matched), G.gaps(matched)
        totals["complete"] = totals["complete"] and gaps.isEmpty()
    if manuals is not None:
        catalog = C.reconciled(catalog, complete=totals["complete"], absent=C.provably_absent(catalog, walked.enumerated))
    else:
        catalog = catalog.withColumn("status", F.lit("present"))
    return Run(catalog, totals, None, coverage, gaps)


def read_recorded(
    spark: SparkSession, root: str, limits: W.Limits = W.Limits(), *, manuals: DataFrame | None = None, config_commands: list[str] = ("show running-config",), version_commands: list[str] = ("show version",),
    pattern: str | None = None, skim: bool = False,
) -> Run:
    """A device as raw recordings of its sessions show it, against the manuals if they are given.

    Contexts are those that recorded commands lead to from the prompt that most sessions begin with
    (ties: the first by text); their help is walked together.  Answers to ``config_commands`` are held
    against the catalog, those to ``version_commands`` are kept with identities redacted.  Recordings
    without any exchange are refused.
    """
    recording = R.read_recording(spark, root, pattern=pattern)
    executed = keep(recording.executed, "executed")
    asked = keep(recording.help_rows, "asked")
    begun = recording.exchanges.groupBy("session").agg(F.min_by("fingerprint", "n").alias("fingerprint")).where("fingerprint IS NOT NULL")
    first = begun.groupBy("fingerprint").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fingerprint").first()
    if first is None:
        raise ValueError(f"no session is recorded below {root}")
    leaves = F.lower(T.head_word(F.col("command"))).isin(*R.LEAVING)  # they lead back, into no new context
    found = W.discovered(executed.where(~leaves).drop("session"), first["fingerprint"], verbs=None, denied=[])
    again = F.row_number().over(Window.partitionBy("name").orderBy("place"))  # contexts are bounded in number
    contexts = found.contexts.withColumn("name", F.when(again == 1, F.col("name")).otherwise(F.concat("name", F.lit("~"), F.col("place").cast("string"))))
    contexts = keep(contexts, "contexts-named")
    up = F.slice("entry_path", 1, F.greatest(F.size("entry_path") - 1, F.lit(0)))
    child = contexts.where("depth > 0").select(up.alias("at"), F.element_at("entry_path", -1).alias("command"), F.col("name").alias("child"))
    probes = child.join(contexts.select(F.col("entry_path").alias("at"), F.col("name").alias("context")), "at").select("context", "command", F.lit("entered").alias("outcome"), "child")
    rows = asked.withColumn("key", T.context_key(F.col("fingerprint"), F.col("entry_path"))).join(contexts.select("key", F.col("name").alias("context")), "key").select("context", "prefix", "output")
    walked, per = W.walk_contexts(rows, contexts, probes, limits, skim=skim)
    dumps = recording.dumps(list(config_commands))
    run = _held_against(walked, manuals, keep(dumps, "dumps"), contexts)
    run.contexts = contexts.join(per, "name").select("name", "fingerprint", "entry_path", "commands", "complete")
    run.executed = placed(executed.select("session", "ord", "command"), [F.col("session"), F.col("ord")], "n").select("n", "command")
    versions = executed.where(F.col("command").isin(*version_commands)).select("session", F.col("command").alias("source_command"), F.col("answer").alias("output"))
    run.firmware = D.firmware(versions).select(F.col("source_command").alias("command"), "output", F.lit(None).cast("string").alias("error")).distinct()
    return run
