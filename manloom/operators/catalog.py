"""The command catalog: union of sources, reconciliation, absence proofs, merges and rollups.

A catalog is a table ``(command, description, executable, sources array<string>)``, one row per
command; ``enumerated(prefix)`` lists the nodes whose keywords were all listed by the device.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import placed

STATUSES = ("matched", "undocumented", "missing_on_device", "not_observed")


def source_union(entries: DataFrame) -> DataFrame:
    """``(command, description, executable, source, rank)`` of any number of sources -> catalog.
    The first description that isn't empty, by rank, stays; executable anywhere is executable."""
    held = F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.struct("rank", F.trim("description").alias("description")))
    return (
        entries.withColumn("command", T.one_spaced(F.col("command")))
        .where("command <> ''")
        .groupBy("command")
        .agg(F.min(held)["description"].alias("description"), F.bool_or(F.coalesce("executable", F.lit(False))).alias("executable"), F.array_sort(F.collect_set("source")).alias("sources"))
        .withColumn("description", F.coalesce("description", F.lit("")))
    )


def described(entries: DataFrame, preferred: str | None = None) -> DataFrame:
    """``(command, description, language, place)`` -> the description each command ends up with:
    the first in the preferred language, else the first at all, by ``place``."""
    told = entries.where("coalesce(description, '') <> ''")
    other = F.lit(1) if preferred is None else F.when(F.col("language") == preferred, 0).otherwise(1)
    return told.groupBy("command").agg(F.min_by(F.struct("description", "language"), F.struct(other, F.col("place"))).alias("best")).select("command", "best.*")


def on_device(sources: Column) -> Column:
    return F.array_contains(sources, "cli")


def documented(sources: Column) -> Column:
    return F.exists(sources, lambda s: s.startswith("documentation:"))


def prefixes(tokens: Column) -> Column:
    """Array of ``(n, prefix)`` for every leading run of tokens."""
    return F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(tokens, 1, n), " ").alias("prefix")))


def provably_absent(catalog: DataFrame, enumerated: DataFrame) -> DataFrame:
    """``(command, absent)``: walking down a command's words, did an enumerated node fail to list the
    next word on the device before the walk left enumerated ground?"""
    steps = catalog.select("command", F.explode(prefixes(T.words(F.col("command")))).alias("s")).select("command", "s.n", F.col("s.prefix").alias("child"))
    parent = F.when(F.col("n") == 1, "").otherwise(F.regexp_replace("child", " [^ ]+$", ""))
    listed = enumerated.select(F.col("prefix").alias("parent")).distinct().withColumn("asked", F.lit(True))
    device = catalog.where(on_device(F.col("sources"))).select(F.col("command").alias("child")).withColumn("seen", F.lit(True))
    walked = steps.withColumn("parent", parent).join(listed, "parent", "left").join(device, "child", "left")
    stop = F.when(F.col("asked").isNull(), F.struct("n", F.lit(False).alias("absent"))).when(F.col("seen").isNull(), F.struct("n", F.lit(True).alias("absent")))
    return walked.groupBy("command").agg(F.min(stop)["absent"].alias("absent")).select("command", F.coalesce("absent", F.lit(False)).alias("absent"))


def reconciled(catalog: DataFrame, *, complete: bool, absent: DataFrame | None = None) -> DataFrame:
    """Adds ``status``.  Commands only the documents know are missing where the scan was complete or
    their absence is proved, else merely not observed."""
    proof = F.lit(complete)
    if absent is not None:
        catalog = catalog.join(absent, "command", "left")
        proof = proof | F.coalesce("absent", F.lit(False))
    device, manual = on_device(F.col("sources")), documented(F.col("sources"))
    status = F.when(device & manual, "matched").when(device, "undocumented").when(proof, "missing_on_device").otherwise("not_observed")
    return catalog.withColumn("status", status).drop("absent")


def status_counts(catalog: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """``(status, n)`` with a row for every status, zero ones too."""
    spine = catalog.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return F.broadcast(spine).join(catalog.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ordered(catalog: DataFrame) -> DataFrame:
    """Fewest words first, then by text: the order in which catalogs are written."""
    return catalog.orderBy(F.size(T.words(F.col("command"))), "command")


def probe_order(commands: DataFrame, hints: list[str]) -> DataFrame:
    """Adds ``place`` (from 1): hinted head words first in their order, then shorter, then by text."""
    rank = reduce(lambda acc, ih: F.when(T.head_word(F.col("command")) == ih[1], ih[0]).otherwise(acc), reversed(list(enumerate(hints))), F.lit(len(hints)))
    keys = commands.withColumn("hint", rank).withColumn("n_words", F.size(T.words(F.col("command"))))
    return placed(keys, [F.col("hint"), F.col("n_words"), F.col("command")]).drop("hint", "n_words")


def merged_by_key(held: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Upsert: rows of ``new`` replace rows of ``held`` with the same key.  Nothing is deleted."""
    keys = [key] if isinstance(key, str) else key
    tagged = held.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)), allowMissingColumns=True)
    others = [c for c in tagged.columns if c not in (*keys, "_age")]
    best = tagged.groupBy(*keys).agg(F.min_by(F.struct(*others), "_age").alias("_row"))
    return best.select(*keys, "_row.*")


def merged_context(catalog: DataFrame, scanned: DataFrame, entry_path: list[str]) -> DataFrame:
    """A context's commands under its entry path, put together with the catalog's."""
    lead = "".join(f"{step} " for step in entry_path)
    moved = scanned.withColumn("command", F.concat(F.lit(lead), F.col("command")))
    both = catalog.withColumn("rank", F.lit(0)).unionByName(moved.withColumn("rank", F.lit(1)))
    return source_union(both.withColumn("source", F.explode("sources")).drop("sources"))


def scan_totals(contexts: DataFrame, *by: str) -> DataFrame:
    """Contexts, commands, queries, and complete only if there is one and all are: one row, or one
    for each value of ``by``."""
    return contexts.groupBy(*by).agg(
        F.count("*").alias("contexts"), F.coalesce(F.sum("commands"), F.lit(0)).cast("long").alias("commands"), F.coalesce(F.sum("queries"), F.lit(0)).cast("long").alias("queries"),
        F.coalesce(F.bool_and("complete"), F.lit(False)).alias("complete"),
    )


def commands_in(catalog: DataFrame, entry_path: list[str]) -> DataFrame:
    """Device commands below an entry path."""
    found = catalog.where(on_device(F.col("sources")))
    return found.where(F.col("command").startswith(" ".join(entry_path) + " ")) if entry_path else found


def commands_below(catalog: DataFrame, leads: DataFrame) -> DataFrame:
    """Device commands below any of the entry paths ``leads(lead)``; they meet on equal prefixes."""
    found = catalog.where(on_device(F.col("sources")))
    steps = found.select("*", F.explode(prefixes(T.words(F.col("command")))).alias("_s")).withColumn("lead", F.col("_s.prefix")).where("lead <> command")
    return steps.join(leads.select("lead"), "lead", "left_semi").select(*catalog.columns).dropDuplicates(["command"])


def scoped_merge(held: DataFrame, scanned: DataFrame, held_contexts: DataFrame, scanned_contexts: DataFrame, *, unexplained: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Commands, contexts and one row of totals after a scan of some contexts only.

    Commands and contexts of the new scan replace those of the same name, all others stay.  Totals
    are counted anew; the whole is complete only if every context is, there is one, and no
    configuration was left unexplained."""
    commands = merged_by_key(held, scanned, "command")
    contexts = merged_by_key(held_contexts, scanned_contexts, "name")
    device = commands.agg(F.count_if(on_device(F.col("sources"))).alias("device_commands"))
    totals = scan_totals(contexts.withColumn("commands", F.coalesce("commands", F.lit(0))))
    return commands, contexts, totals.join(F.broadcast(device)).withColumn("complete", F.col("complete") & F.lit(not unexplained))


def probes_within(candidates: DataFrame, hints: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """``(context, command)`` -> the first ``most`` commands to try of each context, in probing order
    (``place`` from 1), and ``(context, skipped)``: how many more there are."""
    rank = reduce(lambda acc, ih: F.when(T.head_word(F.col("command")) == ih[1], ih[0]).otherwise(acc), reversed(list(enumerate(hints))), F.lit(len(hints)))
    over = Window.partitionBy("context").orderBy(rank, F.size(T.words(F.col("command"))), "command")
    placed_ = candidates.withColumn("place", F.row_number().over(over))
    return placed_.where(F.col("place") <= most), placed_.groupBy("context").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("skipped"))


def token_tree(catalog: DataFrame) -> DataFrame:
    """``(prefix, parent, token, depth)``: one row per node of the commands' word tree."""
    nodes = catalog.select(F.explode(prefixes(T.words(F.col("command")))).alias("s")).select("s.prefix", F.col("s.n").alias("depth")).distinct()
    parent = F.when(F.col("depth") == 1, "").otherwise(F.regexp_replace("prefix", " [^ ]+$", ""))
    return nodes.select("prefix", parent.alias("parent"), F.element_at(F.split("prefix", " "), -1).alias("token"), "depth")


def systematic_sample(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Every ``step``-th row in order, ``limit`` of them, with ``step = max(1, n // limit)``."""
    n = rows.count()
    step = max(1, n // limit)
    numbered = placed(rows, [F.col(c) for c in order], "_n")
    return numbered.where(((F.col("_n") - 1) % step == 0) & (F.col("_n") <= step * limit)).drop("_n")


def first_per_group(rows: DataFrame, group: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of every group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def catalog_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(command, change)``: commands gone, new, or told differently between two catalogs."""
    b, a = before.select("command", F.col("description").alias("was")), after.select("command", F.col("description").alias("now"))
    change = F.when(F.col("now").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.col("now") != F.col("was"), "described differently")
    return b.join(a, "command", "full").select("command", change.alias("change")).where("change IS NOT NULL")
