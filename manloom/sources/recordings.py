"""Raw recordings of terminal sessions, read as exchanges.

A recording is what a terminal showed: prompts with what was typed at them, and answers.  Files are
read by Spark's text reader, so they may lie in any store that it reaches and long ones are split.
An exchange is numbered by the prompts before it: those of its own split, and the counts of the
splits before.  So no task holds a whole session, and answers that cross splits come out whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import keep

#: A prompt at the start of a line: host, mode in brackets, level mark; then what was typed.
PROMPT_LINE = r"^([\w.-]+?)(\([^)]*\))?([#>$])(?:\s+(.*?))?\s*$"
#: Commands that leave a view.
LEAVING = ("exit", "end", "quit", "return", "disable", "logout")


@dataclass
class Recording:
    """``exchanges(session, n, prompt, fingerprint, typed, output, after)`` in the order recorded, and
    what was counted while they were read."""

    exchanges: DataFrame
    counts: dict[str, int]

    @property
    def located(self) -> DataFrame:
        """``exchanges`` with ``entry_path``: the command that last led to the prompt's mode in its session,
        going back apart; none where the session began so."""
        typed = T.one_spaced(F.col("typed"))
        command = F.when(~F.col("typed").rlike(r"\?$") & (typed != "") & ~F.col("shown_again"), typed)
        leaves = F.lower(T.head_word(typed)).isin(*LEAVING)
        leads = command.isNotNull() & F.col("after").isNotNull() & ~F.col("after").eqNullSafe(F.col("fingerprint")) & ~leaves
        own = self.exchanges.withColumn("command", command)
        steps = own.where(leads).select("session", "n", F.col("after").alias("fingerprint"), F.col("command").alias("step"))
        told = own.withColumn("real", F.lit(True)).unionByName(steps, allowMissingColumns=True)
        before = Window.partitionBy("session", "fingerprint").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
        told = told.withColumn("step", F.last("step", ignorenulls=True).over(before)).where("real")
        path = F.when(F.col("step").isNull(), F.array().cast("array<string>")).otherwise(F.array("step"))
        return told.withColumn("entry_path", path).drop("real", "step")

    @property
    def help_rows(self) -> DataFrame:
        """``(session, fingerprint, entry_path, prefix, output)``: answers to a question mark that stands
        by itself."""
        asked = self.located.where(F.col("typed").rlike(r"(?:^|\s)\?$"))
        return asked.select("session", "fingerprint", "entry_path", T.one_spaced(F.regexp_replace("typed", r"\?$", "")).alias("prefix"), "output")

    @property
    def executed(self) -> DataFrame:
        """``(session, ord, fingerprint, entry_path, command, answer, after)``: commands that were entered,
        as ``crawl.discovered`` takes them.  A session that ends within an answer has no ``after``.  A
        prompt line that only shows again what stood before a question mark is no command."""
        done = self.located.where("command IS NOT NULL")
        return done.select("session", F.col("n").alias("ord"), "fingerprint", "entry_path", "command", F.col("output").alias("answer"), "after")

    def dumps(self, commands: list[str]) -> DataFrame:
        """``(device, source_command, output)``: answers to the commands that show a configuration; of
        several in a session the last of the command named first."""
        turn = F.array_position(F.array(*[F.lit(c) for c in commands]), F.col("command"))
        found = self.executed.where(F.col("command").isin(*commands))
        return found.groupBy(F.col("session").alias("device")).agg(F.min_by(F.struct(F.col("command").alias("source_command"), F.col("answer").alias("output")), F.struct(turn, -F.col("ord"))).alias("d")).select("device", "d.*")


def _part(of: int) -> Column:
    return F.regexp_extract("line", PROMPT_LINE, of)


def read_recording(spark: SparkSession, root: str, *, pattern: str | None = None) -> Recording:
    """The recordings below ``root``, each file a session named by its path below it.

    ``pattern`` picks files by name.  A prompt is known by its host, the one that most lines of the
    session begin with (ties: the first), so lines of answers that look like another host's stay in
    their answers.  Lines before
    the first prompt belong to no exchange; a prompt that nothing follows only tells where the one
    before it led.  Control sequences, carriage returns and backspaces are applied to each line.
    An empty folder gives an empty table.  Counted are lines, prompts and lines before a prompt.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    raw = reader.text(root).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), T.terminal_cleaned(F.col("value")).alias("line"))
    lines = keep(raw.withColumn("host", F.when(F.col("line").rlike(PROMPT_LINE), _part(1))), "recorded-lines")
    named = lines.where("host IS NOT NULL").groupBy("path", "host").agg(F.count("*").alias("times"), F.min(F.struct("block", "at")).alias("first"))
    hosts = named.groupBy("path").agg(F.min_by("host", F.struct(-F.col("times"), F.col("first"))).alias("own"))
    lines = lines.join(hosts, "path", "left").withColumn("asks", F.coalesce(F.col("host") == F.col("own"), F.lit(False)))
    within = Window.partitionBy("path", "block").orderBy("at")
    numbered = lines.withColumn("k", F.count_if("asks").over(within))
    sums = lines.groupBy("path", "block").agg(F.count_if("asks").alias("asked"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    shifts = sums.select("path", "block", F.coalesce(F.sum("asked").over(earlier), F.lit(0)).alias("shift"))
    numbered = numbered.join(shifts, ["path", "block"]).withColumn("n", F.col("k") + F.col("shift"))
    told = F.struct("block", "at", F.col("line").alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("asks"), told))), lambda x: x["line"]), "\n")
    head = F.max(F.when(F.col("asks"), F.col("line")))
    groups = numbered.groupBy("path", "n").agg(head.alias("line"), body.alias("output"), F.count_if(~F.col("asks")).alias("answered"))
    prompt = F.concat(_part(1), _part(2), _part(3))
    shown = groups.select("path", "n", prompt.alias("prompt"), T.fingerprint(prompt).alias("fingerprint"), _part(4).alias("typed"), "output", "answered")
    shown = keep(shown, "recorded-exchanges")
    sums = {"lines": F.sum(F.col("answered") + (F.col("n") > 0).cast("int")), "prompts": F.count_if(F.col("n") > 0), "before_prompt": F.sum(F.when(F.col("n") == 0, F.col("answered")))}
    counts = shown.agg(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in sums.items()]).first().asDict()
    shown = shown.where("n > 0")
    following = shown.select("path", (F.col("n") - 1).alias("n"), F.col("fingerprint").alias("after"))
    asked = shown.where(F.col("typed").rlike(r"(?:^|\s)\?$")).select("path", (F.col("n") + 1).alias("n"), T.one_spaced(F.regexp_replace("typed", r"\?$", "")).alias("asked_below"))
    told = shown.join(following, ["path", "n"], "left").join(asked, ["path", "n"], "left")
    again = (F.col("answered") == 0) & (T.one_spaced(F.col("typed")) == F.col("asked_below"))
    told = told.where(F.col("after").isNotNull() | (F.col("answered") > 0)).withColumn("shown_again", F.coalesce(again, F.lit(False)))
    session = F.regexp_replace(F.replace(F.col("path"), F.lit(_qualified(spark, root)), F.lit("")), "^/+", "")
    exchanges = told.select(session.alias("session"), "n", "prompt", "fingerprint", "typed", "output", "after", "shown_again")
    return Recording(keep(exchanges, "exchanges"), counts)


def _qualified(spark: SparkSession, root: str) -> str:
    """The folder as the reader names it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    where = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return where.replace("file:///", "file:/") if where.startswith("file:///") else where
