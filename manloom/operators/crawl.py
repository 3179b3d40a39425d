"""Walking a help tree from recorded answers, level by level.

The answers are a table; a level of the walk is one join of the frontier with it.  Nodes whose
options look exactly like those of an earlier node of the same context are not walked again: their
subtrees are copied afterwards.  Where answers are recorded below both, only equal ones make nodes
alike; a sample of the copies is held against what is recorded below them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import keep, placed
from .catalog import prefixes
from .contexts import probe_outcomes
from .help import parse_help, signatures

_NODE = "catalog_prefix string, query_prefix string, expand boolean, ord string"


@dataclass(frozen=True)
class Limits:
    """Bounds of a walk, and what it types for placeholders."""

    max_depth: int = 12
    max_queries: int = 1_000_000
    explore_parameters: bool = True
    samples: dict[str, str] = field(default_factory=dict)
    denied: tuple[str, ...] = ()
    deduplicate: bool = True
    prefer_recorded: bool = True
    max_copies: int = 1_000_000
    copy_passes: int = 8
    verify_samples: int = 20
    undescribed: bool = False
    error_words: bool = False

    @classmethod
    def checked(cls, given: dict) -> Limits:
        """Limits from a mapping such as a parsed settings file.  Unknown names, wrong types, bounds
        below 1 (samples and copies: 0) and samples that can't be typed are refused."""
        known = {f.name: f for f in fields(cls)}
        if unknown := sorted(set(given) - set(known)):
            raise ValueError(f"unknown limits: {', '.join(unknown)}")
        out = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
        for name in known:
            value, kind = getattr(out, name), type(getattr(cls(), name))
            if type(value) is not kind:
                raise ValueError(f"{name} must be of type {kind.__name__}")
            if kind is int and value < (0 if name in ("verify_samples", "max_copies") else 1):
                raise ValueError(f"{name} is too small: {value}")
        if bad := sorted(k for k, v in out.samples.items() if not (isinstance(v, str) and v.isascii() and v.isprintable() and v.strip() and "?" not in v)):
            raise ValueError(f"samples that can't be typed: {', '.join(bad)}")
        return out


@dataclass
class Walk:
    """``commands(command, description, executable, sources)``, ``children(command, child)``,
    ``enumerated(prefix)``, ``derived(prefix, canonical)`` and the totals of a walk, and
    ``skipped(token, n)``, the placeholders that nothing could be typed for."""

    commands: DataFrame
    children: DataFrame
    enumerated: DataFrame
    derived: DataFrame
    totals: dict
    skipped: DataFrame | None = None


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def seed_nodes(spark, seeds: DataFrame | list[str], verify: DataFrame | list[str], limits: Limits) -> tuple[DataFrame, DataFrame]:
    """Frontier rows of commands to walk below, and to look at only; and the placeholders among
    them that nothing can be typed for.  A table of commands, ``(command)``, is taken in their order
    and stays a table."""

    def numbered(part: DataFrame | list[str], expand: bool) -> DataFrame:
        if isinstance(part, DataFrame):
            told = placed(part.select(F.col("command").alias("seed")).distinct(), [F.col("seed")], "n").select("seed", F.col("n").cast("long").alias("n"))
        else:
            told = spark.createDataFrame([(s, i) for i, s in enumerate(part)], "seed string, n long")
        return told.withColumn("expand", F.lit(expand))

    told = numbered(seeds, True).unionByName(numbered(verify, False)).withColumn("tokens", T.words(F.col("seed"))).where("size(tokens) > 0")
    sample = lambda t: F.when(F.lit(limits.explore_parameters), T.parameter_sample(t, limits.samples))
    typed = F.transform("tokens", lambda t: F.when((T.option_kind(t) != "parameter") & T.parameter_sample(t, limits.samples).isNull(), t).otherwise(sample(t)))
    told = told.withColumn("typed", typed).withColumn("blocked", F.filter(F.zip_with("tokens", "typed", lambda t, q: F.when(q.isNull() | ~T.is_safe_fragment(q), t)), lambda x: x.isNotNull()))
    order = F.concat(F.when(F.col("expand"), "1").otherwise("2"), F.lpad(F.col("n").cast("string"), 12, "0"))
    nodes = told.where("size(blocked) = 0").select(F.array_join("tokens", " ").alias("catalog_prefix"), F.array_join("typed", " ").alias("query_prefix"), "expand", order.alias("ord"))
    return nodes, told.where("size(blocked) > 0").select(F.col("blocked")[0].alias("token"))


def subtree_marks(shapes: DataFrame) -> DataFrame:
    """``(prefix, deep)``: one mark for all that was recorded below a prefix: how many answers, and the
    sum without carry of their relative paths' and shapes' hashes; prefixes with nothing below have
    none.  The state of a prefix is three numbers, whatever stands below it."""
    below = shapes.select("prefix", "signature", F.explode(prefixes(T.words(F.col("prefix")))).alias("p")).select("prefix", "signature", F.col("p.prefix").alias("above")).where("above <> prefix")
    below = below.withColumn("rest", F.expr("substring(prefix, length(above) + 1)"))
    marks = below.groupBy(F.col("above").alias("prefix")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rest", "signature")).alias("x"), F.bit_xor(F.xxhash64("signature", "rest")).alias("y"))
    return marks.select("prefix", F.concat_ws(":", "n", "x", "y").alias("deep"))


def walk(help_rows: DataFrame, seeds: DataFrame | list[str] = (), verify: DataFrame | list[str] = (), limits: Limits = Limits(), *, include_root: bool = True, by_first_word: bool = False) -> Walk:
    """``help_rows(prefix, output)``: the answer to each query prefix; of several to one, the least.

    Ordinary branches go first, then seeds, then top-level negations.  A node at ``max_depth``
    words is not asked; denied words, option flags and placeholders without a sample are
    catalogued but not entered.  The walk is complete only if nothing was skipped, cut or found
    to differ.

    A node that looks like an earlier one is not walked but gets a copy of what stands below that,
    unless answers are recorded below both that differ (``limits.prefer_recorded``).  With
    ``by_first_word`` only nodes of the same first word are alike, as those of one context are.
    """
    spark = help_rows.sparkSession
    answers = help_rows.select(T.one_spaced(F.col("prefix")).alias("prefix"), "output").groupBy("prefix").agg(F.min("output").alias("output"))
    options = keep(parse_help(answers, undescribed=limits.undescribed, error_words=limits.error_words, spread=False), "help-options")
    shapes = signatures(options)
    if limits.deduplicate:
        shapes = keep(shapes, "help-shapes")
        shapes = keep(shapes.join(subtree_marks(shapes), "prefix", "left"), "help-subtrees")
    planted, blocked = seed_nodes(spark, seeds, verify, limits)
    root = spark.createDataFrame([("", "", True, "0")] if include_root else [], _NODE)
    has_seeds = any(isinstance(p, DataFrame) or len(p) > 0 for p in (seeds, verify))
    phases = ([root] if include_root else []) + ([planted] if has_seeds else [])
    firsts = None  # the nodes that others are copied from
    visited: list[tuple[int, int, DataFrame]] = []  # least and greatest depth, and the nodes
    seen, children, enumerated, derived, skipped, refused = [], [], [], [], [blocked], []
    queries = skipped_depth = pending = level = 0
    keys = ["catalog_prefix", "query_prefix"]
    while phases:
        frontier, phases = phases[0], phases[1:]
        while True:
            fresh = frontier.groupBy(*keys).agg(F.min_by("expand", "ord").alias("expand"), F.min("ord").alias("ord")).withColumn("depth", F.size(T.words(F.col("catalog_prefix"))))
            fresh, within = keep(fresh, "frontier"), F.col("depth") < limits.max_depth
            sums = [F.min("depth").alias("least"), F.max("depth").alias("most"), F.count_if(~within).alias("deep"), F.count_if(within).alias("n")]
            told = fresh.agg(*sums).first()
            if told["least"] is None:
                break
            met = [v for low, high, v in visited if low <= told["most"] and told["least"] <= high]  # a node has the depth of its words
            if met:
                fresh = keep(fresh.join(_all(met).select(*keys), keys, "left_anti"), "frontier")
                told = fresh.agg(*sums).first()
            skipped_depth += told["deep"]
            todo, n = fresh.where(within), told["n"]
            if n == 0:
                break
            if queries + n > limits.max_queries:
                room = limits.max_queries - queries
                pending += n - room
                todo = placed(todo, [F.col("ord"), F.col("catalog_prefix"), F.col("query_prefix")]).where(F.col("place") <= room).drop("place")
                n = room
            if n == 0:
                break
            queries += n
            visited.append((told["least"], told["most"], todo))
            asked = todo.withColumn("copied", F.lit(False))
            if limits.deduplicate:
                asked, firsts = _copied(todo, shapes, firsts, level, limits, by_first_word)
                derived.append(asked.where("copied").select(F.col("catalog_prefix").alias("prefix"), "canonical", "query_prefix", "deep", "canonical_deep"))
            level += 1
            told = keep(asked.select(*keys, "expand", "ord", "copied").join(options.withColumnRenamed("prefix", "query_prefix"), "query_prefix"), "told")
            below = F.trim(F.concat_ws(" ", "catalog_prefix", "token"))
            parent = told.where("catalog_prefix <> ''").groupBy(F.col("catalog_prefix").alias("command")).agg(
                F.max(F.when(F.col("kind") == "cr", F.col("description"))).alias("description"), F.bool_or(F.col("kind") == "cr").alias("executable")
            )
            open_nodes = told.where("expand AND NOT copied")
            listed = open_nodes.where((F.col("kind") != "cr") & T.is_safe_fragment(F.col("token"))).withColumn("child", below)
            seen += [parent.withColumn("ord", F.lit("~")), listed.select(F.col("child").alias("command"), "description", F.lit(False).alias("executable"), "ord")]
            children.append(listed.where("catalog_prefix <> ''").select(F.col("catalog_prefix").alias("command"), "child").distinct())
            enumerated.append(open_nodes.select(F.col("catalog_prefix").alias("prefix")).distinct())
            is_denied = F.lower("token").isin(*[d.lower() for d in limits.denied]) if limits.denied else F.lit(False)
            refused.append(listed.where(is_denied).select("token"))
            typed = F.when(F.col("kind") != "parameter", F.col("token")).otherwise(F.when(F.lit(limits.explore_parameters), T.parameter_sample(F.col("token"), limits.samples)))
            entered = listed.where(~is_denied & ~T.is_option_flag(F.col("token"))).withColumn("typed", F.when(T.is_safe_fragment(typed), typed))
            skipped.append(entered.where("typed IS NULL").select("token"))
            order = F.concat("ord", F.lit("."), F.lpad(F.col("pos").cast("string"), 6, "0"))
            step = entered.where("typed IS NOT NULL").select(F.col("child").alias("catalog_prefix"), F.trim(F.concat_ws(" ", "query_prefix", "typed")).alias("query_prefix"), F.lit(True).alias("expand"), order.alias("ord"))
            if include_root and level == 1:  # negations at the top wait for all the rest
                mirror = F.col("catalog_prefix").isin(*T.NEGATIONS)
                phases.append(step.where(mirror))
                step = step.where(~mirror)
            frontier = step
            if pending:
                break
        if pending:
            pending += frontier.count()
            break
    empty = spark.createDataFrame([], "command string, description string, executable boolean, ord string")
    entries = _all([empty, *seen])
    text = F.when(F.coalesce(F.trim("description"), F.lit("")) != "", F.struct("ord", F.trim("description").alias("d")))
    commands = keep(entries.groupBy("command").agg(F.coalesce(F.min(text)["d"], F.lit("")).alias("description"), F.bool_or("executable").alias("executable")), "walked")
    copies_of = spark.createDataFrame([], "prefix string, canonical string, query_prefix string, deep string, canonical_deep string")
    added = verified = mismatched = n_derived = 0
    truncated = False
    if derived:
        copies_of = keep(_all([copies_of, *derived]).groupBy("prefix").agg(F.min(F.struct("canonical", "query_prefix", "deep", "canonical_deep")).alias("v")).select("prefix", "v.*"), "derived")
        n_derived = copies_of.count()
        if n_derived:
            commands, added, truncated = replicate(commands, copies_of, limits)
            verified, mismatched = verify_copies(copies_of, limits)
    skipped = keep(_all(skipped).groupBy("token").agg(F.count("*").alias("n")), "skipped")
    n_skipped, n_refused = skipped.count(), _all(refused).count() if limits.denied and refused else 0
    totals = {
        "queries": queries + verified, "derived": n_derived, "copied": added, "copies_truncated": truncated, "verified": verified, "mismatched": mismatched,
        "skipped_depth": skipped_depth, "skipped_denied": n_refused, "skipped_parameters": n_skipped, "pending": pending,
        "complete": not (pending or skipped_depth or n_refused or n_skipped or mismatched or truncated),
    }
    kids = _all([spark.createDataFrame([], "command string, child string"), *children]).distinct()
    listed = _all([spark.createDataFrame([], "prefix string"), *enumerated]).distinct()
    return Walk(commands.withColumn("sources", F.array(F.lit("cli"))), kids, listed, copies_of.select("prefix", "canonical"), totals, skipped)


def _copied(todo: DataFrame, shapes: DataFrame, firsts: DataFrame | None, level: int, limits: Limits, by_first_word: bool) -> tuple[DataFrame, DataFrame]:
    """The nodes of a level with ``canonical`` and whether they are ``copied`` from it, and the table
    of first nodes brought up to date.

    A node's key is its shape, and its context's mark if contexts are kept apart.  A node with
    answers recorded below it is alike a first node with the same below; one without any is alike
    the first node of its shape that has some.
    """
    asked = todo.join(shapes.withColumnRenamed("prefix", "query_prefix"), "query_prefix", "left")
    scope = F.regexp_extract("catalog_prefix", r"^(\S*)", 1) if by_first_word else F.lit("")
    key = F.when(F.col("expand") & F.coalesce("expandable", F.lit(False)), F.concat_ws(" ", scope, "signature"))
    asked = asked.withColumn("key", key).withColumn("below", F.coalesce("deep", F.lit("")) if limits.prefer_recorded else F.lit(""))
    asked = keep(asked.select("catalog_prefix", "query_prefix", "expand", "ord", "depth", "key", "below", "deep"), "asked")
    first = F.struct(F.lit(level).alias("level"), "ord", F.col("catalog_prefix").alias("canonical"), "deep")
    own = asked.where("key IS NOT NULL").groupBy("key", "below").agg(F.min(first).alias("first"))
    firsts = keep(own if firsts is None else firsts.unionByName(own).groupBy("key", "below").agg(F.min("first").alias("first")), "first-nodes")
    bare = firsts.groupBy("key").agg(F.min_by("first", F.struct(F.col("below") == "", F.col("first"))).alias("first")).withColumn("below", F.lit(""))
    found = firsts.where("below <> ''").unionByName(bare).select("key", "below", F.col("first.canonical").alias("canonical"), F.col("first.deep").alias("canonical_deep"))
    apart = F.coalesce("key", F.concat(F.lit("\n"), "catalog_prefix"))  # nodes without a key lie spread out
    asked = asked.withColumn("key", apart).join(found, ["key", "below"], "left")
    return asked.withColumn("copied", F.coalesce(F.col("canonical") != F.col("catalog_prefix"), F.lit(False))), firsts


def replicate(commands: DataFrame, copies_of: DataFrame, limits: Limits) -> tuple[DataFrame, int, bool]:
    """Copies what stands below each canonical node to the nodes that look like it, again while
    that adds anything.  Subtrees meet their nodes on equal prefixes, not by ranges."""
    added, truncated = 0, False
    if copies_of.isEmpty():
        return commands, 0, False
    for _ in range(limits.copy_passes):
        below = commands.select("command", "description", "executable", F.explode(prefixes(T.words(F.col("command")))).alias("p")).select("command", "description", "executable", F.col("p.prefix").alias("canonical")).where("canonical <> command")
        copy = F.concat("prefix", F.expr("substring(command, length(canonical) + 1)"))
        new = below.join(copies_of.select("prefix", "canonical"), "canonical").withColumn("copy", copy).where(F.size(T.words(F.col("copy"))) <= limits.max_depth)
        new = new.groupBy(F.col("copy").alias("command")).agg(F.min_by(F.struct("description", "executable"), "command").alias("v")).select("command", "v.*").join(commands.select("command"), "command", "left_anti")
        new = keep(new, "copies")
        n = new.count()
        if added + n >= limits.max_copies:
            new = placed(new, [F.col("command")]).where(F.col("place") <= limits.max_copies - added).drop("place")
            n, truncated = limits.max_copies - added, True
        commands, added = commands.unionByName(new), added + n  # parts that are written
        if n == 0 or truncated:
            break
    return commands, added, truncated


def verify_copies(copies_of: DataFrame, limits: Limits) -> tuple[int, int]:
    """How many copied nodes were looked at, spread over all, and how many of them have answers
    recorded below that aren't those below their canonical node."""
    n = copies_of.count()
    if not n or not limits.verify_samples:
        return 0, 0
    step = max(1, n // limits.verify_samples)
    spread = placed(copies_of, [F.col("prefix")]).where(((F.col("place") - 1) % step == 0) & (F.col("place") <= step * limits.verify_samples))
    differs = F.col("deep").isNotNull() & ~F.col("deep").eqNullSafe(F.col("canonical_deep"))
    r = spread.agg(F.count("*").alias("n"), F.count_if(differs).alias("bad")).first()
    return r["n"], r["bad"]


@dataclass
class Discovery:
    """``contexts(name, fingerprint, entry_path, key, depth, place)`` in the order found,
    ``probes(name, command, outcome)`` that were looked at, and how many were left out by the bound."""

    contexts: DataFrame
    probes: DataFrame
    skipped: int


def discovered(
    recorded: DataFrame, root_fingerprint: str = "#", *, denied: list[str] = T.DENIED_PROBES, verbs: list[str] | None = T.VIEW_VERBS, focus: list[str] | None = None,
    descend: bool = True, most_probes: int = 200, max_contexts: int = 64, max_depth: int = 16,
) -> Discovery:
    """The contexts that recorded probes lead to from the root, breadth first.

    ``recorded(fingerprint, entry_path, ord, command, answer, after)`` are probes typed in contexts,
    told apart by their prompt and the steps that led to them; ``after`` is the fingerprint of the
    prompt that followed, null where the session was lost.  Contexts whose prompt and last step
    differ in numbers only are one, that found first.  Tried are commands without denied words
    whose first word is among ``verbs`` (None: any), at the root among ``focus`` if given, in
    their order and at most ``most_probes`` a context.  Without ``descend`` what the root opens is
    recorded but not entered.
    """
    spark = recorded.sparkSession
    path = F.coalesce("entry_path", F.array().cast("array<string>"))
    typed = recorded.select(T.context_key(F.col("fingerprint"), path).alias("key"), path.alias("at"), "fingerprint", "ord", "command", "answer", "after")
    head = T.head_word(F.col("command"))
    typed = typed.where(T.is_probe_allowed(F.col("command"), denied) & (head.isin(*verbs) if verbs is not None else F.lit(True)))
    typed = typed.groupBy("key", "command").agg(F.min(F.struct("at", "ord", "fingerprint", "answer", "after")).alias("p")).select("key", "command", F.col("p.ord").alias("ord"), F.col("p.fingerprint").alias("before"), F.col("p.answer").alias("answer"), F.col("p.after").alias("after"))
    typed = keep(probe_outcomes(typed), "probes-recorded")
    root = spark.createDataFrame([("root", root_fingerprint, [], 0, 1)], "name string, fingerprint string, entry_path array<string>, depth int, place long")
    found = level = keep(root.withColumn("key", T.context_key(F.col("fingerprint"), F.col("entry_path"))), "contexts-found")
    seen, tried, skipped = 1, [], 0
    for depth in range(1, max_depth + 1):
        open_ = level.join(typed, "key")
        if focus and depth == 1:
            open_ = open_.where(head.isin(*[v.lower() for v in focus]))
        ranked = keep(open_.withColumn("turn", F.row_number().over(Window.partitionBy("name", "key").orderBy("ord", "command"))), "probes-tried")
        skipped += ranked.where(F.col("turn") > most_probes).count()
        ranked = ranked.where(F.col("turn") <= most_probes)
        tried.append(ranked.select("name", "command", "outcome"))
        if not descend:
            break
        steps = F.concat("entry_path", F.array("command"))
        child = ranked.where("outcome = 'entered'").select(F.concat("name", F.lit("/"), F.split("command", " ")[0]).alias("name"), F.col("after").alias("fingerprint"), steps.alias("entry_path"), F.lit(depth).alias("depth"), F.col("place").alias("up"), "turn")
        child = child.withColumn("key", T.context_key(F.col("fingerprint"), F.col("entry_path"))).join(found.select("key"), "key", "left_anti")
        first = child.groupBy("key").agg(F.min(F.struct("up", "turn", "name", "fingerprint", "entry_path", "depth")).alias("c")).select("key", "c.*")
        level = placed(first, [F.col("up"), F.col("turn"), F.col("key")]).where(F.col("place") <= max_contexts - seen).withColumn("place", F.col("place") + seen)
        level = keep(level.select("name", "fingerprint", "entry_path", "depth", "place", "key"), "contexts-level")
        n = level.count()
        if n == 0:
            break
        found, seen = keep(found.unionByName(level), "contexts-found"), seen + n
    return Discovery(found, _all(tried), skipped)


def reachable(contexts: DataFrame, probes: DataFrame, *, root: str = "root", max_contexts: int = 1000, max_depth: int = 16) -> DataFrame:
    """``(name, depth)``: contexts that probes lead to from the root, nearest first, up to a number.

    ``probes(context, command, outcome, child)``; only entered ones lead on."""
    edges = keep(probes.where("outcome = 'entered'").select(F.col("context").alias("name"), "child").distinct(), "context-edges")
    level = contexts.where(F.col("name") == root).select("name")
    found = keep(level.withColumn("depth", F.lit(0)), "contexts-found")
    for depth in range(1, max_depth):
        level = level.join(edges, "name").select(F.col("child").alias("name")).distinct().join(contexts.select("name"), "name", "left_semi").join(found.select("name"), "name", "left_anti")
        level = keep(level, "contexts-level")
        if level.isEmpty():
            break
        found = keep(found.unionByName(level.withColumn("depth", F.lit(depth))), "contexts-found")
    return found.orderBy("depth", "name").limit(max_contexts)


def walk_contexts(help_rows: DataFrame, contexts: DataFrame, probes: DataFrame, limits: Limits = Limits(), *, root: str = "root", max_contexts: int = 1000, skim: bool = False) -> tuple[Walk, DataFrame]:
    """Walks the help of every reachable context at once: ``help_rows(context, prefix, output)``.

    Returns the walk, its commands led by their context's entry path, and ``(name, commands,
    complete)`` per context.  ``skim`` looks at the first two levels only.
    """
    names = reachable(contexts, probes, root=root, max_contexts=max_contexts)
    marked = keep(placed(names.join(contexts.select("name", F.array_join("entry_path", " ").alias("lead")), "name"), [F.col("depth"), F.col("name")]).withColumn("mark", F.concat(F.lit("@"), F.col("place").cast("string"))), "contexts-marked")
    rows = help_rows.join(marked.select(F.col("name").alias("context"), "mark"), "context").select(F.trim(F.concat_ws(" ", "mark", "prefix")).alias("prefix"), "output")
    seeds = [r["mark"] for r in marked.select("mark").collect()]  # at most max_contexts
    depth = 3 if skim else limits.max_depth + 1  # the mark is one word
    done = walk(rows, seeds, limits=Limits(**{**limits.__dict__, "max_depth": depth}), include_root=False, by_first_word=True)

    def led(df: DataFrame, column: str) -> DataFrame:
        told = df.withColumn("mark", F.regexp_extract(column, r"^(@\d+)", 1)).join(marked.select("mark", "name", "lead"), "mark")
        return told.withColumn(column, F.trim(F.concat_ws(" ", "lead", F.regexp_replace(column, r"^@\d+ ?", "")))).drop("mark", "lead")

    commands = led(done.commands.where(F.col("command").contains(" ")), "command")
    per = marked.select("name").join(commands.groupBy("name").agg(F.count("*").alias("commands")), "name", "left")
    per = per.select("name", F.coalesce("commands", F.lit(0)).alias("commands"), F.lit(bool(done.totals["complete"]) and not skim).alias("complete"))
    merged = commands.groupBy("command").agg(F.max("description").alias("description"), F.bool_or("executable").alias("executable"), F.min("sources").alias("sources"))
    return Walk(merged, led(done.children, "command"), led(done.enumerated, "prefix").select("prefix").distinct(), done.derived, done.totals, done.skipped), per


def with_harvest(candidates: DataFrame, harvested: DataFrame, denied: list[str]) -> DataFrame:
    """``(head, command)`` to try: those of the help surface, and configured lines under heads that
    the surface has, if allowed and not there already.  Bare placeholders that a line now covers
    are left out."""
    lines = harvested.select("head", F.explode("entries").alias("command")).where(T.is_probe_allowed(F.col("command"), denied))
    heads = candidates.select("head").distinct()
    more = lines.join(heads, "head", "left_semi").join(candidates.select("command"), "command", "left_anti").distinct()
    open_ended = T.option_kind(F.element_at(T.words(F.col("command")), -1)) == "parameter"
    covered = candidates.where(open_ended).join(more.select("head").distinct(), "head", "left_semi")
    return candidates.join(covered.select("command"), "command", "left_anti").select("head", "command").unionByName(more.select("head", "command"))
