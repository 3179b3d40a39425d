"""Contexts of a command line: their tree, rollups along it, states and expected blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Seconds a query takes by transport, and the blocks a map is expected to show.
SECONDS_PER_QUERY = {"ssh": 0.15, "telnet": 0.30}
BLOCKS = {
    "interface": ("interface", "int"), "vlan": ("vlan",), "vrf": ("vrf", "ip-vpn-instance", "vpn-instance"), "mlag": ("mlag", "m-lag", "vpc", "stack"), "line": ("line", "user-interface"),
    "router": ("router", "bgp", "ospf", "isis", "rip"), "acl": ("acl", "access-list", "ip-access-list"), "route-map": ("route-map", "route-policy"), "prefix-list": ("prefix-list", "ip-prefix"),
    "aaa": ("aaa",), "stp": ("stp", "spanning-tree"), "snmp": ("snmp", "snmp-server", "snmp-agent"), "ntp": ("ntp", "ntp-service"),
}


def ancestors(name: Column) -> Column:
    """Every leading part of a slash path, the whole last."""
    parts = F.split(name, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def last_named(contexts: DataFrame, order: str = "seq") -> DataFrame:
    """One row per name: the values of its last row, the place of its first."""
    others = [c for c in contexts.columns if c not in ("name", order)]
    return contexts.groupBy("name").agg(F.max_by(F.struct(*others), order).alias("_row"), F.min(order).alias(order)).select("name", order, "_row.*")


def parents(contexts: DataFrame) -> DataFrame:
    """Adds ``parent``: the nearest ancestor by path that is present, else the root; null for the
    root, which is ``root`` or else the name of the shortest path."""
    names = contexts.select("name").distinct()
    root = names.agg(F.min(F.struct((F.col("name") != "root").alias("a"), (F.size(F.split("name", "/")) - 1).alias("b"), "name"))["name"].alias("root"))
    ups = contexts.select("name", F.posexplode(ancestors(F.col("name"))).alias("depth", "up")).where("up <> name")
    near = ups.join(names.select(F.col("name").alias("up")), "up").groupBy("name").agg(F.max_by("up", "depth").alias("near"))
    told = contexts.join(near, "name", "left").join(F.broadcast(root))
    return told.withColumn("parent", F.when(F.col("name") != F.col("root"), F.coalesce("near", "root"))).drop("near", "root")


def rollups(contexts: DataFrame, transport: str = "ssh") -> DataFrame:
    """``(name, contexts, commands, queries, seconds, badge)`` of every subtree, over present
    ancestors by path."""
    below = contexts.select(F.explode(ancestors(F.col("name"))).alias("up"), "commands", "queries")
    sums = below.groupBy("up").agg(F.count("*").alias("contexts"), F.sum("commands").cast("long").alias("commands"), F.sum("queries").cast("long").alias("queries"))
    seconds = F.col("queries") * F.lit(SECONDS_PER_QUERY.get(transport.lower(), 0.15))
    return contexts.select(F.col("name").alias("up")).distinct().join(sums, "up").withColumnRenamed("up", "name").withColumn("seconds", seconds).withColumn("badge", T.duration_badge(F.col("seconds")))


def node_state(commands: Column, complete: Column) -> Column:
    return F.when(complete, "parsed").when(commands > 0, "topped").otherwise("unknown")


def rejected_verbs(probes: DataFrame) -> DataFrame:
    """``verb``: heads of commands that were tried and refused."""
    return probes.where("outcome = 'rejected' AND trim(command) <> ''").select(T.head_word(F.col("command")).alias("verb")).distinct()


def missing_blocks(contexts: DataFrame, probes: DataFrame, blocks: dict[str, tuple[str, ...]] = BLOCKS) -> DataFrame:
    """``(block, state)`` of expected blocks no context shows: absent if a verb was refused."""
    verbs = contexts.sparkSession.createDataFrame([(i, b, v) for i, (b, vs) in enumerate(blocks.items()) for v in vs], "place int, block string, verb string")
    shown = contexts.select(T.head_word(T.block_label(F.col("name"))).alias("verb")).distinct().join(F.broadcast(verbs), "verb").select("block").distinct()
    refused = rejected_verbs(probes).withColumn("refused", F.lit(True))
    state = F.when(F.bool_or(F.coalesce("refused", F.lit(False))), "absent").otherwise("unknown")
    return verbs.join(shown, "block", "left_anti").join(refused, "verb", "left").groupBy("place", "block").agg(state.alias("state")).orderBy("place").select("block", "state")


def probe_outcomes(probes: DataFrame) -> DataFrame:
    """Adds ``outcome`` from the answer and the prompt fingerprints before and after."""
    refused = T.terminal_cleaned(F.col("answer")).rlike(r"(?im)^\s*(?:%|\^|error\b|invalid\b|unrecognized\b|unknown\b|ambiguous\b|incomplete\b)")
    changed = F.col("after").isNotNull() & ~F.col("after").eqNullSafe(F.col("before"))
    return probes.withColumn("outcome", F.when(F.col("after").isNull(), "reset").when(refused, "rejected").when(changed, "entered").otherwise("executed"))


def block_listing(commands: DataFrame, contexts: DataFrame, most: int = 200) -> DataFrame:
    """``(name, listed array<string>, more)``: up to ``most`` device commands of each context in
    order, and how many follow.  ``commands(command, sources)``, ``contexts(name, entry_path)``."""
    lead = contexts.select("name", F.array_join("entry_path", " ").alias("lead"))
    device = commands.where(F.array_contains("sources", "cli"))
    ups = device.select("command", F.explode(F.transform(F.sequence(F.lit(0), F.size(T.words(F.col("command"))) - 1), lambda n: F.array_join(F.slice(T.words(F.col("command")), 1, n), " "))).alias("lead"))
    numbered = ups.join(lead, "lead").withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("command")))
    listed = F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.col("command"))))
    return numbered.groupBy("name").agg(listed.alias("listed"), F.greatest(F.count("*") - most, F.lit(0)).alias("more"))


def map_rows(contexts: DataFrame, expanded: list[str] | None = None) -> DataFrame:
    """The map drawn depth first: ``(name, depth, label, state, badge)`` in order of path; with
    ``expanded`` only rows all of whose ancestors are among it."""
    told = contexts.select("name", "commands", "complete").join(rollups(contexts).select("name", "badge"), "name")
    if expanded is not None:
        ups = F.filter(ancestors(F.col("name")), lambda a: a != F.col("name"))
        told = told.where(F.forall(ups, lambda a: a.isin(expanded)) if expanded else F.size(ups) == 0)
    rows = told.select("name", (F.size(F.split("name", "/")) - 1).alias("depth"), T.block_label(F.col("name")).alias("label"), node_state(F.col("commands"), F.col("complete")).alias("state"), "badge")
    return rows.orderBy(F.split("name", "/"))
