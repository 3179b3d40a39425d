from pyspark.sql import functions as F

from manloom.functions import grammar as G
from manloom.functions import text as T
from manloom.operators import catalog, config, contexts, crawl
from manloom.operators import help as H


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def of(spark, values, column):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(column(F.col("v"))).collect()]


def test_scalars(spark):
    assert of(spark, ["<CR>", "<1-9>", "IFNAME", "10GE1/0/1", "a|b", "vlan", "7"], T.option_kind) == ["cr", "parameter", "parameter", "parameter", "parameter", "keyword", "keyword"]
    assert of(spark, ["ip 10.0.0.1 up", "x" * 25 + " y"], T.skeleton) == ["ip <value> up", "<value> y"]
    assert of(spark, ["  user password simple abc", "set key", "snmp community Read x", "plain", ""], T.secrets_blanked) == ["  user password <redacted>", "set key", "snmp community <redacted>", "plain", ""]
    assert of(spark, [" show  version ", "`vlan 1`", "Show", "a b.", "what ?", "ping a -> b", "ssh host", "", None, "a" * 600, " ".join("a" * 33), "é x"], T.command_verdict) == [
        "ok", "ok", "not a command", "sentence", "question", "arrow", "host tool", "empty", "empty", "too long", "too many words", "not printable ascii"]
    assert of(spark, ["Range 1 to 4094.", "1-4 or 1-4", "1-4 or 2-9", "10/100/1000", "none", "from 5-7"], T.numeric_domain) == ["1-4094", "1-4", None, None, None, "5-7"]
    assert of(spark, ["sw1(config-if-10)#", "host>", "text", "[~sw-vlan10]"], T.fingerprint)[:3] == ["(config-if-*)#", ">", None]
    assert of(spark, ["My Block/1!", "--", "vlan"], T.safe_name) == ["my-block-1", "block", "vlan"]
    assert of(spark, ["a\x1b[1mb\r\nxy\b\bz\b", "\b\bq"], T.terminal_cleaned) == ["ab\n", "q"]
    assert of(spark, ["<1-9>", "NAME", "name", "X"], lambda c: T.parameter_sample(c, {"NAME": "n1"})) == ["1", "n1", "n1", None]
    assert of(spark, ["0.4", "45", "120", "150.4", "2.5"], lambda c: T.duration_badge(c.cast("double"))) == ["<1s", "~45s", "~2m", "~2m30s", "~2s"]
    assert of(spark, ["reset all", "show arp", "no shut", ""], lambda c: T.is_probe_allowed(c, ["reset"])) == [False, True, False, False]


def test_grammar(spark):
    assert G.forms("a {b|c d} [e]") == [("a", "b"), ("a", "b", "e"), ("a", "c", "d"), ("a", "c", "d", "e")]
    assert G.forms("x [y [z]] p|q") == [("x", "p"), ("x", "q"), ("x", "y", "p"), ("x", "y", "q"), ("x", "y", "z", "p"), ("x", "y", "z", "q")]
    big = "a " + " ".join("{b|c|d|e}" for _ in range(5))
    assert G.forms(big) == [tuple(big.split())]
    df = spark.createDataFrame([(1, "show {arp|mac} [all]"), (2, big), (3, "Bad {a|b}")], "id int, s string")
    assert rows(G.expand_syntax(df, F.col("s")), "id", "command") == [(1, "show arp"), (1, "show arp all"), (1, "show mac"), (1, "show mac all")]


def test_help(spark):
    out = "sw# show ?\n  arp   ARP table\n  error-down  x\n  <cr>\n  lone\nCommands:\n  arp   again\n% Bad\nsw#\n  up\ttabbed desc > \n"
    df = spark.createDataFrame([("show", out)], "prefix string, output string")
    assert rows(H.parse_help(df), "token", "kind", "description") == [("<cr>", "cr", ""), ("arp", "keyword", "ARP table"), ("up", "keyword", "tabbed desc >")]
    assert [r[0] for r in rows(H.parse_help(df, undescribed=True, error_words=True), "token")] == ["<cr>", "arp", "error-down", "lone", "up"]


CONFIG = """sw#show run
#
vlan 10
 name x
  deep 1
 other
#
interface 10ge1/0/1
 ip address 10.0.0.1
interface 10ge1/0/2
interface 10ge1/0/3
 password cipher abc
banner motd ^ hello
 indented prose
^
snmp community s3
return
sw#
"""


def test_identities(spark):
    cases = {
        "Chassis Serial Number : FOC123X": "Chassis Serial Number : <redacted>", "System ID: 12": "System ID: <redacted>", "Device name: sw1": "Device name: <redacted>", "a psk abcdef": "<redacted line>", "key 7 1234": "<redacted line>",
        "ospf authentication-key 1 md5 x": "<redacted line>", "snmp-server user bob": "<redacted line>", "tokenring vlan 5": "tokenring vlan 5", "up\n  secret x\nat 0011.2233.aabb": "up\n<redacted line>\nat <redacted>", "monkey business": "monkey business",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in df.select("t", T.identity_redacted(F.col("t")).alias("x")).collect()} == cases
    prompts = {"sw(config-vlan-10)#": "(config-vlan-*)#", "user$ ": "$", " r-1.x> ": ">", "[sw]": None, "sw(x)]": None, "<sw>": None, "a b#": None, "": None}
    df = spark.createDataFrame([(k,) for k in prompts], "t string")
    assert {r.t: r.x for r in df.select("t", T.fingerprint(F.col("t")).alias("x")).collect()} == prompts
    df = spark.createDataFrame([("sw#\r\nx\r\nsw(if-3)$\r\nend of it",), ("none",)], "t string")
    assert [r.x for r in df.select(T.fingerprint_of(F.col("t")).alias("x")).collect()] == ["(if-*)$", None]
    df = spark.createDataFrame([("interface 1",), ("x Reload now",), ("no shutdown",), ("line vty 0",)], "t string")
    assert [r.x for r in df.select(T.is_probe_allowed(F.col("t")).alias("x")).collect()] == [True, False, False, False]


def test_config(spark):
    dumps = spark.createDataFrame([("d", "show run", CONFIG), ("e", "", "banner x ~ never\nlost\n")], "device string, source_command string, output string")
    lines = config.config_lines(dumps)
    got = {r.text: r for r in lines.where("device = 'd'").collect()}
    assert got["deep 1"].path == ["vlan 10", "name x", "deep 1"] and got["other"].path == ["vlan 10", "other"]
    assert got["banner motd ^ hello"].verbatim and "indented prose" not in got and got["snmp community s3"].path == ["snmp community s3"]
    assert [r.text for r in lines.where("device = 'e'").orderBy("seq").collect()] == ["banner x ~ never", config.UNTERMINATED]
    entries = {r.head: r.entries for r in config.harvest(lines.where("device = 'd'")).collect()}
    assert entries["interface"] == ["interface 10ge1/0/1", "interface 10ge1/0/2"] and set(entries) == {"vlan", "interface", "snmp"}
    commands = spark.createDataFrame([(i, c) for i, c in enumerate(["vlan <1-4094>", "vlan <1-4094> name WORD", "system-view interface 10ge1/0/9", "ip address IP", "snmp community WORD"])], "place int, command string")
    views = spark.createDataFrame([("a", []), ("b", ["system-view"])], "name string, entry_path array<string>")
    m = config.correlate(lines.where("device = 'd'"), commands, config.view_prefixes(views))
    got = {r.text: (r.status, r.command) for r in m.collect()}
    assert got["vlan 10"] == ("matched", "vlan <1-4094>") and got["name x"] == ("matched", "vlan <1-4094> name WORD")
    assert got["interface 10ge1/0/1"] == ("matched", "system-view interface 10ge1/0/9") and got["ip address 10.0.0.1"] == ("matched_elsewhere", "ip address IP")
    assert got["deep 1"][0] == "unmatched" and got["banner motd ^ hello"][0] == "free-text"
    c = config.coverage(m).first()
    assert (c.lines, c.matched, c.matched_elsewhere, c.unmatched, c.free_text, c.coverage) == (11, 6, 1, 3, 1, 0.7)
    assert ("interface <value> password <redacted>", 1) in rows(config.gaps(m), "command", "occurrences")


def test_match_backtracks_and_prefers_literals(spark):
    commands = spark.createDataFrame([(0, "a <x> c"), (1, "a bb d"), (2, "a Bb d"), (3, "port ge1 up"), (4, "port WORD up")], "place int, command string")
    asked = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["a", "bb", "d"]), (2, ["port", "ge7", "up"]), (3, ["a"]), (4, [])], "key int, tokens array<string>")
    assert rows(config.match_commands(asked, commands), "key", "command") == [(0, "a <x> c"), (1, "a Bb d"), (2, "port WORD up")]


def test_reconcile(spark):
    entries = spark.createDataFrame(
        [("show arp", "", True, "cli", 0), ("show  arp", "ARP", False, "documentation:m", 1), ("show x", "", False, "cli", 0), ("show y z", "Y", False, "documentation:m", 1), ("q r", "", False, "documentation:m", 1), ("show", "", False, "cli", 0)],
        "command string, description string, executable boolean, source string, rank int",
    )
    cat = catalog.source_union(entries)
    listed = spark.createDataFrame([("show",)], "prefix string")
    absent = catalog.provably_absent(cat, listed)
    assert rows(absent.where("absent"), "command") == []  # the root was never asked
    absent = catalog.provably_absent(cat, listed.union(spark.createDataFrame([("",)], "prefix string")))
    told = catalog.reconciled(cat, complete=False, absent=absent)
    assert rows(told, "command", "status") == [("q r", "missing_on_device"), ("show", "undocumented"), ("show arp", "matched"), ("show x", "undocumented"), ("show y z", "missing_on_device")]
    assert rows(catalog.status_counts(told), "status", "n") == [("matched", 1), ("missing_on_device", 2), ("not_observed", 0), ("undocumented", 2)]
    again = catalog.merged_by_key(cat, cat, "command")
    assert rows(again, "command", "description") == rows(cat, "command", "description")


def test_contexts(spark):
    ctx = spark.createDataFrame([(0, "root", 5, 10, True), (1, "root/a/b", 2, 20, False), (2, "root/c", 0, 0, False), (3, "root/c/d", 1, 900, True), (4, "root/c", 3, 4, True)], "seq int, name string, commands int, queries int, complete boolean")
    one = contexts.last_named(ctx)
    assert rows(contexts.parents(one), "name", "parent") == [("root", None), ("root/a/b", "root"), ("root/c", "root"), ("root/c/d", "root/c")]
    up = {r.name: r for r in contexts.rollups(one).collect()}
    assert (up["root"].contexts, up["root"].commands, up["root"].queries, up["root/c"].badge) == (4, 11, 934, "~2m16s")
    probes = spark.createDataFrame([("vlan 1", "rejected"), ("acl x", "entered")], "command string, outcome string")
    states = dict(rows(contexts.missing_blocks(spark.createDataFrame([("root/interface 1",)], "name string"), probes), "block", "state"))
    assert states["vlan"] == "absent" and states["acl"] == "unknown" and "interface" not in states


def test_walk_copies_like_subtrees(spark):
    h = {
        "": "  show   s\n  port   p\n  no   n\n  reset   r\n", "show": "  arp   a\n  mac   m\n", "show arp": "  all  x\n  <cr>\n", "show mac": "  all  y\n  <cr>\n", "show arp all": "  <cr>\n", "show mac all": "  <cr>\n",
        "port": "  <1-9>   number\n  NAME   n\n", "port 1": "  <cr>\n", "no": "  show   s\n", "no show": "  <cr>\n",
    }
    df = spark.createDataFrame(list(h.items()), "prefix string, output string")
    w = crawl.walk(df, limits=crawl.Limits(denied=("reset",)))
    got = {r.command: r for r in w.commands.collect()}
    assert set(got) == {"show", "port", "no", "reset", "show arp", "show mac", "show arp all", "show mac all", "port <1-9>", "port NAME", "no show"}
    assert rows(w.derived, "prefix", "canonical") == [("show mac", "show arp")]
    assert got["show mac all"].executable and got["show arp all"].description == "x" and got["show mac all"].description == "x" and not got["show"].executable
    assert w.totals["skipped_denied"] == 1 and w.totals["skipped_parameters"] == 1 and rows(w.skipped, "token", "n") == [("NAME", 1)] and not w.totals["complete"] and w.totals["mismatched"] == 0
    full = crawl.walk(df, limits=crawl.Limits(deduplicate=False, samples={"NAME": "1"}))
    assert set(r.command for r in full.commands.collect()) == set(got) and full.totals["complete"] is True
    cut = crawl.walk(df, limits=crawl.Limits(max_queries=3))
    assert cut.totals["queries"] == 3 and not cut.totals["complete"] and cut.totals["pending"] > 0
    shallow = crawl.walk(df, limits=crawl.Limits(max_depth=2))
    assert shallow.totals["skipped_depth"] > 0 and "show arp" in {r.command for r in shallow.commands.collect()}


def test_copies_stay_within_what_is_recorded(spark):
    like = {"": "  x   1\n  y   2\n  z   3\n  w   4\n", "x": "  mode   m\n", "y": "  mode   m\n", "z": "  mode   m\n", "w": "  mode   m\n", "x mode": "  alpha   a\n", "y mode": "  beta   b\n", "w mode": "  alpha   a\n"}
    df = spark.createDataFrame(list(like.items()), "prefix string, output string")
    done = crawl.walk(df)
    below = sorted(r.command for r in done.commands.collect() if r.command.count(" ") == 2)
    assert below == ["w mode alpha", "x mode alpha", "y mode beta", "z mode alpha"] and rows(done.derived, "prefix", "canonical") == [("w", "x"), ("z", "x")]
    assert done.totals["complete"] and done.totals["mismatched"] == 0 and done.totals["verified"] == 2
    forced = crawl.walk(df, limits=crawl.Limits(prefer_recorded=False))
    assert forced.totals["mismatched"] == 1 and not forced.totals["complete"] and "y mode beta" not in {r.command for r in forced.commands.collect()}
    single = crawl.walk(df, limits=crawl.Limits(prefer_recorded=False, verify_samples=0))
    assert single.totals["mismatched"] == 0 and single.totals["complete"]


def test_copies_stay_within_their_context(spark):
    contexts_ = spark.createDataFrame([("root", []), ("a", ["enter a"]), ("b", ["enter b"])], "name string, entry_path array<string>")
    probes = spark.createDataFrame([("root", "enter a", "entered", "a"), ("root", "enter b", "entered", "b")], "context string, command string, outcome string, child string")
    answers = spark.createDataFrame([("a", "", "  mode   m\n"), ("b", "", "  mode   m\n"), ("a", "mode", "  alpha   a\n"), ("b", "mode", "  beta   b\n")], "context string, prefix string, output string")
    for limits in (crawl.Limits(), crawl.Limits(prefer_recorded=False)):
        done, _ = crawl.walk_contexts(answers, contexts_, probes, limits)
        assert rows(done.commands, "command") == [("enter a mode",), ("enter a mode alpha",), ("enter b mode",), ("enter b mode beta",)]
        assert done.totals["complete"] and done.totals["derived"] == 0


def test_limits_are_checked():
    import pytest

    assert crawl.Limits.checked({"max_depth": 3, "denied": ["reset"], "samples": {"NAME": "x"}}) == crawl.Limits(max_depth=3, denied=("reset",), samples={"NAME": "x"})
    for bad in ({"depth": 1}, {"max_depth": 0}, {"max_depth": "3"}, {"samples": {"A": "a?"}}, {"deduplicate": 1}):
        with pytest.raises(ValueError):
            crawl.Limits.checked(bad)


def test_contexts_are_found_from_probes(spark):
    row = lambda fp, path, k, command, answer="", after="same": (fp, path, k, command, answer, fp if after == "same" else after)
    data = [
        row("#", [], 0, "vlan 1", after="(vlan-*)#"), row("#", [], 1, "vlan 2", after="(vlan-*)#"), row("#", [], 2, "interface x", "% bad", "(if)#"), row("#", [], 3, "router a", after="(r)#"), row("#", [], 4, "reload", after="(x)#"),
        row("#", [], 5, "show it", after="(show)#"), row("#", [], 6, "class c", after=None), row("(vlan-*)#", ["vlan 1"], 0, "class q", after="(c)#"), row("(r)#", ["router a"], 0, "vlan 7"), row("(far)#", ["far"], 0, "vlan 9", after="(vlan-*)#"),
    ]
    df = spark.createDataFrame(data, "fingerprint string, entry_path array<string>, ord int, command string, answer string, after string")
    got = crawl.discovered(df)
    assert [(r.place, r.name, r.entry_path) for r in got.contexts.orderBy("place").collect()] == [(1, "root", []), (2, "root/vlan", ["vlan 1"]), (3, "root/router", ["router a"]), (4, "root/vlan/class", ["vlan 1", "class q"])]
    assert rows(got.probes, "command", "outcome") == [("class c", "reset"), ("class q", "entered"), ("interface x", "rejected"), ("router a", "entered"), ("vlan 1", "entered"), ("vlan 2", "entered"), ("vlan 7", "executed")]
    assert rows(crawl.discovered(df, focus=["router"]).contexts, "name") == [("root",), ("root/router",)]
    assert rows(crawl.discovered(df, max_contexts=2).contexts, "name") == [("root",), ("root/vlan",)] and crawl.discovered(df, descend=False).contexts.count() == 1
    few = crawl.discovered(df, most_probes=1)
    assert few.skipped == 4 and "root/show" in {r.name for r in crawl.discovered(df, verbs=None).contexts.collect()}


def nested(lines):
    """A mapping read back from lines that are indented by two blanks a level."""
    tree, stack = {}, []
    for line in lines:
        body = line.split("  # ")[0].rstrip().removesuffix(":")
        depth = (len(body) - len(body.lstrip(" "))) // 2
        key = body.strip()
        key = key[1:-1].replace('\\"', '"').replace("\\\\", "\\") if key[0] == '"' else key
        stack[depth:] = [{}]
        (stack[depth - 1] if depth else tree)[key] = stack[depth]
    return tree


def test_trees_are_written_and_read_back_equal(spark, tmp_path):
    from manloom.sources import sinks

    commands = ["show arp", "show arp <1-9>", 'set "x" \\y', "no", "set on"]
    cat = spark.createDataFrame([(c, ["cli"]) for c in commands] + [("docs only", ["documentation:m"])], "command string, sources array<string>")
    sinks.write_lines(sinks.tree_lines(cat), ["path"], str(tmp_path / "tree"))
    want = {}
    for c in commands:
        at = want
        for w in c.split():
            at = at.setdefault(w, {})
    assert nested(r.value for f in sorted((tmp_path / "tree").glob("part-*")) for r in spark.read.text(str(f)).collect()) == want
    matched = spark.createDataFrame([("d", 0, ["vlan 1"], "vlan 1", 1, "matched"), ("d", 1, ["vlan 1", "name x"], "name x", 2, "unmatched"), ("d", 2, ["vlan 1", "name x"], "name x", 3, "matched"), ("d", 3, ["end"], "end", 4, "free-text")], "device string, seq int, path array<string>, text string, number int, status string")
    got = [r.line for r in sinks.config_lines_yaml(matched).orderBy("seq").collect()]
    assert got == ['"vlan 1":', '  "name x":  # not in the catalog', '  "name x (line 3)":', "end:"] and nested(got) == {"vlan 1": {"name x": {}, "name x (line 3)": {}}, "end": {}}


def test_help_lines_are_dealt_and_control_characters_make_no_option(spark):
    told = H.parse_help(spark.createDataFrame([("show", "  arp  ARP table\n  x\x01y\n")], "prefix string, output string"))
    assert [r.token for r in told.collect()] == ["arp"]
    assert "REPARTITION_BY_NUM" in told._jdf.queryExecution().executedPlan().toString()


def test_syntax_rows_are_dealt_over_all_tasks(spark):
    told = G.expand_syntax(spark.createDataFrame([("a [b | c]",)], "syntax string").coalesce(1), F.col("syntax"))
    assert [(r.pos, r.command) for r in sorted(told.collect(), key=lambda r: r.pos)] == [(0, "a"), (1, "a b"), (2, "a c")]
    assert "REPARTITION_BY_NUM" in told._jdf.queryExecution().executedPlan().toString()


def test_answers_are_split_once(spark):
    df = spark.createDataFrame([("\nsw1# show x\na\n\nb\nsw1#",)], "o string")
    told = df.select(T.edges_trimmed(F.col("o"), F.lit("show x")).alias("o"))
    assert told.first().o == "a\n\nb"
    assert told._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
