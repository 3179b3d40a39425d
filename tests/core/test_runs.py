import zipfile

from pyspark.sql import functions as F

from manloom.functions import text as T
from manloom.operators import crawl as W
from manloom.operators import manuals as M
from manloom.plans import runs
from manloom.sources import documents as D
from manloom.sources import sinks
from manloom.streaming import transcripts as S

CARD = """### 3.{i}.1 mirror {w} port
**Purpose**
- mirror {w} port copies traffic of {w}
**Command syntax**
```
mirror {w} port {{ rx | tx | both }} [ limit
<rate> ]
```
**Parameters**
```
rate     Packets a second, range 1 to 5000,
         counted per port
```
"""
WORDS = ["alpha", "beta", "gamma", "delta"]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_manuals_to_catalog(spark, tmp_path):
    (tmp_path / "cards.md").write_text("".join(CARD.format(i=i, w=w) for i, w in enumerate(WORDS)))
    (tmp_path / "plain.txt").write_text("show clock  Time of day\nThis is prose.\nshow users\n")
    (tmp_path / "notes.MD").write_text("text\n```\nshow arp\n```\n```python\nimport x\n```\n| Command | Use |\n|---|---|\n| `reload` | Restart |\n\n| en | 5 |\nsw> show log\nUsage: ping host\n")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe nothing here.")
    (tmp_path / "big.txt").write_text("x" * (D.MAX_TEXT + 1))
    (tmp_path / "broken.docx").write_bytes(b"PK no zip")
    xml = "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body>{}</w:body></w:document>"
    p = lambda t, left: f"<w:p><w:pPr>{'<w:ind w:left=\"9\"/>' if left else ''}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "paged.docx", "w") as z:
        z.writestr("word/document.xml", xml.format(p("flow one", 0) + p("1", 0) + p("placed two", 1) + p("flow two", 0) + p("2", 0)))
    run = runs.read_manuals(spark, str(tmp_path), runs.CardProfile(min_cards=3))
    got = {r.command: r for r in run.catalog.collect()}
    assert {"mirror alpha port rx", "mirror beta port tx limit <rate>", "show clock", "show users", "show arp", "reload", "show log", "ping host"} <= set(got)
    assert got["mirror gamma port both"].description == "copies traffic of gamma" and got["show clock"].description == "Time of day" and got["reload"].description == "Restart"
    assert "import x" not in got and "en" not in got
    why = {d.rsplit("/", 1)[-1]: s for d, s in rows(run.skipped, "doc", "skipped")}
    assert why["big.txt"] == "larger than 5 MiB" and why["broken.docx"].startswith("BadZipFile") and why["bad.txt"] == "no commands found"
    order = D.reading_order(D.docx_paragraphs(D.scan_documents(spark, str(tmp_path))).where("skipped IS NULL"), r"^\d+$")
    assert [r.text for r in order.orderBy("place").collect()] == ["placed two", "flow one", "flow two"]


def test_cards_are_marked(spark):
    lines = M.doc_lines(spark.createDataFrame([("d", CARD.format(i=0, w="alpha"))], "doc string, text string"))
    parts = M.cards(lines, runs.CardProfile().heading, {"syntax": ["command syntax"], "parameters": ["parameters"], "purpose": ["purpose"]})
    table = M.parameter_rows(parts)
    assert rows(table, "name", "description") == [("rate", "Packets a second, range 1 to 5000, counted per port")]
    told = {r.token: (r.kind, r.written, r.reason) for r in M.marks(parts, table).collect()}
    assert told["mirror"] == ("keyword", "mirror", "name") and told["rate"] == ("parameter", "<1-5000>", "domain") and told["tx"][0] == "keyword" and told["limit"][2] == "untabled"
    assert dict(rows(M.measurement(parts, M.marks(parts, table)), "measure", "n"))["cards"] == 1
    assert spark.range(1).select(M.says_no_parameters(F.lit("This command takes no para-\nmeters.")), M.says_no_parameters(F.lit("rate  limit"))).first() == (True, False)
    welds = spark.createDataFrame([("servergroup", 1), ("server", 5), ("group", 9), ("sergroup", 1)], "token string, seen long")
    assert rows(M.weld_repairs(welds), "repaired") == [("server group",)]


def test_compare_run(spark):
    h = {"": "  show   s\n", "show": "  arp   a\n", "show arp": "  <cr>\n"}
    help_rows = spark.createDataFrame(list(h.items()), "prefix string, output string")
    manuals = spark.createDataFrame([("show arp", "ARP", ["documentation:m"]), ("show mac", "", ["documentation:m"])], "command string, description string, sources array<string>")
    dumps = spark.createDataFrame([("d", "", "show arp\nodd line 7\n")], "device string, source_command string, output string")
    run = runs.read_device(help_rows, W.Limits(), manuals=manuals, dumps=dumps)
    assert rows(run.catalog, "command", "status", "description") == [("show", "undocumented", "s"), ("show arp", "matched", "ARP"), ("show mac", "missing_on_device", "")]
    assert run.coverage.first().coverage == 0.5 and run.totals["complete"] is False and rows(run.gaps, "command") == [("odd line <value>",)]
    assert [r.html for r in sinks.html_rows(run.catalog).collect()][0] == "<tr><td>show</td><td>undocumented</td><td>s</td></tr>"
    assert rows(sinks.human_list(run.catalog, "audit"), "command") == [("show",), ("show arp",)]
    assert runs.read_device(help_rows).totals["complete"] is True


def test_sources_and_reports(spark, tmp_path):
    answers = spark.createDataFrame([("d", 0, "a", "% bad\n"), ("d", 1, "b", "1\n2\n3\n4\n"), ("d", 2, "c", "1\n2\n3\n4\n5\n")], "device string, ord int, source_command string, output string")
    assert rows(D.first_capture(answers), "source_command") == [("b",)]
    fw = spark.createDataFrame([("Serial Number: ABC1\nMAC 00:11:22:33:44:55\nv 1\npassword x",)], "output string")
    assert D.firmware(fw).first().output == "Serial Number: <redacted>\nMAC <redacted>\nv 1\n<redacted line>"
    checked = D.verified_answers(spark.createDataFrame([("c", "x\nsw(vlan-1)#"), ("c", "sw>")], "context string, output string"), spark.createDataFrame([("c", "(vlan-*)#")], "name string, fingerprint string"))
    assert sorted(r.verified for r in checked.collect()) == [False, True]
    blocks = spark.createDataFrame([("root/My vlan", ["vlan 1"], 2, False, ["vlan 1 a"], 3)], "name string, entry_path array<string>, commands int, complete boolean, listed array<string>, more int")
    r = sinks.block_markdown(blocks).first()
    assert r.file == "my-vlan.md" and "- state: topped" in r.markdown and r.markdown.endswith("- `vlan 1 a`\n- and 3 more\n")
    cat = spark.createDataFrame([("b c", "x"), ("a", "y")], "command string, description string")
    sinks.write_catalog(cat, str(tmp_path / "out"))
    assert rows(spark.read.json(str(tmp_path / "out")), "command") == [("a",), ("b c",)]
    assert spark.range(1).select(T.command_form(F.lit("show arp — note"))).first()[0] == "show arp"


def test_streamed_transcripts_replay_idempotently(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"prefix":"show","output":"  arp   a\\n","taken_at":"2024-01-01T00:00:00Z"}\n')
    stream = S.arriving_help(spark, str(src))
    run = lambda: S.upsert_options(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    assert rows(S.latest_options(spark, str(tmp_path / "out")), "prefix", "token") == [("show", "arp")]
    (src / "2.json").write_text('{"prefix":"show","output":"  mac   m\\n","taken_at":"2024-01-02T00:00:00Z"}\n')
    run()
    run()
    assert rows(S.latest_options(spark, str(tmp_path / "out")), "prefix", "token") == [("show", "mac")]


def test_structured_manual(spark):
    text = "1.2 vlan\nCommand format\n• vlan <id> {a|\nb}\nundo vlan\nport x\nParameters\nvlan no\n1.3\nmirror command\nSyntax:\nmirror [ x\ny ]\n"
    lines = M.doc_lines(spark.createDataFrame([("d", text)], "doc string, text string"))
    assert [r[0] for r in rows(M.structured_syntax(lines), "syntax")] == ["mirror [ x y ]", "undo vlan", "vlan <id> {a| b}"]
    cards = M.doc_lines(spark.createDataFrame([("d", "".join(CARD.format(i=i, w=w) for i, w in enumerate(WORDS)))], "doc string, text string"))
    picked = M.pick_profile(cards, {"chapter": r"^Chapter (.+)$", "numbered": runs.CardProfile().heading}, {"syntax": ["command syntax"], "parameters": ["parameters"]}, min_cards=3)
    assert rows(picked, "doc", "profile") == [("d", "numbered")]


def test_contexts_are_walked_together(spark):
    h = [("root", "", "  show   s\n  vlan   v\n"), ("root", "show", "  <cr>\n"), ("root", "vlan", "  <cr>\n"), ("root/vlan", "", "  name   n\n"), ("root/vlan", "name", "  <cr>\n"), ("root/far", "", "  x   x\n")]
    contexts = spark.createDataFrame([("root", []), ("root/vlan", ["vlan 1"]), ("root/far", ["far"])], "name string, entry_path array<string>")
    probes = spark.createDataFrame([("root", "vlan 1", "entered", "root/vlan"), ("root", "far", "rejected", "root/far")], "context string, command string, outcome string, child string")
    done, per = W.walk_contexts(spark.createDataFrame(h, "context string, prefix string, output string"), contexts, probes)
    assert rows(done.commands, "command") == [("show",), ("vlan",), ("vlan 1 name",)]
    assert rows(per, "name", "commands", "complete") == [("root", 2, True), ("root/vlan", 1, True)]
    surface = spark.createDataFrame([("vlan", "vlan <1-9>"), ("show", "show arp")], "head string, command string")
    lines = spark.createDataFrame([("vlan", ["vlan 7"]), ("other", ["other 1"]), ("show", ["show arp"])], "head string, entries array<string>")
    assert rows(W.with_harvest(surface, lines, []), "command") == [("show arp",), ("vlan 7",)]


def test_map_rows_and_reload(spark, tmp_path):
    from manloom.operators import contexts as X

    ctx = spark.createDataFrame([("root", 5, 10, True), ("root/b", 2, 20, False), ("root/b/c", 0, 0, False), ("root/a", 0, 1, True)], "name string, commands int, queries int, complete boolean")
    assert [(r.label, r.depth, r.state) for r in X.map_rows(ctx).collect()] == [("root", 0, "parsed"), ("a", 1, "parsed"), ("b", 1, "topped"), ("c", 2, "unknown")]
    assert [r.label for r in X.map_rows(ctx, ["root"]).collect()] == ["root", "a", "b"]
    assert sinks.read_catalog(spark, str(tmp_path / "none")) is None
