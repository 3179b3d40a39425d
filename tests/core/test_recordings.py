"""Raw recordings: exchanges, help, commands and dumps, however the files are split."""

import pytest

from manloom.operators.crawl import Limits, discovered, walk
from manloom.sources.recordings import read_recording

SESSION = """maintenance> tonight
sw1> enable
sw1# ?
  configure  Enter mode
  show       Show things
sw1# show ?
  vlan   VLANs
  <cr>
sw1# show
sw1# show running
interface 5
 mtu 9000
core# not mine
sw1# configure
sw1(config)# interface 5
sw1(config-if-5)# exit
sw1(config)# vl?
vlan
sw1(config)# end
sw1#
"""


@pytest.fixture(params=["whole", "split"])
def recording(request, spark, tmp_path):
    (tmp_path / "lab").mkdir()
    (tmp_path / "lab" / "a.log").write_text(SESSION.replace("show running", "shoe\b\bow running"))
    (tmp_path / "b.log").write_text("r2# \x1b[1mreload\x1b[0m\r\nRestarting\r\n")
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "notes.md").write_text("sw9# show\nno recording\n")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    if request.param == "split":
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield read_recording(spark, str(tmp_path), pattern="*.log")
    for k, v in held.items():
        spark.conf.set(k, v)


def test_exchanges_help_and_commands(recording):
    assert recording.counts == {"lines": 22, "prompts": 12, "before_prompt": 1}
    help_rows = {(r.session, r.fingerprint, r.prefix): r.output for r in recording.help_rows.collect()}
    assert help_rows == {("lab/a.log", "#", ""): "  configure  Enter mode\n  show       Show things", ("lab/a.log", "#", "show"): "  vlan   VLANs\n  <cr>"}
    done = [(r.session, r.fingerprint, list(r.entry_path), r.command, r.after) for r in recording.executed.orderBy("session", "ord").collect()]
    assert done == [
        ("b.log", "#", [], "reload", None),
        ("lab/a.log", ">", [], "enable", "#"),
        ("lab/a.log", "#", ["enable"], "show running", "#"),
        ("lab/a.log", "#", ["enable"], "configure", "(config)#"),
        ("lab/a.log", "(config)#", ["configure"], "interface 5", "(config-if-*)#"),
        ("lab/a.log", "(config-if-*)#", ["interface 5"], "exit", "(config)#"),
        ("lab/a.log", "(config)#", ["configure"], "end", "#"),
    ]
    assert [tuple(r) for r in recording.dumps(["show running"]).collect()] == [("lab/a.log", "show running", "interface 5\n mtu 9000\ncore# not mine")]


def test_walk_and_discovery_read_recordings(recording):
    done = walk(recording.help_rows.select("prefix", "output"), limits=Limits())
    assert {r.command for r in done.commands.collect()} == {"configure", "show", "show vlan"}
    found = discovered(recording.executed.drop("session"), ">", verbs=None, denied=["reload"]).contexts
    assert [(r.fingerprint, list(r.entry_path)) for r in found.orderBy("place").collect()][:3] == [(">", []), ("#", ["enable"]), ("(config)#", ["enable", "configure"])]


def test_empty_folder(spark, tmp_path):
    (tmp_path / "empty.log").write_text("")
    held = read_recording(spark, str(tmp_path))
    assert held.exchanges.count() == 0 and held.counts["lines"] == 0 and held.help_rows.count() == 0 and held.executed.count() == 0
