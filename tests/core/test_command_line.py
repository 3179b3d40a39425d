"""Runs from the command line, from folders to written results."""

import json

import pytest

from manloom.__main__ import DONE, FAILED, USAGE, main

SESSION = """sw1> ?
  enable  Raise the level
sw1> enable
sw1# show version
Release 5
Serial number: ABC123
sw1# ?
  configure  Enter mode
  show       Show things
sw1# show ?
  vlan     VLANs
  version  Release
sw1# show vlan ?
  <cr>
sw1# show version ?
  <cr>
sw1# configure
sw1(config)# ?
  hostname   Name
  interface  Enter interface
sw1(config)# interface 5
sw1(config-if-5)# ?
  mtu  Size
sw1(config-if-5)# end
sw1# show running-config
hostname sw1
ntp 10.0.0.1
interface 5
 mtu 9000
sw1#
"""


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text(SESSION)
    (tmp_path / "manuals").mkdir()
    (tmp_path / "manuals" / "m.md").write_text("```\nenable show vlan\nenable show clock\n```\n")
    return tmp_path


def told(folder, name):
    return [line for p in sorted((folder / "run" / name).glob("part-*")) for line in p.read_text().splitlines()]


def test_compare(spark, folders, capsys):
    code = main(["compare", "--docs", str(folders / "manuals"), "--recordings", str(folders / "logs"), "--out", str(folders / "run")], spark)
    assert code == DONE, capsys.readouterr().err
    summary = json.loads(capsys.readouterr().out)
    assert summary == json.loads(told(folders, "summary")[0]) and summary["mode"] == "compare"
    catalog = {r["command"]: r for r in map(json.loads, told(folders, "catalog"))}
    assert catalog["enable show vlan"]["status"] == "matched" and catalog["enable show clock"]["status"] == "missing_on_device"
    assert {"enable configure hostname", "enable configure interface 5 mtu"} <= set(catalog)
    assert summary["summary"]["matched"] == 1 and summary["summary"]["missing_on_device"] == 1
    contexts = {tuple(r["entry_path"]): r["commands"] for r in map(json.loads, told(folders, "contexts"))}
    assert contexts[("enable", "configure", "interface 5")] == 1 and set(contexts) == {(), ("enable",), ("enable", "configure"), ("enable", "configure", "interface 5")}
    assert "ntp <value>" in {r["command"] for r in map(json.loads, told(folders, "gaps"))} and not summary["scan"]["complete"]
    page = "\n".join(told(folders, "report"))
    assert "Release 5" in page and "ABC123" not in page and "<code>enable show clock</code>" in page and "(config-if-*)#" in page
    assert "enable show clock" not in "\n".join(told(folders, "commands")) and "    vlan:" in told(folders, "tree")


def test_docs_and_audit(spark, folders, capsys):
    assert main(["docs", "--docs", str(folders / "manuals"), "--out", str(folders / "run"), "--quiet"], spark) == DONE
    assert told(folders, "commands") == ["enable show clock", "enable show vlan"] and capsys.readouterr().out == ""
    assert main(["audit", "--recordings", str(folders / "logs"), "--out", str(folders / "run")], spark) == DONE
    summary = json.loads(capsys.readouterr().out)
    assert summary["summary"]["present"] == summary["summary"]["device"] == len(told(folders, "catalog"))


def test_wrong_use(spark, folders, capsys):
    settings = folders / "settings.json"
    assert main(["walk"]) == USAGE and main(["compare", "--docs", "x"]) == USAGE
    for bad in ('{"limit": {}}', '{"limits": {"max_depth": 0}}', '{"config_commands": [1]}', "[]", "{"):
        settings.write_text(bad)
        assert main(["docs", "--config", str(settings), "--check-config"]) == USAGE
    settings.write_text('{"limits": {"max_depth": 3}, "config_commands": ["show run"]}')
    assert main(["docs", "--config", str(settings), "--check-config", "--quiet"]) == DONE
    (folders / "none").mkdir()
    assert main(["audit", "--recordings", str(folders / "none"), "--out", str(folders / "run")], spark) == FAILED
    assert "no session" in capsys.readouterr().err
