"""The report page: escaping, what is said of each state, sections that aren't given."""

from html.parser import HTMLParser

from manloom.sources.report import report_lines, write_report

CATALOG = "command string, description string, sources array<string>, status string"


def page(spark, rows, mode="compare", **given):
    lines = report_lines(spark.createDataFrame(rows, CATALOG), mode, **given)
    return [r.html for r in lines.orderBy("section", "place").collect()]


def balanced(html):
    open_, void = [], {"meta", "input"}

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag not in void:
                open_.append(tag)

        def handle_endtag(self, tag):
            assert open_.pop() == tag

    Reader().feed(html)
    return not open_


ROWS = [
    ("show <id>", 'a "b" & c', ["documentation:m"], "missing_on_device"),
    ("copy run", None, ["documentation:m"], "not_observed"),
    ("clear log", "", ["cli", "documentation:m"], "matched"),
]


def test_findings_are_escaped_and_searchable(spark):
    text = "\n".join(page(spark, ROWS, complete=False, queries=3))
    assert balanced(text)
    assert '<tr data-says="show &lt;id&gt; a &quot;b&quot; &amp; c"><td>1</td><td><code>show &lt;id&gt;</code></td><td>a &quot;b&quot; &amp; c</td></tr>' in text
    assert "<code>copy run</code></td><td>-</td>" in text and "clear log" not in text
    assert "on the device: <b>1</b>, in manuals: <b>3</b>, queries: <b>3</b>" in text and "walk incomplete" in text
    assert "Contexts" not in text and "Firmware" not in text and "Configurations" not in text


def test_states(spark):
    gaps = spark.createDataFrame([("d", "vlan <value>", 2)], "device string, command string, occurrences long")
    clean = [r for r in ROWS if r[3] == "matched"]
    assert any("confirms no difference" in x for x in page(spark, clean, complete=True))
    assert any("configuration holds commands" in x for x in page(spark, clean, complete=True, gaps=gaps))
    assert any("These are the differences" in x for x in page(spark, ROWS, complete=True))
    empty = page(spark, [], complete=True)
    assert balanced("\n".join(empty)) and any("No commands." in x for x in empty) and not any("<input" in x for x in empty)
    audit = page(spark, ROWS, "audit", complete=True)
    assert any("compares nothing" in x for x in audit) and not any("Missing on the device" in x for x in audit)


def test_contexts_and_files(spark, tmp_path):
    rows = [("root", "#", [], 4, True, None, None), ("a", "(a)#", ["enter a"], 2, False, ["<x>"], 3), ("b", "(b)#", None, 0, False, None, None)]
    contexts = spark.createDataFrame(rows, "name string, fingerprint string, entry_path array<string>, commands int, complete boolean, skipped_parameters array<string>, skipped_denied long")
    executed = spark.createDataFrame([(2, "exit"), (1, "enter a")], "n int, command string")
    lines = report_lines(spark.createDataFrame(ROWS, CATALOG), complete=False, contexts=contexts, executed=executed)
    write_report(lines, str(tmp_path / "page"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "page").glob("part-*")))
    assert balanced(text) and text.startswith("<!doctype html>") and text.endswith("</html>\n")
    assert "incomplete: no sample for &lt;x&gt;; branches refused: 3" in text and "<td>root</td><td>4</td><td>complete</td>" in text
    assert text.index("enter a</code></td></tr>") < text.index("<code>exit</code>")
