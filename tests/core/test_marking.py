import re

import pytest
from pyspark.sql import functions as F

from manloom.operators import marking as K
from manloom.operators import profiles as P

LEX = K.Lexicon(domain=r"(?i)integer|\brange\b|<\d+-\d+>", address=r"(?i)ip address", effect=r"(?i)^\s*(?:enables|shows)\b", ranges=(r"(?i)from (\d+) to (\d+)", r"<(\d+)-(\d+)>", r"(\d+(?:\s\d{3})*)\s*~\s*(\d+)", r"(\d+)-(\d+)"))


def read(spark, command, line, table):
    lines = spark.createDataFrame([(0, 0, command, 0, "syntax", line)], "doc int, card int, command string, n int, part string, line string")
    rows = spark.createDataFrame([(0, 0, k, v) for k, v in table.items()], "doc int, card int, name string, text string")
    marked = K.marks(lines, rows, LEX)
    got = [(r.token, r.reason, r.written) for r in sorted(marked.collect(), key=lambda r: r.pos)]
    assert all((r.kind == "value") == (r.reason in ("compound", "domain", "default")) for r in marked.collect())
    return got, K.marked_lines(lines, marked).first().marked, rows, marked


def test_every_kind_of_evidence(spark):
    table = {
        "cost": "(cost)", "low": "low Slow", "deadtime": "deadtime Integer from 1 to 9", "port": "Port Integer", "tag": "tag Enables it", "mode": "mode Something", "addr": "addr an IP address <0-255>",
        "if-no": "if-no from 1 to 4", "hop": "hop integer <1-2> or <3-4>", "slot": "integer <0-0>/<0-0>", "gone": "gone nothing", "src": "src integer from 10 to 20",
    }
    line = "no set aa cost { low | high } deadtime { deadtime | 7 } if-no.sub-no port port [ tag ] mode addr hop2 slot src/M x | y {mode}"
    got, marked, rows, told = read(spark, "set aa", line, table)
    assert got == [
        ("no", "command-name", "no"), ("set", "command-name", "set"), ("aa", "command-name", "aa"), ("cost", "named-only", "cost"), ("low", "alternative", "low"), ("high", "untabled", "high"),
        ("deadtime", "named-then-valued", "deadtime"), ("deadtime", "alternative", "deadtime"), ("7", "untabled", "7"), ("if-no.sub-no", "compound", "<1-4>.sub-no"), ("port", "named-then-valued", "port"),
        ("port", "domain", "<port>"), ("tag", "effect", "tag"), ("mode", "named-then-valued", "mode"), ("addr", "domain", "<addr>"), ("hop2", "domain", "<hop2>"), ("slot", "domain", "<slot>"),
        ("src/M", "domain", "<10-20>"), ("x", "untabled", "x"), ("y", "untabled", "y"), ("mode", "default", "<mode>"),
    ]
    assert marked == "no set aa cost { low | high } deadtime { deadtime | 7 } <1-4>.sub-no port <port> [ tag ] mode <addr> <hop2> <slot> <10-20> x | y {<mode>}"
    unused = {(r.name, r.written, r.reason) for r in K.read_rows(rows, told).where("kind = 'unused'").collect()}
    assert unused == {(n, n, "unmatched-row") for n in ("if-no", "hop", "src", "gone")}
    assert {r.reason for r in K.read_rows(rows, told).where("name = 'mode'").collect()} == {"named-then-valued", "default"}


def test_own_name(spark):
    assert [r for _, r, _ in read(spark, "no mac", "no mac x", {"mac": "mac Text", "no": "no Text"})[0]] == ["command-name", "command-name", "untabled"]
    assert [r for _, r, _ in read(spark, "show it", "clear it", {"it": "it Text"})[0]] == ["untabled", "default"]
    assert [r for _, r, _ in read(spark, "", "it", {})[0]] == ["untabled"]
    assert read(spark, "x", "- ", {})[:2] == ([], "-")


def depths(line):
    """Brackets open around each character, a bracket counting itself."""
    out, depth = [], 0
    for c in line:
        depth += c in "{["
        out.append(depth)
        depth = max(0, depth - (c in "}]"))
    return out


@pytest.mark.parametrize("line", ["a {b|c} d", "{a [b | c] d} | e", "}} a ] b", "{a}{b|c} d", "[ a ] { b } | c", "{{a} | b} c"])
def test_groups_that_offer_a_choice(spark, line):
    df = spark.createDataFrame([(line,)], "line string").withColumn("lex", K.lexemes(F.col("line"))).withColumn("w", K._words(F.col("lex")))
    got = [(w.token, w.depth, w.choice) for w in df.first().w]
    d, want = depths(line), []
    for m in re.finditer("[a-z]", line):
        a = b = m.start()
        while a > 0 and d[a - 1] >= d[m.start()]:
            a -= 1
        while b < len(line) and d[b] >= d[m.start()]:
            b += 1
        want.append((m[0], d[m.start()], d[m.start()] > 0 and any(c == "|" and d[i] == d[m.start()] for i, c in enumerate(line[a:b], a))))
    assert got == want


def test_ranges(spark):
    cases = {
        "from 1 to 24": "1-24", "from 1 to 24, from 1 to 48": None, "from 1 to 9 that is <1-9>": "1-9", "<0-15>": "0-15", "<0-0>/<0-0>/<0-0>": None, "<0-0>/<00>/<0-0>": None, "1 000 ~ 2": "1000-2",
        "none": None, "": None, "5-7 and <5-7> or 5-8": None, "5-7 and/or 5-7": "5-7", "5-7 \x01 x": "5-7", "from 1 to 2-3": "1-2",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", K.range_in(F.col("t"), F.array(*[F.lit(r) for r in LEX.ranges])).alias("r"))
    assert {r.t: r.r for r in df.collect()} == cases


def test_ranges_with_notations_by_row(spark):
    never = "(x)(x)"
    cases = [("1-9", [], None), ("1-9 <1-9>", [r"<(\d+)-(\d+)>"], "1-9"), ("1-9 or <2-9>", [r"<(\d+)-(\d+)>"], "2-9"), ("1-9 or <2-9>", [r"<(\d+)-(\d+)>", r"(\d+)-(\d+)"], None), ("1-9", [never] * K._IN_PLACE + [r"(\d+)-(\d+)"], "1-9")]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(cases)], "i int, t string, p array<string>")
    assert {r.i: r.r for r in df.select("i", K.range_in(F.col("t"), F.col("p")).alias("r")).collect()} == {i: want for i, (_, _, want) in enumerate(cases)}


def test_profiles_are_chosen_per_document(spark, tmp_path):
    told = P.profiles(spark)
    assert [r.name for r in told.orderBy("rank").collect()] == ["russian", "english"]
    english = "\n".join(f"2.1.{i} show thing{i}\n**Command Format**\n```\nshow thing{i} level\n```\n**Parameter Description**\n```\nParameter  Values\nlevel  range 1 to 5\n```" for i in range(20))
    russian = "\n".join(f"#### `show thing{i}`\n**Синтаксис**\n```\nshow thing{i}\n```\n**Параметры**\nнет\n" for i in range(20))
    docs = {"e": english, "r": russian, "p": "plain text", "few": english[:300]}
    lines = spark.createDataFrame([(d, n, x) for d, t in docs.items() for n, x in enumerate(t.split("\n"))], "doc string, n int, line string")
    read_ = P.cards_by_profile(lines, told)
    assert {(r.doc, r.name) for r in P.picked(read_, told).collect()} == {("e", "english"), ("r", "russian")}
    assert read_.where("doc = 'e' AND name = 'english' AND part = 'parameters'").count() == 40
    (tmp_path / "bad.json").write_text('{"name": "x"}')
    with pytest.raises(ValueError, match="heading"):
        P.profiles(spark, tmp_path)
