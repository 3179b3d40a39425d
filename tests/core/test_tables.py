import pytest

from manloom.operators import tables as B

SCHEMA = "doc int, card int, command string, n int, part string, line string"


def read(spark, cards, **options):
    """Rows of each card, (syntax lines, table lines), as name -> text in order."""
    lines = []
    for k, (syntax, table) in enumerate(cards):
        lines += [(0, k, "c", n, "syntax", x) for n, x in enumerate(syntax)] + [(0, k, "c", 100 + n, "parameters", x) for n, x in enumerate(table)]
    df = spark.createDataFrame(lines, SCHEMA).repartition(3)
    out = [{} for _ in cards]
    for r in B.parameter_rows(df, **options).collect():
        assert r.name not in out[r.card]
        out[r.card][r.name] = (r.text, r.description)
    return out


HEAD = "Parameter      Description"
CASES = {
    "clean": (["set level <rate>"], [HEAD, "level          How far", "               to go", "rate           1 to 5"], {"level": "level How far to go", "rate": "rate 1 to 5"}),
    "text above the first row": (["set level"], [HEAD, "               stands above", "level          How far"], {"level": "stands above level How far"}),
    "no header, no rows": (["set level"], ["level          How far"], {}),
    "blank lines and header tails": (["set level"], ["", "Пара           Описание", "метр", "   ", "level  Text"], {"level": "level Text"}),
    "one blank between name and text": (["set privilege-value"], [HEAD, "privilege-value Level of"], {"privilege-value": "privilege-value Level of"}),
    "capital of a row": (["set isis-instance"], [HEAD, "Isis-instance is the number"], {"isis-instance": "Isis-instance is the number"}),
    "no other case": (["set mac-vlan"], [HEAD, "MAC-VLAN is a feature"], {}),
    "two words, hyphen lost": (["set process process-id"], [HEAD, "Process ID     The number"], {"process-id": "Process ID The number"}),
    "a gutter isn't one blank": (["set groupnum groupnum1"], [HEAD, "groupnum       1 to 4"], {"groupnum": "groupnum 1 to 4"}),
    "number glued by one blank": (["set groupnum groupnum1"], [HEAD, "groupnum 1     to 4"], {"groupnum1": "groupnum 1 to 4"}),
    "island in foreign prose": (["copy srcfile"], [HEAD, "               Строковый форsrcfile имя"], {"srcfile": "Строковый форsrcfile имя"}),
    "broken with hyphen": (["line vty-number"], [HEAD, "vty-           Number of", "number         the line"], {"vty-number": "vty- Number of number the line"}),
    "broken, hyphen eaten": (["show skip-lines1"], [HEAD, "skip           Lines", "               to leave", "lines1         out"], {"skip-lines1": "skip Lines to leave lines1 out"}),
    "too far apart": (["line level vty-number"], [HEAD, "level          Text", "vty-           Number", "               a", "               b", "number         c"], {"level": "level Text vty- Number a b number c"}),
    "second piece opens no row": (["line vty-number number"], [HEAD, "vty-           Text", "number         more", "number         of it"], {"vty-number": "vty- Text number more", "number": "number of it"}),
    "tail glued elsewhere": (["set interface-number"], [HEAD, "interface-     Number of the", "               Switchnumber here"], {"interface-number": "interface- Number of the Switchnumber here"}),
    "shortest completion first": (["set next-hop-address1 next-hop-address2"], [HEAD, "next-hop       An xaddress"], {"next-hop-address": "next-hop An xaddress"}),
    "ambiguous beginnings need their end": (["set port-name port-number"], [HEAD, "port           of a Switchnumber"], {"port-number": "port of a Switchnumber"}),
    "missing end, no row": (["set level port-name"], [HEAD, "level          Text", "port           of a switch"], {"level": "level Text port of a switch"}),
    "glued text": (["debug send process process-id"], [HEAD, "sendIGMP Protocol", "process-idOSPF number"], {"send": "sendIGMP Protocol", "process-id": "process-idOSPF number"}),
    "a longer word is no glued text": (["debug send level"], [HEAD, "level          Text", "sending of messages"], {"level": "level Text sending of messages"}),
    "a name once": (["set level"], [HEAD, "level          First", "level          again"], {"level": "level First level again"}),
    "dots and slashes": (["if interface-number.subinterface-number src-ip/M"], [HEAD, "interface-number  One", "subinterface-number  Two", "src-ip  Three"], {"interface-number": "interface-number One", "subinterface-number": "subinterface-number Two", "src-ip": "src-ip Three"}),
    "off the name column the spelling is exact": (["set level"], [HEAD, "                         Level of", "                         the level"], {"level": "Level of the level"}),
    "by shape": ([], [HEAD, "enable         Turns on", "disable        Turns off", "enable         again", "X              no name", "lonely"], {"enable": "enable Turns on", "disable": "disable Turns off enable again X no name lonely"}),
    "empty": ([], [], {}),
}


def test_damage_is_put_right(spark):
    got = read(spark, [(s, t) for s, t, _ in CASES.values()])
    assert {k: {n: v[0] for n, v in rows.items()} for k, rows in zip(CASES, got, strict=True)} == {k: want for k, (_, _, want) in CASES.items()}


def test_own_names_are_taken_off(spark):
    got = read(spark, [(["set drop preference"], [HEAD, "drop           (drop) - Discards it", "preference"])])[0]
    assert got == {"drop": ("drop (drop) - Discards it", "(drop) - Discards it"), "preference": ("preference", "")}


def test_tables_without_a_header_by_their_gutter(spark):
    table = ["level          How far to", "               go at most", "rate           of all"]
    assert read(spark, [(["set level rate"], table)])[0] == {}
    got = read(spark, [(["set level rate"], table), ([], table)], headerless=True)
    assert [{n: t for n, (t, _) in g.items()} for g in got] == [{"level": "level How far to go at most", "rate": "rate of all"}] * 2
    lines = spark.createDataFrame([(0, 0, x) for x in table] + [(0, 1, "one two three"), (0, 1, "of words")], "doc int, card int, line string")
    assert {r.card: (r.indent, r.edge) for r in B.gutters(lines).collect()} == {0: (0, 15), 1: (0, None)}


@pytest.mark.parametrize("word, want", [("level", "level"), ("Level", "level"), ("LEVEL", None), ("rate9", "rate9"), ("rate", "rate"), ("x", None), ("mac-address", "mac-address"), ("Mac-address", "mac-address"), ("MAC-Address", None)])
def test_spelled(spark, word, want):
    from pyspark.sql import functions as F

    lines = spark.createDataFrame([(0, 0, "c", 0, "syntax", "set level rate9 mac-address MAC-ADDRESS")], SCHEMA)
    got = B.vocabulary(lines).select(B.spelled(F.lit(word)).alias("s")).first().s
    # of two spellings that fold together the one that sorts first is known
    assert got == (None if word == "Mac-address" else want)


def test_partial_spellings_spell_their_names(spark):
    lines = spark.createDataFrame([(0, 0, "c", 0, "syntax", "set vty-number rate9")], SCHEMA)
    vocab = B.vocabulary(lines)
    got = {(r.head, r.tail, r.joint, r.name) for r in B.partial_spellings(vocab).collect()}
    want = set()
    for name in ("set", "vty-number", "rate9", "rate"):
        for written in (name, name.capitalize()):
            for k in range(1, len(name)):
                want.add((written[:k], written[k:], 0, name))
                if written[k] == "-":
                    want.add((written[:k], written[k + 1 :], 1, name))
    assert got == want
    assert {(r.head, r.name) for r in B.completions(vocab).collect()} == {(n[:k], n) for n in ("vty-number", "rate9", "rate") for k in range(3, len(n))}
