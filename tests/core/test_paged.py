import random
from collections import deque

from pyspark.sql import functions as F

from manloom.operators import paged as Q
from manloom.operators import profiles as P


def queue_order(paragraphs):
    """The order by a queue of pages, step by step."""
    intervals, flow, placed = [], [], []
    for positioned, text in [*paragraphs, (False, "FOOT")]:
        if text == "FOOT":
            if len(intervals) == sum(t == "FOOT" for _, t in paragraphs) and not flow and not placed:
                break  # nothing follows the last footer
            pages = []
            for line in placed:
                if line == placed[0]:
                    pages.append([])
                else:
                    pages[-1].append(line)
            intervals.append((flow, pages))
            flow, placed = [], []
        else:
            (placed if positioned else flow).append(text)
    waiting, held, out = deque(), [], []
    for flow, pages in intervals:
        waiting.extend(pages)
        out += waiting.popleft() if waiting else []
        out += held
        held = flow
    out += held
    for page in waiting:
        out += page
    return out


def test_pages_wait_in_a_queue(spark):
    rng = random.Random(4)
    docs = {}
    for d in range(25):
        rows, k = [], 0
        for i in range(rng.randint(1, 6)):
            for _ in range(rng.choice([0, 1, 1, 1, 2, 3])):
                rows.append((True, f"H{i}"))
                rows += [(True, f"p{(k := k + 1)}") for _ in range(rng.randint(0, 2))]
            for _ in range(rng.randint(0, 2)):
                rows.insert(rng.randint(max(0, len(rows) - 2), len(rows)), (False, f"f{(k := k + 1)}"))
            rows += [(False, "FOOT")] * rng.choice([1, 1, 1, 2])
        docs[d] = rows if rng.random() < 0.5 else rows[:-1]
    data = [(d, n, pos, t) for d, rows in docs.items() for n, (pos, t) in enumerate(rows)]
    got = Q.page_order(spark.createDataFrame(data, "doc int, n int, positioned boolean, text string").withColumn("page_footer", F.lit("^FOOT$")).repartition(3))
    by = {}
    for r in sorted(got.collect(), key=lambda r: r.place):
        by.setdefault(r.doc, []).append(r.text)
    assert {d: by.get(d, []) for d in docs} == {d: queue_order(rows) for d, rows in docs.items()}


def test_titles_over_lines(spark):
    titles = {"usage example": "Usage Example", "command format": "Command Format", "format": "Format", "x y z": "X Y Z", "y": "Y"}
    lines = ["Command", "Format", "show x", "FORMAT", "x", "y", "z", "y", "Usage", "example", "format of it"]
    df = spark.createDataFrame([(0, n, x) for n, x in enumerate(lines)], "doc int, n int, line string").withColumn("is_heading", F.lit(False))
    df = df.withColumn("titles", F.create_map(*[F.lit(x) for kv in titles.items() for x in kv]))
    got = [(r.n, r.title) for r in sorted(Q.titled(df, ["doc"]).collect(), key=lambda r: r.n)]
    assert got == [(0, "Command Format"), (2, None), (3, "Format"), (4, "X Y Z"), (7, "Y"), (8, "Usage Example"), (10, None)]


def test_forms_are_joined_where_unfinished(spark):
    def read(command, block):
        df = spark.createDataFrame([(command, block)], "command string, block array<string>")
        return df.select(Q.forms(F.transform("block", lambda x: F.struct(x.alias("line"), Q.opened_form(x, F.col("command")).alias("opened"))))).first()[0]

    assert read("bgp mode", ["bgp af-ipv4-", "mcast { a |", "b", "} c", "This is a note", "no bgp", "Nothing", "Bgp on", "Bgp Is A Feature", "[ no ]bgp x"]) == ["bgp af-ipv4-mcast { a | b } c", "no bgp", "bgp on", "[no] bgp x"]
    assert read("ping|ping6 host", ["ping a", "ping6 b", "other"]) == ["ping a", "ping6 b"]
    assert read("ipv4[ipv6]-family", ["ipv4-family x", "ipv6-family y"]) == ["ipv4-family x", "ipv6-family y"]
    assert read("x", []) == [] and read("x", ["| y"]) == []


def test_cards_of_word_files(spark):
    told = P.profiles(spark).where("name = 'english'")
    flow = []
    for i in range(3):
        flow += [f"2.1.{i} show thing{i}", "Command", "Function", f"Shows thing {i}.", "Command Format", f"show thing{i} {{ a |", "b } level", "A note on it.", "Parameter Description", "Parameter  Values", "level  range 1 to 5", "Usage Example", "sw# show"]
    rows = [("d", n, False, t) for n, t in enumerate(["Contents ..... 3", *flow, "Switch Command Line Manual 7"])]
    got = Q.paged_cards(spark.createDataFrame(rows, "doc string, n int, positioned boolean, text string"), told).where("card = 2").orderBy("n").collect()
    assert [(r.command, r.part, r.line) for r in got] == [
        ("show thing1", "heading", "2.1.1 show thing1"), ("show thing1", "purpose", "Shows thing 1."), ("show thing1", "syntax", "show thing1 { a | b } level"),
        ("show thing1", "parameters", "Parameter  Values"), ("show thing1", "parameters", "level  range 1 to 5"),
    ]
    assert all(r.had_syntax and r.had_parameters for r in got)
