"""Manuals: command candidates from plain lines, cards of a reference, repairs and measurements.

Order within a document is carried by windows over its lines: fences, tables, sections and cards
are running sums and last values, so no task holds more than Spark's window needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import spread

#: Fence languages that hold no command line.
CODE_LANGUAGES = "python py python3 ruby perl go rust c cpp java js javascript ts typescript yaml yml json toml ini xml html css diff patch sql make makefile dockerfile".split()
#: Marks of tables, prompts, labels and columns in manuals.
_FENCE = r"^\s*(?:```|~~~)"
_TABLE_HEAD = r"(?i)^\s*\|\s*`?\s*(?:command|syntax|cli|команда|синтаксис)\b"
_TABLE_ROW = r"^\s*\|\s*`?([a-zA-Z][^|`]+)`?\s*\|\s*([^|]+)"
_PROMPT_LINE = r"^\s*[\w()./@:-]+[>#]\s*([a-z][^\r\n]*?)\s*$"
_LABELLED = r"(?i)^\s*(?:command|syntax|command\s+format|usage|example|команда|синтаксис|формат\s*команды|пример)\s*:\s*([a-z][^\r\n]*?)\s*$"
_TWO_COLUMNS = r"^\s*([a-z][^\t]*?)(?:\t+|\s{2,})(\S.*?)\s*$"


def doc_lines(documents: DataFrame) -> DataFrame:
    """``(doc, text)`` -> ``(doc, n, line)``.

    Documents are dealt over all tasks before they are cut: packed as they are, Spark takes many for
    little work, and one task would sort the lines of all that it is given."""
    return spread(documents.select("doc", "text"), "doc").select("doc", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("n", "line"))


def _up_to() -> Window:
    return Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)


def carried(value: Column, group: str = "doc", order: str = "n") -> Column:
    """The last value that isn't null up to each line, such as the heading that it stands under."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def line_commands(lines: DataFrame) -> DataFrame:
    """``(doc, n, line, plain)`` -> ``(doc, n, command, description)`` of lines that are commands.

    A row of a table whose header names commands, a line after a prompt, a labelled line, and, in
    a fence or a plain text, a command with its description two blanks on, or a bare line.  A fence
    of a programming language holds none.  A line without a bar ends a table.
    """
    line = F.col("line")
    fences = F.sum(F.when(line.rlike(_FENCE), 1).otherwise(0)).over(_up_to())
    told = lines.withColumn("fences", fences).withColumn("is_fence", line.rlike(_FENCE)).withColumn("inside", (F.col("fences") % 2 == 1) & ~F.col("is_fence"))
    language = F.lower(F.regexp_extract(line, r"^\s*(?:```|~~~)\s*(\w+)", 1))
    told = told.withColumn("language", carried(F.when(F.col("is_fence") & (F.col("fences") % 2 == 1), language)))
    told = told.where(~F.col("is_fence") & ~(F.col("inside") & F.coalesce(F.col("language").isin(CODE_LANGUAGES), F.lit(False))))
    table = F.when(line.rlike(_TABLE_HEAD), True).when(~F.trim(line).startswith("|"), False)
    told = told.withColumn("in_table", F.coalesce(carried(table), F.lit(False)) & ~line.rlike(_TABLE_HEAD) & ~line.rlike(r"^\s*\|[\s:|-]+$"))
    got = lambda pattern, group=1: F.when(line.rlike(pattern), F.regexp_extract(line, pattern, group))
    loose = F.col("inside") | F.col("plain")
    command = F.coalesce(F.when(F.col("in_table"), got(_TABLE_ROW)), got(_PROMPT_LINE), got(_LABELLED), F.when(loose, F.coalesce(got(_TWO_COLUMNS), line)))
    by_table, by_mark = F.col("in_table") & line.rlike(_TABLE_ROW), line.rlike(_PROMPT_LINE) | line.rlike(_LABELLED)
    description = F.when(by_table, F.trim(F.regexp_extract(line, _TABLE_ROW, 2))).when(by_mark, "").when(loose, F.coalesce(got(_TWO_COLUMNS, 2), F.lit(""))).otherwise("")
    found = told.select("doc", "n", T.normal_command(command).alias("command"), description.alias("description"))
    return found.where("command IS NOT NULL")


def contents_commands(lines: DataFrame) -> DataFrame:
    """Commands of a table of contents: numbered lines with dot leaders and a page."""
    pattern = r"^\s*\d+(?:\.\d+)+\s+(.+?)\s*(?:\.\s*){3,}\d+\s*$"
    title = T.one_spaced(F.regexp_replace(F.regexp_extract("line", pattern, 1), r"\s*\([^)]*\)\s*", " "))
    return lines.where(F.col("line").rlike(pattern)).select("doc", "n", T.normal_command(title).alias("command")).where("command IS NOT NULL")


def joined_wraps(lines: DataFrame, group: list[str]) -> DataFrame:
    """Lines after one that ends in a dash, a bar or a backslash, or that leaves a bracket open,
    belong to it: one row per whole line, with the number of its first."""
    over = Window.partitionBy(*group).orderBy("n")
    balance = F.length(F.regexp_replace("line", r"[^\[{]", "")) - F.length(F.regexp_replace("line", r"[^\]}]", ""))
    still_open = F.coalesce(F.sum(balance).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    goes_on = F.coalesce(F.lag("line").over(over).rlike(r"[-|\\]\s*$"), F.lit(False)) | still_open
    islands = lines.withColumn("starts", (~goes_on).cast("int")).withColumn("island", F.sum("starts").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: F.trim(x["line"]))
    whole = F.aggregate(parts, F.lit(""), lambda acc, p: F.when((acc == "") | acc.rlike(r"\w-$"), F.concat(acc, p)).otherwise(F.concat(F.regexp_replace(acc, r"\s*\\$", ""), F.lit(" "), p)))
    return islands.groupBy(*group, "island").agg(F.min("n").alias("n"), whole.alias("line")).drop("island")


def cards(lines: DataFrame, heading: str, sections: dict[str, list[str]]) -> DataFrame:
    """``(doc, n, line)`` -> ``(doc, card, command, n, part, line)``: the lines of each card's parts.

    ``heading`` extracts a card's command; a bold line outside a fence names the part that
    follows, told apart by ``sections`` (part -> titles).  Syntax and parameters count only within
    fences, purpose anywhere.  Cards without a syntax or parameters part are left out.
    """
    line = F.col("line")
    told = lines.withColumn("is_fence", line.rlike(_FENCE)).withColumn("inside", (F.sum(F.col("is_fence").cast("int")).over(_up_to()) % 2 == 1) & ~F.col("is_fence"))
    is_heading = ~F.col("inside") & ~F.col("is_fence") & line.rlike(heading)
    told = told.withColumn("is_heading", is_heading).withColumn("card", F.sum(F.col("is_heading").cast("int")).over(_up_to()))
    title = F.when(~F.col("inside"), F.regexp_extract(line, r"^\s*\*\*(.+?)\*\*\s*:?\s*$", 1))
    is_title = F.coalesce(title != "", F.lit(False))
    part = reduce(lambda acc, kv: F.when(F.lower(F.trim(title)).isin([t.lower() for t in kv[1]]), kv[0]).otherwise(acc), sections.items(), F.lit("other"))
    of_card = Window.partitionBy("doc", "card").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    told = told.where("card > 0").withColumn("is_title", is_title).withColumn("part", F.last(F.when(F.col("is_title"), part), ignorenulls=True).over(of_card))
    whole = Window.partitionBy("doc", "card")
    told = told.withColumn("command", F.first(F.when(F.col("is_heading"), F.trim(F.regexp_extract(line, heading, 1))), ignorenulls=True).over(whole))
    told = told.withColumn("has_block", F.bool_or(F.col("is_title") & F.col("part").isin("syntax", "parameters")).over(whole))
    content = F.trim("line").rlike(r"\S") & ~F.col("is_fence") & ~F.col("is_title") & ~F.col("is_heading")
    kept = told.where(F.col("has_block") & content & ((F.col("part").isin("syntax", "parameters") & F.col("inside")) | (F.col("part") == "purpose")))
    return kept.select("doc", "card", "command", "n", "part", "line")


def parameter_rows(card_lines: DataFrame) -> DataFrame:
    """Rows of fixed-width parameter tables: ``(doc, card, name, description)``.

    A row begins with a token that the card's syntax holds, placeholders taken bare; lines that
    don't are the description going on.  What the syntax holds is told to every line of its card by a
    window, so the lines need no join."""
    keys = ["doc", "card"]
    bare = F.transform(F.split("line", r"[\s|{}\[\]]+"), lambda t: F.lower(F.regexp_replace(t, r"[<>{}\[\]()|]", "")))
    told = card_lines.where("part IN ('syntax', 'parameters')").withColumn("known", F.collect_list(F.when(F.col("part") == "syntax", bare)).over(Window.partitionBy(*keys)))
    body = told.where("part = 'parameters'").withColumn("name", F.lower(F.regexp_replace(F.regexp_extract("line", r"^\s*(\S+)(?:\s{2,}|\t|\s*$)", 1), r"[<>]", "")))
    body = body.withColumn("known", F.coalesce((F.col("name") != "") & F.exists("known", lambda words: F.array_contains(words, F.col("name"))), F.lit(False)))
    over = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = body.withColumn("row", F.sum(F.col("known").cast("int")).over(over)).where("row > 0")
    text = F.when(F.col("known"), F.regexp_extract("line", r"^\s*\S+\s*(.*?)\s*$", 1)).otherwise(F.trim("line"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda x: x["t"])
    return rows.groupBy(*keys, "row").agg(F.min_by("name", "n").alias("name"), T.one_spaced(F.array_join(parts, " ")).alias("description")).drop("row")


def purposes(card_lines: DataFrame) -> DataFrame:
    """``(doc, card, description)``: the purpose line that begins with most of the command's words,
    the later of equals, those words taken off; without one, all lines joined."""
    told = card_lines.where("part = 'purpose'").withColumn("line", F.trim(F.regexp_replace("line", "^[\\s*\u2219-]+", "")))
    tokens, heads = T.words(F.lower("line")), T.words(F.lower("command"))
    same = F.zip_with(F.slice(tokens, 1, F.size(heads)), heads, lambda a, b: F.coalesce(a == b, F.lit(False)))
    score = F.aggregate(same, F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")), lambda s, x: F.struct(F.when(s["on"] & x, s["k"] + 1).otherwise(s["k"]).alias("k"), (s["on"] & x).alias("on")))["k"]
    scored = told.withColumn("score", score)
    best = F.max_by(F.struct("line", "score"), F.struct("score", "n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ")
    both = scored.groupBy("doc", "card").agg(best.alias("best"), joined.alias("joined"))
    rest = F.array_join(F.slice(T.words(F.col("best.line")), F.col("best.score") + 1, F.greatest(F.size(T.words(F.col("best.line"))), F.lit(1))), " ")
    return both.select("doc", "card", F.when(F.col("best.score") > 0, F.trim(F.regexp_replace(rest, "^[\\s:\u2013\u2014-]+", ""))).otherwise(F.col("joined")).alias("description"))


def table_row_of(words: DataFrame, rows: DataFrame) -> DataFrame:
    """``(doc, card, token)`` -> adds ``key`` and ``description``: the table row of a syntax word, by the
    first of its spellings that the table lists: as it stands, before a slash, without a final mark,
    without its number, and without both."""
    low = F.lower("token")
    head = F.split(low, "/")[0]
    spellings = F.array(low, head, F.regexp_replace(low, "[.,;:]+$", ""), T.stem(low), T.stem(head))
    listed = rows.where("name IS NOT NULL").groupBy("doc", "card", "name").agg(F.min("description").alias("description"))
    tables = listed.groupBy("doc", "card").agg(F.map_from_entries(F.collect_list(F.struct("name", "description"))).alias("_table"))
    # merged: by the size of the files that they come from, tables look small enough to broadcast
    told = words.join(tables.hint("merge"), ["doc", "card"], "left").withColumn("key", F.get(F.filter(spellings, lambda k: F.map_contains_key("_table", k)), F.lit(0)))
    return told.withColumn("description", F.col("_table")[F.col("key")]).drop("_table")


def unmatched_rows(card_lines: DataFrame, rows: DataFrame) -> DataFrame:
    """``(doc, card, name, description)``: rows of a table that no word of the card's syntax stands for."""
    token = F.regexp_replace("raw", r"[<>{}\[\]|]", "")
    words = card_lines.where("part = 'syntax'").select("doc", "card", F.explode(T.words(F.regexp_replace("line", r"([{}\[\]|])", " $1 "))).alias("raw")).select("doc", "card", token.alias("token")).where("token <> ''")
    used = table_row_of(words, rows).where("key IS NOT NULL").select("doc", "card", F.col("key").alias("name"))
    return rows.join(used.distinct().hint("merge"), ["doc", "card", "name"], "left_anti").select("doc", "card", "name", "description")


def marks(card_lines: DataFrame, rows: DataFrame) -> DataFrame:
    """``(doc, card, n, pos, token, kind, written, reason)`` for every word of the syntax lines.

    The first evidence counts: a word of the command's own name is a keyword; a word the table
    doesn't list is one too; one of several alternatives is; a listed word right after itself is
    the value; a listed word with a numeric domain, or spelled as a placeholder, is a parameter;
    else a listed word is a value.
    """
    token = F.regexp_replace("raw", r"[<>{}\[\]|]", "")
    words = card_lines.where("part = 'syntax'").select("doc", "card", "command", "n", F.posexplode(T.words(F.regexp_replace("line", r"([{}\[\]|])", " $1 "))).alias("pos", "raw"))
    over = Window.partitionBy("doc", "card", "n").orderBy("pos")
    words = words.withColumn("token", token).withColumn("beside", (F.lag("raw").over(over) == "|") | (F.lead("raw").over(over) == "|")).where("token <> ''").withColumn("previous", F.lag("token").over(over))
    told = table_row_of(words, rows)
    own = F.array_contains(T.words(F.col("command")), F.col("token"))
    domain = T.numeric_domain(F.coalesce("description", F.lit("")))
    spelled = F.col("raw").rlike("^<") | T.is_shouted(F.col("token"))
    reason = (
        F.when(own, "name").when(F.lower("previous") == F.lower("token"), "repeat").when(F.col("description").isNull() & ~spelled, "untabled")
        .when(F.coalesce("beside", F.lit(False)) & domain.isNull() & ~spelled, "alternative").when(domain.isNotNull(), "domain").when(spelled, "spelled").otherwise("default")
    )
    kind = F.when(reason.isin("name", "untabled", "alternative"), "keyword").otherwise("parameter")
    written = F.when(kind == "keyword", F.col("token")).otherwise(T.placeholder(F.col("token"), F.coalesce("description", F.lit(""))))
    return told.select("doc", "card", "n", "pos", "token", kind.alias("kind"), written.alias("written"), reason.alias("reason"))


def card_gate(rows: DataFrame, by: list[str], *, min_cards: int = 20, min_share: float = 0.9) -> DataFrame:
    """``(by..., structured boolean)`` per card -> ``cards, structured, qualifies`` per group: enough
    cards, and enough of them structured."""
    told = rows.groupBy(*by).agg(F.count("*").alias("cards"), F.count_if("structured").alias("structured"))
    return told.withColumn("qualifies", (F.col("cards") >= min_cards) & (F.col("structured") >= F.lit(min_share) * F.col("cards")))


def weld_repairs(counts: DataFrame, *, headings: DataFrame | None = None, margin: int = 3, piece: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., token, seen)`` -> ``(by..., token, seen, cut, repaired)`` of tokens whose two halves
    both stand alone at least ``margin`` times as often; the first such cut.  Words of headings and
    tokens with a dot or slash stay.  Each value of ``by`` is a dictionary of its own."""
    able = counts.where(~F.col("token").rlike("[./]") & (F.length("token") >= 2 * piece))
    if headings is not None:
        able = able.join(headings, [*by, "token"], "left_anti")
    cuts = able.select(*by, "token", "seen", F.explode(F.sequence(F.lit(piece), F.length("token") - piece)).alias("cut"))
    cuts = cuts.withColumn("head", F.expr("left(token, cut)")).withColumn("tail", F.expr("substring(token, cut + 1)"))
    alone = counts.where(F.col("seen") >= margin)
    heads, tails = alone.select(*by, F.col("token").alias("head"), F.col("seen").alias("h")), alone.select(*by, F.col("token").alias("tail"), F.col("seen").alias("t"))
    found = cuts.join(heads, [*by, "head"]).where(F.col("h") >= margin * F.col("seen")).join(tails, [*by, "tail"]).where(F.col("t") >= margin * F.col("seen"))
    return found.groupBy(*by, "token", "seen").agg(F.min("cut").alias("cut")).withColumn("repaired", F.expr("concat(left(token, cut), ' ', substring(token, cut + 1))"))


def says_no_parameters(text: Column) -> Column:
    """A block that states there are none rather than failing to list them."""
    joined = F.regexp_replace(F.regexp_replace(text, "(?m)^\\s*[\u2014\u2013-]\\s*$", " "), r"(\w)-\s*\n\s*(\w)", "$1$2")
    return joined.rlike(r"(?im)^\s*(?:none|no parameters?|нет)\s*\.?\s*$") | T.one_spaced(joined).rlike(r"(?i)\b(?:has|takes|with) no (?:parameters?|arguments?)\b|не (?:имеет|принимает) параметров")


def measurement(card_rows: DataFrame, marked: DataFrame) -> DataFrame:
    """``(measure, n, percent)``: cards, those with forms and descriptions, words by reason, and the
    share of parameters with a numeric domain; percents to one digit."""
    cards_ = card_rows.groupBy("doc", "card").agg(F.bool_or(F.col("part") == "syntax").alias("forms"), F.bool_or(F.col("part") == "parameters").alias("tables"), F.bool_or(F.col("part") == "purpose").alias("purpose"))
    one = cards_.agg(F.count("*").alias("cards"), F.count_if("forms").alias("with forms"), F.count_if("tables").alias("with parameters"), F.count_if("purpose").alias("with purpose"))
    names = ["cards", "with forms", "with parameters", "with purpose"]
    told = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("n"), F.round(100 * F.col(m) / F.col("cards"), 1).alias("percent")) for m in names])).alias("m")).select("m.*")
    # the few counts go into one row, so the words are told apart once and no row is broadcast
    counts = marked.groupBy("reason").agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.collect_list(F.struct("reason", "n")).alias("r"))
    reasons = counts.select("all", F.explode("r").alias("r")).select(F.concat(F.lit("reason "), F.col("r.reason")).alias("measure"), "r.n", F.round(100 * F.col("r.n") / F.col("all"), 1).alias("percent"))
    return told.unionByName(reasons)


#: Headings, bullets and running titles of structured manuals.
_FORMAT_HEAD = r"(?i)^\s*(?:command\s+format|command\s+form|command\s+syntax|syntax|формат\s+команды|синтаксис)\s*:?\s*$"
_END_HEAD = r"^\s*(?=\p{Lu})(?i:parameters?|command\s+function|command\s+view|default(?:\s+value)?|usage\s+example|command\s+guidance|description|note|параметр(?:ы|ов)?|описание|функция|режим|значение|пример|примечание)\b"
_SECTION = r"^\s*\d+(?:\.\d+)+\s+([a-z][^\r\n.]*?)\s*$"
_BULLET = "^\\s*(?:[•●▪◦∙·‣▫○▸➢]\\s*|[-*]\\s+)"
_NOISE = r"(?i)^(?:chapter\b|table\s+of\b|содержание\b|руководство\b)"


def syntax_root(form: Column) -> Column:
    """First word of a form in lower case, after a negation the second."""
    tokens = T.words(F.lower(form))
    return F.coalesce(F.when(F.coalesce(F.get(tokens, F.lit(0)).isin(*T.NEGATIONS), F.lit(False)), F.get(tokens, F.lit(1))).otherwise(F.get(tokens, F.lit(0))), F.lit(""))


def looks_like_syntax(line: Column) -> Column:
    bare = F.trim(line)
    return bare.rlike(r"^[a-z][\x20-\x7e]*$") & ~bare.contains("#") & ~bare.rlike(_NOISE) & ~bare.rlike(r"[.,:;]$")


def structured_syntax(lines: DataFrame) -> DataFrame:
    """``(doc, n, line)`` -> ``(doc, n, syntax)`` of manuals that print a heading over each format.

    A format block runs from its heading to the next one or to the heading of another part.  Its
    wrapped lines are joined, and a form counts if it begins like the command of its numbered
    section, where there is one.
    """
    line = F.col("line")
    over = Window.partitionBy("doc").orderBy("n")
    bare = F.trim(F.regexp_replace(line, _BULLET, ""))
    told = lines.withColumn("bare", bare).where("bare <> ''").withColumn("opens", line.rlike(_FORMAT_HEAD))
    titled = F.coalesce(F.lag("line").over(over).rlike(r"^\s*\d+(?:\.\d+)+\s*$"), F.lit(False))
    title = F.when(line.rlike(_SECTION), F.regexp_extract(line, _SECTION, 1)).when(titled & looks_like_syntax(F.regexp_replace("bare", r"(?i)\s+(?:command|команда)\s*$", "")), F.regexp_replace("bare", r"(?i)\s+(?:command|команда)\s*$", ""))
    told = told.withColumn("title", title).withColumn("root", F.coalesce(carried(F.when(F.col("title").isNotNull(), syntax_root(F.col("title")))), F.lit("")))
    state = F.when(F.col("opens"), True).when(line.rlike(_END_HEAD), False)
    told = told.withColumn("inside", F.coalesce(carried(state), F.lit(False))).withColumn("block", F.sum(F.col("opens").cast("int")).over(_up_to()))
    body = told.where(F.col("inside") & ~F.col("opens") & F.col("title").isNull() & ~F.col("bare").rlike(_NOISE))
    forms = joined_wraps(body.select("doc", "block", "root", "n", F.col("bare").alias("line")), ["doc", "block", "root"])
    kept = forms.where(looks_like_syntax(F.col("line")) & ((F.col("root") == "") | (syntax_root(F.col("line")) == F.col("root"))))
    return kept.select("doc", "n", F.col("line").alias("syntax"))


def pick_profile(lines: DataFrame, headings: dict[str, str], sections: dict[str, list[str]], *, min_cards: int = 20, min_share: float = 0.9) -> DataFrame:
    """``(doc, profile)``: the first of the named heading patterns whose cards make the document
    regular enough; documents that suit none are left out."""
    parts = []
    for place, (name, heading) in enumerate(headings.items()):
        each = cards(lines, heading, sections).groupBy("doc", "card").agg(F.bool_or(F.col("part") == "syntax").alias("structured"))
        parts.append(card_gate(each, ["doc"], min_cards=min_cards, min_share=min_share).where("qualifies").select("doc", F.struct(F.lit(place).alias("place"), F.lit(name).alias("name")).alias("p")))
    return reduce(DataFrame.unionByName, parts).groupBy("doc").agg(F.min("p")["name"].alias("profile"))
