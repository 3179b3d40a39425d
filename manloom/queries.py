"""Bindings of the operators to the test tables, with the DuckDB SQL each is held against.

The tables hold no manuals, so every binding is an analogue: lines of documents, paths of pages,
names of parts and rows of orders stand in for commands, contexts and configuration lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import catalog as C
from .operators import config as G
from .operators import contexts as X
from .scratch import keep, spread

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- relations that several bindings share ------------------------------------------------------

_LINES = r"""
lines AS (
  SELECT doc_id, source, lang, i - 1 AS line_no, trim(regexp_replace(l, '\s+', ' ', 'g')) AS line
  FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
)"""

_PATHS = r"""
pages_at AS (
  SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
         rtrim(regexp_replace(regexp_extract(url, '^[a-z]+://(.*)$', 1), '[?#].*$', ''), '/') AS path
  FROM pages
)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "l"))
    return docs.select("doc_id", "source", "lang", "line_no", F.trim(F.regexp_replace("l", r"\s+", " ")).alias("line"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://(.*)$", 1), r"[?#].*$", "")
    return _table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"^([a-z]+)://", 1).alias("scheme"), F.rtrim(rest, F.lit("/")).alias("path"))


def _number(source: Column) -> Column:
    return F.regexp_extract(source, r"(\d+)", 1).cast("int")


def _line_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as catalog entries: even sources are the device, odd ones manuals."""
    lines = _lines(spark, sf_dir).where("line <> ''")
    source = F.when(_number(F.col("source")) % 2 == 0, "cli").otherwise(F.concat(F.lit("documentation:"), F.col("source")))
    return lines.select(F.col("line").alias("command"), F.lit("").alias("description"), F.lit(False).alias("executable"), source.alias("source"), F.col("doc_id").alias("rank"))


# -- reconciliation -----------------------------------------------------------------------------

_STATUS = f"""
WITH {_LINES}, cat AS (
  SELECT line, bool_or(CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 2 = 0) AS dev, bool_or(CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 2 = 1) AS man
  FROM lines WHERE line <> '' GROUP BY line
), st AS (SELECT CASE WHEN dev AND man THEN 'matched' WHEN dev THEN 'undocumented' ELSE 'missing_on_device' END AS status FROM cat)
"""


@_query(_STATUS + "SELECT s.status, count(st.status) AS n FROM (VALUES ('matched'), ('undocumented'), ('missing_on_device'), ('not_observed')) s(status) LEFT JOIN st USING (status) GROUP BY s.status")
def reconcile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented against observed, a row for every status."""
    return C.status_counts(C.reconciled(C.source_union(_line_sources(spark, sf_dir)), complete=True))


@_query(_STATUS.replace("'missing_on_device'", "'not_observed'") + "SELECT s.status, count(st.status) AS n FROM (VALUES ('matched'), ('undocumented'), ('missing_on_device'), ('not_observed')) s(status) LEFT JOIN st USING (status) GROUP BY s.status")
def reconcile_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where the scan was cut short: nothing is proved missing."""
    return C.status_counts(C.reconciled(C.source_union(_line_sources(spark, sf_dir)), complete=False))


@_query(
    f"WITH {_LINES} SELECT line AS command, string_agg(DISTINCT CASE WHEN CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 2 = 0 THEN 'cli' ELSE 'documentation:' || source END, ',' ORDER BY CASE WHEN CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 2 = 0 THEN 'cli' ELSE 'documentation:' || source END) AS sources, "
    "count(DISTINCT CASE WHEN CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 2 = 0 THEN 'cli' ELSE source END) AS n FROM lines WHERE line <> '' GROUP BY line"
)
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of every line."""
    union = C.source_union(_line_sources(spark, sf_dir))
    return union.select("command", F.array_join("sources", ",").alias("sources"), F.size("sources").cast("long").alias("n"))


_ABSENT = f"""
WITH {_PATHS}, cmd AS (
  SELECT replace(path, '/', ' ') AS command, bool_or(scheme = 'https') AS dev FROM pages_at WHERE path <> '' GROUP BY 1
), step AS (
  SELECT command, i AS n, array_to_string(string_split(command, ' ')[1:i], ' ') AS child, array_to_string(string_split(command, ' ')[1:i-1], ' ') AS parent
  FROM cmd, LATERAL (SELECT unnest(generate_series(1, len(string_split(command, ' ')))) AS i)
), dev AS (
  SELECT DISTINCT child FROM step JOIN cmd USING (command) WHERE dev
), asked AS (SELECT '' AS parent UNION SELECT child FROM dev WHERE child NOT LIKE '% % %'), stop AS (
  SELECT command, min(n) AS n FROM step WHERE parent NOT IN (SELECT parent FROM asked) OR child NOT IN (SELECT child FROM dev) GROUP BY command
)
SELECT step.command FROM step JOIN stop USING (command, n) WHERE parent IN (SELECT parent FROM asked) AND child NOT IN (SELECT child FROM dev)
"""


def _path_catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Page paths as commands, https ones with all that leads to them on the device; and the nodes
    of up to two words as enumerated."""
    pages = _paths(spark, sf_dir).where("path <> ''").select(F.regexp_replace("path", "/", " ").alias("command"), (F.col("scheme") == "https").alias("dev"))
    up = pages.where("dev").select(F.explode(C.prefixes(T.words(F.col("command")))).alias("p")).select(F.col("p.prefix").alias("command")).distinct()
    entries = pages.select("command", F.lit("documentation:web").alias("source")).union(up.select("command", F.lit("cli")))
    cat = C.source_union(entries.withColumn("description", F.lit("")).withColumn("executable", F.lit(False)).withColumn("rank", F.lit(0)))
    listed = up.where(F.size(T.words(F.col("command"))) <= 2).select(F.col("command").alias("prefix")).union(spark.createDataFrame([("",)], "prefix string"))
    return cat, listed


@_query(_ABSENT)
def provably_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented paths that the device, asked, did not offer."""
    cat, listed = _path_catalog(spark, sf_dir)
    return C.provably_absent(cat, listed).where("absent").select("command")


@_query(
    f"WITH {_LINES} SELECT line AS command, arg_min(source, (CASE WHEN lang = 'de' THEN 0 ELSE 1 END, doc_id, line_no)) AS description, arg_min(lang, (CASE WHEN lang = 'de' THEN 0 ELSE 1 END, doc_id, line_no)) AS language FROM lines WHERE line <> '' GROUP BY line"
)
def description_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which text a command keeps: the preferred language first, then reading order."""
    entries = _lines(spark, sf_dir).where("line <> ''").select(F.col("line").alias("command"), F.col("source").alias("description"), F.col("lang").alias("language"), F.struct("doc_id", "line_no").alias("place"))
    return C.described(entries, "de")


# -- trees and prefixes -------------------------------------------------------------------------


@_query(
    f"""WITH {_PATHS}, u AS (SELECT path, length(url) AS n, unnest(generate_series(1, len(string_split(path, '/')))) AS i FROM pages_at), s AS (
  SELECT array_to_string(string_split(path, '/')[1:i], '/') AS name, count(*) AS contexts, CAST(sum(i) AS BIGINT) AS commands, CAST(sum(n) AS BIGINT) AS queries FROM (SELECT u.*, len(string_split(path, '/')) AS depth FROM u) GROUP BY 1
), t AS (SELECT name, contexts, queries, CAST(round_even(queries * CAST(0.15 AS DOUBLE), 0) AS BIGINT) AS t FROM s WHERE name IN (SELECT path FROM pages_at))
SELECT name, contexts, queries, CASE WHEN queries * CAST(0.15 AS DOUBLE) < 1 THEN '<1s' WHEN t < 60 THEN '~' || t || 's' WHEN t % 60 = 0 THEN '~' || t // 60 || 'm' ELSE '~' || t // 60 || 'm' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') || 's' END AS badge FROM t"""
)
def subtree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below every page path, and the time that their addresses as queries would take."""
    nodes = _paths(spark, sf_dir).select(F.col("path").alias("name"), F.lit(1).alias("commands"), F.length("url").alias("queries"))
    return X.rollups(nodes).select("name", "contexts", "queries", "badge")


@_query(
    f"""WITH {_PATHS}, p AS (SELECT DISTINCT path AS name FROM pages_at),
u AS (SELECT name, unnest(generate_series(1, len(string_split(name, '/')) - 1)) AS i FROM p), c AS (SELECT name, i, array_to_string(string_split(name, '/')[1:i], '/') AS up FROM u),
h AS (SELECT DISTINCT string_split(name, '/')[1] AS name FROM p), a AS (SELECT name FROM p UNION SELECT name FROM h),
f AS (SELECT c.name, arg_max(c.up, c.i) AS near FROM c JOIN a ON a.name = c.up GROUP BY 1), r AS (SELECT arg_min(name, (len(string_split(name, '/')), name)) AS root FROM a)
SELECT a.name, coalesce(f.near, r.root) AS parent FROM a CROSS JOIN r LEFT JOIN f USING (name) WHERE a.name <> r.root"""
)
def nearest_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest present ancestor of all page paths; few of their ancestors are pages themselves."""
    pages = _paths(spark, sf_dir).select(F.col("path").alias("name"))
    hosts = pages.select(F.split("name", "/")[0].alias("name"))
    return X.parents(pages.union(hosts).distinct()).where("parent IS NOT NULL").select("name", "parent")


@_query("WITH t AS (SELECT DISTINCT p_type || ' ' || p_name AS c FROM part), u AS (SELECT c, unnest(generate_series(1, len(string_split(c, ' ')))) AS i FROM t) SELECT i AS depth, count(DISTINCT array_to_string(string_split(c, ' ')[1:i], ' ')) AS nodes FROM u GROUP BY i")
def token_tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the word tree of part types and names, by depth."""
    commands = _table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_name").alias("command"))
    return C.token_tree(commands).groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("nodes"))


@_query(f"WITH {_PATHS} SELECT DISTINCT replace(path, '/', ' ') AS command FROM pages_at WHERE scheme = 'https' AND split_part(path, '/', 2) = 'en' AND len(string_split(path, '/')) > 2")
def prefix_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device commands below entry paths: the English pages of every host."""
    pages = _paths(spark, sf_dir)
    catalog = pages.select(F.replace("path", F.lit("/"), F.lit(" ")).alias("command"), F.array(F.when(F.col("scheme") == "https", "cli").otherwise("documentation:web")).alias("sources"))
    leads = pages.select(F.concat(F.split("path", "/")[0], F.lit(" en")).alias("lead")).distinct()
    return C.commands_below(catalog, leads).select("command")


@_query(
    """SELECT r.r_name || ' ' || n.n_name || ' ' || c.k AS command FROM nation n JOIN region r ON n_regionkey = r_regionkey
CROSS JOIN (SELECT DISTINCT c_mktsegment AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation)) c"""
)
def replicate_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subtree of one nation copied to all nations that look like it."""
    from .operators.crawl import Limits, replicate

    n = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.regexp_replace(F.concat_ws("\x01", "r_name", "n_name"), " ", "\x02").alias("node"), "n_name")
    n = n.withColumn("node", F.regexp_replace("node", "\x01", " "))
    first = n.agg(F.min_by(F.struct("n_nationkey", "node"), "n_name").alias("f")).select("f.*")
    held = _table(spark, sf_dir, "customer").join(F.broadcast(first), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws(" ", "node", "c_mktsegment").alias("command")).distinct()
    commands = held.withColumn("description", F.lit("")).withColumn("executable", F.lit(True))
    alike = n.join(F.broadcast(first.select(F.col("node").alias("canonical")))).where("node <> canonical").select(F.col("node").alias("prefix"), "canonical")
    done, _, _ = replicate(commands, alike, Limits(max_depth=64))
    return done.select(F.regexp_replace("command", "\x02", " ").alias("command"))


# -- text ---------------------------------------------------------------------------------------


@_query(
    r"""WITH w AS (SELECT unnest(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')) AS t FROM part) SELECT kind, count(*) AS n, count(DISTINCT t) AS tokens FROM (
SELECT t, CASE WHEN lower(t) IN ('<cr>', '<return>', '<enter>', '<[enter]>', '[enter]') THEN 'cr' WHEN (t LIKE '<%' AND t LIKE '%>') OR (upper(t) = t AND lower(t) <> t) OR regexp_matches(t, '[\[\]{}|]') THEN 'parameter' ELSE 'keyword' END AS kind FROM w) GROUP BY kind"""
)
def token_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of the words of parts."""
    tokens = _table(spark, sf_dir, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")).alias("t"))
    return tokens.groupBy(T.option_kind(F.col("t")).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("t").alias("tokens"))


@_query(
    r"""WITH k AS (SELECT doc_id, i - 1 AS line_no, trim(regexp_replace(l, '\s+', ' ', 'g')) AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM (SELECT doc_id, translate(replace(text, 'token', 'secret'), '=:_', '   ') AS text FROM documents))),
v AS (SELECT doc_id, line_no, l, list_filter(string_split(l, ' '), lambda x: x <> '') AS w FROM k),
p AS (SELECT *, list_filter(generate_series(1, len(w)), lambda i: i < len(w) AND list_contains(['password','secret','community','pre-shared','psk','key','key-string','authentication-key','shared-key','private-key','certificate','cipher'], lower(w[i])))[1] AS cut FROM v)
SELECT doc_id, line_no, CASE WHEN cut IS NULL THEN l ELSE array_to_string(w[1:cut], ' ') || ' <redacted>' END AS line FROM p"""
)
def secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines, what follows a secret word blanked."""
    docs = _table(spark, sf_dir, "documents").withColumn("text", F.translate(F.replace("text", F.lit("token"), F.lit("secret")), "=:_", "   "))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "l")).withColumn("line", F.trim(F.regexp_replace("l", r"\s+", " ")))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.secrets_blanked(F.col("line")).alias("line"))


@_query(
    rf"""WITH {_LINES}, c AS (SELECT trim(regexp_replace(line, '^`+|`+$', '', 'g')) AS c FROM lines)
SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN c = '' THEN 'empty' WHEN strlen(c) > 512 THEN 'too long' WHEN NOT regexp_full_match(c, '[\x20-\x7e]*') THEN 'not printable ascii' WHEN contains(c, '?') THEN 'question'
WHEN regexp_matches(c, '[.,:;]$') THEN 'sentence' WHEN regexp_matches(c, '^(sudo|ssh|telnet) ') THEN 'host tool' WHEN NOT regexp_full_match(c, '[a-z][a-z0-9-]*( [^ ]+)*') THEN 'not a command' WHEN regexp_matches(c, '->|=>') THEN 'arrow'
WHEN len(string_split(c, ' ')) > 32 THEN 'too many words' ELSE 'ok' END AS verdict FROM c) GROUP BY verdict"""
)
def command_normalize_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines would pass for commands, and why the others don't."""
    return _lines(spark, sf_dir).groupBy(T.command_verdict(F.col("line")).alias("verdict")).agg(F.count("*").alias("n"))


_FOLDED = rf"""WITH {_LINES}, f AS (SELECT array_to_string(list_transform(list_filter(string_split(line, ' '), lambda w: w <> ''), lambda w: CASE WHEN regexp_matches(w, '[0-9]') OR length(w) > 24 THEN '<value>' ELSE w END), ' ') AS command FROM lines WHERE line <> '')"""


@_query(_FOLDED + " SELECT command, count(*) AS occurrences FROM f GROUP BY command")
def skeleton_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines, their values folded."""
    return _lines(spark, sf_dir).where("line <> ''").groupBy(T.skeleton(F.col("line")).alias("command")).agg(F.count("*").alias("occurrences"))


@_query(
    rf"""WITH {_LINES}, v AS (SELECT list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM lines WHERE line <> ''),
p AS (SELECT w, list_filter(generate_series(1, len(w)), lambda i: i < len(w) AND list_contains(['password','secret','community','pre-shared','psk','key','key-string','authentication-key','shared-key','private-key','certificate','cipher'], lower(w[i])))[1] AS cut FROM v),
b AS (SELECT CASE WHEN cut IS NULL THEN w ELSE list_append(w[1:cut], '<redacted>') END AS w FROM p),
f AS (SELECT array_to_string(list_transform(w, lambda w: CASE WHEN regexp_matches(w, '[0-9]') OR length(w) > 24 THEN '<value>' ELSE w END), ' ') AS command FROM b)
SELECT command, count(*) AS occurrences FROM f GROUP BY command ORDER BY occurrences DESC, command LIMIT 20"""
)
def gap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty gaps that occur most, all lines being unmatched."""
    matched = _lines(spark, sf_dir).where("line <> ''").select(F.lit("d").alias("device"), F.array("line").alias("path"), F.lit("unmatched").alias("status"))
    return G.gaps(matched).drop("device").orderBy(F.desc("occurrences"), "command").limit(20)


@_query(
    rf"""WITH {_LINES}, told AS (
  SELECT doc_id, line_no, [' ', 'Chassis Serial Number : ', 'System ID: ', 'set psk ', 'snmp-server user bob ', 'tokenring ', 'Device name:', 'base 00:1a:2B:33:44:55 and 001a.2b33.4455 '][line_no % 8 + 1] || line AS line FROM lines WHERE line <> ''
)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, trim(regexp_replace(regexp_replace(
  CASE WHEN regexp_matches(line, '(?i)\b(?:password|secret|community|pre-shared|psk|snmp-server\s+(?:user|community)|key(?:-string)?|md5|hmac|authentication-key|shared-key|private-key|certificate)\b') THEN '<redacted line>' ELSE line END,
  '(?i)^([^:]*\b(?:serial|s/n|sn|system\s+id|chassis\s+id|host\s*name|hostname|device\s+name|mac\s+address|base\s+ethernet)\b[^:]*:)\s*\S.*$', '\1 <redacted>'),
  '\b(?:[0-9a-fA-F]{{2}}[:-]){{5}}[0-9a-fA-F]{{2}}\b|\b(?:[0-9a-fA-F]{{4}}\.){{2}}[0-9a-fA-F]{{4}}\b', '<redacted>', 'g')) AS line
FROM told"""
)
def identity_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines, each below one of eight labels or none, what may tell who or what redacted."""
    labels = [" ", "Chassis Serial Number : ", "System ID: ", "set psk ", "snmp-server user bob ", "tokenring ", "Device name:", "base 00:1a:2B:33:44:55 and 001a.2b33.4455 "]
    lines = _lines(spark, sf_dir).where("line <> ''")
    labelled = F.concat(F.get(F.array(*[F.lit(x) for x in labels]), F.col("line_no") % 8), "line")
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.identity_redacted(labelled).alias("line"))


@_query(rf"WITH {_PATHS} SELECT '(' || regexp_replace(path, '[0-9]+', '*', 'g') || ')' || ['#', '>', '$'][page_id % 3 + 1] AS shape, count(*) AS n, min(page_id) AS first_page FROM pages_at GROUP BY 1")
def fingerprint_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the fingerprint of a prompt that names their path, at the end of an answer."""
    mark = F.get(F.array(F.lit("#"), F.lit(">"), F.lit("$")), (F.col("page_id") % 3).cast("int"))
    output = F.concat(F.lit("one line\nhost>\nsw(x)]\n\nsw("), "path", F.lit(")"), mark)
    return _paths(spark, sf_dir).groupBy(T.fingerprint_of(output).alias("shape")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@_query(rf"WITH {_LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, part FROM (SELECT doc_id, line_no, unnest(list_filter(list_transform(string_split(translate(line, '[]{{}}', '()()'), '|'), lambda p: trim(p)), lambda p: p <> '')) AS part FROM lines)")
def alternatives_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut at vertical bars outside of groups."""
    from .functions.grammar import alternatives

    line = F.translate("line", "[]{}", "()()")
    return _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.explode(alternatives(line)).alias("part"))


@_query(
    """SELECT p_partkey, pos, command FROM (SELECT p_partkey, 0 AS pos, lower(p_name) AS command FROM part UNION ALL SELECT p_partkey, 1, lower(p_name) || ' size ' || p_size FROM part UNION ALL SELECT p_partkey, 2, lower(p_name) || ' all' FROM part)
WHERE regexp_full_match(command, '[a-z][a-z0-9-]*( [^ ]+)*')"""
)
def grammar_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concrete forms of a grammar written from each part."""
    from .functions.grammar import expand_syntax

    rows = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower("p_name"), F.lit(" [size "), F.col("p_size").cast("string"), F.lit(" | all]")).alias("syntax"))
    return expand_syntax(rows, F.col("syntax")).select("p_partkey", F.col("pos").cast("int").alias("pos"), "command")


# -- windows, top-k, sampling, merging ----------------------------------------------------------


@_query(rf"WITH {_PATHS}, r AS (SELECT page_id, path, row_number() OVER (PARTITION BY regexp_replace(path, '[0-9]+', '*', 'g') ORDER BY page_id) AS k FROM pages_at) SELECT page_id, path FROM r WHERE k <= 2")
def shape_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two pages of each shape."""
    pages = _paths(spark, sf_dir).withColumn("shape", T.folded(F.col("path")))
    return C.first_per_group(pages, ["shape"], ["page_id"], 2).select("page_id", "path")


@_query(
    "WITH s AS (SELECT l_orderkey AS o, sha256(string_agg(DISTINCT l_returnflag || l_linestatus || chr(9) || 'keyword', chr(10) ORDER BY l_returnflag || l_linestatus || chr(9) || 'keyword')) AS signature FROM lineitem GROUP BY 1) SELECT signature, min(o) AS canonical, count(*) - 1 AS derived FROM s GROUP BY signature"
)
def signature_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the same set of line kinds: one is walked, the others derived."""
    from .operators.help import signatures

    options = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("prefix"), F.concat("l_returnflag", "l_linestatus").alias("token"), F.lit("keyword").alias("kind"))
    return signatures(options).groupBy("signature").agg(F.min("prefix").alias("canonical"), (F.count("*") - 1).alias("derived"))


@_query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS c FROM orders) SELECT o_orderkey FROM r WHERE n % greatest(1, c // 25) = 0 AND n < 25 * greatest(1, c // 25)")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five orders spread over all."""
    return C.systematic_sample(_table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 25)


@_query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading that a line stands under, as the last user turn carried on."""
    from .operators.manuals import carried

    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", carried(F.when(F.col("role") == "user", F.col("turn")), "conv_id", "turn").alias("section"))


@_query(
    r"""WITH w AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL AND trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''))
SELECT doc_id, count(*) AS options, CAST(sum(first_pos) AS BIGINT) AS places FROM (SELECT doc_id, t, min(pos) AS first_pos FROM w GROUP BY doc_id, t) GROUP BY doc_id"""
)
def option_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that list the words of each document: of a repeated word the first line counts."""
    from .operators.help import parse_help

    listed = F.array_join(F.transform(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda w: F.concat(F.lit("  w"), w, F.lit("  x"))), "\n")
    options = parse_help(_table(spark, sf_dir, "documents").where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select(F.concat(F.lit("d"), "doc_id").alias("prefix"), listed.alias("output")), error_words=True)
    return options.groupBy(F.expr("substring(prefix, 2)").cast("long").alias("doc_id")).agg(F.count("*").alias("options"), F.sum("pos").cast("long").alias("places"))


@_query("WITH n AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id), o AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events WHERE event_type <> 'purchase' GROUP BY user_id) SELECT user_id, coalesce(o.event_type, n.event_type) AS event_type, CAST(epoch_us(coalesce(o.ts, n.ts)) AS BIGINT) AS ts_us FROM n LEFT JOIN o USING (user_id)")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest event of each user, replaced where a newer scan has one of its own."""
    events = _table(spark, sf_dir, "events")
    newest = lambda e: e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))
    merged = C.merged_by_key(newest(events), newest(events.where("event_type <> 'purchase'")), "user_id")
    return merged.select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@_query("SELECT user_id, count(*) AS contexts, CAST(sum(CAST(value AS BIGINT)) AS BIGINT) AS queries, bool_and(value > 5) AS complete FROM events GROUP BY user_id")
def fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan is complete only if all of its parts are."""
    parts = _table(spark, sf_dir, "events").select("user_id", F.lit(1).alias("commands"), F.bround("value").cast("long").alias("queries"), (F.col("value") > 5).alias("complete"))
    return C.scan_totals(parts, "user_id").drop("commands")


@_query("WITH e AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS commands, bool_and(value > 5) AS complete FROM events GROUP BY user_id) SELECT user_id, commands, CASE WHEN complete THEN 'parsed' WHEN commands > 0 THEN 'topped' ELSE 'unknown' END AS state FROM e")
def node_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each context is known."""
    nodes = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("commands"), F.bool_and(F.col("value") > 5).alias("complete"))
    return nodes.select("user_id", "commands", X.node_state(F.col("commands"), F.col("complete")).alias("state"))


@_query("SELECT event_type, CASE WHEN after IS NULL THEN 'reset' WHEN value < 0 THEN 'rejected' WHEN after <> before THEN 'entered' ELSE 'executed' END AS outcome, count(*) AS n FROM (SELECT event_type, value, user_id % 3 AS before, nullif(user_id % 7, 6) AS after FROM events) GROUP BY ALL")
def probe_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as probes: what came of each."""
    probes = _table(spark, sf_dir, "events").select("event_type", F.when(F.col("value") < 0, "% error").otherwise("fine").alias("answer"), (F.col("user_id") % 3).alias("before"), F.expr("nullif(user_id % 7, 6)").alias("after"))
    return X.probe_outcomes(probes).groupBy("event_type", "outcome").agg(F.count("*").alias("n"))


@_query(
    "WITH n AS (SELECT DISTINCT p_name AS command FROM part), k AS (SELECT command, CASE split_part(command, ' ', 1) WHEN 'green' THEN 0 WHEN 'red' THEN 1 ELSE 2 END AS hint FROM n) SELECT command, CAST(row_number() OVER (ORDER BY hint, len(string_split(command, ' ')), command) AS INTEGER) AS place FROM k"
)
def probe_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in the order they would be tried."""
    return C.probe_order(_table(spark, sf_dir, "part").select(F.col("p_name").alias("command")).distinct(), ["green", "red"]).select("command", F.col("place").cast("int").alias("place"))


@_query(
    """WITH b(place, block, verb) AS (VALUES (0, 'standard', 'standard'), (1, 'colours', 'blue'), (1, 'colours', 'navy'), (2, 'metals', 'medium'), (3, 'never', 'never'), (4, 'tried', 'green'), (5, 'small', 'small')),
shown AS (SELECT DISTINCT block FROM b JOIN part ON verb = lower(split_part(p_type, ' ', 1))), refused AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS verb FROM part WHERE p_size > 20)
SELECT block, CASE WHEN bool_or(r.verb IS NOT NULL) THEN 'absent' ELSE 'unknown' END AS state FROM b LEFT JOIN refused r USING (verb) WHERE block NOT IN (SELECT block FROM shown) GROUP BY block"""
)
def missing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected blocks that no part type shows: absent where a part name that would open one was refused."""
    part = _table(spark, sf_dir, "part")
    blocks = {"standard": ("standard",), "colours": ("blue", "navy"), "metals": ("medium",), "never": ("never",), "tried": ("green",), "small": ("small",)}
    probes = part.select(F.col("p_name").alias("command"), F.when(F.col("p_size") > 20, "rejected").otherwise("entered").alias("outcome"))
    return X.missing_blocks(part.select(F.concat_ws("/", "p_brand", "p_type").alias("name")), probes, blocks)


@_query(
    """WITH e AS (SELECT 'r' || r_regionkey AS command FROM region UNION ALL SELECT 'r' || n_regionkey || ' n' || n_nationkey FROM nation
UNION ALL SELECT DISTINCT 'r' || n_regionkey || ' n' || n_nationkey || ' b' || c_custkey // 256 FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'r' || n_regionkey || ' n' || n_nationkey || ' b' || c_custkey // 256 || ' c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT command, len(string_split(command, ' ')) < 4 AS listed FROM e"""
)
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk over region, nation, bucket and customer from recorded answers; customers stand at the
    depth bound and are not asked."""
    from .operators.crawl import Limits, walk

    customer = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    r, n = F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey")
    b, c = F.concat(F.lit("b"), F.floor(F.col("c_custkey") / 256)), F.concat(F.lit("c"), "c_custkey")
    pairs = _table(spark, sf_dir, "region").select(F.lit("").alias("prefix"), F.concat(F.lit("r"), "r_regionkey").alias("token"))
    pairs = pairs.union(_table(spark, sf_dir, "nation").select(r, n)).union(customer.select(F.concat_ws(" ", r, n), b)).union(customer.select(F.concat_ws(" ", r, n, b), c)).distinct()
    line = F.concat(F.lit("  "), "token", F.lit("  seen"))
    answers = pairs.groupBy("prefix").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("output"))
    done = walk(answers, limits=Limits(max_depth=4, deduplicate=False))
    return done.commands.join(done.enumerated.select(F.col("prefix").alias("command"), F.lit(True).alias("listed")), "command", "left").select("command", F.coalesce("listed", F.lit(False)).alias("listed"))


# -- manuals ------------------------------------------------------------------------------------


@_query(
    r"""WITH w AS (SELECT t, count(*) AS seen FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents) GROUP BY t), c AS (SELECT t, seen, unnest(generate_series(3, length(t) - 3)) AS cut FROM w WHERE length(t) >= 6)
SELECT t AS token, c.seen, min(cut) AS cut FROM c JOIN w h ON h.t = left(c.t, cut) AND h.seen >= 3 * c.seen JOIN w l ON l.t = substr(c.t, cut + 1) AND l.seen >= 3 * c.seen GROUP BY c.t, c.seen""".replace("SELECT t AS token", "SELECT c.t AS token")
)
def weld_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are two welded ones, judged by how often the halves stand alone."""
    from .operators.manuals import weld_repairs

    words = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("token"))
    return weld_repairs(words.groupBy("token").agg(F.count("*").alias("seen"))).select("token", "seen", F.col("cut").cast("long").alias("cut"))


@_query("WITH g AS (SELECT source, count(*) AS cards, count(l.doc_id) AS structured FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source) SELECT source, cards, structured, cards >= 20 AND structured * 10 >= cards * 4 AS qualifies FROM g")
def card_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources regular enough to be read card by card."""
    from .operators.manuals import card_gate as gate

    cards = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("structured")), "doc_id", "left").select("source", F.coalesce("structured", F.lit(False)).alias("structured"))
    return gate(cards, ["source"], min_cards=20, min_share=0.4).select("source", "cards", "structured", "qualifies")


@_query("WITH d AS (SELECT p_partkey // 64 AS doc, count(*) AS n FROM part GROUP BY 1) SELECT doc, CASE WHEN doc % 3 = 0 THEN 'chapter' ELSE 'marked' END AS profile FROM d WHERE n >= 5 AND doc % 3 <> 2")
def profile_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first profile whose cards suit a manual: some manuals head their cards one way, some
    another, some in none that is known."""
    from .operators.manuals import doc_lines, pick_profile

    doc = F.floor(F.col("p_partkey") / 64)
    head = F.when(doc % 3 == 0, "Chapter ").when(doc % 3 == 1, "### ").otherwise("= ")
    text = F.concat(head, "p_name", F.lit("\n**Syntax**\n```\nset "), "p_name", F.lit("\n```"))
    docs = _table(spark, sf_dir, "part").groupBy(doc.alias("doc")).agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("text"))
    return pick_profile(doc_lines(docs), {"chapter": r"^Chapter (.+)$", "marked": r"^### (.+)$"}, {"syntax": ["Syntax"], "parameters": ["Parameters"]}, min_cards=5).select("doc", "profile")


# -- matching configurations --------------------------------------------------------------------

_PATTERNS = ["goldenrod <word>", "<first> <second>", "blue <word>", "almond antique"]


def _matched_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.split("p_name", " ").alias("tokens"))
    patterns = spark.createDataFrame(list(enumerate(_PATTERNS)), "place int, command string")
    return G.match_commands(asked, patterns)


_MATCHED = "SELECT p_partkey, CASE WHEN len(w) <> 2 THEN NULL WHEN w[1] = 'goldenrod' THEN 'goldenrod <word>' WHEN w[1] = 'blue' THEN 'blue <word>' WHEN w[1] = 'almond' AND w[2] = 'antique' THEN 'almond antique' ELSE '<first> <second>' END AS command FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)"


@_query(f"SELECT * FROM ({_MATCHED}) WHERE command IS NOT NULL")
def trie_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command each part name is an instance of."""
    return _matched_parts(spark, sf_dir).select(F.col("key").alias("p_partkey"), "command")


@_query(f"SELECT count(*) AS lines, count(*) FILTER (command <> '<first> <second>') AS matched, count(*) FILTER (command = '<first> <second>') AS matched_elsewhere, count(*) FILTER (command IS NULL) AS unmatched, round(count(command) / count(*), 4) AS coverage FROM ({_MATCHED})")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many part names the patterns explain."""
    told = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")).join(_matched_parts(spark, sf_dir), "key", "left")
    status = F.when(F.col("command").isNull(), "unmatched").when(F.col("command") == "<first> <second>", "matched_elsewhere").otherwise("matched")
    return G.coverage(told.select(F.lit("d").alias("device"), status.alias("status"))).drop("device", "free_text")


# -- summaries and text functions ---------------------------------------------------------------


@_query("SELECT s.status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status) LEFT JOIN orders ON o_orderstatus = s.status GROUP BY s.status")
def summary_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by state, with a row for a state that none has."""
    return C.status_counts(_table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")), ("F", "O", "P", "X"))


@_query("SELECT count(*) AS contexts, CAST(sum(p_size) AS BIGINT) AS commands, CAST(sum(2 * p_size) AS BIGINT) AS queries, bool_and(p_size < 50) AS complete FROM part")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over parts as contexts; complete only if all are."""
    size = F.col("p_size")
    return C.scan_totals(_table(spark, sf_dir, "part").select(size.alias("commands"), (2 * size).alias("queries"), (size < 50).alias("complete")))


@_query(
    rf"""WITH {_LINES}, b AS (SELECT line AS command, min(lang) AS was FROM lines WHERE line <> '' AND CAST(regexp_extract(source, '(\d+)', 1) AS INTEGER) % 2 = 0 GROUP BY 1),
a AS (SELECT line AS command, min(lang) AS now FROM lines WHERE line <> '' AND CAST(regexp_extract(source, '(\d+)', 1) AS INTEGER) % 2 = 1 GROUP BY 1)
SELECT command, CASE WHEN now IS NULL THEN 'gone' WHEN was IS NULL THEN 'new' ELSE 'described differently' END AS change FROM b FULL JOIN a USING (command) WHERE was IS DISTINCT FROM now"""
)
def catalog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of even sources against those of odd ones, told by their language."""
    lines = _lines(spark, sf_dir).where("line <> ''").withColumn("odd", _number(F.col("source")) % 2)
    of = lambda odd: lines.where(F.col("odd") == odd).groupBy(F.col("line").alias("command")).agg(F.min("lang").alias("description"))
    return C.catalog_diff(of(0), of(1))


@_query(
    "SELECT command, bool_or(x) AS executable, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM (SELECT lower(p_type) AS command, false AS x, 'documentation:types' AS src FROM part "
    "UNION ALL SELECT 'configure ' || p_name, p_size > 25, 'cli' FROM part) GROUP BY command"
)
def merge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names below an entry path, put together with a catalog of part types."""
    part = _table(spark, sf_dir, "part").withColumn("description", F.lit(""))
    held = part.select(F.lower("p_type").alias("command"), "description", F.lit(False).alias("executable"), F.array(F.lit("documentation:types")).alias("sources"))
    scanned = part.select(F.col("p_name").alias("command"), "description", (F.col("p_size") > 25).alias("executable"), F.array(F.lit("cli")).alias("sources"))
    return C.merged_context(held, scanned, ["configure"]).select("command", "executable", F.array_join("sources", ",").alias("sources"))


@_query(
    """WITH s AS (SELECT o_orderkey, (o_orderkey % 1000) / 4.0 AS seconds FROM orders), r AS (SELECT *, CAST(round_even(seconds, 0) AS BIGINT) AS t FROM s)
SELECT o_orderkey, CASE WHEN seconds < 1 THEN '<1s' WHEN t < 60 THEN '~' || t || 's' WHEN t % 60 = 0 THEN '~' || t // 60 || 'm' ELSE '~' || t // 60 || 'm' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') || 's' END AS badge FROM r"""
)
def duration_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of seconds as badges."""
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.duration_badge((F.col("o_orderkey") % 1000) / F.lit(4.0)).alias("badge"))


@_query("SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(url), '[^a-z0-9_-]', '-', 'g'), '-'), ''), 'block') AS name FROM pages")
def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names from addresses."""
    return _table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@_query("SELECT regexp_replace(w, '[0-9]+$', '') AS stem, count(*) AS n FROM (SELECT unnest(string_split(c_name || ' ' || 'seg' || c_custkey, ' ')) AS w FROM customer) GROUP BY 1")
def token_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens without the number at their end."""
    tokens = _table(spark, sf_dir, "customer").select(F.explode(F.split(F.concat("c_name", F.lit(" seg"), "c_custkey"), " ")).alias("w"))
    return tokens.groupBy(T.stem(F.col("w")).alias("stem")).agg(F.count("*").alias("n"))


@_query("SELECT p_partkey, p_partkey % 5 <> 0 AND NOT list_has_any(string_split(lower(p_name), ' '), ['blue', 'antique']) AS allowed FROM part")
def probe_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands without denied words; each fifth is a negation."""
    command = F.concat(F.when(F.col("p_partkey") % 5 == 0, "no ").otherwise(""), F.col("p_name"))
    return _table(spark, sf_dir, "part").select("p_partkey", T.is_probe_allowed(command, ["blue", "antique"]).alias("allowed"))


@_query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '<' || p_size || '-' || (p_size + 9) || '>' WHEN 1 THEN '<' || p_size || '-' || (p_size + 9) || '>' ELSE '<level>' END AS written,
CASE WHEN p_partkey % 4 < 2 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 4 = 2 THEN '7' END AS typed FROM part"""
)
def range_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a placeholder is written as, by the range its description names, and what is typed for it."""
    lo, hi, turn = F.col("p_size").cast("string"), (F.col("p_size") + 9).cast("string"), F.col("p_partkey") % 4
    told = (
        F.when(turn == 0, F.concat(F.lit("Level, range "), lo, F.lit("-"), hi, F.lit(".")))
        .when(turn == 1, F.concat(F.lit("from "), lo, F.lit(" to "), hi))
        .when(turn == 2, F.concat(lo, F.lit("-"), hi, F.lit(" or 100-200")))
        .otherwise(F.concat(F.lit("address in "), lo, F.lit("-"), hi))
    )
    written = T.placeholder(F.lit("level"), told)
    # what names two ranges is typed from a sample, an address from none
    return _table(spark, sf_dir, "part").select("p_partkey", written.alias("written"), T.parameter_sample(F.when(turn == 3, "<address>").otherwise(written), {"<LEVEL>": "7"}).alias("typed"))


@_query("SELECT p_partkey, p_name AS cleaned FROM part")
def terminal_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as a terminal coloured, mistyped and ended them."""
    shown = F.concat(F.lit("\x1b[31m"), F.col("p_name"), F.lit("xy\b\b\x1b[0m\r"))
    return _table(spark, sf_dir, "part").select("p_partkey", T.terminal_cleaned(shown).alias("cleaned"))


# -- recorded answers and configurations --------------------------------------------------------


@_query(
    """WITH o AS (SELECT 'c' || o_custkey || ' b' || o_orderkey // 4096 AS prefix, * FROM orders) SELECT prefix, 'o' || o_orderkey AS token, 'keyword' AS kind, o_orderpriority AS description FROM o
UNION ALL SELECT DISTINCT prefix, '<cr>', 'cr', '' FROM o UNION ALL SELECT DISTINCT prefix, 'WORD', 'parameter', 'any name' FROM o"""
)
def help_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that list a customer's orders, between a header, an error, a pager and a prompt."""
    from .operators.help import parse_help

    line = F.concat(F.lit("  o"), "o_orderkey", F.lit("  "), "o_orderpriority")
    answers = _table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("c"), "o_custkey", F.lit(" b"), F.floor(F.col("o_orderkey") / 4096)).alias("prefix")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    output = F.concat(F.lit("sw# "), "prefix", F.lit(" ?\nPossible completions:\n"), "body", F.lit("\n  WORD\tany name\n  WORD  again\n  <cr>\n --More-- \n% Incomplete command\nsw#"))
    return parse_help(answers.select("prefix", output.alias("output"))).select("prefix", "token", "kind", "description")


_DUMPED = """c AS (SELECT n_name || ' ' || c_custkey // 1024 AS device, c_custkey, c_mktsegment, 3 * row_number() OVER (PARTITION BY n_name, c_custkey // 1024 ORDER BY c_custkey) - 2 AS i FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's customers as indented configurations of at most 1,024 each."""
    rows = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    block = F.struct("c_custkey", F.concat(F.lit("#\ninterface "), "c_custkey", F.lit("\n segment "), "c_mktsegment").alias("block"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["block"]), "\n")
    return rows.groupBy(F.concat_ws(" ", "n_name", F.floor(F.col("c_custkey") / 1024)).alias("device")).agg(F.concat(F.lit("sw# show run\n"), body, F.lit("\nend\nsw#")).alias("output")).withColumn("source_command", F.lit("show run"))


@_query(f"WITH {_DUMPED} SELECT device, i AS number, 'interface ' || c_custkey AS path FROM c UNION ALL SELECT device, i + 1, 'interface ' || c_custkey || ' / segment ' || c_mktsegment FROM c")
def config_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view path of every configured line; a bare mark at the top counts as a prompt, not a line."""
    return G.config_lines(_dumps(spark, sf_dir)).select("device", F.col("number").cast("long").alias("number"), F.array_join("path", " / ").alias("path"))


@_query(f"WITH {_DUMPED} SELECT device, 'interface' AS head, string_agg('interface ' || c_custkey, ',' ORDER BY i) AS entries FROM c WHERE i < 7 GROUP BY device")
def harvest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two configured entries of each shape to try."""
    return G.harvest(G.config_lines(_dumps(spark, sf_dir))).select("device", "head", F.array_join("entries", ",").alias("entries"))


@_query(
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'free-text' WHEN c_custkey % 3 = 0 THEN 'unmatched' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'matched' ELSE 'matched_elsewhere' END AS status,
CASE WHEN c_acctbal < 0 OR c_custkey % 3 = 0 THEN NULL WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN lower(c_mktsegment) || ' client <id>' ELSE 'client <id>' END AS command FROM customer"""
)
def correlate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured customers matched with their view, without it, or not at all."""
    own = F.concat(F.when(F.col("c_custkey") % 3 == 0, "other ").otherwise("client "), F.col("c_custkey"))
    lines = _table(spark, sf_dir, "customer").select(
        F.lit("d").alias("device"), F.col("c_custkey").alias("seq"), own.alias("text"), F.array(F.lower("c_mktsegment"), own).alias("path"), (F.col("c_acctbal") < 0).alias("verbatim")
    )
    commands = spark.createDataFrame([(0, "building client <id>"), (1, "machinery client <id>"), (2, "client <id>")], "place int, command string")
    prefixes = spark.createDataFrame([(0, []), (1, ["configure"])], "place int, tokens array<string>")
    return G.correlate(lines, commands, prefixes).select(F.col("seq").alias("c_custkey"), "status", "command")


@_query("SELECT lower(c_mktsegment) AS name, least(count(*), 200) AS listed, min(lower(c_mktsegment) || ' ' || c_name) AS first, greatest(count(*) - 200, 0) AS more FROM customer GROUP BY 1")
def block_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 200 commands of each block, and how many follow."""
    customer = _table(spark, sf_dir, "customer").withColumn("name", F.lower("c_mktsegment"))
    commands = customer.select(F.concat_ws(" ", "name", "c_name").alias("command"), F.array(F.lit("cli")).alias("sources"))
    told = X.block_listing(commands, customer.select("name", F.array("name").alias("entry_path")).distinct())
    return told.select("name", F.size("listed").cast("long").alias("listed"), F.col("listed")[0].alias("first"), F.col("more").cast("long").alias("more"))


# -- printed manuals ----------------------------------------------------------------------------


@_query("SELECT p_partkey AS doc, p_name AS command FROM part WHERE p_partkey % 2 = 0")
def contents_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of a table of contents; each second line is no entry."""
    from .operators.manuals import contents_commands as read

    number = F.concat(F.lit("1."), F.col("p_partkey"))
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat(number, F.lit(" "), "p_name", F.lit(" (all models) ........ "), "p_size")).otherwise(F.concat(number, F.lit(" "), "p_name"))
    return read(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.lit(0).alias("n"), line.alias("line"))).select("doc", "command")


def _manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manuals with a card for each of 64 parts."""
    from .operators.manuals import cards, doc_lines

    name = F.col("p_name")
    text = F.concat(
        F.lit("### set "), name, F.lit("\n**Syntax**\n```\nset "), name, F.lit(" <level>\n```\n**Parameters**\n```\nlevel     Step "), F.col("p_partkey").cast("string"),
        F.lit("\n          of the scale\n```\n**Purpose**\nset "), name, F.lit(" - "), F.col("p_type"), F.lit("\n**Notes**\nnothing"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", text.alias("text")))), lambda x: x["text"]), "\n")
    # dealt by document first: a grouping's own dealing would be packed into few tasks
    docs = spread(_table(spark, sf_dir, "part").select("*", F.floor(F.col("p_partkey") / 64).alias("doc")), "doc").groupBy("doc").agg(joined.alias("text"))
    return cards(doc_lines(docs), r"^### (.+)$", {"syntax": ["Syntax"], "parameters": ["Parameters"], "purpose": ["Purpose"]})


_CARDS = "c AS (SELECT p_partkey // 64 AS doc, row_number() OVER (PARTITION BY p_partkey // 64 ORDER BY p_partkey) AS card, * FROM part)"


@_query(
    f"WITH {_CARDS} SELECT doc, card, 'set ' || p_name AS command, 'syntax' AS part, 'set ' || p_name || ' <level>' AS line FROM c UNION ALL SELECT doc, card, 'set ' || p_name, 'parameters', 'level     Step ' || p_partkey FROM c "
    "UNION ALL SELECT doc, card, 'set ' || p_name, 'parameters', '          of the scale' FROM c UNION ALL SELECT doc, card, 'set ' || p_name, 'purpose', 'set ' || p_name || ' - ' || p_type FROM c"
)
def card_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each card's parts."""
    return _manuals(spark, sf_dir).select("doc", F.col("card").cast("long").alias("card"), "command", "part", "line")


@_query(f"WITH {_CARDS} SELECT doc, card, 'level' AS name, 'Step ' || p_partkey || ' of the scale' AS description FROM c")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters with their descriptions, put together over lines."""
    from .operators.manuals import parameter_rows

    return parameter_rows(_manuals(spark, sf_dir)).select("doc", F.col("card").cast("long").alias("card"), "name", "description")

_DAMAGED = r"""
WITH p AS (
  SELECT p_partkey // 64 AS doc, p_partkey AS card, p_partkey % 8 AS v, p_size, split_part(p_name, ' ', 1) || 'x' AS a, split_part(p_name, ' ', 2) || 'y' AS b FROM part
), r AS (
  SELECT *, a || '-' || b AS name, CASE v
    WHEN 0 THEN a || '-' || b || ' Size ' || p_size WHEN 1 THEN a || '- Size ' || p_size || ' ' || b || ' at most' WHEN 2 THEN a || ' Size ' || p_size || ' ' || b || ' at most'
    WHEN 3 THEN a || '- Size ' || p_size || ' Switch' || b || ' at most' WHEN 4 THEN a || '-' || b || 'Size ' || p_size
    WHEN 5 THEN upper(left(a, 1)) || substr(a, 2) || '-' || b || ' Size ' || p_size WHEN 6 THEN a || ' ' || b || ' Size ' || p_size ELSE a || ' Size ' || p_size END AS text
  FROM p
)
SELECT doc, card, CASE v WHEN 7 THEN a ELSE name END AS name, text FROM r
UNION ALL SELECT doc, card, 'level', 'level Integer of ' || p_size || ' steps' FROM r"""


@_query(_DAMAGED)
def damaged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of parts, each damaged in one of seven ways or out of reach of its card's syntax."""
    from .operators.tables import parameter_rows

    a, b = F.concat(F.split("p_name", " ")[0], F.lit("x")), F.concat(F.split("p_name", " ")[1], F.lit("y"))
    told = _table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 64).alias("doc"), F.col("p_partkey").alias("card"), (F.col("p_partkey") % 8).alias("v"), F.col("p_size").cast("string").alias("size"), a.alias("a"), b.alias("b"))
    size, more = F.concat(F.lit("     Size "), "size"), F.lit("               at most")
    row = lambda *parts: F.array(*parts)
    turned = F.concat(F.upper(F.left("a", F.lit(1))), F.expr("substring(a, 2)"))
    name = F.concat("a", F.lit("-"), "b")
    damaged = (
        F.when(F.col("v") == 0, row(F.concat(name, size))).when(F.col("v") == 1, row(F.concat("a", F.lit("-"), size), F.concat("b", more))).when(F.col("v") == 2, row(F.concat("a", size), F.concat("b", more)))
        .when(F.col("v") == 3, row(F.concat("a", F.lit("-"), size), F.concat(F.lit("               Switch"), "b", F.lit(" at most")))).when(F.col("v") == 4, row(F.concat(name, F.trim(size))))
        .when(F.col("v") == 5, row(F.concat(turned, F.lit("-"), "b", size))).when(F.col("v") == 6, row(F.concat("a", F.lit(" "), "b", size))).otherwise(row(F.concat("a", size)))
    )
    table = F.concat(row(F.lit("Parameter      Description")), damaged, row(F.lit("level          Integer of"), F.concat(F.lit("               "), "size", F.lit(" steps"))))
    syntax = F.when(F.col("v") == 7, "show").otherwise(F.concat(F.lit("show "), name, F.lit(" level")))
    lines = told.select("doc", "card", F.posexplode(F.concat(row(syntax), table)).alias("n", "line")).withColumn("part", F.when(F.col("n") == 0, "syntax").otherwise("parameters"))
    return parameter_rows(lines).select("doc", "card", "name", "text")

_EVIDENCE = """
WITH p AS (SELECT p_partkey // 64 AS doc, p_partkey AS card, split_part(p_name, ' ', 1) || 'x' AS a, CAST(p_size AS VARCHAR) AS s, p_size + 1 AS t FROM part),
w(pos, token, kind, reason, form) AS (VALUES
  (0, 'set', 'keyword', 'command-name', ''), (1, '', 'keyword', 'command-name', ''), (2, 'cost', 'keyword', 'named-only', ''), (3, 'low', 'keyword', 'alternative', ''), (4, 'high', 'keyword', 'untabled', ''),
  (5, 'deadtime', 'keyword', 'named-then-valued', ''), (6, 'deadtime', 'keyword', 'alternative', ''), (7, 'never', 'keyword', 'untabled', ''), (8, 'if-no.sub-no', 'value', 'compound', '.sub-no'),
  (9, 'port', 'keyword', 'named-then-valued', ''), (10, 'port', 'value', 'domain', 'name'), (11, 'tag', 'keyword', 'effect', ''), (12, 'mode', 'value', 'default', 'name'), (13, 'rate', 'value', 'domain', 'range'),
  (14, 'span', 'value', 'domain', 'name'), (15, 'slot', 'value', 'domain', 'name'), (16, 'addr', 'value', 'domain', 'name'), (17, 'hop2', 'value', 'domain', 'range'))
SELECT doc, card, pos, CASE pos WHEN 1 THEN a ELSE token END AS token, kind, reason,
  CASE form WHEN 'name' THEN '<' || token || '>' WHEN 'range' THEN '<1-' || t || '>' WHEN '.sub-no' THEN '<1-' || t || '>.sub-no' ELSE CASE pos WHEN 1 THEN a ELSE token END END AS written
FROM p, w"""


@_query(_EVIDENCE)
def card_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of parts whose words are told apart by every kind of evidence, in an English manual's words."""
    from .operators.marking import Lexicon, marks
    from .operators.profiles import profiles

    told = _table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 64).alias("doc"), F.col("p_partkey").alias("card"), F.concat(F.split("p_name", " ")[0], F.lit("x")).alias("a"), F.col("p_size").cast("string").alias("s"), (F.col("p_size") + 1).cast("string").alias("t"))
    line = F.concat(F.lit("set "), "a", F.lit(" cost { low | high } deadtime { deadtime | never } if-no.sub-no port port [ tag ] mode rate span slot addr hop2"))
    lines = told.select("doc", "card", F.concat(F.lit("set "), "a").alias("command"), F.lit(0).alias("n"), F.lit("syntax").alias("part"), line.alias("line"))
    texts = {
        "cost": F.lit("(cost)"), "low": F.lit("low Slow"), "deadtime": F.lit("deadtime Integer"), "if-no": F.concat(F.lit("if-no in the range 1 to "), "t"), "port": F.lit("port Number of it"), "tag": F.lit("tag Enables it"), "mode": F.concat(F.lit("mode As of "), "s"),
        "rate": F.concat(F.lit("rate in the range of 1 to "), "t", F.lit(", that is <1-"), "t", F.lit(">")), "span": F.concat(F.lit("span <1-"), "t", F.lit("> or <0-"), "t", F.lit(">")), "slot": F.concat(F.lit("slot <1-"), "t", F.lit(">/<1-"), "t", F.lit(">")),
        "addr": F.lit("addr IP address of <0-255>"), "hop": F.concat(F.lit("hop 1 ~ "), "t"),
    }
    # dealt first: else the few tasks that read the file would put the tables together
    rows = spread(told, "doc", "card").select("doc", "card", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("text")) for k, v in texts.items()])).alias("r")).select("doc", "card", "r.*")
    english = profiles(spark).where("name = 'english'").first()  # one row
    lexicon = Lexicon(english.domain, english.address, english.effect, tuple(english.ranges))
    return marks(lines, rows, lexicon).select("doc", "card", "pos", "token", "kind", "reason", "written")


@_query(f"WITH {_CARDS} SELECT doc, card, p_type AS description FROM c")
def purpose_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each card's command is for, its own words taken off."""
    from .operators.manuals import purposes

    return purposes(_manuals(spark, sf_dir)).select("doc", F.col("card").cast("long").alias("card"), "description")


@_query(f"WITH {_CARDS} SELECT doc, card, w AS token, CASE WHEN w = '<level>' THEN 'parameter' ELSE 'keyword' END AS kind, w AS written, CASE WHEN w = '<level>' THEN 'spelled' WHEN w = 'set' OR list_contains(string_split(p_name, ' '), w) THEN 'name' END AS reason FROM (SELECT doc, card, p_name, unnest(string_split('set ' || p_name || ' <level>', ' ')) AS w FROM c)")
def card_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each word of a card's syntax is, and on what evidence."""
    from .operators.manuals import marks, parameter_rows

    parts = _manuals(spark, sf_dir)
    told = marks(parts, parameter_rows(parts))
    token = F.when(F.col("reason") == "spelled", F.concat(F.lit("<"), "token", F.lit(">"))).otherwise(F.col("token"))
    return told.select("doc", F.col("card").cast("long").alias("card"), token.alias("token"), "kind", "written", "reason")


@_query(
    f"""WITH {_CARDS}, n AS (SELECT count(*) AS cards, CAST(sum(len(string_split(p_name, ' ')) + 1) AS BIGINT) AS names FROM c)
SELECT * FROM (SELECT unnest(['cards', 'with forms', 'with parameters', 'with purpose']) AS measure, cards AS n, 100.0::DOUBLE AS percent FROM n)
UNION ALL SELECT 'reason name', names, round(100 * names / (names + cards), 1) FROM n UNION ALL SELECT 'reason spelled', cards, round(100 * cards / (names + cards), 1) FROM n"""
)
def card_measurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the manuals was read, and on what evidence their words were told apart."""
    from .operators.manuals import marks, measurement, parameter_rows

    parts = keep(_manuals(spark, sf_dir), "card-parts")  # read three times
    return measurement(parts, marks(parts, parameter_rows(parts)))


@_query("SELECT p_partkey AS doc, CAST(2 * i AS BIGINT) AS n, 'set ' || p_name || CASE i WHEN 0 THEN ' [ size ' || p_size || ' ]' ELSE ' | all' END AS line FROM part, (VALUES (0), (1)) t(i)")
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a bracket or a bar leaves open, joined with what follows."""
    from .operators.manuals import joined_wraps

    text = F.array(F.concat(F.lit("set "), "p_name", F.lit(" [")), F.concat(F.lit("size "), "p_size", F.lit(" ]")), F.concat(F.lit("set "), "p_name", F.lit(" |")), F.lit("all"))
    lines = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.posexplode(text).alias("n", "line"))
    return joined_wraps(lines, ["doc"]).select("doc", F.col("n").cast("long").alias("n"), "line")


@_query("SELECT p_partkey AS doc, 'set ' || p_name || CASE i WHEN 0 THEN ' <level>' ELSE ' { a | b }' END AS syntax FROM part, (VALUES (0), (1)) t(i)")
def structured_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats under their headings in manuals with numbered sections."""
    from .operators.manuals import doc_lines, structured_syntax

    text = F.concat(F.lit("1.2 set "), "p_name", F.lit("\nCommand format\n- set "), "p_name", F.lit(" <level>\n- set "), "p_name", F.lit(" { a |\nb }\nother "), "p_type", F.lit("\nParameters\nset level\n"))
    return structured_syntax(doc_lines(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), text.alias("text")))).select("doc", "syntax")


@_query(
    """WITH p AS (SELECT p_partkey // 64 AS doc, p_partkey, p_name, row_number() OVER (PARTITION BY p_partkey // 64 ORDER BY p_partkey) - 1 AS page FROM part),
l AS (SELECT doc, 2 * page + 1 AS turn, 3 * page AS n, 'flow ' || p_name AS text FROM p UNION ALL SELECT doc, 2 * page - 2, 3 * page + 1, 'placed ' || p_name FROM p)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY turn, n) AS place, text FROM l"""
)
def paged_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of paged manuals in reading order, page numbers dropped."""
    from .sources.documents import reading_order

    doc = F.floor(F.col("p_partkey") / 64)
    page = F.row_number().over(Window.partitionBy(doc).orderBy("p_partkey")) - 1
    rows = F.array(F.struct(F.lit(False).alias("positioned"), F.concat(F.lit("flow "), "p_name").alias("text")), F.struct(F.lit(True).alias("positioned"), F.concat(F.lit("placed "), "p_name").alias("text")), F.struct(F.lit(False).alias("positioned"), F.col("page").cast("string").alias("text")))
    told = _table(spark, sf_dir, "part").select(doc.alias("doc"), page.alias("page"), "p_name").select("doc", "page", F.posexplode(rows).alias("k", "r"))
    ordered = reading_order(told.select("doc", (3 * F.col("page") + F.col("k")).alias("n"), "r.positioned", "r.text"), footer=r"^\d+$")
    return ordered.select("doc", F.col("place").cast("long").alias("place"), "text")


@_query(
    """WITH v AS (SELECT c_mktsegment AS context, c_name AS command, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) AS place FROM customer)
SELECT context, CAST(greatest(count(*) - 40, 0) AS BIGINT) AS skipped, min(command) AS first, max(CASE WHEN place <= 40 THEN command END) AS last FROM v GROUP BY context"""
)
def probe_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first commands to try of each context, and how many more there are."""
    tried, left = C.probes_within(_table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("context"), F.col("c_name").alias("command")), ["show"], 40)
    return tried.groupBy("context").agg(F.min("command").alias("first"), F.max("command").alias("last")).join(left, "context").select("context", "skipped", "first", "last")


@_query(
    """WITH m AS (SELECT n_nationkey, n_name, n_nationkey % 2 = 0 AS again FROM nation) SELECT count(*) AS contexts, CAST(sum(CASE WHEN again THEN 2 ELSE 1 END) AS BIGINT) AS commands, CAST(sum(CASE WHEN again THEN 20 ELSE 10 END) AS BIGINT) AS queries,
bool_and(again OR n_nationkey <> 3) AS complete, (SELECT count(*) FROM (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)) AS device_commands FROM m"""
)
def scoped_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a scan of some contexts was folded into a whole map."""
    nation, customer = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer")
    held = nation.select(F.col("n_name").alias("name"), F.lit(1).alias("commands"), F.lit(10).alias("queries"), (F.col("n_nationkey") != 3).alias("complete"))
    new = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.lit(2).alias("commands"), F.lit(20).alias("queries"), F.lit(True).alias("complete"))
    commands = customer.select(F.col("c_name").alias("command"), F.array(F.lit("documentation:m")).alias("sources"))
    scanned = customer.where("c_custkey % 2 = 0").select(F.col("c_name").alias("command"), F.array(F.lit("cli")).alias("sources"))
    return C.scoped_merge(commands, scanned, held, new)[2]


@_query(
    r"""SELECT p_partkey, '<p>' || replace(replace(p_name, ' ', ' & '), 'a', '<') || '</p>' AS raw, '&lt;p&gt;' || replace(replace(replace(replace(p_name, ' ', ' & '), 'a', '<'), '&', '&amp;'), '<', '&lt;') || '&lt;/p&gt;' AS html,
p_partkey % 2 = 0 AS flag, p_partkey % 3 <> 0 AS safe, p_name AS form, p_name AS head FROM part"""
)
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped text, option flags, fragments that can be typed, forms without remarks, block labels."""
    from .sources.sinks import escaped

    key = F.col("p_partkey")
    raw = F.concat(F.lit("<p>"), F.replace(F.replace("p_name", F.lit(" "), F.lit(" & ")), F.lit("a"), F.lit("<")), F.lit("</p>"))
    token = F.concat(F.when(key % 2 == 0, "-v").otherwise("-7"), F.lit("x"))
    typed = F.concat(F.lit("show"), F.when(key % 3 == 0, "?").otherwise(" x"))
    return _table(spark, sf_dir, "part").select(
        "p_partkey", raw.alias("raw"), escaped(raw).alias("html"), T.is_option_flag(token).alias("flag"), T.is_safe_fragment(typed).alias("safe"),
        T.command_form(F.concat("p_name", F.lit(" — a remark"))).alias("form"), T.block_label(F.concat("p_brand", F.lit("/"), "p_name")).alias("head"),
    )


@_query("SELECT o_orderkey, 'rel ' || o_orderkey || chr(10) || 'MAC <redacted>' AS output FROM orders")
def firmware_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version answers without echo, prompt and identities."""
    from .sources.documents import firmware

    output = F.concat(F.lit("\nsw1# show version\nrel "), "o_orderkey", F.lit("\nMAC 00:11:22:33:44:55\n\nsw1#"))
    return firmware(_table(spark, sf_dir, "orders").select("o_orderkey", F.lit("show version").alias("source_command"), output.alias("output"))).select("o_orderkey", "output")


@_query(
    "SELECT 'enter ' || lower(c_mktsegment) || ' b' || c_custkey // 256 || ' c' || c_custkey AS command FROM customer UNION ALL SELECT DISTINCT 'enter ' || lower(c_mktsegment) || ' b' || c_custkey // 256 FROM customer"
)
def context_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The help of every context that probes lead to, walked together: a context for each segment."""
    from .operators.crawl import walk_contexts

    customer = _table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("name"), "c_custkey")
    segments = customer.select("name").distinct()
    contexts = segments.select("name", F.array(F.concat(F.lit("enter "), "name")).alias("entry_path")).union(spark.createDataFrame([("root", [])], "name string, entry_path array<string>"))
    probes = segments.select(F.lit("root").alias("context"), F.concat(F.lit("enter "), "name").alias("command"), F.lit("entered").alias("outcome"), F.col("name").alias("child"))
    bucket = F.concat(F.lit("b"), F.floor(F.col("c_custkey") / 256))  # no answer grows with the table
    pairs = customer.select("name", F.lit("").alias("prefix"), bucket.alias("token")).union(customer.select("name", bucket, F.concat(F.lit("c"), "c_custkey"))).distinct()
    line = F.concat(F.lit("  "), "token", F.lit("  seen"))
    answers = pairs.groupBy(F.col("name").alias("context"), "prefix").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("output"))
    done, _ = walk_contexts(answers, contexts, probes)  # all roots look alike, no two of their subtrees do
    return done.commands.select("command")


@_query(
    """WITH c AS (SELECT c_nationkey AS n, c_custkey % 4 AS b, c_custkey AS c FROM customer),
nat AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 5 = 0 AND n_nationkey IN (SELECT n FROM c) THEN n_nationkey ELSE 0 END AS source FROM nation)
SELECT 'n' || n AS command, n = source AS walked FROM nat UNION ALL SELECT 'n' || n || ' b' || b, n = source FROM nat, range(4) r(b) UNION ALL SELECT 'n' || nat.n || ' b' || b || ' c' || c, nat.n = source FROM nat JOIN c ON c.n = source"""
)
def walk_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk over nations that all look alike: each fifth has answers of its own recorded below, all
    different, the others none; these get copies."""
    from .operators.crawl import walk

    nation, customer = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer")
    n = F.concat(F.lit("n"), "n_nationkey")
    own = customer.where("c_nationkey % 5 = 0").select(F.concat(F.lit("n"), "c_nationkey", F.lit(" b"), F.col("c_custkey") % 4).alias("prefix"), F.concat(F.lit("c"), "c_custkey").alias("token"))
    pairs = nation.select(F.lit("").alias("prefix"), n.alias("token")).union(nation.select(n, F.explode(F.array(*[F.lit(f"b{i}") for i in range(4)])))).union(own)
    line = F.concat(F.lit("  "), "token", F.lit("  seen"))
    done = walk(pairs.groupBy("prefix").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("output")))
    copies = done.derived.select(F.col("prefix").alias("top"), F.lit(True).alias("copy"))
    told = done.commands.select("command", F.split("command", " ")[0].alias("top")).join(copies, "top", "left")
    return told.select("command", F.col("copy").isNull().alias("walked"))


@_query(
    """WITH cmd AS (SELECT DISTINCT p_type || ' ' || p_name AS command FROM part), step AS (SELECT string_split(command, ' ')[1:i] AS path FROM cmd, LATERAL (SELECT unnest(generate_series(1, len(string_split(command, ' ')))) AS i))
SELECT DISTINCT array_to_string(path, ' ') AS path, repeat('  ', len(path) - 1) || CASE WHEN regexp_matches(path[-1], '^[A-Za-z_][A-Za-z0-9_./-]*$') THEN path[-1] ELSE '"' || path[-1] || '"' END || ':' AS line FROM step"""
)
def nested_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types and names as one nested mapping, a node a line."""
    from .sources.sinks import tree_lines

    catalog = _table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_name").alias("command"), F.array(F.lit("cli")).alias("sources"))
    return tree_lines(catalog).select(F.array_join("path", " ").alias("path"), "line")


@_query(
    """WITH n AS (SELECT n_nationkey AS k, 'x' || chr(97 + CAST(n_nationkey AS INTEGER)) AS name FROM nation),
v AS (SELECT k, c_custkey AS c FROM n JOIN customer ON c_nationkey = k WHERE k % 4 <> 3), first_v AS (SELECT k, c FROM v ORDER BY k, c LIMIT 1)
SELECT 'root' AS name, '' AS entry, 0 AS depth, '#' AS fingerprint
UNION ALL SELECT 'root/interface', 'interface ' || name, 1, '(if-' || name || ')#' FROM n WHERE k % 4 <> 3
UNION ALL SELECT 'root/interface/vlan', 'interface ' || name || ' > vlan c' || c, 2, '(vlan-*)#' FROM first_v JOIN n USING (k)"""
)
def context_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts out of probes alone: nations open views of their own, each fourth refuses; customers below
    open views that differ in their number, which are one."""
    from .operators.crawl import discovered

    name = F.concat(F.lit("x"), F.chr(F.col("n_nationkey") + 97))
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", name.alias("name"))
    answer = F.when(F.col("n_nationkey") % 4 == 3, "% Invalid input").otherwise("")
    mode = F.concat(F.lit("(if-"), "name", F.lit(")#"))
    none = F.array().cast("array<string>")
    tops = nation.select(F.lit("#").alias("fingerprint"), none.alias("entry_path"), F.col("n_nationkey").cast("long").alias("ord"), F.concat(F.lit("interface "), "name").alias("command"), answer.alias("answer"), mode.alias("after"))
    risky = nation.select(F.lit("#"), none, F.col("n_nationkey").cast("long"), F.concat(F.lit("interface reload "), "name"), F.lit(""), F.lit("(x)#"))
    below = _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        mode, F.array(F.concat(F.lit("interface "), "name")), F.col("c_custkey").cast("long"), F.concat(F.lit("vlan c"), "c_custkey"), F.lit(""), F.lit("(vlan-*)#")
    )
    told = discovered(tops.union(risky).union(below), most_probes=1_000_000).contexts
    return told.select("name", F.array_join("entry_path", " > ").alias("entry"), "depth", "fingerprint")


@_query(
    r"""WITH d AS (SELECT p_partkey // 64 AS doc, count(*) AS n FROM part GROUP BY 1)
SELECT doc, CASE doc % 3 WHEN 0 THEN 'english' ELSE 'russian' END AS name FROM d WHERE doc % 3 <> 2 AND n >= 20"""
)
def profile_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in profile that suits each manual of 64 parts: a third are headed one way, a third the
    other, a third have no parameters part."""
    from .operators.manuals import doc_lines
    from .operators.profiles import cards_by_profile, picked, profiles

    english = F.concat(F.lit("2.1."), "p_partkey", F.lit(" show "), "p_name", F.lit("\n**Command Format**\n```\nshow level\n```\n**Parameter Description**\n```\nParameter\nlevel 1 to 5\n```"))
    russian = F.concat(F.lit("#### `show "), "p_name", F.lit("`\n**Синтаксис**\n```\nshow level\n```\n**Параметры**\n```\nнет\n```"))
    bare = F.concat(F.lit("#### `show "), "p_name", F.lit("`\n**Синтаксис**\n```\nshow level\n```"))
    doc = F.floor(F.col("p_partkey") / 64)
    text = F.when(doc % 3 == 0, english).when(doc % 3 == 1, russian).otherwise(bare)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", text.alias("text")))), lambda x: x["text"]), "\n")
    docs = _table(spark, sf_dir, "part").groupBy(doc.alias("doc")).agg(joined.alias("text"))
    told = profiles(spark)
    return picked(cards_by_profile(doc_lines(docs), told), told)


@_query(
    """WITH RECURSIVE p AS (SELECT p_partkey // 64 AS doc, row_number() OVER (PARTITION BY p_partkey // 64 ORDER BY p_partkey) - 1 AS k, p_name, p_type FROM part),
l AS (SELECT doc, max(k) AS last FROM p GROUP BY doc),
pg AS (SELECT doc, k AS a, p_type || ' ' || i AS text, row_number() OVER (PARTITION BY doc ORDER BY k, i) - 1 AS j FROM p, range(2) r(i) WHERE i < CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END),
q(doc, j, e) AS (SELECT doc, j, a FROM pg WHERE j = 0 UNION ALL SELECT pg.doc, pg.j, greatest(pg.a, q.e + 1) FROM q JOIN pg ON pg.doc = q.doc AND pg.j = q.j + 1)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY x, y) AS INTEGER) AS place, text FROM (
  SELECT doc, 2 * k + 3 AS x, 0 AS y, p_name AS text FROM p UNION ALL
  SELECT doc, CASE WHEN e <= last THEN 2 * e ELSE 2 * last + 4 END, CASE WHEN e <= last THEN 0 ELSE j END, text FROM pg JOIN q USING (doc, j) JOIN l USING (doc))"""
)
def page_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paged manuals of parts, an interval a part: some carry two positioned pages, the next one none."""
    from .operators.paged import page_order

    doc = F.floor(F.col("p_partkey") / 64)
    k = F.row_number().over(Window.partitionBy(doc).orderBy("p_partkey")) - 1
    told = _table(spark, sf_dir, "part").select(doc.alias("doc"), k.alias("k"), "p_name", "p_type")
    line = lambda at, positioned, text: F.struct((F.col("k") * 10 + at).alias("n"), F.lit(positioned).alias("positioned"), text.alias("text"))
    page = lambda i: [line(2 * i, True, F.lit("Running header")), line(2 * i + 1, True, F.concat("p_type", F.lit(f" {i}")))]
    ends = [line(8, False, F.col("p_name")), line(9, False, F.lit("page 7"))]
    rows = F.when(F.col("k") % 3 == 0, F.array(*page(0), *page(1), *ends)).when(F.col("k") % 3 == 1, F.array(*ends)).otherwise(F.array(*page(0), *ends))
    paragraphs = told.select("doc", F.explode(rows).alias("r")).select("doc", "r.*").withColumn("page_footer", F.lit(r"^page \d+$"))
    return page_order(paragraphs).select("doc", "place", "text")


@_query(
    f"""WITH {_PATHS}, c AS (SELECT 'n' || page_id % 25 || '-' || page_id // 6400 AS session, * FROM pages_at), s AS (SELECT DISTINCT session FROM c)
SELECT session, '(config)#' AS context, 'page p' || page_id AS said, scheme AS token, 'its scheme' AS told FROM c
UNION ALL SELECT session, '(config)#', 'page p' || page_id, '<cr>', '' FROM c
UNION ALL SELECT session, '(config)#', 'page p' || page_id || ' ' || scheme, '', CASE WHEN page_id % 7 = 0 THEN 'rejected' ELSE 'executed' END FROM c
UNION ALL SELECT session, '>', 'enable', '', 'entered' FROM s UNION ALL SELECT session, '#', 'configure', '', 'entered' FROM s UNION ALL SELECT session, '(config)#', 'exit', '', 'entered' FROM s"""
)
def recorded_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw recordings of a session for up to 256 pages, written as a terminal showed them and read
    again: what was offered below each page, and what came of each command."""
    from .operators.help import parse_help
    from .scratch import spread, written_text
    from .sources.recordings import read_recording

    of = F.col("page_id")
    page = _paths(spark, sf_dir).withColumn("session", F.concat(F.lit("n"), of % 25, F.lit("-"), F.floor(of / 6400)))
    host = F.concat(F.lit("sw"), F.split("session", "-")[0])
    typed = F.concat(host, F.lit("(config)# page p"), of)
    shown = [F.concat(typed, F.lit(" ?\r")), F.concat(F.lit("  "), "scheme", F.lit("   its scheme\r")), F.lit("  <cr>\r"), F.concat(typed, F.lit(" xx\b\b"), "scheme", F.lit("\r"))]
    shown = F.concat(F.array(*shown), F.when(of % 7 == 0, F.array(F.lit("% Invalid input\r"))).otherwise(F.array().cast("array<string>")))
    lead = F.array(F.lit("authorised use> only\r"), F.concat(host, F.lit("> enable\r")), F.concat(host, F.lit("# \x1b[1mconfigure\x1b[0m\r")))
    ends = F.array(F.concat(host, F.lit("(config)# exit\r")), F.concat(host, F.lit("#")))
    sessions = page.select("session").distinct()
    lines = page.select("session", of.alias("of"), F.posexplode(shown).alias("i", "value"))
    lines = lines.union(sessions.select("session", F.lit(-1).cast("long"), F.posexplode(lead))).union(sessions.select("session", F.lit(1 << 62), F.posexplode(ends)))
    at = written_text(spread(lines, "session").sortWithinPartitions("session", "of", "i").select("session", "value"), "recordings", "session")
    read = read_recording(spark, at)
    session = F.regexp_extract("session", r"session=([^/]+)/", 1)
    offered = parse_help(read.help_rows.select(F.concat_ws("\t", session, "fingerprint", "prefix").alias("prefix"), "output")).withColumn("of", F.split("prefix", "\t"))
    offered = offered.select(F.col("of")[0].alias("session"), F.col("of")[1].alias("context"), F.col("of")[2].alias("said"), "token", F.col("description").alias("told"))
    done = X.probe_outcomes(read.executed.withColumn("before", F.col("fingerprint")))
    return offered.union(done.select(session.alias("session"), "fingerprint", "command", F.lit(""), "outcome"))


def _page_part(section: int, title: str, heads: str, rows: str, *, empty: str | None = None, note: str | None = None, says: bool = False) -> str:
    """SQL for a section of a report over ``rows(i, cells, says)``."""
    some, none = f"(SELECT count(*) FROM {rows}) > 0", f"(SELECT count(*) FROM {rows}) = 0"
    lead = """'<tr data-says="' || says || '"><td>'""" if says else "'<tr><td>'"
    columns = "".join(f"<th>{h}</th>" for h in ["#", *heads.split(",")])
    parts = [
        f"SELECT {section} AS section, i AS place, {lead} || i || '</td><td>' || array_to_string(cells, '</td><td>') || '</td></tr>' AS html FROM {rows}",
        f"SELECT {section}, -3, '<h2>{title} <span>' || (SELECT count(*) FROM {rows}) || '</span></h2>'" + ("" if empty is not None else f" WHERE {some}"),
        f"SELECT {section}, -1, '<table><thead><tr>{columns}</tr></thead><tbody>' WHERE {some}",
        f"SELECT {section}, {1 << 62}, '</tbody></table>' WHERE {some}",
    ]
    if note is not None:
        parts.append(f"SELECT {section}, -2, '<p class=\"bad\">{note}</p>' WHERE {some}")
    if empty is not None:
        parts.append(f"SELECT {section}, 0, '<p>{empty}</p>' WHERE {none}")
    return " UNION ALL ".join(parts)


_SAFE = """replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""
_PAGE_SQL = f"""WITH cat AS (
  SELECT 'p' || page_id || ' ' || url AS command, CASE WHEN page_id // 4 % 3 = 0 THEN '' ELSE '<' || page_id % 10 || '> & ' || page_id % 9 END AS description, page_id % 4 IN (0, 2) AS dev, page_id % 4 > 0 AS man, page_id // 12 % 2 = 1 AS gone FROM pages
), told AS (
  SELECT command, {_SAFE.format("command")} AS c, CASE WHEN description = '' THEN '-' ELSE {_SAFE.format("description")} END AS d, lower({_SAFE.format("command || ' ' || description")}) AS says, gone FROM cat WHERE man AND NOT dev
), missing AS (SELECT row_number() OVER (ORDER BY command) AS i, ['<code>' || c || '</code>', d] AS cells, says FROM told WHERE gone),
unseen AS (SELECT row_number() OVER (ORDER BY command) AS i, ['<code>' || c || '</code>', d] AS cells, says FROM told WHERE NOT gone),
vers AS (SELECT row_number() OVER (ORDER BY 'show version ' || r_name) AS i, ['<code>show version ' || r_name || '</code>', CASE WHEN r_regionkey = 0 THEN 'no answer: timed out' ELSE '<pre>rel &amp; ' || r_regionkey || '</pre>' END] AS cells FROM region),
seg AS (SELECT lower(c_mktsegment) AS device, count(*) AS lines, count(*) FILTER (c_acctbal < 0) AS free, count(*) FILTER (c_acctbal >= 0 AND c_custkey % 3 = 0) AS un, count(*) FILTER (c_acctbal >= 0 AND c_custkey % 3 > 0) AS ok FROM customer GROUP BY 1),
share AS (SELECT *, CAST(round(10000 * CASE WHEN un + ok > 0 THEN round_even(ok / (un + ok), 4) ELSE 1 END) AS BIGINT) AS x FROM seg),
cover AS (SELECT row_number() OVER (ORDER BY device) AS i, [device, lines::VARCHAR, ok::VARCHAR, un::VARCHAR, x // 100 || '.' || lpad((x % 100)::VARCHAR, 2, '0') || '%'] AS cells FROM share),
gap AS (SELECT row_number() OVER (ORDER BY device) AS i, [device, '<code>client &lt;value&gt;</code>', un::VARCHAR] AS cells FROM seg WHERE un > 0),
ctx AS (SELECT row_number() OVER (ORDER BY n_name) AS i, ['<code>(n-*)#</code>', CASE WHEN n_regionkey = 0 THEN 'root' ELSE 'configure / nation ' || n_nationkey END, n_regionkey::VARCHAR,
  CASE n_nationkey % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'incomplete: no sample for &lt;a&gt;, &lt;b&gt;, &lt;c&gt;, &lt;d&gt; and 1 more; too deep: ' || n_nationkey WHEN 2 THEN 'incomplete: copied branches that weren&#x27;t confirmed: ' || n_nationkey ELSE 'incomplete' END] AS cells FROM nation),
ran AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS i, ['<code>ping ' || s_name || '</code>'] AS cells FROM supplier)
SELECT 0 AS section, 2 AS place, '<p>on the device: <b>' || count(*) FILTER (dev) || '</b>, in manuals: <b>' || count(*) FILTER (man) || '</b>, queries: <b>7</b></p>' AS html FROM cat
UNION ALL SELECT 2, 0, '<p class="bad">The walk is incomplete: parts of the device were not seen, so what follows is not exhaustive.</p>'
UNION ALL SELECT 2, 1, '<input id="find" type="search" aria-label="Search commands and descriptions">' WHERE (SELECT count(*) FROM told) > 0
UNION ALL """ + " UNION ALL ".join(
    [
        _page_part(1, "Firmware", "Command,Answer", "vers"),
        _page_part(3, "Missing on the device", "Command,Description", "missing", empty="No commands.", says=True),
        _page_part(4, "Not observed", "Command,Description", "unseen", note="The walk did not reach these branches; it can''t be said that the device lacks them.", says=True),
        _page_part(5, "Configurations", "Device,Lines,Explained,Not in the catalog,Share", "cover", empty="No configuration."),
        _page_part(6, "Configured but not in the catalog", "Device,Command,Lines", "gap", empty="Every configured line is explained."),
        _page_part(7, "Contexts", "Prompt,Entered by,Commands,Walk", "ctx"),
        _page_part(8, "Commands entered", "Command", "ran", empty="Nothing was entered; only help was asked for."),
    ]
)


@_query(_PAGE_SQL)
def report_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a report: pages as commands, customers as configured lines, nations as contexts."""
    from .sources.report import report_lines

    page, nation, of = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "nation"), F.col("page_id")
    command = F.concat(F.lit("p"), of, F.lit(" "), "url")
    source = F.array(F.when(of % 4 != 0, "documentation:m"), F.when(of % 2 == 0, "cli"))
    text = F.when(F.floor(of / 4) % 3 == 0, "").otherwise(F.concat(F.lit("<"), of % 10, F.lit("> & "), of % 9))
    catalog = page.select(command.alias("command"), text.alias("description"), F.array_compact(source).alias("sources"))
    catalog = C.reconciled(catalog, complete=False, absent=page.select(command.alias("command"), (F.floor(of / 12) % 2 == 1).alias("absent")))
    status = F.when(F.col("c_acctbal") < 0, "free-text").when(F.col("c_custkey") % 3 == 0, "unmatched").otherwise("matched")
    matched = _table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("device"), F.array(F.concat(F.lit("client c"), "c_custkey")).alias("path"), status.alias("status"))
    version = _table(spark, sf_dir, "region").select(
        F.concat(F.lit("show version "), "r_name").alias("command"), F.when(F.col("r_regionkey") > 0, F.concat(F.lit("rel & "), "r_regionkey")).alias("output"), F.lit("timed out").alias("error")
    )
    turn, key = F.col("n_nationkey") % 4, F.col("n_nationkey").cast("long")
    none = F.array().cast("array<string>")
    contexts = nation.select(
        F.col("n_name").alias("name"), F.lit("(n-*)#").alias("fingerprint"), F.when(F.col("n_regionkey") == 0, none).otherwise(F.array(F.lit("configure"), F.concat(F.lit("nation "), "n_nationkey"))).alias("entry_path"),
        F.col("n_regionkey").alias("commands"), (turn == 0).alias("complete"), F.when(turn == 1, F.array(*[F.lit(f"<{c}>") for c in "abcde"])).alias("skipped_parameters"),
        F.when(turn == 1, key).alias("skipped_depth"), F.when(turn == 2, key).alias("mismatched"),
    )
    executed = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"), F.concat(F.lit("ping "), "s_name").alias("command"))
    lines = report_lines(catalog, complete=False, queries=7, firmware=version, coverage=G.coverage(matched), gaps=G.gaps(matched), contexts=contexts, executed=executed)
    return lines.where("section BETWEEN 1 AND 8 OR (section = 0 AND place = 2)")  # the frame is fixed text
