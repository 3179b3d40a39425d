"""Secret scan: broad candidate patterns, and a random forest that removes false positives.

Candidates are values assigned to a secret-like name, tokens of known credential shapes, private
key blocks, and long mixed tokens.  The forest judges each by its length, the transitions between
its characters, how much of it dictionary words cover, words of its path, and the words around it.
It is trained from labelled findings; a table of them can be given, and a generated one serves
otherwise.  The dictionary is the set of whole words of a vocabulary file.
"""

from __future__ import annotations

import json
import math
import random
import re
import string
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_vocabulary
from .scratch import keep

_NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "credential", "private_key")
_NAMED = re.compile(r"(?i)password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key")
_SEPARATOR = re.compile(r"=>|[:=]")
_ASSIGNED = re.compile(r"""\s*["']?([^\s"'`,;<>]{6,})""")
_NAME_LETTERS = frozenset(string.ascii_letters + string.digits + "_-")
_KEY_EDGE = re.compile(r"-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----")
_KEY_BODY = re.compile(r"[A-Za-z0-9+/=\s\\:,\-]*")
_SHAPES = {
    "aws_id": re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"),
    "forge_token": re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_\-]{20,})"),
    "chat_token": re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9\-]{10,}"),
    "pay_key": re.compile(r"(?<![A-Za-z0-9])[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    "cloud_key": re.compile(r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_\-]{35}"),
    "signed_token": re.compile(r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"),
}
_HINTS = {"aws_id": ("AKIA", "ASIA"), "forge_token": ("gh", "glpat-"), "chat_token": ("xox",), "pay_key": ("k_live_", "k_test_"), "cloud_key": ("AIza",), "signed_token": ("eyJ",)}
_MIXED = re.compile(r"[A-Za-z0-9+/=_\-]{16,}")
_LOWER_WORD = re.compile(r"[a-z0-9]+")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
_MASKING = frozenset("example sample dummy test tests testing placeholder your fake changeme xxx mock demo redacted todo none null commit sha md5 sha1 sha256 checksum hash digest uuid version id ref".split())
_PATHS = frozenset("test tests testing example examples sample samples doc docs fixture fixtures mock mocks demo spec readme".split())
KINDS = ("assigned", "mixed", *_SHAPES, "private_key")
FEATURES = (
    "length", "entropy", "switches", "transition", "coverage", "digits", "upper", "symbols", "distinct", "longest_run", "hex_only", "uuid_shape", "name_before", "masking_near", "masking_inside", "word_neighbours", "path_masking", "path_depth",
    *(f"is_{k}" for k in KINDS),
)


@lru_cache(maxsize=2)
def _dictionary(path: str) -> tuple[frozenset[str], dict[str, float], ahocorasick.Automaton]:
    """Whole words of a vocabulary, of four letters or more, log frequencies of letter pairs, and
    what finds the words of up to 16 letters in a text."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = frozenset(w for t in vocab if (w := t.removesuffix("</w>")) != t and len(w) >= 4 and w.isascii() and w.isalpha())
    pairs: dict[str, float] = {}
    for w in words:
        for a, b in zip(w, w[1:], strict=False):
            pairs[a + b] = pairs.get(a + b, 0) + 1
    total = sum(pairs.values())
    finder = ahocorasick.Automaton()
    for w in words:
        if len(w) <= 16:
            finder.add_word(w, len(w))
    finder.make_automaton()
    return words, {p: math.log(n / total) for p, n in pairs.items()}, finder


def _coverage(low: str, finder: ahocorasick.Automaton) -> float:
    """Share of characters under dictionary words, the longest of the leftmost each time."""
    return sum(size for _, size in finder.iter_long(low)) / len(low)


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(value: str, before: str, after: str, path: str, kind: str, vocabulary: str) -> list[float]:
    """Numbers in the order of ``FEATURES`` for one candidate and its surroundings."""
    words, pairs, finder = _dictionary(vocabulary)
    low, n = value.lower(), max(1, len(value))
    counts = [value.count(c) for c in set(value)]
    classes = [_class(c) for c in value]
    steps = [pairs.get(low[i : i + 2], -12.0) for i in range(len(low) - 1) if low[i].isalpha() and low[i + 1].isalpha()]
    run = best = 1
    for a, b in zip(value, value[1:], strict=False):
        run = run + 1 if a == b else 1
        best = max(best, run)
    around_before, around_after = re.findall(r"[a-z0-9]+", before.lower()), re.findall(r"[a-z0-9]+", after.lower())
    near = {*around_before[-4:], *around_after[:3]}
    parts = re.findall(r"[a-z]+", path.lower())
    inside = set(re.findall(r"[a-z]+", low))
    return [
        math.log(n), -sum(c / n * math.log2(c / n) for c in counts), sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / n,
        sum(steps) / len(steps) if steps else -9.0, _coverage(low, finder) if value else 0.0, classes.count(2) / n, classes.count(1) / n, classes.count(3) / n,
        len(counts) / n, best / n, float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value))),
        float(any(name in " ".join(around_before[-3:]).replace(" ", "_") for name in _NAMES)), float(len(near & _MASKING)),
        float(bool(inside & _MASKING) or any(m in low for m in ("example", "changeme", "placeholder", "${", "{{", "xxxx", "your")) or value[:1] in "$<{%"),
        float(sum(w in words for w in near)), float(len(_PATHS.intersection(parts))), math.log1p(path.count("/")),
        *(float(kind == k) for k in KINDS),
    ]


def _assigned(text: str) -> list[tuple[int, int, str]]:
    """Values after ``=``, ``:`` or ``=>`` with a secret-like name before it.  Separators are found
    first and looked back from; each character is looked at a fixed number of times."""
    found, at = [], 0
    for m in _SEPARATOR.finditer(text):
        if m.start() < at:
            continue  # within the last value
        end = m.start()
        while end > 0 and text[end - 1].isspace():
            end -= 1
        if end > 0 and text[end - 1] in "\"'":
            end -= 1
        start = end
        while start > 0 and text[start - 1] in _NAME_LETTERS:
            start -= 1
        if start < end and _NAMED.search(text, start, end) and (value := _ASSIGNED.match(text, m.end())):
            found.append((value.start(1), value.end(1), "assigned"))
            at = value.end()
    return found


def _key_blocks(text: str) -> list[tuple[int, int, str]]:
    """Private keys from a header to the next end, with nothing but what keys hold between."""
    found, opened = [], None
    for m in _KEY_EDGE.finditer(text):
        if m[1] == "END" and opened is not None and _KEY_BODY.fullmatch(text, opened.end(), m.start()):
            found.append((opened.start(), m.end(), "private_key"))
        opened = m if m[1] == "BEGIN" else None
    return found


def candidates(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of every candidate in a whole text, in order, none overlapping an
    earlier kind: known shapes, then assigned values, then long tokens of letters and digits.  The
    time is in proportion to the text, whatever stands in it."""
    found: list[tuple[int, int, str]] = []
    for kind, hints in _HINTS.items():
        if any(h in text for h in hints):
            found += [(m.start(), m.end(), kind) for m in _SHAPES[kind].finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += _key_blocks(text)
    low = text.lower()
    if any(name in low for name in ("passw", "pwd", "secret", "token", "key", "auth", "credential")):
        found += _assigned(text)
    if any(len(w) >= 16 and _DIGIT.search(w) for w in text.split()):
        found += [(m.start(), m.end(), "mixed") for m in _MIXED.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0])]
    taken: list[tuple[int, int, str]] = []
    order = {k: i for i, k in enumerate((*_SHAPES, "private_key", "assigned", "mixed"))}
    ends: list[int] = []
    for start, end, kind in sorted(found, key=lambda f: (f[0], order[f[2]], -f[1])):
        if not ends or start >= ends[-1]:
            taken.append((start, end, kind))
            ends.append(end)
        elif order[kind] < order[taken[-1][2]]:  # a known shape within an assigned value names it better
            taken[-1], ends[-1] = (start, end, kind), end
    return taken


def surroundings(text: str, start: int, end: int) -> tuple[str, str]:
    """Text before and after a candidate that holds at least the four words before it and the three
    after it, where there are so many, however far off they stand."""
    size = 80
    while len(_LOWER_WORD.findall(before := text[max(0, start - size) : start].lower())) <= 4 and size < start:
        size *= 4
    size = 60
    while len(_LOWER_WORD.findall(after := text[end : end + size].lower())) <= 3 and end + size < len(text):
        size *= 4
    return before, after


def labelled_findings(spark: SparkSession, n: int = 4000, seed: int = 11) -> DataFrame:
    """A generated table of findings ``(value, before, after, path, kind, label)``: credentials of
    many makes, and what scans take for them (checksums, identifiers, placeholders, names)."""
    rng = random.Random(seed)
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    words = "the of value order river stone light paper under maker small green house number letter winter".split()
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    prose = lambda k: " ".join(rng.choice([pick(string.ascii_lowercase, rng.randint(2, 9)), rng.choice(words)]) for _ in range(k))
    name = lambda: rng.choice(["password", "passwd", "db_password", "secret", "token", "api_key", "auth_token", "access_key"])
    rows = []
    for _ in range(n // 2):
        before, after = prose(4), prose(3)
        value, kind, named = rng.choice(
            [
                (pick(hexa, rng.randint(12, 40)), "assigned", True), (pick(alnum, rng.randint(10, 40)), "assigned", True), (pick(alnum + "!@#$%^&*-_", rng.randint(8, 20)), "assigned", True),
                (rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + "234567", 16), "aws_id", False), ("ghp_" + pick(alnum, 36), "forge_token", False), ("sk_live_" + pick(alnum, 24), "pay_key", False),
                ("xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24), "chat_token", False), ("AIza" + pick(alnum + "-_", 35), "cloud_key", False),
                ("eyJ" + pick(alnum, 20) + ".eyJ" + pick(alnum, 40) + "." + pick(alnum, 43), "signed_token", False), (pick(alnum + "+/", rng.randint(32, 64)), "mixed", True),
                ("-----BEGIN RSA PRIVATE KEY-----" + pick(alnum + "+/", 300) + "-----END RSA PRIVATE KEY-----", "private_key", False),
            ]
        )
        rows.append((value, f"{before} {name()}=" if named or rng.random() < 0.3 else before + " ", " " + after, rng.choice(["", "src/app/main.py", "config/prod.env", "deploy/values.yaml"]), kind, 1))
        value, kind, lead = rng.choice(
            [
                (pick(hexa, 40), "mixed", "commit "), (pick(hexa, 32), "mixed", "md5 checksum "), (pick(hexa, 64), "mixed", "sha256 "), ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), "mixed", rng.choice(["id ", "uuid ", ""])),
                (rng.choice(["changeme", "your_password_here", "example123", "xxxxxxxx", "${DB_PASSWORD}", "{{secret}}", "<password>", "placeholder", "********", "os.environ", "None", "required", "string"]), "assigned", name() + "="),
                ("AKIA" + "IOSFODNN7EXAMPLE", "aws_id", "for example "), ("sk_test_" + "x" * 24, "pay_key", "sample "), (rng.choice(words) + "-" + rng.choice(words) + "-" + pick(string.digits, 4) + "-" + rng.choice(words), "mixed", "version "),
                (rng.choice(words) + "_" + rng.choice(words) + "_" + rng.choice(words) + str(rng.randint(1, 9)), "mixed", prose(1) + " "), (rng.choice(words) + rng.choice(words), "assigned", rng.choice(["the token: ", "auth: ", "secret: "])),
                ("20" + pick(string.digits, 2) + "-" + pick(string.digits, 2) + "-" + pick(string.digits, 2) + "T" + pick(string.digits, 6) + "Z", "mixed", "at "), ("aaaaaaaaaaaaaaaa1111", "mixed", prose(1) + " "),
                ("/".join(rng.choice(words) for _ in range(4)) + "/v2", "mixed", prose(1) + " "),
            ]
        )
        rows.append((value, f"{before} {lead}", " " + after, rng.choice(["", "tests/fixtures/keys.py", "docs/readme.md", "src/app/main.py", "examples/a.env"]), kind, 0))
    return spark.createDataFrame(rows, "value string, before string, after string, path string, kind string, label int")


def train(findings: DataFrame, vocabulary: str | None = None, *, trees: int = 40, depth: int = 8, seed: int = 3) -> RandomForestClassificationModel:
    """A forest from all labelled findings; null values, kinds and labels are left out."""
    path = vocabulary or default_vocabulary()

    @F.udf("array<double>", useArrow=True)
    def measured(value, before, after, where, kind):
        return features(value, before or "", after or "", where or "", kind, path)

    rows = findings.where("value IS NOT NULL AND kind IS NOT NULL AND label IN (0, 1)")
    rows = keep(rows.select(measured("value", "before", "after", "path", "kind").alias("x"), F.col("label").cast("double").alias("label")), "secret-findings")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label")
    return forest.fit(rows.select(array_to_vector("x").alias("features"), "label"))


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", vocabulary: str | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: ``(doc_id, start, n_chars, kind, value, score, is_secret)``, places in
    code points of the whole text.

    Null and empty texts give none; a null path counts as empty; rows with a null id and repeated
    rows are scanned like any other; an empty table gives no rows.  Other columns are ignored
    whatever their names.
    """
    path = vocabulary or default_vocabulary()
    model = train(labelled_findings(docs.sparkSession) if findings is None else findings, path)

    def each(batches):
        for batch in batches:
            out = []
            for doc, text, where in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                whole = text.as_py() or ""
                for start, end, kind in candidates(whole):
                    x = features(whole[start:end], *surroundings(whole, start, end), where or "", kind, path)
                    out.append((doc, start, end - start, kind, whole[start:end], x))
            if out:
                names = ["doc_id", "start", "n_chars", "kind", "value", "x"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    where = F.col(path_col).cast("string") if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), where.alias("path"))
    found = rows.mapInArrow(each, "doc_id long, start long, n_chars long, kind string, value string, x array<double>")
    judged = model.transform(found.withColumn("features", array_to_vector("x")))
    return judged.withColumn("score", vector_to_array("probability")[1]).select("doc_id", "start", "n_chars", "kind", "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Findings with digests in place of the values, so that no secret is written again."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("value_sha256", F.sha2("value", 256)).drop("value")
