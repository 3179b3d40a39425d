"""Manuals and recorded transcripts as DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: What is read, and how large it may be.
SUFFIXES = ("md", "txt", "rst", "docx")
MAX_TEXT = 5 << 20
MAX_UNPACKED = 256 << 20
MAX_PROLOG = 1 << 20


def scan_documents(spark: SparkSession, root: str) -> DataFrame:
    """``(path, suffix, length, content, skipped)`` of all files below ``root``.

    Suffixes are told apart without case.  ``skipped`` says why a file isn't read, else null.  Text
    over 5 MiB isn't, nor are word files that are larger packed than they may be unpacked; sizes are
    checked by the reader, before any content is loaded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = files.withColumn("suffix", suffix).where(F.col("suffix").isin(*SUFFIXES))
    most = F.when(F.col("suffix") == "docx", MAX_UNPACKED).otherwise(MAX_TEXT)
    small = known.where(F.col("length") <= most).select("path", "suffix", "length", "content", F.lit(None).cast("string").alias("skipped"))
    why = F.when(F.col("suffix") == "docx", "larger than 256 MiB").otherwise("larger than 5 MiB")
    large = known.where(F.col("length") > most).select("path", "suffix", "length", F.lit(None).cast("binary").alias("content"), why.alias("skipped"))
    return small.unionByName(large)


def texts(documents: DataFrame) -> DataFrame:
    """``(doc, suffix, text)`` of plain documents; broken UTF-8 is replaced."""
    told = documents.where("skipped IS NULL AND suffix <> 'docx'")
    return told.select(F.col("path").alias("doc"), "suffix", _decoded(F.col("content")).alias("text"))


def _decoded(content: Column) -> Column:
    @F.pandas_udf("string")
    def each(raws: pd.Series) -> pd.Series:
        return raws.map(lambda raw: bytes(raw).decode("utf-8", errors="replace"))

    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(each(content))


def refuse_entities(xml) -> None:
    """Reads up to the root element; what stands before it, comments apart, may declare no entities."""
    head = b""
    while len(head) < MAX_PROLOG and (more := xml.read(1 << 16)):
        head += more
        bare = re.sub(rb"<!--.*?(?:-->|\Z)", b"", head, flags=re.DOTALL)
        root = re.search(rb"<[A-Za-z_]", bare)
        if b"<!ENTITY" in (bare[: root.start()] if root else bare):
            raise ValueError("declares entities")
        if root:
            return
    raise ValueError("has no root element where one is looked for")


def docx_paragraphs(documents: DataFrame) -> DataFrame:
    """``(doc, n, positioned, text, skipped)``: leaf paragraphs of word files in file order.

    ``positioned`` tells whether the paragraph has a left indent.  An archive that is broken, that
    would unpack to more than 256 MiB, or that declares entities gives one row with the reason.
    """
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def paragraphs(raw: bytes) -> Iterator[tuple[int, bool, str]]:
        with zipfile.ZipFile(io.BytesIO(raw)) as box:
            if sum(i.file_size for i in box.infolist()) > MAX_UNPACKED:
                raise ValueError("unpacks to more than 256 MiB")
            with box.open("word/document.xml") as f:
                refuse_entities(f)
            open_, n = [], 0
            with box.open("word/document.xml") as f:
                for event, e in ElementTree.iterparse(f, events=("start", "end")):
                    if e.tag != f"{w}p":
                        continue
                    if event == "start":
                        if open_:
                            open_[-1] = False  # it holds another paragraph
                        open_.append(True)
                    elif open_.pop():
                        text = "".join(t.text or "" if t.tag == f"{w}t" else "\t" for t in e.iter() if t.tag in (f"{w}t", f"{w}tab"))
                        indent = e.find(f"{w}pPr/{w}ind")
                        yield n, indent is not None and (f"{w}left" in indent.attrib or f"{w}start" in indent.attrib), text
                        n += 1
                        e.clear()

    def each(batches):
        for pdf in batches:
            out = []
            for doc, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out += [(doc, n, placed, text, None) for n, placed, text in paragraphs(bytes(raw))]
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError, EOFError, OSError) as error:
                    out.append((doc, -1, False, "", f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["doc", "n", "positioned", "text", "skipped"])

    packed = documents.where("skipped IS NULL AND suffix = 'docx'").select("path", "content")
    return packed.mapInPandas(each, "doc string, n int, positioned boolean, text string, skipped string")


def reading_order(paragraphs: DataFrame, footer: str, header: str | None = None) -> DataFrame:
    """``(doc, n, positioned, text)`` -> ``(doc, place, text)`` of a paged manual.

    A footer line ends a page.  What is positioned on a page is printed before the flowing text of
    the page before; headers, footers and lines with dot leaders are dropped.
    """
    from pyspark.sql import Window

    over = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    is_footer = F.col("text").rlike(footer)
    told = paragraphs.withColumn("is_footer", is_footer).withColumn("page", F.coalesce(F.sum(F.col("is_footer").cast("int")).over(over), F.lit(0)))
    furniture = F.col("is_footer") | F.col("text").rlike(r"(?:\.\s*){4,}") | (F.col("text").rlike(header) if header else F.lit(False))
    turn = F.when(F.col("positioned"), 2 * F.col("page") - 2).otherwise(2 * F.col("page") + 1)
    place = F.row_number().over(Window.partitionBy("doc").orderBy("turn", "n"))
    return told.where(~furniture).withColumn("turn", turn).select("doc", place.alias("place"), "text")


def first_capture(answers: DataFrame, least: int = 4) -> DataFrame:
    """``(device, ord, source_command, output)`` -> the first command of each device that answered
    with at least ``least`` lines that are neither empty nor errors."""
    lines = F.filter(F.split(T.terminal_cleaned(F.col("output")), "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"(?i)^(?:%|\^|error\b|invalid\b|unknown\b|unrecognized\b|incomplete\b)"))
    able = answers.where(F.size(lines) >= least)
    return able.groupBy("device").agg(F.min_by(F.struct("source_command", "output"), "ord").alias("v")).select("device", "v.*")


def firmware(answers: DataFrame) -> DataFrame:
    """Version answers without echo and prompt, identities redacted."""
    command = F.trim(F.col("source_command")) if "source_command" in answers.columns else F.lit("")
    return answers.withColumn("output", T.identity_redacted(T.edges_trimmed(T.terminal_cleaned(F.col("output")), F.coalesce(command, F.lit("")))))


def verified_answers(help_rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """Adds ``verified``: does the prompt at the end of an answer belong to its context?"""
    told = help_rows.join(contexts.select(F.col("name").alias("context"), "fingerprint"), "context", "left")
    return told.withColumn("verified", T.fingerprint_of(F.col("output")).eqNullSafe(F.col("fingerprint"))).drop("fingerprint")
