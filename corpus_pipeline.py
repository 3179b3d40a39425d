"""A corpus pipeline over ``documents``: what is fit to train on, once, in the mix wanted, as tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of ``documents``, whatever
others there are and whatever they are called: a row's own columns travel as one struct.

Each text is read for one thing once: decisions are kept as ``(doc_id, mark)`` with ``mark`` the hash
of the raw text, and texts meet them by that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manloom.llm import bpe, exact_dedup, mixing, quality, simhash
from manloom.llm.scratch import keep


def _marked(docs: DataFrame) -> DataFrame:
    """``(own, id, mark)``: each row's columns as one, its id, and the hash of its text."""
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(F.struct("*").alias("own"), F.col("doc_id").cast("long").alias("id"), mark.alias("mark"))


def _kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and mark are among ``kept(doc_id, mark)``; of rows that repeat
    both, the first by source and language."""
    same = F.col("d.id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.mark") == F.col("k.mark"))
    found = _marked(docs).alias("d").join(kept.hint("shuffle_hash").alias("k"), same).select("d.*")
    return found.groupBy("id", "mark").agg(F.min_by("own", F.struct("own.source", "own.lang", "own.n_chars")).alias("own")).select("own.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.7 or more).

    Null texts are scored as empty ones, very long ones whole; rows that repeat are kept or dropped
    together; labels of ids without a document, and null ids, teach nothing.  Where the labels know
    one class only, or are empty, nothing tells documents apart and all have the base rate: they
    stay if that reaches 0.7.  An empty table stays empty.
    """
    model = quality.sampled_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(model.score_of(quality.statistics_of(F.col("text"))) >= 0.7)


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each text (white space counts as one blank, null as empty).

    Null ids come last; of rows that repeat id and text one stays, the first by source, language and
    length.  Very long texts are compared in parts.  An empty table stays empty.
    """
    return _kept(docs, exact_dedup.exact_dedup(docs).where("kept").select("doc_id", "mark"))


def one_of_each_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies (five-word shingles).

    Documents with a null id stay only where no document of their component has one, once per text.
    Null and empty texts are near copies of each other; texts of fewer than five words are one
    shingle.  An empty table stays empty.
    """
    return _kept(docs, simhash.near_copies(docs).where("doc_id <=> component_id").select("doc_id", "mark").distinct())


def in_proportion(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes, by words of the whole text.

    Documents without words (null texts too) weigh nothing and are taken as often as the whole part of
    their source's share; a null source is a source, placed last; null ids are ids.  Rows alike in id,
    source and text are copies of one document, told apart by language and length.  Ties are drawn by
    hash, alike in every run.  An empty table stays empty.
    """
    key = ["id", "source", "mark"]
    sized = keep(_marked(docs).select("id", F.col("own.source").cast("string").alias("source"), "mark", mixing.word_count(F.col("own.text")).alias("size")), "mix-words")
    taken = mixing.mix(sized, id_col="id", size_col="size").where("copies > 0").select("doc_id", "source", "size", "copy", "copies")
    # rows alike in id, source and size are numbered as the mix numbers them
    numbered = sized.withColumn("copy", F.row_number().over(Window.partitionBy("id", "source", "size").orderBy("mark")).cast("long"))
    same = F.col("n.id").eqNullSafe(F.col("t.doc_id")) & F.col("n.source").eqNullSafe(F.col("t.source")) & (F.col("n.size") == F.col("t.size")) & (F.col("n.copy") == F.col("t.copy"))
    counts = numbered.alias("n").join(taken.alias("t"), same).select("n.id", "n.source", "n.mark", "t.copies")
    counts = keep(counts.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("copies"))).cast("long")), "mix-copies")
    several = keep(sized.groupBy(*key).agg(F.count("*").alias("m")).where("m > 1"), "mix-repeated")
    texts = _marked(docs).withColumn("source", F.col("own.source").cast("string")).withColumn("nth", F.lit(1).cast("long"))
    if not several.isEmpty():  # rows alike in id, source and text are told apart by their place
        alike = F.col("x.id").eqNullSafe(F.col("s.id")) & F.col("x.source").eqNullSafe(F.col("s.source")) & (F.col("x.mark") == F.col("s.mark"))
        place = F.row_number().over(Window.partitionBy(*key).orderBy("own.lang", "own.n_chars")).cast("long")
        alone = texts.alias("x").join(several.alias("s"), alike, "left_anti")
        texts = alone.unionByName(texts.alias("x").join(several.alias("s"), alike, "left_semi").withColumn("nth", place))
    same = F.col("x.id").eqNullSafe(F.col("c.id")) & F.col("x.source").eqNullSafe(F.col("c.source")) & (F.col("x.mark") == F.col("c.mark")) & (F.col("x.nth") == F.col("c.nth"))
    mixed = texts.alias("x").join(counts.hint("shuffle_hash").alias("c"), same).select("x.own", "c.copies")
    return mixed.select("own", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("own.*")


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them: a row per row.

    Null and empty texts have no tokens; very long texts are encoded whole; null ids and repeated
    rows keep their rows; other columns end here.  An empty table stays empty.
    """
    return bpe.digests(docs)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", one_of_each_text),
    ("near_dedup", one_of_each_kind),
    ("mix", in_proportion),
    ("bpe", as_tokens),
]

#: SQL has no XXH64 and no random dependent rounding; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
