"""From raw documents to packed training sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table that is written and read again as the next stage's documents. All but
the last return the columns of ``documents``. ``run`` applies them to ``documents``; ``scratch`` holds the tables between them.

There is no SQL for it: the quality classifier is fitted and the token ids come from a tokenizer. Each stage is tested against its
operator's brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import quality
from logsift.llm.decontaminate import contaminated
from logsift.llm.linededup import dedup_lines
from logsift.llm.packing import pack
from logsift.llm.queries import quality_model, tokenizer
from logsift.llm.simhash import near_groups
from logsift.scratch import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def new_name(name: str, docs: DataFrame) -> str:
    """A column name that the table does not have."""
    held = {c.lower() for c in docs.columns}
    while name.lower() in held:
        name += "_"
    return name


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier of operator 6 does not reject (score of at least 0.5).

    Every row is judged by its own text: repeated rows alike, rows without an id like any other, null and empty texts as one text. A score
    of exactly 0.5 stays. An empty table stays empty.
    """
    name = new_name("score", docs)
    return quality.score_rows(docs, quality_model(spark, sf_dir), name).where(F.col(name) >= 0.5).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has (operator 4); ``n_chars`` follows.

    No row goes. Rows of one id are one document; rows without an id keep all their lines and take none from others. A null text becomes
    an empty one. An empty table stays empty.
    """
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    texts = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return dedup_lines(whole).select(*(texts.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies (operator 10: three-word shingles, fingerprints at most 2 bits apart).

    Rows of one id are one document: it stays if it is the smallest of a group with any of its texts. Rows without an id stay. All texts
    without a word are copies of one another. An empty table stays empty.
    """
    groups = near_groups(docs, words=3).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("component_id") == F.col("doc_id")).alias("first"))
    others = saved(groups.where(~F.col("first")).select("doc_id"), "copies")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark`` (operator 1).

    An id goes with all its rows if one of them contains an item; a row without an id goes if it contains one itself, as do its equals.
    Null and empty texts stay. An empty table stays empty.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = saved(contaminated(docs, items).where("doc_id is not null").select("doc_id").distinct(), "hit")
    kept = docs.where("doc_id is not null").join(hit, "doc_id", "left_anti").select(*docs.columns)
    # Rows without an id are searched under a hash of their text.
    key = new_name("text_key", docs)
    nameless = docs.where("doc_id is null").withColumn(key, F.xxhash64("text"))
    found = saved(contaminated(nameless.select(F.col(key).alias("doc_id"), "text"), items).select(F.col("doc_id").alias(key)).distinct(), "hit-texts")
    return kept.union(nameless.join(found, key, "left_anti").select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 token ids (operator 5), the ids themselves included.

    Every row is packed, repeated ones and those without an id or a text, too. An empty table gives no piece. The workers are those of
    the stages before and keep their memory, so they hold fewer words than operator 5 alone lets them.
    """
    return pack(docs, tokenizer(), end_id=1, room=2048, kept_words=100_000)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
