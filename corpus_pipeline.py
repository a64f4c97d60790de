"""From raw documents to packed sequences: five stages over the documents table, each a written table.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All but the last return the columns of ``docs``; where
a stage changes a text, ``n_chars`` follows it. Null and empty texts pass: they count as empty, are scored near the
prior of the labels, link with nothing, hold no lines or secrets, and pack as their end token. Rows with a null id
stay. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.llm import linededup, neardup, packing, quality, secrets
from tidemeter.llm.common import fold_of, stored, table


def _columns(rows: DataFrame, docs: DataFrame, changed: bool = False) -> DataFrame:
    """The columns of ``docs`` out of ``row``."""

    def column(name: str) -> Column:
        value = F.col("row")[name]
        if changed and name == "n_chars":
            value = F.coalesce(F.length(F.col("row")["text"]).cast("long"), F.lit(0).cast("long"))
        return value.alias(name)

    return rows.select(*map(column, docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id")) != 0)
    return _columns(quality.score_quality(docs, model).where("predicted = 1"), docs)


#: Share of a source's distinct texts above which a line goes, from three texts on; the README has the measured spread.
LINE_RATIO = 0.0001


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; whole copies of a text are left to the next stage."""
    return _columns(linededup.drop_boilerplate(docs, ratio=LINE_RATIO, least_pages=3, by_text=True), docs, changed=True)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of every class of near duplicates, the one of smallest id (then of smallest key); of equal rows, one.

    A key of id and text stands for a row, so rows that share an id but hold unlike texts are judged apart and all stay.
    """
    number = F.col("doc_id").cast("long")
    key = F.xxhash64(number, F.coalesce("text", F.lit("")))
    rows = docs.where(number.isNotNull())
    classes = neardup.near_duplicates(rows.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("__key"), "component_id")
    ids = rows.select(key.alias("__key"), number.alias("__id")).distinct()
    first = classes.join(ids, "__key").groupBy("component_id").agg(F.min(F.struct("__id", "__key")).alias("first")).select("first.*")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), number.alias("__id"), key.alias("__key"))
    kept = whole.join(first, ["__id", "__key"], "left_semi").groupBy("__id", "__key").agg(F.min("row").alias("row")).select("row")
    return _columns(kept.unionByName(whole.where("__id IS NULL").select("row")), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return _columns(secrets.redact(docs), docs, changed=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces with their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_duplicates", keep_first_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The stages rest on a fitted classifier and on tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
