"""Reading and flattening passage and question files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.positions import id_positions, prefix_weights
from quillmesh.session import cut_lineage

PASSAGES = "map<string,map<string,struct<page_content:string,index:bigint>>>"
QA = (
    "key_content struct<question:string,answer:string,reference:array<string>,"
    "reference_idx:array<bigint>>, other_info struct<doc_name:string,question_type:string>"
)
MULTIHOP = (
    "question string, answer string, context struct<title:array<string>,"
    "sentences:array<array<string>>>, supporting_facts struct<title:array<string>,"
    "sent_id:array<int>>"
)
PAIRS_PER_ROW = 1 << 20


def flatten_corpus(
    raw: DataFrame, passages: str | Column, order: str | None = None, max_docs: int | None = None
) -> DataFrame:
    """``id, title, text`` of a map of maps of passages.

    ``max_docs`` keeps the first passages in file order, by ``order`` and then by
    the two map positions.
    """
    col = F.col(passages) if isinstance(passages, str) else passages
    keep = [order] if order else []
    flat = (
        raw.select(*keep, F.posexplode(col).alias("_d", "_doc", "_passages"))
        .select(*keep, "_d", F.posexplode("_passages").alias("_p", "_name", "_body"))
        .select(
            *keep,
            "_d",
            "_p",
            F.col("_body.index").alias("id"),
            F.lit("").alias("title"),
            F.col("_body.page_content").alias("text"),
        )
    )
    if max_docs is not None:
        flat = flat.orderBy(*keep, "_d", "_p").limit(max_docs)
    return flat.select("id", "title", "text")


def read_corpus(spark: SparkSession, path: str, max_docs: int | None = None) -> DataFrame:
    """Nested corpus JSON as flat passages.

    One object per file is the layout of the format; many files are read in
    parallel, ordered by file name.
    """
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"),
        F.from_json("value", PASSAGES).alias("passages"),
    )
    return flatten_corpus(raw, "passages", "file", max_docs)


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Question file: a JSON array of items, or one item per line."""
    return spark.read.schema(QA).json(path, multiLine=True)


def explode_references(qa: DataFrame) -> DataFrame:
    """Gold references as passages titled by their document.

    Texts and ids are paired up to the end of the shorter list.
    """
    n = F.least(F.size("key_content.reference"), F.size("key_content.reference_idx"))
    pairs = F.slice(
        F.arrays_zip(
            F.col("key_content.reference").alias("text"),
            F.col("key_content.reference_idx").alias("id"),
        ),
        F.lit(1),
        F.greatest(n, F.lit(0)),
    )
    return qa.select(
        F.col("other_info.doc_name").alias("title"), F.explode(pairs).alias("_r")
    ).select(F.col("_r.id").alias("id"), "title", F.col("_r.text").alias("text"))


def write_corpus(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Flat corpus as JSON lines or parquet, one file per task."""
    df.select("id", "title", "text").write.mode("overwrite").format(fmt).save(path)


def load_qa(qa: DataFrame) -> DataFrame:
    """Questions with an answer; each keeps its own type and references."""
    return qa.filter(F.col("key_content.answer") != "").select(
        F.col("key_content.question").alias("question"),
        F.col("key_content.answer").alias("answer"),
        F.col("key_content.reference").alias("reference"),
        F.col("key_content.reference_idx").alias("reference_idx"),
        F.col("other_info.doc_name").alias("doc_name"),
        F.col("other_info.question_type").alias("question_type"),
    )


def load_multihop(df: DataFrame, row_id: str) -> DataFrame:
    """``title, title_id, start, sentences`` of the distinct titles.

    The first occurrence of a title, by row and place in the row, supplies its
    sentences; ids and sentence offsets count titles in that order.
    """
    pairs = df.select(
        row_id,
        F.posexplode(
            F.arrays_zip(
                F.col("context.title").alias("title"),
                F.col("context.sentences").alias("sentences"),
            )
        ).alias("_p", "_t"),
    )
    placed = pairs.select(
        (F.col(row_id) * PAIRS_PER_ROW + F.col("_p")).alias("_at"),
        F.col("_t.title").alias("title"),
        F.col("_t.sentences").alias("sentences"),
    )
    first = cut_lineage(
        placed.groupBy("title").agg(
            F.min("_at").alias("_at"), F.min_by("sentences", "_at").alias("sentences")
        )
    )
    numbered = id_positions(first, "_at", pos="title_id", total=None)
    sized = prefix_weights(numbered, "_at", F.size("sentences"), "start", "_total")
    return sized.select("title", "title_id", F.col("start").cast("long").alias("start"), "sentences")
