"""Named collections of chunks, evaluation files, and path handling."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.operators import postings
from pagequarry.operators.postings import PostingsIndex
from pagequarry.operators.vectors import VectorTable, write_vectors
from pagequarry.sources.lines import json_lines
from pagequarry.sources.shared import exists, remove, shared_path

#: Columns of a stored chunk; those of one type are null in others.
CHUNK_SCHEMA = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("source_doc", T.StringType()),
    T.StructField("page_number", T.LongType()), T.StructField("token_count", T.LongType()), T.StructField("heading_path", T.ArrayType(T.StringType())),
    T.StructField("is_cross_page", T.BooleanType()), T.StructField("table_name", T.StringType()), T.StructField("page_span", T.ArrayType(T.LongType())),
    T.StructField("chart_type", T.StringType()), T.StructField("title", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("chunk_type", T.StringType()), T.StructField("ingested_at", T.TimestampType()),
])


class Collections:
    """Collections under one folder, each a directory of JSON lines, or of Parquet files where ``parquet`` is set."""

    def __init__(self, spark: SparkSession, root: str, parquet: bool = False):
        self.spark, self.root, self.parquet = spark, root.rstrip("/"), parquet

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if self.parquet else f"{self.root}/{name}.jsonl"

    def save(self, name: str, chunks: DataFrame, ingested_at: str | None = None) -> None:
        """Overwrite a collection with the time of ingest. A column ``vector`` goes to a table of vectors beside it, made once and here."""
        stamp = F.lit(ingested_at).cast("timestamp") if ingested_at else F.current_timestamp()
        rows = chunks.drop("embedding", "vector").withColumn("ingested_at", stamp)
        writer = rows.write.mode("overwrite")
        writer.partitionBy("chunk_type").parquet(self.path(name)) if self.parquet else writer.json(self.path(name))
        if "vector" in chunks.columns:
            path = shared_path(self.spark, "embedded")
            chunks.select(F.col("chunk_id").alias("doc_id"), "vector").write.parquet(path)  # the model runs once, the table is made in several passes
            write_vectors(self.spark.read.parquet(path), self.vector_path(name))
            remove(self.spark, path)

    def vector_path(self, name: str) -> str:
        return f"{self.root}/{name}.vectors"

    def vectors(self, name: str) -> VectorTable | None:
        """The stored vectors (doc_id is the chunk's id) of a collection that was saved with them."""
        return VectorTable(self.spark, self.vector_path(name)) if exists(self.spark, self.vector_path(name)) else None

    def index_path(self, name: str) -> str:
        return f"{self.root}/{name}.index"

    def build_index(self, name: str) -> PostingsIndex:
        """Index the stored chunks by their terms, beside the collection."""
        return postings.build(self.load(name), self.index_path(name), "chunk_id")

    def index(self, name: str) -> PostingsIndex | None:
        """The stored index of a collection that has one."""
        return PostingsIndex(self.spark, self.index_path(name)) if exists(self.spark, self.index_path(name)) else None

    def load(self, name: str, schema: T.StructType = CHUNK_SCHEMA) -> DataFrame:
        """A collection's rows; blank lines are none, and a missing collection is empty."""
        if not exists(self.spark, self.path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name)) if self.parquet else self.spark.read.schema(schema).json(self.path(name))

    def count_lines(self, name: str) -> int:
        """Lines of a JSON collection, blank ones too; 0 where it is missing."""
        return self.spark.read.text(self.path(name)).count() if exists(self.spark, self.path(name)) else 0

    def names(self) -> list[str]:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        found = [x for x in found if not x.endswith((".vectors", ".index"))]
        return sorted(x.removesuffix(".jsonl") for x in found if self.parquet or x.endswith(".jsonl"))


def union_chunks(text: DataFrame, table: DataFrame, chart: DataFrame) -> DataFrame:
    """All chunks; columns of one type are null in the others."""
    return text.unionByName(table, allowMissingColumns=True).unionByName(chart, allowMissingColumns=True)


def discover_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of the PDF files of a folder, whatever the case of their suffix."""
    try:
        return spark.read.format("binaryFile").load(f"{folder}/*.[pP][dD][fF]")
    except AnalysisException as none:
        if none.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")


def first_of_each(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """Rows whose key has not come before in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def align_by_position(answers: DataFrame, contexts: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """Rows of several inputs joined on their ``line`` column, as far as the shortest goes."""
    joined = answers.join(contexts, "line")
    return joined.join(questions, "line") if questions is not None else joined


def align_files(spark: SparkSession, answers: str, contexts: str, questions: str | None = None) -> DataFrame:
    """(line, answer, citations, contexts, question) of evaluation files of JSON lines, zipped by position; the shortest ends them."""
    kinds = {"answers": "answer string, citations array<string>", "contexts": "contexts array<string>", "questions": "question string"}
    held = [json_lines(spark, path, kinds[name]) for name, path in (("answers", answers), ("contexts", contexts), ("questions", questions)) if path]
    aligned = align_by_position(*held)
    return aligned if questions else aligned.withColumn("question", F.lit(None).cast("string"))
