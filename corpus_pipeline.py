"""A cleaning pipeline over documents: toxicity, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of docs. Every stage works on all rows that its
predecessor kept.

1. toxicity: documents whose score reaches the threshold of their language go. The classifier learns from `labels`.
2. line_dedup: later copies and near copies of lines go; documents stay, with the lines that are left.
3. near_dedup: one document of each SimHash component stays, the one with the smallest doc_id. Documents that line dedup
   left without any text are alike, and one of them stays.
4. decontaminate: documents that hold a window of a benchmark item go.
5. encode: doc_id, source, lang, n_pieces and the SentencePiece ids of the whole text.

Of every stage: a null text counts as empty (and stays null where the row stays); rows with null doc_id have no say in dedup and
stay there; texts of any length are read whole; an empty table gives an empty one; further columns of docs, whatever their names, ride along
inside a struct; repeated rows are one document to near_dedup, while rows of one doc_id with different texts are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate as leaks
from sparkloom.llm import lines, pieces, simhash, toxicity
from sparkloom.llm.common import column, let_go, materialise


def _bundle(docs: DataFrame, *names: str, **more: Column) -> DataFrame:
    """The columns that a stage reads, and `row`, all columns of docs."""
    have = [column(n) if n in docs.columns else F.lit(None).cast("string").alias(n) for n in names]
    return docs.select(*have, *(c.alias(n) for n, c in more.items()), F.struct(*map(column, docs.columns)).alias("row"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_go(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    scored = toxicity.score(_bundle(docs, "text", "lang"), model, ["row", "lang"])
    return scored.where(F.col("toxicity") < toxicity.threshold_of(model, F.col("lang"))).select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_go(spark)
    rest = [c for c in docs.columns if c != "text"]
    done = lines.dedup_lines(docs.select("doc_id", "text", F.struct(*map(column, rest)).alias("row")))
    values = {c: F.col("row")[c] for c in rest} | {"text": F.col("text")}
    if "n_chars" in rest:
        values["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(values["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return done.select(*(values[c].alias(c) for c in docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_go(spark)
    hashed = F.xxhash64(F.coalesce(column("text"), F.lit("")))
    found = simhash.near_duplicates(docs.select("doc_id", "text", hashed.alias("th")), keep=("th",))
    heads = found.where("doc_id is not null").groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("head")).select("head.*")
    rows = _bundle(docs, "doc_id", th=hashed)
    # repeats of the document that stays fall in one window
    once = rows.join(heads, ["doc_id", "th"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "th").orderBy("th")))
    return once.where("n = 1").select("row.*").unionByName(rows.where("doc_id is null").select("row.*"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_go(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks.without_contaminated(docs, benchmark)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_go(spark)
    keep = [c for c in ("doc_id", "source", "lang") if c in docs.columns]
    coded = pieces.encode(docs, keep)
    return coded.select(*keep, F.size("pieces").cast("bigint").alias("n_pieces"), "pieces")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("encode", encode_stage),
]

#: A trained classifier and MinHash bands are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
