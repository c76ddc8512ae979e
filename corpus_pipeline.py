"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Toxic documents go, one document of each group of near duplicates stays, documents that contain benchmark passages go,
sources are mixed to target weights, and what is left is cut into shards. Each stage takes (spark, docs, sf_dir), works on
all its predecessor kept, and returns the columns of ``docs``; the last adds ``shard`` and ``slot``. Extra columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, neardup, sharding, toxicity, winnow
from tidemark.llm.places import free_name, placed
from tidemark.runtime import stage, unstage, working

SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose probability of toxicity is below one half; NULL and wordless texts stay. Learned from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.train_part(docs), toxicity.train_part(labels))
    name = free_name(docs, "toxicity")
    return toxicity.score(spark, docs, model, name).where(F.col(name) < 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of those with an id, and of those without, one each.

    Every row is compared by its own text, whatever its id, and groups are reached over all rows. Of the rows with an id
    the one with the smallest stays; of rows that repeat it, or have none, the one whose text has the smallest SHA-256.
    A row with an id is thus no reason to drop one without, nor the other way round. Texts without words all stay.
    """
    rows, place = placed(docs, "single-rows")
    with working() as keep:
        text = F.col("text").cast("string")
        keyed = rows.select(F.col(place).alias("place"), F.col("doc_id").cast("long").alias("id"), F.sha2(text, 256).alias("digest"), text.alias("text"))
        found = neardup.linked(keyed).where("component IS NOT NULL").select("place", "id", "digest", "component")
        found = stage(found, "single-groups")
        of_group = found.groupBy("component", F.col("id").isNull().alias("no_id"))
        first = of_group.agg(F.min(F.struct("id", "digest", "place")).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        first = first.select(F.col("component").alias("_group"), "no_id", F.col("_first.place").alias("_kept"))
        same = (F.col("component") == F.col("_group")) & (F.col("id").isNull() == F.col("no_id"))
        copies = found.join(first, same).where("place != _kept").select(F.col("place").alias(place))
        copies = keep(stage(copies, "single-copies"))
    return rows.join(copies, place, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window, each judged by its own text whatever its id."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, place = placed(docs, "clean-rows")
    with working() as keep:
        read, spans = winnow.decontaminate(rows.select(F.col(place).alias("doc_id"), "text"), items)
        hit = read.join(spans.select("_doc").distinct(), "_doc", "left_semi").select(F.col("doc_id").alias(place))
        hit = keep(stage(hit, "contaminated"))
    return rows.join(hit, place, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole copy; none of it if that is 0."""
    mixed = mixing.mix(docs, carry=True)
    times = mixing.copies(F.col("taken"), F.col("size"))
    copies = mixed.select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("_copy"))
    return copies.select("row.*")


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``shard`` and ``slot``, equal texts together."""
    placed = sharding.shard_documents(docs, SHARDS, carry=True)
    new = [F.col(n).alias(free_name(docs, n)) for n in ("shard", "slot")]
    return placed.select("row.*", *new)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

ORACLE_SQL = None  # a trained classifier and signatures have no SQL; the tests run a brute-force version beside it


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Only the last table is left staged: a stage's input and working tables are dropped
    once its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES:
        before = docs
        with working() as keep:
            docs = keep(stage(work(spark, before, sf_dir), name.replace(" ", "-")))
        unstage(before)
    return docs
