"""A corpus pipeline over ``documents``: five stages, each a written table that the next one reads.

Every stage works on all that its predecessor kept, and all but the last return the columns of
documents. See the operators' modules for how each decides.

In every stage a null text counts as empty, texts are read whole, rows may repeat, ids may be null or
repeat, an empty table gives an empty one, and other columns of any name are passed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlens.llm import containment, mixing, ngramjoin, suffixes, toxicity
from orderlens.llm.queries import table
from orderlens.llm.store import Scratch


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels of these documents, does not call toxic. Empty and null
    texts get the bias alone; repeated rows are judged alike; without a usable label all documents stay."""
    scratch = Scratch(spark, "toxicity")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(False), scratch)
    if model.isEmpty():
        return docs
    score = _free(docs, "_toxicity")
    return toxicity.score(docs, model, docs.columns, score).where(F.col(score) < 0.5).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the n-gram Jaccard join (five words, similarity 0.8): the one with the
    smallest id, those without an id last, and of these the one with the least text hash. Rows with equal id
    and text are one document, rows that share an id alone are not; rows without an id and words all stay."""
    scratch = Scratch(spark, "near-copies")
    bare = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(~bare)
    # the join sees row keys as ids: never null, and different texts of one id stay apart
    key, whole_name = _free(docs, "_key"), _free(docs, "_whole")
    joined = ngramjoin.ngram_jaccard_join(rows.select(suffixes.row_key().alias("doc_id"), "text"), n=5, percent=80, scratch=scratch)
    part_of = joined.select(F.col("doc_id").alias(key), F.col("component_id").alias("part")).distinct()
    whole = F.xxhash64(*docs.columns)  # tells rows apart that share id and text
    place = rows.select(suffixes.row_key().alias(key), F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("t"), whole.alias("whole")).alias("place"))
    keep = scratch.write(place.join(part_of, key).groupBy("part").agg(F.min("place").alias("m")).select(F.col("m.whole").alias(whole_name)), "keep")
    return (rows.withColumn(whole_name, whole).join(keep, whole_name, "left_semi").dropDuplicates([whole_name]).drop(whole_name)
            .select(*docs.columns).unionByName(docs.where(bare)))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they occur first and are cut elsewhere; rows with equal id and text are
    one document; a document of which nothing is left goes, one that was empty before stays."""
    return suffixes.cut_passages(docs, suffixes.repeated_passages(docs, Scratch(spark, "repeats")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, told apart by id and text, so with a null or repeated id too."""
    found = containment.contained_items(docs.select(suffixes.row_key().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    key = _free(docs, "_key")
    leaks = Scratch(spark, "leaks").write(found.select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return docs.withColumn(key, suffixes.row_key()).join(leaks, key, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their words in it, repeats counted. Texts without words are in none; a null
    source is a source."""
    rows, slots, pieces = mixing.mix_sources(docs, scratch=Scratch(spark, "mixture"))
    taken = mixing.words_taken(rows, slots, pieces).where("taken > 0")
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing_sources", mix),
]

#: Fitted models and pseudorandom draws are not SQL; tests/llm holds brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
