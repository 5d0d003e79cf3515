"""A corpus pipeline over the operators of motrac.llm, stage by stage.

Documents that the quality classifier rejects go, then toxic ones, then exact
copies but the one with the smallest doc_id, then all but one of each group of
near copies; what stays is packed in sequences. Each stage sees all that its
predecessor kept, and all but the last return the columns of documents.

A row with a null doc_id is judged by its text like any other. Where rows repeat
a doc_id within a group of copies, one of them stays; rows that share a doc_id, or
have none, with texts of their own all stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motrac.llm import dedup, packing, quality, simhash, toxicity
from motrac.llm.common import materialize, table


def _only(docs: DataFrame, judged: DataFrame, keep: Column, key: list) -> DataFrame:
    """The rows of docs whose key a kept row of judged has; where rows share a key, one row of it.

    judged has a row for each row of docs. key: pairs of a column of docs and a column of judged.
    """
    names = [f"_key{i}" for i in range(len(key))]
    kept = judged.select(keep.cast("int").alias("_keep"), *[b.alias(n) for n, (_, b) in zip(names, key)]).groupBy(*names).agg(F.count("*").alias("_rows"), F.max("_keep").alias("_keep"))
    kept = materialize(kept.where("_keep = 1"), "kept")
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[a.alias(f"_own{i}") for i, (a, _) in enumerate(key)])
    on = [F.col(f"_own{i}").eqNullSafe(F.col(n)) for i, n in enumerate(names)]
    out = keyed.join(kept, on, "left_semi")
    if kept.where("_rows > 1").head(1):
        out = out.dropDuplicates([f"_own{i}" for i in range(len(key))])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filter_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = dedup.exact_duplicates(docs)
    digest = F.sha2(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    return _only(docs, judged, F.col("kept"), [(F.col("doc_id").cast("long"), F.col("doc_id")), (digest, F.col("text_sha256"))])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that with the smallest doc_id, a null one last.

    A doc_id that only one row has finds its row alone. Rows without one, or that
    share it, are told apart by their fingerprint, which is made for them again.
    """
    judged = simhash.labelled(docs)
    first = judged.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("k")).select("k.doc_id", "k.fp")
    repeated = judged.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("many"))
    kept = first.join(repeated, "doc_id", "left").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), (F.col("doc_id").isNull() | F.col("many").isNotNull()).alias("_many"))
    kept = materialize(kept, "kept")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*columns, F.col("doc_id").cast("long").alias("_own"))
    out = keyed.join(kept.where("not _many"), F.col("_own") == F.col("_id"), "left_semi").select(*columns)
    many = kept.where("_many")
    if many.head(1):
        shared = keyed.join(many.where("_id is not null").select("_id").distinct(), F.col("_own") == F.col("_id"), "left_semi").unionByName(keyed.where("_own is null"))
        shared = shared.withColumn("_print", simhash.fingerprint_of(F.col("text")))
        shared = shared.join(many, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_fp")), "left_semi")
        out = out.unionByName(shared.dropDuplicates(["_own", "_print"]).select(*columns))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs)


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("packing", pack)]
#: Two classifiers, SimHash and a tokenizer are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}-{name.replace(' ', '-')}")
    return docs
