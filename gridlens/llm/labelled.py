"""Bounded samples of labelled documents, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import cut_lineage, text_table


def label_rows(labels: DataFrame, label: str, allowed: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, y) of the rows with a 0/1 label and an id; ids with contradicting rows are left out."""
    rows = text_table(labels, id_col, label).toDF("doc_id", "y").where("doc_id is not null and y in (0, 1)")
    if allowed is not None:
        rows = rows.where(allowed)
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", "y")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, allowed: Column | None = None,
                    text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """((doc_id, y, text), labelled documents per class): at most ``per_class`` ids of each class, by a hash of the id.

    The sample of ids is bounded by the parameter, so broadcasting it is too; one text is taken per id.
    """
    rows = cut_lineage(label_rows(labels, label, allowed, id_col))
    counts = {int(r["y"]): r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit("sample"))
    parts = [rows.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    ids = cut_lineage(parts[0].union(parts[1]))
    texts = text_table(docs, id_col, text).toDF("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")), counts
