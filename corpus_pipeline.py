"""A training corpus from raw documents, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet and reads again for the next.
All but the last return the columns of their input. Rows whose id is null are never
removed by a decision on ids; rows that share an id stay or go together.

1. toxicity: documents that the classifier rejects (score of 0.5 or more) go; without labels to learn from none does;
2. near_duplicates: of each group linked by SimHash fingerprints or by five-word Jaccard similarity of 0.8 or more the
   document with the smallest id stays;
3. decontamination: documents that leak a test item go;
4. secrets: secrets in the text are replaced by a mark, and n_chars follows;
5. tokens: the text becomes token ids, which are decoded again and compared.

Stage 2 takes the links of the SimHash operator (fingerprints at 2 or fewer differing bits) and, as these reach few of the near
copies (at a similarity of 0.8 some 10 +- 3 of 64 bits differ), those of ``minhash``, which verifies the shingle sets themselves. A
group is whatever both kinds of links hold together.

SQL can express none of them whole (a trained model, minima of hashes,
block-max search, decoded structures, merges in order of rank).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pointloom.llm import bpe, decontaminate, minhash, secrets, simhash, toxicity
from pointloom.llm.common import broadcast_if_few, fresh
from pointloom.llm.queries import tokenizer_path
from pointloom.operators.graph import star_edges
from pointloom.session import materialise, scratch_path, table

ORACLE_SQL = None


def _without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``removed`` (one column, doc_id)."""
    ids = broadcast_if_few(materialise(removed.distinct(), "removed"))
    return docs.join(ids, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    if not model.trained:  # without labels nothing is known to be toxic
        return docs
    own = fresh(docs, "__score")
    named = docs.withColumnsRenamed({c: own for c in docs.columns if c.lower() == "score"})
    kept = toxicity.score(named, model, keep=True).where("score < 0.5").drop("score")
    return kept.withColumnsRenamed({own: c for c in docs.columns if c.lower() == "score"}).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    texts = docs.select("doc_id", "text")
    moved = [f(texts).where("doc_id <> component_id").select("doc_id", "component_id") for f in (simhash.near_duplicates, minhash.near_duplicates)]
    moved = materialise(moved[0].unionByName(moved[1]).distinct(), "moved")
    # each kind moves a row to its smallest id; where both meet in a document their groups are one. An id that several rows share holds texts
    # that may have nothing to do with each other, so it joins no groups
    several = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    links = moved.join(several, "doc_id", "left_anti").join(several.withColumnRenamed("doc_id", "component_id"), "component_id", "left_anti")
    joined = star_edges(links, "doc_id", "component_id").select(F.col("u").alias("doc_id"))
    return _without(docs, moved.select("doc_id").unionByName(joined))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, decontaminate.leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = fresh(docs, "__before")
    marked = secrets.redacted(docs.withColumn(before, F.col("text")))
    if "n_chars" in docs.columns:
        n = F.when(F.col("text") != F.col(before), F.length("text")).otherwise(F.col("n_chars"))
        marked = marked.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded_and_checked(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
