"""Token counts as rollups that signed deltas maintain.

A store keeps two tables in shared storage. The ledger has, for each batch, the rows
(document, tokenizer version) that it set: source, language, count and whether the
document is alive. The deltas have, for each batch, signed sums of documents and tokens by
source, language and tokenizer version. A batch of inserts, deletes and revised counts
is compared with the ledger: what a row stood for so far is subtracted where it was
counted, what it stands for now is added, so totals are sums of deltas and nothing is
ever recounted.

Both tables of a batch are written into a folder of its own. The commit is one file with the
batch's number, name and folder: its number is claimed first by creating a file, which the
storage grants to one writer only, so of two writers one is refused and applies its batch again on
the new state. A batch whose name exists is skipped, so a repeated delivery changes nothing, and a batch
that failed half-way leaves only a folder that nothing names (a writer that dies between claim and
commit leaves a claim, which ``release`` takes back).

Every ``SNAPSHOT`` batches the ledger is written whole; reading starts from there. A batch of few
keys reads only their rows of the ledger before anything is shuffled.

Defined results: inserting what exists revises it, revising what doesn't inserts it,
deleting what doesn't changes nothing; of several changes of one row in one batch the
one with the largest ``at`` holds, then deletes, then the larger count; null counts are zero;
null sources and languages are groups of their own, null ids a document of
their own; an empty batch commits and changes nothing; other columns are not read. Ids are integers.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialise
from .bpe import counts as token_counts
from .common import join_classes

KEY = ("doc_id", "tokenizer")
GROUP = ("source", "lang", "tokenizer")
LEDGER = "doc_id long, tokenizer string, source string, lang string, tokens long, alive boolean, seq long"
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"
#: Batches after which the ledger is written whole, and keys of a batch up to which the ledger is read for them alone.
SNAPSHOT, FEW_KEYS = 16, 50_000


class Rollup:
    """Token totals by source, language and tokenizer version in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[dict]:
        """What was committed, oldest first: batch, folder and whether it has a snapshot."""
        if not self._fs.exists(self._hadoop(self.path)):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._hadoop(self.path)))
        out = []
        for n in (n for n in names if n.endswith(".commit")):
            stream = self._fs.open(self._hadoop(f"{self.path}/{n}"))
            out.append(json.loads(stream.readUTF()))
            stream.close()
        return out

    def batches(self) -> list[str]:
        """Names of the committed batches, oldest first."""
        return [c["batch"] for c in self._commits()]

    def _claim(self, seq: int) -> str:
        return f"{self.path}/{seq:012d}.claim"

    def release(self, seq: int) -> None:
        """Take back the claim of a writer that died before its commit."""
        if seq >= len(self._commits()):
            self._fs.delete(self._hadoop(self._claim(seq)), False)

    def _commit(self, seq: int, batch: str, folder: str, snapshot: bool) -> None:
        if not self._fs.createNewFile(self._hadoop(self._claim(seq))):
            raise RuntimeError(f"number {seq} was taken by another writer; apply batch {batch} again")
        at = f"{self.path}/{folder}/commit"
        out = self._fs.create(self._hadoop(at), True)
        out.writeUTF(json.dumps({"batch": batch, "folder": folder, "snapshot": snapshot}))
        out.close()
        if not self._fs.rename(self._hadoop(at), self._hadoop(f"{self.path}/{seq:012d}.commit")):
            raise RuntimeError(f"batch {batch} could not be committed")

    def ledger(self, keys: DataFrame | None = None) -> DataFrame:
        """The last row of each document and tokenizer version (of those in ``keys`` at least, where these are few)."""
        done = self._commits()
        start = max((k for k, c in enumerate(done) if c["snapshot"]), default=None)
        paths = [f"{self.path}/{c['folder']}/ledger" for c in done[0 if start is None else start + 1 :]]
        paths += [f"{self.path}/{done[start]['folder']}/snapshot"] if start is not None else []
        rows = self.spark.read.schema(LEDGER).parquet(*paths) if paths else self.spark.createDataFrame([], LEDGER)
        if keys is not None and keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
            wanted = F.broadcast(keys.select(*[F.col(k).alias(f"w_{k}") for k in KEY]).distinct())
            rows = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_doc_id")) & F.col("tokenizer").eqNullSafe(F.col("w_tokenizer")), "left_semi")
        last = rows.groupBy(*KEY).agg(F.max_by(F.struct("source", "lang", "tokens", "alive", "seq"), "seq").alias("x"))
        return last.select(*KEY, "x.*")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit ``changes`` (op, doc_id, source, lang, tokenizer, tokens, at) under a name; False where it was committed before."""
        done = self.batches()
        if batch in done:
            return False
        seq = len(done)
        rows = changes.select("op", F.col("doc_id").cast("long"), "source", "lang", "tokenizer",
            F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), "at")
        new = rows.groupBy(*KEY).agg(F.max_by(F.struct("source", "lang", "tokens", "op"),
                F.struct("at", F.col("op") == "delete", "tokens", "source", "lang")).alias("n")).select(*KEY, "n.*")
        new = materialise(new, "batch")
        old = self.ledger(new).where("alive").select(F.col("doc_id").alias("o_id"), F.col("tokenizer").alias("o_tok"),
            F.col("source").alias("o_source"), F.col("lang").alias("o_lang"), F.col("tokens").alias("o_tokens"), F.lit(True).alias("had"))
        both = new.join(old, new.doc_id.eqNullSafe(old.o_id) & new.tokenizer.eqNullSafe(old.o_tok), "left").where("op <> 'delete' or had")
        folder = f"data-{uuid.uuid4().hex}"
        path = f"{self.path}/{folder}"
        gone = F.col("op") == "delete"
        kept = lambda a, b: F.when(gone, F.col(b)).otherwise(F.col(a))
        both.select(*KEY, kept("source", "o_source").alias("source"), kept("lang", "o_lang").alias("lang"), "tokens",
            (~gone).alias("alive"), F.lit(seq).cast("long").alias("seq"), "o_source", "o_lang", "o_tokens",
            "had").write.parquet(f"{path}/ledger")
        written = self.spark.read.parquet(f"{path}/ledger")
        plus = written.where("alive").select(*GROUP, F.lit(1).alias("docs"), "tokens")
        minus = written.where("had").select(F.col("o_source").alias("source"), F.col("o_lang").alias("lang"), "tokenizer",
            F.lit(-1).alias("docs"), (-F.col("o_tokens")).alias("tokens"))
        plus.unionByName(minus).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{path}/deltas")
        snapshot = seq % SNAPSHOT == SNAPSHOT - 1
        if snapshot:
            columns = [c.split()[0] for c in LEDGER.split(", ")]
            every = self.ledger().select(*columns).unionByName(written.select(*columns))
            every.groupBy(*KEY).agg(F.max_by(F.struct(*columns[2:]), "seq").alias("x")).select(*KEY,
                "x.*").where("alive").write.parquet(f"{path}/snapshot")
        self._commit(seq, batch, folder, snapshot)
        return True

    def _deltas(self) -> DataFrame:
        done = [f"{self.path}/{c['folder']}/deltas" for c in self._commits()]
        return self.spark.read.schema(DELTAS).parquet(*done) if done else self.spark.createDataFrame([], DELTAS)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs and tokens, without groups that have no documents left."""
        return self._deltas().groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0")


#: Tokenizer versions: ids of the public byte-level vocabulary, and bytes.
BPE, BYTES = "byte_bpe_50k/1", "bytes/1"


def corpus_totals(docs: DataFrame, store: Rollup, tokenizer: str) -> DataFrame:
    """Totals of a corpus after its usual life: all documents are inserted with an estimate of their tokens
    (a quarter of the bytes, rounded up), counts are revised to those of the tokenizer in the file ``tokenizer``
    and a second version is added, exact copies are deleted but for the smallest id, and batches arrive more than once.
    """
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.coalesce("text", F.lit("")).alias("body"))
    body = body.withColumns({"bytes": F.octet_length("body").cast("long"), "digest": F.sha2(F.col("body").cast("binary"), 256)})
    columns = ["doc_id", "source", "lang", "bytes", "digest", "n_tokens"]
    counts = materialise(token_counts(body, tokenizer, text_col="body").select(*columns), "token-counts")
    rows = lambda op, version, col: counts.select(F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(version).alias("tokenizer"),
        col.cast("long").alias("tokens"), F.lit(0).alias("at"))
    copies = counts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    several = copies.where("n > 1")
    copied = join_classes(counts.select("doc_id", "source", "lang", "digest"), several, "digest").where("doc_id <> first")
    deleted = copied.select("doc_id", "source", "lang", F.explode(F.array(F.lit(BPE), F.lit(BYTES))).alias("tokenizer"))
    steps = [
        ("load", rows("insert", BPE, F.ceil(F.col("bytes") / 4))),
        ("recount", rows("revise", BPE, F.col("n_tokens")).unionByName(rows("insert", BYTES, F.col("bytes")))),
        ("copies", deleted.select(F.lit("delete").alias("op"), "doc_id", "source", "lang", "tokenizer", F.lit(0).alias("tokens"),
                F.lit(0).alias("at"))),
    ]
    for name, changes in [*steps, steps[1], steps[0]]:  # the last two are repeated deliveries
        store.apply(name, changes)
    return store.totals()
