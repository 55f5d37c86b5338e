"""Token totals by source, language and tokenizer version, maintained by deltas.

A batch of changes (inserts, deletes, revised counts) becomes signed sums per
group, written to a folder of its own. It is committed by a marker: a small file named
after the batch, which names that folder and which only one writer can create. Totals are
sums over committed batches, so they are additive, and a batch that is sent again, or by
two writers at once, counts once: the others find the marker there.
"""

from __future__ import annotations

import base64
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer_version"]
_DELTA = "source string, lang string, tokenizer_version string, d_docs long, d_tokens long"


def tokenizer(path: str, pattern: str):
    """A byte-level BPE tokenizer from a ranks file (base64 token, rank) at ``path``."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """The columns of ``keep`` with ``n_tokens long`` of the whole text; a null or empty text has none.

    ``path`` names a vocabulary file that every node of the cluster has. Repeated rows are counted each; an empty
    table gives no rows; a column n_tokens of ``keep`` is replaced by the count.
    """
    keep = tuple(k for k in keep if k != "n_tokens")

    def run(batches):
        import pyarrow as pa

        encode = tokenizer(path, pattern).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(1, b.num_columns)), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    out = docs.select(F.col(text_col).cast("string").alias("__text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[1:])
    return out.mapInArrow(run, f"{schema}, n_tokens long")


class TokenRollup:
    """Totals kept under a folder that all nodes share.

    ``apply`` takes rows ``op`` (insert, delete, revise), the key columns,
    ``n_tokens`` and, for revise, ``old_tokens`` (the count it replaces). Null keys
    are groups of their own; null counts are 0; an unknown or null op is an error.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def _checked(batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id) or batch_id.startswith((".", "_")):
            raise ValueError(f"batch id {batch_id!r}: letters, digits, '_', '.', '-' only, the first a letter, digit or '-'")
        return batch_id

    def _marker(self, batch_id: str) -> str:
        return f"{self.root}/commits/{batch_id}"

    def committed(self) -> list[str]:
        top = self._path(f"{self.root}/commits")
        if not self._fs.exists(top):
            return []
        return sorted(n for s in self._fs.listStatus(top) if not (n := s.getPath().getName()).startswith((".", "_")))

    def _folder(self, batch_id: str) -> str:
        """The folder that a marker names."""
        reader = self._fs.open(self._path(self._marker(batch_id)))
        try:
            name = bytes(reader.readAllBytes()).decode()
        finally:
            reader.close()
        if not re.fullmatch("[0-9a-f]{32}", name):
            raise RuntimeError(f"the commit of batch {batch_id} was interrupted; remove {self._marker(batch_id)} and send the batch again")
        return f"{self.root}/data/{name}"

    def _create_marker(self, batch_id: str, name: str) -> bool:
        """Create the batch's marker; False if there is one. Exactly one of any number of writers gets True."""
        self._fs.mkdirs(self._path(f"{self.root}/commits"))
        at = self._path(self._marker(batch_id))
        if self._fs.getUri().getScheme() == "file":
            place = at.toUri().getPath()
            draft = f"{os.path.dirname(place)}/.{name}"
            with open(draft, "x") as f:
                f.write(name)
            try:
                os.link(draft, place)  # fails if the place is taken, and never shows a half-written marker
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        try:
            writer = self._fs.create(at, False)  # exclusive on HDFS and on object stores with conditional writes
        except Exception:
            if self._fs.exists(at):
                return False
            raise
        writer.write(bytearray(name.encode()))
        writer.close()
        return True

    def _commit(self, batch_id: str, delta: DataFrame) -> bool:
        name = uuid.uuid4().hex
        delta.write.parquet(f"{self.root}/data/{name}")
        if self._create_marker(batch_id, name):
            return True
        self._fs.delete(self._path(f"{self.root}/data/{name}"), True)
        return False

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch; False if a batch of that id is already in the totals, which then stay as they are."""
        if self._fs.exists(self._path(self._marker(self._checked(batch_id)))):
            return False
        new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0)) if "old_tokens" in changes.columns else F.lit(0)
        op = F.col("op")
        known = F.when(op == "insert", F.lit(1)).when(op == "delete", F.lit(-1)).when(op == "revise", F.lit(0)).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null")))).cast("int"))
        signed = changes.select(
            *[F.col(k).cast("string").alias(k) for k in KEYS], known.alias("d"), F.when(op == "revise", new - old).when(op == "delete", -new).otherwise(new).alias("t")
        )
        delta = signed.groupBy(*KEYS).agg(F.sum("d").cast("long").alias("d_docs"), F.sum("t").cast("long").alias("d_tokens"))
        return self._commit(batch_id, delta)

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer_version, n_docs, n_tokens)`` over all committed batches; groups back at zero are left out."""
        done = self.committed()
        if not done:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer_version string, n_docs long, n_tokens long")
        rows = self.spark.read.schema(_DELTA).parquet(*[self._folder(b) for b in done])
        return rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self, into: str) -> bool:
        """Commit the totals as they stand to another rollup folder, as one batch."""
        t = self.totals().select(*KEYS, F.col("n_docs").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))
        return TokenRollup(self.spark, into)._commit(f"compacted-{len(self.committed())}", t)
