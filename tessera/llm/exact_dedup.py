"""Exact deduplication with an extendible-hash index on shared files.

Keys are the leading 64 bits of the SHA-256 of each text in ASCII lower case. A histogram of
key prefixes (its size is set by the index size, not by the rows) drives the directory: a bucket
over its byte capacity splits on its next prefix bit, and the directory doubles when a bucket's depth
passes its own. Each bucket, a contiguous key range, goes to one owner task, which chains the
texts under a key, compares their bytes and writes its groups to the shared folder. Map tasks chain
their own copies first, so a text that holds a third of all rows reaches its owner once per
map task, and its group goes back to its rows by broadcast.

The directory has at most 2**MAX_BITS slots. Past 8 TB of distinct text buckets therefore grow (to some
100 MB at 100 TB); an owner reads its bucket sorted by key, with spilling, and holds one chain at a
time, so its memory does not grow with the bucket.

Defined results: null counts as the empty text and equals it; of equal texts the row with the
largest doc_id stays; a null doc_id is smaller than any other; rows that share both text and
doc_id are one document and stay or go together; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import vec
from tessera.llm.shared import join_heavy, keep, row_key, table, without

#: Bytes of distinct text in a bucket, and of text that a map task chains before it sends.
BUCKET_BYTES = 8 << 20
CHAIN_BYTES = 16 << 20
MAX_BITS = 20
ENTRY_SCHEMA = "doc_id bigint, h bigint, text_sha256 string, n_bytes bigint"
CHAIN_SCHEMA = "bucket int, h bigint, text_sha256 string, text binary, keep_id bigint, n bigint"
GROUP_SCHEMA = "h bigint, text_sha256 string, keep_id bigint, group_size bigint"


class Directory:
    """An extendible-hash directory over key prefixes; buckets are numbered in key order."""

    def __init__(self, weights: np.ndarray, capacity: float):
        """``weights``: the load of each prefix of ``log2(len(weights))`` bits."""
        self.bits = len(weights).bit_length() - 1
        load = np.concatenate([[0], np.cumsum(weights)])
        self.depth, done, open_ = 0, [], [(0, 0)]
        while open_:
            prefix, depth = open_.pop()
            width = 1 << (self.bits - depth)
            if depth < self.bits and load[(prefix + 1) * width] - load[prefix * width] > capacity:
                if depth == self.depth:
                    self.depth += 1  # the directory doubles
                open_ += [(prefix << 1 | 1, depth + 1), (prefix << 1, depth + 1)]
            else:
                done.append((prefix, depth))
        self.buckets = done  # (prefix, local depth), in key order
        self.slots = np.repeat(np.arange(len(done), dtype=np.int32), [1 << (self.depth - d) for _, d in done])

    def bucket(self, h: int) -> int:
        return int(self.slots[(h & (2**64 - 1)) >> (64 - self.depth) if self.depth else 0])


def hashed(batch: pa.RecordBatch):
    """(doc_id, key, digest, normalised bytes) of each row."""
    data, offs = vec.text_buffer(batch.column(1))
    raw = memoryview(vec.LOWER[data].tobytes())
    o = offs.tolist()
    for i, doc in enumerate(batch.column(0).to_pylist()):
        text = raw[o[i] : o[i + 1]]
        sha = hashlib.sha256(text)
        yield doc, int.from_bytes(sha.digest()[:8], "big", signed=True), sha.hexdigest(), text


def _entries(batches):
    for rb in batches:
        cols = list(zip(*((d, h, s, len(t)) for d, h, s, t in hashed(rb)), strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["doc_id", "h", "text_sha256", "n_bytes"])


def _largest(a, b):
    return b if a is None else a if b is None else max(a, b)


def _chains(directory):
    def rows(chains: dict):
        out = [(directory.value.bucket(h), h, sha, text, doc, n) for h, links in chains.items() for text, sha, doc, n in links]
        for i in range(0, len(out), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 1000], strict=True), (pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["bucket", "h", "text_sha256", "text", "keep_id", "n"])

    def run(batches):
        chains, size = {}, 0
        for rb in batches:
            for doc, h, sha, text in hashed(rb):
                links = chains.setdefault(h, [])
                for link in links:
                    if link[0] == text:
                        link[2], link[3] = _largest(link[2], doc), link[3] + 1
                        break
                else:
                    links.append([bytes(text), sha, doc, 1])
                    size += len(text) + 200
                    if size > CHAIN_BYTES:
                        yield from rows(chains)
                        chains, size = {}, 0
        yield from rows(chains)

    return vec.tidy(run)


def _owner(batches):
    """Chains of a key range, sorted by key -> its groups of two rows or more."""
    key, links = None, []

    def groups():
        return [(key, sha, doc, n) for _, sha, doc, n in links if n > 1]

    for rb in batches:
        out = []
        for h, sha, text, doc, n in zip(*(rb.column(c).to_pylist() for c in ("h", "text_sha256", "text", "keep_id", "n")), strict=True):
            if h != key:
                out += groups()
                key, links = h, []
            for link in links:
                if link[0] == text:
                    link[2], link[3] = _largest(link[2], doc), link[3] + n
                    break
            else:
                links.append([text, sha, doc, n])
        yield _group_batch(out)
    yield _group_batch(groups())


def _group_batch(rows):
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["h", "text_sha256", "keep_id", "group_size"])


def build_directory(entries: DataFrame) -> Directory:
    """The directory for the distinct keys of ``entries``, from a histogram of their prefixes."""
    keys = entries.groupBy("h").agg(F.max("n_bytes").alias("n_bytes"))
    total = entries.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(MAX_BITS, max(1, math.ceil(math.log2(1 + total / BUCKET_BYTES)) + 3))
    weights = np.zeros(1 << bits, np.int64)
    for p, w in keys.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("p")).agg(F.sum(F.col("n_bytes") + 200)).collect():
        weights[p] = w
    return Directory(weights, BUCKET_BYTES)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    entries, _ = keep(rows.mapInArrow(vec.tidy(_entries), ENTRY_SCHEMA), "exact-entries")
    directory = build_directory(entries)
    chains = rows.mapInArrow(_chains(spark.sparkContext.broadcast(directory)), CHAIN_SCHEMA)
    owned = chains.repartitionById(len(directory.buckets), F.col("bucket")).sortWithinPartitions("h")
    groups, _ = keep(owned.mapInArrow(_owner, GROUP_SCHEMA), "exact-index")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return join_heavy(entries, groups, ["h", "text_sha256"], "group_size", entries.count()).select(F.col("doc_id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct text."""
    gone = exact_groups(docs, id_col, text_col).where(~F.col("kept")).select(row_key(id_col, "text_sha256").alias("row"))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    sha = F.sha2(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), letters, letters.lower()), 256)
    key = F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("bigint"), F.lit(False), sha)
    return without(docs, gone, key)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


#: ASCII lower case in DuckDB: translate() maps the 26 letters and nothing else.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH n AS (SELECT doc_id, {LOWERED} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t"""
