"""Reproducible shuffle of rows into shards: a Feistel permutation, with cycle walking, of global row numbers.

Rows get gapless numbers in the order of id (null first), text size and text digest, so the numbers do not
depend on how the input is partitioned. A keyed permutation of 0..n-1 gives each number its place; shard and
slot are the place's remainder and quotient by the number of shards. So shards differ by one row at most,
slots have no gaps, and either direction can be computed for any single row from n, the seed and the shards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.llm.common import write_stage

#: Modulus of the round function: squares of its remainders fit 64 bits.
PRIME = (1 << 31) - 1
#: Bits of a row's number within its partition in monotonically_increasing_id().
AT_BITS = 33
#: Codec of the files that hold whole rows: the numbered rows and the shards stand on disk at the same time.
CODEC = "zstd"


def round_keys(seed: int, rounds: int) -> list[tuple[int, ...]]:
    """Three remainders a round, from a digest of the seed and the round's number."""
    digests = [hashlib.sha256(f"{seed}/{k}".encode()).digest() for k in range(rounds)]
    return [tuple(int.from_bytes(d[i:i + 8], "little") % PRIME for i in (0, 8, 16)) for d in digests]


class Permutation:
    """A keyed bijection of 0..n-1, for n up to 2^60.

    The balanced Feistel network permutes the smallest even power of two that holds n, under 4 n; a result
    of n or more is permuted again until it is less. That walk ends, as it runs along the cycle of a number
    below n.
    """

    def __init__(self, n: int, seed: int = 0, rounds: int = 6):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        if self.half > 30:
            raise ValueError("more than 2^60 rows")
        self.mask = (1 << self.half) - 1
        self.keys = round_keys(seed, rounds)

    def mixed(self, x: np.ndarray, key: tuple[int, ...]) -> np.ndarray:
        a, b, c = key
        z = (x + a) % PRIME
        z = (z * z + b) % PRIME
        z = (z * z + c) % PRIME
        return (z ^ (z >> 15)) & self.mask

    def forth(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ self.mixed(right, key)
        return left << self.half | right

    def back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in reversed(self.keys):
            left, right = right ^ self.mixed(left, key), left
        return left << self.half | right

    def walked(self, step, x: np.ndarray) -> np.ndarray:
        x = step(np.asarray(x, np.int64))
        while (out := np.flatnonzero(x >= self.n)).size:
            x[out] = step(x[out])
        return x

    def place(self, row: np.ndarray) -> np.ndarray:
        """Where the rows of these numbers go."""
        return self.walked(self.forth, row)

    def row(self, place: np.ndarray) -> np.ndarray:
        """Which row numbers stand at these places."""
        return self.walked(self.back, place)


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray, int]:
    """(rows, first, n): rows r and their sorted place `at` (partition, number in it), the number at which each
    partition begins, and how many rows there are.

    One exchange by ranges of (id, size, digest, input position): rows of one id, however many, are split
    by their texts, and equal rows by their position. Equal rows may swap numbers without any effect. The
    driver gets one count a partition.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = [F.col("i").asc_nulls_first(), F.col("size"), F.col("digest"), F.col("u")]
    rows = docs.select(F.struct(*docs.columns).alias("r"), F.col(id_col).alias("i"), F.octet_length(text).alias("size"),
                       F.md5(text.cast("binary")).alias("digest"), F.monotonically_increasing_id().alias("u"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = write_stage(rows.select("r", F.monotonically_increasing_id().alias("at")), "numbered", CODEC)
    sizes = rows.groupBy(F.shiftright("at", AT_BITS).alias("p")).count().collect()
    counts = np.zeros(max((r.p for r in sizes), default=-1) + 1, np.int64)
    for r in sizes:
        counts[r.p] = r["count"]
    return rows, np.cumsum(counts) - counts, int(counts.sum())


def sharded(docs: DataFrame, shards: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs` with row_number, shard (0 to shards - 1) and slot (from 0), both by the law of rows.

    Null texts count as empty; null ids come first. Rows of equal id are ordered by size and digest of their
    texts; wholly equal rows each have a slot of their own. Equal texts are not kept together, as no group may
    make a shard longer. Columns of the names added are replaced. An empty table gives an empty result.
    """
    rows, first, n = numbered(docs, id_col, text_col)
    perm = Permutation(n, seed)

    @F.pandas_udf("row_number long, place long")
    def placed(at: pd.Series) -> pd.DataFrame:
        at = at.to_numpy(np.int64)
        number = first[at >> AT_BITS] + (at & ((1 << AT_BITS) - 1))
        return pd.DataFrame({"row_number": number, "place": perm.place(number)})
    added = {"row_number": F.col("w.row_number"), "shard": F.pmod("w.place", F.lit(shards)).cast("int"), "slot": F.expr(f"w.place div {shards}")}
    kept = [F.col(f"r.`{c}`").alias(c) for c in docs.columns if c not in added]
    return rows.withColumn("w", placed("at")).select(*kept, *[v.alias(k) for k, v in added.items()])


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of `docs` under `path`, a folder shard=k for each shard, rows of each file in the order of slots.

    Each task holds rows of all shards and writes a file for each, so no shard is gathered in one task.
    """
    rows = sharded(docs, shards, seed, id_col, text_col)
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path, compression=CODEC)


def read_shards(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows of write_shards(like, path), in no order."""
    added = {"row_number": T.LongType(), "slot": T.LongType(), "shard": T.IntegerType()}
    schema = T.StructType([f for f in like.schema if f.name not in added])
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return spark.read.schema(schema).parquet(path)


def digests(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: of the law of keys only), row_number of sharded rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return rows.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "row_number")


def sharding_sql(shards: int = 8, seed: int = 0, rounds: int = 6) -> str:
    """DuckDB SQL for the digests: the network as nested rounds, the walk as a recursive query, the checksum byte by byte."""
    parts = []
    for k in range(8):
        c = 1 << k
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        parts.append(f"{c} * ((xor(a, e) >> {k}) & 1)")
    step = "a >> 8"
    for part in parts:
        step = f"xor({step}, {part})"

    def network(source: str) -> str:
        sql = f"SELECT g, n, h, p >> h AS l, p & ((1::BIGINT << h) - 1) AS r FROM {source}"
        for a, b, c in round_keys(seed, rounds):
            z = f"((r + {a}) % {PRIME})"
            z = f"(({z} * {z} + {b}) % {PRIME})"
            sql = f"SELECT g, n, h, l, r, (({z} * {z} + {c}) % {PRIME}) AS z FROM ({sql})"
            sql = f"SELECT g, n, h, r AS l, xor(l, xor(z, z >> 15) & ((1::BIGINT << h) - 1)) AS r FROM ({sql})"
        return f"SELECT g, n, h, (l << h) | r AS p FROM ({sql})"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, row_number() OVER (ORDER BY doc_id NULLS FIRST, strlen(t), md5(t)) - 1 AS g FROM d),
c AS (SELECT count(*) AS n FROM d),
b AS (SELECT n, greatest(1, (length(bin(greatest(n - 1, 1))) + 1) // 2)::BIGINT AS h FROM c),
s AS (SELECT g, n, h, g AS p FROM o, b),
w AS ({network('s')} UNION ALL {network('(SELECT * FROM w WHERE p >= n)')})
SELECT doc_id, strlen(t) + 1 AS size, 'rows' AS law, CAST(p % {shards} AS INTEGER) AS shard, CAST(p // {shards} AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, g AS row_number,
  CAST(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'),
    lambda e: ('0x' || e)::BIGINT)), lambda a, e: {step})) AS BIGINT) AS text_crc32
FROM o JOIN w USING (g) WHERE p < n"""
