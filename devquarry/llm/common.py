"""What the corpus operators share: the shared folder, cut lineage, byte-level tokenising and hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multipliers of the 64-bit finaliser and of the rolling hashes; all odd.
MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
STEP = np.uint64(0x9E3779B97F4A7C13)


#: Bytes of an Arrow batch between the JVM and a Python worker, and of a row group that is written while texts pass.
BATCH_BYTES, GROUP_BYTES = 4 << 20, 16 << 20


def give_back() -> None:
    """From now on this process returns freed arrays of 16 MB or more, and what is free above 32 MB, at once, so that a reused worker keeps no peak of an earlier stage."""
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):  # glibc
        libc.mallopt(-3, 1 << 24)  # M_MMAP_THRESHOLD, which otherwise grows to 32 MB
        libc.mallopt(-1, 1 << 25)  # M_TRIM_THRESHOLD


give_back()


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as rows may be long; a smaller bound of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(64 << 20)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a local session gets a temporary folder; a cluster gets an error,
    as no folder of one machine could be read by the others.
    """
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="devquarry-"))
        top = context.getCheckpointDir()
    return f"{top.rstrip('/')}/devquarry-{uuid.uuid4().hex}"


def cut(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written below ``folder`` and read back: lineage ends here, and a lost executor costs nothing written."""
    df.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage, upon which Spark removes the shuffle files of plans that are done with."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table that ``cut`` wrote, through Hadoop's file system, so that any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Keys that have more than one of HEAVY rows are fewer than HEAVY; they are told to all tasks.
HEAVY = 1000


def told_by_key(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the facts of their key (one row a key, which must be there; ``size`` is its number of rows of ``total``).

    The facts of frequent keys, HEAVY at most, are broadcast and their rows dealt by all their columns, so that no
    key gathers in a task; the others meet by key.
    """
    others = [c for c in facts.columns if c != key]
    of = facts.select(F.col(key), F.col(size).alias("own_size"), F.struct(*others).alias("facts"))
    heavy = F.broadcast(of.filter(F.col("own_size") > total // HEAVY).select(key, F.col("facts").alias("told")))
    light = of.filter(F.col("own_size") <= total // HEAVY).select(F.col(key).alias("met"), "facts")
    marked = rows.join(heavy, key, "left").withColumn("met", F.when(F.col("told").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns)))
    found = marked.join(light, "met", "left").withColumn("told", F.coalesce("told", "facts"))
    return found.select(*rows.columns, *[F.col(f"told.{c}").alias(c) for c in others])


def version(text):
    """Tells apart the rows of one id: a 64-bit hash of the text, null as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fold_remainder(doc_id, modulus: int):
    """crc32 of the id as decimal text, modulo ``modulus``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser: a bijection whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_A
    x ^= x >> np.uint64(33)
    x *= MIX_B
    x ^= x >> np.uint64(33)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def byte_table(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte, zero for the six separators, so that they add nothing to a word."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * STEP + np.uint64(seed))
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


class Bytes:
    """The texts of an Arrow column as one byte array with offsets; nulls are empty."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
        ends = ends[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        self.data, self.at = data[ends[0] : ends[-1]], ends - ends[0]
        if lower:
            data = self.data.copy()
            data[(data >= 65) & (data <= 90)] += 32
            self.data = data

    def words(self) -> None:
        """Sets ``starts`` and ``ends`` of all words and ``first``, the index of each text's first word."""
        data, at = self.data, self.at
        if not len(data):
            self.starts = self.ends = np.empty(0, np.int64)
            self.first = np.zeros(len(at), np.int64)
            return
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edges = at[(at > 0) & (at < len(data))]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        begin[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, at)

    def word_hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        lengths = self.ends - self.starts
        head = int(self.starts[0])
        gaps = np.diff(np.append(self.starts, len(self.data)))
        place = np.arange(head, len(self.data), dtype=np.int64) - np.repeat(self.starts, gaps)
        value = byte_table(seed)[self.data[head:]]
        longest = int(gaps.max())
        value *= powers(STEP, longest)[place]
        # a text's leading separators follow the word before and count as zero, like the trailing ones
        return mix(np.add.reduceat(value, self.starts - head) + lengths.astype(np.uint64) * MIX_B)


def as_long(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark longs, bit by bit."""
    return pa.array(x.view(np.int64))


def joined(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join([data[a:b] for a, b in zip(starts.tolist(), ends.tolist())])


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 18):
    """Consecutive rows of a batch, each slice of about ``most`` bytes in ``column`` at most, or of one longer row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)
