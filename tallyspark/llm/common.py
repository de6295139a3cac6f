"""What the corpus operators share: table access, staging, and byte-level words."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the word definition: ASCII letters and digits and every byte from 0x80.
_NOT_WORD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in bytes(range(256)).lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set in local mode (tests)."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.conf.get("tallyspark.shared.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if folder is None:
            folder = tempfile.mkdtemp(prefix="tallyspark-")
            spark.conf.set("tallyspark.shared.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage is cut, lost executors cost nothing.
    ``release`` collects the driver's garbage, on which Spark drops the shuffle files behind what was written."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if release:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def bounded(df: DataFrame, most: int = 2_000_000) -> DataFrame:
    """df (staged, of narrow rows) with a broadcast hint if it has at most ``most`` rows; else joins shuffle it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def text_of(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(""))


def id_mod(col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of [0-9a-z] and non-ASCII characters, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NOT_WORD).split()


def space_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of anything but \\x20 and \\x09-\\x0D, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def partitions_for(df: DataFrame, least: int = 12) -> int:
    """Number of shuffle partitions of the session."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def span_hashes(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[a:b] for arrays of bounds; equal bytes give equal hashes wherever they stand."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power(_BASE, len(buf)), out=sums[1:])
    inv = _power(pow(_BASE, -1, 1 << 64), len(buf) + 1)
    return mix64((sums[b] - sums[a]) * inv[a] + (b - a).astype(np.uint64))


#: Fixed by the word definitions: lower-cased byte, or a space where no word goes on.
SPACE_WORDS = np.frombuffer(bytes(0x20 if b in b" \t\n\v\f\r" else b for b in bytes(range(256)).lower()), np.uint8)
ALNUM_WORDS = np.frombuffer(_NOT_WORD, np.uint8)


def hashed_words(texts: list[bytes], kind: np.ndarray = SPACE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts: hash, and the bounds in the joined buffer; and the first word of each text
    (one more entry than texts)."""
    buf = kind[np.frombuffer(b" ".join(texts), np.uint8)]
    gap = buf == 0x20
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1, append=1))
    a, b = edge[::2], edge[1::2]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return span_hashes(buf, a, b), a, b, np.searchsorted(a, starts)


def batches_of_bytes(texts, most: int = 1 << 19):
    """(first, texts as bytes) of a list or Arrow column in runs of about ``most`` bytes, each text whole."""
    run, size, first = [], 0, 0
    for a in range(0, len(texts), 256):
        part = texts[a : a + 256] if isinstance(texts, list) else texts.slice(a, 256).to_pylist()
        for i, t in enumerate(part, a):
            run.append((t or "").encode("utf-8", "surrogatepass"))
            size += len(run[-1])
            if size >= most:
                yield first, run
                run, size, first = [], 0, i + 1
    if run:
        yield first, run


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; the whole run if there are fewer; nothing without words."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[j : j + n]
    return mix64(out)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the smallest node that links reach.

    Smallest labels of neighbours, then a jump to the label's label, until nothing changes; every round is
    written to the shared folder."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    now = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).withColumn("root", F.least("node", "root")), "roots")
    while True:
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = now.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = now.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = staged(step.join(up, "root").select("node", "old", F.least("root", "above").alias("root")), "roots")
        changed = step.where("old <> root").limit(1).count()
        now = step.select("node", "root")
        if not changed:
            return now
