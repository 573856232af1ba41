"""What the operators of this subpackage share: durable intermediate tables, size-checked broadcasts and word hashes."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many rows (each of a few hundred bytes at most) may be broadcast; beyond it the plan shuffles.
BROADCAST_ROWS = 200_000
#: The word of every contract: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where a local session leaves it unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = getattr(spark, "_cairn_shared", None) or tempfile.mkdtemp(prefix="cairn-")
        spark._cairn_shared = at
    return f"{at.rstrip('/')}/cairn-{spark.sparkContext.applicationId}"


#: Rows of a file of an intermediate table whose size is known beforehand.
ROWS_A_FILE = 100_000


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and rereads it: lineage ends there, and any executor can be lost afterwards.

    rows: the most that df can have, where that is known. Its last step then runs in as many tasks as that needs, though at least
    in one for each core, so that a small table is not written as a tiny file for each partition of a shuffle.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE), 1))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder; for its end, when no table of it is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df, which should be durable, has at most so many rows; counts no further."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its checked size allows that, else as it is."""
    return F.broadcast(df) if small(df, rows) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """A name for each of wanted that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def letter_class() -> str:
    """A class of regular expressions that takes what str.isalpha() does: \\w without digits, the underscore, and numbers like ½ and ²."""
    numbers = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
    return rf"[^\W\d_{re.escape(numbers)}]"


_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n-1 modulo 2**64; kept, and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * HASH_BLOCK:  # those for a word longer than a block are not kept
            _powers[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit with probability near one half."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Bytes of a text that are hashed at a time, but for a longer word.
HASH_BLOCK = 1 << 20


def word_hashes(data: bytes, gap: np.ndarray = _SPACE, block: int = HASH_BLOCK) -> np.ndarray:
    """A 64-bit hash of each word in UTF-8 bytes, in order. gap: which byte values separate words.

    A longer text is hashed block by block, each of which ends at a gap, so that what is held besides the hashes is bounded.
    """
    b, out, start = np.frombuffer(data, np.uint8), [], 0
    while start < len(b):
        end = min(start + block, len(b))
        while end < len(b) and not gap[b[end]]:
            ends = np.flatnonzero(gap[b[end : end + 4096]])
            end = min(end + (int(ends[0]) if len(ends) else 4096), len(b))
        out.append(_hash_block(b[start:end], gap))
        start = end
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint64)


def _hash_block(b: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """The polynomial hash of every word comes from one running sum, so no Python loop runs per word."""
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~gap[b]
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_ODD, len(b)), out=total[1:])
    own = (total[end] - total[start]) * _power(_INV, len(b))[start]
    return mix64(own + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of the whole sequence; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = mix64(h * np.uint64(0x9DDFEA08EB382D69) + words[j : n - k + 1 + j])
    return np.unique(h)
