"""Helpers shared by the training-data operators: scratch tables, memoised lookups, words of a text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (`spark.checkpoint.dir`).

    Only where that setting is missing in local mode, as in tests, a temporary folder of this machine stands in.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        base = _own_folder.setdefault("path", "")
        if not base:
            base = _own_folder["path"] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write `df` to the shared folder and read it back: its lineage ends here, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Memo(dict):
    """A table of `make(key)` in two generations, so that it stays below 2 * `cap` entries and keeps what is in use.

    Values of keys longer than 256 are made each time.
    """

    def __init__(self, make: Callable, cap: int = 150_000):
        super().__init__()
        self.make, self.cap, self.old = make, cap, {}

    def __missing__(self, key):
        if len(key) > 256:
            return self.make(key)
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: A-Z to a-z; 0-9, a-z and all bytes of characters beyond ASCII stay; every other byte becomes a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def word_bytes(text: str | None) -> list[bytes]:
    """Words of a whole text in UTF-8: runs of ASCII letters (lower-cased), digits and characters beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


def bounded_sample(df: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most about `most` rows (a hard limit is twice as many), picked by a hash of `key`: the same on each call."""
    n = df.count()
    step = max(1, -(-n // max(1, most)))
    if step > 1:
        df = df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(step)) == 0)
    return df.limit(2 * most)
