"""Placement of documents on shards through a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size, (offset + k * skip) mod size. The
shards take turns; at its turn a shard claims its next slot that is still free, until none is left. A document's key
hashes to a slot, and the table, a few tens of thousands of rows whatever the data, is broadcast: one lookup a
document, no shuffle. Slots are shared out evenly (counts differ by one at most), and taking a shard away moves few
documents that were not on it.

Null keys are placed as the empty text. Equal keys go to one shard, so a hot key stays whole. Repeated rows are placed
each. Other columns are kept; columns with the names of the result (`slot`, `shard`) are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> np.ndarray:
    """slot -> index of the shard that claimed it."""
    if not is_prime(size) or not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("a table needs a prime size, and one to that many different shards")
    start, skip = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        start.append(int.from_bytes(digest[:8], "big") % size)
        skip.append(int.from_bytes(digest[8:16], "big") % (size - 1) + 1)
    owner = np.full(size, -1, np.int32)
    wish, free = list(start), size
    while free:
        for s in range(len(shards)):
            while owner[wish[s]] >= 0:
                wish[s] = (wish[s] + skip[s]) % size
            owner[wish[s]] = s
            free -= 1
            if not free:
                break
    return owner


def place(docs: DataFrame, shards: Sequence[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """`docs` with `slot` (long) and `shard` (the shard's name)."""
    owner = lookup_table(shards, size)
    spark = docs.sparkSession
    rows = spark.createDataFrame([(k, shards[s]) for k, s in enumerate(owner.tolist())], "slot long, shard string")
    spread = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), F.lit(size))
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("slot", "shard")], spread.alias("slot"))
    columns = [F.col(f"`{c}`") for c in [*kept.columns, "shard"]]
    return kept.join(F.broadcast(rows), "slot").select(*columns)
