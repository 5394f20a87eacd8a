"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: Share of all rows, and least number, from which a key's rows are joined without a shuffle: 1 / HOT_SHARE keys at most.
HOT_SHARE, HOT_LEAST = 1 / 64, 10_000


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str, salts: int = SALTS) -> DataFrame:
    """Inner join of ``many`` with ``one`` on ``key``, where ``one`` has a row a key. A key's rows in ``many`` are dealt to
    ``salts`` tasks by a hash of ``spread``, so that a key with a third of all rows is no single task; ``one``, which must
    be the smaller by far in bytes, is copied as often. Null keys match nothing."""
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copied = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def counted_join(many: DataFrame, one: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``many`` with ``one`` on ``key``, where ``one`` has a row a key and in ``size`` the number of the key's
    rows in ``many``, which has ``total``. The rows of ``one`` with the largest keys, 64 at most, are broadcast; only the
    rest of ``many`` is shuffled. Null keys match nothing."""
    is_hot = F.col(size) > max(HOT_LEAST, int(total * HOT_SHARE))
    kept = [c for c in one.columns if c not in (key, size)]
    hot = F.broadcast(one.where(is_hot).select(key, F.struct(*kept).alias("_one")))
    marked = many.join(hot, key, "left")
    plain = marked.where("_one IS NULL").drop("_one").join(one.where(~is_hot).drop(size), key)
    return plain.union(marked.where("_one IS NOT NULL").select(*many.columns, "_one.*").select(*plain.columns))
