"""Blocked Bloom filters as small broadcast tables, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Saved

_WORDS, _WORD_BITS = range(8), 64
#: Bits a block; bits spent on a key while MAX_BLOCKS allow it; most rows of a filter (about 80 bytes each when broadcast).
BLOCK_BITS, BITS_PER_KEY, MAX_BLOCKS = len(_WORDS) * _WORD_BITS, 12, 1 << 18


def blocks_for(keys: int, bits_per_key: int = BITS_PER_KEY, max_blocks: int = MAX_BLOCKS) -> int:
    """Blocks of a filter of so many keys: with more than max_blocks can hold, more keys pass that aren't in it, none is lost."""
    return max(1, min(max_blocks, -(-keys * bits_per_key // BLOCK_BITS)))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    """The one bit that `key` sets in word `word` of its block."""
    shift = F.shiftrightunsigned(F.xxhash64(F.lit("bits"), key), 6 * word).bitwiseAND(F.lit(_WORD_BITS - 1)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), shift)


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7): each key of column `key` sets one bit in each of the eight words of its block.

    At most `blocks` rows of 68 bytes, whatever the number of keys.
    """
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*(F.bit_or(_bit(F.col("key"), w)).alias(f"w{w}") for w in _WORDS))


def marked(df: DataFrame, key: Column, filter_blocks: DataFrame, blocks: int, name: str) -> DataFrame:
    """`df` plus boolean `name`: whether `key` may be in the filter. The filter is broadcast: `blocks` bounds its size."""
    probed = df.withColumn("_block", _block(key, blocks)).join(F.broadcast(filter_blocks.withColumnRenamed("block", "_block")), "_block", "left")
    passed = F.lit(True)
    for w in _WORDS:
        passed = passed & (F.col(f"w{w}").bitwiseAND(_bit(key, w)) != 0)
    return probed.withColumn(name, F.coalesce(passed, F.lit(False))).drop("_block", *(f"w{w}" for w in _WORDS))


def may_contain(keys: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """The rows of `keys` whose column `key` may be in the filter."""
    return marked(keys, F.col("key"), filter_blocks, blocks, "_passed").filter("_passed").drop("_passed")


class Bloom:
    """The filter of column `key` of a written table, written itself, so that it's built once."""

    def __init__(self, keys: DataFrame):
        self.blocks = blocks_for(keys.count())
        self.saved = Saved(bloom_blocks(keys, self.blocks), "bloom")

    def mark(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """`df` plus boolean `name`: whether `key` may be in the filter."""
        return marked(df, key, self.saved.df, self.blocks, name)

    def drop(self) -> None:
        self.saved.drop()
