"""Mixing sources to target weights.

Each source's words are packed into blocks of a fixed number of words. The mixture is a sequence of
output shards of a fixed number of slots; every shard draws how many of its slots go to each source
(the whole part of the expectation, the rest multinomial). The slots of a source, counted through
all shards, go through pseudorandom permutations of the source's block indices, one for each pass
over the source, and slots and blocks are joined by index. Nothing depends on task placement, so
reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from orderlens.llm.store import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block of the mixture.
BLOCK_WORDS = 128
#: Slots in an output shard.
SHARD_SLOTS = 16384
#: Words in a lane, the unit in which documents are lined up; a window never holds more rows than a
#: lane has documents, or than a group of lanes has lanes.
LANE_WORDS = 1 << 20
LANE_GROUP = 4096
#: A mixture has a weight for each source; their table is broadcast and its weights sent to the driver.
MOST_SOURCES = 100_000
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` in ``order`` (0, 1, ... without repeats) for each key, in
    two levels, so no task sees more than LANE_GROUP rows of a key, or one row for each such group."""
    df = df.withColumn("_group", F.floor(F.col(order) / LANE_GROUP).cast("long"))
    inner = Window.partitionBy(*keys, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = (df.groupBy(*keys, "_group").agg(F.sum(value).alias("_sum"))
              .withColumn("_base", F.coalesce(F.sum("_sum").over(outer), F.lit(0))).drop("_sum"))
    same = F.lit(True)
    for k in (*keys, "_group"):
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"g.{k}"))
    return (df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0))).alias("d")
            .join(groups.alias("g"), same)
            .select("d.*", (F.col("d._in") + F.col("g._base")).alias(out)).drop("_in", "_group"))


def source_targets(sizes: DataFrame, weights: Sequence[float], total: float, most: float) -> DataFrame:
    """Adds ``target`` to (source, source_size): ``total`` times all sizes, shared by the weights,
    which repeat over the sources in code point order (null last); no target exceeds ``most`` times
    its source's size, and what exceeds it is reshared by weight.

    A source is capped exactly when its cap divided by its weight is below the level at which the
    rest share what the capped ones leave, which one running sum over the sources ordered by that
    quotient finds: a row for each source, however many documents it has. (Past the first source that
    is not capped, that level only falls, so the largest one is the share.)
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    ordered = Window.orderBy("_level", F.col("source").asc_nulls_last())
    through = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return (sizes.withColumn("_rank", F.row_number().over(by_name)).withColumn("weight", weight)
            .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
            .withColumn("_level", F.col("_cap") / F.col("weight"))
            .withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(total)))
            .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)))
            .withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
            .withColumn("_capped", F.col("_level") * F.col("_weights") <= F.col("_left"))
            .withColumn("_share", F.max(F.when(~F.col("_capped"), F.col("_left") / F.col("_weights"))).over(everything))
            .withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("weight") * F.col("_share")))
            .select("source", "source_size", "weight", "target"))


def _feistel(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutations of range(n), elementwise: a four-round Feistel network on the next
    even number of bits, walked until the value lies below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.astype(np.uint64), np.ones(len(i), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = out[todo] >> half[todo], out[todo] & mask[todo]
            for r in range(4):
                f = (right + key[todo] + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
                left, right = right, left ^ ((f >> np.uint64(32)) & mask[todo])
            out[todo] = (left << half[todo]) | right
            todo = todo & (out >= n.astype(np.uint64))
    return out.astype(np.int64)


def pack_blocks(docs: DataFrame, scratch: Scratch, block_words: int) -> tuple[DataFrame, DataFrame]:
    """(source, block, row, start, n_words) pieces of the fixed-length blocks, and (source, blocks).

    ``docs`` needs row, source and n_words. A source's documents are dealt over lanes of about
    LANE_WORDS words by a hash of the row; inside a lane they follow each other without gaps, and only
    the last block of a lane may be short. Block numbers run through the lanes of a source.
    """
    sizes = docs.groupBy("source").agg(F.sum("n_words").alias("words"))
    lanes = sizes.select(F.col("source").alias("_s"), F.ceil(F.col("words") / LANE_WORDS).cast("long").alias("_lanes"))
    dealt = (docs.where("n_words > 0").join(F.broadcast(lanes), F.col("source").eqNullSafe(F.col("_s")))
             .withColumn("lane", F.pmod(F.xxhash64("row"), F.col("_lanes"))))
    w = Window.partitionBy("source", "lane").orderBy("row")
    placed = scratch.write(dealt.withColumn("at", F.sum("n_words").over(w) - F.col("n_words")).select("source", "lane", "row", "n_words", "at"), "placed")
    lane_blocks = placed.groupBy("source", "lane").agg(F.ceil(F.sum("n_words") / block_words).cast("long").alias("blocks"))
    based = scratch.write(prefix_sums(lane_blocks, ["source"], "lane", "blocks", "base"), "lanes")
    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("n_words") - 1) / block_words)
    b = based.select(F.col("source").alias("_s"), F.col("lane").alias("_l"), "base")
    pieces = (placed.join(b, F.col("source").eqNullSafe(F.col("_s")) & (F.col("lane") == F.col("_l")))
              .withColumn("_b", F.explode(F.sequence(first, last)))
              .withColumn("start", F.greatest(F.lit(0), F.col("_b") * block_words - F.col("at")))
              .withColumn("stop", F.least(F.col("n_words"), (F.col("_b") + 1) * block_words - F.col("at")))
              .select("source", (F.col("base") + F.col("_b")).alias("block"), "row", "start", (F.col("stop") - F.col("start")).alias("n_words")))
    return pieces, based.groupBy("source").agg(F.sum("blocks").alias("blocks"))


def draw_slots(targets: DataFrame, shard_slots: int, seed: int, scratch: Scratch) -> DataFrame:
    """(shard, slot, source, block): the block that each slot of the mixture holds.

    ``targets`` has a row for each source with its blocks and ``slots``, the expected number of its
    slots; both it and a shard's counts are bounded by the number of sources.
    """
    wanted = scratch.write(targets.select("source", "blocks", "slots").where("slots > 0")
                           .withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1), "wanted")
    rows = sorted(wanted.collect(), key=lambda r: r.k)  # one row for each source
    expected = np.array([r.slots for r in rows], float)
    shards = int(np.ceil(expected.sum() / shard_slots)) if len(rows) else 0
    spark = targets.sparkSession

    def counts(parts):
        for part in parts:
            out = []
            for shard in part["id"]:
                size = min(1.0, expected.sum() / shard_slots - shard) * shard_slots
                mean = expected / expected.sum() * size
                whole = np.floor(mean + 1e-9).astype(np.int64)
                rest = np.clip(mean - whole, 0, None)
                left = int(round(rest.sum()))
                more = np.random.Generator(np.random.PCG64([seed, int(shard)])).multinomial(left, rest / rest.sum()) if left and rest.sum() > 0 else 0
                out.append(pd.DataFrame({"shard": np.full(len(mean), shard, np.int64), "k": np.arange(len(mean)), "n": whole + more}))
            yield pd.concat(out) if out else pd.DataFrame({"shard": [], "k": [], "n": []})

    drawn = scratch.write(spark.range(shards).mapInPandas(counts, "shard long, k long, n long"), "drawn")
    runs = prefix_sums(drawn, ["k"], "shard", "n", "before")
    # a source's slots are spread evenly over the shard
    slots = (runs.where("n > 0").join(F.broadcast(wanted), "k")
             .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
             .withColumn("draw", F.col("before") + F.col("j"))
             .withColumn("turn", (F.col("j") + 0.5) / F.col("n")))

    def permute(parts):
        for p in parts:
            n, draw = p["blocks"].to_numpy(np.int64), p["draw"].to_numpy(np.int64)
            with np.errstate(over="ignore"):
                key = (p["k"].to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (draw // n).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))
            p["block"] = _feistel(draw % n, n, key)
            yield p[["shard", "turn", "source", "draw", "block"]]

    kind = targets.schema["source"].dataType.simpleString()
    return slots.select("shard", "k", "turn", "source", "blocks", "draw").mapInPandas(permute, f"shard long, turn double, source {kind}, draw long, block long")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total: float = 1.5, most: float = 2.0,
                block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED,
                scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mixture of ``docs`` (doc_id, text, source; other columns are ignored).

    Returns
      rows: row, doc_id, source, size, source_size, target for each row of docs;
      slots: shard, turn, source, draw, block: the mixture's order is shard, turn;
      pieces: source, block, row, start, n_words: the words that a block holds.

    A null text has size 0, a null source is a source of its own, rows without words are in no block,
    repeated rows (ids, texts) count separately, a text of any length is cut over blocks, and with no
    rows or no words there are no slots. A block is drawn at most ``most`` times, rounded down, so no
    word is.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("n_words"), F.xxhash64("text").alias("_t"))
    # equal rows are told apart by their number among equals
    copies = sized.groupBy("doc_id", "source", "_t", "n_words").agg(F.count("*").alias("_c"))
    sized = copies.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))))
    sized = scratch.write(sized.select(F.struct("doc_id", "source", "_t", "_i").alias("row"), "doc_id", "source", "n_words"), "sized")
    sizes = sized.groupBy("source").agg(F.sum("n_words").alias("source_size"))
    targets = scratch.write(source_targets(sizes, weights, total, most), "targets")
    if (n := targets.count()) > MOST_SOURCES:
        raise ValueError(f"{n} sources; a mixture takes {MOST_SOURCES} at most")
    pieces, blocks = pack_blocks(sized, scratch, block_words)
    t, b = targets.alias("t"), blocks.alias("b")
    # mean words of a block: source_size / blocks, so short last blocks leave the target unbiased
    wanted = (t.join(b, F.col("t.source").eqNullSafe(F.col("b.source")))
              .select("t.source", "b.blocks", (F.col("b.blocks") * F.col("t.target") / F.col("t.source_size")).alias("slots")))
    slots = draw_slots(wanted, shard_slots, seed, scratch)
    counts = wanted.select(F.col("source").alias("_s"), F.col("blocks").alias("_n"))
    slots = (slots.join(F.broadcast(counts), F.col("source").eqNullSafe(F.col("_s")))
             .where(F.floor(F.col("draw") / F.col("_n")) < int(most)).drop("_s", "_n"))
    tt = targets.select(F.col("source").alias("_s"), "source_size", "target")
    rows = sized.join(F.broadcast(tt), F.col("source").eqNullSafe(F.col("_s"))).select("row", "doc_id", "source", F.col("n_words").alias("size"), "source_size", "target")
    return rows, slots, pieces


def words_taken(rows: DataFrame, slots: DataFrame, pieces: DataFrame) -> DataFrame:
    """``rows`` with ``taken``: the words of the row in the mixture, repeats counted."""
    drawn = slots.groupBy("source", "block").agg(F.count("*").alias("times"))
    p, d = pieces.alias("p"), drawn.alias("d")
    taken = (p.join(d, F.col("p.source").eqNullSafe(F.col("d.source")) & (F.col("p.block") == F.col("d.block")))
             .groupBy("p.row").agg(F.sum(F.col("p.n_words") * F.col("d.times")).alias("_taken")).withColumnRenamed("row", "_row"))
    return (rows.join(taken, F.col("row").eqNullSafe(F.col("_row")), "left")
            .withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("long")).drop("_row", "_taken"))


def block_texts(slots: DataFrame, pieces: DataFrame, docs: DataFrame) -> DataFrame:
    """(shard, turn, source, block, text): the words of every slot, joined by single spaces."""
    texts = (docs.select("doc_id", F.xxhash64("text").alias("_t"), "text").dropDuplicates(["doc_id", "_t"]))
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    cut = (pieces.alias("p").join(texts.alias("t"), F.col("p.row.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("p.row._t") == F.col("t._t")))
           .select("p.source", "p.block", F.col("p.row").alias("row"), F.array_join(F.slice(words, F.col("p.start") + 1, F.col("p.n_words")), " ").alias("part"), "p.start"))
    blocks = (cut.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("row", "start", "part"))).alias("parts"))
              .select(F.col("source").alias("_s"), F.col("block").alias("_b"), F.array_join(F.transform("parts", lambda x: x["part"]), " ").alias("text")))
    return (slots.join(blocks, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
            .select("shard", "turn", "source", "block", "text"))
