"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only.

Sources get word targets from their weights, no more than ``most_copies`` times what they hold
(the excess is shared again by weight). Blocks of equal size are apportioned to sources by highest
quotients target / (2 j - 1), and each source's blocks to its shards likewise. A shard's documents
lie end to end in an order given by the seed; it gives whole passes and then a run of blocks that
starts at a block drawn by the seed and wraps around.

Apportionment doesn't list all blocks: with m parties and B seats, the seats at divisor
(1 +- m / 2B) bound it, and only the at most 2 m seats between the bounds compete by quotient.

Null texts have size 0, a null source is a source of its own, sorted last. Rows with equal ids
are documents of their own. Sources without words get nothing. Columns not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilcount.llm._shared import WORD, materialize, table, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
SEED = 17
#: Words that a shard holds about, and the largest block.
SHARD_WORDS = 4_000_000
BLOCK_WORDS = 1024
#: Blocks that the smallest target is cut into at least, where it has so many words.
LEAST_BLOCKS = 2000


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size and text_key, a hash of the text."""
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        count_words(text).alias("size"),
        F.xxhash64(text).alias("text_key"),
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most_copies: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target: one row a source, by water-filling over capacity / weight."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("position") - 1, F.lit(len(weights))) + 1).cast("int"))
    held = totals.withColumn("position", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most_copies)).withColumn("wanted", F.sum("source_size").over(everything) * float(share))
    # Sources fill up in the order of most / weight; the level is where the rest share what is left.
    filling = Window.orderBy((F.col("most") / F.col("weight")), "position")
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    held = held.withColumn("level", (F.col("wanted") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    is_open = F.col("level") <= F.col("most") / F.col("weight")
    held = held.withColumn("water", F.min(F.when(is_open, F.struct(F.col("most") / F.col("weight"), F.col("position"), F.col("level")))).over(everything)["level"])
    return held.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("water") * F.col("weight"), F.col("most"))).alias("target"))


def apportion(parties: DataFrame, group: list[str], key: list[str], claim: str, seats: str) -> DataFrame:
    """Sainte-Lague within each group: adds `quota` to parties, from the group's seats and each party's claim.

    Ties go to the larger claim, then to the lower key. The group's quotas sum to its seats where
    any claim is positive.
    """
    whole = Window.partitionBy(*group)
    exact = F.when(F.col("_all") > 0, F.col(claim) / F.col("_all") * F.col(seats)).otherwise(F.lit(0.0))
    slack = F.col("_n") / (2 * F.greatest(F.col(seats), F.lit(1)))
    # Half a millionth of a seat of slack on either side covers rounding.
    sized = parties.withColumn("_all", F.sum(claim).over(whole)).withColumn("_n", F.sum(F.when(F.col(claim) > 0, 1).otherwise(0)).over(whole)).withColumn("_exact", exact)
    sized = sized.withColumn("_low", F.greatest(F.floor(F.col("_exact") * F.greatest(1 - slack, F.lit(0.0)) + 0.5 - 5e-7), F.lit(0)).cast("long")).withColumn("_high", F.when(F.col("_exact") > 0, F.floor(F.col("_exact") * (1 + slack) + 0.5 + 5e-7)).otherwise(F.lit(0)).cast("long"))
    sized = sized.withColumn("_open", F.col(seats) - F.sum("_low").over(whole))
    contest = sized.where(F.col("_high") > F.col("_low")).select(*group, *key, claim, "_open", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_seat"))
    order = Window.partitionBy(*group).orderBy((F.col(claim) / (2 * F.col("_seat") - 1)).desc(), F.col(claim).desc(), *[F.col(k).asc_nulls_last() for k in key])
    won = contest.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= F.col("_open")).groupBy(*group, *key).agg(F.count("*").alias("_won"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}")) for c in dict.fromkeys(group + key)]
    joined = sized.alias("p").join(won.alias("w"), _all(same), "left")
    return joined.select(*[f"p.{c}" for c in parties.columns], (F.col("p._low") + F.coalesce(F.col("w._won"), F.lit(0))).alias("quota"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most_copies: int = MOST_COPIES, seed: int = SEED, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, block (the source's block size), source and text_key, one row each."""
    sizes = materialize(sized(docs, id_col, text_col, source_col), "sizes")
    targets = source_targets(sizes, weights, share, most_copies)
    everything = Window.partitionBy()
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    block = F.greatest(F.least(F.floor(least / LEAST_BLOCKS), F.lit(block_words)), F.lit(1)).cast("long")
    sources = targets.withColumn("block", F.coalesce(block, F.lit(block_words))).withColumn("seats", F.round(F.sum("target").over(everything) / F.col("block")).cast("long")).withColumn("world", F.lit(0))
    sources = apportion(sources, ["world"], ["source"], "target", "seats").withColumn("shards", F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / shard_words)).select("source", "source_size", "target", "block", "shards", F.col("quota").alias("source_seats"))
    # Written, as three joins read it: a row a source.
    sources = materialize(sources, "sources")

    place = F.xxhash64(F.lit(seed), "doc_id", "size", "text_key")
    held = sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.doc_id", "d.size", "d.text_key", "s.*")
    # A mix takes nothing of documents without words, so they lie in no shard: any number of them stays where it is.
    wordless = held.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    dealt = held.where("size > 0").withColumn("place", place).withColumn("shard", F.pmod(F.col("place"), F.col("shards")))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_seats").alias("source_seats"), F.first("block").alias("block"))
    shards = apportion(shards, ["source"], ["shard"], "shard_size", "source_seats")
    blocks = F.greatest(F.ceil(F.col("shard_size") / F.col("block")), F.lit(1))
    seats = F.least(F.col("quota"), most_copies * blocks)
    shards = shards.withColumn("blocks", blocks).withColumn("passes", F.floor(seats / blocks)).withColumn("run", seats % blocks).withColumn("first", F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.col("blocks")))
    edge = lambda b: F.floor(b * F.col("shard_size") / F.col("blocks"))  # noqa: E731  where block b of a shard begins
    shards = shards.select(F.col("source").alias("shard_source"), F.col("shard").alias("shard_no"), "shard_size", "passes", edge(F.col("first")).alias("from"), edge(F.least(F.col("first") + F.col("run"), F.col("blocks"))).alias("to"), edge(F.greatest(F.col("first") + F.col("run") - F.col("blocks"), F.lit(0))).alias("wrapped"))

    lying = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.withColumn("end", F.sum("size").over(lying))
    laid = laid.join(shards, F.col("source").eqNullSafe(F.col("shard_source")) & (F.col("shard") == F.col("shard_no")))
    start = F.col("end") - F.col("size")
    overlap = lambda lo, hi: F.greatest(F.least(F.col("end"), hi) - F.greatest(start, lo), F.lit(0))
    taken = F.col("passes") * F.col("size") + overlap(F.col("from"), F.col("to")) + overlap(F.lit(0), F.col("wrapped"))
    columns = ["doc_id", "size", "source_size", "target", "taken", "block", "source", "text_key"]
    return laid.withColumn("taken", taken.cast("long")).select(columns).unionByName(wordless.select(columns))


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The documents, each as often as the mix takes it (rounded), with all their columns.

    A run of blocks cuts two documents a shard at most, so rounding hardly moves a source's total.
    Documents without words stay once. Rows that repeat id, source and text share what the mix takes of them.
    """
    keys = ["doc_id", "source", "text_key"]
    taken = mix(docs, id_col, text_col, source_col, **options)
    times = F.when(F.sum("size") > 0, F.round(F.sum("taken") / F.sum("size"))).otherwise(1).cast("int")
    taken = taken.groupBy(*keys).agg(times.alias("times")).where("times > 0")
    row = docs.select(F.struct(*docs.columns).alias("_row"))
    text, source = text_of(F.col(f"_row.{text_col}")), F.col(f"_row.{source_col}").cast("string")
    same = F.col(f"_row.{id_col}").eqNullSafe(F.col("doc_id")) & source.eqNullSafe(F.col("source"))
    # The hint makes small and large corpora join alike: the ids grow with the corpus.
    met = row.join(taken.hint("merge"), same & (F.xxhash64(text) == F.col("text_key")))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("times")))
    return met.select("_row", copies.alias("_copy")).select("_row.*")


def op3_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("source", "text_key")
