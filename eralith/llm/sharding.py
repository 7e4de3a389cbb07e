"""Sharding by weighted rendezvous hashing of record keys.

Every shard draws a number for a key, and the key goes to the shard whose draw, scaled by its weight, is greatest. A shard
that is added takes just the keys for which its own draw wins, in proportion to its weight; no key moves between others, and
a shard whose weight changes exchanges keys with others only as far as its share changes. The shard depends on the key and
the weights alone: neither on other rows nor on how a table is stored.

A shard's rows stand in the order of a hash of their content. Slots are counted in ranges of that hash of about
``PER_RANGE`` rows, whose first slots come from a running sum over the ranges' counts, so no task sees a whole shard. Rows
alike in all that is returned are one row with a count until the end: a key with a third of all rows is no hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eralith.llm._spark import written

#: Rows that one range of hashes holds on average, and copies of one row that one row is expanded to at once.
PER_RANGE, PER_CHUNK = 100_000, 10_000


def draw(key: Column, shard: Column) -> Column:
    """A number between 0 and 1 that shard and key decide (52 bits of an MD5)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", shard.cast("string"), key)), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def _scores(key: Column, weights: Sequence[float]) -> Column:
    """array<struct<score, last>>, by shard: the greatest struct names the winner; of equal scores the smaller shard's is."""
    shards = F.array(*(F.struct(F.lit(float(w)).alias("weight"), F.lit(i).alias("shard")) for i, w in enumerate(weights)))
    return F.transform(shards, lambda x: F.struct((-x["weight"] / F.log(draw(key, x["shard"]))).alias("score"), (-x["shard"]).alias("last")))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key (a string). Costs one MD5 a shard and key."""
    if not weights or min(weights) <= 0:
        raise ValueError("there must be a shard, and every weight must be above 0")
    return -F.array_max(_scores(key, weights))["last"]


def shard_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * 8, grown_weight: float = 1.0
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row per row of docs that has an id.

    size: UTF-8 bytes of the text and 1; a null text is an empty one. slot: places within a shard, from 0 and without gaps, in
    the order of MD5(id:crc), then id and size. grown_shard: the shard if one of grown_weight were added. Rows that
    repeat have the same shard and a slot each; a row without an id is left out. law names the rule that holds: key.
    """
    if not weights or min(*weights, grown_weight) <= 0:
        raise ValueError("there must be a shard, and every weight must be above 0")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    alike = ["doc_id", "size", "text_crc32"]
    key, n = F.col("doc_id").cast("string"), len(weights)
    each = d.where("doc_id is not null").groupBy(*alike).agg(F.count("*").alias("n"))
    each = each.withColumns({"scores": _scores(key, [*weights, grown_weight]), "by": F.unhex(F.md5(F.concat_ws(":", key, F.col("text_crc32").cast("string"))))})
    best = F.array_max(F.slice("scores", 1, n))
    each = written(each.select(*alike, "n", "by", (-best["last"]).alias("shard"), (-F.array_max("scores")["last"]).alias("grown_shard")))

    rows, most = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    bits = min(31, max(0, (rows // PER_RANGE).bit_length()))
    in_range = F.shiftright(F.conv(F.hex(F.substring("by", 1, 4)), 16, 10).cast("long"), 32 - bits)
    each = each.withColumn("range", in_range.cast("int"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = each.groupBy("shard", "range").agg(F.sum("n").alias("m")).withColumn("first", before(Window.partitionBy("shard").orderBy("range"), "m"))
    # the first window keeps its distribution by shard and range, so only the few ranges are sent to it
    placed = each.withColumn("at", before(Window.partitionBy("shard", "range").orderBy("by", *alike), "n")).join(first.select("shard", "range", "first"), ["shard", "range"])
    placed = placed.select(*alike, "shard", "grown_shard", (F.col("first") + F.col("at")).alias("from"), "n")

    def slots(df: DataFrame) -> DataFrame:
        return df.select(*alike, F.lit("key").alias("law"), "shard", F.explode(F.expr("sequence(from, from + n - 1)")).alias("slot"), "grown_shard")

    if most <= PER_CHUNK:
        return slots(placed)
    # rows that stand very often are dealt out in chunks
    chunk = F.explode(F.expr(f"sequence(0, (n - 1) div {PER_CHUNK})")).alias("chunk")
    many = placed.where(F.col("n") > PER_CHUNK).select("*", chunk).repartition("doc_id", "text_crc32", "chunk")
    many = many.withColumns({"from": F.expr(f"from + chunk * {PER_CHUNK}"), "n": F.expr(f"least({PER_CHUNK}, n - chunk * {PER_CHUNK})")})
    return slots(placed.where(F.col("n") <= PER_CHUNK)).unionByName(slots(many))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", weights: Sequence[float] = (1.0,) * 8, rows_per_file: int = PER_RANGE) -> str:
    """Writes whole rows as Parquet, one folder a shard and files of about rows_per_file rows; returns the shard column's name.

    All columns stay as they are; the shard column is called shard, with underscores before it where docs has one of that
    name. A file takes rows by their place in the input, not by key, so repeated ids fill no file. Rows without an id are left out.
    """
    names = {c.lower() for c in docs.columns}
    free = lambda name: next(c for c in ("_" * i + name for i in range(len(names) + 1)) if c not in names)
    shard, part = free("shard"), free("part")
    d = docs.where(F.col(id_col).isNotNull())
    parts = max(1, round(d.count() * max(weights) / sum(weights) / rows_per_file))
    d = d.withColumns({shard: rendezvous(F.col(id_col).cast("long").cast("string"), weights), part: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))})
    d.repartition(parts * len(weights), shard, part).drop(part).write.mode("overwrite").partitionBy(shard).parquet(path)
    return shard


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of documents, alike in weight."""
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
