"""Document fingerprints by a threshold-scaled sketch, in DataFrame functions only.

Of all hashes of a text's shingles of five words those below a fixed fraction of the hash range are retained, and the
least one always is, so that no text with words has an empty sketch. Both rules hold for unions as well: the sketch of
two texts together is the union of their sketches cut to the same rule (merge_sketches). Containment, the share of the
smaller sketch that the other has too, stays meaningful between very unequal documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eralith.llm._spark import written

#: One hash in so many is retained.
SCALE = 8
_RANGE = 1 << 60
_PER_RANGE = 100_000


def with_sketch(df: DataFrame, text: str, out: str, shingle: int = 5, scale: int = SCALE) -> DataFrame:
    """df with column out: sorted distinct retained hashes (60 bits) of the word shingles of column text.

    A text of fewer words is one shingle; one without words has an empty sketch. Words and hashes are columns of their
    own on the way, or each shingle would split the text anew.
    """
    w, h, n = F.col(f"{out}_words"), F.col(f"{out}_hashes"), F.size(f"{out}_words")
    hashed = lambda ws: F.shiftrightunsigned(F.xxhash64(ws), 4)
    shingles = F.transform(F.sequence(F.lit(1), n - (shingle - 1)), lambda i: hashed(F.slice(w, i, shingle)))
    df = df.withColumn(f"{out}_words", F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), ""))
    df = df.withColumn(f"{out}_hashes", F.when(n >= shingle, shingles).when(n > 0, F.array(hashed(w))).otherwise(F.array().cast("array<bigint>")))
    kept = F.filter(h, lambda x: x < _RANGE // scale)
    df = df.withColumn(out, F.array_sort(F.array_distinct(F.array_compact(F.array_append(kept, F.array_min(h))))))
    return df.drop(f"{out}_words", f"{out}_hashes")


def merge_sketches(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts together."""
    union = F.array_sort(F.array_union(a, b))
    return F.filter(union, lambda h: (h < _RANGE // scale) | (h == F.element_at(union, 1)))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that is in the other; 1 for two empty ones, 0 for one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))


def to_string(sk: Column) -> Column:
    """Hashes as 15 hexadecimal digits each, one after another."""
    return F.array_join(F.transform(sk, lambda h: F.lpad(F.lower(F.hex(h)), 15, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, sketch) of every row with an id; a null text is empty."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_sketch(d.where("doc_id is not null"), "text", "sketch")


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next): the next lower id, and the highest after the lowest; of distinct ids, without a global sort.

    Ids are dealt into ranges of about ``_PER_RANGE`` ids, whose numbers are written, and looked up within each; a range's
    lowest id looks to the highest of the range below. Only one row a range meets in one task.
    """
    ids = ids.select("doc_id").distinct()
    ranges = ids.count() // _PER_RANGE + 1
    ids = written(ids.repartitionByRange(ranges, "doc_id").withColumn("part", F.spark_partition_id()))
    inside = ids.withColumn("next", F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    tops = ids.groupBy("part").agg(F.max("doc_id").alias("top"))
    tops = tops.select("part", F.coalesce(F.lag("top").over(Window.orderBy("part")), F.max("top").over(Window.partitionBy())).alias("below"))
    return inside.join(tops, "part").select("doc_id", F.coalesce("next", "below").alias("next"))


def op3_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and their likeness to those and to the next document's.

    Where ids repeat, a row looks to one of the next id's texts (the least).
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    follows = next_ids(d.select("doc_id"))
    lengths = d.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    # what a document gives away: to the one before it, as many code points as half of that one's
    takers = follows.join(lengths, "doc_id").select(F.col("doc_id").alias("taker"), F.col("next").alias("doc_id"), F.expr("cast(n div 2 as int)").alias("half"))
    giver = with_sketch(d.join(takers, "doc_id"), "text", "sketch").select("taker", F.struct(F.expr("substring(text, 1, half)").alias("head"), "sketch").alias("given"))
    given = giver.groupBy("taker").agg(F.min("given").alias("given")).select(F.col("taker").alias("doc_id"), "given.*")
    n = F.length("text")
    both = d.join(given, "doc_id").select(
        "doc_id", n.cast("long").alias("n_chars"), "text", F.col("sketch").alias("next_sketch"),
        F.expr("concat(substring(text, 1, length(text) - cast(length(text) div 2 as int)), substring(head, 1, cast(length(text) div 2 as int)))").alias("edited"),
    )
    both = with_sketch(with_sketch(both, "text", "own"), "edited", "other").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", to_string(F.col("own")).alias("fingerprint"), to_string(F.col("other")).alias("edited_fingerprint"),
        containment(F.col("own"), F.col("other")).alias("near_edited"), containment(F.col("own"), F.col("next_sketch")).alias("near_next"),
    )
