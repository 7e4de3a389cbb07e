"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Measures of each text are sketched per language and source: a sketch counts values in buckets whose edges grow by 2 %,
so a quantile is right to 1 % of its value, sketches merge by adding counts, and the result depends neither on the order
of rows nor on lost and repeated tasks. Languages and all texts have sketches by merging.

Most texts have no symbol, no repeated line and no repeated phrase, so quartiles of the plain shares would be zero. What is
sketched are odds (count against the rest), where a count of zero stands for the least count that there can be: a text without
any tells by its length how rare such things are at most. A group's fence lies above its upper quartile by a
multiple of the distance of its quartiles, on the scale of logarithms (LEAST_SPREAD at least), so it is above zero and follows the group alone; no
count or share is fixed. It is drawn towards its language's, and that towards all texts', by ``prior`` texts' weight, alike at
every group size. A text is rejected if a measure lies beyond its group's fence, never for a count of zero; a join on
(language, source) carries the fences to the texts.
Sketches have a bounded size and are partial aggregates, so a source with a third of all rows is no heavier than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eralith.llm._spark import text_hash, written
from eralith.llm._text import Words, covered, mix, slices, windows

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Languages and sources whose fences may be broadcast (under 10 MB); more of them are joined.
MOST_BROADCAST = 100_000
#: measure -> (count, what it is counted in, least count that is not zero). Words in phrases that come twice are ten at least.
#: word_length is no share and never zero.
MEASURES = {
    "symbol_share": ("n_symbols", "word_chars", 1),
    "dup_line_share": ("n_dup_lines", "n_lines", 1),
    "repeat_share": ("n_repeat_words", "n_words", 10),
    "word_length": ("word_chars", "n_words", None),
}
#: Natural logarithm of the ratio of a sketch's bucket edges; the bucket of zeros.
STEP, ZERO = 0.02, -(1 << 20)
#: Distances of the quartiles that a fence lies above the upper one.
WIDTH = 2.0
#: What the quartiles of a group with next to no spread count as being apart: a tenth, in logarithms.
LEAST_SPREAD = 0.1


def text_counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep... and the counts of each text: words, their code points, symbols, lines, repeated lines and words."""
    d = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("text"))
    schema = d.drop("text").schema
    names = [*schema.names, *_COUNTS]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b.column(b.num_columns - 1)):
                w = Words(t)
                n = np.diff(w.first)
                points = np.concatenate([[0], np.cumsum(w.inside & ((t.data & 0xC0) != 0x80))])
                symbols = np.concatenate([[0], np.cumsum(_SYMBOL[t.data])])
                start, h = windows(w.hashes(), w.first, 5)
                of = np.searchsorted(w.first, start, "right") - 1
                h = mix(h ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                order = np.argsort(h)
                same = h[order][1:] == h[order][:-1]
                twice = np.zeros(len(h), bool)
                twice[order[1:][same]] = twice[order[:-1][same]] = True
                repeat = np.concatenate([[0], np.cumsum(covered(start[twice], start[twice] + 5, len(w.start)))])
                lines = [[x for x in raw.split(b"\n") if x.strip()] for raw in t.each()]
                n_lines = np.array([len(x) for x in lines])
                dup = n_lines - np.array([len(set(x)) if len(x) > 1 else len(x) for x in lines])
                at = t.offsets
                counts = (n, points[at[1:]] - points[at[:-1]], symbols[at[1:]] - symbols[at[:-1]], n_lines, dup, repeat[w.first[1:]] - repeat[w.first[:-1]])
                yield pa.RecordBatch.from_arrays([*(c.slice(t.first, t.n) for c in b.columns[:-1]), *(pa.array(x, pa.int64()) for x in counts)], names=names)

    for c in _COUNTS:
        schema = schema.add(c, "long")
    out = d.mapInArrow(count, schema)
    return out.withColumnsRenamed({f"k{i}": f"_{c}" for i, c in enumerate(keep)})


def measured(name: str) -> str:
    """What is sketched of a measure: odds of a share, or the ratio (SQL over the counts)."""
    count, of, least = MEASURES[name]
    return f"{count} / {of}" if least is None else f"greatest({count}, {least}) / greatest({of} - {count}, {least})"


def beyond(name: str, fence: str) -> str:
    """Whether a text's measure lies beyond a fence (SQL over the counts)."""
    count, of, least = MEASURES[name]
    return f"{count} > {fence} * {of}" if least is None else f"{count} > {fence} * greatest({of} - {count}, {least})"


def sketches(values: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """(by..., measure, bucket, n): quantile sketches of non-negative columns; they merge by adding n."""
    bucket = lambda m: F.when(F.col(m) > 0, F.ceil(F.log(m) / STEP)).otherwise(ZERO).cast("int")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(m).alias("bucket")) for m in measures)))
    return values.select(*by, each.alias("v")).groupBy(*by, "v.measure", "v.bucket").agg(F.count("*").alias("n"))


def merged(sk: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of wider groups."""
    return sk.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sk: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by..., measure, n, one column a share): the value up to which that share of a sketch lies, within 1 %.

    A sketch has some thousand buckets at most, so its window is bounded.
    """
    group = Window.partitionBy(*by, "measure")
    value = F.when(F.col("bucket") > ZERO, F.exp(F.col("bucket") * STEP - STEP / 2)).otherwise(0.0)
    w = sk.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "of": F.sum("n").over(group), "value": value})
    return w.groupBy(*by, "measure").agg(F.max("of").alias("n"), *(F.min(F.when(F.col("upto") >= F.col("of") * q, F.col("value"))).alias(c) for c, q in shares.items()))


def group_fences(counts: DataFrame, width: float = WIDTH, prior: int = 50) -> DataFrame:
    """(g0, g1, fence_<measure>...): the fences of each language and source of counts (g0, g1, counts..., base_failed)."""
    shares = counts.where("not base_failed").select("g0", "g1", *(F.expr(measured(m)).alias(m) for m in MEASURES))
    own = written(sketches(shares, ["g0", "g1"], list(MEASURES)))

    def fences(sk: DataFrame, by: list[str], p: str) -> DataFrame:
        q1, q3 = F.log("q1"), F.log("q3")
        fence = q3 + F.greatest(q3 - q1, F.lit(LEAST_SPREAD)) * width
        return quantiles(sk, by, {"q1": 0.25, "q3": 0.75}).select(*by, "measure", F.col("n").alias(f"n_{p}"), fence.alias(f"f_{p}"))

    drawn = lambda p, wider: (F.coalesce(f"n_{p}", F.lit(0)) * F.coalesce(f"f_{p}", F.lit(0.0)) + wider * prior) / (F.coalesce(f"n_{p}", F.lit(0)) + prior)
    table = (
        counts.select("g0", "g1").distinct().withColumn("measure", F.explode(F.array(*map(F.lit, MEASURES))))
        .join(fences(merged(own, []), [], "all"), "measure", "left")
        .join(fences(merged(own, ["g0"]), ["g0"], "lang"), ["g0", "measure"], "left")
        .join(fences(own, ["g0", "g1"], "own"), ["g0", "g1", "measure"], "left")
        .groupBy("g0", "g1").pivot("measure", list(MEASURES)).agg(F.first(F.exp(drawn("own", drawn("lang", F.col("f_all"))))))
    )
    return written(table.withColumnsRenamed({m: f"fence_{m}" for m in MEASURES}))


def verdicts(counts: DataFrame, fences: DataFrame) -> DataFrame:
    """counts with kept and reasons by the fences of their groups."""
    # a source may hold a third of all rows, so the fences go to the rows where they are few; without any, all texts fail the base rules
    out = counts.join(F.broadcast(fences) if fences.count() <= MOST_BROADCAST else fences, ["g0", "g1"], "left")
    reasons = F.array_compact(F.array(F.when(F.col("base_failed"), F.lit("base")), *(F.when(F.expr(beyond(m, f"fence_{m}")), F.lit(m)) for m in MEASURES)))
    return out.withColumn("reasons", reasons).withColumn("kept", F.size("reasons") == 0)


def group_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(doc_id, text_hash, g0, g1, counts..., base_failed) of every row with an id."""
    group = (F.coalesce(F.col(x).cast("string"), F.lit("\0")).alias(f"g{i}") for i, x in enumerate(by))
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), *group, F.col(text_col).alias("text"))
    c = text_counts(d, "text", ("doc_id", "text_hash", "g0", "g1")).withColumnsRenamed({f"_{x}": x for x in ("doc_id", "text_hash", "g0", "g1")})
    return c.select("doc_id", "text_hash", "g0", "g1", *_COUNTS, F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words").alias("base_failed"))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, str] = ("lang", "source"),
    width: float = WIDTH, prior: int = 50,
) -> DataFrame:
    """(doc_id, text_hash, counts..., base_failed, kept, reasons): one row per row of docs that has an id.

    Fence of a sketch, in logarithms: upper quartile + width * interquartile range. The fence of a language and source is
    the mean of its own sketch's, weighing as many as its texts, and its language's, weighing prior; the language's is
    drawn to all texts' in the same way. Null language or source: a group of its own. A null text is an empty one; texts without words
    fail the base rules (fewer than 10 words); they and others that fail them count in no sketch. Rows without an id
    are left out; repeated rows count and are judged as often as they stand.
    """
    c = written(group_counts(docs, id_col, text_col, by))
    return verdicts(c, group_fences(c, width, prior)).select("doc_id", "text_hash", *_COUNTS, "base_failed", "kept", "reasons")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Verdicts of quality_rules over documents."""
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("reasons", ",").alias("reasons"))
