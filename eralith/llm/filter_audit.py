"""What filters do to each other, in every order they could be applied in.

Each text's failures are a bit mask, and a part (a language, say) is known by its cells: how many texts, good and toxic ones
among them, have each mask. Cells are a partial aggregate of at most 2^k rows a part, whatever the size of the input. All k!
orders are then visited by swaps of two neighbouring filters: a swap changes only the two steps that it touches, and these
are read anew from the cells. Each filter's removals are added up along the walk.

Copies are told from aggregates alone: texts are known by SHA-256, copies of one text collapse to a row for each part and
label before they meet, and no copy is joined to another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filters whose orders are visited at most: 5,040 orders.
MOST_FILTERS = 7
#: Parts that a task walks side by side.
_PARTS = 64


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places i, in order, such that swapping items i and i + 1 visits every order of n items once."""
    if n < 2:
        return
    inner = list(adjacent_swaps(n - 1))
    for j in range(len(inner) + 1):
        # the last item goes through the others and back; in between these move on by one swap
        yield from range(n - 2, -1, -1) if j % 2 == 0 else range(n - 1)
        if j < len(inner):
            yield inner[j] + (1 if j % 2 == 0 else 0)


def walk(cells: np.ndarray, k: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """(order, removed) of each order of k filters; removed: (k steps, parts, columns). cells: (parts, 2^k masks, columns).

    removed is one array that changes from step to step; a filter fails the texts in whose mask its bit is set.
    """
    masks = np.arange(1 << k)

    def removed_by(f: int, before: int) -> np.ndarray:
        return cells[:, (masks >> f & 1 == 1) & (masks & before == 0)].sum(1)

    order, before = list(range(k)), [(1 << i) - 1 for i in range(k)]  # before: the filters that a step comes after
    removed = np.stack([removed_by(f, b) for f, b in zip(order, before, strict=True)])
    yield order, removed
    for i in adjacent_swaps(k):
        a, b = order[i], order[i + 1]
        order[i], order[i + 1], before[i + 1] = b, a, before[i] | 1 << b
        removed[i], removed[i + 1] = removed_by(b, before[i]), removed_by(a, before[i + 1])
        yield order, removed


def orders(cells: DataFrame, names: list[str], sums: list[str]) -> DataFrame:
    """Every order and step of each part of cells (part, mask, n, sums...): what failure_cells returns, or the like.

    (part, filter_order, step, kept, removed, redundant, unique_fails, one <sum>_lost for each of sums, shapley). names: the
    filters by their bit in mask, which stand in filter_order as they are (joined by commas if any has more than one
    letter). shapley: what the step's filter removes, added up over all orders. Rows of one part and mask are added.
    """
    k, columns = len(names), ["n", *sums]
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")
    joint = "" if all(len(x) == 1 for x in names) else ","
    lost = [f"{s}_lost" for s in sums]
    schema = f"part string, filter_order string, step int, {', '.join(f'`{c}` long' for c in ('kept', 'removed', 'redundant', 'unique_fails', *lost, 'shapley'))}"
    one = cells.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in columns))
    one = one.groupBy("part").agg(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in ("mask", *columns)))).alias("cells"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _PARTS):
                batch = whole.slice(at, _PARTS)
                n = batch.num_rows
                dense = np.zeros((n, 1 << k, len(columns)), np.int64)
                for i, row in enumerate(batch.column(1).to_pylist()):
                    for c in row:
                        dense[i, c["mask"]] = [c[x] for x in columns]
                visited = [(order.copy(), removed.copy()) for order, removed in walk(dense, k)]
                of = np.array([order for order, _ in visited])  # (orders, steps): the step's filter
                removed = np.stack([x for _, x in visited]).transpose(2, 0, 1, 3)  # (parts, orders, steps, columns)
                shapley = np.stack([removed[..., 0].sum((1, 2), where=of == f) for f in range(k)], 1)
                bits = np.arange(1 << k)[:, None] >> np.arange(k) & 1
                failing, alone = dense[..., 0] @ bits, dense[:, 1 << np.arange(k), 0]
                total = dense[..., 0].sum(1)
                kept = total[:, None, None] - removed[..., 0].cumsum(2)
                made = [kept, removed[..., 0], failing[:, of] - removed[..., 0], alone[:, of], *(removed[..., 1 + i] for i in range(len(sums))), shapley[:, of]]
                per = of.size
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(np.arange(n), per))),
                    pa.array(np.tile(np.repeat([joint.join(names[f] for f in o) for o in of.tolist()], k), n).tolist(), pa.string()),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n * len(of))), *(pa.array(x.reshape(-1)) for x in made),
                ], names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley"])

    return one.mapInArrow(work, schema)


def failure_cells(
    docs: DataFrame, filters: dict[str, Callable[[Column], Column]], copies: str | None = None, part_col: str = "lang",
    labels: DataFrame | None = None, sums: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(part, mask, n, sums...): texts of docs by what they fail; at most 2^k rows a part.

    filters: name -> condition on a text that it fails (null: it does not); bit i of mask is the i-th filter. copies: the name
    of one more filter, the last bit, which a text fails if any row with a smaller id has the same text. sums: name -> condition
    (SQL) on a row of labels (id_col, ...); the texts of an id any of whose labels meets it are counted. A null text is an empty one, a
    null part an empty string. Repeated rows count as often as they stand and are no copies of each other, having one id.
    A row without an id is left out.
    """
    text, sums = F.coalesce(F.col("text"), F.lit("")), sums or {}
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text")).where("doc is not null")
    mask = sum((F.when(fails(text), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    sig = F.unhex(F.sha2(text.cast("binary"), 256)) if copies else F.lit(None).cast("binary")
    # rows that repeat are one from here on, with a count
    d = d.select("doc", "part", mask.cast("int").alias("mask"), sig.alias("sig")).groupBy("doc", "part", "mask", "sig").agg(F.count("*").alias("n"))
    if sums:
        found = labels.groupBy(F.col(id_col).cast("long").alias("doc")).agg(*(F.max(F.coalesce(F.expr(c), F.lit(False))).alias(f"is_{s}") for s, c in sums.items()))
        d = d.join(found, "doc", "left")
    flags = [F.coalesce(f"is_{s}", F.lit(False)).alias(f"is_{s}") for s in sums]
    names = [f"is_{s}" for s in sums]
    told = lambda n: [F.sum(F.when(F.col(f), n).otherwise(0)).alias(s) for f, s in zip(names, sums, strict=True)]
    d = d.select("doc", "part", "mask", "sig", "n", *flags)
    if copies is None:
        return d.groupBy("part", "mask").agg(F.sum("n").alias("n"), *told(F.col("n")))
    # of each text in each part and with each label: its rows, its least id and that id's rows
    g = d.groupBy("sig", "part", "mask", *names).agg(F.sum("n").alias("n"), F.min("doc").alias("least"), F.min_by("n", "doc").alias("n_least"))
    g = g.withColumn("first", F.when(F.col("least") == F.min("least").over(Window.partitionBy("sig")), F.col("n_least")).otherwise(0))
    g = g.groupBy("part", "mask", *names).agg(F.sum("first").alias("first"), F.sum(F.col("n") - F.col("first")).alias("later"))
    bit = 1 << len(filters)
    both = F.inline(F.array(F.struct(F.col("mask").alias("m"), F.col("first").alias("n")), F.struct((F.col("mask") + bit).alias("m"), F.col("later").alias("n"))))
    return g.select("part", *names, both).groupBy("part", F.col("m").alias("mask")).agg(F.sum("n").alias("n"), *told(F.col("n")))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


#: Fixed values of the query: filter -> condition that a text fails.
FILTERS: dict[str, Callable[[Column], Column]] = {
    "A": lambda t: F.size(_words(t)) < 200,
    "B": lambda t: 100 * F.size(F.array_distinct(_words(t))) < 50 * F.size(_words(t)),
    "C": lambda t: 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > 3 * F.length(t),
    "D": lambda t: t.rlike("[#$%&*|]"),
}


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All orders of five filters over documents, by language; labels tell good and toxic texts."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    sums = {"good": "quality = 1", "toxic": "toxic = 1"}
    return orders(failure_cells(docs, FILTERS, copies="E", labels=labels, sums=sums), [*FILTERS, "E"], list(sums))
