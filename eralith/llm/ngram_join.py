"""N-gram Jaccard self-join: T-occurrence search with DivideSkip inside candidate clusters.

Sets of equal shingles form one class, spoken for by its least id. What is left is narrowed down in linear steps:

1. A document whose partner reaches the threshold misses few shingles in all others. On a quarter of the hash range
   each document's shingles that no other set has are counted; too many, and it has no partner.
2. For the rest all shingles are counted. The rarest ``allowed + 1`` of a document form its prefix; partners share one.
3. Pairs that share a short prefix list are kept if the places of what they share leave room for the required
   overlap; whoever shares a long list goes in one cluster. Clusters are the components of these edges.
4. A cluster is searched in blocks of bounded size, each pair of blocks in one task: the query's short inverted lists are
   merged, its long ones are probed by binary search for those documents alone that can still reach the overlap
   (DivideSkip). A task tells a spanning forest of the links that it found, never all pairs. A cluster beyond one block
   is first held against a few of its own members, one after another: what links to one of these is one group already,
   and pairs of blocks of the same group, in a large cluster of near copies nearly all, need no search.

Components of all links are then found by alternating stars. No list or class is collected, capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralith.llm._components import components
from eralith.llm._spark import id_filter, shared_runs, written
from eralith.llm._text import Rolling, Words, lists, mix, slices, spread, thinned, windows

#: Longest prefix list whose pairs are looked at one by one; documents in one block of a cluster.
SHORT_LIST, BLOCK = 64, 512
#: Members that a large cluster is held against before it is searched.
LEADERS = 3


def shingle_sets(texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their number; a shorter text is one shingle."""
    w = Words(texts, lower=True)
    h = w.hashes()
    start, g = windows(h, w.first, k)
    of = np.searchsorted(w.first, start, "right") - 1
    n = np.diff(w.first)
    few = np.flatnonzero((n > 0) & (n < k))
    whole = mix(Rolling(h).ranges(w.first[few], w.first[few + 1]) + np.uint64(k))
    of, g = np.concatenate([of, few]), np.concatenate([g, whole])
    order = np.lexsort((g, of))
    of, g = of[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    return g[new], np.bincount(of[new], minlength=texts.n)


def _signature(g: np.ndarray, of: np.ndarray, n: np.ndarray, salt: int = 0x51ED270B) -> np.ndarray:
    """Hash of each set of shingles g, whatever their order."""
    total = np.zeros(len(n), np.uint64)
    np.add.at(total, of, mix(g ^ np.uint64(salt)))
    return mix(total + n.astype(np.uint64)).view(np.int64)


def _required(n: int, percent: int) -> int:
    """Least overlap with any partner of a set of n."""
    return -(-percent * n // 100)


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row with an id.

    Words: runs without ASCII white space, A-Z lower-cased. Two rows link when 100 * intersection >= percent * union of
    their k-word shingle sets. component_id: the least id that links reach. Rows without words (null and empty texts)
    have no shingles and no links. Rows with equal ids are one node, linked as any of them; those of equal text too are
    told once each. Without an id: left out.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b.column(1)):
                g, n = shingle_sets(t, k)
                of = np.repeat(np.arange(t.n), n)
                sig = [pa.array(_signature(g, of, n, salt)) for salt in (0x51ED270B, 0xB492B66F)]
                sub = np.bincount(of[g % np.uint64(4) == 0], minlength=t.n)
                yield pa.record_batch([b.column(0).slice(t.first, t.n), pa.array(n.astype(np.int64)), pa.array(sub.astype(np.int64)), *sig], names=["doc", "n", "n_sub", "sig", "sig2"])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = np.asarray(b.column(0))
            for t in slices(b.column(1)):
                g, n = shingle_sets(t, k)
                of = np.repeat(np.arange(t.n), n)
                sig = _signature(g, of, n)
                use = g % np.uint64(4) == 0
                of = of[use]
                rows, key, known = thinned(g[use].view(np.int64), sig[of], doc[t.first + of])
                of = of[rows]
                yield pa.record_batch([pa.array(key), sig[of], doc[t.first + of], pa.array(known)], names=["h", "sig", "doc", "known"])

    stats = written(d.mapInArrow(measure, "doc long, n long, n_sub long, sig long, sig2 long"))
    classes = written(stats.where("n > 0").groupBy("sig", "sig2").agg(F.min("doc").alias("least"), F.first("n").alias("n"), F.first("n_sub").alias("n_sub")))
    # 1: shingles of the quarter that other sets have as well
    elsewhere = shared_runs(d.mapInArrow(tokens, "h long, sig long, doc long, known boolean"), ["h"], [], "doc long, sig long, n long", between_texts=True, aggregate=True)
    # of equal sets in different slices the least document tells of all shared shingles, others of some
    elsewhere = elsewhere.groupBy("sig", "doc").agg(F.sum("n").alias("m")).groupBy("sig").agg(F.max("m").alias("m"))
    allowed = F.col("n") - F.expr(f"({percent} * n + 99) div 100")
    # a small set may have no shingle in the quarter at all; one that is inside a larger set misses none (allowed = 0).
    # A partner holds at least one shingle more or less, so sets with 100 * n < percent * (n + 1) link with equals alone
    linkable = F.col("n") * 100 >= (F.col("n") + 1) * percent
    some = classes.join(elsewhere, "sig", "left").where((F.col("n_sub") - F.coalesce("m", F.lit(0)) <= allowed) & linkable)
    alive = written(some.select("least", "n", "sig"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.asarray(b.column(0))
            for t in slices(b.column(1)):
                g, n = shingle_sets(t, k)
                of = np.repeat(np.arange(t.n), n)
                mine = sig[t.first : t.first + t.n] == _signature(g, of, n)  # an id may stand at several texts
                g, n = g[mine[of]], n[mine]
                yield pa.record_batch([pa.array(sig[t.first : t.first + t.n][mine]), pa.array(n.astype(np.int64)), lists(pa.array(g.view(np.int64)), n)], names=["doc", "n", "items"])

    # from here on a class is known by its signature
    near = id_filter(alive, "least")
    full = d.where(near(F.col("doc"))).join(alive.select(F.col("least").alias("doc"), "sig"), "doc").select("sig", "text")
    full = written(full.mapInArrow(sets, "doc long, n long, items array<long>").dropDuplicates(["doc"]))
    alive = alive.select(F.col("sig").alias("doc"), "n")
    # 2: prefixes by exact counts among what is left; places count shingles that only this set has first
    # dealt out by shingle once, for the count and for the join with it
    token = full.select("doc", F.explode("items").alias("h")).repartition("h")
    counted = token.join(token.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "h")
    listed = counted.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("s")).join(alive.select("doc", "n"), "doc")
    listed = listed.withColumn("own", F.col("n") - F.size("s")).where(F.col("own") <= allowed)
    prefix = listed.select("doc", "n", "own", F.posexplode(F.slice(F.col("s"), F.lit(1), (allowed + 1 - F.col("own")).cast("int"))))
    prefix = written(prefix.select(F.col("col.h").alias("h"), F.col("col.c").alias("c"), "doc", "n", (F.col("own") + F.col("pos")).alias("at")))
    # 3: edges of clusters
    short = prefix.where(F.col("c") <= SHORT_LIST)
    a, b = (short.select("h", *(F.col(x).alias(f"{x}_{s}") for x in ("doc", "n", "at"))) for s in "ab")
    pairs = (
        a.join(b, "h").where((F.col("doc_a") < F.col("doc_b")) & (percent * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b")))
        .groupBy("doc_a", "doc_b", "n_a", "n_b").agg(F.count("*").alias("m"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"))
        .where(F.expr(f"{100 + percent} * (m + least(n_a - at_a, n_b - at_b) - 1) >= {percent} * (n_a + n_b)"))
        .select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    )
    long = prefix.where(F.col("c") > SHORT_LIST)
    stars = long.join(long.groupBy("h").agg(F.min("doc").alias("a")), "h").where("a < doc").select("a", F.col("doc").alias("b"))
    cluster = components(pairs.unionByName(stars))
    member = cluster.unionByName(cluster.select(F.col("root").alias("node"), "root").distinct())
    # 4: search in pairs of blocks
    placed = full.join(member, full["doc"] == member["node"]).select("root", "doc", "n", "items")
    large = member.groupBy("root").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("root")
    led = _led(placed.join(large, "root", "left_semi"), percent)
    placed = placed.join(led, ["root", "doc"], "left").withColumn("led", F.coalesce("led", F.lit(0)))
    groups = member.withColumnRenamed("node", "doc").join(led, ["root", "doc"], "left").groupBy("root", F.coalesce("led", F.lit(0)).alias("led")).agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("blocks"))
    groups = groups.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("led", "blocks"))).alias("blocks"))  # LEADERS + 1 entries at most
    placed = placed.join(groups, "root").withColumn("block", F.pmod(F.xxhash64("doc"), F.element_at("blocks", F.col("led"))).cast("int") * (LEADERS + 1) + F.col("led"))
    # blocks are numbered with their group as the remainder
    others = F.flatten(F.transform(F.map_entries("blocks"), lambda g: F.transform(F.sequence(F.lit(0), g["value"] - 1), lambda b: b * (LEADERS + 1) + g["key"])))
    others = F.filter(others, lambda o: (F.col("led") == 0) | (o % (LEADERS + 1) != F.col("led")))
    placed = placed.select("root", "block", "doc", "items", F.explode(others).alias("other"))
    placed = placed.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "items")
    links = placed.groupBy("root", "i", "j").applyInArrow(_search(percent), "a long, b long")
    leaders = led.groupBy("root", "led").agg(F.min("doc").alias("a"))
    links = links.unionByName(led.join(leaders, ["root", "led"]).select("a", F.col("doc").alias("b")))
    # rows of one id are one node: their classes meet in it
    ties = stats.where("n > 0").groupBy("doc").agg(F.min("sig").alias("a"), F.max("sig").alias("z")).where("a < z")
    ties = stats.where("n > 0").join(ties, "doc").select("a", F.col("sig").alias("b"))
    found = components(written(links.unionByName(ties)))
    found = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    # of a component its least id
    found = found.join(classes.select(F.col("sig").alias("node"), "least"), "node")
    found = found.join(found.groupBy("root").agg(F.min("least").alias("component")), "root").select(F.col("node").alias("sig"), "component")
    out = stats.join(classes.select("sig", "sig2", "least"), ["sig", "sig2"], "left").join(found, "sig", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "least")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _led(placed: DataFrame, percent: int) -> DataFrame:
    """(root, doc, led): members of large clusters (root, doc, n, items) that link to the led-th leader; written.

    Each leader is the least of the members that none has led yet.
    """
    led = None
    for k in range(1, LEADERS + 1):
        rest = placed if led is None else placed.join(led, ["root", "doc"], "left_anti")
        least = rest.groupBy("root").agg(F.min_by(F.struct("n", "items"), "doc").alias("lead"))
        both = F.size(F.array_intersect("items", "lead.items"))
        now = rest.join(least, "root").where((100 + percent) * both >= percent * (F.col("n") + F.col("lead.n"))).select("root", "doc", F.lit(k).alias("led"))
        led = written(now if led is None else led.unionByName(now))
        if k == 1 and led.isEmpty():  # no large cluster: a leader links to itself
            break
    return led


def _search(percent: int):
    def search(table: pa.Table) -> pa.Table:
        """T-occurrence search of every document of block i against those of block j, by DivideSkip."""
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        block, doc = np.asarray(table["block"]), np.asarray(table["doc"])
        items = table["items"].combine_chunks()
        ends, flat = items.offsets.to_numpy().astype(np.int64), np.asarray(items.values)
        sizes = np.diff(ends)
        flat = flat[ends[0] : ends[-1]]
        ends = ends - ends[0]
        _, token = np.unique(flat, return_inverse=True)
        m = len(doc)
        of = np.repeat(np.arange(m), sizes)
        # inverted lists of block j as one sorted array of token * m + document
        indexed = block[of] == j
        post = np.sort(token[indexed] * m + of[indexed])
        first = np.searchsorted(post, np.arange(token.max() + 2 if len(token) else 1) * m)
        root = list(range(m))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for q in np.flatnonzero(block == i).tolist():
            ts = token[ends[q] : ends[q + 1]]
            n = len(ts)
            least = _required(n, percent)
            length = first[ts + 1] - first[ts]
            order = np.argsort(length, kind="stable")
            # long lists are set aside for probing; what remains must still be reached by merging
            aside = min(least - 1, int(least / (0.01 * np.log2(max(int(length[order[-1]]), 2)) + 1)))
            short, long = ts[order[: n - aside]], ts[order[n - aside :]]
            # a stable sort finds the sorted lists as runs and merges them; equal neighbours are one document's hits
            merged = np.sort(post[spread(first[short], first[short + 1] - first[short])] % m, kind="stable")
            edge = np.flatnonzero(np.diff(merged, prepend=-1, append=m))
            often = np.diff(edge)
            hit, count = merged[edge[:-1]], np.zeros(m, np.int64)
            count[hit] = often
            hit = hit[often >= least - aside]
            hit = hit[hit > q] if i == j else hit
            hit = hit[(percent * np.maximum(sizes[hit], n) <= 100 * np.minimum(sizes[hit], n))]
            if not len(hit):
                continue
            both = count[hit]
            if len(long):
                probe = (long[:, None] * m + hit[None, :]).ravel()
                at = np.minimum(np.searchsorted(post, probe), max(len(post) - 1, 0))
                both = both + (post[at] == probe).reshape(len(long), len(hit)).sum(axis=0)
            for x in hit[(100 + percent) * both >= percent * (sizes[hit] + n)].tolist():
                r, s = top(q), top(x)
                if r != s:
                    root[max(r, s)] = min(r, s)
                    out.append((doc[q], doc[x]))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return search


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
