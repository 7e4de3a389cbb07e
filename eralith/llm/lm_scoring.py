"""Language-model scoring by a weighted backoff automaton that is learnt from the corpus itself.

States are contexts (the last words), arcs are seen n-grams with their smoothed log10 probabilities, and every state has
a weighted failure arc to the state of the shorter context. A text is scored in one left-to-right traversal that
carries the state: follow the word's arc, or else the failure arc, whose weight is added, until an arc is found.

Smoothing: absolute discounting for words (the discounted mass goes to unknown words as one event), and for longer
n-grams P(w|h) = (c(hw) + m * P(w|shorter h)) / (c(h) + m); the failure arc of h weighs log10(m / (c(h) + m)).

No task ever holds the whole model. Texts are taken in blocks of bounded size, whose words become local numbers once.
A block asks for its distinct n-grams, as sorted 64-bit hashes, with its own training counts; shards of the hash range
add the counts up and answer each block in its own order, beyond some thousand blocks by way of ranges of them. So counting and look-up are one exchange, whose size
follows the input; a frequent n-gram comes once from each block, however often it stands there. The block then
builds the part of the automaton that its texts can reach, as arrays, and traverses it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eralith.llm._spark import written
from eralith.llm._text import Words, combine, slices

_BLOCK_BYTES = 4 << 20
_END, _START = (np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344))
_TOKENS_PER_SHARD = 2_000_000
#: Blocks whose n-grams of one shard are added up in one task.
BLOCKS_PER_RANGE = 8192
_RUN = "block long, docs binary, train binary, sizes binary, words binary, tokens binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (doc, train, text) as blocks of local word numbers, an end mark after each text."""
    for b in batches:
        docs, train = np.asarray(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for t in slices(b.column(2), _BLOCK_BYTES):
            w = Words(t, lower=True)
            n = np.diff(w.first)
            ends = w.first[1:] + np.arange(t.n)
            tokens = np.empty(len(w.start) + t.n, np.uint64)
            is_end = np.zeros(len(tokens), bool)
            is_end[ends] = True
            tokens[is_end], tokens[~is_end] = _END, w.hashes()
            words, local = np.unique(tokens, return_inverse=True)
            rows = slice(t.first, t.first + t.n)
            parts = [x.tobytes() for x in (docs[rows].astype("<i8"), train[rows], (n + 1).astype("<i4"), words, local.astype("<u4"))]
            # an id that follows from the block's content: the same when a lost task runs again
            key = int.from_bytes(blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)
            yield pa.record_batch([pa.array([key], pa.int64()), *(pa.array([p], pa.binary()) for p in parts)], names=["block", "docs", "train", "sizes", "words", "tokens"])


class _Block:
    """A block read back, with its distinct n-grams of each order."""

    def __init__(self, row: dict, order: int):
        self.docs, self.train = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["train"], bool)
        self.sizes, self.words = np.frombuffer(row["sizes"], "<i4").astype(np.int64), np.frombuffer(row["words"], "<u8")
        self.tokens = np.frombuffer(row["tokens"], "<u4").astype(np.int64)
        learns = np.repeat(self.train, self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        self.keys, self.at, self.counts = [], [], []
        h = self.words[self.tokens]
        context = h
        for n in range(1, order + 1):
            if n > 1:  # the n-gram that ends at each place: a longer context, then the word; texts begin with start marks
                before = np.empty_like(h)
                before[1:] = context[:-1]
                before[first] = _START + np.uint64(n)
                context = combine(before, h)
            keys, at = np.unique(context, return_inverse=True)
            self.keys.append(keys)
            self.at.append(at)
            self.counts.append(np.bincount(at[learns], minlength=len(keys)).astype("<u4"))


def _ask(order: int, shards: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = _Block(row, order)
                for n, (keys, counts) in enumerate(zip(block.keys, block.counts, strict=True), 1):
                    shard = (keys % np.uint64(shards)).astype(np.int64)
                    by = np.argsort(shard, kind="stable")
                    cut = np.searchsorted(shard[by], np.arange(shards + 1))
                    some = np.flatnonzero(np.diff(cut))
                    pick = [by[cut[s] : cut[s + 1]] for s in some]
                    yield pa.record_batch([
                        pa.array(some.astype(np.int32)), pa.array(np.full(len(some), row["block"])), pa.array(np.full(len(some), n, np.int32)),
                        pa.array([keys[p].tobytes() for p in pick], pa.binary()), pa.array([counts[p].tobytes() for p in pick], pa.binary()),
                    ], names=["shard", "block", "n", "keys", "counts"])

    return ask


def _packed(counts: np.ndarray) -> bytes:
    """Counts as 32-bit integers, or all as 64-bit ones where the greatest needs them."""
    return counts.astype("<u4" if counts.max(initial=0) < 1 << 32 else "<u8").tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u8" if len(raw) == 8 * n else "<u4").astype(np.int64)


def _keys_and_counts(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    keys = [np.frombuffer(x.as_py(), "<u8") for x in table["keys"]]
    return keys, [_unpacked(x.as_py(), len(k)) for x, k in zip(table["counts"], keys, strict=True)]


def _answer(table: pa.Table) -> pa.Table:
    """Sums of one shard and order, for each block in the order of its keys; and how many keys have each small count."""
    keys, counts = _keys_and_counts(table)
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts))
    cut = np.cumsum([0, *map(len, keys)])
    answers = [_packed(total[at[a:b]]) for a, b in zip(cut, cut[1:], strict=False)]
    facts = [total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()]
    m = table.num_rows
    first = [None] * (m - 1)
    return pa.table({
        "block": table["block"], "n": table["n"], "shard": table["shard"], "counts": pa.array(answers, pa.binary()),
        "facts": pa.array([[int(x) for x in facts], *first], pa.list_(pa.int64())),
    })


def _gathered(table: pa.Table) -> pa.Table:
    """The blocks of one range, shard and order as one: each key once, in order, with its sum."""
    keys, counts = _keys_and_counts(table)
    each, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts))
    return pa.table({"shard": table["shard"][:1], "block": table["range"][:1], "n": table["n"][:1], "keys": pa.array([each.tobytes()], pa.binary()), "counts": pa.array([_packed(total)], pa.binary())})


def _passed_on(table: pa.Table) -> pa.Table:
    """What the one row without keys says of a range, to each of its blocks in the order of the block's keys."""
    told = table.filter(pc.is_null(table["keys"]))
    asked = table.filter(pc.is_valid(table["keys"]))
    keys = [np.frombuffer(x.as_py(), "<u8") for x in asked["keys"]]
    each, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = _unpacked(told["counts"][0].as_py(), len(each))
    cut = np.cumsum([0, *map(len, keys)])
    answers = [_packed(total[at[a:b]]) for a, b in zip(cut, cut[1:], strict=False)]
    return pa.table({"block": asked["block"], "n": asked["n"], "shard": asked["shard"], "counts": pa.array(answers, pa.binary())})


def _answered(asked: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame]:
    """(answers (block, n, shard, counts), facts (n, facts)) of asked (shard, block, n, keys, counts).

    A frequent n-gram's shard has a row from every block. With more than one range, blocks of a range (by their ids) are
    added up first and ranges then, and answers go back the same way, so no task takes a row from every block.
    """
    schema = "block long, n int, shard int, counts binary, facts array<long>"
    if ranges == 1:
        both = written(asked.groupBy("shard", "n").applyInArrow(_answer, schema))
        return both.drop("facts"), both.where("facts is not null").select("n", "facts")
    asked = written(asked.withColumn("range", F.pmod("block", F.lit(ranges))))
    by_range = asked.groupBy("shard", "n", "range").applyInArrow(_gathered, "shard int, block long, n int, keys binary, counts binary")
    told = written(by_range.groupBy("shard", "n").applyInArrow(_answer, schema))
    back = told.select("shard", F.lit(None).cast("long").alias("block"), "n", F.lit(None).cast("binary").alias("keys"), "counts", F.col("block").alias("range"))
    answers = asked.unionByName(back).groupBy("shard", "n", "range").applyInArrow(_passed_on, "block long, n int, shard int, counts binary")
    return written(answers), told.where("facts is not null").select("n", "facts")


class Automaton:
    """The part of the automaton that a block's texts can reach, compiled to arrays.

    A state is a context of up to order - 1 words that training has seen: state 0 is the empty context, state 1 a text's
    beginning, the others are numbered by length and n-gram. An arc (state, word) has a target and a weight, the word's
    smoothed log10 probability there; the failure arc of a state leads to the context without its first word. From the
    empty context every word has an arc, unknown ones too.
    """

    def __init__(self, block: _Block, answers: list[np.ndarray], first_words: np.ndarray, order: int, m: float, start_count: float):
        self.block, self.order = block, order
        first, sizes = np.cumsum(block.sizes) - block.sizes, [len(k) for k in block.keys]
        base = 2 + np.concatenate([[0], np.cumsum(sizes[: order - 1])]).astype(np.int64)  # state of the first n-gram of each length
        states = int(base[order - 1])
        self.failure, self.fail_weight = np.zeros(states, np.int64), np.zeros(states)
        self.fail_weight[1] = np.log10(m / (start_count + m))
        prob = first_words
        # arcs of the empty context: one for each word
        self.root_weight = np.log10(prob)
        self.root_target = np.where(answers[0] > 0, base[0] + np.arange(sizes[0]), 0) if order > 1 else np.zeros(sizes[0], np.int64)
        keys, targets, weights = [np.array([np.iinfo(np.int64).max])], [np.zeros(1, np.int64)], [np.zeros(1)]  # an end that no key reaches
        for n in range(1, order):
            # of each n-gram: its context's state, the shorter n-gram that it ends with, its last word
            context, suffix, word = (np.empty(sizes[n], np.int64) for _ in range(3))
            previous = np.empty(len(block.tokens), np.int64)
            previous[1:] = base[n - 1] + block.at[n - 1][:-1]
            previous[first] = 1 if n == 1 else 0  # longer contexts than a text's beginning are none
            context[block.at[n]], suffix[block.at[n]], word[block.at[n]] = previous, block.at[n - 1], block.tokens
            count = np.concatenate([[0.0 if n > 1 else 1.0, start_count if n == 1 else 0.0], answers[n - 1]]).astype(float)
            held = count[np.where(context < 2, context, context - base[n - 1] + 2)]
            c = answers[n].astype(float)
            prob = np.where(held > 0, (c + m * prob[suffix]) / (held + m), prob[suffix])
            arc = (c > 0) & (held > 0)
            keys.append(context[arc] * sizes[0] + word[arc])
            weights.append(np.log10(prob[arc]))
            # on: the n-gram itself as a context, or the one that it ends with where it is as long as contexts get
            targets.append(base[n] + np.flatnonzero(arc) if n < order - 1 else base[n - 1] + suffix[arc])
            own = slice(base[n - 1], base[n - 1] + sizes[n - 1])
            self.fail_weight[own] = np.log10(m / (answers[n - 1] + m))
            if n > 1:
                self.failure[own] = base[n - 2] + shorter
            shorter = suffix
        keys, targets, weights = (np.concatenate(x) for x in (keys, targets, weights))
        by = np.argsort(keys, kind="stable")
        self.keys, self.target, self.weight = keys[by], targets[by], weights[by]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, next state) of reading one word in each state: failure arcs until there is an arc."""
        weight, at_state, after = np.zeros(len(state)), state.copy(), np.full(len(state), -1)
        way = np.flatnonzero(state)
        while len(way):
            key = at_state[way] * len(self.root_weight) + word[way]
            at = np.searchsorted(self.keys, key)
            hit = self.keys[at] == key
            weight[way[hit]] += self.weight[at[hit]]
            after[way[hit]] = self.target[at[hit]]
            way = way[~hit]
            weight[way] += self.fail_weight[at_state[way]]
            at_state[way] = self.failure[at_state[way]]
            way = way[at_state[way] > 0]
        way = np.flatnonzero(after < 0)
        weight[way] += self.root_weight[word[way]]
        after[way] = self.root_target[word[way]]
        return weight, after

    def traverse(self, piece: int = 256) -> np.ndarray:
        """log10 probability of each text by one walk from left to right that carries the state.

        All texts of the block take a step at a time. Long ones are cut into pieces that walk side by side: a piece begins
        order - 1 words early in the empty context, and as a state holds no more words than that, has the true one when
        its own words begin.
        """
        sizes = self.block.sizes
        first = np.cumsum(sizes) - sizes
        pieces = -(-sizes // piece)
        text = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        early = np.where(nth > 0, self.order - 1, 0)
        start = first[text] + nth * piece - early
        length = np.minimum(sizes[text] - nth * piece, piece) + early
        by = np.argsort(-length, kind="stable")
        text, start, length, early = text[by], start[by], length[by], early[by]
        state = np.where(start == first[text], 1, 0) if self.order > 1 else np.zeros(len(text), np.int64)
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
        total = np.zeros(len(text))
        for t, n in enumerate(active.tolist()):
            weight, state[:n] = self.step(state[:n], self.block.tokens[start[:n] + t])
            total[:n] += np.where(early[:n] <= t, weight, 0.0)
        return np.bincount(text, weights=total, minlength=len(sizes))


def lm_scores(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2, prior: float = 200.0
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row with an id.

    The model learns from rows that are not held_out and scores all. Null and empty texts hold the end mark alone.
    base_score: add-one smoothed words. Without any training text every word is the unknown event: score 0. A row
    without an id neither teaches nor is scored; repeated rows teach as often as they stand.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc"), (~held_out).alias("train"), F.col(text_col).cast("string").alias("text")).where("doc is not null")
    blocks = written(d.select("doc", F.coalesce("train", F.lit(False)).alias("train"), "text").mapInArrow(_blocks, _RUN))
    tokens = blocks.agg(F.sum(F.octet_length("tokens")) / 4).first()[0] or 0
    shards = int(tokens * order // _TOKENS_PER_SHARD) + 1
    asked = blocks.mapInArrow(_ask(order, shards), "shard int, block long, n int, keys binary, counts binary")
    answers, facts = _answered(asked, int(blocks.count() // BLOCKS_PER_RANGE) + 1)
    f = facts.where("n = 1").agg(*(F.coalesce(F.sum(F.get("facts", i)), F.lit(0)) for i in map(F.lit, range(4)))).first()
    total, known, once, twice = (int(x) for x in f)
    n_train = int(blocks.mapInArrow(_train_docs, "n long").agg(F.sum("n")).first()[0] or 0)
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5

    def walk(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        heads = [r for r in rows if not r["kind"]]  # several only where rows of the input repeat
        block = _Block(heads[0], order)
        found = [np.zeros(len(k), np.int64) for k in block.keys]
        shard = [(k % np.uint64(shards)).astype(np.int64) for k in block.keys]
        for r in rows:
            if r["kind"]:
                mine = shard[r["n"] - 1] == r["shard"]
                found[r["n"] - 1][mine] = _unpacked(r["counts"], np.count_nonzero(mine))
        c = found[0].astype(float)
        base = np.log10((c + 1) / (total + known + 1))
        p = np.where(c > 0, (c - discount) / total, discount * known / total) if total else np.ones(len(c))
        score = Automaton(block, found, p, order, prior, float(n_train)).traverse()
        ends = np.cumsum(block.sizes)
        at = block.at[0]
        add = lambda v: np.add.reduceat(v[at], ends - block.sizes)
        n = len(block.docs)
        one = pa.table({
            "doc_id": block.docs, "held_out": ~block.train, "n_tokens": block.sizes, "n_known": add((c > 0).astype(np.int64)),
            "train_tokens": np.full(n, total), "base_score": add(base), "score": score,
        })
        return pa.concat_tables([one] * len(heads))

    none = F.lit(None)
    mine = blocks.select("block", F.lit(0).alias("kind"), none.cast("int").alias("n"), none.cast("int").alias("shard"), none.cast("binary").alias("counts"), "docs", "train", "sizes", "words", "tokens")
    theirs = answers.select("block", F.lit(1).alias("kind"), "n", "shard", "counts", *(none.cast("binary").alias(x) for x in ("docs", "train", "sizes", "words", "tokens")))
    return mine.unionByName(theirs).groupBy("block").applyInArrow(
        walk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def _train_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([pa.array([sum(int(np.frombuffer(x.as_py(), bool).sum()) for x in b.column(b.schema.get_field_index("train")))], pa.int64())], names=["n"])


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of documents; texts whose id's CRC-32 leaves 2 modulo 7 are held out."""
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), held)
