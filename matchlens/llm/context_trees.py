"""Context-tree weighting over bytes, learned from the corpus and beside a unigram word model.

A byte is eight binary decisions, the places of a tree with 255 inner nodes. For each place there is a
context tree: its root stands for no context, its children for the byte before, and so on to ``DEPTH``
bytes. At every node a Krichevsky-Trofimov estimate competes with what its children make of the same
decisions:

    weighted(node) = KT(node) / 2 + product of weighted(children) / 2

After learning, a node's share of that sum is the weight of its estimate against the deeper ones, so
the probability of a decision mixes the estimates of all depths.

Every node is a node of its own, named by its context and place, so each has one parent. Documents are
stored in blocks; a block tells which grams (a byte behind ``DEPTH`` bytes of context) it has, and gets
the score of each back. In between, the grams with the same two bytes before the last one meet, and with
them all nodes of two and more context bytes; there are at most 2**24 of them whatever the corpus. The
upper nodes are a table of at most 257 * 255 rows. Nothing is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import LOWER, corpus, fresh_path, stored
from matchlens.llm.postings import BLOCK_BYTES, PARTIAL, PLACE_BITS, POSTINGS, SlotSums, block_rows, documents_of, totals

#: Bytes of context.
DEPTH = 4
#: What stands before a text and after it.
EDGE = 0
FOLDS = 10
SMOOTHING = 0.1
#: Bytes whose contexts are counted or looked up at once.
AT_ONCE = 2 << 20
#: Grams of one group whose nodes are looked at together; those of three equal context bytes stay together.
GRAMS_AT_ONCE = 200_000
#: Bits of the hash by which a block finds most of its grams.
FIND_BITS = 21

GRAM_ROWS = "gram long, block long, n long"
UPPER_ROWS = "byte long, place long, zeros double, ones double, children double"
SCORE_ROWS = "gram long, score double"


# ---------------------------------------------------------------- estimates


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x > 0, by Stirling's series from x + 8 on."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    product = np.ones_like(y)
    for k in range(8):
        product *= x + k
    return series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the KT probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


# ---------------------------------------------------------------- nodes


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def places(grams: np.ndarray, k: int) -> np.ndarray:
    """Place of decision ``k`` of each gram's last byte, 1 to 255."""
    return (grams & np.uint64(255) | np.uint64(256)) >> np.uint64(8 - k)


def nodes_at(grams: np.ndarray, depth: int) -> np.ndarray:
    """Node of each gram's eight decisions at a depth, one row per decision."""
    context = (grams >> np.uint64(8) & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8)
    return np.stack([context | places(grams, k) for k in range(8)])


# ---------------------------------------------------------------- counting


def lowered_bytes(text: str) -> bytes:
    return text.encode().translate(LOWER)


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of every text and the end after it, each behind the ``DEPTH`` bytes before it, as one
    number; and where each text begins."""
    before, end = bytes([EDGE]) * DEPTH, bytes([EDGE])
    line = np.frombuffer(b"".join(before + t + end for t in texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) + np.repeat(DEPTH * np.arange(len(texts)), lengths)
    grams = np.zeros(len(at), np.uint64)
    for k in range(DEPTH + 1):
        grams = grams << np.uint64(8) | line[at + k].astype(np.uint64)
    return grams, starts


def chunks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, some megabytes at a time."""
    held, total = [], 0
    for t in texts:
        held.append(t)
        total += len(t)
        if total >= AT_ONCE:
            yield held
            held, total = [], 0
    if held:
        yield held


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, which = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(which, np.concatenate(counts), len(found)).astype(np.int64)


def store_blocks(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``flag`` with their ``block``, bucketed by it."""
    spark = docs.sparkSession

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, held = TaskContext.get().partitionId() << 20, 0, 0
        for b in batches:
            blocks = []
            for n in pc.binary_length(b.column(1)).to_pylist():
                blocks.append(block)
                size, held = size + n, held + 1
                if size >= BLOCK_BYTES or held == 1 << PLACE_BITS:
                    block, size, held = block + 1, 0, 0
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *b.columns], names=["block", "doc_id", "text", "flag"])

    rows = docs.select("doc_id", "text", "flag").mapInArrow(number, "block long, doc_id long, text string, flag boolean")
    path = fresh_path(spark, "texts")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "block").saveAsTable(name)
    return spark.table(name)


def gram_rows(blocks: DataFrame) -> DataFrame:
    """Per block its distinct grams, and how often its flagged texts have each."""

    def count(rows: pa.Table) -> pa.Table:
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for learning in (True, False):
            texts = rows.filter(rows["flag"] if learning else pc.invert(rows["flag"]))["text"]
            for chunk in chunks(lowered_bytes(t.as_py()) for t in texts):
                found, n = np.unique(grams_of(chunk)[0], return_counts=True)
                keys.append(found)
                counts.append(n * learning)
                if sum(map(len, keys)) > 2_000_000:
                    keys, counts = [[x] for x in _summed(keys, counts)]
        found, n = _summed(keys, counts)
        block = np.full(len(found), rows["block"][0].as_py())
        return pa.table([pa.array(found.view(np.int64)), pa.array(block), pa.array(n)], names=["gram", "block", "n"])

    return blocks.groupBy("block").applyInArrow(count, GRAM_ROWS)


# ---------------------------------------------------------------- weights


def _mixture(kt: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(kt, children) - np.log(2)


class _Lower:
    """The nodes of three and four context bytes below one node of two, slice by slice."""

    def __init__(self, grams: np.ndarray, times: np.ndarray):
        order = np.lexsort([grams, grams >> np.uint64(8) & np.uint64(0xFFFFFF)])
        self.grams, self.times = grams[order], times[order].astype(np.float64)
        three = self.grams >> np.uint64(8) & np.uint64(0xFFFFFF)
        firsts = np.flatnonzero(np.r_[True, three[1:] != three[:-1]])
        self.cuts = [0]
        for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(grams)]):
            if b - self.cuts[-1] > GRAMS_AT_ONCE and a > self.cuts[-1]:
                self.cuts.append(a)
        self.cuts.append(len(grams))

    def slices(self) -> Iterator[tuple]:
        """Slice of the grams; per depth from four up its distinct nodes, their zeros, ones, weighted value
        and share, and the node of each decision."""
        for a, b in zip(self.cuts, self.cuts[1:]):
            grams, times = self.grams[a:b], np.tile(self.times[a:b], 8)
            bit = np.concatenate([grams >> np.uint64(7 - k) & np.uint64(1) for k in range(8)]).astype(np.float64)
            out, children = [], None
            for depth in (4, 3):
                nodes, which = np.unique(nodes_at(grams, depth).ravel(), return_inverse=True)
                zeros, ones = (np.bincount(which, times * x, len(nodes)) for x in (1 - bit, bit))
                weighted = kt = log_kt(zeros, ones)
                share = np.ones(len(nodes))
                if children is not None:
                    above, below = children
                    weighted = _mixture(kt, np.bincount(np.searchsorted(nodes, above), below, len(nodes)))
                    share = np.exp(kt - np.log(2) - weighted)
                # The node above: the same place, the farthest context byte left out.
                up = nodes >> np.uint64(8) & np.uint64((1 << 8 * (depth - 1)) - 1)
                children = up << np.uint64(8) | nodes & np.uint64(255), weighted
                out.append((nodes, zeros, ones, weighted, share, which.reshape(8, -1)))
            yield slice(a, b), out

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Zeros, ones, weighted value and share of the node of two context bytes, by place."""
        zeros, ones, children = np.zeros(256), np.zeros(256), np.zeros(256)
        for _, (_, (nodes, z, o, weighted, _, _)) in self.slices():
            place = (nodes & np.uint64(255)).astype(np.int64)
            np.add.at(zeros, place, z)
            np.add.at(ones, place, o)
            np.add.at(children, place, weighted)
        kt = log_kt(zeros, ones)
        weighted = _mixture(kt, children)
        return zeros, ones, weighted, np.exp(kt - np.log(2) - weighted)


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


def upper_rows(grams: DataFrame) -> DataFrame:
    """Per two context bytes and place: counts and weighted value, for the node of the last ``byte``."""

    def weigh(rows: pa.Table) -> pa.Table:
        zeros, ones, weighted, _ = _Lower(rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy()).top()
        at = np.flatnonzero(zeros + ones > 0)
        byte = np.full(len(at), rows["gram"][0].as_py() >> 8 & 255)
        return pa.table([byte, at, zeros[at], ones[at], weighted[at]], names=["byte", "place", "zeros", "ones", "children"])

    return grams.groupBy(F.shiftright("gram", 8).bitwiseAND(0xFFFF).alias("two")).applyInArrow(weigh, UPPER_ROWS)


def upper_mixtures(rows: DataFrame) -> DataFrame:
    """``byte`` and ``mixture``: for each of its places ``a`` and ``b``, so that what the root and the byte's
    node make of an estimate x from below is a + b * x."""

    @F.pandas_udf("double")
    def own(zeros: pd.Series, ones: pd.Series) -> pd.Series:
        return pd.Series(log_kt(zeros.to_numpy(), ones.to_numpy()))

    half = F.log(F.lit(2.0))

    def level(below: DataFrame, *key: str) -> DataFrame:
        nodes = below.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "children")]).withColumn("kt", own("zeros", "ones"))
        larger, smaller = F.greatest("kt", "children"), F.least("kt", "children")
        nodes = nodes.withColumn("weighted", larger + F.log1p(F.exp(smaller - larger)) - half)
        one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
        return nodes.withColumn("share", F.exp(F.col("kt") - half - F.col("weighted"))).withColumn("one", one)

    of_byte = stored(level(rows, "byte", "place"), "nodes")
    root = level(of_byte.drop("children").withColumnRenamed("weighted", "children"), "place").select("place", F.col("share").alias("s"), F.col("one").alias("o"))
    a = F.col("s") * F.col("o") + (1 - F.col("s")) * F.col("share") * F.col("one")
    b = (1 - F.col("s")) * (1 - F.col("share"))
    # Places that the byte's node does not have: the root alone, and one half from below.
    ids = rows.sparkSession.range(1 << 16)
    every = ids.select(F.shiftright("id", 8).alias("byte"), F.col("id").bitwiseAND(255).alias("place")).join(root, "place")
    every = every.join(of_byte.select("byte", "place", "share", "one"), ["byte", "place"], "left")
    every = every.withColumn("share", F.coalesce("share", F.lit(0.0))).withColumn("one", F.coalesce("one", F.lit(0.5)))
    return every.groupBy("byte").agg(F.collect_list(F.struct("place", a.alias("a"), b.alias("b"))).alias("mixture"))


def gram_scores(grams: DataFrame, upper: DataFrame) -> DataFrame:
    """``gram`` and ``score``, the log10 probability of its last byte after those before it."""
    two = F.shiftright("gram", 8).bitwiseAND(0xFFFF).alias("two")
    # The mixture of its last byte for each pair of context bytes, of which there are at most 65 536.
    pairs = grams.select(two).distinct().withColumn("byte", F.col("two").bitwiseAND(255)).join(upper, "byte").select("two", "mixture")

    def mix(rows: pa.Table, above: pa.Table) -> pa.Table:
        a, b = np.zeros(256), np.ones(256)
        if above.num_rows:
            found = above["mixture"].combine_chunks().values
            place = found.field("place").to_numpy()
            a[place], b[place] = found.field("a").to_numpy(), found.field("b").to_numpy()
        lower = _Lower(rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy())
        zeros, ones, _, share = lower.top()
        seen = zeros + ones > 0
        own = np.where(seen, share, 0.0)
        a, b = a + b * own * _estimate(zeros, ones), b * (1 - own)
        scores = np.zeros(len(lower.grams))
        for part, levels in lower.slices():
            grams = lower.grams[part]
            for k in range(8):
                p = np.full(len(grams), 0.5)
                for _, z, o, _, share, which in levels:
                    at = which[k]
                    weight = np.where(z + o > 0, share, 0.0)[at]
                    p = weight * _estimate(z, o)[at] + (1 - weight) * np.where((z + o > 0)[at], p, 0.5)
                place = places(grams, k).astype(np.int64)
                p = a[place] + b[place] * np.where(seen[place], p, 0.5)
                one = (grams >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
                scores[part] += np.log10(np.where(one, p, 1 - p))
        return pa.table([lower.grams.view(np.int64), scores], names=["gram", "score"])

    grouped = grams.withColumn("two", two).groupBy("two")
    return grouped.cogroup(pairs.groupBy("two")).applyInArrow(mix, SCORE_ROWS)


class Found:
    """The scores of a block's grams."""

    def __init__(self, grams: np.ndarray, scores: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.scores = grams[order], scores[order]
        self.place = np.zeros(1 << FIND_BITS, np.int32)
        self.place[self._hash(self.grams)] = np.arange(len(grams))

    @staticmethod
    def _hash(grams: np.ndarray) -> np.ndarray:
        return (_mixed(grams) >> np.uint64(64 - FIND_BITS)).astype(np.int64)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Log10 probability of each text and its end."""
        out = [np.zeros(0)]
        for chunk in chunks(texts):
            grams, starts = grams_of(chunk)
            at = self.place[self._hash(grams)]
            missed = np.flatnonzero(self.grams[at] != grams)
            at[missed] = np.searchsorted(self.grams, grams[missed])
            out.append(np.add.reduceat(self.scores[at], starts))
        return np.concatenate(out)


# ---------------------------------------------------------------- scores


def fold(folds: int = FOLDS) -> Column:
    """crc32 of ``doc_id`` as text, modulo ``folds``; a null id is in fold 1."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)), F.lit(1))


def score(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (unigram words), ``score`` (context trees) and ``bits_per_byte``.

    Both models learn from every text that is not held out, with A-Z in lower case. The trees code the
    bytes and the end, which is a zero byte. A null or empty text is its end alone. A null id is not
    held out. Repeated rows count and are scored each. Without texts to learn from every decision has
    probability one half, and every token the probability of an unseen one.
    """
    blocks = store_blocks(corpus(docs).withColumn("flag", fold() != 0))
    in_blocks = stored(gram_rows(blocks), "block-grams")
    grams = stored(in_blocks.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    scores = gram_scores(grams, upper_mixtures(upper_rows(grams)))

    def words(texts: pa.Table, known: pa.Table) -> pa.Table:
        data = [lowered_bytes(t) for t in texts["text"].to_pylist()]
        values = Found(known["gram"].to_numpy().view(np.uint64), known["score"].to_numpy()).score(data)
        ids, flags = texts["doc_id"].to_pylist(), texts["flag"].to_pylist()
        split = ((i, len(t), t.split(), v, f) for i, t, v, f in zip(ids, data, values.tolist(), flags))
        return pa.Table.from_batches(block_rows(texts["block"][0].as_py(), split))

    sent = in_blocks.select("gram", "block").join(stored(scores, "scores"), "gram").groupBy("block")
    found = stored(blocks.groupBy("block").cogroup(sent).applyInArrow(words, POSTINGS), "words")
    terms = found.filter("term is not null").select("term", "block", "places", "times", "n_flagged")
    known = stored(terms.groupBy("term").agg(F.sum("n_flagged").alias("c")), "counts")
    documents = documents_of(found)
    ends, train_words = documents.filter("flag").agg(F.count("*"), F.sum("n_terms")).first()
    n = ends + (train_words or 0)
    distinct = known.filter("c > 0").count() + (ends > 0)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = SlotSums(2)

        for b in batches:
            c = b.column(3).to_numpy().astype(np.float64)
            sums.add(b.column(0).to_numpy(), b.column(1), b.column(2), np.log10(c + SMOOTHING), (c > 0).astype(np.float64))
            if sums.full():
                yield sums.take()
        yield sums.take()

    joined = terms.select("term", "block", "places", "times").join(known, "term").select("block", "places", "times", "c")
    parts = joined.mapInArrow(add, PARTIAL)
    summed = totals(parts.unionByName(documents, allowMissingColumns=True), 2)
    tokens = F.col("n_terms") + 1
    whole = float(np.log10(n + SMOOTHING * (distinct + 1)))
    return summed.select(
        "doc_id",
        (~F.col("flag")).alias("held_out"),
        tokens.alias("n_tokens"),
        (F.round("sum1").cast("long") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("sum0") + F.lit(float(np.log10(ends + SMOOTHING))) - tokens * F.lit(whole)).alias("base_score"),
        F.col("value").alias("score"),
        (-F.col("value") * F.lit(float(np.log2(10))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
