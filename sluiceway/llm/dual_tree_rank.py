"""Ranked lexical search by a dual tree.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. A document is a vector over the
terms of the items: saturated term frequencies, scaled to whole numbers; an item is the vector of its terms' weights; a score is their
product. Rows of documents are ordered by their heaviest terms and put into a tree whose nodes hold the largest coordinate of
each term below them, and items likewise. The largest score that any document of one node can have with any item of another is at
most the product of the nodes' maxima. The search walks pairs of nodes, best bound first, and drops a pair, with all its items and
documents, where its bound is below the weakest kth score found so far of the node's items. Nothing else is dropped, so the result is exact.

Items are taken in blocks of bounded bytes, whose terms are sent to the tasks; a block meets all documents. Each task searches its own documents, a bounded
shard at a time, and returns at most k rows an item; these lists are merged in two rounds. Document vectors are stored in the shared folder
once they are made. Texts are not shuffled.

Sums are whole numbers below 2**53, so float64 products are exact: a weight is below 2**16 and a coordinate below 2**20, which leaves room for 2**17 terms an
item; items of more terms are summed in whole numbers.

Defined cases: a null or empty text has no terms; such a document is never found and counts nowhere, such an item finds nothing. Repeated rows of documents
are documents of their own. Item rows that share an id are one item with the terms of all of them. Equal scores go to the smaller id, null ids last. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import utf8
from sluiceway.session import cut

K = 50
ITEM_BYTES = 4 << 20  # of the items whose terms are sent to the tasks at once
ITEMS_AT_ONCE = 256  # items of one tree
SHARD = 8192  # documents of one tree
LEAF, FAN = 16, 4  # documents of a leaf, children of a node
ITEM_LEAF = 4
LISTS = 64  # tasks whose lists are merged in the first round
EXACT_TERMS = 2**17
# Fixed values of the score.
FOLD = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
SLOPE, SCALE, FLAT, LONG = 20, 10**9, 50, 50


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def tree(rows: np.ndarray, leaf: int, fan: int) -> list[np.ndarray]:
    """Coordinate maxima of the nodes, a level at a time from the leaves to one root."""
    levels = [np.maximum.reduceat(rows, np.arange(0, len(rows), leaf), axis=0)]
    while len(levels[-1]) > 1:
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), fan), axis=0))
    return levels


class Best:
    """The k best documents of every item met so far."""

    def __init__(self, n: int, k: int):
        self.k, self.kth = k, np.zeros(n)
        self.scores, self.ids = [np.empty(0)] * n, [np.empty(0, np.int64)] * n
        self.nulls = [np.empty(0, bool)] * n

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        scores, ids, nulls = np.r_[self.scores[item], scores], np.r_[self.ids[item], ids], np.r_[self.nulls[item], nulls]
        order = np.lexsort((ids, nulls, -scores))[:self.k]
        self.scores[item], self.ids[item], self.nulls[item] = scores[order], ids[order], nulls[order]
        if len(order) == self.k:
            self.kth[item] = scores[order[-1]]


class Items:
    """A bounded number of items, their tree, and the terms that they use."""

    def __init__(self, numbers: list[int], own: list[list[int]], weights: np.ndarray):
        self.numbers, self.columns = numbers, np.unique(np.concatenate([np.asarray(t, np.int64) for t in own]))
        self.rows = np.zeros((len(own), len(self.columns)))
        for row, found in zip(self.rows, own):
            at = np.searchsorted(self.columns, found)
            row[at] = weights[self.columns[at]]
        self.levels = tree(self.rows, ITEM_LEAF, FAN)
        self.exact = max(map(len, own)) <= EXACT_TERMS


def search(items: Items, ids: np.ndarray, nulls: np.ndarray, start: np.ndarray, columns: np.ndarray, values: np.ndarray, best: Best) -> None:
    """Bring ``best`` up to date with documents start[d]:start[d + 1] of columns and values, in the order given."""
    n = len(ids)
    at = np.searchsorted(items.columns, columns)
    at[at == len(items.columns)] = 0
    mine = items.columns[at] == columns
    owner = np.repeat(np.arange(n), np.diff(start))[mine]
    at, values, width = at[mine], values[mine], len(items.columns)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    leaves = np.zeros((-(-n // LEAF), width))
    np.maximum.at(leaves.reshape(-1), owner // LEAF * width + at, values)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN), axis=0))
    numbers = np.array(items.numbers)
    spans = [ITEM_LEAF * FAN**level for level in range(len(items.levels))]
    held: list = [None, None]

    def leaf_rows(leaf: int) -> np.ndarray:
        if held[0] != leaf:
            first, last = leaf * LEAF, min(n, leaf * LEAF + LEAF)
            part = slice(bounds[first], bounds[last])
            rows = np.zeros((last - first, width))
            rows[owner[part] - first, at[part]] = values[part]
            held[:] = leaf, rows
        return held[1]

    def weakest(level: int, node: int) -> float:
        return best.kth[numbers[node * spans[level]:(node + 1) * spans[level]]].min()

    todo = [(math.inf, len(levels) - 1, 0, len(items.levels) - 1, 0)]
    while todo:
        bound, level, node, item_level, item_node = todo.pop()
        if bound < weakest(item_level, item_node) or bound == 0:
            continue
        if level == 0 and item_level == 0:
            first = node * LEAF
            some = slice(item_node * ITEM_LEAF, item_node * ITEM_LEAF + ITEM_LEAF)
            if items.exact:
                scores = leaf_rows(node) @ items.rows[some].T
            else:
                scores = np.array([[sum(int(x) * int(y) for x, y in zip(d, i) if x and y) for i in items.rows[some]] for d in leaf_rows(node)], np.float64)
            for k, item in enumerate(numbers[some].tolist()):
                good = np.flatnonzero((scores[:, k] >= best.kth[item]) & (scores[:, k] > 0))
                if len(good):
                    best.add(item, scores[good, k], ids[first + good], nulls[first + good])
            continue
        own = slice(node * FAN, node * FAN + FAN) if level else slice(node, node + 1)
        other = slice(item_node * FAN, item_node * FAN + FAN) if item_level else slice(item_node, item_node + 1)
        below, item_below = max(0, level - 1), max(0, item_level - 1)
        pairs = levels[below][own] @ items.levels[item_below][other].T
        for flat in np.argsort(pairs, axis=None).tolist():  # the last one pushed is the next one popped
            d, i = divmod(flat, pairs.shape[1])
            todo.append((pairs[d, i], below, own.start + d, item_below, other.start + i))


def vectors(docs: DataFrame, vocabulary, key: str, text: str) -> DataFrame:
    """(doc_id, n, term, tf) of the documents with a term: all their terms counted, those of the vocabulary listed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {word: i for i, word in enumerate(vocabulary.value)}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms(data.as_buffer().to_pybytes())
                if words:
                    counts = Counter(words)
                    hits = sorted((number[w], counts[w]) for w in counts.keys() & number.keys())
                    for column, value in zip(out, (doc, len(words), [h for h, _ in hits], [n for _, n in hits])):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "n", "term", "tf"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("text")).mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


def holders(found: DataFrame, n_terms: int) -> np.ndarray:
    """Number of documents that hold each term; summed up in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for row in found.select("term").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.term] = row.n  # one row a term of the item block
    return out


def _rank_block(docs: DataFrame, block: list, key: str, text: str, k: int) -> DataFrame:
    """(item, doc_id, score): the lists of the tasks. ``block``: sets of terms."""
    context = docs.sparkSession.sparkContext
    words = sorted(set().union(*block))
    number = {word: i for i, word in enumerate(words)}
    found = cut(vectors(docs, context.broadcast(words), key, text))
    n_docs, length = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    own = [sorted(number[w] for w in x) for x in block]
    weights = np.array([weight(int(df), n_docs) for df in holders(found, len(words))], np.float64)
    # Items with the same rare terms are neighbours in the tree.
    order = sorted((i for i, x in enumerate(own) if x), key=lambda i: sorted(((-weights[t], t) for t in own[i])))
    sent = context.broadcast((own, weights, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights, order = sent.value
        trees = [Items(order[at:at + ITEMS_AT_ONCE], [own[i] for i in order[at:at + ITEMS_AT_ONCE]], weights) for at in range(0, len(order), ITEMS_AT_ONCE)]
        best, waiting = Best(len(own), k), []

        def shard() -> None:
            table = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            n, lists = table["n"].to_numpy(), table["term"].combine_chunks()
            term, tf = lists.flatten().to_numpy().astype(np.int64), table["tf"].combine_chunks().flatten().to_numpy().astype(np.int64)
            size = np.diff(lists.offsets.to_numpy())
            m = 100 - FLAT + (LONG * n * n_docs) // length
            value = (SCALE * tf) // (1000 * tf + SLOPE * np.repeat(m, size))
            doc = np.repeat(np.arange(len(n)), size)
            heavy = np.lexsort((term, -weights[term] * value, doc))
            first, two = np.searchsorted(doc, np.arange(len(n))), np.full((2, len(n)), -1)
            for place in (0, 1):  # the two heaviest terms of each document
                has = size > place
                two[place, has] = term[heavy[first[has] + place]]
            rows = np.lexsort((n, two[1], two[0]))
            take = np.argsort(np.argsort(rows)[doc], kind="stable")
            ids = table["doc_id"]
            nulls, ids = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
            for items in trees:
                search(items, ids[rows], nulls[rows], np.r_[0, np.cumsum(size[rows])], term[take], value[take].astype(np.float64), best)

        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                waiting.append(batch.slice(at, SHARD))
                if sum(b.num_rows for b in waiting) >= SHARD:
                    shard()
        if waiting:
            shard()
        sizes = [len(s) for s in best.scores]
        none = np.concatenate([np.empty(0, bool), *best.nulls])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *best.ids]), pa.int64(), mask=none),
            pa.array(np.concatenate([np.empty(0), *best.scores]).astype(np.int64), pa.int64())], names=["item", "doc_id", "score"])

    return found.where(F.size("term") > 0).mapInArrow(run, "item int, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
         item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_key).cast("long").alias("id"), utf8(item_text).alias("text"))
    blocks = -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 1) // item_bytes)
    out = None
    for number in range(blocks):
        block: dict = {}
        for row in asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toLocalIterator():  # about item_bytes
            block.setdefault(row.id, set()).update(terms(bytes(row.text)))
        if not any(block.values()):
            continue
        lists = _rank_block(docs, list(block.values()), key, text, k).withColumn("part", (F.spark_partition_id() / LISTS).cast("int"))
        for group in (["item", "part"], ["item"]):
            best = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block)), "item int, item_id long")
        ranked = lists.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionAll(ranked)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
