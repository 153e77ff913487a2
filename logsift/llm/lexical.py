"""Ranked lexical search: posting lists in blocks of similar documents, with coordinatewise-maximum summaries.

One scan keeps of every document its length and how often it holds each term of the query set (its row of a forward index), and the
statistics of the whole corpus come from there. The index is then searched as it lies, in slices of ``ROWS`` documents. In a slice, the
documents of every term are clustered by similarity, that is by projections of their term vectors, into blocks of about ``BLOCK``; a
block's summary is the largest value of each coordinate among its documents. A query's product with a summary bounds the score of every
document in the block. A document is scored exactly unless a block that holds it stays below the query's current k-th score, which is a
score that k documents reach: it comes from a first search of a sample and rises with what a task finds. So the result is exact.

Queries are taken in blocks of a bounded size (``pass_bytes``), which is what is collected and broadcast at a time, one pass over the
documents each; in a slice, queries are grouped so that their joint vocabulary stays about ``GROUP_TERMS``. A usual benchmark is one pass.

Defined results: null texts have no term; a document without a term is not counted, an item without one finds nothing. Items of one text
are all answered. Repeated rows are documents of their own. Ties go to the smaller ``doc_id``, null last. Scores are whole numbers and
exact below 2^63. Empty tables give no row. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsift.llm.common import slices, texts_of
from logsift.scratch import saved

ROWS, BLOCK, GROUP_TERMS = 2048, 64, 2048
CELLS = 1 << 23  # of a slice's matrix and of the summaries held at a time
ENTRIES = 1 << 20
SAMPLE = 64
# Runs of digits, ASCII letters and everything above ASCII are terms.
SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
INDEX = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
FOUND = "query int, doc_id bigint, score bigint"


def terms_of(text: bytes) -> list[bytes]:
    return text.lower().translate(SPACED).split()


def forward_index(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, counts`` of every document with a term: all its terms counted, those of the vocabulary by number."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def indexed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        numbers = {t: k for k, t in enumerate(shared.value)}
        for batch in slices(batches, 256):
            ids, lengths, terms, counts, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
                words = terms_of(text)
                if words:
                    held = Counter(words)
                    known = sorted((numbers[t], held[t]) for t in held.keys() & numbers.keys())
                    ids.append(doc_id)
                    lengths.append(len(words))
                    terms.extend(t for t, _ in known)
                    counts.extend(c for _, c in known)
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(rows.mapInArrow(indexed, INDEX), "forward-index")


def projection(terms: int, width: int = 16) -> np.ndarray:
    """A fixed direction for each term, for comparing documents."""
    return np.random.default_rng(terms).standard_normal((terms, width)).astype(np.float32)


class Slice:
    """Documents of a slice as a matrix of the values ``(10^9 tf) div (1000 tf + 8 m)``, over the terms that they hold."""

    def __init__(self, ids, null, lengths, ends, terms, counts, documents: int, all_terms: int) -> None:
        self.ids, self.null = ids, null
        m = 25 + (75 * lengths * documents) // all_terms
        row = np.repeat(np.arange(len(ids)), np.diff(ends))
        tf = counts.astype(np.int64)
        values = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        self.row, self.terms, self.values = row, terms, values.astype(np.int32)


class Lists:
    """Posting lists of some terms in a slice, each in blocks of similar documents."""

    def __init__(self, part: Slice, wanted: np.ndarray, weights: np.ndarray) -> None:
        at = np.searchsorted(wanted, part.terms)
        at[at == len(wanted)] = 0
        held = wanted[at] == part.terms if len(wanted) else np.zeros(len(part.terms), dtype=bool)
        columns, self.column = np.unique(at[held], return_inverse=True)
        self.terms = wanted[columns]  # the terms that occur here
        self.row, self.value = part.row[held], part.values[held]
        self.matrix = np.zeros((len(part.ids), len(columns)), dtype=np.int32)
        self.matrix[self.row, self.column] = self.value
        self.ends = np.searchsorted(self.row, np.arange(len(part.ids) + 1))
        shape = self.matrix.astype(np.float32) * weights[self.terms].astype(np.float32)
        sketch = shape @ projection(len(columns))
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        order = np.argsort(self.column, kind="stable")
        self.by_term = self.row[order]
        self.list_ends = np.searchsorted(self.column[order], np.arange(len(columns) + 1))

    def clustered(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """A list's documents in the order of their blocks, and where the blocks begin."""
        docs = self.by_term[self.list_ends[term] : self.list_ends[term + 1]]
        n = -(-len(docs) // BLOCK)
        if n == 1:
            return docs, np.zeros(1, dtype=np.int64)
        centres = docs[(np.arange(n) * len(docs)) // n]
        near = (self.sketch[docs] @ self.sketch[centres].T).argmax(axis=1)
        order = np.argsort(near, kind="stable")
        return docs[order], np.flatnonzero(np.diff(near[order], prepend=-1))

    def summaries(self, docs: np.ndarray, block: np.ndarray, blocks: int) -> np.ndarray:
        """The largest value of each coordinate among the documents of every block."""
        width = len(self.terms)
        most = np.zeros(blocks * width, dtype=np.int32)
        size = np.diff(self.ends)[docs]
        upto = np.cumsum(size)
        first = 0
        while first < len(docs):  # so many entries at a time
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + ENTRIES, "right")))
            n = size[first:last]
            entry = np.repeat(self.ends[docs[first:last]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            np.maximum.at(most, np.repeat(block[first:last] * width, n) + self.column[entry], self.value[entry])
            first = last
        return most.reshape(blocks, width)


class Search:
    """The k best documents of each query so far, and the score that the next must reach."""

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, least: np.ndarray, k: int) -> None:
        self.queries, self.weights, self.least, self.k = queries, weights, least.copy(), k
        self.best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)) for _ in queries]
        self.scored = 0
        self.groups: list[tuple[list[int], np.ndarray]] = []
        group: list[int] = []
        held: set[int] = set()
        for q, (terms, _) in enumerate(queries):
            wide = held | set(terms.tolist())
            if group and len(wide) > GROUP_TERMS:
                self.groups.append((group, np.array(sorted(held), dtype=np.int64)))
                group, wide = [], set(terms.tolist())
            group.append(q)
            held = wide
        if group:
            self.groups.append((group, np.array(sorted(held), dtype=np.int64)))

    def add(self, q: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (np.concatenate(x) for x in zip(self.best[q], (score, ids, null), strict=True))
        kept = np.lexsort((ids, null, -score))[: self.k]
        self.best[q] = score[kept], ids[kept], null[kept]
        if len(kept) == self.k:
            self.least[q] = max(self.least[q], score[kept[-1]])

    def slice(self, part: Slice) -> None:
        for group, wanted in self.groups:
            lists = Lists(part, wanted, self.weights)
            if len(lists.terms):
                self._group(part, lists, group)

    def _group(self, part: Slice, lists: Lists, group: list[int]) -> None:
        width = len(lists.terms)
        columns, factors = {}, {}
        for q in group:
            terms, times = self.queries[q]
            at = np.searchsorted(lists.terms, terms)
            at[at == width] = 0
            here = lists.terms[at] == terms
            columns[q], factors[q] = at[here], (times * self.weights[terms])[here]
        upper = {q: np.full(len(part.ids), np.iinfo(np.int64).max) for q in group if len(columns[q])}
        asked: dict[int, list[int]] = {}
        for q in upper:
            for c in columns[q].tolist():
                asked.setdefault(c, []).append(q)
        met = {q: np.zeros(len(part.ids), dtype=bool) for q in upper}

        # Lists are taken so many at a time that their summaries stay small; a block bounds all its documents for every query.
        todo = [(c, *lists.clustered(c)) for c in sorted(asked)]
        while todo:
            some, cells = [], 0
            while todo and (not some or cells + len(todo[0][2]) * width <= CELLS):
                some.append(todo.pop(0))
                cells += len(some[-1][2]) * width
            starts = np.cumsum([0] + [len(s) for _, _, s in some])
            docs = np.concatenate([d for _, d, _ in some])
            sizes = [np.diff(np.append(s, len(d))) for _, d, s in some]
            block = np.repeat(np.arange(starts[-1]), np.concatenate(sizes))
            summary = lists.summaries(docs, block, int(starts[-1]))
            for (c, listed, _), first, last, size in zip(some, starts[:-1], starts[1:], sizes, strict=True):
                for q in asked[c]:
                    bound = summary[first:last][:, columns[q]] @ factors[q]
                    upper[q][listed] = np.minimum(upper[q][listed], np.repeat(bound, size))
                    met[q][listed] = True

        for q, bound in upper.items():
            reach = np.flatnonzero(met[q] & (bound >= max(self.least[q], 1)))
            reach = reach[np.argsort(-bound[reach], kind="stable")]
            at = 0
            while at < len(reach) and bound[reach[at]] >= self.least[q]:
                rows = reach[at : at + 4 * BLOCK]
                rows = rows[bound[rows] >= self.least[q]]
                score = lists.matrix[np.ix_(rows, columns[q])] @ factors[q]
                self.scored += len(rows)
                good = score >= max(self.least[q], 1)  # a tie may have a smaller id
                if good.any():
                    self.add(q, score[good], part.ids[rows[good]], part.null[rows[good]])
                at += 4 * BLOCK


def searched(index: DataFrame, model: tuple, k: int) -> DataFrame:
    """``query, doc_id, score``: the k best documents of each query in every task that reads the index."""
    shared = index.sparkSession.sparkContext.broadcast(model)

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        queries, weights, least, documents, all_terms = shared.value
        search = Search(queries, weights, least, k)
        for batch in slices(batches, ROWS):
            terms = batch.column("terms")
            ends = np.asarray(terms.offsets) - terms.offsets[0].as_py()
            numbers = [np.asarray(batch.column(c).flatten()).astype(np.int64) for c in ("terms", "counts")]
            ids = batch.column("doc_id")
            rows = len(ids)
            known = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), np.asarray(batch.column("n"))
            step = max(1, min(rows, CELLS // max(1, len(np.unique(numbers[0])))))
            for first in range(0, rows, step):
                last = min(rows, first + step)
                here = slice(ends[first], ends[last])
                search.slice(Slice(*(x[first:last] for x in known), ends[first : last + 1] - ends[first], numbers[0][here], numbers[1][here], documents, all_terms))
        rows = [(q, *x) for q, (score, ids, null) in enumerate(search.best) for x in zip(ids.tolist(), null.tolist(), score.tolist(), strict=True)]
        columns = [[q for q, *_ in rows], [None if gone else i for _, i, gone, _ in rows], [s for *_, s in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["query", "doc_id", "score"])

    return index.mapInArrow(found, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, pass_bytes: int = 4 << 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``item_id, text`` its k best documents of ``doc_id, text``."""
    spark = docs.sparkSession
    named = saved(items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), F.sha2(F.col("text").cast("binary"), 256).alias("key")), "items")
    texts = saved(named.groupBy("key").agg(F.min("text").alias("text")), "item-texts")
    size = texts.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    passes = -(-size // pass_bytes)
    found = spark.createDataFrame([], "key string, rank int, doc_id bigint, score bigint")
    for number in range(passes):
        part = texts.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == number).collect()
        found = found.union(_one_pass(docs, [(r["key"], r["text"]) for r in part], k))
    found = saved(found, "ranked")
    return named.join(found, "key").select("item_id", "rank", "doc_id", "score")


def _one_pass(docs: DataFrame, items: list[tuple[str, str]], k: int) -> DataFrame:
    spark = docs.sparkSession
    bags = [Counter(terms_of(text.encode())) for _, text in items]
    vocabulary = sorted(set().union(*bags))
    numbers = {t: n for n, t in enumerate(vocabulary)}
    index = forward_index(docs, vocabulary)
    totals = index.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("all_terms")).first()
    # At most a row for each term of the queries comes back.
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[row["term"]] = row["count"]
    documents, all_terms = totals["n"], totals["all_terms"] or 1
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    queries = []
    for bag in bags:
        held = sorted((numbers[t], n) for t, n in bag.items())
        queries.append((np.array([t for t, _ in held], dtype=np.int64), np.array([n for _, n in held], dtype=np.int64)))

    def model(least: np.ndarray) -> tuple:
        return queries, weights, least, documents, all_terms

    nothing = np.zeros(len(queries), dtype=np.int64)
    first = best(searched(index.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SAMPLE)) == 0), model(nothing), k), k)
    least = nothing.copy()
    for row in first.where(F.col("rank") == k).collect():
        least[row["query"]] = row["score"]
    keys = spark.createDataFrame([(n, key) for n, (key, _) in enumerate(items)], "query int, key string")
    return best(searched(index, model(least), k), k).join(F.broadcast(keys), "query").select("key", "rank", "doc_id", "score")
