"""Top documents of each item, by masks of the terms present.

Documents are read once for each block of items: what is kept of a text is its length and, for terms of those items,
how often each occurs. A task then takes some thousand documents at a time. For an item it posts a bit for each of its
terms into the masks of the documents that hold it and groups them by mask. No document scores more than the sum of the
terms of its mask, each at the best that any document here reaches with it. Masks are evaluated by falling bound, until
the next bound is below the twentieth score so far, in this group or in one before it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerlake.llm.bpe import slices
from offerlake.llm.common import tidy, written

TOP = 20
ITEM_CHARS = 4_000_000  # of item texts that one pass over the documents holds in memory
TOGETHER = 8192  # documents that are grouped by mask at once
POSTINGS = 2_000_000  # and terms of theirs, at most
SCALE, FLAT, SHARE = 1000, 75, 25  # of a weight; of a document's m: its fixed part and the part that grows with its length
GAIN, HALF = 12, 1_000_000_000
WORD = 63  # terms in one word of a mask
LAST = np.iinfo(np.int64).max  # a null id, after all others

# Bytes of a text: A-Z to lower case, other ASCII than letters and digits to blanks, all of other characters as they are.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FOUND = "item long, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and other characters, A-Z lower-cased, as UTF-8; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()


def item_blocks(items: DataFrame, chars: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items (item_id, text) in blocks of about `chars` characters; one at a time is held in the driver."""
    block, size = [], 0
    for item, text in items.toLocalIterator(prefetchPartitions=False):
        block.append((item, terms(text)))
        size += len(text or "")
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def occurrences(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text), term (numbers of known ones) and times, of texts with a term; written."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                ids, lengths, term, times = [], [], [], []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words = terms(text)
                    if words:
                        own = {numbers[w]: k for w, k in Counter(words).items() if w in numbers}
                        ids.append(doc)
                        lengths.append(len(words))
                        term.append(list(own))
                        times.append(list(own.values()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "n", "term", "times"])

    return written(docs.mapInArrow(tidy(run), "doc_id long, n long, term array<int>, times array<long>"), "occurrences")


class Documents:
    """Some documents: their terms in a row, what each occurrence gains, and the documents of each term."""

    def __init__(self, batch: pa.RecordBatch, n_terms: int, count: int, total: int):
        self.ids = batch.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
        m = np.array([FLAT + SHARE * n * count // total for n in batch.column("n").to_pylist()], np.int64)
        term = batch.column("term")
        self.ends = np.concatenate([[0], np.cumsum(term.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.term = term.flatten().to_numpy(zero_copy_only=False)
        times = batch.column("times").flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.ends))
        self.gain = HALF * times // (SCALE * times + GAIN * m[owner])
        order = np.argsort(self.term, kind="stable")
        self.posted = owner[order]
        self.first = np.searchsorted(self.term[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, self.term, self.gain)

    def masks(self, own: np.ndarray) -> np.ndarray:
        """A row of mask words for each document."""
        out = np.zeros((len(self.ids), -(-len(own) // WORD)), np.int64)
        for k, t in enumerate(own):
            out[self.posted[self.first[t] : self.first[t + 1]], k // WORD] |= np.int64(1) << np.int64(k % WORD)
        return out

    def scores(self, docs: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Exact scores of documents; value: of each term, for this item."""
        sizes = self.ends[docs + 1] - self.ends[docs]
        begins = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) - np.repeat(begins - self.ends[docs], sizes)
        return np.add.reduceat(value[self.term[at]] * self.gain[at], begins)


def bounds(masks: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each mask the sum of its terms' best values: eight bits at a time are looked up."""
    out = np.zeros(len(masks), np.int64)
    bits = np.arange(256)[:, None] >> np.arange(8) & 1
    for word in range(masks.shape[1]):
        for byte in range(8):
            at = word * WORD + 8 * byte
            own = most[at : min(at + 8, (word + 1) * WORD)]
            if len(own):
                out += (bits[:, : len(own)] @ own)[masks[:, word] >> np.int64(8 * byte) & 255]
    return out


class Best:
    """The best documents of an item so far, best first."""

    def __init__(self, size: int):
        self.size, self.ids, self.scores = size, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a score has to reach; equal ones may still come first by their ids."""
        return int(self.scores[-1]) if len(self.scores) == self.size else 1

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least
        ids, scores = np.concatenate([self.ids, ids[good]]), np.concatenate([self.scores, scores[good]])
        order = np.lexsort((ids, -scores))[: self.size]
        self.ids, self.scores = ids[order], scores[order]


def search(docs: Documents, own: np.ndarray, worth: np.ndarray, value: np.ndarray, best: Best) -> None:
    """One item over some documents. own: its terms; worth: their weights times their repeats; value: worth by term."""
    masks = docs.masks(own)
    some = np.flatnonzero(masks.any(axis=1))
    if not len(some):
        return
    if masks.shape[1] == 1:
        groups, of = np.unique(masks[some, 0], return_inverse=True)
        groups = groups[:, None]
    else:
        groups, of = np.unique(masks[some], axis=0, return_inverse=True)
    bound = bounds(groups, worth * docs.most[own])
    order = np.argsort(-bound, kind="stable")
    members = some[np.argsort(of.ravel(), kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.bincount(of.ravel(), minlength=len(groups)))])
    at, step = 0, 1
    while at < len(order) and bound[order[at]] >= best.least:
        now = [g for g in order[at : at + step] if bound[g] >= best.least]
        chosen = np.concatenate([members[ends[g] : ends[g + 1]] for g in now])
        best.add(docs.ids[chosen], docs.scores(chosen, value))
        at, step = at + step, min(step * 2, 256)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of a batch with at most TOGETHER documents and, but for single ones, POSTINGS terms."""
    sizes = batch.column("term").value_lengths().to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for k, size in enumerate(sizes):
        if k > begin and (k - begin == TOGETHER or held + size > POSTINGS):
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += int(size)
    if len(sizes) > begin:
        yield batch.slice(begin)


def found_in(occurring: DataFrame, items: list[list[bytes]], known: dict[bytes, int], weights: np.ndarray, count: int, total: int, top: int) -> DataFrame:
    """FOUND: each task's best documents for each item (its place in the list)."""
    queries = []
    for words in items:
        own = Counter(known[w] for w in words)
        own = {t: k * int(weights[t]) for t, k in own.items() if weights[t] > 0}
        queries.append((np.array(list(own), np.int64), np.array(list(own.values()), np.int64)))
    shared = occurring.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in shared.value]
        value = np.zeros(len(weights), np.int64)
        for batch in batches:
            for piece in pieces(batch):
                docs = Documents(piece, len(weights), count, total)
                for (own, worth), held in zip(shared.value, best, strict=True):
                    if len(own):
                        value[own] = worth
                        search(docs, own, worth, value, held)
                        value[own] = 0
        item = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        ids = np.concatenate([np.zeros(0, np.int64), *(b.ids for b in best)])
        ids = pa.array(ids, pa.int64(), mask=ids == LAST)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), ids, pa.array(np.concatenate([np.zeros(0, np.int64), *(b.scores for b in best)]), pa.int64())], names=["item", "doc_id", "score"])

    return occurring.mapInArrow(tidy(run), FOUND)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, chars: int = ITEM_CHARS) -> DataFrame:
    """The `top` best rows of `docs` (doc_id, text) for each row of `items` (item_id, text): item_id, rank, doc_id, score.

    Rows of `docs` that repeat are documents of their own, rows of `items` that repeat items of their own with equal
    answers. Equal scores go by doc_id, null last. A null or empty text has no terms: such a document is never found, such
    an item finds nothing. Without documents that have terms there are no rows. Other columns aren't read.

    Items go to every task in blocks of `chars` characters, so any number of them may be asked; the documents are read
    once for each block. Only counts of the items' own terms go through the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in item_blocks(items.select(F.col("item_id").cast("long"), "text"), chars):
        known = {w: k for k, w in enumerate(dict.fromkeys(w for _, words in block for w in words))}
        occurring = occurrences(docs, known)
        count, total = occurring.agg(F.count("*"), F.sum("n")).first()
        held = dict(occurring.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*")).collect())  # at most one row for each term of the items
        weights = np.array([math.floor(SCALE * math.log((2 * count + 2) / (2 * held.get(k, 0) + 1))) for k in range(len(known))], np.int64)
        names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(block)], "item long, item_id long")
        rows = found_in(occurring, [words for _, words in block], known, weights, count, total or 1, top)
        by = (F.desc("score"), F.asc_nulls_last("doc_id"))
        spread = W.partitionBy("item", "__part").orderBy(*by)  # many tasks' rows first in parts
        rows = rows.withColumn("__part", F.spark_partition_id() % 64).withColumn("__n", F.row_number().over(spread)).where(F.col("__n") <= top)
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*by))).where(F.col("rank") <= top)
        rows = written(rows.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
        out = rows if out is None else out.unionAll(rows)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all `documents` for each `benchmark` item, with ranks from 1; cases as in `ranked_search`."""
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), d AS (SELECT *, len(words) AS n FROM w WHERE len(words) > 0
), total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d
), tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1
), q AS (
  SELECT i, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), s AS (
  SELECT i, item_id, doc_id, r, sum(times * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN d USING (r), total GROUP BY ALL
), x AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM x WHERE rank <= 20
"""
