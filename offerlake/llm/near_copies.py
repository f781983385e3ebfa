"""N-gram Jaccard join by a MinHash LSH forest.

A text is its set of five-word shingles; texts with one set are copies and form a class. A class has a signature: in each
of several tries a row of MinHash values, sorted into the trie by its prefixes. Classes that share a node are candidates;
they are verified by the exact Jaccard similarity of their sets, block against block where a node is large. The join
starts with the deepest nodes and shortens the matched prefix by two values at a time. After each depth the similarities of
the pairs found so far tell how many links the tries have missed at that depth; once these are few enough for the target
recall, it ends. No prefix gets shorter than what finds a pair just at the threshold with that recall.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.bpe import slices
from offerlake.llm.common import extended, mixed, prefix_hashes, tidy, unused, written
from offerlake.llm.decontaminate import normalised

WORDS = 5
THRESHOLD = 0.8
TRIES, DEEPEST, STEP = 20, 8, 2  # values of the deepest prefix, and by how many it is shortened
RECALL = 0.9999  # of all links, as the pairs found let one expect
UNSEEN = 3  # links just at the threshold that may be there though none was found (at 95 %: the rule of three)
BINS = 20  # of the similarities found
BLOCK = 1024  # classes of a trie node that are held together, about
COLUMNS = 2048  # shingles that a block's matrix has at once


def chance(similarity: float, depth: int, tries: int = TRIES) -> float:
    """That two sets share a prefix of this length in some trie."""
    return 1 - (1 - similarity**depth) ** tries


def shallowest(threshold: float, tries: int = TRIES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The longest prefix that finds a pair just at the threshold with this recall; no shorter one is needed."""
    return next((d for d in range(deepest, 1, -1) if chance(threshold, d, tries) >= recall), 1)


def missed(found: list[int], threshold: float, depth: int, tries: int = TRIES) -> float:
    """Expected number of links that share no prefix of this length, from those found by bins of similarity: each stands
    for 1 / chance links. A bin counts with its lower end, and some links at the threshold are always added."""
    seen = [(UNSEEN, threshold), *((n, threshold + (1 - threshold) * k / len(found)) for k, n in enumerate(found))]
    return sum(n * (1 / chance(s, depth, tries) - 1) for n, s in seen)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct runs of `words` words (lower-case letters and digits); a shorter text is one run;
    a text without words has none."""
    points, _ = normalised(text)
    if not len(points):
        return np.zeros(0, np.uint64)
    blanks = np.flatnonzero(points == 32)
    starts, ends = np.append(0, blanks + 1), np.append(blanks, len(points))
    n = max(1, len(starts) - words + 1)
    total, back = prefix_hashes(points)
    first, last = starts[:n], ends[min(words, len(ends)) - 1 :][:n]
    return np.unique(mixed((total[last] - total[first]) * back[first] + (last - first).astype(np.uint64)))


def set_keys(found: np.ndarray) -> tuple[int, int]:
    """A cryptographic digest of the set in 128 bits: sets with one digest are one set."""
    return tuple(np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64).tolist())


class Forest:
    """Signatures of sets: `depth` MinHash values for each trie."""

    def __init__(self, tries: int, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 1 << 31, tries * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.addends = rng.integers(0, 1 << 32, tries * depth, dtype=np.uint32)

    def signature(self, found: np.ndarray) -> np.ndarray:
        x = (found >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(x), 1024):
            values = x[None, k : k + 1024] * self.factors[:, None]
            values += self.addends[:, None]
            np.minimum(least, values.min(axis=1), out=least)
        return least.view(np.int32)


def signed(docs: DataFrame, text_col: str, words: int, forest: Forest) -> DataFrame:
    """Adds k1, k2 and n (the set's digest and size), and its signature."""
    schema = extended(docs, "k1 long, k2 long, n int, signature array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                sets = [shingles(t or "", words) for t in batch.column(text_col).to_pylist()]
                keys = np.array([set_keys(x) for x in sets], np.int64).reshape(-1, 2)
                signatures = [forest.signature(x) if len(x) else None for x in sets]
                columns = [*batch.columns, pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([len(x) for x in sets], pa.int32()), pa.array(signatures, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def set_of(docs: DataFrame, words: int) -> DataFrame:
    """c, k1, k2, text -> c, items (array<long>: the set), for texts that have the set the digest stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                c, k1, k2, texts = (x.to_pylist() for x in batch.columns)
                sets = [shingles(t or "", words) for t in texts]
                real = [i for i, x in enumerate(sets) if set_keys(x) == (k1[i], k2[i])]
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in real], pa.int64()), pa.array([sets[i].view(np.int64) for i in real], pa.list_(pa.int64()))], names=["c", "items"])

    return docs.select("c", "k1", "k2", "text").mapInArrow(tidy(run), "c long, items array<long>")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many items any two sets share: products of 0/1 matrices over the items that occur more than once."""
    sizes = [len(x) for x in sets]
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    fresh = np.append(True, flat[1:] != flat[:-1])
    times = np.diff(np.append(np.flatnonzero(fresh), len(flat)))
    keep = np.repeat(times > 1, times)
    column = np.cumsum(fresh[keep]) - 1
    row = row[keep]
    out = np.zeros((len(sets), len(sets)), np.int32)
    bounds = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b > a:
            part = np.zeros((len(sets), COLUMNS), np.float32)
            part[row[a:b], column[a:b] - k * COLUMNS] = 1
            out += np.rint(part @ part.T).astype(np.int32)
    return out


def joined(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the smallest row that it hangs together with."""
    own = np.arange(len(linked))
    while True:
        least = np.minimum(own, np.where(linked, own[None, :], len(linked)).min(axis=1, initial=len(linked)))
        least = least[least]
        if (least == own).all():
            return own
        own = least


def prefixes(signatures: np.ndarray, depth: int) -> np.ndarray:
    """Of signatures (class, trie, value): a hash of each trie's first values."""
    h = np.zeros(signatures.shape[:2], np.uint64)
    for k in range(depth):
        h = mixed(h ^ signatures[:, :, k].astype(np.uint32).astype(np.uint64)) + np.uint64(k + 1)
    return h


def open_pairs(table: pa.Table, tries: int, depth: int, before: int | None, deepest: int) -> np.ndarray:
    """Pairs of a node (part) that are to be verified there, as a symmetric matrix: those that share the node's prefix,
    none of an earlier trie, and none of the length `before`
    in any trie, so that each pair is verified once in the whole join."""
    own = table.column("own").to_numpy()
    i, j, trie = (table.column(x)[0].as_py() for x in ("i", "j", "trie"))
    signatures = table.column("signature").combine_chunks().flatten().to_numpy().reshape(len(own), tries, deepest)
    same = lambda x: x[:, None] == x[None, :]
    now = prefixes(signatures, depth)
    out = same(now[:, trie])
    for t in range(trie):
        out &= ~same(now[:, t])
    if before:
        longer = prefixes(signatures, before)
        for t in range(tries):
            out &= ~same(longer[:, t])
    np.fill_diagonal(out, False)
    if i != j:
        out &= (own == i)[:, None] != (own == i)[None, :]
    return out


def waiting(tries: int, depth: int, before: int | None, deepest: int):
    """A node (part) with signatures -> its classes in pairs that are to be verified there."""

    def run(table: pa.Table) -> pa.Table:
        at = open_pairs(table, tries, depth, before, deepest).any(axis=1)
        return table.select(["trie", "label", "i", "j", "c", "own"]).filter(pa.array(at))

    return run


def verified(threshold: float, tries: int, depth: int, before: int | None, deepest: int):
    """Those classes with their sets -> (c, links, texts, to, near): for each class in a link the documents and classes
    it is linked with here, and one it hangs together with; near: the similarities by bins, once for each call."""

    def run(table: pa.Table) -> pa.Table:
        c, copies = (table.column(x).to_numpy() for x in ("c", "copies"))
        items = table.column("items").combine_chunks()
        flat, offsets = items.values.to_numpy(), items.offsets.to_numpy()
        sets = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        size = np.array([len(x) for x in sets], np.int32)
        both = shared_counts(sets)
        either = size[:, None] + size[None, :] - both
        linked = open_pairs(table, tries, depth, before, deepest) & (both >= threshold * either - 1e-9)
        at = np.flatnonzero(linked.any(axis=1))
        x, y = np.nonzero(np.triu(linked))
        bins = np.clip(((both[x, y] / either[x, y] - threshold) / (1 - threshold) * BINS).astype(int), 0, BINS - 1) if threshold < 1 else np.full(len(x), BINS - 1)
        near = [np.bincount(bins, minlength=BINS)] + [None] * (len(at) - 1) if len(at) else []
        return pa.table({"c": c[at], "links": (linked @ copies)[at].astype(np.int64), "texts": linked.sum(axis=1)[at].astype(np.int64), "to": c[joined(linked)][at], "near": pa.array(near, pa.list_(pa.int64()))})

    return run


def posts(classes: DataFrame, tries: int, deepest: int, depth: int, before: int | None = None) -> DataFrame:
    """Each class in each trie: label of its node at this depth, and at the one before."""
    values = lambda n: F.xxhash64("trie", F.slice("signature", F.col("trie") * deepest + 1, n))
    return classes.withColumn("trie", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).select("c", "trie", values(depth).alias("label"), values(before or depth).alias("below"))


def links_of(known: DataFrame, threshold: float, tries: int, deepest: int, recall: float, block: int) -> tuple[DataFrame, int]:
    """(c, links, texts, to) over all depths until the recall is reached, and the last depth."""
    least, found, out = shallowest(threshold, tries, deepest, recall), [0] * BINS, None
    depths = [*range(deepest, least, -STEP), least]
    for before, depth in zip([None, *depths], depths, strict=False):
        here = posts(known, tries, deepest, depth, before)
        alike = F.lit(True) if before is None else F.min("below") < F.max("below")  # else all its pairs shared a longer prefix
        nodes = here.groupBy("trie", "label").agg(F.count("*").alias("g"), F.sum(F.xxhash64("c").bitwiseAND(F.lit((1 << 40) - 1))).alias("s"), F.bit_xor(F.xxhash64("c", F.lit(3))).alias("x"), alike.alias("new")).where("g > 1 and new")
        nodes = nodes.groupBy("g", "s", "x").agg(F.min(F.struct("trie", "label")).alias("at")).select("at.*", "g")  # one of those with the same members: the first trie's
        blocks = F.ceil(F.col("g") / block).cast("int")
        members = here.join(nodes, ["trie", "label"]).select("c", "trie", "label", blocks.alias("blocks"), F.pmod(F.xxhash64("c", F.lit(5)), blocks).cast("int").alias("own"))
        members = members.join(known.select("c", "signature"), "c")
        met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("c", "signature", "trie", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        keys = ["trie", "label", "i", "j"]
        due = met.groupBy(*keys).applyInArrow(waiting(tries, depth, before, deepest), "trie int, label long, i int, j int, c long, own int")
        own = written(written(due, "due").join(known, "c").groupBy(*keys).applyInArrow(verified(threshold, tries, depth, before, deepest), "c long, links long, texts long, to long, near array<long>"), "links")
        for r in own.where("near is not null").select(F.posexplode("near").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS rows at most
            found[r["bin"]] += r["n"]
        out = own.drop("near") if out is None else out.unionByName(own.drop("near"))
        if missed(found, threshold, depth, tries) <= (1 - recall) * sum(found):
            break
    return out, depth


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node that it hangs together with.

    Stars alternate: every node links its larger neighbours, then its smaller ones, to the smallest it knows, until
    nothing changes. Edges stay tables; each round is written to the checkpoint folder.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        turned = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = turned.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = turned.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        after = written(small, "edges")
        if after.join(now, ["a", "b"], "left_anti").limit(1).count() == 0 and after.count() == now.count():
            break
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS, tries: int = TRIES, deepest: int = DEEPEST, recall: float = RECALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame, int]:
    """(rows: id, at, k1, k2, n; classes: k1, k2, n, first_id, first_at, copies, links, texts, group_id, stays; the
    depth at which the join ended); both tables are written.

    A class is one set of shingles; first_id is its smallest document id (null ids after all others), first_at a hash of
    that document's text; links and texts count the documents and classes similar to it; group_id is the smallest id
    among classes that hang together by links, and exactly one class of a group stays. Rows without words are in no
    class.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("at"), F.col(text_col).alias("text"))
    rows = written(signed(source, "text", words, Forest(tries, deepest)).drop("text"), "signed")
    grouped = rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("first"), F.count("*").alias("copies"), F.any_value("signature").alias("signature"))
    classes = written(grouped.select("k1", "k2", "n", F.col("first.id").alias("first_id"), F.col("first.at").alias("first_at"), "copies", "signature", F.monotonically_increasing_id().alias("c")), "classes")

    # Only classes that share a node at the shallowest depth can be in a pair; their sets are read from the texts once.
    top = posts(classes, tries, deepest, shallowest(threshold, tries, deepest, recall))
    shared = top.join(top.groupBy("trie", "label").agg(F.count("*").alias("g")).where("g > 1"), ["trie", "label"], "left_semi").select("c").distinct()
    company = written(classes.join(shared, "c", "left_semi"), "company")
    once = source.dropDuplicates(["id", "at"]) if rows.groupBy("id", "at").count().where("count > 1").limit(1).count() else source
    texts = once.join(company.select("c", "k1", "k2", "first_id", "first_at"), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("at") == F.col("first_at")))
    known = written(set_of(texts, words).join(company.select("c", "copies", "signature"), "c"), "sets")
    found, depth = links_of(known, threshold, tries, deepest, recall, block)

    links = found.groupBy("c").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    roots = components(found.select(F.col("c").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("c"), "root")
    full = classes.drop("signature").join(links, "c", "left").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    heads = full.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), F.col("first_id"), F.col("c"))).alias("head"))
    full = full.join(heads, "root").select(
        "k1", "k2", "n", "first_id", "first_at", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"), F.col("head.first_id").alias("group_id"), (F.col("head.c") == F.col("c")).alias("stays")
    )
    return rows.drop("signature"), written(full, "groups"), depth


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """Per row of `docs`: its id, class_id, copy_id, n_copies, n_links, n_text_links.

    copy_id: smallest id among the rows with the same shingles; n_copies: the other rows with them. n_links: other rows
    at the threshold or above, copies included; n_text_links: different sets of shingles among them. class_id: smallest
    id of all rows that hang together by links. Texts without words (null, empty) are alone: class_id and copy_id are
    their own id. A text under `words` words is one shingle. Rows that repeat id and text are copies of each other.
    """
    rows, classes, _ = classes_of(docs, id_col, text_col, threshold, words)
    out = rows.join(classes, ["k1", "k2", "n"], "left")
    alone = F.col("n") == 0
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("group_id")).alias("class_id"),
        F.when(alone, F.col("id")).otherwise(F.col("first_id")).alias("copy_id"),
        F.coalesce(F.col("copies") - 1, F.lit(0)).alias("n_copies"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_text_links"),
    )


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group of near copies, with all columns of `docs`; texts without words (null, empty) all stay.

    The row that stays is the first of its group by id (a null id comes last); of rows that repeat its id and text, any one.
    """
    rows, classes, _ = classes_of(docs, id_col, text_col)
    own_id, own_text, worded, at = unused(docs, "own_id", "own_text", "worded", "at")
    stay = classes.where("stays").select(F.col("first_id").alias(own_id), F.col("first_at").alias(own_text), F.lit(True).alias(worded))
    bare = rows.where("n = 0").select(F.col("id").alias(own_id), F.col("at").alias(own_text), F.lit(False).alias(worded)).distinct()
    keyed = docs.withColumn(at, F.xxhash64(text_col))
    kept = keyed.join(stay.unionByName(bare), (F.col(at) == F.col(own_text)) & F.col(id_col).cast("long").eqNullSafe(F.col(own_id)))
    if classes.where("copies > 1").limit(1).count():
        first = kept.where(F.col(worded)).dropDuplicates([id_col, at])
        kept = first.unionByName(kept.where(~F.col(worded)))
    return kept.select(*docs.columns)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `near_copies` gives for every document: doc_id, class_id, copy_id, n_copies, n_links, n_text_links.

    Every row gives one, repeated and null ids too; null texts and texts without words have no links. An empty table gives
    no rows. Only doc_id and text are read.
    """
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
