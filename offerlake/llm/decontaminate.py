"""Benchmark decontamination by q-gram lemma filtering.

A window is any stretch of 80 characters of a benchmark item. A document region within e edits of a window of m
characters shares at least m - q + 1 - q*e of its q-grams with it, on diagonals that differ by e at most; so shared
q-grams of whole items are counted in diagonal bands of width 2e that overlap by e, and windows that reach the bound in
a band are verified by banded alignment: first what eight neighbouring windows have in common, then each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.bpe import slices
from offerlake.llm.common import extended, mixed, prefix_hashes, tidy, written
from offerlake.llm.language import table

Q = 8
WORDS_BELOW = 8  # characters: shorter items are found as whole words
WINDOW = 80  # normalised characters
GROUP = 8  # neighbouring windows that are verified together
ALIGNED = 20_000  # alignments held in memory at once
POSTINGS = 2_000_000  # pairs of q-grams held in memory at once
EDITS = 0.1  # of a window's characters
EXACT_BELOW = 24  # shorter items have to be there unchanged
BENCHMARK_CHARS = 8_000_000  # of benchmark text that one pass over the documents holds in memory
PAD = 0x110000
BITS = 22


def alphanumeric() -> np.ndarray:
    """Code point -> its lower-case form, or a blank for what is neither letter nor digit."""
    from offerlake.llm.language import TABLES

    if "plain" not in TABLES:
        lower = table("lower")
        keep = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
        TABLES["plain"] = np.where(keep, lower, np.uint32(32)).astype(np.uint32)
    return TABLES["plain"]


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and digits with single blanks for all else between them, and each one's place in the text."""
    points = alphanumeric()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = points != 32
    keep[1:] |= points[:-1] != 32
    places = np.flatnonzero(keep)
    if len(places) and points[places[0]] == 32:
        places = places[1:]
    if len(places) and points[places[-1]] == 32:
        places = places[:-1]
    return points[places], places


class Windows:
    """The benchmark items, one after another, and the places of each q-gram in them; an item has a window at every start."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, window: int = WINDOW, edits: float = EDITS):
        self.q = q
        plain = [(item, normalised(text)[0]) for item, text in items]
        short = [x for x in plain if 0 < len(x[1]) < max(q, WORDS_BELOW)]
        self.short = {m: [(item, points) for item, points in short if len(points) == m] for m in sorted({len(x[1]) for x in short})}
        plain = [x for x in plain if len(x[1]) >= max(q, WORDS_BELOW)]
        self.owner = np.array([item for item, _ in plain], np.int64)
        self.lengths = np.array([len(points) for _, points in plain], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.points = np.concatenate([points for _, points in plain]) if plain else np.zeros(0, np.uint32)
        self.sizes = np.minimum(self.lengths, window)
        allowed = np.array([int(edits * m) if m >= EXACT_BELOW else 0 for m in self.sizes.tolist()], np.int64)
        self.edits = np.minimum(allowed, self.sizes // q - 1)  # never less than allowed with the q of `indexes`
        self.bound = self.sizes - q + 1 - q * self.edits
        joined = gram_hashes(self.points, q)
        owner = np.repeat(np.arange(len(plain), dtype=np.int32), self.lengths)[: len(joined)]
        place = (np.arange(len(joined)) - self.begins[owner]).astype(np.int32)
        whole = np.flatnonzero(place <= self.lengths[owner] - q)  # the others run into the next item
        order = whole[np.argsort(joined[whole], kind="stable")]
        self.grams, self.first, self.times = np.unique(joined[order], return_index=True, return_counts=True)
        self.item_of, self.place = owner[order], place[order]
        # Postings in order of q-gram and place in the whole benchmark.
        self.posting = (np.repeat(np.arange(len(self.grams)), self.times) << np.int64(32)) | order
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[(self.grams >> np.uint64(64 - BITS)).astype(np.int64)] = True

    # Each window on its own: its item, its characters, its edits. Not kept, as there are as many as characters.
    @property
    def items(self) -> np.ndarray:
        return np.repeat(self.owner, self.lengths - self.sizes + 1)

    @property
    def texts(self) -> list[np.ndarray]:
        return [self.points[b + s : b + s + m] for b, n, m in zip(self.begins, self.lengths, self.sizes, strict=True) for s in range(n - m + 1)]

    @property
    def budget(self) -> np.ndarray:
        return np.repeat(self.edits, self.lengths - self.sizes + 1)


def gram_size(length: int) -> int:
    """The largest q, up to Q, of which a shared q-gram is left after all edits of an item: 7 for 30 and 31 characters."""
    size = min(length, WINDOW)
    edits = int(EDITS * size) if size >= EXACT_BELOW else 0
    return min(Q, size // (edits + 1)) if size >= WORDS_BELOW else Q


def indexes(items: list[tuple[int, str]]) -> list[Windows]:
    """The items, in one index for each q that they need."""
    by_size: dict[int, list[tuple[int, str]]] = {Q: []}
    for item, text in items:
        by_size.setdefault(gram_size(len(normalised(text)[0])), []).append((item, text))
    return [Windows(own, q) for q, own in by_size.items()]


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    if len(points) < q:
        return np.zeros(0, np.uint64)
    total, back = prefix_hashes(points)
    return mixed((total[q:] - total[:-q]) * back[: len(points) - q + 1])


def hits(points: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Places of the text's q-grams that items hold, and which q-gram of theirs it is."""
    hashes = gram_hashes(points, windows.q)
    at = np.flatnonzero(windows.maybe[(hashes >> np.uint64(64 - BITS)).astype(np.int64)])
    slot = np.minimum(np.searchsorted(windows.grams, hashes[at]), len(windows.grams) - 1)
    real = windows.grams[slot] == hashes[at]
    return at[real], slot[real]


def candidates(at: np.ndarray, first: np.ndarray, times: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first diagonal of a band, first start) of groups of windows, one of which at least has enough shared q-grams.

    A group is the windows at GROUP starts in a row, or all of an item that has fewer. Given are the places of q-grams in
    the text and, for each, where its postings begin and how many there are.
    """
    posted = np.repeat(first - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
    item, place = windows.item_of[posted].astype(np.int64), windows.place[posted].astype(np.int64)
    longest = int(windows.lengths.max())
    diagonal = np.repeat(at, times) - place + longest  # not below 0
    key = (item << np.int64(32)) | (diagonal // np.maximum(windows.edits[item], 1))
    found, of, shared = np.unique(key, return_inverse=True, return_counts=True)
    # A band of two steps is a step and the one after it; the lowest q-gram shared is in the first.
    nearby = np.minimum(np.searchsorted(found, found + 1), max(0, len(found) - 1))
    follows = found[nearby] == found + 1
    enough = shared + np.where(follows, shared[nearby], 0) >= windows.bound[found >> np.int64(32)]
    after = np.zeros(len(found), bool)
    after[nearby[follows & enough]] = True
    own, next_ = np.flatnonzero(enough[of]), np.flatnonzero(after[of])
    band, place = np.concatenate([key[own], key[next_] - 1]), np.concatenate([place[own], place[next_]])
    order = np.lexsort((place, band))
    band, place = band[order], place[order]
    fresh = np.ones(len(band), bool)
    fresh[1:] = (band[1:] != band[:-1]) | (place[1:] != place[:-1])
    band, place = band[fresh], place[fresh]
    # Places of as many q-grams as the bound asks for, close enough for one window: the starts of the windows that hold them.
    item = band >> np.int64(32)
    last = np.arange(len(band)) + windows.bound[item] - 1
    inside = last < len(band)
    last = np.minimum(last, max(0, len(band) - 1))
    reach = windows.sizes[item] - windows.q
    low = np.maximum(place[last] - reach, 0)
    high = np.minimum(place, windows.lengths[item] - windows.sizes[item])
    fits = np.flatnonzero(inside & (band[last] == band) & (low <= high))
    band, item, low, high = band[fits], item[fits], low[fits], high[fits]
    # Within a band both ends only rise: a start is counted where it wasn't reached before.
    again = np.zeros(len(band), bool)
    again[1:] = band[1:] == band[:-1]
    low[1:] = np.where(again[1:], np.maximum(low[1:], high[:-1] + 1), low[1:])
    some = np.flatnonzero(low <= high)
    band, item, low, high = band[some], item[some], low[some], high[some]
    joins = np.zeros(len(band), bool)
    joins[1:] = (band[1:] == band[:-1]) & (low[1:] == high[:-1] + 1)
    first = np.flatnonzero(~joins)
    high = high[np.append(first[1:], len(band)) - 1] if len(band) else high
    band, item, low = band[first], item[first], low[first]
    groups = (high - low) // GROUP + 1
    start = np.repeat(low - GROUP * (np.cumsum(groups) - groups), groups) + GROUP * np.arange(int(groups.sum()))
    band, item = np.repeat(band, groups), np.repeat(item, groups)
    start = np.minimum(start, np.maximum(windows.lengths[item] - windows.sizes[item] - GROUP + 1, 0))
    return item, (band & np.int64(0xFFFFFFFF)) * np.maximum(windows.edits[item], 1) - longest, start


def aligned(points: np.ndarray, item: np.ndarray, diagonal: np.ndarray, start: np.ndarray, size: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits between each stretch of an item and a part of the text near its band, and where that part ends.

    Rows are the stretch's characters, columns the diagonals from the band's first minus e to its last plus e; the part
    may begin and end anywhere. Stretches of one length and budget go together.
    """
    edits, ends = np.full(len(item), 1 << 20), np.zeros(len(item), np.int64)
    kinds = size * 1000 + windows.edits[item]
    for kind in np.unique(kinds):
        m, e = divmod(int(kind), 1000)
        width = 4 * e + 1 if e else 2
        column = np.arange(width)
        every = np.flatnonzero(kinds == kind)
        for k in range(0, len(every), ALIGNED):
            of = every[k : k + ALIGNED]
            begin = diagonal[of] + start[of] - e  # column c of row i stands for text place begin + i + c
            pattern = windows.points[(windows.begins[item[of]] + start[of])[:, None] + np.arange(m)]
            cost = np.zeros((len(of), width), np.int32)
            for i in range(m):
                place = begin[:, None] + i + column
                inside = (place >= 0) & (place < len(points))
                letter = np.where(inside, points[np.clip(place, 0, len(points) - 1)], PAD + 1)
                step = cost + (letter != pattern[:, i : i + 1])
                step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
                cost = np.minimum.accumulate(step - column, axis=1) + column
            best = cost.argmin(axis=1)
            edits[of] = cost[np.arange(len(of)), best]
            ends[of] = begin + m + best
    return edits, ends


def verified(points: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first end, last end) of the parts of the text that windows of an item are found in.

    Frequent q-grams of both sides could meet in very many pairs. So that no more than POSTINGS are held at once, text or
    benchmark are halved until they fit; halves overlap by more than a window and its edits, so that none is lost.
    """
    out = [(np.zeros(0, np.int64),) * 3]
    at, slot = hits(points, windows)
    todo = [(0, len(points), 0, len(windows.points))]
    while todo:
        a, b, low, high = todo.pop()
        of = slice(*np.searchsorted(at, [a, b]))
        first = np.searchsorted(windows.posting, (slot[of] << np.int64(32)) | low)
        times = np.searchsorted(windows.posting, (slot[of] << np.int64(32)) | high) - first
        if times.sum() > POSTINGS and max(b - a, high - low) > 8 * WINDOW:
            if b - a >= high - low:
                middle = (a + b) // 2
                todo += [(a, middle + 2 * WINDOW, low, high), (middle, b, low, high)]
            else:
                middle = (low + high) // 2
                todo += [(a, b, low, middle + 2 * WINDOW), (a, b, middle, high)]
        elif len(first):
            out.append(verified_there(points, *candidates(at[of], first, times, windows), windows))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def verified_there(points: np.ndarray, item: np.ndarray, diagonal: np.ndarray, start: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, budget = windows.sizes[item], windows.edits[item]
    more = np.minimum(GROUP, windows.lengths[item] - size + 1) - 1
    # No window of a group takes fewer edits than the characters that all of them share, and none `more` edits more.
    edits, ends = aligned(points, item, diagonal, start + more, size - more, windows)
    sure = np.flatnonzero(edits + more <= budget)
    open_ = np.flatnonzero((edits <= budget) & (edits + more > budget))
    each = more[open_] + 1
    shift = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    open_ = np.repeat(open_, each)
    edits, own = aligned(points, item[open_], diagonal[open_], start[open_] + shift, size[open_], windows)
    fine = np.flatnonzero(edits <= budget[open_])
    return np.concatenate([item[sure], item[open_[fine]]]), np.concatenate([ends[sure], own[fine]]), np.concatenate([ends[sure] + more[sure], own[fine]])


def whole_words(points: np.ndarray, windows: Windows) -> list[tuple[int, int, int]]:
    """(item, start, end) of items too short for a q-gram, where they stand between blanks or ends of a text."""
    out = []
    apart = np.concatenate([[True], (points == 32) | (points == PAD), [True]])
    for m, items in windows.short.items():
        grams = gram_hashes(points, m)
        bounded = apart[: len(grams)] & apart[m + 1 :][: len(grams)]
        for item, own in items:
            at = np.flatnonzero(bounded & (grams == gram_hashes(own, m)[0]))
            out += [(item, int(k), int(k) + m) for k in at if (points[k : k + m] == own).all()]
    return out


def regions(texts: list[str], windows: Windows) -> list[list[tuple[int, int, int]]]:
    """For each text: (item, start, end) of the regions found, in its own code points; those of an item that overlap are one."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    parts, places, begins, at = [], [], [], 0
    gap = np.full(2 * WINDOW, PAD, np.uint32)
    for t in texts:
        points, place = normalised(t)
        begins.append(at)
        parts += [points, gap]
        places.append(place)
        at += len(points) + len(gap)
    if not at:
        return out
    points, begins = np.concatenate(parts), np.array(begins)
    for item, start, end in whole_words(points, windows):
        text = int(np.searchsorted(begins, start, side="right")) - 1
        out[text].append((item, int(places[text][start - begins[text]]), int(places[text][end - 1 - begins[text]]) + 1))
    item, low, high = verified(points, windows) if len(windows.grams) else ([], [], [])
    for k in range(len(item)):
        text = int(np.searchsorted(begins, low[k] - 1, side="right")) - 1
        place = places[text]
        last = min(int(high[k] - begins[text]), len(place))
        first = max(0, int(low[k] - begins[text]) - int(windows.sizes[item[k]]))
        if last > first:
            out[text].append((int(windows.owner[item[k]]), int(place[first]), int(place[last - 1]) + 1))
    return [merged(x) for x in out]


def merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for item, start, end in sorted(found):
        if out and out[-1][0] == item and start <= out[-1][2]:
            out[-1] = (item, out[-1][1], max(end, out[-1][2]))
        else:
            out.append((item, start, end))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", chars: int = BENCHMARK_CHARS) -> DataFrame:
    """Adds contaminated (boolean) and regions (array of item, start, end in code points) to every row of `docs`.

    A region lies within a tenth of edits of a window, any stretch of 80 normalised characters of an item (the whole item,
    if shorter; items under 24 characters have to be there unchanged, those under 8 as whole words). A region's start is
    its end minus the window's length; regions of one item that overlap are one. Null texts have no regions, null items
    are left out, items that repeat count once. Columns of `docs` with these names are replaced; rows that repeat get
    equal answers; an empty table gives no rows, an empty benchmark no regions.

    The benchmark's size is looked at first: up to `chars` characters go to every task at once; a larger one is dealt
    by hash into parts of about that size, and the documents pass once for each part, written in between.
    """
    kept = [c for c in docs.columns if c not in {"contaminated", "regions"}]
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // chars))
    region = pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
    out = docs.select(*kept).withColumn("regions", F.array().cast("array<struct<item:bigint,start:int,end:int>>"))
    for part in range(parts):
        out = written(out, "pass") if part else out
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        windows = indexes([tuple(r) for r in own.collect()])
        out = out.mapInArrow(passing(docs.sparkSession.sparkContext.broadcast(windows), text_col, region), extended(out.drop("regions"), "regions array<struct<item:bigint,start:int,end:int>>"))
    return out.select(*kept, (F.size("regions") > 0).alias("contaminated"), "regions")


def passing(shared, text_col: str, region: pa.DataType):
    """One pass over documents: what it finds is added to the regions of the passes before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, 1_000_000):
                texts = [t or "" for t in batch.column(text_col).to_pylist()]
                rows = batch.column("regions").to_pylist()
                for windows in shared.value:
                    rows = [[*a, *({"item": i, "start": s, "end": e} for i, s, e in b)] for a, b in zip(rows, regions(texts, windows), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, region)], names=batch.schema.names)

    return tidy(run)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, contaminated, n_items (distinct), items (their ids) and regions (item:start:end), by commas.

    Every row gives one, repeated ids too; null and empty texts are clean, and null and empty items are found nowhere. All
    items found in one place are listed. An empty table of documents gives no rows, one of items finds nothing. Of the
    documents only doc_id and text are read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort(F.array_distinct(F.transform("regions", lambda r: r["item"])))
    spans = F.transform("regions", lambda r: F.concat_ws(":", r["item"].cast("string"), r["start"].cast("string"), r["end"].cast("string")))
    return out.select("doc_id", "contaminated", F.size(items).cast("long").alias("n_items"), F.array_join(items.cast("array<string>"), ",").alias("items"), F.array_join(spans, ",").alias("regions"))
