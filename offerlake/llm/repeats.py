"""Suffix-array removal of repeated byte strings across all documents.

Every string of `length` bytes holds an anchor: the 24 bytes with the smallest hash in it. Equal strings hold equal
anchors at equal places, so the strings of an anchor whose bytes occur nowhere else can't repeat. What is left is
compared anchor by anchor. Segments (all strings that share one anchor in one place) with equal hashes form matches
between documents, whose bytes are compared before anything is removed. The strings of segments that differ are suffixes
that a mergesort puts in order: it compares two of them by binary search over prefix polynomial hashes for their common
extension, and checks the bytes of those it finds equal. An anchor with very many different segments is dealt out first:
by the place of the strings around it and the bytes that all strings of such places share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.llm.bpe import slices
from offerlake.llm.common import BASES, mixed, prefix_hashes, tidy, written

LENGTH = 100
ANCHOR = 24
PIECE = 1 << 20  # strings that start in one piece of a document are looked at together
PLACE_BITS = 21  # of a place within a run of pieces
GROUP = 4096  # different segments of an anchor that are sorted together; more are dealt out before
PLACES = 10  # places of strings around an anchor that stay together when it is dealt out
NULL_ID = -(1 << 63)


def pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """Parts of a text that together hold each string of `length` bytes once."""
    for start in range(0, max(0, len(text) - length + 1), PIECE):
        yield start, text[start : start + PIECE + length - 1]


def runs_of(parts: list[bytes], length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """For parts of at least `length` bytes: part, start and number of the strings in each run with one anchor in one
    place; hash of the anchor; hash of the run's bytes; place of the anchor after the start."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(parts), np.uint8)
    n = len(data)
    total, back = prefix_hashes(data)
    grams = mixed((total[anchor:] - total[:-anchor]) * back[: n - anchor + 1])
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, width = length - anchor + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    place = (least & low).astype(np.int64)  # of the anchor, for the string that starts here
    valid = np.ones(len(place), bool)
    for end in (begins + sizes)[:-1]:
        valid[end - length + 1 : end] = False
    fresh = valid.copy()
    fresh[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    first = np.flatnonzero(fresh)
    stop = np.append(fresh[1:] | ~valid[1:], True) & valid
    last = np.flatnonzero(stop)
    other, other_back = prefix_hashes(data, BASES[1])
    ends = last + length
    whole = mixed((other[ends] - other[first]) * other_back[first] + (ends - first).astype(np.uint64))
    part = np.searchsorted(begins, first, side="right") - 1
    return part, first - begins[part], last - first + 1, grams[place[first]].view(np.int64), whole.view(np.int64), place[first] - first


def emitted(batches: Iterator[pa.RecordBatch], length: int, anchor: int, hashes_only: bool) -> Iterator[pa.RecordBatch]:
    """o, t and text of documents -> their runs; only the anchors' hashes if asked so."""

    def flush() -> pa.RecordBatch:
        part, start, n, h, d, a = runs_of([x[3] for x in held], length, anchor)
        if hashes_only:
            return pa.RecordBatch.from_pydict({"h": h})
        of = lambda k: np.fromiter((x[k] for x in held), np.int64, len(held))[part]
        return pa.RecordBatch.from_pydict({"h": h, "d": d, "o": of(0), "t": of(1), "p": of(2) + start, "n": n.astype(np.int16), "a": a.astype(np.int16)})

    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    for batch in (part for whole in batches for part in slices(whole, "text")):
        for o, t, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for start, part in pieces(text, length):
                if size and size + len(part) > PIECE + length:
                    yield flush()
                    held, size = [], 0
                held.append((o, t, start, part))
                size += len(part)
    if held:
        yield flush()


class Suffixes:
    """Strings of `length` bytes within one buffer, compared through prefix hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.length = length
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.total, self.back = prefix_hashes(self.data)
        words = np.zeros(len(data), np.uint64)
        for k in range(8):
            words = words << np.uint64(8) | self.data[k : k + len(data)]
        self.words = words

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search; `length` at most."""
        low = np.zeros(len(x), np.int64)
        step = 1 << (self.length.bit_length() - 1)
        while step:
            m = low + step
            fits = m <= self.length
            m = np.where(fits, m, low)
            same = (self.total[x + m] - self.total[x]) * self.back[x] == (self.total[y + m] - self.total[y]) * self.back[y]
            low = np.where(same & fits, m, low)
            step >>= 1
        return low

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """x < y, by the byte after the common extension."""
        k = self.common(x, y)
        return (k < self.length) & (self.data[x + np.minimum(k, self.length - 1)] < self.data[y + np.minimum(k, self.length - 1)])

    def equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Byte for byte, eight at a time."""
        same = np.ones(len(x), bool)
        for k in [*range(0, self.length - 7, 8), self.length - 8]:
            same &= self.words[x + k] == self.words[y + k]
        return same

    def sorted(self, at: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Mergesort within each class (begins: where classes start in `at`, and the end). Runs double at every level;
        an element's new place is its own rank plus its rank in the neighbouring run, found by binary search. Equal
        strings keep their order."""
        at = at.copy()
        sizes = np.diff(begins)
        base = np.repeat(begins[:-1], sizes)
        room = np.repeat(sizes, sizes)
        inner = np.arange(len(at)) - base
        width = 1
        while width < sizes.max(initial=0):
            moving = np.flatnonzero(room > width)
            i, b, size = inner[moving], base[moving], room[moving]
            run = i // width
            left = run % 2 == 0
            start = np.where(left, (run + 1) * width, (run - 1) * width)
            stop = np.minimum(start + width, size)
            low, high = np.minimum(start, stop), stop
            mine = at[moving]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                theirs, own = at[b[open_] + middle], mine[open_]
                # From the left run: those strictly before it come first. From the right run: those not after it.
                is_left = left[open_]
                first = self.before(np.where(is_left, theirs, own), np.where(is_left, own, theirs))
                ahead = np.where(is_left, first, ~first)
                low[open_] = np.where(ahead, middle + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], middle)
            place = (i - run * width) + (low - np.minimum(start, stop)) + (run // 2) * 2 * width
            at[b + place] = mine
            width *= 2
        return at


def later_strings(groups: np.ndarray, rank: np.ndarray, starts: np.ndarray, counts: np.ndarray, offsets: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments of one buffer (start there, number of strings, place of the anchor after the start, group) and their
    order of appearance `rank`: segment and offset of each string that an earlier one equals."""
    seg = np.repeat(np.arange(len(starts)), counts)
    j = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)
    # Equal strings have the anchor at the same place, so only those are put in one class.
    place = offsets[seg] - j
    order = np.lexsort((rank[seg], place, groups[seg]))
    seg, j, place = seg[order], j[order], place[order]
    fresh = np.ones(len(seg), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (groups[seg][1:] != groups[seg][:-1])
    begins = np.append(np.flatnonzero(fresh), len(seg))
    suffixes = Suffixes(data, length)
    at = starts[seg] + j
    ordered = suffixes.sorted(at, begins)
    klass = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    same = np.zeros(len(at), bool)
    pairs = np.flatnonzero(klass[1:] == klass[:-1]) + 1
    alike = pairs[suffixes.common(ordered[pairs - 1], ordered[pairs]) == length]
    same[alike] = suffixes.equal(ordered[alike - 1], ordered[alike])
    # A stable sort leaves equal strings in order of appearance: all but the first repeat.
    owner = np.searchsorted(starts, ordered[same], side="right") - 1
    return owner, ordered[same] - starts[owner]


def intervals(owner: np.ndarray, j: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings as (segment, first byte, end) after the segment's start."""
    order = np.lexsort((j, owner))
    owner, j = owner[order], j[order]
    fresh = np.ones(len(j), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (j[1:] != j[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(j)) - 1 if len(j) else first
    return owner[first], j[first], j[last] + length


def compared(batches: Iterator[pa.RecordBatch], length: int, bound: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Segments in order of their anchor's hash (h, o, t, p, n, a, bytes) -> intervals (o, t, s, e) that repeat."""

    def flush() -> pa.RecordBatch:
        h, o, t, p, n, a = (np.array([x[k] for x in held], np.int64) for k in range(6))
        rank = np.empty(len(held), np.int64)
        rank[np.lexsort((p, t, o))] = np.arange(len(held))
        sizes = np.array([len(x[6]) for x in held], np.int64)
        data = np.frombuffer(b"".join(x[6] for x in held), np.uint8)
        seg, s, e = intervals(*later_strings(h, rank, np.cumsum(sizes) - sizes, n, a, data, length), length)
        return pa.RecordBatch.from_pydict({"o": o[seg], "t": t[seg], "s": p[seg] + s, "e": p[seg] + e})

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > bound and row[0] != held[-1][0]:
                yield flush()
                held, size = [], 0
            held.append(row)
            size += len(row[6])
    if held:
        yield flush()


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """o, t and a document's repeated segments (s, e, fo, ft, fs: where the first of its kind stands), in order -> its
    matches: neighbouring segments that lie equally far from one first document, as one."""
    for batch in batches:
        rows = batch.column(2)
        flat, sizes = rows.flatten(), np.diff(rows.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), sizes)
        s, e, fo, ft, fs = (flat.field(k).to_numpy() for k in range(5))
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (fo[1:] != fo[:-1]) | (ft[1:] != ft[:-1]) | (s[1:] - fs[1:] != s[:-1] - fs[:-1]) | (s[1:] > e[:-1])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(row)) - 1 if len(row) else first
        o, t = (batch.column(k).to_numpy()[row[first]] for k in range(2))
        yield pa.RecordBatch.from_pydict({"o": o, "t": t, "s": s[first], "e": e[last], "fo": fo[first], "ft": ft[first], "fs": fs[first]})


def dealt(segments: DataFrame, length: int, anchor: int, places: int) -> DataFrame:
    """Segments of one anchor each (h, o, t, p, n, a, data) -> their strings by ranges of `places` places around the
    anchor, as segments too, with g: a hash of anchor, range and the bytes that all strings of the range have in common.
    Equal strings stand at equal places, so they have equal g."""
    reach = length - anchor
    ranged = segments.withColumn("r", F.explode(F.sequence(F.floor((F.col("a") - F.col("n") + 1) / places).cast("int"), F.floor(F.col("a") / places).cast("int"))))
    low, high = F.col("r") * places, F.least(F.col("r") * places + (places - 1), F.lit(reach))
    ranged = ranged.withColumns({"far": F.least(F.col("a").cast("int"), high), "near": F.greatest(F.col("a") - F.col("n") + 1, low), "common": F.substr("data", F.col("a") - low + 1, length - (high - low))})
    start = F.col("a") - F.col("far")
    return ranged.select(
        F.xxhash64("h", "r", "common").alias("g"), "o", "t", (F.col("p") + start).alias("p"), (F.col("far") - F.col("near") + 1).cast("short").alias("n"),
        F.col("far").cast("short").alias("a"), F.substr("data", start + 1, F.col("far") - F.col("near") + length).alias("data"),
    )


def after_first(rows: DataFrame, keys: list[str], length: int) -> tuple[DataFrame, DataFrame]:
    """(the first segment by o, t, p of those that agree in all `keys`, their bytes among them; the intervals o, t, s, e
    of all others)."""
    at, rest = F.struct("o", "t", "p"), [c for c in rows.columns if c not in {"o", "t", "p", *keys}]
    first = written(rows.groupBy(*keys).agg(F.min(at).alias("first"), *[F.min(c).alias(c) for c in rest]), "first")
    others = rows.join(first.select(*keys, "first"), keys).where(at > F.col("first"))
    return first.select(*keys, *rest, "first.*"), others.select("o", "t", F.col("p").alias("s"), (F.col("p") + F.col("n") + F.lit(length - 1)).alias("e"))


def repeated(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP, places: int = PLACES) -> DataFrame:
    """o, t and spans (s, e, data) of documents o, t, text: every byte of a span belongs to a string of `length` bytes that
    also starts earlier, in a document with a smaller o (then t), or before in the same one. Where data isn't null, that
    holds if the span's bytes equal it; they were matched by hashes so far. Rows that repeat o and t are one document.
    """
    long_enough = docs.where(F.octet_length("text") >= length)
    hashes = long_enough.mapInArrow(lambda b: emitted(b, length, anchor, True), "h long")
    often = written(hashes.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "often")
    runs = long_enough.mapInArrow(lambda b: emitted(b, length, anchor, False), "h long, d long, o long, t long, p long, n short, a short")
    runs = written(runs.join(often, "h", "left_semi"), "runs")

    segments = written(runs.groupBy("h", "d").agg(F.min(F.struct("o", "t", "p", "n", "a")).alias("first")), "segments")
    kinds = segments.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    at, end = F.struct("o", "t", "p"), (F.col("p") + F.col("n") + F.lit(length - 1)).alias("e")
    others = runs.join(segments, ["h", "d"]).where((at > F.struct("first.o", "first.t", "first.p")) & (F.col("n") == F.col("first.n")))
    own = others.groupBy("o", "t").agg(F.array_sort(F.collect_list(F.struct(F.col("p").alias("s"), end, F.col("first.o").alias("fo"), F.col("first.t").alias("ft"), F.col("first.p").alias("fs")))).alias("own"))
    matches = written(own.mapInArrow(chained, "o long, t long, s long, e long, fo long, ft long, fs long"), "matches").withColumn("fe", F.col("fs") + F.col("e") - F.col("s"))

    # Bytes that are needed: of segments that differ from others with their anchor, and of what matches start from.
    wanted = segments.join(kinds, "h").select("first.*", "h", "k").select("o", "t", F.col("p").alias("s"), end, "h", "k", "n", "a")
    starts = matches.select(F.col("fo").alias("o"), F.col("ft").alias("t"), F.col("fs").alias("s"), F.col("fe").alias("e")).distinct()
    texts = long_enough.select("o", "t", "text")
    texts = texts.dropDuplicates(["o", "t"]) if docs_repeat(texts) else texts
    parts = wanted.unionByName(starts, allowMissingColumns=True).join(texts, ["o", "t"])
    parts = written(parts.select("o", "t", "s", "e", "h", "k", "n", "a", F.substr("text", (F.col("s") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int")).alias("data")), "parts")
    matched = matches.join(parts.where("h is null").select(F.col("o").alias("fo"), F.col("t").alias("ft"), F.col("s").alias("fs"), F.col("e").alias("fe"), "data"), ["fo", "ft", "fs", "fe"]).select("o", "t", "s", "e", "data")

    differ = parts.where("h is not null").withColumnRenamed("s", "p").drop("e")
    small, large = differ.where(F.col("k") <= group).drop("k"), differ.where(F.col("k") > group).drop("k")
    columns = ["g", "o", "t", "p", "n", "a", "data"]
    windows, again = after_first(written(dealt(large, length, anchor, places), "windows"), ["g", "a", "data"], length)
    crowded = written(windows.groupBy("g").agg(F.count("*").alias("k")).where(F.col("k") > group).select("g"), "crowded")
    strings = windows.join(crowded, "g", "left_semi").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    strings = strings.select("g", "o", "t", (F.col("p") + F.col("j")).alias("p"), F.lit(1).cast("short").alias("n"), (F.col("a") - F.col("j")).alias("a"), F.substr("data", F.col("j") + 1, F.lit(length)).alias("data"))
    _, alike = after_first(strings, ["g", "a", "data"], length)
    sortable = small.withColumnRenamed("h", "g").select(*columns).unionByName(windows.join(crowded, "g", "left_anti").select(*columns))
    within = sortable.repartition("g").sortWithinPartitions("g").mapInArrow(lambda b: compared(b, length), "o long, t long, s long, e long")
    found = within.unionByName(again).unionByName(alike).unionByName(matched, allowMissingColumns=True)
    return found.groupBy("o", "t").agg(F.collect_list(F.struct("s", "e", "data")).alias("spans"))


def docs_repeat(rows: DataFrame) -> bool:
    """Does any (o, t) stand in more than one row?"""
    return bool(rows.groupBy("o", "t").count().where("count > 1").limit(1).count())


def merged(text: bytes, spans: list[dict]) -> list[tuple[int, int]]:
    """Overlapping and touching intervals as one; those whose bytes differ from what they were matched with stay out."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans if x["data"] is None or text[x["s"] : x["e"]] == x["data"]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


RESULT = ("n_bytes", "n_removed", "n_spans", "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Every row of `docs` without its text, and n_bytes, n_removed, n_spans (maximal runs), kept (binary: what is left).

    A string stays where it starts first: in the document with the smallest id, a null id before all others. A null text
    is empty. Rows with one id and different texts are told apart by a hash of the text and come in its order; rows that
    repeat id and text are one document and lose the same bytes. Other columns stay; those of `docs` that bear the name
    of a new one are replaced. An empty table gives no rows. Texts are cut into pieces of 1 MB for the search only.
    """
    own = F.struct(*[F.col(c) for c in docs.columns if c != text_col and c not in RESULT]).alias("row")
    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("o"), F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b"")).alias("text"), own)
    keyed = named.withColumn("t", F.xxhash64("text"))
    double = keyed.groupBy("o").agg(F.min("t").alias("least"), F.max("t").alias("most")).where("least <> most").select("o", F.lit(True).alias("double"))
    if double.limit(1).count():
        source = keyed.join(written(double, "double"), "o", "left").select("o", F.when(F.col("double"), F.col("t")).otherwise(F.lit(0)).alias("t"), "text", "row")
    else:
        source = named.select("o", F.lit(0).cast("long").alias("t"), "text", "row")
    whole = source.join(repeated(source.select("o", "t", "text"), length, group=group), ["o", "t"], "left").select("row", "text", "spans")
    schema = T.StructType([whole.schema["row"], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                runs = merged(text, spans or [])
                edges = [0, *(x for run in runs for x in run), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(text), len(text) - len(kept), len(runs), kept))
            n, gone, k, kept = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(k, pa.int64()), pa.array(kept, pa.binary())], names=schema.names)

    return whole.mapInArrow(cut, schema).select("row.*", *RESULT)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `without_repeats` gives for every document, with the SHA-256 of the bytes left.

    Every row gives one; rows of one id count in the order of their texts. A null text is empty: no bytes, digest of none.
    An empty table gives no rows. Only doc_id and text are read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
