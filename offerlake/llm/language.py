"""Language identification of mixed-language text.

Every word gets a score for each language from character n-gram counts of the training texts. The word's script leaves
only the languages that use it. A Viterbi pass over the words with a penalty for each switch labels spans; the
language with most letters is the text's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.bpe import slices
from offerlake.llm.common import MULTIPLIER, extended, fold, mixed, prefix_hashes, tidy

BUCKETS = 1 << 16  # of hashed character n-grams
ORDERS = (1, 2, 3, 4)
SWITCH = 12.0  # log-probability that a change of language costs
SMOOTH = 0.5
UNDETERMINED = "und"

# First code points of the blocks that tell scripts apart, and the script from there on.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0E00, "Thai"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x3040, "Kana"), (0x3130, "Hangul"),
    (0x31F0, "Kana"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Other"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"), (0x20000, "Han"),
]
SCRIPT_STARTS = np.array([a for a, _ in SCRIPTS], np.int64)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
SCRIPT_IDS = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS], np.int64)

TABLES: dict[str, np.ndarray] = {}


def table(name: str) -> np.ndarray:
    """By code point: is it a letter, or its lower-case form. Made once in a Python worker."""
    if not TABLES:
        TABLES["letter"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        TABLES["lower"] = np.fromiter((ord(chr(i).lower()[0]) for i in range(0x110000)), np.uint32, 0x110000)
    return TABLES[name]


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of letters. Lower-case code points of all texts in a row; each word's start and end there, and
    its text; where each text starts."""
    held = [t or "" for t in texts]
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    begins = np.cumsum(sizes + 1) - sizes - 1
    points = np.frombuffer("\n".join([*held, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.concatenate(([False], table("letter")[points], [False]))
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = edges[::2], edges[1::2]
    return table("lower")[points], starts, ends, np.searchsorted(begins, starts, side="right") - 1, begins


def distinct_words(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each kind, by 64-bit hashes of the letters; each word's kind; how often each kind occurs."""
    total, back = prefix_hashes(points)
    h = mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    _, first, kind, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    return first, kind, times


def between_blanks(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words in a row, each between two blanks; where each starts; their lengths with the blanks."""
    lengths = ends - starts + 2
    begins = np.cumsum(lengths) - lengths
    out = np.full(int(lengths.sum()), 32, np.uint32)
    inner = np.ones(len(out), bool)
    inner[begins] = inner[begins + lengths - 1] = False
    out[inner] = points[np.arange(int((ends - starts).sum())) + np.repeat(starts - np.cumsum(ends - starts) + (ends - starts), ends - starts)]
    return out, begins, lengths


def ngrams(points: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at every position, and whether it stays within its word."""
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # characters to the word's end
    x = points.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            x = np.append(x[1:], np.uint64(0))
        h = (h + x) * MULTIPLIER
        if n in ORDERS:
            yield ((h ^ np.uint64(n)) * MULTIPLIER >> np.uint64(48)).astype(np.int64) % BUCKETS, left >= n


def scripts_of(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script of each word: that of its first letter."""
    return SCRIPT_IDS[np.searchsorted(SCRIPT_STARTS, points[starts + 1].astype(np.int64), side="right") - 1]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Counts of hashed n-grams by language over every row with a text and a language, summed by Spark.

    What comes to the driver is bounded by languages x (BUCKETS + scripts), whatever the number of documents. Repeated
    rows count as often as they stand there. Without training rows there are no languages.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        seen: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                of: dict[str, list[str]] = {}
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    of.setdefault(lang, []).append(text)
                for lang, texts in of.items():
                    points, starts, ends, _, _ = words_of(texts)
                    if not len(starts):
                        continue
                    first, _, times = distinct_words(points, starts, ends)
                    points, starts, lengths = between_blanks(points, starts[first], ends[first])
                    total = grams.setdefault(lang, np.zeros(BUCKETS))
                    each = np.repeat(times, lengths)
                    for bucket, inside in ngrams(points, lengths):
                        total += np.bincount(bucket[inside], each[inside], BUCKETS)
                    seen.setdefault(lang, np.zeros(len(SCRIPT_NAMES)))
                    seen[lang] += np.bincount(scripts_of(points, starts), times, len(SCRIPT_NAMES))
        for lang, total in grams.items():
            at, scripts = np.flatnonzero(total), np.flatnonzero(seen[lang])
            yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(at) + len(scripts)), "slot": np.concatenate([at, -1 - scripts]), "n": np.concatenate([total[at], seen[lang][scripts]]).astype(np.int64)})

    counts = rows.mapInArrow(tidy(counted), "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    code = counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64) if langs else np.zeros(0, np.int64)
    slot, n = counts["slot"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    table, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPT_NAMES), len(langs)))
    table[slot[slot >= 0], code[slot >= 0]] = n[slot >= 0]
    scripts[-1 - slot[slot < 0], code[slot < 0]] = n[slot < 0]
    scores = np.log((table + SMOOTH) / (table.sum(axis=0) + SMOOTH * BUCKETS)) if langs else table
    words = scripts.sum(axis=0)
    return {"langs": langs, "scores": scores.astype(np.float32), "uses": scripts >= np.maximum(1, 0.001 * words), "prior": np.log((words + 1) / (words.sum() + len(langs))).astype(np.float32) if langs else words}


def word_scores(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: dict) -> np.ndarray:
    """Words as between_blanks gives them. Mean log-probability of a word's n-grams times its characters, by language; languages of other scripts far below.

    A word whose script no language uses says nothing: zeros.
    """
    total = np.zeros((len(points), len(model["langs"])), np.float32)
    for bucket, inside in ngrams(points, lengths):
        total += np.where(inside[:, None], model["scores"][bucket], 0)
    out = np.add.reduceat(total, starts, axis=0) / len(ORDERS)
    uses = model["uses"][scripts_of(points, starts)]
    out = np.where(uses, out, np.float32(-1e4))
    out[~uses.any(axis=1)] = 0
    return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Best language of each word. scores: words of all texts in a row; lengths: words of each text. Texts step together."""
    order = np.argsort(-lengths, kind="stable")
    sizes, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
    live = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # texts with more than t words
    stay = np.ones(scores.shape, bool)
    best = np.zeros(len(scores), np.int16)  # the language before a switch into this word
    now = np.zeros((len(sizes), scores.shape[1]), np.float32)
    for t, n in enumerate(live):
        at = starts[:n] + t
        if t:
            last = now[:n]
            top = last.argmax(axis=1)
            jump = last[np.arange(n), top] - np.float32(SWITCH)
            best[at] = top
            keep = last >= jump[:, None]
            stay[at] = keep
            now[:n] = np.where(keep, last, jump[:, None]) + scores[at]
        else:
            now[:n] = prior + scores[at]
        now[:n] -= now[:n].max(axis=1, keepdims=True)
    path = np.zeros(len(scores), np.int16)
    state = np.zeros(len(sizes), np.int64)
    for t in range(len(live) - 1, -1, -1):
        n, grown = live[t], live[t + 1] if t + 1 < len(live) else 0
        at = starts[:n] + t
        state[grown:n] = now[grown:n].argmax(axis=1)
        path[at] = state[:n]
        if t:
            state[:n] = np.where(stay[at, state[:n]], state[:n], best[at])
    return path


def identify(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, lang_score and lang_spans (array of start, end, lang in code points) to every row.

    lang_score: the share of the text's letters that lang_pred has. A null text, one without letters, or a model
    without languages: `und`, 0.0, no spans. Equal shares go to the language that comes first in the alphabet. Columns
    of `docs` with these names are replaced. The model is broadcast: 2 MB for eight languages.
    """
    kept = [c for c in docs.columns if c not in {"lang_pred", "lang_score", "lang_spans"}]
    schema = extended(docs.select(*kept), "lang_pred string, lang_score double, lang_spans array<struct<start:int,end:int,lang:string>>")
    at, langs = kept.index(text_col), model["langs"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in slices(whole, text_col):
                texts = batch.column(at).to_pylist()
                points, starts, ends, text_of, begins = words_of(texts if langs else [])
                sizes = np.bincount(text_of, minlength=len(texts))
                path = np.zeros(0, np.int16)
                if len(starts):
                    first, kind, _ = distinct_words(points, starts, ends)
                    path = viterbi(word_scores(*between_blanks(points, starts[first], ends[first]), own)[kind], sizes, own["prior"])
                letters = ends - starts
                share = np.zeros((len(texts), max(1, len(langs))))
                share += np.bincount(text_of * share.shape[1] + path, letters, share.size).reshape(share.shape)
                total = share.sum(axis=1)
                top = share.argmax(axis=1)
                fresh = np.ones(len(path), bool)
                fresh[1:] = (path[1:] != path[:-1]) | (text_of[1:] != text_of[:-1])
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(path)) - 1 if len(path) else first
                spans: list[list[dict]] = [[] for _ in texts]
                which = text_of[first]
                for k, i, a, b in zip(which.tolist(), path[first].tolist(), (starts[first] - begins[which]).tolist(), (ends[last] - begins[which]).tolist(), strict=True):
                    spans[k].append({"start": a, "end": b, "lang": langs[i]})
                pred = [langs[i] if n else UNDETERMINED for i, n in zip(top.tolist(), total.tolist(), strict=True)]
                score = np.divide(share.max(axis=1, initial=0), total, out=np.zeros(len(texts)), where=total > 0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)], names=[*kept, "lang_pred", "lang_score", "lang_spans"])

    return docs.select(*kept).mapInArrow(tidy(run), schema)


HELD_OUT_OF, HELD_OUT = 4, 2


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(F.coalesce(fold("doc_id", HELD_OUT_OF), F.lit(HELD_OUT)) != HELD_OUT)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document whether it is held out, the language, its share of letters, and the spans of each language.

    Every row gives one, repeated ids too; null texts and texts without a letter are `und` with score 0. A document without
    id is neither learned from nor held out. Without a training row all are `und`; an empty table gives no rows. Only the
    named columns are read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(training_rows(docs))
    out = identify(docs.select("doc_id", "text"), model)
    spans = F.array_join(F.transform("lang_spans", lambda s: F.concat_ws(":", s["lang"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", F.coalesce(fold("doc_id", HELD_OUT_OF) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), spans.alias("spans"))
