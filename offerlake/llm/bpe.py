"""Byte-level BPE by a pair-occurrence index.

Within a partition the new pre-tokens of a batch are laid out as one linked list of symbols. An index maps every pair
that has a rank to all its positions; ranks are taken in ascending order, all positions of the rank are merged, and
the lists of the pairs that arise are extended. Pre-tokens seen before keep their ids in a cache of bounded size.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.common import extended, tidy

# The pre-token pattern of byte-level BPE, and the bytes that stand for themselves as characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]

CACHED = 100_000  # pre-tokens that a Python worker keeps: the first, which are the frequent ones
RUN = 500  # new pre-tokens that share an index
WIDTH = 21  # bits of an id in a packed pair
LONG = 64  # longer pre-tokens aren't kept


def byte_characters() -> dict[int, str]:
    """Byte -> the character that stands for it; those without one of their own follow from U+0100 on."""
    own = {b for a, z in PRINTABLE for b in range(a, z + 1)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class Codec:
    """A vocabulary file of the tokenizers library (byte-level BPE without normalizer or prefix space)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, to_char = model["vocab"], byte_characters()
        from_char = {c: b for b, c in to_char.items()}
        self.byte_ids = np.array([vocab[to_char[b]] for b in range(256)], np.int64)
        self.rules: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}  # a rule's number -> its pair
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            number = rank << WIDTH | vocab[a + b]
            self.rules[vocab[a] << WIDTH | vocab[b]] = number
            self.parts[number] = (vocab[a], vocab[b])
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: bytes(from_char[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: token.encode() for token, i in self.added.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, tuple[int, ...]] = {x: (i,) for x, i in self.added.items()}  # the pattern never gives an added token's text

    def pre_tokens(self, text: str) -> list[str]:
        """Added tokens as they are, and the pattern's pieces of what lies between them."""
        if not self.split_added or not any(x in text for x in self.added):
            return self.words.findall(text)
        return [w for part in self.split_added.split(text) for w in ([part] if part in self.added else self.words.findall(part))]

    def merged(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word, by one pair-occurrence index over all of them."""
        coded = [w.encode() for w in words]
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        start = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        n = len(start)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[ends > 0] - 1] = -1  # last of its word
        before[np.append(0, ends[:-1])[ends > 0] if n else ends[:0]] = -1
        pairs = (start[:-1] << WIDTH) | start[1:]
        pairs[after[:-1] < 0] = -1
        rule = self.rules.get  # pair -> rank and merged symbol in one number, so that numbers order by rank
        ids, after, before = start.tolist(), after.tolist(), before.tolist()
        here = list(map(rule, pairs.tolist()))  # of each position the rule of the pair that now starts there
        here.append(None)
        index: dict[int, list[int]] = {}
        for p, r in enumerate(here):
            if r is not None:
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
        active = list(index)
        heapq.heapify(active)
        low, pop, push = (1 << WIDTH) - 1, heapq.heappop, heapq.heappush
        while active:
            r = pop(active)
            new, places = r & low, index.pop(r)
            if len(places) > 1:
                places.sort()
            for p in places:
                if here[p] != r:
                    continue  # taken by another merge since it was posted
                q = after[p]
                ids[p], ids[q], here[q] = new, -1, None
                q = after[p] = after[q]
                if q >= 0:
                    before[q] = p
                    here[p] = made = rule(new << WIDTH | ids[q])
                    if made is not None:
                        if made in index:
                            index[made].append(p)
                        else:
                            index[made] = [p]
                            push(active, made)
                else:
                    here[p] = None
                q = before[p]
                if q >= 0:
                    here[q] = made = rule(ids[q] << WIDTH | new)
                    if made is not None:
                        if made in index:
                            index[made].append(q)
                        else:
                            index[made] = [q]
                            push(active, made)
        left = np.array(ids, np.int64)
        stays = left >= 0
        cuts = np.append(0, np.cumsum(stays))[np.append(0, ends)].tolist()
        flat = left[stays].tolist()
        return [tuple(flat[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_batch(self, texts: Iterable[str]) -> list[list[int]]:
        """Ids of each text, as the tokenizers library gives them with add_special_tokens=False."""
        cut = [self.pre_tokens(t) for t in texts]
        known = self.cache
        new = list(set(chain.from_iterable(cut)).difference(known))
        room = CACHED - len(known)
        for k in range(0, len(new), RUN):
            known.update(zip(new[k : k + RUN], self.merged(new[k : k + RUN]), strict=True))
        out = [list(chain.from_iterable(map(known.__getitem__, words))) for words in cut]
        for k, w in enumerate(new):
            if k >= room or len(w) > LONG:
                del known[w]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """As decode(ids, skip_special_tokens=False): bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


#: One codec a Python worker.
CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per Python worker."""
    if path not in CODECS:
        CODECS[path] = Codec(path)
    return CODECS[path]


def slices(batch: pa.RecordBatch, column: str, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs of about so many bytes, so that memory doesn't hang on rows a batch."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for k, n in enumerate(lengths):
        if held and held + n > chars:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def lists(ids: list[list[int]]) -> pa.ListArray:
    """The ids of texts as one array of numbers and its ends."""
    ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))))


def encode_decode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """Adds ids (array<int>) and decoded (string) to every row.

    vocabulary: the file's path, readable on every executor. A null text counts as empty: no ids, an empty string. A
    text that names an added token gets its id there. Texts of any length are encoded whole; columns of `docs` with
    the new names are replaced.
    """
    kept = [c for c in docs.columns if c not in {"ids", "decoded"}]
    schema = extended(docs.select(*kept), "ids array<int>, decoded string")
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for whole in batches:
            for batch in slices(whole, text_col):
                ids = own.encode_batch(t or "" for t in batch.column(at).to_pylist())
                decoded = [own.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([*batch.columns, lists(ids), pa.array(decoded, pa.string())], names=[*kept, "ids", "decoded"])

    return docs.select(*kept).mapInArrow(tidy(run), schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what encode_decode gave."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its number of tokens and the digests of ids and decoded text.

    Every row gives one, repeated ids too; a null text is empty: no tokens, digests of an empty string. Texts of any length
    are encoded whole; pairs of one rank merge from the left. An empty table gives no rows. Only doc_id and text are read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encode_decode(docs, byte_bpe_path()))
