"""The manifest, the archive and the lexical search against brute force on small tables with odd rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlake.llm import lexical, merkle, web_archive

LOW = str.maketrans(lexical_upper := "ABCDEFGHIJKLMNOPQRSTUVWXYZ", lexical_upper.lower())
DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, at long, block string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    count = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest(*map(count, r[:5]))

    def levels(nodes):
        out = [nodes]
        while len(nodes) > 1:
            nodes = [digest(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
            out.append(nodes)
        return out

    def way(tree, at):
        out = []
        for nodes in tree[:-1]:
            first = at // 8 * 8
            out.append((nodes[first:at], nodes[at + 1 : first + 8]))
            at //= 8
        return out

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: levels([leaf(r) for r in own[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for at, r in enumerate(own[x]):
            steps = way(trees[x], at) + way(top, k)
            found = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                found = leaf((*r[:4], None if r[4] is None else r[4].translate(LOW)))
            for a, b in steps:
                found = digest(*a, found, *b)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], digest(*[y for both in steps for side in both for y in side]), found, found == top[-1][0]))
    return out


def tampered():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def odd_documents():
    rng = random.Random(4)
    rows = [(k, "S", rng.choice(["en", "de", None, "", "zh-ü"]), k * 7, f"Text {k}") for k in range(300)]
    rows += [(None, None, None, None, None), (7, "S", "en", 49, "Text 7"), (7, "S", "en", 49, "Text 7"), (-5, "é", "en", 0, ""), (999, "S", "lone", 3, "É ÀB"), (1, "x", "en", 1, "A" * 200_000)]
    return [(*r, "clash", 5, "clash") for r in rows]


@pytest.mark.parametrize("deep", [1, 2, 4])
def test_manifest_equals_brute_force(spark, deep):
    rows = odd_documents()  # small blocks: several levels of them
    got = merkle.verify(spark.createDataFrame(rows, DOCS), tampered(), deep).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_manifest(rows))


def test_manifest_of_few_rows(spark):
    for rows in ([], [(1, "a", None, 1, "x")], [(3, "a", "en", 1, "X"), (3, "a", "en", 1, "X")]):
        docs = spark.createDataFrame([(*r, "", 0, "") for r in rows], DOCS)
        assert collections.Counter(map(tuple, merkle.verify(docs, tampered()).collect())) == collections.Counter(brute_manifest(rows) if rows else [])


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_layout_stores_halves_one_after_another(levels):
    at = merkle.layout(levels)
    assert sorted(np.concatenate(at).tolist()) == list(range(merkle.tree_size(levels)))
    upper = levels // 2
    if upper:
        assert sorted(np.concatenate(at[:upper]).tolist()) == list(range(merkle.tree_size(upper)))
        size = merkle.tree_size(levels - upper)
        for k in range(8**upper):  # each lower tree is one stretch, laid out like a tree of its own
            own = np.concatenate([at[d].reshape(8**upper, -1)[k] for d in range(upper, levels)]) - merkle.tree_size(upper) - k * size
            assert own.tolist() == np.concatenate(merkle.layout(levels - upper)).tolist()


PAGES = [
    (1, "http://a.example/x", "<p>é</p>"), (2, "http://b.example/\r\nX: y", "<p>é</p>"), (3, None, None), (4, "u", ""), (2, "http://b.example/", "<p>é</p>"), (None, "n", "<p>é</p>"),
    (None, "m", "only here"), (None, "m", "only here"), (9, "z", "HTTP/1.1\r\n\r\nWARC/1.1\r\n\r\nx"), (10, "long", "ab\r\n\r\n" * 100_000),
]
PAGE = "page_id long, url string, html string"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, PAGE).withColumns({"record": F.lit("clash"), "address": F.lit(1), "payload": F.lit("clash"), "page": F.lit("x")})


def test_archive_round_trip(spark):
    back = web_archive.read_archive(web_archive.write_archive(pages_of(spark, PAGES), "2024-01-01T00:00:00Z"))
    rows = web_archive.record_text(back).collect()
    assert collections.Counter((r["page_id"], r["payload"]) for r in rows) == collections.Counter((p, h or "") for p, _, h in PAGES)
    for r in rows:
        data = r["payload"].encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        head, block = r["warc"].split("\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(block.encode()) and fields["WARC-Type"] == r["record_type"]
        assert block.endswith("\r\n\r\n" + (r["payload"] if r["record_type"] == "response" else "")) and ("WARC-Refers-To" in fields) == (r["record_type"] == "revisit")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["payload"]].append(r)
    for own in groups.values():
        first = [r for r in own if r["record_type"] == "response"]
        most = max((r["page_id"] for r in own if r["page_id"] is not None), default=None)
        assert len(first) == 1 and first[0]["page_id"] == most and all(r["refers_to"] == most for r in own if r["record_type"] == "revisit")
    assert {r["url"] for r in rows if r["page_id"] == 2} == {"http://b.example/%0D%0AX: y", "http://b.example/"}


def test_archive_stores_a_payload_once_and_finds_damage(spark):
    archive = web_archive.write_archive(pages_of(spark, PAGES), "2024-01-01T00:00:00Z")
    assert archive.payloads.count() == len({h or "" for _, _, h in PAGES}) and archive.headers.count() == len(PAGES)
    hurt = web_archive.Archive(archive.headers, archive.payloads.withColumn("payload", F.concat("payload", F.lit("!"))))
    with pytest.raises(Exception, match="fit its address"):
        web_archive.read_archive(hurt).collect()
    with pytest.raises(Exception, match="missing"):
        web_archive.read_archive(web_archive.Archive(archive.headers, archive.payloads.where("bytes > 0"))).collect()
    assert web_archive.read_archive(web_archive.write_archive(pages_of(spark, []), "2024-01-01T00:00:00Z")).count() == 0


def test_archive_files_can_be_read_by_lengths(spark, tmp_path):
    archive = web_archive.write_archive(pages_of(spark, PAGES), "2024-01-01T00:00:00Z")
    web_archive.export_warc(archive, f"file://{tmp_path}/warc", gzip=False)
    n = 0
    for file in tmp_path.glob("warc/part-*"):
        data = file.read_bytes()
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            size = int(re.search(rb"\r\nContent-Length: (\d+)$", head)[1])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            data, n = rest[size + 4 :], n + 1
    assert n == len(PAGES)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, top):
    words = [TERM.findall((t or "").translate(LOW)) for _, t in docs]
    count, total = sum(bool(w) for w in words), sum(map(len, words))
    df = collections.Counter(t for w in words for t in set(w))
    out = []
    for item, text in items:
        found = []
        for (doc, _), own in zip(docs, words, strict=True):
            tf, score = collections.Counter(own), 0
            for t in TERM.findall((text or "").translate(LOW)):
                if tf[t]:
                    m = 75 + 25 * len(own) * count // total
                    score += math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, k, None if null else doc, -score) for k, (score, null, doc) in enumerate(sorted(found)[:top], 1)]
    return collections.Counter(out)


def searched(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("clash"), "term": F.lit(1), "item": F.lit(2)}).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("clash"))
    return collections.Counter(map(tuple, lexical.ranked_search(d, i, **more).collect()))


def test_search_equals_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "ÉTÉ", "中文", "x1", "🙂"]
    weighted = [rng.choice(vocabulary[: rng.randrange(1, len(vocabulary))]) for _ in range(20_000)]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(weighted) for _ in range(n))
    docs = [(k, text(rng.randrange(1, 80))) for k in range(400)] + [(k, None) for k in range(3)] + [(500, ""), (501, " .,!"), (None, "w1 w2 w50"), (None, "w1 w2 w50"), (7, "w3 W3 w59"), (7, "w3 W3 w59"), (600, "w40 " * 30_000)]
    docs += [(700 + k, docs[5][1]) for k in range(40)]  # ties
    items = [(k, text(rng.randrange(1, 30))) for k in range(12)] + [(90, None), (91, ""), (92, "unknown words"), (3, docs[5][1]), (3, docs[5][1]), (None, "w1 w1 w2"), (93, " ".join(f"w{k} " for k in range(60)) + " ".join(f"q{k}" for k in range(80)) + docs[5][1])]
    want = brute_search(docs, items, 20)
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, chars=150) == want  # several passes


def test_search_with_masks_of_several_words_and_small_groups(spark):
    rng = random.Random(7)
    words = [f"t{k}" for k in range(200)]
    docs = [(k, " ".join(rng.sample(words, 60))) for k in range(150)]
    items = [(0, " ".join(words)), (1, " ".join(words[50:130]))]
    assert searched(spark, docs, items, top=5) == brute_search(docs, items, 5)


def test_pieces_hold_all_documents(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical, "TOGETHER", 4)
    monkeypatch.setattr(lexical, "POSTINGS", 10)
    batch = pa.RecordBatch.from_arrays([pa.array([[1] * n for n in (3, 0, 12, 5, 5, 5, 0, 0, 0, 0, 0, 1)], pa.list_(pa.int32()))], names=["term"])
    parts = list(lexical.pieces(batch))
    assert [r for p in parts for r in p.column(0).to_pylist()] == batch.column(0).to_pylist() and all(p.num_rows <= 4 for p in parts)


def test_bounds_are_sums_over_bits():
    rng = np.random.default_rng(1)
    masks, most = rng.integers(0, 1 << 63, (50, 2), np.int64), rng.integers(0, 1000, 100)
    want = [sum(int(most[k]) for k in range(100) if int(m[k // 63]) >> (k % 63) & 1) for m in masks]
    assert lexical.bounds(masks, most).tolist() == want


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == searched(spark, [(1, "a")], []) == searched(spark, [(1, "..")], [(1, "a")]) == collections.Counter()
