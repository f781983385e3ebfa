"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is trained in numpy on windows labelled by the base spans of a bounded sample. Overlapping windows are
decoded by Viterbi; spans of all windows of a text are reconciled together, pieces of longer ones put together, and those
that meet a base span are dropped.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.bpe import slices
from offerlake.llm.common import extended, tidy

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then first and further characters of each kind
SAMPLE = 2000  # documents that the network is trained on, at most
WINDOW, STRIDE = 96, 48
HIDDEN = 16
SYMBOLS = 101  # printable ASCII, then: line end, other blank, other letter, other digit, anything else, nothing
PASSES, BATCH, RATE = 8, 64, 0.01
TRAINING_WINDOWS = 1200  # with spans; as many without, at most

EVIDENCE = re.compile(r"[0-9@]")
EMAIL_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
DIGITS_RUN = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def card_like(found: str) -> bool:
    digits = "".join(DIGITS.findall(found))
    return 12 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost without overlap for each kind, by start and then kind.

    The same matches as the contract's patterns give, in time linear in the text: e-mail addresses are looked for at
    each `@`, addresses of hosts in whole runs of dotted numbers.
    """
    if not EVIDENCE.search(text):
        return []
    out: list[tuple[int, int, str]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        host = EMAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            out.append((start, end, "email"))
        at = text.find("@", max(end, at + 1))
    for run in NUMBERS.finditer(text):
        if text.find(".", run.start(), run.end()) < 0:
            continue
        parts = list(DIGITS_RUN.finditer(text, run.start(), run.end()))
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or 0) <= 255 for p in four):
                out.append((four[0].start(), four[3].end(), "ip"))
    out.extend((m.start(), m.end(), "card") for m in CARD.finditer(text) if m.end() - m.start() >= 12 and card_like(m[0]))
    if "+" in text:
        out.extend((m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15)
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def plausible(found: str, kind: str) -> bool:
    """What a span that the network adds must hold, whatever its tags. Each needs a digit or `@`, so windows without
    either can't add any."""
    if kind == "email":
        local, _, host = found.partition("@")
        return bool(local) and "." in host.strip(".") and not re.search(r"\s", found)
    digits = len(DIGITS.findall(found))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(p.lstrip('0')) <= 3 and int(p) <= 255 for p in parts) and re.fullmatch(r"[0-9 .\[\]()]+", found) is not None
    if kind == "card":
        return re.fullmatch(r"[0-9 ./_-]+", found) is not None and card_like(found)
    return 9 <= digits <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ()./-]+[0-9]", found) is not None and re.search(r"[ ()./-]", found) is not None


def symbols(text: str) -> np.ndarray:
    """Network input: a small number for each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = points - 32
    odd = np.flatnonzero((points < 32) | (points > 126))
    for k in odd:
        c = text[k]
        out[k] = 95 if c == "\n" else 96 if c.isspace() else 97 if c.isalpha() else 98 if c.isdigit() else 99
    return out


def starts_of(n: int) -> list[int]:
    """Where windows start in a text of n characters: each part of STRIDE characters lies whole in some window."""
    return [0] if n <= WINDOW else sorted({*range(0, n - WINDOW + 1, STRIDE), n - WINDOW})


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """A bidirectional LSTM over characters with a CRF on top. Arrays run over time, window, unit."""

    NAMES = ("in_f", "rec_f", "in_b", "rec_b", "out", "bias", "step", "begin")

    def __init__(self, seed: int = 5, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        self.p = {"in_f": scale(SYMBOLS, 4 * hidden), "rec_f": scale(hidden, 4 * hidden), "in_b": scale(SYMBOLS, 4 * hidden), "rec_b": scale(hidden, 4 * hidden), "out": scale(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "step": np.zeros((TAGS, TAGS), np.float32), "begin": np.zeros(TAGS, np.float32)}
        self.hidden = hidden

    def packed(self) -> bytes:
        buffer = io.BytesIO()
        np.savez(buffer, **self.p)
        return buffer.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Tagger:
        own = cls()
        with np.load(io.BytesIO(data)) as held:
            own.p = {k: held[k] for k in cls.NAMES}
        return own

    def pass_over(self, x: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """x: time by window. One direction's outputs, in that direction's order, and what going back needs."""
        h = self.hidden
        state, cell = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
        out, kept = np.empty((len(x), x.shape[1], h), np.float32), []
        inputs, recurrent = self.p[f"in_{way}"], self.p[f"rec_{way}"]
        for t in range(len(x)):
            z = inputs[x[t]] + state @ recurrent
            gates = sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            before, last = cell, state
            cell = gates[:, h : 2 * h] * cell + gates[:, :h] * new
            squashed = np.tanh(cell)
            state = gates[:, 2 * h :] * squashed
            out[t] = state
            kept.append((gates, new, before, squashed, last))
        return out, kept

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        f, kept_f = self.pass_over(x, "f")
        b, kept_b = self.pass_over(x[::-1], "b")
        both = np.concatenate([f, b[::-1]], axis=2)
        return both @ self.p["out"] + self.p["bias"], (both, kept_f, kept_b)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags y, and its gradients."""
        e, (both, kept_f, kept_b) = self.emissions(x)
        n_time, n, _ = e.shape
        p, rows = self.p, np.arange(n)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = p["begin"] + e[0]
        for t in range(1, n_time):
            m = alpha[t - 1].max(axis=1, keepdims=True)
            alpha[t] = np.log(np.exp(alpha[t - 1] - m) @ np.exp(p["step"]) + 1e-30) + m + e[t]
        for t in range(n_time - 2, -1, -1):
            v = beta[t + 1] + e[t + 1]
            m = v.max(axis=1, keepdims=True)
            beta[t] = np.log(np.exp(v - m) @ np.exp(p["step"]).T + 1e-30) + m
        m = alpha[-1].max(axis=1, keepdims=True)
        total = (np.log(np.exp(alpha[-1] - m).sum(axis=1, keepdims=True)) + m)[:, 0]
        gold = p["begin"][y[0]] + e[0, rows, y[0]]
        for t in range(1, n_time):
            gold = gold + p["step"][y[t - 1], y[t]] + e[t, rows, y[t]]
        d = np.exp(alpha + beta - total[None, :, None])
        grads = {"begin": d[0].sum(axis=0), "step": np.zeros_like(p["step"])}
        for t in range(1, n_time):
            a = np.exp(alpha[t - 1] - alpha[t - 1].max(axis=1, keepdims=True))
            b = np.exp(beta[t] + e[t] - (total - alpha[t - 1].max(axis=1))[:, None])
            grads["step"] += (a.T @ b) * np.exp(p["step"])
        np.add.at(grads["step"], (y[:-1].ravel(), y[1:].ravel()), -1)
        np.add.at(grads["begin"], y[0], -1)
        np.put_along_axis(d, y[:, :, None], np.take_along_axis(d, y[:, :, None], 2) - 1, 2)
        grads["bias"] = d.sum(axis=(0, 1))
        grads["out"] = both.reshape(-1, both.shape[2]).T @ d.reshape(-1, TAGS)
        back = d @ p["out"].T
        h = self.hidden
        for way, kept, given, inputs in (("f", kept_f, back[:, :, :h], x), ("b", kept_b, back[::-1, :, h:], x[::-1])):
            table, recurrent = np.zeros_like(p[f"in_{way}"]), np.zeros_like(p[f"rec_{way}"])
            d_state, d_cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t in range(n_time - 1, -1, -1):
                gates, new, before, squashed, last = kept[t]
                i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
                d_state = d_state + given[t]
                d_cell = d_cell + d_state * o * (1 - squashed**2)
                dz = np.concatenate([d_cell * new * i * (1 - i), d_cell * before * f * (1 - f), d_state * squashed * o * (1 - o), d_cell * i * (1 - new**2)], axis=1)
                recurrent += last.T @ dz
                np.add.at(table, inputs[t], dz)
                d_state, d_cell = dz @ p[f"rec_{way}"].T, d_cell * f
            grads[f"in_{way}"], grads[f"rec_{way}"] = table, recurrent
        return float((total - gold).mean()), {k: v / n for k, v in grads.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, passes: int = PASSES, seed: int = 3) -> float:
        """x and y: window by time. Adam over shuffled batches; the last pass's mean loss."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step, loss = 0, 0.0
        for k in range(passes):
            losses = []
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
                value, grads = self.gradients(np.ascontiguousarray(x[at].T), np.ascontiguousarray(y[at].T))
                losses.append(value)
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                step += 1
                for name, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.p[name] = (self.p[name] - RATE * (0.5 if k >= passes // 2 else 1) * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags of each window (x and result: window by time)."""
        e, _ = self.emissions(np.ascontiguousarray(x.T))
        best = self.p["begin"] + e[0]
        came = np.zeros((*x.T.shape, TAGS), np.int8)
        for t in range(1, len(e)):
            options = best[:, :, None] + self.p["step"]
            came[t] = options.argmax(axis=1)
            best = options.max(axis=1) + e[t]
        tags = np.zeros(x.T.shape, np.int64)
        tags[-1] = best.argmax(axis=1)
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = np.take_along_axis(came[t], tags[t][:, None], 1)[:, 0]
        return tags.T


def tags_of(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for a, b, kind in spans:
        if not out[a:b].any():
            out[a:b] = 2 + 2 * KINDS.index(kind)
            out[a] -= 1
    return out


def variants(text: str, spans: list[tuple[int, int, str]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with some phone numbers written without their country code, so that the network learns those, too."""
    out, moved, at = [], [], 0
    for a, b, kind in spans:
        if a < at:
            continue
        found = text[a:b]
        if kind == "phone" and rng.random() < 0.7:
            found = re.sub(r"^\+[0-9]{1,3}[ .-]?(?=[(0-9])", "", found) if len(DIGITS.findall(found)) > 10 else found
        out.append(text[at:a])
        start = sum(map(len, out))
        out.append(found)
        moved.append((start, start + len(found), kind))
        at = b
    out.append(text[at:])
    return "".join(out), moved


def training_windows(texts: list[str], limit: int = TRAINING_WINDOWS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Input and tags of windows around base spans, as they are and varied, and of windows without any."""
    rng = np.random.default_rng(seed)
    with_span: list[tuple[np.ndarray, np.ndarray]] = []
    without: list[tuple[np.ndarray, np.ndarray]] = []
    for text in texts:
        spans = base_spans(text)
        for own, found in ((text, spans), variants(text, spans, rng)) if any(x[2] == "phone" for x in spans) else ((text, spans),):
            x, y = symbols(own), tags_of(len(own), found)
            places = {max(0, a - int(rng.integers(8, 40))) for a, _, _ in found} | {m.start() for m in list(EVIDENCE.finditer(own))[:2]} | {int(rng.integers(0, max(1, len(own) - WINDOW)))}
            for a in sorted(places):
                part = np.full(WINDOW, SYMBOLS - 1), np.zeros(WINDOW, np.int64)
                n = len(x[a : a + WINDOW])
                part[0][:n], part[1][:n] = x[a : a + WINDOW], y[a : a + WINDOW]
                (with_span if part[1].any() else without).append(part)
    pick = lambda held: [held[k] for k in rng.permutation(len(held))[:limit]]
    rows = pick(with_span) + pick(without)
    return (np.array([r[0] for r in rows]), np.array([r[1] for r in rows])) if with_span else (np.zeros((0, WINDOW), int),) * 2


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> bytes | None:
    """The network, trained in one executor task on at most `sample` different texts that hold a digit or `@`: those
    with the smallest hashes. None if they have no base span. Different texts are counted first, so that each partition
    sends on only its share of about one and a half times the sample; the share doubles until the sample is full or all
    texts are in."""
    own = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    share = min(1.0, 1.5 * sample / max(1, own.agg(F.approx_count_distinct("h")).first()[0]))
    while share < 1 and own.where(F.col("h") < int(share * (1 << 40))).select("h").distinct().limit(sample).count() < sample:
        share = min(1.0, 2 * share)
    chosen = own.where(F.col("h") < int(share * (1 << 40))).distinct().orderBy("h", "text").limit(sample).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = training_windows([t for batch in batches for t in batch.column(0).to_pylist()])
        if len(x):
            tagger = Tagger()
            tagger.fit(x, y)
            yield pa.RecordBatch.from_pydict({"model": [tagger.packed()]})

    found = chosen.mapInArrow(tidy(run), "model binary").collect()
    return bytes(found[0]["model"]) if found else None


def runs(tags: np.ndarray, n: int) -> list[tuple[int, int, str]]:
    """Tagged runs (start, end, kind) of a window of n characters; one at its start may begin with a further character."""
    out, t = [], 0
    while t < n:
        if tags[t] % 2 == 1 or (t == 0 and tags[t]):
            further = tags[t] + tags[t] % 2
            end = t + 1
            while end < n and tags[end] == further:
                end += 1
            out.append((t, end, KINDS[further // 2 - 1]))
            t = end
        else:
            t += 1
    return out


def put_together(cut: Sequence[tuple[int, int, str, bool, bool]]) -> list[tuple[int, int, str]]:
    """Spans of one text from pieces (start, end, kind, begins inside its window, ends inside it) that windows' edges cut:
    a piece with a beginning, any number without either end, and one with an end, each of which meets the one before."""
    out: list[tuple[int, int, str]] = []
    last: dict[str, tuple[int, int]] = {}
    for s, e, kind, opens, closes in sorted(cut):
        if opens:
            last[kind] = s, e
        elif kind in last and s <= last[kind][1]:
            first, before = last[kind]
            if closes:
                out.append((first, e, kind))
                del last[kind]
            else:
                last[kind] = first, max(e, before)
    return out


def added_spans(texts: list[str], base: list[list[tuple[int, int, str]]], tagger: Tagger | None) -> list[list[tuple[int, int, str]]]:
    """Spans that the network adds to each text, by start.

    Windows overlap by half. A window gives the spans that lie inside it, not at its edge unless the text ends there;
    spans that an edge cuts are put together from the windows they run through (`put_together`). Of spans of one text
    that overlap, the first stays, then the longer. Windows without digit or `@` are left out, as no plausible span can
    lie in them; where one is left out amid a span, the span ends open and doesn't count.
    """
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    jobs, parts = [], []
    for k, text in enumerate(texts) if tagger else ():
        if not EVIDENCE.search(text):
            continue
        x = symbols(text)
        evidence = np.concatenate(([0], np.cumsum(((x >= 16) & (x <= 25)) | (x == 32))))
        for a in starts_of(len(text)):
            if evidence[min(len(text), a + WINDOW)] > evidence[a]:
                jobs.append((k, a))
                parts.append(x[a : a + WINDOW])
    found: dict[int, list[tuple[int, int, str]]] = {}
    cut: dict[int, list[tuple[int, int, str, bool, bool]]] = {}
    for low in range(0, len(jobs), 1024):
        x = np.full((len(jobs[low : low + 1024]), WINDOW), SYMBOLS - 1)
        for r, part in enumerate(parts[low : low + 1024]):
            x[r, : len(part)] = part
        tags = tagger.decode(x)
        for r in np.flatnonzero(tags.any(axis=1)):
            k, a = jobs[low + r]
            n = min(WINDOW, len(texts[k]) - a)
            for t, end, kind in runs(tags[r], n):
                opens, closes = t > 0 or a == 0, end < n or a + n == len(texts[k])
                if opens and closes:
                    found.setdefault(k, []).append((a + t, a + end, kind))
                else:
                    cut.setdefault(k, []).append((a + t, a + end, kind, opens, closes))
    for k in found.keys() | cut.keys():
        text, taken = texts[k], [(s, e) for s, e, _ in base[k]]
        spans = {*found.get(k, ()), *put_together(cut.get(k, ()))}
        for s, e, kind in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
            cut_off = text[max(0, s - 1) : s].isdigit() or text[e : e + 1].isdigit()  # part of a longer number
            if not cut_off and plausible(text[s:e], kind) and all(e <= a or b <= s for a, b in taken):
                taken.append((s, e))
                out[k].append((s, e, kind))
        out[k].sort()
    return out


def find_pii(docs: DataFrame, model: bytes | None, text_col: str = "text") -> DataFrame:
    """Adds spans (array of kind, start, end in code points, base) to every row, by start and then kind.

    Base spans always stay; spans of the network never overlap one. Null and empty texts have none. The network (70 kB)
    is broadcast. A column of that name in `docs` is replaced.
    """
    kept = [c for c in docs.columns if c != "spans"]
    schema = extended(docs.select(*kept), "spans array<struct<kind:string,start:int,end:int,base:boolean>>")
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger.unpacked(shared.value) if shared.value else None
        for whole in batches:
            for batch in slices(whole, text_col):
                texts = [t or "" for t in batch.column(text_col).to_pylist()]
                base = [base_spans(t) for t in texts]
                rows = []
                for own, more in zip(base, added_spans(texts, base, tagger), strict=True):
                    both = sorted([(s, KINDS.index(k), e, True) for s, e, k in own] + [(s, KINDS.index(k), e, False) for s, e, k in more])
                    rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in both])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, span)], names=[*kept, "spans"])

    return docs.select(*kept).mapInArrow(tidy(run), schema)


def redact(docs: DataFrame, model: bytes | None, text_col: str = "text") -> DataFrame:
    """The rows of `docs` with every span replaced by <EMAIL>, <IP>, <CARD> or <PHONE>; spans that overlap become one,
    named after the first. Null texts stay null."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def cut(text: str, spans: list[tuple[int, int, str]]) -> str:
        out, at = [], 0
        for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
            if start >= at:
                out += [text[at:start], f"<{kind.upper()}>"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger.unpacked(shared.value) if shared.value else None
        for whole in batches:
            for batch in slices(whole, text_col):
                held = batch.column(text_col).to_pylist()
                base = [base_spans(t or "") for t in held]
                more = added_spans([t or "" for t in held], base, tagger)
                new = pa.array([cut(t, [*a, *b]) if t and (a or b) else t for t, a, b in zip(held, base, more, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([new if c == text_col else batch.column(c) for c in names], names=names)

    return docs.mapInArrow(tidy(run), docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the counts of base spans by kind, their digest, all spans, and n_added, those of the network.

    Every row gives one, repeated ids too; null and empty texts have no spans, and the digest of an empty list. Equal
    starts go by kind as listed. An empty table gives no rows. Only doc_id and text are read, so other columns can't clash.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_pii(docs, train(docs)).select("doc_id", "spans")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: lambda s: s["base"] & (s["kind"] == kind)
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))
