"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time. It labels every byte position of a
segment with language probabilities, and a document's probabilities are the mean over its positions.

A segment is a run of non-space characters between two space bytes, cut between characters after SEGMENT bytes. The network reads
segments one by one, so equal segments have equal labels: a worker runs each distinct segment once and then adds
up what it has. Segments without a letter say nothing about the language and are left out of the mean.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.llm.common import held, table
from termforge.llm.tokens import gathered, small_batches

#: Training takes at most this many labelled documents: at most SAMPLE_DOCS of a language, and as many of each language
#: as SAMPLE_ROWS allows for all, the more frequent languages first; this many characters of each, and this many segments.
SAMPLE_ROWS, SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_SEGMENTS = 16_384, 1024, 1200, 30_000
SEGMENT, HIDDEN = 48, 12
EPOCHS, BATCH, RATE = 6, 128, 0.01
UNKNOWN = "und"
#: A worker forgets segments beyond this many, or this many numbers about them, and labels so many positions' languages at once.
MOST_SEGMENTS, MOST_CELLS, LABEL_CELLS = 400_000, 8_000_000, 20_000_000
_ASCII = re.compile(r"[A-Za-z]")
_GATES = ("forward", "backward")


def has_letter(text: str) -> bool:
    return bool(_ASCII.search(text)) or any(map(str.isalpha, text))


def segments(text: str) -> list[str]:
    """Lower-cased runs of non-space characters."""
    return text.lower().split()


def framed(segment: str) -> list[bytes]:
    """The bytes of a segment, in runs of at most SEGMENT that end with a character, each between two spaces."""
    raw, out, at = segment.encode("utf-8", "replace"), [], 0
    while at < len(raw):
        end = min(len(raw), at + SEGMENT)
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(b" " + raw[at:end] + b" ")
        at = end
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class ByteGru:
    """Parameters and passes. Every pass takes an array (rows, length) of bytes: rows of one length."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.p: dict[str, np.ndarray] = {}
        for d in _GATES:
            self.p[f"{d}.x"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p[f"{d}.h"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
            self.p[f"{d}.b"] = np.zeros(3 * hidden, np.float32)
        self.p["out"] = rng.normal(0, (2 * hidden) ** -0.5, (2 * hidden, len(languages))).astype(np.float32)
        self.p["bias"] = np.zeros(len(languages), np.float32)

    def _run(self, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (length, rows, hidden) in reading order of d."""
        n = self.hidden
        wx, wh, b = self.p[f"{d}.x"] + self.p[f"{d}.b"], self.p[f"{d}.h"], None
        h = np.zeros((len(x), n), np.float32)
        states, kept = np.empty((x.shape[1], len(x), n), np.float32), []
        for t in range(x.shape[1]):
            fed, u = wx[x[:, t]], h @ wh
            zr = _sigmoid(fed[:, : 2 * n] + u[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(fed[:, 2 * n :] + r * u[:, 2 * n :])
            new = c + z * (h - c)
            if keep:
                kept.append((h, z, r, c, u[:, 2 * n :]))
            states[t] = h = new
        return states, kept

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (length, rows, languages) of every position."""
        a, b = self._run("forward", x, False)[0], self._run("backward", x[:, ::-1], False)[0][::-1]
        return self._soft(np.concatenate([a, b], 2))

    def _soft(self, states: np.ndarray) -> np.ndarray:
        logits = states @ self.p["out"] + self.p["bias"]
        e = np.exp(logits - logits.max(2, keepdims=True))
        return e / e.sum(2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
        n, (rows, length) = self.hidden, x.shape
        read = {"forward": x, "backward": x[:, ::-1]}
        runs = {d: self._run(d, read[d], True) for d in _GATES}
        states = np.concatenate([runs["forward"][0], runs["backward"][0][::-1]], 2)
        probs = self._soft(states)
        loss = -float(np.log(probs[:, np.arange(rows), y] + 1e-9).mean())
        d_logits = probs
        d_logits[:, np.arange(rows), y] -= 1
        d_logits /= rows * length
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["out"] = np.einsum("trh,trl->hl", states, d_logits)
        grads["bias"] = d_logits.sum((0, 1))
        d_states = d_logits @ self.p["out"].T
        for d, d_here in (("forward", d_states[:, :, :n]), ("backward", d_states[::-1, :, n:])):
            wh, carried = self.p[f"{d}.h"], np.zeros((rows, n), np.float32)
            for t in range(length - 1, -1, -1):
                h, z, r, c, u = runs[d][1][t]
                dh = d_here[t] + carried
                dz, dc = dh * (h - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
                dr = dc * u * r * (1 - r)
                d_gate = np.concatenate([dz, dr, dc], 1)
                d_u = np.concatenate([dz, dr, dc * r], 1)
                grads[f"{d}.h"] += h.T @ d_u
                grads[f"{d}.b"] += d_gate.sum(0)
                np.add.at(grads[f"{d}.x"], read[d][:, t], d_gate)
                carried = dh * z + d_u @ wh.T
        return loss, grads

    def fit(self, found: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = 11) -> list[float]:
        """Adam over shuffled batches of equally long segments; returns the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        by_length: dict[int, list[tuple[bytes, int]]] = {}
        for x in found:
            by_length.setdefault(len(x[0]), []).append(x)
        m, v, step, losses = {k: 0 for k in self.p}, {k: 0 for k in self.p}, 0, []
        for epoch in range(epochs):
            batches = []
            for rows in by_length.values():
                order = rng.permutation(len(rows))
                batches += [[rows[i] for i in order[a : a + BATCH]] for a in range(0, len(rows), BATCH)]
            total = 0.0
            rate = RATE * (1 - epoch / epochs)
            for k in rng.permutation(len(batches)):
                x = np.frombuffer(b"".join(s for s, _ in batches[k]), np.uint8).reshape(len(batches[k]), -1)
                loss, grads = self.gradients(x, np.array([y for _, y in batches[k]]))
                total += loss
                step += 1
                for name, g in grads.items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    self.p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(total / max(1, len(batches)))
        return losses


class SegmentLabels:
    """Sums of position probabilities by segment: looked up, or run once and kept."""

    def __init__(self, model: ByteGru) -> None:
        self.model, self.width = model, len(model.languages)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sums = np.zeros((1 << 12, self.width + 1), np.float32)

    def learn(self, found: list[str]) -> None:
        new = list(set(found).difference(self.known))
        if len(self.known) + len(new) > min(MOST_SEGMENTS, MOST_CELLS // (self.width + 1)):
            self.forget()
            new = list(set(found))
        at = len(self.known)
        while at + len(new) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        by_length: dict[int, tuple[list[bytes], list[int]]] = {}
        for i, s in enumerate(new, at):
            if has_letter(s):
                for x in framed(s):
                    held = by_length.setdefault(len(x), ([], []))
                    held[0].append(x)
                    held[1].append(i)
        for length, (rows, where) in by_length.items():
            some = max(1, min(4096, LABEL_CELLS // (length * (self.width + 2 * self.model.hidden))))
            for a in range(0, len(rows), some):
                x = np.frombuffer(b"".join(rows[a : a + some]), np.uint8).reshape(-1, length)
                np.add.at(self.sums, where[a : a + some], np.concatenate([self.model.label(x).sum(0), np.full((len(x), 1), length, np.float32)], 1))
        self.known.update(zip(new, range(at, at + len(new))))

    def pooled(self, texts: list[str]) -> np.ndarray:
        """Mean probabilities of each text over all labelled positions; zeros where there are none."""
        split = [segments(t) for t in texts]
        flat = [s for x in split for s in x]
        self.learn(flat)
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        out = np.zeros((len(texts), self.width + 1))
        filled = np.flatnonzero(counts)
        if len(filled):
            out[filled] = np.add.reduceat(self.sums[at].astype(np.float64), (np.cumsum(counts) - counts)[filled], 0)
        return out[:, :-1] / np.maximum(out[:, -1:], 1)


def training_rows(docs: DataFrame, skip: int = 2, of: int = 4) -> DataFrame:
    """A bounded sample of labelled documents, SAMPLE_ROWS at most: for each language those with the least hashes.

    Languages are counted first, so a share of each language's documents that is a little larger than needed can be told
    by hash alone, and no more than that is shuffled and ordered.
    """
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % of != skip)
    counts = labelled.groupBy("lang").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "lang").limit(SAMPLE_ROWS)
    rows = counts.collect()  # a row for each language, SAMPLE_ROWS at most
    each = max(1, min(SAMPLE_DOCS, SAMPLE_ROWS // max(1, len(rows))))
    wanted = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (each + 6 * each**0.5 + 10) / r["k"])) for r in rows], "lang string, share double")
    h = F.xxhash64("doc_id")
    near = labelled.join(F.broadcast(wanted), "lang").where(F.shiftrightunsigned(h, 11) < F.col("share") * float(1 << 53))
    near = near.select("lang", "doc_id", h.alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    return near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= each).select("doc_id", "lang", "text")


def train(docs: DataFrame, skip: int = 2, of: int = 4) -> ByteGru:
    """Fit on the text and lang of documents whose crc32(doc_id) modulo `of` is not `skip`."""
    rows = sorted({(r["lang"], r["doc_id"], r["text"]) for r in training_rows(docs, skip, of).collect()})  # SAMPLE_ROWS at most
    by_lang: dict[str, list[str]] = {}
    for lang, _, text in rows:
        by_lang.setdefault(lang, []).append(text)
    languages = sorted(by_lang)
    rng, found = np.random.default_rng(5), []
    for y, lang in enumerate(languages):
        own = [x for text in by_lang[lang] for s in segments(text) if has_letter(s) for x in framed(s)]
        most = max(1, SAMPLE_SEGMENTS // len(languages))
        order = rng.permutation(len(own))[:most]
        found += [(own[i], y) for i in order]
    model = ByteGru(languages)
    model.losses = model.fit(found) if len(languages) > 1 else []
    return model


def predict(docs: DataFrame, model: ByteGru) -> DataFrame:
    """docs plus lang_pred and score, every row kept as it is.

    lang_pred is one of the learned languages, the first by name on ties, or `und` with score 0 where the text is
    null or has no letter, or where nothing was learned. score is the pooled probability of lang_pred. Columns
    of docs named lang_pred or score are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("lang_pred", "score")
    key = hashlib.sha256(b"".join(np.ascontiguousarray(v).tobytes() for v in model.p.values())).hexdigest()
    shared = spark.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = held("segments", key, lambda: SegmentLabels(shared.value))
        names = shared.value.languages
        for b in batches:
            texts = b["text"].to_pylist()
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = [(i, t) for i, t in enumerate(texts) if t and names and has_letter(t)]
            for group in gathered(rows):
                probs = labels.pooled([t for _, t in group])
                top = probs.argmax(1)
                for (i, _), k, p in zip(group, top.tolist(), probs.max(1).tolist()):
                    best[i], score[i] = names[k], min(1.0, p)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(score)], names=[*b.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    found = predict(docs.select("doc_id", "text"), model)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
