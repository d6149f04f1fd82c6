"""Quality classifier: supervised subword embeddings.

A document is the average of its words' vectors; a word's vector is the average of a learned hashed vector for the word
itself and one for each of its character n-grams; a word that repeats the one before it counts as the word AGAIN besides; a
softmax over the two labels follows. The vectors and the output layer are learned by plain stochastic gradient descent in
numpy. Since average and output layer are linear, scoring needs one number a word: it is computed once for each distinct
word that a worker meets, for many words at once, and kept until the worker's memory for words is full.

Defined cases: a null text counts as empty; an empty text or one of blanks gets the softmax of the bias alone; texts of
any length are read whole; repeated rows are scored row by row; an empty table gives an empty result; a table without
labelled rows gives 0.5 everywhere. Labels that are null are ignored; several labels of a document are averaged.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_batches, free_name, kept_in_worker


@dataclass(frozen=True)
class Settings:
    dim: int = 8
    buckets: int = 1 << 18
    min_n: int = 3
    max_n: int = 5
    epochs: int = 3
    rate: float = 0.4
    seed: int = 7
    #: At most so many labelled rows are fitted on: those whose ids hash lowest, of those with texts of up to
    #: max_training_bytes bytes, so what the driver gathers is bounded. The bounds do not depend on the table.
    max_training_rows: int = 2000
    max_training_bytes: int = 1 << 16
    #: Distinct words, and their bytes, that a worker keeps; beyond that it starts anew.
    cache: int = 120_000
    cache_bytes: int = 1 << 24
    #: Bytes of words whose n-grams are hashed together, and of texts scored together.
    together: int = 1 << 19
    threshold: float = 0.7


#: Stands for "the word before, once more", a word of its own; no word holds a blank.
AGAIN = b" again"


def _hashes(codes: np.ndarray, k: int, buckets: int) -> np.ndarray:
    """The bucket of every k bytes in a row."""
    x = np.full(len(codes) - k + 1, 0x811C9DC5 + k, np.uint32)
    for i in range(k):
        x = (x ^ codes[i : i + len(x)]) * np.uint32(0x01000193)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((x ^ (x >> np.uint32(13))) & np.uint32(buckets - 1)).astype(np.int32)


def features(words: list[bytes], s: Settings):
    """Buckets of words and of all their character n-grams (of bytes, with marks at both ends), in portions of about
    s.together bytes: yields (which word each bucket belongs to, the buckets)."""
    i = 0
    while i < len(words):
        j, size = i, 0
        while j < len(words) and (j == i or size + len(words[j]) <= s.together):
            size += len(words[j]) + 2
            j += 1
        marked = [b"<" + w + b">" for w in words[i:j]]
        n = np.fromiter(map(len, marked), np.int64, j - i)
        yield np.arange(i, j, dtype=np.int32), (np.array([crc32(m, 1) for m in marked], np.int64) & (s.buckets - 1)).astype(np.int32)
        whole = b"".join(marked)
        codes = np.frombuffer(whole, np.uint8).astype(np.uint32) if j - i > 1 or size <= s.together else None
        if codes is None:
            # one very long word, window by window
            raw = np.frombuffer(whole, np.uint8)
            for k in range(s.min_n, s.max_n + 1):
                for a in range(0, len(raw) - k + 1, s.together):
                    got = _hashes(raw[a : a + s.together + k - 1].astype(np.uint32), k, s.buckets)
                    yield np.full(len(got), i, np.int32), got
        else:
            of = np.repeat(np.arange(i, j, dtype=np.int32), n)
            left = np.repeat(np.cumsum(n), n) - np.arange(len(codes))
            for k in range(s.min_n, s.max_n + 1):
                if len(codes) >= k:
                    inside = left[: len(codes) - k + 1] >= k
                    yield of[: len(inside)][inside], _hashes(codes, k, s.buckets)[inside]
        i = j


@dataclass
class Model:
    settings: Settings
    #: For each bucket, what its vector adds to the log odds of label 1.
    odds: np.ndarray
    bias: float
    #: Words by number, and what each adds.
    number: dict = field(default_factory=dict)
    values: np.ndarray = field(default_factory=lambda: np.empty(0))
    held: int = 0

    def learn(self, words: list[bytes]) -> None:
        """Numbers words that are new."""
        sums, counts = np.zeros(len(words)), np.zeros(len(words))
        for of, buckets in features(words, self.settings):
            sums += np.bincount(of, self.odds[buckets], len(words))
            counts += np.bincount(of, minlength=len(words))
        first = len(self.number)
        self.number.update(zip(words, range(first, first + len(words)), strict=True))
        if first + len(words) > len(self.values):
            self.values = np.concatenate([self.values[:first], np.empty(first + 2 * len(words))])
        self.values[first : first + len(words)] = sums / counts
        self.held += sum(map(len, words))

    def score_texts(self, texts: list) -> np.ndarray:
        """Probability of label 1 of each text (bytes or None)."""
        out, i = [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or b"") <= self.settings.together):
                size += len(texts[j] or b"")
                j += 1
            out.append(self._log_odds(texts[i:j]))
            i = j
        z = self.bias + (np.concatenate(out) if out else np.empty(0))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def _log_odds(self, texts: list) -> np.ndarray:
        per = [(t or b"").split() for t in texts]
        n = np.fromiter(map(len, per), np.int64, len(per))
        words = [w for x in per for w in x]
        if not words:
            return np.zeros(len(texts))
        if len(self.number) > self.settings.cache or self.held > self.settings.cache_bytes:
            self.number, self.held = {}, 0
        if AGAIN not in self.number:
            self.learn([AGAIN])
        ids = list(map(self.number.get, words))
        if None in ids:
            self.learn(list(dict.fromkeys(w for w, x in zip(words, ids, strict=True) if x is None)))
            ids = list(map(self.number.get, words))
        ids, ends = np.array(ids), np.cumsum(n)
        again = np.append(False, ids[1:] == ids[:-1])
        again[(ends - n)[n > 0]] = False
        # a zero at the end, so that empty texts have a place too
        sums = np.add.reduceat(np.append(self.values[ids] + again * self.values[self.number[AGAIN]], 0.0), ends - n)
        total = np.add.reduceat(np.append(1 + again, 0), ends - n)
        return np.where(n > 0, sums / np.where(n > 0, total, 1), 0.0)


def fit(texts: list[bytes], labels: list[float], s: Settings) -> Model:
    """SGD over documents in a seeded order, the rate falling linearly to 0."""
    rng = np.random.default_rng(s.seed)
    table = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    out, bias = np.zeros((2, s.dim), np.float32), np.zeros(2, np.float32)
    number: dict[bytes, int] = {}
    counted = []
    for text in texts:
        words = (text or b"").split()
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        if again := int((ids[1:] == ids[:-1]).sum()):
            ids = np.append(ids, np.full(again, number.setdefault(AGAIN, len(number))))
        counted.append(np.unique(ids, return_counts=True) if words else None)
    # buckets in the order of the words, some thousand words at a time
    words, held, sizes = list(number), [], []
    for i in range(0, len(words), 4096):
        of, buckets = (np.concatenate(x) for x in zip(*features(words[i : i + 4096], s), strict=True))
        held.append(buckets[np.argsort(of, kind="stable")])
        sizes.append(np.bincount(of, minlength=min(4096, len(words) - i)))
    buckets, sizes = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (held, sizes))
    starts = np.cumsum(sizes) - sizes
    del words, held

    def document(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A document's buckets and their shares, made anew in each epoch: all documents' would be a hundred times their texts."""
        k = sizes[words]
        at = np.repeat(starts[words] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        # a bucket met twice in a document gets the sum of its shares
        uniq, place = np.unique(buckets[at], return_inverse=True)
        return uniq, np.bincount(place, np.repeat(n / n.sum() / k, k)).astype(np.float32)

    steps, done = max(1, s.epochs * len(counted)), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(counted)):
            rate = s.rate * (1 - done / steps)
            done += 1
            y = np.array([1 - labels[i], labels[i]], np.float32)
            if counted[i] is None:
                z = bias.copy()
            else:
                ids, share = document(*counted[i])
                rows = table[ids]
                hidden = share @ rows
                z = out @ hidden + bias
            p = np.exp(z - z.max())
            g = p / p.sum() - y
            if counted[i] is not None:
                back = g @ out
                out -= rate * np.outer(g, hidden)
                # shares are small where texts are long: the step is scaled by the largest, as if each bucket were met once
                table[ids] = rows - (rate * share / share.max())[:, None] * back
            bias -= rate * 0.1 * g
    return Model(s, (table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def train(documents: DataFrame, labels: DataFrame, s: Settings = Settings(), held_out=None) -> Model:
    """Fits on at most s.max_training_rows labelled rows, outside the fold that held_out (a function of the id's column) marks."""
    ids = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y")).where("id is not null and y is not null")
    if held_out is not None:
        ids = ids.where(~held_out(F.col("id")))
    ids = ids.groupBy("id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(s.max_training_rows)
    # at most max_training_rows rows of two numbers: the bound proves the size of the broadcast
    text = documents.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= s.max_training_bytes)
    rows = text.join(F.broadcast(ids), "id").orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(s.max_training_rows).collect()
    return fit([bytes(r.text) if r.text is not None else b"" for r in rows], [r.y for r in rows], s)


def score(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all if not given) of documents and `quality_score` double, 0 to 1."""
    keep = documents.columns if keep is None else keep
    kept = documents.select(*(F.col(f"`{c}`") for c in keep))
    name = free_name(kept, "quality_score")
    bounded_batches(documents.sparkSession)
    sent = documents.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("binary").alias(free_name(kept, "__bytes")))
    schema = kept.schema.add(name, "double", False)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = kept_in_worker(("quality", crc32(shared.value.odds.tobytes()), shared.value.bias), lambda: shared.value)
        for b in batches:
            scores = m.score_texts(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], name])

    return sent.mapInArrow(run, schema)


def in_fold(c, parts: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts == remainder, F.lit(False))


def quality_query(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents."""
    model = train(documents, labels, s, lambda c: in_fold(c, 4, 2))
    out = score(documents.select("doc_id", "text"), model, ["doc_id"])
    p = F.col("quality_score")
    return out.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), p.alias("score"), (p >= s.threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of documents, whole, that the classifier does not reject."""
    model = train(documents, labels, s, lambda c: in_fold(c, 4, 2))
    out = score(documents, model)
    return out.where(F.col(out.columns[-1]) >= s.threshold).select(*(F.col(f"`{c}`") for c in documents.columns))
