"""Quality rules: counts that reject a text outright, and a calibrated classifier for the rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of training: labelled rows, and buckets for words and for characters each.
ROWS, BUCKETS = 3_000, 1 << 13
#: Labelled rows that a step of the fit handles at once.
FITTED = 200
#: A text is kept where the calibrated probability of quality is at least this.
KEEP = 0.5
SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
WORD_GRAMS, CHAR_GRAMS = (1, 2), (2, 3, 4)
MIX = np.uint64(0x9E3779B97F4A7C15)
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of codes found twice or more; codes are exact word numbers."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    names, width = codes.astype(np.int64), 1
    while width < window:  # names of runs of twice the width, by pairs
        step = min(width, window - width)
        pairs = names[: len(names) - step] * (int(names.max()) + 1) + names[step:]
        names, width = np.unique(pairs, return_inverse=True)[1], width + step
        if width == window or len(names) == 0:
            break
    twice = np.bincount(names)[names] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(codes) + 1, dtype=np.int64)
    edges[:n] += twice
    edges[window : window + n] -= twice
    return int((np.cumsum(edges)[:-1] > 0).sum())


def statistics(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode()
    words = raw.split()
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    blanks = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), len(text) - blanks, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(codes)


def gram_buckets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's word n-grams and of its character n-grams (over UTF-8 bytes), repeats included."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    values = data.astype(np.uint64)
    chars = []
    for n in CHAR_GRAMS:
        if len(values) >= n:
            h = np.full(len(values) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h << np.uint64(8)) | values[k : len(values) - n + 1 + k]
            chars.append((h * MIX) >> np.uint64(51))
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    # A word's number is a polynomial of its bytes, from sums that run over the whole text.
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    words = []
    if len(starts):
        place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
        power = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * MIX
        mixed = (values + np.uint64(1)) * (power ^ (power >> np.uint64(29)))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        ids = total[ends] - total[starts]
        for n in WORD_GRAMS:
            if len(ids) >= n:
                h = np.full(len(ids) - n + 1, n, dtype=np.uint64)
                for k in range(n):
                    h = h * np.uint64(0x100000001B3) + ids[k : len(ids) - n + 1 + k]
                h ^= h >> np.uint64(32)
                words.append((h * MIX) >> np.uint64(51))
    join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
    return join(words), join(chars)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that a text has and their values: its n-grams' shares, words and characters each of length 1."""
    at, value = [], []
    for offset, grams in zip((0, BUCKETS), gram_buckets(text), strict=True):
        counts = np.bincount(grams, minlength=BUCKETS)
        some = np.flatnonzero(counts)
        at.append(some + offset)
        value.append(counts[some] / np.sqrt((counts[some].astype(float) ** 2).sum() or 1))
    return np.concatenate(at).astype(np.int32), np.concatenate(value).astype(np.float32)


class Classifier:
    """Logistic regression on hashed n-grams; Platt's sigmoid, fitted on a fifth of the rows, calibrates it."""

    def __init__(self) -> None:
        self.weights, self.bias, self.slope, self.shift = np.zeros(2 * BUCKETS), 0.0, 1.0, 4.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 150) -> Classifier:
        """rows: features of texts. With labels of one kind only, or none, every text is kept."""
        if len(set(labels.tolist())) < 2:
            return self
        held = np.arange(len(rows)) % 5 == 4
        if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
            held = np.zeros(len(rows), dtype=bool)
        own = [r for r, h in zip(rows, held, strict=True) if not h]
        y = labels[~held].astype(float)
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))  # both kinds count alike
        # Some rows at a time: the driver holds one copy of the features and little more.
        parts = []
        for rows_ in np.array_split(np.arange(len(own)), -(-len(own) // FITTED)):
            some = [own[i] for i in rows_]
            parts.append((rows_, np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some]), [len(r[0]) for r in some]))
        del own
        w, b, rate = np.zeros(2 * BUCKETS), 0.0, 4.0
        mw, mb = np.zeros_like(w), 0.0
        for _ in range(steps):
            ahead, slope, total = w + 0.9 * mw, 1e-4 * w, 0.0
            for rows_, at, value, sizes in parts:
                row = np.repeat(np.arange(len(sizes)), sizes)
                z = np.bincount(row, weights=value * ahead[at], minlength=len(sizes)) + b + 0.9 * mb
                error = weight[rows_] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows_])
                slope += np.bincount(at, weights=value * error[row], minlength=2 * BUCKETS)
                total += error.sum()
            mw, mb = 0.9 * mw - rate * slope, 0.9 * mb - rate * total
            w, b = w + mw, b + mb
        self.weights, self.bias = w, b
        sample = held if held.any() else ~held
        self._calibrate(np.array([self._raw(r) for r, h in zip(rows, sample, strict=True) if h]), labels[sample].astype(float))
        return self

    def _raw(self, row: tuple[np.ndarray, np.ndarray]) -> float:
        return float((self.weights[row[0]] * row[1]).sum() + self.bias)

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        a, c = 1.0, 0.0
        n1, n0 = y.sum(), (1 - y).sum()
        goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # Platt's targets
        for _ in range(50):  # Newton's steps, damped
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
            g = np.array([((p - goal) * z).sum(), (p - goal).sum()])
            s = p * (1 - p) + 1e-9
            hessian = np.array([[(s * z * z).sum(), (s * z).sum()], [(s * z).sum(), s.sum()]]) + 1e-6 * np.eye(2)
            move = np.clip(np.linalg.solve(hessian, g), -1, 1)
            a, c = a - move[0], c - move[1]
            if np.abs(move).max() < 1e-9:
                break
        self.slope, self.shift = float(a), float(c)

    def probability(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self._raw(features(text)) + self.shift, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Classifier:
    """A classifier from at most rows labelled texts, those of the lowest hash of doc_id; all of them up to that bound.

    Rows without doc_id or quality don't train, nor do labels of documents that docs lacks, which take no place of the bound; of several
    different labels of a document each counts, with one text.
    """
    known = labels.filter("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = known.distinct().join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    # At most `rows` pairs of numbers, so that they can be sent to every task. Of a document's texts one trains.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen.distinct()), "doc_id")
    found = found.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    @F.pandas_udf("at binary, value binary")
    def sparse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(at.astype(np.uint16).tobytes(), value.tobytes()) for at, value in map(features, texts)], columns=["at", "value"])

    # The driver gets no text: of each at most 2 * BUCKETS places and values, of six bytes.
    sample = found.select("doc_id", "quality", sparse("text").alias("f")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").collect()
    vectors = [(np.frombuffer(r["f"]["at"], dtype=np.uint16), np.frombuffer(r["f"]["value"], dtype=np.float32)) for r in sample]
    return Classifier().fit(vectors, np.array([int(r["quality"] > 0) for r in sample], dtype=int))


def judge_quality(docs: DataFrame, labels: DataFrame, rows: int = ROWS, keep: float = KEEP) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality and kept.

    The counts are of whole texts. base_failed: under MIN_WORDS words, or over MAX_REPEATED hundredths of the
    words in repeated windows of WINDOW words. kept: not base_failed and quality, the calibrated probability,
    at least keep. A null text is an empty one; repeated rows are judged alike; without labels
    of both kinds only the base counts; an empty table gives an empty result; columns of the input
    named like an added one are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    @F.pandas_udf(f"{STATS}, quality double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        out = [(*statistics(t), model.value.probability(t)) for t in (x or "" for x in texts)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in STATS.split(", ")] + ["quality"])

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"]
    docs = docs.drop(*names)
    out = docs.withColumn("_q", judge(F.coalesce("text", F.lit("")))).select(*docs.columns, "_q.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep))


__all__ = ["Classifier", "judge_quality", "statistics", "train"]
