"""Language-model scoring by a hashed maximum-entropy model (operator 5).

P(word | history) = P(class | history) * P(word | class). The most frequent words and the end of a text are classes of their
own; every other word is in one of TAIL classes, by a hash of its last two bytes. P(class | history) is a softmax over sums of weights of
features of the history: the class of the last word, that of the word before it (a skip feature), and both together, hashed
into PAIRS buckets. P(word | class) is (c + 1) / (sum of c + 1 over the class's words + 1), which leaves room for unknown words.

Training reads every training text: word counts, then counts of classes after histories, which is all that the likelihood's
gradient depends on. Gradient updates run distributed over the histories; each sends the sums of its features' gradients.
Scoring looks classes up in numpy batches. Counts of frequent words travel with the code (at most HEAD words); the other words of a text
meet their counts in a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, bucket_of, column, prepare, save, table, text_or_empty

#: Classes of single words (with the end), of other words, buckets of pair features; words whose counts travel with the code.
SINGLE, TAIL, PAIRS, HEAD = 96, 32, 2048, 200_000
CLASSES = SINGLE + TAIL
#: Gradient updates, their first step, entries of a worker's tables.
UPDATES, RATE, MAX_KEPT = 12, 0.3, 400_000
END = b""


def words_of(text: str) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id: Column) -> Column:
    """Rows without id belong to the training texts."""
    return F.coalesce(bucket_of(doc_id, 7) == 2, F.lit(False))


def word_counts(train: DataFrame) -> DataFrame:
    """word (binary; empty for the end), c: over all texts of `train`. Words are counted inside tasks before they are shuffled."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"])
            counts.clear()
            return out

        for batch in batches(rows):
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
            counts[END] += batch.num_rows
            if len(counts) >= MAX_KEPT:
                yield flush()
        if counts:
            yield flush()

    return train.select(text_or_empty().alias("text")).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def tail_class(word: Column) -> Column:
    return (F.crc32(F.substring(word, -2, 2)) % TAIL).cast("int") + SINGLE


@dataclass
class Vocabulary:
    """Head words with counts, the single-word classes, and the totals."""

    tokens: int  # N
    kinds: int  # V
    words: list[bytes]
    counts: np.ndarray
    class_log: np.ndarray  # log10 of the total of each class

    def __post_init__(self) -> None:
        # Head words in order of count; the end is always class 0, the most frequent words follow.
        self.index = {w: i for i, w in enumerate(self.words)}
        first = [i for i in range(len(self.words)) if self.words[i] != END][: SINGLE - 1]
        self.single = {self.words[i]: k + 1 for k, i in enumerate(first)}
        self.class_of = np.array([0 if w == END else self.single.get(w, -1) for w in self.words] or [0], dtype=np.int64)
        for i in np.flatnonzero(self.class_of < 0):
            self.class_of[i] = SINGLE + zlib.crc32(self.words[i][-2:]) % TAIL
        self.log_count = np.log10(self.counts + 1.0)

    def lookup(self) -> dict[bytes, int]:
        """word -> place among the head words, or len(words) + its class."""
        return _Places(self)


class _Places(dict):
    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary.index)
        self.n, self.kept = len(vocabulary.words), vocabulary.index

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.n + MAX_KEPT:
            self.clear()
            self.update(self.kept)
        self[word] = place = self.n + SINGLE + zlib.crc32(word[-2:]) % TAIL
        return place


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """Reads the totals and the most frequent words, at most `head` of them and all from some count up, and sums the classes."""
    band = F.when(F.col("c") < 1024, F.col("c")).otherwise(F.pow(F.lit(1.01), F.floor(F.log(F.col("c").cast("double")) / math.log(1.01))).cast("long"))
    bands = counts.groupBy(band.alias("low")).agg(F.count("*").alias("words"), F.sum("c").alias("tokens")).collect()  # a few thousand rows
    least, seen = math.inf, 0
    for r in sorted(bands, key=lambda r: -r.low):
        seen += r.words
        if seen > head:
            break
        least = r.low
    in_head = (F.col("c") >= least) if least < math.inf else F.lit(False)
    top = counts.filter(in_head | (F.col("word") == F.lit(END))).toArrow()
    order = sorted(zip(top["word"].to_pylist(), top["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    found = Vocabulary(sum(r.tokens for r in bands), sum(r.words for r in bands), [w for w, _ in order], np.array([c for _, c in order], dtype=np.int64), np.zeros(CLASSES))
    totals = np.ones(CLASSES)
    per_class = counts.groupBy(tail_class(F.col("word")).alias("k")).agg(F.sum(F.col("c") + 1).alias("total")).collect()
    for r in per_class:
        totals[r.k] += r.total
    for word, k in [*found.single.items(), (END, 0)]:
        count = int(found.counts[found.index[word]]) + 1 if word in found.index else 1
        if word in found.index:
            totals[SINGLE + zlib.crc32(word[-2:]) % TAIL] -= count
        totals[k] = count
    found.class_log = np.log10(totals)
    return found


def histories(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """History of each token, last class * CLASSES + the one before; before a text stand two ends. `starts` are places of first tokens."""
    last = np.concatenate(([0], classes[:-1]))
    before = np.concatenate(([0, 0], classes[:-2]))[: len(classes)]
    last[starts] = 0
    before[starts] = 0
    seconds = starts + 1
    before[seconds[seconds < len(classes)]] = 0
    return last * CLASSES + before


def read(batch: pa.Array, places: dict[bytes, int], vocab: Vocabulary) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, all places (texts end with END), all classes, and the places of the first tokens."""
    texts = [words_of(t) for t in batch.to_pylist()]
    lengths = np.array([len(w) + 1 for w in texts])
    flat = np.fromiter((p for w in texts for p in (*map(places.__getitem__, w), -1)), dtype=np.int64, count=int(lengths.sum()))
    n = len(vocab.words)
    classes = np.where(flat < 0, 0, np.where(flat < n, vocab.class_of[np.clip(flat, 0, max(n - 1, 0))], flat - n))
    return texts, flat, classes, np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)


def class_counts(train: DataFrame, vocab: Vocabulary) -> DataFrame:
    """history, c0 .. : how often each class follows a history. A task adds up what it reads; rows are summed by history."""
    schema = "history int, " + ", ".join(f"c{k} bigint" for k in range(CLASSES))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, total = vocab.lookup(), np.zeros(CLASSES**3, dtype=np.int64)
        for batch in batches(rows):
            _, _, classes, starts = read(batch.column(0), places, vocab)
            np.add(total, np.bincount(histories(classes, starts) * CLASSES + classes, minlength=CLASSES**3), out=total)
        total = total.reshape(-1, CLASSES)
        seen = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(seen), 4096):
            part = seen[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *[pa.array(total[part, k]) for k in range(CLASSES)]], names=["history", *[f"c{k}" for k in range(CLASSES)]])

    seen = train.select(text_or_empty().alias("text")).mapInArrow(run, schema)
    return seen.groupBy("history").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(CLASSES)])


def pair_bucket(history: np.ndarray) -> np.ndarray:
    mixed = (history.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(PAIRS)).astype(np.int64)


def active(history: np.ndarray) -> list[np.ndarray]:
    """Rows of the weight matrix that are on in a history: last class, class before, both."""
    return [history // CLASSES, CLASSES + history % CLASSES, 2 * CLASSES + pair_bucket(history)]


def log_softmax(weights: np.ndarray, history: np.ndarray) -> np.ndarray:
    """Natural log of P(class | history), a row for each history."""
    z = sum(weights[rows] for rows in active(history))
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def learn(counts: DataFrame, updates: int = UPDATES) -> tuple[np.ndarray, list[float]]:
    """(weights, log-likelihood before each update). The first weights make a bigram model of the classes; then AdaGrad.

    `counts` has at most CLASSES**2 rows, whatever the corpus. A step that lowers the likelihood is taken back and halved.
    """
    rows, names = 2 * CLASSES + PAIRS, [f"c{k}" for k in range(CLASSES)]
    weights, squares, likelihoods = np.zeros((rows, CLASSES)), np.full((rows, CLASSES), 1e-6), []
    bigrams = counts.groupBy(F.floor(F.col("history") / CLASSES).cast("int").alias("last")).agg(*[F.sum(c).alias(c) for c in names]).collect()
    if not bigrams:
        return weights, []
    seen = np.zeros((CLASSES, CLASSES))
    for r in bigrams:
        seen[r[0]] = r[1:]
    overall = (seen.sum(axis=0) + 0.5) / (seen.sum() + 0.5 * CLASSES)
    weights[:CLASSES] = np.log((seen + 50 * overall) / (seen.sum(axis=1, keepdims=True) + 50))
    schema = "row int, total double, " + ", ".join(f"g{k} double" for k in range(CLASSES))

    def gradient(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, total = np.zeros((rows, CLASSES)), 0.0
            for batch in parts:
                history = batch.column(0).to_numpy().astype(np.int64)
                n = np.stack([batch.column(k + 1).to_numpy() for k in range(CLASSES)], axis=1).astype(np.float64)
                logs = log_softmax(weights, history)
                total += float((n * logs).sum())
                off = n - n.sum(axis=1, keepdims=True) * np.exp(logs)
                for on in active(history):
                    np.add.at(sums, on, off)
            moved = np.flatnonzero(np.abs(sums).any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(moved, -1).astype(np.int32)), pa.array(np.append(np.zeros(len(moved)), total)),
                 *[pa.array(np.append(sums[moved, k], 0.0)) for k in range(CLASSES)]], names=["row", "total", *[f"g{k}" for k in range(CLASSES)]],
            )

        added = counts.mapInArrow(run, schema).groupBy("row").agg(F.sum("total").alias("total"), *[F.sum(f"g{k}").alias(f"g{k}") for k in range(CLASSES)]).toArrow()
        out, which = np.zeros((rows, CLASSES)), added["row"].to_numpy()
        table_ = np.stack([added[f"g{k}"].to_numpy() for k in range(CLASSES)], axis=1)
        out[which[which >= 0]] = table_[which >= 0]
        return float(added["total"].to_numpy()[which < 0][0]), out

    n, rate = max(seen.sum(), 1.0), RATE
    best, slope = gradient(weights)
    likelihoods.append(best)
    for _ in range(updates):
        scaled = slope / n
        step = rate * scaled / np.sqrt(squares + scaled**2)
        value, after = gradient(weights + step)
        if value > best:
            weights, squares, best, slope = weights + step, squares + scaled**2, value, after
        else:
            rate /= 2
        likelihoods.append(best)
    return weights, likelihoods


def visited(docs: DataFrame, vocab: Vocabulary, weights: np.ndarray) -> DataFrame:
    """Per row: what head words and classes contribute, and the words that aren't among the head words (with repeats)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    others = [c for c in docs.columns if c != "text"]
    sums = "n_tokens bigint, n_head bigint, head_log double, class_log10 double, within_log double"
    small = weights.astype(np.float32)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, n = vocab.lookup(), len(vocab.words)
        kept, known = np.zeros((CLASSES * CLASSES, CLASSES), dtype=np.float32), np.zeros(CLASSES * CLASSES, dtype=bool)
        end = vocab.index.get(END)
        for batch in batches(rows):
            texts, flat, classes, starts = read(batch.column("text"), places, vocab)
            history = histories(classes, starts)
            new = np.unique(history[~known[history]])
            for at in range(0, len(new), 1024):
                part = new[at : at + 1024]
                kept[part] = log_softmax(small, part)
                known[part] = True
            in_head = (flat >= 0) & (flat < n)
            logs = np.where(in_head, vocab.log_count[np.clip(flat, 0, max(n - 1, 0))] if n else 0.0, 0.0)
            if end is not None:
                logs[flat < 0] = vocab.log_count[end]
            add = lambda x, starts=starts: np.add.reduceat(x, starts)
            tails = [[w for w in words if places[w] >= n] for words in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others]
                + [
                    pa.array([len(w) + 1 for w in texts], pa.int64()), pa.array(add(in_head.astype(np.int64)) + (0 if end is None else 1), pa.int64()), pa.array(add(logs)),
                    pa.array(add(kept[history, classes].astype(np.float64)) / math.log(10)), pa.array(add(vocab.class_log[classes])), pa.array(tails, pa.list_(pa.binary())),
                ],
                names=[*others, "n_tokens", "n_head", "head_log", "class_log10", "within_log", "rare"],
            )

    return docs.select(*[column(c) for c in others], text_or_empty().alias("text")).mapInArrow(run, f"{fields + ', ' if fields else ''}{sums}, rare array<binary>")


RESULT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
_WORK = ("n_head", "head_log", "class_log10", "within_log", "rare", "rare_known", "rare_log", "__row")


def score(docs: DataFrame, train: DataFrame, head: int = HEAD, updates: int = UPDATES) -> DataFrame:
    """Columns of `docs` without `text`, and n_tokens, n_known, train_tokens, base_score, score.

    Columns of `docs` that have one of these names or a working name (n_head, rare ...) aren't kept. NULL and empty texts hold the end alone. Without training texts every word is unknown and each class as likely as any other.
    """
    docs = docs.drop(*RESULT, *_WORK)
    counts = save(word_counts(train), "maxent-counts")
    vocab = vocabulary(counts, head)
    weights, _ = learn(save(class_counts(train, vocab), "maxent-classes"))
    rows = save(visited(docs.withColumn("__row", F.monotonically_increasing_id()), vocab, weights), "maxent-rows")
    rare = rows.select("__row", F.explode("rare").alias("word")).groupBy("__row", "word").agg(F.count("*").alias("n"))
    found = rare.join(counts, "word").groupBy("__row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_log"))
    whole = rows.drop("rare").join(found, "__row", "left")
    counted = F.col("head_log") + F.coalesce("rare_log", F.lit(0.0))
    return whole.select(
        *[column(c) for c in docs.columns if c != "text"], "n_tokens", (F.col("n_head") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"), (counted - F.col("n_tokens") * F.lit(math.log10(vocab.tokens + vocab.kinds + 1))).alias("base_score"),
        (F.col("class_log10") + counted - F.col("within_log")).alias("score"),
    )


def op5_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return score(docs, docs.filter(~F.col("held_out")))


