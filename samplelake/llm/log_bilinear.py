"""A log-bilinear language model by noise-contrastive estimation, and unigram scores."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold, staged, text_or_empty

#: The token after a text's last word. No word is this, for words have no white space.
END = "\n"


class Tokens:
    """The tokens of a batch of texts, each distinct one once. Words are in lower case (A-Z
    only) and stand between ASCII white space; after a text's words comes the end."""

    def __init__(self, texts: pa.Array | list[str]) -> None:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = split.flatten().dictionary_encode()
        real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
        codes = coded.indices.to_numpy()
        words = real[codes]  # white space at either end of a text leaves an empty part
        before = np.concatenate([[0], np.cumsum(words)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        #: Where each text begins, and where the last one ends.
        self.begins = before + np.arange(len(before))
        self.codes = np.full(self.begins[-1], len(real), np.int64)
        inside = np.ones(len(self.codes), bool)
        inside[self.begins[1:] - 1] = False
        self.codes[inside] = codes[words]
        self.distinct = pa.concat_arrays([coded.dictionary, pa.array([END], coded.dictionary.type)])
        self.names = self.distinct.to_pylist()

    def __getitem__(self, i: int) -> list[str]:
        """The tokens of one text."""
        return [self.names[c] for c in self.codes[self.begins[i] : self.begins[i + 1]]]

    def counted(self) -> Iterator[tuple[str, int]]:
        """The distinct tokens that occur, and how often."""
        return ((w, c) for w, c in zip(self.names, np.bincount(self.codes, minlength=len(self.names)).tolist()) if c)

    def those(self, chosen: np.ndarray) -> pa.ListArray:
        """Each text's tokens at the chosen positions."""
        ends = np.concatenate([[0], np.cumsum(chosen)])[self.begins]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.distinct.take(pa.array(self.codes[chosen])))


def tokens_of(text: str) -> list[str]:
    """One text's tokens."""
    return Tokens([text])[0]


class Model:
    """Vectors of the vocabulary's words as contexts (``R``) and as predictions (``Q``), a
    diagonal weight for each context position (``C``), and biases (``b``).

    Numbers: 0 the end, which also stands before a text; then words; then classes of words."""

    CONTEXT = 2

    def __init__(self, counts: np.ndarray, width: int) -> None:
        n = len(counts)
        rng = np.random.default_rng(5)
        self.noise = (counts / counts.sum()).astype(np.float32)
        self.cumulated = np.cumsum(counts / counts.sum())
        self.cumulated[-1] = 1.0
        self.R = rng.normal(0, 0.1, (n, width)).astype(np.float32)
        self.Q = rng.normal(0, 0.1, (n, width)).astype(np.float32)
        self.C = np.full((self.CONTEXT, width), 0.5, np.float32)
        self.b = np.log(np.maximum(self.noise, 1e-12)).astype(np.float32)
        #: AdaGrad's sums of squared gradients, one for each row.
        self.past = {name: np.full(len(getattr(self, name)), 1e-3, np.float32) for name in "RQCb"}

    def flat(self) -> np.ndarray:
        """A row for each word, R, Q and b side by side, then one for each of C."""
        words = np.concatenate([self.R, self.Q, self.b[:, None]], 1)
        rest = np.zeros((self.CONTEXT, words.shape[1]), np.float32)
        rest[:, : self.C.shape[1]] = self.C
        return np.concatenate([words, rest])

    def load(self, flat: np.ndarray) -> None:
        d = self.C.shape[1]
        words = flat[: -self.CONTEXT].astype(np.float32)
        self.R, self.Q, self.b = words[:, :d].copy(), words[:, d : 2 * d].copy(), words[:, 2 * d].copy()
        self.C = flat[-self.CONTEXT :, :d].astype(np.float32)

    def learn(self, before: np.ndarray, word: np.ndarray, rate: float, noises: int, rng: np.random.Generator) -> None:
        """One step of noise-contrastive estimation on a batch. All its positions share the
        ``noises`` samples of the unigram noise, so scores come from matrix products."""
        drawn = np.searchsorted(self.cumulated, rng.random(noises))
        shift = np.float32(np.log(noises))
        ahead = sum(self.R[before[:, i]] * self.C[i] for i in range(self.CONTEXT))
        log_noise = np.log(np.maximum(self.noise, 1e-12))
        real = np.einsum("ij,ij->i", ahead, self.Q[word]) + self.b[word] - log_noise[word] - shift
        fake = ahead @ self.Q[drawn].T + (self.b[drawn] - log_noise[drawn]) - shift
        up = 1 / (1 + np.exp(np.clip(real, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(fake, -30, 30)))
        toward = up[:, None] * self.Q[word] + down @ self.Q[drawn]
        d_q = np.concatenate([up[:, None] * ahead, down.T @ ahead])
        d_b = np.concatenate([up, down.sum(0)])
        every = np.concatenate([word, drawn])
        for i in range(self.CONTEXT):
            rows = before[:, i]
            gain = (toward * self.R[rows]).mean(0)
            self._step("R", *_sums(rows, toward * self.C[i]), rate)
            self._step("C", np.array([i]), gain[None], rate * 0.1)
        self._step("Q", *_sums(every, d_q), rate)
        self._step("b", *_sums(every, d_b), rate * 0.1)

    def _step(self, name: str, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
        past = self.past[name]
        past[rows] += (gradient * gradient).reshape(len(rows), -1).mean(1)
        scale = rate / np.sqrt(past[rows])
        getattr(self, name)[rows] += gradient * (scale if gradient.ndim == 1 else scale[:, None])

    def tables(self) -> tuple[np.ndarray, ...]:
        """One table of scores for each context position, the biases, and the logarithm of
        the sum over the vocabulary for each pair of context words: batched products."""
        parts = [(self.R * self.C[i]) @ self.Q.T for i in range(self.CONTEXT)]
        n = len(self.b)
        total = np.empty((n, n), np.float32)
        low = parts[1] + self.b
        for i in range(n):
            scores = low + parts[0][i]
            top = scores.max(1)
            total[i] = top + np.log(np.exp(scores - top[:, None]).sum(1))
        return (*parts, self.b, total)


def _sums(rows: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the sum of what belongs to each."""
    order = np.argsort(rows, kind="stable")
    ranked = rows[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    return ranked[starts], np.add.reduceat(what[order], starts, axis=0)


def token_counts(docs: DataFrame, held_entries: int = 400_000) -> DataFrame:
    """(token, c) over all training texts. A task adds up its own tokens before the shuffle,
    and hands on what it has whenever it holds ``held_entries`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["token", "c"])

        for batch in batches:
            for token, c in Tokens(batch.column(0)).counted():
                held[token] += c
            if len(held) > held_entries:
                yield out()
        yield out()

    return docs.filter("NOT held_out").select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Entries:
    """The model's entry of each token: a frequent word's own, or that of its class, which is
    its ending's hash and so needs no list of words."""

    def __init__(self, vocabulary: list[str], classes: int, ending: int = 2) -> None:
        self.index = {w: i for i, w in enumerate(vocabulary)}
        self.words, self.classes, self.ending = len(vocabulary), classes, ending
        self.known: dict[str, int] = {}

    def of(self, token: str) -> int:
        ending = token[-self.ending :]
        found = self.known.get(ending)
        if found is None:
            found = self.words + zlib.crc32(ending.encode("utf-8", "replace")) % self.classes
            if len(self.known) < 65_536:
                self.known[ending] = found
        return found

    def column(self, token: str) -> Column:
        """The class of a token's column."""
        return F.pmod(F.crc32(F.expr(f"right({token}, {self.ending})").cast("binary")), F.lit(self.classes)).cast("int")

    def numbers(self, tokens: Tokens) -> np.ndarray:
        """The entry of each token, in order."""
        get, of = self.index.get, self.of
        return np.array([i if (i := get(w)) is not None else of(w) for w in tokens.names], np.int32)[tokens.codes]


def contexts(flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The two tokens before each position; before a text stands the end."""
    out = np.zeros((len(flat), Model.CONTEXT), np.int32)
    out[1:, 0] = flat[:-1]
    out[2:, 1] = flat[:-2]
    starts = begins[:-1]
    out[starts] = 0
    seconds = starts[np.diff(begins) > 1] + 1
    out[seconds, 1] = 0
    return out


def train(docs: DataFrame, entries: Entries, counts: np.ndarray, width: int, rounds: int, rate: float, noises: int, batch: int) -> Model:
    """Each task learns from all its training texts, starting from the same parameters;
    their mean, weighted by tokens, is the next round's start. Rows of the parameters are
    added up by the shuffle, so the driver gets one model's rows however many tasks ran."""
    model = Model(counts, width)
    for turn in range(rounds):
        start = model.flat()

        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = start, turn: int = turn) -> Iterator[pa.RecordBatch]:
            own, seen = Model(counts, width), 0
            own.load(start)
            rng = np.random.default_rng(11 + turn)
            for some in batches:
                tokens = Tokens(some.column(0))
                flat = entries.numbers(tokens)
                before = contexts(flat, tokens.begins)
                order = rng.permutation(len(flat))
                for i in range(0, len(order), batch):
                    at = order[i : i + batch]
                    seen += len(at)
                    own.learn(before[at], flat[at], rate, noises, rng)
            if seen:
                rows = own.flat().astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows.tolist(), pa.list_(pa.float64())), pa.array([seen] * len(rows), pa.int64())], names=["i", "v", "n"])

        sent = docs.filter("NOT held_out").select("text").mapInArrow(run, "i int, v array<double>, n long")
        sums = [F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(start.shape[1])]
        got = sent.groupBy("i").agg(F.sum("n").alias("n"), *sums).collect()
        if got:
            flat = start.astype(np.float64).copy()
            for r in got:
                flat[r["i"]] = np.array(r[2:]) / r["n"]
            model.load(flat)
    return model


def frequent_tokens(counts: DataFrame, head: int) -> dict[str, int]:
    """The tokens with the highest counts, ``head`` at most: all tokens of the ranges of
    counts, an eighth of a power of two each, that still fit. The driver gets the ranges'
    sizes and these tokens only, however large the table of counts is."""
    wide = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(counts.groupBy(wide.alias("range")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    total, least = 0, None
    for r in sizes:
        total += r["n"]
        if total > head:
            break
        least = r["range"]
    return {} if least is None else {r["token"]: r["c"] for r in counts.filter(wide >= least).collect()}


@dataclass
class Scorer:
    """All that scoring needs: entries, counts of frequent tokens, the model's tables, and of
    each class the logarithm of its words' smoothed counts in sum."""

    entries: Entries
    known: dict[str, int]
    tables: tuple[np.ndarray, ...]
    class_totals: np.ndarray
    base_total: float

    def logs(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray, Tokens, np.ndarray, np.ndarray]:
        """Where texts begin; whether a token is known here; tokens; log10 of the model and of
        the unigrams, to which log10(c + 1) of a token that is not known here is to be added."""
        first, second, bias, total = self.tables
        tokens = Tokens(texts)
        flat = self.entries.numbers(tokens)
        before = contexts(flat, tokens.begins)
        logs = first[before[:, 0], flat] + second[before[:, 1], flat] + bias[flat] - total[before[:, 0], before[:, 1]]
        logs = logs.astype(np.float64) / float(np.log(10))
        counts = np.array([self.known.get(w, 0) for w in tokens.names], np.float64)
        sizes, seen = np.log10(counts + 1)[tokens.codes], (counts > 0)[tokens.codes]
        words = self.entries.words
        inside = flat < words
        logs += np.where(inside, 0.0, sizes - self.class_totals[np.where(inside, 0, flat - words)])
        return tokens.begins, seen, tokens, logs, sizes - self.base_total


def fitted(docs: DataFrame, counts: DataFrame, n: int, v: int, vocabulary_size: int, classes: int, head: int, width: int, rounds: int, rate: float, noises: int, batch: int) -> Scorer:
    """Learns from the rows of ``docs`` (text, held_out) that aren't held out."""
    known = frequent_tokens(counts, head)
    ranked = sorted((w for w in known if w != END), key=lambda w: (-known[w], w))
    vocabulary = [END, *ranked[: vocabulary_size - 1]]
    entries = Entries(vocabulary, classes)
    sums = {r["k"]: (r["c"], r["n"]) for r in counts.groupBy(entries.column("token").alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    mass = np.array([sums.get(k, (0, 0)) for k in range(classes)], np.float64).reshape(classes, 2)
    for w in vocabulary:
        if w in known:
            mass[entries.of(w) - entries.words] -= (known[w], 1)
    inside = [known.get(w, 0) for w in vocabulary]
    model = train(docs, entries, np.array([*inside, *mass[:, 0]], np.float64) + 0.5, width, rounds, rate, noises, batch)
    return Scorer(entries, known, model.tables(), np.log10(mass.sum(1) + 1), float(np.log10(n + v + 1)))


def score_texts(
    docs: DataFrame,
    vocabulary_size: int = 768,
    classes: int = 256,
    width: int = 16,
    rounds: int = 1,
    rate: float = 0.1,
    noises: int = 32,
    batch: int = 4096,
    head: int = 65_536,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Scores every whole text by a log-bilinear model and by smoothed unigrams.

    Tokens are counted over all training texts (crc32 of the id modulo 7 is not 2). The
    model predicts a token from the two before it: one of the ``vocabulary_size`` most
    frequent, or one of ``classes`` classes, to which all others belong by their endings, as
    tokens and as contexts. It is trained by noise-contrastive estimation on all training
    texts, in every task, and averaged. A token of a class has the probability of the class
    times its smoothed share (c + 1) / Z, where Z adds up c + 1 over the class's tokens and
    1 for unseen ones, so probabilities add up to 1 over the V training tokens and one unseen
    of each class. ``score`` is the sum of log10 over a text's tokens, its end included;
    ``base_score`` that of (c + 1) / (N + V + 1).

    The counts of the most frequent tokens, ``head`` at most, go to every task. All others
    of a text are joined with the whole table of counts, so nothing that grows is on the
    driver. The row of a text keeps its place (partition and number), so repeated rows and
    ids are scored each for itself. Null texts count as empty: one token, the end. Null ids
    are as the empty id. Without training texts N = V = 0. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), (fold(doc_id, 7) == 2).alias("held_out"))
    counts = staged(token_counts(keyed), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    shipped = spark.sparkContext.broadcast(fitted(keyed, counts, n, v, vocabulary_size, classes, head, width, rounds, rate, noises, batch))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shipped.value
        for some in batches:
            begins, seen, tokens, logs, base = scorer.logs(some.column(1))
            cuts = begins[:-1]
            sums = [np.add.reduceat(x, cuts) if len(cuts) else x[:0] for x in (seen.astype(np.int64), base, logs)]
            columns = [some.column(0), some.column(2), pa.array(np.diff(begins)), *map(pa.array, sums), tokens.those(~seen)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<string>"
    rows = staged(keyed.select("doc_id", "text", "held_out").mapInArrow(run, schema).withColumn("place", F.monotonically_increasing_id()), "scored")
    tail = rows.select("place", F.explode("tail").alias("token")).join(counts, "token")  # unseen tokens add log10(1)
    added = tail.groupBy("place").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("gain"))
    joined = rows.drop("tail").join(added, "place", "left")
    gain = F.coalesce("gain", F.lit(0.0))
    # a token that a task doesn't know is of a class: both scores gain as much
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + gain).alias("base_score"),
        (F.col("score") + gain).alias("score"),
    )
