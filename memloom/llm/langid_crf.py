"""Language identification by a linear-chain conditional random field over words.

Each word gets a language; a chain's score is the sum of its words' feature weights and of the
learned transitions between neighbours' languages.  Features: affixes of 1 to 4 characters,
character n-grams of 2 to 4, the word itself, and the word's standing in a lexicon of the
training sample.  Training chains are spliced from runs of differently labelled documents, so
that transitions learn what switching looks like.  Forward-backward gives every word's
posterior; a document's language is the one with most posterior mass over its letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.shared import fresh

#: Bound of the training sample: labelled documents of each language, the characters of one of
#: them, and labelled documents of all languages together, of which each then gets an equal part.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_ALL = 240, 12_000, 24_000
#: Words used of the sample for each language, half for the lexicon and half for the weights.
SAMPLE_WORDS = 50_000
#: Words of a chain; longer texts are labelled chain by chain, without gaps.
CHAIN = 64
#: Hashed features.
BUCKETS = 1 << 17
#: Distinct words whose emissions a worker remembers; emptied when full.
REMEMBERED = 120_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_RATES = (1.0, 2.0, 4.0, 8.0)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; figures that count as word characters, such as ² or Ⅳ, part them."""
    words = _WORD.findall(text.lower()) if text else []
    if not "".join(words).isalpha() and words:
        words = [w for word in words for w in "".join(c if c.isalpha() else " " for c in word).split()]
    return words


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of distinct words: the feature numbers, and each word's offset among them."""
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.zeros(len(words), np.int64)
    np.cumsum(lengths[:-1] + 2, out=first[1:])
    owner = np.repeat(np.arange(len(words)), lengths + 2)
    keys, owners = [], []

    def add(kind: int, values: np.ndarray, who: np.ndarray) -> None:
        keys.append(_spread(values * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind)))
        owners.append(who)

    base = np.uint64(1_000_003)
    rolling = codes.copy()
    for n in (2, 3, 4):  # n-grams over the word with its edge marks: those at the edges are its affixes
        rolling = rolling[:-1] * base + codes[n - 1 :]
        inside = owner[: len(rolling)] == owner[n - 1 :]
        add(n, rolling[inside], owner[: len(rolling)][inside])
    for n in (1, 2, 3, 4):  # prefixes and suffixes as such, of words that are long enough
        long = np.flatnonzero(lengths >= n)
        head, tail = np.zeros(len(long), np.uint64), np.zeros(len(long), np.uint64)
        for i in range(n):
            head = head * base + codes[first[long] + 1 + i]
            tail = tail * base + codes[first[long] + 1 + lengths[long] - n + i]
        add(10 + n, head, long)
        add(20 + n, tail, long)
    whole = np.zeros(len(words), np.uint64)
    powers = np.power(np.full(int(lengths.max(initial=0)) + 2, base), np.arange(int(lengths.max(initial=0)) + 2, dtype=np.uint64))
    np.add.at(whole, owner, codes * powers[np.arange(len(codes)) - first[owner]])
    add(30, whole, np.arange(len(words)))
    key, who = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    numbers = (key[order] % np.uint64(BUCKETS)).astype(np.int32)
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bincount(who, minlength=len(words)), out=offsets[1:])
    return numbers, offsets


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray = field(repr=False)
    lexicon: dict[str, int] = field(repr=False)
    lexical: np.ndarray = field(repr=False)
    transitions: np.ndarray = field(repr=False)
    start: np.ndarray = field(repr=False)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores (words x languages) of distinct words."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        numbers, offsets = features(words)
        sums = np.add.reduceat(self.weights[numbers], offsets[:-1], axis=0)
        return sums + self.lexical[[self.lexicon.get(w, 0) for w in words]]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray):
    """Posteriors of chains side by side.  scores: steps x chains x languages, chains of given lengths,
    longest first.  Returns the posteriors, the chains' log-partition values, and the expected transitions."""
    steps, chains, k = scores.shape
    peak = scores.max(2, keepdims=True)
    e = np.exp(scores - peak)
    t = np.exp(transitions)
    alive = [int(np.searchsorted(-lengths, -s, "left")) for s in range(steps + 1)]  # chains longer than s
    alpha, scale = np.zeros_like(e), np.ones((steps, chains), e.dtype)
    a = np.exp(start)[None, :] * e[0]
    for s in range(steps):
        n = alive[s]
        if s:
            a = (a[:n] @ t) * e[s, :n]
        z = a.sum(1, keepdims=True)
        a = a / z
        alpha[s, :n], scale[s, :n] = a, z[:, 0]
    beta = np.ones((chains, k), e.dtype)
    gamma = np.zeros_like(e)
    pairs = np.zeros((k, k), np.float64)
    gamma[steps - 1, : alive[steps - 1]] = alpha[steps - 1, : alive[steps - 1]]
    for s in range(steps - 2, -1, -1):
        n = alive[s + 1]
        ahead = e[s + 1, :n] * beta[:n] / scale[s + 1, :n, None]
        pairs += t * (alpha[s, :n].T @ ahead)
        beta[:n] = ahead @ t.T
        gamma[s, : alive[s]] = alpha[s, : alive[s]] * beta[: alive[s]]
    mask = np.arange(steps)[:, None] < lengths[None, :]
    log_z = ((np.log(scale) + peak[:, :, 0]) * mask).sum(0)
    return gamma, log_z, pairs


def chains_of(lengths: list[int], size: int = CHAIN) -> np.ndarray:
    """(first word, words) of the chains of texts with so many words, longest first."""
    parts, at = [], 0
    for n in lengths:
        parts += [(at + i, min(size, n - i)) for i in range(0, n, size)]
        at += n
    out = np.array(parts, np.int64).reshape(-1, 2)
    return out[np.argsort(-out[:, 1], kind="stable")]


def _padded(values: np.ndarray, chains: np.ndarray) -> np.ndarray:
    """values of the chains' words as steps x chains (x anything), padded with the first value."""
    steps = int(chains[0, 1])
    index = chains[None, :, 0] + np.arange(steps)[:, None]
    return values[np.where(np.arange(steps)[:, None] < chains[None, :, 1], index, chains[None, :, 0])]


def train(texts: list[str], labels: list[str], seed: int = 7, epochs: int = 6, batch: int = 256, rate: float = 0.3, decay: float = 1e-6) -> Model:
    """Fits the field by AdaGrad on the conditional likelihood; the same input gives the same model."""
    languages = sorted(set(labels))
    k, rng = len(languages), np.random.default_rng(seed)
    number = {l: i for i, l in enumerate(languages)}
    pools: list[list[list[str]]] = [[] for _ in languages]
    counts: list[Counter] = [Counter() for _ in languages]
    seen, taken = [0] * k, [0] * k
    for text, label in zip(texts, labels):
        y, words = number[label], words_of(text)
        if seen[y] >= SAMPLE_WORDS or not words:
            continue
        seen[y] += len(words)
        # by turns within a language, so that each has both, in whatever order the languages come
        if taken[y] % 2:
            counts[y].update(words)
        else:
            pools[y].append(words)
        taken[y] += 1
    # the lexicon: a word's most frequent language, and by how much it leads
    lexicon: dict[str, int] = {}
    for y in range(k):
        for word, n in counts[y].items():
            others = max((counts[o][word] for o in range(k) if o != y), default=0)
            if n >= 2 and n > others:
                lead = sum((n + 0.5) / (others + 0.5) >= r for r in _RATES)
                lexicon[word] = 1 + y * (len(_RATES) + 1) + lead
    streams = [[w for words in pool for w in words] for pool in pools]
    # chains spliced from runs of 4 to 40 words; more than half of the runs stay in their language
    words, truth, at = [], [], [0] * k
    while any(a < len(s) for a, s in zip(at, streams)):
        open_ = [y for y in range(k) if at[y] < len(streams[y])]
        y = open_[rng.integers(len(open_))]
        run = int(rng.integers(4, 41)) if rng.random() < 0.5 else CHAIN
        got = streams[y][at[y] : at[y] + run]
        at[y] += run
        words += got
        truth += [y] * len(got)
    vocabulary = sorted(set(words))
    place = {w: i for i, w in enumerate(vocabulary)}
    ids = np.array([place[w] for w in words], np.int64)
    truth = np.array(truth, np.int64)
    model = Model(languages, np.zeros((BUCKETS, k), np.float32), lexicon, np.zeros((1 + k * (len(_RATES) + 1), k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32))
    if not vocabulary or k == 1:
        return model
    numbers, offsets = features(vocabulary)
    lexical = np.array([lexicon.get(w, 0) for w in vocabulary], np.int64)
    steps = {name: np.full(getattr(model, name).shape, 1e-6, np.float32) for name in ("weights", "lexical", "transitions", "start")}
    every = chains_of([len(ids)])
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(every)), max(1, len(every) // batch)):
            chosen = every[np.sort(part)]  # stays longest first
            w, y = _padded(ids, chosen), _padded(truth, chosen)
            mask = np.arange(len(w))[:, None] < chosen[None, :, 1]
            distinct, inverse = np.unique(w, return_inverse=True)
            inverse = inverse.reshape(w.shape)
            spans = [np.arange(offsets[d], offsets[d + 1]) for d in distinct]
            rows = numbers[np.concatenate(spans)]
            starts = np.zeros(len(distinct), np.int64)
            np.cumsum([len(s) for s in spans[:-1]], out=starts[1:])
            scores = np.add.reduceat(model.weights[rows], starts, axis=0) + model.lexical[lexical[distinct]]
            gamma, _, pairs = forward_backward(scores[inverse].astype(np.float64), chosen[:, 1], model.transitions, model.start)
            gold = np.zeros_like(gamma)
            np.put_along_axis(gold, y[:, :, None], 1.0, 2)
            error = (gold - gamma) * mask[:, :, None]
            by_word = np.zeros((len(distinct), k))
            np.add.at(by_word, inverse.ravel(), error.reshape(-1, k))
            seen_pairs = np.zeros((k, k))
            np.add.at(seen_pairs, (y[:-1][mask[1:]], y[1:][mask[1:]]), 1.0)
            grads = {"transitions": seen_pairs - pairs, "start": error[0].sum(0)}
            for name, g in grads.items():
                steps[name] += (g / len(chosen)) ** 2
                getattr(model, name)[:] += (rate * g / len(chosen) / np.sqrt(steps[name])).astype(np.float32)
            per_feature = np.repeat(by_word, [len(s) for s in spans], axis=0) / len(chosen)
            touched, back = np.unique(rows, return_inverse=True)
            g = np.zeros((len(touched), k))
            np.add.at(g, back, per_feature)
            g -= decay * model.weights[touched]
            steps["weights"][touched] += g**2
            model.weights[touched] += (rate * g / np.sqrt(steps["weights"][touched])).astype(np.float32)
            g = np.zeros_like(model.lexical, dtype=np.float64)
            np.add.at(g, lexical[distinct], by_word / len(chosen))
            steps["lexical"] += g**2
            model.lexical += (rate * g / np.sqrt(steps["lexical"])).astype(np.float32)
    return model


class Labeller:
    """Word posteriors of whole texts under a model."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.empty((1024, len(self.model.languages)), np.float32)

    def posteriors(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Per text, of given words, the posteriors (words x languages)."""
        k = len(self.model.languages)
        lengths = [len(t) for t in texts]
        total = sum(lengths)
        if not total or not k:
            return [np.zeros((n, k), np.float32) for n in lengths]
        new = set().union(*texts).difference(self.place)
        if len(self.place) + len(new) > REMEMBERED:
            self._reset()
            new = set().union(*texts)
        if new:
            new = sorted(new)
            used = len(self.place)
            while used + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[used : used + len(new)] = self.model.emissions(new)
            self.place.update(zip(new, range(used, used + len(new))))
        ids = np.fromiter((i for t in texts for i in map(self.place.__getitem__, t)), np.int64, total)
        chains = chains_of(lengths)
        gamma, _, _ = forward_backward(self.table[_padded(ids, chains)], chains[:, 1], self.model.transitions, self.model.start)
        out = np.empty((total, k), np.float32)
        mask = np.arange(len(gamma))[:, None] < chains[None, :, 1]
        index = chains[None, :, 0] + np.arange(len(gamma))[:, None]
        out[index[mask]] = gamma[mask]
        return np.split(out, np.cumsum(lengths)[:-1])

    def document(self, words: list[str], posterior: np.ndarray) -> tuple[str, float]:
        """The language with most posterior mass over the letters, and its share; ``und`` and 0 without letters."""
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        letters = np.fromiter(map(len, words), np.float64, len(words))
        mass = letters @ posterior / letters.sum()
        best = int(np.argmax(mass))
        return self.model.languages[best], float(min(1.0, max(0.0, mass[best])))


def sample(df: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[str]]:
    """The bounded training sample: of each language the labelled rows with the smallest hashes.
    Rows labelled ``und`` teach no language and are left out; so are labels beyond SAMPLE_ALL, in
    the order of their names."""
    rows = df.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= SAMPLE_CHARS) & (F.col(label_col) != UNKNOWN))
    keyed = rows.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), F.xxhash64(id_col, F.lit(11)).alias("h"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("h", "id", "text"))
    labels = df.select(F.col(label_col).cast("string").alias("label")).where(F.col("label") != UNKNOWN).distinct()
    known = [r["label"] for r in labels.orderBy("label").limit(SAMPLE_ALL).collect()]
    if not known:
        return [], []
    got = keyed.withColumn("nth", nth).where((F.col("nth") <= min(SAMPLE_DOCS, SAMPLE_ALL // len(known))) & (F.col("label") <= known[-1]))
    got = got.orderBy("nth", "label").select("text", "label").toPandas()
    return got["text"].tolist(), got["label"].tolist()


def _batches(model, names: list[str], rows):
    """Runs a labeller over batches whose last column holds the texts; ``rows`` makes the columns that stand in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from memloom.llm.word_hashes import slices

        labeller = Labeller(model.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in slices(texts, lambda t: len(t or ""), 1 << 20):
                words = [words_of(t) for t in texts[a:b]]
                made = rows(labeller, words, labeller.posteriors(words))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], *names])

    return run


def _document_rows(labeller: Labeller, words, posteriors) -> list[pa.Array]:
    got = [labeller.document(w, p) for w, p in zip(words, posteriors)]
    return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]


def _span_rows(labeller: Labeller, words, posteriors) -> list[pa.Array]:
    """Runs of words with the same most likely language: (lang, first word, words, mean posterior)."""
    out = []
    for w, p in zip(words, posteriors):
        spans = []
        if len(w) and p.shape[1]:
            best = p.argmax(1)
            cuts = np.flatnonzero(np.diff(best)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(w)]):
                spans.append({"lang": labeller.model.languages[best[a]], "first_word": a, "n_words": b - a, "score": float(p[a:b, best[a]].mean())})
        out.append(spans)
    return [pa.array(out, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("score", pa.float64())])))]


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **options) -> Model:
    """A model from a bounded sample of the rows of df with text and label; without any, a model that knows no language."""
    texts, labels = sample(df, id_col, text_col, label_col)
    return train(texts, labels, **options)


def _with_text(df: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").cast("string").alias(fresh(columns, "_text")))


def predict(df: DataFrame, model: Model, columns: list[str], text_col: str = "text", lang: str = "_lang", score: str = "_score") -> DataFrame:
    """The given columns of df, with the language and score of the whole text."""
    rows = _with_text(df, columns, text_col)
    held = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights for each language and the sample's lexicon
    return rows.mapInArrow(_batches(held, [lang, score], _document_rows), _fields(df.select(*[F.col(f"`{c}`") for c in columns])) + f"`{lang}` string, `{score}` double")


def label_spans(df: DataFrame, model: Model, columns: list[str], text_col: str = "text", spans: str = "_spans") -> DataFrame:
    """The given columns of df, with the languages of code-switched text, run by run."""
    rows = _with_text(df, columns, text_col)
    held = df.sparkSession.sparkContext.broadcast(model)
    kind = "array<struct<lang: string, first_word: int, n_words: int, score: double>>"
    return rows.mapInArrow(_batches(held, [spans], _span_rows), _fields(df.select(*[F.col(f"`{c}`") for c in columns])) + f"`{spans}` {kind}")


def held_out(id_col: str):
    """Whether a row is kept from training: crc32 of its identifier as text, modulo 3, is 1.  A null identifier is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row per row of df: (doc_id, held_out, lang_pred, score).

    The model learns from text and label of rows that are not held out; a prediction sees the
    text alone.  lang_pred is a learned label, or ``und`` with score 0 where the text is null,
    has no letter, or nothing could be learned.  score is the share of the predicted language
    in the posterior mass over the text's letters.  An empty table gives an empty result; rows
    that repeat are each predicted; texts of any length are labelled whole, chain by chain; other columns of df are ignored.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang"))
    rows = rows.withColumn("held_out", held_out("doc_id"))
    model = fit(rows.where(~F.col("held_out")))
    out = predict(rows, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
