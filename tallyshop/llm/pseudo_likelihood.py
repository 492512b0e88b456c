"""Language-model scores by masked pseudo-likelihood.

A small network looks at the ``SIDE`` words on either side of a word and predicts it: word
vectors, a tanh layer, a softmax over word classes. The most frequent words are classes of
their own, all others share hashed ones, within which a word has its share of the corpus
counts. The log-probabilities of all words of a text, each given its neighbours, sum to
the text's score. Texts are cut into words twice: to count them, and to number them; training
and scoring read the numbers, two bytes a word.

The vocabulary counts every word of the corpus. Words beyond the numbered ones have a class of
their own together, and their counts, a table that grows with the corpus, are joined when texts
are scored. Training covers every word: in each round, each task trains a copy of the network
in numpy on masked words (one in ``ROUNDS``, others each round) of all its texts, so that each
word is a target once; the copies are averaged, weighted by the words they saw, by a grouped
sum. So what is gathered grows with the corpus, and what the driver gets is one network.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshop.llm import words as W
from tallyshop.llm.storage import opened, saved, shared

VOCABULARY = 4_096
OWN, SHARED = 127, 32
SIDE, SIZE, HIDDEN = 2, 16, 32
ROUNDS, BATCH = 2, 512
_CLASSES = OWN + SHARED + 1  # one for words beyond the vocabulary
_EDGE = VOCABULARY  # the vector of what lies beyond a text; further ones for rarer words
_RARE = 64
_STEPS = np.array([d for d in range(-SIDE, SIDE + 1) if d])
_SHAPES = {
    "vectors": (VOCABULARY + 1 + _RARE, SIZE),
    "w1": (2 * SIDE * SIZE, HIDDEN),
    "b1": (HIDDEN,),
    "w2": (HIDDEN, _CLASSES),
    "b2": (_CLASSES,),
}


@dataclass
class Vocabulary:
    """Sorted hashes of the most frequent words, their numbers and classes, and the log-share
    of each word in its class (``rare``: of a word beyond the vocabulary that occurs once)."""

    hashes: np.ndarray
    number: np.ndarray
    classes: np.ndarray
    log_share: np.ndarray
    rare: float


def _word_counts(batches):
    for batch in batches:
        for _, _, data, offsets in W.slices(batch.column("text")):
            hashes = W.find_words(data, offsets, W.ALNUM).hashes(W.ALNUM)
            word, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])


def vocabulary(texts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The ``VOCABULARY`` most frequent words, numbered, and ``(word, n)``: the counts of all
    words of the corpus."""
    counts = texts.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = saved(counts)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    word = np.array([r.word for r in top], np.int64).view(np.uint64)
    n = np.array([r.n for r in top], float)
    rank = np.arange(len(word))
    classes = np.where(rank < OWN, rank, OWN + (word % np.uint64(SHARED)).astype(np.int64))
    mass = np.bincount(classes, n, _CLASSES)
    order = np.argsort(word)
    return Vocabulary(
        word[order], rank[order], classes, np.log(n / mass[classes]),
        -float(np.log(max(1, total - sum(r.n for r in top)))),
    ), counts


def _numbers(hashes: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The number of each word: its rank, or for one beyond the vocabulary ``_EDGE + 1`` and more."""
    out = _EDGE + 1 + (hashes % np.uint64(_RARE)).astype(np.int16)
    if len(vocab.hashes):
        at = np.minimum(np.searchsorted(vocab.hashes, hashes), len(vocab.hashes) - 1)
        known = vocab.hashes[at] == hashes
        out[known] = vocab.number[at[known]]
    return out


def _of_numbers(vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Per number: its class, and the log-share in the class."""
    known, numbers = len(vocab.classes), VOCABULARY + 1 + _RARE
    classes, share = np.full(numbers, _CLASSES - 1), np.full(numbers, vocab.rare)
    classes[:known], share[:known] = vocab.classes, vocab.log_share
    return classes, share


#: Words whose contexts are held at once, at least one text.
_PART = 1 << 17


def _parts(column: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from, to, numbers, first)`` for runs of texts, ``first`` where each text's words begin."""
    offsets, values = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + _PART, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to, values[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _padded(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers with ``SIDE`` edges around each text, and where each word is in them."""
    texts = len(first) - 1
    at = np.arange(len(numbers)) + np.repeat(SIDE * np.arange(1, texts + 1), np.diff(first))
    out = np.full(len(numbers) + SIDE * (texts + 1), _EDGE, np.int16)
    out[at] = numbers
    return out, at


def initial(seed: int = 23) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        k: (rng.normal(0, 1 / np.sqrt(shape[0] if k[0] == "w" else 4), shape) if len(shape) == 2 else np.zeros(shape)).astype(np.float32)
        for k, shape in _SHAPES.items()
    }


def _forward(net: dict, context: np.ndarray):
    x = net["vectors"].take(context, axis=0).reshape(len(context), -1)
    h = np.tanh(x @ net["w1"] + net["b1"])
    z = h @ net["w2"]
    z += net["b2"]
    # no logit is beyond this bound, so exp needs the maximum taken off only where it is large
    if np.abs(net["w2"]).sum(0).max() + np.abs(net["b2"]).max() > 80:
        z -= z.max(1, keepdims=True)
    return x, h, z


def _learn(net: dict, context: np.ndarray, target: np.ndarray, rate: float) -> None:
    for a in range(0, len(target), BATCH):
        c, y = context[a : a + BATCH], target[a : a + BATCH]
        x, h, z = _forward(net, c)
        p = np.exp(z, out=z)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= rate / len(y)
        back = (p @ net["w2"].T) * (1 - h * h)
        net["w2"] -= h.T @ p
        net["b2"] -= p.sum(0)
        pull = (back @ net["w1"].T).reshape(-1, SIZE)
        net["w1"] -= x.T @ back
        net["b1"] -= back.sum(0)
        flat = c.ravel()
        order = flat.argsort(kind="stable")
        number = flat[order]
        begin = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        net["vectors"][number[begin]] -= 8 * np.add.reduceat(pull[order], begin, axis=0)


def _round_of(numbers: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The one round in which each word, at its place inside its text, is a target."""
    return (W.mix(numbers.astype(np.uint64) + (inside.astype(np.uint64) << np.uint64(16))) % np.uint64(ROUNDS)).astype(np.int64)


def _train_copies(round_: int):
    def run(state, batches):
        vocab, start = state
        net, seen = {k: v.copy() for k, v in start.items()}, 0
        classes, _ = _of_numbers(vocab)
        for batch in batches:
            for _, _, numbers, first in _parts(batch.column("numbers")):
                inside = np.arange(len(numbers)) - np.repeat(first[:-1], np.diff(first))
                # the round in which a word is masked depends on the word and its place only
                places = np.flatnonzero(_round_of(numbers, inside) == round_)
                if len(places) == 0:
                    continue
                padded, at = _padded(numbers, first)
                _learn(net, padded[at[places, None] + _STEPS], classes[numbers[places]], 0.5 / (1 + round_))
                seen += len(places)
        if seen:
            flat = np.concatenate([net[k].ravel() for k in _SHAPES]).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), seen))],
                ["i", "v", "n"],
            )

    return run


def numbered(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, numbers, words, times, copies)`` for every row, saved: a hash of the text, the
    numbers of its words and, in one of the rows of a slice with equal texts, the words beyond
    the vocabulary with ``times`` summed over those rows, and their number."""
    held, kind = shared(docs.sparkSession, vocab), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        yield from _numbered(opened(held), batches)

    return saved(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
            run,
            f"id {kind}, key long, numbers array<smallint>, words array<long>, times array<long>, copies long",
        )
    )


def _numbered(vocab: Vocabulary, batches):
    for batch in batches:
        for lo, hi, data, offsets in W.slices(batch.column("text")):
            found = W.find_words(data, offsets, W.ALNUM)
            hashes = found.hashes(W.ALNUM)
            numbers, keys = _numbers(hashes, vocab), _text_keys(data, offsets)
            _, of, same = np.unique(keys, return_index=True, return_inverse=True)
            copies = np.zeros(len(keys), np.int64)
            copies[of] = np.bincount(same)
            rare = (numbers > _EDGE) & (copies > 0)[found.owner()]
            owner, word = found.owner()[rare], hashes[rare].view(np.int64)
            order = np.lexsort((word, owner))
            owner, word = owner[order], word[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])
            times = np.diff(np.append(np.flatnonzero(new), len(owner))) * copies[owner[new]]
            held = np.bincount(owner[new], minlength=len(keys))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(lo, hi - lo),
                    pa.array(keys),
                    W.list_array(pa.array(numbers), found.counts()),
                    W.list_array(pa.array(word[new]), held),
                    W.list_array(pa.array(times), held),
                    pa.array(copies),
                ],
                ["id", "key", "numbers", "words", "times", "copies"],
            )


def fit(docs: DataFrame, text_col: str = "text", seed: int = 23) -> tuple[Vocabulary, dict, DataFrame]:
    """Vocabulary, network and word counts of a corpus. A corpus without words keeps the initial
    network."""
    texts = docs.select(F.lit(0).alias("id"), F.col(text_col).cast("string").alias("text"))
    vocab, counts = vocabulary(texts)
    return vocab, _trained(numbered(texts, vocab, "id", "text"), vocab, seed), counts


def _trained(corpus: DataFrame, vocab: Vocabulary, seed: int) -> dict:
    net = initial(seed)
    for round_ in range(ROUNDS):
        held, train = shared(corpus.sparkSession, (vocab, net)), _train_copies(round_)

        def run(batches, held=held, train=train):
            yield from train(opened(held), batches)

        mean = (
            corpus.select("numbers").mapInArrow(run, "i long, v double, n long")
            .groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toPandas().sort_values("i")
        )
        if len(mean):
            flat, at = mean["v"].to_numpy(np.float32), 0
            for k, shape in _SHAPES.items():
                net[k] = flat[at : at + int(np.prod(shape))].reshape(shape)
                at += int(np.prod(shape))
    return net


#: Rows of each product of matrices when words are scored. One size for all, as others round
#: otherwise, so that a word's score does not depend on what is scored beside it.
_ROWS = 1 << 11


def word_scores(numbers: np.ndarray, first: np.ndarray, vocab: Vocabulary, net: dict) -> np.ndarray:
    """The conditional log-probability of each word, one beyond the vocabulary as if it occurred
    once."""
    classes, share = _of_numbers(vocab)
    padded, at = _padded(numbers, first)
    out, ones = np.empty(len(numbers)), np.ones(_CLASSES, np.float32)
    target = classes[numbers]
    for a in range(0, len(numbers), _ROWS):
        part = slice(a, a + _ROWS)
        context = np.full((_ROWS, len(_STEPS)), _EDGE, np.int16)
        words = len(target[part])
        context[:words] = padded[at[part, None] + _STEPS]
        _, _, z = _forward(net, context)
        own = z[np.arange(words), target[part]]
        out[part] = own - np.log(np.exp(z, out=z) @ ones)[:words]
    return out + share[numbers]


def _text_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hashes of whole texts, equal for equal texts."""
    return np.array(
        [
            int.from_bytes(hashlib.blake2b(data[a:b], digest_size=8).digest(), "little", signed=True)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        ],
        np.int64,
    )


def _score(state, batches):
    vocab, net = state
    for batch in batches:
        for lo, hi, numbers, first in _parts(batch.column("numbers")):
            total = np.concatenate([[0.0], np.cumsum(word_scores(numbers, first, vocab, net))])[first]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(lo, hi - lo),
                    batch.column("key").slice(lo, hi - lo),
                    pa.array(np.diff(first)),
                    pa.array(np.diff(total)),
                ],
                ["id", "key", "n_tokens", "base"],
            )


def score(
    docs: DataFrame, fitted: tuple[Vocabulary, dict, DataFrame], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_tokens, pseudo_log_likelihood, per_token)`` for every row.

    Tokens are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased.
    A text without tokens, or null, scores 0 and has no value per token. The share of a word
    beyond the vocabulary is its count over the counts of all such words; one that the fitted
    corpus does not have counts as one that occurs once. Repeated rows, null ids, empty tables
    and other columns make no difference: counts are joined by the text's hash, and equal
    texts have equal scores. Texts are read whole.
    """
    return _scored(numbered(docs, fitted[0], id_col, text_col), fitted, id_col)


def fit_and_score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 23
) -> DataFrame:
    """``score`` of a corpus by the network fitted on itself, with its words numbered once."""
    vocab, counts = vocabulary(docs.select(F.col(text_col).cast("string").alias("text")))
    corpus = numbered(docs, vocab, id_col, text_col)
    return _scored(corpus, (vocab, _trained(corpus, vocab, seed), counts), id_col)


def _scored(corpus: DataFrame, fitted: tuple[Vocabulary, dict, DataFrame], id_col: str) -> DataFrame:
    vocab, net, counts = fitted
    held, kind = shared(corpus.sparkSession, (vocab, net)), corpus.schema["id"].dataType.simpleString()

    def run(batches):
        yield from _score(opened(held), batches)

    scored = corpus.select("id", "key", "numbers").mapInArrow(
        run, f"id {kind}, key long, n_tokens long, base double"
    )
    often = counts.where("n > 1").select("word", F.log("n").alias("log_n"))
    beyond = corpus.select("key", "copies", F.posexplode(F.arrays_zip("words", "times")).alias("at", "x"))
    extra = (
        beyond.select(
            "key", F.col("x.words").alias("word"), F.col("x.times").alias("times"),
            F.when(F.col("at") == 0, F.col("copies")).alias("copies"),
        )
        .join(often, "word", "left")
        .groupBy("key")
        .agg((F.sum(F.col("times") * F.coalesce("log_n", F.lit(0.0))) / F.sum("copies")).alias("extra"))
    )
    total = F.col("base") + F.coalesce("extra", F.lit(0.0))
    return scored.join(extra, "key", "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        total.alias("pseudo_log_likelihood"),
        F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("per_token"),
    )
