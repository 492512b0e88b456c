"""Language identification with spans of mixed-language text.

The script of a word narrows the languages it can belong to. The rest are scored by naive
Bayes over the whole word and its byte trigrams, and a Viterbi path over the words of the
text, with a penalty for each switch, labels its spans.

The model is counts of hashed features per language, taken by Spark over a bounded, seeded
share of the labelled rows (``FIT_ROWS`` in expectation). It holds ``FEATURES`` numbers per
language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshop.llm import words as W
from tallyshop.llm.storage import opened, shared

FIT_ROWS = 20_000
WORD_BITS, TRIGRAM_BITS = 16, 15
# First and last code point of the ranges of each script.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
FEATURES = (1 << WORD_BITS) + (1 << TRIGRAM_BITS) + len(SCRIPTS) + 2
_NONE, _OTHER = 0, len(SCRIPTS) + 1
SWITCH = 12.0
_CLIP = 8.0


@dataclass
class Model:
    """Languages, log-probabilities of features (feature by language) and which scripts a
    language is written in (script by language)."""

    langs: list[str]
    log_p: np.ndarray
    allowed: np.ndarray


def _lowered(data: np.ndarray) -> np.ndarray:
    """Bytes in the word alphabet, with the capitals of Latin-1 lower-cased too."""
    out = W.ALNUM[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[capital] += 0x20
    return out


def _scripts(found: W.Words) -> np.ndarray:
    """The script of each word: that of its first letter beyond ASCII, else Latin if it has an
    ASCII letter, else none."""
    data = found.data
    out = np.zeros(len(found.starts), np.int64)
    letters = np.concatenate([[0], np.cumsum((W.ALNUM[data] >= 0x61) & (data < 0x80))])
    latin = list(SCRIPTS).index("latin") + 1
    out[letters[found.ends] > letters[found.starts]] = latin
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead) == 0:
        return out
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    b0, b1, b2 = padded[lead], padded[lead + 1] & 0x3F, padded[lead + 2] & 0x3F
    point = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1, (b0 & 0x0F) << 12 | b1 << 6 | b2)
    point[b0 >= 0xF0] = 0x10000
    script = np.full(len(lead), _OTHER)
    for i, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            script[(point >= a) & (point <= b)] = i + 1
    word = np.searchsorted(found.starts, lead, side="right") - 1
    word, at = np.unique(word, return_index=True)
    out[word] = script[at]
    return out


def _features(found: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word its own feature and its script; per byte of a word its trigram feature; and
    where each word's bytes begin among them."""
    low = _lowered(found.data)
    own = W.Words(low, found.starts, found.ends, found.first).hashes(np.arange(256, dtype=np.uint8))
    size = found.ends - found.starts
    begin = np.cumsum(size) - size
    at = np.repeat(found.starts - begin, size) + np.arange(int(size.sum()))
    here = low[at].astype(np.uint64)
    before = np.concatenate([[0], here[:-1]]).astype(np.uint64)
    before[begin] = 0
    after = np.concatenate([here[1:], [0]]).astype(np.uint64)
    after[begin[1:] - 1] = 0
    code = before << np.uint64(16) | here << np.uint64(8) | after
    tri = (W.mix(code) >> np.uint64(64 - TRIGRAM_BITS)).astype(np.int64) + (1 << WORD_BITS)
    return (own >> np.uint64(64 - WORD_BITS)).astype(np.int64), _scripts(found), tri, begin


def _count(batches):
    """``(lang, feature, n)`` of the labelled texts of a partition."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lo, hi, data, offsets in W.slices(batch.column("text")):
            found = W.find_words(data, offsets, W.ALNUM)
            if len(found.starts) == 0:
                continue
            own, script, tri, begin = _features(found)
            owner = langs[lo:hi][found.owner()]
            size = np.diff(np.concatenate([begin, [len(tri)]]))
            for lang in set(owner):
                mine = owner == lang
                total = totals.setdefault(lang, np.zeros(FEATURES, np.int64))
                total += np.bincount(own[mine], minlength=FEATURES)
                total += np.bincount(tri[np.repeat(mine, size)], minlength=FEATURES)
                total += np.bincount(script[mine] + FEATURES - len(SCRIPTS) - 2, minlength=FEATURES)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])],
            ["lang", "feature", "n"],
        )


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        rows: int = FIT_ROWS, seed: int = 5) -> Model:
    """Count features over about ``rows`` of the rows with a text and a language, a seeded
    share by id. No such rows give a model without languages."""
    usable = labelled.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where("text IS NOT NULL AND lang IS NOT NULL")
    share = min(1.0, rows / max(1, usable.count()))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 32)
    counts = (
        usable.where(draw <= int(share * 0xFFFFFFFF)).select("text", "lang")
        .mapInArrow(_count, "lang string, feature long, n long")
        .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    )
    langs = sorted(counts["lang"].unique())
    total = np.zeros((FEATURES, len(langs)))
    total[counts["feature"], np.searchsorted(langs, counts["lang"])] = counts["n"]
    log_p = np.zeros((FEATURES, len(langs)), np.float32)
    words, grams = slice(0, 1 << WORD_BITS), slice(1 << WORD_BITS, (1 << WORD_BITS) + (1 << TRIGRAM_BITS))
    for part in (words, grams):
        smooth = total[part] + 0.05
        log_p[part] = np.log(smooth / smooth.sum(0))
    scripts = total[FEATURES - len(SCRIPTS) - 2 :]
    share = scripts / np.maximum(1, scripts[1:].sum(0))
    allowed = share >= 0.005
    allowed |= ~allowed.any(1, keepdims=True)
    allowed[_NONE] = True
    return Model(langs, log_p, allowed)


def _word_scores(found: W.Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    own, script, tri, begin = _features(found)
    score = (model.log_p[own] + np.add.reduceat(model.log_p[tri], begin, axis=0)) / 2
    score[~model.allowed[script]] = -1e3
    score -= score.max(1, keepdims=True)
    np.maximum(score, -_CLIP, out=score)
    score[script == _NONE] = 0
    return score.astype(np.float64), script


def _viterbi(score: np.ndarray, first: np.ndarray, texts: np.ndarray, penalty: float, path: np.ndarray) -> None:
    """Best labels of the words of ``texts``, all texts one word at a time, longest first."""
    counts = np.diff(first)[texts]
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][texts][order], counts[order]
    active = np.searchsorted(-counts, -np.arange(counts[0]), side="left")
    back = np.empty((int(counts.sum()), score.shape[1]), np.int16)
    row = np.concatenate([[0], np.cumsum(active)])
    same = np.arange(score.shape[1], dtype=np.int16)
    state = np.zeros((len(order), score.shape[1]))
    last = np.zeros(len(order), np.int64)
    for t, a in enumerate(active):
        now = state[:a]
        top = now.argmax(1)
        jump = now[np.arange(a), top] - penalty
        stay = now >= jump[:, None]
        back[row[t] : row[t + 1]] = np.where(stay, same, top[:, None])
        state[:a] = np.where(stay, now, jump[:, None]) + score[begin[:a] + t]
    last = state.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        path[begin[:a] + t] = last[:a]
        last[:a] = back[row[t] : row[t + 1]][np.arange(a), last[:a]]


def label_words(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The label of each word. A text in which no stretch gains more than the penalty with
    another label than the overall best one keeps that label throughout: that is the Viterbi
    path, so only the other texts are worked through word by word."""
    counts = np.diff(first)
    full = np.flatnonzero(counts)
    path = np.zeros(len(score), np.int64)
    if len(full) == 0:
        return path
    total = np.add.reduceat(score, first[:-1][full], axis=0)
    best = total.argmax(1)
    path[:] = np.repeat(best, counts[full])
    mixed = np.zeros(len(full), bool)
    where = np.repeat(np.arange(len(full)), counts[full])
    base = score[np.arange(len(score)), path]
    far = float(np.abs(score).sum()) + 1.0 if len(score) else 1.0
    begin = first[:-1][full]
    for label in range(score.shape[1]):
        gain = score[:, label] - base
        upto = np.cumsum(gain)
        before = upto - gain
        low = np.minimum.accumulate(before - where * far) + where * far
        mixed |= np.maximum.reduceat(upto - low, begin) > penalty - 1e-3
    if mixed.any():
        _viterbi(score, first, full[mixed], penalty, path)
    return path


def _has_letter(data, offsets, i) -> bool:
    text = bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")
    return any(c.isalpha() for c in text)


def _identify(model: Model, penalty: float, text_col: str):
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column(text_col)):
                found = W.find_words(data, offsets, W.ALNUM)
                texts, langs = found.texts, len(model.langs)
                names, scores, spans = ["und"] * texts, [0.0] * texts, [[] for _ in range(texts)]
                if langs and len(found.starts):
                    score, script = _word_scores(found, model)
                    path = label_words(score, found.first, penalty)
                    for i in range(texts):
                        a, b = found.first[i], found.first[i + 1]
                        if a == b or not (script[a:b].any() and _letters(script[a:b], data, offsets, i)):
                            continue
                        own, worded = path[a:b], script[a:b] != _NONE
                        votes = np.bincount(own, weights=worded, minlength=langs)
                        top = int(votes.argmax())
                        names[i] = model.langs[top]
                        sums = score[a:b][own == top].sum(0)
                        rival = np.delete(sums, top).max() if langs > 1 else -np.inf
                        margin = np.clip(sums[top] - rival, -30, 30)
                        scores[i] = float(votes[top] / max(1.0, votes.sum()) / (1 + np.exp(-margin)))
                        cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [b - a]])
                        spans[i] = [
                            {"lang": model.langs[own[x]], "first_word": int(x), "n_words": int(y - x)}
                            for x, y in zip(cuts[:-1], cuts[1:], strict=True)
                        ]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                    [*part.schema.names, "lang_pred", "lang_score", "spans"],
                )

    return run


def _letters(script, data, offsets, i) -> bool:
    """Words beyond ASCII may be symbols only; then the text itself is looked at."""
    return bool((script == 1).any()) and _ascii_letter(data, offsets, i) or _has_letter(data, offsets, i)


def _ascii_letter(data, offsets, i) -> bool:
    low = W.ALNUM[data[offsets[i] : offsets[i + 1]]]
    return bool(((low >= 0x61) & (low <= 0x7A)).any())


_RESULT = [
    ("lang_pred", "string"),
    ("lang_score", "double"),
    ("spans", "array<struct<lang:string,first_word:bigint,n_words:bigint>>"),
]


def identify_rows(
    docs: DataFrame, model: Model, text_col: str = "text", penalty: float = SWITCH
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``spans`` in each row, without a shuffle.
    Columns of these names are replaced.

    ``lang_pred`` is the language of most words, ``und`` (score 0, no spans) where the text is
    null, has no letter, or the model has no languages. ``lang_score`` is that language's share
    of the words times its posterior against the runner-up over the words of its own spans, so
    other languages in the text lower it by their share only. ``spans`` are runs of words of one
    language. Ties go to the first language by name. Rows are taken one by one, so repeated
    ids, empty tables and other columns make no difference; long texts are read whole.
    """
    docs = docs.drop(*(name for name, _ in _RESULT))
    held = shared(docs.sparkSession, model)

    def run(batches):
        yield from _identify(opened(held), penalty, text_col)(batches)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(run, ", ".join(kinds + [f"{name} {kind}" for name, kind in _RESULT]))


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH
) -> DataFrame:
    """``(id, lang_pred, score, spans)`` for every row; see ``identify_rows``."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return identify_rows(rows, model, "text", penalty).select(
        id_col, "lang_pred", F.col("lang_score").alias("score"), "spans"
    )


def held_out(id_col: str = "doc_id"):
    """Rows that no model of this package learns from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
