"""Language identification by a linear-chain conditional random field.

Every word of a text gets a distribution over the languages. Its features are the character
bigrams and trigrams with word boundaries (so prefixes and suffixes of up to two letters), prefixes and
suffixes of three letters, and the languages in whose lexicon it stands; learned transitions tie neighbouring
words together, so a text may switch. Marginals come from forward-backward over the whole text: texts are cut
into segments, whose transfer matrices are multiplied first, so that all segments of a batch are
run side by side and still see everything before and after them. The language of a text is the one with the
largest share of its words; the score is that share.

Training learns every language, from at most ``PER_LANGUAGE`` texts of each and, where there are many
languages, from an equal number of each out of ``MOST_TEXTS`` in all (one at least). They are drawn by
a hash of the text, those of at most ``MOST_BYTES`` bytes first; of a longer one, taken where a language has too
few, so many characters count. Words are weighed part by part, so that what the driver holds beside the sample
grows with the number of languages only.

A null text, or one without a letter, is ``und`` with score 0. Ties go to the language that comes
first in the alphabet. A null id is never held out and is not learned from; null languages are not learned
from. Repeated rows are judged each. Other columns are ignored. Without anything to learn from, every text is
``und``. An empty table gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loginlab.llm.common import per_process, small_batches, table, trimmed

PER_LANGUAGE = 200
MOST_BYTES = 8192
MOST_TEXTS = 3200  # of all languages
BUCKETS = 2**16  # hashed features of each kind
LEXICON = 5000  # words of a language
ROUNDS = 30
SWITCHES = 0.01  # share of words after which the language is assumed to change
SEGMENT = 128  # words
CHARACTERS = 500_000  # of a batch that is worked on at once, with up to FEW languages
FEW = 16
NUMBERS = 8_000_000  # of an array in training: words times languages, segments times pairs of languages

U64 = np.uint64


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # feature kind, bucket, language
    lexicon: np.ndarray  # sorted hashes of words
    lexical: np.ndarray  # entry of the lexicon, language
    transitions: np.ndarray


def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def _hash(*parts) -> np.ndarray:
    h = np.zeros(len(parts[0]), U64)
    for p in parts:
        h = (h ^ p.astype(U64)) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(29)
    return h


class Words(NamedTuple):
    """The words of some texts: where their characters begin, hashed features, and how many
    words each text has."""

    begins: np.ndarray
    pairs: np.ndarray  # bucket of each character's bigram
    triples: np.ndarray
    prefixes: np.ndarray  # bucket per word
    suffixes: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray


def words_of(texts: list[str]) -> Words:
    letters = per_process("letters", _letters)
    lowered = [t.lower() for t in texts]
    code = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.concatenate([[10], code, [10, 10, 10]]).astype(np.uint32)
    is_letter = letters[code]
    code = np.where(is_letter, code, 0)
    at = np.nonzero(is_letter)[0]
    starts = at[code[at - 1] == 0]
    ends = at[code[at + 1] == 0]
    begins = np.searchsorted(at, starts)
    before, here, after = code[at - 1], code[at], code[at + 1]
    bucket = lambda h: (h >> U64(64 - 16)).astype(np.int32)
    position = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    whole = np.add.reduceat(_hash(here, position), begins) if len(begins) else np.zeros(0, U64)
    second = code[ends - 1]
    third = np.where(second > 0, code[ends - 2], 0)
    next_ = code[starts + 1]
    over = np.where(next_ > 0, code[starts + 2], 0)
    offsets = np.cumsum([1] + [len(t) + 1 for t in lowered])
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(
        begins,
        bucket(_hash(before, here)),
        bucket(_hash(before, here, after)),
        bucket(_hash(code[starts], next_, over)),
        bucket(_hash(code[ends], second, third)),
        whole,
        counts,
    )


def emissions(words: Words, model: Model) -> np.ndarray:
    """The score of each word in each language."""
    if not len(words.begins):
        return np.zeros((0, len(model.languages)))
    w = model.weights
    out = np.add.reduceat(w[0][words.pairs] + w[1][words.triples], words.begins, axis=0)
    out += w[2][words.prefixes] + w[3][words.suffixes]
    place = np.minimum(np.searchsorted(model.lexicon, words.hashes), max(0, len(model.lexicon) - 1))
    if len(model.lexicon):
        out += np.where((model.lexicon[place] == words.hashes)[:, None], model.lexical[place], 0)
    return out


def _part(words: Words, a: int, b: int) -> Words:
    """The words a to b, as one text."""
    first, last = (int(words.begins[k]) if k < len(words.begins) else len(words.pairs) for k in (a, b))
    return Words(
        words.begins[a:b] - first,
        words.pairs[first:last],
        words.triples[first:last],
        words.prefixes[a:b],
        words.suffixes[a:b],
        words.hashes[a:b],
        np.array([b - a]),
    )


def _segments(counts: np.ndarray, size: int):
    """Begin, length, text and place in the text of segments of at most ``size`` words."""
    per = -(-counts // size)
    text = np.repeat(np.arange(len(counts)), per)
    place = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = np.repeat(np.cumsum(counts) - counts, per) + place * size
    length = np.minimum(size, np.repeat(counts, per) - place * size)
    return begin, length, text, place


def marginals(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray, size=SEGMENT):
    """The distribution over languages of every word, given all words of its text, and the
    expected number of transitions."""
    k = scores.shape[1]
    move = np.exp(transitions - transitions.max())
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    begin, length, text, place = _segments(counts, size)
    order = np.argsort(-length, kind="stable")  # lanes that end early are at the end
    begin, length = begin[order], length[order]
    lanes = len(order)
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(size)]  # lanes longer than t

    # what a whole segment does to the state before it; nothing moves into the first word of a text
    opens = (place == 0)[order]
    back = np.empty(lanes, np.int64)
    back[order] = np.arange(lanes)
    several = np.bincount(text, minlength=len(counts))[text[order]] > 1
    matrix = np.broadcast_to(np.eye(k), (lanes, k, k)).copy()
    where = np.nonzero(several)[0]
    for t in range(size):
        n = int(np.searchsorted(where, active[t]))
        if not n:
            break
        at = where[:n]
        m = (matrix[at] @ move if t else np.where(opens[at, None, None], matrix[at], move)) * e[begin[at] + t][:, None]
        matrix[at] = m / m.sum(axis=(1, 2), keepdims=True)

    # entering and leaving states, text by text; only texts of several segments need the loop
    enter = np.full((lanes, k), 1.0)
    leave = np.full((lanes, k), 1.0)
    first_of = np.nonzero(place == 0)[0]
    for s, stop in zip(first_of, np.append(first_of[1:], lanes)):
        for x in range(s + 1, stop):
            v = enter[back[x - 1]] @ matrix[back[x - 1]]
            enter[back[x]] = v / v.sum()
        for x in range(stop - 2, s - 1, -1):
            v = matrix[back[x + 1]] @ leave[back[x + 1]]
            leave[back[x]] = v / v.sum()

    # inside the segments
    alpha = np.empty_like(e)
    state = enter
    for t in range(size):
        n = active[t]
        if not n:
            break
        come = state[:n] @ move if t else np.where(opens[:n, None], 1.0, state[:n] @ move)
        come = come * e[begin[:n] + t]
        state = come / come.sum(axis=1, keepdims=True)
        alpha[begin[:n] + t] = state
    expected = np.zeros((k, k))
    out = np.empty_like(e)
    state = np.empty((0, k))
    for t in range(size - 1, -1, -1):
        n = active[t]
        if not n:
            continue
        ends = leave[len(state) : n]
        state = np.concatenate([state, ends])
        at = begin[:n] + t
        both = alpha[at] * state
        out[at] = both / both.sum(axis=1, keepdims=True)
        ahead = e[at] * state
        if t:
            pair = alpha[at - 1][:, :, None] * move * ahead[:, None]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        state = ahead @ move.T
        state = state / state.sum(axis=1, keepdims=True)
    return out, expected


def fit(texts: list[str], labels: list[str], rounds=ROUNDS) -> Model:
    languages = sorted(set(labels))
    k = len(languages)
    if not k:
        return Model([], np.zeros((4, BUCKETS, 0), np.float32), np.zeros(0, U64), np.zeros((0, 0)), np.zeros((0, 0)))
    words = words_of(texts)
    gold = np.array([languages.index(x) for x in labels])[np.repeat(np.arange(len(texts)), words.counts)]

    # lexicon: the most frequent words of each language
    values, where = np.unique(words.hashes, return_inverse=True)
    per = np.stack([np.bincount(where[gold == y], minlength=len(values)) for y in range(k)], axis=1)
    top = np.unique(np.concatenate([np.argsort(-per[:, y], kind="stable")[:LEXICON] for y in range(k)] + [[]])).astype(int)
    top = top[per[top].sum(axis=1) > 1]
    share = (per[top] + 0.5) / (per.sum(axis=0) + 0.5 * len(values))
    model = Model(
        languages,
        np.zeros((4, BUCKETS, k), np.float32),
        values[top],
        (np.log(share) - np.log(share).mean(axis=1, keepdims=True)) * 0.2,
        np.zeros((k, k)),
    )
    if k == 1 or not len(gold):
        return model
    begin, length, _, _ = _segments(words.counts, SEGMENT)
    kept_ = np.eye(k) * (1 - SWITCHES) + (1 - np.eye(k)) * SWITCHES / (k - 1)
    pairs_of = np.bincount(gold[begin], weights=length - 1, minlength=k)[:, None] * kept_
    heavy = np.cumsum(np.maximum(length * k, k * k))
    cut = np.append(np.nonzero(np.diff(heavy // NUMBERS, prepend=-1))[0], len(length))
    params = [*model.weights, model.transitions]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for turn in range(1, rounds + 1):
        slope = np.zeros((len(model.weights), k, BUCKETS), np.float32)
        expected = np.zeros((k, k))
        for x, y in zip(cut[:-1], cut[1:]):
            first, last = int(begin[x]), int(begin[y - 1] + length[y - 1])
            part = _part(words, first, last)
            seen, moved = marginals(emissions(part, model), length[x:y], model.transitions)
            expected += moved
            wrong = -seen
            wrong[np.arange(last - first), gold[first:last]] += 1
            sizes = np.diff(np.append(part.begins, len(part.pairs)))
            for z in range(k):
                of_char = np.repeat(wrong[:, z], sizes)
                slope[0, z] += np.bincount(part.pairs, of_char, BUCKETS)
                slope[1, z] += np.bincount(part.triples, of_char, BUCKETS)
                slope[2, z] += np.bincount(part.prefixes, wrong[:, z], BUCKETS)
                slope[3, z] += np.bincount(part.suffixes, wrong[:, z], BUCKETS)
        slopes = [*(g.T for g in slope), pairs_of - expected]
        for n, (p, g, (m, v)) in enumerate(zip(params, slopes, moments)):
            g = g - (2 if n < len(model.weights) else 1) * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)
    return model


def judge(texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    texts = [t or "" for t in texts]
    words = words_of(texts)
    shares = np.zeros((len(texts), len(model.languages)))
    some = np.nonzero(words.counts)[0]
    if len(some) and model.languages:
        size = max(SEGMENT, len(model.languages))  # the matrices of a text take no more than its scores
        seen, _ = marginals(emissions(words, model), words.counts[some], model.transitions, size)
        first = np.cumsum(words.counts[some]) - words.counts[some]
        shares[some] = np.add.reduceat(seen, first, axis=0) / words.counts[some][:, None]
    best = shares.argmax(axis=1) if model.languages else np.zeros(len(texts), int)
    return [
        (model.languages[b], min(1.0, float(shares[n, b]))) if model.languages and words.counts[n] else ("und", 0.0)
        for n, b in enumerate(best)
    ]


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> Model:
    """The model of a bounded sample of the labelled texts that are not held out."""
    rows = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).where(
        F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0)
    )
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    is_long = F.octet_length("text") > MOST_BYTES
    drawn = Window.partitionBy("lang").orderBy(is_long, F.xxhash64("text"), "text")
    languages = rows.select("lang").distinct().count()
    each = max(1, min(PER_LANGUAGE, MOST_TEXTS // max(1, languages)))
    sample = rows.withColumn("n", F.row_number().over(drawn)).where(F.col("n") <= each)
    sample = sample.select(F.substring("text", 1, MOST_BYTES).alias("text"), "lang").collect()
    sample.sort()
    return fit([r[0] for r in sample], [r[1] for r in sample])


def identify(docs: DataFrame, model: Model, text_col="text", names=("lang_pred", "score"), keep_text=False) -> DataFrame:
    """``docs`` with the language and the score in columns called ``names``, without its text
    unless ``keep_text``."""
    small_batches(docs.sparkSession)
    kept_ = [f for f in docs.schema if f.name not in names and (keep_text or f.name != text_col)]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch[text_col]
            sizes = np.array([len(t.as_py() or "") for t in column], np.int64)
            most = CHARACTERS * FEW // max(FEW, len(sent.value.languages))
            cut = np.append(np.nonzero(np.diff(np.cumsum(sizes) // most, prepend=-1))[0], len(sizes))
            for a, b in zip(cut[:-1], cut[1:]):
                found = judge(column.slice(a, b - a).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch[f.name].slice(a, b - a) for f in kept_),
                        pa.array([x[0] for x in found], pa.string()),
                        pa.array([x[1] for x in found], pa.float64()),
                    ],
                    [*(f.name for f in kept_), *names],
                )

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_), f"{names[0]} string, {names[1]} double"])
    columns = dict.fromkeys([*(f.name for f in kept_), text_col])
    return docs.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, fields)


def keep_identified(docs: DataFrame, text_col="text") -> DataFrame:
    """The rows of ``docs`` that are not ``und``; texts that mix languages stay, whatever their score."""
    names = ("_lang_pred", "_lang_score")
    found = identify(docs, learn(docs), text_col, names, keep_text=True)
    return found.where(f"{names[0]} != 'und'").select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
