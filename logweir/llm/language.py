"""Language spans: script ranges narrow the candidates of a word, and Viterbi over
the words' scores with a switching penalty labels the spans of mixed texts.

A word is a run of letters.  Its score for a language is the sum of the log
probabilities of the trigrams round its letters (word ends included), counted in
BUCKETS hash buckets, so the model has languages x BUCKETS numbers whatever the
corpus.  A language is a candidate for the words of the scripts it was seen in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 15
#: Labelled documents a language is learned from at most (in expectation; drawn
#: by hash of the id from all that may be learned from).
SAMPLE = 4_000
SWITCH = 25.0  # log probability that a change of language costs
FOREIGN = 12.0  # log probability that a letter of a script the language was not seen in costs
SEEN = 0.005  # share of a language's letters from which a script is one of its own
CHARS = 800_000  # characters that one step works on
LONG = 2_000  # words from which a text is labelled in blocks of its own

#: First code points of the blocks of scripts, in order.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2DE0, "Cyrillic"), (0x2E80, "Han"), (0x3040, "Kana"),
    (0x3100, "Han"), (0x3130, "Hangul"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "Yi"), (0xA640, "Cyrillic"), (0xA720, "Latin"),
    (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0x20000, "Han"),
]


@dataclass
class Alphabet:
    """Lookup tables by code point: is it a letter, its lower case, its script."""

    letter: np.ndarray
    lower: np.ndarray
    starts: np.ndarray
    script: np.ndarray
    names: list[str]

    @staticmethod
    def make() -> Alphabet:
        names = sorted({n for _, n in SCRIPTS})
        low = [chr(c).lower() for c in range(0x2000)]
        return Alphabet(
            np.packbits(np.array([chr(c).isalpha() for c in range(0x30000)])), np.array([ord(x[0]) for x in low], np.uint32),
            np.array([s for s, _ in SCRIPTS]), np.array([names.index(n) for _, n in SCRIPTS]), names)


@dataclass
class Words:
    """The letters and words of some texts laid end to end."""

    bucket: np.ndarray  # of each letter's trigram
    script: np.ndarray  # of each letter
    start: np.ndarray  # of each word, in letters
    at: np.ndarray  # of each letter, in code points of its text
    doc: np.ndarray  # of each word


def read_words(texts: list[str], abc: Alphabet) -> Words:
    codes = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    bits = np.unpackbits(abc.letter)
    letter = bits[np.minimum(codes, len(bits) - 1)].astype(bool) & (codes < len(bits))
    low = np.where(codes < len(abc.lower), abc.lower[np.minimum(codes, len(abc.lower) - 1)], codes)
    low = np.where(letter, low, np.uint32(0)).astype(np.uint64)
    here = np.flatnonzero(letter)
    h = low[here - 1] * np.uint64(0x9E3779B97F4A7C15) ^ low[here] * np.uint64(0xC2B2AE3D27D4EB4F) ^ low[here + 1] * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
    doc = np.searchsorted(begins, here, side="right") - 1
    start = np.flatnonzero(~letter[here - 1])
    script = abc.script[np.searchsorted(abc.starts, codes[here], side="right") - 1]
    return Words((h >> np.uint64(49)).astype(np.int64), script, start, here - begins[doc] if len(texts) else here, doc[start])


@dataclass
class Model:
    """Log probabilities (bucket x language) and the scripts of each language."""

    langs: list[str]
    weights: np.ndarray
    scripts: np.ndarray  # script x language
    abc: Alphabet

    def word_scores(self, w: Words) -> np.ndarray:
        if not len(w.start):
            return np.zeros((0, len(self.langs)), np.float32)
        known = self.scripts[w.script].any(1)
        per = self.weights[w.bucket] - np.float32(FOREIGN) * ~self.scripts[w.script]
        per[~known] = 0  # a script of no language speaks for none
        return np.add.reduceat(per, w.start, axis=0)


def best_paths(scores: np.ndarray, first: np.ndarray, size: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word: Viterbi over the words of each text (its
    first word and number of words), all texts step by step together."""
    n, k = scores.shape
    out, back = np.zeros(n, np.int64), np.zeros((n, k), np.int16)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")  # texts with more than t words
    best = np.zeros((len(first), k), scores.dtype)
    own = np.arange(k, dtype=np.int16)
    for t, m in enumerate(live):
        row, b = first[:m] + t, best[:m]
        if t:
            top = b.argmax(1)
            jump = b[np.arange(m), top][:, None] - np.asarray(switch, scores.dtype)
            stay = b >= jump
            back[row] = np.where(stay, own, top[:, None])
            b = np.where(stay, b, jump)
        best[:m] = b + scores[row]
    state = best.argmax(1)
    for t in range(len(live) - 1, -1, -1):
        row = first[: live[t]] + t
        out[row] = state[: live[t]]
        if t:
            state[: live[t]] = back[row, state[: live[t]]]
    return out


def long_path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """``best_paths`` of one long text, in blocks of about the square root of its words that step together: first what
    each block makes of each language it may begin with (a max-plus matrix), then from block to block the scores it
    begins with, then every block's own way back from each language, and from block to block which of them it is."""
    n, k = scores.shape
    size = max(1, math.isqrt(n))
    count = -(-n // size)
    x = np.zeros((count * size, k))
    x[:n] = scores
    x = x.reshape(count, size, k)

    def step(b: np.ndarray, add: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = b.argmax(-1)[..., None]
        jump = np.take_along_axis(b, top, -1) - switch
        stay = b >= jump
        return np.where(stay, b, jump) + add, np.where(stay, np.arange(k), top).astype(np.int16)

    through = np.broadcast_to(np.where(np.eye(k, dtype=bool), 0.0, -np.inf), (count, k, k))  # block, first, last
    for t in range(size):
        through, _ = step(through, x[:, t, None, :])
    start = np.zeros((count, k))
    for c in range(1, count):
        start[c] = (start[c - 1][:, None] + through[c - 1]).max(0)
    back, b = np.zeros((size, count, k), np.int16), start
    for t in range(size):
        b, back[t] = step(b, x[:, t])
    state = np.broadcast_to(np.arange(k), (count, k))  # of the word before, by block and last language
    for t in range(size - 1, -1, -1):
        state = np.take_along_axis(back[t], state, 1).astype(np.int64)
    last = np.zeros(count, np.int64)
    last[-1] = b[-1].argmax()
    for c in range(count - 1, 0, -1):
        last[c - 1] = state[c, last[c]]
    out = np.zeros((count, size), np.int64)
    for t in range(size - 1, -1, -1):
        out[:, t] = last
        last = back[t][np.arange(count), last].astype(np.int64)
    return out.ravel()[:n]


def _slices(text: str) -> Iterator[tuple[int, str]]:
    """Parts of a text of about CHARS characters, cut outside of words."""
    low = 0
    while low < len(text):
        inside = lambda i: text[i - 1].isalpha() and text[i].isalpha()
        high = min(len(text), low + CHARS)
        while low < high < len(text) and inside(high):
            high -= 1
        if high == low:  # a word longer than a part
            high = min(len(text), low + CHARS)
            while high < len(text) and inside(high):
                high += 1
        yield low, text[low:high]
        low = high


def _pieces(lengths: np.ndarray) -> Iterator[list[int]]:
    """Rows by length, in pieces of about CHARS characters."""
    piece, size = [], 0
    for i in np.argsort(lengths, kind="stable").tolist():
        if piece and size + lengths[i] > CHARS:
            yield piece
            piece, size = [], 0
        piece.append(i)
        size += lengths[i]
    if piece:
        yield piece


def may_learn(doc_id: Column) -> Column:
    """Whether the label of a document may be learned from; null for a null id."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 != 1


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from (doc_id, text, lang); null texts and labels are left out.

    About ``sample`` documents a language are read, drawn by hash of the id."""
    spark, abc = labelled.sparkSession, Alphabet.make()
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    shares = {r["lang"]: sample / r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(shares)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(abc.names), 0), bool), abc)
    share = spark.createDataFrame([(k, float(v)) for k, v in shares.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("lang", "text")
    of = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {}
        for b in batches:
            lang, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for piece in _pieces(np.array([len(t) for t in texts])):
                w = read_words([texts[i] for i in piece], abc)
                word_of = np.repeat(np.arange(len(w.start)), np.diff(np.r_[w.start, len(w.bucket)]))
                by_letter = np.array([of[lang[i]] for i in piece])[w.doc][word_of]
                for k in np.unique(by_letter):
                    mine = by_letter == k
                    n = seen.setdefault(int(k), np.zeros(BUCKETS + len(abc.names), np.int64))
                    n[:BUCKETS] += np.bincount(w.bucket[mine], minlength=BUCKETS)
                    n[BUCKETS:] += np.bincount(w.script[mine], minlength=len(abc.names))
        for k, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    counts = drawn.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((BUCKETS + len(abc.names), len(langs)))
    found = counts.toPandas()  # at most languages x (BUCKETS + scripts) rows
    table[found["bucket"], found["lang"]] = found["n"]
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    weights = np.log((grams + 0.05) / (grams + 0.05).sum(0))
    return Model(langs, (weights - weights.max(1, keepdims=True)).astype(np.float32), scripts > SEEN * scripts.sum(0), abc)


SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _labelled(texts: list[str], m: Model, switch: float) -> list[tuple]:
    """(language, its share of the letters, spans) of each text."""
    if len(texts) == 1 and len(texts[0]) > CHARS:
        return [_labelled_long(texts[0], m, switch)]
    w = read_words(texts, m.abc)
    out = [("und", 0.0, [])] * len(texts)
    if not len(w.start) or not m.langs:
        return out
    docs, first, size = np.unique(w.doc, return_index=True, return_counts=True)
    scores, long = m.word_scores(w), size > LONG
    path = best_paths(scores, first[~long], size[~long], switch)
    for a, n in zip(first[long], size[long]):
        path[a : a + n] = long_path(scores[a : a + n], switch)
    ends = np.r_[w.start[1:], len(w.bucket)]
    lo, hi = w.at[w.start], w.at[ends - 1] + 1
    for d, a, n in zip(docs, first, size):
        out[d] = _told(path[a : a + n], (ends - w.start)[a : a + n], lo[a : a + n], hi[a : a + n], m)
    return out


def _labelled_long(text: str, m: Model, switch: float) -> tuple:
    """As ``_labelled``, read in parts: of each word only its scores and place are held."""
    parts = []
    for off, part in _slices(text):
        w = read_words([part], m.abc)
        if len(w.start):
            ends = np.r_[w.start[1:], len(w.bucket)]
            parts.append((m.word_scores(w), ends - w.start, w.at[w.start] + off, w.at[ends - 1] + 1 + off))
    if not parts or not m.langs:
        return "und", 0.0, []
    scores, letters, lo, hi = (np.concatenate(c) for c in zip(*parts))
    return _told(long_path(scores, switch), letters, lo, hi, m)


def _told(path: np.ndarray, letters: np.ndarray, lo: np.ndarray, hi: np.ndarray, m: Model) -> tuple:
    votes = np.bincount(path, weights=letters, minlength=len(m.langs))
    k = int(votes.argmax())
    new = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
    last = np.r_[new[1:], len(path)] - 1
    spans = [{"lang": m.langs[path[a]], "start": int(lo[a]), "end": int(hi[z])} for a, z in zip(new, last)]
    return m.langs[k], float(votes[k] / votes.sum()), spans


def label_spans(docs: DataFrame, model: Model, *keep: str, switch: float = SWITCH, names: tuple[str, ...] = ("lang_pred", "score", "spans")) -> DataFrame:
    """doc_id (or the columns of ``keep``), lang_pred, score and spans: the language
    that most letters of a text are labelled with, their share, and the labelled spans
    in code points.  ``names`` renames these; two names leave the spans out.

    Texts of any length: a long one is read in parts of CHARS characters, and its words are labelled in blocks.
    ``und``, 0.0 and no span for a text that is null or has no letter.  Equal
    numbers of letters: the language first in order.  Repeated rows and null ids stay;
    an empty table gives none.  Kept columns of these names are replaced.
    """
    keep = [c for c in keep or ("doc_id",) if c not in names]
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))  # the text goes over once
    kinds = [T.StringType(), T.DoubleType(), SPANS][: len(names)]
    out = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, k) for n, k in zip(names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        shapes = [pa.string(), pa.float64(), span][: len(names)]
        for b in batches:
            column = b.column("text")
            size = pc.utf8_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            got: list[tuple] = [()] * len(column)
            for piece in _pieces(size):  # a piece's texts only are held as strings
                texts = [x or "" for x in column.take(pa.array(piece)).to_pylist()]
                for i, x in zip(piece, _labelled(texts, model, switch)):
                    got[i] = x[: len(names)]
            if got:
                new = [pa.array(list(v), k) for v, k in zip(zip(*got), shapes)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *new], names=[*keep, *names])

    return rows.mapInArrow(run, out)
