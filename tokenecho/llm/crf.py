"""Language identification by a linear-chain conditional random field over words.

Each word scores the languages by affix, character n-gram and lexicon features; learned
transitions tie neighbouring words; forward-backward gives every word's probability of
each language, so code-switched text is labelled word by word. A document's language is
the one with the largest sum over its words. Training climbs the conditional likelihood
with the exact marginals of words and of neighbouring pairs. Its sequences are all
stretches of the sampled documents, half of them spliced with a stretch of another, from
which the transitions between languages are learned.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import U64, mix, powers, ship

#: A word: a run of letters; longer runs, as in unspaced scripts, are cut into consecutive words of 40 letters.
WORD = re.compile(r"[^\W\d_]{1,40}")
BUCKETS = 1 << 16
#: Labelled rows that the model is fitted on, at most, whole texts of each; words of a training sequence.
SAMPLE, SEQUENCE = 2000, 96
#: Bytes of text that a worker labels at once, words that it looks up at once, and word scores that it keeps.
AT_ONCE, WORDS, CACHE = 1 << 20, 100_000, 200_000
#: What identify() adds to a document.
FOUND = "struct<lang_pred:string,score:double,certainty:double>"


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, of): the hashed features of all words at once, and the word that each belongs to.

    Prefixes and suffixes of 1 to 4 letters, bigrams and trigrams with the word's borders,
    the word itself, its language in the lexicon, and a constant.
    """
    code = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(size + 2) - size - 1  # first letters
    end, word = start + size, np.repeat(np.arange(size.size), size + 2)
    key, of = [np.zeros(size.size, np.uint64)], [np.arange(size.size)]

    def add(seed: int, at: np.ndarray, letters: int, owner: np.ndarray) -> None:
        h = np.full(at.size, seed, np.uint64)
        for k in range(letters):
            h = h * U64(0x9E3779B97F4A7C15) + code[at + k]
        key.append(h)
        of.append(owner)

    for k in (2, 3):
        at = np.flatnonzero(word[: word.size - k + 1] == word[k - 1 :])
        add(k, at, k, word[at])
    for k in (1, 2, 3, 4):
        some = np.flatnonzero(size >= k)
        add(10 + k, start[some], k, some)
        add(20 + k, end[some] - k, k, some)
    up, down = powers(code.size)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * up[: code.size])))
    key.append((total[end] - total[start]) * down[start] + U64(30))
    of.append(of[0])
    known = np.array([lexicon.get(w, -1) for w in words], np.int64)
    some = np.flatnonzero(known >= 0)
    key.append(known[some].astype(np.uint64) + U64(1000))
    of.append(some)
    return (mix(np.concatenate(key)) % U64(BUCKETS)).astype(np.int64), np.concatenate(of)


def messages(scores: np.ndarray, start: np.ndarray, size: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages, each scaled to sum 1, and exp(scores), of sequences laid end to end.

    scores (words, labels); sequences start at `start` and have `size` words, all at least 1.
    All sequences advance together; shorter ones drop out.
    """
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    move = np.exp(trans - trans.max())
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    fwd, back = np.empty_like(local), np.full_like(local, 1 / scores.shape[1])
    now = local[start] * np.exp(first - first.max())
    fwd[start] = now = now / now.sum(axis=1, keepdims=True)
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # sequences with a word t
    for t in range(1, size[0]):
        n = active[t]
        at = start[:n] + t
        now = (now[:n] @ move) * local[at]
        now /= now.sum(axis=1, keepdims=True)
        fwd[at] = now
    for t in range(size[0] - 1, 0, -1):
        at = start[: active[t]] + t
        behind = (back[at] * local[at]) @ move.T
        back[at - 1] = behind / behind.sum(axis=1, keepdims=True)
    return fwd, back, local


def forward_backward(scores: np.ndarray, start: np.ndarray, size: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probabilities of each label at each position of sequences as in messages()."""
    fwd, back, _ = messages(scores, start, size, trans, first)
    fwd *= back
    return fwd / fwd.sum(axis=1, keepdims=True)


def pairs(fwd: np.ndarray, back: np.ndarray, local: np.ndarray, trans: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probabilities of the labels of words at-1 and at together: (words, label before, label)."""
    joint = fwd[at - 1][:, :, None] * np.exp(trans - trans.max())[None] * (local[at] * back[at])[:, None, :]
    return joint / joint.sum(axis=(1, 2), keepdims=True)


def words_in(text: str) -> Iterator[list[str]]:
    """The lower-cased words of a text, in lists of bounded length."""
    if len(text) <= AT_ONCE:
        yield WORD.findall(text.lower())
    else:
        found = (m[0].lower() for m in WORD.finditer(text))
        while some := list(islice(found, WORDS)):
            yield some


class Tagger:
    """Weights of a fitted field, and the scores of the words seen last."""

    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray, first: np.ndarray, lexicon: dict[str, int]):
        self.langs, self.weights, self.trans, self.first, self.lexicon = langs, weights, trans, first, lexicon
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.empty((1024, len(self.langs)), np.float32)

    def __getstate__(self):
        return self.langs, self.weights, self.trans, self.first, self.lexicon

    def __setstate__(self, state):
        self.__init__(*state)

    def look_up(self, words: list[str]) -> np.ndarray:
        if len(self.index) > CACHE:
            self._forget()
        index = self.index
        new = list(set(words).difference(index))
        for lo in range(0, len(new), 20_000):
            part, n = new[lo : lo + 20_000], len(index)
            flat, of = features(part, self.lexicon)
            while n + len(part) > len(self.scores):
                self.scores = np.concatenate((self.scores, np.empty_like(self.scores)))
            for c in range(len(self.langs)):
                self.scores[n : n + len(part), c] = np.bincount(of, self.weights[flat, c], len(part))
            index.update(zip(part, range(n, n + len(part))))
        return self.scores[list(map(index.__getitem__, words))]

    def probabilities(self, texts: Iterable[Iterable[list[str]]]) -> list[np.ndarray]:
        """(words, languages) for each text, given as lists of its lower-cased words."""
        score = [np.concatenate([self.scores[:0], *map(self.look_up, lists)]) for lists in texts]
        size = np.array([len(x) for x in score], np.int64)
        at, some = np.cumsum(size) - size, np.flatnonzero(size)
        if some.size:
            p = forward_backward(np.concatenate(score), at[some], size[some], self.trans, self.first)
            return [p[a : a + n] for a, n in zip(at.tolist(), size.tolist())]
        return score

    def label_words(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, language, probability) of each word of a text."""
        found = list(WORD.finditer(text))
        p = self.probabilities([[[m[0].lower() for m in found]]])[0]
        return [(m.start(), m.end(), self.langs[k], float(q[k])) for m, q in zip(found, p) for k in [int(q.argmax())]]


def fit(rows: Iterable[tuple[str, str]], epochs: int = 3, rate: float = 0.2, seed: int = 5) -> Tagger | None:
    """rows: (text, language). None if no row has a word. Texts are kept as numbers of words only."""
    rng = np.random.default_rng(seed)
    known: dict[str, int] = {}
    docs = []
    for text, lang in rows:
        w = [np.array([known.setdefault(x, len(known)) for x in some], np.int32) for some in words_in(text)]
        w = np.concatenate(w) if w else np.empty(0, np.int32)
        if w.size:
            docs.append((w, lang))
    if not docs:
        return None
    every, langs = list(known), sorted({lang for _, lang in docs})
    label = {x: i for i, x in enumerate(langs)}
    uses: dict[int, Counter] = defaultdict(Counter)
    for w, lang in docs:
        for x in np.unique(w).tolist():
            uses[x][label[lang]] += 1
    lexicon = {every[x]: top for x, c in sorted(uses.items()) if c.total() >= 5 for top, n in [min(c.items(), key=lambda y: (-y[1], y[0]))] if n >= 0.8 * c.total()}

    n = len(langs)
    weights, trans, first = np.zeros((BUCKETS, n)), np.zeros((n, n)), np.zeros(n)
    power = [np.full_like(x, 1e-6) for x in (weights, trans, first)]
    cut = [(w[at : at + SEQUENCE], label[lang]) for w, lang in docs for at in range(0, w.size, SEQUENCE)]
    flats, of = features(every, lexicon)
    flats = flats[np.argsort(of, kind="stable")]
    many = np.bincount(of, minlength=len(every))
    begin = np.cumsum(many) - many
    for _ in range(epochs):
        order = rng.permutation(len(cut))
        for lo in range(0, len(cut), 64):
            words, gold = [], []
            for k in order[lo : lo + 64].tolist():
                w, y = cut[k]
                y = np.full(w.size, y)
                if rng.random() < 0.5:
                    v, z = cut[int(rng.integers(len(cut)))]
                    a, b = int(rng.integers(1, w.size + 1)), int(rng.integers(1, v.size + 1))
                    w, y = np.concatenate((w[:a], v[:b])), np.concatenate((y[:a], np.full(b, z)))
                words.append(w)
                gold.append(y)
            size = np.array([w.size for w in words])
            start = np.cumsum(size) - size
            gold = np.concatenate(gold)
            ids, word = np.unique(np.concatenate(words), return_inverse=True)  # a word is scored once for all its places
            of = np.repeat(np.arange(ids.size), many[ids])
            flat = flats[np.repeat(begin[ids] - np.cumsum(many[ids]) + many[ids], many[ids]) + np.arange(of.size)]
            score = np.stack([np.bincount(of, weights[flat, c], ids.size) for c in range(n)], axis=1)[word]
            fwd, back, local = messages(score, start, size, trans, first)
            p = fwd * back
            p /= p.sum(axis=1, keepdims=True)
            y = np.zeros((gold.size, n))
            y[np.arange(gold.size), gold] = 1
            diff = y - p
            inner = np.ones(gold.size, bool)
            inner[start] = False
            j = np.flatnonzero(inner)
            move = y[j - 1].T @ y[j] - pairs(fwd, back, local, trans, j).sum(axis=0)
            used, at = np.unique(flat, return_inverse=True)
            by_word = [np.bincount(word, diff[:, c], ids.size) for c in range(n)]
            step = np.stack([np.bincount(at, by_word[c][of], used.size) for c in range(n)], axis=1) - 1e-3 * weights[used]
            power[0][used] += step**2
            weights[used] += rate * step / np.sqrt(power[0][used])
            for x, g, q in ((trans, move, power[1]), (first, diff[start].sum(axis=0), power[2])):
                q += g**2
                x += rate * g / np.sqrt(q)
    return Tagger(langs, weights.astype(np.float32), trans.astype(np.float32), first.astype(np.float32), lexicon)


def shares(rows: dict[str, int], sample: int) -> dict[str, int]:
    """Rows to take of each language: as even as can be, all of those that have fewer."""
    out, left = {}, sample
    for k, (lang, n) in enumerate(sorted(rows.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, left // (len(rows) - k))
        left -= out[lang]
    return out


def fit_on(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Tagger | None:
    """Fits on at most `sample` rows with a language, dealt evenly over the languages; whole texts.

    Rows whose crc32(id as text) mod 4 is 2 are held out, as are rows with a null id. Rows
    below a threshold of a hash of the id are drawn, about twice as many as are wanted of a
    language, and of these the first in the order of the hash; so no other text is moved,
    and reruns agree. Rows that tie (repeated ids) are taken in the order of their texts.
    An empty table, or one without labelled words, gives None. The number of languages is
    taken to be small; of more than `sample`, the rarest are left out.
    """
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    rows = docs.where((remainder != 2) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), F.shiftrightunsigned(F.xxhash64(F.lit(11), id_col), 1).alias("draw"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(sample).collect()}
    if not counts:
        return None
    quota = shares(counts, sample)
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(x, q, min(2**63 - 1, (2 * q + 50) * 2**63 // counts[x])) for x, q in quota.items()], "l string, quota int, below long")
    rows = rows.join(F.broadcast(wanted), "l").where("draw <= below")  # one row for each language
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("l").orderBy("draw", "t"))).where("rank <= quota")
    return fit((r[1], r[2]) for r in sorted(((r["draw"], r["t"], r["l"]) for r in rows.select("draw", "t", "l").toLocalIterator())))


def _stretches(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about AT_ONCE bytes of text each; a longer text makes a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // AT_ONCE
    cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    for a, z in zip(cut, cut[1:]):
        if z > a:
            yield batch.slice(a, z - a)


def identify(docs: DataFrame, tagger: Tagger | None, text_col: str = "text", out: str = "language_found") -> DataFrame:
    """All columns of docs and the struct `out`: lang_pred, score (the mean probability of that
    language over the words) and certainty (the mean over words of their largest probability).

    `und` with 0 and 0 where the text is null or has no letter, or nothing could be learned.
    Rows with null or repeated ids each get their own result; of tied languages the first in
    order is given; an empty table stays empty. A column of docs named `out`, whatever its
    case, is an error; other names of docs do not matter. Long texts are read to their end.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have a column {out} already")
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(tagger)  # BUCKETS rows of weights, and words of the bounded sample
    place, names = docs.columns.index(text_col), [*docs.columns, out]

    def tag(batches):
        tagger = sent.value
        for batch in batches:
            for part in _stretches(batch, text_col):
                langs, scores, sure = [], [], []
                texts = [words_in(t.as_py()) if t.is_valid and tagger else () for t in part.column(place)]
                for p in tagger.probabilities(texts) if tagger else [()] * len(texts):
                    if len(p):
                        mean = p.mean(axis=0, dtype=np.float64)
                        langs.append(tagger.langs[int(mean.argmax())])
                        scores.append(min(1.0, float(mean.max())))
                        sure.append(min(1.0, float(p.max(axis=1).mean(dtype=np.float64))))
                    else:
                        langs.append("und")
                        scores.append(0.0)
                        sure.append(0.0)
                found = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.float64())], ["lang_pred", "score", "certainty"])
                yield pa.RecordBatch.from_arrays([*part.columns, found], names)

    kind = spark.createDataFrame([], f"x {FOUND}").schema["x"].dataType
    return docs.mapInArrow(tag, StructType([*docs.schema.fields, StructField(out, kind)]))


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and certainty: a field fitted on the rows that are not held out, applied to all."""
    out = identify(docs.select("doc_id", "text"), fit_on(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "language_found.*")
