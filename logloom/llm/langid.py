"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is the sum, over all
ways to cut the word into pieces, of the product of their probabilities; the forward algorithm takes that sum in one pass over
the word's positions. A text's score is the sum of its words' logarithms. The piece probabilities are fitted by expectation
maximisation, which shares each word's count among its segmentations in the same way.

The fit takes a bounded sample: about ``docs_per_lang`` labelled documents of each language, chosen by a hash of
their ids. There it takes words of over ``LONGEST`` characters in stretches of that length. Predictions cover all words of all texts, each as a whole, whatever its length.

Words are runs of letters (Unicode category L), in lower case, for the fit and for predictions alike. Characters outside of the vocabulary share the probability of one unknown piece.
``score`` is the posterior of the best language under equal priors; equal scores go to the language first in order.

Edge cases: null texts and texts without a letter are ``und`` with score 0; without any labelled document all
texts are ``und``; rows are independent, so that ties and repeated rows repeat; more than ``MOST_LANGS`` languages are an error; an empty table gives an empty one; extra columns pass
through, those named as an output column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, text_slices

#: Parameter: labelled documents of each language that the fit takes, about.
DOCS_PER_LANG = 200
#: Parameter: documents of the sample in all, about; many languages have fewer each.
DOCS_IN_ALL = 8000
EM_ROUNDS = 3
SMOOTHING = 0.05
LONGEST = 24
#: Words that a worker remembers, and their characters at most.
REMEMBERED, REMEMBERED_CHARS = 250_000, 40
#: Parameter: the model is a row of all pieces for each language, and is sent to every worker; more languages than this raise an error.
MOST_LANGS = 1000
#: Numbers held at a time by the forward pass, and positions for which it lists edges.
HELD, STRETCH = 2_000_000, 4096
ASCII_LETTERS, LETTERS = re.compile(r"[a-z]+"), regex.compile(r"\p{L}+")
WORD_START = "▁"


def words_of(text: str | None) -> list[str]:
    """The runs of letters, in lower case."""
    if not text:
        return []
    text = text.lower()
    return (ASCII_LETTERS if text.isascii() else LETTERS).findall(text)


def read_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece vocabulary file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Lattices:
    """Ways to cut words into pieces."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.unknown = len(pieces)
        self.begins = {p[:k] for p in pieces for k in range(1, len(p))}
        self.longest = max(map(len, pieces), default=1)

    def edges(self, words: list[str], low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and piece of every edge that ends after ``low`` and up to ``high``."""
        ids, begins, unknown = self.ids, self.begins, self.unknown
        out: list[int] = []
        put = out.extend
        for w, word in enumerate(words):
            n = len(word) if high is None else min(len(word), high)
            for s in range(max(0, low - self.longest), n):
                e = s + 1
                part = word[s:e]
                if e > low:
                    put((w, s, e, ids.get(part, unknown)))
                while part in begins and e < n:
                    e += 1
                    part = word[s:e]
                    i = ids.get(part)
                    if i is not None and e > low:
                        put((w, s, e, i))
        flat = np.array(out, np.int64).reshape(-1, 4)
        return flat[:, 0], flat[:, 1], flat[:, 2], flat[:, 3]

    def log_forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """[word, language] logarithms of the words' probabilities; ``p`` is [piece, language]. Words of similar length go together."""
        out = np.zeros((len(words), p.shape[1]), np.float32)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        most = max(1, HELD // ((self.longest + 1) * max(1, p.shape[1])))
        for at in range(0, len(order), most):
            part = order[at : at + most]
            out[part] = self._log_forward([words[k] for k in part], p)
        return out

    def _log_forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Keeps the sums of the last positions only, as many as the longest piece has characters; they are scaled up as they get small."""
        n, ring = len(words), self.longest + 1
        size = np.array([len(w) for w in words])
        alpha = np.zeros((ring, n, p.shape[1]))
        alpha[0] = 1
        scale, out = np.zeros((n, p.shape[1])), np.zeros((n, p.shape[1]))
        for low in range(0, int(size.max(initial=0)), STRETCH):
            high = min(low + STRETCH, int(size.max()))
            w, s, e, i = self.edges(words, low, high)
            order = np.lexsort((w, e))
            w, s, e, i = w[order], s[order] % ring, e[order], i[order]
            cuts = np.searchsorted(e, np.arange(low + 1, high + 2))
            for at in range(low + 1, high + 1):
                a, b = cuts[at - low - 1], cuts[at - low]
                first = np.flatnonzero(np.diff(w[a:b], prepend=-1))
                here = w[a:b][first]
                alpha[at % ring, here] = np.add.reduceat(alpha[s[a:b], w[a:b]] * p[i[a:b]], first)
                ends = here[size[here] == at]
                if len(ends):
                    out[ends] = np.log(np.maximum(alpha[at % ring, ends], 1e-300)) + scale[ends]
                if at % 16 == 0:
                    largest = np.maximum(alpha.max(0), 1e-300)
                    alpha /= largest
                    scale += np.log(largest)
        return out

    def _sums(self, n: int, edges, p: np.ndarray) -> np.ndarray:
        """[word, position] sums of one language, for words of up to LONGEST characters; ``p`` is [piece]."""
        w, s, e, i = edges
        alpha = np.zeros((n, LONGEST + 1))
        alpha[:, 0] = 1
        order = np.lexsort((w, e))
        w, s, e, i = w[order], s[order], e[order], i[order]
        cuts = np.searchsorted(e, np.arange(LONGEST + 2))
        for at in range(1, LONGEST + 1):
            a, b = cuts[at], cuts[at + 1]
            if a < b:
                first = np.flatnonzero(np.diff(w[a:b], prepend=-1))
                alpha[w[a:b][first], at] = np.add.reduceat(alpha[w[a:b], s[a:b]] * p[i[a:b]], first)
        return alpha

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts of one language; ``p`` is [piece]."""
        out = np.zeros(len(p))
        for at in range(0, len(words), 20_000):
            part, n = words[at : at + 20_000], counts[at : at + 20_000]
            w, s, e, i = self.edges(part)
            size = np.array([len(x) for x in part])
            alpha = self._sums(len(part), (w, s, e, i), p)
            # backward sums are forward sums of the reversed lattice
            beta = self._sums(len(part), (w, size[w] - e, size[w] - s, i), p)
            whole = alpha[np.arange(len(part)), size]
            share = alpha[w, s] * p[i] * beta[w, size[w] - e] / np.maximum(whole[w], 1e-300)
            out += np.bincount(i, share * n[w], len(p))
        return out


def cut(word: str) -> list[str]:
    """The word with its start mark, in pieces of LONGEST characters at most."""
    marked = WORD_START + word
    return [marked] if len(marked) <= LONGEST else [marked[k : k + LONGEST] for k in range(0, len(marked), LONGEST)]


class Model:
    """Learned languages and piece probabilities; small: pieces times languages."""

    def __init__(self, pieces: list[str], langs: list[str], p: np.ndarray):
        self.pieces, self.langs, self.p = pieces, langs, p

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.langs = model.langs
        self.p = model.p
        self.lattices = Lattices(model.pieces)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.langs)), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found = [words_of(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self._forget()
        new = sorted({w for x in found for w in x if w not in self.known}, key=lambda w: (len(w) > REMEMBERED_CHARS, w))
        for w in new:
            self.known[w] = len(self.known)
        marked = [WORD_START + w for w in new]
        logs = np.concatenate([self.logs, *(self.lattices.log_forward(marked[at : at + 4000], self.p) for at in range(0, len(marked), 4000))])
        names, scores = [], np.zeros(len(texts))
        for k, words in enumerate(found):
            if not words or not self.langs:
                names.append("und")
                continue
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            total = logs[at].sum(0, dtype=np.float64)
            best = int(total.argmax())
            names.append(self.langs[best])
            scores[k] = 1 / np.exp(total - total[best]).sum()
        for w in reversed(new):
            if len(w) <= REMEMBERED_CHARS:
                break
            del self.known[w]
        self.logs = logs[: len(self.known)]
        return names, scores


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is left out of the fit: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, docs_per_lang: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """About ``docs_per_lang`` rows (text, lang) of each language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} languages")
    docs_per_lang = max(1, min(docs_per_lang, DOCS_IN_ALL // max(1, len(counts))))
    share = F.lit(0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col(lang_col) == lang, min(1 << 30, int(docs_per_lang / n * (1 << 30)) + 1)).otherwise(share)
    place = F.xxhash64(F.lit("language sample"), F.coalesce(F.col(id_col).cast("string"), F.col(text_col))).bitwiseAND((1 << 30) - 1)
    return rows.where(place < share).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))


def fit(labelled: DataFrame, pieces: list[str], docs_per_lang: int = DOCS_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on the driver, from the word counts of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, w, n) for lang, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True) for w, n in Counter(words_of(text)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    found = mapped(sample(labelled, docs_per_lang, id_col, text_col, lang_col), run, "lang string, word string, n long")
    rows = found.groupBy("lang", "word").agg(F.sum("n").alias("count")).toPandas()
    lattices, langs = Lattices(pieces), sorted(rows["lang"].unique())
    p = np.zeros((len(pieces) + 1, len(langs)))
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang].sort_values("word")
        flat = [(c, n) for w, n in zip(own["word"], own["count"], strict=True) for c in cut(w)]
        parts, counts = [c for c, _ in flat], np.array([n for _, n in flat], float)
        now = np.full(len(p), 1 / len(p))
        for _ in range(EM_ROUNDS):
            got = lattices.expected(parts, counts, now) + SMOOTHING
            now = got / got.sum()
        p[:, k] = now
    return Model(pieces, [str(x) for x in langs], p)


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score to all columns but those of these names."""
    held = df.sparkSession.sparkContext.broadcast((model.pieces, model.langs, model.p))
    keep = [f for f in df.schema.fields if f.name.lower() not in ("lang_pred", "score")]
    schema = T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(*held.value).scorer()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            names, scores = [], []
            for texts in text_slices(column):
                a, b = scorer.predict(texts)
                names += a
                scores.append(b)
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in keep), pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return mapped(df, run, schema)
