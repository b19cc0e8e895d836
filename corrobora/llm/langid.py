"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside the family.

Texts become hashed byte n-gram frequencies. Both steps are linear support vector machines trained by dual coordinate
descent in numpy on a bounded sample of labelled rows; the model is a few weight rows, of the same size for any corpus.
Prediction runs over whole texts, a row at a time, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.llm.features import bounded_sample, gram_counts, has_letter
from corrobora.ship import ship

# Families of languages by ISO 639-1 code. A language in none of them is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("bn", "gu", "hi", "mr", "pa", "ur"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

#: log2 of the number of features; rows of the sample per language (a bound on what the fit gathers: about 0.7 GB at 50 languages of long texts, 16 MB at four).
BITS, ROWS_PER_LANGUAGE = 13, 800


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12) -> np.ndarray:
    """Weights (bias last) of an L2-regularised hinge-loss SVM, by dual coordinate descent; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    cost = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1))) * c
    w, alpha, norm, rng = np.zeros(x.shape[1]), np.zeros(len(y)), (x * x).sum(axis=1), np.random.default_rng(5)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            a = np.clip(alpha[i] - (y[i] * (x[i] @ w) - 1) / norm[i], 0, cost[i])
            if a != alpha[i]:
                w += (a - alpha[i]) * y[i] * x[i]
                alpha[i] = a
    return w


class Model:
    """Families, their languages, and the weights of both steps."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.langs = sorted(set(langs.tolist()))
        of = np.array([FAMILY_OF.get(v, v) for v in langs])
        self.families = {f: sorted(set(langs[of == f].tolist())) for f in sorted(set(of.tolist()))}
        self.names = list(self.families)
        pick = [svm(x, np.where(of == f, 1.0, -1.0)) for f in self.names] if len(self.names) > 1 else []
        self.by_family = np.array(pick, np.float32).T if pick else None
        self.pairs: dict[str, tuple[list[tuple[int, int]], np.ndarray]] = {}
        for f, own in self.families.items():
            duels = list(combinations(range(len(own)), 2))
            if duels:
                rows = []
                for a, b in duels:
                    part = (langs == own[a]) | (langs == own[b])
                    rows.append(svm(x[part], np.where(langs[part] == own[a], 1.0, -1.0)))
                self.pairs[f] = (duels, np.array(rows, np.float32).T)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The language of one row, and a confidence: the family's margin and the least margin of the duels won, squashed."""
        x = np.append(x, 1.0).astype(np.float32)
        squash = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
        score, family = 1.0, self.names[0]
        if self.by_family is not None:
            m = x @ self.by_family
            top = int(m.argmax())
            family, score = self.names[top], float(squash(m[top] - np.delete(m, top).max()))
        own = self.families[family]
        if family not in self.pairs:
            return own[0], score
        duels, w = self.pairs[family]
        m, wins, sums = x @ w, np.zeros(len(own)), np.zeros(len(own))
        for (a, b), v in zip(duels, m, strict=True):
            wins[a if v > 0 else b] += 1
            sums[a] += v
            sums[b] -= v
        best = int(np.lexsort((sums, wins))[-1])
        least = min(v if a == best else -v for (a, b), v in zip(duels, m, strict=True) if best in (a, b))
        return own[best], score * float(squash(max(least, 0.0)))


def fit(documents: DataFrame, learn: Column, bits: int = BITS, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Train on the rows where ``learn`` holds that have a lang and letters; None if there are none.

    At most about ``rows_per_language`` whole texts of each language are used, chosen by doc_id, of the 200 most frequent
    languages (features.bounded_sample). They become features on the executors; the driver gathers those. Repeated rows
    count as often as they stand there. Of equal duels won, the larger sum of margins decides, then the later name.
    """
    ship(documents.sparkSession)
    rows = documents.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sample = bounded_sample(rows, F.col("lang"), rows_per_language)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text, lang, doc in zip(pdf["text"], pdf["lang"], pdf["doc_id"], strict=True):
                if has_letter(text):
                    x = gram_counts(text, bits)
                    at = np.flatnonzero(x).astype(np.uint16 if bits <= 16 else np.uint32)
                    yield pd.DataFrame({"doc": [str(doc)], "lang": [lang], "at": [at.tobytes()], "x": [x[at].astype(np.float16).tobytes()]})

    got = sample.mapInPandas(run, "doc string, lang string, at binary, x binary").toArrow().to_pandas().sort_values(["doc", "lang", "at"])
    if not len(got):
        return None
    x = np.zeros((len(got), 1 << bits), np.float32)
    for row, at, v in zip(x, got["at"], got["x"], strict=True):
        row[np.frombuffer(at, np.uint16 if bits <= 16 else np.uint32)] = np.frombuffer(v, np.float16)
    return Model(x, got["lang"].to_numpy(object))


def language_of(model: Model | None, text: Column, bits: int = BITS) -> Column:
    """struct(lang_pred, score) of a text column.

    ``und`` with score 0 for null texts, texts without a letter, and where nothing could be learned. Long texts are read
    whole. Equal texts have equal results.
    """
    ship(SparkSession.active())

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([("und", 0.0) if t is None or model is None or not has_letter(t) else model.predict(gram_counts(t, bits)) for t in part], columns=["lang_pred", "score"])

    return predict(text)
