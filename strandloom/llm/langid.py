"""Language identification in two steps: family first, then pairs within it.

Texts become hashed counts of letter sequences (one to three bytes of the
lower-cased text, everything else a blank), square-rooted and scaled to length
one.  Linear support vector machines, one per family against the rest, choose
the family.  Within it, one machine for each pair of languages votes.

The models are fitted on the driver from a bounded sample: at most ``per_lang``
texts of each language, the first in the order of a hash of id and text, and fewer
where there are so many languages that those would pass ``MAX_TEXTS`` together.
Every language is learned.  Only their hashed counts, made from whole texts on
the executors, reach the driver.  Prediction maps over all texts; nothing is
shuffled.

Defined results: null texts and those without a letter are ``und`` with score
0; rows without a language teach nothing; repeated rows get equal answers; with
no row to learn from every text is ``und``; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import stage, table

#: Families of ISO 639-1 codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr gu pa ur ne",
    "semitic": "ar he am mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
PER_LANG = 400
#: Texts to learn from, of all languages together (21.5 kB each on the driver).
MAX_TEXTS = 16_000
#: Hash slots of single letters, pairs and triples.
SLOTS = (256, 1024, 4096)
#: Bytes that count as letters: a to z and all of multi-byte characters.
FOLD = np.where([97 <= b <= 122 or b >= 128 for b in range(256)], np.arange(256), 32).astype(np.uint32)


def features(text: str) -> np.ndarray:
    b = FOLD[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    b = b[(b != 32) | np.append(True, b[:-1] != 32)] if len(b) else b
    pairs = b[:-1] * 31 + b[1:]
    triples = (b[:-2] * 961 + b[1:-1] * 31 + b[2:]) * 2654435761 >> 20
    out = np.concatenate(
        [
            np.bincount(b, minlength=SLOTS[0]),
            np.bincount(pairs % SLOTS[1], minlength=SLOTS[1]),
            np.bincount(triples % SLOTS[2], minlength=SLOTS[2]),
        ]
    )
    out = np.sqrt(out, dtype=np.float32)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights, the last the bias, of a linear machine with squared hinge loss; ``y`` is -1 or 1.

    Accelerated gradient descent with a step from the largest singular value.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x.dtype) * c
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(15):
        v = x.T @ (share * (x @ v))
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    rate = 1 / (1 + 2 * top)
    w = prev = np.zeros(x.shape[1], x.dtype)
    for k in range(steps):
        z = w + (k / (k + 3)) * (w - prev)
        slack = np.maximum(0, 1 - y * (x @ z))
        prev, w = w, z - rate * (z - 2 * (x.T @ (share * y * slack)))
    return w


@dataclass
class Model:
    families: dict[str, list[str]]
    of_family: dict[str, np.ndarray]
    of_pair: dict[tuple[str, str], np.ndarray]

    @staticmethod
    def fit(x: np.ndarray, langs: np.ndarray) -> Model:
        families: dict[str, list[str]] = {}
        for code in sorted(set(langs.tolist())):
            families.setdefault(FAMILY_OF.get(code, code), []).append(code)
        own = np.array([FAMILY_OF.get(code, code) for code in langs])
        of_family = {f: fit_svm(x, np.where(own == f, 1, -1).astype(np.float32)) for f in families} if len(families) > 1 else {}
        of_pair = {}
        for codes in families.values():
            for i, a in enumerate(codes):
                for b in codes[i + 1 :]:
                    both = (langs == a) | (langs == b)
                    of_pair[a, b] = fit_svm(x[both], np.where(langs[both] == a, 1, -1).astype(np.float32))
        return Model(families, of_family, of_pair)

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        score, family = 1.0, next(iter(self.families))
        if self.of_family:
            margin = {f: float(w[:-1] @ v + w[-1]) for f, w in self.of_family.items()}
            family = max(margin, key=margin.get)
            score = _sure(margin[family])
        codes = self.families[family]
        votes, strength = dict.fromkeys(codes, 0), dict.fromkeys(codes, 0.0)
        seen = {}
        for i, a in enumerate(codes):
            for b in codes[i + 1 :]:
                w = self.of_pair[a, b]
                m = float(w[:-1] @ v + w[-1])
                seen[a, b] = m
                votes[a if m >= 0 else b] += 1
                strength[a] += m
                strength[b] -= m
        best = max(codes, key=lambda k: (votes[k], strength[k]))
        for (a, b), m in seen.items():
            if best in (a, b):
                score = min(score, _sure(m if best == a else -m))
        return best, score


def _sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-3 * np.clip(margin, -10, 10))))


def letters(text_col: str) -> Column:
    """Whether a text has a letter."""
    return F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}")


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, teaches: Column, per_lang: int = PER_LANG) -> Model | None:
    rows = docs.where(teaches & F.col(lang_col).isNotNull() & letters(text_col))
    # of rows equal in id and text one is enough
    draw = F.pmod(F.xxhash64(F.lit("langid"), id_col, text_col), F.lit(1 << 52)) / (1 << 52)
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    per_lang = max(1, min(per_lang, MAX_TEXTS // len(counts)))
    # a first cut by the share each language needs; the second, exact cut has few rows left
    share = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 2.0 * per_lang / n))))
    picked = rows.where(draw <= F.coalesce(F.try_element_at(share, F.col(lang_col)), F.lit(0.0)))

    def run(batches):
        for batch in batches:
            vectors = [features(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], names=["lang", "draw", "v"])

    picked = picked.select(F.col(lang_col).alias("lang"), draw.alias("draw"), F.col(text_col).alias("text")).dropDuplicates(["lang", "draw"])
    found = picked.mapInArrow(run, "lang string, draw double, v binary").toPandas()
    found = found.sort_values(["lang", "draw", "v"]).groupby("lang").head(per_lang)
    x = np.stack([np.frombuffer(v, np.float32) for v in found["v"]])
    return Model.fit(x, found["lang"].to_numpy(dtype=object))


def predict(docs: DataFrame, model: Model | None, id_col: str, text_col: str) -> DataFrame:
    """``id_col, lang_pred, score`` of every row."""

    def run(batches):
        for batch in batches:
            langs, scores = [], []
            for t, ok in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                lang, score = model.predict(features(t.as_py())) if model and ok else ("und", 0.0)
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, letters(text_col).alias("ok")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op3_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    model = fit(docs, "doc_id", "text", "lang", part != 1)
    out = predict(docs, model, "doc_id", "text")
    return out.select("doc_id", (part == 1).alias("held_out"), "lang_pred", "score")
