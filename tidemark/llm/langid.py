"""Language of a text: its family first, then the languages of that family by pairs.

Features are counts of three-byte runs of the lower-cased text, hashed to ``DIM`` places,
with everything that is not a letter read as a space. Linear support vector machines
without offset are trained on a bounded sample of labelled rows: one for every two
families, and one for every two languages within a family. A text takes the family, then
the language, that wins most of its pairs; equal wins are settled by the sum of margins.

``score`` is the product over both levels of the winner's mean logistic of its margins, so
an undecided pair counts 0.5. Null texts and texts without a letter are ``und`` with score
0; so is every text if there are no labelled rows. With one learned language, every text
with a letter is of it, with score 1.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import forget, slices

UNKNOWN = "und"
DIM = 4096
#: Labelled rows that are fitted, all languages together: the bound of what the driver holds.
SAMPLE = 3200
#: Most texts counted at a time, and most bytes.
ROWS, BYTES = 512, 1 << 21

# Language codes by family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "hr", "sl", "sk", "cs", "pl"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
    "semitic": ("ar", "he"),
    "indo-aryan": ("hi", "bn", "ur", "mr"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = range(97, 123)
LETTERS[128:] = range(128, 256)


def histograms(texts: pa.Array) -> np.ndarray:
    """Counts of hashed three-byte runs per text, scaled to length one (zero if there are none)."""
    space = pa.scalar(" ", pa.large_string())
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    padded = pc.binary_join_element_wise(space, lower, space, pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(padded.buffers()[1], np.int64)[padded.offset : padded.offset + len(padded) + 1]
    data = padded.buffers()[2]
    raw = LETTERS[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    out = np.zeros(len(texts) * DIM, np.float64)
    # a run is counted in the text of its first byte, unless it reaches into the next one
    base = np.repeat(np.arange(len(texts)) * DIM, np.diff(offsets))
    for a in range(0, max(len(raw) - 2, 0), BYTES):
        block = raw[a : a + BYTES + 2].astype(np.uint32)
        code = block[:-2] | block[1:-1] << np.uint32(8) | block[2:] << np.uint32(16)
        code *= np.uint32(2654435761)
        code >>= np.uint32(32 - (DIM.bit_length() - 1))
        text = base[a : a + BYTES + 2]
        good = np.flatnonzero((block[1:-1] != 32) & (text[:-2] == text[2:]))
        out += np.bincount(text[good] + code[good], minlength=len(out))
    counts = out.reshape(len(texts), DIM)
    size = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return (counts / np.where(size > 0, size, 1)).astype(np.float32)


def fit_margin(x: np.ndarray, positive: np.ndarray, turns: int = 250, weight: float = 1e-4) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, both classes weighing the same.

    Accelerated gradient descent; rows have length one, which bounds the curvature.
    """
    sign = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum()).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    rate, pace = 1.0 / (2.0 + weight), 1.0
    for _ in range(turns):
        short = np.maximum(0, 1 - sign * (x @ ahead))
        slope = weight * ahead - 2 * ((share * sign * short) @ x)
        step = ahead - np.float32(rate) * slope
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = step + np.float32((pace - 1) / faster) * (step - w)
        w, pace = step, faster
    return w


@dataclass
class Model:
    families: list[tuple[str, list[str]]]
    family_pairs: np.ndarray
    language_pairs: list[np.ndarray]
    #: Steepness of the logistic of each level.
    steep: float = 4.0

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        x = histograms(texts)
        known = pc.fill_null(pc.match_substring_regex(texts, "\\pL"), False).to_numpy(zero_copy_only=False)
        if not self.families:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        family, score = self._winner(x, len(self.families), self.family_pairs)
        names = np.empty(len(texts), object)
        for n, (_, languages) in enumerate(self.families):
            mine = family == n
            best, sure = self._winner(x[mine], len(languages), self.language_pairs[n])
            names[mine] = [languages[b] for b in best]
            score[mine] *= sure
        names[~known] = UNKNOWN
        return names.tolist(), np.where(known, score, 0.0)

    def _winner(self, x: np.ndarray, choices: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wins, margins, sure = (np.zeros((len(x), choices)) for _ in range(3))
        for (a, b), w in zip(combinations(range(choices), 2), weights):
            margin = x @ w
            for choice, m in ((a, margin), (b, -margin)):
                wins[:, choice] += m > 0
                margins[:, choice] += m
                sure[:, choice] += 1 / (1 + np.exp(-self.steep * m))
        best = np.lexsort((margins, wins), axis=1)[:, -1] if len(x) else np.zeros(0, np.int64)
        return best, sure[np.arange(len(x)), best] / max(1, choices - 1) if choices > 1 else np.ones(len(x))


def held_out(key: Column) -> Column:
    """Rows that are never learned from: the CRC-32 of the key as text leaves 2 by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(labelled: DataFrame, size: int) -> DataFrame:
    """About ``size`` rows (id, text, lang), as many of each language where it has them."""
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    each = max(1, size // max(1, len(counts)))
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) / F.lit(1e6)
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * each / n)))) if counts else None
    return labelled.filter(draw < F.element_at(share, F.col("lang"))) if counts else labelled


def _ordered(found: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Languages and histograms of the sample in a fixed order, as many rows of each language.

    The histograms are read where Arrow has them and copied once.
    """
    lang, id_ = found.column("lang").to_pylist(), found.column("id").to_pylist()
    parts = [np.frombuffer(c.buffers()[2], np.float32).reshape(-1, DIM)[c.offset : c.offset + len(c)] for c in found.column("x").chunks if len(c)]
    place = [(p, n) for p, part in enumerate(parts) for n in range(len(part))]
    order = sorted(range(len(lang)), key=lambda k: (lang[k], id_[k] or "", zlib.crc32(parts[place[k][0]][place[k][1]])))
    each, kept, seen = max(1, size // max(1, len(set(lang)))), [], Counter()
    for k in order:
        seen[lang[k]] += 1
        if seen[lang[k]] <= each:
            kept.append(k)
    x = np.empty((len(kept), DIM), np.float32)
    for row, k in enumerate(kept):
        x[row] = parts[place[k][0]][place[k][1]]
    return np.array([lang[k] for k in kept], object), x


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", size: int = SAMPLE) -> Model:
    """A model from a sample of at most ``size`` labelled rows that are not held out."""
    labelled = docs.filter(~held_out(F.col(f"`{key}`"))).select(
        F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")
    )
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def count(batches):
        forget()
        for batch in batches:
            for part in slices(batch, "text", BYTES):
                for n in range(0, part.num_rows, ROWS):
                    few = part.slice(n, ROWS)
                    x = histograms(few.column("text"))
                    yield pa.RecordBatch.from_arrays(
                        [few.column("lang"), few.column("id").cast(pa.string()), pa.array([r.tobytes() for r in x], pa.binary())],
                        names=["lang", "id", "x"],
                    )

    label, x = _ordered(_sample(labelled, size).mapInArrow(count, "lang string, id string, x binary").toArrow(), size)
    languages = sorted(set(label))
    groups: dict[str, list[str]] = {}
    for code in languages:
        groups.setdefault(FAMILY_OF.get(code.lower(), code), []).append(code)
    families = sorted(groups.items())

    def pairs(names: list[list[str]]) -> np.ndarray:
        found = []
        for a, b in combinations(names, 2):
            mine = np.isin(label, a + b)
            found.append(fit_margin(x[mine], np.isin(label[mine], a)))
        return np.stack(found) if found else np.zeros((0, DIM), np.float32)

    return Model(families, pairs([codes for _, codes in families]), [pairs([[c] for c in codes]) for _, codes in families])


def identify(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the language and its score; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in (pred, score)]
    schema = T.StructType(
        [*(docs.schema[c] for c in kept), T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]
    )
    place = kept.index(text)

    def run(batches):
        forget()
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, [str(n) for n in range(batch.num_columns)])
            for part in slices(batch, str(place), BYTES):
                for n in range(0, part.num_rows, ROWS):
                    few = part.slice(n, ROWS)
                    names, sure = model.predict(few.column(place))
                    yield pa.RecordBatch.from_arrays([*few.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64())], schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)
