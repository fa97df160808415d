"""Hierarchical language identification: the family first, then the language within it.

Features are hashed counts of one- to three-byte grams of the lower-cased text, runs of anything but letters
being one blank, dampened by a square root and scaled to length one.  A linear support vector machine per
family (one against the rest) picks the family; within it a machine for each pair of languages votes.  The
machines are fitted on the driver from a bounded sample of labelled rows' features; every text is then scored
whole, in the executors, from a model of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrain.sources.workspace import spread

from .common import bound_batches
from .kernels import LOWER, buffers, pieces

#: Close relatives (fixed values); a language that is not listed is a family of its own.
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da", "no", "is"), "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"), "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"), "uralic": ("fi", "et", "hu"), "turkic": ("tr", "az", "kk")}
BITS = 11
DIM = 1 << BITS
#: Labelled rows that the machines are fitted on, at most, over all languages.
SAMPLE_ROWS = 4000
#: A text whose margins are less than ``PART`` of those that all but ``FEW`` of the fitted texts of its family or
#: language reach is in none of the learnt languages.
PART, FEW = 0.5, 0.01
#: Steps end when no weight changes by more than this share of the largest.
SETTLED = 1e-3
#: Bytes and rows whose features are held at a time.
PIECE = (500_000, 512)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_MULTIPLY = np.uint32(2654435761)


def text_features(column: pa.Array) -> np.ndarray:
    """(rows, DIM) float32 features of a piece of a string column."""
    raw, off = buffers(column)
    n = len(off) - 1
    low = LOWER[raw]
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    letter = _LETTER[low]
    low = np.where(letter, low, np.uint8(32))
    keep = letter.copy()
    keep[:1] |= True
    keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
    low, row = low[keep].astype(np.uint32), row[keep]
    out = np.zeros(n * DIM, np.float32)
    code = low
    for size in (1, 2, 3):
        if size > 1:
            code = (code[:-1] << np.uint32(8)) | low[size - 1 :]
            whole = row[size - 1 :] == row[: len(row) - size + 1]
            own, at = code[whole], row[: len(row) - size + 1][whole]
        else:
            own, at = code, row
        slot = ((own + np.uint32(size << 24)) * _MULTIPLY) >> np.uint32(32 - BITS)
        out += np.bincount(at * DIM + slot, minlength=n * DIM).astype(np.float32)
    out = np.sqrt(out.reshape(n, DIM))
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12)


def fit_svm(x: np.ndarray, y: np.ndarray, weight: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Weights (the last one the bias) of a linear machine with squared hinge loss, classes weighted alike,
    by accelerated gradient steps; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    v, t, rate = w.copy(), 1.0, 1 / (2 * 2.0 + weight)
    for _ in range(steps):
        old = w
        lack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (weight * v - 2 * (x.T @ (share * y * lack)))
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / later * (new - w)
        w, t = new, later
        if np.abs(w - old).max() <= SETTLED * np.abs(w).max():
            break
    return w


class Model:
    """Machines by family and by pair of languages."""

    def __init__(self, x: np.ndarray, labels: list[str], families: Mapping[str, Iterable[str]] = FAMILIES):
        of = {lang: name for name, langs in families.items() for lang in langs}
        self.languages = sorted(set(labels))
        self.family = {lang: of.get(lang, f"={lang}") for lang in self.languages}
        self.names = sorted(set(self.family.values()))
        y = np.array(labels)
        fam = np.array([self.family[v] for v in labels])
        sign = lambda hit: np.where(hit, 1, -1).astype(np.float32)
        names = self.names if len(self.names) > 1 else []
        # of two families one machine tells both apart
        fits = [fit_svm(x, sign(fam == f)) for f in names[: 1 if len(names) == 2 else None]]
        self.family_weights = np.array(fits if len(names) != 2 else [fits[0], -fits[0]]).reshape(len(names), DIM + 1)
        self.members = {f: [v for v in self.languages if self.family[v] == f] for f in self.names}
        self.pairs = {}
        for f in self.names:
            for a, b in combinations(self.members[f], 2):
                own = (y == a) | (y == b)
                self.pairs[a, b] = fit_svm(x[own], sign(y[own] == a))
        found, _, family, language = self.decide(x)
        right = found == y
        usual = lambda m: PART * float(np.quantile(m, FEW)) if len(m) else 0.0
        self.least_family, self.least_language = (usual(m[right & np.isfinite(m)]) for m in (family, language))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores; a score is the product of the logistic of the family's lead over the next
        and of the winner's smallest margin within it."""
        return self.decide(x)[:2]

    def learnt(self, family: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Which texts with these margins are in a learnt language.  A single learnt language has no margins, so
        all are."""
        return (family >= self.least_family) & (language >= self.least_language)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`predict`, and the best family's margin and the winner's smallest one in its family; a margin
        is infinite where there is no other to choose."""
        n = len(x)
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -30, 30)))
        if len(self.family_weights):
            margins = x @ self.family_weights[:, :-1].T + self.family_weights[:, -1]
            won = margins.argmax(1)
            ranked = np.sort(margins, 1)
            family = ranked[:, -1]
            score = sure((ranked[:, -1] - ranked[:, -2]) / 2)
        else:
            won, score, family = np.zeros(n, int), np.ones(n), np.full(n, np.inf)
        language = np.full(n, np.inf)
        out = np.empty(n, object)
        for k, f in enumerate(self.names):
            at, langs = np.flatnonzero(won == k), self.members[f]
            if not len(at):
                continue
            votes = np.zeros((len(at), len(langs)))
            least = np.full((len(at), len(langs)), np.inf)
            for (a, b), w in self.pairs.items():
                if a not in langs:
                    continue
                m = x[at] @ w[:-1] + w[-1]
                for lang, side in ((a, m), (b, -m)):
                    j = langs.index(lang)
                    votes[:, j] += np.where(side > 0, 1, 0)
                    least[:, j] = np.minimum(least[:, j], side)
            best = (votes + 1e-6 * np.clip(np.where(np.isinf(least), 0, least), -1e3, 1e3)).argmax(1)
            out[at] = np.array(langs, object)[best]
            language[at] = own = least[np.arange(len(at)), best]
            score[at] *= np.where(np.isinf(own), 1.0, sure(own))
        return out, score, family, language


def fold(key: Column, folds: int) -> Column:
    """CRC-32 of the key's text (a null key's is '') modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, families: Mapping[str, Iterable[str]] = FAMILIES) -> Model | None:
    """Fit from rows with a text and a label, at most ``sample_rows`` of them; None if there are no labelled rows.

    Languages are sampled alike, by a hash of text and label, and a text counts once for each label.  Ids take no part, so null
    or repeated ids change nothing (``key`` is not read).  Of every language that has a row at least one text is drawn."""
    bound_batches(labelled.sparkSession)
    rows = spread(labelled).where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    draw = F.pmod(F.xxhash64(F.col(text), F.col(lang), F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    counts = {r[0]: (r[1], r[2]) for r in rows.groupBy(lang).agg(F.count("*"), F.min(draw)).collect()}  # one row a language
    if not counts:
        return None
    share = max(1, sample_rows // len(counts))
    most = F.lit(0.0)
    for v, (c, least) in sorted(counts.items()):
        most = F.when(F.col(lang) == v, max(min(1.0, 0.9 * share / c), least)).otherwise(most)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in pieces(b.column(1), *PIECE):
                x = text_features(b.column(1).slice(i, j - i)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    drawn = rows.where(draw <= most).select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropDuplicates()
    sample = drawn.mapInArrow(features, "lang string, x binary").limit(sample_rows).toArrow()
    if not sample.num_rows:
        return None
    x = np.frombuffer(b"".join(sample["x"].to_pylist()), np.float16).reshape(-1, DIM).astype(np.float32)
    order = np.lexsort((x[:, 0], sample["lang"].to_numpy(zero_copy_only=False).astype(str)))
    return Model(x[order], [sample["lang"][int(i)].as_py() for i in order], families)


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), learnt_only: bool = False) -> DataFrame:
    """(key, lang_pred, score) and the columns ``keep`` of every row, from its whole text alone.

    A text that is null or has no letter is ``und`` with score 0, as is every text without a model (no
    labelled rows), and with ``learnt_only`` every text that is in none of the learnt languages.  Null keys and
    repeated rows are kept.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    names = [f"_k{i}" for i in range(len(keep) + 1)]
    rows = spread(docs).select(*(F.col(c).alias(n) for c, n in zip((key, *keep), names, strict=True)), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_ok"), F.col(text).cast("string").alias("_text"))
    sent = spark.sparkContext.broadcast(model)
    kinds = [docs.schema[c].dataType.simpleString() for c in (key, *keep)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in pieces(b.column(len(names) + 1), *PIECE):
                part = b.slice(i, j - i)
                ok = part.column(len(names)).to_numpy(zero_copy_only=False)
                pred, score = np.full(len(ok), "und", object), np.zeros(len(ok))
                if sent.value is not None and ok.any():
                    own, s, family, language = sent.value.decide(text_features(part.column(len(names) + 1)))
                    if learnt_only:
                        ok = ok & sent.value.learnt(family, language)
                    pred[ok], score[ok] = own[ok], s[ok]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)) + ", lang_pred string, score double"
    out = rows.mapInArrow(run, schema)
    for c, n in zip((key, *keep), names, strict=True):
        out = out.withColumnRenamed(n, c)
    return out
