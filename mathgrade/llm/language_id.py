"""Language identification by interpolated Kneser-Ney character models.

One character model of order ``ORDER`` per language. Texts are lower-cased,
runs of other characters than letters become one space. The models live in
sorted arrays of n-gram hashes with one column of log-probabilities per
language; an n-gram that no language has seen falls back to the next lower
order by the back-off weights of its context, which are kept alike. A text gets
the language of the lowest cross-entropy per character.

Rejection is calibrated: for each language, labelled texts outside the training
sample give mean and deviation of the cross-entropy (shrunk to the mean for
short texts); a text is rejected if it lies above ``mean + SIGMAS * deviation``,
``mean + MARGIN`` and every calibration text, or if it has no letter. A limit
stays below the cost of letters that the language has never seen (half way
from chance, the logarithm of the number of known characters) unless a
calibration text lies above that.

Training reads a bounded sample: per language, the documents of the lowest
hash, ``TRAIN_DOCS`` for the counts and ``CALIBRATION_DOCS`` for the
calibration, whole texts. They are dealt by share (every third to the
calibration), so that a language of fewer documents has both. A language with
too few for that is cross-fitted: all its documents count, and each calibrates
a model of those of the other folds. If fewer than ``LEAST`` texts calibrate a
language, its limit takes the widest distance from mean to limit of the other
languages and isn't below chance. Every text of the table is then scored whole.

Definitions for odd input. Null texts and texts without a letter are ``und``
with score 0 and rejected. Documents with null lang, text or id are not learnt
from. Without any labelled document all texts are ``und``. Ties go to the
language that sorts first. Rows are scored one by one; extra columns are
ignored by ``predict`` and kept by ``keep``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fraction_bucket, lowest, row_and_text, stored, texts, trimmed
from .wordbytes import mix64

ORDER = 4
TRAIN_DOCS = 400
CALIBRATION_DOCS = 200
#: Calibration texts that a limit of its own needs, and folds of a language that is dealt fewer than 1.5 times that.
LEAST, FOLDS = 20, 3
SIGMAS = 8.0
#: A limit lies at least this far (nats per character) above the mean: mixed or noisy texts of a language stay.
MARGIN = 1.5
#: Characters of prior weight that a short text's cross-entropy is shrunk by.
SHRINK = 30
#: Characters at most that a score treats as independent evidence.
EVIDENCE = 20
PIECE_CHARS = 1 << 18
PAD, SPACE = 0, 32
UNKNOWN = "und"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code, and whether it is a letter, of each code point."""
    n = sys.maxunicode + 1
    code, letter = np.arange(n, dtype=np.uint32), np.zeros(n, bool)
    for i in range(n):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            low = c.lower()
            if len(low) == 1:
                code[i] = ord(low)
    code[~letter] = SPACE
    code[0] = PAD
    return code, letter


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised characters of all texts, each preceded by ORDER - 1 pads, and the text index of each."""
    if not _TABLES:
        _TABLES.append(_tables())
    code, letter = _TABLES[0]
    pad = "\0" * (ORDER - 1)
    raw = np.frombuffer((pad + pad.join(t.replace("\0", " ") for t in texts)).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.array([len(t) for t in texts], np.int64) + ORDER - 1)
    is_letter = letter[raw]
    keep = is_letter | (raw == PAD)
    keep[1:] |= is_letter[:-1]
    return code[raw[keep]], owner[keep]


_SEED = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, ORDER + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hash_rows(grams: np.ndarray) -> np.ndarray:
    """Hash of each row of codes; the same as for a window of a text."""
    h = np.full(len(grams), np.uint64(grams.shape[1]))
    for k in range(grams.shape[1]):
        # weights count from the last character, so a gram's suffix keeps its weights
        h += grams[:, k].astype(np.uint64) * _SEED[grams.shape[1] - 1 - k]
    return mix64(h)


def _hash_windows(codes: np.ndarray, order: int, at: np.ndarray) -> np.ndarray:
    """Hash of the ``order`` characters that end at each position of ``at``."""
    h = np.full(len(at), np.uint64(order))
    for k in range(order):
        h += codes[at - (order - 1 - k)].astype(np.uint64) * _SEED[order - 1 - k]
    return mix64(h)


@dataclass
class Model:
    """Sorted hash arrays by order: n-grams with log-probabilities, contexts with log back-off weights."""

    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    base: np.ndarray | None = None
    mean: np.ndarray | None = None
    limit: np.ndarray | None = None
    chance: float = 0.0

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy sums (one column per language) and characters of each text."""
        codes, owner = _codes(texts)
        every = np.flatnonzero(codes != PAD)
        n = np.bincount(owner[every], minlength=len(texts))
        total = np.zeros((len(texts), len(self.languages)))
        if self.languages:
            for a in range(0, len(every), PIECE_CHARS):  # a very long text is scored in parts
                at = every[a:a + PIECE_CHARS]
                lp = self._logp(codes, at)
                for k in range(len(self.languages)):
                    total[:, k] -= np.bincount(owner[at], lp[:, k], minlength=len(texts))
        return total, n

    def _logp(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of the character at each position, by language."""
        lp = np.zeros((len(at), len(self.languages)), np.float32)
        todo = np.arange(len(at))
        for order in range(ORDER, 0, -1):
            h = _hash_windows(codes, order, at[todo])
            i = np.searchsorted(self.grams[order - 1], h)
            i[i == len(self.grams[order - 1])] = 0
            hit = self.grams[order - 1][i] == h
            lp[todo[hit]] += self.logp[order - 1][i[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if order > 1:
                h = _hash_windows(codes, order - 1, at[todo] - 1)
                i = np.searchsorted(self.contexts[order - 1], h)
                i[i == len(self.contexts[order - 1])] = 0
                hit = self.contexts[order - 1][i] == h
                lp[todo[hit]] += self.weights[order - 1][i[hit]]
            else:
                lp[todo] += self.base
        return lp

    def decide(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language index (-1: none), score, cross-entropy per character and rejection of each text."""
        total, n = self.entropy(texts)
        none = (n == 0) | (not self.languages)
        if not self.languages:
            zero = np.zeros(len(texts))
            return np.full(len(texts), -1), zero, zero, np.ones(len(texts), bool)
        ce = total / np.maximum(n, 1)[:, None]
        best = ce.argmin(1)
        low = ce[np.arange(len(texts)), best]
        odds = np.exp(-(ce - low[:, None]) * np.minimum(n, EVIDENCE)[:, None]).sum(1)
        rejected = none.copy()
        if self.limit is not None:
            shrunk = (low * n + SHRINK * self.mean[best]) / (n + SHRINK)
            rejected |= shrunk > self.limit[best]
        return np.where(none, -1, best), np.where(none, 0.0, 1 / odds), np.where(none, 0.0, low), rejected


def fit(languages: list[str], lang: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> Model:
    """Kneser-Ney models from n-gram counts of the highest order (rows of codes, by language index)."""
    model = Model(languages)
    size = len(languages)
    by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for k in range(size):
        g, c = grams[lang == k], counts[lang == k].astype(float)
        by_order[ORDER - 1].append((g, c))
        for order in range(ORDER - 1, 0, -1):  # lower orders count distinct left neighbours
            g, c = np.unique(by_order[order][k][0][:, 1:], axis=0, return_counts=True)
            real = g[:, -1] != PAD
            by_order[order - 1].append((g[real], c[real].astype(float)))
    vocabulary = len(np.unique(np.concatenate([g[:, -1] for g, _ in by_order[0]]))) + 1
    below_h, below_p, base = np.zeros(0, np.uint64), np.zeros((0, size)), np.full(size, 1 / vocabulary)
    for order in range(1, ORDER + 1):
        rows = np.concatenate([g for g, _ in by_order[order - 1]])
        union_h, first = np.unique(_hash_rows(rows), return_index=True)
        union = rows[first]
        context_h = _hash_rows(union[:, :-1]) if order > 1 else np.zeros(len(union), np.uint64)
        contexts = np.unique(context_h)
        weight = np.ones((len(contexts), size))
        share = np.zeros((len(union), size))
        for k, (g, c) in enumerate(by_order[order - 1]):
            if not len(g):
                continue
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            discount = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 + n2 else 0.5
            own = np.searchsorted(contexts, _hash_rows(g[:, :-1]) if order > 1 else np.zeros(len(g), np.uint64))
            mass = np.bincount(own, c, minlength=len(contexts))
            types = np.bincount(own, minlength=len(contexts))
            seen = mass > 0
            weight[seen, k] = discount * types[seen] / mass[seen]
            share[np.searchsorted(union_h, _hash_rows(g)), k] = (c - discount) / mass[own]
        if order == 1:
            lower = base[None, :]
            new_base = weight[0] * base if len(weight) else base
        else:
            at = np.searchsorted(below_h, _hash_rows(union[:, 1:]))
            lower = below_p[at]
        p = share + weight[np.searchsorted(contexts, context_h)] * lower
        model.grams.append(union_h)
        model.logp.append(np.log(p).astype(np.float32))
        model.contexts.append(contexts)
        model.weights.append(np.log(weight).astype(np.float32))
        below_h, below_p = union_h, p
    model.base = np.log(new_base).astype(np.float32)
    model.chance = float(np.log(vocabulary))
    return model


def _runs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The column cut into runs of at most ``PIECE_CHARS`` characters (a longer text alone)."""
    start, held, run = 0, 0, []
    for i, value in enumerate(column):
        t = value.as_py()
        if run and held + len(t or "") > PIECE_CHARS:
            yield start, run
            start, held, run = i, 0, []
        run.append(t or "")
        held += len(t or "")
    if run:
        yield start, run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of the highest order by language and fold, as strings."""
    for batch in batches:
        keys = np.empty(batch.num_rows, object)
        keys[:] = list(zip(batch.column("lang").to_pylist(), batch.column("fold").to_pylist(), strict=True))
        for start, run in _runs(batch.column("text")):
            codes, owner = _codes(run)
            here = keys[start:start + len(run)]
            for lang, fold in sorted(set(here)):
                mine = np.array([i for i, k in enumerate(here) if k == (lang, fold)])
                at = np.flatnonzero((codes != PAD) & np.isin(owner, mine))
                grams = np.stack([codes[at - (ORDER - 1 - k)] for k in range(ORDER)], 1)
                found, counts = np.unique(grams, axis=0, return_counts=True)
                packed = np.ascontiguousarray(found.astype("<u4"))
                out = pa.array([row.tobytes() for row in packed], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([fold] * len(found), pa.int32()), out,
                                                  pa.array(counts, pa.int64())], ["lang", "fold", "gram", "n"])


def learnable(doc_id: Column) -> Column:
    return fraction_bucket(doc_id, 4) != 2


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> Model:
    """Models and rejection limits from the bounded sample of labelled documents."""
    ids = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable(F.col("doc_id")))
    ids = ids.select("doc_id", "lang", F.xxhash64(F.col("doc_id"), F.lit("language")).alias("h"))
    ids = lowest(ids, "lang", ["h", "doc_id"], train_docs + calibration_docs, F.col("doc_id"))
    ids = ids.groupBy("doc_id").agg(F.min("pos").alias("pos"))
    # the sample has at most (train_docs + calibration_docs) rows per language
    sample = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text") \
        .join(F.broadcast(ids), "doc_id")
    sample = stored(sample, "language-sample")
    sizes = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    share = calibration_docs / max(train_docs + calibration_docs, 1)
    few = [x for x, size in sizes.items() if size * share < 1.5 * LEAST]
    dealt = F.floor(F.col("pos") * share + 1e-9) > F.floor((F.col("pos") - 1) * share + 1e-9)
    # fold -1 counts, fold -2 calibrates; a cross-fitted language does both in each fold
    sample = sample.withColumn("fold", F.when(F.col("lang").isin(few), F.pmod("pos", F.lit(FOLDS))).when(dealt, -2).otherwise(-1).cast("int"))
    counts = sample.filter("fold <> -2").select("lang", "fold", "text") \
        .mapInArrow(trimmed(_count), "lang string, fold int, gram binary, n long") \
        .groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n")).orderBy("lang", "fold", "gram").toArrow()
    names = counts.column("lang").to_pylist()
    languages = sorted(set(names))
    if not languages:
        return Model([])
    index = {x: i for i, x in enumerate(languages)}
    grams = np.frombuffer(b"".join(counts.column("gram").to_pylist()), "<u4").reshape(-1, ORDER)
    lang, fold, n = np.array([index[x] for x in names]), counts.column("fold").to_numpy(), counts.column("n").to_numpy()
    model = fit(languages, *_merged(lang, grams, n))
    models = {-2: model}
    for f in range(FOLDS):
        rest = (fold >= 0) & (fold != f)
        if rest.any():
            there = np.unique(lang[rest])
            models[f] = fit([languages[k] for k in there], *_merged(np.searchsorted(there, lang[rest]), grams[rest], n[rest]))
    held = sample.filter("fold <> -1").select("lang", "fold", "text").mapInArrow(trimmed(_calibrate(models)), "lang string, ce double, n long").toArrow()
    lang = np.array([index[x] for x in held.column("lang").to_pylist()], int)
    _set_limits(model, lang, held.column("ce").to_numpy(), held.column("n").to_numpy())
    return model


def _merged(lang: np.ndarray, grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each language without regard to folds."""
    rows, at = np.unique(np.column_stack([lang.astype(np.uint32), grams]), axis=0, return_inverse=True)
    return rows[:, 0].astype(int), rows[:, 1:], np.bincount(at.ravel(), n).astype(np.int64)


def _set_limits(model: Model, lang: np.ndarray, ce: np.ndarray, n: np.ndarray) -> None:
    """Means and limits from the calibration texts' languages, cross-entropies and characters."""
    size = len(model.languages)
    own = [(lang == k) & (n > 0) for k in range(size)]
    enough = [k for k in range(size) if own[k].sum() >= LEAST]
    pooled = np.isin(lang, enough) & (n > 0)
    model.mean = np.full(size, np.average(ce[pooled], weights=n[pooled]) if pooled.any() else model.chance)
    model.limit = np.zeros(size)
    widest = MARGIN
    for k in sorted(range(size), key=lambda k: k not in enough):
        c, m = ce[own[k]], n[own[k]]
        if len(c):
            model.mean[k] = np.average(c, weights=m)
        shrunk = (c * m + SHRINK * model.mean[k]) / (m + SHRINK)
        if k in enough:
            limit = max(shrunk.mean() + SIGMAS * shrunk.std(), model.mean[k] + MARGIN)
            widest = max(widest, limit - model.mean[k])
        else:
            limit = max(model.mean[k] + widest, model.chance)
        model.limit[k] = max(min(limit, (model.chance - model.base[k]) / 2), shrunk.max(initial=0.0))


def _calibrate(models: dict[int, Model]):
    """Cross-entropy of each text by its own language in the model for its fold; none if that model lacks the language."""
    index = {f: {x: k for k, x in enumerate(m.languages)} for f, m in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, folds = batch.column("lang").to_pylist(), batch.column("fold").to_pylist()
            for start, run_texts in _runs(batch.column("text")):
                for f in sorted(set(folds[start:start + len(run_texts)])):
                    at = [i for i in range(len(run_texts)) if folds[start + i] == f and langs[start + i] in index.get(f, ())]
                    if not at:
                        continue
                    total, n = models[f].entropy([run_texts[i] for i in at])
                    mine = [langs[start + i] for i in at]
                    own = total[np.arange(len(at)), [index[f][x] for x in mine]]
                    yield pa.RecordBatch.from_arrays([pa.array(mine, pa.string()), pa.array(own / np.maximum(n, 1)), pa.array(n, pa.int64())],
                                                     ["lang", "ce", "n"])
    return run


def _score(model: Model, row: str):
    """Adds the decision beside the column ``row``: an id, or a whole row that holds the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            column = batch.column("text") if "text" in batch.schema.names else texts(batch)
            for start, run_texts in _runs(column):
                best, score, ce, rejected = model.decide(run_texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(row).slice(start, len(run_texts)), pa.array(names[best].tolist(), pa.string()),
                     pa.array(score), pa.array(ce), pa.array(rejected)], [row, "lang_pred", "score", "cross_entropy", "rejected"])
    return run


def _schema(first: T.StructField) -> T.StructType:
    return T.StructType([first, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                         T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy and rejected of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(trimmed(_score(model, "doc_id")), _schema(T.StructField("doc_id", T.LongType())))
    return out.withColumn("held_out", ~learnable(F.col("doc_id")))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, unchanged."""
    rows = row_and_text(docs)
    out = rows.mapInArrow(trimmed(_score(model, "row")), _schema(rows.schema["row"])).filter("not rejected")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
