"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import sliced

UNDETERMINED = "und"


@dataclass(frozen=True)
class LangIdSpec:
    #: n-grams of 1 to ``order`` characters, hashed into 2 ** ``bits`` features
    order: int = 3
    bits: int = 16
    #: expected number of labelled documents of each language that the model is fitted on, the fit's only bound
    sample_per_language: int = 500
    epochs: int = 3
    #: follow-the-regularised-leader: learning rate, its offset, and the elastic-net penalties
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.1
    scale: float = 50.0
    #: one in so many sampled documents calibrates the temperature instead
    calibrate_every: int = 5
    seed: int = 9


@dataclass(frozen=True)
class LangModel:
    spec: LangIdSpec
    languages: tuple[str, ...]
    #: (2 ** bits + 1, languages): weight times IDF, and zeros for no feature; (languages,) intercepts; the calibrated
    #: temperature
    table: np.ndarray
    bias: np.ndarray
    temperature: float


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str], spec: LangIdSpec) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams of all texts, one array per order; first character of each text; letters in it.

    Texts are lower-cased and every other character than a letter counts as a space; a space is put before and
    ``order`` behind each text. A place whose n-gram would reach into the next text has feature 2 ** bits, which counts
    for nothing, so a text's features do not depend on its neighbours.
    """
    low = [" " + t.lower() + " " * spec.order for t in texts]
    ends = np.cumsum([len(t) for t in low])
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(low), np.int64)
    np.cumsum([len(t) for t in low[:-1]], out=starts[1:])
    letter = _letters()[c]
    c = np.where(letter, c, np.uint32(32))
    shift = np.uint32(32 - spec.bits)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, spec.order + 1):
        h = (h[: len(c) - n + 1] ^ c[n - 1 :]) * np.uint32(0x9E3779B1) + np.uint32(n)
        h ^= h >> np.uint32(15)
        mixed = (h * np.uint32(0x85EBCA77)) >> shift
        own = np.append(mixed, np.zeros(n - 1, np.uint32)).astype(np.int32)
        for back in range(1, n):
            own[ends - back] = 1 << spec.bits
        out.append(own)
    return out, starts, np.add.reduceat(letter.astype(np.int32), starts)


def labelled_rows(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(label, text, key) of the rows to learn from; key is a hash of id and text, equal for repeated rows."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return rows.select(F.col(lang_col).alias("label"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("key"))


def sample_rows(labelled: DataFrame, sizes: dict[str, int], spec: LangIdSpec) -> DataFrame:
    """A sample with equal expected numbers per language, chosen by the key; of repeated rows one at most."""
    rates = F.create_map(*[F.lit(x) for k in sorted(sizes) for x in (k, min(1.0, spec.sample_per_language / sizes[k]))])
    draw = F.pmod(F.xxhash64("key", F.lit(spec.seed)), F.lit(1 << 30))
    part = F.pmod(F.xxhash64("key", F.lit(spec.seed + 1)), F.lit(spec.calibrate_every)).cast("int")
    return labelled.where(draw < rates[F.col("label")] * float(1 << 30)).dropDuplicates(["label", "key"]).withColumn("part", part)


def document_frequencies(labelled: DataFrame, spec: LangIdSpec) -> np.ndarray:
    """In how many texts each feature occurs, over all rows; at most 2 ** bits sums come to the driver."""

    def run(batches):
        total = np.zeros((1 << spec.bits) + 1, np.int64)
        for b in sliced(batches, 64):
            texts = b.column(0).to_pylist()
            if not texts:
                continue
            feats, starts, _ = grams(texts, spec)
            row = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(feats[0]))))
            seen = np.zeros((len(texts), (1 << spec.bits) + 1), bool)
            for f in feats:
                seen[row, f] = True
            total += seen.sum(axis=0)
        at = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["feature", "n"])

    sums = labelled.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << spec.bits)
    out[np.asarray(sums.column("feature"))] = np.asarray(sums.column("n"))
    return out


def counted(rows: DataFrame, spec: LangIdSpec) -> DataFrame:
    """label, key, part, features (distinct n-gram numbers) and shares (their share of the text's n-grams)."""

    def run(batches):
        for b in sliced(batches, 64):
            feats, shares = [], []
            for t in b.column(3).to_pylist():
                g, _, _ = grams([t], spec)
                u, n = np.unique(np.concatenate(g), return_counts=True)
                u, n = u[: len(u) - (u[-1] == 1 << spec.bits)], n[: len(u) - (u[-1] == 1 << spec.bits)]
                feats.append(u.astype(np.int32))
                shares.append((n / n.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(feats, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                ["label", "key", "part", "features", "shares"]
            )

    return rows.select("label", "key", "part", "text").mapInArrow(
        run, "label string, key long, part int, features array<int>, shares array<float>"
    )


def fit(
    docs: DataFrame, spec: LangIdSpec = LangIdSpec(), *, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang"
) -> LangModel:
    """Fit on the rows where ``learn`` holds (all by default) and the label and the text are not null.

    The sample's sparse counts, bounded by the spec and the number of languages, come to the driver. IDF is taken over
    all of these rows. The model depends on the rows alone, not on their order or partitions; of repeated rows one is
    learnt from. Without labelled rows the model knows no language.
    """
    labelled = labelled_rows(docs, F.lit(True) if learn is None else learn, id_col, text_col, lang_col)
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a language
    dim, empty = 1 << spec.bits, LangModel(spec, (), np.zeros(((1 << spec.bits) + 1, 0), np.float32), np.zeros(0), 1.0)
    if not sizes:
        return empty
    rows = counted(sample_rows(labelled, sizes, spec), spec).toPandas().sort_values(["label", "key"])
    languages = tuple(sorted(rows["label"].unique())) if len(rows) else ()
    k = len(languages)
    if not k:
        return empty
    index = {lang: i for i, lang in enumerate(languages)}
    x = [(np.asarray(f), np.asarray(s, np.float64)) for f, s in zip(rows["features"], rows["shares"], strict=True)]
    y = np.array([index[v] for v in rows["label"]])
    held = rows["part"].to_numpy() == 0
    idf = np.log((1 + sum(sizes.values())) / (1 + document_frequencies(labelled, spec))) + 1
    z, n = np.zeros((dim + 1, k)), np.zeros((dim + 1, k))

    def weights(f: np.ndarray) -> np.ndarray:
        zf = z[f]
        return np.where(np.abs(zf) <= spec.l1, 0.0, -(zf - np.sign(zf) * spec.l1) / ((spec.beta + np.sqrt(n[f])) / spec.alpha + spec.l2))

    rng = np.random.default_rng(spec.seed)
    learnt = np.flatnonzero(~held) if (~held).any() else np.arange(len(x))
    for _ in range(spec.epochs):
        for i in rng.permutation(learnt):
            f, s = x[i]
            f, v = np.append(f, dim), np.append(s * idf[f] * spec.scale, 1.0)  # the last feature is the intercept
            w = weights(f)
            p = softmax((v @ w)[None, :])[0]
            p[y[i]] -= 1
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / spec.alpha
            z[f] += g - sigma * w
            n[f] += g * g
    w = weights(np.arange(dim + 1))
    logits = np.array([w[dim] + (s * idf[f] * spec.scale) @ w[f] for f, s in x])
    check = held if held.any() else ~held
    table = np.append(w[:dim] * idf[:, None] * spec.scale, np.zeros((1, k)), axis=0).astype(np.float32)
    return LangModel(spec, languages, table, w[dim], calibrated(logits[check], y[check]))


def softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least smoothed negative log-likelihood on a geometric grid from 1/8 to 64.

    A share of 1 / (n + 2) of each label is spread over all languages: languages that the sample separates without
    an error would else be scored as certain everywhere.
    """
    best, share = (np.inf, 1.0), 1.0 / (len(y) + 2)
    for t in np.geomspace(0.125, 64, 91):
        log_p = np.log(np.maximum(softmax(logits / t), 1e-300))
        loss = -((1 - share) * log_p[np.arange(len(y)), y] + share * log_p.mean(axis=1)).mean()
        best = min(best, (float(loss), float(t)))
    return best[1]


def identify(
    docs: DataFrame, model: LangModel, *, text_col: str = "text", pred: str = "lang_pred", score_col: str = "lang_score"
) -> DataFrame:
    """``docs`` with ``pred``, the language, and ``score_col``, its calibrated probability (0 to 1).

    ``und`` with score 0 if the text is null or has no letter, or no language is known. Whole texts
    count; one row per input row, in place, all columns kept, but for those that have one of the two names, which are
    replaced. A text's result depends on it and the model alone.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in (pred.lower(), score_col.lower())])
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        tables = [np.ascontiguousarray(model.table[:, j]) for j in range(len(model.languages))]
        for b in sliced(batches, 256):
            if not b.num_rows:
                continue
            texts = [t or "" for t in b.column(at).to_pylist()]
            feats, starts, letters = grams(texts, model.spec)
            best, sure = np.full(len(texts), -1), np.zeros(len(texts))
            if tables:
                n = model.spec.order  # an n-gram for each place, but none for those that reach beyond the text
                total = np.diff(np.append(starts, len(feats[0]))) * n - n * (n - 1) // 2
                logits = np.stack(
                    [sum(np.add.reduceat(t[f], starts, dtype=np.float64) for f in feats) / total for t in tables], axis=1
                ) + model.bias
                p = softmax(logits / model.temperature)
                best, sure = np.where(letters > 0, p.argmax(axis=1), -1), np.where(letters > 0, p.max(axis=1), 0.0)
            langs = pa.array([UNDETERMINED if i < 0 else model.languages[i] for i in best], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, langs, pa.array(sure)], [*names, pred, score_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{pred}` string, `{score_col}` double")
