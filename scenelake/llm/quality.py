"""Quality filtering by weak supervision, in DataFrame functions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import WORD_SPACE, cut, fresh, text_or_empty


@dataclass(frozen=True)
class QualitySpec:
    #: documents whose posterior probability of good quality is below this go
    least_posterior: float = 0.5
    #: base rule: too few words, too many words in repeated windows (per cent)
    least_words: int = 50
    most_repeat_percent: int = 50
    #: expectation-maximisation
    rounds: int = 50
    prior: float = 0.85
    #: the share of good documents may come out as low as this: a table may be mostly junk
    least_prior: float = 0.05
    #: start and bounds of P(vote good | good, voted) and P(vote bad | bad, voted). A bad document breaks few
    #: rules, so the second may be small; a good one breaks hardly any.
    good_accuracy: tuple[float, float, float] = (0.99, 0.9, 0.9995)
    bad_accuracy: tuple[float, float, float] = (0.3, 0.02, 0.99)
    #: a bad vote is at least so many times as likely on a bad document: no rule may turn round
    least_ratio: float = 3.0
    #: pseudo-votes that hold an accuracy to its starting value
    strength: float = 20.0


#: name, column expression of the statistic, sure-good bound, sure-bad bound. The vote is +1 (good) at or
#: below the first, -1 (bad) at or above the second and 0 (abstain) between.
RULES: tuple[tuple[str, str, float, float], ...] = (
    ("repeats", "n_repeat_words / greatest(n_words, 1)", 0.10, 0.40),
    ("lines", "n_dup_lines / greatest(n_lines, 1)", 0.20, 0.50),
    ("symbols", "n_symbols / greatest(word_chars, 1)", 0.02, 0.10),
    ("cells", "n_pipes / greatest(n_words, 1)", 0.02, 0.20),
    ("capitals", "n_upper / greatest(n_letters, 1)", 0.15, 0.50),
    ("letters", "1 - n_letters / greatest(word_chars, 1)", 0.15, 0.35),
    ("vocabulary", "1 - n_distinct_words / greatest(least(n_words, 400), 1)", 0.65, 0.90),
    ("shouts", "n_shouts / greatest(n_words, 1)", 0.02, 0.20),
)

#: words of a window in which distinct words are counted, as in the rule "vocabulary"
WINDOW = 400


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def others(docs: DataFrame, out: str) -> list[str]:
    """The columns of ``docs`` but for one named ``out``, in either case, which is replaced."""
    return [c for c in docs.columns if c.lower() != out.lower()]


def measure(docs: DataFrame, text_col: str = "text", *, out: str = "quality", room: int = 1 << 62) -> DataFrame:
    """``docs`` with a struct ``out`` of text statistics, all computed inside the row.

    n_repeat_words: windows of three words are hashed and packed with their position into sorted longs below ``room``;
    equal neighbours, confirmed on the words, mark repeated windows, whose union of positions is counted. Should two
    different windows of a text meet in a hash, its windows are sorted by their words instead. n_distinct_words: the mean
    over windows of 400 words that cover the whole text. A null text has no words. Input columns keep their names and
    values, but for one named ``out``, which is replaced.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in others(docs, out)])  # in one column, so that no name of theirs meets one below
    df = docs.select(row.alias("_row"), text_or_empty(text_col).alias("_t")).withColumn(
        "_w", F.filter(F.split("_t", WORD_SPACE, -1), lambda w: w != "")
    )
    n = F.size("_w")
    df = df.withColumn("_k", F.greatest(n - 2, F.lit(0)).cast("long"))
    # hash and position in one long: position < _k, hash reduced to what remains of the room
    packed = f"""if(_k > 0, transform(sequence(1L, _k), i -> pmod(xxhash64(_w[i - 1], _w[i], _w[i + 1]), greatest({room} div _k, 1L)) * _k + i - 1), cast(array() as array<bigint>))"""
    df = df.withColumn("_p", F.sort_array(F.expr(packed)))
    words = "_w[int(p % _k)] = _w[int(q % _k)] and _w[int(p % _k) + 1] = _w[int(q % _k) + 1] and _w[int(p % _k) + 2] = _w[int(q % _k) + 2]"
    pairs = "zip_with(slice(_p, 1, size(_p) - 1), slice(_p, 2, size(_p) - 1), (p, q) -> {})"
    # of two neighbours: 1 the same words, 0 other words, 2 other words of the same hash
    hashed = pairs.format(f"if(p div _k <> q div _k, 0, if({words}, 1, 2))")
    df = df.withColumn("_e", F.expr(f"if(_k > 1, {hashed}, cast(array() as array<int>))")).withColumn("_met", F.array_contains("_e", 2))
    by_words = "transform(sort_array(transform(sequence(1L, _k), i -> struct(_w[i - 1] as a, _w[i] as b, _w[i + 1] as c, i - 1 as at))), s -> s.at)"
    df = df.withColumn("_p", F.expr(f"if(_met, {by_words}, _p)"))
    df = df.withColumn("_e", F.expr(f"if(_met, {pairs.format(f'if({words}, 1, 0)')}, _e)"))
    df = df.withColumn(
        "_r",
        F.expr(
            "if(array_contains(_e, 1), sort_array(filter(transform(_p, (p, i) -> if((i > 0 and _e[i - 1] = 1) or (i < size(_e) and _e[i] = 1), p % _k, -1)), x -> x >= 0)), cast(array() as array<bigint>))"
        )
    )
    repeat = F.expr(
        "if(size(_r) = 0, 0L, 3L + aggregate(zip_with(slice(_r, 1, size(_r) - 1), slice(_r, 2, size(_r) - 1), (a, b) -> least(b - a, 3L)), 0L, (s, x) -> s + x))"
    )
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_l", lines)
    text = F.col("_t")
    # the last window ends with the text and may overlap the one before, so that all are full and every word is in one
    windows = f"if(size(_w) <= {WINDOW}, double(size(array_distinct(_w))), aggregate(sequence(1, size(_w), {WINDOW}), 0L, (s, i) -> s + size(array_distinct(slice(_w, least(i, size(_w) - {WINDOW - 1}), {WINDOW})))) / ceil(size(_w) / {WINDOW}))"
    word_chars = F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    stats = {
        "n_words": n.cast("long"),
        "word_chars": word_chars,
        "n_symbols": _without(text, "#*$%&|<>").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": repeat,
        "n_lines": F.size("_l"),
        "n_pipes": F.size(F.filter("_w", lambda w: w == "|")),
        "n_upper": F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", "")),
        "n_letters": F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", "")),
        # the share of distinct words falls with length by itself, so long texts are measured in windows of one length
        "n_distinct_words": F.expr(windows),
        "n_shouts": F.size(F.filter("_w", lambda w: w.endswith("!!"))),
    }
    return df.select("_row", F.struct(*[v.alias(k) for k, v in stats.items()]).alias("_stats")).select("_row.*", F.col("_stats").alias(out))


def votes(q: str = "quality") -> Column:
    """array<int> of the rules' votes on the statistics struct ``q``; a text without words gets bad votes only."""
    out = []
    for _, expr, good, bad in RULES:
        for name in (
            "n_repeat_words", "n_distinct_words", "n_dup_lines", "n_symbols", "n_letters", "word_chars", "n_words", "n_lines", "n_pipes",
            "n_upper", "n_shouts"
        ):
            expr = _qualify(expr, name, q)
        v = F.expr(expr)
        out.append(F.when(F.col(f"{q}.n_words") == 0, -1).when(v <= good, 1).when(v >= bad, -1).otherwise(0))
    return F.array(*out)


def _qualify(expr: str, name: str, q: str) -> str:
    import re

    return re.sub(rf"(?<![\w.]){name}\b", f"{q}.{name}", expr)


@dataclass(frozen=True)
class LabelModel:
    """Prior of good quality, and each rule's accuracy when it votes and the document is good or bad."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]


def fit(patterns: list[tuple[tuple[int, ...], int]], spec: QualitySpec = QualitySpec()) -> LabelModel:
    """Expectation-maximisation over counts of vote patterns; at most 3 ** rules patterns exist."""
    m = len(RULES)
    (g0, g_lo, g_hi), (b0, b_lo, b_hi) = spec.good_accuracy, spec.bad_accuracy
    model = LabelModel(spec.prior, (g0,) * m, (b0,) * m)
    for _ in range(spec.rounds):
        total = good_mass = 0.0
        hit_g, seen_g = [spec.strength * g0] * m, [spec.strength] * m
        hit_b, seen_b = [spec.strength * b0] * m, [spec.strength] * m
        for pattern, n in patterns:
            p = posterior(pattern, model)
            total += n
            good_mass += n * p
            for j, v in enumerate(pattern):
                if v:
                    seen_g[j] += n * p
                    seen_b[j] += n * (1 - p)
                    hit_g[j] += n * p * (v > 0)
                    hit_b[j] += n * (1 - p) * (v < 0)
        if not total:
            return model
        good = [min(g_hi, max(g_lo, h / s)) for h, s in zip(hit_g, seen_g, strict=True)]
        bad = [min(b_hi, max(b_lo, spec.least_ratio * (1 - g), h / s)) for h, s, g in zip(hit_b, seen_b, good, strict=True)]
        model = LabelModel(min(0.99, max(spec.least_prior, good_mass / total)), tuple(good), tuple(bad))
    return model


def posterior(pattern: tuple[int, ...], model: LabelModel) -> float:
    logit = math.log(model.prior / (1 - model.prior))
    for v, g, b in zip(pattern, model.good, model.bad, strict=True):
        if v > 0:
            logit += math.log(g / (1 - b))
        elif v < 0:
            logit += math.log((1 - g) / b)
    return 1 / (1 + math.exp(-logit))


def posterior_column(votes_col: str, model: LabelModel) -> Column:
    """The same posterior as a column over the vote array."""
    logit = F.lit(math.log(model.prior / (1 - model.prior)))
    for j, (g, b) in enumerate(zip(model.good, model.bad, strict=True)):
        v = F.col(votes_col)[j]
        logit = logit + F.when(v > 0, math.log(g / (1 - b))).when(v < 0, math.log((1 - g) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def judge(
    docs: DataFrame, spec: QualitySpec = QualitySpec(), *, text_col: str = "text", out: str = "quality", keep: tuple[str, ...] | None = None
) -> DataFrame:
    """``docs`` (of it, the columns ``keep``) with a struct ``out``: the statistics, base_failed, posterior and kept.

    Each text is measured once and materialised with its statistics. The counts of vote patterns over all
    documents (at most 3 ** 8 rows) come to the driver, where expectation-maximisation estimates the rules' accuracies
    without labels. One row per input row, repeated rows alike; an empty table gives none. A text without words fails the
    base rule. Input columns keep their names and values, but for one named ``out``, which is replaced.
    """
    names = others(docs, out) if keep is None else [c for c in keep if c.lower() != out.lower()]
    vote = fresh([*names, out], "_votes")
    columns = [F.col(f"`{c}`") for c in names]
    measured = cut(measure(docs, text_col, out=out).select(*columns, out, votes(out).alias(vote)))
    patterns = [(tuple(r[0]), r[1]) for r in measured.groupBy(vote).agg(F.count("*")).collect()]
    model = fit(sorted(patterns), spec)
    q = lambda c: F.col(f"{out}.{c}")
    failed = (q("n_words") < spec.least_words) | (100 * q("n_repeat_words") > spec.most_repeat_percent * q("n_words"))
    likely = posterior_column(vote, model)
    verdict = F.col(out).withField("base_failed", failed).withField("posterior", likely).withField(
        "kept", ~failed & (likely >= spec.least_posterior)
    )
    return measured.select(*columns, verdict.alias(out))


def digest(judged: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    return judged.select(F.col(id_col).alias("doc_id"), *[F.col(f"{quality_col}.{c}") for c in fields])
