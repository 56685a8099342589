"""Secret scanning in DataFrame functions: base patterns and a battery of randomness tests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import text_or_empty

KINDS = ("assign", "access", "hex")
#: Pattern of each base kind, its checked group and that group's least length; fixed values.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Encodings in the order they are tried; fixed values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_CANDIDATE = r"[A-Za-z0-9+/_-]"
SPAN = "struct<kind:string,start:int,end:int>"


@dataclass(frozen=True)
class SecretSpec:
    #: least length of a candidate for the tests
    least: int = 20
    #: share of flagged candidates of a stratum that may be structured text
    fdr: float = 0.05
    #: combined p-values under this speak against randomness
    alpha: float = 0.01
    #: p-values over this are taken to come from random strings only (Storey's estimate)
    tail: float = 0.5
    #: upper ends of the length classes
    lengths: tuple[int, ...] = (23, 31, 39, 47, 63, 95, 191)
    bins: int = 100


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>, in code points.

    The gaps between matches come from a split by the same pattern, so both walk the text alike.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    # one more gap than matches: the last pair has no value
    steps = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), F.split(text, pattern, -1).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        lo = acc["at"] + F.length(x["gap"])
        hi = lo + F.length(x["value"])
        return F.when(x["value"].isNull(), acc).otherwise(
            F.struct(
                hi.alias("at"),
                F.array_append(acc["out"], F.struct(lo.alias("start"), hi.alias("end"), x["value"].alias("value"))).alias("out")
            )
        )

    return F.when(text.rlike(pattern), F.aggregate(steps, start, add, lambda a: a["out"])).otherwise(none)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds by start, then by kind in the listed order."""

    def part(rank: int, kind: str) -> Column:
        pattern, group, least = PATTERNS[kind]
        # hex and access match maximal runs, so asking for the least length in the pattern finds the same runs
        fast = {"hex": r"[0-9a-f]{24,}", "access": r"AKIA[A-Z0-9]{16,}"}.get(kind, pattern)
        kept = matches(text, fast)
        if group:
            kept = F.filter(kept, lambda m: F.length(F.regexp_extract(m["value"], pattern, group)) >= least)
        return F.transform(
            kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"))
        )

    return F.array_sort(F.concat(*(part(i, k) for i, k in enumerate(KINDS))))


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution (Abramowitz and Stegun 26.2.17, error under 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def battery(s: Column) -> Column:
    """Struct(encoding, n, p_uniform, p_runs, p_serial, p) of a string over one of the alphabets.

    p_uniform: chi-squared uniformity over the alphabet, upper tail by the Wilson-Hilferty cube root.
    p_runs: Wald-Wolfowitz runs above and below the alphabet's middle, two-sided. p_serial: lag-one
    serial correlation of the symbols, two-sided. p: Sidak's combination 1 - (1 - least) ** 3, close to
    uniform for symbols drawn uniformly at random, and near 0 for structured ones.
    The encoding is the smallest alphabet that holds every symbol; a null stays null.
    """
    names = list(ALPHABETS)
    alphabets = F.create_map(*[F.lit(x) for k in names for x in (k, ALPHABETS[k])])
    shifted = lambda a, f: F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), f)
    total = lambda a, zero: F.aggregate(a, F.lit(zero), lambda acc, v: acc + v)

    def counted(e: Column) -> Column:
        """e: encoding and alphabet. Symbols as places in the alphabet, and their squared counts."""
        x = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.position(c, e["alphabet"]).cast("double"))
        squares = F.aggregate(
            F.filter(F.split(e["alphabet"], ""), lambda c: c != ""), F.lit(0.0),
            lambda a, c: a + F.pow((F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double"), F.lit(2.0))
        )
        return F.struct(
            e["encoding"].alias("encoding"), F.length(s).cast("double").alias("n"), F.length(e["alphabet"]).cast("double").alias("size"),
            x.alias("x"), squares.alias("squares")
        )

    def summed(e: Column) -> Column:
        high = F.transform(e["x"], lambda v: F.when(v > e["size"] / 2, 1).otherwise(0))
        return F.struct(
            e["encoding"].alias("encoding"), e["n"].alias("n"), e["size"].alias("size"), e["x"].alias("x"), e["squares"].alias("squares"),
            high.alias("high"), (total(e["x"], 0.0) / e["n"]).alias("mu")
        )

    def scored(e: Column) -> Column:
        n, df = e["n"], e["size"] - 1
        chi2 = e["size"] / n * e["squares"] - n
        z_uniform = (F.pow(chi2 / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        moments = F.struct(
            total(e["high"], 0).cast("double").alias("n1"),
            (1 + total(shifted(e["high"], lambda a, b: F.when(a != b, 1).otherwise(0)), 0)).cast("double").alias("runs"),
            F.aggregate(e["x"], F.lit(0.0), lambda a, v: a + (v - e["mu"]) * (v - e["mu"])).alias("var"),
            total(shifted(e["x"], lambda a, b: (a - e["mu"]) * (b - e["mu"])), 0.0).alias("lag"),
        )

        def tested(m: Column) -> Column:
            mean_runs = 2 * m["n1"] * (n - m["n1"]) / n + 1
            var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
            z_runs = F.when(var_runs > 0, (m["runs"] - mean_runs) / F.sqrt(var_runs)).otherwise(F.sqrt(n))
            z_serial = F.when(m["var"] > 0, (m["lag"] / m["var"] + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
            return F.struct(
                normal_tail(z_uniform).alias("u"), (2 * normal_tail(F.abs(z_runs))).alias("r"),
                (2 * normal_tail(F.abs(z_serial))).alias("s")
            )

        return let(
            let(moments, tested),
            lambda p: F.struct(
                e["encoding"].alias("encoding"), n.cast("int").alias("n"), p["u"].alias("p_uniform"), p["r"].alias("p_runs"),
                p["s"].alias("p_serial"), (1 - F.pow(1 - F.least(F.lit(1.0), p["u"], p["r"], p["s"]), F.lit(3.0))).alias("p")
            )
        )

    encoding = F.coalesce(*[F.when(s.rlike(f"^[{ALPHABETS[k].replace('-', chr(92) + '-')}]+$"), F.lit(k)) for k in names])
    out = let(let(let(let(encoding, lambda k: F.struct(k.alias("encoding"), alphabets[k].alias("alphabet"))), counted), summed), scored)
    return F.when(encoding.isNotNull(), out)


def pieces(runs: Column, least: int) -> Column:
    """``runs`` with those that fit no alphabet, having '+' or '/' beside '-' or '_', cut at either kind of separator.

    Every maximal part of ``least`` or more over one of the two alphabets is a piece; pieces may overlap.
    """
    mixed = lambda m: m["value"].rlike("[+/]") & m["value"].rlike("[_-]")

    def part(m: Column, chars: str) -> Column:
        found = matches(m["value"], f"[A-Za-z0-9{chars}]{{{least},}}")
        return F.transform(
            found,
            lambda x: F.struct((m["start"] + x["start"]).alias("start"), (m["start"] + x["end"]).alias("end"), x["value"].alias("value"))
        )

    return F.flatten(F.transform(runs, lambda m: F.when(mixed(m), F.concat(part(m, "+/"), part(m, "_-"))).otherwise(F.array(m))))


def candidates(text: Column, spec: SecretSpec = SecretSpec()) -> Column:
    """Array of (start, end, encoding, length class, p) of the token-like runs of ``text``.

    A candidate is a maximal run of token characters of ``spec.least`` or more over one alphabet. Those without
    a digit or without a letter are mostly words and numbers: "plain" after their encoding gives them strata of
    their own, so they leave the cutoffs of the others alone.
    """
    runs = pieces(matches(text, f"{_CANDIDATE}{{{spec.least},}}"), spec.least)
    plain = lambda v: F.when(v.rlike("[0-9]") & v.rlike("[A-Za-z]"), "").otherwise(" plain")
    tested = F.transform(
        runs,
        lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), plain(m["value"]).alias("plain"), battery(m["value"]).alias("t")
        )
    )
    cls = lambda n: sum((F.when(n > e, 1).otherwise(0) for e in spec.lengths), F.lit(0))
    return F.transform(
        tested,
        lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.concat(m["t"]["encoding"], m["plain"]).alias("encoding"),
            cls(m["t"]["n"]).alias("cls"), m["t"]["p"].alias("p")
        )
    )


def cutoffs(tested: DataFrame, spec: SecretSpec = SecretSpec()) -> DataFrame:
    """(encoding, cls, cutoff): candidates (of a column _cand) of the stratum with p at or above the cutoff are random.

    Short strings can rarely be told from random ones, so the test is calibrated per encoding and length
    class over the whole table. A random string's p is uniform or larger, so those above ``tail`` tell how
    many random ones there are; what a stratum holds beyond that between cutoff and tail is structured. The
    cutoff is the least p-value bin, from alpha on, at which the structured share of all flagged ones
    is at most ``fdr``; none if even the last bin exceeds it. At most 2 x encodings x classes rows.
    """
    one = tested.select(F.explode("_cand").alias("c")).select(
        "c.encoding", "c.cls", F.least(F.floor(F.col("c.p") * spec.bins), F.lit(spec.bins - 1)).cast("int").alias("bin")
    )
    hist = one.groupBy("encoding", "cls", "bin").agg(F.count("*").alias("n"))
    tail_bin = int(spec.tail * spec.bins)
    first = max(1, int(spec.alpha * spec.bins))
    per = hist.groupBy("encoding", "cls").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"),
        F.sum(F.when(F.col("bin") >= tail_bin, F.col("n")).otherwise(0)).alias("above"),
    )
    level = F.col("above") / F.lit(float(spec.bins - tail_bin))
    at = lambda b: F.coalesce(F.col("h")[b], F.lit(0))

    def share(b: Column) -> Column:
        middle = F.when(b < tail_bin, F.aggregate(F.sequence(b, F.lit(tail_bin - 1)), F.lit(0.0), lambda a, i: a + at(i))).otherwise(0.0)
        flagged = middle + F.col("above")
        excess = F.greatest(middle - level * (tail_bin - b), F.lit(0.0))
        return F.when(flagged > 0, excess / flagged).otherwise(1.0)

    fits = F.filter(F.sequence(F.lit(first), F.lit(tail_bin)), lambda b: share(b) <= spec.fdr)
    return per.select(
        "encoding", "cls", (F.try_element_at(fits, F.lit(1)) / F.lit(float(spec.bins))).alias("cutoff")
    ).where(F.col("cutoff").isNotNull())


def scan(docs: DataFrame, spec: SecretSpec = SecretSpec(), *, text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """``docs`` with ``out``: array of (start, kind, end), base kinds and "random", by start.

    "random" spans are candidates that pass the calibrated randomness tests and lie in no base span.
    The calibration table (at most 112 rows) comes to the driver and goes out as a literal. One row per input row,
    repeated rows alike; a null or empty text has no span, an empty table no row. Input columns keep their names and
    values, but for one named ``out``, which is replaced.
    """
    text = text_or_empty(text_col)
    strata = cutoffs(docs.select(candidates(text, spec).alias("_cand")), spec).collect()
    cut = {f"{r['encoding']}:{r['cls']}": r["cutoff"] for r in sorted(strata)}
    table = F.create_map(*[F.lit(x) for kv in cut.items() for x in kv]).cast("map<string,double>")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()])  # no name of theirs meets one below
    tested = docs.select(row.alias("_row"), candidates(text, spec).alias("_cand"), base_spans(text).alias("_base"))
    free = lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    flagged = F.filter("_cand", lambda c: (c["p"] >= table[F.concat_ws(":", c["encoding"], c["cls"].cast("string"))]) & free(c))
    more = F.transform(
        flagged,
        lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("random").alias("kind"), c["end"].alias("end"))
    )
    spans = F.array_sort(F.concat(F.col("_base"), more))
    found = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return tested.select("_row", found.alias("_found")).select("_row.*", F.col("_found").alias(out))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlapping spans are replaced as one, by the first's kind."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out")
        )

    return F.when(
        F.size(spans) > 0, F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    ).otherwise(text)


def digest(found: DataFrame, id_col: str = "doc_id", spans_col: str = "secret_spans") -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans, all spans as text, and their number."""
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter(spans_col, lambda s: s["kind"].isin(*KINDS))
    count = lambda k: F.size(F.filter(spans_col, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select(
        F.col(id_col).alias("doc_id"), *counts, F.sha2(F.concat_ws(",", F.transform(base, label)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(F.col(spans_col), label)).alias("spans"), F.size(spans_col).cast("long").alias("n_spans")
    )
