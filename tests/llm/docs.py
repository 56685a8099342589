"""Small document tables with the awkward cases."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, spans string, kept boolean, length long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 1, []
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2147483648
        out.append(WORDS[x // 65536 % len(WORDS)] + ("x" if x // 1024 % 3 == 0 else ""))
        if i % 12 == 11:
            out[-1] += ".\n"
    return " ".join(out)


def table(spark, texts, langs=None, ids=None):
    """One row per text; the other columns clash with names that operators use, and are partly null."""
    ids = ids or list(range(len(texts)))
    rows = [(i, t, (langs[k] if langs else None), None, None, k, "x", None, -1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


AWKWARD = [None, "", " \n\t ", "one", "one", "Ünïcode wörds ☃ 𝒳 here", prose(1, 30), prose(1, 30), prose(2, 6000), "a" * 20000, "\n\n\nx\nx\n", "mixed <|endoftext|> text\r\n\x0b tail "]
