"""Small documents with every awkward case, and plain-Python word splitting."""

import random
import re

WORDS = ["alpha", "Beta", "gamma,", "delta", "Épsilon", "zeta", "eta.", "theta", "iota1", "kappa", "λ", "mu", "nu", "xi", "o'mi"]

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def prose(rng, n):
    return " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 400) if rng.random() < 0.7 else ''}" for _ in range(n))


def texts():
    """(doc_id, text) pairs: copies, near copies, shared passages, short, long,
    empty and null texts, white space of all kinds, repeated rows and ids."""
    rng = random.Random(5)
    base, passage = prose(rng, 300), prose(rng, 90)
    near = base.split()
    near[150] = "changed"
    rows = [
        (1, base), (2, base), (7, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n \x0b "),
        (8, "one"), (9, "One"), (10, "two words"), (11, "a b c"), (12, "a b c d"), (13, "  no break \x1c x"),
        (14, prose(rng, 120) + "\n" + passage + "\n" + prose(rng, 40)), (15, passage), (16, prose(rng, 30) + "  " + passage.replace(" ", "\t", 5)),
        (17, prose(rng, 12_000)), (18, "x" * 60_000), (19, "same " * 400), (20, "same " * 400), (21, "\n".join(["line one here"] * 5)),
        (22, passage[:200] + " " + base), (2, base), (23, prose(rng, 49)), (None, base), (24, "日本語 テキスト 🙂 \U0001f468‍\U0001f469"),
    ]
    rows += [(30 + i, prose(rng, rng.randint(1, 200))) for i in range(40)]
    for i in range(25):  # a group of near copies
        w = base.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 999)}"
        rows.append((100 + i, " ".join(w)))
    return rows


def documents(spark, rows=None, extra=True):
    """A documents table with columns whose names clash with results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(texts() if rows is None else rows, "doc_id bigint, text string")
    df = df.withColumns({"lang": F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "fr"),
                         "source": F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string"))),
                         "n_chars": F.length("text").cast("bigint")})
    if extra:
        df = df.withColumns({c: F.lit("own") for c in ("n_words", "doc", "mark", "ids", "spans", "n", "node", "kept", "item", "label", "key")})
    return df.repartition(3)


def by_key(rows, *keys):
    """Rows as a sorted list of tuples, nulls last."""
    return sorted((tuple(r[k] for k in keys) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))
