"""Small document tables with every odd case, and plain re-computations."""

import random

from pyspark.sql import functions as F

WORDS = "the of and river stone light house green quiet morning table window letter garden market silver winter summer engine paper".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed"]) for _ in range(n))


def documents(spark, rows, extra=True):
    """rows: (doc_id, text) or (doc_id, text, lang, source); with columns whose names could clash."""
    full = [r if len(r) == 4 else (r[0], r[1], "en", f"src{(r[0] or 0) % 3}") for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
    if extra:
        for name in ("row", "key", "h", "fp", "n", "queue", "label", "score", "start", "bucket", "spans", "window_id", "entity", "node", "leaf", "__score", "__row", "__spans", "__terms", "Row_", "piece", "digest", "root", "odd `name`", "dotted.name"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def odd_rows(seed=1):
    """Nulls, empties, ties, repeated rows, very long and odd texts among prose."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100, base[3]), (101, base[3]), (102, base[4] + " extra"), (103, None), (104, ""), (105, " \n\t "), (106, "é ß 日本語 😀 " * 5), (None, base[5]), (None, None), (107, "word"), (107, "word")]
    rows += [(108, prose(rng, 6000)), (109, "a" * 3000), (110, base[6] + "\n" + base[7] + "\n" + base[8]), (111, base[9].upper()), (112, "x\x00y \x1c z  w")]
    return rows
