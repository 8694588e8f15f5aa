"""Small document tables with the awkward cases."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),  # columns whose names clash with those used inside
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("doc_key", T.IntegerType()),
        T.StructField("h", T.StringType()),
        T.StructField("pos", T.StringType()),
        T.StructField("part", T.StringType()),
    ]
)


def awkward(seed: int = 7) -> list[tuple[int | None, str | None]]:
    """Nulls, empty and long texts, repeats within and across documents, ties, repeated rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, line = words(70), " ".join(words(8))
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, "   \n\t "), (4, "One"), (5, "one two"), (6, "\n"), (None, " ".join(words(60)))]
    for i in range(10, 40):
        body = words(r.randint(5, 90))
        if i % 3 == 0:
            body += passage[: r.randint(30, 70)] + words(r.randint(0, 9))
        rows.append((i, " ".join(body) + ("\n" + (line.upper() if i % 2 else f"  {line}\t") + "\nend" if i % 4 == 0 else "")))
    rows += [(50, rows[12][1]), (51, rows[12][1]), (51, rows[12][1]), (52, " ".join(words(30) * 4)), (53, "x y " * 300), (54, " ".join(words(6000)))]
    rows += [(55, "<|endoftext|> é́ A B İ " + " ".join(passage)), (56, "longword" * 900), (57, "a\n" * 50), (57, "two texts of one id"), (58, f"{line}\n{line}\n{line}")]
    near = words(60)
    for i in range(60, 75):
        some = list(near)
        some[i - 60] = "changed"
        rows.append((i, " ".join(some)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([("k", d, t, "en", f"src{(d or 0) % 3}", len(t or ""), 1, "h", "p", "q") for d, t in rows], SCHEMA)


def of(df, *names):
    return [tuple(r[n] for n in names) for r in df.select(*names).collect()]
