"""Small tables with the awkward cases that every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(n: int = 40, seed: int = 3) -> list[tuple]:
    """Documents with copies, near copies, shared lines, nulls, empty, short and long texts, repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéüñlmnorst") for _ in range(rng.randint(2, 8))) for _ in range(120)]

    def line(k: int) -> str:
        return " ".join(rng.choice(vocabulary) for _ in range(k)) + "."

    common = line(9)
    base = "\n".join(line(30) for _ in range(4))
    out: list[tuple] = []
    for i in range(n):
        kind = i % 8
        if kind == 0:
            text = base
        elif kind == 1:
            words = base.split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 2:
            text = common + "\n" + line(25)
        elif kind == 3:
            text = line(12) + "\n" + common
        else:
            text = "\n".join(line(rng.randint(1, 30)) for _ in range(rng.randint(1, 6)))
        out.append((i, text, "en", f"src{i % 3}", len(text)))
    out += [
        (n, None, None, None, None),
        (n + 1, "", "en", "src0", 0),
        (n + 2, " \n\t ", "en", "src0", 4),
        (n + 3, "One", "en", "src0", 3),
        (n + 4, "ONE", "en", "src0", 3),
        (n + 5, "x" * 70_000 + " y" * 3000, "en", "src0", 76_000),
        (n + 6, "a b   c \U0001f600 d́", "xx", "src0", 12),
        (None, base, "en", None, len(base)),
        out[0],
    ]
    return out


def frame(spark, data=None, parts: int = 3):
    return spark.createDataFrame(rows() if data is None else data, DOCS).repartition(parts)


def save(df, folder, name: str) -> str:
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
