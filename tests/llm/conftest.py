from __future__ import annotations

import zlib

import pytest
from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n: int, seed: int) -> str:
    """Deterministic words with a number of their own."""
    pick = lambda i, k: WORDS[zlib.crc32(f"{seed}/{i}/{k}".encode()) % 20]
    return " ".join(f"{pick(i, 0)}{pick(i, 1)}{(i * seed) % 17 if i % 23 == 5 else ''}" for i in range(n))


def documents() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows and ids, copies, markup of every operator."""
    base = prose(120, 3).split()
    near = list(base)
    near[40:42] = ["changed", "words"]
    rows = [
        (1, prose(80, 1)), (2, None), (3, ""), (4, "   \n\t "), (5, " ".join(base)), (6, " ".join(near)), (7, " ".join(base)), (7, " ".join(base)), (8, "don't we'll 'tis x's  two  spaces \n\n end "),
        (9, prose(30_000, 9)), (10, "x" * 50_000), (11, "1 " * 3000), (12, "é漢字 😀 naïve ÀÉÎ " * 20), (None, prose(60, 12)), (None, None),
        (13, "mail a.b@c.example.com and 4111 1111 1111 1111 or +1 (212) 555-0100 at 10.0.0.256 and 10.0.0.25."),
        (14, prose(50, 14) + "\nAll rights are reserved here.\n" + prose(20, 15)),
    ]
    rows += [(20 + i, f"{prose(40, 20 + i)}\nAll rights are reserved here.\nRead 17{i} times since 20{i:02d} by us\n{prose(10, 40 + i)}") for i in range(6)]
    rows += [(15, "a <|endoftext|> b<|startoftext|>c ~ d~e <|ENDOFTEXT|> <|endoftext|><|endoftext|>")]
    rows += [(100 + i, f'{prose(30, 60 + i)} token = "{i}f3a9c{i}77be02d{i}41" {prose(5, i)}') for i in range(8)]
    rows += [(200 + i, prose(60, 80 + i) + (" you are such a blorkhead and blorkish " if i % 3 == 0 else f" fine u{i}@c.example.com ")) for i in range(90)]
    return rows


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in ("node", "digest", "score", "ids", "file", "k", "label", "__lines", "base", "of", "url", "__lines_read", "lines_read", "Lines_Dropped", "__keep", "keep", "row", "__node", "__spans", "spans", "address", "keepers", "a.b")],
])


def full(rows: list[tuple]) -> list[tuple]:
    return [(i, t, None if i == 5 else "en", None if i == 6 else "src", None if t is None else len(t), *["clash"] * 23) for i, t in rows]


def write_tables(spark, path: str, docs: list[tuple]) -> str:
    spark.createDataFrame(full(docs), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int("blork" in (t or ""))) for i, t in docs if i is not None and i >= 200] + ([(200, 1, 1), (None, 0, 1), (201, None, None)] if docs else [])
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(i, f"http://h/{i}", t) for i, t in docs] + ([(301, None, "p" * 100), (302, "http://a\r\nb", "p" * 100), (300, "u", "p" * 100), (300, "u", "p" * 100), (305, "u", "q" * 99), (304, "u", "q" * 99), (2**63 - 1, "u", "r" * 100), (2**63 - 1, "u", "p" * 100), (-5, "u", "r" * 100)] if docs else [])
    spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, payload string, digest string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    return write_tables(spark, str(tmp_path_factory.mktemp("tables")), documents())


@pytest.fixture(scope="session")
def no_rows(spark, tmp_path_factory):
    return write_tables(spark, str(tmp_path_factory.mktemp("empty")), [])
