"""Plain helpers for the tests of this folder."""

import random


def plain_rows(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def words(rng: random.Random, n: int, vocabulary: str = "abcdefg") -> str:
    return " ".join("".join(rng.choices(vocabulary, k=rng.randint(1, 4))) for _ in range(n))
