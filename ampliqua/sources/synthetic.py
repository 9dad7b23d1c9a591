"""Seeded amplicon reads with known truth, for tests and demonstrations."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

BASES = "ACGT"


def control_sequence(length: int = 600, seed: int = 1) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(BASES) for _ in range(length))


def substituted(sequence: str, at: int) -> str:
    return sequence[:at] + BASES[(BASES.index(sequence[at]) + 1) % 4] + sequence[at + 1 :]


def deleted(sequence: str, start: int, size: int) -> str:
    return sequence[:start] + sequence[start + size :]


def inserted(sequence: str, at: int, extra: str) -> str:
    return sequence[:at] + extra + sequence[at:]


def read_of(sequence: str, rng: random.Random, error: float) -> str:
    out = []
    for b in sequence:
        x = rng.random()
        if x < error / 3:
            continue
        out.append(rng.choice(BASES) if x < 2 * error / 3 else b)
        if x > 1 - error / 3:
            out.append(rng.choice(BASES))
    return "".join(out)


def reads(spark: SparkSession, mixture: list[tuple[str, float]], n: int, seed: int = 1, error: float = 0.01) -> DataFrame:
    """READS of sequences by share, half of them from the other strand."""
    rng, rows = random.Random(seed), []
    turn = str.maketrans("ACGT", "TGCA")
    for k in range(n):
        seq = read_of(rng.choices([s for s, _ in mixture], [w for _, w in mixture])[0], rng, error)
        seq = seq[::-1].translate(turn) if k % 2 else seq
        rows.append((k, f"@read{k} run=1", f"read{k}", seq, "I" * len(seq)))
    return spark.createDataFrame(rows, "read_ord long, identifier string, qname string, sequence string, quality string")
