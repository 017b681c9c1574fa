"""A bank with planted structure, drawn in tasks: every number is a hash of the seed, the stream and its place, so a table of
any size is the same on any partitioning, and no part of it is ever on the driver.

Responses are a linear map of a compound's bits, plus noise; depths follow a Pareto law, so few compounds have most rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.operators.vectors import listed

U64 = np.uint64
# The smoke test's shapes.
COMPOUNDS, BITS, DESCRIPTORS, GENES, CELLS = 200, 512, 15, 978, 8
STREAMS = {"bits": 1, "map": 2, "depth": 3, "noise": 4, "spare": 5, "descriptors": 6, "cell": 7, "noise2": 8, "map2": 9}


def uniform(seed: int, stream: str, *at) -> np.ndarray:
    """Numbers above 0 and below 1 of places `at`, arrays that broadcast against each other."""
    x = np.asarray(U64(seed * 1000 + STREAMS[stream]))
    with np.errstate(over="ignore"):
        for a in at:
            x = (x ^ np.asarray(a).astype(U64)) * U64(0x9E3779B97F4A7C15) + U64(0x632BE59BD9B4E019)
            x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
            x = x ^ (x >> U64(31))
    return ((x >> U64(11)).astype(float) + 0.5) / 2**53


def normal(seed: int, stream: str, *at) -> np.ndarray:
    return np.sqrt(-2 * np.log(uniform(seed, stream, *at))) * np.cos(2 * np.pi * uniform(seed, {"map": "map2", "noise": "noise2"}.get(stream, "spare"), *at))


def bits_of(seed: int, pos: np.ndarray, bits: int, share: float = 0.1) -> np.ndarray:
    return (uniform(seed, "bits", pos[:, None], np.arange(bits)) < share).astype(float)


def depths(seed: int, pos: np.ndarray, most: int = 400) -> np.ndarray:
    pareto = uniform(seed, "depth", pos) ** (-1 / 1.2) - 1
    return np.clip((pareto * 4.8 + 1).astype(np.int64), 1, most)


def bank(spark: SparkSession, n: int = COMPOUNDS, bits: int = BITS, descriptors: int = DESCRIPTORS, seed: int = 0) -> DataFrame:
    """(pos, compound_id, smiles, moa, targets, features): bits, then descriptors."""

    def draw(batches):
        for b in batches:
            pos = np.asarray(b.column(0))
            x = np.concatenate((bits_of(seed, pos, bits), normal(seed, "descriptors", pos[:, None], np.arange(descriptors))), 1)
            text = lambda f: pa.array([f(int(p)) for p in pos], pa.string())
            yield pa.record_batch([b.column(0), text(lambda p: f"BRD{p:07d}"), text(lambda p: "C" * (1 + p % 50)), text(lambda p: f"moa{p % 20}"), pa.array([[f"GENE{int(p) % 40}"] for p in pos], pa.list_(pa.string())), listed(x)], names=["pos", "compound_id", "smiles", "moa", "targets", "features"])

    return spark.range(n).mapInArrow(draw, "pos long, compound_id string, smiles string, moa string, targets array<string>, features array<double>")


def signatures(spark: SparkSession, n: int = COMPOUNDS, bits: int = BITS, genes: int = GENES, seed: int = 0, noise: float = 0.35, most: int = 400) -> DataFrame:
    """(sig_id, pos, cell_index, log_dose, log_time, has_dose, vec) of the bank of the same seed."""

    def draw(batches):
        plan = normal(seed, "map", np.arange(bits)[:, None], np.arange(genes)) / np.sqrt(bits / 10)
        for b in batches:
            for p in np.asarray(b.column(0)):
                reps = np.arange(depths(seed, np.array([p]), most)[0])
                v = bits_of(seed, np.array([p]), bits) @ plan + noise * normal(seed, "noise", p, reps[:, None], np.arange(genes))
                cell = (uniform(seed, "cell", p, reps) * CELLS).astype(np.int64)
                same = lambda x, t: pa.array([x] * len(reps), t)  # noqa: B023, E731
                yield pa.record_batch([pa.array([f"S{p}:{r}" for r in reps]), pa.array(np.full(len(reps), p)), pa.array(cell), same(1.0, pa.float64()), same(1.38, pa.float64()), same(True, pa.bool_()), listed(v)], names=["sig_id", "pos", "cell_index", "log_dose", "log_time", "has_dose", "vec"])

    return spark.range(n).mapInArrow(draw, "sig_id string, pos long, cell_index long, log_dose double, log_time double, has_dose boolean, vec array<double>")
