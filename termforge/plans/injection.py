"""Documents with planted terms at known places, from a seed: the means to measure an extraction without judging it by hand."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.config import Config
from termforge.operators import analysis, shape

#: Carriers by register; {ID} takes a plant, {DIS} something that should be left alone, {ACR} an acronym.
CARRIERS = {
    "invoice": "Invoice for the order {ID} of last month.\nPlease pay for {ID} and for {ID} by {DIS}. The goods under {ID} were sent with {ID}.\nIf you have a question about {ID} then call {DIS}. It is the {ACR} that you asked for.",
    "ticket": "The fault {ID} was seen again. It is like {ID} and may come from {ID}.\nWe found it on {DIS} when the part {ID} was put in. See {ID} and write to {DIS}. The {ACR} was told.",
    "lab": "We took the sample {ID} on {DIS} and put it with {ID} and {ID}. The value of {ID} was low.\nAfter that we used {ID} and then {ID} again. The {ACR} was on. All of it is under {ID} and {DIS}.",
    "minutes": "All were there. The {ACR} has said that {ID} is done and {ID} is not.\nOn {DIS} we will look at {ID} again. Then {ID} can go. The next time is {DIS}.",
}
ACRONYMS = ("HPLC", "GMP", "PCR", "ELISA", "SLA", "KPI", "RFQ", "MRI", "LIMS", "QMS")
SCHEMA = "doc_id bigint, register string, text string, plants array<struct<surface: string, start: bigint, end: bigint, scheme: string, is_distractor: boolean>>"


class Stream:
    """Random numbers from a hash of seed and domain; the same on every machine."""

    def __init__(self, seed: int, domain: str) -> None:
        self.key, self.at, self.pool = f"{seed}:{domain}".encode(), 0, b""

    def below(self, n: int) -> int:
        """Uniform from 0 to n - 1, without bias: values beyond the last whole multiple of n are drawn again."""
        most = (1 << 32) // n * n
        while True:
            if len(self.pool) < self.at + 4:
                self.pool = hashlib.shake_256(self.key).digest(2 * len(self.pool) + 4096)
            x = int.from_bytes(self.pool[self.at : self.at + 4], "little")
            self.at += 4
            if x < most:
                return x % n

    def shuffled(self, items: Sequence) -> list:
        out = list(items)
        for i in range(len(out) - 1, 0, -1):
            j = self.below(i + 1)
            out[i], out[j] = out[j], out[i]
        return out


def filled(carrier: str, plants: Sequence[tuple[str, str]], distractors: Sequence[tuple[str, str]], stream: Stream) -> tuple[str, list[tuple]]:
    """The text, and (surface, start, end, scheme, is_distractor) of what was put in, in bytes."""
    out, spans, size = [], [], 0
    rest = carrier
    while (at := rest.find("{")) >= 0:
        close = rest.index("}", at)
        out.append(rest[:at])
        size += len(rest[:at].encode())
        slot, rest = rest[at + 1 : close], rest[close + 1 :]
        pool = {"ID": plants, "DIS": distractors, "ACR": [(a, "acronym") for a in ACRONYMS]}[slot]
        surface, scheme = pool[stream.below(len(pool))]
        n = len(surface.encode())
        spans.append((surface, size, size + n, scheme, slot == "DIS"))
        out.append(surface)
        size += n
    return "".join([*out, rest]), spans


def corpus(spark: SparkSession, seed: int, n: int, plants: Sequence[tuple[str, str]], distractors: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """n documents (doc_id, register, text) and their plants (doc_id, register, surface, start, end, scheme, is_distractor). Carriers take turns."""
    rows = []
    for i in range(n):
        register = list(CARRIERS)[i % len(CARRIERS)]
        text, spans = filled(CARRIERS[register], plants, distractors, Stream(seed, f"document {i}"))
        rows.append((i, register, text, spans))
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.drop("plants"), frame.select("doc_id", "register", F.explode("plants").alias("p")).select("doc_id", "register", "p.*")


def report(plants: DataFrame, candidates: DataFrame, grid: DataFrame, tokens: int) -> DataFrame:
    """A row a grid point (point, identifier, technical): recall by tier and false emissions per 1,000 tokens."""
    emitted = analysis.emissions(candidates, grid)
    found = analysis.recalled(plants, emitted)
    wrong = analysis.false_emissions(plants, emitted)
    return analysis.rates(found, wrong, tokens)


def sweep(tokens_of, plants: DataFrame, sizes: Sequence[int], thresholds: Sequence[float], config: Config, total: int, column: str = "HardReachable") -> DataFrame:
    """A row a list size, a column a technical threshold. tokens_of(size) gives tokens with lexicon flags for that size."""
    out = None
    for size in sizes:
        scored = shape.candidates(tokens_of(size), config)
        grid = scored.sparkSession.createDataFrame([(i, config.thresholds.identifier, float(t)) for i, t in enumerate(thresholds)], "point bigint, identifier double, technical double")
        row = report(plants, scored, grid, total).select(F.lit(size).alias("wordlist_size"), "point", column)
        out = row if out is None else out.unionByName(row)
    return out.groupBy("wordlist_size").pivot("point", list(range(len(thresholds)))).agg(F.first(column)).toDF("wordlist_size", *(f"t{t:g}" for t in thresholds))
