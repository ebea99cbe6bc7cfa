"""Word lists: ranked words, stopwords, and lemmas of irregular forms; bounded, digested, replaceable."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.config import Config


def entries(text: str) -> list[str]:
    """Words of a list file in order: lines starting with # are left out."""
    return [w.lower() for line in text.splitlines() if not line.lstrip().startswith("#") for w in line.split()]


def lemma_entries(text: str) -> list[tuple[str, str]]:
    """(inflected, lemma) of lines `inflected lemma ...`; a form that is its own lemma, or comes twice, counts once."""
    out: dict[tuple[str, str], None] = {}
    for line in text.splitlines():
        fields = line.lower().split()
        if fields and not fields[0].startswith("#"):
            out |= {(fields[0], lemma): None for lemma in fields[1:] if lemma != fields[0]}
    return list(out)


def bundled(name: str) -> str:
    return (files("termforge") / "data" / name).read_text("utf-8")


@dataclass
class Resources:
    """Lists for one configuration. words: (word, rank) below the larger of both depths; it is broadcast."""

    words: DataFrame
    stopwords: DataFrame
    lemmas: DataFrame
    config: Config
    digests: tuple[str, ...]
    total: int

    @classmethod
    def of(cls, spark: SparkSession, config: Config, wordlist: str | None = None, stopwords: str | None = None, lemmas: str | None = None) -> Resources:
        """From the texts of list files; the bundled short lists stand in for those not given."""
        texts = (wordlist or bundled("wordlist.txt"), stopwords or bundled("stopwords.txt"), lemmas or bundled("lemmas.txt"))
        words = list(dict.fromkeys(entries(texts[0])))
        depth = max(config.wordlist_size, config.acronym_wordlist_depth)
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        return cls(
            frame([(w, i) for i, w in enumerate(words[:depth])], "word string, rank int"),
            frame([(w,) for w in sorted(set(entries(texts[1])))], "word string"),
            frame(lemma_entries(texts[2]), "inflected string, lemma string"),
            config,
            tuple(hashlib.sha256(t.encode()).hexdigest() for t in texts),
            len(words),
        )

    @classmethod
    def from_files(cls, spark: SparkSession, config: Config, **paths: str) -> Resources:
        """As `of`, from paths that Spark can read (wordlist, stopwords, lemmas); a missing file is an error."""
        read = lambda p: "\n".join(r[0] for r in spark.read.text(p, wholetext=True).collect())
        return cls.of(spark, config, **{k: read(p) for k, p in paths.items()})

    @property
    def extent(self) -> tuple[int, int]:
        """Ranks in use, and in the list."""
        return min(self.config.wordlist_size, self.total), self.total

    def common(self) -> DataFrame:
        return self.words.where(F.col("rank") < self.config.wordlist_size).select("word")

    def frequent(self) -> DataFrame:
        return self.words.where(F.col("rank") < self.config.acronym_wordlist_depth).select("word")
