"""The operators in place against those over flat frames, on texts of many kinds, and what they leave out: shuffles."""

import random

import pytest
from pyspark.sql import functions as F
from termforge.config import Config
from termforge.functions import arrow, classes
from termforge.operators import canonical, gates, inplace, lexicon, shape, tokenize, topical
from termforge.operators import vocabulary as V
from termforge.resources import Resources

CONFIG = Config(wordlist_size=40, acronym_wordlist_depth=10)
LISTED = "the of and to in is that for it was with on are as be this have from by at we read note order used column batch will sure program realize good well run value sample size y".replace(" ", "\n")
ODD = [
    "", " ", ".", "\n\n", "x", "a\x01b", "\x01\x01", "One.\x01Two\n\x01Three", "It is 5. 6 are. a b? C! \n d.\n\n5", "Mab SuRe LoRa WAn DS-1 PolyGrind TiMe Zed\nPolyGrind", "THE BATCH WAS HPLC NOW. ABC DEF on GHI",
    "ΑΣ Σ. ΑΣΑ. Öl-ÄRA straße ß İx ǅ áb ⅷ ² x² 𝒜𝒷 日本語 𐐀𐐨 don’t DON'T.", "Columns batches running programs realised sizes the’s THE y's ys", "a/b/c DS-2291/b2 v1.0.12 x--y -_- q_ 2024-03-11 ABCDEFGH A_B",
    "We read. The resin column is good: the resin columns of it. resin column; Resin Columns, resin colums " * 4, "\x1c a \x1f b\x1f. C", "e. ” F", "no end.\nsmall goes on\nLarge. 1",
]


@pytest.fixture(scope="module")
def resources(spark):
    return Resources.of(spark, CONFIG, wordlist=LISTED, lemmas="better good well\nran run\nwell well\n")


@pytest.fixture(scope="module")
def docs(spark, small):
    draw = random.Random(5)
    pool = "the resin Column of it. HPLC DS-12 PolyGrind TiMe note\n \n\n , (x) columns realised é Ö. 7 ABC; is: LoRa b".split(" ")
    made = [" ".join(draw.choice(pool) for _ in range(draw.randrange(120))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate([*ODD, *made], 10**6)), "doc_id bigint, text string")
    real = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).limit(60)
    return canonical.canonicalise(rows.unionByName(real)).select("doc_id", "canonical").persist()


@pytest.fixture(scope="module")
def flat(docs, resources):
    pieces = tokenize.with_clauses(tokenize.sentences(tokenize.placed(docs))).persist()
    return pieces, lexicon.with_lexicon(tokenize.tokens(pieces), resources).persist()


def bag(rows, *columns):
    """Rows in order, numbers to nine digits."""
    plain = lambda v: round(v, 9) if isinstance(v, float) else [tuple(x) for x in v] if isinstance(v, list) else v
    return sorted((tuple(plain(v) for v in r) for r in rows.select(*columns).collect()), key=repr)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_pieces_clauses_and_tokens(docs, flat):
    pieces, tokens = flat
    columns = ("doc_id", "sent", "piece", "start", "end", "kept", "clause", "line")
    assert bag(inplace.pieces(docs), *columns) == bag(pieces, *columns)
    columns = ("doc_id", "clause", "start", "end", "text")
    assert bag(inplace.clauses(docs), *columns) == bag(tokenize.clauses(pieces), *columns)
    columns = ("doc_id", "idx", "token", "lower", "start", "end", "line", "clause", "at")
    assert bag(inplace.tokens(docs), *columns) == bag(tokens, *columns)
    assert {r["token"] for r in inplace.words(docs).collect()} == {r["token"] for r in tokens.select("token").distinct().collect()}


def test_lexicon_and_capitals(docs, flat, resources):
    lists = V.Lists.of(resources)
    columns = ("doc_id", "idx", "lower", "is_common", "is_frequent", "is_stopword", "caps", "run", "acronym")
    got = inplace.tokens(docs, lists)
    assert bag(got, *columns) == bag(shape.with_acronyms(flat[1]), *columns)
    columns = ("doc_id", "idx", "token", "run", "acronym")
    assert bag(inplace.capitals(docs, lists), *columns) == bag(shape.with_acronyms(flat[1]).where("caps"), *columns)


def test_candidates(docs, flat, resources):
    lists = V.Lists.of(resources)
    columns = ("doc_id", "normalised", "surface", "kind", "frequency", "offsets", "score", *shape.FEATURES)
    got, want = inplace.candidates(docs, lists, CONFIG), shape.candidates(flat[1], CONFIG)
    assert bag(got, *columns) == bag(want, *columns) and got.where("normalised LIKE '% %'").count() > 3


def test_topical(docs, flat, resources):
    lists = V.Lists.of(resources)
    pieces, tokens = flat
    totals = pieces.where("kept").groupBy("doc_id").agg(F.count_distinct("clause").alias("total"))
    scores = topical.term_scores(topical.term_statistics(tokens), totals)
    columns = ("doc_id", "lower", "tf", "uppercase", "acronym", "n_clauses", "n_left", "n_right", "median_clause", "score")
    assert bag(inplace.statistics(docs, lists), *columns) == bag(scores, *columns)
    every = topical.phrases(tokens, scores, CONFIG)
    columns = ("doc_id", "normalised", "raw", "frequency", "first_start")
    assert bag(inplace.phrases(docs, lists, CONFIG), *columns) == bag(every.withColumn("first_start", F.col("offsets")[0]["start"]), *columns)
    got = inplace.deduplicated(docs, lists, CONFIG)
    want = topical.deduplicated(every, CONFIG)
    assert bag(got, "doc_id", "normalised", "raw") == bag(want, "doc_id", "normalised", "raw") and 0 < got.count() < every.where("raw <= 0.15").count()


def test_measures_and_language(docs, flat, resources):
    lists = V.Lists.of(resources)
    columns = ("doc_id", "tokens", "stopword_ratio", "mean_sentence_len", "table_line_ratio")
    pieces, tokens = flat
    got = inplace.measures(docs, lists)
    assert bag(got, *columns) == bag(gates.prose_measures(docs, tokens, tokenize.clauses(pieces)), *columns)
    assert bag(got, "doc_id", "language") == bag(gates.language(docs), "doc_id", "language")
    words = F.split(F.lower("canonical"), r"(?U)[^\p{IsAlphabetic}]+")
    heard_in = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    n = {r["doc_id"]: r.asDict() for r in docs.select("doc_id", F.length("canonical").alias("size"), *(heard_in(ws.split()).alias(c) for c, ws in gates.FUNCTION_WORDS.items())).collect()}
    for r in gates.language(docs).collect():
        size, by = n[r["doc_id"]]["size"], {c: n[r["doc_id"]][c] for c in sorted(gates.FUNCTION_WORDS)}
        best = max(by, key=by.get) if size >= gates.LEAST_CHARS and any(by.values()) else None
        assert (r["language"], r["confidence"]) == (best, by[best] / sum(by.values()) if best else 0.0)


def test_nothing_is_shuffled(spark, resources):
    """A token is never moved: every one of these plans reads the documents and writes its rows."""
    docs, lists = spark.createDataFrame([(1, "The DS-1 note.")], "doc_id bigint, canonical string"), V.Lists.of(resources)
    frames = [
        inplace.pieces(docs), inplace.clauses(docs), inplace.tokens(docs, lists), inplace.capitals(docs, lists), inplace.candidates(docs, lists, CONFIG), inplace.listed(docs, lists, CONFIG), inplace.listed(docs, lists, CONFIG, 3),
        inplace.statistics(docs, lists), inplace.phrases(docs, lists, CONFIG), inplace.deduplicated(docs, lists, CONFIG),
    ]
    assert all(shuffles(f) == 0 and f.collect() is not None for f in frames) and shuffles(tokenize.tokenised(docs)[1]) > 0


def test_classes_of_characters(spark):
    """The table is that of Spark's patterns, and lower case that of Spark, for every character."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and c != 0xFEFF]  # the last is taken for a byte order mark here
    tests = {"IsAlphabetic": classes.LETTER, "IsUppercase": classes.UPPER, "IsLowercase": classes.LOWER, "N": classes.NUMBER}
    sums = ", ".join(f"cast(c rlike '\\\\p{{{k}}}' AS int) * {v}" for k, v in tests.items()).replace(", ", " + ") + f" + cast(c rlike '(?U)\\\\s' AS int) * {classes.SPACE} + cast(c rlike '[0-9]' AS int) * {classes.DIGIT}"
    rows = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57343 AND id <> 65279").selectExpr("id", "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c").selectExpr("id", f"{sums} AS k", "lower(c) AS low").orderBy("id").toPandas()
    assert rows["id"].tolist() == points
    assert rows["k"].tolist() == classes.table()[points].tolist()
    assert rows["low"].tolist() == [classes.lowered(chr(c)) for c in points]


def test_distance_and_apart():
    draw = random.Random(3)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    texts = ["".join(draw.choice("abcé") for _ in range(draw.randrange(14))) for _ in range(150)]
    assert all(inplace.distance(a, b) == plain(a, b) for a in texts[:60] for b in texts[:60])
    kept = []
    for i, x in enumerate(texts):
        if not any(plain(texts[k], x) <= 0.2 * max(len(texts[k]), len(x)) + 1e-9 for k in kept):
            kept.append(i)
    assert inplace.apart(texts) == kept and len(kept) < 150


def test_slices_are_whole():
    import pyarrow as pa

    texts = ["a" * n for n in (0, 10, arrow.SLICE * 3, 5, arrow.SLICE - 5, 1, 0)] + [None]
    b = pa.RecordBatch.from_pydict({"doc_id": list(range(8)), "canonical": texts})
    parts = list(arrow.slices(b, "canonical"))
    assert [x for p in parts for x in p["doc_id"].to_pylist()] == list(range(8)) and len(parts) == 4


def test_known_words_are_bounded(monkeypatch):
    monkeypatch.setattr(V, "MOST", 3)
    lists = V.Lists(frozenset({"run"}), frozenset(), frozenset(), frozenset())
    for i in range(9):
        known = V.of_worker(lists)
        assert len(known) <= 4 and known[f"x{i}"][0] == f"x{i}" and known["running"][1] & V.COMMON
