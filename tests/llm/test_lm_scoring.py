import math
import zlib
from collections import Counter

import numpy as np
import pytest
from termforge.llm import lm_scoring as M


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [*filter(None, low.split(" ")), None]


def expected(rows):
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter(t for d, text in rows if not held(d) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return {d: (held(d), len(t := tokens(text)), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) for d, text in rows}


def compare(found, rows):
    want = expected(rows)
    assert {r["doc_id"] for r in found} == set(want) and len(found) == len(rows)
    for r in found:
        held, n, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert abs(r["base_score"] - base) <= 1e-6 * max(1, abs(base))
        assert math.isfinite(r["score"]) and r["score"] < 0 and r["bits_per_byte"] > 0


def test_whole_table_against_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = M.op5_lm_scoring(spark, small).collect()
    compare(found, rows)
    held = [r for r in found if r["held_out"]]
    # the base gives every unknown word the same and so sums to more than one; a spelled word costs what it must
    assert sum(r["score"] for r in held) > 1.15 * sum(r["base_score"] for r in held)
    assert sum(r["bits_per_byte"] for r in held) / len(held) < 2.6


def taught(texts):
    zeros, ones = M.decisions(M.counted(texts))
    mixer = M.Mixer(zeros, ones)
    mixer.learn(texts, zeros, ones)
    return mixer


def asked(mixer, found):
    """log10 of each (word before, word)."""
    vocabulary = M.Vocabulary()
    at = [vocabulary.at(list(x)) for x in found]
    keys = np.array([a * len(vocabulary.number) + b for a, b in at])
    vocabulary.close()
    return mixer.log10(vocabulary, keys)


def test_probabilities_of_bytes_sum_to_one():
    """The eight bits of a byte are a distribution over all bytes, whatever was learned."""
    mixer = taught([[b"alpha", b"beta", b"alphabet", b"gamma", b"alps"]] * 5)
    total, best = 0.0, (0.0, None)
    for i in range(256):
        raw = np.frombuffer(b"beta al" + bytes([i]) + b" ", np.uint8)
        units = M.Units(raw, np.array([4]), np.array([7], np.uint32))
        p = math.exp(mixer.logs(units)[2])
        total, best = total + p, max(best, (p, bytes([i])))
    assert abs(total - 1) < 1e-5 and best[1] == b"p"


def test_logs_against_a_loop():
    """Every bit by itself: odds of its slots, weights by what their groups have seen, the adaptive table, the mean."""
    mixer = taught([[b"alpha", b"beta", b"alphabet", b"gamma", b"alps"]] * 5)
    units = M.Units(np.frombuffer(b"beta alpx  gam ", np.uint8)[:10], np.array([5]), np.array([7], np.uint32))
    found = mixer.logs(units)
    for i in range(len(found)):
        want = 0.0
        for k, node, bit, groups in units.bits():
            seen = [int(mixer.seen[groups[c][i] >> 4]) for c in M.GATES]
            gate = k // 4 + sum(x << (1 + 2 * n) for n, x in enumerate(seen))
            mixed = sum(float(mixer.weights[c, gate]) * int(mixer.odds[g[i] + node[i]]) for c, g in enumerate(groups))
            whole = (1 << k) | (int(units.bytes[i]) >> (8 - k))
            at = (min(max(mixed, -7.999), 7.999) + 8) * (M._BINS - 1) / 16
            low = int(at)
            a, b = mixer.apm[whole * M._BINS + low], mixer.apm[whole * M._BINS + low + 1]
            final = (mixed + a + (b - a) * (at - low)) / 2
            want -= math.log1p(math.exp(-final if bit[i] else final))
        assert abs(found[i] - want) < 8 / M._FINE  # levels of the mixed log-odds


def test_contexts_run_across_words():
    """The word before counts, so a text in another order has another score."""
    texts = [[b"north", b"wind"], [b"south", b"sea"]] * 30
    mixer = taught(texts)
    likely, other = asked(mixer, [(b"north", b"wind"), (b"south", b"wind")])
    assert likely > other + 0.3


def test_counts_and_contexts_against_a_loop():
    """Equal contexts share their slots, and every decision's zeros and ones are those of a loop over the bits."""
    text = [b"ab", b"abc", b"", b"ab", b"q" * 70_000, b"\xff\x00", b"ab"]
    text = [w for w in text if w]
    leaves = M.counted([text, text[:3], []])
    zeros, ones = M.decisions(leaves)
    want = Counter()
    running = [(p, w) for t in (text, text[:3]) for p, w in zip([M.END, *t], t)]
    for p, w in running:
        line = (b" " * M.HEAD + p)[1 - M.HEAD :] + b" " + w + b" "
        for i in range(M.HEAD, len(line)):
            for c, context in enumerate([line[i - 1 : i], line[i - 2 : i], line[i - 3 : i], line[i - 5 : i], line[M.HEAD : i], (p, line[M.HEAD : i])]):
                if len(w) > 1000 and c > 3:
                    continue
                want[c, context, line[i] >> 4] += 1
    vocabulary = M.Vocabulary()
    keys = vocabulary.pairs(vocabulary.at(text), np.array([len(text)]))
    vocabulary.close()
    groups_of = {}
    for a, b, units in vocabulary.units(keys):
        before, at = np.divmod(keys[a:b], len(vocabulary.number))
        for n, (x, y) in enumerate(zip(before, at)):
            p, w = vocabulary.found[x], vocabulary.found[y]
            if len(w) > 1000:
                continue
            line = (b" " * M.HEAD + p)[1 - M.HEAD :] + b" " + w + b" "
            for i in range(M.HEAD, len(line)):
                j = units.starts[n] + i - M.HEAD
                assert units.bytes[j] == line[i]
                for c, context in enumerate([line[i - 1 : i], line[i - 2 : i], line[i - 3 : i], line[i - 5 : i], line[M.HEAD : i], (p, line[M.HEAD : i])]):
                    g = int(units.groups[0][c][j])
                    assert groups_of.setdefault((c, context), g) == g
                    if c != 3 and c != 5 and (c != 4 or len(w) < 1000):
                        assert leaves[g + (line[i] >> 4)] >= want[c, context, line[i] >> 4]
    assert len(set(groups_of.values())) > 0.9 * len(groups_of)
    n = sum(len(w) + 1 for _, w in running)
    assert leaves.sum() == 2 * M.CONTEXTS * n
    assert (zeros + ones).sum() == 8 * M.CONTEXTS * n
    for v in range(1, 16):
        j = v.bit_length() - 1
        low = (v - (1 << j)) << (4 - j)
        rows = leaves.reshape(-1, 16)
        assert (zeros.reshape(-1, 16)[:, v] == rows[:, low : low + (8 >> j)].sum(1)).all()
        assert (ones.reshape(-1, 16)[:, v] == rows[:, low + (8 >> j) : low + (16 >> j)].sum(1)).all()


def test_scores_don_t_depend_on_how_units_are_cut():
    rng = np.random.default_rng(8)
    words = [bytes(rng.integers(97, 105, rng.integers(1, 9)).tolist()) for _ in range(60)]
    texts = [[words[i] for i in rng.integers(0, 60, 40)] for _ in range(20)]
    mixer = taught(texts)
    found = [(a, b) for t in texts for a, b in zip(t, t[1:])]
    together = asked(mixer, found)
    assert np.allclose(together, [asked(mixer, [x])[0] for x in found], rtol=1e-5)


def test_seen_before_against_a_loop():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 40, 60)
    at = rng.integers(0, 9, sizes.sum())
    want, i = [], 0
    for n in sizes:
        seen = Counter()
        for w in at[i : i + n].tolist():
            want.append(seen[w])
            seen[w] += 1
        i += n
    assert M.seen_before(at, sizes).tolist() == want
    assert M.seen_before(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_learning_lowers_the_bits(monkeypatch):
    monkeypatch.setattr(M, "_RATE", 0.002)
    texts = [[f"pre{i % 7}fix{i % 5}".encode() for i in range(k, k + 200)] for k in range(0, 4000, 200)]
    zeros, ones = M.decisions(M.counted(texts))
    mixer = M.Mixer(zeros, ones)
    first, then = mixer.learn(texts[:5], zeros, ones), mixer.learn(texts[15:], zeros, ones)
    assert then < first


def test_base_of_hand_made_rows(spark):
    rows = [(1, "A b\tB"), (2, None), (3, ""), (4, "c\x0bd é É"), (5, "b " * 200_000), (26, "zzz b"), (30, "x")]
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) or True
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS score", "'h' AS held_out", "2 AS block", "3 AS h")
    compare(M.score(docs).collect(), rows)


def test_repeats_null_ids_and_empty(spark):
    found = M.score(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in found) == [(0, 2), (1, 3), (1, 3)]
    assert M.score(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


@pytest.mark.parametrize("found", [[], [b"a"], [M.END]])
def test_counts_have_two_outcomes_a_byte(found):
    assert M.counted([found]).sum() == sum(2 * M.CONTEXTS * (len(w) + 1) for w in found)


def test_slots_count_all_tokens_however_texts_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(M, "_MOST_COUNTED", 3)
    rows = [(i, f"a b{i % 5} c{i % 3} a") for i in range(40)] + [(50, None)]
    docs = M._split(spark.createDataFrame(rows, "doc_id bigint, text string"), 0, 10).na.fill({"text": ""})
    texts = [[*M.words(text or ""), M.END] for i, text in rows if zlib.crc32(str(i).encode()) % 10]
    for n in (1, 7):
        assert (M.slot_counts(docs.repartition(n)) == M.counted(texts)).all()


def test_scores_don_t_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(150).cache()
    one, many = ({r["doc_id"]: r["score"] for r in M.score(x).collect()} for x in (docs.coalesce(1), docs.repartition(8)))
    assert one.keys() == many.keys() and all(abs(one[d] - many[d]) <= 1e-6 * abs(one[d]) for d in one)


def test_order_of_words_counts(spark):
    docs = spark.createDataFrame([(i, "north wind south sea " * 5) for i in range(1, 40)] + [(100, "north wind south sea"), (101, "sea north wind south"), (102, "wind sea north south")], "doc_id bigint, text string")
    found = {r["doc_id"]: r["score"] for r in M.score(docs).where("doc_id >= 100").collect()}
    assert found[100] > found[102]


def test_learning_sums_all_training_tokens_however_texts_are_dealt(spark, monkeypatch):
    """More documents than a sample would hold: every decision of every training token is learned from, whole numbers alike for any dealing."""
    monkeypatch.setattr(M, "_MOST_COUNTED", 500)
    rows = [(i, f"a b{i % 5} word{i % 300} longerword{i % 7} a") for i in range(900)] + [(950, None)]
    docs = M._split(spark.createDataFrame(rows, "doc_id bigint, text string"), 0, 10).na.fill({"text": ""})
    texts = [[*M.words(text or ""), M.END] for i, text in rows if zlib.crc32(str(i).encode()) % 10]
    zeros, ones = M.decisions(M.counted(texts))
    vocabulary = M.Vocabulary()
    sums = M.Sums(*M.without_own(zeros, ones))
    sums.add(vocabulary, *vocabulary.counted([vocabulary.at(t) for t in texts]))
    assert sums.shown.sum() == 8 * sum(len(w) + 1 for t in texts for w in t)
    for n in (1, 7):
        assert (M.learning_sums(docs.repartition(n), zeros, ones) == sums.all).all()


def test_learning_sums_against_a_loop():
    texts = [[b"alpha", b"beta", b"alphabet", b"gamma", b"alps", M.END]] * 3 + [[b"beta", b"alpha", b"x", M.END]]
    zeros, ones = M.decisions(M.counted(texts))
    vocabulary = M.Vocabulary()
    keys, times = vocabulary.counted([vocabulary.at(t) for t in texts])
    sums = M.Sums(*M.without_own(zeros, ones))
    sums.add(vocabulary, keys, times)
    slopes, curves = np.zeros((M._SETS, M.CONTEXTS)), np.zeros((M._SETS, M.CONTEXTS, M.CONTEXTS))
    for a, b, units in vocabulary.units(keys):
        each = np.repeat(times[a:b], np.diff(units.starts, append=len(units.bytes)))
        for k, node, bit, groups in units.bits():
            for i in range(len(units.bytes)):
                slots = [g[i] + node[i] for g in groups]
                x = np.array([int(M._odds(zeros[s] - (1 - bit[i]), ones[s] - bit[i])) for s in slots])
                n = [int((zeros + ones)[(groups[c][i] >> 4 << 4) + 1]) - 1 for c in M.GATES]
                gate = k // 4 + sum(int(M._seen(np.array(y))) << (1 + 2 * m) for m, y in enumerate(n))
                p = 1 / (1 + math.exp(-float(np.array(M.START) @ x) / (10 * M._STEPS)))
                slopes[gate] += each[i] * (bit[i] - p) * x
                curves[gate] += each[i] * p * (1 - p) * np.outer(x, x)
    n = times.sum() * 8 * 10
    assert np.abs(sums.slopes / M._UNIT - slopes).max() < n * 127 / M._UNIT and np.abs(sums.slopes / M._UNIT - slopes).max() < 0.02 * np.abs(slopes).max()
    assert np.abs(sums.curves / M._UNIT - curves).max() < 0.02 * np.abs(curves).max()


def test_what_pairs_share_is_what_each_has():
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 101, rng.integers(1, 12)).tolist()) for _ in range(80)] + [M.END, b"\xff" * 9]
    texts = [[words[i] for i in rng.integers(0, 82, 60)] for _ in range(20)]
    mixer = taught(texts)
    vocabulary = M.Vocabulary()
    keys, _ = vocabulary.counted([vocabulary.at(t) for t in texts])
    want = np.concatenate([np.add.reduceat(mixer.logs(u).astype(float), u.starts) for _, _, u in vocabulary.units(keys)]) / math.log(10)
    assert np.allclose(mixer.log10(vocabulary, keys), want, rtol=1e-6)


def test_contexts_are_made_once_for_what_they_see():
    """CPU time: a first byte's contexts but the last see HEAD bytes, so pairs that are alike there share it, whatever follows."""
    words = [f"{a}{b}{c}{d}tail".encode() for a in "pq" for b in "rs" for c in "tu" for d in "vwxyz"]
    vocabulary = M.Vocabulary()
    keys, times = vocabulary.counted([vocabulary.at([x for b in words for x in (b, a)]) for a in words])
    found = [shared for _, shared in vocabulary.shared(keys)]
    # two words that stand next to each other are alike in the last bytes of the first: "tail"
    assert len(found) == 1 and len(found[0].local.bytes) <= 2 * (2 + 4 + 8 + 40) + 40 * len("tail ")
    assert sum(times) == 2 * len(words) ** 2


def test_read_finds_the_words_of_whole_texts():
    texts = ["A b\tB", "", "c\x0bd \u00e9 \u00c9\n", " b " * 70, "x" * 3_000_000 + " a", "\u2028 abc", "  "]
    one, other = M.Vocabulary(), M.Vocabulary()
    at, sizes = one.read(texts)
    want = [[*M.words(x), M.END] for x in texts]
    assert [one.found[i] for i in at] == [w for x in want for w in x] and sizes.tolist() == [len(x) for x in want]
    assert one.found[0] == M.END and len(set(one.found)) == len(one)
    keys, times = other.counted([other.at(x) for x in want])
    again, often = np.unique(one.pairs(at, sizes), return_counts=True)
    named = lambda v, k: (v.found[k // len(v)], v.found[k % len(v)])
    assert {named(one, k): n for k, n in zip(again, often)} == {named(other, k): n for k, n in zip(keys, times)}
    for i, w in enumerate(one.found):
        j = other.found.index(w)
        assert (one.heads[i] == other.heads[j]).all() and bytes(one.heads[i]) == (b"    " + w)[-4:] + b" "
        assert one.hashes[i] == other.hashes[j] and one.first[i] == other.first[j] and one.last[i] == other.last[j]
    assert [x.tolist() for x in M.Vocabulary().read([])] == [[], []]


def test_odds_by_path_are_those_of_each_decision():
    rng = np.random.default_rng(3)
    odds = rng.integers(-126, 127, (5, 16), dtype=np.int8)
    found = M._paths(odds).view(np.int8).reshape(5, 16, 4)
    for leaf in range(16):
        for j in range(4):
            assert (found[:, leaf, j] == odds[:, (1 << j) | (leaf >> (4 - j))]).all()
