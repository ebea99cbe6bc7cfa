"""Personal data: exact base patterns, and more spans by candidates, boosted trees and calibrated thresholds.

High-recall generators propose overlapping candidate spans of KINDS; features of format and context go to one
gradient-boosted model; a candidate is taken if its score reaches the threshold of its kind, calibrated for
precision on labelled examples that the trees have not seen. The examples are written here by a seeded
generator, so the model is a function of this file; those that thresholds are calibrated on come from a second one, with
other words and formats and with negatives that look like the real thing. Base spans always stay; taken candidates don't overlap them or
each other (the higher score wins, then the earlier start).
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm.boosting import BoostedTrees, threshold_for
from termforge.llm.common import documents, table
from termforge.llm.tokens import small_batches

BASE = ("email", "ip", "card", "phone")
#: Kinds of candidates; secrets and account numbers have no base pattern.
KINDS = ("email", "phone", "secret", "account")
ORDER = {k: i for i, k in enumerate((*BASE, "secret", "account"))}
EXAMPLES, PRECISION = 6000, 0.98
#: Examples of the other writer, which thresholds are calibrated on, and the highest threshold of a kind.
CALIBRATION, MOST = 4000, 0.95
_DIGIT = re.compile("[0-9]")
_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: As [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), which never begins or ends within a run of digits; so a run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_GENERATORS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?[\[({<]? ?(?:at|AT|@) ?[\])}>]? ?[A-Za-z0-9-]+(?:(?: ?[\[({<]? ?(?:dot|DOT) ?[\])}>]? ?| ?[\[({<] ?\. ?[\])}>] ?| \. |\.)[A-Za-z0-9-]+)+"),
    "phone": re.compile(r"(?<![\w+.-])\(?[0-9]{2,4}\)?[ ./-]?(?:[0-9]{2,4}[ ./-]?){1,4}[0-9](?![\w])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*[0-9])[A-Za-z0-9_/+-]{16,}+={0,2}"),
    "account": re.compile(r"(?<![\w-])[A-Z]{0,2}[0-9](?:[ -]?[0-9]){5,}+(?![\w-])"),
}
_AT = re.compile(r"@|(?<![A-Za-z])(?:at|AT)(?![A-Za-z])")
_HINTS = {
    "email": ("mail", "contact", "write", "reach"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp"),
    "secret": ("token", "key", "secret", "password", "passwd", "auth", "bearer", "credential"),
    "account": ("account", "iban", "ssn", "passport", "social", "licence", "license no", "tax"),
}
_AGAINST = ("version", "commit", "isbn", "order", "price", "total", "page", "http", "/", "build", "file", "sha", "checksum", "digest")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _HOST.match(text, at)):
            out.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m.group().split("."))]
        out += [(*m.span(), "card") for m in _CARD.finditer(text) if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    """Addresses with signs in words: from the start of the run of characters before an `at`, as far as they go."""
    done = -1
    for m in _AT.finditer(text):
        end = m.start()
        for skipped in (" ", "[({<", " "):  # what may stand between the two
            end -= end > 0 and text[end - 1] in skipped
        start = end
        while start > done + 1 and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        same = start == done + 1 and start > 0 and text[start - 1] in _LOCAL_CHARS
        done = max(done, end - 1)
        if start < end and not same:  # a run is walked and tried once
            if f := _GENERATORS["email"].match(text, start):
                yield f.start(), f.end(), "email"


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans that may be personal data, overlapping ones included."""
    out = []
    if _DIGIT.search(text):
        for kind in ("phone", "secret", "account"):
            out += [(*m.span(), kind) for m in _GENERATORS[kind].finditer(text) if kind != "phone" or 7 <= len(_digits(m.group())) <= 15]
    if "@" in text or "at" in text or "AT" in text:
        out += _spelled(text)
    return sorted(set(out))


def features(text: str, span: tuple[int, int, str]) -> list[float]:
    """Format of the span and words around it, as numbers."""
    start, end, kind = span
    body, before, after = text[start:end], text[max(0, start - 40) : start].lower(), text[end : end + 12].lower()
    digits = _digits(body)
    letters = [c for c in body if c.isalpha()]
    counts = Counter(body)
    entropy = -sum(n / len(body) * math.log2(n / len(body)) for n in counts.values())
    groups = re.findall("[0-9]+", body)
    return [
        float(KINDS.index(kind)), float(len(body)), float(len(digits)), float(len(letters)), sum(c.isupper() for c in letters) / (len(letters) or 1), sum(c in "0123456789abcdefABCDEF" for c in body) / len(body),
        entropy, float(len(counts)), float(luhn(digits)) if len(digits) >= 12 else -1.0, float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)), float(sum(c in " -./()" for c in body)),
        float(any(h in before for h in _HINTS[kind])), float(any(h in before for hs in _HINTS.values() for h in hs)), float(any(h in before for h in _AGAINST)), float(before[-1:] in "\"'" and before != ""), float(before.rstrip(" \"'")[-1:] in "=:" and before.strip(" \"'") != ""),
        float(before[-1:] in "$€£#/"), float(after[:1] in "%€$/"), float(body[:1] in "(0"), float("dot" in body.lower()), float(" at " in body.lower() or "[at]" in body.lower() or "(at)" in body.lower()), float("@" in body), float(len(re.findall("[0-9][A-Za-z]|[A-Za-z][0-9]", body))), float("_" in body or "/" in body),
    ]


def _examples(n: int, seed: int = 20) -> tuple[list[list[float]], list[int], list[str]]:
    """Labelled candidates from made-up sentences."""
    r = random.Random(seed)
    word = lambda k=8: "".join(r.choice(("an", "er", "ti", "on", "re", "sa", "lo", "mi", "ku", "de")) for _ in range(r.randint(1, max(1, k // 2))))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    filler = lambda: " ".join(word() for _ in range(r.randint(0, 5)))
    hint = lambda kind: r.choice(_HINTS[kind])
    x, y, kinds = [], [], []
    while len(y) < n:
        kind, yes = r.choice(KINDS), r.random() < 0.5
        lead = ""
        if kind == "email":
            user, host, end = word() + r.choice(("", number(2), "." + word(4))), word(), r.choice(("com", "org", "net", "example"))
            if yes:
                a, d = r.choice(((" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" @ ", "."), (" AT ", " DOT ")))
                body = f"{user}{a}{host}{d}{end}"
                lead = r.choice(("", f"{hint(kind)} "))
            else:
                body = r.choice((f"{word()} at {host}.{word(4).title()}", f"{word()} at {number(1)}.{number(2)}", f"{word()} at {word()} dotted"))
        elif kind == "phone":
            if yes:
                body = r.choice((f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"0{number(2)} {number(4)} {number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"0{number(3)}/{number(3)}{number(4)}"))
                lead = r.choice(("", f"{hint(kind)} ", f"{hint(kind)}: "))
            else:
                body = r.choice((f"20{number(2)}-{number(2)}-{number(2)}", number(16), f"{number(4)}-20{number(2)}", f"{number(2)}.{number(2)}.20{number(2)}", number(6), f"{number(3)} {number(3)}", f"{number(4)} {number(4)} {number(4)} {number(4)}", f"{number(3)}.{number(2)}.{number(3)}.{number(2)}"))
                lead = r.choice(("", f"{r.choice(_AGAINST)} "))
        elif kind == "secret":
            if yes:
                body = r.choice((hexes(40), hexes(32), mixed(24), mixed(40), "AKIA" + mixed(16).upper(), "ghp_" + mixed(36), "sk_live_" + mixed(24)))
                quote = r.choice(("", '"', "'"))
                lead = r.choice((f"{hint(kind)} = {quote}", f"{hint(kind)}: {quote}", f"{hint(kind).upper()} = {quote}", f"{hint(kind)}={quote}"))
            else:
                body = r.choice((f"{word()}-{word()}-{word()}-20{number(2)}", f"{word()}_{word()}_{word()}{number(1)}", number(18), f"/{word()}/{word()}/{word()}{number(2)}", hexes(40), f"{word(14)}{word(10)}{number(1)}"))
                lead = r.choice(("", f"{r.choice(_AGAINST)} ", "https:/"))
        else:
            body = r.choice((f"{number(3)}-{number(2)}-{number(4)}", f"DE{number(2)} {number(4)} {number(4)} {number(4)} {number(4)} {number(2)}", number(10), f"{number(4)} {number(4)} {number(4)}"))
            lead = r.choice((f"{hint(kind)} ", f"{hint(kind)}: ", f"{hint(kind)} number ")) if yes else r.choice(("", "", f"{r.choice(_AGAINST)} "))
        text = f"{filler()} {lead}{body}{r.choice(('', '.', ',', chr(34)))} {filler()}"
        at = text.index(body, len(text) - len(body) - len(filler()) - 80 if len(text) > 4000 else 0)
        want = (at, at + len(body))
        for c in candidates(text):
            overlap = min(c[1], want[1]) - max(c[0], want[0])
            if c[2] == kind and overlap > 0:
                x.append(features(text, c))
                y.append(int(yes and overlap >= 0.9 * max(c[1] - c[0], want[1] - want[0])))
                kinds.append(kind)
    return x, y, kinds


def _calibration(n: int, seed: int = 31) -> tuple[list[list[float]], list[int], list[str]]:
    """Labelled candidates from sentences of another kind: real words, formats that `_examples` has not, hard negatives."""
    r = random.Random(seed)
    say = ("we", "met", "the", "team", "on", "Monday", "and", "reviewed", "results", "from", "last", "week", "please", "see", "below", "for", "details", "thanks")
    some = lambda a, b: " ".join(r.choice(say) for _ in range(r.randint(a, b)))
    of = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    number, hexes = (lambda k: of("0123456789", k)), (lambda k: of("0123456789abcdef", k))
    both = lambda k: of("abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k)
    names, hosts = ("maria", "t.osei", "li_wei", "k-berg", "sam99"), ("acme", "uni-lab", "post", "mx1")
    x, y, kinds = [], [], []
    while len(y) < n:
        kind, yes = r.choice(KINDS), r.random() < 0.5
        if kind == "email":
            if yes:
                at, dot = r.choice(((" at ", " dot "), (" AT ", " DOT "), ("(at)", "(dot)"), (" [at] ", "."), (" @ ", " dot "), ("{at}", "{dot}")))
                lead, body = r.choice(("", "you find me under ", "write ", "ask ")), f"{r.choice(names)}{at}{r.choice(hosts)}{dot}{r.choice(('de', 'co', 'edu', 'io'))}"
            else:
                lead, body = r.choice(("", "held ", "look ")), r.choice((f"stay at home.{some(1, 1).title()}", f"team at {number(2)}.{number(2)}", f"is at point. {some(1, 1).title()}", "sold at 4.50", "back at ten. We"))
        elif kind == "phone":
            if yes:
                lead, body = r.choice(("ring ", "my number is ", "cell: ", "call ", "tel. ", "")), r.choice((f"({number(3)}) {number(3)} {number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"0{number(3)} {number(3)} {number(3)}", f"0{number(2)}/{number(4)}-{number(3)}"))
            else:
                lead, body = r.choice(("from ", "between ", "ref ", "item ", "")), r.choice((f"19{number(2)}-20{number(2)}", f"20{number(2)}.0{r.randint(1, 9)}.1{number(1)}", f"{number(2)}:{number(2)}", f"1{number(2)} 000 000", f"{number(4)}/{number(2)}/{number(2)}", f"{number(3)}-{number(1)}-{number(2)}-{number(3)}"))
        elif kind == "secret":
            if yes:
                lead, body = r.choice(("api_key=", "password: ", "export TOKEN=", "secret is ", "Authorization: Bearer ", 'key = "')), r.choice((both(32), hexes(64), "xoxb-" + number(10) + "-" + both(20), both(88), both(240), "AKIA" + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)))
            else:
                lead, body = r.choice(("commit ", "sha256 ", "see ", "etag ", "in ", "file ")), r.choice((hexes(40), hexes(64), f"/usr/share/{some(1, 1)}/{some(1, 1)}{number(2)}", f"release-{some(1, 1)}-{some(1, 1)}-{number(4)}", f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", f"{some(1, 1)}_{some(1, 1)}_{some(1, 1)}_{number(3)}"))
        else:
            lead = r.choice(("account no. ", "IBAN: ", "passport ", "tax id ", "social security ")) if yes else r.choice(("order ", "population ", "serial ", "isbn ", "on ", ""))
            body = r.choice((f"{number(3)}-{number(2)}-{number(4)}", f"FR{number(2)} {number(4)} {number(4)} {number(4)}", number(9), f"{number(4)}-{number(4)}-{number(2)}"))
        text = f"{some(1, 6)} {lead}{body}{r.choice(('', '.', ','))} {some(0, 4)}"
        at = text.index(body)
        for c in candidates(text):
            overlap = min(c[1], at + len(body)) - max(c[0], at)
            if c[2] == kind and overlap > 0:
                x.append(features(text, c))
                y.append(int(yes and overlap >= 0.9 * max(c[1] - c[0], len(body))))
                kinds.append(kind)
    return x, y, kinds


class _Disjoint:
    """Covered stretches, in order and apart, found by bisection."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.ends, start)
        return i == len(self.starts) or self.starts[i] >= end

    def cover(self, start: int, end: int) -> None:
        a, b = bisect.bisect_right(self.ends, start), bisect.bisect_left(self.starts, end)
        if a < b:
            start, end = min(start, self.starts[a]), max(end, self.ends[b - 1])
        self.starts[a:b], self.ends[a:b] = [start], [end]


class PiiModel:
    """Boosted trees and the thresholds of the kinds."""

    def __init__(self) -> None:
        x, y, _ = _examples(EXAMPLES)
        self.trees = BoostedTrees().fit(np.array(x), np.array(y, float))
        x, y, kinds = _calibration(CALIBRATION)
        y, held = np.array(y, float), self.trees.score(np.array(x))
        self.thresholds = {k: min(max(0.5, threshold_for(held[m], y[m], PRECISION)), MOST) for k in KINDS for m in [np.array([q == k for q in kinds])]}
        taken = held >= np.array([self.thresholds[k] for k in kinds])
        self.precision, self.recall = float(y[taken].mean()), float(taken[y > 0].mean())

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans, and all spans."""
        base = base_spans(text)
        held = _Disjoint()
        for start, end, _ in base:
            held.cover(start, end)
        found = [c for c in candidates(text) if held.free(c[0], c[1])]
        if not found:
            return base, base
        scores = self.trees.score(np.array([features(text, c) for c in found]))
        taken: list[tuple[int, int, str]] = []
        for s, c in sorted(zip(-scores, found)):
            if -s >= self.thresholds[c[2]] and held.free(c[0], c[1]):
                held.cover(c[0], c[1])
                taken.append(c)
        return base, sorted([*base, *taken], key=lambda s: (s[0], ORDER[s[2]]))


_MODEL: list[PiiModel] = []


def model() -> PiiModel:
    """The model, made once in a process: the same in all of them."""
    if not _MODEL:
        _MODEL.append(PiiModel())
    return _MODEL[0]


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_spans for every row.

    Null text is empty; an empty text has no spans. Rows are taken one by one, so repeated rows and rows without
    doc_id are like any others. Extra columns are ignored. Positions count code points.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model())  # sixty small trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            rows = [m.spans(t) for t in b["text"].to_pylist()]
            counts = [[sum(s[2] == k for s in base) for base, _ in rows] for k in BASE]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in rows], pa.string()), pa.array([shown(every) for _, every in rows], pa.string()), pa.array([len(e) for _, e in rows], pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"],
            )

    return documents(docs).mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint")


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets."""
    out, done = [], 0
    for start, end, kind in sorted(spans):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in its text column replaced; null stays null, other columns and rows stay as they are."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            at = b.schema.get_field_index(text)
            new = [None if t is None else redacted(t, m.spans(t)[1]) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
