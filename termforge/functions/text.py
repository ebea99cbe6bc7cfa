"""Column expressions over text, as SQL that both Spark and, where `duck` is set, DuckDB can run.

The two differ in names of classes and functions only; keeping one builder for both keeps the oracle honest about the
rules and leaves the engines to disagree about results.
"""

from __future__ import annotations

LETTER, UPPER, LOWER = r"\\p{IsAlphabetic}", r"\\p{IsUppercase}", r"\\p{IsLowercase}"
WORD = rf"[{LETTER}\\p{{N}}]"
#: A token inside a chunk without white space: its ends are letters or digits.
TOKEN = rf"{WORD}(?:.*{WORD})?"
SEPARATORS = r"[-_/.+]"


def newlines(c: str) -> str:
    return rf"translate(regexp_replace({c}, '\\r\\n?', '\n'), '\u000c', '\n')"


def folded_characters(c: str) -> str:
    """Soft hyphens go; hyphens and fixed spaces become plain ones."""
    return f"translate(translate({c}, '‐‑   ', '--   '), '­', '')"


def joined_hyphens(c: str) -> str:
    return rf"regexp_replace({c}, '(?U)(?<=\\p{{IsAlphabetic}})-[^\\S\\n]*\\n(?=[^\\S\\n]*\\p{{IsLowercase}})', '')"


def collapsed(c: str) -> str:
    one = rf"regexp_replace({c}, '(?U)[^\\S\\n]+', ' ')"
    lines = rf"regexp_replace({one}, ' ?\\n ?', '\n')"
    return rf"regexp_replace(regexp_replace({lines}, '\\n{{3,}}', '\n\n'), '^[ \\n]+|[ \\n]+$', '')"


def has_internal_caps(t: str) -> str:
    return f"(substring({t}, 2) rlike '{UPPER}' AND substring({t}, 2) rlike '{LOWER}')"


def has_digit(t: str) -> str:
    return f"({t} rlike '[0-9]')"


def has_letter(t: str) -> str:
    return f"({t} rlike '{LETTER}')"


def all_caps(t: str) -> str:
    """At least one letter, and every letter upper case."""
    return rf"({t} rlike '{LETTER}' AND NOT {t} rlike '[{LETTER}&&[^{UPPER}]]')"


def short_all_caps(t: str) -> str:
    return f"({all_caps(t)} AND length({t}) BETWEEN 2 AND 6)"


def long_all_caps(t: str) -> str:
    return f"({all_caps(t)} AND length({t}) > 6)"


def segments(t: str) -> str:
    """Number of parts between separators, if there are several and each has a letter or digit; else 1."""
    parts = f"filter(split({t}, '{SEPARATORS}'), p -> p <> '')"
    return f"(CASE WHEN size({parts}) > 1 AND forall({parts}, p -> p rlike '{WORD}') THEN size({parts}) ELSE 1 END)"


def folded_apostrophes(w: str) -> str:
    return f"translate({w}, '’ʼ＇', '''''''')"


def base_forms(w: str, duck: bool = False) -> str:
    """Array of forms that an inflected word may come from; a form may occur twice, and null stands for none."""
    listed = "list_value" if duck else "array"
    ends = lambda s: f"right({w}, {len(s)}) = '{s.replace(chr(39), chr(39) * 2)}'"
    stem = lambda n: f"left({w}, greatest(length({w}) - {n}, 0))"

    def undoubled(s: str) -> str:
        last = f"right({s}, 1)"
        letter = f"regexp_matches({last}, '^\\p{{L}}$')" if duck else f"{last} rlike '^{LETTER}$'"
        return f"CASE WHEN length({s}) >= 2 AND substring({s}, length({s}) - 1, 1) = {last} AND {letter} AND {last} NOT IN ('a', 'e', 'i', 'o', 'u') THEN left({s}, length({s}) - 1) END"

    forms = [f"CASE WHEN {ends(chr(39) + 's')} THEN {stem(2)} END", f"CASE WHEN {ends(chr(39))} THEN {stem(1)} END", f"CASE WHEN {ends('ies')} THEN {stem(3)} || 'y' END"]
    for suffix in ("es", "ed", "ing", "s"):
        s = stem(len(suffix))
        forms.append(f"CASE WHEN {ends(suffix)} THEN {s} END")
        if suffix != "s":
            forms.append(f"CASE WHEN {ends(suffix)} THEN {s} || 'e' END")
        forms.append(f"CASE WHEN {ends(suffix)} THEN {undoubled(s)} END")
    return f"{listed}({', '.join(forms)})"


def american(x: str) -> str:
    """The z spelling of a form in -ise, -isation, -ised or -ising; null for others."""
    cases = " ".join(f"WHEN right({x}, {len(b)}) = '{b}' THEN left({x}, length({x}) - {len(b)}) || '{z}'" for b, z in (("ise", "ize"), ("isation", "ization"), ("ised", "ized"), ("ising", "izing")))
    return f"CASE {cases} END"


def lookup_keys(w: str) -> str:
    """All forms under which a word is looked up, without lemmas."""
    first = f"concat(array({w}), array_compact({base_forms(w)}))"
    return f"transform(array({first}), f -> filter(array_distinct(concat(f, array_compact(transform(f, x -> {american('x')})))), x -> length(x) >= 2 OR x = {w}))[0]"
