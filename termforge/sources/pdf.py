"""Text of PDF files with plain or deflated content streams and one-byte fonts, from the standard library alone.

Text is what the showing operators of the content streams say, in the order of the file; a line ends where the pen moves
down. Fonts with two-byte codes are read through a ToUnicode map of the file where it has one, and give nothing without.
"""

from __future__ import annotations

import re
import zlib

_STREAM = re.compile(rb"<<((?:[^<>]|<(?!<)|>(?!>)|<<(?:[^<>]|<(?!<)|>(?!>))*>>)*)>>\s*stream\r?\n", re.S)
_TOKEN = re.compile(rb"\((?:[^\\()]|\\.|\((?:[^\\()]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?[0-9.]+|/[^\s/<>\[\]()]*|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
#: A word gap in a line of glyphs, in thousandths of the font's size.
GAP = 180


class Locked(Exception):
    pass


def _streams(content: bytes) -> list[bytes]:
    out = []
    for m in _STREAM.finditer(content):
        if b"/Image" in m[1] or b"/FontFile" in m[1]:
            continue
        end = content.find(b"endstream", m.end())
        data = content[m.end() : end if end >= 0 else len(content)]
        if b"FlateDecode" in m[1]:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        out.append(data)
    return out


def _wide(streams: list[bytes]) -> dict[int, str]:
    """Codes of the ToUnicode maps, all fonts together."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for s in streams:
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", s, re.S):
            out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", s, re.S):
            for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                low, high = int(a, 16), int(b, 16)
                out |= {k: chr(int(c, 16) + k - low) for k in range(low, min(high, low + 0xFFFF) + 1)}
    return out


def _shown(raw: bytes, wide: dict[int, str]) -> str:
    if raw[:1] == b"(":
        return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _NAMED.get(m[1], m[1]), raw[1:-1]).decode("cp1252", "replace")
    digits = re.sub(rb"\s", b"", raw[1:-1]).decode()
    if wide and len(digits) % 4 == 0:
        return "".join(wide.get(int(digits[i : i + 4], 16), "") for i in range(0, len(digits), 4))
    return bytes.fromhex(digits + "0" * (len(digits) % 2)).decode("cp1252", "replace")


def text_of(content: bytes) -> tuple[str, bool]:
    """(text, whether any text is shown). An encrypted file raises Locked."""
    if re.search(rb"/Encrypt\s+[0-9]+\s+[0-9]+\s+R", content) or re.search(rb"/Encrypt\s*<<", content):
        raise Locked
    streams = _streams(content)
    wide, out = _wide(streams), []
    for s in streams:
        if b"BT" not in s or b"begincmap" in s:
            continue
        held: list[bytes] = []
        for m in _TOKEN.finditer(s):
            t = m[0]
            if t[:1] in b"(<[]/" or t[:1] in b"+-.0123456789":
                held.append(t)
                continue
            if t in (b"Tj", b"TJ", b"'", b'"'):
                if t in (b"'", b'"'):
                    out.append("\n")
                for h in held:
                    if h[:1] in (b"(", b"<"):
                        out.append(_shown(h, wide))
                    elif t == b"TJ" and h[:1] not in (b"[", b"]", b"/") and float(h) < -GAP:
                        out.append(" ")
            elif t in (b"T*", b"ET") or t in (b"Td", b"TD") and len(held) >= 2 and float(held[-1] or 0) != 0 or t == b"Tm":
                out.append("\n")
            held = []
    text = re.sub(r"\n+", "\n", "".join(out)).lstrip("\n")
    return text, bool(text.strip())
