"""What needs Python's own Unicode tables or spans: plain functions over single texts.

The Arrow functions in :mod:`wardline.operators` call them on the rows that native guards let through.
"""

from __future__ import annotations

import base64
import binascii
import re
import sys
import unicodedata
from functools import lru_cache

from .patterns import REGISTRY, SPACED_PARTS, SPACED_WORDS, Pattern

# Characters, tokens, labels and markers that normalization looks for.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\u2061\u2062\u2063\u2064\ufeff\u00ad\u180e"
BIDI = "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
TOKENS = (
    "<|im_start|>", "<|im_end|>", "shanhu/", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>",
    "<|end_header_id|>", "<|eot_id|>", "[INST]", "[/INST]", "</s>", "<start_of_turn>", "<end_of_turn>",
)
LABELS = ("system", "user", "assistant", "human", "ai", "instruction", "instructions")
MARKERS = (
    "ignore", "disregard", "forget", "override", "system", "assistant", "developer mode", "instructions", "jailbreak",
    "prompt", "reveal", "pretend", "act as", "new rules", "no rules", "no restrictions", "do anything", "unfiltered",
    "unrestricted",
)
BLOB = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}={0,2}(?![A-Za-z0-9+/_-])"
QUOTES = (('"', '"'), ("“", "”"), ("«", "»"), ("‘", "’"), ("`", "`"), ("'", "'"))
LEAST_HEX, LEAST_RUN, LEAST_PRINTABLE, PASSES = 20, 6, 0.85, 2
PREVIEW, SNIPPET = 80, 120

_LABEL = "|".join(sorted(LABELS, key=len, reverse=True))
ROLE_LINE = rf"(?im)^(\s*[#*\->]{{0,8}}\s*)({_LABEL})(\s*:)(?=\s|$)"
ROLE_HEADER = rf"(?im)^(\s*#+\s*)({_LABEL})(?=\s*:?\s*$)"

Finding = tuple[str, str, list[tuple[int, int]], str | None]  # category, description, spans, preview


def slug(token: str) -> str:
    return "⟦fake-" + "-".join(re.findall("[a-z0-9]+", token.lower())) + "⟧"


@lru_cache(maxsize=1)
def _control() -> re.Pattern[str]:
    """Categories Cc and Cf but for line feed and tab."""
    points = (c for c in map(chr, range(sys.maxunicode + 1)) if c not in "\n\t" and unicodedata.category(c) in ("Cc", "Cf"))
    return re.compile("[" + "".join(map(re.escape, points)) + "]+")


def preview(text: str) -> str:
    shown = re.sub("[\x00-\x1f\x7f]", lambda m: f"\\u{ord(m[0]):04x}", text)
    return shown if len(shown) <= PREVIEW else shown[: PREVIEW - 1] + "…"


# ------------------------------------------------------------------ normalization


def fold_unicode(text: str) -> tuple[str, list[Finding]]:
    found: list[Finding] = []
    folded = unicodedata.normalize("NFKC", text)
    if folded != text:
        found.append(("unicode-nfkc", "NFKC normalization changed the text", [], None))
    for category, runs, what in (
        ("unicode-zero-width", re.compile(f"[{ZERO_WIDTH}]+"), "zero-width character"),
        ("unicode-bidi", re.compile(f"[{BIDI}]+"), "bidi control char"),
        ("unicode-control", _control(), "control char"),
    ):
        spans = [m.span() for m in runs.finditer(folded)]
        if spans:
            found.append((category, f"Removed {len(spans)} {what} run(s)", spans, None))
            folded = runs.sub("", folded)
    return folded, found


def _spliced(text: str, edits: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, new in sorted(edits):
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


_TOKEN = re.compile("|".join(map(re.escape, sorted(TOKENS, key=len, reverse=True))), re.I)
_ROLES = re.compile(ROLE_LINE), re.compile(ROLE_HEADER)


def defuse(text: str) -> tuple[str, list[Finding]]:
    """Template tokens, role labels and role headers made visible; where two meet, the first, then the longer."""
    edits = [(m.start(), m.end(), slug(m[0])) for m in _TOKEN.finditer(text)]
    edits += [(m.start(), m.end(), m[1] + slug(m[2]) + m[3]) for m in _ROLES[0].finditer(text)]
    edits += [(m.start(), m.end(), m[1] + slug(m[2])) for m in _ROLES[1].finditer(text)]
    kept: list[tuple[int, int, str]] = []
    reach = 0
    for start, end, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        if start >= reach:
            kept.append((start, end, new))
            reach = end
    found = [("delimiter-neutralized", "Neutralized a pseudo-system delimiter token", [(a, b)], preview(new)) for a, b, new in kept]
    return (_spliced(text, kept) if kept else text), found


def readable(data: bytes) -> str | None:
    """``data`` as text if it looks like some: UTF-8, a letter, mostly printable."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    dark = [c for c in text if not c.isspace()]
    if not any(map(str.isalpha, dark)):
        return None
    return text if sum(map(str.isprintable, dark)) >= LEAST_PRINTABLE * len(dark) else None


def _unhexed(blob: str) -> str | None:
    fits = len(blob) >= LEAST_HEX and len(blob) % 2 == 0 and re.fullmatch("[0-9a-fA-F]+", blob)
    return readable(binascii.unhexlify(blob)) if fits else None


def _unbased(blob: str) -> str | None:
    core = blob.rstrip("=")
    if len(core) % 4 == 1:
        return None
    padded = core + "=" * (-len(core) % 4)
    for alphabet in (None, b"-_"):
        try:
            spelled = padded if alphabet is None else padded.translate(str.maketrans("-_", "+/"))
            return readable(base64.b64decode(spelled, validate=True))
        except binascii.Error:
            continue
    return None


_ROT13 = str.maketrans(
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"
)


def marked(text: str) -> bool:
    low = text.lower()
    return any(m in low for m in MARKERS)


def decode_once(text: str, use_base64: bool, use_hex: bool, use_rot13: bool) -> tuple[str, list[Finding]]:
    edits: list[tuple[int, int, str]] = []
    found: list[Finding] = []
    for m in re.finditer(BLOB, text) if use_base64 or use_hex else ():
        # a blob that reads as hex is hex, whether hex is decoded or not
        plain, kind = _unhexed(m[0]), "hex"
        if plain is None:
            plain, kind = _unbased(m[0]), "base64"
        if plain is None or plain == m[0] or not (use_hex if kind == "hex" else use_base64):
            continue
        safe, inner = defuse(plain)
        edits.append((*m.span(), safe))
        found.append((f"encoding-{kind}", f"Decoded {kind} blob and inlined its content", [m.span()], preview(safe)))
        found += inner
    blobs = list(edits)
    for m in re.finditer(f"[A-Za-z]{{{LEAST_RUN},}}", text) if use_rot13 else ():
        turned = m[0].translate(_ROT13)
        if not marked(turned) or any(a <= m.start() and m.end() <= b for a, b, _ in blobs):
            continue
        edits.append((*m.span(), turned))
        found.append(("encoding-rot13", "Decoded ROT13 run containing a suspicious marker", [m.span()], preview(turned)))
    return (_spliced(text, edits) if edits else text), found


def normalize(
    text: str | None, unicode: bool = True, base64: bool = True, hex: bool = True, rot13: bool = True, delimiters: bool = True
) -> tuple[str, list[Finding]]:
    if text is None:
        return "", []
    found: list[Finding] = []
    if unicode:
        text, found = fold_unicode(text)
    for _ in range(PASSES if base64 or hex or rot13 else 0):
        text, more = decode_once(text, base64, hex, rot13)
        if not more:
            break
        found = found + more
    if delimiters:
        text, more = defuse(text)
        found = found + more
    return text, found


# ------------------------------------------------------------------------ scoring

_COMPILED = [(p, re.compile(p.regex, re.I)) for p in REGISTRY]


def _counts(pattern_id: str, m: re.Match[str]) -> bool:
    if pattern_id != "obf_spaced_letters":
        return True
    word = "".join(m[0].split()).lower()
    return word in SPACED_WORDS or any(part in word for part in SPACED_PARTS)


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Each opening mark with the first closing one after it, kind by kind."""
    out = []
    for a, b in QUOTES:
        last = text.rfind(b) + 1  # beyond it nothing closes
        out += [m.span() for m in re.finditer(f"{a}[^{b}]*{b}", text[:last])]
    return out


def _first_hits(text: str) -> dict[str, tuple[Pattern, re.Match[str]]]:
    first = {}
    for p, regex in _COMPILED:
        m = next((m for m in regex.finditer(text) if _counts(p.id, m)), None)
        if m is not None:
            first[p.id] = (p, m)
    return first


def raw(text: str | None) -> list[str]:
    """Ids of all patterns that match, in registry order, before gating."""
    return list(_first_hits(text or ""))


def scan(text: str | None) -> list[tuple[str, str, int, int, bool]]:
    """The accepted hits in registry order: (pattern id, snippet, start, end, demoted)."""
    text = text or ""
    first = _first_hits(text)
    tags = {tag for p, _ in first.values() for tag in p.tags}
    quoted = quoted_spans(text) if first else []
    out = []
    for p, m in first.values():
        if tags.issuperset(p.requires):
            shown = m[0] if len(m[0]) <= SNIPPET else m[0][: SNIPPET - 1] + "…"
            out.append((p.id, shown, *m.span(), any(a <= m.start() and m.end() <= b for a, b in quoted)))
    return out
