"""Plain-Python answers for small fixtures, written independently of the Spark expressions."""

from __future__ import annotations

import re

MARKS = set("āīūṛṅñṭḍṇśṣḥ")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s]


def assembled(pieces: list[str]) -> str:
    if len(pieces) < 2:
        return "".join(pieces)
    out: list[str] = []
    for piece in (p.strip() for p in pieces):
        if piece == "":
            continue
        tail, head = (sentences(out[-1]) if out else []), sentences(piece)
        shared = [
            n for n in (2, 1) if n <= min(len(tail), len(head)) and tail[-n:] == head[:n]
        ]
        out.append(" ".join(head[shared[0] :]) if shared else piece)
    return "\n\n".join(out)


def verse_block(block: str) -> bool:
    rows = [r.strip() for r in block.split("\n") if r.strip()]
    if len(rows) < 2:
        return False
    marked = [bool(MARKS & set(r)) for r in rows]
    if any(m and r[0] in "“”\"'‘’" for m, r in zip(marked, rows, strict=True)):
        return True
    mean = sum(map(len, rows)) / len(rows)
    return 2 * sum(marked) >= len(rows) and all(abs(len(r) - mean) < mean / 2 for r in rows)


def chunks(text: str, upper: int = 500, lower: int = 300, tail: int = 150) -> list[str]:
    text = text.strip()
    if len(text.split()) <= upper:
        return [text] if text else []
    paragraphs = re.split(r"\n\s*\n", text)
    if max(len(p.split()) for p in paragraphs) > upper:
        paragraphs = text.split("\n")
    groups: list[list[str]] = []
    waiting: list[str] = []
    for p in filter(None, (p.strip() for p in paragraphs)):
        if not verse_block(p):
            groups.append([*waiting, p])
            waiting = []
        elif groups:
            groups[-1].append(p)
        else:
            waiting.append(p)
    if waiting:
        groups.append(waiting)
    packed: list[list[str]] = [[]]
    size = lambda ps: sum(len(p.split()) for p in ps)
    for group in groups:
        if size(packed[-1]) + size(group) > upper and size(packed[-1]) >= lower:
            packed.append([])
        packed[-1] += group
    if len(packed) > 1 and size(packed[-1]) < tail:
        last = packed.pop()
        packed[-1] += last
    return ["\n\n".join(p) for p in packed]


def word_sections(lines: list[str], target: int) -> list[int]:
    """Start lines of word-count sections (empty when there is only one)."""
    at = min(50, int(len(lines) * 0.05))
    starts, total = [at], 0
    while at < len(lines):
        total += len(lines[at].split())
        following = at + 1
        if total >= target:
            blanks = [j for j in range(at, min(at + 20, len(lines))) if not lines[j].strip()]
            if blanks and blanks[0] + 1 < len(lines):
                following, total = blanks[0] + 1, 0
                starts.append(following)
        at = following
    return starts if len(starts) > 1 else []


def bucket(requests: list[tuple], capacity: int, width: int) -> dict:
    """Token bucket over (key, microseconds, id); token levels in units of microseconds."""
    level: dict = {}
    verdicts = {}
    for key, now, rid in sorted(requests):
        have, seen = level.get(key, (capacity * width, now))
        have = min(capacity * width, have + now - seen)
        if have >= width:
            verdicts[rid] = (True, have // width - 1, 0)
            have -= width
        else:
            verdicts[rid] = (False, 0, -(-(width - have) // 1_000_000))
        level[key] = (have, now)
    return verdicts
