"""Sentences of Polish legal prose.

Three steps: Unicode sentence boundaries (UAX #29, from the property classes of the ``regex`` package),
joining of neighbours that an abbreviation, an ordinal or a colon keeps together, and splitting at the
markers of enumerations.  Results are never blank.
"""

from __future__ import annotations

import regex

# Abbreviations after which a sentence goes on (each also without its final stop).
ABBREVIATIONS = (
    "art.", "ust.", "pkt.", "lit.", "poz.", "t.j.", "tj.", "r.", "nr", "z późn. zm.", "ze zm.", "zw.", "sp.", "z o.o.", "sygn.", "dz. u.", "zz.", "k.c.",
    "a.", "b.", "c.", "d.", "np.", "wyd.", "ul.", "pl.", "pzp.", "pn.", "dot.", "ww.", "m.in.", "itp.", "etc.", "i.e.", "s.m.", "św.m.", "p.m.", "j.m.", "p.n.", "p.w.",
    "tzn.", "tzw.", "ok.", "śr.", "min.", "max.", "maks.", "tys.", "mln", "mld", "ha", "kg", "g", "mg", "l", "ml", "cm", "mm", "m", "km", "szt.", "godz.", "min", "sek.",
    "temp.", "wg", "ws.", "zob.", "por.", "ryc.", "rys.", "tab.", "fot.", "str.", "al.", "rozdz.",
)

_END = regex.compile(r"[\p{SB=AT}\p{SB=ST}][\p{SB=EX}\p{SB=FO}]*")
_TAIL = regex.compile(r"[\p{SB=CL}\p{SB=EX}\p{SB=FO}]*[\p{SB=SP}\p{SB=EX}\p{SB=FO}]*")
_BREAK = regex.compile(r"\r\n|[\r\n\p{SB=SE}]")
_STOP = regex.compile(r"[\p{SB=AT}]")
_CONTINUES = regex.compile(r"[\p{SB=SC}\p{SB=AT}\p{SB=ST}]")
_LOWER_NEXT = regex.compile(r"[^\p{SB=LE}\p{SB=UP}\p{SB=LO}\p{SB=SE}\r\n\p{SB=AT}\p{SB=ST}]*[\p{SB=LO}]")
_NUMBER = regex.compile(r"[\p{SB=NU}]")
_LETTER = regex.compile(r"[\p{SB=UP}\p{SB=LO}]")
_UPPER = regex.compile(r"[\p{SB=UP}]")
_MARKER = regex.compile(r"(?:[0-9]{1,3}|[A-Z])\s*[.)](?=\s)")
_SPACES = " \t\n\r\x0b\x0c\x85\xa0                　"
_ORDINAL = regex.compile(r"[0-9]+|[ivxlcdm]{1,8}", regex.IGNORECASE)


def _table(extra: tuple[str, ...]) -> frozenset[str]:
    entries = {e.strip().lower() for e in (*ABBREVIATIONS, *extra) if e.strip()}
    return frozenset(entries | {e.removesuffix(".") for e in entries})


_BASE = _table(())


def boundaries(text: str) -> list[int]:
    """Offsets of sentence ends by UAX #29, the text's end included."""
    ends = set()
    for m in _BREAK.finditer(text):
        ends.add(m.end())
    at = 0
    while m := _END.search(text, at):
        at = m.end()
        stop = bool(_STOP.match(m.group()))
        if stop and (_NUMBER.match(text, at) or (m.start() and _LETTER.match(text[m.start() - 1]) and _UPPER.match(text, at))):
            continue
        after = _TAIL.match(text, at).end()
        if _CONTINUES.match(text, after) or stop and _LOWER_NEXT.match(text, after):
            continue
        line = _BREAK.match(text, after)
        ends.add(line.end() if line else after)
    return sorted(e for e in ends | {len(text)} if e)


def _bare(token: str) -> str:
    return token.strip(",;:\"')(")


def _is_abbreviation(token: str, table: frozenset[str]) -> bool:
    """A listed word, or an initial: one ASCII capital and a full stop."""
    if len(token) == 2 and "A" <= token[0] <= "Z" and token[1] == ".":
        return True
    low = token.lower()
    return bool(low) and (low in table or low.removesuffix(".") in table)


def _goes_on(left: str, right: str, table: frozenset[str], abbreviations: bool = True, ordinals: bool = True) -> bool:
    """Whether a sentence that seems to end with ``left`` continues with ``right``."""
    tail, head = left.split()[-3:], right.split()[:1]
    if not tail or not head:
        return False
    words = [_bare(t) for t in tail]
    if abbreviations:
        if _is_abbreviation(words[-1], table) or any(" ".join(words[-n:]).lower() in table for n in range(2, len(words) + 1)):
            return True
        if words[-1] and _bare(head[0]) and f"{words[-1]} {_bare(head[0])}".lower() in table:
            return True
        if tail[-1].endswith(":") and "a" <= head[0][0] <= "z":
            return True
    return ordinals and bool(_ORDINAL.fullmatch(words[-1].strip(".)(\"',;")))


def _enumeration(text: str) -> list[str]:
    """Parts of one sentence, cut before the markers of an enumeration.

    A marker is one to three digits or a capital, then a full stop or bracket and white space; the first one
    needs the sentence's start, a colon, semicolon, bracket or dash before it, later ones follow freely (even
    from within a longer number).
    """
    cuts, follow, at = [], False, 0
    while m := _MARKER.search(text, at):
        before = text[: m.start()].rstrip()
        if follow or not before or before[-1] in ":;()[]-–—":
            follow = True
            at = m.end()
            if before:
                cuts.append(m.start())
        else:
            at = m.start() + 1
    edges = [0, *cuts, len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def split(text: str, extra: tuple[str, ...] = (), abbreviations: bool = True, ordinals: bool = True) -> list[str]:
    """Sentences; ``extra`` adds abbreviations, the flags turn the two kinds of joining off."""
    table = _table(extra) if extra else _BASE
    merged: list[list[int]] = []
    begin = 0
    for end in boundaries(text):
        piece = text[begin:end].strip(_SPACES)
        if piece:
            if merged and _goes_on(text[merged[-1][0] : merged[-1][1]].strip(_SPACES), piece, table, abbreviations, ordinals):
                merged[-1][1] = end
            else:
                merged.append([begin, end])
        begin = end
    return [s for a, b in merged for part in _enumeration(text[a:b].strip(_SPACES)) if (s := part.strip(_SPACES))]
