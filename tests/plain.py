"""Slow, direct versions of the packing rules, used only to check the Spark results."""

import math
import re

from chunkloom.functions.patterns import CLAUSE_BREAK, HYPHEN_BREAK, SENTENCE_BREAK, SOFT_BREAK


def tokens(text):
    return max(len(text) // 2, math.floor(len(text.split()) * 2.2)) if text else 0


def units_of(text, legal, budget):
    text = re.sub(HYPHEN_BREAK.removeprefix("(?U)"), r"\1\2", text.strip())
    parts = [text]
    for pattern in ([CLAUSE_BREAK] if legal else []) + [SENTENCE_BREAK]:
        parts = [s.strip() for p in parts for s in re.split(pattern, p) if s.strip()]
    return [u for p in parts for u in (long_units(p, budget) if tokens(p) > budget else [p])]


def long_units(sentence, budget):
    flat = []
    for piece in (p.strip() for p in re.split(SOFT_BREAK, sentence) if p.strip()):
        if tokens(piece) > budget:
            flat += [(w, i == 0) for i, w in enumerate(piece.split())]
        else:
            flat.append((piece, False))
    out = []
    for s, forced in flat:
        if out and not forced and tokens(out[-1] + " " + s) <= budget:
            out[-1] += " " + s
        else:
            out.append(s)
    return out


def pack(weights, budget):
    packs, used = [], 0
    for i, w in enumerate(weights):
        if not packs or used + w > budget:
            packs.append([])
            used = 0
        packs[-1].append(i)
        used += w
    return packs


def pack_articles(items, budget):
    """items: (weight, article or None) of one section; returns [(indexes, title)]."""
    packs, used, title = [], 0, None
    for i, (w, art) in enumerate(items):
        if art and title and art != title:
            used, title = 0, None
        if art and not title:
            title = art
        if used and used + w > budget:
            used, title = 0, art and art + " (계속)"
        if not used:
            packs.append([[], None])
        packs[-1][0].append(i)
        packs[-1][1] = title
        used += w
    return [(p, t) for p, t in packs]
