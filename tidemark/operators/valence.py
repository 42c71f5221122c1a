"""Valence rules of a text: lexicon words, and what near them strengthens, turns or outweighs them.

The rules are those published by Hutto and Gilbert (ICWSM 2014), written anew: boosters and negations among the three
words before, capitals among other words, exclamation and question marks, and "but", after which words count more; "least", "never so",
"without doubt" and idioms, which are found by a trie over runs of words. The sum is squashed to between -1 and 1. The lexicon is
the caller's, and so are the names of emoji. The reference implementation of the rules is under the MIT License,
Copyright (c) 2016 C.J. Hutto.
"""

from __future__ import annotations

import json
import math
import string
from pathlib import Path

#: Fixed values of the published rules.
BOOST, CAPITALS, TURN, SQUASH = 0.293, 0.733, -0.74, 15
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
FADE = (1.0, 0.95, 0.9)
EXCLAMATION, MOST_EXCLAMATIONS, QUESTION, MANY_QUESTIONS = 0.292, 4, 0.18, 0.96
NEGATIONS = frozenset(
    "aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't dont hadnt hasnt havent isnt mightnt "
    "mustnt neither don't hadn't hasn't haven't isn't mightn't mustn't neednt needn't never none nope nor not nothing nowhere oughtnt shant "
    "shouldnt wasnt werent oughtn't shan't shouldn't wasn't weren't without wont wouldnt won't wouldn't rarely seldom despite".split()
)
STRONGER = frozenset(
    "absolutely amazingly awfully completely considerably decidedly deeply enormously entirely especially exceptionally extremely fabulously "
    "fully greatly highly hugely incredibly intensely majorly more most particularly purely quite really remarkably so substantially thoroughly "
    "totally tremendously unbelievably unusually utterly very".split()
)
#: Idioms and their valences, and the factor of "never so" and "never this".
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5, "to die for": 3.0,
    "beating heart": 3.1, "broken heart": -2.9,
}
NEVER_SO = 1.25
WEAKER = frozenset("almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat sorta".split())


def words_of(text: str) -> list[str]:
    """Words without the punctuation around them; where two characters or fewer are left (emoticons) it stays."""
    bare = ((w, w.strip(string.punctuation)) for w in text.split())
    return [b if len(b) > 2 else w for w, b in bare]


def emphasis(text: str) -> float:
    asked = text.count("?")
    return min(text.count("!"), MOST_EXCLAMATIONS) * EXCLAMATION + (0.0 if asked < 2 else asked * QUESTION if asked < 4 else MANY_QUESTIONS)


class Trie:
    """Runs of words with values; the longest run that begins at a place counts."""

    def __init__(self, runs: dict[str, float]):
        self.root: dict = {}
        for run, value in runs.items():
            node = self.root
            for w in run.split():
                node = node.setdefault(w, {})
            node[None] = value

    def at(self, words: list[str], i: int) -> tuple[int, float] | None:
        """(end, value) of the longest run that begins at *i*."""
        node, found = self.root, None
        for j in range(i, len(words)):
            node = node.get(words[j])
            if node is None:
                break
            if None in node:
                found = j + 1, node[None]
        return found


PUBLISHED = Trie(IDIOMS)


def turned(v: float, low: list[str], i: int, back: int) -> float:
    """The valence at *i* after what the word *back* places before negates or strengthens."""
    near, between = low[i - back], low[i - back + 1 : i]
    if near == "never" and ("so" in between or "this" in between):
        return v * NEVER_SO
    if near == "without" and "doubt" in between:
        return v
    return v * TURN if near in NEGATIONS or "n't" in near else v


def valence(text: str, lexicon: dict[str, float], idioms: Trie = PUBLISHED, emoji: dict[str, str] | None = None) -> float:
    """Between -1 and 1; 0 for a text without lexicon words and idioms.

    An idiom counts once, at its last word, and its other words don't count; *emoji* are replaced by their names first.
    """
    if emoji:
        text = "".join(f" {emoji[c]} " if c in emoji else c for c in text)
    words = words_of(text)
    low = [w.lower() for w in words]
    loud = [w.isupper() for w in words]
    mixed = 0 < sum(loud) < len(words)
    values = [0.0] * len(low)
    held: dict[int, float] = {}  # places of idioms: their last word has the value, the others none
    i = 0
    while i < len(low):
        run = idioms.at(low, i)
        if run:
            held |= dict.fromkeys(range(i, run[0]), 0.0)
            held[run[0] - 1] = run[1]
        i = run[0] if run else i + 1
    for i, w in enumerate(low):
        v = held[i] if i in held else 0.0 if w in STRONGER or w in WEAKER else lexicon.get(w, 0.0)
        if not v:
            continue
        if i in held:
            values[i] = v
            continue
        if mixed and loud[i]:
            v += math.copysign(CAPITALS, v)
        for back, fade in enumerate(FADE, 1):
            if i < back or low[i - back] in lexicon or i - back in held:
                continue
            near = low[i - back]
            step = BOOST if near in STRONGER else -BOOST if near in WEAKER else 0.0
            if step and mixed and loud[i - back]:
                step += CAPITALS
            v += math.copysign(1.0, v) * step * fade
            v = turned(v, low, i, back)
        if i and low[i - 1] == "least" and low[i - 1] not in lexicon and (i < 2 or low[i - 2] not in ("at", "very")):
            v *= TURN
        values[i] = v
    if "but" in low:
        at = low.index("but")
        values = [v * (BEFORE_BUT if i < at else AFTER_BUT if i > at else 1.0) for i, v in enumerate(values)]
    total = sum(values)
    if total:
        total += math.copysign(emphasis(text), total)
    return total / math.sqrt(total * total + SQUASH)


def read_lexicon(path: str) -> dict[str, float]:
    """Word weights of a JSON object, or of lines with a word, a tab, its weight and perhaps more columns."""
    body = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(body)
    return {cells[0]: float(cells[1]) for line in body.splitlines() if len(cells := line.split("\t")) > 1}
