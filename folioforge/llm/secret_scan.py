"""Secret scan: fixed patterns, and values near credential words that are costly to guess.

A value that follows a word such as *password* may be a secret or ordinary prose.  What it
costs an attacker to guess it decides: dynamic programming finds the cheapest way to cut the
value into dictionary words, dates, repeats, keyboard walks and characters tried one by one.
Values above a threshold are reported beside the matches of the fixed patterns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.rows import text_of
from folioforge.session import ship_package

# Fixed patterns with the shortest length of the part that decides; kinds in their order.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A match takes in the whole run of such characters, so the length can be asked for at once.
HEX = re.compile(r"[0-9a-f]{32,}")
BASE = {"assign": (ASSIGN, 2, 8), "access": (ACCESS, 0, 16), "hex": (HEX, 0, 32)}
#: The kind of what the method adds comes last.
GUESS = "guess"
KINDS = (*BASE, GUESS)

#: A credential word, what may stand between, and the value up to a space, quote or bracket.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|(?:api|access|private|client|auth)[\x20_-]?(?:key|secret|token))"""
    r"""["']?(?:\x20*(?:=>|->|[:=])|\x20+(?:is|was)(?=\x20)|(?<=[Bb]earer)(?=\x20))\x20*["'(\[{<]?([^\s"'()\[\]{}<>,;|]{6,})""",
    re.I | re.A,
)
#: Decimal logarithm of the guesses from which a value is a secret, and how many of small
#: letters, capitals, digits and signs it has to mix (a first capital does not count as one), and
#: its length at least.
THRESHOLD, CLASSES, SHORTEST = 12.0, 2, 6

# Words that passwords and credential phrases are made of, most frequent first: their place is
# the number of guesses.
WORDS = tuple(
    "password the pass admin user login welcome secret token key test love root master access"
    " hello monkey dragon shadow sun moon star summer winter spring autumn football baseball"
    " soccer hockey batman superman michael jordan thomas robert daniel charlie andrew joshua"
    " letmein trustno iloveyou princess sunshine flower cheese coffee orange purple yellow"
    " silver golden green black white blue red tiger eagle lion horse correct battery staple"
    " changeme default guest temp demo example sample null none required invalid expired reset"
    " forgot change enter your that this with from have been will must should please is and for"
    " not are was must field value string number basic bearer auth client server private public"
    " database system computer internet google apple windows linux office home work family"
    " mother father friend angel baby junior freedom money power magic matrix hunter ranger"
    " killer maverick phoenix mustang ferrari harley thunder london paris berlin january"
    " february march april may june july august september october november december".split()
)
#: Letters behind the signs and digits that stand for them.
LOOKS_LIKE = str.maketrans("0134578@$!", "oleastbasi")

KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
#: How far each row of keys is moved to the right of the one above, in keys.
OFFSETS = (0.0, 1.5, 1.75, 2.25)
KEYS = sum(map(len, KEY_ROWS))
SHORTEST_WALK, LONGEST_WORD, LONGEST_PERIOD = 3, max(map(len, WORDS)), 32
DATE = re.compile(
    r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d", re.A
)
YEAR = re.compile(r"(?:19|20)\d\d", re.A)
# Guesses for a date: 366 days of 200 years; for a year alone: 200; a separator is one of five.
DAYS, YEARS, SEPARATORS = 366, 200, 5
#: Size of the alphabet that a character is tried from.
ALPHABETS = ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10))
OTHER_SIGNS = 33


PLACES = {c: (x + OFFSETS[y], y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}


def _neighbours(key: str) -> set[str]:
    """The keys at most one row and one key's width away."""
    x, y = PLACES[key]
    return {k for k, (a, b) in PLACES.items() if k != key and abs(a - x) <= 1 and abs(b - y) <= 1}


ADJACENT = {key: _neighbours(key) for key in PLACES}
MOST_NEIGHBOURS = max(map(len, ADJACENT.values()))
_RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}


def character_cost(c: str) -> float:
    return math.log10(next((n for is_one, n in ALPHABETS if is_one(c)), OTHER_SIGNS))


def word_cost(part: str) -> float | None:
    """Guesses for a dictionary word: its place, capitals, and signs in place of letters."""
    lower = part.lower()
    plain = lower.translate(LOOKS_LIKE)
    word = lower if lower in _RANK else plain
    if word not in _RANK or len(word) != len(part):
        return None
    capitals = sum(c.isupper() for c in part)
    usual = capitals in (0, len(part)) or (capitals == 1 and part[0].isupper())
    cost = math.log10(_RANK[word])
    if capitals:
        cost += math.log10(2) if usual else _choices(len(part), capitals)
    swapped = sum(a != b for a, b in zip(lower, word, strict=True))
    return cost + swapped * math.log10(2)


def date_cost(part: str) -> float:
    if len(part) == 4:
        return math.log10(YEARS)
    return math.log10(DAYS * YEARS) + (math.log10(SEPARATORS) if re.search(r"\D", part) else 0.0)


def walks(value: str) -> list[tuple[int, float]]:
    """For each end, where the longest walk along adjacent keys that ends there starts, and
    its guesses: where it starts, how long it is, where it turns, which keys are shifted."""
    keys = value.translate(SHIFTED).lower()
    found, start, turns, shifted, step = [], 0, 1, 0, None
    for i, c in enumerate(keys):
        if i and c in ADJACENT.get(keys[i - 1], ()):
            new = (PLACES[c][0] - PLACES[keys[i - 1]][0], PLACES[c][1] - PLACES[keys[i - 1]][1])
            turns += step is not None and new != step
            step = new
        else:
            start, turns, shifted, step = i, 1, 0, None
        shifted += value[i] != c
        n = i + 1 - start
        cost = math.log10(KEYS * n) + turns * math.log10(MOST_NEIGHBOURS)
        found.append((start if c in ADJACENT else i + 1, cost + _choices(n, shifted)))
    return found


def _choices(n: int, k: int) -> float:
    """Logarithm of the ways to choose which ``k`` of ``n`` characters are special."""
    return (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)) / math.log(10) if k else 0.0


def _plain_cost(value: str) -> float:
    """The cheapest segmentation into words and single characters."""
    best = [0.0]
    for end in range(1, len(value) + 1):
        cost = best[-1] + character_cost(value[end - 1])
        for start in range(max(0, end - LONGEST_WORD), end - 1):
            if (word := word_cost(value[start:end])) is not None:
                cost = min(cost, best[start] + word)
        best.append(cost)
    return best[-1]


def guess_cost(value: str) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation of a value takes.

    Spans that compete: a dictionary word; a date or year; the longest repeat of a block of
    at most ``LONGEST_PERIOD`` characters that ends at a place; the longest keyboard walk that
    ends there; and any single character.  The costs of the spans add up.
    """
    n = len(value)
    dates: dict[int, list[int]] = {}
    for start in range(n):
        for pattern in (DATE, YEAR):
            if m := pattern.match(value, start):
                dates.setdefault(m.end(), []).append(start)
    walked = walks(value)
    same = [0] * (LONGEST_PERIOD + 1)
    block_costs: dict[str, float] = {}
    best = [0.0]
    for end in range(1, n + 1):
        cost = best[-1] + character_cost(value[end - 1])
        for start in range(max(0, end - LONGEST_WORD), end - 1):
            if (word := word_cost(value[start:end])) is not None:
                cost = min(cost, best[start] + word)
        for start in dates.get(end, ()):
            cost = min(cost, best[start] + date_cost(value[start:end]))
        start, walk = walked[end - 1]
        if end - start >= SHORTEST_WALK:
            cost = min(cost, best[start] + walk)
        for period in range(1, min(LONGEST_PERIOD, end - 1) + 1):
            same[period] = same[period] + 1 if value[end - 1] == value[end - 1 - period] else 0
            if same[period] >= period:
                times = same[period] // period + 1
                block = value[end - period : end]
                if block not in block_costs:
                    block_costs[block] = _plain_cost(block)
                cost = min(cost, best[end - times * period] + block_costs[block] + math.log10(times))
        best.append(cost)
    return best[-1]


def classes(value: str) -> int:
    """How many of small letters, later capitals, digits and other signs a value mixes."""
    rest = value[1:]
    kinds = (value.lower() != value.upper(), rest != rest.lower() and rest != rest.upper(), any(map(str.isdigit, value)))
    return sum(kinds) + any(not c.isalnum() for c in value)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Of each fixed kind, the leftmost matches that don't overlap and are long enough."""
    return {
        kind: [m.span() for m in pattern.finditer(text) if m.end(part) - m.start(part) >= least]
        for kind, (pattern, part, least) in BASE.items()
    }


def guessed_spans(text: str, taken: list[tuple[int, int]], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Values next to credential words that are costly to guess and overlap nothing taken."""
    found = []
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        end -= len(m[1]) - len(m[1].rstrip(".:!?"))
        value = text[start:end]
        apart = not any(a < end and start < b for a, b in taken)
        if len(value) >= SHORTEST and apart and classes(value) >= CLASSES and guess_cost(value) >= threshold:
            found.append((start, end))
    return found


def _joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    listed = sorted((s, KINDS.index(k), e) for k, own in spans.items() for s, e in own)
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in listed)


def scan_text(text: str, threshold: float = THRESHOLD) -> tuple[int, int, int, str, str]:
    """``(n_assign, n_access, n_hex, base, spans)`` of one text."""
    base = base_spans(text)
    taken = [s for own in base.values() for s in own]
    every = {**base, GUESS: guessed_spans(text, taken, threshold)}
    return (*(len(base[k]) for k in BASE), _joined(base), _joined(every))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_spans, spans)`` of every row.

    Spans are ``kind:start:end`` in code points, by start and then kind, comma-joined.  Null
    texts count as empty and have no spans; repeated rows and null ids each get a row; other
    columns don't matter; texts and values are read whole, whatever their length.
    """
    ship_package(docs.sparkSession)
    fields = "n_assign long, n_access long, n_hex long, base_spans string, spans string"

    @F.pandas_udf(fields)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [scan_text(t, threshold) for t in texts]
            yield pd.DataFrame(found, columns=["n_assign", "n_access", "n_hex", "base_spans", "spans"])

    return docs.select("doc_id", of(text_of(docs)).alias("s")).select("doc_id", "s.*")


