"""Secret scans: fixed patterns, and values in credential contexts that are costly to guess."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from dwellspark.llm.rows import column

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A match that is shorter fails as a whole, so these find the same as matching first and dropping then.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS, LEAST_VALUE = ("password", "passwd", "secret", "token", "apikey", "api_key"), 12

#: Names before a value; wider than those of ``ASSIGN``.
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "login")
CONTEXT = re.compile(
    r"""\b(?:\w*(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)"""
    r"""|pass|auth|authorization|bearer|credentials?|login)["']?\s{0,8}(?:=>|[:=])\s{0,8}(?:bearer\s{1,8}|basic\s{1,8})?["']?([^\s"'<>,;]{6,})""",
    re.I | re.A,
)
#: A value is a secret from this many guesses on, as a power of ten.
LEAST_COST = 8.0

# Common parts of passwords, the most common first.
COMMON = (
    "password pass admin root user login secret token welcome letmein qwerty dragon monkey master shadow sunshine "
    "princess football baseball superman batman hello love freedom whatever trust hunter ranger summer winter spring "
    "autumn monday friday january march april june july august september october november december test testing "
    "demo example sample default change changeme changeit your here none null value string key name email guest "
    "server system service access account company office manager public private internal local data info the and "
    "for this that with from not you are have word code home house star blue red green black white money computer "
    "internet soccer hockey killer pepper ginger cookie flower tiger lion bear eagle"
).split()
# Letters, each with those that often follow it in words of languages in Latin script.
FOLLOWERS = (
    "abcdefgijklmnopqrstuvyz baeilorsuy cacehiklortuyz dadeijlosu eabcdefghijlmnpqrstuvwxy faefiloruy gaeghilnorsu "
    "haeilnort iabcdefgjlmnoprstvxz jaou keistu ladeijlopstuyz mabeimopsu nacdefgijlnostuvyz oabcdefgijklmnoprstuvw "
    "paehiloprstu qu racdefgiklmnoprstuvwyz sacehiklopstuwyz tacdehilorstuyz uabcdegilmnprst vaeio waehior xceiptx "
    "yinpst zaeuw"
).split()
#: Guesses for any word of a dictionary, as a power of ten; and the fewest letters that are taken for one.
WORD_COST, LEAST_WORD = 6.0, 5
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4301!5$7", "aaeoiisst")

DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:[0-2]?\d|3[01]))?)?|(?:[0-2]?\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d")
#: The longest word or repeated block that is looked for; of longer walks and runs only the whole counts.
LONGEST = 16


@lru_cache
def _neighbours() -> frozenset[tuple[str, str]]:
    """Keys next to each other, and followers in the alphabet and among digits."""
    at = {key: (x, y) for y, row in enumerate(ROWS) for x, key in enumerate(row)}
    near = {(a, b) for a, (x, y) in at.items() for b, (u, v) in at.items() if a != b and abs(x - u) <= 1 and abs(y - v) <= 1}
    letters = "abcdefghijklmnopqrstuvwxyz"
    follow = {pair for run in (letters, letters[::-1], "0123456789", "9876543210") for pair in zip(run, run[1:])}
    return frozenset(near | follow)


@lru_cache
def _words(words: tuple[str, ...]) -> dict[str, int]:
    return {word: rank for rank, word in enumerate(words, 1)}


def _any_cost(char: str) -> float:
    """Brute force: the size of the character's class."""
    return math.log10(10 if char.isdigit() else 26 if char.isalpha() else 33)


def _sizes(least: int, most: int) -> list[int]:
    """Lengths a segment may have: all up to ``LONGEST``, and the longest."""
    return [*range(least, min(most, LONGEST) + 1), *([most] if most > LONGEST else [])]


def guess_cost(value: str, words: tuple[str, ...] = tuple(COMMON)) -> float:
    """Power of ten of the guesses for the cheapest way to put the value together.

    ``cost[i]`` is that of the first i characters: the least, over the last segment, of what
    is before it plus the segment's own guesses. Segments are common words (by rank; doubled
    for capitals and for signs in place of letters), letters that read like a word of any dictionary
    (one case or a capital first, at most one pair of neighbours that is rare in words; other scripts than
    Latin have none), dates and years, repeated blocks, walks over neighbouring keys or along the
    alphabet, and single characters by brute force. Each segment doubles the guesses. Of walks, runs,
    repetitions and words, those of up to ``LONGEST`` characters and the longest that ends at a place are tried, so
    time is linear in the length.
    """
    ranks, near = _words(words), _neighbours()
    low = value.lower()
    plain, n = low.translate(LEET), len(value)
    cost = [0.0] + [math.inf] * n
    walk = run = 1
    follow, letters = _follow(), 0
    upper, lower, rare = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)  # sums over the first i characters, and pairs in them
    join = math.log10(2)
    ends: dict[int, list[tuple[int, float]]] = {}
    for match in DATE.finditer(low):
        for start in range(match.start(), match.end()):
            found = DATE.match(low, start, match.end())
            if found and found.end() - start >= 4:
                ends.setdefault(found.end(), []).append((start, math.log10(120 if found.end() - start == 4 else 36_500)))
    # A block of up to LONGEST characters that comes again: ends of the repetition, by block length.
    same = [0] * (LONGEST + 1)
    for i in range(1, n + 1):
        best = cost[i - 1] + _any_cost(value[i - 1]) + (join if i > 1 and value[i - 1].isalnum() != value[i - 2].isalnum() else 0)
        if i > 1:
            walk = walk + 1 if (low[i - 2], low[i - 1]) in near else 1
            run = run + 1 if low[i - 2] == low[i - 1] else 1
        char = value[i - 1]
        letters = letters + 1 if char.isalpha() else 0
        upper[i], lower[i] = upper[i - 1] + char.isupper(), lower[i - 1] + char.islower()
        pair = low[i - 2 : i] if i > 1 else ""
        rare[i] = rare[i - 1] + (len(pair) == 2 and pair.isascii() and pair not in follow)
        for size in _sizes(LEAST_WORD, letters):
            start = i - size
            one_case = upper[i] - upper[start + 1] == 0 or lower[i] - lower[start] == 0
            if one_case and rare[i] - rare[start + 1] <= 1:
                best = min(best, cost[start] + WORD_COST + join)
        for size in _sizes(3, walk):
            best = min(best, cost[i - size] + math.log10(47 * size) + join)
        for size in _sizes(3, run):
            best = min(best, cost[i - size] + _any_cost(value[i - 1]) + math.log10(size) + join)
        for size in range(2, min(LONGEST, i - 1) + 1):
            same[size] = same[size] + 1 if i > size and low[i - 1] == low[i - 1 - size] else 0
            for more in _sizes(size, same[size]):  # the block's first showing ends where these begin
                best = min(best, cost[i - more] + math.log10(more // size + 1) + join)
        for start in range(max(0, i - LONGEST), i - 2):
            part = plain[start:i]
            if part in ranks:
                own = value[start:i]
                extra = (own != own.lower()) + (low[start:i] != part)
                best = min(best, cost[start] + math.log10(ranks[part] + 1) + extra * join + join)
        for start, own in ends.get(i, ()):
            best = min(best, cost[start] + own + join)
        cost[i] = best
    return cost[n]


def spans(text: str, least_cost: float = LEAST_COST) -> list[tuple[int, int, int]]:
    """``(start, kind's place in KINDS, end)`` of all finds in a whole text, sorted; in code points."""
    low, found = text.lower(), []
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    taken = [(start, end) for start, _, end in found]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(word in low for word in CONTEXT_WORDS):
        base = 0
        for m in CONTEXT.finditer(text):
            start, end = m.span(1)
            while base < len(taken) and taken[base][1] <= start:
                base += 1
            inside = base < len(taken) and taken[base][0] < end
            word = m[1].rstrip(".:!?)")  # what follows a colon may be prose
            if not inside and guess_cost(word if word.isalpha() else m[1]) >= least_cost:
                found.append((start, 3, end))
    return sorted(found)


@lru_cache
def _follow() -> frozenset[str]:
    return frozenset(x[0] + y for x in FOLLOWERS for y in x[1:])


def secret_scan(
    docs: DataFrame, least_cost: float = LEAST_COST, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """A row per document: its id, ``n_assign, n_access, n_hex, n_guess, base_sha256, spans``.

    ``assign``, ``access`` and ``hex`` are the base patterns; ``guess`` is a value in a
    credential context, outside those, that takes 10^``least_cost`` guesses or more, be it
    of letters or digits only; a lone word takes ``WORD_COST`` and so is none. ``spans`` lists ``kind:start:end`` (code points, end
    exclusive) by start, then kind, comma-joined; ``base_sha256`` is of the same list without
    ``guess``. NULL and empty texts have none. Repeated rows and rows without id are scanned
    each; empty tables give no rows; other columns are not read.

    Scanned in Arrow batches without a shuffle. Finding nothing is the usual case, so cheap
    searches for words go before the patterns that need them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = spans(text.as_py() or "", least_cost)
                said = [f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found]
                base = ",".join(x for x, f in zip(said, found) if f[1] < 3)
                numbers = [sum(f[1] == kind for f in found) for kind in range(4)]
                rows.append((*numbers, sha256(base.encode()).hexdigest(), ",".join(said)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch["id"], *map(pa.array, columns, kinds)], ["id", *made])

    made = ["n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]
    wanted = docs.select(column(id_column).alias("id"), column(text_column).alias("text"))
    schema = f"id {wanted.schema['id'].dataType.simpleString()}, " + ", ".join(map(" ".join, zip(made, ["bigint"] * 4 + ["string"] * 2)))
    return wanted.mapInArrow(run, schema).withColumnRenamed("id", id_column)
