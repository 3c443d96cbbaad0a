"""Secret scans: fixed patterns, and a guess-cost search of credential values.

Three patterns find spans that look like secrets by form alone: an assignment
to a credential name, an access key, a long hexadecimal run.  Values that
follow a credential word but that no pattern caught whole are judged by what it
would cost to guess them: a dynamic programme finds the cheapest way to cut the
value into known words, dates, repeats, keyboard walks and brute-force
characters (after Wheeler, "zxcvbn: Low-Budget Password Strength Estimation").
A quoted value ends at its closing quote; Bearer, Basic or Token before it is
not part of it.  A value that costs at least 2**MIN_BITS guesses is a secret; an
everyday word is not, nor a reference that names where a secret is kept.

The known words are a parameter, most common first: the few hundred of WORDS, or
with ``ranked_words`` those and the words of a vocabulary file, whose order
tells how common they are.

The search is linear in a value's length, and stops where the cost of every
way to go on has passed the limit.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import per_text, present, with_texts

#: The kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "guess")

# The patterns of the three base kinds.
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16

#: Words before a value that the guess cost judges.
WORD = (
    r"""(?ai:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|"""
    r"""(?:api|access|private|client|secret|auth|signing|encryption|master)[_\-]?(?:key|secret|token))"""
    r"""(?:[_\-](?:key|secret|token|value))*)["']?\x20*[:=]\x20*"""
)
#: A word that names how a value is used, not part of it.
SCHEME = r"(?:(?ai:bearer|basic|token)[\x20\t]+)?"
#: A line break inside quotes; a quote that its paragraph leaves open is none.
BREAK = r"\\?\n(?![\x20\t]*\n)"
#: The value is one group of three: to the closing double or single quote
#: (an apostrophe within a word closes nothing), or what stands without quotes.
CONTEXT = (
    rf"""{WORD}{SCHEME}(?:"{SCHEME}((?:[^"\\\n]|\\[^\n]|{BREAK}){{6,}}+)\""""
    rf"""|'{SCHEME}((?:[^'\\\n]|(?<=\w)'(?=\w)|\\[^\n]|{BREAK}){{6,}}+)'"""
    rf"""|["']?{SCHEME}([^\s"'<>,;]{{6,}}))"""
)
#: A value of one of these forms only says where a secret is kept, or hides it.
REFERENCE = (
    r"(?:\$\{[\w.]+\}|\$\([^()]*\)|\{\{[\w\s.|\-]*\}\}|\{\w*\}|%\w+%|%\(\w+\)s|\$[A-Z]+(?:_[A-Z0-9]+)*|<[^<>]*>"
    r"|(?:os\.environ|process\.env|env|secrets|vars|config)[.\[(][\w.\[\]()'\"]*|(?:os\.)?getenv\([^()]*\)|[xX*.\u2022_\-]+)[.:)\]}]*"
)
MIN_BITS = 38.0
#: Known words at most, as many are sent to every executor; and characters of one.
MOST_WORDS, LONGEST_WORD = 1 << 17, 24

_ASSIGN, _ACCESS, _HEX, _CONTEXT, _REFERENCE = map(re.compile, (ASSIGN, ACCESS, HEX, CONTEXT, REFERENCE))
#: RE2 tells, in one pass over a batch, which texts can hold a span at all.
_MAYBE = (
    r"""(?i:password|passwd|secret|token|api_?key|pass|pwd|credential|auth"""
    r"""|(?:api|access|private|client|signing|encryption|master)[_\-]?key)[a-zA-Z_\-]*["']?\x20*[:=]|AKIA|[0-9a-f]{16}"""
)

# Common words in passwords, most common first; the place is the guess cost.
WORDS = """
password admin login welcome letmein monkey dragon master qwerty abc secret token test user guest root
default change changeme example sample dummy placeholder your here none null true false value string
insert replace enter todo foo bar baz love sun moon star shadow summer winter spring football
baseball hockey soccer batman superman princess michael jennifer jordan hunter ranger buster thomas
robert george charlie andrew daniel joshua ashley nicole jessica amanda flower cookie banana orange
purple yellow silver golden diamond computer internet server system database oracle mysql postgres
service account private public access key api client auth pass word code phrase trust no one hello
world freedom whatever killer pepper ginger cheese coffee chocolate tiger eagle falcon phoenix
""".split()
# Rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")

_LEET = str.maketrans("@4310$5!7", "aaeiossit")
_NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in ROWS for a, b in zip(row, row[1:])}
_LONGEST_DATE = 10
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?\d\d[-/._]?\d\d|\d{1,2}[-/._]\d{1,2}[-/._](?:19|20)?\d\d|(?:19|20)\d\d")


def _char_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    if c in "_-.":
        return 2.0  # the usual separators
    if c.isascii() and c.isalpha():
        return math.log2(26)
    return math.log2(33) if c.isascii() else math.log2(100)


def _runs(value: str, lower: str) -> dict[int, list[tuple[int, float]]]:
    """Maximal repeats of units of 1 to 4 characters and keyboard walks, by
    their start."""
    found: dict[int, list[tuple[int, float]]] = {}
    n = len(value)
    for unit in range(1, 5):
        start = 0
        for i in range(unit, n + 1):
            if i == n or value[i] != value[i - unit]:
                if i - start >= max(3, 2 * unit):
                    cost = sum(map(_char_bits, value[start : start + unit])) + math.log2((i - start) / unit)
                    found.setdefault(start, []).append((i, cost))
                start = i - unit + 1
    start = 0
    for i in range(1, n + 1):
        if i == n or (lower[i - 1], lower[i]) not in _NEXT:
            if i - start >= 4:
                found.setdefault(start, []).append((i, math.log2(len(ROWS) * 10) + math.log2(i - start)))
            start = i
    return found


class Guesses:
    """What values cost to guess for one who knows ``words``, most common first."""

    def __init__(self, words: Sequence[str] = WORDS):
        self.rank = {w: i + 1 for i, w in reversed(list(enumerate(words)))}
        self.longest = max(map(len, self.rank), default=1)
        self.bits = lru_cache(maxsize=4096)(self._bits)

    def _segments(self, value: str, at: int, lower: str, plain: str) -> Iterator[tuple[int, float]]:
        """Ends and costs in bits of the pieces that start at ``at``: words,
        dates, and one brute-force character."""
        n = len(value)
        yield at + 1, _char_bits(value[at])
        for end in range(at + 3, min(n, at + self.longest) + 1):
            rank = self.rank.get(lower[at:end])
            swapped = 0.0
            if rank is None:
                rank = self.rank.get(plain[at:end])
                swapped = 1.0
            if rank is not None:
                piece = value[at:end]
                usual = piece.isupper() or piece[:1].isupper() and piece[1:].islower()
                yield end, math.log2(rank + 1) + swapped + (0.0 if piece == lower[at:end] else 1.0 if usual else 2.0)
        if value[at].isdigit():
            m = _DATE.match(value, at)
            if m:
                # a day of two centuries in one of a few forms, or a year alone
                yield m.end(), math.log2(200 if m.end() - at == 4 else 73050 * 4)

    def _bits(self, value: str, limit: float = math.inf) -> float:
        """log2 of the guesses for the cheapest segmentation of ``value``, a bit
        more for each piece after the first; or some number of at least
        ``limit`` if that cost is."""
        n = len(value)
        if not n:
            return 0.0
        lower = value.lower()
        if len(lower) != n:  # a few letters change their length
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        plain = lower.translate(_LEET)
        runs = _runs(value, lower)
        best = [0.0] + [math.inf] * n
        reach = 0  # the furthest end of a repeat or walk that was begun
        longest = max(self.longest, _LONGEST_DATE)
        for at in range(n):
            base = best[at] + (1.0 if at else 0.0)
            for end, cost in self._segments(value, at, lower, plain):
                best[end] = min(best[end], base + cost)
            for end, cost in runs.get(at, ()):
                best[end] = min(best[end], base + cost)
                reach = max(reach, end)
            # every way on starts at one of the last places that a word can reach from, or in a longer run
            if at >= reach and at >= longest and min(best[at - longest + 1 : at + 2]) >= limit:
                return limit
        return best[n]


def ranked_words(path: str, least: int = 4) -> list[str]:
    """WORDS, then the words of ``least`` or more letters of a vocabulary file
    (a tokenizer's JSON with end-of-word marks) in its order, which is that of
    how often merges were found: the more common, the earlier."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    mark, vocab = model["end_of_word_suffix"], model["vocab"]
    own = (t.removesuffix(mark) for t in sorted(vocab, key=vocab.get) if t.endswith(mark))
    words = [w for w in own if least <= len(w) <= LONGEST_WORD and w.isascii() and w.isalpha()]
    return list(dict.fromkeys([*WORDS, *words]))


_FEW = Guesses()


def spans_of(text: str | None, guesses: Guesses = _FEW) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span of a whole text, by start, then kind;
    code points, ends exclusive.  A null text has none."""
    if not text:
        return []
    found = []
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_VALUE:
            found.append((m.start(), m.end(), 0))
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text) if m.end() - m.start() >= HEX_LENGTH]
    base = sorted(found)
    starts, reach = [s for s, _, _ in base], [0, *accumulate((e for _, e, _ in base), max)]
    for m in _CONTEXT.finditer(text):
        a, b = m.span(m.lastindex)
        inside = b <= reach[bisect_right(starts, a)]  # of the spans that begin no later, the one that ends last
        value = m[m.lastindex]
        if not inside and not _REFERENCE.fullmatch(value) and guesses.bits(value, MIN_BITS) >= MIN_BITS:
            found.append((a, b, 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _maybe(texts: list[str | None]) -> list[bool]:
    got = pc.match_substring_regex(pa.array(texts, pa.large_string()), _MAYBE)
    return pc.fill_null(got, False).to_pylist()


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _shipped(docs: DataFrame, words: Sequence[str]) -> Callable[[], Guesses]:
    """What makes a task's Guesses; the words are sent once to each executor,
    and their number is checked."""
    if len(words) > MOST_WORDS or any(len(w) > LONGEST_WORD for w in words):
        raise ValueError(f"at most {MOST_WORDS} words of at most {LONGEST_WORD} characters are sent to executors")
    sent = docs.sparkSession.sparkContext.broadcast(list(words))
    return lambda: Guesses(sent.value)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", words: Sequence[str] = WORDS) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_assign, n_access, n_hex,
    base_sha256, spans, n_guess.

    base_sha256 is the hash of the base spans as kind:start:end, joined by
    commas; ``spans`` lists all spans, those of the guess cost included, for one
    who knows ``words``, most common first.  A null text counts as empty.  Other columns are not read; repeated rows are
    scanned each; an empty table gives no rows.
    """
    schema = T.StructType(
        [T.StructField(key, T.LongType())]
        + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]]
        + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
        + [T.StructField("n_guess", T.LongType())]
    )

    guesses_of = _shipped(docs, words)

    def make() -> Callable:
        guesses = guesses_of()

        def f(cols):
            out = [cols[0], [], [], [], [], [], []]
            for text_, maybe in zip(cols[1], _maybe(cols[1])):
                spans = spans_of(text_, guesses) if maybe else []
                base = [x for x in spans if x[2] != "guess"]
                for i, kind in enumerate(KINDS[:3]):
                    out[1 + i].append(sum(x[2] == kind for x in base))
                out[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out[5].append(_joined(spans))
                out[6].append(len(spans) - len(base))
            return out

        return f

    return per_text(docs, [present(docs, key, "long"), F.col(text).cast("string")], schema, make)


def redacted(text: str | None, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str | None:
    """``text`` with each stretch that spans cover, alone or together, as
    ``mark``; an assignment keeps nothing either."""
    if not spans or text is None:
        return text
    out, at, end = [], 0, -1
    for s, e, _ in spans:
        if s >= end:
            out += [text[at:s] if end < 0 else text[end:s], mark]
        end = max(end, e)
    return "".join(out) + text[end:]


def redact_secrets(docs: DataFrame, text: str = "text", length: str = "n_chars", words: Sequence[str] = WORDS) -> DataFrame:
    """``docs`` with secrets replaced in the whole texts, all rows and columns
    kept; ``length``, where present, is set anew.  Null texts stay null; repeated
    rows are searched each; an empty table gives no rows."""
    guesses_of = _shipped(docs, words)

    def make() -> Callable:
        guesses = guesses_of()

        def f(texts):
            return [redacted(t, spans_of(t, guesses)) if m else t for t, m in zip(texts, _maybe(texts))], None

        return f

    return with_texts(docs, text, make, length)
