"""BPE encoding by dynamic programming over prefixes, and decoding.

A word's BPE encoding has this property: cut after any token, what stands
before is the encoding of that prefix.  So every prefix of a word has a unique
last token, and one pass from left to right finds it: of the tokens that end
there, the one that is compatible with the last token of what stands before it.
Two tokens are compatible if merging their joint text gives back just them.
Following the last tokens back from the end emits the ids (van Antwerpen and
Neubeck, "Faster Linear-Time Byte Pair Encoding", published as open source).

The tokens that end at a place come from an automaton over the vocabulary whose
states are the tokens' prefixes and whose failure links are suffixes.  Here
every word ends in an end-of-word mark, one more symbol.

Normalising and splitting follow the tokenizer file: NFC, white space as one
blank, lower case character by character, then the file's word pattern.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import per_text, present

#: What a worker remembers at most: the ids of stretches without white space
#: of up to KNOWN_LENGTH characters, the latest so many and those before them,
#: and which pairs of tokens are compatible.
KNOWN_CHUNKS, KNOWN_LENGTH, KNOWN_PAIRS = 1 << 17, 40, 1 << 18
#: The symbol of a word's last byte is the byte's letter moved up by this.
_LAST = 1 << 16
_NEVER = 1 << 30

# Code points that newer Unicode versions call letters or numbers
# and the tokenizers library does not, as hexadecimal ranges.
NO_LETTERS = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf
10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3
187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6
1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed
1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
NO_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"
# Marks that newer Unicode versions reorder or join on
# normalising, and the tokenizers library leaves in place.
NO_MARKS = """
7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac
10efd-10eff 10f46-10f50 10f82-10f85 11070 1133b 1145e 11839-1183a 11930 1193d-1193e 11943 119e0 11a34
11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef
1e4ec-1e4ef
"""
# Capitals newer than Python's tables: first, last, offset of the small letter.
LATER_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1),
    (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)


def _set_of(ranges: str) -> str:
    """Hexadecimal ranges as the inside of a pattern's set."""
    ends = [(r.split("-")[0], r.split("-")[-1]) for r in ranges.split()]
    return "".join(f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for a, b in ends)


_LETTER = rf"[\p{{L}}--[{_set_of(NO_LETTERS)}]]"
_NUMBER = rf"[\p{{N}}--[{_set_of(NO_NUMBERS)}]]"
#: Capital letters whose lower case str.lower() has otherwise; no final sigma.
_LOWER = {c: c + d for a, b, d in LATER_CAPITALS for c in range(a, b + 1)} | {0x3A3: 0x3C3}
_OWN_LOWER = regex.compile("[" + "".join(map(chr, _LOWER)) + "]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself
    where it prints, else one from 256 up, in order."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(other)) for b in range(256)]


_OWN_MARKS = regex.compile(f"([{_set_of(NO_MARKS)}])")
#: Python splits at these; they are no white space to the tokenizers library.
_NO_SPACE = "\x1c\x1d\x1e\x1f"
_SPACES = regex.compile(r"\p{White_Space}+")


class SuffixAutomaton:
    """Finds, after each symbol of a word, all tokens that end there.

    A state is a prefix of a token: the longest one that the symbols so far end
    in.  ``ends`` has its tokens, longest first: those of the state itself and
    of its suffix states.  ``after`` has the transitions; those that fall back
    to a suffix are added when first taken.
    """

    def __init__(self, tokens: Iterable[tuple[str, int]]):
        self.after: list[dict[str, int]] = [{}]
        own: list[tuple[tuple[int, int], ...]] = [()]
        for symbols, token in tokens:
            at = 0
            for c in symbols:
                to = self.after[at].get(c)
                if to is None:
                    to = self.after[at][c] = len(own)
                    self.after.append({})
                    own.append(())
                at = to
            own[at] = ((len(symbols), token),)
        self.suffix = [0] * len(own)
        self.ends = own
        row = list(self.after[0].values())
        trie = [dict(x) for x in self.after]
        while row:  # by depth, so that suffixes are ready
            deeper = []
            for at in row:
                self.ends[at] = own[at] + self.ends[self.suffix[at]]
                for c, to in trie[at].items():
                    self.suffix[to] = self.step(self.suffix[at], c)
                    deeper.append(to)
            row = deeper

    def step(self, state: int, symbol: str) -> int:
        """The state after ``symbol``; keeps what it finds."""
        passed = []
        while (to := self.after[state].get(symbol)) is None and state:
            passed.append(state)
            state = self.suffix[state]
        to = to or 0
        for x in passed:
            self.after[x][symbol] = to
        return to


class _Known(dict):
    """The ids of chunks, made when first asked for.

    When it is full, it begins anew but still looks into what it had, so that
    common chunks are made once."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            ids = self.make(chunk)
        if len(chunk) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_CHUNKS:
                self.before = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class WordBpe:
    """BPE over bytes with end-of-word marks, as a tokenizer file (JSON text)
    describes it."""

    def __init__(self, spec_text: str):
        spec = json.loads(spec_text)
        self._read_steps(spec)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.mark: str = model["end_of_word_suffix"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added = added
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)))
        self.pieces = [""] * (1 + max([*vocab.values(), *added.values()]))
        for t, i in [*vocab.items(), *added.items()]:
            self.pieces[i] = t
        self.letters = byte_letters()

        #: Rank of the merge of two tokens; each token's own merge: rank, left and right part.
        self.rank: dict[tuple[int, int], int] = {}
        self.own: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right = vocab[a], vocab[b]
            self.rank[left, right] = r
            if self.own.setdefault(vocab[a + b], (r, left, right))[0] != r:
                raise ValueError("two merges make one token; this file needs another method")

        symbols = {i: self._symbols(t) for t, i in vocab.items()}
        self.length = {i: len(t) for i, t in symbols.items()}
        self.automaton = SuffixAutomaton(
            (t, i)
            for i, t in symbols.items()
            if i not in self.own or self.compatible(*self.own[i][1:], before=self.own[i][0])
        )
        self._known = _Known(self._chunk_ids)
        self._fits: dict[int, bool] = {}

    def _read_steps(self, spec: dict) -> None:
        """The word pattern, after a look that the file asks for no other
        steps than those built here."""
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (
            [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]
            or spec["decoder"] is not None
            or spec["post_processor"] is not None
            or (split["behavior"], split["invert"]) != ("Removed", True)
            or level["use_regex"]
            or level["add_prefix_space"]
            or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
            or spec["model"]["continuing_subword_prefix"]
            or spec["model"]["ignore_merges"]
        ):
            raise ValueError("this tokenizer file needs steps that are not built here")
        pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.word = regex.compile("(?V1)" + pattern.replace(r"\p{L}", _LETTER).replace(r"\p{N}", _NUMBER))

    def _symbols(self, token: str) -> str:
        """A token of the vocabulary as symbols, one for each byte."""
        if token.endswith(self.mark) and token != self.mark:
            body = token[: -len(self.mark)]
            return body[:-1] + chr(ord(body[-1]) + _LAST)
        return token

    def compatible(self, left: int, right: int, before: int = _NEVER) -> bool:
        """Whether merging the joint symbols of two tokens brings up just these
        two, side by side, before any merge of rank ``before``.

        Merges run by rank, equal ranks from left to right.  So undo the merges
        next to the seam, latest first; if the pair at the seam would have
        merged ahead of the merge just undone, the two tokens cannot stand.
        """
        rank, own = self.rank, self.own
        while True:
            if rank.get((left, right), _NEVER) < before:
                return False
            a, b = own.get(left), own.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                before, left = a[0], a[2]  # of equal pairs, the one further left came first
            else:
                before, right = b[0] + 1, b[1]  # here the seam is further left, so it would win

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word: the last token of every prefix, then back."""
        letters = list(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass")))
        letters[-1] = chr(ord(letters[-1]) + _LAST)
        last = [-1]
        fits, state, before, after, ends = self._fits, 0, 0, self.automaton.after, self.automaton.ends
        for end, letter in enumerate(letters, 1):
            state = after[state].get(letter)
            if state is None:
                state = self.automaton.step(before, letter)
            before = state
            for length, token in ends[state]:
                start = end - length
                if not start:
                    break
                pair = last[start] << 32 | token
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) >= KNOWN_PAIRS:
                        fits.clear()
                    fit = fits[pair] = self.compatible(last[start], token)
                if fit:
                    break
            last.append(token)
        length = self.length
        ids, at = [], len(letters)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return ids[::-1]

    def _normal(self, text: str) -> str:
        """NFC and lower case, each as the tokenizers library has it."""
        try:
            text.encode("latin-1")  # these are composed and have no later capitals
        except UnicodeEncodeError:
            if not unicodedata.is_normalized("NFC", text):
                text = "".join(unicodedata.normalize("NFC", part) for part in _OWN_MARKS.split(text))
            if _OWN_LOWER.search(text):
                text = text.translate(_LOWER)
        return text.lower()

    def _chunks(self, text: str) -> list[str]:
        """Stretches of a normal text between white space; no word has any."""
        if any(c in text for c in _NO_SPACE):
            return [chunk for chunk in _SPACES.split(text) if chunk]  # white space at an end leaves an empty one
        return text.split()

    def _ids_of(self, text: str) -> bytes:
        return b"".join(map(self._known.__getitem__, self._chunks(self._normal(text))))

    def _words(self, chunk: str) -> list[str]:
        if max(chunk) < "\u0100":  # the usual forms: a word, or a word and one sign
            if chunk.isalpha():
                return [chunk]
            if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return self.word.findall(chunk)

    def _chunk_ids(self, chunk: str) -> bytes:
        ids = []
        for word in self._words(chunk):
            ids += self.encode_word(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers;
        a null text is empty."""
        if not text:
            return b""
        out, at = [], 0
        if "<|" in text or not all(t.startswith("<|") for t in self.added):
            for m in self.special.finditer(text):
                out.append(self._ids_of(text[at : m.start()]))
                out.append(struct.pack("<I", self.added[m[0]]))
                at = m.end()
        return b"".join([*out, self._ids_of(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The tokens' pieces with a blank between; the file names no decoder."""
        return " ".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_made: dict[int, WordBpe] = {}


def _tokenizer(spec_text: str) -> WordBpe:
    """One tokenizer in each worker, whatever the number of tasks."""
    at = hash(spec_text)
    if at not in _made:
        _made.clear()
        _made[at] = WordBpe(spec_text)
    return _made[at]


def _shipped(docs: DataFrame, path: str):
    """The tokenizer file's text, read where the job starts and sent once to
    each executor; its size is checked."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if len(text) > 64 << 20:
        raise ValueError("a tokenizer file of over 64 MB is not sent to executors")
    return docs.sparkSession.sparkContext.broadcast(text)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key`` and ids (binary, little-endian
    unsigned 32-bit integers) of the whole text.

    A null text counts as empty and has no ids.  Other columns are not read;
    repeated rows are encoded each; an empty table gives no rows.
    """
    spec = _shipped(docs, path)
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("ids", T.BinaryType())])

    def make() -> Callable:
        bpe = _tokenizer(spec.value)
        return lambda cols: [cols[0], [bpe.encode(t) for t in cols[1]]]

    return per_text(docs, [present(docs, key, "long"), F.col(text).cast("string")], schema, make)


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: ``key`` and the text of its ids; null
    ids give an empty text.  Other columns are not read; an empty table gives
    no rows."""
    spec = _shipped(encoded, path)
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("text", T.StringType())])

    def make() -> Callable:
        bpe = _tokenizer(spec.value)
        return lambda cols: [cols[0], [bpe.decode(x or b"") for x in cols[1]]]

    return per_text(encoded, [present(encoded, key, "long"), F.col(ids)], schema, make)


def encoding_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, n_tokens, ids_sha256 and
    decoded_sha256, from encoding each whole text and decoding its ids.

    Null and empty texts have no ids and decode to an empty text; repeated rows
    are encoded each; an empty table gives no rows.
    """
    spec = _shipped(docs, path)
    schema = T.StructType(
        [
            T.StructField(key, T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def make() -> Callable:
        bpe = _tokenizer(spec.value)

        def f(cols):
            ids = [bpe.encode(t) for t in cols[1]]
            return [
                cols[0],
                [len(x) // 4 for x in ids],
                [hashlib.sha256(x).hexdigest() for x in ids],
                [hashlib.sha256(bpe.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids],
            ]

        return f

    return per_text(docs, [present(docs, key, "long"), F.col(text).cast("string")], schema, make)
