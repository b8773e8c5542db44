"""BPE encoding as a streaming transducer with bounded lookahead, and incremental decoding.

A tokenization is the merge list's own if every two neighbouring tokens are (Berglund and
van der Merwe 2023). So the last token of every prefix follows from at most the longest
token's length of earlier prefixes. The prefixes that a later symbol may still build on
form a tree; what they have in common is stable and is emitted at once. The waiting part is
bounded by the merge list, not by the text.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from tablewright.llm.arrays import batches

VOCABULARY = "word_bpe_49k.json"
# Distinct words kept with their tokens by one worker, about, borders kept, and the longest such word.
CACHED = 400_000
CACHED_BORDERS = 1 << 18
CACHED_LENGTH = 64
# Characters of a text cut into runs at once.
CHUNK = 1 << 16
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file states: tokens, merges, special strings, the word pattern and word end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model = stated["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.end = model.get("end_of_word_suffix") or ""
        self.letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in stated["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.by_decimal = {str(i): t for i, t in self.tokens.items()}
        pattern = next(p["pattern"]["Regex"] for p in stated["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(pattern)
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks: dict[tuple[int, int], int] = {}  # ids of a pair -> when the merges join it
        self.made = [(-1, -1, -1)] * (1 + max(self.ids.values(), default=-1))  # id -> (rank, left id, right id)
        for rank, (left, right) in enumerate(pairs):
            a, b, c = self.ids[left], self.ids[right], self.ids[left + right]
            self.ranks.setdefault((a, b), rank)
            if self.made[c][0] < 0:
                self.made[c] = rank, a, b
        # The longest token: a later symbol can replace no token border further back than this.
        self.lookahead = max((len(t.removesuffix(self.end)) for t in self.ids), default=1)
        self._borders: dict[int, bool] = {}
        self.known_border = self._borders.get
        # Tokens by their letters, for symbols inside a word and for its last one.
        self.inner = {t: i for t, i in self.ids.items() if not self.end or not t.endswith(self.end)}
        self.final = {t.removesuffix(self.end): i for t, i in self.ids.items() if t.endswith(self.end)} if self.end else self.ids

    def symbols(self, word: str) -> Iterator[str]:
        """First symbols of a word: one per byte, the last with the word end."""
        raw = word.encode("utf-8", "replace")
        yield from map(self.letters.__getitem__, raw[:-1])
        if raw:
            yield self.letters[raw[-1]] + self.end

    def merge(self, symbols: Iterable[str]) -> list[str]:
        """Merge until no listed pair is left: always the lowest rank, leftmost first."""
        out = list(symbols)
        while len(out) > 1:
            best = min(((self.ranks[p], i) for i, p in enumerate(zip(out, out[1:])) if p in self.ranks), default=None)
            if best is None:
                break
            i = best[1]
            out[i: i + 2] = [out[i] + out[i + 1]]
        return out

    def border(self, left: int, right: int) -> bool:
        """Do the merges leave a border between these two tokens?

        Both are taken apart again, the later merge first. The border falls if, before that
        merge came, the two pieces that touch would have been joined with each other.
        """
        key = left << 20 | right
        known = self._borders.get(key)
        if known is None:
            if len(self._borders) >= CACHED_BORDERS:
                self._borders.clear()
            known = self._borders[key] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        ranks, made, before = self.ranks, self.made, 1 << 60
        while True:
            if ranks.get((left, right), before) < before:
                return False
            a, b = made[left], made[right]
            if a[0] < 0 and b[0] < 0:
                return True
            if a[0] > b[0]:
                before, left = a[0], a[2]
            else:  # of equal merges the left one comes first
                before, right = b[0] + 1, b[1]


def short_word(vocabulary: Vocabulary, letters: str) -> list[int]:
    """What ``transduce`` emits for a word that fits its lookahead, without keeping a window."""
    inner, final, known_border, border = vocabulary.inner.get, vocabulary.final.get, vocabulary.known_border, vocabulary.border
    n = len(letters)
    last, back = [-1] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        known = inner if i < n else final
        for j in range(i - 1, -1, -1):
            token = known(letters[j:i])
            if token is not None:
                if j:
                    before = last[j]
                    good = known_border(before << 20 | token)
                    if good is None:
                        good = border(before, token)
                    if not good:
                        continue
                last[i], back[i] = token, j
                break
        else:
            raise ValueError(f"no token covers the end of {letters[:i]!r}")
    out = []
    while n:
        out.append(last[n])
        n = back[n]
    out.reverse()
    return out


def transduce(vocabulary: Vocabulary, symbols: Iterable[str]) -> Iterator[int]:
    """Token ids of one word from its symbols, each as soon as no later symbol can change it.

    A later token can only end on one of the last ``lookahead`` prefixes. Each prefix knows
    its last token and the prefix before it. Older prefixes stay only while one of those
    builds on them; where all of them agree, the tokens are emitted.
    """
    known, border, lookahead = vocabulary.ids.get, vocabulary.border, vocabulary.lookahead
    nodes: dict[int, tuple[int, int]] = {0: (-1, -1)}  # prefix length -> (prefix before its last token, that token)
    done, at, recent, next_look = 0, 0, "", 2 * lookahead
    for symbol in symbols:
        at += 1
        tail = symbol[1:]  # the word end, on the last symbol alone
        recent = recent[1 - lookahead:] + symbol[0]
        for width in range(1, min(len(recent), at - done) + 1):
            token = known(recent[-width:] + tail)
            if token is not None:
                before = nodes.get(at - width)
                if before and (before[0] < 0 or border(before[1], token)):
                    nodes[at] = at - width, token
                    break
        else:
            raise ValueError(f"no token covers the symbol {symbol!r}")
        if at >= next_look:
            reached, stable = {done}, None
            for leaf in range(max(done, at - lookahead), at + 1):
                path = []
                while leaf > done:
                    path.append(leaf)
                    leaf = nodes[leaf][0]
                reached.update(path)
                stable = set(path) if stable is None else stable.intersection(path)
            for done in sorted(stable):
                yield nodes[done][1]
            nodes = {k: v for k, v in nodes.items() if k >= done and k in reached}
            next_look = at + lookahead
    path = []
    while at > done:
        at, token = nodes[at]
        path.append(token)
    yield from reversed(path)


# White space of the pattern; str.split also splits at four control characters that are none.
_WHITE = regex.compile(r"[^\S\x1c-\x1f]+")
_ODD_WHITE = regex.compile(r"[\x1c-\x1f]")


def normalise(text: str) -> str:
    """Composed and in lower case, one character at a time; a run holds no white space."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    # str.lower turns a final sigma by its context; character by character it stays the same.
    return "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Pieces of about ``size`` characters that end before white space, which no word holds."""
    low = 0
    while len(text) - low > size:
        space = _WHITE.search(text, low + size)
        if space is None:
            break
        yield text[low: space.start()]
        low = space.start()
    yield text[low:]


class Recent:
    """A bounded cache in two halves; what the older half still serves moves to the newer one."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size // 2, {}, {}

    def put(self, key, value):
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value


class Encoder:
    """Tokens of texts, one run of other than white space at a time.

    No word reaches across white space, so a run's tokens do not depend on its place; those
    of short words are kept in a bounded cache.
    """

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._known = Recent(CACHED)

    def run(self, run: str) -> str:
        """Ids of a short run in normal form, in decimal, joined by spaces."""
        known = self._known.new.get(run)
        if known is not None:
            return known
        # All letters, or letters and one mark: the usual runs need no pattern.
        if run.isalpha():
            return self.word(run)
        if run[-1] in ".," and run[:-1].isalpha():
            return f"{self.word(run[:-1])} {self.word(run[-1])}"
        return " ".join(map(self.word, self.vocabulary.word.findall(run)))

    def word(self, word: str) -> str:
        known = self._known.new.get(word)
        if known is not None:
            return known
        known = self._known.old.get(word)
        if known is None:
            known = " ".join(map(str, self._stream(word)))
        return self._known.put(word, known) if len(word) <= CACHED_LENGTH else known

    def _stream(self, word: str) -> Iterable[int]:
        """Ids of a word of any length, each as soon as it is stable."""
        vocabulary = self.vocabulary
        if len(word) * 4 <= vocabulary.lookahead * 2:
            return short_word(vocabulary, "".join([vocabulary.letters[b] for b in word.encode("utf-8", "replace")]))
        return transduce(vocabulary, vocabulary.symbols(word))

    def pieces(self, text: str) -> Iterator[str]:
        """Ids of a text in order, in decimal, some at a time joined by spaces."""
        low = 0
        for hit in self.vocabulary.special_at.finditer(text) if self.vocabulary.special else ():
            yield from self._plain(text[low: hit.start()])
            yield str(self.vocabulary.special[hit[0]])
            low = hit.end()
        yield from self._plain(text[low:])

    def _plain(self, text: str) -> Iterator[str]:
        for part in chunks(text):
            part = normalise(part)
            runs = filter(None, _WHITE.split(part)) if _ODD_WHITE.search(part) else part.split()
            if len(part) <= 2 * CHUNK:
                yield from filter(None, map(self.run, runs))
                continue
            # A very long run: its ids are passed on as the transducer emits them.
            for run in runs:
                words = (w[0] for w in self.vocabulary.word.finditer(run))
                ids = (i for word in words for i in self._stream(word))
                while some := list(islice(ids, 1 << 12)):
                    yield " ".join(map(str, some))

    def ids(self, text: str) -> list[int]:
        return [int(i) for piece in self.pieces(text) for i in piece.split(" ")]


class Decoder:
    """Token ids to text, one at a time.

    ``plain`` follows a tokenizer file without a decoder: the tokens joined by spaces.
    Otherwise tokens turn into bytes and these into characters as soon as they are whole; a
    word end becomes a space. Bytes that no character can begin or go on with become U+FFFD.
    """

    def __init__(self, vocabulary: Vocabulary, plain: bool = True):
        self.vocabulary, self.plain, self._first = vocabulary, plain, True
        self._bytes = {letter: b for b, letter in enumerate(vocabulary.letters)}
        self._need, self._low, self._high, self._held = 0, 0x80, 0xBF, b""

    def feed(self, ids: list[str]) -> str:
        """Text of some more ids in decimal; as many calls of ``push``, but that a plain file's tokens are looked up at once."""
        if not self.plain:
            return "".join(map(self.push, map(int, ids)))
        out = " ".join(map(self.vocabulary.by_decimal.__getitem__, ids))
        if not ids or self._first:
            self._first = self._first and not ids
            return out
        return " " + out

    def push(self, token_id: int) -> str:
        token = self.vocabulary.tokens[token_id]
        if self.plain:
            out = token if self._first else " " + token
            self._first = False
            return out
        if token in self.vocabulary.special:
            return self.finish() + token
        end = bool(self.vocabulary.end) and token.endswith(self.vocabulary.end)
        body = token.removesuffix(self.vocabulary.end) if end else token
        out = "".join(self._byte(self._bytes[c]) for c in body)
        return out + self.finish() + " " if end else out

    def _byte(self, b: int) -> str:
        out = ""
        if self._need:
            if self._low <= b <= self._high:
                self._held += bytes([b])
                self._need, self._low, self._high = self._need - 1, 0x80, 0xBF
                if self._need:
                    return ""
                whole, self._held = self._held, b""
                return whole.decode("utf-8")
            out = self.finish()
        if b < 0x80:
            return out + chr(b)
        if 0xC2 <= b <= 0xF4:
            self._need, self._held = 1 + (b >= 0xE0) + (b >= 0xF0), bytes([b])
            self._low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
            self._high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            return out
        return out + "\ufffd"

    def finish(self) -> str:
        """What is left of an unfinished character."""
        left = "\ufffd" if self._need else ""
        self._need, self._low, self._high, self._held = 0, 0x80, 0xBF, b""
        return left


def decode(vocabulary: Vocabulary, ids: Iterable[int], plain: bool = True) -> str:
    decoder = Decoder(vocabulary, plain)
    return decoder.feed(list(map(str, ids))) + decoder.finish()


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker: its cache serves all tasks of the worker."""
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: ``RESULT``, and the ids themselves with ``with_ids``.

    ``path`` is a tokenizer file that every executor has. Each row is encoded by itself, so
    there is no shuffle and a lost task is simply run again. Repeated rows yield repeated
    results. A null or empty text, or one of white space alone, has no tokens and the digest
    of nothing. Very long texts are taken in chunks, and a run without white space that is
    longer than a chunk as a stream of symbols; the digests follow the ids as they come, that
    of the decoded text through ``Decoder``.
    Other columns of ``docs`` are not read.
    """
    columns = [c.split(" ")[0] for c in RESULT.split(", ")] + ["ids"] * with_ids

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        for frame in batches(frames, 512):
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                count, kept = 0, [np.empty(0, np.int32)]
                ids, decoded, decoder = hashlib.sha256(), hashlib.sha256(), Decoder(own.vocabulary)
                joint = ""
                parts = own.pieces(text if isinstance(text, str) else "")
                while block := list(islice(parts, 1 << 12)):
                    as_ids = " ".join(block)
                    some = as_ids.split(" ")
                    count += len(some)
                    ids.update((joint + as_ids).encode())
                    decoded.update(decoder.feed(some).encode("utf-8", "replace"))
                    joint = " "
                    if with_ids:
                        kept.append(np.fromiter(map(int, some), np.int32, len(some)))
                decoded.update(decoder.finish().encode())
                out.append((doc_id, count, ids.hexdigest(), decoded.hexdigest(), *([np.concatenate(kept)] if with_ids else [])))
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, RESULT + (", ids array<int>" if with_ids else ""))
