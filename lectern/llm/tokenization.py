"""Token counts and token ids of whole texts.

Both work word by word: a text falls into units at its single spaces, where no token can cross, and
each unit is worked out once a task.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrow import add_column
from lectern.llm.text import body

#: The split pattern of byte-level tokenizers, with white space spelt out.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A space beside other white space: no unit ends there.
CROWDED = re.compile(r"[ ][\s\x1c-\x1f\x85]|[\s\x1c-\x1f\x85][ ]")
#: White space besides spaces and line feeds: of ASCII, of all.
ODD_WHITE = re.compile(r"[\t\x0b-\r]")
RARE_WHITE = re.compile(r"[^\S \n]")
#: Units remembered in a Python worker, and the longest that are.
MEMORY, LONGEST = 800_000, 64
#: Words of letters that neither lower-casing nor composition changes in number.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")


class Remembered(dict):
    """Values by short unit, made when first asked for; forgets all when full."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, unit):
        value = self.make(unit)
        if len(unit) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[unit] = value
        return value


def byte_alphabet() -> list[str]:
    """A character for each byte: printable ones stand for themselves, the other bytes for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """How many tokens byte-pair merging leaves of a text.  No token ids are made."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.ranks = {(a, b): r for r, (a, b) in enumerate(spec["model"]["merges"])}
        self.symbol = byte_alphabet()
        self.after_space = Remembered(lambda unit: self.segments(f" {unit}"))
        self.pieces = Remembered(self.merged)

    def count(self, text: str) -> int:
        if "  " in text or CROWDED.search(text):
            return self.segments(text)
        head, *tail = text.split(" ")
        return self.segments(head) + sum(map(self.after_space.__getitem__, tail))

    def segments(self, text: str) -> int:
        """Special strings count as one token each and part the text around them."""
        parts = re.split("|".join(self.special), text) if self.special else [text]
        return len(parts) - 1 + sum(self.pieces[m] for p in parts for m in BYTE_LEVEL.findall(p))

    def merged(self, piece: str) -> int:
        """Initial symbols less merges: a heap gives the lowest-ranked adjacent pair, linked lists the neighbours."""
        symbols = [self.symbol[b] for b in piece.encode()]
        n, ranks = len(symbols), self.ranks
        before, after = [*range(-1, n - 1)], [*range(1, n), -1]
        heap = [(ranks[pair], i, *pair) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in ranks]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = a + b, None
            after[i] = after[j]
            merges += 1
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (rank := ranks.get((symbols[left], symbols[right]))) is not None:
                    heapq.heappush(heap, (rank, left, symbols[left], symbols[right]))
        return n - merges


class Encoder:
    """Ids by the tokenizers library, as little-endian unsigned 32-bit bytes.

    Plain words go straight to the library's model, as normalizing and splitting leave them whole; all
    other units go through all of it, in lots.
    """

    LOT_CHARS = 4 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # Where the split pattern drops white space, every word stands alone and in lower case; else it
        # carries the space before it.
        self.drops_white = spec["pre_tokenizer"]["type"] == "Sequence"
        alphabet = byte_alphabet()
        self.letters = dict(enumerate(alphabet))
        self.space = "" if self.drops_white else alphabet[ord(" ")]
        # Units of late and those before them: what is asked for again outlives the rest.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        *ends, self.line = self.library([".", ",", "\n"])
        self.ends = dict(zip(".,", ends, strict=True))

    def library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [_packed(e.ids) for e in found]

    def word(self, word: str, space: str) -> bytes:
        """A plain word in the byte alphabet, through the model."""
        if self.drops_white:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.model.tokenize(space + word)])

    def learn(self, units: list[str]) -> None:
        """Ids of new units.  One that starts with a line feed has that and no space before it.

        A word with one full stop or comma behind it is made of the ids of both: no token spans them.
        """
        known, older, odd, ends, line, space = self.known, self.older, [], self.ends, self.line, self.space
        for u in units:
            if u in older:
                known[u] = older[u]
                continue
            before, stem, room = (line, u[1:], "") if u[:1] == "\n" else (b"", u, space)
            end = ends.get(stem[-1:], b"")
            bare = stem[:-1] if end else stem
            if not (bare.isalpha() if bare.isascii() else PLAIN.match(bare)):
                odd.append(u)
            elif not end:
                known[u] = before + self.word(stem, room)
            else:
                base = u[:-1]
                ids = known.get(base) or older.get(base)
                if ids is None:
                    ids = known[base] = before + self.word(bare, room)
                known[u] = ids + end
        spaced = [u if u[:1] == "\n" or self.drops_white else f" {u}" for u in odd]
        known.update(zip(odd, self.library(spaced), strict=True))

    def ids(self, texts: list[str | None], end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has; a null has none.

        With ``end`` the id 0 follows each text.
        """
        lots, lot, size = [], [], 0
        for text in texts:
            lot.append(text)
            size += len(text or "")
            if size > self.LOT_CHARS:
                lots.append(self._lot(lot))
                lot, size = [], 0
        lots.append(self._lot(lot))
        flat, counts = (np.concatenate(x) for x in zip(*lots, strict=True))
        if not end:
            return flat, counts
        counts = counts + 1
        closed = np.zeros(counts.sum(), "<u4")
        inner = np.ones(len(closed), bool)
        inner[np.cumsum(counts) - 1] = False
        closed[inner] = flat
        return closed, counts

    def parted(self, text: str) -> str | None:
        """The text with its units between single spaces; none if spaces or line feeds meet other white space there."""
        if self.drops_white:
            return text.replace("\n", " ") if not ODD_WHITE.search(text) else b" ".join(text.encode().split()).decode()
        if any(x in text for x in ("  ", " \n", "\n ", "\n\n")):
            return None
        if any(x in text for x in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f") or not text.isascii() and RARE_WHITE.search(text):
            return None
        # A line feed before the text stands for its start, where there is no space either.
        return f"\n{text.replace('\n', ' \n')}"

    def _lot(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        plain = [self.parted(t) if t else None for t in texts]
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        # Arrow numbers the units of the lot; Python sees each of them once.
        lists = pc.split_pattern(pa.array([p for p in plain if p is not None], pa.string()), " ")
        units = lists.values.dictionary_encode()
        names, which, offsets = units.dictionary.to_numpy(zero_copy_only=False), units.indices.to_numpy(), lists.offsets.to_numpy()
        found = [*map(self.known.get, names)]
        if new := [k for k, ids in enumerate(found) if ids is None]:
            self.learn([names[k] for k in new])
            for k in new:
                found[k] = self.known[names[k]]
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        many, begins = sizes[which], (np.cumsum(sizes) - sizes)[which]
        if not self.drops_white:  # without the line feed before each text
            many[offsets[:-1]] -= 1
            begins[offsets[:-1]] += 1
        ends = np.cumsum(many)
        flat = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - many), many)]
        edges = np.concatenate([[0], ends])[offsets]
        if len(plain) == len(edges) - 1:
            return flat, np.diff(edges)
        pieces, regular = [], iter(np.split(flat, edges[1:-1]) if len(edges) > 1 else [])
        for text, p in zip(texts, plain, strict=True):
            pieces.append(next(regular) if p is not None else np.frombuffer(self.library([text])[0] if text else b"", "<u4"))
        return np.concatenate([flat[:0], *pieces]), np.fromiter(map(len, pieces), np.int64, len(pieces))


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()  # four bytes an id, little-endian on all machines that Spark runs on


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps what it has learnt from task to task."""
    return Encoder(path)


@cache
def merge_counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), a row for each row of ``docs``.

    A null text is empty and has no tokens.  Other columns are left behind.  An empty table gives no rows.
    """

    def make():
        count = merge_counter(tokenizer_path(tokenizer)).count
        return lambda texts: pa.array([count(t) if t else 0 for t in texts], pa.int64())

    sized = docs.select("doc_id", F.octet_length(body()).cast("long").alias("n_bytes"), "text")
    counted = add_column(sized, make, "n_tokens", "long", keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
