"""Encoding whole texts with a public tokenizer, each distinct piece once."""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .shingles import arrow_bytes, hashed_spans, runs

#: Fixed values, as the tokenizer file has them: all that decides how a text is cut before its model sees it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Added tokens have this in them; a text with it is left to the library.
MARK = "<|"

#: Kinds of bytes in lower-cased plain text: 0 white space, 1 letters, 2 digits, 3 all else, 4 what plain text hasn't.
_KIND = np.full(256, 4, np.uint8)
_KIND[[9, 10, 32]] = 0
_KIND[0x21:0x7F] = 3
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[ord("a") : ord("z") + 1] = 1
#: Letters of Latin-1: this byte, then another; two of them are the signs of times and division, which plain text hasn't.
_LATIN, _LATIN_SIGNS = 0xC3, (0x97, 0xB7)
_KIND[[_LATIN, *range(0x80, 0xC0)]] = 1
#: Chunks a worker remembers, the longest such, pieces it remembers and the ids they have.
CACHE_CHUNKS, CACHE_LENGTH, CACHE_PIECES, CACHE_IDS = 20_000, 48, 500_000, 5_000_000


class _Memory(dict):
    """A dictionary of two generations: what is asked for again lives on when the older one goes."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most // 2, {}

    def age(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


class _Pieces:
    """Ids of pieces by 64-bit hash, in an open table; when it is full, pieces that only one run of rows had go."""

    SLOTS = 1 << 20

    def __init__(self, dtype):
        self.dtype = dtype
        self.clear()

    def shrink(self) -> None:
        used = np.flatnonzero(self.keys)
        at = self.at[used]
        again = self.runs[at] > 1
        keys, at = self.keys[used][again], at[again]
        ids, count = self.ids_of(at)
        self.clear()
        if len(keys) <= CACHE_PIECES // 2 and len(ids) <= CACHE_IDS // 2:
            self.add(keys, ids, count)

    def clear(self) -> None:
        self.keys, self.at = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
        self.first, self.count, self.runs = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids, self.used, self.known = np.zeros(4096, self.dtype), 0, 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's number, -1 for unknown ones."""
        out = np.full(len(h), -1, np.int64)
        rest, slot = np.arange(len(h)), (h >> np.uint64(44)).astype(np.int64)
        while len(rest):
            key = self.keys[slot]
            hit = key == h[rest]
            out[rest[hit]] = self.at[slot[hit]]
            on = ~hit & (key != 0)
            rest, slot = rest[on], (slot[on] + 1) & (self.SLOTS - 1)
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Distinct unknown hashes, all their ids in a row, and how many each has."""
        grown = lambda x, n: x if n <= len(x) else np.concatenate([x, np.zeros(max(n, len(x)), x.dtype)])
        known, used = self.known + len(h), self.used + len(ids)
        self.first, self.count, self.runs, self.ids = grown(self.first, known), grown(self.count, known), grown(self.runs, known), grown(self.ids, used)
        self.first[self.known : known] = self.used + np.cumsum(count) - count
        self.count[self.known : known] = count
        self.ids[self.used : used] = ids
        rest, slot = np.arange(len(h)), (h >> np.uint64(44)).astype(np.int64)
        while len(rest):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[rest[free]]
            mine = self.keys[slot] == h[rest]
            self.at[slot[mine]] = self.known + rest[mine]
            rest, slot = rest[~mine], (slot[~mine] + 1) & (self.SLOTS - 1)
        self.known, self.used = known, used

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All their ids in a row, and how many each has."""
        n = self.count[numbers]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.first[numbers] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n


class ChunkEncoder:
    """Gives what the tokenizer's own encode(text, add_special_tokens=False) gives.

    Where the file cuts texts as expected (NORMALIZER, PRE_TOKENIZER, added tokens with MARK) and a text is plain (printable
    ASCII, Latin-1 letters, blanks, tabs and line feeds, no MARK), it is cut by vectors of its bytes, and the library
    encodes each distinct piece once; pieces are known by 64-bit hashes. Of other texts each distinct chunk between white
    space is encoded once by the whole tokenizer, since no piece goes over white space. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        marked = all(MARK in t["content"] and not t["normalized"] for t in spec.get("added_tokens") or [])
        whole = not any(spec.get(k) for k in ("truncation", "padding", "post_processor")) and not (spec.get("model") or {}).get("dropout")
        self.by_piece = marked and whole and spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == PRE_TOKENIZER
        self.code, self.dtype = ("H", np.uint16) if self.tok.get_vocab_size() <= 1 << 16 else ("I", np.uint32)
        self.pieces, self.chunks = _Pieces(self.dtype), _Memory(CACHE_CHUNKS)

    def _made(self, b: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row and how many each has: between spaces, pieces are words of their own to the library."""
        data = b.tobytes()
        made = self.tok.encode(b" ".join([data[i : i + n] for i, n in zip(first.tolist(), length.tolist(), strict=True)]).decode(), add_special_tokens=False)
        return np.array(made.ids, self.dtype), np.bincount(np.array(made.word_ids, np.int64), minlength=len(first))

    def _chunk(self, c: str) -> bytes:
        return array(self.code, self.tok.encode(c, add_special_tokens=False).ids).tobytes()

    def _odd(self, text: str) -> np.ndarray:
        """Ids of a text that isn't plain."""
        if not self.by_piece:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype)
        self.chunks.age()
        found = []
        for c in text.replace("\n", " ").replace("\t", " ").split(" "):
            ids = self.chunks.get(c)
            if ids is None:
                ids = self.chunks.older.get(c)
                ids = self._chunk(c) if ids is None else ids
                if len(c) <= CACHE_LENGTH:
                    self.chunks[c] = ids
            found.append(ids)
        return np.frombuffer(b"".join(found), self.dtype)

    def _plain(self, b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each row of bytes is plain; where pieces of such rows begin and how long they are."""
        kind = _KIND[b]
        bad = kind == 4
        bad[1:] |= (b[:-1] == _LATIN) & ((b[1:] == _LATIN_SIGNS[0]) | (b[1:] == _LATIN_SIGNS[1]))
        bad[1:] |= (b[:-1] == ord("<")) & (b[1:] == ord("|"))
        plain = np.ones(len(ends) + 1, bool)
        plain[np.searchsorted(ends, np.flatnonzero(bad), "right")] = False
        begins = np.ones(len(b), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begins[ends[ends < len(b)]] = True
        begins &= kind != 0
        # an apostrophe by itself takes the letters of a contraction behind it
        row_end = np.zeros(len(b) + 1, bool)
        row_end[ends] = True
        quote = np.flatnonzero(begins[:-2] & (b[:-2] == ord("'")) & (kind[1:-1] == 1) & ~row_end[1:-2])
        one, two = b[quote + 1], b[quote + 2]
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        double &= ~row_end[quote + 2]
        for some, n in ((quote[single], 1), (quote[double], 2)):
            begins[some + 1] = False
            after = some + 1 + n
            after = after[~row_end[after]]
            begins[after[kind[after] == 1]] = True
        stops = row_end
        stops[:-1] |= begins | (kind == 0)
        stops[-1] = True
        # pieces and white space follow each other: a piece ends at the next stop
        stop = np.flatnonzero(stops)
        k = np.flatnonzero(begins[stop[:-1]])
        return plain[:-1], stop[k], stop[k + 1] - stop[k]

    def _run(self, data: np.ndarray, at: np.ndarray, original) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of rows of lower-cased bytes; ``original(k)`` is the text of a row."""
        b, ends, rows = data[at[0] : at[-1]], at[1:] - at[0], len(at) - 1
        b = np.concatenate([b, np.full(3, 32, np.uint8)])
        plain, first, length = self._plain(b, ends)
        row = np.searchsorted(ends, first, "right")
        inside = first < (ends[-1] if rows else 0)
        use = inside & plain[np.minimum(row, max(rows - 1, 0))]
        first, length, row = first[use], length[use], row[use]
        h = hashed_spans(b, first, length)
        h[h == 0] = 1
        if self.pieces.known > CACHE_PIECES or self.pieces.used > CACHE_IDS:
            self.pieces.shrink()
        number = self.pieces.find(h)
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            new, k = np.unique(h[unknown], return_index=True)
            # a run has far fewer pieces than the table has slots
            self.pieces.add(new, *self._made(b, first[unknown[k]], length[unknown[k]]))
            number[unknown] = self.pieces.find(h[unknown])
        self.pieces.runs[number] += 1
        ids, n = self.pieces.ids_of(number)
        counts = np.bincount(row, weights=n, minlength=rows).astype(np.int64)
        if plain.all():
            return ids, counts
        parts, cuts = [], np.concatenate([[0], np.cumsum(counts)])
        for k in range(rows):
            parts.append(ids[cuts[k] : cuts[k + 1]] if plain[k] else self._odd(original(k)))
            counts[k] = len(parts[-1])
        return np.concatenate(parts), counts

    def _whole(self, rows: int, original) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._odd(original(k)) for k in range(rows)]
        return np.concatenate(parts) if parts else np.zeros(0, self.dtype), np.array([len(x) for x in parts], np.int64)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none of them null) in a row, and how many each has."""
        if not self.by_piece:
            return self._whole(len(texts), lambda k: texts[k].as_py())
        data, at = arrow_bytes(texts)
        found = [self._run(data, at[a : z + 1], lambda k, a=a: texts[a + k].as_py()) for a, z in runs(at)]
        if not found:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])

    def encode_with_end(self, texts: pa.Array, end_id: int, dtype=None) -> tuple[np.ndarray, np.ndarray]:
        """The same with ``end_id`` after each text's ids, counted in."""
        ids, n = self.encode_column(texts)
        out = np.full(len(ids) + len(n), end_id, dtype or self.dtype)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
        return out, n + 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, n = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(n)[:-1]) if texts else []


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One a worker process: what it has learned serves its later tasks too."""
    return ChunkEncoder(path)
