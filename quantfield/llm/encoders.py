"""Tokenising whole texts with the tokenizers library, a word at a time.

Both vocabularies cut a text at white space before any merge, so a text's ids are the ids of its
pieces in order. Workers remember pieces' ids; a text goes through the library whole only
where cutting at spaces could differ from its own cut (rare white space, special tokens).
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import keeps, working

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space other than space, tab, line feed, carriage return; and marks that join words.
_ODD = re.compile("[\x00\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    -⁤　﻿]|<\\|")
_ODD_ASCII = ("\0", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Runs of white space that the pattern of a byte-level vocabulary cuts elsewhere than at a space.
_RUNS = re.compile(r"\s\s\s|  ")
_RUN_PARTS = ("  ", " \n", "\n ", "\n\n", "\t", "\r")
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: ASCII marks that end a word, after a digit or letter, are pieces of their own: both vocabularies cut there. Letters that normal form or
#: lower case ends with a combining mark (U+0130, U+0958) are left out, for marks join it. Arrow's expressions.
_TAIL = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}\x{410}-\x{44F}])([!-/:-@\[-`{-~]+)"
#: One line feed between other signs is cut on both sides.
_LINE = r"([^\s])\n([^\s])"

#: Pieces and their characters that a worker remembers; beyond either it keeps the short ones asked for again since the last time.
CACHE_PIECES, CACHE_CHARS, LONG_PIECE = 600_000, 1 << 23, 64
#: Characters looked up together, and words whose ids are gathered together.
PART_CHARS, PART_WORDS = 1 << 22, 1 << 19
#: Pieces encoded as one text; the marks that may stand between words: the first of them that is one id; how byte-level vocabularies write a space.
GROUP, MARKS, BYTE_SPACE = 64, "~^`|§", "Ġ"


class Pool:
    """Ids of pieces one after the other in one growing array; row k of start and length is piece k's."""

    def __init__(self, dtype: str):
        self.row: dict[str, int] = {}
        self.ids, self.n_ids, self.chars = np.zeros(1 << 16, dtype), 0, 0
        self.start, self.length, self.asked = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def append(self, ids: np.ndarray) -> int:
        at, self.n_ids = self.n_ids, self.n_ids + len(ids)
        if self.n_ids > len(self.ids):
            self.ids = np.resize(self.ids, 2 * self.n_ids)
        self.ids[at : self.n_ids] = ids
        return at

    def add(self, keys: list[str], start: np.ndarray, length: np.ndarray) -> None:
        n = len(self.row)
        self.row.update(zip(keys, range(n, n + len(keys))))
        self.chars += sum(map(len, keys))
        if len(self.row) > len(self.start):
            self.start, self.length, self.asked = (np.resize(x, 2 * len(self.row)) for x in (self.start, self.length, self.asked))
        at = slice(n, n + len(keys))
        self.start[at], self.length[at], self.asked[at] = start, length, 0

    def again(self) -> Pool:
        """A pool of the pieces asked for in several parts, half of what a pool holds at most."""
        keys = list(self.row)
        rows = np.flatnonzero(self.asked[: len(keys)] > 1)
        rows = rows[np.argsort(-self.asked[rows], kind="stable")[: CACHE_PIECES // 2]]
        rows = np.array([k for k in rows.tolist() if len(keys[k]) <= LONG_PIECE], np.int64)
        ids, end = self.gather(rows)
        out = Pool(self.ids.dtype)
        out.append(ids)
        out.add([keys[k] for k in rows.tolist()], end - self.length[rows], self.length[rows])
        return out

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows, and where each row's end."""
        length = self.length[rows]
        end = np.cumsum(length)
        out = np.empty(int(end[-1]) if len(end) else 0, self.ids.dtype)
        for i in range(0, len(rows), PART_WORDS):
            n, z = length[i : i + PART_WORDS], end[i : i + PART_WORDS]
            first = int(z[0] - n[0])
            at = np.repeat(self.start[rows[i : i + PART_WORDS]] - (z - n), n)
            at += np.arange(first, int(z[-1]))
            out[first : int(z[-1])] = self.ids[at]
        return out, end


class PieceEncoder:
    """ids(texts): for each text its ids as little-endian bytes of `dtype`. style: "spaces" keeps
    white space (byte-level vocabulary), "words" drops it (word vocabulary).

    Arrow splits texts and numbers their distinct pieces, so a piece is asked for once in each part.
    Keys: "x" is the piece " x" ("x" itself for words), "\\0x" a piece without the space before.
    """

    def __init__(self, path: str, style: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.words = style == "words"
        self.dtype = "<u2" if self.tok.get_vocab_size() <= 65536 else "<u4"
        self.width = int(self.dtype[-1])
        size = self.tok.get_vocab_size()
        self.cuts = np.zeros(size, bool)
        self.mark = ""
        if self.words:
            single = [(m, e.ids[0]) for m, e in zip(MARKS, self.tok.encode_batch_fast(list(MARKS), add_special_tokens=False)) if len(e.ids) == 1]
            if single:
                self.mark, at = single[0]
                self.cuts[at] = True
            else:
                self.cuts = None
        else:
            self.cuts[[i for t, i in self.tok.get_vocab().items() if t.startswith(BYTE_SPACE)]] = True
        self.pool = Pool(self.dtype)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[str]) -> None:
        """Plain pieces go GROUP at a time as one text, and its ids are cut where a piece begins: at ids
        whose token begins with a space, or at the id of a mark put between words. Others go alone."""
        plain = [k for k in keys if k.split() == [k] and k[0] != "\0" and not (self.words and self.mark in k)] if self.cuts is not None else []
        rest = list(set(keys).difference(plain))
        groups = [plain[i : i + GROUP] for i in range(0, len(plain), GROUP)]
        glue, skip = (f" {self.mark} ", 1) if self.words else (" ", 0)
        for i in range(0, len(groups), 16):
            part = groups[i : i + 16]
            for g, ids in zip(part, self._raw([glue + glue.join(g) for g in part])):
                at = np.flatnonzero(self.cuts[ids])
                if len(at) != len(g):
                    rest += g
                    continue
                self.pool.add(g, self.pool.append(ids) + at + skip, np.diff(at, append=len(ids)) - skip)
        for i in range(0, len(rest), 2000):
            part = rest[i : i + 2000]
            found = self._raw([self._piece(k) for k in part])
            size = np.array([len(x) for x in found], np.int64)
            self.pool.add(part, self.pool.append(np.concatenate(found)) + np.cumsum(size) - size, size)

    def _piece(self, key: str) -> str:
        return key if self.words else key[1:] if key[:1] == "\0" else " " + key

    def _odd(self, text: str) -> bool:
        return (not text.isascii() or any(c in text for c in _ODD_ASCII)) and bool(_ODD.search(text))

    def _part(self, texts: list[str]) -> list[bytes]:
        """Of one part of texts, each at hand whole."""
        out = [b""] * len(texts)
        simple, runs = [], []
        for k, t in enumerate(texts):
            if self._odd(t):
                out[k] = self._raw([t])[0].tobytes()
            elif not self.words and any(c in t for c in _RUN_PARTS) and _RUNS.search(t):
                runs.append(k)
            else:
                simple.append(k)
        if self.words:
            # The vocabulary writes no capitals. Beside combining marks lower case could differ, so only ASCII texts come in it.
            whole = pa.array([texts[k].lower() if texts[k].isascii() else texts[k] for k in simple], pa.large_string())
            cut = pc.ascii_split_whitespace(pc.replace_substring_regex(whole, _TAIL + r"(\s|$)", r"\1 \2\3"))
        else:
            whole = pa.array(["\0" + texts[k] for k in simple], pa.large_string())
            whole = pc.replace_substring_regex(whole, _LINE, "\\1 \0\n \0\\2")
            cut = pc.split_pattern(pc.replace_substring_regex(whole, _TAIL + "( |$)", "\\1 \0\\2\\3"), " ")
        chunks = [[c[1:] if c[0] == " " else "\0" + c for c in _CHUNK.findall(texts[k])] for k in runs]
        sizes = np.array([*pc.list_value_length(cut).to_pylist(), *map(len, chunks)], np.int64)
        flat = pa.concat_arrays([cut.flatten(), pa.array([x for c in chunks for x in c], pa.large_string())]).dictionary_encode()
        # One string of all keys, cut again: no text here holds the sign between them.
        one = pa.LargeListArray.from_arrays([0, len(flat.dictionary)], flat.dictionary)
        keys = pc.binary_join(one, pa.scalar("\x1f", pa.large_string()))[0].as_py().split("\x1f") if len(flat) else []
        if len(self.pool.row) > CACHE_PIECES or self.pool.chars > CACHE_CHARS:
            self.pool = self.pool.again()
        row = self.pool.row
        found = list(map(row.get, keys))
        if None in found:
            self._learn([k for k, r in zip(keys, found) if r is None])
            found = list(map(row.__getitem__, keys))
        found = np.array(found, np.int64)
        self.pool.asked[found] += 1
        ids, end = self.pool.gather(found[flat.indices.to_numpy()])
        end = np.append(0, end)[np.append(0, np.cumsum(sizes))].tolist()
        for k, a, z in zip([*simple, *runs], end, end[1:]):
            out[k] = ids[a:z].tobytes()
        return out

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out, part, size = [], [], 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1])
            if size >= PART_CHARS:
                out += self._part(part)
                part, size = [], 0
        return out + (self._part(part) if part else [])


_encoder = lru_cache(maxsize=4)(PieceEncoder)
keeps("encoding", _encoder.cache_clear)


def encoder(path: str, style: str) -> PieceEncoder:
    """One for each worker process, until it turns to other work."""
    working("encoding")
    return _encoder(path, style)
