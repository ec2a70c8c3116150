"""Token ids of whole texts by the tokenizers library, with a cache of pieces.

Tokenizers whose first step splits a text at white space give every piece between two
single blanks the same ids wherever it stands. Such pieces are encoded once and kept; a
text with other white space, or with one of the tokenizer's added words such as an
end-of-text mark, is encoded whole. Either way the ids are the library's own, with
add_special_tokens=False.
"""

from __future__ import annotations

import gc
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: White space other than blank, newline, tab and carriage return, and separators that only some engines count.
_ODD_SPACE = re.compile(r"[^\S \n\t\r]")
_TRAIL = ".,!$%&*#|"
#: Pieces kept by a worker, about 200 bytes each.
_MOST_PIECES = 400_000
#: Words encoded as one text when they are new.
_WORDS_AT_ONCE = 8192
_LOADED: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """Encodes texts to little-endian unsigned 16-bit (or 32-bit) ids, as bytes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"].lower() for t in spec.get("added_tokens", [])]
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        parts = [p.get("type") for p in pre.get("pretokenizers", [])]
        self.kind, edge = "whole", None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.kind, edge = "spaced", lambda token: token[:1] == "Ġ"  # a leading blank
        elif parts == ["Split", "ByteLevel"] and [n.get("type") for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            suffix = spec["model"].get("end_of_word_suffix") or "\0"
            self.kind, edge = "words", lambda token: token.endswith(suffix)
        #: Whether an id is at the edge of a word: its first with a leading blank, its last with a suffix.
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        if edge is not None:
            self.edge[[i for token, i in self.tokenizer.get_vocab().items() if edge(token)]] = True
        self.cache: dict[str, bytes] = {"": b""}
        #: Pieces met again since the cache was last cut down.
        self.again: set[str] = set()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _splittable(self, text: str) -> str | None:
        """The text with its pieces between white space (blanks, for "spaced"), or None if it must be encoded whole."""
        if self.kind == "whole":
            return None
        if self.kind == "spaced":
            if "<" in text and any(w in text.lower() for w in self.added):
                return None
            spaced = ("\n" + text).replace("\n", " \n")
            if "  " in spaced or "\n " in spaced or spaced[-1] in " \n":
                return None
            # a printable text has no white space but blanks
            plain = text.replace("\n", " ")
            return spaced[1:] if plain.isprintable() or plain.split() == plain.split(" ") else None
        plain = text
        if not text.islower():
            try:
                text.encode("latin-1")
                plain = text.lower()
            except UnicodeEncodeError:
                pass
        if _ODD_SPACE.search(text) or ("<" in text and any(w in text.lower() for w in self.added)):
            return None
        return plain

    def _split(self, texts: list[str]) -> pa.ListArray:
        rows = pa.array(texts, pa.string())
        return pc.split_pattern(rows, " ") if self.kind == "spaced" else pc.ascii_split_whitespace(rows)

    def _piece_text(self, key: str) -> str:
        return key if self.kind == "words" or key[0] == "\n" else " " + key

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters alone, encoded as one text and cut at its words."""
        lead = "" if self.kind == "words" else " "
        ids = np.array(self.tokenizer.encode_batch_fast([lead + " ".join(words)], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}")
        edges = np.flatnonzero(self.edge[ids]) + (self.kind == "words")
        if len(edges) != len(words):
            return self._encode([self._piece_text(w) for w in words])
        cuts = (edges * self.width).tolist()
        bounds = [0, *cuts] if self.kind == "words" else [*cuts, len(ids) * self.width]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _learn(self, keys: list[str]) -> None:
        cache = self.cache
        words = dict.fromkeys(filter(str.isalpha, keys))
        other: dict[str, str] = {}
        parts: list[tuple[str, str, str]] = []
        for key in keys:
            if key in words:
                continue
            base = key.rstrip(_TRAIL)
            if not base.lower().isalpha():  # a dotted capital I becomes two characters
                other[key] = self._piece_text(key)
                continue
            words[base] = None
            if len(base) < len(key):
                trail = key[len(base) :]
                other["\0" + trail] = trail
                parts.append((key, base, "\0" + trail))
        for known, encode, most in ((words, self._encode_words, _WORDS_AT_ONCE), (other, lambda names: self._encode([other[k] for k in names]), 4096)):
            names = [k for k in known if k not in cache]
            for i in range(0, len(names), most):
                chunk = names[i : i + most]
                cache.update(zip(chunk, encode(chunk)))
        for key, base, trail in parts:
            cache[key] = cache[base] + cache[trail]

    def _cut_down(self, here: list[str]) -> None:
        """Keep the pieces met again lately, or if these are too many the present ones."""
        keep = here if len(self.again) > _MOST_PIECES // 2 else [*here, *self.again]
        self.cache = {p: self.cache[p] for p in ["", *keep] if p in self.cache}
        self.again = set()

    def _from_pieces(self, texts: list[str]) -> list[bytes]:
        """The ids of splittable texts: every distinct piece is looked up once."""
        rows = self._split(texts)
        coded = rows.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.cache) > _MOST_PIECES:
            self._cut_down(pieces)
        missing = [p for p in pieces if p not in self.cache]
        self.again.update(pieces)
        if missing:
            self.again.difference_update(missing)
            self._learn(missing)
        found = list(map(self.cache.__getitem__, pieces))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.width
        flat = np.frombuffer(b"".join(found), dtype=f"<u{self.width}")
        at = coded.indices.to_numpy()
        lens = sizes[at]
        ends = np.cumsum(lens)
        shift = (np.cumsum(sizes) - sizes)[at] - (ends - lens)
        raw = flat[np.repeat(shift, lens) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        bounds = (np.concatenate([[0], ends])[rows.offsets.to_numpy() - rows.offsets[0].as_py()] * self.width).tolist()
        skip = self.width if self.kind == "spaced" else 0  # the newline set before each text
        return [raw[a + skip : b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        gc.disable()
        try:
            out = [b""] * len(texts)
            split = [(k, s) for k, t in enumerate(texts) if t and (s := self._splittable(t)) is not None]
            for (k, _), ids in zip(split, self._from_pieces([s for _, s in split]) if split else []):
                out[k] = ids
            done = {k for k, _ in split}
            whole = [k for k, t in enumerate(texts) if t and k not in done]
            for k, ids in zip(whole, self._encode([texts[k] for k in whole])):
                out[k] = ids
            return out
        finally:
            gc.enable()


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a tokenizer file; one is kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]
