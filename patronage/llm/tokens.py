"""Token ids of a public tokenizer file, one text at a time, with a bounded cache of words.

A byte-level tokenizer cuts a text with a fixed pattern before it merges. A cut always falls before a
single space between two non-space characters, so the text between two such spaces can be encoded by
itself and its ids remembered. Any other kind of tokenizer file is applied to the whole text.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# The split pattern and the byte alphabet of byte-level tokenizer files.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_SPELLED = np.array([_ALPHABET[b] for b in range(256)], "<u2")
_NUL = chr(_ALPHABET[0])

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")
_PLAIN = re.compile(r"[\n\t\r !-~¡-ɏ]+")  # where every pattern library agrees on the classes
_LONGEST_CACHED = 48
_CHUNK = 8 << 20  # characters whose words are looked up together
_JOINED = 20_000  # new words that are encoded together


def _ids(values: list[int]) -> bytes:
    return struct.pack(f"<{len(values)}I", *values)


def _odd_spaces(text: str) -> bool:
    """Whether a space stands beside another white space or at an end of the text."""
    if "  " in text or text[0] == " " or text[-1] == " ":
        return True
    return any(c in text and (f" {c}" in text or f"{c} " in text) for c in _OTHER_SPACE)


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers.

    ``cache`` bounds the remembered words, about 200 bytes each; when it is full, the older half is forgotten.
    """

    def __init__(self, path: str, cache: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.by_word = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout")
            and all(token["special"] for token in spec.get("added_tokens") or ())
        )
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        self.half = max(1, cache // 2)
        self.spaced: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._whole(text)
        parts = _BETWEEN.split(text) if _odd_spaces(text) else text.split(" ")
        ids = list(map(self.spaced.get, parts))
        ids[0] = self._chunk(parts[0])
        if None in ids:
            for i, known in enumerate(ids):
                if known is None:
                    ids[i] = self._after_space(parts[i])
        return b"".join(ids)

    def encode_many(self, texts: pa.StringArray) -> list[bytes]:
        """``encode`` of each text. Words of a chunk of texts are looked up once and their ids taken by number."""
        out = [b""] * len(texts)
        even, held = [], 0
        for i, text in enumerate(texts.to_numpy(zero_copy_only=False).tolist()):
            if text and self.by_word and not _odd_spaces(text):
                even.append(i)
                held += len(text)
                if held >= _CHUNK:
                    self._encode_even(texts, even, out)
                    even, held = [], 0
            elif text:
                out[i] = self.encode(text)
        if even:
            self._encode_even(texts, even, out)
        return out

    def _encode_even(self, texts: pa.StringArray, rows: list[int], out: list[bytes]) -> None:
        """Texts whose spaces all stand alone between other characters: each space begins a part."""
        parts = pc.split_pattern(texts.take(pa.array(rows)), pattern=" ")
        offsets = parts.offsets.to_numpy()
        numbered = parts.flatten().dictionary_encode()
        words, number = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy().astype("i8")
        first = offsets[:-1] - offsets[0]
        known = list(map(self.spaced.get, words))
        new = [k for k, ids in enumerate(known) if ids is None]
        for k, ids in zip(new, self._after_spaces([words[k] for k in new])):
            known[k] = ids
        known += [self._chunk(words[k]) for k in number[first].tolist()]
        number[first] = len(words) + np.arange(len(first))
        size = np.fromiter(map(len, known), "i8", len(known)) // 4
        start = np.cumsum(size) - size
        length = size[number]
        end = np.cumsum(length)
        flat = np.frombuffer(b"".join(known), "<u4")
        at = np.repeat((start[number] - end + length).astype("i4"), length)
        at += np.arange(len(at), dtype="i4")
        ids = flat[at].tobytes()
        stop = end[np.append(first[1:], len(number)) - 1]
        low = 0
        for row, high in zip(rows, stop.tolist()):
            out[row] = ids[4 * low:4 * high]
            low = high

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _after_space(self, part: str) -> bytes:
        ids = self.spaced.get(part) or self.older.get(part)
        if ids is None:  # letters alone are one word
            ids = self._pieces("Ġ" + part) if part.isascii() and part.isalpha() else self._chunk(" " + part)
        if len(part) <= _LONGEST_CACHED:
            if len(self.spaced) >= self.half:
                self.older, self.spaced = self.spaced, {}
            self.spaced[part] = ids
        return ids

    def _after_spaces(self, parts: list[str]) -> list[bytes]:
        """``_after_space`` of different parts; the short plain ones that are new are encoded together."""
        out: list[bytes] = []
        for low in range(0, len(parts), _JOINED):
            block = parts[low:low + _JOINED]
            found = list(map(self.older.get, block))
            new = [k for k, part in enumerate(block) if found[k] is None and len(part) <= _LONGEST_CACHED and (part.isascii() or _PLAIN.fullmatch(part))]
            for k, ids in zip(new, self._joined([block[k] for k in new])):
                found[k] = ids
            if len(self.spaced) >= self.half:
                self.older, self.spaced = self.spaced, {}
            self.spaced.update((part, ids) for part, ids in zip(block, found) if ids is not None)
            out += [self._after_space(part) if ids is None else ids for part, ids in zip(block, found)]
        return out

    def _joined(self, parts: list[str]) -> list[bytes]:
        """Ids of each part behind a space. A cut falls before every space, so the pieces that begin with one tell the parts apart."""
        if not parts:
            return []
        pieces = SPLIT.findall(" " + " ".join(parts))
        known = dict.fromkeys(pieces)
        spelled = _SPELLED[np.frombuffer("\0".join(known).encode(), "u1")].tobytes().decode("utf-16-le").split(_NUL)
        tokenize, flat, ends = self.model.tokenize, [], [0]
        for piece in spelled:
            flat += [t.id for t in tokenize(piece)]
            ends.append(4 * len(flat))
        raw = np.array(flat, "<u4").tobytes()
        known = dict(zip(known, [raw[a:b] for a, b in zip(ends, ends[1:])]))
        found = list(map(known.__getitem__, pieces))
        size = np.cumsum([0, *map(len, found)])
        edges = size[[k for k, piece in enumerate(pieces) if piece[0] == " "] + [-1]].tolist()
        raw = b"".join(found)
        return [raw[a:b] for a, b in zip(edges, edges[1:])]

    def _chunk(self, chunk: str) -> bytes:
        if not _PLAIN.fullmatch(chunk):
            return self._whole(chunk)
        return b"".join([self.words.get(p) or self._word(p) for p in SPLIT.findall(chunk)])

    def _pieces(self, word: str) -> bytes:
        return _ids([p.id for p in self.model.tokenize(word)])

    def _word(self, word: str) -> bytes:
        ids = self._pieces(word.encode().decode("latin-1").translate(_ALPHABET))
        if len(word) <= _LONGEST_CACHED:
            if len(self.words) >= self.half // 2:
                self.words.clear()
            self.words[word] = ids
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
