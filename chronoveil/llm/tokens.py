"""Token ids of whole batches of texts, the same as the tokenizer gives text by text.

The tokenizer of ``word_bpe_49k.json`` drops white space and never merges across it, so a text's ids are those of its
words, one after another. Each distinct word is encoded once per worker and kept in a bounded memory. A text is never cut.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from chronoveil.llm import base

#: Words a worker remembers at least (about 150 bytes each): beyond twice as many, those not seen lately are forgotten.
REMEMBERED = 300_000
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_MARK = np.isin(np.arange(256), list(b".,;:!?"))
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
#: Letters only, none of which normalisation turns into anything but a letter: one word for the tokenizer.
_PLAIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: Plain words that are encoded as one text.
_LINE = 256
#: Normaliser and pre-tokenizer of ``word_bpe_49k.json``.
_PUBLIC_STEPS = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})
_workers: dict[str, "WordEncoder"] = {}


def public_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def word_encoder(path: str) -> "WordEncoder":
    """The encoder of this worker process for a tokenizer file."""
    if path not in _workers:
        _workers[path] = WordEncoder(path)
    return _workers[path]


def pieces(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Like ``base.words``, in lower case as far as ASCII goes and with a closing mark as a word of its own.

    A mark behind a Latin letter and before white space begins a word for the tokenizer too, and it lower-cases anyway.
    Only its special tokens are matched before that, so texts that may have one are split at white space alone.
    """
    data, offsets = base.utf8(column)
    if not len(data) or (data[:-1][data[1:] == ord("|")] == ord("<")).any():
        return base.words(column)
    data = _LOWER[data]
    space = _SPACE[data]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    lasts = offsets[1:][np.diff(offsets) > 0] - 1
    before, after = np.ones(len(data), dtype=bool), np.ones(len(data), dtype=bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[firsts], after[lasts] = True, True
    marks = np.flatnonzero(_MARK[data] & after & ~before)
    last = data[marks - 1]
    accented = (data[marks - 2] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (marks > 1)
    begins = before & ~space
    begins[marks[((last >= ord("a")) & (last <= ord("z"))) | accented]] = True
    packed = data[~space]
    at = np.flatnonzero(begins)
    spaces = np.cumsum(space, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    starts = np.append(at - spaces[at], len(packed))
    flat = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(packed))
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(at, offsets)


def _cut(flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of consecutive runs of ``flat``, given where each ends."""
    data, at = flat.tobytes(), [0, *(4 * ends).tolist()]
    return [data[a:b] for a, b in zip(at, at[1:])]


class WordEncoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.closing = np.zeros(self.vocabulary, dtype=bool)
        self.closing[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]] = True
        self.plain = self._plain()
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def _plain(self):
        """The tokenizer for lower-case plain words alone, which normalisation leaves as they are and the pattern takes whole."""
        from tokenizers import Tokenizer, pre_tokenizers
        known = json.loads(self.tokenizer.to_str())
        if (known["normalizer"], known["pre_tokenizer"]) != _PUBLIC_STEPS:
            return self.tokenizer
        plain = Tokenizer(self.tokenizer.model)
        plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return plain

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of each part. Plain words are encoded many at a time: in each, the last id alone closes a word."""
        plain = [bool(_PLAIN.fullmatch(p)) for p in parts]
        joined = [p for p, one in zip(parts, plain) if one]
        lines = [" ".join(joined[i:i + _LINE]).lower() for i in range(0, len(joined), _LINE)]
        flat = np.array([i for e in self.plain.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], dtype="<u4")
        ends = np.flatnonzero(self.closing[flat]) + 1 if len(flat) else np.zeros(0, np.int64)
        if len(ends) != len(joined) or (len(ends) and ends[-1] != len(flat)):  # a vocabulary without marks at word ends
            plain = [False] * len(parts)
            ends = ends[:0]
        rest = self.tokenizer.encode_batch_fast([p for p, one in zip(parts, plain) if not one], add_special_tokens=False)
        whole, each = iter(_cut(flat, ends)), iter(_cut(
            np.array([i for e in rest for i in e.ids], dtype="<u4"), np.cumsum([len(e) for e in rest], dtype=np.int64)))
        return [next(whole if one else each) for one in plain]

    def _words(self, dictionary: list[str]) -> list[bytes]:
        known = self.known
        out = list(map(known.get, dictionary))
        new = [i for i, v in enumerate(out) if v is None]
        if new:
            words = [dictionary[i] for i in new]
            ids = list(map(self.earlier.get, words))
            unseen = iter(self._ids([w for w, v in zip(words, ids) if v is None]))
            ids = [next(unseen) if v is None else v for v in ids]
            known.update(zip(words, ids))
            for i, v in zip(new, ids):
                out[i] = v
            if len(known) > self.remembered:
                self.known, self.earlier = {}, known
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after another (null: no id), and the offset at which each text begins, plus the end."""
        dictionary, codes, offsets = pieces(column)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        _, ends, data = pa.array(self._words(dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pa.array(codes)).buffers()
        ends = np.frombuffer(ends, dtype=np.int64, count=len(codes) + 1) // 4
        return np.frombuffer(data, dtype="<u4", count=int(ends[-1])), ends[offsets]
