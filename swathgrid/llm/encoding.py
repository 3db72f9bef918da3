"""Whole-text encoding with the tokenizers library, memoised by white-space separated chunk.

Two pre-tokenizers, told by the vocabulary file, never match across a single space or line end between two other characters,
so a text may be cut there and the cuts' ids joined; distinct chunks are encoded once per worker. Texts with other white
space, runs of it or control characters are cut only between printable Latin characters. Texts that hold the string of an
added token, and all texts under other pre-tokenizers, go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

_SAFE = "[!-~¡-˿]"
_CUT = re.compile(f"(?<={_SAFE}) (?={_SAFE})")
#: White space and what stands around it is cut alike by these (fixed values of the library's file format).
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_DROPS_SPACE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks that a worker remembers (the first ones it meets), a bound on its memory only.
MEMO = 400_000
#: Characters of a chunk that is remembered at most.
LONGEST = 256


def _may_cut(file: dict) -> bool:
    """Whether the module's rule of cutting holds for a vocabulary file."""
    before, normal = file.get("pre_tokenizer") or {}, file.get("normalizer")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in file.get("added_tokens") or ()):
        return False
    if normal is None:
        return _BYTE_LEVEL.items() <= before.items()
    steps = {n.get("type") for n in normal.get("normalizers", ())}
    first, *rest = before.get("pretokenizers") or [{}]
    words = (first.get("pattern") or {}).get("Regex") == _DROPS_SPACE and first.get("invert")
    plain = all(p.get("type") == "ByteLevel" and not p.get("use_regex") and not p.get("add_prefix_space") for p in rest)
    return bool(steps <= {"NFC", "Replace", "Lowercase"} and words and plain)


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit arrays, as ``encode(text, add_special_tokens=False)`` has them.

    The string of a special token in a text becomes its id, the library's default; with ``specials_as_text`` it is text.
    """

    def __init__(self, path: str, remember: int = MEMO, specials_as_text: bool = False):
        self._remember = remember
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = specials_as_text
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self._whole = not _may_cut(file)
        self._added = [t["content"] for t in file.get("added_tokens") or ()]
        del file
        self._code = "H" if self._tokenizer.get_vocab_size() <= 65536 else "I"
        encode = lambda text: self._tokenizer.encode(text, add_special_tokens=False).ids
        # byte-level vocabularies join a space to the word behind it, the others drop white space
        self._keeps = encode(" a") != encode("a")
        self._memo: dict[str, bytes] = {}

    @property
    def kind(self):
        """The least Arrow type that holds an id."""
        import pyarrow as pa

        return pa.uint16() if self._code == "H" else pa.uint32()

    def _chunks(self, text: str) -> list[str]:
        """Keys of the text's chunks: the first is marked by a null character, a line's first by its line end."""
        if self._whole or any(a in text for a in self._added):
            return ["\0" + text]
        flat = text.replace("\n", " ")
        if "  " in flat or not flat.isprintable():
            cut = _CUT.split(text)
        elif self._keeps:
            cut = text.replace("\n", " \n").split(" ")
        else:
            return flat.split(" ")
        cut[0] = "\0" + cut[0]
        return cut

    def _text(self, key: str) -> str:
        """What a key stands for in the text."""
        if key[:1] == "\0":
            return key[1:]
        return " " + key if self._keeps and key[:1] != "\n" else key

    def ids_of(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self._chunks(x) if x else [] for x in texts]
        get = self._memo.get
        known, holes = [], []
        new: dict[str, bytes] = {}
        for t, chunks in enumerate(cut):
            row = list(map(get, chunks))
            k = -1
            try:
                while True:
                    k = row.index(None, k + 1)
                    holes.append((t, k))
                    new[chunks[k]] = b""
            except ValueError:
                known.append(row)
        keys = list(new)
        for k in range(0, len(keys), 4096):
            part = keys[k : k + 4096]
            for c, e in zip(part, self._tokenizer.encode_batch_fast([self._text(c) for c in part], add_special_tokens=False)):
                new[c] = array(self._code, e.ids).tobytes()
        for t, k in holes:
            known[t][k] = new[cut[t][k]]
        if len(self._memo) + len(new) <= self._remember:
            self._memo.update({k: v for k, v in new.items() if len(k) <= LONGEST})
        kind = np.dtype("<u2" if self._code == "H" else "<u4")
        return [np.frombuffer(b"".join(row), kind).astype("<u4") for row in known]


def release() -> None:
    """Give memory that a finished task no longer uses back to the system: idle workers keep what they remember only."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, remember: int = MEMO, specials_as_text: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file, which remembers so many chunks (about 200 bytes each)."""
    key = path, specials_as_text
    if key not in _encoders:
        _encoders[key] = Encoder(path, remember, specials_as_text)
    return _encoders[key]
