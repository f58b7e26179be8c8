"""Byte-level BPE through the tokenizers library's model, once per new pre-token.

Merges never cross a pre-token, so a text's ids are those of its pre-tokens in order.
Pre-tokens are cut here by the vocabulary's own pattern, written in the vocabulary's byte
characters and encoded by the library's model once per worker. A text that holds an added
token's string goes to the library whole.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import regex
from tokenizers import Tokenizer

#: The byte-level pre-token pattern (fixed value of this vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for the standard library's faster matcher, where letters are word characters that
#: are neither digits nor the underscore. It holds for texts without ``_ODD`` characters.
_FAST = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
#: All but Latin letters, digits, punctuation and controls that both matchers class alike
#: (superscript digits, fractions and the separators U+001C to U+001F aren't among them).
_ODD = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u02af]").search
#: Pre-tokens held per worker; when full, the table starts anew. Longer ones aren't held.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 40


class _Table(dict):
    """Ids of pre-tokens, made when first asked for; long pre-tokens' aren't held."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(piece) <= CACHE_CHARS:
            self[piece] = ids
        return ids


class ByteBpe:
    def __init__(self, file: str) -> None:
        self.library = Tokenizer.from_file(file)
        self.special = [t["content"] for t in json.load(open(file, encoding="utf-8"))["added_tokens"]]
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.slow = regex.compile(PATTERN).findall
        self.model = self.library.model
        self.known = _Table(self._piece)
        # bytes are written as printable characters: those that are printable as themselves, others from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.char_of = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self._bytes: list[bytes] | None = None

    def cut(self, text: str) -> list[str]:
        """The text's pre-tokens."""
        return _FAST(text) if text.isascii() or not _ODD(text) else self.slow(text)

    def _piece(self, text: str) -> bytes:
        """Ids of one pre-token."""
        shown = text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.char_of)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        whole = [t is not None and any(s in t for s in self.special) for t in texts]
        out = []
        for t, w in zip(texts, whole):
            if len(self.known) > CACHE_ENTRIES:
                self.known.clear()
            if w:
                out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(b"".join(map(self.known.__getitem__, self.cut(t))) if t else b"")
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def token_bytes(self) -> list[bytes]:
        """The bytes that each id stands for."""
        if self._bytes is None:
            shown = {c: b for b, c in self.char_of.items()}
            special = set(self.special)
            names = ((self.library.id_to_token(i) or "") for i in range(self.size))
            self._bytes = [x.encode() if x in special else bytes(shown[c] for c in x) for x in names]
        return self._bytes

    def decode(self, ids) -> str:
        table = self.token_bytes()
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def loaded(file: str) -> ByteBpe:
    """One encoder per worker process and file."""
    if file not in _LOADED:
        _LOADED[file] = ByteBpe(file)
    return _LOADED[file]
