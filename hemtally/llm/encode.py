"""Token ids of whole texts by a public byte-level BPE; pieces between spaces are encoded once per worker and kept.

The vocabulary's pre-tokenizer never joins a visible character with a space, tab or newline that follows it, so a text's ids are
the ids of its pieces (white space, then visible characters) one after another. Pieces are found, hashed and looked up
with numpy for a whole batch of texts; only pieces not met before reach the encoder. Texts that hold unusual white space or
control characters are encoded whole. Texts that hold one of the .json file's added tokens (such as <|endoftext|>) are cut there: with
`added` those get their own ids, as by default in `tokenizers`, else they are spelled out. The ids are those of `tokenizers` on the .json file; where its .tiktoken twin (the same
vocabulary as ranks) is given, that library computes them, which is faster; a test holds both against each other.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np

from .words import hashes_between

#: Code points that a pre-tokenizer may take for white space, besides space, tab and newline; with control characters.
_UNUSUAL_RANGES = (
    (0x00, 0x08), (0x0B, 0x1F), (0x7F, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F),
    (0x205F, 0x206F), (0x3000, 0x3000), (0xD800, 0xDFFF), (0xFEFF, 0xFEFF),
)
_UNUSUAL = re.compile("[" + "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in _UNUSUAL_RANGES) + "]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x09, 0x0A, 0x20]] = True
#: Most pieces that a worker keeps (about 30 bytes each).
MOST_KEPT = 2_000_000


class Encoder:
    """`json_path`: for tokenizers; `ranks_path` and `pattern`: the same vocabulary for tiktoken, or None; `added`: whether added tokens count."""

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None, added: bool = False):
        self._added: dict[str, int] = {}
        if added:
            with open(json_path, encoding="utf-8") as f:
                tokens = json.load(f).get("added_tokens") or []
            if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in tokens):
                raise ValueError(f"added tokens of {json_path} take part of the text around them")
            self._added = {x["content"]: x["id"] for x in tokens}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if self._added else None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self._list = coder.encode_ordinary
            width_of = {i: len(piece) for piece, i in ranks.items()}
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(json_path)
            tokenizer.encode_special_tokens = True
            self._list = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
            width_of = {i: len(piece) for piece, i in tokenizer.get_vocab().items()}  # one character stands for one byte
        #: Bytes that each id stands for.
        self.widths = np.zeros(max(*width_of, *self._added.values()) + 1, np.int64)
        for i, n in width_of.items():
            self.widths[i] = n
        for token, i in self._added.items():
            self.widths[i] = len(token.encode())
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self._list(text), np.uint32)

    def _learn(self, data: bytes, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        """Keeps the ids of these pieces, which differ."""
        if len(self.keys) + len(h) > MOST_KEPT:
            self._forget()
        pieces = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        joins = np.array([p[:1] in b" \n\t" and not p.isspace() for p in pieces], bool)  # can follow another piece
        some = [p for p, j in zip(pieces, joins) if j]
        ids = self._encode(b"".join(some).decode())
        stop = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(p) for p in some])) + 1
        alone = [self._encode(p.decode()) for p, j in zip(pieces, joins) if not j]
        size = np.empty(len(h), np.int64)
        size[joins] = np.diff(stop, prepend=0) if some else 0
        size[~joins] = [len(x) for x in alone]
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        at = np.empty(len(h), np.int64)
        at[order] = len(self.pool) + np.cumsum(size[order]) - size[order]
        self.pool = np.concatenate([self.pool, ids, *alone])
        keys = np.concatenate([self.keys, h])
        by = np.argsort(keys)
        self.keys, self.at, self.size = keys[by], np.concatenate([self.at, at])[by], np.concatenate([self.size, size])[by]

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return i, self.keys[i] == h

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; of None, none."""
        if self._cut is None or not any(t and self._cut.search(t) for t in texts):
            return self._batch(texts)
        parts = [self._cut.split(t) if t else [t] for t in texts]  # every second one is an added token
        ids = iter(self._batch([p for some in parts for p in some[::2]]))
        out = []
        for some in parts:
            out.append(np.concatenate([np.array([self._added[p]], np.uint32) if i % 2 else next(ids) for i, p in enumerate(some)]))
        return out

    def _batch(self, texts: list[str | None]) -> list[np.ndarray]:
        plain = [bool(t) and not _UNUSUAL.search(t) for t in texts]
        parts = [t.encode() for t, p in zip(texts, plain) if p]
        out = [np.empty(0, np.uint32) if p or not t else self._encode(t.encode("utf-8", "replace").decode()) for t, p in zip(texts, plain)]
        if not parts:
            return out
        data = b"".join(parts)
        begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        space = _IS_SPACE[np.frombuffer(data, np.uint8)]
        first = np.empty(len(data), bool)
        first[0] = True
        first[1:] = space[1:] & ~space[:-1]
        first[begins[:-1]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        h = hashes_between(data, starts, ends)
        distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
        _, known = self._find(distinct)
        if not known.all():
            new = where[~known]
            self._learn(data, starts[new], ends[new], distinct[~known])
            i, known = self._find(distinct)
            if not known.all():  # the kept pieces were dropped for these
                self._learn(data, starts[where[~known]], ends[where[~known]], distinct[~known])
        i, _ = self._find(distinct)
        at, size = self.at[i][back], self.size[i][back]
        stop = np.cumsum(size)
        ids = self.pool[np.arange(stop[-1]) + np.repeat(at - (stop - size), size)]
        cut = np.append(0, stop)[np.searchsorted(starts, begins)]
        cut = cut.tolist()
        for k, i in enumerate(i for i, p in enumerate(plain) if p):
            out[i] = ids[cut[k] : cut[k + 1]]
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder(vocabulary: str | None = None, added: bool = False) -> Encoder:
    """The worker's encoder; without a path, the public 50k byte-level BPE of the worker's own installation."""
    key = vocabulary, added
    if key not in _encoders:
        if vocabulary is None:
            import public_tokenizers as public

            _encoders[key] = Encoder(
                public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, added
            )
        else:
            _encoders[key] = Encoder(vocabulary, added=added)
    return _encoders[key]
