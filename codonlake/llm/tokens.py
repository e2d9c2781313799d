"""Token ids of whole texts under a lower-casing word BPE, as fast as a corpus needs."""

from __future__ import annotations

import json
import os
import re
from itertools import filterfalse

import numpy as np


class WordBpe:
    """The ids that the tokenizers library gives for a word BPE file with `</w>` ends, add_special_tokens=False.

    White space always ends a word, so a text's ids are those of its chunks between white space. Chunks
    are kept with their ids; new ones are cut into words and merged by tiktoken's ranked merges, where a
    word's end is the byte 0x01. A ranked merge gives the same ids if each token of the file, merged
    alone, gives itself (`tests/llm/test_packing.py` checks that of every token). Chunks with control
    bytes, with special tokens or with letters beyond U+024F go to the tokenizers library itself.
    """

    #: Chunks kept at once; then the older half goes. It bounds memory, not what is encoded.
    KEEP = 250_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        byte = {c: b for b, c in letter.items()}

        def raw(token: str) -> bytes:
            ends = token.endswith("</w>")
            return bytes(byte[c] for c in (token[:-4] if ends else token)) + b"\x01" * ends

        names = [*letter.values(), *(c + "</w>" for b, c in letter.items() if b != 1), *("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"])]
        ranks: dict[bytes, int] = {}
        ids: list[int] = []
        for name in names:
            if (key := raw(name)) not in ranks:
                ranks[key] = len(ids)
                ids.append(vocab[name])
        self.ids = np.array(ids, dtype="<u4")
        self.ends = np.zeros(len(ids), dtype=bool)
        self.ends[[r for k, r in ranks.items() if k.endswith(b"\x01")]] = True
        self.ranked = tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.plain = re.compile(r"(?!.*<\|)[\x21-ɏ]+").fullmatch
        self.odd = re.compile(r"[\x00-\x08\x0e-\x1f\x85]").search
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def slow_bytes(self, text: str) -> bytes:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, chunks: set[str]) -> None:
        easy = [c for c in chunks if self.plain(c)]
        for c in chunks.difference(easy):  # few
            self.new[c] = self.slow_bytes(c)
        if not easy:
            return
        cut = [self.words(c.lower()) for c in easy]
        n = np.array([len(w) for w in cut])
        flat = [w for x in cut for w in x]
        got = self.ranked.encode_to_numpy("\x01".join(flat) + "\x01")
        word_end = np.flatnonzero(self.ends[got]) + 1
        last = np.concatenate([[0], word_end])[np.cumsum(n)] * 4
        data, at = self.ids[got].tobytes(), 0
        for c, to in zip(easy, last.tolist()):
            self.new[c] = data[at:to]
            at = to

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null text counts as empty."""
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif self.odd(text):
                out.append(self.slow_bytes(text))
            else:
                chunks = text.split()
                if missing := set(filterfalse(self.new.__contains__, chunks)):
                    if kept := [c for c in missing if c in self.old]:
                        self.new.update((c, self.old[c]) for c in kept)
                        missing.difference_update(kept)
                    if missing:
                        self.learn(missing)
                out.append(b"".join(map(self.new.__getitem__, chunks)))
                if len(self.new) > self.KEEP:
                    self.old, self.new = self.new, {}
        return out


_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One encoder for each process and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
