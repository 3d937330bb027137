"""Token ids of a byte-level BPE vocabulary, word by word from a cache."""

from __future__ import annotations

import base64
import os
import re
import struct

#: A worker's cache starts anew once it holds so many pieces of text.
CACHED = 400_000
#: What the quick way leaves to the tokenizer itself: characters outside ASCII and the Latin letters,
#: white space other than single spaces and line ends, and the text of the special token.
_UNUSUAL = re.compile(r"[^\n\x20-\x7eÀ-ÖØ-öø-ſ]|  |\n\n| \n|\n |<\|endoftext\|>| \Z|\n\Z")


class _Words(dict):
    """Text between two spaces (``lead`` put before it) -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, encode, lead: str) -> None:
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        ids = self.encode(self.lead + word)
        out = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return out


class TokenBytes:
    """``__call__(text)``: the ids of ``text`` as little-endian unsigned 32-bit numbers.

    The ids are those of ``tokenizers`` with ``add_special_tokens=False``. The vocabulary
    splits text before it merges, and a single space or line end between other characters
    always begins a new piece; so ordinary text is cut there and each piece is looked up. The
    pieces that the cache lacks are encoded from the same vocabulary as ranks, where that file is at hand, which is
    quicker for short strings. Any other text goes to ``tokenizers`` whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        encode, ranks = self._slow, path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken
            from public_tokenizers import PATTERN

            pairs = (line.split() for line in open(ranks, "rb"))
            encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={}).encode_ordinary
        self.first, self.later = _Words(encode, ""), _Words(encode, " ")
        self.line_end = struct.pack("<I", *encode("\n"))

    def _slow(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0] in " \n" or _UNUSUAL.search(text):
            ids = self._slow(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        lines = []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:])))
        return self.line_end.join(lines)
