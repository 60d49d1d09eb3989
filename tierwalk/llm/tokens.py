"""Token ids of texts by a byte-level BPE file, with a cache of words.

In a text whose only white space is single blanks and single line ends inside it, the pre-tokenizer never joins anything
across a blank or a line end, so the ids are those of the words (with the blank before them) in turn. Other texts, and
texts that could hold a special token, go to the tokenizer whole.

Edge cases: an empty text has no ids; equal texts have equal ids, whatever the caches hold; caches are bounded and a long
text costs no more of them than its distinct words.
"""

from __future__ import annotations

import os
import string
import struct
from functools import cache
from itertools import islice

#: White space other than blanks and line ends, pairs of those, and what could start a special token.
ODD = (*"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)), "  ", "\n\n", " \n", "\n ", "<|")
#: Byte-level alphabets print each byte as one letter: printable Latin-1 as itself, the rest from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = dict(zip(_PLAIN, _PLAIN, strict=True)) | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
#: What the byte-level alphabet prints for each letter below U+0250.
LATIN = ["".join(chr(ALPHABET[b]) for b in chr(i).encode()) for i in range(0x250)]
#: Words with marks are held up to this length: short ones come again, the others are put together each time.
SHORT = 7
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


def packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Packed ids (little-endian uint32) of a word after `before`."""

    def __init__(self, tokenizer, before: str, most: int):
        super().__init__()
        self.tokenizer, self.before, self.most = tokenizer, before, most
        self.first = before.translate(ALPHABET)
        self.marks: dict[str, bytes] = {}

    def _encoded(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        base = word.rstrip(string.punctuation)
        if len(base) < len(word) and base[-1:].isalpha():
            # Marks after a letter are a piece of their own.
            mark = word[len(base) :]
            value = self.marks.get(mark)
            if value is None:
                value = self._encoded(mark)
                if len(self.marks) < 10_000:
                    self.marks[mark] = value
            value = self[base] + value
            if len(word) > SHORT:
                return value
        elif word.isalpha() and (word.isascii() or max(word) < "ɐ"):
            # Letters alone are one piece for the merges.
            piece = word if word.isascii() else word.translate(LATIN)
            value = packed([t.id for t in self.tokenizer.model.tokenize(self.first + piece)])
        else:
            value = self._encoded(self.before + word)
        if len(self) >= self.most:
            # The words met first are by and large the common ones; of the others the older half goes.
            for old in list(islice(self, self.most // 8, self.most // 8 + self.most // 2)):
                del self[old]
        self[word] = value
        return value


class Encoder:
    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.first, self.later = _Words(self.tokenizer, "", most // 4), _Words(self.tokenizer, " ", most)
        self.line = packed(self.tokenizer.encode("\n", add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        """Ids of a text, packed."""
        if not text:
            return b""
        if text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, ODD)):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        out: list[bytes] = []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(self.first[words[0]])
            out.extend(map(self.later.__getitem__, words[1:]))
            out.append(self.line)
        out.pop()
        return b"".join(out)

    def clear(self) -> None:
        self.first.clear()
        self.later.clear()


@cache
def encoder(path: str) -> Encoder:
    """One encoder a process, so that its words outlive a task."""
    return Encoder(path)
