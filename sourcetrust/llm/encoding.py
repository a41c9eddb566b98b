"""Token ids by the `tokenizers` library, chunk by chunk with a bounded memory of chunks.

Most words of a corpus repeat, and the library costs many times a dictionary lookup. Both
splitters cut a text only where no token can span the cut, so the ids are those of the whole text.
Words that a batch of texts brings anew are encoded together, where words end at white space.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sourcetrust.llm.tables import Memory, worker_value

TOGETHER = 256  # new words that are encoded as one text
BATCH_CHARS = 1 << 23  # texts whose new words are learned together
KNOWN = 1_300_000  # chunks remembered by one Python worker, at most
SIGNS = ".,;:!?)|#$%&*"  # fixed value: signs that no token joins to a letter before them
BAR = "|"  # stands between new words that are encoded together; words with it are encoded alone


class _Unsafe(Exception):
    """A cut beside white space, where a token may span."""


class Encoder:
    """Little-endian unsigned ids (`dtype`) of texts; `special` strings in a text are matched as the library does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a batch here is one text
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __call__(self, text: str) -> bytes:
        return self.whole(text)

    def many(self, texts: list[str]) -> list[bytes]:
        return [self(text) for text in texts]

    def _together(self, words: list[str], before: str, between: str, after: str, mark: int) -> list[bytes]:
        """Ids of `before + word` for each word, in texts where `between`, whose id `mark` no word has, and `after` stand after a word."""
        out: list[bytes] = []
        for at in range(0, len(words), TOGETHER):
            some = words[at:at + TOGETHER]
            made = self.library.encode_batch_fast([before + f"{between}{after}".join(some)], add_special_tokens=False)[0]
            ids = np.asarray(made.ids, self.dtype)
            ends = np.flatnonzero(ids == mark).tolist()
            if len(ends) != len(some) - 1:
                out += [self.whole(before + w) for w in some]
                continue
            wide, data = self.dtype.itemsize, ids.tobytes()
            out += [data[wide * a:wide * b] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)])]
        return out

    def _looked_up(self, lists: pa.ListArray, memory: Memory, is_word: Callable[[str], bool], make: Callable[[list], list]):
        """Of each word of the flattened lists where its ids begin, their bytes one after the other, and which words have none.

        A word is looked up once, however often it stands in the lists; new ones are made together.
        """
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(memory.get, words))
        new = [word for word, ids in zip(words, found) if ids is None]
        made = self._learned(memory, new, is_word, make)
        at_hand = iter(list(map(memory.__getitem__, new)))
        found = [next(at_hand) if ids is None else ids for ids in found]
        memory.forget_long(made)
        unsafe = np.zeros(len(found), bool)
        if False in found:
            unsafe[:] = [ids is False for ids in found]
            found = [ids or b"" for ids in found]
        table = pa.array(found, pa.large_binary()).take(coded.indices)
        at, data = np.frombuffer(table.buffers()[1], np.int64, len(table) + 1, 8 * table.offset), table.buffers()[2]
        return at, memoryview(data or b""), unsafe[coded.indices.to_numpy()]

    def _learned(self, memory: Memory, new: list, is_word: Callable[[str], bool], make: Callable[[list], list]) -> list:
        """Have the ids of all words in `new` at hand; gives those that had to be made. Signs after letters are looked up apart."""
        bases = {word: base for word in new if word[-1:] in SIGNS and word and is_word(base := word.rstrip(SIGNS))}
        made = memory.learn(set(bases.values()).union(word for word in new if word not in bases), make)
        memory.add({word: memory[base] + self.sign[word[len(base):]] for word, base in bases.items()})
        return made + list(bases)


class SpacedEncoder(Encoder):
    """For byte-level vocabularies whose words carry the space before them.

    A cut before one space or line feed between two characters that are not white space is
    safe: a token starts there and the one before has ended.
    """

    CUT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        super().__init__(path)
        self.first, self.sign = Memory(KNOWN // 10, self._first), Memory(1000, self.whole)
        self.later = Memory(KNOWN, lambda chunk: self._made([chunk])[0])
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.mark = line[0] if len(line) == 1 else -1

    def _first(self, chunk: str) -> bytes:
        if not chunk or chunk[-1].isspace():
            raise _Unsafe
        return self.whole(chunk)

    def _made(self, chunks: list[str]) -> list[bytes | bool]:
        """Ids of chunks after the first, which a space or their own line feed begins; `False` for one that may not be cut off."""
        plain = [c for c in chunks if c and "\n" not in c and not (c[0].isspace() or c[-1].isspace())]
        ids: dict[str, bytes | bool] = dict(zip(plain, self._together(plain, " ", "\n", " ", self.mark), strict=True))
        if len(plain) < len(chunks):
            rest = [c for c in chunks if c not in ids]
            lines = [c for c in rest if c[:1] == "\n" and c[1:] and "\n" not in c[1:] and not (c[1].isspace() or c[-1].isspace())]
            feed = self.whole("\n")
            made = self._together([c[1:] for c in lines], "", "\n", "", self.mark)
            ids.update((c, feed + m) for c, m in zip(lines, made, strict=True))
            # several lines, where white space stands beside other white space
            ids.update((c, self.whole(" " + c) if c and not (c[0].isspace() or c[-1].isspace()) else False) for c in rest if c not in ids)
        return [ids[chunk] for chunk in chunks]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        at, data, unsafe = self._looked_up(lists, self.later, str.isalpha, self._made)
        ends, wrong, out = lists.offsets.to_numpy(), np.concatenate([[0], np.cumsum(unsafe)]), []
        for text, low, high in zip(texts, ends[:-1].tolist(), ends[1:].tolist()):
            if not text:
                out.append(b"")
                continue
            first = text[:min(i for i in (text.find(" "), text.find("\n"), len(text)) if i >= 0)]
            try:
                if wrong[high] > wrong[low + 1]:
                    raise _Unsafe
                out.append(self.first[first] + data[at[low + 1]:at[high]])
            except _Unsafe:
                out.append(self._slow(text))
        return out

    def _slow(self, text: str) -> bytes:
        """The same where white space stands beside other white space."""
        first, *later = self.CUT.split(text)
        out = [self.whole(first)]
        safe = {chunk for chunk in later if not chunk[-1].isspace()}
        made = self._learned(self.later, list(safe.difference(self.later)), str.isalpha, self._made)
        for chunk in later:
            out.append(self.later[chunk] if chunk in safe else self.whole(" " + chunk))
        self.later.forget_long(made)
        return b"".join(out)


class WordEncoder(Encoder):
    """For vocabularies whose words end at white space, which itself has no ids."""

    def __init__(self, path: str):
        super().__init__(path)
        self.words, self.sign = Memory(KNOWN, self.whole), Memory(1000, self.whole)
        bar = self.library.encode(BAR, add_special_tokens=False).ids
        self.mark = bar[0] if len(bar) == 1 else -1

    @staticmethod
    def _is_word(base: str) -> bool:
        return base.isalpha() if base.isascii() else unicodedata.normalize("NFC", base).lower().isalpha()

    def _made(self, words: list[str]) -> list[bytes]:
        plain = [word for word in words if BAR not in word]
        ids = dict(zip(plain, self._together(plain, " ", f" {BAR}", " ", self.mark), strict=True))
        return [ids[word] if word in ids else self.whole(word) for word in words]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        at, data, _ = self._looked_up(lists, self.words, self._is_word, self._made)
        ends = at[lists.offsets.to_numpy()].tolist()
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]


KINDS = {"whole": Encoder, "spaced": SpacedEncoder, "words": WordEncoder}


def encoder(path: str, kind: str = "whole") -> Encoder:
    """The worker's encoder for a vocabulary file; `kind` says how texts may be cut."""
    return worker_value(f"encoder {kind} {path}", lambda: KINDS[kind](path))


def encoded_texts(encode: Encoder, texts: Iterable[str | None]) -> Iterator[bytes]:
    """Ids of texts (null: empty), taken some at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= BATCH_CHARS:
            yield from encode.many(held)
            held, size = [], 0
    yield from encode.many(held)
