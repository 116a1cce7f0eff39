"""Token ids of whole texts from a public tokenizer file, with a memo of chunks between white space.

The tokenizer drops white space and treats what lies between it alone, so a text's ids are its chunks' ids in a row; the
memo holds them as little-endian unsigned 32-bit bytes. It is bounded by bytes, and emptied when full and when a task
ends, since Python workers outlive their tasks. Long texts are cut at white space and encoded part by part. Arrow cuts the
texts and numbers the different chunks, so that the memo is asked once for each of them, and numpy puts the ids in place.

New words of Latin letters go to the library's BPE model many in one call, in lower case and joined by blanks, and its ids
are cut again at the ends of words, which the vocabulary marks. ASCII symbols after a word are a chunk of their own, as
they are to the tokenizer's pattern. All other chunks go through the library's encoder, one by one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tokenizers import Tokenizer, pre_tokenizers

from ._arrow import trim

#: Bytes of a process's memo at which it is emptied; an entry takes ENTRY_BYTES besides its letters and ids.
MEMO_BYTES, ENTRY_BYTES = 96 << 20, 200
#: Characters of a text that are cut into chunks together: a longer text is encoded in parts of about so many.
PART_CHARS = 1 << 18
ID_BYTES = 4
#: Bytes of text that are encoded together: new chunks are found once for all of them.
ENCODE_BYTES = 4 << 20
#: Chunks that the library encodes together; its results take some hundred bytes each. So many words are joined.
BATCH_CHUNKS, JOIN_WORDS = 4096, 512


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BLANK = re.compile(r"[ \t\n\r]")


def parts(text: str) -> Iterator[str]:
    """The text in parts that end at white space; a chunk is never cut."""
    at = 0
    while len(text) - at > PART_CHARS:
        blank = _BLANK.search(text, at + PART_CHARS)
        if not blank:
            break
        yield text[at : blank.start()]
        at = blank.end()
    yield text[at:] if at else text


class ChunkEncoder:
    """Ids of texts by the ``word_bpe`` kind of tokenizer file: NFC, lower case, white space dropped, word ends marked."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads would spin beside it
        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for token, k in vocabulary.items() if token.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
        self.clear()

    def _whole(self, chunks: list[str]) -> list[bytes]:
        cut = (chunks[k : k + BATCH_CHUNKS] for k in range(0, len(chunks), BATCH_CHUNKS))
        return [np.array(x.ids, "<u4").tobytes() for c in cut for x in self.tokenizer.encode_batch_fast(c, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> Iterator[bytes]:
        """The ids of words of small Latin letters."""
        for k in range(0, len(words), JOIN_WORDS):
            own = words[k : k + JOIN_WORDS]
            mapped = [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in own]
            (found,) = self.words.encode_batch_fast([" ".join(mapped)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = ((np.flatnonzero(self.last[ids]) + 1) * ID_BYTES).tolist()
            if len(ends) != len(own):
                raise ValueError("the tokenizer file does not mark the end of each word")
            raw = ids.tobytes()
            yield from (raw[a:b] for a, b in pairwise([0, *ends]))

    def clear(self) -> None:
        self.memo = {"": b""}
        self.held = 0

    def learn(self, chunks: Iterable[str]) -> None:
        """Take the ids of new chunks into the memo."""
        memo, before, words, ended, other = self.memo, len(self.memo), [], [], {}
        for chunk in chunks:
            word = chunk.rstrip(punctuation)
            if word.isalpha() and (word.isascii() or (max(word) < "\u0200" and "\u0130" not in word)):  # lower case and NFC act on single letters here
                words.append(word)
                if len(word) < len(chunk):
                    end = chunk[len(word) :]
                    ended.append((chunk, word, end))
                    if end not in memo:
                        other[end] = None
            else:
                other[chunk] = None
        lower = [w.lower() for w in words]
        new = [w for w in dict.fromkeys(lower) if w not in memo]
        memo.update(zip(new, self._letters(new), strict=True))
        memo.update(zip(words, map(memo.__getitem__, lower), strict=True))
        memo.update(zip(other, self._whole(list(other)), strict=True))
        memo.update((chunk, memo[word] + memo[end]) for chunk, word, end in ended)
        self.held += (len(memo) - before) * ENTRY_BYTES + sum(map(len, other)) * (ID_BYTES + 1)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        # the library takes four control characters for ordinary ones that Arrow's and Python's split take for white space
        odd = {k for k, t in enumerate(texts) if any(c in t for c in "\x1c\x1d\x1e\x1f")}
        apart = {k for k, t in enumerate(texts) if len(t) > PART_CHARS} | odd
        if not apart:
            return self._encode(texts)
        rest = iter(self._encode([t for k, t in enumerate(texts) if k not in apart]))
        whole = {k: b"".join(x for p in parts(texts[k]) for x in (self._whole([p]) if k in odd else self._encode([p]))) for k in apart}
        return [whole[k] if k in apart else next(rest) for k in range(len(texts))]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.held > MEMO_BYTES:
            self.clear()
        cut = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        numbered = cut.flatten().dictionary_encode()
        chunks = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn([c for c in chunks if c not in self.memo])
        ids = [self.memo[c] for c in chunks]
        values = np.frombuffer(b"".join(ids), "<u4")
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // ID_BYTES
        begins = np.cumsum(lengths) - lengths
        which = numbered.indices.to_numpy()
        own = lengths[which]
        after = np.concatenate([[0], np.cumsum(own)])
        places = np.repeat(begins[which] - after[:-1], own)
        places += np.arange(len(places))
        raw = values[places].tobytes()
        bounds = (after[cut.offsets.to_numpy()] * ID_BYTES).tolist()
        return [raw[a:b] for a, b in pairwise(bounds)]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The process's encoder for a file, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Give up the process's memos; called when a task ends."""
    for held in _ENCODERS.values():
        held.clear()
    trim()
