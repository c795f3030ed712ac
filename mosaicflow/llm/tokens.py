"""Token ids of public vocabularies, loaded once a worker."""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

ENDOFTEXT = "<|endoftext|>"
ENDOFTEXT_ID = 50256
#: Texts of these characters alone split alike in both libraries, whatever their Unicode version: letters and signs
#: of the Latin blocks and common punctuation, without the controls on which the two differ over white space.
_PLAIN = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ‐-‧€]").search
#: Longer texts go to the encoder in parts, cut before a single space between two others, where tokens never cross.
PART_CHARS = 200_000
_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")


def file_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def parts(text: str, most: int = PART_CHARS) -> list[str]:
    out, at = [], 0
    while len(text) - at > most and (cut := _CUT.search(text, at + most)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


@functools.lru_cache(maxsize=4)
def _ranked(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def _ordinary(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


class PieceBPE:
    """Ids of a sentencepiece model, which puts a space before a text."""

    def __init__(self, vocabulary: str = "piece_bpe_32k"):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=file_of(f"{vocabulary}.model"))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.model.encode(texts, num_threads=1)]

    def token_bytes(self) -> list[bytes]:
        """What each id stands for: its piece with spaces, or one byte."""
        m = self.model
        return [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(m.id_to_piece(list(range(m.get_piece_size()))))]


class ByteBPE:
    """Ids as the tokenizers file gives them without special tokens added.

    The same vocabulary as ranks is several times faster, so plain texts take that way; others take the file's own.
    The string of the end-of-text token is that token, as in the file.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        self.fast = _ranked(file_of(f"{vocabulary}.tiktoken"))
        self.json = file_of(f"{vocabulary}.json")

    def ids(self, text: str) -> np.ndarray:
        if _PLAIN(text):
            return np.array(_tokenizer(self.json).encode(text, add_special_tokens=False).ids, np.uint32)
        if ENDOFTEXT in text:
            first, *rest = (self._plain(x) for x in text.split(ENDOFTEXT))
            return np.concatenate([first, *(y for x in rest for y in (np.array([ENDOFTEXT_ID], np.uint32), x))])
        return self._plain(text)

    def ordinary(self, text: str) -> np.ndarray:
        """Ids where strings of special tokens are plain text."""
        return np.array(_ordinary(self.json).encode(text, add_special_tokens=False).ids, np.uint32) if _PLAIN(text) else self._plain(text)

    def token_bytes(self) -> list[bytes]:
        """What each id stands for, but for the end-of-text token."""
        return [self.fast.decode_single_token_bytes(i) for i in range(self.fast.max_token_value + 1)]

    def _plain(self, text: str) -> np.ndarray:
        found = [self.fast.encode_to_numpy(x, disallowed_special=()) for x in parts(text) if x]
        return found[0] if len(found) == 1 else np.concatenate([np.zeros(0, np.uint32), *found])
