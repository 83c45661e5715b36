"""Token ids of whole texts, with the parts that repeat looked up instead of encoded."""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back, tokenizer_path

#: Letters for which Python and the tokenizer agree on case and class, for the short way.
_LOW = "a-zß-öø-ÿ"
_SAFE = re.compile(r"[!-~ß-öø-ÿÀ-ÖØ-Þ]*\Z")
#: The tokenizer's own pre-tokenizing pattern, for lower-cased text of safe characters.
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOW}]+|[0-9]|[^{_LOW}0-9]+")


def _byte_letters() -> dict[int, str]:
    """How byte-level BPE writes each byte as a character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class WordTokenizer:
    """Ids of texts under a tokenizer that never looks across blanks (word_bpe_49k).

    A text is split at blanks and line feeds; each chunk's ids come from a bounded
    cache. A new chunk of plain characters is lower-cased and cut into the
    tokenizer's pieces here, and only its new pieces go through the merges;
    any other chunk is encoded by the tokenizer itself.
    """

    def __init__(self, name: str = "word_bpe_49k.json", most: int = 50_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.merge = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.special[0][:2] if all(s[:2] == self.special[0][:2] for s in self.special) else ""
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.most = most  # chunks of each of the two generations
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self._turn_over()

    def _turn_over(self) -> None:
        """Start a new generation; the last one is still looked up on a miss."""
        old, make, self.pieces = self.chunks, self._chunk, {}

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                out = self[chunk] = old[chunk] if chunk in old else make(chunk)
                return out

        if hasattr(old, "forget"):
            old.forget()
        Chunks.forget = lambda _: old.clear()
        self.chunks = Chunks({"": b""})

    def forget(self) -> None:
        """Drop all that was looked up."""
        self._turn_over()
        self._turn_over()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            found = self.pieces[piece] = array("I", [t.id for t in self.merge(written)]).tobytes()
        return found

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            if chunk.isalpha():
                return self._piece(chunk.lower())
            if chunk[:-1].isalpha():  # a word and its punctuation mark or digit
                return self._piece(chunk[:-1].lower()) + self._piece(chunk[-1])
        if _SAFE.match(chunk) and (self.mark not in chunk or not any(s in chunk for s in self.special)):
            return b"".join(map(self._piece, _PIECE.findall(chunk.lower())))  # such characters are already composed
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: none), in the order of texts."""
        if len(self.chunks) > self.most:
            self._turn_over()
            give_back()  # what a generation leaves lies scattered, and would add up
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.string()).fill_null(""), "\n", " "), " ")
        coded = split.values.slice(split.offsets[0].as_py(), split.offsets[-1].as_py() - split.offsets[0].as_py()).dictionary_encode()
        ids = list(map(self.chunks.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
        listed = pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), pa.array(np.frombuffer(b"".join(ids), np.uint32)))
        taken = listed.take(coded.indices)
        bounds = taken.offsets.to_numpy()[split.offsets.to_numpy() - split.offsets[0].as_py()]
        values = taken.values.to_numpy()
        return [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@functools.lru_cache(maxsize=1)
def word_tokenizer(name: str) -> WordTokenizer:
    """This process's one tokenizer, which a worker's tasks share."""
    return WordTokenizer(name)
