"""Token ids of whole texts with the ``tokenizers`` library, each distinct piece of text encoded once.

A text is cut only where the vocabulary's own pre-tokenizer always cuts, so the pieces' ids laid end to end are
the ids of the whole text. Arrow cuts a block of texts and numbers its different pieces, so only these become Python
objects. Pieces repeat, and their ids (little-endian unsigned 32-bit) are kept in a table of bounded size in each worker.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The first so many different pieces are kept; common ones are among them.
MOST_PIECES = 600_000
#: Pieces encoded in one call.
RUN = 1000
#: Characters of texts whose pieces are numbered together: the more, the fewer are looked up.
BLOCK_CHARACTERS = 1 << 20
STOPS = [".", ","]
LONG_PIECE = 64
#: White space for byte-level BPE: a cut before a space or line feed that a character other than white space follows.
#: Python also takes \x1c-\x1f for white space; where they stand there is no cut.
_BEFORE_WORD = re.compile(" (?=[^\\s\x1c-\x1f])|(?=\n[^\\s\x1c-\x1f])")
#: For Arrow: texts with a space or line feed at which there is no cut.
_UNCUT_SPACE = r"[ \n]([\t-\r\x1c-\x20\x{85}\pZ]|\z)"
_WHITE = re.compile("[^\\S\x1c-\x1f]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def word_pieces(text: str) -> list[str]:
    """Cuts of pre-tokenizers that drop all white space (Python's, but for \\x1c-\\x1f)."""
    return [p for p in _WHITE.split(text) if p] if _SEPARATORS.search(text) else text.split()


def _parts(ids: list[int], ends: np.ndarray) -> list[bytes]:
    data, ends = np.array(ids, "<u4").tobytes(), [0, *(4 * ends).tolist()]
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Coder:
    """ids(texts) -> bytes of each text's ids. spaced: byte-level BPE with ' ?letters', where a space stays with the word that follows; a line feed before a word is a pre-token."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        # Added tokens are found before all pre-tokenizing, across any cut; one that is sought in normalised text may stand anywhere.
        self.added, self.uncut = [t.content for t in added], any(t.normalized for t in added)
        #: Bytes of each token: byte-level BPE spells one as one character.
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(1 + max(vocabulary.values()), np.int64)
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        #: Ids by piece. Spaced: the piece without its space; with one if it has none, at the start of a text; from a line feed on as it is.
        self.spaced, self.known = spaced, {}
        self.stops = dict(zip(STOPS, self._encode(STOPS), strict=True))

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces as they are spelled in a text."""
        out: list[bytes] = []
        for at in range(0, len(pieces), RUN):
            run = pieces[at : at + RUN]
            got = self.tokenizer.encode(run, is_pretokenized=True, add_special_tokens=False)
            out += _parts(got.ids, np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(run)), side="right"))
        return out

    def _encode_spaced(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that begin with a space or line feed, before which there always is a cut: laid end to end, parted by their tokens' bytes."""
        out: list[bytes] = []
        for at in range(0, len(pieces), RUN):
            run = pieces[at : at + RUN]
            text, ends = "".join(run), np.cumsum([len(p.encode()) for p in run])
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
            covered = np.cumsum(self.sizes[ids])
            last = np.searchsorted(covered, ends)
            if not any(a in text for a in self.added) and last[-1] == len(ids) - 1 and (covered[last] == ends).all():
                out += _parts(ids, last + 1)
            else:  # tokens that don't stand for the text's own bytes, or an added one with a space in it
                out += self._encode(run)
        return out

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Texts that hold an added token (as <|endoftext|>) are encoded whole, the others by pieces."""
        out, cut = [b""] * len(texts), []
        for k, t in enumerate(texts):
            if t and (self.uncut or any(a in t for a in self.added)):
                out[k] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            elif t:
                cut.append(k)
        held = pa.array([texts[k] for k in cut], pa.string())
        odd = pc.match_substring_regex(held, _UNCUT_SPACE).to_numpy(zero_copy_only=False) if self.spaced else np.ones(len(cut), bool)
        if not odd.all():
            split = pc.split_pattern(pc.replace_substring(held.filter(pa.array(~odd)), "\n", " \n"), " ")
            for k, ids in zip(np.flatnonzero(~odd), self._joined(split.flatten(), split.offsets.to_numpy()), strict=True):
                out[cut[k]] = ids
        if odd.any():
            some = [_BEFORE_WORD.split(texts[cut[k]]) if self.spaced else word_pieces(texts[cut[k]]) for k in np.flatnonzero(odd)]
            starts = np.cumsum([0, *map(len, some)])
            for k, ids in zip(np.flatnonzero(odd), self._joined(pa.array([p for s in some for p in s], pa.string()), starts), strict=True):
                out[cut[k]] = ids
        return out

    def _joined(self, pieces: pa.Array, starts: np.ndarray) -> list[bytes]:
        """The ids of each run of pieces; starts: where the runs start, and the end."""
        numbered = np.zeros(len(pieces), np.int64)
        later = np.ones(len(pieces), bool)
        if self.spaced:
            later[starts[:-1]] = False
        coded = pieces.filter(pa.array(later)).dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbered[later] = coded.indices.to_numpy()
        numbered[~later] = len(different) + np.arange(len(pieces) - len(coded))
        different += [" " + p for p in pieces.filter(pa.array(~later)).to_pylist()]
        joined = pa.array(self._look_up(different), pa.large_binary()).take(pa.array(numbered))
        ends = np.frombuffer(joined.buffers()[1], np.int64)[starts].tolist()
        data = joined.buffers()[2].to_pybytes() if joined.buffers()[2] else b""
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        fresh: dict[str, bytes] = {}
        rest = []
        for k, x in enumerate(found):
            if x is None:
                w = pieces[k]
                # letters, then one full stop or comma: always two pre-tokens, of which the first is often known
                if w[-1] in self.stops and w[-2:-1].isalpha():
                    head, stop = w[:-1], self.stops[w[-1]]
                else:
                    head, stop = w, b""
                if (x := self.known.get(head)) is None:
                    fresh[head] = b""
                    rest.append((k, head, stop))
                else:
                    found[k] = x + stop
        if fresh:
            after = [w for w in fresh if self.spaced and w[0] != " "]
            others = [w for w in fresh if not self.spaced or w[0] == " "]
            fresh = dict(zip(after, self._encode_spaced([w if w[0] == "\n" else " " + w for w in after]), strict=True)) | dict(zip(others, self._encode([w[self.spaced :] for w in others]), strict=True))
            for k, head, stop in rest:
                found[k] = fresh[head] + stop
            if len(self.known) < MOST_PIECES:
                self.known.update((w, x) for w, x in fresh.items() if len(w) <= LONG_PIECE)
        return found


@cache
def coder(path: str, kind: str) -> Coder:
    """One for each worker process. kind: byte_level or word."""
    return Coder(path, spaced={"byte_level": True, "word": False}[kind])


def in_blocks(texts: list[str | None], most: int = 1 << 19):
    """(start, texts) in runs of about ``most`` characters."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield at, texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield at, texts[at:]
