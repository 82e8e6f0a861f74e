"""Exact token ids of whole texts from the tokenizers library, piece by piece from a cache.

A change from non-space to white space always ends a pre-token of the
byte-level pattern, and nothing to its left matters to what follows. So a text is
cut there, the library encodes each distinct piece once, and the ids of a
text are those of its pieces in a row. A full stop or comma after a letter is a
pre-token boundary too, so a word and the same word before a comma share one
encoding. Python's white space holds all that the library's does.

Texts come in runs of a few MB: Arrow cuts a run into pieces and numbers the
distinct ones, Python looks at those alone, and numpy gathers the ids of the run.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held_bytes

#: Bytes of pieces and their ids that a worker holds at most: the first it meets, so the frequent ones.
CACHE_BYTES = 96 << 20
#: New pieces that go to the library as one text.
RUN = 2000
#: Bytes of text in a run; a longer text is a run of its own.
RUN_BYTES = 2 << 20
_CUT = re.compile(r"\s+\S*|\S+")
#: Stands before the first piece of a text.
_FIRST = "\0"


class Encoder:
    """Encodes texts with one tokenizer file; ids below 65,536 are kept in two bytes each."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.width = np.uint16 if size <= 1 << 16 else np.uint32
        #: Ids of a piece that follows a blank (which its key leaves out) or begins with a line break.
        self.known: dict[str, bytes] = {}
        self.room = CACHE_BYTES
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        #: Bytes of text that each id stands for; a byte-level token has a letter for each.
        self.lengths = np.array([len(special[i].encode()) if i in special else len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.marks = {m: self._alone(m) for m in ".,"}

    def _alone(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, self.width).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text without added tokens."""
        return self.encode_run(pa.array([text], pa.large_string()))[0]

    def encode_run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts in a row (null: empty), and where each text's begin, with the end of the last."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, self.width), np.zeros(1, np.int64)
        whole = lambda s: pa.scalar(s, pa.large_string())
        lines = pc.replace_substring(texts, "\n", " \n")
        parts = pc.split_pattern(pc.binary_join_element_wise(whole(_FIRST), lines, whole("")), " ")
        cuts = parts.offsets.to_numpy().astype(np.int64)
        cuts -= cuts[0]
        coded = parts.flatten().dictionary_encode()
        kinds, of = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found, odd = self._ids_of(kinds)
        size = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.width).itemsize
        pool = np.frombuffer(b"".join(found), self.width)
        each = size[of]
        reached = np.concatenate([[0], np.cumsum(each)])
        total = int(reached[-1])
        kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
        ids = pool[np.repeat(((np.cumsum(size) - size)[of] - reached[:-1]).astype(kind), each) + np.arange(total, dtype=kind)]
        starts = reached[cuts]
        # Other white space, several in a row, or the sign that marks a first piece: text by text.
        own = pc.match_substring(texts, _FIRST).to_numpy(zero_copy_only=False)
        if odd:
            none = np.zeros(len(kinds), bool)
            none[odd] = True
            own = own | np.logical_or.reduceat(none[of], cuts[:-1])
        if own.any():
            rows = [self._by_pieces(texts[i].as_py()) if o else ids[s:e] for i, (o, s, e) in enumerate(zip(own.tolist(), starts, starts[1:], strict=False))]
            ids, starts = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        return ids, starts

    def documents(self, texts: pa.Array, end_id: int, most: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, starts) of runs of texts of at most so many bytes, each text's ids with ``end_id`` after them."""
        for first, run in runs(texts, most):
            ids, starts = self.encode_run(run)
            yield first, np.insert(ids, starts[1:], self.width(end_id)), starts + np.arange(len(starts))

    def _ids_of(self, kinds: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of pieces, and places of those that can't stand for themselves: empty ones and those that end in white space."""
        found: list = list(map(self.known.get, kinds))
        new: list[str] = []
        later, firsts, odd = [], [], []
        for i in [i for i, x in enumerate(found) if x is None]:
            p = kinds[i]
            if not p or p[-1].isspace():
                found[i] = b""
                odd.append(i)
            elif p[0] == _FIRST:
                firsts.append(i)
            else:
                new.append(p)
                later.append(i)
        fresh = self._fresh(new)
        for i, p in zip(later, new, strict=True):
            found[i] = fresh[p]
        # Before the first piece a line break would be a token of its own.
        lead = {i: "\n" + kinds[i][1:] for i in firsts if len(kinds[i]) > 1 and kinds[i][1] != _FIRST and not kinds[i][1].isspace()}
        held = {p: self.known.get(p) or fresh.get(p) for p in lead.values()}
        held |= self._fresh([p for p, x in held.items() if x is None])
        for i in firsts:
            found[i] = held[lead[i]][np.dtype(self.width).itemsize :] if i in lead else self._alone(kinds[i][1:])
        return found, odd

    def _by_pieces(self, text: str) -> np.ndarray:
        """For texts with other white space, or several in a row."""
        pieces = _CUT.findall(text)
        keys = [(p[1:] if p[0] == " " else p) if p[0] in " \n" and len(p) > 1 and not p[1].isspace() else None for p in pieces]
        plain = set(keys) - {None}
        held = {p: self.known[p] for p in plain if p in self.known}
        held |= self._fresh([p for p in plain if p not in held])
        return np.frombuffer(b"".join([self._alone(p) if k is None else held[k] for p, k in zip(pieces, keys, strict=True)]), self.width)

    def _fresh(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new pieces, which end in no white space, encoded in runs.

        In a run, where one piece ends and the next begins is a cut like any
        other, and the tokens' byte lengths tell whose they are.
        """
        known, marks = self.known, self.marks
        out: dict[str, bytes] = {}
        later = [p for p in new if p[-1] in marks and len(p) > 1 and p[-2].isalpha()]
        stems = dict.fromkeys(p[:-1] for p in later)
        stems |= dict.fromkeys(new)
        for p in later:
            del stems[p]
        run = [p for p in stems if p not in known]
        for i in range(0, len(run), RUN):
            part = [p if p[0] == "\n" else " " + p for p in run[i : i + RUN]]
            joined = "".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.width)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
            if not joined.isascii():
                raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
                ends = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))[ends]
            reached = np.cumsum(self.lengths[ids])
            at = np.searchsorted(reached, ends)
            if len(ids) == 0 or not np.array_equal(reached[np.minimum(at, len(ids) - 1)], ends):
                raise ValueError("tokens cross the cut between two pieces")
            packed, n = ids.tobytes(), ids.itemsize
            cuts = ((at + 1) * n).tolist()
            out.update(zip(run[i : i + RUN], [packed[s:e] for s, e in zip([0, *cuts], cuts, strict=False)], strict=True))
        if self.room > 0:
            for p, x in out.items():
                if p not in known:
                    self.room -= held_bytes(p, x)
                    if self.room < 0:
                        break
                    known[p] = x
        for p in later:
            held = known.get(p[:-1])
            if held is None:
                held = out[p[:-1]]
            out[p] = held + marks[p[-1]]
        return out


def runs(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of at most so many bytes; a longer text is alone."""
    texts, most = texts.cast(pa.large_string()), most or RUN_BYTES
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; kept from task to task."""
    return Encoder(path)
