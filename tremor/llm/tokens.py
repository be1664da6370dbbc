"""Token ids of whole texts by the tokenizers library, remembered for pieces that cannot influence each other.

The pre-tokenizer of byte-level BPE always cuts before a blank that stands between two other characters. So a text is
the concatenation of its pieces split there, and the ids of a piece do not depend on its neighbours. It cuts between letters and
the marks after them as well, so a word with such a tail is put together of both. Unknown pieces go to the
library, many in one call. Pieces are kept in two generations of about ``room`` entries, so memory stays bounded
whatever the vocabulary of the texts.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Parameter: the public vocabulary, by name.
VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
ROOM = 500_000
_JOINT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r" (?:\s|(?<=\s ))")
_BLOCK = 4096
#: Marks that are no letters, digits or white space.
_MARKS = string.punctuation


@cache
def encoder(vocabulary: str = VOCABULARY, room: int = ROOM) -> Encoder:
    """One for each Python worker."""
    return Encoder(vocabulary, room)


class Encoder:
    def __init__(self, vocabulary: str, room: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.tokenizer.encode_special_tokens = True
        names = self.tokenizer.get_vocab()
        self.n_ids = max(names.values()) + 1
        self.n_bytes = np.zeros(self.n_ids, np.int64)
        for name, i in names.items():
            self.n_bytes[i] = len(name)  # a character of a name stands for a byte
        self.room = room
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _learn(self, fresh: list[str]) -> None:
        tailed, cores = [], set()
        plain = []
        for p in fresh:
            if p and p[-1] in _MARKS and (core := p.rstrip(_MARKS)).isalpha():
                tailed.append((p, core))
                if core not in self.new:
                    if (ids := self.old.get(core)) is None:
                        cores.add(core)
                    else:
                        self.new[core] = ids
            else:
                plain.append(p)
        cores.difference_update(plain)
        self._ask(plain + list(cores))
        for p, core in tailed:
            tail = p[len(core) :]
            if (ids := self.tails.get(tail)) is None:
                if len(self.tails) >= _BLOCK:
                    self.tails.clear()
                # marks alone are cut as they are after a letter
                ids = self.tails[tail] = np.array(self.tokenizer.encode_batch_fast([tail], add_special_tokens=False)[0].ids, "<u4").tobytes()
            self.new[p] = self.new[core] + ids

    def _ask(self, fresh: list[str]) -> None:
        """Pieces that begin and end with something else than white space are a text again when strung together."""
        strung = [p for p in fresh if p and not (p[0].isspace() or p[-1].isspace())]
        for k in range(0, len(strung), _BLOCK):
            part = strung[k : k + _BLOCK]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(p.encode()) + 1 for p in part])
            cuts = (4 * np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 4).tolist()
            raw = ids.tobytes()
            self.new.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts], cuts)), strict=False))
        if len(strung) < len(fresh):
            rest = [p for p in fresh if p not in self.new]
            for p, e in zip(rest, self.tokenizer.encode_batch_fast([" " + p for p in rest], add_special_tokens=False), strict=True):
                self.new[p] = np.array(e.ids, "<u4").tobytes()

    def encode_many(self, texts: Iterable[str | None]) -> list[bytes]:
        """For each text its ids, little-endian unsigned 32-bit, without an end id; none for null or empty texts."""
        if len(self.new) > self.room:
            self.old, self.new = self.new, {}
        cuts: list[list[str]] = []
        found: list[list[bytes | None]] = []
        lacks: list[list[int]] = []
        absent: set[str] = set()
        for t in texts:
            if not t:
                cuts.append([])
                found.append([])
                lacks.append([])
                continue
            c = _JOINT.split(t) if t[0] == " " or t[-1] == " " or _ODD.search(t) else t.split(" ")
            got = list(map(self.new.get, c))
            got[0] = b""  # the first piece has no blank before it
            lack = [i for i, g in enumerate(got) if g is None] if None in got else []
            absent.update([c[i] for i in lack])
            cuts.append(c)
            found.append(got)
            lacks.append(lack)
        fresh = []
        for p in absent:
            if (ids := self.old.get(p)) is None:
                fresh.append(p)
            else:
                self.new[p] = ids
        self._learn(fresh)
        heads = self.tokenizer.encode_batch_fast([c[0] for c in cuts if c], add_special_tokens=False)
        ahead = iter(heads)
        out = []
        for c, got, lack in zip(cuts, found, lacks, strict=True):
            if not c:
                out.append(b"")
                continue
            for i in lack:
                got[i] = self.new[c[i]]
            got[0] = np.array(next(ahead).ids, "<u4").tobytes()
            out.append(b"".join(got))
        return out

    def encode_column(self, column: pa.Array, step: int = 512) -> Iterator[bytes]:
        """As ``encode_many``, for a column of texts, a few at a time."""
        for lo in range(0, len(column), step):
            yield from self.encode_many(column[lo : lo + step].to_pylist())

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_many([text])[0], "<u4")
