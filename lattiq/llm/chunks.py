"""Exact decomposition of texts into chunks that a byte-level BPE encodes independently.

The pre-tokenizer of the byte-level vocabularies never lets a piece cross the place before a single
space that stands between two characters which are not white space. A text may therefore be cut there;
equal chunks are encoded once per batch (and kept in a bounded memory), and the ids of a document are
those of its chunks in order. Texts where a space touches other white space are cut into the
pre-tokenizer's own pieces instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: White space in the sense of Unicode, and four control characters that some engines count as such.
_WS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = f"[^{_WS[1:]}"


class ChunkEncoder:
    """Encodes record batches of texts.

    encode: for an array of distinct chunks, their ids in one flat array, and the number of ids of each.
    pattern: the pre-tokenizer's pattern, for texts that cannot be cut at spaces.
    remember: bound on the number of chunks kept between batches; beyond it the half that was met in most batches stays.
    whole: strings that the encoder takes for tokens of their own; a text that holds one is a chunk by itself.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], pattern: str, remember: int = 1_000_000, whole: tuple[str, ...] = ()):
        self.encode, self.pattern, self.remember = encode, regex.compile(pattern), remember
        self.whole = "|".join(map(re.escape, sorted(whole)))
        self.known = pa.array([], pa.string())
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.met = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keeps the chunks that were met most often, those learned last among equals."""
        n = len(self.known)
        kept = np.sort(np.argsort(self.met, kind="stable")[max(0, n - self.remember // 2) :])
        length = self.length[kept]
        ends = np.cumsum(length, dtype=np.int64)
        self.used = int(ends[-1]) if len(ends) else 0
        self.pool = self.pool[np.repeat(self.start[kept] - (ends - length), length) + np.arange(self.used)]
        self.known = self.known.take(pa.array(kept))
        self.start, self.length, self.met = ends - length, length, (self.met[kept] + 1) // 2

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """The numbers of chunks in the memory; those it lacks are encoded first."""
        at = pc.index_in(chunks, value_set=self.known)
        if at.null_count:
            lacking = chunks.filter(at.is_null())
            new = pc.unique(lacking)
            ids, sizes = self.encode(new)
            if self.used + len(ids) > len(self.pool):
                more = np.zeros(max(2 * len(self.pool), self.used + len(ids)), np.uint32)
                more[: self.used] = self.pool[: self.used]
                self.pool = more
            self.pool[self.used : self.used + len(ids)] = ids
            places = pc.add(pc.index_in(lacking, value_set=new), pa.scalar(len(self.known), pa.int32()))
            self.known = pa.concat_arrays([self.known, new])
            self.start = np.concatenate([self.start, self.used + np.cumsum(sizes) - sizes])
            self.length = np.concatenate([self.length, sizes.astype(np.int32)])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])
            self.used += len(ids)
            at = pc.replace_with_mask(at, at.is_null(), places)
        out = at.to_numpy(zero_copy_only=False).astype(np.int64)
        self.met[out] += 1  # once for each, however often it stands in the batch
        return out

    def elements(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text the numbers of its chunks: one flat array, and the offsets of the texts in it."""
        if len(self.known) > self.remember:
            self._forget()
        column = pc.fill_null(column, "")
        odd = pc.match_substring_regex(column, f" {_WS}|{_WS} ").to_numpy(zero_copy_only=False)
        own = pc.match_substring_regex(column, self.whole).to_numpy(zero_copy_only=False) if self.whole else np.zeros(len(column), bool)
        odd = odd | own
        parts = pc.split_pattern(column, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets, flat = offsets - offsets[0], parts.flatten()
        coded = pc.dictionary_encode(flat)
        words, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        first = np.zeros(len(at), bool)
        first[offsets[:-1]] = True
        of_odd = np.repeat(odd, np.diff(offsets))
        seen = np.zeros((2, len(words)), bool)
        seen[first[~of_odd].astype(np.int8), at[~of_odd]] = True
        spaced, leading = np.flatnonzero(seen[0]), np.flatnonzero(seen[1])
        leading = leading[pc.binary_length(words.take(pa.array(leading))).to_numpy(zero_copy_only=False) > 0]  # nothing stands before a leading space
        pieces = {int(i): [column[int(i)].as_py()] if own[i] else self.pattern.findall(column[int(i)].as_py()) for i in np.flatnonzero(odd)}
        wanted = [pc.binary_join_element_wise("", words.take(pa.array(spaced)), " "), words.take(pa.array(leading)), pa.array([p for x in pieces.values() for p in x], pa.string())]
        numbers = np.split(self._numbers(pa.concat_arrays(wanted)), np.cumsum([len(x) for x in wanted])[:-1])
        to = np.full((2, len(words) + 1), -1, np.int64)
        to[0, spaced], to[1, leading] = numbers[0], numbers[1]
        out = to[first.astype(np.int8), at]
        if pieces:
            of_piece = np.split(numbers[2], np.cumsum([len(x) for x in pieces.values()])[:-1])
            rows = [out[offsets[i] : offsets[i + 1]] for i in range(len(column))]
            for i, x in zip(pieces, of_piece, strict=True):
                rows[i] = x
            out, offsets = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return out, offsets

    def lengths(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        chunks, offsets = self.elements(column)
        total = np.concatenate([[0], np.cumsum(np.where(chunks < 0, 0, self.length[chunks]))])
        return total[offsets[1:]] - total[offsets[:-1]]

    def flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one uint32 array, and the offsets of the texts in it."""
        chunks, offsets = self.elements(column)
        sizes = np.where(chunks < 0, 0, self.length[chunks])
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[chunks] - (ends - sizes), sizes)
        return self.pool[at + np.arange(total)], np.concatenate([[0], ends])[offsets]
