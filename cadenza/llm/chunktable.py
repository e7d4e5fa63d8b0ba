"""Distinct-chunk tables: segment each distinct chunk once, join ids back by position.

A tokenizer whose tokens never span a single space between two non-space characters
gives the same ids for a text as for its space-separated chunks one by one. A batch of
texts is therefore split by Arrow, its distinct chunks are encoded once, and the ids are
gathered back by position with NumPy. Texts with other white space next to a space take
the regular-expression path, which cuts at the safe places only.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A single space between two characters that are not white space.
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: A chunk that begins with such a space and ends with a character that is not white space.
PLAIN = re.compile(r" \S(?:.*\S)?", re.DOTALL)
#: Bytes of chunks and ids that a worker remembers between batches; further ones are encoded in each batch.
REMEMBERED = 20 << 20
#: Characters of chunks that are encoded as one text.
JOINED = 64 << 10


class ChunkTable:
    """Ids of texts through distinct chunks.

    ``encode`` maps a list of chunks to lists of ids. A chunk is passed with its leading
    space if ``keep_space``, and without it where the encoder adds one by itself.
    ``odd`` tells of distinct space-free parts that their texts need ``cut``, which
    returns a text's chunks. ``joined`` encodes chunks that may follow each other, each a
    space, a character that is not white space and up to another, to (lengths, ids).
    """

    def __init__(self, encode: Callable[[list[str]], list], keep_space: bool, cut: Callable[[str], list[str]], odd: Callable[[list[str]], np.ndarray], joined: Callable | None = None):
        self.encode, self.keep_space, self.cut, self.odd, self.joined = encode, keep_space, cut, odd, joined
        self.known, self.room = pa.array([], pa.large_string()), REMEMBERED
        self.starts, self.lens, self.kept = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint16)

    def _encoded(self, chunks: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of chunks; ``plain`` are those that may be joined."""
        n = len(chunks)
        parts = np.cumsum(np.fromiter(map(len, chunks), np.int64, n)) // JOINED * 2 + plain
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), n] if n else []
        lens, pools = [np.empty(0, np.int64)], [np.empty(0, np.uint16)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            found = self.joined(chunks[low:high]) if self.joined and plain[low] else None
            if found is None:
                each = [np.asarray(ids, np.uint16) for ids in self.encode(chunks[low:high])]
                found = np.fromiter(map(len, each), np.int64, len(each)), np.concatenate([np.empty(0, np.uint16), *each])
            lens.append(found[0])
            pools.append(found[1])
        return np.concatenate(lens), np.concatenate(pools)

    def _lookup(self, chunks: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts in the pool, lengths) of chunks' ids; the pool is what is remembered and this batch's new ids."""
        names = pa.array(chunks, pa.large_string())
        place = pc.index_in(names, value_set=self.known)
        new = np.flatnonzero(place.is_null().to_numpy(zero_copy_only=False))
        own, ids = self._encoded([chunks[i] for i in new.tolist()], plain[new])
        begin = len(self.kept) + np.cumsum(own) - own
        place = place.fill_null(0).to_numpy()
        starts, lens = (np.append(known, 0)[place].astype(np.int64) for known in (self.starts, self.lens))
        starts[new], lens[new] = begin, own
        self.pool = np.concatenate([self.kept, ids])
        cost = np.cumsum(pc.binary_length(names).to_numpy()[new] + 16 + 2 * own)  # its text, an offset, two numbers and ids
        fit = int(np.searchsorted(cost, self.room, "right"))
        if fit:
            self.room -= int(cost[fit - 1])
            self.known = pa.concat_arrays([self.known, names.take(pa.array(new[:fit]))])
            self.starts, self.lens = np.append(self.starts, begin[:fit].astype(np.int32)), np.append(self.lens, own[:fit].astype(np.int32))
            self.kept = self.pool[: begin[fit - 1] + own[fit - 1]].copy()
        return starts, lens

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lengths by text, flat uint16 ids) of an array of texts; null counts as empty."""
        flat, starts, lens, sizes = self._gather(texts)
        by_chunk = lens[flat]
        total = int(by_chunk.sum())
        ends = np.cumsum(by_chunk)
        source = np.repeat(starts[flat] - (ends - by_chunk), by_chunk) + np.arange(total)
        return self._by_text(by_chunk, sizes), self.pool[source]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of ids by text."""
        flat, _, lens, sizes = self._gather(texts)
        return self._by_text(lens[flat], sizes)

    @staticmethod
    def _by_text(by_chunk: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(by_chunk)])
        at = np.concatenate([[0], np.cumsum(sizes)])
        return ends[at[1:]] - ends[at[:-1]]

    def _gather(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy()
        parts = lists.flatten().dictionary_encode()
        words, code = parts.dictionary.to_pylist(), parts.indices.to_numpy().astype(np.int64)
        sizes, n = np.diff(offsets), len(words)
        offsets = offsets - offsets[0]
        strange = self.odd(words)
        firsts = offsets[:-1]
        chunks = words
        if self.keep_space:  # first parts have no space before them, so they are chunks of their own
            chunks = [" " + w for w in words]
            lead, own = np.unique(code[firsts], return_inverse=True)
            chunks += [words[i] for i in lead.tolist()]
            code[firsts] = n + own
            strange = np.concatenate([strange, strange[lead]])
        plain = ~strange
        plain[n:] = False
        bad_rows = np.unique(np.searchsorted(offsets, np.flatnonzero(strange[code]), "right") - 1) if strange.any() else []
        if len(bad_rows):
            extra: dict[str, int] = {}
            pieces, new_sizes, last = [], sizes.copy(), 0
            for row in bad_rows.tolist():
                own = [extra.setdefault(c, len(chunks) + len(extra)) for c in self.cut(texts[row].as_py())]
                pieces += [code[last : offsets[row]], np.asarray(own, np.int64)]
                new_sizes[row], last = len(own), offsets[row + 1]
            code, sizes = np.concatenate([*pieces, code[last:]]), new_sizes
            chunks = chunks + list(extra)
            plain = np.concatenate([plain, np.fromiter((PLAIN.fullmatch(c) is not None for c in extra), bool, len(extra))])
        if len(bad_rows) or self.keep_space:  # drop spaced forms that only occur at a text's start
            seen = np.bincount(code, minlength=len(chunks)) > 0
            used, code = np.flatnonzero(seen), (np.cumsum(seen) - 1)[code]
            chunks, plain = [chunks[i] for i in used.tolist()], plain[used]
        starts, lens = self._lookup(chunks, plain)
        return code, starts, lens, sizes


def byte_level_table(path: str) -> ChunkTable:
    """For a byte-level BPE file of the tokenizers library, special strings as its default."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def cut(text: str) -> list[str]:
        if not text:
            return []
        first, *rest = SAFE_SPACE.split(text)
        return [first, *(" " + x for x in rest)]

    def odd(words: list[str]) -> np.ndarray:
        n = len(words)
        return np.fromiter(map(operator.ne, map(str.strip, words), words), bool, n) | (np.fromiter(map(len, words), np.int64, n) == 0)

    # bytes of each id: a vocabulary entry has a character for each, a special string is itself
    width = np.zeros(max(tokenizer.get_vocab(True).values()) + 1, np.int64)
    for token, i in tokenizer.get_vocab(False).items():
        width[i] = len(token)
    for i, token in tokenizer.get_added_tokens_decoder().items():
        width[i] = len(token.content.encode())

    def joined(chunks: list[str]):
        """(lengths, ids), or None where a chunk's end is not an id's end."""
        ids = np.array(tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, np.uint16)
        sizes = pc.binary_length(pa.array(chunks, pa.large_string())).to_numpy()
        ends, at = np.cumsum(width[ids]), np.cumsum(sizes)
        last = np.searchsorted(ends, at)
        if not len(ends) or ends[-1] != at[-1] or (ends[last] != at).any():
            return None
        return np.diff(last, prepend=-1), ids

    return ChunkTable(lambda chunks: [e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)], True, cut, odd, joined)


#: The sign that sentencepiece writes for a space.
MARKER = "▁"


def sentencepiece_table(model) -> ChunkTable:
    """For a sentencepiece model whose pieces never have a marker after another character.

    The library puts a marker before each text, so a chunk is passed without its first space.
    """
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
    if any(MARKER in p.lstrip(MARKER) for p in pieces):
        raise ValueError("pieces cross white-space markers; encode whole texts instead")

    def cut(text: str) -> list[str]:
        if not text:
            return []
        if MARKER in text:  # a written marker may join with spaces: the whole text is one chunk
            return [text]
        return [c[1:] for c in re.findall(r" +[^ ]+(?: +\Z)?| +\Z", " " + text)]

    def odd(words: list[str]) -> np.ndarray:
        return np.fromiter((not w or MARKER in w for w in words), bool, len(words))

    return ChunkTable(lambda chunks: model.encode(chunks, num_threads=1), False, cut, odd)
