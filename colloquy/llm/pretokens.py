"""Encode whole texts by cutting them at blanks, fast.

A single blank after a character that is no white space always starts a new
match of the usual pre-tokenizer patterns, whatever stands before it. Texts
whose blanks are all of this kind are cut at blanks; a text's ids are its
chunks' ids one after the other. A batch's chunks are cut and told apart in
Arrow, so Python sees each distinct chunk of a batch once, and encodes it if a
memo of bounded bytes does not know it. Other texts are encoded as one.
"""

import itertools

import numpy as np
import regex

#: White space other than the blank, in any version of Unicode.
OTHER_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0" + "".join(map(chr, (0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
MEMO_BYTES = 64 << 20   # of a memo, unless a caller says otherwise
GROUP_BYTES = 2 << 20   # of text that is cut at once


class Memo:
    """Values of keys met lately within a number of bytes: a full generation becomes the old one, what is met again moves on."""

    def __init__(self, limit: int = MEMO_BYTES):
        self.new, self.old, self.size, self.limit = {}, {}, 0, limit

    def known(self, keys: list) -> list:
        """The value of each key, None where it is not known."""
        values = [*map(self.new.get, keys)]
        if self.old:
            again = [at for at, value in enumerate(values) if value is None and keys[at] in self.old]
            for at in again:
                values[at] = self.old[keys[at]]
            self.learn([keys[at] for at in again], [values[at] for at in again])
        return values

    def learn(self, keys: list, values: list):
        """A key and its value take their lengths and what Python adds to them."""
        self.size += sum(map(len, keys)) + sum(map(len, values)) + 190 * len(keys)
        if self.size > self.limit // 2:
            self.old, self.new, self.size = self.new, {}, 0
            if 190 * len(keys) > self.limit // 2:
                return
        self.new.update(zip(keys, values))


def cuts_at_blanks(pattern: str) -> bool:
    """Whether ``pattern`` starts a new match at a single blank after what is no white space, by trying all pairs of kinds of characters."""
    find = regex.compile(pattern).findall
    kinds = ["a", "Z", "é", "ß", "1", "٣", "Ⅷ", ".", "'", "'s", "don't", "-", "_", "€", "中", "ก", "\U0001f600", "́", "\x00", "ab12", "a.b", "'ll"]
    after = [*kinds, "", "\n", "\nx", "\t.", "　a"]
    return all(find(f"{a} {b}") == find(a) + find(f" {b}") for a in kinds for b in after)


class TextEncoder:
    """``encoder(texts)``: the ids of each text of an Arrow array, as numpy arrays of ``dtype``; none for nulls.

    ``encode_chunks(chunks)`` gives packed ids of each chunk: a blank and what
    follows it up to the next, or a text's beginning. ``encode_text`` gives
    those of a text that cannot be cut.
    """

    def __init__(self, pattern: str | None, encode_chunks, encode_text, dtype: str, limit: int = MEMO_BYTES):
        self.encode_chunks, self.encode_text, self.dtype = encode_chunks, encode_text, np.dtype(dtype)
        self.cuts = bool(pattern) and cuts_at_blanks(pattern)
        self.unusual = f"[{''.join(f'\\x{{{ord(c):x}}}' for c in OTHER_SPACE)} ] "
        self.memo = Memo(limit)

    def lookup(self, keys: list[str]) -> list[bytes]:
        if not self.memo.limit:
            return self.encode_chunks(keys)
        values = self.memo.known(keys)
        missing = [at for at, value in enumerate(values) if value is None]
        if missing:
            unknown = [keys[at] for at in missing]
            made = self.encode_chunks(unknown)
            for at, value in zip(missing, made):
                values[at] = value
            self.memo.learn(unknown, made)
        return values

    def cut(self, texts) -> list[np.ndarray]:
        """Ids of texts that can be cut at blanks."""
        import pyarrow.compute as pc

        lists = pc.split_pattern(texts, " ")
        edges = lists.offsets.to_numpy().astype(np.int64)
        chunks = lists.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
        edges -= edges[0]
        words, codes = chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), chunks.indices.to_numpy().astype(np.int64)
        codes[edges[:-1]] += len(words)             # a text's first chunk has no blank before it
        there = np.zeros(2 * len(words), bool)
        there[codes] = True
        used = np.flatnonzero(there)
        codes = (np.cumsum(there) - 1)[codes]
        after = int(np.searchsorted(used, len(words)))
        values = self.lookup([" " + words[u] for u in used[:after].tolist()] + [words[u] for u in (used[after:] - len(words)).tolist()])
        sizes = np.array([*map(len, values)], np.int64) // self.dtype.itemsize
        table, starts = np.frombuffer(b"".join(values), self.dtype), np.cumsum(sizes) - sizes
        sizes = sizes[codes]
        ends = np.cumsum(sizes)
        places = np.int32 if ends[-1] < 1 << 31 else np.int64
        ids = table[np.repeat((starts[codes] - ends + sizes).astype(places), sizes) + np.arange(ends[-1], dtype=places)]
        ends = ends[edges[1:] - 1].tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def __call__(self, texts) -> list[np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        if self.cuts:
            whole = pc.match_substring_regex(texts, self.unusual).to_numpy(zero_copy_only=False)
        else:
            whole = np.ones(len(texts), bool)
        found = [None] * len(texts)
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_BYTES, "right")))
            places = np.flatnonzero(~whole[at:end]) + at
            if len(places):
                for place, ids in zip(places.tolist(), self.cut(texts.take(pa.array(places)))):
                    found[place] = ids
            at = end
        for place in np.flatnonzero(whole).tolist():
            found[place] = np.frombuffer(self.encode_text(texts[place].as_py()), self.dtype)
        return found


class PieceChunks:
    """Chunks by an encoder of single pieces: each match of ``pattern`` is one, new ones come in ascending order. Pieces are remembered, chunks need not be."""

    def __init__(self, pattern: str, encode_piece, limit: int = MEMO_BYTES):
        self.find, self.encode_piece, self.memo = regex.compile(pattern).findall, encode_piece, Memo(limit)

    def text(self, text: str) -> bytes:
        return self([text])[0]

    def __call__(self, chunks: list[str]) -> list[bytes]:
        found = [*map(self.find, chunks)]
        pieces = list(dict.fromkeys(itertools.chain.from_iterable(found)))
        values = dict(zip(pieces, self.memo.known(pieces)))
        unknown = sorted(piece for piece, value in values.items() if value is None)
        made = [*map(self.encode_piece, unknown)]
        self.memo.learn(unknown, made)
        values.update(zip(unknown, made))
        return [values[f[0]] if len(f) == 1 else b"".join([values[p] for p in f]) for f in found]
