"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

The BPE tokens of a text are the one sequence in which every neighbouring pair
is stable: BPE over the two tokens' bytes gives the same two tokens back. So
the last token of each prefix follows from the last tokens of shorter prefixes.
A state holds the last token already emitted and the bytes read since. A byte
leads to the state after it and emits the tokens that all continuations share:
only positions from which the unread text could still start a token matter, so
nothing waits longer than the longest token. Moves that are met again and
again are made and kept, with the states they lead to. What follows a move that
is not made yet is read through; pieces that come in ascending order share this
reading as far as they begin alike.
"""

import base64
import struct

import numpy as np
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import once, slices
from colloquy.llm.pretokens import MEMO_BYTES, PieceChunks, TextEncoder

STATE_BYTES = 1 << 10   # of a move, its state and what is known beside it, at the least
AGAIN = 3               # times that a move is met before it is made
NEVER = 1 << 60         # a rank beyond all others


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: one base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Plain BPE: join the neighbours of lowest rank, the leftmost of equals, until none can be joined."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """``Transducer(ranks)(piece)``: packed ids of one piece, by the ranks of the tokens' bytes.

    Positions count the pending bytes. ``ids[p]`` is the last token of the text
    up to ``p`` (at 0 the token emitted last, -1 at the begin of a piece). A
    node stands for the longest end of the text that a token starts with: it
    tells the tokens that end here and the starts that are still open.
    """

    def __init__(self, ranks: dict[bytes, int], memo_bytes: int = MEMO_BYTES):
        self.most = memo_bytes // STATE_BYTES   # moves before all are made anew
        self.ranks, self.tokens = ranks, {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.borders: tuple[dict, dict] = ({}, {})
        self.kinds = {token: 1 for token in ranks}      # bit 0: a token, bit 1: the start of one
        for token in ranks:
            for n in range(1, len(token)):
                self.kinds[token[:n]] = self.kinds.get(token[:n], 0) | 2
        self.stable: dict[int, dict[int, bool]] = {}    # of a token: whether it stays apart from the one before it
        self.pairs = 0                                  # known to all of them
        self.nodes = {b"": 0}                           # by their bytes, as many as tokens have beginnings at most
        self.spelt, self.ending, self.opened = [b""], [()], [(0,)]  # of a node: bytes; size, token and its stable, longest first; sizes of open starts
        self.steps: dict[int, int] = {}                 # node * 256 + byte: next node
        self.reset()

    def reset(self):
        self.states = [(b"", (-1,), 0)]                 # pending bytes, ids, node
        self.numbers = {(-1, b""): 0}
        self.moves: dict[int, tuple[int, bytes]] = {}   # state * 256 + byte: next state, packed ids emitted
        self.met: dict[int, int] = {}                   # how often moves not yet made were met
        self.ends: dict[int, bytes] = {}
        self.last = -1, b"", [], []                     # read through last: state, bytes, ids, a node for each byte and one before

    def border(self, token: bytes, tail: bool) -> tuple[tuple, tuple]:
        """The symbols that stand at one end of ``token`` while it is merged from bytes, and the rank that ends each."""
        known = self.borders[tail].get(token)
        if known is None:
            if len(token) == 1:
                known = (token,), (NEVER,)
            else:
                parts = {t: r for n in range(2, len(token)) for i in range(len(token) - n + 1)
                         if (r := self.ranks.get(t := token[i:i + n])) is not None}
                symbols, until = self.border(merge(token, parts)[-tail], tail)
                known = (*symbols, token), (*until[:-1], self.ranks[token], NEVER)
            self.borders[tail][token] = known
        return known

    def follows(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens apart, for the first time.

        Merges come in the order of their ranks, so both sides grow as they do
        alone until a pair across the border is due before either side's next
        merge; of equal ranks the leftmost pair comes first.
        """
        apart = True
        if left >= 0:
            tails, after_left = self.border(self.tokens[left], True)
            heads, after_right = self.border(self.tokens[right], False)
            known, i, j = self.ranks.get, 0, 0
            while True:
                across, due_left, due_right = known(tails[i] + heads[j], NEVER), after_left[i], after_right[j]
                if across < due_left and across <= due_right:
                    apart = False
                    break
                if due_left > due_right:
                    j += 1
                elif due_left < NEVER:
                    i += 1
                else:
                    break
        if self.pairs > 2 * self.most:
            self.pairs = 0
            for known in self.stable.values():
                known.clear()
        self.stable[right][left] = apart
        self.pairs += 1
        return apart

    def step(self, node: int, byte: int) -> int:
        """The node after ``byte``, for the first time."""
        text = self.spelt[node] + bytes((byte,))
        while text and text not in self.kinds:
            text = text[1:]
        number = self.nodes.get(text)
        if number is None:
            number = self.nodes[text] = len(self.spelt)
            ends = [(text[at:], self.kinds.get(text[at:], 0)) for at in range(len(text))]
            self.spelt.append(text)
            self.ending.append(tuple((len(t), self.ranks[t], self.stable.setdefault(self.ranks[t], {})) for t, kind in ends if kind & 1))
            self.opened.append((*(len(t) for t, kind in ends if kind & 2), 0))
        if len(self.steps) > 2 * self.most:
            self.steps.clear()
        self.steps[node << 8 | byte] = number
        return number

    def read(self, ids: list[int], nodes: list[int], more: bytes):
        """Go on after ``ids`` and the last of ``nodes``: both grow by one for each byte of ``more``."""
        steps, ending, node = self.steps, self.ending, nodes[-1]
        for byte in more:
            after = steps.get(node << 8 | byte)
            node = self.step(node, byte) if after is None else after
            for size, token, stable in ending[node]:
                before = ids[-size]
                apart = stable.get(before)
                if apart is None:
                    apart = self.follows(before, token)
                if apart:
                    ids.append(token)
                    nodes.append(node)
                    break
            else:
                raise ValueError("the ranks do not cover this text")

    def through(self, state: int, rest: bytes) -> bytes:
        """Packed ids from a state to the end of a piece. What the piece before, from the same state, has in common with it is not read again."""
        last, text, ids, nodes = self.last
        if last == state:
            same = 0
            for a, b in zip(text, rest):
                if a != b:
                    break
                same += 1
            del ids[len(ids) - len(nodes) + same + 1:], nodes[same + 1:]
        else:
            _, ids, node = self.states[state]
            ids, nodes, same = [*ids], [node], 0
        self.last = -1, b"", [], []
        self.read(ids, nodes, rest[same:])
        self.last = state, rest, ids, nodes
        return self.chain(ids)

    def chain(self, ids) -> bytes:
        """Packed ids of the pending bytes."""
        out, end, sizes = [], len(ids) - 1, self.sizes
        while end:
            token = ids[end]
            out.append(token)
            end -= sizes[token]
        return struct.pack(f"<{len(out)}I", *out[::-1])

    def move(self, state: int, byte: int) -> tuple[int, bytes]:
        data, ids, node = self.states[state]
        ids, nodes, data = [*ids], [node], data + bytes((byte,))
        self.read(ids, nodes, data[-1:])
        end, node = len(data), nodes[-1]
        # What is before the last boundary that all open starts have in common is certain.
        ways = {end - size for size in self.opened[node]}
        while len(ways) > 1:
            furthest = max(ways)
            ways.discard(furthest)
            ways.add(furthest - self.sizes[ids[furthest]])
        cut = ways.pop()
        key = (ids[cut], data[cut:])
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append((data[cut:], tuple(ids[cut:]), node))
        result = self.moves[state << 8 | byte] = (number, self.chain(ids[:cut + 1]))
        return result

    def finish(self, state: int) -> bytes:
        """What is still pending when the input ends."""
        known = self.ends.get(state)
        if known is None:
            known = self.ends[state] = self.chain(self.states[state][1])
        return known

    def __call__(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers.

        A move that is met for the first few times is only read through, with
        all that follows it; it is made when it is met again after that.
        Pieces in ascending order share most of what is read through.
        """
        if len(self.moves) > self.most:
            self.reset()
        if len(self.met) > 2 * self.most:
            self.met.clear()
        state, out, moves, text = 0, b"", self.moves, piece.encode("utf-8", "surrogatepass")
        for at, byte in enumerate(text):
            key = state << 8 | byte
            step = moves.get(key)
            if step is None:
                times = self.met.get(key, 0)
                if times < AGAIN:
                    self.met[key] = times + 1
                    return out + self.through(state, text[at:])
                step = self.move(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        return out + self.finish(state)


#: UTF-8 by lead byte: how many bytes follow. Continuation bytes are 80 to BF.
def utf8_need(byte: int) -> int:
    return 1 if 0xC2 <= byte <= 0xDF else 2 if 0xE0 <= byte <= 0xEF else 3 if 0xF0 <= byte <= 0xF4 else 0


class StreamDecoder:
    """Text of a stream of ids: gives out all characters that are complete, keeps an open one.

    The state is the open character's bytes so far, three at most. Bytes that
    are no UTF-8 become U+FFFD as in ``bytes.decode(errors="replace")``.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.open = tokens, b""

    def feed(self, ids) -> str:
        data = self.open + b"".join(map(self.tokens.__getitem__, ids))
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                if utf8_need(byte) >= back and _open_utf8(data[-back:]):
                    keep = back
                break
        self.open = data[len(data) - keep:]
        return data[:len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


def _open_utf8(tail: bytes) -> bool:
    """Whether more bytes can make ``tail``, a lead byte and what follows it, one character."""
    if len(tail) == 1:
        return True
    low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(tail[0], (0x80, 0xBF))
    return low <= tail[1] <= high


def text_encoder(ranks: bytes, pattern: str, memo_bytes=MEMO_BYTES) -> TextEncoder:
    """The ids of whole texts by the transducer; its pieces, and its moves and states, take ``memo_bytes`` each."""
    chunks = PieceChunks(pattern, Transducer(read_ranks(ranks), memo_bytes), memo_bytes)
    return TextEncoder(pattern, chunks, chunks.text, "<u4", 0)


def encode(df: DataFrame, ranks: bytes, pattern: str, id_col="doc_id", text_col="text", packed=True, decoded=False, memo_bytes=MEMO_BYTES) -> DataFrame:
    """Token ids of every text: ``id_col``, ``ids``; with ``decoded`` also the bytes that they decode to, as by :func:`decode`.

    ``ranks`` is the content of a rank file; each match of ``pattern`` is
    encoded separately. ``ids`` is binary, little-endian unsigned 32-bit
    integers, or ``array<int>`` if not ``packed``. Null and empty texts have no
    ids. Rows are independent: repeated rows and null ids come out as they are,
    other columns are left out. One pass, no shuffle; memory is bounded by a
    batch of rows and the worker's memos.
    """
    name = hash(ranks)
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file: a size that is fixed

    def run(batches):
        import pyarrow as pa

        encoder = once("bpe", "encoder", (name, pattern, memo_bytes), lambda: text_encoder(shared.value, pattern, memo_bytes))
        tokens = once("bpe", "tokens", name, lambda: vocabulary(shared.value)) if decoded else None
        for batch in slices(batches):
            out = encoder(batch.column(1))
            if packed:
                ids = pa.array([x.tobytes() for x in out], pa.binary())
            else:
                ids = pa.ListArray.from_arrays(np.cumsum([0, *map(len, out)]).astype(np.int32), np.concatenate([np.zeros(0, "<u4"), *out]).view(np.int32))
            columns, names = [batch.column(0), ids], [id_col, "ids"]
            if decoded:
                columns.append(pa.array([text_of(tokens, x.tolist()) for x in out], pa.string()).cast(pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = df.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids {'binary' if packed else 'array<int>'}"
                           + ", decoded binary" * decoded)


def vocabulary(ranks: bytes) -> list[bytes]:
    """The bytes of each id."""
    known = read_ranks(ranks)
    tokens = [b""] * (max(known.values()) + 1)
    for token, rank in known.items():
        tokens[rank] = token
    return tokens


def text_of(tokens: list[bytes], ids: list[int], block=4096) -> str:
    """A text decoded from its ids block by block."""
    stream = StreamDecoder(tokens)
    return "".join([*(stream.feed(ids[at:at + block]) for at in range(0, len(ids), block)), stream.close()])


def decode(df: DataFrame, ranks: bytes, id_col="doc_id", ids_col="ids", as_text=False, block=4096) -> DataFrame:
    """Add ``decoded``, the bytes of packed ids; with ``as_text`` the text, decoded block by block.

    Null ids give null; ids outside the vocabulary are an error.
    """
    name = hash(ranks)
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        import pyarrow as pa

        tokens = once("bpe", "tokens", name, lambda: vocabulary(shared.value))
        for batch in slices(batches):
            ids = [None if x is None else np.frombuffer(x, "<u4").tolist() for x in batch.column(1).to_pylist()]
            if as_text:
                out = pa.array([None if x is None else text_of(tokens, x, block) for x in ids], pa.string())
            else:
                out = pa.array([None if x is None else b"".join(map(tokens.__getitem__, x)) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], names=[id_col, ids_col, "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(
        run, f"`{id_col}` {kind}, `{ids_col}` binary, decoded {'string' if as_text else 'binary'}")
