"""Fill-in-middle transformation by secondary sort.

A text is cut into units, a prefix, a middle and a suffix. What the output is
made of leaves a task as pieces of whole units, keyed by document and place in
the output. Repartitioned by document and sorted within partitions, the pieces
of a document stand together in that order and stream through an incremental
digest: no output need be held. The same pieces are then keyed by their place
in the original text, which the markers in the output tell, and sorted again
within the same partitions, without a second shuffle; streamed once more, they
rebuild the text. This is ``repartitionAndSortWithinPartitions`` on rows, so
that the sorts run, and spill, outside Python.

A document's key is a digest of its id and text with the number of the task it
came from. So texts that repeat, or a null id, never gather more rows in one
place than one task has read, and pieces of rows that are alike in id and text
are sent in equal copies, of which one is used for all.
"""

import hashlib
import itertools

import numpy as np
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import arrow_schema, partitions, slices

#: The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}   # by the part's place in the text
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLAIN_FROM, SPM_BELOW = 90, 20              # of 100
PIECE_UNITS = 4096
PIECE_CHARS = 1 << 14                       # a longer unit is cut
BLOCK = 1 << 20                             # characters looked at at once
_FAR = 1 << 40


def unit_starts(text: str, at: int) -> np.ndarray:
    """Where units ``[A-Za-z]+|[^A-Za-z]`` begin in the block of ``text`` from ``at``; places in the text."""
    codes = np.frombuffer(text[max(at - 1, 0):at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((codes | 32) - np.uint32(97)) < 26
    begins = np.ones(len(codes), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins[1:] if at else begins) + at


def draws(id_text: str, salt="1:") -> tuple[int, ...]:
    """The four numbers that a document's id gives."""
    digits = hashlib.sha256((salt + id_text).encode("utf-8", "surrogatepass")).hexdigest()
    return tuple(int(digits[8 * i:8 * i + 8], 16) for i in range(4))


def cut(text: str, id_text: str, plain_from=PLAIN_FROM, spm_below=SPM_BELOW) -> tuple[int, str, int, int, np.ndarray]:
    """Units, form, ends of prefix and middle, and all places where a piece ends, of a text."""
    blocks = [unit_starts(text, at) for at in range(0, min(len(text), BLOCK), BLOCK)]
    counts = [len(b) for b in blocks] + [len(unit_starts(text, at)) for at in range(BLOCK, len(text), BLOCK)]
    n = sum(counts)
    one, two, three, four = draws(id_text)
    if not text or any(m in text for m in MARKS) or three % 100 >= plain_from:
        form, bounds = "plain", ()
    else:
        form, bounds = "spm" if four % 100 < spm_below else "psm", sorted((one % (n + 1), two % (n + 1)))
    ends, places, seen = [], [len(text)] * len(bounds), 0
    for number, count in enumerate(counts):
        starts = blocks[number] if number < len(blocks) else unit_starts(text, number * BLOCK)
        ends.append(starts[-seen % PIECE_UNITS::PIECE_UNITS])
        for i, unit in enumerate(bounds):
            if seen <= unit < seen + count:
                places[i] = int(starts[unit - seen])
        seen += count
    ends = np.unique(np.concatenate([*ends, np.array([0, *places, len(text)], np.int64)]))
    long = np.flatnonzero(np.diff(ends) > PIECE_CHARS)
    if len(long):
        ends = np.unique(np.concatenate([ends, *(np.arange(ends[i], ends[i + 1], PIECE_CHARS) for i in long)]))
    return (n, form, *(places or (0, 0)), ends)


def pieces(text: str, form: str, prefix_end: int, middle_end: int, ends: np.ndarray):
    """(place in the output, bytes) of every piece; a part's first piece begins with its marker."""
    edges = ends.tolist()
    spans = list(zip(edges, edges[1:]))
    if form == "plain":
        for place, (a, b) in enumerate(spans):
            yield place, text[a:b].encode("utf-8", "surrogatepass")
        return
    limits = {PREFIX: (0, prefix_end), MIDDLE: (prefix_end, middle_end), SUFFIX: (middle_end, len(text))}
    for part, mark in enumerate(ORDERS[form]):
        low, high = limits[mark]
        yield part * _FAR, mark.encode()
        inside = (s for s in spans if low <= s[0] < high)
        for place, (a, b) in enumerate(inside, part * _FAR):
            # The marker and the first piece have one place; they are joined below.
            yield place, text[a:b].encode("utf-8", "surrogatepass")


def joined(found):
    """Pieces at one place as one."""
    for place, same in itertools.groupby(found, key=lambda p: p[0]):
        yield place, b"".join(p[1] for p in same)


def _key(id_text, text: str, task: int) -> bytes:
    digest = hashlib.blake2b((id_text or "").encode("utf-8", "surrogatepass"), digest_size=12, person=b"n" if id_text is None else b"i")
    digest.update(b"\0" + text.encode("utf-8", "surrogatepass"))
    return digest.digest() + task.to_bytes(4, "little")


def _batches(rows, schema):
    """Tuples as Arrow batches of a bounded size; ``rows`` yields (bytes, tuple)."""
    import pyarrow as pa

    held, size = [], 0
    for weight, row in rows:
        held.append(row)
        size += weight
        if len(held) >= 4096 or size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _runs(batches):
    """(document, its head, number of equal rows, its (place, piece) without repeats) of rows sorted by document and place."""
    rows = (row for batch in batches for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256))
            for row in zip(*(c.to_pylist() for c in part.columns)))
    for document, own in itertools.groupby(rows, key=lambda row: row[0]):
        places = itertools.groupby(own, key=lambda row: row[1])
        _, heads = next(places)
        head, copies = None, 0
        for head in heads:
            copies += 1
        yield document, head[3:], copies, ((place, next(same)[2]) for place, same in places)


def sorted_pieces(df: DataFrame, id_col="doc_id", text_col="text", plain_from=PLAIN_FROM, spm_below=SPM_BELOW, parts=None) -> DataFrame:
    """All pieces, in order within their partition: ``document`` (a key), ``place``, ``piece``.

    At place -1 stands the document's head: ``own`` (its id), ``n``, ``form``,
    ``prefix_chars``, ``middle_chars``; these are null in the other rows.
    """
    rows = df.select(F.col(id_col).alias("_own"), F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    layout = f"document binary, place bigint, piece binary, own {df.schema[id_col].dataType.simpleString()}, " + HEAD
    schema = arrow_schema(layout)

    def emit(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for batch in slices(batches):
            for own, id_text, text in zip(*(c.to_pylist() for c in batch.columns)):
                document = _key(id_text, text, task)
                n, form, prefix_end, middle_end, ends = cut(text, id_text or "", plain_from, spm_below)
                sizes = (None, None) if form == "plain" else (prefix_end, middle_end - prefix_end)
                yield 64, (document, -1, None, own, n, form, *sizes)
                for place, piece in joined(pieces(text, form, prefix_end, middle_end, ends)):
                    yield len(piece), (document, place, piece, None, None, None, None, None)

    count = parts or max(partitions(df.sparkSession), rows.rdd.getNumPartitions())
    return rows.mapInArrow(lambda batches: _batches(emit(batches), schema), layout) \
        .repartition(count, "document").sortWithinPartitions("document", "place")


#: What a document's head says besides its id.
HEAD = "n bigint, form string, prefix_chars bigint, middle_chars bigint"


def _with_output(batches, texts: bool):
    """Stream the pieces in output order; give them their place in the text. The head gets the output's digest."""
    for document, head, copies, own in _runs(batches):
        form, digest, part, whole = head[2], hashlib.sha256(), 0, []
        for place, piece in own:
            digest.update(piece)
            if texts:
                whole.append(piece)
            if form != "plain":
                mark = piece[:3].decode("latin-1")
                if mark in MARKS:       # a text that is cut holds no marker of its own
                    part, piece = MARKS[mark], piece[3:]
            if piece:
                yield len(piece), (document, part * _FAR + place % _FAR, piece, None, None, None, None, None, None, None, None)
        output = b"".join(whole).decode("utf-8", "surrogatepass") if texts else None
        yield 64 + len(output or ""), (document, -1, None, *head, digest.hexdigest(), copies, output)


def _with_text(batches, texts: bool):
    """Stream the pieces in the text's order: a row per document."""
    for _, head, _, own in _runs(batches):
        digest, whole = hashlib.sha256(), []
        for _, piece in own:
            digest.update(piece)
            if texts:
                whole.append(piece)
        *row, output_digest, copies, output = head
        row += [output_digest, digest.hexdigest()]
        if texts:
            row += [output, b"".join(whole).decode("utf-8", "surrogatepass")]
        for _ in range(copies):
            yield 64 + 2 * len(output or ""), tuple(row)


def transform(df: DataFrame, id_col="doc_id", text_col="text", plain_from=PLAIN_FROM, spm_below=SPM_BELOW, texts=False, parts=None) -> DataFrame:
    """``id_col``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output_sha256``, ``restored_sha256``; with ``texts`` also ``output`` and ``restored``.

    Units, cuts and forms follow from the text and the hash of ``1:`` and the
    id: prefix and middle end after h1 % (n + 1) and h2 % (n + 1) units, the
    smaller first. Texts that are empty or hold a marker, and those with
    h3 % 100 >= ``plain_from``, stay as they are (form plain, no sizes). Others
    become suffix first (spm) if h4 % 100 < ``spm_below``, else prefix first
    (psm). Null texts count as empty; null ids are hashed as an empty text and
    come out null; ids may be of any type that has a text form. Repeated rows,
    and rows that repeat an id with another text, come out as often as they
    are. An empty table gives none. Other columns are left out.

    One shuffle of the texts in pieces, sorted twice within its partitions;
    the sorts spill. ``parts`` is their number, by default that of the input's
    splits or of shuffle partitions, whichever is more.
    """
    kind = df.schema[id_col].dataType.simpleString()
    between = f"document binary, place bigint, piece binary, own {kind}, {HEAD}, output_sha256 string, copies bigint, output string"
    final = f"`{id_col}` {kind}, {HEAD}, output_sha256 string, restored_sha256 string" + ", output string, restored string" * texts
    between_schema, final_schema = arrow_schema(between), arrow_schema(final)
    return sorted_pieces(df, id_col, text_col, plain_from, spm_below, parts) \
        .mapInArrow(lambda batches: _batches(_with_output(batches, texts), between_schema), between) \
        .sortWithinPartitions("document", "place") \
        .mapInArrow(lambda batches: _batches(_with_text(batches, texts), final_schema), final)


def restore(output: str, form: str) -> str:
    """The text that an output and its form stand for."""
    if form == "plain":
        return output
    parts, rest = {}, output
    marks = ORDERS[form]
    for mark, following in zip(marks, (*marks[1:], None)):
        rest = rest.removeprefix(mark)
        parts[mark], _, rest = rest.partition(following) if following else (rest, "", "")
    return parts[PREFIX] + parts[MIDDLE] + parts[SUFFIX]
