"""Best-fit packing of token pieces with a swap-based local search (operator 5).

Documents become tokens and an end id, longer ones are cut into pieces of the
capacity. Pieces are dealt evenly over cells of bounded size (a round-robin deal, so
no key can make one cell large). Each cell is packed by itself: best fit from the
longest piece down, then a local search among underfull bins that moves one piece,
exchanges one for one, or two for one, always towards the fuller bin. Every step
raises the sum of squared fills; it goes on until no bin has a step left. Bins that a cell couldn't fill go through the same packing again, together.

Cases: a null text is empty (its piece is the end id alone); repeated rows are
packed as often as they occur; a null doc_id is kept; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takemark.llm.common import Scratch

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Ids of parts seen before, per tokenizer file: the latest ones and those before them. Kept for all tasks that a worker runs.
_CACHES: dict[str, list[dict[bytes, bytes]]] = {}


def _splits_words(tokenizer) -> bool:
    """Whether the ids of a lower-cased text are those of its parts between blanks, and of a word and a mark after it."""
    s = json.loads(tokenizer.to_str())
    steps = (s["normalizer"] or {}).get("normalizers", [s["normalizer"]])
    cuts = (s["pre_tokenizer"] or {}).get("pretokenizers", [s["pre_tokenizer"]])
    apart = cuts[0] and cuts[0].get("type") == "Split" and cuts[0].get("invert") and cuts[0].get("behavior") == "Removed" and str(cuts[0]["pattern"].get("Regex", "")).endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
    return bool(apart) and any(x and x["type"] == "Lowercase" for x in steps) and s["post_processor"] is None


#: Lower-cased Latin letters that are their own normal form, then ASCII marks but apostrophes: two words to such a tokenizer.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: The characters by which a byte-level model knows bytes that have no visible ones of their own.
_BYTE_CHARS = dict(zip([*range(33), *range(127, 161), 173], range(256, 324)))


def _bytes_only(tokenizer) -> bool:
    """Whether what _PLAIN matches reaches the model as its two parts, byte by byte and otherwise unchanged."""
    s = json.loads(tokenizer.to_str())
    steps = (s["normalizer"] or {}).get("normalizers", [s["normalizer"]])
    cuts = (s["pre_tokenizer"] or {}).get("pretokenizers", [s["pre_tokenizer"]])
    known = all(x and (x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"}) for x in steps)
    return known and len(cuts) == 2 and cuts[1]["type"] == "ByteLevel" and not cuts[1]["add_prefix_space"] and not cuts[1].get("use_regex", True)


def text_encoder(path: str, cache_words: int = 120_000):
    """Arrow array of texts -> list of packed little-endian uint32 ids, equal to the tokenizer's on the whole texts; a null text has none.

    Where the tokenizer's own settings say that it lower-cases and never joins across a blank nor a
    letter to a mark, the ids of a text are those of its parts in a row. Arrow numbers the different parts of all texts.
    Parts seen before come from a cache of bounded size; new ones of letters and marks go to the model as they are, others
    are encoded together and told apart by their offsets. Any other tokenizer gets whole texts.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if not _splits_words(tokenizer):
        return lambda texts: [np.asarray(tokenizer.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts.to_pylist()]
    special = [pc.ascii_lower(x.content).as_py() for x in tokenizer.get_added_tokens_decoder().values()]
    caches = _CACHES.setdefault(path, [{b"": b""}, {}])
    tokenize, plain = tokenizer.model.tokenize, _PLAIN if _bytes_only(tokenizer) else lambda _: None

    def word(x: bytes) -> bytes:
        chars = x.decode() if x.isascii() else x.decode("latin-1").translate(_BYTE_CHARS)
        return array("I", [token.id for token in tokenize(chars)]).tobytes()

    def fill(cache: dict[bytes, bytes], parts: list[bytes]) -> None:
        texts = [x.decode("utf-8") for x in parts]
        ends = np.cumsum([len(x) + 1 for x in texts])
        found = tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.asarray(found.ids, "<u4").tobytes()
        at = np.asarray(found.offsets, np.int64).reshape(-1, 2)[:, 0]
        cuts = [0, *(4 * np.searchsorted(at, ends)).tolist()]
        cache.update(zip(parts, map(ids.__getitem__, map(slice, cuts[:-1], cuts[1:]))))

    def ids_of(words: list[bytes]) -> list[bytes]:
        if len(caches[0]) > cache_words:
            caches[:] = [{b"": b""}, caches[0]]
        cache, before = caches
        known = [*map(cache.get, words)]
        if None in known:
            other = []
            for x, ids in zip(words, known, strict=True):
                if ids is not None:
                    continue
                ids = before.get(x)
                if ids is None:
                    found = plain(x)
                    if not found:
                        other.append(x)
                        continue
                    head, marks = found.groups()
                    if marks:
                        for part in (head, marks):
                            if part not in cache:
                                cache[part] = before.get(part) or word(part)
                        ids = cache[head] + cache[marks]
                    else:
                        ids = word(x)
                cache[x] = ids
            for k in range(0, len(other), 2000):
                fill(cache, other[k : k + 2000])
            known = [*map(cache.__getitem__, words)]
        return known

    def encode(texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        texts = texts.cast(pa.string()).fill_null("")
        lower = pc.ascii_lower(texts)
        kept = lower
        for token in special:  # it has a case, so texts with one, in any case, keep theirs
            kept = pc.if_else(pc.match_substring(lower, token), texts, kept)
        rows = pc.split_pattern(pc.replace_substring(kept, "\n", " "), " ")
        numbered = rows.flatten().dictionary_encode()
        words = numbered.dictionary.cast(pa.binary())
        _, bounds, data = words.buffers()
        at = np.frombuffer(bounds, np.int32)[words.offset : words.offset + len(words) + 1].tolist()
        ids = ids_of([*map((data.to_pybytes() if data else b"").__getitem__, map(slice, at[:-1], at[1:]))])
        # The ids of all different words stand in a row; each word of the texts takes its own from there.
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        number = numbered.indices.to_numpy(zero_copy_only=False)
        n = sizes[number]
        ends = np.cumsum(n)
        place = np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[number] - (ends - n), n)
        flat = np.frombuffer(b"".join(ids), "<u4")[place].tobytes()
        offsets = rows.offsets.to_numpy()
        cuts = (4 * np.append(0, ends)[offsets - offsets[0]]).tolist()
        return [*map(flat.__getitem__, map(slice, cuts[:-1], cuts[1:]))]

    return encode


def _shares(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64))
    cuts = np.flatnonzero(np.diff(sizes // most, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def tokenized(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece; with keep_ids also ``ids`` (packed little-endian uint32)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = text_encoder(tokenizer_path), np.asarray([end_id], "<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for some in _shares(batch):
                for doc, ids in zip(some.column(0).to_pylist(), encode(some.column(1)), strict=True):
                    data = memoryview(ids + end)
                    for k in range(0, len(data), width):
                        part = data[k : k + width]
                        row = (doc, k // width, k // 4, len(part) // 4, zlib.crc32(part), bytes(part) if keep_ids else None)
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out[:n], kinds[:n], strict=True)], names[:n])

    schema = _PIECES + (", ids binary" if keep_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text)).mapInArrow(pieces, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes into lengths (which come longest first)."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    mask, bins = 0, []
    for i, n in enumerate(lengths):
        above = mask >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
            bins[b].append(i)
            left = room - n
        else:
            bins.append([i])
            b, left = len(bins) - 1, capacity - n
        if left:
            rooms[left].append(b)
            mask |= 1 << left
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Moves and exchanges pieces between underfull bins until bins become empty or no step is left.

    The donor is the emptiest bin that still has a step: it gives one piece, or one or two for a smaller one, to a
    bin that is at least as full, which raises the sum of squared fills. ``fits[s]`` counts the
    bins and pieces that could take s more tokens (a bin its room, a piece up to what its bin would hold instead), so
    that a bin without a step is known as such at once.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    alive = [k for k in range(len(bins)) if fill[k] < capacity]
    fits = np.zeros((2, 2 * capacity + 2), np.int64)  # rooms of bins; exchanges for one piece
    left, fewest = len(bins), -(-sum(fill) // capacity)

    def count(k: int, by: int) -> None:
        room = capacity - fill[k]
        if room and bins[k]:
            fits[0, 1 : room + 1] += by
            for y in {lengths[i] for i in bins[k]}:
                fits[1, y + 1 : y + room + 1] += by

    def step(donor: int) -> bool:
        """Tries all gifts of the donor, single pieces first and larger ones first."""
        count(donor, -1)
        try:
            sizes = sorted({lengths[i] for i in bins[donor]}, reverse=True)
            single = [(s, (s,)) for s in sizes if fits[:, s].any()]
            held = Counter(lengths[i] for i in bins[donor])
            double = ((s + u, (s, u)) for a, s in enumerate(sizes) for u in sizes[a:] if (s != u or held[s] > 1) and fits[1, s + u])
            others = None
            for size, gift in itertools.chain(single, double):
                if others is None:  # fullest first: best fit
                    others = sorted((k for k in alive if k != donor and bins[k] and (fill[k], -k) >= (fill[donor], -donor)), key=lambda k: (-fill[k], k))
                found = _taker(size, len(gift) == 1, others, bins, fill, lengths, capacity)
                if found:
                    k, back = found
                    give = []
                    for s in gift:
                        give.append(next(i for i in bins[donor] if lengths[i] == s and i not in give))
                    count(k, -1)
                    for src, dst, moved in ((donor, k, give), (k, donor, back)):
                        for i in moved:
                            bins[src].remove(i)
                            bins[dst].append(i)
                            fill[src] -= lengths[i]
                            fill[dst] += lengths[i]
                    count(k, 1)
                    return True
            return False
        finally:
            count(donor, 1)

    for k in alive:
        count(k, 1)
    moved = True
    while moved and left > fewest:
        moved = False
        for donor in sorted(alive, key=lambda k: (fill[k], k)):
            while bins[donor] and left > fewest and step(donor):
                moved = True
            if not bins[donor]:
                left -= 1
                alive.remove(donor)
    return [b for b in bins if b]


def _taker(size: int, whole: bool, others: list[int], bins, fill, lengths, capacity: int):
    """(bin, pieces it gives back): the first of others with room, or else the first that exchanges a piece; None if there is none."""
    if whole:
        for k in others:
            if fill[k] + size <= capacity:
                return k, ()
    for k in others:
        room = capacity - fill[k]
        best = max((y for y in bins[k] if 0 < size - lengths[y] <= room), key=lambda y: (-lengths[y], -y), default=None)
        if best is not None:
            return k, (best,)
    return None


def _packed(rows: DataFrame, capacity: int, cell_rows: int, level: int) -> DataFrame:
    """Packs each cell; adds sequence_id, offset and loose (its bin is less than 15/16 full)."""
    columns = [c for c in rows.columns if c not in ("sequence_id", "offset", "loose")]
    rows = rows.select(*columns)
    cells = max(1, -(-rows.count() // cell_rows))
    schema = rows.schema.add("sequence_id", "long").add("offset", "long").add("loose", "boolean")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cell = TaskContext.get().partitionId()
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table["length"].to_pylist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset, loose = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), np.empty(len(lengths), bool)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i] = (level << 60) | (cell << 32) | k, at
                at += lengths[i]
            loose[b] = at * 16 < capacity * 15
        for name, column in (("sequence_id", sequence), ("offset", offset), ("loose", loose)):
            table = table.append_column(name, pa.array(column))
        yield from table.to_batches()

    return rows.repartition(cells).mapInArrow(pack, schema)


def pack(pieces: DataFrame, capacity: int = 2048, cell_rows: int = 16_384) -> DataFrame:
    """Layout of all pieces: sequence_id and offset beside the columns of pieces."""
    with Scratch(pieces.sparkSession) as s:
        first = s.saved(_packed(pieces, capacity, cell_rows, 0), "packed")
        second = _packed(first.where("loose"), capacity, cell_rows, 1)
        return s.keep(first.where("not loose").unionByName(second).drop("loose"), "layout")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, cell_rows: int = 16_384, **columns) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    with Scratch(docs.sparkSession) as s:
        return pack(s.saved(tokenized(docs, tokenizer_path, capacity, **columns), "pieces"), capacity, cell_rows)
