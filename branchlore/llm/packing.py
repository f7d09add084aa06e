"""Packing token streams into training sequences by an order-preserving dynamic program.

Documents follow each other as one stream of token numbers.  Sequences are stretches of the stream;
cuts may lie at document ends, at sentence ends, and every ``STRIDE`` tokens in stretches that have
neither.  A cut costs what its place truncates, a sequence its padding and a constant; the cheapest
cuts are found in one pass.  A sequence that ends at position j and starts at i is padded by
``size - (j - i)``, so the best i minimises ``best[i] + i`` over a sliding window, which a monotone
queue keeps; lengths that are powers of two need no padding and are looked at one by one.

A task packs its own documents in their order, a block of ``BLOCK_TOKENS`` after the other; a block
ends with a document.  Nothing is shuffled.
"""

from __future__ import annotations

import os
import unicodedata
from array import array
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchlore.llm.common import kept_columns, whole

SEQUENCE_TOKENS = 2048
END = 1  # closes every document
SENTENCE_COST = 16  # tokens of padding that a cut inside a document is worth
STRIDE_COST = 64  # the same inside a sentence
SEQUENCE_COST = 32  # keeps short sequences few
LONG_STRETCH = 256  # tokens without a sentence end from which on cuts inside are allowed
STRIDE = 64
BLOCK_TOKENS = 1 << 20
SEGMENT_BYTES = 1 << 20  # of a text that are split into words at once
GROUP_BYTES = 1 << 23  # of texts whose words are looked up together
CACHED_WORDS = 1 << 20  # a worker forgets its words and their parts when it knows so many
CACHED_BYTES = 64  # longer words are not kept
SIGNS = b".,;:!?#$%&*"  # at the end of a word they are one part for the tokenizer
SPACES = b" \t\n\r\x0b\x0c"
IS_SIGN, IS_STOP, IS_SPACE = (np.isin(np.arange(256), list(signs)) for signs in (SIGNS, b".!?", SPACES))  # by byte
SMALL = np.frombuffer(bytes(range(256)).lower(), np.uint8)  # small letters for A-Z, by byte
FOREIGN = "\u0130\u0149"  # letters whose small form is more than a letter, or that the tokenizer may split
TASK_BITS = 33  # sequence numbers of a task
PIECES = "array<struct<doc_id: long, start: long, length: long, offset: long, doc_tokens: long>>"
SCHEMA = f"sequence_id long, tokens binary, pieces {PIECES}"


def word_tokenizer() -> str:
    """Where the public word tokenizer lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder(dict):
    """Token numbers and sentence ends of texts; as a dict, the place of every known part of a word.

    The tokenizer never joins what ASCII white space parts, so words are encoded by themselves.  Many
    texts at a time are parted into words and each different word is looked at once.  Words of plain
    letters, with signs at their end or not, are two parts for the tokenizer at most and go straight to
    its model, each part once; all others take its whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = [c for c in map(chr, range(0x180)) if c.isalpha() and unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1]
        # what the tokenizer's model sees of a letter
        self.letters = {c: spelled(c.lower())[0][0] for c in letters if c not in FOREIGN}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.whole: dict[bytes, int] = {}  # places of words that take the whole way
        self.flat, self.starts = array("I"), array("q", [0, 0])
        self[b""] = 0

    def _learn(self, parts: Iterable[bytes]) -> None:
        """Give new parts, small letters or signs, their places; -1 if their words take the whole way."""
        tokenize, flat, starts = self.model.tokenize, self.flat, self.starts
        for part in parts:
            said = part.decode() if part.isalpha() or not part.strip(SIGNS) else self._letters(part)
            if said is None:
                self[part] = -1
            else:
                flat.extend([token.id for token in tokenize(said)])
                self[part] = len(starts) - 1
                starts.append(len(flat))

    def _letters(self, core: bytes) -> str | None:
        try:
            return "".join([self.letters[c] for c in core.decode()])
        except KeyError:
            return None

    def _whole(self, word: bytes) -> int:
        place = self.whole.get(word)
        if place is None:
            place = len(self.starts) - 1
            self.flat.extend(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
            self.starts.append(len(self.flat))
            if len(word) <= CACHED_BYTES:
                self.whole[word] = place
        return place

    def _places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of different words the places of their two parts (the second one may be empty), and whether they close a sentence."""
        starts, ends = (np.frombuffer(words.buffers()[1], np.int32)[words.offset + i :][: len(words)].astype(np.int64) for i in (0, 1))
        data = np.frombuffer(words.buffers()[2], np.uint8)
        short = ends - starts <= CACHED_BYTES
        # a core is what signs at the end leave
        upto = np.where(short, ends, starts)
        signed = np.flatnonzero(upto > starts)
        while len(signed := signed[IS_SIGN[data[upto[signed] - 1]]]):
            upto[signed] -= 1
            signed = signed[upto[signed] > starts[signed]]
        cores = self._parts(_stretches(SMALL[data], starts, upto))
        signs = self._parts(_stretches(data, upto, np.where(short, ends, upto)))
        values = None
        for i in np.flatnonzero((cores < 0) | ~short).tolist():
            values = words.to_numpy(zero_copy_only=False) if values is None else values
            cores[i], signs[i] = self._whole(values[i]), 0
        last, before, first = (data[np.maximum(ends - i, 0)] for i in (1, 2, 3))
        size = ends - starts
        closes = IS_STOP[last] | (size > 1) & ((last == ord('"')) & IS_STOP[before] | (last == ord(")")) & (before == ord(".")))
        closes |= (size > 2) & (first == 0xE2) & (before == 0x80) & (last == 0xA6)  # an ellipsis
        return np.stack([cores, signs], 1), closes

    def _parts(self, words: pa.Array) -> np.ndarray:
        different = words.dictionary_encode()
        parts = different.dictionary.to_numpy(zero_copy_only=False)
        places = list(map(self.get, parts))
        new = [i for i, place in enumerate(places) if place is None]
        self._learn(parts[new])
        for i in new:
            places[i] = self[parts[i]]
        return np.array(places, np.int64)[different.indices.to_numpy()]

    def _group(self, segments: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Token numbers of segments and the places after their sentences; a line and a segment end a sentence."""
        data = np.frombuffer(b"\n" + b"\n".join(segments) + b"\n", np.uint8)
        blank = IS_SPACE[data]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        different = _binary(data[~blank], ends - starts).dictionary_encode()
        numbers = different.indices.to_numpy()
        places, closes = self._places(different.dictionary)
        flat, bounds = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.starts, np.int64)
        sizes = bounds[places + 1] - bounds[places]
        found = _gathered(flat, bounds[places].ravel(), sizes.ravel())
        sizes = sizes.sum(1)
        begins = np.cumsum(sizes) - sizes
        closed = closes[numbers]
        line_ends = np.searchsorted(starts, np.flatnonzero(data == ord("\n"))) - 1
        closed[line_ends[line_ends >= 0]] = True
        first = np.searchsorted(starts, np.cumsum([1] + [len(s) + 1 for s in segments])).tolist()
        del flat, bounds  # the arrays may grow again
        if len(self) + len(self.whole) > CACHED_WORDS:
            self.forget()
        for low, high in zip(first, first[1:]):
            words = numbers[low:high]
            upto = sizes[words]
            ids = _gathered(found, begins[words], upto)
            yield ids, np.cumsum(upto)[closed[low:high]]

    def encode_all(self, texts: Iterable[tuple[object, bytes]]) -> Iterator[tuple]:
        """Of named texts (UTF-8) the name, the token numbers and the places after the sentences."""

        def grouped() -> Iterator[tuple]:
            held, size = [], 0
            for name, data in texts:
                for segment, last in _segments(data):
                    held.append((name, last, segment))
                    size += len(segment)
                    if size >= GROUP_BYTES:
                        yield from zip(held, self._group([s for _, _, s in held]), strict=True)
                        held, size = [], 0
            if held:
                yield from zip(held, self._group([s for _, _, s in held]), strict=True)

        ids, ends, done = [], [], 0
        for (name, last, _), (found, closed) in grouped():
            ids.append(found)
            ends.append(closed + done)
            done += len(found)
            if last:
                yield name, np.concatenate(ids), np.concatenate(ends)
                ids, ends, done = [], [], 0

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of a text (UTF-8) and the places after its sentences."""
        ((_, ids, ends),) = self.encode_all([(None, data)])
        return ids, ends


def _segments(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """A text in stretches of about ``SEGMENT_BYTES``, and whether each is the last one."""
    at = 0
    while True:
        stop = len(data)
        if stop - at > SEGMENT_BYTES:
            # white space near the border, else the whole rest
            stop = next((p + 1 for p in range(at + SEGMENT_BYTES, len(data)) if data[p] in SPACES), len(data))
        yield data[at:stop], stop >= len(data)
        at = stop
        if at >= len(data):
            return


def _stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes between each two bounds."""
    return _binary(_gathered(data, starts, ends - starts), ends - starts)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _gathered(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """So many values from each beginning on, in a row."""
    ends = np.cumsum(sizes)
    return values[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """A worker's encoder, which keeps its words from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_places(ends: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts of a block and their costs: ``ends`` closes documents, the last one the block."""
    costs = np.full(int(ends[-1]) + 1, -1, np.int64)  # by place, -1 where no cut is allowed
    costs[sentences] = SENTENCE_COST
    costs[ends] = 0
    places = np.flatnonzero(costs >= 0)
    gaps = np.diff(places, prepend=0)
    for at, gap in zip(places[gaps > LONG_STRETCH].tolist(), gaps[gaps > LONG_STRETCH].tolist(), strict=True):
        costs[at - gap + STRIDE : at : STRIDE] = STRIDE_COST
    every = np.flatnonzero(costs >= 0)
    return every, costs[every]


def padding(length: int, size: int) -> int:
    """Tokens added to a sequence: none where its length is a power of two."""
    return 0 if length & (length - 1) == 0 else size - length


def best_cuts(places: np.ndarray, costs: np.ndarray, size: int, sequence_cost: int = SEQUENCE_COST) -> list[int]:
    """The cuts of least total cost, the last place among them.  No two places are further apart than ``size``."""
    at = np.concatenate([[0], places])
    # pairs of places a power of two apart, by the later one
    later, earlier = [], []
    power = 1
    while power <= size:
        found = np.searchsorted(at, at - power)
        hit = np.flatnonzero((at >= power) & (at[found] == at - power))
        later.append(hit)
        earlier.append(found[hit])
        power *= 2
    later, earlier = np.concatenate(later), np.concatenate(earlier)
    order = np.argsort(later, kind="stable")
    later, earlier = [*later[order].tolist(), -1], earlier[order].tolist()
    at, costs = at.tolist(), [0, *costs.tolist()]
    best, before, key = [0] * len(at), [0] * len(at), [0] * len(at)
    queue, pair = deque([0]), 0
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0]] < here - size:
            queue.popleft()
        i = queue[0]
        value = key[i] + size - here
        while later[pair] == j:
            other = earlier[pair]
            if best[other] < value:
                value, i = best[other], other
            pair += 1
        best[j], before[j] = value + costs[j] + sequence_cost, i
        key[j] = best[j] + here
        while queue and key[queue[-1]] >= key[j]:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = before[j]
    return cuts[::-1]


def _sequences(docs: list[tuple], size: int) -> Iterator[tuple]:
    """``tokens`` and ``pieces`` of the sequences of a block of (id, tokens, sentence ends)."""
    stream = np.concatenate([ids for _, ids, _ in docs])
    ends = np.cumsum([len(ids) for _, ids, _ in docs])
    begins = ends - [len(ids) for _, ids, _ in docs]
    sentences = np.concatenate([marks + begin for (_, _, marks), begin in zip(docs, begins, strict=True)])
    start, nth = 0, 0
    for stop in best_cuts(*cut_places(ends, sentences), size):
        pieces, place = [], start
        while place < stop:
            upto = min(stop, int(ends[nth]))
            pieces.append((docs[nth][0], place - int(begins[nth]), upto - place, place - start, len(docs[nth][1])))
            nth += upto == ends[nth]
            place = upto
        yield stream[start:stop].astype("<u4").tobytes(), pieces
        start = stop


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE_TOKENS, end: int = END, block: int = BLOCK_TOKENS) -> DataFrame:
    """Sequences of at most ``size`` tokens: ``sequence_id``, ``tokens`` (unsigned 32-bit, little-endian), ``pieces``.

    A piece is a stretch of one document: ``doc_id``, ``start`` in it, ``length``, ``offset`` in
    the sequence and ``doc_tokens``.  Sequence numbers rise in the table's order but have gaps between
    tasks.  ``tokenizer`` is a file that every worker can read (default: the public one where it runs).
    Missing and empty texts are documents of the end number alone; a long text is cut like any
    other; repeated rows and rows without an id are packed each; an empty table gives none; other
    columns are not looked at.
    """
    if size & (size - 1) or size < LONG_STRETCH:
        raise ValueError(f"size must be a power of two from {LONG_STRETCH} on")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer or word_tokenizer())
        number = TaskContext.get().partitionId() << TASK_BITS
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("doc_id", "start", "length", "offset", "doc_tokens")]))
        held, tokens = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            made = list(_sequences(held, size)) if held else []
            for at in range(0, len(made), 256):
                part = made[at : at + 256]
                ids = pa.array(range(number, number + len(part)), pa.int64())
                number += len(part)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([t for t, _ in part], pa.binary()), pa.array([[dict(zip(("doc_id", "start", "length", "offset", "doc_tokens"), p, strict=True)) for p in ps] for _, ps in part], kind)],
                    names=["sequence_id", "tokens", "pieces"],
                )

        texts = ((batch.column(0)[at].as_py(), batch.column(1)[at].as_py()) for batch in batches for at in range(batch.num_rows))
        for doc_id, ids, ends in encoder.encode_all(texts):
            held.append((doc_id, np.append(ids, np.uint32(end)), ends))
            tokens += len(ids) + 1
            if tokens >= block:
                yield from flush()
                held, tokens = [], 0
        yield from flush()

    rows = kept_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), whole("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The pieces of the packed documents, a row each, with the CRC-32 of their token numbers."""
    piece = pack(docs).select("sequence_id", "tokens", F.explode("pieces").alias("p"))
    bytes_of = F.expr("substring(tokens, cast(p.offset * 4 + 1 as int), cast(p.length * 4 as int))")
    return piece.select(
        "p.doc_id", "p.start", "p.length", F.crc32(bytes_of).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset"
    )
