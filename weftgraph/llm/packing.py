"""Cost-balanced packing of tokenised documents into sequences.

The cost of a piece of n tokens is linear + quadratic * n: the work of the feed-forward layers
and that of attention within the piece. Pieces are taken in descending length, each goes to the
sequence of lowest cost so far that has room for it; a piece that fits nowhere whole is cut at
the room of the lowest-cost sequence that has any.

A task packs the rows it reads, POOL tokens at a time, so nothing is shuffled, memory is bounded
and no group of documents meets in one place. A pool of T tokens gets T // capacity sequences and,
for the rest, sequences of distinct powers of two, so all of them are filled and nothing is padded.
Whole sequences are cut from the front of longer documents first.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import col, per_process, tidy

END_ID = 1
POOL = 2_000_000  # tokens that are packed together
WORDS = 800_000  # words whose ids a Python worker keeps at hand, at about 200 bytes
MARK = re.compile(r"(?<=[^\W_])([.,])(?=[ \n]|\Z)")
HIGH = re.compile("[\u0130-\U0010ffff]")


#: What the shortcut must encode as the tokenizer does, or it is not taken.
PROBE = [
    "The Quick, brown FOX jumps.\nOver 12.5 lazy-dogs!  'Tis  a test, isn't it?", "na\u00efve \u00dcn\u00efc\u00f6d\u00e9 \u2014 \u201cquotes\u201d \u6771\u4eac, e\u0301a", " leading, trailing. \n\n",
    "<b>x</b> a@b.co e=mc2 under_score CamelCase ALLCAPS 1,000.00", "tabs\tand\rreturns end.", "", "...,, a.b.c. x,y, \u0130stanbul",
]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, of any tokenizer.

    The one that this is made for composes characters, lower-cases, drops white space and never joins across it,
    nor between a letter or digit and a mark. So texts are cut at blanks and line feeds and before
    a full stop or comma that ends a word, each part is encoded for itself, and what comes again
    is looked up. Up to U+012F nothing needs composing, and Python lower-cases as the tokenizer
    does; such parts skip its normaliser, which takes most of its time, and words of letters its splitting.
    Whether a tokenizer allows that is tried on PROBE; if not, whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.letters = Tokenizer.from_file(path)  # for words of letters only, which are not split
        self.letters.normalizer = None
        self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.letters.get_vocab_size(), bool)  # ids that end a word
        for token, i in self.letters.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # words that came before those; they go unless they come again
        self.by_words = True
        self.by_words = self.encode(PROBE) == self.encode_whole(PROBE)

    def encode_whole(self, texts: list[str | None]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]

    def look_up(self, words: list[str]) -> None:
        plain = [w for w in words if not HIGH.search(w) and "<|" not in w and w == w.lower()]
        rest = list(set(words).difference(plain))
        letters = [w for w in plain if w.isalpha()]
        plain = [w for w in plain if not w.isalpha()]
        for k in range(0, len(letters), 1000):
            some = letters[k : k + 1000]
            ids = np.array(self.letters.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(some):
                rest += some  # never seen: a word of letters ends with one such id
                continue
            data, at = ids.tobytes(), 0
            for w, end in zip(some, cuts):
                self.words[w] = data[at:end]
                at = end
        for tokenizer, some in ((self.plain, plain), (self.whole, rest)):
            for k in range(0, len(some), 20_000):
                part = some[k : k + 20_000]
                for w, e in zip(part, tokenizer.encode_batch(part, add_special_tokens=False)):
                    self.words[w] = np.array(e.ids, "<u4").tobytes()

    def parts(self, text: str | None) -> list[str]:
        text = MARK.sub(r" \1", text or "").replace("\n", " ")
        return (text if "<|" in text or HIGH.search(text) else text.lower()).split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_words:
            return self.encode_whole(texts)
        parts = [self.parts(t) for t in texts]
        met = set().union(*parts)
        fresh = met.difference(self.words)
        if len(self.words) + len(fresh) > WORDS // 2:
            self.old, self.words, fresh = self.words if len(self.words) <= WORDS // 2 else {}, {}, met
        known, back = self.words, [w for w in fresh if w in self.old]
        for w in back:
            known[w] = self.old.pop(w)
        self.look_up(list(fresh.difference(back)))
        return [b"".join(map(known.__getitem__, p)) for p in parts]


def room_for(total: int, capacity: int) -> list[int]:
    """Capacities that sum to total: whole sequences, then distinct powers of two."""
    whole, rest = divmod(total, capacity)
    return [capacity] * whole + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def balance(lengths: list[int], rooms: list[int], linear: float, quadratic: float) -> list[list[tuple[int, int, int, int]]]:
    """For each piece, its parts (start in the piece, length, sequence, offset in the sequence).
    The rooms together hold at least the sum of the lengths."""
    room = np.array(rooms, np.int64)
    cap = room.copy()
    cost = np.zeros(len(room))
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[k]
        while left:
            fits = np.flatnonzero(room >= left)
            if not len(fits):
                fits = np.flatnonzero(room)
            s = int(fits[np.argmin(cost[fits])])
            n = min(left, int(room[s]))
            out[k].append((start, n, s, int(cap[s] - room[s])))
            room[s] -= n
            cost[s] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", linear: float = 12.0 * 1024, quadratic: float = 2.0, pool: int = POOL, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, capacity (of the sequence, which its pieces fill), and with with_ids the ids.

    tokenizer_path: a tokenizers file that is at the same place on all machines. A document is
    its ids and then END_ID; a null or empty text is END_ID alone. Rows are packed one by one,
    so null and repeated ids and repeated rows keep pieces of their own. An empty table gives an
    empty result; other columns are not carried.
    """
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    fields = [rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "capacity"))]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids

    key = f"encoder:{tokenizer_path}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_process(key, lambda: Encoder(tokenizer_path))
        number = TaskContext.get().partitionId() << 36  # sequences of a task count on from here
        tails: list[tuple] = []  # (id, start, ids, tokens of the document)
        held = 0
        out: list[tuple] = []
        kind = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, tails, held, out
            rooms = room_for(held, capacity)
            for (doc, first, ids, n), parts in zip(tails, balance([len(t[2]) // 4 for t in tails], rooms, linear, quadratic)):
                for start, size, s, offset in parts:
                    some = ids[4 * start : 4 * (start + size)]
                    out.append((doc, first + start, size, zlib.crc32(some), n, number + s, offset, rooms[s], *([np.frombuffer(some, "<u4").astype(np.int64)] * with_ids)))
            number += len(rooms)
            tails, held = [], 0
            yield from emit()

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal out
            if out:
                cols = [pa.array(c, t) for c, t in zip(zip(*out), [kind, *[pa.int64()] * 7, pa.list_(pa.int64())])]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])
                out = []

        for b in batches:
            kind = b["doc_id"].type
            for s in range(0, b.num_rows, 256):
                names, texts = b["doc_id"].slice(s, 256).to_pylist(), b["text"].slice(s, 256).to_pylist()
                for doc, ids in zip(names, coder.encode(texts)):
                    ids += END_ID.to_bytes(4, "little")
                    n = len(ids) // 4
                    whole = n // capacity * capacity
                    for start in range(0, whole, capacity):
                        some = ids[4 * start : 4 * (start + capacity)]
                        out.append((doc, start, capacity, zlib.crc32(some), n, number, 0, capacity, *([np.frombuffer(some, "<u4").astype(np.int64)] * with_ids)))
                        number += 1
                    if n > whole:
                        tails.append((doc, whole, ids[4 * whole :], n))
                        held += n - whole
                    if len(out) > 5000:
                        yield from emit()
                    if held >= pool:
                        yield from flush()
        if tails or out:
            yield from flush()

    return rows.mapInArrow(tidy(run, key), T.StructType(fields))
