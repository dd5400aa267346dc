"""Packing by best-fit decreasing.

Each document becomes its token ids and an end id. Full windows are cut off first; what is left of each document, shorter than
a window, is an item. Items of one length are alike, so best-fit decreasing needs only how many there are of each length: the
driver packs that histogram (at most `window` counts, whatever the corpus), a run of alike items at a time, with a segment
tree over remaining capacities that finds the tightest open window. Its plan says, for each run of items of one length by
rank, their first window and the offset there; the items find their places in the broadcast plan. Its size depends on the
window alone: a length touches each class of open windows once, and adds at most three. Ranks come from prefix sums in
two steps, so the commonest length needs no task of its own.

Null text counts as empty: the end id alone. Rows that share a doc_id are separate documents. Only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, pick, running_start, runs_of

#: Chunks whose ids a Python worker remembers before it starts anew.
REMEMBERED = 600_000
#: Text bytes encoded in one go; a longer text goes alone, whole.
SLICE = 1 << 22
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: A chunk that is empty or has white space of any script at an end.
ODD = r"^$|^(?:[\x09-\x0D\x1C-\x20\x{85}]|\p{Z})|(?:[\x09-\x0D\x1C-\x20\x{85}]|\p{Z})$"


class Ids:
    """Token ids of texts, equal to those of the tokenizer file. A single space between two visible characters always begins
    a new pre-token, so texts fall into chunks there whose ids don't depend on what stands around; chunks recur, and each is
    encoded once. With ranks (the same vocabulary as a rank file) new chunks go through the faster library, joined to one text."""

    def __init__(self, path: str, ranks: str | None = None, end: int = 0):
        from tokenizers import Tokenizer

        self.slow, self.end = Tokenizer.from_file(path), end
        self.fast = None
        self.special = [str(t.content) for t in self.slow.get_added_tokens_decoder().values()]
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.bytes_of = np.zeros(max(table.values()) + 1, np.int64)
            self.bytes_of[list(table.values())] = [len(k) for k in table]
        self._forget()

    def _forget(self):
        """Chunk k (a space and known[k]) has the ids arena[start[k] : start[k] + size[k]]; the last k is the end id."""
        self.known = pa.array([], pa.large_string())
        self.heads: dict[str, np.ndarray] = {}
        self.arena, self.start, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _one(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")

    def _learn(self, new: pa.Array) -> None:
        """Chunks that hold no special token are encoded as one text, and parted by their bytes."""
        alone = np.full(len(new), self.fast is None)
        for s in self.special:
            alone |= pc.match_substring(new, s).to_numpy(zero_copy_only=False)
        joint, alone = new.filter(pa.array(~alone)), new.filter(pa.array(alone))
        ids, size = [self.arena], [self.size]
        if len(joint):
            got = np.array(self.fast.encode_ordinary(" " + " ".join(joint.to_pylist())), "<u4")
            ends = np.cumsum(self.bytes_of[got])
            want = np.cumsum(pc.binary_length(joint).to_numpy() + 1)
            at = np.searchsorted(ends, want) + 1
            if not np.array_equal(ends[at - 1], want):
                raise ValueError("a token spans two chunks")
            ids.append(got)
            size.append(np.diff(at, prepend=0))
        for c in alone.to_pylist():
            ids.append(self._one(" " + c))
            size.append(np.array([len(ids[-1])]))
        self.known = pa.concat_arrays([self.known, joint, alone])
        self.arena, self.size = np.concatenate(ids), np.concatenate(size)
        self.start = np.cumsum(self.size) - self.size

    def _numbers(self, words: pa.Array) -> np.ndarray:
        at = pc.index_in(words, value_set=self.known)
        if at.null_count:
            new = words.filter(at.is_null())
            if len(self.known) + len(new) > REMEMBERED:
                self._forget()
                new = words
            self._learn(new)
            at = pc.index_in(words, value_set=self.known)
        return at.to_numpy().astype(np.int64)

    def _assembled(self, offsets: np.ndarray, words: pa.Array, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose chunks are words[code[offsets[i] : offsets[i + 1]]]; the first has no space before it."""
        own = self._numbers(words)[code]
        heads = words.take(pa.array(code[offsets[:-1]])).to_pylist()
        firsts = [self.heads[h] if h in self.heads else self.heads.setdefault(h, self._one(h)) for h in heads]
        extra = np.concatenate([*firsts, np.array([self.end], "<u4")])
        length = np.array([len(x) for x in firsts] + [1], np.int64)
        arena, size = np.concatenate((self.arena, extra)), np.concatenate((self.size, length))
        start = np.concatenate((self.start, len(self.arena) + np.cumsum(length) - length))
        own[offsets[:-1]] = len(self.size) + np.arange(len(heads))
        own = np.insert(own, offsets[1:], len(size) - 1)
        each = size[own]
        ends = np.cumsum(each)
        ids = arena[np.repeat(start[own] - ends + each, each) + np.arange(ends[-1])]
        return ids, np.concatenate(([0], ends))[offsets + np.arange(len(offsets))]

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text (no nulls), with the end id."""
        if len(self.heads) > REMEMBERED:
            self.heads.clear()
        pieces = pc.split_pattern(texts.cast(pa.large_string()), " ")
        offsets, flat = pieces.offsets.to_numpy().astype(np.int64), pieces.flatten().dictionary_encode()
        offsets, code = offsets - offsets[0], flat.indices.to_numpy()
        odd = pc.match_substring_regex(flat.dictionary, ODD).to_numpy(zero_copy_only=False)
        strange = np.logical_or.reduceat(odd[code], offsets[:-1]) if odd.any() else np.zeros(len(texts), bool)
        out: list = [None] * len(texts)
        if strange.any():
            parts = [BETWEEN.split(t) for t in texts.filter(pa.array(strange)).to_pylist()]
            again = pa.array(list(chain.from_iterable(parts)), pa.large_string()).dictionary_encode()
            bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
            self._put(out, np.flatnonzero(strange), bounds, again.dictionary, again.indices.to_numpy())
            count = np.diff(offsets)
            code, count = code[np.repeat(~strange, count)], count[~strange]
            offsets = np.concatenate(([0], np.cumsum(count)))
            used, code = np.unique(code, return_inverse=True)
            self._put(out, np.flatnonzero(~strange), offsets, flat.dictionary.take(pa.array(used)), code)
        else:
            self._put(out, np.arange(len(texts)), offsets, flat.dictionary, code)
        return out

    def _put(self, out, rows, offsets, words, code):
        if len(rows):
            ids, bounds = self._assembled(offsets, words, code)
            for i, lo, hi in zip(rows, bounds[:-1], bounds[1:]):
                out[i] = ids[lo:hi]


def _pieces(path, ranks, window, end, with_ids):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]

    def run(batches):
        ids = Ids(path, ranks, end)
        for batch in batches:
            docs, texts = column(batch, "doc_id"), column(batch, "text").fill_null("")
            for lo, n in runs_of(texts, SLICE):
                rows = []
                for name, got in zip(docs.slice(lo, n).to_pylist(), ids.of(texts.slice(lo, n))):
                    for at in range(0, len(got), window):
                        piece = got[at : at + window]
                        rows.append((name, at, len(piece), zlib.crc32(piece), len(got), *([piece.tobytes()] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names[: 5 + with_ids])

    return run


class Capacities:
    """A segment tree over remaining capacities 0..top: is there an open window of it."""

    def __init__(self, top: int):
        self.leaf = 1 << (top + 1).bit_length()
        self.any = [False] * (2 * self.leaf)

    def set(self, capacity: int, there: bool) -> None:
        at = self.leaf + capacity
        self.any[at] = there
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that has an open window."""
        at = self.leaf + least
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaf:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaf
            at //= 2
        return None


def best_fit(counts: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, items, first window, offset), and the number of windows. Item k of a run lies in window
    first + k. Equal to placing the items one by one, longest first, each in the tightest window that holds it."""
    tree, open_, runs, windows = Capacities(window), defaultdict(list), [], 0

    def put(capacity, first, count):
        if capacity and count:
            open_[capacity].append((first, count))
            tree.set(capacity, True)

    def fill(capacity, first, count, length, rank, left):
        """Places items in windows first, first + 1, ... of one capacity: each takes as many as it holds before the next
        does, for it is then the tightest. Gives the items placed."""
        each = capacity // length
        full = min(count, left // each)
        over = min(left - full * each, each) if full < count else 0
        begin = rank
        for some, at, many in ((full, first, each), (1, first + full, over)):
            for layer in range(many if some else 0):
                runs.append((length, rank, some, at, window - capacity + layer * length))
                rank += some
            if many:
                put(capacity - many * length, at, some)
        put(capacity, first + full + bool(over), count - full - bool(over))
        return rank - begin

    for length in sorted((n for n in counts if counts[n]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, count = window, windows, -(-left // (window // length))
                windows += count
            else:
                first, count = open_[capacity].pop()
                tree.set(capacity, bool(open_[capacity]))
            placed = fill(capacity, first, count, length, rank, left)
            rank, left = rank + placed, left - placed
    return runs, windows


def _placed(plan, window, windows):
    def run(batches):
        key = plan[:, 0] * (1 << 44) + plan[:, 1]
        for batch in batches:
            length, rank = (column(batch, n).to_numpy() for n in ("length", "rank"))
            at = np.maximum(np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1, 0)
            inside = length < window
            got = plan[at] if len(plan) else np.zeros((len(length), 5), np.int64)
            sequence = np.where(inside, got[:, 3] + rank - got[:, 1], windows + rank)
            batch = batch.drop_columns(["rank"]) if hasattr(batch, "drop_columns") else batch
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(np.where(inside, got[:, 4], 0))], names=[*batch.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = 1024, end: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian
    unsigned 32-bit) if asked for. Sequences hold pieces without a gap from 0 on, `window` tokens at most."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    pieces = materialize(pick(docs, "doc_id", "text").mapInArrow(_pieces(tokenizer, ranks, window, end, with_ids), schema))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs, windows = best_fit({n: c for n, c in counts.items() if n < window}, window)
    plan = np.array(sorted(runs), np.int64).reshape(-1, 5)
    ranked = running_start(pieces.withColumn("_one", F.lit(1).cast("long")), ["length"], "_one", ["doc_id", "start", "ids_crc32"], "rank")
    out = schema + ", sequence_id long, offset long"
    return ranked.select(*pieces.columns, "rank").mapInArrow(_placed(plan, window, windows), out)
