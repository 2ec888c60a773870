"""Packing of token ids into rows of fixed width: best fit decreasing with a segment tree over free space."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from acrelane.llm.bpe import read_ranks
from acrelane.llm.common import arrow_map, col, slices

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
#: Width of a packed row, in tokens.
WIDTH = 2048
#: Tokens that a task holds and packs together.  Memory follows this, not the data.
WINDOW_TOKENS = 4 << 20


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


class FreeSpace:
    """Bins by free space 0..width: finds the bin with the least free space that holds a length, in log(width) steps."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, space: int, by: int) -> None:
        node = space + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, space: int, bin_no: int) -> None:
        self.bins[space].append(bin_no)
        self._add(space, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(space, bin) of the tightest bin with space >= need, taken out; None if there is none."""
        count, node = self.count, need + self.size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up until a right neighbour has a bin
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node + (not count[2 * node])
        space = node - self.size
        self._add(space, -1)
        return space, self.bins[space].pop()


def best_fit_decreasing(sizes: list[int], width: int) -> list[list[int]]:
    """Indexes of sizes (each 1..width) by bin; equal sizes keep their order."""
    free, bins = FreeSpace(width), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = free.take(sizes[i])
        space, at = got if got else (width, len(bins))
        if not got:
            bins.append([])
        bins[at].append(i)
        if space > sizes[i]:
            free.put(space - sizes[i], at)
    return bins


def pack_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS, width: int = WIDTH, end_id: int | None = None, pad_id: int = 0, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Rows of width token ids that hold every token of every text once.

    Columns: pack_id string; n_segments int; n_tokens int; ids binary (width little-endian unsigned 32-bit, or 16-bit if all
    ids fit, padded with pad_id); positions binary (same form: position within the segment, 0 in the padding);
    cu_seqlens array<int> (0, then the running sum of segment lengths; padding is not counted); position_resets array<int> (where a
    segment begins); doc_ids array (the id of each segment); doc_starts array<bigint> (the segment's first token within its
    document).

    A text of more than width tokens is split into full segments and a rest, without loss.  Tokens come from each task's own
    rows, window_tokens at a time, so nothing is shuffled and a window's last bins are all that stays loose.
    end_id, if given, closes each document.  Null and empty texts have no tokens (but for end_id) and give no segment;
    repeated rows are packed as often as they come; ids may be null; an empty table gives none; other columns are not carried.
    """
    if not 1 <= width < 1 << 31:
        raise ValueError("width must be positive")
    kind = df.select(col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks if "/" in ranks else public_tokenizers.path(ranks))  # the worker's own file
        form = np.dtype("<u2") if max(encode.max_token_value, end_id or 0, pad_id, width) < 1 << 16 else np.dtype("<u4")
        ids, owners, starts, held, window = [], [], [], 0, 0
        task = TaskContext.get().partitionId()
        ramp = np.arange(width, dtype=form)

        def flush() -> pa.RecordBatch:
            out = {k: [] for k in ("pack_id", "n_segments", "n_tokens", "ids", "positions", "cu_seqlens", "position_resets", "doc_ids", "doc_starts")}
            for b, members in enumerate(best_fit_decreasing([len(x) for x in ids], width)):
                row, places = np.full(width, pad_id, form), np.zeros(width, form)
                ends = np.cumsum([0, *(len(ids[i]) for i in members)], dtype=np.int32)
                for i, at in zip(members, ends, strict=False):
                    row[at : at + len(ids[i])] = ids[i]
                    places[at : at + len(ids[i])] = ramp[: len(ids[i])]
                for k, v in zip(out, (f"{task}-{window}-{b}", len(members), int(ends[-1]), row.tobytes(), places.tobytes(), ends, ends[:-1], [owners[i] for i in members], [starts[i] for i in members]), strict=True):
                    out[k].append(v)
            types = dict(zip(out, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int64())), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(out[k], types[k]) for k in out], names=[*out])

        for batch in batches:
            id_type = batch.schema.types[0]
            for part in slices(batch, 1, 1 << 20):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    tokens = encode.encode_to_numpy(text or "", disallowed_special=()).astype(form)
                    if end_id is not None:
                        tokens = np.append(tokens, form.type(end_id))
                    for start in range(0, len(tokens), width):
                        ids.append(tokens[start : start + width])
                        owners.append(doc)
                        starts.append(start)
                        held += len(ids[-1])
                        if held >= window_tokens:
                            yield flush()
                            ids, owners, starts, held, window = [], [], [], 0, window + 1
        if ids:
            yield flush()

    schema = f"pack_id string, n_segments int, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{kind}>, doc_starts array<bigint>"
    return arrow_map(df.select(col(id_col).alias("k0"), col(text_col).alias("text")), run, schema)
