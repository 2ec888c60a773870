"""Token counts: Arrow functions that return lengths only, in calls of about equal bytes."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrelane.llm.bpe import read_ranks
from acrelane.llm.common import col, map_texts

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Longer texts are cut into parts of at least this many characters, where a cut is safe.
PART_CHARS = 1 << 16
#: Bytes of one call of the tokenizer.
CALL_BYTES = 1 << 20
#: A single space behind a letter and before a letter: split pattern and merges never reach over its left side.
_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level files write for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


def is_twin(file: dict, ranks: dict[bytes, int]) -> bool:
    """Whether ranks are the vocabulary and the merges of a tokenizer file that splits by the same pattern and does nothing else to a text."""
    model, split, added = file["model"], file.get("pre_tokenizer") or {}, file.get("added_tokens") or []
    if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or file.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or not x.get("special") for x in added):
        return False
    letters = _byte_letters()
    written_as = {"".join(letters[b] for b in token): rank for token, rank in ranks.items()}
    if written_as != {t: i for t, i in model["vocab"].items() if t not in {x["content"] for x in added}}:
        return False
    merged = [written_as.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    return -1 not in merged and merged == sorted(merged) and len(set(merged)) == len(merged) == len(ranks) - 256


@lru_cache(maxsize=4)
def counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """A function from texts to token counts, and whether a text may be cut before a space between letters.

    A byte-level .json file beside which the same vocabulary and merges lie as ranks (which is compared) is counted from these, which give the same
    counts at several times the speed; its added tokens keep their default of being recognised inside texts.
    """
    if path.endswith(".model"):
        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]), False
    if path.endswith(".tiktoken"):
        ranks = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
        return (lambda texts: list(map(len, ranks.encode_ordinary_batch(texts, num_threads=1)))), True
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    full = tokenizers.Tokenizer.from_file(path)
    full.no_truncation()
    full.no_padding()
    twin = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(twin) and is_twin(json.loads(full.to_str()), ranks := read_ranks(twin)):
        added = {x.content: i for i, x in full.get_added_tokens_decoder().items()}
        quick = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        return (lambda texts: list(map(len, quick.encode_batch(texts, num_threads=1, allowed_special=set(added))))), True
    return (lambda texts: [len(x) for x in full.encode_batch_fast(texts, add_special_tokens=False)]), False


def parts_of(text: str, size: int = PART_CHARS) -> list[str]:
    """text cut at safe places into parts of size characters or a little more; a text without such places stays whole."""
    out, start = [], 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def lengths(texts: list, path: str) -> list[int]:
    """Token counts of texts, None as empty."""
    count, may_cut = counter(path)
    owner: list[int] = []
    parts: list[str] = []
    for i, text in enumerate(texts):
        for part in parts_of(text or "") if may_cut else [text or ""]:
            owner.append(i)
            parts.append(part)
    out = [0] * len(texts)
    start = held = 0
    for stop, part in enumerate(parts, 1):
        held += (len(part) if part.isascii() else len(part.encode())) + 1
        if held >= CALL_BYTES or stop == len(parts):
            for i, n in zip(owner[start:stop], count(parts[start:stop]), strict=True):
                out[i] += n
            start, held = stop, 0
    return out


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text, without special tokens being added.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows give repeated rows; an empty table gives
    none; other columns, whatever their names, are not carried.
    """

    def fn(texts: list) -> dict:
        path = tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)  # the worker's own
        return {"n_tokens": pa.array(lengths(texts, path), pa.int64())}

    size = F.octet_length(F.coalesce(col(text_col), F.lit(""))).cast("bigint")
    return map_texts(df, [(id_col, col(id_col)), ("n_bytes", size)], col(text_col), fn, "n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
