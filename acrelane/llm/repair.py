"""Conversation structure repair: the cheapest edits that make a dialogue one of (system)? (user assistant)+, or nothing, by generalised LR parsing.

The grammar is  dialogue -> () | pairs | system pairs,  pairs -> user assistant | pairs user assistant.  Its LR automaton has four stack tops: start,
system, user (a user's turn waits for its answer) and pairs (one pair or more, reduced).  Each row may be kept, given another role, or
deleted, and turns may be inserted, so a top leads to several; the graph-structured stack holds each top once for a row, with the edge by which it
is reached at minimum (cost, audit), and what reaches an equal top otherwise is merged into it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelane.llm.common import arrow_map, col, written
from acrelane.llm.ordering import in_ranges, line_digests, running

#: Costs of the edits; an undeleted truncated row adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Stack tops, and the top after a shift (with its reductions) by top and role initial.
START, SYSTEM, USER, PAIRS = range(4)
SHIFT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIRS, (PAIRS, "u"): USER}
ACCEPT = (START, PAIRS)
#: Role initials that may follow each other.
FOLLOWS = ("su", "ua", "au")
#: Rows that are parsed together; a longer dialogue is parsed in such blocks, each from every top, and the blocks are joined.
BLOCK_ROWS = 1024
#: The classes of characters that count as white space, and ends of sentences.
_WORD = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def _opened(top: int) -> Iterator[tuple[str, int]]:
    """What inserted turns make of a top: no top allows more than one role for an inserted turn, and two turns lead around."""
    letters = ""
    for _ in range(3):
        yield letters, top
        letters, top = letters + "I", SHIFT[top, _awaited(top)]


def _awaited(top: int) -> str:
    """The role that a user's or assistant's turn must have on a top."""
    return "a" if top == USER else "u"


def _edges(role: str, fault: str) -> list[tuple[int, int, int, str]]:
    """(top, next top, cost, letters) for a row: insertions before it, then its own edit; the least for each pair of tops."""
    least: dict[tuple[int, int], tuple[int, str]] = {}
    for top in range(4):
        for letters, at in _opened(top):
            ways = [("D", at, DELETE)]
            if fault in "-t":
                more = TRUNCATED if fault == "t" else 0
                if (at, role) in SHIFT:
                    ways.append(("K", SHIFT[at, role], KEEP + more))
                ways.append(("R", SHIFT[at, _awaited(at)], REROLE + more))
            for letter, to, cost in ways:
                way = (cost + INSERT * len(letters), letters + letter)
                least[top, to] = min(least.get((top, to), way), way)
    return [(top, to, cost, letters) for (top, to), (cost, letters) in sorted(least.items())]


#: Edges by role initial ('.' for any other) and fault: '-' none, 't' truncated, 'b' blank, 'd' duplicate.
EDGES = {role + fault: _edges(role, fault) for role in "sua." for fault in "-tbd"}
#: Insertions that end a dialogue, by top.
CLOSE = {top: min((INSERT * len(letters), letters) for letters, at in _opened(top) if at in ACCEPT) for top in range(4)}


def parse_block(roles: str, faults: str, entry: int) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) from a stack top over a block's rows to each top that can be reached, without insertions after the last row.

    Audits up to a row's own letter never begin one another, so where prefixes differ they decide; tops of a row therefore carry the rank of
    their audit instead of the audit, and the letters are read back along the edges.
    """
    tops, stack = {entry: (0, 0)}, []
    for kind in map("".join, zip(roles, faults, strict=True)):
        reached: dict[int, tuple[int, int, str, int]] = {}
        for top, to, cost, letters in EDGES[kind]:
            if top in tops:
                way = (tops[top][0] + cost, tops[top][1], letters, top)
                if to not in reached or way < reached[to]:
                    reached[to] = way
        stack.append(reached)
        order = sorted((rank, letters, to) for to, (_, rank, letters, _) in reached.items())
        tops = {to: (reached[to][0], n) for n, (_, _, to) in enumerate(order)}
    out = {}
    for last, (cost, _) in tops.items():
        letters, top = [], last
        for reached in reversed(stack):
            letters.append(reached[top][2])
            top = reached[top][3]
        out[last] = (cost, "".join(reversed(letters)))
    return out


def edited_roles(roles: str, audit: str, top: int) -> tuple[str, int]:
    """For each letter of an audit the initial that it gives ('-' for a deletion), and the top after it."""
    out, at = [], 0
    for letter in audit:
        role = "-" if letter == "D" else roles[at] if letter == "K" else _awaited(top)
        at += letter != "I"
        top = top if role == "-" else SHIFT[top, role]
        out.append(role)
    return "".join(out), top


def join_blocks(blocks: list[tuple[str, list[dict[int, tuple[int, str]]]]]) -> tuple[int, str, list[tuple[str, str]], tuple[str, str]]:
    """The cost, the audit, each block's (audit, initials), and the insertions after the last row, of blocks in order: (roles, parses by entry)."""
    reached: dict[int, tuple[int, str, tuple[int, ...]]] = {START: (0, "", ())}
    for _, parses in blocks:
        ahead: dict[int, tuple[int, str, tuple[int, ...]]] = {}
        for top, (cost, audit, way) in reached.items():
            for to, (more, letters) in parses[top].items():
                joined = (cost + more, audit + letters, (*way, to))
                if to not in ahead or joined < ahead[to]:
                    ahead[to] = joined
        reached = ahead
    cost, audit, top, way, closing = min((cost + CLOSE[top][0], audit + CLOSE[top][1], top, way, CLOSE[top][1]) for top, (cost, audit, way) in reached.items())
    slices, before = [], START
    for (roles, parses), to in zip(blocks, way, strict=True):
        letters = parses[before][to][1]
        slices.append((letters, edited_roles(roles, letters, before)[0]))
        before = to
    return cost, audit, slices, (closing, edited_roles("", closing, before)[0])


def damage(rows: DataFrame) -> DataFrame:
    """Damaged (conv, turn, role, text), by crc32 of conv:turn modulo 20: 0 drops the row, 1 empties its text, 2 takes its . ! and ? out, 3 repeats it, 4
    makes it the user's.  A null is one space, in that key too; a null turn stays null."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    hurt = rows.withColumn("_kind", kind).filter("_kind <> 0").withColumns({"role": F.when(F.col("_kind") == 4, "user").otherwise(role), "text": F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)})
    return hurt.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))).drop("_kind", "_copy")


def _turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(key, conv, turn, role, text); key is a text that stands for the id, null too."""
    rows = df.select(col(conv_col).alias("conv"), col(turn_col).cast("bigint").alias("turn"), col(role_col).cast("string").alias("role"), col(text_col).cast("string").alias("text"))
    return rows.withColumn("key", F.coalesce(F.concat(F.lit(":"), F.col("conv").cast("string")), F.lit("")))


def faults(rows: DataFrame) -> DataFrame:
    """Rows (key, turn, role, text; no nulls but of turn) in order, written, with k (from 1 in each dialogue), initial and fault: the first of b (no character
    but white space), d (role and text stood before) and t (the last such character ends no sentence), else '-'.

    A dialogue's rows stand by turn, nulls first; those of equal turn by role and text, of texts that agree in 64 characters by a hash.
    """
    ordered = rows.withColumns({"head": F.substring("text", 1, 64), "hash": F.xxhash64("text")})
    numbered = written(running(in_ranges(ordered, "key", "turn", "role", "head", "hash"), "key", k=(F.sum, F.lit(1).cast("long"))).drop("head", "hash", "_part", "_pos"), "turns")
    # the first of equal turns is found by a hash of 128 bits; each place is one row's, so no key of this join is crowded
    first = numbered.groupBy("key", F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("said")).agg(F.min("k").alias("k")).select("key", "k", F.lit(True).alias("first"))
    marked = numbered.select("key", "k", "turn", F.substring("role", 1, 1).alias("initial"), F.col("text").rlike(_WORD).alias("word"), F.col("text").rlike(_ENDED).alias("ended")).join(first, ["key", "k"], "left")
    fault = F.when(~F.col("word"), "b").when(F.col("first").isNull(), "d").when(~F.col("ended"), "t").otherwise("-")
    marked = marked.select("key", "k", "turn", F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(".").alias("initial"), fault.alias("fault"))
    return numbered, marked


def repair(marked: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(key, blank, duplicate, truncated, illegal, cost, audit) a dialogue, and its edits (key, block, edits, roles) a block, where block is null for the
    insertions after the last row; from rows (key, k, initial, fault)."""
    block = F.floor((F.col("k") - 1) / block_rows)
    cells = F.array_sort(F.collect_list(F.struct("k", "initial", "fault")))
    blocks = marked.groupBy("key", block.alias("block")).agg(cells.alias("c"))
    blocks = blocks.select("key", "block", F.array_join("c.initial", "").alias("roles"), F.array_join("c.fault", "").alias("faults"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways = []
            for number, roles, wrong in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                # only a first block begins at the start alone
                ways.append([{"entry": entry, "top": top, "cost": cost, "audit": audit} for entry in (range(4) if number else (START,)) for top, (cost, audit) in parse_block(roles, wrong, entry).items()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ways, kind)], names=["key", "block", "roles", "faults", "ways"])

    kind = pa.list_(pa.struct([("entry", pa.int32()), ("top", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    ways = arrow_map(blocks, parsed, "key string, block bigint, roles string, faults string, ways array<struct<entry: int, top: int, cost: bigint, audit: string>>")
    dialogues = ways.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "roles", "faults", "ways"))).alias("blocks"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blocks in batch.column(1).to_pylist():
                parts = []
                for b in blocks:
                    parses: list[dict[int, tuple[int, str]]] = [{} for _ in range(4)]
                    for w in b["ways"]:
                        parses[w["entry"]][w["top"]] = (w["cost"], w["audit"])
                    parts.append((b["roles"], parses))
                cost, audit, slices, closing = join_blocks(parts)
                roles, wrong = "".join(b["roles"] for b in blocks), "".join(b["faults"] for b in blocks)
                illegal = sum(a + b not in FOLLOWS for a, b in zip(roles, roles[1:], strict=False))
                edits = [(b["block"], *s) for b, s in zip(blocks, slices, strict=True)] + [(None, *closing)]
                out.append((wrong.count("b"), wrong.count("d"), wrong.count("t"), illegal, cost, audit, [dict(zip(("block", "edits", "roles"), e, strict=True)) for e in edits if e[1]]))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "blocks"])

    kinds = [*[pa.int64()] * 5, pa.string(), pa.list_(pa.struct([("block", pa.int64()), ("edits", pa.string()), ("roles", pa.string())]))]
    done = written(arrow_map(dialogues, joined, "key string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, blocks array<struct<block: bigint, edits: string, roles: string>>"), "repairs")
    return done.drop("blocks"), done.select("key", F.explode("blocks").alias("b")).select("key", "b.*")


def repaired_turns(numbered: DataFrame, edits: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, k, j, edit, role, text): the turns of the repaired dialogues in order of k and j; inserted ones stand before the row k, or after the last with
    k null, and have empty texts."""
    role = F.when(F.col("into") == "u", "user").when(F.col("into") == "a", "assistant")
    # a row has the insertions before it and its own letter; a block's rows are at most block_rows, so the join has no crowded key
    pieces = F.expr("regexp_extract_all(edits, '(I*[KRD])', 1)")
    own = numbered.select("key", "k", "role", "text", F.floor((F.col("k") - 1) / block_rows).alias("block"))
    met = own.join(edits.filter("block is not null").select("key", "block", pieces.alias("pieces"), "roles"), ["key", "block"])
    nth = F.pmod(F.col("k") - 1, F.lit(block_rows)).cast("int")
    # letters before this row's piece
    start = F.aggregate(F.slice("pieces", F.lit(1), nth), F.lit(0), lambda n, p: n + F.length(p))
    met = met.select("key", "k", "role", "text", F.get("pieces", nth).alias("piece"), start.alias("start"), "roles")
    met = met.select("key", "k", "role", "text", "start", "roles", F.posexplode(F.regexp_extract_all("piece", F.lit("."), F.lit(0))).alias("j", "edit"))
    met = met.withColumn("into", F.expr("substring(roles, start + j + 1, 1)")).filter("edit <> 'D'")
    kept = met.select("key", "k", "j", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(role).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))
    last = edits.filter("block is null").select("key", F.posexplode(F.regexp_extract_all("roles", F.lit("."), F.lit(0))).alias("j", "into"))
    return kept.unionByName(last.select("key", F.lit(None).cast("bigint").alias("k"), "j", F.lit("I").alias("edit"), role.alias("role"), F.lit("").alias("text")))


def damaged_and_repaired(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every dialogue, damaged by damage() and repaired.

    blank, duplicate and truncated count rows by their first fault, illegal counts neighbours whose roles may not follow each other,
    gaps the turn numbers that lack between the first and the last.  A dialogue of which no row is left has zeros, an empty audit and the digest of nothing.
    A null id is a dialogue; null turns stand first; null roles and texts are one space (so such a text is blank); equal rows of
    the table are duplicates of each other; an empty table gives no rows; other columns are not read.

    A dialogue is cut into blocks of block_rows, so one of any length is parsed in many tasks; joined are its audits, which its result holds
    anyway.  The digest takes a dialogue's texts in order, and they pass one task as a stream.
    """
    turns = _turns(df, conv_col, turn_col, role_col, text_col)
    everyone = turns.groupBy("key").agg(F.first("conv").alias("conv"))
    numbered, marked = faults(damage(turns).select("key", "turn", "role", "text"))
    done, edits = repair(marked, block_rows)
    lines = repaired_turns(numbered, edits, block_rows)
    digests = line_digests(lines.select("key", F.concat("role", F.lit(":"), "text").alias("line"), F.coalesce("k", F.lit((1 << 62))).alias("k"), "j"), "key", "line", ["k", "j"], "\n")
    # equal turns first, so that a dialogue's turns are counted in two steps
    numbers = numbered.filter("turn is not null").select("key", "turn").distinct().groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    out = everyone.join(done, "key", "left").join(numbers, "key", "left").join(digests, "key", "left")
    counted = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").alias(conv_col), *counted, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
