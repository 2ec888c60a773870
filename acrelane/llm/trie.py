"""The prefix trie of conversations by one ROLLUP over positional turn-id columns.

A conversation is laid out in rows of BLOCK_TURNS turn columns; a row is keyed by the node that its earlier turns lead to, so all blocks of all
conversations are rolled up together and no depth is a round.  grouping_id() tells how many turns a node takes of its block.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelane.llm.common import col, written
from acrelane.llm.ordering import in_ranges, line_digests, running

#: Turn columns of a row.
BLOCK_TURNS = 8
#: Conversations that share the first turns of one of them, and the greatest number of turns that are shared.
FAMILY, MOST_SHARED = 20, 3
_WORDS = r"[^\x20\x09-\x0D]+"


def ordered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, k, id, words): turns numbered from 1 in each conversation, with a 128-bit id of role and text and the words of the text.

    By turn, nulls first, those of equal turn by role and text (of texts that agree in 64 characters by their id).  Null role and text are empty.  Rows
    without a conversation id are left out.
    """
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.size(F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))).cast("long")
    rows = df.filter(col(conv_col).isNotNull()).select(col(conv_col).cast("bigint").alias("conv"), col(turn_col).cast("bigint").alias("turn"), role.alias("role"), F.substring(text, 1, 64).alias("head"), said.alias("id"), words.alias("words"))
    numbered = running(in_ranges(rows, "conv", "turn", "role", "head", "id"), "conv", k=(F.sum, F.lit(1).cast("long")))
    return numbered.select("conv", "k", "id", "words")


def with_shared_starts(turns: DataFrame) -> DataFrame:
    """(conv, pos, id, words): conversation c begins with the first h turns of c - c % FAMILY, h = crc32(c) % (MOST_SHARED + 1), and goes on with its own after
    the first h; pos is null in the one row of a conversation to which no turn is left."""
    convs = turns.groupBy("conv").agg(F.max("k").alias("n"))
    asked = convs.select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_SHARED + 1)).alias("h"))
    lengths = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    asked = asked.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    # a base is asked by FAMILY conversations at most, for MOST_SHARED turns
    first = turns.filter(F.col("k") <= MOST_SHARED).select(F.col("conv").alias("base"), "k", "id", "words")
    shared = asked.join(first, "base").filter(F.col("k") <= F.col("taken")).select("conv", F.col("k").alias("pos"), "id", "words")
    own = turns.join(asked.select("conv", "h", "taken"), "conv").filter(F.col("k") > F.col("h")).select("conv", (F.col("k") - F.col("h") + F.col("taken")).alias("pos"), "id", "words")
    bare = convs.join(asked, "conv").filter((F.col("taken") == 0) & (F.col("n") <= F.col("h"))).select("conv", F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("bigint").alias("words"))
    return shared.unionByName(own).unionByName(bare)


def _mark(pos: Column, turn: Column, seed: int) -> Column:
    """64 bits of a turn at its place; the marks of a prefix, taken together by exclusive or, stand for it."""
    return F.xxhash64(F.lit(seed), pos, turn)


def _blocks(rows: DataFrame, width: int, values: list[str]) -> DataFrame:
    """(conv, block, a, b, t0.., and value0..): a row for each conversation and block of turns, keyed (a, b) by the turns before it.  A conversation without turns
    has block 0."""
    placed = rows.withColumns({"block": F.coalesce(F.floor((F.col("pos") - 1) / width), F.lit(0)), "slot": F.pmod(F.col("pos") - 1, F.lit(width)), "ha": F.when(F.col("pos").isNull(), F.lit(0).cast("bigint")).otherwise(_mark(F.col("pos"), F.col("id"), 1)), "hb": F.when(F.col("pos").isNull(), F.lit(0).cast("bigint")).otherwise(_mark(F.col("pos"), F.col("id"), 2))})
    at = [F.max(F.when(F.col("slot") == i, F.col(name))).alias(f"{label}{i}") for name, label in (("id", "t"), *[(v, v) for v in values]) for i in range(width)]
    laid = placed.groupBy("conv", "block").agg(F.bit_xor("ha").alias("ha"), F.bit_xor("hb").alias("hb"), *at)
    summed = running(in_ranges(laid, "conv", "block"), "conv", a=(F.bit_xor, F.col("ha")), b=(F.bit_xor, F.col("hb")))
    # without the block's own turns
    return summed.withColumns({"a": F.col("a").bitwiseXOR(F.col("ha")), "b": F.col("b").bitwiseXOR(F.col("hb"))}).drop("ha", "hb", "_part", "_pos")


def _rolled(blocks: DataFrame, width: int, aggregates: str) -> DataFrame:
    """The nodes: (a, b, depth) of each, (pa, pb) of its parent, and aggregates over its members.  aggregates may name {level} columns by x[level]."""
    turns = ", ".join(f"t{i}" for i in range(width))
    sql = f"SELECT a AS ka, b AS kb, block, {turns}, {width} - bit_count(grouping_id()) AS level, {aggregates} FROM {{blocks}} GROUP BY a, b, block, ROLLUP({turns})"
    rolled = blocks.sparkSession.sql(sql, blocks=blocks)
    last = F.element_at(F.array(F.lit(None).cast("binary"), *[F.col(f"t{i}") for i in range(width)]), F.col("level") + 1)
    # level 0 is the node of the block before, and at a turn that is not there no conversation of the group goes on
    rolled = rolled.filter((F.col("level") == 0) & (F.col("block") == 0) | last.isNotNull())

    def key(start: str, seed: int, level: Column) -> Column:
        out = F.col(start)
        for i in range(width):
            mark = _mark(F.col("block") * width + i + 1, F.col(f"t{i}"), seed)
            out = out.bitwiseXOR(F.when(level > i, mark).otherwise(F.lit(0).cast("bigint")))
        return out

    level = F.col("level")
    named = rolled.withColumns({"depth": F.col("block") * width + level, "a": key("ka", 1, level), "b": key("kb", 2, level), "pa": key("ka", 1, level - 1), "pb": key("kb", 2, level - 1)})
    return named.drop(*[f"t{i}" for i in range(width)], "block", "ka", "kb")


def prefix_trie(rows: DataFrame, width: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node, from (conv, pos, id, words).

    A node is a distinct sequence of first turns; its members are the conversations that begin with it; conv_id is the smallest, which with the
    depth names the node.  saved_tokens sums over the node's subtree the words of each node's last turn times its members but one: what need not be
    computed again.  ends_sha256 digests the ids of the conversations that end there.  An empty table has no node, not even the root.

    Sums over subtrees are a second ROLLUP: each node's amount is put at its smallest member, whose amounts are summed from its end,
    so that the members of any node bring what lies below it.
    """
    rows = written(rows, "rebuilt")
    blocks = written(_blocks(rows, width, ["words"]), "blocks")
    words = ", ".join(f"max(words{i})" for i in range(width))
    nodes = _rolled(blocks, width, f"min(conv) AS conv_id, count(*) AS n_convs, element_at(array(0L, {words}), {width} - bit_count(grouping_id()) + 1) AS words")
    nodes = written(nodes.drop("level"), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["a", "b", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    nodes = written(nodes.join(parents, ["pa", "pb", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "words", "a", "b"), "nodes")

    # what each conversation owns, at its places; (conv, pos) is one row's
    owned = nodes.select(F.col("conv_id").alias("conv"), F.col("depth").alias("pos"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).alias("leaf"))
    valued = rows.withColumn("pos", F.coalesce("pos", F.lit(0).cast("bigint"))).join(owned, ["conv", "pos"], "left")
    valued = valued.select("conv", "pos", "id", F.coalesce("saved", F.lit(0).cast("bigint")).alias("saved"), F.when(F.col("leaf"), 1).otherwise(0).cast("bigint").alias("leaf"))
    upto = running(in_ranges(valued, "conv", "pos"), "conv", upto=(F.sum, F.col("saved"))).drop("_part", "_pos")
    whole = valued.groupBy("conv").agg(F.sum("saved").alias("whole"), F.sum("leaf").alias("leaves"))
    below = upto.join(whole, "conv").select("conv", F.when(F.col("pos") > 0, F.col("pos")).alias("pos"), "id", (F.col("whole") - F.col("upto") + F.col("saved")).alias("below"), "leaves")
    summed = _rolled(written(_blocks(below, width, ["below", "leaves"]), "valued"), width, f"min(conv) AS conv_id, element_at(array(sum(below0), {', '.join(f'sum(below{i})' for i in range(width))}), {width} - bit_count(grouping_id()) + 1) AS saved_tokens, element_at(array(sum(leaves0), {', '.join(f'sum(leaves{i})' for i in range(width))}), {width} - bit_count(grouping_id()) + 1) AS n_leaves")
    # a root of which no conversation has a turn is a leaf
    summed = summed.select("conv_id", "depth", F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"))
    out = nodes.join(summed, ["conv_id", "depth"]).join(_ends(rows), ["a", "b", "depth"], "left")
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))


def _ends(rows: DataFrame) -> DataFrame:
    """(a, b, depth, ends_sha256) of the nodes at which conversations end."""
    marks = [F.bit_xor(F.when(F.col("pos").isNull(), F.lit(0).cast("bigint")).otherwise(_mark(F.col("pos"), F.col("id"), seed))) for seed in (1, 2)]
    ends = rows.groupBy("conv").agg(marks[0].alias("a"), marks[1].alias("b"), F.count("pos").alias("depth"))
    keyed = ends.select(F.concat_ws(":", "a", "b", "depth").alias("node"), "conv")
    digests = line_digests(keyed, "node", "conv", ["conv"], ",")
    part = F.split("node", ":")
    return digests.select(*[F.get(part, F.lit(i)).cast("bigint").alias(c) for i, c in enumerate(("a", "b", "depth"))], F.col("sha256").alias("ends_sha256"))


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", width: int = BLOCK_TURNS, shared_starts: bool = False) -> DataFrame:
    """prefix_trie() of a table of turns; with shared_starts of the conversations that with_shared_starts() makes of them.

    Null turns stand first, null roles and texts are empty, rows without a conversation id are left out, repeated rows are further turns; an empty
    table gives no rows; other columns are not read.  Conversations of any length are spread over ranges and blocks.
    """
    turns = ordered_turns(df, conv_col, turn_col, role_col, text_col)
    if shared_starts:
        return prefix_trie(with_shared_starts(written(turns, "turns")), width)
    return prefix_trie(turns.withColumnRenamed("k", "pos"), width)
