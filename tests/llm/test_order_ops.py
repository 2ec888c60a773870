"""Hilbert shards, repaired conversations and the prefix trie against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from acrelane.llm import hilbert, ordering, queries, repair, trie

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables too are spread over ranges, so that keys reach over them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


@pytest.mark.parametrize("name, table", [("op11_hilbert_sharding", "documents"), ("op12_conversation_repair", "conversations"), ("op13_conversation_trie", "conversations")])
def test_queries_are_sql(spark, sf_dir, name, table):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))


# ---- Hilbert shards


@pytest.mark.parametrize("n,bits", [(1, 3), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(spark, n, bits):
    cells = spark.range(1 << n * bits).select(*[F.expr(f"cast((id >> {bits * i}) & {(1 << bits) - 1} as int)").alias(f"x{i}") for i in range(n)])
    path = cells.withColumn("h", hilbert.curve_index([F.col(f"x{i}") for i in range(n)], bits)).orderBy("h").collect()
    assert [r["h"] for r in path] == list(range(1 << n * bits))
    assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in itertools.pairwise(path))


def test_cuts_part_rows_evenly(spark):
    rng = random.Random(2)
    for values in ([rng.randrange(1000) for _ in range(400)], [5] * 200 + [rng.randrange(50) for _ in range(100)], [None, None], [], [7]):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        cuts = hilbert.cut_values(df, "v", 3)
        known = sorted(v for v in values if v is not None)
        want = sorted({v: known.index(v) * 8 // len(known) for v in known}.items())
        firsts = {}
        for v, b in want:
            firsts.setdefault(b, v)
        assert cuts == sorted(v for b, v in firsts.items() if b)
        got = df.select("v", hilbert.bucket_of(F.col("v"), cuts).alias("b")).collect()
        assert all(r["b"] == (0 if r["v"] is None else sum(c <= r["v"] for c in cuts)) for r in got)


def test_sharding_query(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_hilbert_sharding"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    shards = defaultdict(list)
    for r in rows:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 8, zlib.crc32(text), "rows", None)
        shards[r["shard"]].append(r)
    assert set(shards) == set(range(24)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    for s, own in shards.items():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        # a shard is a run of the curve
        order = [r["curve"] for r in sorted(own, key=lambda r: r["slot"])]
        assert order == sorted(order) and (s == 0 or order[0] >= max(r["curve"] for r in shards[s - 1]))
    # the cells, by ranks in plain Python
    bits = hilbert.BITS
    for dim in hilbert.DIMENSIONS:
        known = sorted(d[dim] for d in docs.values() if d[dim] is not None)
        low = {}
        for i, v in enumerate(known):
            low.setdefault(v, i * (1 << bits) // len(known))
        assert len(hilbert.cut_values(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col(dim).alias("v")), "v", bits)) == len(set(low.values()) - {0})


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_on_edges(spark, law):
    schema = "doc_id long, text string, lang string, source string, n_chars long, law string, shard int"
    rows = [(1, None, None, None, None, "x", 9), (1, "", "en", "a", 0, "x", 9), (None, "é" * 10, "en", None, 10, "x", 9), (5, "w " * 30000, "de", "b", 60000, "x", 9)] + [(7, "same text", "en", "a", 9, "x", 9)] * 300
    got = hilbert.hilbert_shards(spark.createDataFrame(rows, schema).repartition(3), 5, law=law, keep=("law", "lang")).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((r[0] or -1, len((r[1] or "").encode()) + 8) for r in rows)
    assert {r["law"] for r in got} == {law} and {r["law_in"] for r in got} == {"x"}
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by.values()) and set(by) <= set(range(5))
    if law == "rows":
        assert {len(own) for own in by.values()} == {60, 61}
    assert hilbert.hilbert_shards(spark.createDataFrame([], schema), law=law).count() == 0
    few = hilbert.hilbert_shards(spark.createDataFrame(rows[:3], schema), 24, law=law).collect()
    assert len(few) == 3 and all(r["slot"] == 0 for r in few)


def test_sizes_of_shards_are_near_equal(spark, sf_dir):
    rows = hilbert.hilbert_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 6, law="bytes").groupBy("shard").agg(F.sum("size").alias("s"), F.max("size").alias("m")).collect()
    sizes, widest = [r["s"] for r in rows], max(r["m"] for r in rows)
    assert max(sizes) - min(sizes) <= 2 * widest


def test_written_shards_can_be_skipped(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = hilbert.write_shards(docs, str(tmp_path / "shards"), 24).collect()
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(back.drop("_shard").columns) == sorted(docs.columns)
    assert sorted(r["doc_id"] for r in back.collect()) == sorted(r["doc_id"] for r in docs.collect())
    assert sum(r["n_rows"] for r in manifest) == docs.count() and len(manifest) == 24
    # a reader of short documents of late sources opens a few shards; by id nearly all of them hold some
    wanted = [r for r in docs.collect() if r["n_chars"] is not None and r["n_chars"] < 300]
    opened = [m for m in manifest if m["min_n_chars"] is not None and m["min_n_chars"] < 300]
    ids = sorted(r["doc_id"] for r in docs.collect())
    by_id = {ids.index(r["doc_id"]) * 24 // len(ids) for r in wanted}
    assert len(opened) < len(by_id)
    with pytest.raises(ValueError):
        hilbert.hilbert_shards(docs, law="key")


# ---- running aggregates


def test_running_sums_begin_anew_for_each_key(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), i, rng.randrange(9)) for i in range(500)]
    df = ordering.in_ranges(spark.createDataFrame(rows, "key string, i long, v long").repartition(7), "key", "i")
    got = {(r["key"], r["i"]): (r["n"], r["s"], r["x"]) for r in ordering.running(df, "key", n=(F.sum, F.lit(1)), s=(F.sum, F.col("v")), x=(F.bit_xor, F.col("v"))).collect()}
    want, state = {}, {}
    for key, i, v in sorted(rows):
        n, s, x = state.get(key, (0, 0, 0))
        state[key] = want[key, i] = (n + 1, s + v, x ^ v)
    assert got == want and df.select("_part").distinct().count() > 1


# ---- repaired conversations


def cheapest(roles, faults):
    """All edits, one after the other, with up to two insertions anywhere."""
    best = [(10**9, "", "")]

    def go(i, seq, cost, audit):
        if cost > best[0][0]:
            return
        for k in range(3):
            for new in itertools.product("ua", repeat=k):
                s, a, c = seq + "".join(new), audit + "I" * k, cost + 3 * k
                if i == len(roles):
                    if re.fullmatch("(s?(ua)+)?", s):
                        best[0] = min(best[0], (c, a, s))
                    continue
                go(i + 1, s, c + 4, a + "D")
                if faults[i] in "-t":
                    more = 3 * (faults[i] == "t")
                    go(i + 1, s + roles[i], c + more, a + "K")
                    for r in "ua":
                        go(i + 1, s + r, c + 3 + more, a + "R")

    go(0, "", 0, "")
    return best[0]


def test_parser_is_brute_force():
    rng = random.Random(3)
    for n in range(5):
        for _ in range(40 if n < 4 else 15):
            roles, faults = "".join(rng.choice("sua.") for _ in range(n)), "".join(rng.choice("---tbd") for _ in range(n))
            want = cheapest(roles, faults)
            for size in (1, 2, 9):
                blocks = [(roles[i : i + size], [repair.parse_block(roles[i : i + size], faults[i : i + size], top) for top in range(4)]) for i in range(0, n, size)]
                cost, audit, slices, closing = repair.join_blocks(blocks)
                assert (cost, audit) == want[:2], (roles, faults)
                assert ("".join(r for _, r in slices) + closing[1]).replace("-", "") == want[2]


def plain_edits(roles, faults):
    """The least (cost, audit, initials) by whole audits at every row: no ranks, no blocks."""
    nexts = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def filled(states):
        for _ in range(3):
            for at, (c, a, s) in list(states.items()):
                for r in "ua":
                    if (at, r) in nexts:
                        to, way = nexts[at, r], (c + 3, a + "I", s + r)
                        states[to] = min(states.get(to, way), way)
        return states

    states = {"": (0, "", "")}
    for role, fault in zip(roles, faults, strict=True):
        ahead = {}
        for at, (c, a, s) in filled(dict(states)).items():
            ways = [(at, (c + 4, a + "D", s))]
            if fault in "-t":
                more = 3 * (fault == "t")
                ways += [(nexts[at, r], (c + more + 3 * (k == "R"), a + k, s + r)) for k, rs in (("K", role), ("R", "ua")) for r in rs if (at, r) in nexts]
            for to, way in ways:
                ahead[to] = min(ahead.get(to, way), way)
        states = ahead
    return min(way for at, way in filled(states).items() if at in ("", "a"))


def plain_repair(rows):
    """The contract, row by row."""
    out, by = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), ""
        for _, role, text in own:
            body = text.strip(SPACE)
            faults += "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-"
            seen.add((role, text))
        roles = [r[:1] for _, r, _ in own]
        turns = {t for t, _, _ in own if t is not None}
        cost, audit, to = plain_edits([r if r and r in "sua" else "." for r in roles], faults)
        lines, at, kept = [], 0, iter(to)
        for letter in audit:
            name = None if letter == "D" else {"u": "user", "a": "assistant"}.get(next(kept))
            if letter != "D":
                lines.append(f"{own[at][1] if letter == 'K' else name}:{'' if letter == 'I' else own[at][2]}")
            at += letter != "I"
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, "bdt"), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles)), cost, audit, sha("\n".join(lines)))
    return out


def repaired(df, **options):
    return {r["conv_id"]: tuple(r)[1:] for r in repair.damaged_and_repaired(df, **options).collect()}


def test_repair_query(spark, sf_dir):
    rows = conversations(spark, sf_dir)
    df = queries.QUERIES["op12_conversation_repair"](spark, sf_dir)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r)[1:] for r in df.collect()} == plain_repair(rows)


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_repair_on_edges(spark, block):
    rng = random.Random(8)
    texts = ["Yes.", "no", "", " \t\n", None, "Why?", "wait! \n", "x\x0b", ".", "é. ", "end. "]
    rows = [(rng.choice([None, 1, 2, 3, -4]), rng.choice([None, 0, 1, 2, 3, 7, 9]), rng.choice(["user", "assistant", "system", None, "", "tool", "User"]), rng.choice(texts)) for _ in range(120)]
    rows += [(50, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}." * (2000 if t == 5 else 1)) for t in range(300)]
    rows += [(c, 1, "user", "Hi.") for c in range(60, 110)]  # some lose their only row
    df = spark.createDataFrame(rows, TURNS).repartition(5).withColumn("key", F.lit(1)).withColumn("k", F.lit(2))
    want = plain_repair(rows)
    assert repaired(df, block_rows=block) == want
    assert any(v[5:] == (0, "", sha("")) or v[6] == "" for v in want.values())


def test_repair_of_nothing(spark):
    assert repair.damaged_and_repaired(spark.createDataFrame([], TURNS)).count() == 0


def test_repaired_turns_follow_the_grammar(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = repair._turns(df, "conv_id", "turn", "role", "text")
    numbered, marked = repair.faults(repair.damage(turns).select("key", "turn", "role", "text"))
    _, edits = repair.repair(marked, 3)
    by = defaultdict(list)
    for r in repair.repaired_turns(numbered, edits, 3).collect():
        by[r["key"]].append((10**9 if r["k"] is None else r["k"], r["j"], r["role"]))
    assert by and all(re.fullmatch("s?(ua)+", "".join(role[0] for *_, role in sorted(own))) for own in by.values())


# ---- the trie


def plain_trie(rows, shared=True):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in by.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:] if shared else turns
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        kids = children[node]
        below[node] = (sum(below[k][0] for k in kids) or 1, sum(below[k][1] for k in kids) + (len(members[node]) - 1) * words)
    return sorted((m[0], len(n), -1 if not n else members[n[:-1]][0], len(m), len(children[n]), *below[n], sha(",".join(map(str, ends.get(n, []))))) for n, m in members.items())


def told(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def test_trie_query(spark, sf_dir):
    df = queries.QUERIES["op13_conversation_trie"](spark, sf_dir)
    assert dict(df.dtypes) == {c: "bigint" for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")} | {"ends_sha256": "string"}
    assert told(df) == plain_trie(conversations(spark, sf_dir))


@pytest.mark.parametrize("width", [1, 3, 8])
def test_trie_on_edges(spark, width):
    rng = random.Random(11)
    rows = [(rng.choice([None, *range(1, 45)]), rng.choice([None, 0, 1, 2]), rng.choice(["user", None]), rng.choice(["a b", "", None, "c\td e", "x" * 5000])) for _ in range(160)]
    rows += [(c, t, "user", f"turn {t} of many") for c in (40, 47, 200, 333) for t in range(37 if c < 300 else 19)]
    df = spark.createDataFrame(rows, TURNS).repartition(6).withColumn("pos", F.lit(1)).withColumn("id", F.lit(2))
    assert told(trie.conversation_trie(df, width=width, shared_starts=True)) == plain_trie(rows)
    assert told(trie.conversation_trie(df, width=width)) == plain_trie(rows, shared=False)


def test_trie_of_conversations_without_turns(spark):
    # the base lacks, so what c takes of it is nothing; its own turns are too few
    alone = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:3]
    rows = [(c, 0, "user", "hello") for c in alone]
    want = plain_trie(rows)
    assert want == [(alone[0], 0, -1, 3, 0, 1, 0, sha(",".join(map(str, alone))))]
    assert told(trie.conversation_trie(spark.createDataFrame(rows, TURNS), shared_starts=True)) == want
    assert trie.conversation_trie(spark.createDataFrame([], TURNS), shared_starts=True).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0
