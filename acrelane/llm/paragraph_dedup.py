"""Substring dedup: paragraphs that repeat, alike or as a passage inside of another paragraph.

Paragraphs (lines of at least MIN_WORDS words, as many as a shingle has) are compared by MinHash over five-word shingles: bands of signatures, a join of colliding
paragraphs, exact Jaccard similarity, components.  A passage may also stand in the middle of longer lines that are not alike.
For these, every text gives winnowed windows: of each WINDOW_SPAN successive windows of WINDOW_WORDS words the one with the least hash,
so that two texts which share PASSAGE_WORDS (51) words in a row always share a window.  A shared window is an anchor: its two
texts are laid side by side there, and the whole run of equal words around it is the passage.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrelane.llm.common import arrow_map, col, drop_written, slices, written
from acrelane.llm.components import bucket_links, connected_components

SHINGLE_WORDS, LEAST_JACCARD = 5, 0.8
#: Shorter lines hold no shingle; with a lower min_words they are compared as wholes.
MIN_WORDS = SHINGLE_WORDS
#: 10 bands of 3: a pair of similarity 0.8 collides in one of them with probability 0.999.
BANDS, BAND_ROWS = 10, 3
WINDOW_WORDS, WINDOW_SPAN = 20, 32
#: A shorter run of equal words is no passage, if its window stands at two places only; at more, two others may share a longer one around it.
PASSAGE_WORDS = WINDOW_WORDS + WINDOW_SPAN - 1
#: A side of a join that is counted to have at most so many rows (an id and a few numbers) is broadcast.
SMALL_SIDE = 250_000
#: So is a side of lists, if all of them together are counted to have at most so many entries (a line number and a hash each, 32 bytes).
SMALL_LISTS = 1_000_000
#: Scripts without spaces between words (Thai to Lao, Burmese, Khmer, kana, Han): each character is a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W{_UNSPACED}]+|[{_UNSPACED}]")
_RNG = np.random.default_rng(20240917)
_MIX = _RNG.integers(1, 1 << 62, BANDS * BAND_ROWS, dtype=np.uint64) * 2 + 1
_ADD = _RNG.integers(0, 1 << 62, BANDS * BAND_ROWS, dtype=np.uint64)
_POWER = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_POWER), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64) for base in (_POWER, inverse))


def prefix_sums(words: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch of words follows at once."""
    _, inverse = _powers(1 << max(16, len(words).bit_length()))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * inverse[: len(words)], dtype=np.uint64)])


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """Hashes of the n words from each start; they do not depend on where the words stand."""
    powers, _ = _powers(1 << max(16, (len(sums) - 1).bit_length()))
    return _scramble((sums[starts + n] - sums[starts]) * powers[starts + n - 1])


def gram_hashes(words: np.ndarray, n: int, sums: np.ndarray | None = None) -> np.ndarray:
    """A hash of each n successive words (of all, if they are fewer)."""
    n = min(n, len(words))
    return stretch_hashes(prefix_sums(words) if sums is None else sums, np.arange(len(words) - n + 1), n)


def band_keys(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the bands of the MinHash signatures of paragraphs: one row each; a paragraph's shingles begin at its start."""
    out = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64)
        for k in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
            key = _scramble(key * _POWER + np.minimum.reduceat(shingles * _MIX[k] + _ADD[k], starts))
        out[:, band] = key
    return out


def _sliding(x: np.ndarray, span: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of each span successive elements, by doubling."""
    width = 1
    while width * 2 <= span:
        x = least(x[:-width], x[width:])
        width *= 2
    return least(x[: len(x) - (span - width)], x[span - width :]) if width < span else x


def winnowed(grams: np.ndarray, span: int = WINDOW_SPAN) -> np.ndarray:
    """Positions that hold the least hash of some span successive ones (of the whole, if it is shorter); of a run of equal hashes the first."""
    if len(grams) <= span:
        return np.array([int(np.argmin(grams))]) if len(grams) else np.zeros(0, int)
    least = _sliding(grams, span, np.minimum)
    # the greatest of the minima over the windows that hold a position is its own hash only if it is the least of one of them
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    picked = _sliding(padded, span, np.maximum) == grams
    picked[1:] &= grams[1:] != grams[:-1]
    return np.flatnonzero(picked)


def paragraphs(text: str) -> list[list[str]]:
    """Words of each line, lower-case."""
    return [_WORD.findall(line) for line in text.lower().split("\n")]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def units(df: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, doc bigint, line int, start int, words int, unit bigint, bands array): paragraphs (line number, bands) and windows (line -1, the first of a text -2, no bands);
    doc is a hash of the text's words, start the number of the first word in the text, unit a hash of the words; words is a paragraph's number of words, with windows the whole text's."""
    kind = df.select(col(id_col)).schema[0].dataType.simpleString()
    names = ["k0", "doc", "line", "start", "words", "unit", "bands"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                docs = np.zeros(part.num_rows, np.uint64)
                owner, line, start, words, unit = [], [], [], [], []  # paragraphs
                w_owner, w_start, w_words, w_unit = [], [], [], []  # windows, an array a text
                shingles, begins, held = [], [], 0
                for i, text in enumerate(part.column(1).to_pylist()):
                    lines = paragraphs(text or "")
                    hashes = word_hashes([w for ws in lines for w in ws])
                    if len(hashes) < min(WINDOW_WORDS, min_words):
                        continue
                    sums = prefix_sums(hashes)
                    docs[i] = stretch_hashes(sums, np.zeros(1, int), len(hashes))[0]
                    grams = gram_hashes(hashes, SHINGLE_WORDS, sums)
                    first = len(unit)
                    at = 0
                    for k, ws in enumerate(lines):
                        n = len(ws)
                        if n >= min_words:
                            owner.append(i), line.append(k), start.append(at), words.append(n)
                            unit.append(0)
                            own = grams[at : at + n - SHINGLE_WORDS + 1] if n >= SHINGLE_WORDS else gram_hashes(hashes[at : at + n], n)
                            shingles.append(own)
                            begins.append(held)
                            held += len(own)
                        at += n
                    if len(unit) > first:
                        unit[first:] = stretch_hashes(sums, np.array(start[first:]), np.array(words[first:])).tolist()
                    if at >= WINDOW_WORDS:
                        wide = gram_hashes(hashes, WINDOW_WORDS, sums)
                        places = winnowed(wide)
                        w_owner.append(np.full(len(places), i))
                        w_start.append(places)
                        w_words.append(np.full(len(places), at))
                        w_unit.append(wide[places])
                keys = band_keys(np.concatenate(shingles), np.array(begins)) if begins else np.zeros((0, BANDS), np.uint64)
                n_windows = sum(map(len, w_unit))
                empty = np.zeros(0, np.uint64)
                bands = pa.ListArray.from_arrays(pa.array(np.minimum(np.arange(len(owner) + n_windows + 1), len(owner)) * BANDS, pa.int32()), pa.array(_signed(keys.ravel())))
                columns = [np.concatenate([owner, *w_owner]), np.concatenate([line, *(np.where(np.arange(len(x)), -1, -2) for x in w_unit)]), np.concatenate([start, *w_start]), np.concatenate([words, *w_words])]
                at = columns[0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(_signed(docs[at])), *(pa.array(c.astype(np.int32)) for c in columns[1:]), pa.array(_signed(np.concatenate([empty, np.array(unit, np.uint64), *w_unit]))), bands], names=names)

    out = arrow_map(df.select(col(id_col).alias("k0"), col(text_col).alias("text")), run, f"k0 {kind}, doc bigint, line int, start int, words int, unit bigint, bands array<bigint>")
    return out.withColumnRenamed("k0", "id")


def _is_small(side: DataFrame, most: int = SMALL_SIDE) -> bool:
    return side.limit(most + 1).count() <= most


def _small(side: DataFrame) -> DataFrame:
    """side, marked for broadcast if it is counted small."""
    return F.broadcast(side) if _is_small(side) else side


def _collisions(lines: DataFrame) -> DataFrame:
    """(key, node) of the bands that several units of lines(unit, bands) have; equal paragraphs are one node."""
    each = lambda rows: rows.select(F.col("unit").alias("node"), F.explode("bands").alias("key"))
    distinct = lines.groupBy("unit").agg(F.first("bands").alias("bands"))
    keys = each(distinct).groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi")
    keys = written(keys, "keys")
    # the least and the greatest node are all that a key of two has; only keys of more are looked up among the lines
    two = keys.filter("n = 2").select("key", F.explode(F.array("lo", "hi")).alias("node"))
    more = keys.filter("n > 2").select("key")
    small = _is_small(more)
    found = each(lines if small else distinct).join(F.broadcast(more) if small else more, "key").select("key", "node").distinct()
    met = written(two.unionAll(found), "collisions")
    drop_written(keys)
    return met


def _shingles(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(unit, shingles array) of wanted paragraphs (id, line, unit), once a unit."""
    lists = wanted.groupBy("id").agg(F.collect_set(F.struct("line", "unit")).alias("want"))  # bounded by a document's own lines
    lists = F.broadcast(lists) if _is_small(wanted, SMALL_LISTS) else lists
    docs = df.select(col(id_col).alias("owner"), col(text_col).alias("text"))
    chosen = docs.join(lists, F.col("owner").eqNullSafe(F.col("id"))).select("text", F.col("want.line").alias("lines"), F.col("want.unit").alias("units"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                units_, sets = [], []
                for text, lines, wanted_units in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    by_line = paragraphs(text or "")
                    for line, unit in zip(lines, wanted_units, strict=True):
                        if line < len(by_line) and by_line[line]:
                            own = word_hashes(by_line[line])
                            if gram_hashes(own, len(own)).view(np.int64)[0] == unit:  # an id may come with several texts
                                units_.append(unit)
                                sets.append(_signed(np.unique(gram_hashes(own, SHINGLE_WORDS))))
                yield pa.RecordBatch.from_arrays([pa.array(units_, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["unit", "shingles"])

    return arrow_map(chosen, run, "unit bigint, shingles array<bigint>").dropDuplicates(["unit"])


def equal_run(a: np.ndarray, b: np.ndarray, i: int, j: int, step: int = 256) -> tuple[int, int]:
    """How many words before a[i] and b[j], and from there on, are equal in a row."""
    back = ahead = 0
    while (n := min(step, i - back, j - back)) > 0:
        differ = np.flatnonzero(a[i - back - n : i - back] != b[j - back - n : j - back])
        if len(differ):
            back += n - 1 - int(differ[-1])
            break
        back += n
    while (n := min(step, len(a) - i - ahead, len(b) - j - ahead)) > 0:
        differ = np.flatnonzero(a[i + ahead : i + ahead + n] != b[j + ahead : j + ahead + n])
        if len(differ):
            ahead += int(differ[0])
            break
        ahead += n
    return back, ahead


@lru_cache(maxsize=16)
def _hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words, and their sums; the same first text often comes several times in a row."""
    hashes = word_hashes([w for ws in paragraphs(text) for w in ws])
    return hashes, prefix_sums(hashes)


def _whole(sums: np.ndarray) -> int:
    """The hash of all words."""
    return int(stretch_hashes(sums, np.zeros(1, int), len(sums) - 1).view(np.int64)[0]) if len(sums) > 1 else 0


def _runs(df: DataFrame, id_col: str, text_col: str, windows: DataFrame) -> DataFrame:
    """(doc, start, words, unit) of the runs of equal words around windows (id, doc, start, unit) that occur more than once, each against
    the first place of its window; a run is given at both places.  Texts of the same words (doc) are one, the one of the least id, and not laid beside themselves."""
    # most windows stand alone: they are counted before any place is shuffled
    shared = written(windows.groupBy("unit").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    spots = windows.join(_small(shared), "unit").groupBy("unit", "doc", "start", "n").agg(F.min(F.struct("id")).alias("x"))
    spots = written(spots.select("unit", "doc", "start", "n", "x.id"), "spots")
    firsts = written(spots.groupBy("unit").agg(F.min(F.struct("id", "start", "doc")).alias("first")), "firsts")
    placed = spots.join(_small(firsts), "unit").filter((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    placed = written(placed.select("id", "doc", "start", F.col("first.id").alias("other"), F.col("first.doc").alias("other_doc"), F.col("first.start").alias("at"), "unit", "n"), "anchors")
    for done in (shared, spots, firsts):
        drop_written(done)
    pairs = placed.groupBy("id", "doc", "other", "other_doc").agg(F.collect_list(F.struct("start", "at", "n")).alias("xs"))  # bounded by a document's own windows
    docs = df.select(col(id_col).alias("owner"), col(text_col).alias("text"))
    few = _is_small(placed)
    # pairs too many to be broadcast may still be of few documents: the texts of the others are not shuffled
    holders = docs if few else docs.join(_small(written(placed.select(F.col("id").alias("holder")).distinct(), "holders")), F.col("owner").eqNullSafe(F.col("holder")), "left_semi")
    mine = holders.join(F.broadcast(pairs) if few else pairs, F.col("owner").eqNullSafe(F.col("id"))).drop("owner")
    heads = placed.select(F.col("other").alias("head")).distinct()
    theirs = docs.join(_small(written(heads, "heads")), F.col("owner").eqNullSafe(F.col("head")), "left_semi").withColumnRenamed("text", "first_text")
    laid = mine.join(theirs, F.col("other").eqNullSafe(F.col("owner")))
    laid = laid.select("text", "first_text", "doc", "other_doc", *[F.col(f"xs.{c}").alias(f"x_{c}") for c in ("start", "at", "n")])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                rows = []
                for text, first_text, doc, first_doc, *anchors in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    (a, sums), (b, first_sums) = _hashed(text or ""), _hashed(first_text or "")
                    if _whole(sums) != doc or _whole(first_sums) != first_doc:  # an id may come with several texts
                        continue
                    done = {}  # by diagonal, the end of the last run
                    for i, j, n_places in sorted(zip(*anchors, strict=True)):
                        if i < done.get(i - j, 0):
                            continue
                        back, ahead = equal_run(a, b, i, j)
                        n = back + ahead
                        if ahead < WINDOW_WORDS or (n < PASSAGE_WORDS and n_places == 2):
                            continue
                        done[i - j] = i + ahead
                        unit = int(stretch_hashes(sums, np.array([i - back]), n).view(np.int64)[0])
                        rows.append((doc, first_doc, i - back, j - back, n, unit))
                kinds = {"doc": pa.int64(), "other_doc": pa.int64(), "start": pa.int32(), "at": pa.int32(), "words": pa.int32(), "unit": pa.int64()}
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    runs = written(arrow_map(laid, run, "doc bigint, other_doc bigint, start int, at int, words int, unit bigint"), "runs")
    drop_written(placed)
    return runs.select("doc", "start", "words", "unit").unionAll(runs.select("other_doc", "at", "words", "unit")).distinct()


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_JACCARD, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, line, start_word, n_words, component_id, n_places, keeps) of every paragraph or passage that occurs more than once.

    line is the paragraph's line number, or -1 for a passage: all the words in a row, across lines too, that are equal to those around the first
    place of a shared window; start_word counts the words of the text from 0.  component_id names the group of equal or near paragraphs
    (or equal passages), n_places how often it was found, keeps the first place by id, line and start; all other places are for removal.
    Texts of 20 words and more that have the same words are one passage as a whole; passages within them are named at the first of these
    texts only, as all others go.

    Null and empty texts have no paragraphs; repeated rows are further places; ids that are null take part (and come
    first); an empty table gives no rows; documents without repetition give none; other columns are not carried.
    """
    places = written(units(df, id_col, text_col, min_words), "units")
    lines = places.filter("line >= 0")
    met = _collisions(lines)
    nodes = written(met.select(F.col("node").alias("unit")).distinct(), "nodes")
    wanted = lines.join(_small(nodes), "unit").groupBy("unit").agg(F.min(F.struct("id", "line")).alias("x")).select("x.id", "x.line", "unit")
    wanted = written(wanted, "wanted")
    sets = written(_shingles(df, id_col, text_col, wanted), "shingles").select(F.col("unit").alias("node"), F.col("shingles").alias("items"))
    parts = written(connected_components(bucket_links(met.select("key", "node"), sets, least)), "parts")
    for done in (met, wanted, sets):
        drop_written(done)
    # groups: paragraphs by component, windows by their own hash
    named = lines.join(_small(parts), F.col("unit") == F.col("node"), "left").select("id", "line", "start", "words", F.coalesce("component", "unit").alias("component"))
    heads = named.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("id", "line", "start")).alias("first")).filter("n > 1")
    alike = written(named.join(_small(written(heads, "groups")), "component"), "alike")
    # copies of a text are one passage, all its words; runs within it are given at its first row, or they would be as many as copies times runs
    rows = places.filter("line = -2").select("id", "doc", "words")  # one a text
    texts = written(rows.groupBy("doc", F.col("words").alias("total")).agg(F.count("*").alias("copies"), F.min(F.struct("id")).alias("x")), "texts")
    whole = rows.join(_small(texts.filter("copies > 1").select("doc")), "doc").select("id", F.lit(-1).alias("line"), F.lit(0).alias("start"), "words", F.col("doc").alias("component"))
    runs = _runs(df, id_col, text_col, places.filter("line < 0").select("id", "doc", "start", "unit"))
    runs = runs.join(texts, "doc").filter("copies = 1 or words < total").select("x.id", F.lit(-1).alias("line"), "start", "words", F.col("unit").alias("component"))
    passages = written(whole.unionAll(runs), "passages")
    drop_written(places)
    firsts = passages.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("id", "line", "start")).alias("first")).filter("n > 1")
    found = alike.select("component", "id", "line", "start", "words", "n", "first").unionByName(passages.join(firsts, "component"))
    first = F.struct("id", "line", "start") == F.col("first")
    return found.select(F.col("id").alias(id_col), "line", F.col("start").alias("start_word"), F.col("words").alias("n_words"), F.col("component").alias("component_id"), F.col("n").alias("n_places"), F.coalesce(first, F.lit(False)).alias("keeps"))


def _cut(text: str, lines: list[int], words: list[tuple[int, int, list]]) -> str:
    """text without some lines and some stretches of words (start, number, holes that stay: start and number within the stretch)."""
    low = text.lower()
    # a character may be longer in lower case
    origin = None if len(low) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
    gone = np.zeros(len(_WORD.findall(low)), bool)
    for start, n, holes in words:
        part = np.ones(n, bool)
        for at, size in holes:
            part[max(0, at) : at + size] = False
        gone[start : start + n] |= part[: max(0, len(gone) - start)]
    kept, lines, at, word = [], set(lines), 0, 0
    for k, line in enumerate(low.split("\n")):
        spans = [(m.start() + at, m.end() + at) for m in _WORD.finditer(line)]
        own = gone[word : word + len(spans)]
        end = at + len(line)
        if k not in lines and not (len(own) and own.all()):
            pieces, begin, i = [], at, 0
            while i < len(spans):
                if not own[i]:
                    i += 1
                    continue
                first = i
                while i < len(spans) and own[i]:
                    i += 1
                pieces.append((begin, spans[first][0]))
                begin = spans[i - 1][1]
                while begin < end and low[begin].isspace():
                    begin += 1
            pieces.append((begin, end))
            place = (lambda x: x) if origin is None else (lambda x: origin[x] if x < len(origin) else len(text))
            kept.append("".join(text[place(a) : place(b)] for a, b in pieces))
        at, word = end + 1, word + len(spans)
    return "\n".join(kept)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df without the lines and the passages that repeated_passages names for removal; all columns stay.

    A passage stays as far as its first place lies in a line that goes (for it is near another, but not equal).  Lines are found by
    document id, so ids should be unique; a row whose lines all go keeps an empty text.
    """
    found = written(repeated_passages(df, id_col, text_col, **options).withColumnRenamed(id_col, "_id"), "repeats")
    gone = found.filter("line >= 0 and not keeps")
    passages = found.filter("line < 0")
    heads = passages.filter("keeps").select("component_id", F.col("_id").alias("head"), F.col("start_word").alias("at"), F.col("n_words").alias("n")).distinct()
    inside = (F.col("start_word") < F.col("at") + F.col("n")) & (F.col("at") < F.col("start_word") + F.col("n_words"))
    holes = heads.join(gone, F.col("head").eqNullSafe(F.col("_id")) & inside).select(heads["component_id"], F.struct((F.col("start_word") - F.col("at")).alias("at"), F.col("n_words").alias("n")).alias("hole"))
    holes = holes.groupBy("component_id").agg(F.collect_set("hole").alias("holes"))  # bounded by a passage's lines
    cuts = passages.filter("not keeps").join(holes, "component_id", "left").select("_id", F.struct(F.col("start_word").alias("start"), F.col("n_words").alias("n"), "holes").alias("cut"))
    each = gone.select("_id", "line", F.lit(None).cast(cuts.schema["cut"].dataType).alias("cut")).unionAll(cuts.select("_id", F.lit(None).cast("int"), "cut"))
    lists = each.groupBy("_id").agg(F.collect_set("line").alias("_lines"), F.collect_list("cut").alias("_cuts"))
    joined = df.join(lists, col(id_col).eqNullSafe(F.col("_id")), "left").select(*[df[f"`{c}`"] for c in df.columns], "_lines", "_cuts")
    where = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, where):
                texts = part.column(where).to_pylist()
                for i, (lines, cuts_) in enumerate(zip(part.column(len(df_names)).to_pylist(), part.column(len(df_names) + 1).to_pylist(), strict=True)):
                    if texts[i] is not None and lines is not None:
                        texts[i] = _cut(texts[i], lines, [(c["start"], c["n"], [(h["at"], h["n"]) for h in c["holes"] or ()]) for c in cuts_])
                columns = part.columns[: len(df_names)]
                columns[where] = pa.array(texts, columns[where].type)
                yield pa.RecordBatch.from_arrays(columns, names=df_names)

    df_names = df.columns
    return arrow_map(joined, run, df.schema)
