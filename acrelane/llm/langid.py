"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrelane.llm.common import clear_names, col, map_texts

#: A dictionary is made of at most SLOTS pieces of at most PIECE_CHARS characters of each language: the documented bound of
#: the sample that is learned from.
SLOTS, PIECE_CHARS = 64, 1024
LEVEL = 7
#: Texts are compressed in blocks of so many bytes, each from the dictionary alone, so that a long text does not become its own.
BLOCK = 2048
#: Margin (share by which the best size is below the second best) under which a prediction is rejected.
LEAST_MARGIN = 0.004
#: A margin at which the score is 1.
FULL_MARGIN = 0.25


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", slots: int = SLOTS, piece_chars: int = PIECE_CHARS) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from a bounded sample of labelled rows; the most frequent language first.

    Rows are dealt to slots by a hash of the id and one row of each (language, slot) is drawn by another hash: at most slots
    pieces of piece_chars characters a language come to the driver.  Rows with null text, id or language, and texts without a
    letter, are not learned from.  Over 512 languages are an error, for then the labels are something else.
    """
    rows = labelled.select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).alias("lang")).filter("id is not null and lang is not null and text rlike '\\\\p{L}'")
    rows = rows.withColumn("slot", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(slots))).withColumn("draw", F.xxhash64(F.lit(2), "id"))
    drawn = rows.groupBy("lang", "slot").agg(F.min("draw").alias("draw"), F.count("*").alias("n"))
    if drawn.select("lang").distinct().count() > 512:
        raise ValueError("over 512 languages: the labels are not a language column")
    pieces = rows.join(F.broadcast(drawn), ["lang", "slot", "draw"]).groupBy("lang", "slot").agg(F.min(F.substring("text", 1, piece_chars)).alias("piece"), F.min("n").alias("n"))
    by: dict[str, list] = {}
    for lang, slot, piece, n in pieces.collect():  # bounded: languages * slots pieces
        by.setdefault(lang, []).append((slot, piece, n))
    order = sorted(by, key=lambda lang: (-sum(n for *_, n in by[lang]), lang))
    return {lang: "\n".join(p for _, p, _ in sorted(by[lang])).lower().encode() for lang in order}


class Classifier:
    def __init__(self, dictionaries: tuple[tuple[str, bytes], ...], level: int = LEVEL, block: int = BLOCK):
        self.block, self.models = block, []
        for lang, data in dictionaries:
            raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            self.models.append((lang, zstandard.ZstdCompressor(dict_data=raw, level=level, write_content_size=False, write_checksum=False, write_dict_id=False).compress))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, margin); ("und", 0.0) for null or a text without a letter; equal sizes: the language that is more frequent."""
        if not text or not any(map(str.isalpha, text)) or not self.models:
            return "und", 0.0
        data, step = text.lower().encode(), self.block
        blocks = [data[i : i + step] for i in range(0, len(data), step)]
        sizes = sorted((sum(len(pack(b)) for b in blocks), i) for i, (_, pack) in enumerate(self.models))
        lang = self.models[sizes[0][1]][0]
        return lang, 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0


@lru_cache(maxsize=2)
def _classifier(dictionaries: tuple[tuple[str, bytes], ...]) -> Classifier:
    return Classifier(dictionaries)


def identify(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", least_margin: float = LEAST_MARGIN, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_pred, score 0..1, rejected) of every whole text.

    rejected: no letter, or a margin below least_margin.  A null text or one without a letter is 'und' with score 0.  Repeated
    rows give repeated rows; an empty table gives none; columns beside id and keep are not carried; a kept column with a result's name gets _in behind it.
    """
    model = tuple(dictionaries.items())
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded: 64 KB a language

    def fn(texts: list) -> dict:
        got = list(map(_classifier(sent.value).predict, texts))
        return {"lang_pred": pa.array([g[0] for g in got], pa.string()), "margin": pa.array([g[1] for g in got], pa.float64())}

    names = clear_names([id_col, *keep], ["lang_pred", "score", "rejected"])
    out = map_texts(df, [(f"c{i}", col(n)) for i, n in enumerate([id_col, *keep])], col(text_col), fn, "lang_pred string, margin double")
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("margin") / FULL_MARGIN)), 6)
    rejected = (F.col("lang_pred") == "und") | (F.col("margin") < least_margin)
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "lang_pred", score.alias("score"), rejected.alias("rejected"))


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(col(id_col).cast("string")) % 5 == 0, F.lit(False))
