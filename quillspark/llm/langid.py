"""Language identification by compression: the language whose dictionary helps most names the text."""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fold_bucket, unused

UNKNOWN = "und"


def learn_dictionaries(docs: DataFrame, slots: int = 256, block_chars: int = 448) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from rows of docs (text, lang) that have both; any lang is learned, also an empty one.

    A bounded sample: whole texts are cut into blocks of block_chars characters, all of which are candidates, and
    for each language the block with the smallest hash in each of `slots` hash classes is taken. So a dictionary
    has slots * block_chars characters at most, however long the texts and however many there are, and nothing
    depends on the order of rows. Blocks are told apart by their hash, so copies count once.
    """
    known = docs.where("text is not null and lang is not null and text rlike '\\\\p{L}'")
    blocks = known.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))).alias("block"))
    digest = F.xxhash64("block")
    best = blocks.groupBy("lang", F.pmod(digest, F.lit(slots)).alias("slot")).agg(F.min(F.struct(digest.alias("digest"), "block")).alias("best"))
    found: dict[str, bytes] = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["best"])):
        found[r["lang"]] = found.get(r["lang"], b"") + r["best"]["block"].encode("utf-8", "replace") + b"\n"
    return found


def identifier(dictionaries: dict[str, bytes], level: int = 9, block: int = 1024):
    """text -> (language, score). The score is the share by which the best language's size undercuts the next.

    Texts are compressed in blocks, so that a dictionary counts for all of a long text and not only its start.
    Ties go to the first language by name; with one language the score is 1.
    """
    plain = dict(write_checksum=False, write_content_size=False, write_dict_id=False)
    raw = zstandard.DICT_TYPE_RAWCONTENT
    packers = [(lang, zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=raw), **plain)) for lang, d in sorted(dictionaries.items())]

    def identify(text: str | None) -> tuple[str, float]:
        if not packers or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        data = text.lower().encode("utf-8", "replace")
        blocks = [data[at : at + block] for at in range(0, len(data), block)]
        sizes = sorted((sum(len(p.compress(b)) for b in blocks), lang) for lang, p in packers)
        return sizes[0][1], 1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / sizes[1][0]

    return identify


def identify_column(text, dictionaries: dict[str, bytes], **options):
    """Column of struct<lang: string, score: double>."""

    @F.pandas_udf("lang string, score double")
    def identified(texts: pd.Series) -> pd.DataFrame:
        identify = identifier(dictionaries, **options)
        return pd.DataFrame([identify(t) for t in texts], columns=["lang", "score"])

    return identified(text)


def predict_languages(docs: DataFrame, margin: float = 0.005, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of docs (doc_id, text, lang).

    Learns from rows whose crc32(doc_id) modulo 3 is not 1 (a null doc_id is never learned from). A text that
    is null, empty or without a letter is `und` with score 0; rejected holds for these and where the score is
    under margin. Without any labelled row every text is `und`. Texts of any length are read whole, in blocks.
    Ties go to the first language by name. Repeated rows give repeated rows, and an empty table an empty one.
    Other columns, whatever their names, are neither read nor returned. The dictionaries go to every task: some
    110 KB for each distinct lang that is learned.
    """
    held_out = F.coalesce(fold_bucket("doc_id", 3) == 1, F.lit(False))
    dictionaries = learn_dictionaries(docs.where(~(fold_bucket("doc_id", 3) == 1)))
    out = docs.select("doc_id", held_out.alias("held_out"), identify_column(F.col("text"), dictionaries, **options).alias("found"))
    return out.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), (F.col("found.lang").eqNullSafe(UNKNOWN) | (F.col("found.score") < margin)).alias("rejected"))


def drop_rejected(docs: DataFrame, margin: float = 0.005, **options) -> DataFrame:
    """docs with all columns, less the rows that predict_languages rejects."""
    dictionaries = learn_dictionaries(docs.where(~(fold_bucket("doc_id", 3) == 1)))
    found = unused("found", docs)
    judged = docs.withColumn(found, identify_column(F.col("text"), dictionaries, **options))
    return judged.where((F.col(f"{found}.lang") != UNKNOWN) & (F.col(f"{found}.score") >= margin)).drop(found)
