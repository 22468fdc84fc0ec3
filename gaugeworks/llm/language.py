"""Language identification by compression.

Every language has a zstandard dictionary of raw content: slices of its labelled texts. A text is cut
into pieces, each piece is compressed on its own with every dictionary, and the language whose
dictionary gives the smallest sum is the answer. Where the runner-up comes too close the answer is not
accepted. All pieces of a text count; the cut keeps a text's own repetitions from drowning the
dictionary.

The dictionaries are fitted on a bounded sample: ``docs`` different texts a language, those with the
smallest hash, ``slice_chars`` characters of each. They have a fixed size, so they travel with the
function. Everything else is one pass over the texts without a shuffle.

Defined results: a null text and a text without a letter are ``und`` with score 0, not accepted; with
no labelled text every text is ``und``; ties go to the language first in the alphabet; copies get equal
answers; other columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.llm.registry import query
from gaugeworks.plans.bindings import table
from gaugeworks.session import prepare

UNKNOWN = "und"
#: The lead under which the query and the pipeline do not accept an answer.
MARGIN = 0.002
# Greedy matches of four bytes and more: invented or rare words still share their syllables.
_PARAMETERS = dict(
    strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=19, hash_log=16, chain_log=16, search_log=3,
    write_checksum=False, write_content_size=False, write_dict_id=False,
)


def learn(
    df: DataFrame, text: str = "text", lang: str = "lang", docs: int = 256, slice_chars: int = 1024
) -> dict[str, bytes]:
    """A raw-content dictionary for each language with labelled texts that hold a letter."""
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h")
    )
    ranks = Window.partitionBy("lang").orderBy("h")
    chosen = labelled.groupBy("lang", "h").agg(F.lit(1).alias("one"))
    chosen = chosen.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= docs).select("lang", "h")
    picked = chosen.collect()  # docs rows a language
    if not picked:
        return {}
    wanted = labelled.where(F.col("h").isin([r["h"] for r in picked]))
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - slice_chars) / 2).cast("int"))
    rows = wanted.groupBy("lang", "h").agg(F.min(F.substring("text", middle, F.lit(slice_chars))).alias("part")).collect()
    keep, out = {(r["lang"], r["h"]) for r in picked}, {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        if (r["lang"], r["h"]) in keep:
            out[r["lang"]] = out.get(r["lang"], b"") + r["part"].lower().encode("utf-8", "replace") + b" "
    return out


class Compressors:
    """One compressor a language; built in the worker."""

    def __init__(self, dictionaries: dict[str, bytes], piece: int):
        self.piece, self.langs, self.compress = piece, sorted(dictionaries), []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(**_PARAMETERS)
            content.precompute_compress(compression_params=how)
            self.compress.append(zstandard.ZstdCompressor(dict_data=content, compression_params=how).compress)

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode("utf-8", "replace")
        pieces = [raw[i : i + self.piece] for i in range(0, len(raw), self.piece)]
        return [sum(len(c(p)) for p in pieces) for c in self.compress]

    def judge(self, text: str) -> tuple[str, float]:
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        rest = min((s for i, s in enumerate(sizes) if i != best), default=None)
        return self.langs[best], 1.0 if rest is None else 1.0 - sizes[best] / rest


def identify(dictionaries: dict[str, bytes], text: Column, piece: int = 1024) -> Column:
    """Struct (lang, score) of a text column; the score is the smallest size's lead over the next, as a
    share of the next."""
    if not dictionaries:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tools = Compressors(dictionaries, piece)
        for texts in batches:
            rows = [(UNKNOWN, 0.0) if t is None else tools.judge(t) for t in texts]
            yield pd.DataFrame(rows, columns=["lang", "score"])

    return judge(F.when(text.rlike(r"\p{L}"), text))


def detect(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = 0.0) -> DataFrame:
    """Add lang_pred, score and accepted (a language is found and its lead is ``margin`` at least)."""
    prepare(df.sparkSession)
    clash = [c for c in ("lang_pred", "score", "accepted") if c in df.columns and c != text]
    found = df.drop(*clash).withColumn("__l", identify(dictionaries, F.col(text)))
    return found.select(
        "*",
        F.col("__l.lang").alias("lang_pred"),
        F.col("__l.score").alias("score"),
        ((F.col("__l.lang") != UNKNOWN) & (F.col("__l.score") >= margin)).alias("accepted"),
    ).drop("__l")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """True for the rows whose crc32 of the id as text leaves ``fold``; they are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


@query("op4_language")
def op4_language(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"))
    found = detect(docs, learn(docs.where(~held)), margin=MARGIN)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
