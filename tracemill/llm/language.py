"""Language identification by compression.

For every language a bounded sample of labelled texts becomes a raw-content
zstandard dictionary. A text is encoded once with each dictionary; the language
whose dictionary makes it smallest wins, and a narrow margin is flagged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill.llm.common import arrow_schema, map_batches

#: Bounds of the labelled sample a classifier is fitted on, for each language.
SAMPLE_DOCS = 256
SAMPLE_CHARS = 16_384
DICTIONARY_BYTES = 131_072
MAX_LANGUAGES = 512
#: zstandard level: the strategy has to search the dictionary thoroughly.
LEVEL = 6
#: A winner by fewer bytes than this share of the runner-up is flagged as rejected.
MARGIN = 0.02
#: Bytes that weigh as one e-fold of confidence.
SCALE = 4.0
UNDETERMINED = "und"


def learn_dictionaries(labelled: DataFrame, id_column: str = "doc_id") -> dict[str, bytes]:
    """Dictionary bytes by language, from columns ``id_column``, ``text`` and ``lang``.

    Rows without text or language teach nothing. Of each language the
    ``SAMPLE_DOCS`` rows with the lowest hash of their id are taken, the first
    ``SAMPLE_CHARS`` characters of each, up to ``DICTIONARY_BYTES`` in all; the
    sample that reaches the driver is bounded by these three at any scale.
    """
    known = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        "lang",
        F.pmod(F.xxhash64(F.lit("sample"), F.col(id_column).cast("string")), F.lit(1 << 40)).alias("_hash"),
        F.substring("text", 1, SAMPLE_CHARS).alias("_text"),
    )
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if not counts:
        return {}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # Below a threshold that about four times the wanted rows pass, ties of one id fold into one row.
    limits = labelled.sparkSession.createDataFrame(
        [(r["lang"], int(min(1.0, 4 * SAMPLE_DOCS / r["n"]) * (1 << 40))) for r in counts],
        "lang string, _limit long",
    )
    near = (
        known.join(F.broadcast(limits), "lang")
        .where(F.col("_hash") < F.col("_limit"))
        .groupBy("lang", "_hash")
        .agg(F.min("_text").alias("_text"))
    )
    order = Window.partitionBy("lang").orderBy("_hash")
    sample = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= SAMPLE_DOCS)
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in sample.collect():
        texts.setdefault(row["lang"], []).append((row["_rank"], row["_text"]))
    return {
        lang: "\n".join(text for _, text in sorted(rows)).encode()[:DICTIONARY_BYTES]
        for lang, rows in sorted(texts.items())
    }


def predict_language(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` to every row.

    The whole text is encoded, whatever its length. A text that is null or has
    no letter is ``und`` with score 0, and so is every text when nothing could
    be learned. Equal sizes go to the language first in order. ``rejected``
    marks a win by less than ``MARGIN`` of the runner-up's size; the best guess
    stays in ``lang_pred``. Columns of these names in the input are replaced.
    """
    added = "lang_pred string, score double, rejected boolean"
    rest = df.drop("lang_pred", "score", "rejected")
    position = rest.columns.index(text)
    names = sorted(dictionaries)
    shared = df.sparkSession.sparkContext.broadcast([dictionaries[name] for name in names])
    kinds = arrow_schema(added)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = []
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        for content in shared.value:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=parameters)
            encoders.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters))
        for batch in batches:
            found: list[str] = []
            scores: list[float] = []
            narrow: list[bool] = []
            for value in batch.column(position).to_pylist():
                if value is None or not encoders or not any(map(str.isalpha, value)):
                    found.append(UNDETERMINED)
                    scores.append(0.0)
                    narrow.append(True)
                    continue
                content = value.encode()
                sizes = [len(encoder.compress(content)) for encoder in encoders]
                best = min(sizes)
                winner = sizes.index(best)
                others = sizes[:winner] + sizes[winner + 1 :]
                second = min(others, default=math.inf)
                found.append(names[winner])
                scores.append(1.0 / (1.0 + sum(math.exp((best - size) / SCALE) for size in others)))
                narrow.append(second - best < MARGIN * second)
            arrays = [pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(narrow, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema=pa.schema([*batch.schema, *kinds]))

    return map_batches(rest, predict, StructType([*rest.schema, *StructType.fromDDL(added)]))
