"""SentencePiece encoding and decoding by a distinct-chunk table.

Where no piece of the model crosses from other characters into a whitespace marker,
a text's segmentation is the concatenation of the segmentations of its marked words
(markers followed by a word). Each task keeps a table of the distinct marked words it has
met; a word is segmented and decoded by the library once, and the stored ids are
joined back by position. The table is bounded (``TABLE_ENTRIES``): full, it starts anew,
which costs time and changes nothing in the result.

No shuffle: a global table of distinct words would send every word of the corpus across
the network to save a dictionary lookup.

Edge cases: null text is empty text (no ids, empty decoded text). U+2581 in a text is the
marker itself, as for the library. Lone surrogates can't occur in Spark strings. Equal
texts give equal results; an empty table gives an empty table; extra columns are kept
unless their names clash with the result's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from dayloom.llm.common import lean, small_batches

MARK = "▁"
TABLE_ENTRIES = 200_000
LONG_WORD = 256  # characters; longer words are segmented each time, not kept
WORD = re.compile(" *[^ ]+| +")


def pieces_cross_marks(processor) -> bool:
    """Whether any piece has a marker after another character."""
    return any(re.search(f"[^{MARK}]{MARK}", processor.id_to_piece(i)) for i in range(processor.get_piece_size()))


class ChunkTable(dict):
    """Marked word -> (ids as text, decoded text). A key is the word without its first marker, as the
    library puts that one itself."""

    def __init__(self, processor, entries: int = TABLE_ENTRIES):
        super().__init__()
        self.processor, self.entries = processor, entries
        probe = processor.encode("a", out_type=str)
        if not probe or not probe[0].startswith(MARK) or pieces_cross_marks(processor):
            raise ValueError("the model joins pieces across whitespace markers, or puts no marker before a text")
        self.mark_id = processor.piece_to_id(MARK)

    def __missing__(self, word: str):
        ids = self.processor.encode(word) if word else [self.mark_id]
        # the library drops the first marker in decoding; behind another word it stays
        text = self.processor.decode(ids) if word else ""
        value = (",".join(map(str, ids)), word if text == word else text)
        if len(word) <= LONG_WORD:
            if len(self) >= self.entries:
                self.clear()
            self[word] = value
        return value


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first marker."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and not text.startswith(" ") and not text.endswith(" "):
        return text.split(" ") if text else []
    return [w[1:] for w in WORD.findall(" " + text)]


def joined_text(parts: list[tuple]) -> str:
    return ",".join([p[0] for p in parts])


def joined_ids(parts: list[tuple]) -> np.ndarray:
    return np.fromstring(joined_text(parts), np.int32, sep=",") if parts else np.empty(0, np.int32)


def decode_joined(parts: list[tuple]) -> str:
    return " ".join([p[1] for p in parts])


def encode_documents(df: DataFrame, model_file: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 (and, asked for, ids and decoded)."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    keep = [f for f in df.schema.fields if f.name not in names]
    where = [f.name for f in keep].index(text)
    schema = T.StructType([*keep, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
                           *([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if with_ids else [])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        table = ChunkTable(sentencepiece.SentencePieceProcessor(model_file=model_file))
        look = table.__getitem__
        for b in small_batches(batches):
            count, shas, texts, all_ids, decoded = [], [], [], [], []
            for t in b.column(where).to_pylist():
                parts = [look(w) for w in marked_words(t or "")]
                said = joined_text(parts)
                back = decode_joined(parts)
                count.append(said.count(",") + 1 if said else 0)
                shas.append(hashlib.sha256(said.encode()).hexdigest())
                texts.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                if with_ids:
                    all_ids.append(np.fromstring(said, np.int32, sep=",") if said else np.empty(0, np.int32))
                    decoded.append(back)
            more = [pa.array(count, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([len(i) for i in all_ids])]).astype(np.int32)
                more += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(all_ids) if all_ids else np.empty(0, np.int32))), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[f.name for f in schema.fields])

    return df.select(*[f.name for f in keep]).mapInArrow(lean(run), schema)


def default_model_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, default_model_file()).drop("text")
