"""Encoding and decoding whole texts with the speculating byte-level encoder."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .scan import grouped, id_and_text, over_texts
from .tokens import ByteEncoder


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int): the exact ids of each whole text.  Null and empty texts have no ids; repeated
    rows and null ids stay; an empty table gives no rows."""

    def make(texts: list[bytes]) -> dict:
        encoder = ByteEncoder.get(path)
        return {"ids": pa.array([encoder.encode(t) for g in grouped(texts) for t in g], pa.list_(pa.int32()))}

    return over_texts(id_and_text(docs, id_col, text_col), make, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; bytes that aren't UTF-8 become the replacement character."""

    def run(batches):
        encoder = ByteEncoder.get(path)
        for batch in batches:
            texts = [encoder.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each whole text, encoded and decoded in one pass.

    The digests are of the decimal ids joined by commas, and of the decoded text.  They are fed from the cached
    result of each pre-token, so no list of ids is built.  Edge cases as in :func:`encode_texts`.
    """

    def make(texts: list[bytes]) -> dict:
        encoder = ByteEncoder.get(path)
        counts, ids, decoded = [], [], []
        for group in grouped(texts):
            split = [encoder.split(t) for t in group]
            if any(w not in encoder.ids for words in split for w in words):
                encoder.ready(set().union(*split))
            for words in split:
                line = ",".join(map(encoder.shown.__getitem__, words))
                counts.append(line.count(",") + 1 if line else 0)
                ids.append(hashlib.sha256(line.encode()).hexdigest())
                raw = b"".join(map(encoder.bytes_of.__getitem__, words)).decode("utf-8", "replace")
                decoded.append(hashlib.sha256(raw.encode()).hexdigest())
        return {
            "n_tokens": pa.array(counts, pa.int64()),
            "ids_sha256": pa.array(ids, pa.string()),
            "decoded_sha256": pa.array(decoded, pa.string()),
        }

    return over_texts(
        id_and_text(docs, id_col, text_col),
        make,
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
