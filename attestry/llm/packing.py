"""Pack documents into sequences without padding: power-of-two pieces, one document in each sequence.

A document's ids (with the end id) are cut into as many full sequences as fit,
then into the powers of two that sum to the rest, the largest first.  A piece
is a sequence: its length is a power of two, so nothing is padded and nothing
crosses documents; training draws batches from one length bucket at a time.

Cases: null and empty texts give the end id alone; a text of any length is cut
whole; rows that repeat an id are packed row by row; extra columns are ignored;
an empty table gives an empty table.  Sequence ids follow the place of a row in
its input partition, which a rerun of a lost task repeats.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.tokens import ChunkEncoder, loaded, parts, slices


@dataclass(frozen=True)
class PackParams:
    tokenizer: str
    length: int = 1024          # a power of two
    end_id: int = 0


def piece_lengths(n: int, longest: int) -> list[int]:
    """Full sequences, then the binary digits of the rest from the highest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, p: PackParams, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, the ids."""
    if p.length < 1 or p.length & (p.length - 1):
        raise ValueError("the sequence length must be a power of two")
    id_type = docs.schema["doc_id"].dataType
    end = np.array([p.end_id], dtype="<u4").tobytes()
    kind = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long".format(id_type.simpleString())
    kind += ", ids binary" if with_ids else ""

    def pieces(batches):
        encoder = loaded(ChunkEncoder, p.tokenizer)
        for batch in parts(batches):
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                row, start, length, crc, total, own = [], [], [], [], [], []
                for i, data in enumerate(map(encoder.ids, texts[a:b]), a):
                    data += end
                    at, n = 0, len(data) // 4
                    for size in piece_lengths(n, p.length):
                        part = data[4 * at:4 * (at + size)]
                        row.append(i); start.append(at); length.append(size); total.append(n)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            own.append(part)
                        at += size
                columns = [ids.take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(own, pa.binary())); names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    cut = docs.select("doc_id", "text").mapInArrow(pieces, kind)
    return cut.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    """Write pieces in one folder for each length, so that a batch holds equal lengths; big buckets get many files."""
    files = F.pmod(F.xxhash64("sequence_id"), F.lit(64))
    (pieces.repartition("length", files).write.option("maxRecordsPerFile", per_file).partitionBy("length").parquet(path))
