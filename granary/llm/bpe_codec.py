"""BPE encoding and decoding (operator 5): priority-queue merges over linked symbols; decoding concatenates vocabulary strings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.bytebpe import ByteBPE, default_path, load

#: Pre-tokens whose ids a worker remembers; the memory starts afresh when full, which changes no result.
REMEMBERED = 300_000


class Codec:
    """Encoder and decoder of one vocabulary. Ids travel as decimal strings joined by commas."""

    class _Pieces(dict):
        def __init__(self, bpe: ByteBPE):
            super().__init__()
            self.bpe = bpe

        def __missing__(self, piece: str) -> str:
            ids = ",".join(map(str, self.bpe.encode_piece(piece.encode("utf-8", "surrogatepass"))))
            if len(piece) <= 64:
                self[piece] = ids
            return ids

    def __init__(self, path: str):
        self.bpe = load(path)
        self._pieces = self._Pieces(self.bpe)
        self._strings = {str(i): b for i, b in self.bpe.token_bytes.items()}

    def encode(self, text: str) -> str:
        if len(self._pieces) > REMEMBERED:
            self._pieces.clear()
        known, parts = self._pieces.__getitem__, []
        for plain, special in self.bpe.split_special(text):
            if plain:
                parts.append(",".join(map(known, self.bpe.pieces(plain))))
            if special is not None:
                parts.append(str(special))
        return ",".join(parts)

    def decode(self, ids: str) -> str:
        if not ids:
            return ""
        return b"".join(map(self._strings.__getitem__, ids.split(","))).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True
) -> DataFrame:
    """Encode and decode every text: ``(id, n_tokens, ids_sha256, decoded_sha256, ids, decoded)``.

    One output row per input row, in no order; repeated rows repeat. Null and empty texts have no tokens and decode
    to the empty string. Other input columns are not read, so their names cannot clash. ``with_ids=False`` leaves
    out ``ids`` (array<int>) and ``decoded``. A map over rows: no shuffle, memory bounded by one batch and the
    remembered pre-tokens.
    """
    path = path or default_path()
    fields = [
        docs.schema[id_col],
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = _codec(path)
        digest = hashlib.sha256
        for batch in batches:
            n, ids_hash, text_hash, all_ids, texts = [], [], [], [], []
            for value in batch.column(1):
                ids = codec.encode(value.as_py() or "")
                decoded = codec.decode(ids)
                n.append(ids.count(",") + 1 if ids else 0)
                ids_hash.append(digest(ids.encode()).hexdigest())
                text_hash.append(digest(decoded.encode("utf-8")).hexdigest())
                if with_ids:
                    all_ids.append([int(i) for i in ids.split(",")] if ids else [])
                    texts.append(decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, T.StructType(fields))
