"""Byte-level BPE encoding and decoding by a sentencepiece model that is serialised straight from a rank file.

Each token becomes a piece: its bytes are mapped to printable characters (so that sentencepiece can't tell them from
text) and its score is its negative rank, which makes sentencepiece merge the lowest rank first. Normalisation is the
identity. Pre-tokens are encoded one by one; ids are decoded by the inverse mapping of their pieces.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded alike; an empty table
gives an empty result; further columns are ignored. A vocabulary of more than 65,536 tokens is an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder, packed


def byte_characters() -> str:
    """A printable character for each byte 0 to 255: itself where it is one, else the next unused from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in own else chr(next(free)) for b in range(256))


def serialised_model(rank_file: bytes) -> bytes:
    """A sentencepiece BPE model from the lines "base64 rank" of a rank file; the unknown piece comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    characters = byte_characters()
    ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, rank_file.splitlines())}
    model = pb.ModelProto()
    for rank in range(len(ranks)):
        model.pieces.add(piece="".join(characters[b] for b in ranks[rank]), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(ranks)
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes texts and decodes ids with a model of ``serialised_model``."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        if self.model.get_piece_size() - 1 > 1 << 16:
            raise ValueError("ids are kept as 16-bit numbers: the vocabulary may have 65,536 tokens at most")
        characters = byte_characters()
        self.to_characters = {b: c for b, c in enumerate(characters)}
        to_byte = {c: b for b, c in enumerate(characters)}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size() - 1)]
        self.token_bytes = [bytes(to_byte[c] for c in piece) for piece in pieces]
        self.whole = {piece: i for i, piece in enumerate(pieces)}
        self.pre_tokens = regex.compile(pattern).findall
        self.chunks = ChunkEncoder(self._encode_many)
        self.decimal = list(map(str, range(len(pieces))))

    def _encode_many(self, texts: list[str]) -> list[bytes]:
        split = [[p.encode().decode("latin-1").translate(self.to_characters) for p in self.pre_tokens(t)] for t in texts]
        # A pre-token that is a token itself is taken as it is.
        todo = [p for pre in split for p in pre if p not in self.whole]
        encoded = iter(self.model.encode(todo, num_threads=1) if todo else ())
        return [packed([i for p in pre for i in ([self.whole[p]] if p in self.whole else next(encoded))]) for pre in split]

    def encode(self, text: str) -> list[int]:
        return self.chunks.encode(text).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, the SHA-256 of its decimal ids and of its decoded bytes, and with ``keep_ids`` the ids and the decoded text.

    A map over the scan: nothing is shuffled, and memory holds one batch and the worker's bounded cache.
    """
    with open(rank_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(serialised_model(file.read()))  # some 1 MB: one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
                for found in codec.chunks.encode_batch([text or "" for text in part.column(1).to_pylist()]):
                    ids = found.tolist()
                    back = codec.decode(ids)
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(sha(" ".join(map(codec.decimal.__getitem__, ids)).encode()))
                    out["decoded_sha256"].append(sha(back))
                    if keep_ids:
                        out["ids"].append(ids)
                        out["decoded"].append(back.decode())
                columns = [part.column(0), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["decoded"], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)
