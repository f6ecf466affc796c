"""Byte-level BPE encoding and decoding over globally distinct pre-tokens.

The tokenizer's pattern divides texts into pre-tokens, which are exploded with their positions inside blocks of documents (see
blocks.py). Each distinct pre-token of the whole table is encoded once, in the task that its hash names. The ids go back
to the blocks and are put together by position. Decoding joins ids with the token-byte table, which has a row for each of the
tokenizer's ids (about 50,000) and so goes to every task.

A pre-token alone is a single match of the pattern, so that tiktoken encodes it as it does where it stands in a text.

Cases: a null text counts as empty; an empty text has no ids; a very long text is taken whole, as a block of its own; repeated rows give
repeated results; other columns are kept, unless an added column has their name; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.blocks import lookup_words, open_block, pack


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file. It is a tool's file on the driver, and has a line for each token."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Encodings that a Python worker has made, by the digest of their ranks: one serves all tasks and queries.
_encodings: dict[str, tiktoken.Encoding] = {}


def merger(ranks: dict[bytes, int], pattern: str, name: str = "") -> tiktoken.Encoding:
    """The encoding of these ranks; kept under a name, if one is given."""
    if name not in _encodings:
        made = tiktoken.Encoding("pretokens", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        if not name:
            return made
        _encodings.clear()
        _encodings[name] = made
    return _encodings[name]


def _name(ranks: dict[bytes, int], pattern: str) -> str:
    d = hashlib.sha256(pattern.encode())
    for t, i in ranks.items():
        d.update(b"%d %d " % (i, len(t)) + t)
    return d.hexdigest()


def encoded_blocks(df: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str], text: str, finish, schema) -> DataFrame:
    """What finish makes of each block and its answers: the ids of each pre-token of the block as uint16 or uint32 bytes."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # a row for each token of the tokenizer
    name, kind = _name(ranks, pattern), _wide(ranks)

    def answer(words, _):
        encode = (_encodings.get(name) or merger(shared.value, pattern, name)).encode_ordinary
        return [np.array(encode(w), kind).tobytes() for w in words]

    return lookup_words(pack(df, text, keep, lambda t: regex.findall(pattern, t)), lambda payload: None, answer, finish=finish, schema=schema)


def _wide(ranks) -> type:
    return np.uint16 if max(ranks.values(), default=0) < 65536 else np.uint32


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The other columns and ids (array of int) of every row."""
    return _per_row(df, ranks, pattern, text, lambda body, places: pa.array([np.frombuffer(b"".join([body[i] for i in p]), _wide(ranks)).astype(np.int32) for p in places], pa.list_(pa.int32())), ids, T.ArrayType(T.IntegerType()), lambda words: words)


def digests(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """The other columns, n_tokens, ids_sha256 (of the decimal ids joined by a space) and decoded_sha256 (of the bytes that the ids stand for)."""
    wide = _wide(ranks)
    table = df.sparkSession.sparkContext.broadcast([t for t, _ in sorted(ranks.items(), key=lambda x: x[1])] if sorted(ranks.values()) == list(range(len(ranks))) else {i: t for t, i in ranks.items()})

    def words(body):
        tokens, out = table.value, []
        for b in body:
            own = np.frombuffer(b, wide).tolist()
            out.append((len(own), " ".join(map(str, own)).encode(), b"".join([tokens[i] for i in own])))
        return out

    def rows(body, places):
        n, a, b = [], [], []
        counts, decimal, decoded = zip(*body) if body else ((), (), ())
        for p in places:
            n.append(sum(map(counts.__getitem__, p)))
            a.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, p))).hexdigest())
            b.append(hashlib.sha256(b"".join(map(decoded.__getitem__, p))).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    out = _per_row(df, ranks, pattern, text, rows, "__d", T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]), words)
    added = ("n_tokens", "ids_sha256", "decoded_sha256")
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c not in ("__d", *added)], *[F.col(f"__d.{a}").alias(a) for a in added])


def _per_row(df: DataFrame, ranks, pattern: str, text: str, rows, to: str, kind, words) -> DataFrame:
    keep = [c for c in df.columns if c not in (text, to)]
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField(to, kind)])
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in fields]

    def unpack(payload: bytes, answers: list[bytes]) -> pa.Table:
        columns, _, places, lens = open_block(payload)
        body = words(answers)
        cuts = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))
        many, out = 2000, []
        for a in range(0, len(lens), many):
            own = [places[cuts[i] : cuts[i + 1]].tolist() for i in range(a, min(a + many, len(lens)))]
            out.append(pa.RecordBatch.from_arrays([*[pa.array(c[a : a + many], t) for c, t in zip(columns, types)], rows(body, own)], [*[f.name for f in fields], to]))
        return pa.Table.from_batches(out)

    return encoded_blocks(df, ranks, pattern, keep, text, unpack, schema)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the bytes that ids stand for (null ids: null). Each id is looked up in the token-byte table."""
    table = df.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})

    @F.arrow_udf("binary")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else b"".join([table.value[i] for i in x]) for x in column.to_pylist()], pa.binary())

    return df.withColumn(decoded, of(F.col(ids)))


def token_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """The token-byte table: id, token."""
    return spark.createDataFrame([(i, bytearray(t)) for t, i in ranks.items()], "id int, token binary")
