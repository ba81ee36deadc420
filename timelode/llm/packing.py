"""Best-fit packing of tokenised documents into sequences of at most 2048 tokens.

Bounded-space online best fit: a packer keeps at most ``OPEN`` bins open, in
stacks keyed by free space, and a bitset of the free spaces in use. A piece goes
to the open bin with the least free space that still takes it (the lowest set
bit from the piece's length on). When too many bins are open, the fullest closes
(the lowest set bit of all). No bin is capped otherwise: every piece is packed.

Pieces are dealt by a hash of their row to packers of about ``GROUP`` pieces,
whatever the input's size and however many pieces share an id, and come longest
first. A packer's unfilled bins are all that a cut into packers costs.

Token ids come from one pass over the texts; only lengths and checksums are
kept, so the pack shuffles no text.

Defined results: a null or empty text is its end token alone; an added token of
the vocabulary that stands in a text is that token; texts of any length are
tokenised whole and only cut into pieces; of open bins with equal free space the
last one filled is taken; repeated rows are packed one by one; null ids take part, and
ids of any size come out as they went in; an empty table gives an empty result;
only doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelode.operators.memory import give_back, slices

from .common import stored

LENGTH, OPEN, GROUP = 2048, 4096, 50_000
END_TOKEN = 0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizers file (none without a file), which its
    ``encode`` finds inside texts as they stand."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        found = json.load(file).get("added_tokens") or []
    for token in found:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"{path}: {token['content']} isn't matched as it stands")
    return {token["content"]: token["id"] for token in found}


class Encoder:
    """Byte-level BPE from a file of ranks and the added tokens of the json beside
    it (without ``added``, their strings are plain text); a text that its matcher
    gives up on (a very long run of white space, say) goes to the tokenizers library."""

    def __init__(self, ranks_path: str, added: bool = True) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._other, self._other_path, self._added = None, ranks_path.rsplit(".", 1)[0] + ".json", added
        self.bytes = {i: token for token, i in ranks.items()}
        self._main = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(self._other_path) if added else {})

    def ids(self, text: str) -> np.ndarray:
        try:
            return self._main.encode_to_numpy(text, allowed_special="all")
        except BaseException as error:
            # the matcher's failure is a panic: of a class that is no Exception and can't be imported
            if type(error).__name__ != "PanicException" and not isinstance(error, ValueError):
                raise
            if self._other is None:
                from tokenizers import Tokenizer

                self._other = Tokenizer.from_file(self._other_path)
                self._other.encode_special_tokens = not self._added
            return np.array(self._other.encode(text, add_special_tokens=False).ids, np.uint32)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """A row for each piece, with its token ids if wanted. A document of more than
    ``length`` tokens is cut into pieces of that length; the first one takes what remains."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            row, piece, start, size, crc, own = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encoder.ids(text or ""), END_TOKEN).astype("<u4")
                edges = [0, *range(len(ids) % length or length, len(ids) + 1, length)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        own.append(ids[a:b].astype(np.int32))
            # the ids of documents stay in Arrow: none is changed on the way
            arrays = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
            arrays += [pa.array(own, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            del batch, arrays
        del encoder
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


class Packer:
    """Open bins by free space; ``used`` has bit f set if a bin with f free is open."""

    def __init__(self, length: int = LENGTH, most_open: int = OPEN) -> None:
        self.length, self.most_open, self.made, self.open, self.used = length, most_open, 0, 0, 0
        self.stacks: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        bin_ = stack.pop()
        if not stack:
            self.used ^= 1 << free
        self.open -= 1
        return bin_

    def add(self, size: int) -> tuple[int, int]:
        """The bin and the place in it of a piece of ``size``."""
        fits = self.used >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.length, self.made
            self.made += 1
        left = free - size
        if left:
            if self.open == self.most_open:
                self._take((self.used & -self.used).bit_length() - 1)
            if not self.stacks[left]:
                self.used |= 1 << left
            self.stacks[left].append(bin_)
            self.open += 1
        return bin_, self.length - free


def pack(parts: DataFrame, length: int = LENGTH, most_open: int = OPEN, group: int = GROUP) -> DataFrame:
    """pieces -> the same rows with sequence_id and offset."""
    names = parts.columns
    parts = stored(parts.withColumn("packed_row_", F.monotonically_increasing_id()), "pack-pieces")
    packers = max(1, -(-parts.count() // group))
    dealt = parts.withColumn("packer_", F.pmod(F.xxhash64("packed_row_"), F.lit(packers)).cast("long"))
    schema = T.StructType([parts.schema[n] for n in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("packed_row_", "ascending")])
        packer = Packer(length, most_open)
        places = np.array([packer.add(n) for n in rows["length"].to_pylist()], np.int64).reshape(-1, 2)
        found = [pa.array(places[:, 0] + (key[0].as_py() << 32)), pa.array(np.ascontiguousarray(places[:, 1]))]
        return pa.table([*(rows[n] for n in names), *found], names=[*names, "sequence_id", "offset"])

    return dealt.groupBy("packer_").applyInArrow(run, schema)


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """The sequences themselves: sequence_id, ids, doc_ids and starts of their pieces.
    Equal pieces (of repeated rows) share their ids, so each place finds them."""
    key = ["doc_id", "piece", "length", "ids_crc32"]
    tokens = pieces(docs, vocabulary, length, with_ids=True).dropDuplicates(key).select(*[F.col(k).alias(f"{k}_") for k in key], "ids")
    on = [packed[k].eqNullSafe(tokens[f"{k}_"]) for k in key]
    placed = packed.join(tokens, on[0] & on[1] & on[2] & on[3])
    whole = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return whole.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))
