"""Token ids of every text under a public byte-level vocabulary, through a table of distinct words.

1. Spark's tasks split each batch of texts into words: a run of non-space with the one blank before it, or a run of white
   space. The vocabulary's own pieces never cross these borders, so a text's ids are its words' ids in order.
2. Documents are packed into blocks of a few MB; a block holds its distinct words once and, per document, each word's
   place among them. Blocks are written to the shared folder.
3. The blocks' words are shuffled by word and sorted, so that all places of a word meet and it is encoded once. The places
   of a word that lies in more blocks than a partition should hold are split, and it is encoded once in each part.
4. Ids go back to the blocks by position and are laid out into the documents' lists.

Scale: what is shuffled by word is a block's distinct words, not its occurrences, so even the commonest word moves once
per block; partitions follow from the number of blocks, and Spark splits those that hot words fill (REBALANCE). Nothing is
broadcast but the name of the vocabulary, and no vocabulary of words is ever held in one place. A document is never cut: a
text longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyloom.llm import vocab
from tallyloom.llm.words import split_batch
from tallyloom.session import ship, write_shared

#: Occurrences of words in a block, before its last document.
BLOCK_WORDS = 1_000_000
#: Blocks whose words, or ids, a task takes: some 50 MB.
BLOCKS_A_TASK = 8
#: Ids decoded at a time, before a text's last.
DECODED_IDS = 10_000_000


def _lists(lens: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), values)


def word_blocks(df: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """block, ids, lens, codes, words: per block the documents' ids and numbers of words, each word's place in words."""
    kind = df.schema[id_col].dataType
    arrow_id = to_arrow_type(kind)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for b in batches:
            lens, words = split_batch(b.column(1))
            ends, at = np.cumsum(lens), 0
            while at < len(lens):
                before = ends[at] - lens[at]
                to = max(at + 1, int(np.searchsorted(ends, before + block_words, side="right")))
                d = words.slice(before, ends[to - 1] - before).dictionary_encode()
                codes = d.indices.cast(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), b.column(0).slice(at, to - at).cast(arrow_id)),
                        pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), pa.array(lens[at:to].astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), codes),
                        pa.ListArray.from_arrays(pa.array([0, len(d.dictionary)], pa.int32()), d.dictionary.cast(pa.string())),
                    ],
                    names=["block", "ids", "lens", "codes", "words"],
                )
                block += 1
                at = to

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(task, f"block bigint, ids array<{kind.simpleString()}>, lens array<int>, codes array<int>, words array<string>")


def encode_words(enc, sizes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of ids of each word, and all ids end to end.

    The words are encoded in one call, a line feed between them: the vocabulary's pieces begin and end there, so the ids
    are those of each word alone, and are told apart by their pieces' sizes. White-space words would run together with
    the line feeds and are encoded one by one; so are all, should a border not fall between two ids.
    """
    texts = words.to_pylist()
    plain = [i for i, t in enumerate(texts) if not t.isspace()]
    n, lists = np.zeros(len(texts), np.int64), {}
    for i in set(range(len(texts))).difference(plain):
        lists[i] = enc.encode_ordinary(texts[i])
    ids = np.asarray(enc.encode_ordinary("\n".join([texts[i] for i in plain]) + "\n"), np.int32) if plain else np.array([], np.int32)
    at = np.cumsum(sizes[ids])
    length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[plain]
    border = np.cumsum(length + 1)
    to = np.searchsorted(at, border)  # the id that ends with the line feed after each word
    if plain and not (at[to] == border).all() or (sizes[ids[to]] != 1).any():
        lists = {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}
        plain, ids, to = [], np.array([], np.int32), np.array([], np.int64)
    n[plain] = np.diff(np.concatenate([[-1], to])) - 1
    if not lists:
        keep = np.ones(len(ids), bool)
        keep[to] = False
        return n, ids[keep]
    start = np.zeros(len(texts), np.int64)
    start[plain] = to - n[plain]
    extra, base = [], len(ids)
    for i, x in lists.items():
        n[i], start[i] = len(x), base
        extra += x
        base += len(x)
    pool = np.concatenate([ids, np.asarray(extra, np.int32)])
    ends = np.cumsum(n)
    return n, pool[np.repeat(start - (ends - n), n) + np.arange(ends[-1])]


def encoded_words(blocks: DataFrame, name: str, path: str | None, counts_only: bool, partitions: int) -> DataFrame:
    """block, places, lens, ids: for places among a block's words the numbers of their ids and the ids themselves (none
    if counts_only). A distinct word is encoded once per partition its places fill: once, but for the hottest."""
    apart = blocks.select("block", F.posexplode("words").alias("place", "word")).select(F.xxhash64("word").alias("h"), "word", "block", "place")
    near = apart.hint("rebalance", partitions, "h").sortWithinPartitions("h").select("word", "block", "place")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = vocab.encoder(name, path), vocab.piece_sizes(name, path)
        for b in batches:
            d = b.column(0).dictionary_encode()
            n, known = encode_words(enc, sizes, d.dictionary)
            codes, block = d.indices.to_numpy(), b.column(1).to_numpy()
            order = np.argsort(block, kind="stable")
            codes, block, place = codes[order], block[order], b.column(2).to_numpy()[order]
            at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            lens = n[codes]
            if counts_only:
                flat, per = np.array([], np.int32), np.zeros(len(at), np.int64)
            else:
                flat = _gather(known, n, codes)
                per = np.add.reduceat(lens, at)
            rows = np.diff(np.append(at, len(block)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[at]), _lists(rows, pa.array(place)), _lists(rows, pa.array(lens.astype(np.int32))), _lists(per, pa.array(flat))],
                names=["block", "places", "lens", "ids"],
            )

    return near.mapInArrow(task, "block bigint, places array<int>, lens array<int>, ids array<int>")


def _gather(flat: np.ndarray, n: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The lists numbered codes, laid end to end; flat holds all lists one after the other and n their lengths."""
    start, lens = np.concatenate([[0], np.cumsum(n)])[:-1][codes], n[codes]
    ends = np.cumsum(lens)
    return flat[np.repeat(start - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]


def _tables(block: pa.Table, found: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents' ids and numbers of words, codes, and the number of ids by place with the ids in order of place."""
    one = lambda t, c: t.column(c).combine_chunks().flatten()
    place, n, flat = (one(found, c).to_numpy(zero_copy_only=False) for c in ("places", "lens", "ids"))
    order = np.argsort(place, kind="stable")
    if len(flat):
        flat = _gather(flat, n.astype(np.int64), order)
    return one(block, "ids"), one(block, "lens").to_numpy().astype(np.int64), one(block, "codes").to_numpy(), n[order].astype(np.int64), flat


def _by_document(lens: np.ndarray, per_word: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(per_word)])
    at = np.concatenate([[0], np.cumsum(lens)])
    return ends[at[1:]] - ends[at[:-1]]


def _encode(df: DataFrame, id_col: str, text_col: str, name: str, path: str | None, counts_only: bool) -> DataFrame:
    ship(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    blocks = write_shared(word_blocks(df, id_col, text_col), "blocks")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks.count() // BLOCKS_A_TASK))
    found = encoded_words(blocks, name, path, counts_only, parts).repartition(parts, "block")
    docs = blocks.select("block", "ids", "lens", "codes").repartition(parts, "block")

    def ids_task(block: pa.Table, words: pa.Table) -> pa.Table:
        doc, lens, codes, n, flat = _tables(block, words)
        out = _gather(flat, n, codes) if len(codes) else np.array([], np.int32)
        return pa.table({"id": doc, "ids": _lists(_by_document(lens, n[codes]), pa.array(out.astype(np.int32)))})

    def count_task(block: pa.Table, words: pa.Table) -> pa.Table:
        doc, lens, codes, n, _ = _tables(block, words)
        return pa.table({"id": doc, "n_tokens": pa.array(_by_document(lens, n[codes]))})

    both = docs.groupBy("block").cogroup(found.groupBy("block"))
    if counts_only:
        return both.applyInArrow(count_task, f"id {id_type}, n_tokens bigint").withColumnRenamed("id", id_col)
    return both.applyInArrow(ids_task, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def encode_corpus(df: DataFrame, id_col: str, text_col: str, name: str = vocab.DEFAULT, path: str | None = None) -> DataFrame:
    """id_col, ids: one row per row of df, with the list of token ids of its text, without special tokens.

    NULL and empty texts have the empty list. Names of special tokens inside a text are ordinary text. Repeated rows and
    equal or NULL ids keep a row each; other columns are dropped. Texts of any length are encoded whole.
    """
    return _encode(df, id_col, text_col, name, path, False)


def count_tokens(df: DataFrame, id_col: str, text_col: str, name: str = vocab.DEFAULT, path: str | None = None) -> DataFrame:
    """id_col, n_tokens: the lengths of encode_corpus()'s lists, without building them."""
    return _encode(df, id_col, text_col, name, path, True)


def decode_corpus(df: DataFrame, id_col: str, ids_col: str, name: str = vocab.DEFAULT, path: str | None = None) -> DataFrame:
    """id_col, text: the text of every id list, one row per row of df.

    The join of ids to pieces is made inside the tasks, where each holds the vocabulary (some 50,000 short pieces) and takes
    a batch's pieces by id: positions are kept, nothing is shuffled, and a list of any length stays one row. NULL and empty
    lists give the empty text; ids that are NULL or not in the vocabulary add nothing; bytes that are no UTF-8 become
    replacement characters. Repeated rows and equal or NULL ids keep a row each; other columns are dropped.
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType
    arrow_id = to_arrow_type(kind)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocab.pieces(name, path)
        for b in batches:
            lists, at = b.column(1).cast(pa.list_(pa.int64())), 0
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lens)
            while at < len(lens):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] - lens[at] + DECODED_IDS, side="right")))
                ids = lists.slice(at, to - at).flatten()
                known = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(pieces) - 1)).fill_null(False)
                found = pieces.take(pc.if_else(known, ids, len(pieces) - 1))
                borders = np.frombuffer(found.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
                texts = borders[np.concatenate([[0], np.cumsum(lens[at:to])])]
                data = found.buffers()[2] or pa.py_buffer(b"")
                out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(texts.astype(np.int64)), data])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at).cast(arrow_id), out.cast(pa.binary())], names=["id", "bytes"])
                at = to

    back = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(task, f"id {kind.simpleString()}, bytes binary")
    return back.select(F.col("id").alias(id_col), F.make_valid_utf8(F.col("bytes").cast("string")).alias("text"))
