"""BPE encoding and decoding over a table of distinct words.

A task cuts its documents into blocks of about ``BLOCK_BYTES`` of text, parsed in
slices of ``SLICE_BYTES``. A block is its own small dictionary: the distinct words
and, for every document, the numbers of its words in order. The blocks are
written once to the shared folder; all that follows reads them, so no text is
parsed twice, and a block keeps its words whatever task is run again. Spark explodes the dictionaries to (word,
block, number) rows and sorts them by a hash of the word; each distinct word is encoded once,
and its ids go back to the blocks, where the numbers, position by position,
become ids. So a word crosses the shuffle once per block, never once per
occurrence, and no word has more rows than there are blocks.

Cutting at white space is exact for a tokenizer whose pre-tokenizer drops
white space; ``Vocabulary`` checks that. A word of letters and closing
punctuation is cut once more between the two, and A-Z become a-z if the
tokenizer lower-cases, because its own rules do the same.

Decoding looks every id up in the id-to-piece table, whose size is fixed by
the vocabulary: it goes to the Python tasks and is read by position, a slice of
documents at once. Pieces are joined by a blank, as the library does without decoder.

Null and empty texts have no ids and decode to an empty text. Null ids and
repeated rows are kept as rows. A text longer than a slice is a slice of its
own, and must fit its task some times over. An empty table gives an empty table.
Other columns of the input, also ones named like a result, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shelfwise.llm import common

BLOCK_BYTES = 16 << 20
SLICE_BYTES = 2 << 20
# Entries of the sorted word table that a task encodes and packs at once.
PACK_ROWS = 200_000
LIBRARY_ROWS = 10_000
# Letters that every Unicode version knows, then closing punctuation. Without U+0130,
# whose lower case ends in a mark that the tokenizer joins to the punctuation.
CLOSED = "^(?P<word>[a-zA-ZÀ-ÖØ-öø-įı-ɏ]+)(?P<mark>[.,!?;:#*$%&]+)$"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Vocabulary:
    """The tokenizer file as its text, so that executors need no path."""

    def __init__(self, path: str | None = None):
        with open(path or default_tokenizer(), encoding="utf-8") as f:
            self.text = f.read()
        spec = json.loads(self.text)
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        if "Lowercase" not in steps or split.get("behavior") != "Removed" or not split.get("invert"):
            raise ValueError("only tokenizers that lower-case and drop white space can be cut into words")
        vocab = {i: p for p, i in spec["model"]["vocab"].items()}
        vocab.update({t["id"]: t["content"] for t in spec["added_tokens"]})
        self.pieces = [vocab.get(i) for i in range(max(vocab) + 1)]


@lru_cache(maxsize=2)
def _tokenizer(text: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(text)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=2)
def _accented(text: str) -> dict[int, str]:
    """Letters of Latin-1 that the normaliser takes to one letter, and what the pre-tokenizer hands on for each."""
    tok, out = _tokenizer(text), {}
    for c in map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]):
        small = tok.normalizer.normalize_str(c)
        handed = tok.pre_tokenizer.pre_tokenize_str(small)
        if len(small) == len(handed) == 1:
            out[ord(c)] = handed[0][0]
    return out


def encode_words(text: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, number of ids of each) by the library."""
    tok, accented = _tokenizer(text), _accented(text)
    plain = pc.match_substring_regex(words, f"^[a-z{''.join(map(chr, accented))}]+$").to_numpy(zero_copy_only=False)
    found: list = [None] * len(words)
    # A word of these letters stays whole, and each is normalised alone: then the model decides.
    model = tok.model.tokenize
    for i, w in zip(np.flatnonzero(plain).tolist(), words.filter(pa.array(plain)).to_pylist()):
        found[i] = [t.id for t in model(w if w.isascii() else w.translate(accented))]
    rest = np.flatnonzero(~plain)
    for a in range(0, len(rest), LIBRARY_ROWS):  # the library's results are large objects
        at = rest[a:a + LIBRARY_ROWS]
        for i, e in zip(at.tolist(), tok.encode_batch_fast(words.take(pa.array(at)).to_pylist(), add_special_tokens=False)):
            found[i] = e.ids
    lens = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter(chain.from_iterable(found), np.int32, int(lens.sum()))
    return flat, lens


def _chunks(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct chunks between white space, their codes in order, offsets of the rows)."""
    flat, offsets = common.flat_words(pc.fill_null(batch.column("text"), ""))
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), offsets


def _cut(slices: list[tuple]) -> tuple[pa.Array, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """One dictionary for the slices of a block, words by falling frequency; and for each
    slice the codes of its words and the number of words of each row."""
    coded = pa.concat_arrays([c for c, _, _ in slices]).dictionary_encode()
    chunks, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    edges = np.cumsum([0, *(len(c) for c, _, _ in slices)])
    own = [number[a:b] for a, b in zip(edges, edges[1:])]
    often = np.zeros(len(chunks), np.int64)
    for to, (_, codes, _) in zip(own, slices):
        often[to] += np.bincount(codes, minlength=len(to))
    chunks = pc.if_else(pc.match_substring(chunks, "<|"), chunks, pc.ascii_lower(chunks))
    cut = pc.extract_regex(chunks, CLOSED)
    closed = pc.is_valid(cut).to_numpy(zero_copy_only=False)
    head = pc.if_else(pc.is_valid(cut), cut.field("word"), chunks)
    pieces = pa.concat_arrays([head, cut.field("mark").filter(pa.array(closed))]).dictionary_encode()
    piece = pieces.indices.to_numpy(zero_copy_only=False)
    held = np.bincount(piece, np.concatenate([often, often[closed]]), len(pieces.dictionary))
    order = np.argsort(-held, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    first, mark = rank[piece[:len(chunks)]], np.zeros(len(chunks), np.uint32)
    mark[closed] = rank[piece[len(chunks):]]

    def worded(to: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        two = closed[to][codes]
        before = np.concatenate([[0], np.cumsum(two)])  # marks before each chunk
        at = np.arange(len(codes)) + before[:-1]
        out = np.empty(len(codes) + before[-1], np.uint32)
        out[at] = first[to][codes]
        out[at[two] + 1] = mark[to][codes[two]]
        return out, np.diff(offsets + before[offsets])

    return pieces.dictionary.take(pa.array(order)).cast(pa.string()), (worded(to, *s[1:]) for to, s in zip(own, slices))


def _block(batch: pa.RecordBatch) -> tuple[int, pa.Array, np.ndarray, np.ndarray]:
    """A block of one slice: (rows, distinct words by falling frequency, codes of all words, words of each row)."""
    words, cut = _cut([_chunks(batch)])
    return batch.num_rows, words, *next(cut)


# Two rows a block: its words, and its documents.
_BLOCKS = ("kind string, block bigint, doc_ids array<array<bigint>>, counts array<array<bigint>>, codes array<binary>, "
           "n_words bigint, words array<string>")


def pack(a: np.ndarray) -> bytes:
    """Numbers as zstandard over byte planes: the planes of small numbers vanish."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack(b: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    # Partition and count name a block: the table of blocks holds one attempt of each task.
    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def flush() -> pa.RecordBatch:
        words, cut = _cut([s for _, s in held])
        codes, counts = zip(*((pack(c), n.tolist()) for c, n in cut))
        columns = (["brief", "lasting"], [number, number], [None, [d for d, _ in held]], [None, list(counts)],
                   [None, list(codes)], [len(words), len(words)])
        lists = pa.list_(pa.list_(pa.int64()))
        kinds = pa.string(), pa.int64(), lists, lists, pa.list_(pa.binary()), pa.int64()
        words = pa.ListArray.from_arrays(pa.array([0, len(words), len(words)], pa.int32()), words)
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, columns, kinds), words], ["kind", "block", "doc_ids", "counts", "codes", "n_words", "words"])

    for batch in batches:
        for part in common.slices(batch, limit=SLICE_BYTES):
            held.append((part.column("doc_id").to_pylist(), _chunks(part)))
            size += part.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield flush()
                number, held, size = number + 1, [], 0
    if held:
        yield flush()


def _encoder(text: str):
    def encoded(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        word = t.column("word").combine_chunks().dictionary_encode()
        block = t.column("block").combine_chunks().dictionary_encode()
        flat, lens = encode_words(text, word.dictionary)
        starts = np.cumsum(lens) - lens
        w, b = word.indices.to_numpy(), block.indices.to_numpy()
        code = t.column("code").to_numpy()
        order = np.lexsort((code, b))  # rising codes of a block are kept as differences
        w, code = w[order], code[order]
        edges = np.searchsorted(b[order], np.arange(len(block.dictionary) + 1))
        rows: list[list] = [[], [], [], []]
        for i in range(len(block.dictionary)):
            s = slice(edges[i], edges[i + 1])
            rows[0].append(block.dictionary[i].as_py())
            rows[1].append(pack(np.diff(code[s], prepend=0)))
            rows[2].append(pack(lens[w[s]]))
            rows[3].append(pack(flat[common.ranges(starts[w[s]], lens[w[s]])]))
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int64()), *(pa.array(r, pa.binary()) for r in rows[1:])], ["block", "codes", "lens", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield encoded(held)
                held, n = [], 0
        if n:
            yield encoded(held)

    return run


IDS = "doc_id bigint, ids array<int>"


def as_ids(doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Table:
    """A slice of documents as rows with their ids."""
    return pa.table({"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))})


TEXTS = IDS + ", decoded string"


def spell(pieces: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts that ids decode to; an id outside the vocabulary is left out."""
    found = pieces.take(pa.array(ids, pa.int32(), mask=(ids < 0) | (ids >= len(pieces))))
    if found.null_count:
        known = pc.is_valid(found)
        ends = np.concatenate([[0], np.cumsum(known.to_numpy(zero_copy_only=False))])[ends]
        found = found.filter(known)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), " ")


def as_texts(vocabulary: Vocabulary) -> Callable[[pa.Array, np.ndarray, np.ndarray], pa.Table]:
    """A ``finish`` that adds the decoded texts to the ids."""
    pieces = pa.array(vocabulary.pieces, pa.string())
    return lambda doc_ids, ids, ends: as_ids(doc_ids, ids, ends).append_column("decoded", spell(pieces, ids, ends))


def _assembler(finish: Callable[[pa.Array, np.ndarray, np.ndarray], pa.Table]):
    def assemble(documents: pa.Table, words: pa.Table) -> pa.Table:
        """Ids of the documents of one block, finished slice by slice."""
        out = [finish(pa.array([], pa.int64()), np.empty(0, np.int32), np.zeros(1, np.int64))]

        def numbers(column: str, of=lambda a: a) -> np.ndarray:
            return np.concatenate([np.empty(0, np.int64), *(of(unpack(b).astype(np.int64)) for b in words.column(column).to_pylist())])

        code, size, flat = numbers("codes", np.cumsum), numbers("lens"), numbers("ids").astype(np.int32)
        for row in documents.to_pylist():
            n = row["n_words"]
            lens, starts = np.full(n, -1, np.int64), np.zeros(n, np.int64)
            lens[code], starts[code] = size, np.cumsum(size) - size
            if (lens < 0).any():
                raise RuntimeError("a block lost words")
            for doc_ids, counts, packed in zip(row["doc_ids"], row["counts"], row["codes"]):
                codes = unpack(packed).astype(np.int64)
                own = lens[codes]
                ids, upto = flat[common.ranges(starts[codes], own)], np.concatenate([[0], np.cumsum(own)])
                ends = upto[np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])]
                out.append(finish(pa.array(doc_ids, pa.int64()), ids, ends))
        return pa.concat_tables(out)

    return assemble


def word_table(blocks: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Encoded entries of the block dictionaries; each distinct word is encoded where its rows meet."""
    entries = blocks.select("block", F.posexplode("words").alias("code", "word"))
    # A hash brings the rows of a word together, and Spark sorts numbers by radix.
    by_word = entries.repartition("word").sortWithinPartitions(F.xxhash64("word"))
    return by_word.mapInArrow(_encoder(vocabulary.text), "block bigint, codes binary, lens binary, ids binary")


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, finish=as_ids, schema: str = IDS) -> DataFrame:
    """doc_id, ids (array of int) of every row of ``docs``; or what ``finish``, a table of ``schema``,
    makes of (doc_ids, ids, ends) of a slice in the Python task that has its ids."""
    vocabulary = vocabulary or Vocabulary()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    with common.two_tables(rows.mapInArrow(_blocks, _BLOCKS), "bpe-blocks", "kind") as (dictionaries, documents):
        words = common.cut(word_table(dictionaries, vocabulary), "bpe-words")
    documents = documents.select("block", "doc_ids", "counts", "n_words", "codes")
    return documents.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_assembler(finish), schema)


def _decoder(vocabulary: Vocabulary):
    pieces = pa.array(vocabulary.pieces, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
            texts = spell(pieces, pc.fill_null(ids.flatten(), -1).to_numpy(), ends)
            yield batch.append_column("decoded", pc.if_else(pc.is_valid(ids), texts, None))

    return run


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Adds ``decoded`` to a frame with ``ids``; an id outside the vocabulary is left out, as in the library."""
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    return encoded.mapInArrow(_decoder(vocabulary or Vocabulary()), schema)


def encode_and_decode(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """As ``decode(encode(docs))``, decoded in the Python task that has the ids."""
    vocabulary = vocabulary or Vocabulary()
    return encode(docs, vocabulary, as_texts(vocabulary), TEXTS)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encode_and_decode(common.read(spark, sf_dir, "documents"))
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
