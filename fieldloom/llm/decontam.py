"""Benchmark decontamination: an FM-index for each training shard, searched for all test phrases.

A shard is a bounded run of words inside a task: documents, or pieces of long ones that overlap by a phrase, up to SHARD_WORDS words. Every word of
it is in its index, under a number of its own. Phrases are searched backwards through wavelet ranks, occurrences are located
through sampled suffix positions, and their word spans are merged.

Phrases come in blocks of at most BLOCK_WORDS words and BLOCK_BYTES bytes (but for the item that runs across), which tasks write to files in the shared
folder; the driver knows their names only. A shard's index is built once and searched for one block after another, so a task holds one index
and one block, whatever the sizes of documents and benchmark. Texts are read once and not shuffled.

Defined results: null or empty texts have no words, no hits and are not contaminated; a benchmark item without
words has no phrase; an item shorter than a window is one phrase, whole; items are told apart by
item_id (repeated rows count once, a null item_id is the item "null"); an empty benchmark hits
nothing; repeated documents stay rows of their own; other columns are ignored by `find` unless named in `keep`, and kept by `clean`.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import fresh_path, small_batches, utf8
from fieldloom.llm.fmindex import FMIndex

WINDOW, SHARD_WORDS, BLOCK_WORDS, BLOCK_BYTES = 13, 1_000_000, 2_000_000, 64 << 20
#: Bytes that no word has (00-2F, 3A-60, 7B-7F after lower-casing A-Z) become blanks.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
BLANK = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().translate(BLANK).split() if text else []


@dataclass
class Phrases:
    """Distinct phrases, as numbers of the block's distinct words, and their items."""

    words: dict[bytes, int] = field(default_factory=dict)
    seen: dict[tuple, int] = field(default_factory=dict)
    items: list[dict[str, None]] = field(default_factory=list)
    n_words: int = 0
    n_bytes: int = 0

    def add(self, item: str, text: bytes | None, window: int) -> None:
        ids = [self.words.setdefault(w, len(self.words)) for w in words_of(text)]
        self.n_words += len(ids)
        self.n_bytes += len(text or b"")
        for phrase in {tuple(ids[i : i + window]) for i in range(max(1, len(ids) - window + 1))} if ids else ():
            k = self.seen.setdefault(phrase, len(self.seen))
            if k == len(self.items):
                self.items.append({})
            self.items[k][item] = None

    def write(self, path: str) -> None:
        """Three Arrow streams in one file: words, phrases, items."""
        place = np.array([p for p in self.seen.values()], np.int64)
        tables = (
            pa.table({"word": pa.array(self.words, pa.binary())}),
            pa.table({"k": place, "phrase": pa.array(list(self.seen), pa.list_(pa.int32()))}),
            pa.table({"items": pa.array([list(i) for i in self.items], pa.list_(pa.string()))}),
        )
        system, name = file_system(path)
        with system.open_output_stream(name) as out:
            for t in tables:
                with pa.ipc.new_stream(out, t.schema) as stream:
                    stream.write_table(t)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@functools.lru_cache(maxsize=1)
def read_block(path: str) -> tuple[dict[bytes, int], list[tuple[int, np.ndarray, np.ndarray]], list[list[str]]]:
    """A block's words, its phrases by length (length, numbers, words as a matrix) and their items. The last block read is kept."""
    system, name = file_system(path)
    with system.open_input_stream(name) as source:
        words, phrases, items = (pa.ipc.open_stream(source).read_all() for _ in range(3))
    k, phrase = phrases.column("k").to_numpy(), phrases.column("phrase").combine_chunks()
    sizes = phrase.value_lengths().to_numpy()
    flat, starts = phrase.values.to_numpy(), phrase.offsets.to_numpy()[:-1]
    by_length = [(int(n), k[sizes == n], flat[starts[sizes == n][:, None] + np.arange(n)]) for n in np.unique(sizes)]
    return {w: i for i, w in enumerate(words.column("word").to_pylist())}, by_length, items.column("items").to_pylist()


def write_blocks(benchmark: DataFrame, window: int, block_words: int) -> list[str]:
    """Blocks of phrases as files that all executors see; their names."""
    folder = fresh_path(benchmark.sparkSession, "phrases")
    system, name = file_system(folder)
    system.create_dir(name, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, block, made = context.partitionId() if context else 0, Phrases(), []

        def put() -> None:
            made.append(f"{folder}/{part}-{len(made)}.arrow")
            block.write(made[-1])

        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), utf8(batch.column("text")), strict=True):
                block.add("null" if item is None else item, text, window)
                if block.n_words >= block_words or block.n_bytes >= BLOCK_BYTES:
                    put()
                    block = Phrases()
        if block.seen:
            put()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["path"])

    # Files of a small benchmark are read as one part, so that it is one block.
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.coalesce(1) if size <= BLOCK_BYTES else rows
    return sorted(r["path"] for r in rows.mapInArrow(write, "path string").collect())


def index_of(pieces: list[list[bytes]]) -> tuple[FMIndex, dict[bytes, int]]:
    """The index of all words of a shard, a symbol 1 after each piece and 0 at the end; and the words' symbols."""
    symbols: dict[bytes, int] = defaultdict(count(2).__next__)
    size = sum(map(len, pieces)) + len(pieces) + 1
    numbers = chain.from_iterable(chain(map(symbols.__getitem__, words), (1,)) for words in pieces)
    text = np.fromiter(chain(numbers, (0,)), np.int64, size)
    return FMIndex(text), symbols


def shards_of(word_lists: list[list[bytes]], window: int, shard_words: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Shards of pieces (document, first word, words) of at most shard_words words together, or one piece of a window."""
    step = max(1, shard_words - window + 1)
    held: list[tuple[int, int, list[bytes]]] = []
    total = 0
    for k, words in enumerate(word_lists):
        for at in range(0, max(1, len(words) - window + 1), step) if words else ():
            piece = words[at : at + step + window - 1]
            if held and total + len(piece) > shard_words:
                yield held
                held, total = [], 0
            held.append((k, at, piece))
            total += len(piece)
    if held:
        yield held


def search_shard(shard: list[tuple[int, int, list[bytes]]], paths: list[str]) -> Iterator[tuple[int, int, int, list[str]]]:
    """(document, first word, end, items) of each occurrence of a phrase; the index is built once for all blocks."""
    pieces = [p for _, _, p in shard]
    owner, offset = (np.array([x[k] for x in shard], np.int64) for k in (0, 1))
    index, symbols = index_of(pieces)
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])
    for path in paths:
        words, phrases, items = read_block(path)
        place = np.fromiter((symbols[w] if w in symbols else index.symbols for w in words), np.int64, len(words))
        for n, numbers, matrix in phrases:
            alive, low, high = index.search(place[matrix])
            if len(alive):
                found = high - low
                rows = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)
                at = index.locate(rows)
                piece = np.searchsorted(starts, at, side="right") - 1
                at = at + offset[piece] - starts[piece]
                for doc, first, k in zip(owner[piece].tolist(), at.tolist(), np.repeat(numbers[alive], found).tolist(), strict=True):
                    yield doc, first, first + n, items[k]


def merged(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """Spans that touch or overlap become one."""
    out_s: list[int] = []
    out_e: list[int] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if out_e and s <= out_e[-1]:
            out_e[-1] = max(out_e[-1], e)
        else:
            out_s.append(s)
            out_e.append(e)
    return out_s, out_e


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns `keep`), n_words, merged removal spans in words (span_starts, span_ends) and
    item_ids, sorted, of each row."""
    small_batches(docs.sparkSession)
    keep = keep or ["doc_id"]
    ints, strings = pa.list_(pa.int64()), pa.list_(pa.string())
    paths = write_blocks(benchmark, window, block_words)
    # under names of their own, so that no column of the input can clash
    rows = docs.select(F.struct(*(docs[c] for c in keep)).alias("own"), docs["text"].alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words: list[list[bytes]] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            starts: list[list[int]] = [[] for _ in words]
            ends: list[list[int]] = [[] for _ in words]
            items: list[set[str]] = [set() for _ in words]
            for shard in shards_of(words, window, shard_words) if paths else ():
                for doc, first, end, found in search_shard(shard, paths):
                    starts[doc].append(first)
                    ends[doc].append(end)
                    items[doc].update(found)
            spans, at = [merged(s, e) for s, e in zip(starts, ends, strict=True)], 0
            for batch in held:
                now = slice(at, at + batch.num_rows)
                at += batch.num_rows
                arrays = [batch.column("own"), pa.array([len(w) for w in words[now]], pa.int64()), *(pa.array([s[k] for s in spans[now]], ints) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([sorted(i) for i in items[now]], strings)], ["own", "n_words", "span_starts", "span_ends", "item_ids"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch.select(["own"]))
                new = [words_of(t) for t in utf8(batch.column("text"))]
                words += new
                total += sum(map(len, new)) + len(new)
                if total >= shard_words:
                    yield from flush()
                    held, words, total = [], [], 0
        if held:
            yield from flush()

    own = rows.schema["own"].dataType.simpleString()
    return rows.mapInArrow(search, f"own {own}, n_words long, span_starts array<long>, span_ends array<long>, item_ids array<string>")


def is_contaminated(share: int):
    hits = F.aggregate(F.zip_with("span_ends", "span_starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, b: a + b)
    return hits, (hits > 0) & (hits * share >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20, **options) -> DataFrame:
    """The digest of `find`: counts, a hash of the items, and whether at least 1 in `share` words is hit."""
    hits, verdict = is_contaminated(share)
    return find(docs, benchmark, **options).select(
        F.col("own.doc_id").alias("doc_id"), "n_words", hits.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), verdict.alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, share: int = 20, **options) -> DataFrame:
    """The rows that are not contaminated, as they are."""
    _, verdict = is_contaminated(share)
    return find(docs, benchmark, keep=docs.columns, **options).filter(~verdict).select("own.*")
