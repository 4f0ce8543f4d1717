"""Token counts without token ids.

A byte-level BPE never merges across pre-tokens, so a text has as many tokens as its pre-tokens have pieces.
The library's model counts the pieces of each distinct pre-token of the corpus once; documents then look
up the pieces of their pre-token frequencies and sum.

 1. Tasks gather distinct pre-tokens with their occurrences (flushed at a bound); a shuffle on the
    pre-token merges them; one call per distinct pre-token counts its pieces. This vocabulary is written to the
    shared folder.
 2. Pre-tokens are joined to the documents' frequencies. The frequent head, at most HEAD entries of at most
    HEAD_CHARS characters, is broadcast; it is every pre-token of at least 2^k occurrences, for the smallest k that
    keeps to that bound. What is left of a document, its rare pre-tokens, is joined by a shuffle.

Pre-tokens are found with the library's own pattern. Characters that Python's Unicode tables do not know are
classified differently by different regex engines, so a text with one of them is split by the library itself.

Defined results: null and empty texts have 0 bytes and 0 tokens; the special token's string inside a text counts as
one token, as the library does by default; repeated rows stay rows of their own; other columns are ignored; an
empty table gives no rows; a tokenizer file of another kind is an error.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import columns, materialised, small_batches

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEAD, HEAD_CHARS, FLUSH = 400_000, 48, 300_000


@lru_cache(4)
def _library(path: str):
    """The library's model; a file whose texts are not cut by PATTERN, or whose pieces depend on more than the pre-token, is refused."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    cut, model = parts["pre_tokenizer"] or {}, parts["model"]
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    if not plain or parts["normalizer"] or model["type"] != "BPE" or model.get("dropout"):
        raise ValueError(f"{path} is no byte-level BPE with the usual split")
    return Tokenizer.from_file(path)


class PreTokens:
    """Splits texts as the library's file says: special strings first, then the pattern."""

    def __init__(self, path: str):
        self.library = _library(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))).split if self.specials else None
        self.known: dict[str, bool] = {}

    def _new_character(self, text: str) -> bool:
        known = self.known
        for c in set(text):
            if c not in known:
                known[c] = unicodedata.category(c) == "Cn"
            if known[c]:
                return True
        return False

    def __call__(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special tokens stand between them."""
        parts = [text]
        if self.split and any(s in text for s in self.specials):
            parts = self.split(text)
        out: list[str] = []
        for part in parts:
            if not part.isascii() and self._new_character(part):
                out += [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
            else:
                out += self.find(part)
        return out, len(parts) - 1


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """Distinct pre-tokens: pre_token, occurrences, n_pieces."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = PreTokens(path), Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["pre_token", "occurrences"])

        for (texts,) in columns(batches, "text"):
            for text in texts.to_pylist():
                if text:
                    seen.update(split(text)[0])
                    if len(seen) > FLUSH:
                        yield rows()
                        seen.clear()
        if seen:
            yield rows()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(path)
        for batch in batches:
            ids = library.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x.ids) for x in ids], pa.int32())], ["pre_token", "occurrences", "n_pieces"])

    found = docs.select("text").mapInArrow(distinct, "pre_token string, occurrences long")
    found = found.groupBy("pre_token").agg(F.sum("occurrences").alias("occurrences"))
    return materialised(found.mapInArrow(pieces, "pre_token string, occurrences long, n_pieces int"))


def head_of(words: DataFrame, head: int) -> DataFrame:
    """At most `head` of the most frequent pre-tokens."""
    short = words.filter(F.length("pre_token") <= HEAD_CHARS)
    power = F.floor(F.log2("occurrences")).cast("int")
    sizes = {r["power"]: r["n"] for r in short.groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()}
    least, total = 64, 0
    while least and total + sizes.get(least - 1, 0) <= head:
        least -= 1
        total += sizes.get(least, 0)
    return short.filter(power >= least)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than `limit`) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    words = vocabulary(docs, path)
    first = head_of(words, head).toPandas()
    frequent = spark.sparkContext.broadcast(dict(zip(first["pre_token"], map(int, first["n_pieces"]), strict=True)))
    complete = len(first) == words.count()
    del first
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, table = PreTokens(path), frequent.value
        rest_type = pa.map_(pa.string(), pa.int64())
        for ids, texts in columns(batches, "doc_id", "text"):
            sizes, sums, rests = [], [], []
            for text in texts.to_pylist():
                found, total = split(text or "")
                rest = []
                for token, n in Counter(found).items():
                    if (k := table.get(token)) is None:
                        rest.append((token, n))
                    else:
                        total += k * n
                sizes.append(len((text or "").encode()))
                sums.append(total)
                rests.append(rest)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rests, rest_type)], ["doc_id", "n_bytes", "n_tokens", "rest"])

    counted = docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, rest map<string,long>")
    if not complete:
        counted = materialised(counted.withColumn("row", F.monotonically_increasing_id()))
        rare = counted.select("row", F.explode("rest").alias("pre_token", "n"))
        rare = rare.join(words.select("pre_token", "n_pieces"), "pre_token").groupBy("row").agg(F.sum(F.col("n") * F.col("n_pieces")).alias("rare"))
        counted = counted.drop("rest").join(rare, "row", "left").withColumn("n_tokens", F.col("n_tokens") + F.coalesce("rare", F.lit(0)))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
