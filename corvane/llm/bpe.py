"""Byte-level BPE by a table of distinct words: encode each word once, join ids back by position, decode by a join of ids to pieces.

Texts are split in tasks into words that no merge crosses: a special token of the tokenizer, other characters between white
space with one space before them, cut before punctuation that follows a plain letter or digit, or white space. Documents
are packed in groups, a group's words are numbered and its texts kept as numbers, in a table bucketed by group. The words
of all groups are dealt to ranges by their hash, where each distinct word is encoded once, and its ids go back to the
groups that hold the word, where a text's numbers put them in place and the ids meet their pieces. So a word travels once
for a group, packed with others of its range, not once for an occurrence, and no text is shuffled.

A null text counts as empty and gives no ids and an empty text. Special tokens in a text become their own ids. Repeated
rows give repeated results, an empty table none. Columns of the input called ids or decoded, in any case, are replaced.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import packed, parts_for, shared_folder, slices, unlike, unpacked

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.json"
#: A tokenizer is broadcast up to this size, its pieces are a table of as many rows as it has ids.
MAX_TOKENIZER_BYTES = 16 << 20
#: Bytes of text in a group, MB of text for a range of hashes.
GROUP, RANGE_MB = 6 << 20, 64
# The characters with the Unicode property White_Space; ASCII punctuation; letters and digits in every version of Unicode.
WHITE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
MARKS = r"!-/:-@\[-`{-~"
PLAIN = r"0-9A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u024F"
WORD = re.compile(f" ?[{MARKS}]*+[{PLAIN}]++(?=[{MARKS}{WHITE}]|\\Z)| ?[{MARKS}]++(?=[{WHITE}]|\\Z)| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def read(tokenizer_file: str) -> str:
    """The tokenizer's JSON, when it is a byte-level BPE that words can be encoded with one by one."""
    with open(tokenizer_file, encoding="utf-8") as f:
        source = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(source) > MAX_TOKENIZER_BYTES:
        raise ValueError("the tokenizer is too large to broadcast")
    t = json.loads(source)
    split = t["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and not t["normalizer"] and t["model"]["type"] == "BPE" and not t["model"].get("dropout")
    if not plain or any(a["lstrip"] or a["rstrip"] or a["single_word"] or not a["content"].strip() for a in t["added_tokens"]):
        raise ValueError("only byte-level BPE without normaliser, with plain special tokens")
    return source


@lru_cache(maxsize=2)
def tokenizer(source: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(source)
    t.no_padding()
    t.no_truncation()
    return t


def special_tokens(source: str) -> re.Pattern | None:
    """The special tokens, longest first, in one group."""
    contents = sorted((a["content"] for a in json.loads(source)["added_tokens"]), key=lambda c: -len(c))
    return re.compile("(" + "|".join(map(re.escape, contents)) + ")") if contents else None


def split_words(text: str, special: re.Pattern | None) -> list[str]:
    """Words of the text in order; joined they give it back, and each is encoded by itself as it is in the text. A special token ends white space as the end of the text does."""
    if special is None or not special.search(text):
        return WORD.findall(text)
    return [w for i, x in enumerate(special.split(text)) for w in ([x] if i % 2 else WORD.findall(x))]


def spelled(source: str) -> list[bytes]:
    """The bytes of every id. In the vocabulary a printable byte stands for itself, the others are numbered from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}
    t = json.loads(source)
    named = {i: token for token, i in t["model"]["vocab"].items()} | {a["id"]: a["content"] for a in t["added_tokens"]}
    raw = lambda token: bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return [raw(named.get(i, "")) for i in range(max(named) + 1)]


def decode(rows: DataFrame, keys: list[str], tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """keys and decoded, the text of the column ids, by a join of ids to pieces; keys tell the rows apart. Bytes that are not UTF-8 become U+FFFD, ids without a piece are passed over. Null ids count as none."""
    table = rows.sparkSession.createDataFrame([(i, raw.hex()) for i, raw in enumerate(spelled(read(tokenizer_file)))], "id int, piece string")
    each = rows.select(*keys, F.posexplode_outer("ids").alias("i", "id"))
    found = each.join(F.broadcast(table), "id", "left")  # as many rows as the tokenizer has ids
    listed = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("i", "piece")))).alias("l"))
    raw = F.unhex(F.array_join(F.transform("l", lambda x: x["piece"]), ""))
    return listed.select(*keys, F.make_valid_utf8(raw.cast("string")).alias("decoded"))


def squeezed(numbers: np.ndarray, data: bytes) -> bytes:
    """Lengths and the bytes they measure, compressed."""
    raw = numbers.astype(np.uint32).tobytes() + data
    return np.array([len(numbers), len(raw)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def released(value: bytes) -> tuple[np.ndarray, bytes]:
    n, size = np.frombuffer(value[:16], np.int64).tolist()
    raw = pa.decompress(value[16:], decompressed_size=size, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint32, n), raw[4 * n :]


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    """The groups as a table in the shared folder, bucketed by part: each is written once and read where its part belongs."""
    spark, name = groups.sparkSession, f"bpe_{uuid.uuid4().hex}"
    groups.write.option("path", f"{shared_folder(spark)}/{name}").bucketBy(buckets, "part").saveAsTable(name)
    return spark.table(name)


def encode(docs: DataFrame, keep: list[str], text: str = "text", tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """The columns `keep` with ids array<int>, what the tokenizer gives for the whole text without adding special tokens, and decoded, the text of these ids."""
    spark, source = docs.sparkSession, read(tokenizer_file)
    shared, special = spark.sparkContext.broadcast(source), special_tokens(source)
    keep = unlike(keep, "ids", "decoded")
    n_ranges, small = parts_for(docs, RANGE_MB), len(spelled(source)) <= 1 << 16
    kind = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.binary())]))
    rows = docs.select(*keep, F.col(text).cast("string").alias("~text"))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents packed in groups: a group's distinct words, and its documents with their words as numbers, frequent words first."""
        group = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(len(keep))
            for a, b in slices([n or 0 for n in pc.binary_length(texts).to_pylist()], GROUP):
                split = [split_words(t or "", special) for t in texts.slice(a, b - a).to_pylist()]
                ends = np.cumsum([0, *map(len, split)])
                coded = pa.array([w for ws in split for w in ws], pa.string()).dictionary_encode()
                place = coded.indices.to_numpy()
                order = np.argsort(-np.bincount(place, minlength=len(coded.dictionary)), kind="stable")
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order))
                numbers = rank[place]
                bytes_of = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((numbers >> np.uint32(8 * i)).astype(np.uint8 if i < 2 else np.uint16))) for i in range(3)]
                documents = {n: batch.column(i).slice(a, b - a) for i, n in enumerate(keep)} | {f"~{i}": x for i, x in enumerate(bytes_of)}
                words = [w.encode() for w in coded.dictionary.take(pa.array(order)).to_pylist()]
                at = np.fromiter((zlib.crc32(w) % n_ranges for w in words), np.uint32, len(words))
                by_range = np.argsort(at, kind="stable")
                heads = np.flatnonzero(np.diff(at[by_range], prepend=-1))
                held = [(int(at[own[0]]), squeezed(np.array([len(words[i]) for i in own]), b"".join([words[i] for i in own]))) for own in np.split(by_range, heads[1:]) if len(own)]
                blob = squeezed(at, packed(documents))
                yield pa.RecordBatch.from_pydict({"part": pa.array([group], pa.int64()), "words": pa.array([[{"at": a, "words": w} for a, w in held]], kind), "documents": pa.array([blob], pa.binary())})
                group += 1

    def encoded(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of a range's words, each encoded once, back to the groups in the order that they came in."""
        t, table = tokenizer(shared.value), pa.Table.from_batches(batches)
        lists, flat = [], []
        for value in table.column("words").to_pylist():
            sizes, raw = released(value)
            ends = np.cumsum(sizes, dtype=np.int64)
            lists.append(len(sizes))
            flat.append(pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(raw)]))
        coded = pa.chunked_array(flat).combine_chunks().dictionary_encode()
        of_words = [np.array(e.ids, np.uint32) for e in t.encode_batch_fast(coded.dictionary.to_pylist(), add_special_tokens=False)]
        for part, own in zip(table.column("part").to_pylist(), np.split(coded.indices.to_numpy(), np.cumsum(lists)[:-1]), strict=True):
            ids = [of_words[i] for i in own.tolist()]
            value = squeezed(np.array([len(x) for x in ids]), np.concatenate(ids).astype(np.uint16 if small else np.uint32).tobytes())
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "at": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([value], pa.binary())})

    groups = _bucketed(rows.mapInArrow(grouped, "part long, words array<struct<at: int, words: binary>>, documents binary"), n_ranges)
    words = groups.select("part", F.inline("words"))
    back = words.groupBy("at").applyInArrow(encoded, "part long, at int, ids binary")

    def placed(left: pa.Table, right: pa.Table) -> pa.Table:
        ranges, blob = released(left.column("documents")[0].as_py())
        documents = unpacked(pa.scalar(blob))
        came = [released(v) for v in right.sort_by("at").column("ids").to_pylist()]
        order = np.empty(len(ranges), np.int64)
        order[np.argsort(ranges, kind="stable")] = np.arange(len(ranges))
        sizes = np.concatenate([n for n, _ in came]).astype(np.int64) if came else np.zeros(0, np.int64)
        flat = np.concatenate([np.frombuffer(x, np.uint16 if small else np.uint32) for _, x in came]).astype(np.int32) if came else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat)).take(pa.array(order))
        sizes = sizes[order]
        low, high, top = (documents.column(f"~{i}").combine_chunks() for i in range(3))
        numbers = low.values.to_numpy().astype(np.int64) + (high.values.to_numpy().astype(np.int64) << 8) + (top.values.to_numpy().astype(np.int64) << 16)
        n = np.concatenate([[0], np.cumsum(sizes[numbers])])[low.offsets.to_numpy()]
        flat = lists.take(pa.array(numbers)).flatten()
        pieces = piece_table(shared.value).take(flat)  # ids meet their pieces
        at = np.frombuffer(pieces.buffers()[1], np.int64)[n] if len(pieces) else np.zeros(len(n), np.int64)
        data = memoryview(pieces.buffers()[2] or b"")
        texts = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.table([*(documents.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(n, pa.int32()), flat), pa.array(texts, pa.string())], names=[*keep, "ids", "decoded"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return groups.select("part", "documents").groupBy("part").cogroup(back.groupBy("part")).applyInArrow(placed, f"{fields}ids array<int>, decoded string")


@lru_cache(maxsize=2)
def piece_table(source: str) -> pa.Array:
    return pa.array(spelled(source), pa.large_binary())


def op12(spark, sf_dir: str) -> DataFrame:
    coded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
