"""Token ids as Parquet files with list columns, for reading parts of them.

Documents are encoded in the order of their ids. A row is a piece of at most ``PIECE``
ids of one document, so that rows, pages and row groups have bounded sizes however long
a text is. The ids are dictionary encoded, the numbers beside them delta encoded; pages
carry an index of their least and greatest values. A reader that wants lengths and
places reads those columns alone, one that wants a stretch of tokens or some documents
skips files, row groups and pages by ``part``, ``offset`` and the document id.

``tokens/`` holds the pieces, one file for each range of ids, numbered by ``part``;
``offset`` counts the tokens of its part before a piece. ``manifest/`` has a row per
part with the tokens before it, so the global place of a piece is a sum.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from trackframe.llm.common import shuffle_width, text_of

END = 2
#: Ids of a row.
PIECE = 8_192
#: Bytes of text that are encoded together.
STEP = 4_000_000
#: Sizes of the files.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 1_000

#: A border that the tokenizer always sets: ASCII white space after anything that could
#: not be white space by any reading.
OPEN = "[\\s\x1c-\x1f\u180e\u200b\ufeff]"
BORDER = re.compile(f"(?<!{OPEN})(?=[\\t-\\r ])")
OPEN_SIGNS = frozenset(re.findall(OPEN, "".join(map(chr, range(0x10000)))))
#: Signs that every version of Unicode sorts alike: Latin, Greek, Cyrillic, Kana, Han, Hangul.
PLAIN = (
    "[\t-\r -~\u00a1-\u00ac\u00ae-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481"
    "\u048a-\u0513\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"
)
#: Pieces that a task keeps with their ids, and up to which length.
SEEN, SHORT = 300_000, 64
_LOADED: dict = {}


class PieceTokens:
    """A tokenizer of the library, applied to each distinct piece of many texts.

    Byte-level tokenizers that split by their own pattern always split before white
    space that follows something else, so texts are cut there and equal pieces are
    encoded once. Pieces of plain signs go through a rank encoder with the same merges
    and the same pattern, which is faster; all others go through the library. Other
    kinds of tokenizers get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            spec = json.load(file)
        level = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.cuts = (
            spec.get("normalizer") is None
            and level.get("type") == "ByteLevel"
            and level.get("use_regex", True)
            and not level.get("add_prefix_space", True)
            and not any(
                t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                for t in added
            )
        )
        self.ranks = _ranks(spec["model"]) if self.cuts else None
        # signs that added tokens start with are not plain
        starts = "".join({re.escape(t["content"][0]) for t in added})
        self.plain = re.compile(f"(?:(?![{starts}]){PLAIN})*" if starts else f"{PLAIN}*").fullmatch

    def _new(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, four bytes each."""
        fast = self.ranks.encode_ordinary if self.ranks else None
        slow = self.tokenizer.encode
        return [
            array(
                "i",
                fast(p) if fast and self.plain(p) else slow(p, add_special_tokens=False).ids,
            ).tobytes()
            for p in pieces
        ]

    def _codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The pieces of all texts: their numbers, how many each text has, and what they are."""
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        borders = split.offsets.to_numpy().astype(np.int64)
        borders = borders - borders[0]
        known = words.dictionary.to_pylist()
        codes = words.indices.to_numpy().astype(np.int64)
        first, final = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        first[borders[:-1]] = True
        final[borders[1:] - 1] = True
        # a word that is empty or ends in white space has no border behind it
        empty = pc.binary_length(words.dictionary).to_numpy() == 0
        ends = np.array([w[-1:] in OPEN_SIGNS for w in known])
        torn = (empty | ends)[codes] & ~final & ~(first & empty[codes])
        # even: the word alone; odd: a space and the word
        codes = 2 * codes + ~first
        sizes = np.diff(borders)
        extra: dict[str, int] = {}
        if torn.any():
            runs, at = [], 0
            for i in np.flatnonzero(np.add.reduceat(torn, borders[:-1])).tolist():
                pieces = [p for p in BORDER.split(texts[i].as_py()) if p]
                numbers = [extra.setdefault(p, 2 * len(known) + len(extra)) for p in pieces]
                runs += [codes[borders[at] : borders[i]], np.array(numbers, np.int64)]
                sizes[i], at = len(pieces), i + 1
            codes = np.concatenate([*runs, codes[borders[at] :]])
        number = np.full(2 * len(known) + len(extra), -1)
        number[codes] = 0
        used = np.flatnonzero(number == 0)
        number[used] = np.arange(len(used))
        odd = [f" {w}" for w in known]
        pieces = list(chain.from_iterable(zip(known, odd, strict=True)))
        pieces += extra
        return number[codes], sizes, [pieces[c] for c in used.tolist()]

    def encode(
        self, texts: pa.Array, end: int, seen: dict[str, bytes] | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``, and where each text's stop.

        ``seen`` keeps the ids of pieces from call to call.
        """
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.cuts:
            codes, sizes, pieces = self._codes(texts)
        else:
            pieces = texts.to_pylist()
            codes, sizes = np.arange(len(pieces)), np.ones(len(pieces), np.int64)
        seen = {} if seen is None else seen
        if len(seen) > SEEN:
            seen.clear()
        found = list(map(seen.get, pieces))
        fresh = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(fresh, self._new([pieces[i] for i in fresh]), strict=True):
            found[i] = ids
            if len(pieces[i]) <= SHORT:
                seen[pieces[i]] = ids
        found.append(array("i", [end]).tobytes())
        table = np.frombuffer(b"".join(found), np.int32)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(lengths) - lengths
        flat = np.insert(codes, np.cumsum(sizes), len(pieces))
        run = lengths[flat]
        stops = np.cumsum(run)
        ids = table[np.arange(int(stops[-1])) + np.repeat(begins[flat] - stops + run, run)]
        return ids, stops[np.cumsum(sizes + 1) - 1]


def _ranks(model: dict):
    """A rank encoder with the merges of a byte-level model; None if it has other rules."""
    import public_tokenizers
    import tiktoken

    if model.get("type") != "BPE" or model.get("byte_fallback") or model.get("ignore_merges"):
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    # bytes that are no visible sign are written as the signs from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocabulary = model["vocab"]
    steps = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    numbers = [vocabulary["".join(m)] for m in steps]
    if numbers != list(range(256, 256 + len(steps))) or len(vocabulary) != 256 + len(steps):
        return None
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()}
    return tiktoken.Encoding(
        "merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )._core_bpe


def tokens_at(path: str) -> PieceTokens:
    if path not in _LOADED:
        _LOADED[path] = PieceTokens(path)
    return _LOADED[path]


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``STEP`` bytes of text, one text at least."""
    sizes = np.cumsum(pc.binary_length(batch["text"]).to_numpy())
    start = 0
    while start < len(sizes):
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + STEP, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _encoder(path: str, piece: int, end: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, offset = tokens_at(path), TaskContext.get().partitionId(), 0
        seen: dict[str, bytes] = {}
        for batch in batches:
            for some in _steps(batch):
                ids, stops = tokens.encode(some["text"], end, seen)
                total = np.diff(stops, prepend=0)
                rows = -(-total // piece)
                doc = np.repeat(np.arange(len(total)), rows)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(rows) - rows, rows)
                begins = (stops - total)[doc] + number * piece
                sizes = np.minimum(piece, total[doc] - number * piece)
                yield pa.RecordBatch.from_arrays(
                    [
                        some["doc_id"].take(pa.array(doc)),
                        pa.repeat(pa.scalar(part, pa.int32()), len(doc)),
                        pa.array(offset + begins),
                        pa.array(number * piece),
                        pa.array(sizes.astype(np.int32)),
                        pa.array(total[doc]),
                        pa.ListArray.from_arrays(
                            pa.array(np.append(begins, len(ids)).astype(np.int32)), pa.array(ids)
                        ),
                    ],
                    ["doc_id", "part", "offset", "ahead", "n", "doc_tokens", "ids"],
                )
                offset += len(ids)

    return encode


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int | None = None,
    piece: int = PIECE,
    end: int = END,
) -> None:
    """Encode whole texts and write them below ``path``, in ascending order of their ids.

    Null ids come first; rows of one id are ordered by the hash of their text. A null
    text is empty, so it has the end id only. Other columns are not read. An empty table
    gives an empty one. ``tokenizer`` is the path of a file of the tokenizers library.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")
    ).withColumns({"__tie": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
    order = ["doc_id", "__tie", "__row"]
    pieces = (
        rows.repartitionByRange(parts or shuffle_width(spark), *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(
            _encoder(tokenizer, piece, end),
            f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part int, offset long, "
            "ahead long, n int, doc_tokens long, ids array<int>",
        )
    )
    writer = pieces.write.options(
        **{
            "compression": "zstd",
            "parquet.writer.version": "v2",
            "parquet.block.size": ROW_GROUP,
            "parquet.page.size": PAGE,
            "parquet.page.row.count.limit": PAGE_ROWS,
            "parquet.enable.dictionary": "false",
            "parquet.enable.dictionary#ids.list.element": "true",
        }
    )
    writer.parquet(f"{path}/tokens")
    # one row per file: only they meet in one task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    _pieces(spark, path).groupBy("part").agg(
        F.sum("n").alias("tokens"), F.max("n").alias("longest"), F.count_if(F.col("ahead") == 0).alias("documents")
    ).select(
        "*", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")).alias("first")
    ).coalesce(1).write.parquet(f"{path}/manifest")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tokens")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(part, tokens, longest, documents, first): one row per file; ``longest`` is of a piece."""
    return spark.read.parquet(f"{path}/manifest")


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ahead, n, doc_tokens, ids); columns that are not used are not read.

    ``start`` counts all tokens before the piece, ``ahead`` those of its document.
    """
    first = read_manifest(spark, path).select("part", "first")
    return _pieces(spark, path).join(first, "part").select(
        "doc_id", (F.col("first") + F.col("offset")).alias("start"), "ahead", "n", "doc_tokens", "ids"
    )


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids) of the tokens from ``start`` to before ``stop``, in pieces.

    The manifest says which files, the index of their pages which of their pages.
    """
    manifest = read_manifest(spark, path).filter(
        (F.col("first") < stop) & (F.col("first") + F.col("tokens") > start)
    )
    ends = manifest.agg(
        F.min(F.struct("part", "first", "longest")).alias("a"),
        F.max(F.struct("part", "first")).alias("b"),
    ).first()
    pieces = _pieces(spark, path)
    if ends["a"] is None:
        return pieces.select(F.col("offset").alias("start"), "ids").limit(0)
    (a, a_first, longest), (b, b_first) = ends
    found = pieces.filter(
        F.col("part").between(a, b)
        & ((F.col("part") > a) | (F.col("offset") > start - a_first - longest))
        & ((F.col("part") < b) | (F.col("offset") < stop - b_first))
    ).join(manifest.select("part", "first"), "part")
    at = F.col("first") + F.col("offset")
    skip = F.greatest(F.lit(start) - at, F.lit(0)).cast("int")
    left = (F.least(F.lit(stop), at + F.col("n")) - at - skip).cast("int")
    return found.select(
        (at + skip).alias("start"), left.alias("left"), skip.alias("skip"), "ids"
    ).filter("left > 0").select("start", F.slice("ids", F.col("skip") + 1, F.col("left")).alias("ids"))


#: Fixed value: the polynomial of crc32, lowest power first.
POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two remainders modulo the polynomial."""
    found = 0
    while b:
        if b & 0x80000000:
            found ^= a
        a = (a >> 1) ^ (POLYNOMIAL if a & 1 else 0)
        b = (b << 1) & 0xFFFFFFFF
    return found


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """The crc32 of bytes whose parts have these (crc32, number of bytes)."""
    whole = 0
    for crc, size in parts:
        power, step = 1 << 31, 1 << 23  # x^0, and x^8 for one byte
        while size:
            if size & 1:
                power = _times(power, step)
            step, size = _times(step, step), size >> 1
        whole = _times(whole, power) ^ crc
    return whole


@F.arrow_udf(LongType())
def _crc(lists: pa.Array) -> pa.Array:
    flat, ends = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
    return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.int64())


@F.udf(LongType())
def _join_crcs(parts):
    return joined_crc([(p["crc"], 4 * p["n"]) for p in parts])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    Only the digests of pieces are shuffled, by the place of their document.
    """
    digests = (
        read_pieces(spark, path).withColumn("crc", _crc("ids"))
        .groupBy("doc_id", (F.col("start") - F.col("ahead")).alias("start"),
                 F.col("doc_tokens").alias("n_tokens"))
        .agg(F.array_sort(F.collect_list(F.struct("ahead", "crc", "n"))).alias("parts"))
    )
    return (
        digests.filter(F.size("parts") == 1).withColumn("ids_crc32", F.col("parts")[0]["crc"])
        .unionByName(
            digests.filter(F.size("parts") > 1).withColumn("ids_crc32", _join_crcs("parts"))
        )
        .drop("parts")
    )
