"""Byte-level BPE encoding and decoding (operator 7).

Texts are cut into overlapping chunks of ``chunk_chars`` characters. Each chunk is split into pieces by the
vocabulary's pattern on its own, and neighbours are stitched at the first piece boundary inside their overlap
that both agree on: from a true boundary on, splitting depends only on the text that follows, so everything
after an agreed boundary is right. Then the pieces are encoded by their merges. If an overlap holds no common boundary
(one piece longer than the overlap), chunks go on growing together until one is found, so the result is exact for
any text. Decoding concatenates the tokens' raw bytes.

Every text goes through the same cutting and stitching. A task does it for its rows; only the chunks of a text of
more than ``spread_chars`` characters are dealt over the cluster by a shuffle, to be split there.

Defined results: a null text is encoded as an empty one: no ids, empty bytes. Repeated
rows are encoded each, an empty table gives no rows. A null id stays null. Extra columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.llm import textkernel as tk
from leafpress.llm.common import table

#: Characters of a chunk, and how far it reaches into the next one.
CHUNK_CHARS, OVERLAP = 1 << 12, 1 << 8
#: Longer texts have their chunks split by several tasks.
SPREAD_CHARS = 1 << 21
#: A boundary this close to a chunk's end may depend on text beyond it: a contraction
#: looks three characters ahead, a run of one class one character.
MARGIN = 4
_CACHE_PIECES = 60_000
_CODES_AT_ONCE = 1 << 14


def _ranges(points: list[int]) -> str:
    spans: list[list[int]] = []
    for p in points:
        if spans and spans[-1][1] == p - 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in spans)


class _Pieces(dict):
    """piece -> its ids, computed when first asked for."""

    def __init__(self, encode_piece):
        self.encode_piece = encode_piece

    def __missing__(self, piece: str) -> list[int]:
        ids = self[piece] = self.encode_piece(piece.encode())
        return ids


class Codec:
    """One vocabulary: split pattern, ranks, bytes of each id."""

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        core = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for raw, rank in ranks.items():
            self.bytes_of[rank] = raw
        self.decimal = list(map(str, range(len(self.bytes_of))))
        self.pieces = _Pieces(core.encode_single_piece)
        self.split, self.odd, self.split_odd = self._patterns(pattern)

    @staticmethod
    def _patterns(pattern: str):
        """The pattern as is, characters whose class differs between the two regular-expression
        engines (they know different Unicode versions), and a pattern with the encoder's classes."""
        import tiktoken

        raw = {bytes([i]): i for i in range(256)}
        odd: dict[str, list[int]] = {}
        for kind in (r"\p{L}", r"\p{N}"):
            theirs = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=raw, special_tokens={})
            differ: list[int] = []
            for start in range(0, 0x110000, _CODES_AT_ONCE):
                some = "".join(map(chr, (c for c in range(start, start + _CODES_AT_ONCE) if not 0xD800 <= c < 0xE000)))
                differ += map(ord, set(bytes(theirs.encode_ordinary(some)).decode()) ^ set(regex.findall(kind, some)))
            odd[kind] = sorted(differ)
        both = sorted({*odd[r"\p{L}"], *odd[r"\p{N}"]})
        if not both:
            return regex.compile(pattern), None, None
        letters, numbers = (rf"[{k}~~[{_ranges(v)}]]" if v else k for k, v in odd.items())
        fixed = _outside_sets(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{_ranges(both)}]]"), letters, numbers)
        return regex.compile(pattern), re.compile(f"[{_ranges(both)}]"), regex.compile(fixed, regex.V1)

    def pattern_for(self, text: str):
        return self.split if text.isascii() or self.odd is None or not self.odd.search(text) else self.split_odd

    def encode(self, pieces: Iterable[str]) -> list[int]:
        """Ids of pieces, each encoded separately, without special tokens."""
        if len(self.pieces) > _CACHE_PIECES:
            self.pieces.clear()
        return list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest()

    def split_text(self, text: str) -> list[str]:
        """The pieces; they tile the text."""
        return self.pattern_for(text).findall(text)


def _outside_sets(pattern: str, letters: str, numbers: str) -> str:
    """Replace the two classes in a pattern except inside its bracketed sets."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        two = pattern[i : i + 5]
        if depth == 0 and two in (r"\p{L}", r"\p{N}"):
            out.append(letters if two == r"\p{L}" else numbers)
            i += 5
            continue
        if pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        depth += (pattern[i] == "[") - (pattern[i] == "]")
        out.append(pattern[i])
        i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(rank_file: str | None = None, pattern: str | None = None) -> Codec:
    """The vocabulary, loaded once per Python worker. None: the multilingual one of the tokenizer package."""
    import public_tokenizers as files

    return Codec(rank_file or files.path("byte_bpe_multi_50k.tiktoken"), pattern or files.PATTERN)


def cut(text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(offset, chunk text); each chunk reaches ``overlap`` characters into the next one."""
    return [(at, text[at : at + chunk + overlap]) for at in range(0, max(1, len(text)), chunk)]


def split_chunk(c: Codec, text: str, last: bool) -> list[str]:
    """The chunk's pieces, without those that end where text beyond the chunk may move the boundary."""
    pieces = c.split_text(text)
    if not last:
        at = len(text)
        while pieces and at > len(text) - MARGIN:
            at -= len(pieces.pop())
    return pieces


def stitch(parts: list[tuple[int, list[str]]]) -> tuple[list[list[str]], int | None]:
    """The pieces that each chunk (offset, pieces) contributes, up to the first boundary in the overlap on which it and the
    next chunk agree; and the number of the first chunk that shares none with its successor, or None."""
    out: list[list[str]] = []
    skip = 0  # pieces of a chunk that its predecessor has
    for k, (at, pieces) in enumerate(parts):
        if k + 1 == len(parts):
            out.append(pieces[skip:])
            return out, None
        start, theirs = parts[k + 1]
        ends = list(accumulate(map(len, pieces), initial=at))
        i = max(skip, bisect_left(ends, start))
        others = list(accumulate(map(len, theirs), initial=start))
        common = set(others)
        j = next((j for j in range(i, len(ends)) if ends[j] in common), None)
        if j is None:
            return out, k
        out.append(pieces[skip:j])
        skip = bisect_left(others, ends[j])
    return out, None


def joined_pieces(c: Codec, text: Callable[[], str], parts: list[tuple[int, list[str]]]) -> list[str]:
    """All pieces of a text from its chunks. text() gives the text, which is only looked at where an overlap holds no common
    boundary: there splitting starts again at the last agreed one, over more and more characters."""
    whole: list[str] = []
    while True:
        out, broken = stitch(parts)
        for some in out:
            whole += some
        if broken is None:
            return whole
        # A stretch from the last agreed boundary on, twice as long each time, takes the place of the chunks that it covers.
        at = sum(map(len, whole))
        size, full = 2 * (parts[min(broken + 1, len(parts) - 1)][0] + OVERLAP - at), text()
        while True:
            end = min(len(full), at + size)
            pieces = split_chunk(c, full[at:end], end == len(full))
            rest = [p for p in parts[broken + 1 :] if p[0] >= at and p[0] < at + sum(map(len, pieces))]
            after = [p for p in parts[broken + 1 :] if p[0] >= at + sum(map(len, pieces))]
            if end == len(full):
                parts = [(at, pieces)]
                break
            if rest and stitch([(at, pieces), rest[-1]])[1] is None:
                parts = [(at, pieces), rest[-1], *after]
                break
            size *= 2


_RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


def _row(c: Codec, ids: list[int], keep_ids: bool) -> tuple:
    return len(ids), c.digest(ids), hashlib.sha256(c.decode(ids)).hexdigest(), ids if keep_ids else None


def encode_text(c: Codec, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> list[int]:
    """Ids of a text, chunk by chunk."""
    chunks = cut(text, chunk, overlap)
    return c.encode(joined_pieces(c, lambda: text, [(at, split_chunk(c, some, k + 1 == len(chunks))) for k, (at, some) in enumerate(chunks)]))


def encode_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rank_file: str | None = None,
    keep_ids: bool = True,
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP,
    spread_chars: int = SPREAD_CHARS,
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, ids) for each row; ids null unless ``keep_ids``."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file)
        for batch in batches:
            for b, texts in tk.slices(batch, "_text"):
                n, ids_hash, decoded, ids = zip(*(_row(c, encode_text(c, t, chunk_chars, overlap), keep_ids) for t in texts))
                yield pa.RecordBatch.from_arrays(
                    [b["_id"], pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded, pa.string()), pa.array(ids, pa.list_(pa.int32()))],
                    ["_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
                )

    def to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, (text,) in tk.slices(batch, "_text", 0):
                for k, (at, some) in enumerate(cut(text, chunk_chars, overlap)):
                    own = [*b.columns[:-1], pa.array([k], pa.int32()), pa.array([at + chunk_chars >= len(text)]), pa.array([some])]
                    yield pa.RecordBatch.from_arrays(own, ["_id", "r1", "r2", "rows", "k", "last", "text"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file)
        for batch in batches:
            for b, texts in tk.slices(batch, "text"):
                sizes = [list(map(len, split_chunk(c, t, last))) for t, last in zip(texts, b["last"].to_pylist())]
                yield b.append_column("sizes", pa.array(sizes, pa.list_(pa.int32())))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        c = codec(rank_file)
        group = group.sort_values("k")
        parts = []
        for k, text, sizes in zip(group["k"], group["text"], group["sizes"]):
            ends = list(accumulate(map(int, sizes), initial=0))
            parts.append((int(k) * chunk_chars, [text[i:j] for i, j in zip(ends, ends[1:])]))
        whole = lambda: "".join(t[:chunk_chars] for t in group["text"].iloc[:-1]) + group["text"].iloc[-1]
        row = _row(c, c.encode(joined_pieces(c, whole, parts)), keep_ids)
        return pd.DataFrame([(group["_id"].iloc[0], group["rows"].iloc[0], *row)], columns=["_id", "rows", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    is_long = F.char_length("_text") > spread_chars
    key = ["_id", "r1", "r2"]
    # Rows that repeat id and text are split once; their key is the same whenever a lost task runs again.
    spread = slim.where(is_long).withColumns({"_id": F.col("_id").cast("string"), "r1": F.xxhash64("_text"), "r2": F.xxhash64(F.lit("row"), "_text")})
    spread = spread.groupBy(*key).agg(F.count("*").alias("rows"), F.first("_text").alias("_text"))
    chunk_schema = "_id string, r1 long, r2 long, rows long, k int, last boolean, text string"
    long_rows = (
        spread.mapInArrow(to_chunks, chunk_schema)
        .repartition(*key, "k")
        .mapInArrow(split, f"{chunk_schema}, sizes array<int>")
        .groupBy(*key)
        .applyInPandas(join, f"_id string, rows long, {_RESULT}")
        .withColumns({"_id": F.col("_id").cast(kind), "_copy": F.explode(F.sequence(F.lit(1).cast("long"), "rows"))})
        .drop("rows", "_copy")
    )
    out = slim.where(~is_long).mapInArrow(within, f"_id {kind}, {_RESULT}").unionByName(long_rows)
    return out.withColumnRenamed("_id", id_col)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode_documents(docs, keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
