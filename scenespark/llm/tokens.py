"""Token counts at every prefix (8) and power-of-two packing (7) for byte-level BPE vocabularies.

Both read a vocabulary file of the `tokenizers` library, whose path is a parameter. Texts run through an
encoder built from that very file (vocabulary, merge order, special strings); if the file asks for anything
that this encoder does not do, the library itself encodes.
"""

from __future__ import annotations

import functools
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenespark.llm.common import free_name, lean, table

#: Pre-tokenisation of byte-level BPE (a fixed value of the vocabulary's format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces of text that a worker remembers before it starts afresh.
MEMO = 200_000


def _byte_chars() -> dict[str, int]:
    """The format writes each byte as one printable character: printable Latin-1 as itself, the others from
    U+0100 upwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """ids(text) as the library gives them without added begin or end tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], _byte_chars()
        ranks = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items() if all(c in chars for c in token)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.exact = (
            model.get("type") == "BPE"
            and not spec.get("normalizer")
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
            and all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
            and all(bytes([b]) in ranks for b in range(256))
        )
        self.path, self.ranks = path, ranks
        if self.exact:
            import tiktoken

            self._fast = tiktoken.Encoding("from-file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)
            self._allowed = set(self.special)

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        if self.exact:
            if any(s in text for s in self._allowed):
                return self._fast.encode(text, allowed_special=self._allowed, disallowed_special=())
            return self._fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def pieces(self, raw: bytes) -> list[int]:
        """ids of bytes taken as one pre-token."""
        return self._fast._encode_single_piece(raw)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class PrefixCounter:
    """Exact token counts of every prefix of a text by dynamic programming over bytes.

    A sequence of tokens is the BPE of its bytes if and only if every adjacent pair is the BPE of its own
    bytes. So the encoding of a prefix ends in the one token t that spells the last bytes and fits the last
    token of the shorter prefix before t, and count(prefix) = count(shorter prefix) + 1. Pre-tokens are
    encoded apart, so the programme restarts at each of them with the count so far. Three kinds of cut
    change how a prefix is divided, and are set apart: a cut after the last blank of a run of white space,
    inside a contraction, and inside a special string.
    """

    def __init__(self, enc: Encoder):
        if not enc.exact:
            raise ValueError(f"{enc.path}: prefix counts need a byte-level BPE vocabulary")
        self.enc, self.longest = enc, max(map(len, enc.ranks))
        self.find = regex.compile(SPLIT).findall
        self.blanks = regex.compile(r"\s{2,}(?=\S)").finditer
        self.cut = regex.compile(r"'(?:re|ve|ll)").finditer
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(enc.special, key=len, reverse=True))).finditer if enc.special else lambda text: ()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def _fits(self, a: bytes, b: bytes) -> bool:
        if len(self.pairs) > 2 * MEMO:
            self.pairs.clear()
        ranks = self.enc.ranks
        got = self.pairs[a, b] = self.enc.pieces(a + b) == [ranks[a], ranks[b]]
        return got

    def _run(self, piece: str) -> array:
        """Counts after each code point of one pre-token."""
        raw, ranks, longest = piece.encode(), self.enc.ranks, self.longest
        n, pairs, fits = len(raw), self.pairs, self._fits
        last, count, begin = [b""], [0], 0
        for j in range(1, n + 1):
            # exactly one start fits; most often the last token grows
            t = raw[begin:j]
            if t in ranks and (not begin or (pairs[last[begin], t] if (last[begin], t) in pairs else fits(last[begin], t))):
                last.append(t)
                count.append(count[begin] + 1)
                continue
            for i in range(j - 1, max(0, j - longest) - 1, -1):
                t = raw[i:j]
                if i != begin and t in ranks:
                    if i:
                        ok = pairs.get((last[i], t))
                        if ok is None:
                            ok = fits(last[i], t)
                        if not ok:
                            continue
                    last.append(t)
                    count.append(count[i] + 1)
                    begin = i
                    break
        if n != len(piece):
            count = [0] + [c for c, after in zip(count[1:], raw[1:] + b" ") if after & 0xC0 != 0x80]
        return array("I", count[1:])

    def _piece(self, piece: str) -> bytes:
        """The same as bytes, remembered in two generations: what was not asked for in one is forgotten."""
        got = self.older.get(piece) or array("H", self._run(piece)).tobytes()
        if len(self.memo) > MEMO:
            self.older, self.memo = self.memo, {}
        self.memo[piece] = got
        return got

    def _ordinary(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Counts after each code point, special strings taken as ordinary text; and where pre-tokens start."""
        pieces = self.find(text)
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if lens.max() < 16_000:
            one = self._piece
            own = np.frombuffer(b"".join([self.memo.get(p) or one(p) for p in pieces]), np.uint16).astype(np.int32)
        else:
            own = np.concatenate([np.asarray(self._run(p), np.int32) for p in pieces])
        ends = np.cumsum(lens)
        base = np.cumsum(own[ends - 1]) - own[ends - 1]
        out = own + np.repeat(base, lens).astype(np.int32)
        starts = ends - lens
        for m in self.blanks(text):
            a, b = m.span()  # pre-tokens [a, b - 1) and what starts at b - 1; cut at b, they are one
            out[b - 1] = (out[a - 1] if a else 0) + self._run(text[a:b])[-1]
        if "'" in text:
            for m in self.cut(text):
                k = np.searchsorted(starts, m.start())
                if k < len(starts) and starts[k] == m.start() and lens[k] == 3:
                    out[m.start() + 1] = out[m.start()] + 1
        return out, starts

    def counts(self, text: str) -> np.ndarray:
        """int32 array: entry i is the number of tokens of the first i + 1 code points."""
        parts, base, at = [], 0, 0
        for m in self.special(text):
            a, b = m.span()
            plain, starts = self._ordinary(text[at:a])
            p = int(starts[-1]) if len(starts) else 0
            before = int(plain[p - 1]) if p else 0
            if p and p < len(plain):  # counts just before p count p's own white space apart
                before = int(plain[-1]) - int(self._run(text[at + p : a])[-1])
            inside = self._ordinary(text[at + p : b])[0][a - at - p : -1] + before
            total = (int(plain[-1]) if len(plain) else 0) + 1
            parts += [plain + base, inside + base, np.asarray([base + total], np.int32)]
            base, at = base + total, b
        parts.append(self._ordinary(text[at:])[0] + base)
        return np.concatenate(parts).astype(np.int32)


@functools.lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(encoder(path))


def squeeze(counts: np.ndarray) -> bytes:
    """Prefix counts as compressed differences; the first byte tells their width."""
    steps = np.diff(counts, prepend=0)
    width = 1 if not len(steps) or (steps.min() >= -128 and steps.max() <= 127) else 4
    return bytes([width]) + zlib.compress(steps.astype(f"<i{width}").tobytes(), 1)


def unsqueeze(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob[1:]), f"<i{blob[0]}"), dtype=np.int64)


def prefix_counts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with n_bytes, n_tokens and prefix_counts (see `unsqueeze`; read it with `tokens_at` and
    `longest_prefix`). Other columns stay; a clashing one makes the new name end in an underscore.

    Null and empty text: 0 bytes, 0 tokens, an empty array. Texts of any length are handled whole, one at a
    time. Repeated rows each get their own result; an empty table gives an empty one.
    """
    names = {k: free_name(df, k) for k in ("n_bytes", "n_tokens", "prefix_counts")}
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(names["n_bytes"], T.LongType()), T.StructField(names["n_tokens"], T.LongType()), T.StructField(names["prefix_counts"], T.BinaryType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            n_bytes, n_tokens, blobs = [], [], []
            for x in batch.column(at):
                t = x.as_py() or ""
                counts = c.counts(t)
                n_bytes.append(len(t.encode()))
                n_tokens.append(int(counts[-1]) if len(counts) else 0)
                blobs.append(squeeze(counts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(blobs, pa.binary())], names=[*batch.schema.names, *names.values()])

    return df.mapInArrow(count, schema)


@F.udf(T.LongType())
def tokens_at(blob, n_chars):
    """Tokens of the first n_chars code points (all, if the text is shorter), from stored counts alone."""
    if blob is None or n_chars is None:
        return None
    counts = unsqueeze(blob)
    k = min(int(n_chars), len(counts))
    return int(counts[k - 1]) if k > 0 else 0


@F.udf(T.LongType())
def longest_prefix(blob, budget):
    """Code points of the longest prefix of at most `budget` tokens, from stored counts alone. (Counts may
    fall as a prefix grows; the longest one that fits is meant.)"""
    if blob is None or budget is None:
        return None
    fits = np.flatnonzero(unsqueeze(blob) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def binary_lengths(n: int, most: int) -> list[int]:
    """n as full pieces of `most` and then falling powers of two."""
    out = [most] * (n // most)
    rest = n % most
    for k in range(most.bit_length() - 2, -1, -1):
        if rest >> k & 1:
            out.append(1 << k)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack(df: DataFrame, path: str, most: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Sequences by power-of-two decomposition: a document's ids and `end_id`, cut into pieces of `most`
    and then the powers of two of the rest. A piece is a sequence of its own: none crosses documents and
    none needs padding. Sequences of one length form a bucket; `bucket` is that length and the high bits of
    sequence_id, so a batch takes one bucket (write with partitionBy("bucket")).

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, and
    token_ids if with_ids. Null or empty text: one piece that holds end_id. Null doc_id is kept. Repeated
    rows are packed each on its own. One pass, no shuffle; sequence_id is unique in a result.
    """
    if most & (most - 1) or most < 1:
        raise ValueError("most must be a power of two")
    schema = PIECES + (", token_ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            cols: list[list] = [[] for _ in range(6 if with_ids else 5)]
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.asarray([*enc.ids(x.as_py() or ""), end_id], "<u4")
                at = 0
                for n in binary_lengths(len(ids), most):
                    part = ids[at : at + n]
                    row = [d, at, n, zlib.crc32(part.tobytes()), len(ids)]
                    for c, v in zip(cols, [*row, part.astype(np.int32)] if with_ids else row):
                        c.append(v)
                    at += n
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "token_ids"][: len(cols)])

    pieces = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(cut), schema)
    k = (F.length(F.bin("length")) - 1).cast("long")
    out = pieces.withColumn("sequence_id", F.shiftleft(k, 58) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", F.col("length").cast("int"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", *(["token_ids"] if with_ids else []))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), F.xxhash64("prefix_counts").alias("prefix_digest"))
