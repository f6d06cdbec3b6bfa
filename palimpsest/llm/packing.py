"""Best-fit packing of documents' tokens into fixed-length sequences, by hierarchical residual packing.

Documents become token ids, each ended by id 0, and are cut only where longer than a sequence. Every task
packs its own pieces by best fit, longest first; bins that are nearly full are done, and the others travel
on as items of their fill, to fewer and fewer groups that pack them again, until one group has seen all that
could still combine. Bins that don't fit beside even the least one stay behind. Only where GROUP keeps the
groups from shrinking does a round that combines hardly any end it.

Null texts count as empty: they have the one id 0. Bytes that aren't UTF-8 count as U+FFFD. Repeated rows are packed each. A document of any length
is cut whole. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, readable, small_batches, worker_cache

CAPACITY = 2048
#: Bins with less room than this are emitted. Must be 1 or more.
ROOM = 8
#: Pieces that one task packs at a time, and residual bins of one group.
GROUP = 200_000
#: Pieces whose ids a Python worker remembers; about 0.06 GB.
CACHE = 300_000
#: Latin letters with one lower case each, and plain punctuation after them.
_FORM = r"^(?P<head>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,;:!?*$%&#|()]*)$"

_WORD = re.compile("[a-zß-öø-ÿ]+")
#: The characters that stand for bytes without a printable one: those from 256 on, in order.
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


# The settings of a tokenizer for which Encoder's short cuts hold.
_SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def has_short_cuts(settings: dict) -> bool:
    """Whether a tokenizer file is of the kind that Encoder knows: texts are cut as _SETTINGS say, and no added token can lie in a plain piece or across two."""
    odd = lambda x: re.search(r"\s|~", x) or re.fullmatch(r"[A-Za-zÀ-ÖØ-öø-ÿ.,;:!?*$%&#|()]*", x)
    same = all(settings.get(k) == v for k, v in _SETTINGS.items()) and all(settings["model"].get(k) == v for k, v in _MODEL.items())
    return same and not any(odd(t["content"]) for t in settings.get("added_tokens", ()))


class Encoder:
    """Token ids of texts, by short cuts where the tokenizer's settings allow them, else by the tokenizer alone. A text is cut at ASCII white space, which this tokenizer drops before anything
    else, and Latin letters are cut from the plain punctuation after them, as it does, too. Arrow finds the
    distinct pieces of a batch; the tokenizer sees each once, and their ids are laid out by index."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.mark = self._encode("~")
        with open(path, encoding="utf-8") as f:
            self.short = has_short_cuts(json.load(f)) and len(self.mark) == 1

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (32 bits), and where each text's begin and end."""
        if not self.short:
            each = [self._encode(t or "") for t in texts.to_pylist()]
            return np.concatenate([np.empty(0, "<u4"), *each]), np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        words = lists.flatten().dictionary_encode()
        ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        two = pc.extract_regex(words.dictionary, _FORM)
        plain = two.is_valid()
        head = pc.if_else(plain, pc.utf8_lower(two.field(0)), words.dictionary).dictionary_encode()
        tail = pc.if_else(plain, two.field(1), "").dictionary_encode()
        raw = self._learned(head.dictionary.to_pylist() + tail.dictionary.to_pylist())
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        all_, start = np.frombuffer(b"".join(raw), "<u4"), np.cumsum(size) - size
        at = words.indices.to_numpy()
        pair = np.stack([head.indices.to_numpy()[at], tail.indices.to_numpy()[at] + len(head.dictionary)], 1).ravel()
        n = size[pair]
        stop = np.cumsum(n)
        place = np.repeat(start[pair] - (stop - n), n)
        place += np.arange(len(place))
        return all_[place], np.concatenate(([0], stop))[2 * ends]

    def _learned(self, pieces: list[str]) -> list[bytes]:
        known = self.known
        fresh = [p for p in dict.fromkeys(pieces) if p not in known]
        if len(known) + len(fresh) > CACHE:
            self.known = known = {p: known[p] for p in pieces if p in known}
        model, word = self.tokenizer.model.tokenize, _WORD.fullmatch
        rest = []
        for p in fresh:
            if word(p):
                # of these, only the merges are left to do; the tokenizer writes bytes as characters first
                q = p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES)
                known[p] = np.array([t.id for t in model(q)], "<u4").tobytes()
            elif "~" in p:
                known[p] = self._encode(p).tobytes()
            else:
                rest.append(p)
        fresh = rest
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            # one call for many pieces: the mark between them is a piece of its own, whose id no other piece here has
            ids = self._encode(" ~ ".join(part))
            cut = (np.flatnonzero(ids == self.mark[0]) * 4).tolist()
            raw = ids.tobytes()
            known.update(zip(part, [raw[a:b] for a, b in zip([0, *(c + 4 for c in cut)], [*cut, len(raw)])]))
        return [known[p] for p in pieces]

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


def slices(b: pa.RecordBatch, text: int, limit: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `limit` bytes of text, and at least one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy())
    at = 0
    while at < b.num_rows:
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        yield b.slice(at, stop - at)
        at = stop


PIECE = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of each piece."""
    small_batches(docs.sparkSession)
    schema = PIECE | ({"ids": "binary"} if with_ids else {})
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(tokenizer, capacity, with_ids), _ddl(schema))


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in columns.items())


def _pieces(tokenizer: str, capacity: int, with_ids: bool = False):
    """From batches of doc_id, text and any further columns: the pieces, with the further columns of their documents."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"tokenizer {tokenizer}", lambda: Encoder(tokenizer))
        for whole in batches:
            for b in slices(whole, 1):
                out: list[tuple] = []
                row: list[int] = []
                flat, ends = encoder.ids(readable(b.column(1)))
                for i, (doc, first, last) in enumerate(zip(b.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist())):
                    ids = flat[first:last].tobytes() + b"\0\0\0\0"
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        out.append((doc, k, start // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                        row.append(i)
                cols = list(zip(*out)) or [()] * 6
                carried = [c.take(pa.array(row, pa.int64())) for c in b.columns[2:]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, (_, t) in zip(cols, fields)), *carried], [*(n for n, _ in fields), *b.schema.names[2:]])

    return work


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items go longest first, each to the open bin with the least room that holds it."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room
    mask = 0  # bit r: a bin with room r is open
    count = 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, count
            count += 1
        bins[i], offsets[i] = b, capacity - room
        room -= size
        if room:
            open_[room].append(b)
            mask |= 1 << room
    return bins, offsets


#: What packing a partition adds: bin (unique over partitions), at (offset) and fill (of the whole bin).
PLACE = {"bin": "long", "at": "long", "fill": "long"}


def _packed(df: DataFrame, size: str, capacity: int) -> DataFrame:
    """df plus PLACE, packed partition by partition."""
    # a task may run several partitions one after the other, so the partition's number comes with its rows
    return df.withColumn("__partition", F.spark_partition_id()).mapInArrow(_pack_rows(size, capacity), _ddl(dict(df.dtypes) | PLACE))


def _pack_rows(size: str, capacity: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = -1
        held: list[pa.RecordBatch] = []
        for b in [*batches, None]:
            held += [b] if b is not None else []
            n = sum(x.num_rows for x in held)
            if not n or b is not None and n < GROUP:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            base = table["__partition"][0].as_py() << 36 if base < 0 else base
            table = table.drop_columns(["__partition"])
            sizes = table[size].to_numpy()
            bins, offsets = best_fit(sizes, capacity)
            fill = np.bincount(bins, sizes).astype(np.int64)[bins]
            table = table.append_column("bin", pa.array(bins + base)).append_column("at", pa.array(offsets)).append_column("fill", pa.array(fill))
            base += int(bins.max()) + 1
            held = []
            yield from table.to_batches(max_chunksize=50_000)

    return work


def pack(pieces: DataFrame, capacity: int = CAPACITY, room: int = ROOM, fan_in: int = 8) -> DataFrame:
    """pieces (with `length`) plus sequence_id and offset."""
    return _merge(_packed(pieces, "length", capacity), capacity, room, fan_in)


def _merge(packed: DataFrame, capacity: int, room: int = ROOM, fan_in: int = 8) -> DataFrame:
    """The rounds after the first: `packed` has PLACE, for which its other columns plus sequence_id and offset come."""
    scratch = Scratch(packed.sparkSession)
    columns = [c for c in packed.columns if c not in PLACE]
    local = scratch.table(packed)
    # residual bins as items: item (a bin of an earlier round), fill; root and shift follow them from round to round
    left = scratch.cut(local.filter(F.col("fill") <= capacity - room).groupBy("bin").agg(F.first("fill").alias("size")).withColumnRenamed("bin", "item").withColumn("first", F.col("item")).withColumn("shift", F.lit(0).cast("long")))

    def still(bins: DataFrame) -> tuple[int, int]:
        """The most that a bin may hold to fit beside the least one, and how many items hold no more."""
        least = bins.agg(F.min("size")).first()[0]
        most = min(capacity - room, capacity - least) if least is not None else -1
        return most, bins.filter(F.col("size") <= most).select("item").distinct().count()

    most, n = still(left)
    left, done, round_ = left.filter(F.col("size") <= most), [], 0
    groups = max(1, left.rdd.getNumPartitions(), -(-n // GROUP)) if n else 0
    while n:
        was, groups = groups, max(-(-groups // fan_in), -(-n // GROUP))
        # one row an item is packed; the bins of the first round that it holds follow by a join
        items = left.select("item", "size").distinct().repartition(groups, F.xxhash64("item", F.lit(round_)))
        packed = scratch.cut(_packed(items, "size", capacity))
        moved = left.drop("size").join(packed, "item").select("first", (F.col("shift") + F.col("at")).alias("shift"), F.col("item"), "bin", F.col("fill"))
        # a bin's name must not clash with those of other rounds: it takes the least name of what it holds
        name = packed.groupBy("bin").agg(F.min("item").alias("name"))
        moved = scratch.cut(moved.join(name, "bin").select("first", "shift", F.col("name").alias("item"), F.col("fill").alias("size")))
        before, (most, n) = n, still(moved)
        # one group has seen all that is left; where groups can't shrink, bins that hardly combine any more are done as well
        if groups == 1 or groups >= was and n > 0.98 * before:
            done.append(moved)
            break
        done.append(moved.filter(F.col("size") > most))
        left, round_ = moved.filter(F.col("size") <= most), round_ + 1
    if not done:
        return local.withColumnRenamed("bin", "sequence_id").withColumnRenamed("at", "offset").drop("fill")
    where = done[0]
    for d in done[1:]:
        where = where.unionByName(d)
    where = where.select(F.col("first").alias("bin"), "shift", F.col("item").alias("__to"))
    out = local.join(where, "bin", "left")
    return out.select(*columns, F.coalesce("__to", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    small_batches(docs.sparkSession)
    pieces, place = _pieces(tokenizer, capacity), _pack_rows("length", capacity)
    # cut and packed in one pass: two, one after the other, would hold two Python workers a task
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("__partition"))
    return _merge(rows.mapInArrow(lambda batches: place(pieces(batches)), _ddl(PIECE | PLACE)), capacity)
