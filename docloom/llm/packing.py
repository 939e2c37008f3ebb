"""Best-fit packing of tokenized documents into sequences of a fixed length.

Hierarchical residual packing: pieces are dealt over groups of bounded size;
each group packs its items best-fit, longest first, and emits the bins that
are nearly full. Underfull bins go up one level of a tree as single items, are
dealt over fewer groups, and are packed again, until one group is left or a
round cannot shrink the number of groups any more. Every group but the last round's leaves only bins of
`NEARLY_FULL` of the capacity and more behind. Where rounds end with several groups, about as many underfull
bins are left as the groups hold items: bins over half full, of which no two fit together, but for one a group at most. So many sequences this can cost.

A document's ids are those of the tokenizer, then `end_id`. Documents longer
than `capacity` are cut into pieces of `capacity` ids, of which the first may be
shorter. Nothing is dropped or padded.

Defined cases: null and empty texts give one piece with the end id alone;
repeated rows are packed as often as they occur; a null id stays null; other
columns are ignored, whatever their names; a text of any length is tokenized whole; items of equal length go in the order
of their rows; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import give_back, saved

#: Distinct chunks of text whose ids a worker remembers; beyond, it forgets the later half.
REMEMBERED = 400_000
#: Text on which two encoders of one vocabulary must agree.
PROBE = "It's 12 o'clock; élan vital!! naïve 中文 \U0001f44d  <|endoftext|> don't\n\n  x_y = {'a': [1, 2.50]}\t\x85 "
#: Items in one group of one round.
GROUP_ITEMS = 20_000
#: Groups of one round that meet in one group of the next.
FAN_IN = 8
#: A bin with this share of the capacity or more is emitted at once.
NEARLY_FULL = 0.985

_ODD_SPACE = re.compile(r"[^\S \n]")


def tokenizer_of(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@cache
def probe_ids(path: str) -> tuple[int, ...]:
    """The tokenizer's ids of PROBE."""
    ids = tuple(tokenizer_of(path).encode(PROBE, add_special_tokens=False).ids)
    give_back()
    return ids


class IdEncoder:
    """Ids of texts, as little-endian 32-bit bytes.

    The tokenizer's rules for words split a text before any space between two characters that are
    not white space, so the ids of a text are those of its space-led chunks, one after
    the other, and each distinct chunk is encoded once. Where probe_ids are given and the ranks give them, too, the tokenizer is not loaded.
    """

    def __init__(self, path: str, ranks: str | None = None, special: bool = False, probe: tuple[int, ...] | None = None):
        self.fast = self.same_by_ranks(ranks, probe or probe_ids(path)) if ranks else None
        self.tokenizer = tokenizer_of(path) if special or not self.fast else None
        own = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.special = {c: array("I", [self.tokenizer.token_to_id(c)]).tobytes() for c in own}
        self.at_special = re.compile("(" + "|".join(re.escape(c) for c in sorted(own, key=len, reverse=True)) + ")") if own else None
        if self.fast:
            self.tokenizer = None
        self.spaced: dict[str, bytes] = {}  # by the chunk without its leading space
        self.plain: dict[str, bytes] = {}

    def same_by_ranks(self, ranks: str, probe: tuple[int, ...]):
        """A quicker encoder of the same vocabulary, given as ranks; None unless it gives the tokenizer's ids on PROBE."""
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        return fast.encode_ordinary if tuple(fast.encode_ordinary(PROBE)) == probe else None

    def ids(self, chunk: str) -> bytes:
        got = self.fast(chunk) if self.fast else self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return array("I", got).tobytes()

    def learn_plain(self, chunks: set[str]) -> None:
        for c in chunks.difference(self.plain):
            self.plain[c] = self.ids(c)

    def learn_spaced(self, chunks: set[str]) -> None:
        for c in chunks.difference(self.spaced):
            self.spaced[c] = self.ids(" " + c)

    def forget(self) -> None:
        for known in (self.plain, self.spaced):
            if len(known) > REMEMBERED:  # what came first comes most
                for c in list(islice(known, REMEMBERED // 2, None)):
                    del known[c]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. With `special`, the strings of special tokens stand for their ids; else they are text like any other."""
        if not self.at_special or not any(map(self.at_special.search, texts)):
            return self.encode_plain(texts)
        split = [self.at_special.split(t) for t in texts]
        plain = iter(self.encode_plain([x for parts in split for x in parts[::2]]))
        return [b"".join(self.special[x] if i % 2 else next(plain) for i, x in enumerate(parts)) for parts in split]

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        self.forget()
        split: list[tuple[list[str], list[str]]] = []  # plain chunks, then spaced ones
        for t in texts:
            if "  " in t or " \n" in t or "\n " in t or t[-1:] == " " or _ODD_SPACE.search(t):
                chunks = [""]
                for p in t.split(" "):
                    if p and not p[0].isspace() and chunks[-1] and not chunks[-1][-1].isspace():
                        chunks.append(" " + p)
                    else:
                        chunks[-1] += " " + p
                chunks[0] = chunks[0][1:]
                split.append((chunks, []))
            else:
                head, *tail = t.split(" ")
                split.append(([head], tail))
        self.learn_plain({c for head, _ in split for c in head})
        self.learn_spaced(set().union(*[tail for _, tail in split]))
        plain, spaced = self.plain.__getitem__, self.spaced.__getitem__
        return [b"".join(map(plain, head)) + b"".join(map(spaced, tail)) for head, tail in split]


_ENCODERS: dict[tuple[str, bool], IdEncoder] = {}


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; ids are 4 bytes each."""
    n = len(ids) // 4
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, tokenizer: str, ranks: str | None, capacity: int, end_id: int, id_col: str, text_col: str, special: bool = False) -> DataFrame:
    id_type = docs.schema[id_col].dataType
    schema = f"{id_col} {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long"
    probe = probe_ids(tokenizer) if ranks else None  # on the driver, so that no worker has two encoders

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, special) not in _ENCODERS:
            give_back()
            _ENCODERS[tokenizer, special] = IdEncoder(tokenizer, ranks, special, probe)
        encoder, end = _ENCODERS[tokenizer, special], np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            rows: list[int] = []
            out: list[tuple[int, int, int, int]] = []
            for at in range(0, b.num_rows, 256):
                texts = [t or "" for t in b.column(1).slice(at, 256).to_pylist()]
                for i, ids in enumerate(encoder.encode(texts)):
                    ids += end
                    for k, (start, n) in enumerate(pieces_of(ids, capacity)):
                        rows.append(at + i)
                        out.append((k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                [id_col, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: each item, longest first, goes where the least room is left over."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    with_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted, those that some bin has
    bins: list[list[int]] = []
    for i in order:
        n = lengths[i]
        at = bisect_left(rooms, n)
        if at == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            b = with_room[room].pop()
            if not with_room[room]:
                del with_room[room], rooms[at]
        bins[b].append(i)
        if left := room - n:
            if left in with_room:
                with_room[left].append(b)
            else:
                with_room[left] = [b]
                rooms.insert(bisect_left(rooms, left), left)
    return bins


ITEM = "length int, rows array<long>, offsets array<int>"


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """items (row long, length): rows (row, sequence_id, offset). row is unique."""
    full = int(capacity * NEARLY_FULL)

    def group(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("first", "ascending")])
        lengths = table.column("length").to_pylist()
        rows, offsets = table.column("rows").to_pylist(), table.column("offsets").to_pylist()
        last = table.column("last")[0].as_py()
        out: dict[str, list] = {"done": [], "length": [], "rows": [], "offsets": []}
        for members in best_fit(lengths, capacity):
            fill, r, o = 0, [], []
            for i in members:
                r += rows[i]
                o += [x + fill for x in offsets[i]]
                fill += lengths[i]
            out["done"].append(last or fill >= full)
            out["length"].append(fill)
            out["rows"].append(r)
            out["offsets"].append(o)
        return pa.table(out, schema=pa.schema([("done", pa.bool_()), ("length", pa.int32()), ("rows", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32()))]))

    level = items.selectExpr("cast(length as int) as length", "array(row) as rows", "array(0) as offsets")
    n = items.count()
    groups = max(1, -(-n // GROUP_ITEMS))
    done: list[DataFrame] = []
    while True:
        dealt = level.selectExpr("length", "rows", "offsets", "rows[0] as first", f"{str(groups == 1).lower()} as last", f"pmod(xxhash64(rows[0], {groups}), {groups}) as dealt")
        packed = saved(dealt.groupBy("dealt").applyInArrow(group, "done boolean, " + ITEM), "bins")
        done.append(packed.where("done").drop("done"))
        if groups == 1:
            break
        level = packed.where("not done").drop("done")
        left = level.count()
        if not left:
            break
        fewer = max(-(-groups // FAN_IN), -(-left // GROUP_ITEMS))
        if fewer >= groups:
            done.append(level)
            break
        groups = fewer
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.selectExpr("rows[0] as sequence_id", "inline(arrays_zip(rows, offsets))").selectExpr("rows as row", "sequence_id", "cast(offsets as long) as offset")


def packed_sequences(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer: file of the tokenizer; ranks: its vocabulary as ranks, if there is such a file, for a quicker encoder; special: whether
    strings of special tokens in a text stand for their ids (by default they are ordinary text, as the vocabularies' README has it)."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = saved(token_pieces(docs, str(tokenizer), ranks and str(ranks), capacity, end_id, id_col, text_col, special).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces.select("row", "length"), capacity), "row").select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
