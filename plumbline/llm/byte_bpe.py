"""Byte-level BPE by Spark higher-order functions over a literal rank map.

A distinct word is a match of the split pattern. Its UTF-8 bytes become an array
of one-byte pieces, and a fold merges the adjacent pair of least rank, leftmost
first, until none has a rank; ranks of pairs are carried along, so a merge looks
up two new ones. A byte is written as the Latin-1 character of its value, and the
rank map is a literal: an array of small maps picked by the crc32 of the key,
since Spark looks up map keys one after the other.

Every distinct word of a region, about 2 billion characters, is folded once. A task
splits its texts into words and writes them in chunks of about ``chars``
characters: the texts as places in the chunk's list of words, the most frequent
first, and that list by buckets of the words' crc32. Chunks fall into regions by
hash. A task takes the lists of a region and bucket one after the other, finds
their distinct words, folds them, and the ids go back to their chunks by shuffle,
where texts become ids; what a task wrote is bucketed by chunk, so texts are not
shuffled. Nothing is broadcast or collected, since a word is in a chunk's list
once no word is hot, and a task holds one region's lists of one bucket at any size
of input. Lists and texts travel as compressed arrays, a few for each chunk.

Texts are first cut before single spaces that stand between two other characters,
where the pattern always cuts; what stands between two cuts is split once a chunk.
Decoding looks up each id's bytes in a literal array and concatenates them.

Defined cases: null text is empty and has no ids; a word of n bytes costs up to
n merges over arrays of n, over 512 bytes of the root of n; repeated rows are encoded each; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import gather, give_back, let, pack, stored_by, unpack

BUCKETS = 32_768
#: Words of more bytes are folded in blocks.
LONG = 512
#: Chunks whose words are folded together, about, and lists that a chunk's words are cut into at most.
REGION, LISTS = 128, 256
BLOCK = "struct<toks:array<int>,pairs:array<int>,least:int>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.split_pattern = pattern
        buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        pieces = [""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            shown = token.decode("latin-1")
            buckets[zlib.crc32(shown.encode()) % BUCKETS][shown] = rank
            pieces[rank] = shown
        # folded to literals by the optimizer
        self.ranks = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
        self.pieces = F.from_json(F.lit(json.dumps(pieces)), "array<string>")

    def rank(self, piece: Column, ranks: Column) -> Column:
        bucket = F.pmod(F.crc32(piece.cast("binary")), F.lit(BUCKETS)).cast("int")
        return F.try_element_at(F.get(ranks, bucket), piece)

    def fold(self, word: Column, ranks: Column, pieces: Column) -> Column:
        """Ids of one word; ``ranks`` and ``pieces`` are this object's, bound once."""
        none = F.array().cast("array<int>")

        def merge(acc: Column, _: Column) -> Column:
            toks, pairs = acc["toks"], acc["pairs"]

            def at_pair(at: Column) -> Column:  # from 1; the pair of toks at and at + 1
                def with_piece(piece: Column) -> Column:
                    left = self.rank(F.concat(F.get(toks, at - 2), piece), ranks)
                    right = self.rank(F.concat(piece, F.get(toks, at + 1)), ranks)
                    return F.struct(
                        F.filter(F.transform(toks, lambda t, i: F.when(i == at - 1, piece).otherwise(t)), lambda t, i: i != at).alias("toks"),
                        F.filter(F.transform(pairs, lambda r, i: F.when(i == at - 2, left).when(i == at, right).otherwise(r)), lambda r, i: i != at - 1).alias("pairs"),
                    )

                return F.when(at.isNull(), acc).otherwise(let(F.concat(F.get(toks, at - 1), F.get(toks, at)), with_piece))

            return let(F.array_position(pairs, F.array_min(pairs)).cast("int"), at_pair)

        def of(shown: Column) -> Column:
            size = F.length(shown)
            start = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(shown, i, F.lit(1)))
            pairs = F.transform(F.sequence(F.lit(1), size - 1), lambda i: self.rank(F.substring(shown, i, F.lit(2)), ranks))
            first = F.struct(start.alias("toks"), pairs.alias("pairs"))
            short = F.aggregate(F.sequence(F.lit(2), size), first, merge, lambda acc: F.transform(acc["toks"], lambda t: self.rank(t, ranks)))
            folded = F.when(size > LONG, self.fold_long(shown, ranks, pieces)).otherwise(short)
            return let(self.rank(shown, ranks), lambda whole: F.when(whole.isNotNull(), F.array(whole)).when(size > 1, folded).otherwise(none))

        return let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), of)

    def fold_long(self, shown: Column, ranks: Column, pieces: Column) -> Column:
        """Ids of one long word: ids and their pairs' ranks are kept in blocks of about the root of its length.

        A merge looks for the least rank among blocks, then in its block, and makes
        that block and its neighbours anew; a block's last pair reaches into the next.
        A fold copies its state at every step, so that is ids, not text, and nothing
        that holds all blocks goes through ``let``, which copies too.
        """
        size = F.length(shown)
        block = lambda ids, pairs: F.struct(ids.alias("toks"), pairs.alias("pairs"), F.array_min(pairs).alias("least"))
        pair = lambda a, b: self.rank(F.concat(F.get(pieces, a), F.get(pieces, b)), ranks)

        def cut(ids: Column, pairs: Column) -> Column:
            width = F.ceil(F.sqrt(size.cast("double"))).cast("int")
            return F.transform(F.sequence(F.lit(1), size, width), lambda a: block(F.slice(ids, a, width), F.slice(pairs, a, width))).cast(f"array<{BLOCK}>")

        def rebuilt(some: Column, g: Column, rank: Column) -> Column:
            """The blocks with the pair at g, which has this rank, made one."""

            def of(ids: Column, pairs: Column) -> Column:
                left, right = pair(F.get(ids, g - 1), rank), pair(rank, F.get(ids, g + 2))
                made = F.filter(F.transform(ids, lambda t, i: F.when(i == g, rank).otherwise(t)), lambda t, i: i != g + 1)
                rest = F.filter(F.transform(pairs, lambda r, i: F.when(i == g - 1, left).when(i == g + 1, right).otherwise(r)), lambda r, i: i != g)
                # where each block ends; the one that held the right part is one shorter
                ends = F.transform(some, lambda x, k: F.aggregate(F.slice(some, F.lit(1), k + 1), F.lit(0), lambda n, y: n + F.size(y["toks"])))
                bounds = F.transform(ends, lambda e: e - F.when(e > g + 1, 1).otherwise(0))

                def blocks(ids: Column, pairs: Column, bounds: Column) -> Column:
                    start = lambda k: F.coalesce(F.get(bounds, k - 1), F.lit(0))
                    own = F.transform(bounds, lambda e, k: block(F.slice(ids, start(k) + 1, e - start(k)), F.slice(pairs, start(k) + 1, e - start(k))))
                    return F.filter(own, lambda x: F.size(x["toks"]) > 0)

                return let(made, lambda m: let(rest, lambda r: let(bounds, lambda b: blocks(m, r, b))))

            flat = lambda name: F.flatten(F.transform(some, lambda x: x[name]))
            return let(flat("toks"), lambda t: let(flat("pairs"), lambda p: of(t, p)))

        def merge(acc: Column, _: Column) -> Column:
            leasts = F.transform(acc, lambda x: x["least"])
            rank = F.array_min(leasts)
            own = F.array_position(leasts, rank).cast("int")
            before = lambda own: F.greatest(own - 1, F.lit(1))

            def near(own: Column, rank: Column) -> Column:
                some = F.slice(acc, before(own), own - before(own) + 3)  # the block before, its own, and two after it
                lead = F.when(own > 1, F.size(F.get(acc, own - 2)["toks"])).otherwise(0)
                at = lead + F.array_position(F.get(acc, own - 1)["pairs"], rank).cast("int") - 1
                return let(some, lambda s: let(at, lambda g: rebuilt(s, g, rank)))

            fresh = let(own, lambda o: let(rank, lambda r: near(o, r))).cast(f"array<{BLOCK}>")
            return F.when(rank.isNull(), acc).otherwise(F.concat(F.slice(acc, F.lit(1), before(own) - 1), fresh, F.slice(acc, own + 3, F.size(acc))))

        ids = F.transform(F.sequence(F.lit(1), size), lambda i: self.rank(F.substring(shown, i, F.lit(1)), ranks))
        pairs = F.transform(F.sequence(F.lit(1), size), lambda i: F.when(i < size, self.rank(F.substring(shown, i, F.lit(2)), ranks)))
        start = let(ids, lambda t: let(pairs, lambda p: cut(t, p)))
        return F.aggregate(F.sequence(F.lit(2), size), start, merge, lambda acc: F.flatten(F.transform(acc, lambda x: x["toks"])))

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids."""
        return F.encode(F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), ""), "ISO-8859-1")

    def encode(self, documents: DataFrame, chars: int = 1 << 24) -> DataFrame:
        """doc_id, ids (array of int) of every whole text."""
        kind, pattern = documents.schema["doc_id"].dataType.simpleString(), self.split_pattern
        parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = min(parts, LISTS)
        split = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
            lambda batches: chunked(batches, pattern, buckets, chars), f"chunk long, bucket int, doc_ids array<{kind}>, packed binary"
        )
        split = stored_by(split, "words", "chunk")
        # words are told apart within regions of chunks, so that no task's lists grow with the input
        regions = max(1, -(-split.where(F.col("bucket").isNull()).select("chunk").distinct().count() // REGION))
        region = F.pmod(F.xxhash64("chunk"), F.lit(regions))
        words = split.where(F.col("bucket").isNotNull()).select("chunk", (region * buckets + F.col("bucket")).alias("list"), "packed")
        words = words.repartitionById(parts, F.pmod("list", F.lit(parts)).cast("int")).sortWithinPartitions("list")
        folded = let(self.ranks, lambda ranks: let(self.pieces, lambda pieces: self.fold(F.col("word"), ranks, pieces))).alias("ids")
        found = words.mapInArrow(distinct_words, "word string, chunks array<long>, places array<int>").select(folded, "chunks", "places").mapInArrow(by_chunk, "chunk long, packed binary")
        texts = split.where(F.col("bucket").isNull()).select("chunk", "doc_ids", "packed")
        return texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(put_together, f"doc_id {kind}, ids array<int>")

    def digests(self, encoded: DataFrame) -> DataFrame:
        """doc_id, n_tokens, ids_sha256 (decimal ids, comma-joined) and decoded_sha256 (bytes that the ids stand for)."""
        shown = F.array_join(F.col("ids").cast("array<string>"), ",")
        return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(shown.cast("binary"), 256).alias("ids_sha256"), F.sha2(self.decode(F.col("ids")), 256).alias("decoded_sha256"))


class Words(dict):
    """Places of the words of a piece of text, as bytes, found once; ``listed`` holds the words in order of place."""

    def __init__(self, find: Callable[[str], list[str]], lead: str, listed: dict[str, bytes]) -> None:
        self.find, self.lead, self.listed = find, lead, listed

    def __missing__(self, piece: str) -> bytes | None:
        if self.lead and (not piece or piece[0].isspace() or piece[-1].isspace()):
            self[piece] = None  # white space beside a space is not cut
            return None
        places = []
        for word in self.find(self.lead + piece):
            place = self.listed.get(word)
            if place is None:
                place = self.listed[word] = len(self.listed).to_bytes(4, "little")
            places.append(place)
        self[piece] = made = b"".join(places)
        return made


def units_of(text: str) -> list[str]:
    """Parts between cuts, spaces included; white space beside a space keeps it inside a part."""
    units, run = [], []
    for piece in text.split(" "):
        if run and run[-1] and not run[-1][-1].isspace() and piece and not piece[0].isspace():
            units.append(" ".join(run))
            run = []
        run.append(piece)
    units.append(" ".join(run))
    return [units[0], *(" " + u for u in units[1:])]


def chunked(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int, chars: int, block: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """For each chunk, rows of its words (bucket; lengths, places, bytes) and of its texts (doc_ids; sizes, places)."""
    import regex

    find = regex.compile(pattern).findall
    context = TaskContext.get()
    own, number, held, kind = (context.partitionId() if context else 0) << 32, 0, 0, pa.int64()
    ids: list = []
    codes: list[bytes] = []

    def fresh() -> tuple[dict[str, bytes], Words, Words]:
        listed: dict[str, bytes] = {}
        return listed, Words(find, " ", listed), Words(find, "", listed)

    def row(bucket: int | None, doc_ids: list | None, *arrays: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([own + number], pa.int64()), pa.array([bucket], pa.int32()), pa.array([doc_ids], pa.list_(kind)), pa.array([pack(*arrays)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "doc_ids", "packed"])

    def flush() -> Iterator[pa.RecordBatch]:
        after_space.clear()
        whole_pieces.clear()
        sizes = np.array([len(c) // 4 for c in codes], np.int64)
        whole = np.frombuffer(b"".join(codes), "<u4")
        often = np.argsort(-np.bincount(whole, minlength=len(listed)), kind="stable")
        place = np.empty(len(listed), "<u4")
        place[often] = np.arange(len(listed), dtype="<u4")
        ends = np.cumsum(sizes)
        cuts = [0, *(np.flatnonzero(np.diff(ends // block)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield row(None, ids[a:b], sizes[a:b].astype("<u4"), place[whole[ends[a] - sizes[a] : ends[b - 1]]])
        words = [w.encode() for w in listed]
        of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = sorted(range(len(words)), key=words.__getitem__)
        order = np.array(order, np.int64)[np.argsort(of[order], kind="stable")] if words else np.empty(0, np.int64)
        first = np.searchsorted(of[order], np.arange(buckets + 1))
        for bucket in range(buckets):
            part = order[first[bucket] : first[bucket + 1]]
            if len(part):
                mine = [words[i] for i in part]
                yield row(bucket, None, np.fromiter(map(len, mine), "<u4", len(mine)), place[part], np.frombuffer(b"".join(mine), np.uint8))

    listed, after_space, whole_pieces = fresh()
    for batch in batches:
        kind = batch.column("doc_id").type
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            first, *rest = text.split(" ")
            try:
                if not first or first[-1].isspace():
                    raise TypeError
                code = whole_pieces[first] + b"".join(map(after_space.__getitem__, rest))
            except TypeError:  # a piece that is not cut at its spaces has None
                code = b"".join([whole_pieces[u] for u in units_of(text)])
            ids.append(doc_id)
            codes.append(code)
            held += len(text)
            if held > chars:
                yield from flush()
                ids, codes, held, number = [], [], 0, number + 1
                listed, after_space, whole_pieces = fresh()
                give_back()
    if ids:
        yield from flush()
    del ids, codes, listed, after_space, whole_pieces
    give_back()


def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each list, which rows come in order of, with the chunks that have them and their places there."""
    own, held = None, []
    for batch in batches:
        for number, chunk, packed in zip(batch.column("list").to_pylist(), batch.column("chunk").to_pylist(), batch.column("packed"), strict=True):
            if held and number != own:
                yield from told_apart(held)
                held = []
            own = number
            held.append((chunk, *unpack(packed.as_buffer())))
    if held:
        yield from told_apart(held)
    del held
    give_back()


def told_apart(held: list[tuple], rows: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([x[1] for x in held]), dtype=np.int64)])
    words = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.concatenate([x[3] for x in held]))).dictionary_encode()
    index = words.indices.to_numpy()
    order, ends = np.argsort(index, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(index))])
    which = np.repeat(np.arange(len(held), dtype=np.int32), [len(x[2]) for x in held])[order]
    places, chunks = np.concatenate([x[2] for x in held])[order].view(np.int32), np.array([x[0] for x in held], np.int64)
    for a in range(0, len(words.dictionary), rows):
        b = min(a + rows, len(words.dictionary))
        many = pa.array((ends[a : b + 1] - ends[a]).astype(np.int32))
        lists_ = [pa.ListArray.from_arrays(many, pa.array(x)) for x in (chunks[which[ends[a] : ends[b]]], places[ends[a] : ends[b]])]
        yield pa.RecordBatch.from_arrays([words.dictionary[a:b].cast(pa.string()), *lists_], names=["word", "chunks", "places"])


def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of an array of lists."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(offsets) else np.empty(0, np.int64), np.diff(offsets)


def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of words, for each chunk that has them: places, numbers of ids, ids."""
    for batch in batches:
        ids, many = lists(batch.column("ids"))
        chunk, times = lists(batch.column("chunks"))
        place, _ = lists(batch.column("places"))
        starts = np.cumsum(many) - many
        order = np.argsort(chunk, kind="stable")
        chunk, place, word = chunk[order], place[order].view(np.uint32), np.repeat(np.arange(len(many)), times)[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)]]) if len(chunk) else [0]
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mine = word[a:b]
            rows.append((int(chunk[a]), pack(place[a:b].astype("<u4"), many[mine].astype("<u4"), ids[gather(starts[mine], many[mine])].astype("<u4"))))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "packed"])


def put_together(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
    """Ids of the texts of a chunk from the ids of its words."""
    found = [unpack(x.as_buffer()) for x in words.column("packed")] or [[np.empty(0, np.int64)] * 3]
    place, many, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    many, starts = many.astype(np.int64), np.cumsum(many, dtype=np.int64) - many
    length, start = np.full(len(place), -1), np.empty(len(place), np.int64)
    length[place], start[place] = many, starts
    made, kind = [], texts.schema.field("doc_ids").type.value_type
    for doc_ids, packed in zip(texts.column("doc_ids"), texts.column("packed"), strict=True):
        sizes, codes = unpack(packed.as_buffer())
        each = length[codes]
        if (each < 0).any():
            raise ValueError(f"chunk {key[0]} has words without ids")
        ends = np.concatenate([[0], np.cumsum(each)])
        bounds = ends[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
        of = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids[gather(start[codes], each)].astype(np.int32)))
        made.append(pa.table({"doc_id": doc_ids.values, "ids": of}))
    return pa.concat_tables(made) if made else pa.table({"doc_id": pa.array([], kind), "ids": pa.array([], pa.list_(pa.int32()))})
