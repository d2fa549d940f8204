"""Byte-level BPE encoding and decoding by corpus-level merge replay."""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import give_back, spread

#: Rank file of a public tokenizer; any file of the same form can be named instead.
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: What splits a text into words before the merges, with Unicode white space ((?U) in Java).
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words that are replayed at once; their positions take some 30 bytes a character.
BLOCK_WORDS = 100_000
#: Bytes of memory for the encoded words that a worker remembers; beyond it, it starts afresh (which changes no result).
REMEMBERED_BYTES = 48_000_000
#: What a remembered word takes besides its bytes and tokens: two offsets, and its entry in the hash table of a look-up.
_ENTRY_BYTES = 100
#: A rank file is sent to all workers; one of more bytes is refused.
MOST_RANK_BYTES = 50_000_000
#: A word of no more bytes is sent to the workers as its size, one byte.
_BYTE_SIZE = 127
#: Words whose places a worker has at once, about; a batch of more is cut, and one very long text stays whole.
_WORDS = 6_000_000
#: Pairs that are looked up at once, and runs of values that are copied at once.
_LOOK_UP = 65_536
NONE = np.int32(2**31 - 1)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Merges:
    """The pairs of tokens that make another token, and the replay of all merges over a set of words."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    made.append(rank)
        order = np.argsort(np.array(pairs, np.int64))
        self.pairs = np.array(pairs, np.int64)[order]
        self.made = np.array(made, np.int32)[order]
        self.single = np.full(256, -1, np.int32)
        for i in range(256):
            self.single[i] = ranks[bytes([i])]
        #: Tokens that can join a neighbour into a token of lower rank than their own; words where one does are done singly.
        left, right = self.pairs >> 32, self.pairs & 0xFFFFFFFF
        self.early = np.zeros(max(ranks.values()) + 1, bool)
        self.early[left[self.made < left]] = True
        self.early[right[self.made < right]] = True
        size = max(ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.offsets = np.r_[0, np.cumsum(lengths)]
        by_rank = {r: t for t, r in ranks.items()}
        self.bytes = np.frombuffer(b"".join(by_rank.get(r, b"") for r in range(size)), np.uint8)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair makes, NONE where it makes none."""
        out = np.empty(len(left), np.int32)
        for lo in range(0, len(left), _LOOK_UP):
            key = left[lo : lo + _LOOK_UP].astype(np.int64) << 32 | right[lo : lo + _LOOK_UP]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            out[lo : lo + _LOOK_UP] = np.where(self.pairs[at] == key, self.made[at], NONE)
        return out

    def one(self, word: bytes) -> list[int]:
        """Plain BPE of one word: join the leftmost pair of lowest rank until none is left. Pairs wait in a heap, so a very
        long word takes a time that grows with its length times the logarithm of it."""
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        nxt, prv = [*range(1, len(word)), -1], list(range(-1, len(word) - 1))
        heap = [(rank, i, parts[i] + parts[i + 1]) for i in range(len(word) - 1) if (rank := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, joined = heapq.heappop(heap)
            right = nxt[at]
            if parts[at] is None or right < 0 or len(parts[at]) + len(parts[right]) != len(joined) or parts[at] + parts[right] != joined:
                continue  # one of the two has been joined with another since
            parts[at], parts[right], nxt[at] = joined, None, nxt[right]
            if nxt[at] >= 0:
                prv[nxt[at]] = at
            for a, b in ((prv[at], at), (at, nxt[at])):
                if a >= 0 and b >= 0 and (rank := self.ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (rank, a, parts[a] + parts[b]))
        return [self.ranks[p] for p in parts if p is not None]

    def replay(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words data[starts[i]:starts[i + 1]] (bytes), end to end, and where each word's tokens start.

        An inverted index leads from the rank of a pair to the positions at which it stands, over all words at
        once. Merges are applied in order of rank, each to all its positions; only the pairs of the two neighbours
        are looked up again and entered in the index.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        word = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
        sym = self.single[data]
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[starts[1:][np.diff(starts) > 0] - 1] = -1
        prv[starts[:-1][np.diff(starts) > 0]] = -1
        pair = np.full(n, NONE)
        has = np.flatnonzero(nxt >= 0).astype(np.int32)
        pair[has] = self.rank_of(sym[has], sym[has + 1])
        alive = np.ones(n, bool)
        singly: list[np.ndarray] = []
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            ranks = pair[at]
            at, ranks = at[ranks != NONE], ranks[ranks != NONE]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(heap, rank)
                index[rank].append(part)

        enter(has)
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            at = at[(pair[at] == rank) & alive[at]]
            if not len(at):
                continue
            if len(at) > 1:  # overlapping places, as in aaa: every second one of a chain, from the left
                chained = np.r_[False, nxt[at[:-1]] == at[1:]]
                if chained.any():
                    head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - head) % 2 == 0]
            right = nxt[at]
            after = nxt[right]
            if self.early[rank]:  # the pair with what follows, as it is when this merge comes
                some = at[after >= 0]
                singly.append(word[some[self.rank_of(np.full(len(some), rank), sym[after[after >= 0]]) < rank]])
            sym[at] = rank
            nxt[at] = after
            prv[after[after >= 0]] = at[after >= 0]
            alive[right] = False
            pair[right] = NONE
            before = prv[at]
            if self.early[rank]:  # the pair with what precedes
                some = before[before >= 0]
                singly.append(word[some[self.rank_of(sym[some], np.full(len(some), rank)) < rank]])
            touched = np.unique(np.concatenate([at, before[before >= 0]]))
            touched = touched[alive[touched]]
            last = nxt[touched] < 0
            pair[touched[last]] = NONE
            touched = touched[~last]
            pair[touched] = self.rank_of(sym[touched], sym[nxt[touched]])
            enter(touched)
        tokens = sym[alive]
        counts = np.bincount(word[alive], minlength=len(starts) - 1)
        ends = np.r_[0, np.cumsum(counts)]
        again = np.unique(np.concatenate(singly)) if singly else ()
        if len(again):
            own = {int(w): self.one(data[starts[w] : starts[w + 1]].tobytes()) for w in again}
            parts, at = [], 0
            for w in sorted(own):
                parts += [tokens[at : ends[w]], np.array(own[w], np.int32)]
                at = ends[w + 1]
                counts[w] = len(own[w])
            tokens, ends = np.concatenate([*parts, tokens[at:]]), np.r_[0, np.cumsum(counts)]
        return tokens, ends

    def decode(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens end to end, and how many are of each token."""
        sizes = self.offsets[tokens + 1] - self.offsets[tokens]
        return _gather(self.bytes, self.offsets[tokens], sizes), sizes


@functools.lru_cache(maxsize=2)
def _merges(data: bytes) -> Merges:
    return Merges(read_ranks(data))


class Encoder:
    """Encodes words by replay, and remembers those it has had."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        #: In Arrow, as a dictionary of Python's objects takes several times the bytes; of word i the tokens begin at starts[i].
        self.known = pa.array([], pa.binary())
        self.size = 0
        self.tokens, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def words(self, distinct: pa.Array) -> np.ndarray:
        """The place in ``starts`` of each of the words."""
        if self.size > REMEMBERED_BYTES:
            self.clear()
        distinct = distinct.cast(pa.binary())
        at = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        for lo in range(0, len(new), BLOCK_WORDS):
            block = new[lo : lo + BLOCK_WORDS]
            data, starts = _bytes(distinct.take(pa.array(block)))
            tokens, ends = self.merges.replay(data, starts)
            at[block] = len(self.starts) - 1 + np.arange(len(block))
            self.size += int(starts[-1]) + 4 * len(tokens) + _ENTRY_BYTES * len(block)
            self.tokens = np.concatenate([self.tokens, tokens.astype(np.int32)])
            self.starts = np.concatenate([self.starts, ends[1:] + self.starts[-1]])
        if len(new) and self.size <= REMEMBERED_BYTES:  # else all is forgotten before the next look-up
            self.known = pa.concat_arrays([self.known, distinct.take(pa.array(new))])
        return at


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary ``words`` end to end, and where each word begins and the last ends."""
    _, offsets, data = words.buffers()
    starts = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[i]:starts[i] + sizes[i]] for all i, end to end. In pieces, as an index of all takes 24 bytes a value."""
    ends = np.r_[0, np.cumsum(sizes)]
    out = np.empty(int(ends[-1]), values.dtype)
    for lo in range(0, len(sizes), _LOOK_UP):
        hi = min(lo + _LOOK_UP, len(sizes))
        out[ends[lo] : ends[hi]] = values[spread(starts[lo:hi], sizes[lo:hi])]
    return out


def _list(values: np.ndarray, counts: np.ndarray, null: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32), mask=np.r_[null, False])
    return pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))


def _slices(batch: pa.RecordBatch, at: int, most: int = 500_000):
    """Slices of about ``most`` list items, so that no array is larger than a few such; one very long text is a slice by itself."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    block = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def _sent(spark, rank_file: str):
    """The rank file, read by the driver and sent to the workers once, if it is checked to be small."""
    with open(rank_file, "rb") as f:
        data = f.read(MOST_RANK_BYTES + 1)
    if len(data) > MOST_RANK_BYTES:
        raise ValueError("the rank file is too large to be sent to the workers")
    return spark.sparkContext.broadcast(data)


def encode(docs: DataFrame, rank_file: str = RANK_FILE, check: bool = False) -> DataFrame:
    """``docs`` with tokens (array of int), n_tokens (int) and, on request, round_trip (boolean).

    The JVM splits a text into words and sends their sizes with it; a worker replays the merges over the distinct words of a block of the corpus
    at once and puts the documents together from them, so no text or word is shuffled. round_trip says whether
    decoding gives back the bytes of the text. Special tokens are never made: their strings are ordinary text.
    Cases: a null text has null tokens, 0 of them, and round-trips; an empty text has an empty array; a very long text, or
    a very long word, is encoded whole; a null in any other column passes through; every repeated row has its own result,
    the same one; of two pairs of one rank (a tie) the left one is joined first; an empty table gives an empty one; other
    columns pass through, and those named tokens, n_tokens, round_trip are replaced.
    """
    sent = _sent(docs.sparkSession, rank_file)
    docs = docs.drop("tokens", "n_tokens", "round_trip")
    extra = [T.StructField("tokens", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.IntegerType())]
    extra += [T.StructField("round_trip", T.BooleanType())] if check else []
    schema = T.StructType([*docs.schema.fields, *extra])
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(_worded(batches, text_at), _merges(sent.value), schema.names, text_at if check else None)

    return _with_sizes(docs).mapInArrow(run, schema)


def _with_sizes(docs: DataFrame) -> DataFrame:
    """``docs`` and what tells the words of each text, in three columns: a text to take instead (of one that is not UTF-8, as
    the JVM reads it; else null), the size of each word in bytes, -1 for each long one, and the sizes of the long ones.

    The words end to end are the text, so it is sent to the workers once. As strings they took the bytes of the text again,
    and four for each word, in every buffer between the JVM and the worker.
    """
    size, words = F.octet_length, F.col("__pm_words")
    sizes = F.transform(words, lambda w: F.when(size(w) > _BYTE_SIZE, -1).otherwise(size(w)).cast("byte"))
    rows = docs.withColumn("__pm_words", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    rows = rows.withColumns({"__pm_text": F.when(~F.is_valid_utf8("text"), F.array_join(words, "")), "__pm_sizes": sizes, "__pm_words": words})
    long = F.when(F.array_contains("__pm_sizes", F.lit(-1).cast("byte")), F.transform(F.filter(words, lambda w: size(w) > _BYTE_SIZE), size))
    return rows.select(*docs.columns, "__pm_text", "__pm_sizes", long.alias("__pm_long"))


def _worded(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``_with_sizes`` by ``_with_words``, those of many words in parts. None is held while the next is read."""
    for batch in batches:
        yield from map(functools.partial(_with_words, text_at=text_at), _slices(batch, batch.num_columns - 2, _WORDS))
        del batch


def _with_words(batch: pa.RecordBatch, text_at: int) -> pa.RecordBatch:
    """A batch of ``_with_sizes`` with the words of each text as its last column instead: places in the text, whose bytes are
    not copied."""
    *kept, instead, sizes, long = batch.columns
    texts = batch.column(text_at)
    if instead.null_count < len(instead):
        texts = pc.coalesce(instead, texts)
    large = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    begins = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    each = sizes.flatten().to_numpy(zero_copy_only=False)
    if len(more := long.flatten()):
        each = each.astype(np.int32)
        each[each < 0] = more.to_numpy(zero_copy_only=False)
    places = np.empty(len(each) + 1, begins.dtype)
    places[0] = begins[0]
    np.cumsum(each, dtype=places.dtype, out=places[1:])
    places[1:] += begins[0]
    stops = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(sizes), 0).to_numpy(zero_copy_only=False))].astype(np.int32)
    if (places[stops] != begins).any():
        raise ValueError("the words of a text don't make up the text")
    words = pa.Array.from_buffers(pa.large_binary() if large else pa.binary(), len(each), [None, pa.py_buffer(places), data or pa.py_buffer(b"")])
    null = pc.is_null(sizes).to_numpy(zero_copy_only=False)
    lists = pa.ListArray.from_arrays(pa.array(stops, mask=np.r_[null, False]), words)
    return pa.RecordBatch.from_arrays([*kept, lists], names=[*batch.schema.names[:-3], "__pm_words"])


def _encoded(batches: Iterator[pa.RecordBatch], merges: Merges, names: list[str], text_at: int | None) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is the words of the text, encoded. Nothing of a batch is held while the next is read."""
    encoder = Encoder(merges)
    for whole in batches:
        yield from _encoded_batch(whole, encoder, names, text_at)
        del whole
        give_back()
    encoder.clear()
    give_back()


def _encoded_batch(whole: pa.RecordBatch, encoder: Encoder, names: list[str], text_at: int | None) -> Iterator[pa.RecordBatch]:
    words_at = whole.num_columns - 1
    slices = list(_slices(whole, words_at))
    flat = [b.column(words_at).flatten() for b in slices]
    coded = pa.chunked_array([f for f in flat if len(f)], whole.schema.field(words_at).type.value_type).dictionary_encode()  # one dictionary for all chunks
    places = encoder.words(coded.chunk(0).dictionary) if coded.num_chunks else np.zeros(0, np.int64)
    codes = iter([c.indices for c in coded.chunks])
    del flat, coded
    give_back()
    for batch in slices:
        lists = batch.column(words_at)
        null = pc.is_null(lists).to_numpy(zero_copy_only=False)
        per_doc = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = places[next(codes).to_numpy(zero_copy_only=False) if per_doc.any() else np.zeros(0, np.int64)]
        sizes = encoder.starts[at + 1] - encoder.starts[at]
        tokens = _gather(encoder.tokens, encoder.starts[at], sizes)
        ends = np.r_[0, np.cumsum(sizes)]
        stops = np.cumsum(per_doc)
        counts = ends[stops] - ends[stops - per_doc]
        columns = [batch.column(i) for i in range(words_at)]
        columns += [_list(tokens, counts, null), pa.array(counts.astype(np.int32))]
        if text_at is not None:
            columns.append(_round_trip(encoder.merges, batch.column(text_at), tokens, counts, null))
        del at, sizes, tokens, ends
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _round_trip(merges: Merges, texts: pa.Array, tokens: np.ndarray, counts: np.ndarray, null: np.ndarray) -> pa.Array:
    data, sizes = merges.decode(tokens.astype(np.int64))
    ends, stops = np.r_[0, np.cumsum(sizes)], np.cumsum(counts)
    offsets = np.r_[0, ends[stops]].astype(np.int64)
    decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    same = pc.fill_null(pc.equal(decoded, texts.cast(pa.large_binary())), False).to_numpy(zero_copy_only=False)
    return pa.array(same | null)


def decode(encoded: DataFrame, rank_file: str = RANK_FILE, column: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its column ``tokens`` in ``column``; null tokens give null, none an empty text.

    An unknown id is an error. Bytes that are not UTF-8 (tokens cut out of a text) become U+FFFD.
    """
    sent = _sent(encoded.sparkSession, rank_file)
    kept = encoded.drop(column)
    at = kept.columns.index("tokens")
    schema = T.StructType([*kept.schema.fields, T.StructField(column, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(sent.value)
        for whole in batches:
            for batch in _slices(whole, at):
                lists = batch.column(at)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(flat) and (flat.min() < 0 or flat.max() + 1 >= len(merges.offsets)):
                    raise ValueError("token id out of range")
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                data, sizes = merges.decode(flat)
                ends, stops = np.r_[0, np.cumsum(sizes)], np.r_[0, np.cumsum(counts)]
                raw, null = data.tobytes(), pc.is_null(lists).to_pylist()
                texts = [None if no else raw[ends[a] : ends[b]].decode("utf-8", "replace") for no, a, b in zip(null, stops, stops[1:])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, check=True).drop("text")
