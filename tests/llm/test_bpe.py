import base64
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from pagemill.llm import bpe


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def tokenizer(request):
    path = P.path(request.param)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_replay_equals_plain_bpe(tokenizer):
    _, _, ranks = tokenizer
    merges = bpe.Merges(ranks)
    rng = random.Random(3)
    words = [b"", b"a" * 37, b"ab" * 20, b"aaabaaab", bytes(range(256))]
    words += [bytes(rng.choice(b"abcdeth in") for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    words += [rng.choice(list(ranks)) + rng.choice(list(ranks)) for _ in range(500)]
    tokens, ends = merges.replay(np.frombuffer(b"".join(words), np.uint8), np.r_[0, np.cumsum([len(w) for w in words])])
    for i, w in enumerate(words):
        assert tokens[ends[i] : ends[i + 1]].tolist() == merges.one(w), w


def test_early_words_are_done_singly():
    """A vocabulary in which a merge makes a pair of lower rank than its own."""
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"bc": 300, b"ab": 301, b"cd": 258, b"xy": 302}
    merges = bpe.Merges(ranks)
    words = [b"abcd", b"abcabcd", b"bcd", b"xyabc", b"abcbc"]
    tokens, ends = merges.replay(np.frombuffer(b"".join(words), np.uint8), np.r_[0, np.cumsum([len(w) for w in words])])
    assert [tokens[a:b].tolist() for a, b in zip(ends, ends[1:])] == [merges.one(w) for w in words]


def plain(ranks, word):
    """BPE by the letter: look for the leftmost pair of lowest rank, join it, look again."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 10**9), i) for i in range(len(parts) - 1))
        if rank == 10**9:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def test_single_words_equal_bpe_by_the_letter(tokenizer):
    _, enc, ranks = tokenizer
    merges, rng = bpe.Merges(ranks), random.Random(4)
    for _ in range(500):
        word = bytes(rng.choice(b"abcdethin \xc3\xa9") for _ in range(rng.randint(0, 40)))
        assert merges.one(word) == plain(ranks, word)
    giant = bytes(rng.choice(b"abcdefghilmnorstu") for _ in range(200_000))
    assert merges.one(giant) == enc.encode_ordinary(giant.decode())


def test_forgetting_words_changes_nothing(tokenizer, monkeypatch):
    _, _, ranks = tokenizer
    merges, rng = bpe.Merges(ranks), random.Random(6)
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 20_000)
    encoder = bpe.Encoder(merges)
    for _ in range(30):
        words = [bytes(rng.choice(b"abcdethin") for _ in range(rng.randint(1, 9))) for _ in range(200)]
        places = encoder.words(pa.array(words))
        assert [encoder.tokens[encoder.starts[p] : encoder.starts[p + 1]].tolist() for p in places] == [merges.one(w) for w in words]
        assert encoder.size < 20_000 + 200 * 300


def test_remembered_words_take_few_bytes():
    """A worker lives on beside the executor's heap: a dictionary of Python's objects took some 180 bytes a word."""
    encoder = bpe.Encoder(bpe.Merges({bytes([i]): i for i in range(256)} | {b"zz": 256}))
    words = pa.array([f"{i:06d}" for i in range(100_000)])
    encoder.words(words.slice(0, 10))
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    places = encoder.words(words)
    taken = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow - places.nbytes
    tracemalloc.stop()
    assert encoder.words(words).tolist() == places.tolist()
    assert taken < 60 * len(words)


@pytest.mark.parametrize("check", [False, True])
def test_nothing_of_a_batch_is_held_while_the_next_is_read(check):
    """Batches with long, null and empty texts, some with no word at all, each freed before the next; none of 0 rows fails."""
    merges, texts = bpe.Merges({bytes([i]): i for i in range(256)} | {b"zz": 256}), [["ab " * 400_000, None, "", "ba"], [None, ""], [], ["c" * 600_000, "d"]]
    seen, at_start = [], None

    def batches():
        nonlocal at_start
        at_start = pa.total_allocated_bytes()
        for some in texts:
            seen.append(pa.total_allocated_bytes() - at_start)
            words = [None if t is None else t.split() for t in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(words, pa.list_(pa.string()))], names=["text", "words"])

    names = ["text", "tokens", "n_tokens", *["round_trip"] * check]
    got = []
    for b in bpe._encoded(batches(), merges, names, 0 if check else None):
        got += zip(b.column("tokens").to_pylist(), b.column("n_tokens").to_pylist())
        del b
    whole = [None if t is None else list("".join(t.split()).encode()) for some in texts for t in some]
    assert got == [(t, len(t or ())) for t in whole]
    assert max(seen) < 100_000  # the first batch has megabytes


def test_a_document_of_one_giant_word(spark, make_docs, tokenizer):
    path, enc, _ = tokenizer
    text = "".join(random.Random(7).choice("abcdefghiklmno漢é") for _ in range(100_000))
    (row,) = bpe.encode(make_docs([(1, text, "x", "y")]), path, check=True).collect()
    assert row.tokens == enc.encode_ordinary(text) and row.round_trip


def test_documents_equal_tiktoken_and_round_trip(spark, make_docs, odd_docs, tokenizer):
    path, enc, _ = tokenizer
    rng = random.Random(5)
    alphabet = "abc the  \n\t'sé漢🎉0123…  　 I'll we've ---"
    docs = make_docs([(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))), "x", "y") for i in range(300)]).unionByName(odd_docs)
    out = bpe.encode(docs, path, check=True)
    assert out.columns == [c for c in docs.columns if c != "tokens"] + ["tokens", "n_tokens", "round_trip"]
    for r in bpe.decode(out, path).collect():
        assert r.round_trip and r.decoded == r.text
        assert (r.tokens, r.n_tokens) == ((None, 0) if r.text is None else (enc.encode_ordinary(r.text), len(r.tokens)))


def test_words_are_not_sent_beside_their_text(spark, make_docs, monkeypatch):
    """As strings they more than doubled what each task has in buffers of the JVM and of its worker."""
    docs, sent = make_docs([(i, "Some words, 12 of them: it's a short text. " * 50, "x", "y") for i in range(40)]), []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *a, **k: sent.append(self) or real(self, *a, **k))
    assert bpe.encode(docs, check=True).filter("round_trip").count() == 40
    assert sent[0].toArrow().nbytes < 1.5 * sum(len(r.text) for r in docs.collect())


def test_sizes_of_words_of_any_length_and_texts_that_are_not_utf8(spark, tokenizer):
    """Words about the size that one byte holds, and bytes that the JVM replaces, in three cases of which one keeps its length."""
    path, enc, _ = tokenizer
    texts = [b" ".join([b"a" * n, "é".encode() * n, b"b" * 126]) for n in (62, 63, 64, 126, 127, 128, 129, 255, 256, 40_000)]
    texts += [b"ab \xff cd", b"x \xed\xa0\x80 y", b"\xc3", b"", None, b"q" * 500 + b"\xe2\x82 ok"]
    docs = spark.createDataFrame([(i, None if t is None else bytearray(t)) for i, t in enumerate(texts)], "i int, raw binary").coalesce(1)
    got = bpe.encode(docs.selectExpr("i", "cast(raw as string) AS text"), path, check=True).drop("text").collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.i]
        read = None if t is None else t.replace(b"\xed\xa0\x80", "\ufffd".encode()).decode("utf-8", "replace")  # the JVM replaces it by one, Python by three
        assert r.tokens == (None if t is None else enc.encode_ordinary(read)) and r.n_tokens == len(r.tokens or ())
        assert r.round_trip == (t is None or read.encode() == t)


def test_batches_of_many_words_are_cut_and_not_held(odd_docs, monkeypatch):
    """What a worker takes for the words' places must not grow with the batch; the words are those that the JVM splits."""
    monkeypatch.setattr(bpe, "_WORDS", 7)
    docs = odd_docs.select("doc_id", "text").coalesce(1)
    want = [r.w for r in docs.select(bpe.F.regexp_extract_all("text", bpe.F.lit(bpe.PATTERN), bpe.F.lit(0)).alias("w")).collect()]
    whole = bpe._with_sizes(docs).toArrow().combine_chunks().to_batches()[0]
    held, parts, got, buffers = [], 0, [], whole.serialize()
    schema, before = whole.schema, pa.total_allocated_bytes()

    def batches():
        for _ in range(3):
            held.append(pa.total_allocated_bytes() - before)
            yield pa.ipc.read_record_batch(pa.py_buffer(buffers.to_pybytes()), schema)

    for b in bpe._worded(batches(), 1):
        assert b.num_rows == 1 or sum(len(w or ()) for w in b.column(2).to_pylist()[:-1]) < 2 * 7
        got += [None if w is None else [x.decode() for x in w] for w in b.column(2).to_pylist()]
        parts += 1
        del b
    assert got == want * 3 and parts > 3 * 5
    assert max(held) < 100_000


def test_decoding_takes_few_bytes(tokenizer):
    """An index of every byte, three times over, took 24 bytes for each."""
    merges = bpe.Merges(tokenizer[2])
    tokens = np.full(1_000_000, merges.ranks[b" the"], np.int64)
    tracemalloc.start()
    data, sizes = merges.decode(tokens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert data.tobytes() == b" the" * len(tokens) and sizes.sum() == len(data)
    assert peak < 12 * len(data)  # 4 of them for what comes back with the bytes, by token


def test_empty_table(no_docs):
    assert bpe.decode(bpe.encode(no_docs, check=True)).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(bpe.RANK_FILE, "rb").read()), special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bpe.query(spark, sf).collect()
    assert len(got) == len(texts)
    assert all(r.tokens == enc.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.tokens) and r.round_trip for r in got)
