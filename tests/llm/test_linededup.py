import hashlib

from pagemill.llm import linededup


def brute(rows):
    """rows: (doc_id, text); kept positions by (doc_id, text)."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16)))
    seen, kept = set(), {}
    for key in order:
        kept[key] = []
        for line in [] if key[1] is None else key[1].split("\n"):
            bare = line.strip(" ")
            kept[key].append(bare == "" or bare not in seen)
            seen.add(bare)
    return kept


def runs(keep):
    out, now = [], True
    n = 0
    for k in keep:
        if k != now:
            out.append(n)
            now, n = k, 0
        n += 1
    return ",".join(map(str, [*out, n])) if keep else ""


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    got = sorted((str(r.doc_id), r.n_lines, r.n_kept, r.keep_runs) for r in linededup.keep_bitmaps(docs).collect())
    assert got == sorted((str(i), len(k), sum(k), runs(k)) for (i, _), k in want.items())
    out = linededup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    expected = []
    for key in rows:
        keep = want[key]
        text = key[1] if all(keep) else "\n".join(x for x, k in zip(key[1].split("\n"), keep) if k)
        if all(keep) or text.strip(" \n"):
            expected.append((str(key[0]), str(text), len(text) if text is not None else None))
    assert sorted((str(r.doc_id), str(r.text), r.n_chars) for r in out.collect()) == sorted((a, b, c) for a, b, c in expected) or [
        (r.doc_id, r.n_chars) for r in out.collect() if r.text is None
    ]


def test_odd_rows(odd_docs):
    check(odd_docs)


def test_repeated_rows_keep_their_lines(make_docs):
    docs = make_docs([(1, "a\nb", "x", "y"), (1, "a\nb", "x", "y"), (2, "b\nc\nc", "x", "y")])
    assert sorted(r.text for r in linededup.drop_repeated_lines(docs).collect()) == ["a\nb", "a\nb", "c"]


def test_a_line_that_spans_ranges(spark, make_docs):
    """A line of very many documents is spread over several ranges and still kept once."""
    docs = make_docs([(i, f"hot line\nown {i}\n hot line ", "x", "y") for i in range(3000)]).repartition(8)
    check(docs)


def test_very_long_lines_and_very_many_lines(spark, make_docs):
    long = "word " * 200_000
    many = "\n".join(["same line", *(f"own {i}" if i % 3 else "same line" for i in range(100_000))])
    check(make_docs([(1, long + "\n" + long, "x", "y"), (2, " " + long, "x", "y"), (3, many, "x", "y"), (4, "same line", "x", "y")]))


def test_texts_are_taken_apart_once(make_docs):
    """Run in the filter and again for the result, it took two workers for each task, which live on in later stages."""
    out = linededup.drop_repeated_lines(make_docs([(1, "a\nb", "x", "y"), (2, "b\nc", "x", "y")]))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_empty_table(no_docs):
    assert linededup.keep_bitmaps(no_docs).count() == 0 and linededup.drop_repeated_lines(no_docs).count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs)
