"""Operators that SQL doesn't express, and edge cases, against plain Python."""

from pyspark.sql import functions as F

from folioforge.functions import providers, questions, replies, safety, text
from folioforge.operators import vectors
from folioforge.plans import QUERIES
from folioforge.plans import text as plan
from folioforge.plans.registry import Tables, inline
from folioforge.session import fresh_path
from folioforge.sources import files, pdf
from folioforge.sources.store import Store, updated
from folioforge.streaming import requests


def test_chapters(spark):
    rows = plan.chapters(inline(Tables(spark, ""), plan.STRUCTURED, plan.STRUCTURED_DDL), "id").collect()
    assert sorted((r.id, r.n, r.number, r.title) for r in rows) == [
        (1, 0, "1", "Start"), (1, 1, "2", "Middle"), (2, 0, "1", "Introduction"), (2, 1, "2", "Methods"), (2, 2, "3", "Results"),
        (3, 0, "1", "One"), (3, 1, "2", "Two"), (3, 2, "0x1F", "Intro here"), (3, 3, "9", "LOUD"), (11, 0, "3", "Inline title"),
    ]


def brute_packed(t: str, size: int) -> list[str]:
    chunks, now, n = [], "", 0
    for p in t.split("\n\n"):
        pieces = [(s + ". ", len(s.split())) for s in p.split(". ")] if len(p.split()) > size else [(p + "\n\n", len(p.split()))]
        for piece, words in pieces:
            if n + words <= size:
                now, n = now + piece, n + words
            else:
                if now:
                    chunks.append(now.strip())
                now, n = piece, words
    return [*chunks, now.strip()] if now else chunks


def test_paragraph_packing(spark):
    texts = ["a b. c d e. f g h i", "one two\n\nthree four five\n\nsix", "x " * 30, "", "p. q. " * 20 + "\n\nend of it"]
    got = inline(Tables(spark, ""), list(enumerate(texts)), "id int, t string").select("id", text.packed(F.col("t"), 6).alias("c")).collect()
    assert {r.id: r.c for r in got} == {i: brute_packed(t, 6) for i, t in enumerate(texts)}


def test_chunks_cover_the_text(spark):
    n = range(10_000, 13_000)
    texts = [" ".join(f"word{i}" for i in n), " ".join(f"Sentence {i} here." for i in n), "".join(map(str, n)), "\n\n".join(f"p {i} r" for i in n)]
    rows = inline(Tables(spark, ""), list(enumerate(texts)), "id int, t string").select("id", text.paragraphs(F.col("t")).alias("s"))
    for r in rows.select("s", text.chunks(F.col("s"), 100, 10).alias("c")).collect():
        assert all(0 < len(c) <= 400 for c in r.c)
        at = 0
        for c in r.c:
            found = r.s.find(c, max(0, at - 60))
            assert found >= 0 and found <= at + 2
            at = found + len(c)
        assert at >= len(r.s.rstrip())


def test_stream_takes_text_files_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, body in {"a.txt": "summarize this ", "B.TXT": "x" * 2001, ".hidden.txt": "no", "~tmp.txt": "no", "c.md": "no", "empty.txt": " \n"}.items():
        (folder / name).write_text(body)
    out, mark = fresh_path(spark, "out"), fresh_path(spark, "mark")

    def once():
        stream = requests.triaged(requests.arrivals(spark, str(folder)))
        requests.run(stream, lambda b, n: b.write.mode("append").parquet(out), mark).awaitTermination()
        return sorted((r.name, r.request[-14:], r.category) for r in spark.read.parquet(out).collect())

    want = [("B.TXT", "...[truncated]", "sysadmin"), ("a.txt", "summarize this", "summarization")]
    assert once() == want
    assert once() == want


def test_store_reset_needs_confirmation(spark):
    store = Store(spark, fresh_path(spark, "store"))
    store.add(spark.createDataFrame([("1", "private", "a"), ("2", "public", "b")], "chunk_id string, db string, collection string"))
    assert not store.reset() and store.read().count() == 2
    assert store.drop_collection("public", "b") and [r.chunk_id for r in store.read().collect()] == ["1"]


def test_failing_provider_gives_zero_vectors(spark):
    def broken(texts):
        raise RuntimeError("out of memory")

    df = inline(Tables(spark, ""), [("a b",), ("",), (None,)], "t string")
    assert all(r.e == [0.0] * providers.DIMS for r in df.select(providers.batched(broken)(F.col("t")).alias("e")).collect())
    assert [round(r.n, 6) for r in df.select(vectors.norm(providers.hashed(F.coalesce("t", F.lit("")))).alias("n")).collect()] == [1.0, 0.0, 0.0]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "chunk_id long, embedding array<double>, collection_ord int, chunk_number int, doc_id long")
    asked = spark.createDataFrame([(1, [0.5, 0.5])], "query_id long, query array<double>")
    assert vectors.over_collections(empty, asked, 5).count() == 0


def test_pdf_pages():
    made = pdf.made([["One (two) \\ three", "é ü"], ["", " "], ["last"]])
    assert pdf.pages(made) == ["One (two) \\ three\né ü", "\n ", "last"]
    assert pdf.pages(b"") == [] and pdf.pages(b"not a pdf") == [] and pdf.pages(made[:200]) in ([], [""])
    raw = b"1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R 5 0 R] >>\nendobj\n"
    raw += b"3 0 obj\n<< /Type /Page /Contents [4 0 R 6 0 R] >>\nendobj\n4 0 obj\n<< >>\nstream\nBT <FEFF00E9> Tj 0 -12 Td [(A) -20 (B\\051)] TJ ET\nendstream\nendobj\n"
    raw += b"5 0 obj\n<< /Type /Page >>\nendobj\n6 0 obj\n<< >>\nstream\nBT (next) Tj ET\nendstream\nendobj\n"
    assert pdf.pages(raw) == ["é\nAB)\nnext", ""]


def test_pdf_files_are_read(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf.made([["first page"], [" "], ["third page"]]))
    (tmp_path / "b.PDF").write_bytes(pdf.made([[""]]))
    (tmp_path / "c.txt").write_text("no pdf")
    got = {r.path[-5:]: (r.text, r.status) for r in files.pdfs(spark, str(tmp_path), numbered=True).collect()}
    assert got["a.pdf"] == ("[Page 1]\nfirst page\n\n[Page 3]\nthird page", "success")
    assert set(got) <= {"a.pdf", "b.PDF"} and got.get("b.PDF", (None, "error")) == (None, "error")


def test_many_queries_meet_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "chunk_id long, embedding array<double>")
    asked = rows.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    few = sorted(tuple(r) for r in vectors.nearest(rows, asked, 3).collect())
    monkeypatch.setattr(vectors, "QUERIES", 7)
    assert sorted(tuple(r) for r in vectors.nearest(rows, asked, 3).collect()) == few and len(few) == 180


def test_queries_see_allowed_documents_only(spark):
    rows = spark.createDataFrame([(i, i % 3, [float(i)]) for i in range(12)], "chunk_id long, doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, [0.0], None), (5, [5.0], 77)], "query_id long, query array<double>, filter long")
    passing = spark.createDataFrame([(1, [9, 77]), (2, [9])], "doc_id long, filters array<long>")
    got = {}
    for r in vectors.nearest(rows, asked, 2, passing=passing).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(1, 1), (2, 2)], 5: [(1, 4), (2, 7)]}


def test_token_chunks_make_progress(spark):
    words = F.split(F.lit("a b c d e f g"), " ")
    one = lambda size, overlap: [" ".join(c) for c in spark.range(1).select(text.token_chunks(words, size, overlap).alias("c")).first().c]
    assert one(3, 1) == ["a b c", "c d e", "e f g"] and one(4, 4) == ["a b c d", "c d e f", "e f g"] and one(9, 2) == ["a b c d e f g"]
    assert spark.range(1).select(text.token_chunks(F.array().cast("array<string>"), 3, 1).alias("c")).first().c == []


def test_updates_merge(spark):
    rows = spark.createDataFrame([(1, 0.5, 3), (2, 0.6, None)], "chunk_id long, importance double, access_count int")
    changes = spark.createDataFrame([(2, 0.9), (3, None)], "chunk_id long, importance double")
    assert sorted(tuple(r) for r in updated(rows, changes).collect()) == [(1, 0.5, 3), (2, 0.9, 1), (3, None, 1)]


def test_security_replies(spark):
    texts = [
        "COMMANDS:\n1. df -h\n- ssh me@1.2.3.4 \"uptime\"\necho no\nREASONING: look first\nAPPROACH: slow\nNEXT_STEPS:\n1. Review the outputs again\n2. ok\nCONFIDENCE: 0.7",
        "reasoning: only this\napproach: that way\nCONFIDENCE: 1.7",
        "Try ssh root@10.0.0.1 \"df -h\" now",
        "",
    ]
    fields = replies.security_fields(F.col("t"))
    rows = inline(Tables(spark, ""), list(enumerate(texts)), "id int, t string").select("id", *(c.alias(k) for k, c in fields.items())).collect()
    assert [(r.commands, r.reasoning, r.approach, r.next_steps, r.confidence) for r in sorted(rows)] == [
        (["df -h", "ssh me@1.2.3.4 'uptime'"], "look first", "slow", ["Review the outputs again"], 0.7),
        ([], "only this", "that way\nCONFIDENCE: 1.7", [], 1.0),
        (["ssh root@10.0.0.1 'df -h'"], "Collaborative analysis", "Step-by-step investigation", [], 0.8),
        ([], "Collaborative analysis", "Step-by-step investigation", [], 0.8),
    ]


def test_store_figures(spark):
    store = Store(spark, fresh_path(spark, "store"))
    store.add(spark.createDataFrame([("1", "private", "a"), ("2", "public", "b"), ("3", "public", "c")], "chunk_id string, db string, collection string").coalesce(1))
    got = {r.db: (r.files, r.mb >= 0) for r in store.stats().collect()}
    assert got == {"private": (1, True), "public": (2, True)}


def test_code_of_replies(spark):
    body = "import os\n\n\ndef where():\n    return os.path.join(os.getcwd(), 'somewhere')"
    long = "this line has no end " * 20_000
    cases = [
        (f"Here's the module:\n```python\n{body}\n```\nThis version includes a fix\n1. one\n2. two\n", body + "\n"),
        ("```python\nx = 1\n```", "x = 1\n"),  # too short for a fence: only its marks go
        ("Some words\nclass A:\n    # kept\n    a = 1\nNote: dropped\n    b = 2\n\n# a comment\n", "class A:\n    # kept\n    a = 1\n    b = 2\n"),
        ("no code at all", "no code at all\n"),
        ("# one\n# two", "# one\n# two\n"),
        ("This is it:\n\nx = `y`", "x = y\n"),
        ("This version works\nnothing else\nThis version works", "This version works\nnothing else\n"),
        ("explanation: all of it", ""),
        (long, long.strip() + "\n"),
        ("", ""),
        (None, None),
    ]
    rows = inline(Tables(spark, ""), [(i, r) for i, (r, _) in enumerate(cases)], "id int, reply string")
    got = {r.id: r.code for r in rows.select("id", replies.clean_code(F.col("reply")).alias("code")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_findings_of_suggestions(spark):
    cases = [
        ([], "anything", "low", ["no commands"], []),
        ([], "anything", "critical", ["no commands"], ["critical but harmless"]),
        (["ls /srv/a", "df -h"], "look at /srv/a", "critical", [], ["critical but harmless"]),
        (["ls /srv/b", "ping 10.0.0.1"], "look", "high", [], ["/srv/b", "10.0.0.1"]),
        (["rm", "-rf x"], "clean", "critical", [], []),  # only together a danger
        (["RM -RF x", "mkfs"], "clean", "critical", [r"rm\s+-rf", "mkfs"], []),
    ]
    rows = inline(Tables(spark, ""), [(i, *c[:3]) for i, c in enumerate(cases)], "id int, commands array<string>, request string, risk string")
    issues, warnings = safety.suggestion_findings(F.col("commands"), F.col("request"), F.col("risk"))
    got = {r.id: (r.i, r.w) for r in rows.select("id", issues.alias("i"), warnings.alias("w")).collect()}
    assert got == {i: (c[3], c[4]) for i, c in enumerate(cases)}


def test_chapter_and_section_numbers_beyond_an_int(spark):
    asked = [(1, "chapter 9859476043669043"), (2, "section 2147483648 of it"), (3, "chapter 2147483647 section 7")]
    rows = questions.parsed(inline(Tables(spark, ""), asked, "id int, q string")).orderBy("id").select("*", questions.formatted().alias("shown")).collect()
    assert [(r.chapter, r.section) for r in rows] == [(None, None), (None, None), (2147483647, 7)]
    assert ["chapter" in r.entities for r in rows] == [False, False, True]
    assert "Chapter" not in rows[0].shown and "Chapter: 2147483647" in rows[2].shown


def test_overlaps_are_those_of_all_documents(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    questions = t.benchmark.where("item_id % 50 = 0").count()
    rows = QUERIES["rerank_overlap"](spark, t.sf_dir).collect()
    assert len({(r.item_id, r.doc_id) for r in rows}) == len(rows) == questions * t.documents.count()
    assert {r.overlap == 0 for r in rows} == {True, False}


def test_question_queries_pass_lines_with_numbers_beyond_an_int(spark, tmp_path):
    # the first line of document 22 meets the empty form, so it is the whole question
    spark.createDataFrame([(22, "chapter 9859476043669043 section 2147483648")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {n: QUERIES[n](spark, str(tmp_path)).collect() for n in ("qp_confidence", "qp_entities", "qp_format")}
    assert [(r.id, r.confidence) for r in got["qp_confidence"]] == [(2200001, 0.55)]
    assert [(r.id, r.entities) for r in got["qp_entities"]] == [(2200001, "doc_type")]
    assert [r.shown.split("\n")[1:] for r in got["qp_format"]] == [["Intent: content_search", "  Type: book", "Confidence: 0.55"]]
