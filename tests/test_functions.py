import hashlib
import sqlite3

import pytest
from pyspark.sql import functions as F

from skein.functions import lexing as lx
from skein.functions.globs import glob_regex, matches_any, selected, visible
from skein.operators import lexical


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("path", "pattern", "want"),
    [
        ("notes/a.md", "notes/**/*.md", True),
        ("old/notes/x/y/z.md", "notes/**/*.md", False),
        ("notes/x/a.md", "notes/*.md", False),
        ("top.txt", "**/*.txt", True),
        ("notes/secret/z.md", "notes/**/secret/**", True),
        ("a/b/c.txt", "c.txt", True),
        ("a/b/c.txt", "b", False),
        ("x.md", "/".join(["**"] * 1100) + "/x.md", True),
        ("a/b1.md", "a/b[!2].md", True),
        ("a/B1.md", "a/b?.md", False),
        ("a/é.md", "a/?.md", True),
    ],
)
def test_globs(spark, path, pattern, want):
    assert one(spark, matches_any(F.lit(path), [pattern])) is want
    assert glob_regex(pattern).startswith("^")


def test_scope(spark):
    rows = {p: one(spark, selected(F.lit(p))) for p in ("a/b.md", "a/.x/b.md", "NODE_MODULES/a.md", "a/b.pdf", ".a.md", "")}
    assert rows == {"a/b.md": True, "a/.x/b.md": False, "NODE_MODULES/a.md": False, "a/b.pdf": False, ".a.md": False, "": False}
    assert one(spark, visible(F.lit("_x/a.bin"))) is True


def test_tokens_and_terms(spark):
    assert one(spark, lx.tokens(F.lit("Straße _a_ A.b a.B c++ -- 3.14 né"))) == ["strasse", "a", "a.b", "c++", "3.14", "né"]
    assert one(spark, lx.terms(F.lit("a.b a.c Café"))) == ["a", "b", "a", "c", "cafe"]
    assert lx.phrases("field-note Café the THE") == [["field", "note"], ["cafe"], ["the"]]
    assert one(spark, lx.tokens(F.lit(None).cast("string"))) == []


def test_identity(spark):
    text = lx.retrieval_text(F.lit("body"), F.lit("T"), F.lit(""), F.lit("f.md"))
    assert one(spark, text) == "Title: T\nFilename: f.md\nText:\nbody"
    want = hashlib.sha256(b"text-title-heading_path-filename-v1\0me\0Title: T\nFilename: f.md\nText:\nbody").hexdigest()
    assert one(spark, lx.input_hash(text, "me")) == want
    assert one(spark, lx.stem(F.lit("a/.hidden"))) == ".hidden" and one(spark, lx.stem(F.lit("a/b.c.md"))) == "b.c"
    assert one(spark, lx.excerpt(F.lit("  a \n b "), 3)) == "a b"


def test_bm25_is_what_fts5_says(spark):
    rows = [("1", "alpha needle beta", "x", "y", "a.txt"), ("2", "alpha", "needle", "y", "b.txt"), ("3", "alpha beta", "x", "needle up", "c.txt"), ("4", "beta", "x", "y", "needle.txt"), ("5", "field-note needle a.b", "x", "", "d.txt"), ("6", "", "", "", "")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, title string, heading_path string, filename string")
    index = lexical.layout(lexical.lexical_index(chunks).cache())
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(chunk_id UNINDEXED, text, title, heading_path, filename, tokenize='unicode61')")
    lex = {r.chunk_id: [r[f] for f in ("text", "title", "heading_path", "filename")] for r in chunks.select("chunk_id", *[lx.lexical_text(F.col(f)).alias(f) for f in ("text", "title", "heading_path", "filename")]).collect()}
    for k, v in lex.items():
        db.execute("INSERT INTO f VALUES (?, ?, ?, ?, ?)", (k, *v))
    for query in ("needle", "alpha beta", "field-note", "a.b needle txt"):
        match = " OR ".join(f'"{t}"' for t in query.split())
        want = dict(db.execute("SELECT chunk_id, bm25(f, 0, 1, 6, 4, 2) FROM f WHERE f MATCH ?", (match,)).fetchall())
        got = {r.chunk_id: r.score for r in lexical.bm25(index, lx.phrases(query)).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert lexical.bm25(index, []).count() == 0


def test_case_folding_is_full(spark):
    texts = ["Straße STRASSE ẞ", "ﬁne ﬂow ﬀ", "ſecret ΣΊΣΥΦΟΣ ς", "İstanbul", "ŉ ǰ ΐ և", "plain ASCII", "", "ᾳ Ὠ ꭰ", "É é"]
    got = [r.f for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(lx.fold(F.col("t")).alias("f")).collect()]
    assert got == [t.casefold() for t in texts]


def test_marks_go_from_latin_letters(spark):
    got = spark.createDataFrame([("été ḿ ṡ ế đ ǖ",)], "t string").select(lx.strip_accents(F.col("t")).alias("t")).first().t
    assert got == "ete m s ế đ u"
