"""Page walks, chunk splitting and ids."""

import pytest
from pyspark.sql import functions as F

from brightloom.operators import chunking, extract
from brightloom.operators.chunking import pack_lines
from brightloom.operators.ids import dense_ids


def test_manual_walk():
    x = "x" * 120
    html = f"<h2>4.1 A</h2><p>{x}</p><pre>fmod X is\n\n  sort S .  \nendfm</pre><h2>B</h2><p>short</p>"
    assert extract.page_chunks(html) == [("4.1 A", "code", "", "fmod X is\n  sort S .\nendfm"), ("4.1 A", "text", "", x)]
    assert extract.page_chunks(f"<p>a<b>b</b>c {x}</p>")[0][3] == f"a b c {x}"
    grammar = "<pre>term ::= other things here</pre>"
    assert extract.page_chunks(grammar) == []
    assert len(extract.page_chunks(f"<body>{grammar}</body>", extract.DOCS_SITE)) == 1
    assert extract.page_chunks(None) == extract.page_chunks("") == []


def test_unclosed_paragraphs_do_not_repeat_text():
    a, b = "a" * 80, "b" * 80
    assert extract.page_chunks(f"<p><b>{a}<br><p>{b}") == [("", "text", "", f"{a}\n{b}")]


def test_site_walk():
    prose = "y" * 110
    html = (
        '<nav><p>menu</p></nav><article><h1>T</h1><ul><li>one</li><li><p>lost</p><pre><code class="language-python">client.upsert(points=points)</code></pre></li></ul>'
        f"<p>{prose}</p><table><tr><th>k</th><td>v</td></tr><tr><td></td></tr></table><aside>no</aside></article>"
    )
    got = extract.page_chunks(html, extract.DOCS_SITE)
    assert got[0] == ("T", "code", "python", "client.upsert(points=points)")
    assert got[1] == ("T", "text", "", f"- one\n{prose}\nk | v")
    assert extract.page_chunks("<div>no zone</div>", extract.DOCS_SITE) == []


def test_windows():
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    starts = lambda n: [p.split()[0] for p in pack_lines(words(n))]
    assert starts(380) == ["w0", "w170", "w340"]
    assert starts(370) == ["w0", "w170", "w340"]
    assert len(pack_lines(words(370))[2].split()) == 30
    assert starts(200) == ["w0"]
    assert pack_lines(words(198)) == [words(198)]
    lines = "\n".join(words(90) for _ in range(5))
    assert [len(p.split()) for p in pack_lines(lines)] == [180, 180, 90]


def test_split_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a\nb", "k"), (2, None, "k")], "id long, text string, other string")
    assert [tuple(r) for r in chunking.split_chunks(df).orderBy("id").collect()] == [(1, "a\nb", "k", 0), (2, "", "k", 0)]


def test_embed_text(spark):
    df = spark.createDataFrame([("S", "text", 117), ("S", "text", 118), ("S", "code", 300), ("", "text", 5)], "s string, k string, n int")
    df = df.withColumn("t", F.repeat(F.lit("w "), F.col("n")))
    got = [r[0] for r in df.select(F.startswith(chunking.embed_text(F.col("s"), F.col("k"), F.col("t")), F.lit("S\n"))).collect()]
    assert got == [True, False, True, False]


def test_gate(spark):
    df = spark.createDataFrame([("w " * 300,)], "text string")
    with pytest.raises(ValueError, match="1 chunks exceed 256"):
        chunking.length_gate(df)
    assert chunking.length_gate(df.limit(0)).count() == 0


def test_pdf(spark):
    prose = "these words are readable and there are quite a few of them in this paragraph, so that it is kept"
    code = "fmod LONG is sort S . op f : S -> S . vars X : S . endfm"
    text = f"th T is x endth\n\n{prose}\n \n{code}\n\na b c d e f g h i j k l m n o p q r s t u v w x y z a b c d e f g h i j k l m n o p q r s"
    df = spark.createDataFrame([("d", 1, text), ("d", 2, "")], "doc string, page int, text string")
    got = [tuple(r)[3:] for r in chunking.pdf_chunks(df).orderBy("seq").collect()]
    assert got == [("code", code), ("text", prose)]


@pytest.mark.parametrize("parts", [1, 5])
def test_dense_ids(spark, parts):
    df = spark.range(100, 0, -3).select(F.col("id").alias("k")).repartition(parts)
    got = [tuple(r) for r in dense_ids(df, "k").orderBy("k").collect()]
    assert [i for _, i in got] == list(range(len(got)))
    assert dense_ids(df.limit(0), "k").count() == 0


def test_dense_ids_with_nulls_and_repeats(spark):
    from brightloom.operators.ids import dense_ids

    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d"), (1, "a")], "k long, v string").withColumnRenamed("v", "v.w")
    got = dense_ids(rows, "k").orderBy("id").collect()
    assert [r["id"] for r in got] == [0, 1, 2, 3, 4] and [r["k"] for r in got] == [None, 1, 1, 1, 2]
    assert sorted(r["v.w"] for r in got) == ["a", "a", "b", "c", "d"]
    assert dense_ids(rows.limit(0), "k").count() == 0


def test_pdf_code_pattern_stops_at_the_last_end(spark):
    import time

    from brightloom.operators.chunking import pdf_chunks

    code = "fmod X is sort S " + "y" * 40 + " endfm"
    starts = "with some of the words here again " * 30_000  # "th some" starts a block that never ends
    pages = spark.createDataFrame([("d", 1, code + "\n\n" + starts), ("d", 2, "fth a" + "b" * 60 + "endmc and so on"), ("d", 3, None)], "doc string, page int, text string")
    start = time.time()
    got = sorted((r["page"], r["type"], r["text"]) for r in pdf_chunks(pages).collect())
    assert got == [(1, "code", code), (1, "text", starts.strip()), (2, "code", "fth a" + "b" * 60 + "endm")]
    assert time.time() - start < 60
