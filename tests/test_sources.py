"""Sources, sinks, the stored index and the incremental stream."""

import json

from brightloom.operators import extract
from brightloom.sources import pages, programs, store
from brightloom.streaming import reindex


def test_sitemap(spark):
    xml = "<url><loc>https://a/x</loc></url><loc>https://a/tags/y</loc><loc>https://b/z</loc><loc>https://a/x</loc>"
    df = spark.createDataFrame([(xml,), (None,)], "xml string")
    assert [r[0] for r in pages.sitemap_urls(df, "https://a/").collect()] == ["https://a/x"]


def test_listed_pages(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([("u1", "<p>"), ("u2", "<p>")], "url string, html string").write.parquet(path)
    order = spark.createDataFrame([("u2", 0), ("gone", 1)], "url string, page_order long")
    got = {r["url"]: (r["page_order"], r["error"]) for r in pages.read_pages(spark, path, order).collect()}
    assert got == {"u2": (0, None), "gone": (1, "no page")}


def test_pages_of_one_url_keep_their_numbers(spark, tmp_path):
    """Numbers do not follow the order of rows or files."""
    given = [(f"u{i % 3}", None if i == 4 else f"<p>{i}") for i in range(30)]
    found = []
    for k, listed in enumerate((given, given[::-1], given[15:] + given[:15])):
        path = str(tmp_path / f"p{k}")
        spark.createDataFrame(listed, "url string, html string").coalesce(k + 1).write.parquet(path)
        found.append(sorted((r["page_order"], r["url"], r["html"]) for r in pages.read_pages(spark, path).collect()))
    assert [n for n, *_ in found[0]] == list(range(30)) and [u for _, u, _ in found[0]] == sorted(u for u, _ in given)
    assert found[0][10][2] is None and found[0] == found[1] == found[2]


def test_page_texts(spark):
    df = spark.createDataFrame([("d", ["a", "", "c"])], "doc string, pages array<string>")
    assert [tuple(r) for r in pages.page_texts(df).collect()] == [("d", 1, "a"), ("d", 3, "c")]


def test_program_files(spark, tmp_path):
    (tmp_path / "m1/s").mkdir(parents=True)
    (tmp_path / "m1/s/a.py").write_text("x = 1\n")
    got = programs.read_programs(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("m1", "s/a.py", ".py", "x = 1\n")]


def test_stored_json(spark):
    t = lambda x: spark.createDataFrame([("n", json.dumps(x))], "name string, text string")
    assert [tuple(r) for r in programs.compile_results(t({"a": True})).collect()] == [("a", True)]
    assert [tuple(r) for r in programs.diff_results(t({"p": {"m": {"ok": False, "status": 2, "msg": "x"}}})).collect()] == [("p", "m", False, 2, "x")]
    assert programs.given_inputs(t({"comment": "c", "tests": []})).first()["tests"] == []
    assert programs.traces(t({"file": "f", "iterations": [{"iter": 1, "ok": True}]})).first()["iterations"][0]["ok"]
    assert programs.matrix_configs(t([{"label": "a", "max_iters": 2}])).first()["max_iters"] == 2


def test_toml(spark):
    spec = '[f]\nsignature = ["nat", {type = "int", min = -3}]\nexamples = [[1, true]]\ncount = 4\n[extra]\nx = 1\n'
    got = programs.test_specs(spark.createDataFrame([("p", spec)], "name string, text string")).collect()
    assert len(got) == 1 and got[0]["cnt"] == 4 and got[0]["examples"] == [["1", "true"]] and got[0]["signature"][1]["min"] == -3.0
    prop = '[[prop]]\nname = "c"\nleft = "f({X})"\nright = "g({X})"\nvars = {X = "nat"}\n'
    got = programs.property_specs(spark.createDataFrame([("p", prop)], "name string, text string")).collect()
    assert got[0]["vars"] == {"X": "nat"} and got[0]["cnt"] is None


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "code"), (2, 1, "text")], "id long, version long, type string")
    new = spark.createDataFrame([(1, 2, "text"), (3, 1, "text")], "id long, version long, type string")
    out = store.upserted(df, new)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, "text"), (2, 1, "text"), (3, 1, "text")]
    store.write_index(out, str(tmp_path / "i"))
    assert tuple(store.summary(spark.read.parquet(str(tmp_path / "i"))).first()) == (3, 0, 3)


def test_reindex_stream(spark, tmp_path):
    src, x = str(tmp_path / "src"), "x" * 120
    schema = "page_order long, url string, html string"

    def batch(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = reindex.reindex_stream(spark.readStream.schema(schema).parquet(src), str(tmp_path / "h"), str(tmp_path / "c"), str(tmp_path / "k"))
        q.awaitTermination(120)
        return sorted(r["source"] for r in spark.read.parquet(str(tmp_path / "c")).collect())

    assert batch((0, "u1", f"<p>{x}</p>"), (1, "u2", f"<p>{x}</p>")) == ["u1", "u2"]
    assert batch((0, "u1", f"<p>{x}</p>"), (2, "u3", f"<p>{x}</p>")) == ["u1", "u2", "u3"]
    # A page that changes and changes back is indexed each time, and its last chunks count.
    assert len(batch((0, "u1", f"<p>{x}y</p>"))) == 4
    assert len(batch((0, "u1", f"<p>{x}</p>"))) == 5
    got = reindex.current_chunks(spark, str(tmp_path / "h"), str(tmp_path / "c"))
    assert sorted((r["source"], r["text"]) for r in got.collect()) == [("u1", x), ("u2", x), ("u3", x)]
    assert extract.page_chunks(None) == []
