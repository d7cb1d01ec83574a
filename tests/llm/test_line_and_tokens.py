"""Line dedup by hand-made sites; word-piece counts against the tokenizers library."""

import random

from devident.llm.line_dedup import drop_boilerplate, host, visible_text
from devident.llm.queries.line_dedup import NAME, SQL, query
from devident.llm.queries.wordpiece import vocabulary_path
from devident.llm.wordpiece import build, sentencepiece_vocabulary, token_counts
from pyspark.sql import functions as F
from tests.oracle_check import connect, difference


def test_lines_over_the_ratio_go(spark, rows):
    data = [(i, "a", f"menu \nonly {i}\n\n menu\n{'shared' if i < 2 else 'x'}") for i in range(8)]
    data += [(20, "b", "menu\nb"), (21, None, "menu"), (22, "a", None), (23, "a", ""), (24, "b", "menu\nb"), (24, "b", "menu\nb")]
    frame = rows("doc_id long, site string, text string", data).selectExpr("*", "1 AS line", "2 AS total", "'q' AS n_lines", "3 AS lines")
    got = drop_boilerplate(frame, ratio=0.5, least=3).collect()
    by = {r.doc_id: r for r in got}
    assert by[0].text == "only 0\n\nshared" and by[0].n_dropped == 2 and by[0].n_lines == 4
    assert by[5].text == "only 5\n" and by[5].n_dropped == 3
    assert by[21].text == "menu" and by[22].text is None and by[23].text == "" and by[22].n_lines == 0
    assert by[20].text == "" and len(got) == len(data)
    assert drop_boilerplate(rows("doc_id long, site string, text string", [])).count() == 0


def test_pages(spark, rows):
    html = "<html><head><title>T</title><script>var x='</p>';</script></head><body><!-- <p>no --><p>One <b>two</b>\nthree<br>four</P></body></html>"
    row = rows("url string, html string", [("https://User@WWW.Example.org:80/a?b", html)]).select(host(F.col("url")), visible_text(F.col("html"))).first()
    assert row[0] == "www.example.org" and [x.strip() for x in row[1].split("\n") if x.strip()] == ["T", "One two three", "four"]


def test_line_query_like_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert difference(query(spark, sf_dir), connect(sf_dir), SQL) is None, NAME


def test_line_query_makes_texts_once(spark):
    """What counts and drops lines reads stored texts and doesn't cut the pages again."""
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" in plan and "regexp_replace" not in plan


def reference(initial, inner, texts):
    from tokenizers import Tokenizer, models

    pieces = dict.fromkeys(["[UNK]", *initial, *["##" + p for p in inner]])
    model = Tokenizer(models.WordPiece({p: i for i, p in enumerate(pieces)}, unk_token="[UNK]", max_input_chars_per_word=10**9))
    return [model.encode(t, add_special_tokens=False).tokens for t in texts]


def test_automaton_on_small_vocabularies():
    rng = random.Random(4)
    for _ in range(60):
        make = lambda: list({"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))})
        initial, inner = make(), make()
        machine = build(initial, inner)
        texts = ["".join(rng.choices("abcd" if rng.random() < 0.1 else "abc", k=rng.randint(1, 14))) for _ in range(60)]
        for text, tokens in zip(texts, reference(initial, inner, texts)):
            assert machine.count(text) == (0 if tokens == ["[UNK]"] else len(tokens)), (initial, inner, text)


def test_counts_like_the_library(spark, rows):
    initial, inner = sentencepiece_vocabulary(vocabulary_path())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = rows("doc_id long, text string", [(-1, None), (-2, ""), (-3, "日本語テキスト ☃☃ \U0001f600"), (None, "x"), (-4, "a" * 5000)])
    frame = docs.select("doc_id", "text").unionByName(extra).selectExpr("*", "1 AS n_words", "'a' AS n_tokens")
    got = {r.doc_id: r for r in token_counts(frame, build(initial, inner)).collect()}
    texts = {r.doc_id: r.text for r in frame.collect()}
    for doc_id, text in texts.items():
        tokens = reference(initial, inner, (text or "").split()) if doc_id in (-3, -4, None) or (doc_id or 0) % 10 == 0 else None
        if tokens is not None:
            assert got[doc_id].n_tokens == sum(map(len, tokens)) and got[doc_id].n_unknown == sum(t == ["[UNK]"] for t in tokens)
    assert got[-1].n_tokens == got[-2].n_tokens == 0
    assert token_counts(rows("doc_id long, text string", []), build(["a"], ["b"])).count() == 0


def test_small_sites(spark, rows):
    data = [(10 * n + i, f"h{n}", f"menu\nown {n} {i}") for n in (1, 2, 3, 4) for i in range(n)]
    data += [(100 + i, "big", "menu\nx" + str(i) if i < 2 else f"y{i}") for i in range(40)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in drop_boilerplate(rows("doc_id long, site string, text string", data)).collect()}
    assert got[10] == ("menu\nown 1 0", 0) and got[100] == ("menu\nx0", 0)  # 2 of 40 pages are 5 %, not more
    assert all(got[10 * n + i] == (f"own {n} {i}", 1) for n in (2, 3, 4) for i in range(n))


def test_long_page(spark, rows):
    text = "\n".join(["menu"] * 3 + [f"line {i}" for i in range(50_000)])
    frame = rows("doc_id long, site string, text string", [(i, "a", text if i == 0 else f"menu\n{i}") for i in range(6)])
    got = {r.doc_id: r for r in drop_boilerplate(frame).collect()}
    assert got[0].n_dropped == 3 and got[0].n_lines == 50_003 and got[5].text == "5"


def test_clashing_columns_of_counts_are_replaced(rows):
    frame = rows("doc_id long, text string", [(1, "a ab"), (2, None)]).selectExpr("*", "'x' AS n_words", "'y' AS n_unknown", "3 AS other")
    got = token_counts(frame, build(["a"], ["b"]), keep=("doc_id", "n_words", "n_unknown", "other"))
    assert got.columns == ["doc_id", "other", "n_words", "n_tokens", "n_unknown"]
    assert [tuple(r) for r in got.collect()] == [(1, 3, 2, 3, 0), (2, 3, 0, 0, 0)]
