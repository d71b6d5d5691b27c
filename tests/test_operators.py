import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark import providers
from quillspark.config import Features, PreprocessOptions, RerankOptions, TokenBudgets
from quillspark.functions import text as X
from quillspark.functions import vector as VEC
from quillspark.functions.predicates import ALL, Custom, OneOf, where
from quillspark.operators import attach, chunk, evaluate, graph, index, pages, retrieve, state, structure
from quillspark.sources import loaders, office
from quillspark.streaming import feed


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first()["r"]


# -- text -----------------------------------------------------------------------------


@pytest.mark.parametrize("raw, clean", [
    ("преобразо-\nватель", "преобразователь"), ("multi-\nmodal", "multimodal"), ("RS-\n485", "RS-485"), ("МВА8-\n24В", "МВА8-24В"),
    ("Слово­перенос  с  ним", "Словоперенос с ним"), ("1. Введение ..... 3", "1. Введение 3"), ("a . . . . 15", "a 15"),
    ("a\r\nb\n\n\n\nc", "a\nb\n\nc"), ("", ""), (None, None),
])
def test_clean(spark, raw, clean):
    assert one(spark, X.clean, raw) == clean


@pytest.mark.parametrize("raw, out", [("§17.2 Scope", "S17.2"), ("Article 17", "Art17"), ("RFC 7807 x", "RFC7807"), ("Other", None)])
def test_formal_id(spark, raw, out):
    assert one(spark, X.formal_id, raw) == out


def test_small_texts(spark):
    assert one(spark, X.base64url, "a?b>~~") == "YT9iPn5-"
    assert one(spark, X.label, "a b-c!") == "abc" and one(spark, X.label, "!!") == "Unknown"
    assert one(spark, X.slug, "Über  Uns!") == "über-uns" and one(spark, X.slug, "??") == "node"
    assert [one(spark, X.column_index, c) for c in ("A", "Z", "AA", "BC12")] == [0, 25, 26, 54]
    assert one(spark, X.parse_score, "score: 0,75") == 0.75 and one(spark, X.parse_score, "none") == 0.5 and one(spark, X.parse_score, "7") == 1.0
    h = 2166136261
    for c in "abc":
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    assert one(spark, X.fnv1a, "abc") == h
    assert one(spark, lambda c: X.truncate(c, 3), "ab\ncd") == "ab ..."


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.7071, 0.7071]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 4) for r in df.select(VEC.cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, 0.0, 0.0, 0.0]
    v = one(spark, VEC.hash_embedding, "one two two")
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-6
    assert sum(one(spark, VEC.sparse_counts, "one two two").values()) == 3
    assert one(spark, lambda c: VEC.usable(c, 2), [1.0, float("nan")], "array<float>") is False


# -- predicates -----------------------------------------------------------------------------


def test_predicates(spark):
    rows = [("hr", 2020, None), ("tech", None, "50%_x"), (None, 2024, "abc")]
    df = spark.createDataFrame([(r,) for r in rows], "metadata struct<silo:string,fiscal_year:int,title:string>")
    n = lambda p: df.where(p.column()).count()
    assert n(where(lambda m: m.silo != "hr")) == 2
    assert n(~where(lambda m: m.silo == "hr")) == 2
    assert n(where(lambda m: m.fiscal_year >= 2020)) == 2 and n(where(lambda m: m.fiscal_year == None)) == 1  # noqa: E711
    assert n(where(lambda m: m.title.contains("%_"))) == 1
    assert n(OneOf("silo", [])) == 0 and n(OneOf("silo", ["hr", None])) == 1 and n(ALL) == 3
    assert n(Custom(lambda m: m["silo"] is None)) == 1
    with pytest.raises(ValueError):
        where(lambda m: m.fiscal_year > None).column()


def test_rendered_predicates():
    p = where(lambda m: (m.confidentiality_level == "a'b") & (m.fiscal_year > 2020))
    assert p.render("sql") == "(confidentiality = 'a''b' AND fiscal_year > 2020)"
    assert p.render("odata") == "(confidentiality eq 'a''b' and fiscal_year gt 2020)"
    assert '"range": {"gt": 2020}' in p.render("json")
    assert where(lambda m: m.id != 3).render("sql") == "(document_id <> 3 OR document_id IS NULL)"
    assert where(lambda m: m.title.contains("50%")).render("sql") == "title LIKE '%50\\%%' ESCAPE '\\'"
    assert OneOf("silo", []).render("sql") == "1 = 0" and Custom(bool).render("sql") is None
    assert where(lambda m: m.last_modified > dt.date(2020, 1, 1)).render("json") is None


# -- chunks ------------------------------------------------------------------------------------


def test_fixed_windows_tile(spark):
    text = "abcdefghij" * 7
    rows = chunk.fixed_size(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "xy")], "id int, t string"), "id", "t", 20, 5).orderBy("id", "chunk_index").collect()
    first = [r for r in rows if r["id"] == 1]
    assert [(r["start_char_offset"], r["end_char_offset"]) for r in first] == [(0, 20), (15, 35), (30, 50), (45, 65), (60, 70)]
    assert all(text[r["start_char_offset"] : r["end_char_offset"]] == r["text"] for r in first)
    assert [r["text"] for r in rows if r["id"] == 4] == ["xy"] and {r["id"] for r in rows} == {1, 4}


def test_sentences_and_recursion(spark):
    text = "One here. Two there? 3 more!\n\nLast one."
    df = spark.createDataFrame([(1, text)], "id int, t string")
    rows = chunk.sentence_groups(df, "id", "t", 2).orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == ["One here. Two there?", "3 more!\n\nLast one."]
    assert all(text[r["start_char_offset"] : r["end_char_offset"]] == r["text"] for r in rows)
    long = "## A\nx" + "y" * 30 + "\n## B\n" + " ".join(["word"] * 12)
    rows = chunk.recursive(spark.createDataFrame([(1, long)], "id int, t string"), "id", "t", 20).collect()
    assert all(len(r["text"]) <= 20 and long[r["start_char_offset"] : r["end_char_offset"]] == r["text"] for r in rows)


def test_token_budget(spark):
    df = spark.createDataFrame([("d#0", "d", 0, "a b c d e f g", 10, 23), ("d#1", "d", 1, "x", 30, 31), ("d#2", "d", 2, None, 0, 0)],
                               "chunk_id string, document_id string, chunk_index int, text string, start_char_offset int, end_char_offset int")
    rows = chunk.token_budget(df, 3, lambda t: len(t.split())).orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == ["a b c", "d e f", "g", "x"] and [r["chunk_id"] for r in rows] == ["d#0", "d#1", "d#2", "d#3"]
    kept = chunk.token_budget(df, 3, lambda t: len(t.split()), reindex=False, suffix_ids=True).orderBy("start_char_offset").collect()
    assert [r["chunk_id"] for r in kept] == ["d#0", "d#0.1", "d#0.2", "d#1"] and kept[1]["chunk_index"] == 0
    assert (TokenBudgets(450, 80, 70).base, TokenBudgets(512, 100, 112).base) == (300, 300)
    with pytest.raises(ValueError):
        TokenBudgets(100, 60, 40)


def test_code_and_tables(spark):
    code = "using System;\nnamespace A;\npublic class B\n{\n  public int C(int x)\n  {\n    return x;\n  }\n}\n"
    rows = chunk.code_declarations(spark.createDataFrame([(1, code, "b.cs"), (2, "text", "b.txt")], "id int, t string, p string"), "id", "t", "p").collect()
    assert [(r["id"], r["name"]) for r in rows] == [(1, "B"), (1, "C"), (2, None)]
    md = "# H\nintro\n## T\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |"
    rows = chunk.atomic_tables(spark.createDataFrame([(1, md)], "id int, t string"), "id", "t", 1).orderBy("chunk_index").collect()
    assert [r["text"].split("\n")[0] for r in rows] == ["H", "H > T", "H > T"] and all("| a | b |" in r["text"] for r in rows[1:])


def test_pages(spark):
    def page(n, body):
        return f"## Page {n}\nCompany Report\n{body}\nСтр. {n} из 3"

    words = "Here is a text that has more than forty letters, number "
    content = "\n\n".join(page(n, words + str(n)) for n in (1, 2, 3))
    out = pages.preprocess(spark.createDataFrame([("d", content), ("e", "one page")], "document_id string, content string")).orderBy("document_id").collect()
    assert "Company Report" not in out[0]["content"] and "Стр." not in out[0]["content"] and words.strip() in out[0]["content"]
    assert out[1]["content"] == "one page"
    four = "## Page 1\n" + words * 2 + "\n\n## Page 2\nДля заметок.\n\n## Page 3\n3\n\n## Page 4\n| a | b |"
    kept = pages.keep_pages(pages.split_pages(spark.createDataFrame([("d", four)], "document_id string, content string")), PreprocessOptions(least_letters=30)).collect()
    assert sorted(r["page_index"] for r in kept) == [1, 4]


def test_page_numbers_and_fillers(spark):
    """Page numbers go always, a lone line counts on both sides, phrases are whole pages, and each step can be left out."""
    body = "Words enough to be a page of its own in this document of pages "
    feet = ["Page 1 of 4", "2", "стр. 3", "4 / 4"]
    content = "\n".join(f"## Page {n}\n{body}{'abcd'[n - 1]}\n{x}" for n, x in enumerate(feet, 1)) + "\n## Page 5\nДЛЯ ЗАПИСЕЙ!\n## Page 6\nnotes on paper"
    docs = spark.createDataFrame([("d", content), ("e", "## Page 1\n1\n## Page 2\n2"), ("f", " \n "), ("g", None), ("h", "")], "document_id string, content string")

    def run(**options):
        return {r["document_id"]: r["content"] for r in pages.preprocess(docs, PreprocessOptions(**options)).collect()}

    got = run()
    assert got == {"d": "\n\n".join(f"## Page {n}\n{body}{'abcd'[n - 1]}" for n in range(1, 5)), "e": "", "f": " \n ", "h": ""}
    assert "ЗАПИСЕЙ" in run(drop_empty_pages=False)["d"] and "Page 1 of 4" not in run(drop_empty_pages=False)["d"]
    assert "Page 1 of 4" in run(strip_running_lines=False)["d"] and run(strip_running_lines=False, drop_empty_pages=False)["e"].count("## Page") == 2
    assert "notes on paper" in run(least_letters=5)["d"] and "ЗАПИСЕЙ" in run(least_letters=5, phrases=())["d"]
    lone = spark.createDataFrame([("d", n, f"## Page {n}", "Same line") for n in range(3)], "document_id string, page_index int, header string, body string")
    assert {(r["drop_first"], r["drop_last"], r["body"]) for r in pages.strip_running_lines(lone).collect()} == {(True, False, "")}


def test_codes_over_line_ends(spark):
    rows = spark.createDataFrame([("RS-\n485 and преобразова-\nтель, ab-\nCd, x-\n1, a-\n b",)], "t string")
    assert rows.select(X.dehyphenate(F.col("t"))).first()[0] == "RS-485 and преобразователь, ab-Cd, x-1, a-b"


def test_answers(spark):
    facts = F.array(F.lit("alpha"), F.lit("beta"))
    rows = spark.createDataFrame([(0, "Alpha one!\nBeta two. gamma", "alpha"), (1, "", "x"), (2, None, None), (3, "[Ошибка: alpha]", "alpha"), (4, "также", "z"), (5, "word", " ")], "i int, a string, c string")
    got = rows.orderBy("i").select(evaluate.grounded_share(F.col("a"), F.col("c")), evaluate.fact_share(F.col("a"), facts), evaluate.extractive_answer(F.col("a"), facts)).collect()
    assert [r[0] for r in got] == [round(1 / 3, 6), 0.0, 0.0, 0.5, 1.0, 0.0] and [r[1] for r in got] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert got[0][2] == "Alpha one!. Beta two." and got[1][2] == got[2][2] == evaluate.NO_ANSWER


def test_facts_of_a_first_page(spark):
    from quillspark.sources.facts import document_facts

    lines = ["ООО «Прибор»", "Руководство по эксплуатации", "РАПМ.421.345 РЭ v2.1", "Модуль ввода сигналов", "Нижний Новгород, 2031", "Москва 2019"]
    rows = [("a", "/x/hr-policies/f.pdf", lines, None, "Admin", None), ("b", "f b!.pdf", None, "Untitled", " A. Author ", None), ("c", None, [], "Real title", None, None), ("d", "/?.pdf", [None], None, None, None)]
    schema = "document_id string, source_path string, lines array<string>, info_title string, info_author string, modified date, extra int"
    got = {r["document_id"]: r for r in document_facts(spark.createDataFrame([(*r, 1) for r in rows], schema), "2025-06-01").collect()}
    a = got["a"]
    assert (a["id"], a["silo"], a["office"], a["document_type"], a["fiscal_year"], a["author"]) == ("РАПМ.421.345-РЭ-v2.1", "hr-policies", "Нижний Новгород", "Runbook", 2019, "ООО")
    assert a["title"] == "РАПМ.421.345 РЭ v2.1 — Руководство по эксплуатации — Модуль ввода сигналов"
    assert (got["b"]["id"], got["b"]["title"], got["b"]["author"], got["b"]["fiscal_year"]) == ("f-b", "f b!", "A. Author", 2025)
    assert got["c"]["title"] == "Real title" and got["c"]["id"].startswith("doc-") and got["d"]["id"].startswith("doc-")


def test_words_to_pages(spark):
    w = [("d", 2, "b", 5.0, 90.0), ("d", 2, "a", 1.0, 90.9), ("d", 1, "x", 1.0, 10.0), ("d", 1, "top", 1.0, 40.0), ("d", 3, " ", 1.0, 1.0)]
    df = spark.createDataFrame(w, "document_id string, page_number int, text string, left double, bottom double")
    assert pages.assemble_words(df).first()["content"] == "## Page 1\n\ntop\nx\n\n\n## Page 2\n\na b"
    assert pages.assemble_words(df, None).first()["content"] == "top\nx\n\n\na b"


def test_index_strategies(spark):
    c = spark.createDataFrame([("1", "One. Two."), ("2", "  "), ("3", None)], "chunk_id string, text string")
    chat = providers.RuleChat([("One", "First?\n\n Second? ")], "")
    got = lambda name: [tuple(r) for r in index.index_rows(c, name, chat).collect()]
    assert got("sub-chunk") == [("One.", "1")] and got("query") == [("First?", "1"), ("Second?", "1")] and got("summary") == [("First?\n\n Second?", "1")]
    with pytest.raises(ValueError):
        index.index_rows(c, "query")


def test_version_guard_of_a_hot_document(spark):
    """One document with most events, cut into many blocks, gives what a walk over all events gives."""
    import random

    draw = random.Random(1)
    rows = [(n, "hot" if draw.random() < 0.9 else draw.choice(["a", "b", None]), "t", draw.choice([None, *range(n // 10, n // 10 + 30)])) for n in range(800)]
    df = spark.createDataFrame(rows, "seq bigint, document_id string, tenant_id string, version bigint")
    last, want = {}, []
    for n, d, _, v in rows:
        if v is not None and (d not in last or v > last[d]):
            want.append(n)
            last[d] = v
    known = spark.createDataFrame([("hot", 40)], "document_id string, version bigint")
    for block in (7, 1 << 18):
        assert sorted(r["seq"] for r in state.above_all_earlier(df, None, block).collect()) == want
        assert min(r["version"] for r in state.above_all_earlier(df, known, block).where("document_id = 'hot'").collect()) > 40


# -- retrieval ---------------------------------------------------------------------------------------


def results(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, chunk_id string, rank int, score double")


def test_fusion_values(spark):
    a = results(spark, ("q", "c1", 1, 0.9), ("q", "c2", 2, 0.5))
    b = results(spark, ("q", "c1", 1, 7.0), ("q", "c3", 2, 1.0))
    got = {r["chunk_id"]: r["score"] for r in retrieve.rrf([a, b], 10).collect()}
    assert got == {"c1": round(2 / 61, 6), "c2": round(1 / 62, 6), "c3": round(1 / 62, 6)}
    assert {r["chunk_id"]: r["score"] for r in retrieve.rrf_full_outer(a, b, 10).collect()} == got
    assert {r["chunk_id"]: r["score"] for r in retrieve.weighted(a, b, 10).collect()} == {"c1": 1.0, "c2": 0.0, "c3": 0.0}
    assert [r["chunk_id"] for r in retrieve.cascade(a, b, 5).orderBy("rank").collect()] == ["c1", "c2", "c3"]


@pytest.mark.parametrize("n, order", [(5, [1, 3, 5, 4, 2]), (4, [1, 3, 4, 2]), (1, [1])])
def test_interleave(spark, n, order):
    rows = retrieve.interleave(results(spark, *(("q", f"c{i}", i, 1.0 / i) for i in range(1, n + 1)))).orderBy("position").collect()
    assert [r["rank"] for r in rows] == order


def test_knn_bm25_hybrid(spark):
    rows = spark.createDataFrame([("c1", [1.0, 0.0, 0.0], "relay control board"), ("c2", [0.7071, 0.7071, 0.0], "other"), ("c3", [0.0, 0.0, 1.0], "relay"), ("c4", [0.0, 1.0, 0.0], "none")],
                                 "chunk_id string, vector array<float>, text string")
    knn = retrieve.knn(rows, [("q", [1.0, 0.0, 0.0])], 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in knn] == ["c1", "c2", "c3"]
    top = retrieve.hybrid(rows, [("q", "relay")], [("q", [1.0, 0.0, 0.0])], 4).orderBy("rank").collect()
    assert top[0]["chunk_id"] in ("c1", "c3") and {r["chunk_id"] for r in top} == {"c1", "c2", "c3", "c4"}
    dense = retrieve.hybrid(rows, [("q", "... ??? !!!")], [("q", [1.0, 0.0, 0.0])], 2).orderBy("rank").collect()
    assert dense[0]["chunk_id"] == "c1" and dense[0]["score"] > 0.99
    assert retrieve.bm25(rows, [("q", "rel")], 5, prefix=True).count() == 2 and retrieve.bm25(rows, [("q", "rel")], 5).count() == 0


def test_rerank_crag_mmr(spark):
    rows = results(spark, ("q", "c1", 1, 0.9), ("q", "c2", 2, 0.8), ("q", "c3", 3, 0.7)).withColumn("s", F.expr("map('c1', 0.2, 'c2', 0.95, 'c3', 0.6)[chunk_id]").cast("double"))
    assert [r["chunk_id"] for r in retrieve.rerank(rows, F.col("s"), 2).orderBy("rank").collect()] == ["c2", "c3"]
    assert [r["chunk_id"] for r in retrieve.rerank(rows, F.col("s"), 3, floor=0.5).orderBy("rank").collect()] == ["c2", "c3"]
    graded = rows.withColumn("grade", F.lit("INCORRECT"))
    assert retrieve.crag(graded, 2).count() == 0 and retrieve.crag(graded, 2, rows).count() == 2
    near = spark.createDataFrame([("q", "a", 1.0, [1.0, 0.0]), ("q", "b", 0.99, [1.0, 0.0]), ("q", "c", 0.6, [0.0, 1.0]), ("q", "d", 0.6, [0.0, -1.0])],
                                 "query_id string, chunk_id string, score double, vector array<double>")
    assert [r["chunk_id"] for r in retrieve.mmr(near, 3).orderBy("rank").collect()] == ["a", "c", "d"]


def test_metrics_and_cost(spark):
    judged = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, False)], "query_id string, rank int, relevant boolean")
    m = evaluate.retrieval_metrics(judged).first()
    assert (m["recall_5"], m["mrr"], m["zero_hit"]) == (0.5, 0.25, 0.5)
    df = spark.createDataFrame([(1000, 500, 250)], "e int, p int, c int")
    assert str(df.select(evaluate.cost(F.col("e"), F.col("p"), F.col("c"))).first()[0]) == "0.200000"
    rows = spark.createDataFrame([("g", "a"), ("g", "abc"), ("g", "abcdefg"), ("g", "abcd")], "g string, t string")
    s = evaluate.size_summary(rows, "g", "t").first()
    assert (s["median"], s["mean"]) == (4, 3.75)


# -- index, attach, graph, tree, state --------------------------------------------------------------------


def test_upsert_and_reingest(spark):
    old = spark.createDataFrame([("d#0", "d", "x"), ("d#1", "d", "y"), ("e#0", "e", "z")], "chunk_id string, document_id string, text string")
    new = spark.createDataFrame([("d#0", "d", "new")], old.schema)
    assert {r["chunk_id"]: r["text"] for r in index.upsert(old, new).collect()} == {"d#0": "new", "d#1": "y", "e#0": "z"}
    assert {r["chunk_id"] for r in index.reingest(old, new).collect()} == {"d#0", "e#0"}
    assert [r["chunk_id"] for r in index.orphans(old, new).collect()] == ["d#1"]


def test_attach_levels(spark):
    c = spark.createDataFrame([("d", "d#0", 0, "Intro, see IMG-7", 0, 10, [1], "Alpha"), ("d", "d#1", 1, "Body of Beta", 10, 20, [2, 3], "B"), ("d", "d#2", 2, None, 30, 40, [3], None)],
                              "document_id string, chunk_id string, chunk_index int, text string, start_char_offset int, end_char_offset int, pages array<int>, section string")
    rows = [("inside", 9, None, 15, None), ("edge", 9, None, 10, None), ("zero", 3, None, 0, None), ("img-7", 3, "beta", 500, None), ("table", 3, None, 0, "BODY of"), ("heading", 1, "ALPHA", 400, None),
            ("in text", 1, "beta", None, None), ("page", 3, " ", 400, None), ("far", 9, None, 300, None), ("none", 9, None, 0, None)]
    e = spark.createDataFrame([("d", *r) for r in rows], "document_id string, element_id string, page_number int, section_heading string, start_char_offset int, content string")
    got = {r["element_id"]: (r["chunk_id"], r["level"]) for r in attach.attach_elements(e, c).collect()}
    assert got == {"inside": ("d#1", 1), "edge": ("d#0", 1), "zero": ("d#1", 4), "img-7": ("d#0", 2), "table": ("d#1", 2), "heading": ("d#0", 3), "in text": ("d#1", 3), "page": ("d#2", 4),
                   "far": ("d#2", 5), "none": ("d#0", 5)}


def test_places_and_additions(spark):
    content = "## Page 1\n# One\nfirst words here\n\n[Page 2]\nsecond words\n--- Page 3 ---\n## Two\nlast"
    docs = spark.createDataFrame([("d", content), ("n", "no marks")], "document_id string, content string")
    rows = [("d#0", "d", 0, content[:20], 0, 20), ("d#1", "d", 1, "words here", 20, 45), ("d#2", "d", 2, "## Own\nx", 50, 60), ("d#3", "d", 3, None, 5, 5), ("d#4", "d", 4, "[Page 7]", 9, 9), ("n#0", "n", 0, "no", 0, 2)]
    c = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, text string, start_char_offset int, end_char_offset int")
    got = {r["chunk_id"]: (r["pages"], r["section"]) for r in attach.chunk_places(c, docs).collect()}
    assert got == {"d#0": ([1], "Page 1"), "d#1": ([1, 2], "One"), "d#2": ([2, 3], "Own"), "d#3": ([1], "Pa"), "d#4": ([7], "Page 1"), "n#0": ([1], None)}
    e = [("d", "f1", 1, None, 3, "A picture", "Figure", 1), ("d", "t1", 1, None, 2, "| a |\n| - |", "Table", 0), ("d", "f2", 1, None, 0, "WORDS HERE", "Figure", 2), ("n", "t2", 1, None, 0, " ", "Table", 0)]
    elements = spark.createDataFrame(e, "document_id string, element_id string, page_number int, section_heading string, start_char_offset int, content string, kind string, element_no int")
    out = {r["chunk_id"]: (r["text"], r["figures"], r["tables"]) for r in attach.augmented(c, elements, docs).collect()}
    assert out["d#0"] == (content[:20] + "\n\n[Figure f1] A picture\n\n[Table t1]\n| a |\n| - |", 1, 1) and out["d#1"] == ("words here", 1, 0) and out["n#0"] == ("no", 0, 1)
    assert out["d#3"] == (None, 0, 0) and len(out) == 6


def test_components_and_hops(spark):
    edges = spark.createDataFrame([("a", "B"), ("b", "c"), ("x", "y"), ("c", "A"), ("m", "m")] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)], "from_id string, to_id string")
    got = {r["id"]: r["component"] for r in graph.connected_components(edges, spark.createDataFrame([("lone",)], "id string")).collect()}
    assert got["c"] == got["b"] == got["a"] == "a" and got["y"] == "x" and got["lone"] == "lone" and {v for k, v in got.items() if k[0] == "p"} == {"p000"}
    hops = {r["id"]: r["hop"] for r in graph.within_hops(edges, spark.createDataFrame([("P000",)], "id string"), 3).collect()}
    assert hops == {"p000": 0, "p001": 1, "p002": 2, "p003": 3}
    assert graph.connected_components(edges.where("false")).count() == 0


def test_community_blocks_hold_every_member(spark):
    edges = spark.createDataFrame([(f"v{i:03d}", "hub") for i in range(100)] + [("x", "y")], "from_id string, to_id string")
    entities = spark.createDataFrame([(f"V{i:03d}", "T", f"n{99 - i:03d}") for i in range(100)] + [("hub", "T", "n050"), ("y", "U", "why")], "id string, type string, name string")
    got = sorted(graph.community_blocks(graph.connected_components(edges), entities, 30).collect())
    assert [(r["community_id"], r["block_no"], r["members"]) for r in got] == [(0, 0, 30), (0, 1, 30), (0, 2, 30), (0, 3, 11), (1, 0, 1)]
    assert ", ".join(r["text"][len("Members: "):] for r in got[:4]) == ", ".join(sorted([f"T: n{i:03d}" for i in range(100)] + ["T: n050"]))


def test_the_whole_graph_takes_part(spark, data):
    from quillspark.plans import catalog

    members = sum(spark.read.parquet(f"{data}/{t}.parquet").count() for t in ("customer", "supplier", "nation", "region"))
    rows = catalog.queries()["community_texts_all"](spark, data).collect()
    assert sum(r["members"] for r in rows) == members and max(r["members"] for r in rows) <= 500
    assert {r["id"][0] for r in catalog.queries()["graph_search_all"](spark, data).collect()} == set("csnr")


def test_tree(spark):
    md = "# A\nsee § 2\n### B\n## C\n# §2 Law\ntext Article 9\n## A\n"
    t = structure.node_ids(structure.heading_tree(spark.createDataFrame([("d", md)], "document_id string, content string"))).orderBy("node_no").collect()
    assert [(r["level"], r["parent_no"]) for r in t] == [(1, None), (3, 1), (2, 1), (1, None), (2, 4)]
    assert t[3]["node_id"] == "S2" and t[1]["path"] == "A > B"
    refs = structure.cross_references(structure.heading_tree(spark.createDataFrame([("d", md)], "document_id string, content string"))).collect()
    assert [(r["node_no"], r["target_no"]) for r in refs] == [(1, 4)]


def test_expiry_and_eviction(spark):
    now = "2025-01-01 00:00:00"
    rows = spark.createDataFrame([("a", 1, dt.datetime(2025, 1, 1)), ("b", 1, dt.datetime(2025, 1, 2)), ("b", 2, dt.datetime(2024, 1, 1))], "k string, seq int, expires_at timestamp")
    assert [r["k"] for r in state.live_states(rows, "k", "seq", now).collect()] == []
    cache = spark.createDataFrame([("k1", ["a", "b"]), ("k2", ["c"])], "key string, members array<string>")
    assert [r["key"] for r in state.evict(cache, spark.createDataFrame([("b",)], "id string")).collect()] == ["k2"]


def test_guard_stream_equals_batch(spark, tmp_path):
    import random

    random.seed(1)
    rows = [(i, f"d{random.randrange(5) if i % 3 else 0}", random.choice(["t", None]), random.randrange(20)) for i in range(300)]
    df = spark.createDataFrame(rows, "seq bigint, document_id string, tenant_id string, version bigint")
    for k in range(3):  # three files, one for each micro-batch, in the order of seq
        df.where(f"seq div 100 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "change_event.parquet"))
    want = {tuple(r) for r in state.version_guard(df).select("seq", "document_id", "version").collect()}
    stream = feed.stream_table(spark, str(tmp_path), "change_event", files_a_trigger=1)
    seen = []
    got = feed.run_version_guard(stream, str(tmp_path / "run"), sink=lambda d, n: seen.append(n))
    assert {tuple(r) for r in got.select("seq", "document_id", "version").collect()} == want and len(seen) == 3
    again = feed.run_version_guard(feed.stream_table(spark, str(tmp_path), "change_event", files_a_trigger=1), str(tmp_path / "run"))
    assert again.count() == len(want)  # restarted from its checkpoint: nothing new


def test_accept_without_order_of_arrival(spark):
    df = spark.createDataFrame([(2, "d", 5), (1, "d", 7), (3, "d", 7), (4, "d", 8)], "seq bigint, document_id string, version bigint")
    known = spark.createDataFrame([("d", 6)], "document_id string, version bigint")
    assert sorted(r["seq"] for r in feed.accept(df, known).collect()) == [1, 4]


# -- sources, providers, engine --------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    data = office.write_docx(["# Title", "Body & more", "## Sub"], "T", "A")
    d = office.read_docx(data)
    assert d["content"] == "# Title\n\nBody & more\n\n## Sub" and (d["title"], d["author"]) == ("T", "A")
    x = office.read_xlsx(office.write_xlsx({"S": [["a", "", "c"], ["", "", ""], ["1", "x|y", "3\n4"]]}))
    assert x["content"] == "## Sheet: S\n\n| a | Col_2 | c |\n| --- | --- | --- |\n| 1 | x\\|y | 3 4 |"
    for bad, kind in ((b"junk", office.InvalidDocument), (office.write_docx([]), office.EmptyDocument), (office.write_xlsx({}), office.EmptyDocument)):
        with pytest.raises(kind):
            (office.read_xlsx if bad[:2] == b"PK" and b"workbook" in bad else office.read_docx)(bad)
    (tmp_path / "hr").mkdir()
    (tmp_path / "hr" / "a.docx").write_bytes(data)
    (tmp_path / "hr" / "b.docx").write_bytes(b"junk")
    (tmp_path / "hr" / "c.md").write_text("# Leave policy\ntext")
    (tmp_path / "hr" / "d.pdf").write_bytes(b"%PDF")
    rows = {r["id"]: r for r in loaders.with_metadata(loaders.load(spark, str(tmp_path))).collect()}
    assert rows["a"]["error"] is None and rows["b"]["error"].startswith("invalid") and rows["d"]["error"].startswith("unsupported")
    assert rows["c"]["title"] == "Leave policy" and rows["c"]["document_type"] == "Policy" and rows["c"]["silo"] == "hr"


def test_providers(spark):
    from quillspark import providers as P

    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise P.Transient("busy")
        return 7

    assert P.with_retry(flaky, sleep=lambda s: None) == 7 and len(calls) == 3
    assert P.stream_text(['data: {"choices":[{"delta":{"content":"a"}}]}', "data: junk", 'data: {"choices":[{"delta":{"content":"b"}}]}', "data: [DONE]", "data: x"]) == "ab"
    now = [0.0]
    fetched = []
    cache = P.TokenCache(lambda: (fetched.append(1) or "t", now[0] + 100), lambda: now[0])
    cache.get(), cache.get()
    now[0] = 50
    cache.get()
    assert len(fetched) == 2
    got = P.parse_entities('x {"entities":[{"name":"A"},{"name":"B","id":"b"}],"relations":[{"from":"a","to":"B"},{"from":"a","to":"z"}]} y')
    assert [e["type"] for e in got["entities"]] == ["Unknown", "Unknown"] and len(got["relations"]) == 1
    assert P.parse_entities("junk {") == {"entities": [], "relations": []}
    df = spark.createDataFrame([("what is x",), (None,)], "p string")
    assert [r["reply"] for r in P.complete(df, "p", P.RuleChat([("x", "yes")], "no")).collect()] == ["yes", "no"]


def test_engine(spark, tmp_path):
    from quillspark.config import StoreOptions
    from quillspark.engine import Engine
    from quillspark.providers import RuleChat

    docs = spark.createDataFrame([("d", "The relay board.\n\nAnother part about leave."), ("e", "Power feed text.")], "document_id string, content string")
    e = Engine(spark, store=StoreOptions(str(tmp_path)), rerank=RerankOptions("cross-encoder"), chat=RuleChat([("Grade: .*relay", "CORRECT"), ("Grade", "INCORRECT")], "relay"))
    e.write(e.embed(e.chunks(docs, "sentence", size=1)), "main")
    e.write(e.embed(e.chunks(docs.where("document_id = 'e'"), "sentence", size=1)), "main")
    store = e.read("main")
    assert store.count() == store.select("chunk_id").distinct().count()
    for mode in ("dense", "sparse", "hybrid"):
        assert e.retrieve(store, [("q", "relay board")], 1, mode).first()["chunk_id"] == "d#0"
    for name in ("hyde", "rag-fusion", "stepback", "crag"):
        assert e.enhanced(name, store, [("q", "relay board")], 1).first()["chunk_id"] == "d#0"
    e.remove(spark.createDataFrame([("d#0",)], "chunk_id string"), "main")
    assert e.read("main").where("chunk_id = 'd#0'").count() == 0
    with pytest.raises(ValueError):
        e.retrieve(store, [("q", "x")], 1, "other")
    assert not Features({"a": {"b": "yes"}}).enabled("a.b") and Features({"a": {"b": True}}).enabled("a.b") and not Features().enabled("a")


def test_captions_reports_and_picks(spark):
    assert one(spark, X.figure_caption, "text\n Рис. 3 Схема\nmore") == "Рис. 3 Схема" and one(spark, X.figure_caption, "none") is None
    assert one(spark, X.numbered_heading, "1.2 Title") == "### 1.2 Title" and one(spark, X.numbered_heading, "12 units came.") == "12 units came."
    table = spark.createDataFrame([("b", None), ("a", 1)], "k string, v int")
    assert evaluate.markdown_report("T", table, "k") == "# T\n\n| k | v |\n| --- | --- |\n| a | 1 |\n| b |  |\n"
    tree = structure.heading_tree(spark.createDataFrame([("d", "# A\nsee § 2\n# §2 Law\ntext")], "document_id string, content string"))
    got = structure.picked_nodes(tree, [("d", 1), ("d", 9), ("d", 1)]).orderBy("rank").collect()
    assert [(r["node_no"], r["score"]) for r in got] == [(1, 1.0), (2, 0.5)]
