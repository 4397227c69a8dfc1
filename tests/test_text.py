import json

from pyspark.sql import functions as F

from shopmetrics.functions.formatting import compact_currency, fixed, percent, thousands
from shopmetrics.operators import reports as N
from shopmetrics.operators import retrieval as R


def test_money_and_numbers(spark):
    vals = [999.0, 1000.0, 1_000_000.0, -1500.0, 1663.5, 50.315]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = df.select(compact_currency(F.col("v")), thousands(F.col("v")), fixed(F.col("v"), 2),
                    percent(F.col("v") / 1000)).collect()
    py = []
    for v in vals:
        comp = (f"GBP {v / 1_000_000:.2f}M" if abs(v) >= 1_000_000 else
                f"GBP {v / 1_000:.1f}K" if abs(v) >= 1_000 else f"GBP {v:,.0f}")
        py.append((comp, f"{round(v, 6):,.0f}", f"{round(v, 6):.2f}", f"{v / 1000:.2%}"))
    assert [tuple(r) for r in got] == py


def test_tolerant_json(spark):
    texts = ['```json\n{"a": 1}\n```', 'Sure! {"a": 2} hope it helps', '{"a": 3', "plain words", '```JSON {"b": [1,2]} ```']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, response string")
    got = {r.id: (r.parsed, r.is_json) for r in N.parse_json_column(df).collect()}
    assert json.loads(got[0][0]) == {"a": 1} and json.loads(got[1][0]) == {"a": 2}
    assert got[2] == (None, False) and got[3] == (None, False)
    assert json.loads(got[4][0]) == {"b": [1, 2]}


def _python_top(docs, question, k=3):
    terms = {t.lower().strip(".,?!") for t in question.split() if len(t) > 3}
    scored = [(sum(text.lower().count(t) for t in terms), i) for i, text in docs]
    ranked = [(s, i) for s, i in sorted(scored, key=lambda x: x[0], reverse=True) if s > 0]
    return ranked[:k] or [(0, i) for _, i in scored[:k]]


def test_retrieval_edge_cases_match_python(spark):
    docs = [(1, "Checkout friction on mobile. Mobile mobile!"), (2, "Experiment readout: uplift and p-value."),
            (3, "aaaa aaaaaa banana"), (4, "nothing relevant here at all")]
    questions = [(1, "a an it is"),  # short tokens only -> fallback
                 (2, "Mobile, checkout?!"),  # punctuation stripped after the length test
                 (3, "nana aaa aaaa"),  # term inside a longer word, self-overlapping term
                 (4, "????"),  # strips to the empty term: counts len(text) + 1
                 (5, "zzzz yyyy"),  # no hit -> first k documents
                 (6, "relevant here")]  # Unicode whitespace splits like Python
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("source", F.concat(F.lit("s"), "doc_id"))
    q = spark.createDataFrame(questions, "question_id long, question string")
    got = {}
    for r in R.top_documents(d, q).collect():
        got.setdefault(r.question_id, []).append((r.rank, r.score, r.doc_id))
    for qid, text in questions:
        exp = _python_top([(i, t) for i, t in docs], text)
        assert [(s, i) for _, s, i in sorted(got[qid])] == exp, (qid, got[qid], exp)
    ctx = {r.question_id: r.context for r in R.format_context(d, R.top_documents(d, q)).collect()}
    assert ctx[6].startswith("Source: s4\nnothing relevant here at all")


def test_recorded_answer_on_driver_documents(spark):
    # FIXTURES.md section 4: computed with plain Python over the sf0.01 documents.
    from shopmetrics.sources.fixtures import read_table
    docs = R.documents_table(read_table(spark, "/root/testdata/sf0.01", "documents"))
    q = spark.createDataFrame([(1, "Which copies contain the license and personal data?")],
                              "question_id long, question string")
    got = [(r.doc_id, r.score) for r in R.top_documents(docs, q).orderBy("rank").collect()]
    assert got == [(845, 3), (125, 2), (156, 2)]


def test_front_of_a_text_is_collapsed_once(spark):
    """what a snippet collapses is planned three times at most (the front, and whole texts of two kinds)."""
    from pyspark.sql import functions as F

    from shopmetrics.functions import text as T
    cut = T.first_of_collapsed(F.col("t"), 10)
    assert str(cut).count("regexp_replace") == 3
    texts = ["", " ", "\x1c a　　b\x85", "x " * 30, " " * 50 + "a b", "a" + " " * 90 + "b\n\n", "é​ é", "a\x0bb" * 9, "abcdefghij klm"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    assert [r[0] for r in df.select(cut).collect()] == [" ".join(t.split())[:10] for t in texts] + [None]
    assert [r[0] for r in df.select(T.collapse_ws(F.col("t"))).collect()] == [" ".join(t.split()) for t in texts] + [None]
