"""What the findings of the fourth round named, on small rows."""

import duckdb

from millrace import registry
from millrace.operators import booklets as B
from millrace.workspace import materialize


def of_documents(spark, folder, name, texts):
    """Rows of a query over these documents, in Spark and by its SQL."""
    rows = [(i, x, "pt", "a", len(x)) for i, x in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    found = registry.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    wanted = con.sql(registry.oracles()[name]).project(", ".join(f'"{c}"' for c in found.columns)).fetchall()
    rows = sorted(map(tuple, found.collect()), key=repr)
    assert rows == sorted(wanted, key=repr)
    return [r for r in rows if r[0] > 0]


def test_answers_and_correspondences_are_not_broadcast(spark):
    answers = spark.createDataFrame([(e, b, n, n % 4, False) for e in (1, 2) for b in (1, 2) for n in (1, 2, 3)], "edition long, booklet int, number int, answer int, definitive boolean")
    table = spark.createDataFrame([(e, c, b, c if b == 1 else 4 - c) for e in (1, 2) for c in (1, 2, 3) for b in (1, 2)], "edition long, canonical int, booklet int, number int")
    questions = spark.createDataFrame([(e, b, n, True) for e in (1, 2, 3) for b in (1, 2) for n in (1, 3, 4)], "edition long, booklet int, number int, ok boolean")
    found = B.rekeyed_questions(questions, answers, table, ["edition"])
    numbers = B.canonical_numbers(materialize(answers), materialize(table), ["edition"]).where("canonical IS NOT NULL")
    for df in (found, numbers):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    wanted = [(e, *r) for e in (1, 2) for r in ((1, 1, 1, 1, "ok"), (1, 3, 3, 3, "ok"), (1, 4, 4, None, "annulled"), (2, 1, 3, 1, "ok"), (2, 3, 1, 3, "ok"), (2, 4, None, None, "unkeyed"))]
    rows = found.select("edition", "booklet", "number", "canonical", "correct_index", "status").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(wanted, key=repr)


def test_words_far_into_a_text_vote_for_its_role(spark, tmp_path):
    texts = ["palavra " * 1200 + x for x in ("", "resultado final", "caderno", "das vagas da remuneração das provas")]
    texts.append("\n\n".join(["frase " * 60] * 30 + ["http://a.b"] * 40))
    found = of_documents(spark, tmp_path, "ag_18", texts)
    assert found == [(1, "specification", 0.4), (2, "administrative", 0.7), (3, "evidence", 0.7), (4, "specification", 0.5), (5, "administrative", 0.5)]


#: A line on the first page and one on page 301; thirty lines are a page.
FAR = "perto" + "\n" * 9000 + "2. Além da página"


def test_blocks_of_all_pages(spark, tmp_path):
    assert of_documents(spark, tmp_path, "src_04", [FAR]) == [(1, 1, 1, "paragraph", None, "perto"), (1, 2, 301, "paragraph", None, "2. Além da página")]


def test_paragraphs_of_all_pages(spark, tmp_path):
    assert [r[:4] for r in of_documents(spark, tmp_path, "src_06", [FAR])] == [(1, 1, 0, "perto"), (1, 301, 0, "2. Além da página")]


def test_sections_of_all_pages(spark, tmp_path):
    found = of_documents(spark, tmp_path, "st_01", [FAR])
    assert [(r[1], r[2], r[3], r[8]) for r in found] == [(0, "2. Além da página", 1, 301)]


def test_headings_of_all_pages(spark, tmp_path):
    assert of_documents(spark, tmp_path, "st_02", [FAR]) == [(1, 0, "2. Além da página", 1, "")]
