"""Booklets, syllabi, layouts, circuits, near texts and vectors on literal and random cases against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import booklets as B
from millrace.operators import layout as L
from millrace.operators import likeness as K
from millrace.operators import planning as P
from millrace.operators import sections as S
from millrace.operators import syllabus as Y
from millrace.operators import vectors as V
from millrace.streaming import jobs

SF = "/root/testdata/sf0.001"


# --- booklets ---------------------------------------------------------------------------------------

KEY = """GABARITOS PRELIMINARES
A B C
1 2 3
PROVA TIPO 1
1 2 3 4
A  b C D

5 6
A
7 8
A X
2
9 10
C D
PROVA TIPO
1 2
D A
PROVA TIPO 9
1 2
B B
PROVA TIPO 1
3
2
B
81 1
C C
5 6
2
D
"""


def test_answer_grids(spark):
    rows = B.answer_grids(spark.createDataFrame([("k", KEY)], "id string, text string"), ["id"]).collect()
    found = {(r.booklet, r.number): r.answer for r in rows}
    # a grid of another width or of other letters is none, a heading without a digit is the next booklet, later answers replace earlier ones, and a lone digit names a booklet unless it stands under numbers
    assert found == {(1, 1): 3, (1, 2): 0, (1, 3): 2, (1, 4): 3, (2, 9): 2, (2, 10): 3, (2, 1): 2, (2, 2): 3}
    assert not any(r.definitive for r in rows)


def test_correspondence_and_rekeying(spark):
    text = "1 2 3 4\nGABARITO DEFINITIVO\nPROVA TIPO 1\n1 2\nA B\nPROVA TIPO 2\n2 1 3\nA B C\nTabela de correspondência\nTIPO 1 TIPO 2 TIPO 3 TIPO 4\n1 2 1 2   2 1 2 1\n3 4 5\n90 1 1 1\n1 2 3 4 5"
    keys = spark.createDataFrame([("e", text), ("bare", "PROVA TIPO 1\n1 2\nC D\nPROVA TIPO 3\n1 2\nC D")], "id string, text string")
    answers, table = B.answer_grids(keys, ["id"]), B.correspondences(keys, ["id"])
    assert {(r.id, r.canonical, r.booklet): r.number for r in table.collect()} == {("e", 1, 1): 1, ("e", 1, 2): 2, ("e", 1, 3): 1, ("e", 1, 4): 2, ("e", 2, 1): 2, ("e", 2, 2): 1, ("e", 2, 3): 2, ("e", 2, 4): 1}
    questions = [(i, b, n, True) for i, b, n in [("e", 1, 1), ("e", 1, 3), ("e", 2, 2), ("e", 2, 3), ("e", 4, 1), ("bare", 1, 1), ("bare", 3, 1)]]
    rows = B.rekeyed_questions(spark.createDataFrame(questions, "id string, booklet int, number int, ok boolean"), answers, table, ["id"]).collect()
    found = {(r.id, r.booklet, r.number): (r.canonical, r.correct_index, r.status) for r in rows}
    # booklet 4 has no grid, and booklet 3 of an edition without a table cannot be put in order
    assert found == {("e", 1, 1): (1, 0, "ok"), ("e", 1, 3): (3, None, "annulled"), ("e", 2, 2): (1, 0, "ok"), ("e", 2, 3): (None, None, "unkeyed"), ("bare", 1, 1): (1, 2, "ok")}


def test_booklet_questions(spark):
    question = lambda n: f"{n}\nEste é o enunciado da questão {n} do caderno\n(A) um {n}\nB) dois\ncontinua\n (C) três\nD) quatro"
    text = "TIPO 3 – AMARELA\n15\nquestionário de percepção sobre a prova\n" + "\n".join(map(question, (1, 2))) + "\nTipo 3 – Página 4\n2\n3\ncurto\n(A) a\n(B) b\n(C) c\n(D) d\n4\nEnunciado bastante longo, mas opções iguais\n(A) a\n(B) A\n(C) c\n(D) d\n6\n5\nSó três opções neste enunciado longo\n(A) a\n(B) b\n(C) c\nQUESTIONÁRIO DE PERCEPÇÃO\n6\nComo foi a prova que você fez hoje?\n(A) a\n(B) b\n(C) c\n(D) d"
    rows = {r.number: r for r in B.booklet_questions(spark.createDataFrame([("x", text), ("y", None), ("z", "sem nada")], "id string, text string"), ["id"]).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5] and {r.booklet for r in rows.values()} == {3}
    assert rows[1].options == ["um 1", "dois continua", "três", "quatro"] and rows[1].prompt == "Este é o enunciado da questão 1 do caderno"
    assert [rows[k].ok for k in range(1, 6)] == [True, True, False, False, False]
    assert rows[2].options[3] == "quatro 2"  # a folio that is not the number awaited stays in the text


def test_editions(spark):
    cases = [("EXAME DE ORDEM UNIFICADO 2010.2", 1), ("2010-3", 2), ("46º EXAME", 46), ("XXXIV Exame", 34), ("xxxv exame", None), ("III exame", None), ("99º exame", None), ("V exame de 5 exame", 5), ("CIVIL exame", None), (" ", None), ("iv  EOU", 4)]
    rows = spark.createDataFrame(cases, "t string, n int").select("n", B.edition(F.col("t")).alias("found")).collect()
    assert [r.found for r in rows] == [r.n for r in rows]


# --- syllabi ----------------------------------------------------------------------------------------


def test_statuses_at_their_borders(spark):
    from millrace import registry

    rows = {r.doc: r for r in registry.queries()["sy_04_status"](spark, SF).collect()}
    for doc, leaves, method, status in [("nine", 9, "outline", "needs_review"), ("ten", 10, "outline", "active"), ("most", 600, "outline", "active"), ("over", 601, "outline", "needs_review"), ("span_most", 900, "programme", "active"), ("span_over", 901, "programme", "needs_review"), ("nothing", 0, "outline", "needs_review")]:
        assert (rows[doc].leaves, rows[doc].method, rows[doc].status) == (leaves, method, status), doc


def test_programme_of_the_full_notice(spark):
    from millrace import registry

    rows = sorted((r for r in registry.queries()["sy_03"](spark, SF).collect() if r.doc == "full"), key=lambda r: r.ordinal)
    assert [r.ordinal for r in rows] == list(range(len(rows)))
    subjects = [r.title for r in rows if r.depth == 0]
    assert subjects == ["Língua Portuguesa", "Matemática", "DIREITO CIVIL E PROCESSO", "Informática", "ADMINISTRAÇÃO"] or subjects[:2] == ["Língua Portuguesa", "Matemática"]
    portuguese = [r.title for r in rows if r.parent == "lingua-portuguesa"]
    assert portuguese == ["Crase", "Sintaxe", "Regência verbal", "Pontuação", "Ortografia", "Morfologia"]  # listed twice, one subject, one topic of each name
    assert not any(r.title in ("Tribunal de Exemplo", "NOME DO DIRETOR") for r in rows)


def test_positions_are_kept_once(spark):
    from millrace import registry

    rows = sorted((r for r in registry.queries()["sy_01"](spark, SF).collect() if r.doc in ("full", "plain")), key=lambda r: (r.doc, r.place))
    assert [(r.title, r.vacancies, r.implicit) for r in rows if r.doc == "full"][:2] == [("Analista Judiciário", 3.0, False), ("Técnico", 0.0, False)]
    assert [(r.title, r.implicit) for r in rows if r.doc == "plain"] == [("geral", True)]


def test_replacements_match_a_loop(spark):
    rng = random.Random(3)
    words = ["crase", "sintaxe", "verbal", "nominal", "regencia", "texto"]
    leaf = lambda k: (k % 3, k, rng.randrange(5), f"{rng.choice(['port', 'portugues', 'direito', 'direita'])}/x", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))))
    old, new = [leaf(k) for k in range(60)], [leaf(100 + k) for k in range(60)]
    schema = "exam int, node long, place int, path string, title string"
    frames = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    pairs = spark.createDataFrame([(a[4], b[4], a[3].split("/")[0], b[3].split("/")[0]) for a in new for b in old], "a string, b string, s string, t string").distinct()
    ratio = {}
    for r in pairs.select("*", Y.token_set_ratio(F.col("a"), F.col("b")).alias("r"), Y.token_set_ratio(F.col("s"), F.col("t")).alias("q")).collect():
        ratio[r.a, r.b], ratio[r.s, r.t] = r.r, r.q
    wanted, taken = {}, set()
    for a in sorted(new, key=lambda a: (a[2], a[1])):
        s = a[3].split("/")[0]
        best = None
        for b in sorted(old, key=lambda b: (b[2], b[1])):
            t = b[3].split("/")[0]
            if b[0] != a[0] or b[1] in taken or not (s == t or s in t or t in s or ratio[s, t] >= 70):
                continue
            if ratio[a[4], b[4]] >= 85 and (best is None or ratio[a[4], b[4]] > best[0]):
                best = ratio[a[4], b[4]], b[1]
        wanted[a[1]] = best and best[1]
        taken.add(wanted[a[1]])
    assert {r.node: r.replaces for r in Y.replacements(*frames).collect()} == wanted
    merged = Y.merged_leaves(*frames).collect()
    assert sorted(r.node for r in merged if r.origin == "kept") == sorted(b[1] for b in old if b[1] not in taken)
    assert all(sorted(r.place for r in merged if r.exam == e) == list(range(sum(r.exam == e for r in merged))) for e in range(3))


# --- layout -----------------------------------------------------------------------------------------


def test_heading_levels_at_their_borders(spark):
    rows = [("d", 1, k, t, 0.0, 0.0, 0.0, 0.0, s, False) for k, (t, s) in enumerate([("a", 10.0)] * 8 + [("e", 11.4), ("f", 11.5), ("g", 13.0), ("h", 15.0), ("x" * 121, 15.0), ("n", None)])]
    found = L.blocks(spark.createDataFrame(rows, "doc string, page int, place int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean"))
    assert [(r.kind[0], r.level) for r in sorted(found.collect(), key=lambda r: r.place)] == [("p", None)] * 9 + [("h", 3), ("h", 2), ("h", 1), ("p", None), ("p", None)]
    assert L.blocks(found.limit(0).select("doc", "page", "place", "text", F.lit(1.0).alias("size"))).count() == 0


def test_lines_are_joined(spark):
    spans = []
    for line, (page, y, text, size, font) in enumerate([(1, 0, "Uma li-", 10, None), (1, 14, "nha partida", 10, None), (1, 28, "e outra-", 10, None), (1, 42, "Maior", 10, None), (1, 80, "longe", 10, None), (1, 94, "TÍTULO AQUI", 10, None), (1, 108, "negrito", 10, "X-Bold"), (1, 122, "grande", 12, None), (1, 136, "  ", 10, None), (1, 136, "fim", None, None), (2, 0, "outra página", 10, None), (301, 0, "além", 10, None)]):
        spans += [("d", page, line, k, part, size, font, 10.0, float(y), 500.0, y + 10.0) for k, part in enumerate([text[:2], text[2:]])]
    lines = L.lines_of_spans(spark.createDataFrame(spans, "doc string, page int, line int, span int, text string, size int, font string, x0 double, y0 double, x1 double, y1 double"))
    found = [r.text for r in sorted(L.paragraphs(lines, 600.0).collect(), key=lambda r: (r.page, r.place))]
    assert found == ["Uma linha partida e outra- Maior", "longe", "TÍTULO AQUI", "negrito", "grande", "fim", "outra página"]


def test_section_levels_and_lists(spark):
    texts = [("1. Um", 1), ("1.2.3) Três", 3), ("IV) Quatro", 1), ("B. Letra", 2), ("DAS PROVAS", 1), ("Art. 5º x", 2), ("frase", 2)]
    rows = spark.createDataFrame(texts, "t string, n int").select("n", S.heading_level(F.lit(None).cast("int"), F.col("t")).alias("found"), S.heads(F.lit("paragraph"), F.col("t")).alias("heads")).collect()
    assert [r.found for r in rows] == [n for _, n in texts] and [r.heads for r in rows] == [True] * 6 + [False]
    plain = spark.range(1).select(S.plain_lists(F.lit("a) um\n  • dois\nIV – três\n(10) quatro\n-cinco\n  seis")).alias("t")).first().t
    assert plain == "um\ndois\ntrês\nquatro\n-cinco\n  seis"


# --- circuits and passes ----------------------------------------------------------------------------


def test_circuit_opens_probes_and_closes():
    step, state = jobs.circuit_step, ("healthy", 0.0, 0)
    ok, state = step(state, 0.0, "transient")
    assert ok and state == ("open", 30.0, 0)
    assert step(state, 29.9, None) == (False, state)
    ok, state = step(state, 30.0, "rate_limit")
    assert ok and state == ("open", 90.0, 1)
    ok, half = step(state, 90.0, "invalid_response")
    assert ok and half == ("half_open", 0.0, 1)
    assert step(half, 91.0, None) == (True, ("healthy", 0.0, 0))
    assert step(half, 91.0, "billing") == (True, ("open", 91.0 + 6 * 3600, 2))
    assert step(("open", 0.0, 20), 1.0, "transient")[1][1] == 3601.0
    assert step(("healthy", 0.0, 0), 5.0, "policy") == (True, ("healthy", 0.0, 0))


def _ratio(a, b):
    def levenshtein(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, last = [i], row
            for j, d in enumerate(y, 1):
                row.append(min(last[j - 1] + (c != d), last[j] + 1, row[j - 1] + 1))
        return row[-1]

    def ratio(p, q):
        n = max(len(p), len(q))
        return 100 if p == q else 0 if not p or not q else math.floor((n - levenshtein(p, q)) / n * 100 + 0.5)

    x, y = sorted(set(a.split())), sorted(set(b.split()))
    if not x or not y:
        return 100 if not x and not y else 0
    both = [w for w in x if w in y]
    one, two = " ".join(both + [w for w in x if w not in y]), " ".join(both + [w for w in y if w not in x])
    return max(ratio(" ".join(both), one), ratio(" ".join(both), two), ratio(one, two))


def test_bounded_likeness_is_the_ratio():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = (" ".join("".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(4))) for _ in range(2))
        for least in (50, 85, 100):
            assert jobs.words_alike(sorted(set(a.split())), sorted(set(b.split())), least) == (_ratio(a, b) >= least)


def test_passes_go_on_where_they_stopped(spark, tmp_path):
    """Three micro-batches, each a run of its own over the same state, decide as one loop does."""
    rng = random.Random(5)
    stems = ["qual a regra da crase", "qual a regra da crases", "onde fica o acento", "quando usar virgula", "quando usa virgula", "outra coisa"]
    items = [(f"l{k % 3}", k, k, rng.choice(stems) + rng.choice(["", " hoje", " x"])) for k in range(60)]
    schema = "leaf string, place long, item long, stem string"
    wanted, published = {}, {}
    for leaf, _, item, stem in items:
        near = next((i for i, s in published.get(leaf, []) if _ratio(stem, s) >= 85), None)
        wanted[item] = near
        if near is None:
            published.setdefault(leaf, []).append((item, stem))
    found = []
    for part in range(3):
        spark.createDataFrame(items[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.pass_decisions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, _: found.extend(df.collect())).start()
        query.awaitTermination()
    assert {r.item: r.duplicate_of for r in found} == wanted and len(found) == 60
    assert any(v is not None for v in wanted.values())


def test_waiting_leaves(spark):
    rows = [(1, "queued", 0, None, 0), (2, "done", 0, "2024-01-01", 0), (3, "done", 0, "2023-12-20", 1), (4, "failed", None, "2023-12-24", 1), (5, "done", 3, "2024-01-01", 0), (6, "done", 0, "2023-01-01", 9), (6, "running", 0, None, 9), (7, "done", 0, "2023-11-20", 9), (8, "done", 0, "2023-12-01", 0), (8, "ok", 1, "2024-01-01", 0), (9, "done", 0, "2023-12-25", 0)]
    searches = spark.createDataFrame(rows, "leaf long, status string, stored int, finished string, attempts int").withColumn("finished", F.to_timestamp_ntz("finished"))
    found = {r.leaf for r in P.waiting_leaves(searches, F.to_timestamp_ntz(F.lit("2024-01-01 12:00:00"))).collect()}
    assert found == {1, 2, 3, 4, 6, 7}  # 7: 56 days at most


# --- near texts and vectors -------------------------------------------------------------------------


def test_simhash_of_plain_loops():
    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 % (1 << 32)
        return h

    rng = random.Random(2)
    for n in [0, 1, 4, 5, 6, 30, 200]:
        text = "".join(rng.choice("abcdé中") for _ in range(n))
        grams = [text[k : k + 5] for k in range(max(n - 4, 1))] if text else []
        votes = [sum(1 if (fnv(f":{g}:") << 32 | fnv(g)) >> b & 1 else -1 for g in grams) for b in range(64)]
        assert K.simhash(text) % (1 << 64) == sum(1 << b for b in range(64) if votes[b] > 0)


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_near_texts_match_all_pairs(spark, most):
    rng = random.Random(7)
    texts = []
    for k in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 60))]
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
            texts.append(" ".join(words))
    texts += [texts[0], texts[0], "", None, "só uma"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    signs = K.minhash_signatures(df, "id", "norm").collect()
    own = {r.id: np.array(r.signature) for r in signs}
    first = {}
    for i in sorted(own):
        first.setdefault(own[i].tobytes(), i)
    reps = sorted(first.values())
    wanted = {(a, b): (own[a] == own[b]).mean() for n, a in enumerate(reps) for b in reps[n + 1 :] if (own[a] == own[b]).mean() >= 0.85}
    members, classes = K.minhash_classes(spark.createDataFrame(signs), "id")
    assert {r.id: r.rep for r in members.collect()} == {i: first[s.tobytes()] for i, s in own.items()}
    found = K.minhash_pairs(classes, "rep", most).collect()
    assert {(r.rep, r.other): r.likeness for r in found} == wanted and len(found) == len(wanted) > 30


def test_near_documents_match_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = K.near_texts(docs, "doc_id", "text").collect()
    signs = {r.doc_id: np.array(r.signature) for r in K.minhash_signatures(docs.select("doc_id", K.dedup_normalised(F.col("text")).alias("norm")), "doc_id", "norm").collect()}
    ids = sorted(signs)
    linked = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (signs[a] == signs[b]).mean() >= 0.85}
    first = {}
    for i in ids:
        first.setdefault(signs[i].tobytes(), i)
    rep = {i: first[signs[i].tobytes()] for i in ids}
    found = {(r.doc_id, r.other) for r in rows}
    assert found == {(a, b) for a, b in linked if rep[a] == a and (rep[b] == b or rep[b] == a)}


def test_vector_units_match_all_pairs(spark):
    rng = np.random.default_rng(4)
    vectors = [v + rng.normal(0, s, 16) for v in rng.normal(0, 1, (12, 16)) for s in np.linspace(0.05, 0.3, 12)]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)] + [(900, None), (901, []), (902, [0.0, 0.0]), (903, [1.0, None]), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (906, [1.0, float("nan")])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = {r.id: (r.unit, r.links) for r in V.merged_vectors(df, "id", "v").collect()}
    assert len(found) == len(rows)
    assert found[904][0] == found[905][0] == 904 and all(found[k] == (k, 0) for k in (900, 901, 902, 903, 906))
    unit = np.array([v / np.linalg.norm(v) for v in vectors])
    true = [(a, b) for a in range(len(unit)) for b in range(a + 1, len(unit)) if unit[a] @ unit[b] >= V.SAME]
    members, reps = V.vector_classes(df, "id", "v")
    links = {(r.u, r.v) for r in V.vector_links(reps).collect()}
    hit = sum((a, b) in links for a, b in true)
    assert hit >= 0.9 * len(true) > 40 and all((a, b) in set(true) for a, b in links if b < 900)


def test_tables_reach_their_recall():
    for n in (10, 10_000, 10**9):
        bits, tables = V.plan_tables(n)
        agree = 1 - math.acos(V.SAME) / math.pi
        assert 1 - (1 - agree**bits) ** tables >= V.RECALL and bits <= 40


def test_seeded_sample_is_of_the_newest(spark):
    from millrace import registry

    rows = [r.doc_id for r in registry.queries()["wn_13"](spark, SF).collect()]
    ids = sorted((r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()), reverse=True)[:200]
    assert len(set(rows)) == len(rows) == 20 and set(rows) <= set(ids)
    assert rows == [r.doc_id for r in registry.queries()["wn_13"](spark, SF).collect()]
