"""Boundary cases of the general operators on literal rows."""

import random

from pyspark.sql import functions as F

from millrace.functions.text import dedup_normalised, fnv1a32, slug, squeeze
from millrace.operators import curation as C
from millrace.operators import likeness as L
from millrace.operators import sequences as Q
from millrace.operators import states as S
from millrace.operators import tables as T
from millrace.sources import pages as P


def column(spark, values, expression, kind="string"):
    return [r.y for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expression(F.col("x")).alias("y")).collect()]


def test_fnv_is_the_published_function(spark):
    assert column(spark, ["ab", ""], fnv1a32) == [0x4D2505CA, 2166136261]


def test_text_functions(spark):
    assert column(spark, ["  a  b\t", None], squeeze) == ["a b", None]
    assert column(spark, ["Ação nº 12: Olá!"], dedup_normalised) == ["ação nº 00 olá"]
    assert column(spark, ["  Direito à Vida — 2ª ed. "], slug) == ["direito-a-vida-2-ed"]


def test_word_boundary_is_ascii(spark):
    assert column(spark, ["Isto é o livro que", "xedital n 3", "edital n 3"], lambda c: C.hits(c, r"\bé\s+o|\bedital n")) == [0, 0, 1]


def test_eligibility_boundaries(spark):
    rows = [("knowledge", "content", "pt", n, m, q, s, d, p) for n, m, q, s, d, p in [
        (0.30, 0.35, 0.45, 300, False, 0.62), (0.31, 0.1, 0.9, 300, False, 0.9), (0.1, 0.36, 0.9, 300, False, 0.9), (0.1, 0.1, 0.44, 300, False, 0.9),
        (0.1, 0.1, 0.9, 299, False, 0.9), (0.1, 0.1, 0.9, 4000, False, 0.9), (0.1, 0.1, 0.9, 4001, False, 0.9), (0.1, 0.1, 0.9, 400, True, 0.9), (0.1, 0.1, 0.9, 400, False, 0.61), (0.1, 0.1, 0.9, 400, False, None),
    ]] + [("evidence", "content", "pt", 0.0, 0.0, 1.0, 400, False, 1.0), ("mixed", "nav", "pt", 0.0, 0.0, 1.0, 400, False, 1.0), ("mixed", "content", "de", 0.0, 0.0, 1.0, 400, False, 1.0)]
    df = spark.createDataFrame(rows, "r string, s string, l string, n double, m double, q double, size int, d boolean, p double")
    found = df.select(C.eligibility(*(F.col(c) for c in ("r", "s", "l", "n", "m", "q", "size", "d", "p"))).alias("v")).select("v.*").collect()
    assert [r.reason for r in found] == ["ok", "noise", "metadata", "low_quality", "size", "ok", "size", "duplicate", "unmapped", "unmapped", "role", "section_role", "language"]
    assert [r.status for r in found[:9:8]] == ["eligible", "parked"]


def test_chunks_pack_split_and_drop(spark):
    text = "\n\n".join(["a" * 1000, "b" * 1998, "c" * 10, "d" * 7000, "e" * 299])
    sizes = column(spark, [text, "", None], lambda c: F.transform(C.pack_chunks(c), lambda x: F.char_length(x)))
    assert sizes[0] == [3000, 3000, 3000, 1301]
    assert sizes[1] == [] and sizes[2] is None


def test_garbage_and_boilerplate(spark):
    assert column(spark, ["#### @@ 123 --- 99", "short", "perfectly normal words"], C.is_garbage) == [True, False, False]
    assert column(spark, ["Home", "http://a.b/cdefghijkl x", "a plain sentence of words", ""], C.is_boilerplate) == [True, True, False, False]


def test_repeated_lines_keep_three_documents(spark):
    rows = [(d, "s", 0, "x" * 40) for d in range(5)] + [(9, "s", 0, "short")] * 2
    kept = C.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, source string, pos int, line string"), "source").collect()
    assert sorted(r.doc_id for r in kept) == [0, 1, 2, 9, 9]


def test_token_set_ratio(spark):
    df = spark.createDataFrame([("a b c", "c b a"), ("", ""), ("a", ""), ("abc def", "abc xyz")], "a string, b string")
    assert [r.r for r in df.select(C.token_set_ratio(F.col("a"), F.col("b")).alias("r")).collect()] == [100, 100, 0, 57]


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [1.0])], "a array<double>, b array<double>")
    assert [round(r.c, 6) for r in df.select(C.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 1.0]


def test_stems(spark):
    assert column(spark, ["Administração", "leis", "casas", "só", "rapidamente"], C.stem) == ["administr", "lei", "casa", "so", "rapid"]
    assert column(spark, ["nacionalidade", "as"], C.stem) == ["nacional", "as"]


def test_upsert_and_ignore(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (3, "z")], "k int, v string")
    assert {(r.k, r.v) for r in T.upsert(old, new.where("v = 'c' OR v IS NULL"), ["k"]).collect()} == {(1, "a"), (2, "c"), (3, None)}
    assert [(r.k, r.v) for r in T.insert_or_ignore(old, new, ["k"], [F.col("v").asc_nulls_last()]).collect()] == [(3, "z")]


def test_budget_rejects_without_using(spark):
    random.seed(5)
    requests = [random.randint(1, 6) for _ in range(40)]
    used, wanted = 0, []
    for n in requests:
        wanted.append(used + n <= 20)
        used += n if wanted[-1] else 0
    df = spark.createDataFrame([([(n,) for n in requests],)], "r array<struct<n: long>>")
    assert df.select(S.admitted(F.col("r"), 20).alias("ok")).first().ok == wanted


def test_illegal_edges(spark):
    df = spark.createDataFrame([("announced", "registration_closed"), ("archived", "archived"), ("nonsense", "nonsense"), ("past_due", "archived")], "a string, b string")
    assert [r.ok for r in df.select(S.may_move(F.col("a"), F.col("b")).alias("ok")).collect()] == [False, True, False, True]


def test_url_screen(spark):
    rows = [("https://www.youtube.com/x", ""), ("https://a.example.ru/x", ""), ("https://a.example.org/f.zip", ""), ("https://a.example.org/?a=1&b=2&c=3", ""), ("https://a.example.org/?utm_source=1", ""), ("nothing", ""), ("https://a.example.org/ok", "Curso completo"), ("https://a.example.org/ok", None)]
    found = spark.createDataFrame(rows, "u string, t string").select(P.reject_reason(F.col("u"), F.col("t")).alias("r")).collect()
    assert [r.r for r in found] == ["denylist_domain", "denylist_tld", "deny_file_type", "too_many_params", "tracking_param", "bad_url", "title_spam", None]


def test_gate_is_total(spark):
    rows = [(s, r, g, j) for s in (True, False) for r in (True, False) for g in (True, False) for j in (None, 0.2, 0.5, 0.8)]
    df = spark.createDataFrame(rows, "s boolean, r boolean, g boolean, j double")
    one = F.lit(1.0)
    v = C.publish_gate(F.col("s"), F.col("r"), F.col("g"), F.col("j"), F.lit(1), F.lit(1), one, one, one, F.lit("generated"))
    found = [r.v.decision for r in df.select(v.alias("v")).collect()]
    assert found[:4] == ["needs_review", "failed", "needs_review", "published"] and set(found[4:]) == {"failed"}


def test_hyphens_join_by_case_or_by_the_document(spark):
    assert C.joined_hyphens(["inter- nacional e pós-\n graduação", "Rio- Grande", "RioGrande e Foo- Bar"]) == ["internacional e pósgraduação", "RioGrande", "RioGrande e Foo- Bar"]
    rows = [(1, "s", 0, 0, "paragraph", "Rio- Grande"), (1, "s", 1, 0, "paragraph", "riogrande"), (2, "s", 0, 0, "paragraph", "Rio- Grande"), (3, "s", 0, 0, "paragraph", "sem quebra")]
    df = spark.createDataFrame(rows, "doc_id long, source string, pos long, page long, kind string, line string")
    assert sorted((r.doc_id, r.pos, r.line) for r in C.repair_hyphens(df).collect()) == [(1, 0, "RioGrande"), (1, 1, "riogrande"), (2, 0, "Rio- Grande"), (3, 0, "sem quebra")]


def test_encoding_is_composed(spark):
    assert column(spark, ["é “x”​ﬁ", "plain", None], C.clean_encoding) == ['é "x"fi', "plain", None]


def test_page_artifacts_leave_headings(spark):
    rows = [(1, p, p, "heading" if p == 2 else "paragraph", " Prova ") for p in range(4)] + [(1, 9, 3, "paragraph", "Página 3 / 4"), (2, 0, 0, "paragraph", "Prova"), (2, 1, 1, "paragraph", "Prova")]
    df = spark.createDataFrame(rows, "doc_id long, pos long, page long, kind string, line string")
    found = {(r.doc_id, r.pos): r.kind for r in C.mark_page_artifacts(df).collect()}
    assert found == {(1, 0): "page_artifact", (1, 1): "page_artifact", (1, 2): "heading", (1, 3): "page_artifact", (1, 9): "page_artifact", (2, 0): "paragraph", (2, 1): "paragraph"}


def test_simhash_pairs_are_all_pairs(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(63) for _ in range(30)]
    prints = [(i, x) for i, x in enumerate(base)] + [(100 + i, base[i] ^ sum(1 << b for b in rng.sample(range(63), i % 6))) for i in range(30)] + [(200, base[3]), (201, base[3])]
    found = {(r.k, r.other, r.bits) for r in L.simhash_pairs(spark.createDataFrame(prints, "k long, simhash long"), "k").collect()}
    first = {}
    for k, x in prints:
        first.setdefault(x, k)
    wanted = {(first[x], k, 0) for k, x in prints if first[x] != k}
    reps = [(k, x) for x, k in first.items()]
    wanted |= {(a, b, (x ^ y).bit_count()) for a, x in reps for b, y in reps if a < b and (x ^ y).bit_count() <= 3}
    assert found == wanted


def test_leaders_against_a_plain_scan(spark):
    rng = random.Random(8)
    chunks = []
    for d in range(4):
        own = [" ".join("w" + "abcdefgh"[rng.randrange(8)] + "klmno"[rng.randrange(5)] for _ in range(30)) for _ in range(6)]
        own += [own[0], own[1] + " extra", own[2].replace("wa", "wa wa")]
        chunks += [(d, i, c) for i, c in enumerate(own)]
    df = spark.createDataFrame(chunks, "doc_id long, ordinal long, chunk string").withColumn("content_hash", F.sha2("chunk", 256))
    found = {(r.doc_id, r.ordinal): r.duplicate_of for r in L.greedy_leaders(df).collect()}
    signs, wanted = {}, {}
    for d, i, c in chunks:
        sign = tuple(min(L._fnv(f"{s}:{w}") for w in set(c.split())) for s in range(128))
        same = [j for (e, j), (x, _, _) in signs.items() if e == d and x == c]
        near = [j for (e, j), (_, s, leads) in signs.items() if e == d and leads and sum(a == b for a, b in zip(s, sign)) / 128 >= 0.85]
        wanted[d, i] = same[0] if same else near[0] if near else None
        signs[d, i] = (c, sign, wanted[d, i] is None)
    assert found == wanted


def test_greedy_lists_and_matches(spark):
    near = lambda a, b: F.levenshtein(a, b) <= 1
    rows = spark.createDataFrame([(["abc", "abd", "xyz", "abe", "xy", "q"],), ([],)], "v array<string>")
    assert [r.k for r in rows.select(Q.greedy_keep(F.col("v"), near).alias("k")).collect()] == [["abc", "xyz", "q"], []]
    pairs = spark.createDataFrame([(1, 10, 100, 0.9), (1, 10, 101, 0.9), (1, 11, 100, 1.0), (1, 11, 101, 0.5), (1, 12, 100, 0.7), (2, 20, 100, 0.1)], "g long, a long, b long, s double")
    assert sorted((r.g, r.a, r.b) for r in Q.match_greedily(pairs, "g", "a", "b", "s", "a").collect()) == [(1, 10, 100), (1, 11, 101), (2, 20, 100)]
