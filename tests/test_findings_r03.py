"""What the findings of the third round named, on small rows."""

import random

from pyspark.sql import functions as F

from millrace import registry
from millrace.functions.text import trim
from millrace.operators import curation as C
from millrace.operators import likeness as L
from millrace.operators import roles as R
from millrace.operators import tables as T

SF = "/root/testdata/sf0.001"


def test_batch_with_a_key_twice_is_written_twice_alike(spark):
    old = spark.createDataFrame([(0, 1.0), (1, 2.0)], "k long, v double")
    new = spark.createDataFrame([(0, 5.0), (0, 6.0), (2, 7.0)], "k long, v double")
    once = T.upsert(old, new, ["k"])
    wanted = [(0, 5.0), (0, 6.0), (1, 2.0), (2, 7.0)]
    assert sorted(map(tuple, once.collect())) == wanted
    assert sorted(map(tuple, T.upsert(once, new, ["k"]).collect())) == wanted


def test_customer_zero_is_written_too(spark):
    assert registry.queries()["snk_02"](spark, SF).where("c_custkey = 0").count() == 2


def test_print_pairs_are_not_broadcast_and_come_once(spark):
    rng = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in prints[:40]:
        for b in rng.sample(range(64), rng.randint(0, 5)):
            p ^= 1 << b
        prints.append(p)
    found = L.simhash_pairs(spark.createDataFrame([(i, signed(p)) for i, p in enumerate(prints)], "k long, simhash long"), "k")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    first = {p: i for i, p in reversed(list(enumerate(prints)))}
    wanted = [(a, b, (p ^ q).bit_count()) for p, a in first.items() for q, b in first.items() if a < b and (p ^ q).bit_count() <= 3]
    wanted += [(first[p], i, 0) for i, p in enumerate(prints) if first[p] != i]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


ODD = [
    "EDİTAL n 3", "edıtal de abertura", "reſultado final", "RESULTADO FINAL", "Edital de ABERTURA", "das  vagas da remuneração das provas", "retifıcação", "boleto", "Capítulo 12", "cap\u00cdtulo 3", "", None,
    "\u212aeine", "prova azul", "NOTÍCIAS", "exercícıo", "art. 1 art. 2 art. 3 art. 4 art. 5", "ISENÇÃO", "posſe", "cartão de confirmação", "salário", "taxa de ınscrição", "anexo IV", "ou ſeja", "(a) x (b) y", "lei nº 3", "01/02/2024", "a.b@c.de", "11 91234-5678", "R$ 5",
]


def test_word_screens_lose_no_match_of_a_pattern(spark):
    rows = spark.createDataFrame([(x,) for x in ODD], "x string")
    wordings = [p if isinstance(p, str) else p[0] for p in (*R.SPECIFICATION, *R.SPECIFICATION_BODY, *R.EVIDENCE, *R.KNOWLEDGE, *R.ADMINISTRATIVE, C.HEDGE)]
    assert all(C.sure_words(p) for p in wordings)
    lost = [R.has(F.col("x"), p) & ~C.may_match(C.folded(F.col("x")), p) for p in wordings]
    assert not any(v for r in rows.select(*[c.alias(f"c{i}") for i, c in enumerate(lost)]).collect() for v in r)
    kinds = list(C.META_PATTERNS)
    plain = [C.count(F.lower("x"), C.lowered_regex(C.META_PATTERNS[k])).alias(k) for k in kinds]
    quick = rows.select(C.metadata_counts(F.col("x")).alias("m")).select(*[f"m.{k}" for k in kinds]).collect()
    assert quick == rows.select(*plain).collect()


def test_trim_takes_unicode_space_off_both_ends(spark):
    rows = spark.createDataFrame([("\u3000 \t a \u00a0 b\ufeff\n",), ("\u2003",), ("",), (None,), ("x \u0085",)], "x string")
    assert [r.y for r in rows.select(trim(F.col("x")).alias("y")).collect()] == ["a \u00a0 b", "", "", None, "x \u0085"]


def test_link_density_of_links_and_none(spark):
    rows = spark.createDataFrame([("HTTP://a.b c",), ("sem ligação",), ("",), ("HREF = x " + "y " * 58,)], "x string")
    assert [r.y for r in rows.select(C.link_density(F.col("x")).alias("y")).collect()] == [1.0, 0.0, 0.0, 1 / 3.05]


def test_explode_does_not_compute_its_array_twice(spark):
    rows = spark.range(3).select("id", F.when(F.col("id") > 0, F.sequence(F.lit(1), F.col("id"))).alias("a"))
    found = T.dealt(rows, ["id"], F.transform("a", lambda x: x * 2), "place", "v")
    assert sorted(map(tuple, found.collect())) == [(1, 0, 2), (2, 0, 2), (2, 1, 4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction") == 1


def test_questions_do_not_carry_their_booklet(spark):
    from millrace.operators import booklets as B

    text = "TIPO 2 – COR\n1\nQual é a resposta certa desta?\n(A) um\n(B) dois\n(C) três\n(D) quatro\n2\nE qual é a resposta desta outra?\n(A) um\n(B) um\n(C) três\n(D) quatro"
    found = B.booklet_questions(spark.createDataFrame([(7, text), (8, "sem questões")], "edition long, text string"), ["edition"])
    assert [(r.edition, r.booklet, r.number, r.ok) for r in found.orderBy("number").collect()] == [(7, 2, 1, True), (7, 2, 2, False)]
    assert not any("sequence(" in x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in x)


def test_minhashes_of_kept_words_are_those_of_new_ones(monkeypatch):
    hashed = []
    real = L._word_hashes
    monkeypatch.setattr(L, "_word_hashes", lambda words: hashed.append(len(words)) or real(words))
    L._kept.clear()
    wanted = lambda words: [min(L._fnv(f"{i}:{w}") for w in words) for i in range(L.PERMUTATIONS)]
    for words in (["ab", "c", "defgh"], ["c", "ab"], ["é", "c"]):
        assert L.minhash_words(words).tolist() == wanted(words)
    assert hashed == [3, 1]
    monkeypatch.setattr(L, "KEPT_WORDS", 2)
    assert L.minhash_words(["ab", "c", "defgh", "x", "y"]).tolist() == wanted(["ab", "c", "defgh", "x", "y"])
    assert len(L._kept) <= 2
    assert L.minhash_words([]).tolist() == [0xFFFFFFFF] * L.PERMUTATIONS


def test_leaders_of_documents_whose_chunks_stand_in_several_batches(spark):
    words = lambda a, n=40: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(a, a + n))
    texts = [words(0), words(100), words(0), words(0) + " z", *[words(200 + 60 * i) for i in range(40)], words(200)]
    rows = [(d, i, x, str(hash(x))) for d in (3, 4) for i, x in enumerate(texts)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = L.greedy_leaders(spark.createDataFrame(rows, "doc_id long, ordinal int, chunk string, content_hash string"))
        assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.doc_id, r.ordinal, r.duplicate_of) for r in found.where("duplicate_of IS NOT NULL").collect()) == [(d, *x) for d in (3, 4) for x in ((2, 0), (3, 0), (44, 4))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_near_copies_are_not_cut_into_all_their_windows(spark, monkeypatch):
    from millrace.llm import substring_dedup as D

    rng = random.Random(3)
    words = [f"w{rng.randrange(9999)}" for _ in range(300)]
    texts = []
    for i in range(40):
        own = list(words)
        for at in rng.sample(range(300), 2):
            own[at] = f"new{i}x{at}"
        texts.append((i, " ".join(own)))
    written = []
    real = D.materialize
    monkeypatch.setattr(D, "materialize", lambda df, label="table": (kept := real(df, label), written.append(kept.count()))[0])
    found = D.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string"), most_contexts=3)
    assert found.agg(F.sum("n_removed")).first()[0] > 39 * 200
    # 40 documents of 251 windows each, some 20 anchors
    assert max(written) < 40 * 60


def test_stems_meet_all_published_ones_at_once(monkeypatch):
    from millrace.streaming import jobs as J

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 7)))
    known = [word() for _ in range(25)]
    stems = [sorted({rng.choice(known) if rng.random() < 0.8 else word() for _ in range(rng.randint(0, 6))}) for _ in range(500)]
    stems += [["abcdefghijkl"], ["abcdefghijkx"], ["lkjihgfedcba"], []]
    for least in (60, 85, 100):
        old, wanted = [], []
        for i, words in enumerate(stems):
            near = next((k for k, w in old if J.words_alike(words, w, least)), None)
            wanted.append(near)
            if near is None:
                old.append((i, words))
        published, found = J.Published(least), []
        for i, words in enumerate(stems):
            found.append(published.first_alike(words))
            if found[-1] is None:
                published.add(i, words)
        assert found == wanted
    calls = []
    monkeypatch.setattr(J, "words_alike", lambda *a: calls.append(a))
    published = J.Published(85)
    for i in range(300):
        published.add(i, [f"{chr(97 + i % 26) * 9}", f"{i:04d}"])
    for _ in range(300):
        assert published.first_alike(["0299", chr(97 + 299 % 26) * 9][::-1]) == 299
    assert len(calls) < 30


def test_ratio_makes_each_word_set_once(spark):
    words = ["ana", "bela", "casa", "dado", "é", "x1"]
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(words) + rng.choice(["", "", "s"]) for _ in range(rng.randint(0, 5)))
    pairs = [(text(), text()) for _ in range(300)] + [("", ""), ("a", ""), (None, "a"), ("Ana, Bela!", "bela ana"), ("abcd efg", "abcx efg")]
    rows = spark.createDataFrame(pairs, "a string, b string")

    def edits(p, q):
        last = list(range(len(q) + 1))
        for i, x in enumerate(p, 1):
            row = [i]
            for j, y in enumerate(q, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    def ratio(a, b):
        if a is None or b is None:
            return None
        x, y = ({w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()} for t in (a, b))
        if not x or not y:
            return 100 if not x and not y else 0
        both = sorted(x & y)
        texts = [" ".join(both), " ".join(both + sorted(x - y)), " ".join(both + sorted(y - x))]
        one = lambda p, q: 100 if p == q else 0 if not p or not q else int((max(len(p), len(q)) - edits(p, q)) / max(len(p), len(q)) * 100 + 0.5)
        return max(one(texts[0], texts[1]), one(texts[0], texts[2]), one(texts[1], texts[2]))

    found = rows.select("a", "b", C.token_set_ratio(F.col("a"), F.col("b")).alias("r"))
    assert [r.r for r in found.collect()] == [ratio(a, b) for a, b in pairs]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 2


def test_squeeze_knows_every_space_and_no_other_character(spark):
    from millrace.functions import text as X
    from millrace.operators import syllabus as Y

    rows = spark.range(0xFFFF).where("id > 0 AND NOT id BETWEEN 55296 AND 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("x"))
    x = F.col("x")
    judged = rows.select("id", X.squeeze(F.concat(F.lit("a"), x, F.lit("b"))).alias("one"), X.squeeze(F.concat(x, F.lit("a "), x, F.lit("b"), x)).alias("more"), F.regexp_replace(x, f"[{X.SPACE}]+", "").alias("plain"), Y.item(F.concat(F.lit("a."), x, F.lit(";"), x)).alias("item"))
    for r in judged.collect():
        c, space = chr(r.id), chr(r.id) in X.SPACES
        assert space == (r.plain == "")
        assert r.one == ("a b" if space else f"a{c}b")
        assert r.more == ("a b" if space else f"{c}a {c}b{c}")
        assert r.item == ("A" if space or c in ".;," else f"A.{c};{c}")


def test_programme_arrays_are_computed_once(spark):
    from millrace.operators import syllabus as Y

    span = spark.createDataFrame([(1, 0, None, "MATEMÁTICA\nJuros; Funções; Razão das vagas; Salas; Geometria")], "doc long, ordinal long, heading string, text string")
    nodes = Y.programme_nodes(span)
    assert [(r.depth, r.title, r.path) for r in nodes.orderBy("ordinal").collect()] == [(0, "Matemática", "matematica"), *[(1, t, "matematica/" + p) for t, p in (("Juros", "juros"), ("Funções", "funcoes"), ("Salas", "salas"), ("Geometria", "geometria"))]]
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert not any("size(" in line for line in plan.splitlines() if "Filter" in line and "regexp" in line)


def test_lines_are_cleaned_in_two_writes_and_judged_as_before(spark, monkeypatch):
    import unicodedata

    rng = random.Random(12)
    bits = ["palavra", "a", "É", "×", "÷", "\u0001", "12", "#", " ", "  ", "\t", " ", "http://a.b/c", "www.x", "incomparavelmentelonga", "日本", "menu", "\r"]
    lines = ["", "Home", "Política de Privacidade", "menu\r\n", *["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60))) for _ in range(1500)]]
    x, size = F.col("x"), F.char_length("x")
    letters, solid = (F.char_length(F.regexp_replace("x", p, "")) for p in (r"\P{L}", r"\s"))
    total = lambda p: F.aggregate(F.regexp_extract_all("x", F.lit(p), F.lit(1)), F.lit(0), lambda a, y: a + F.char_length(y))
    words = F.size(F.regexp_extract_all("x", F.lit("([A-Za-zÀ-ÿ]{2,})"), F.lit(1)))
    garbage = (size >= 8) & ((solid == 0) | (letters / F.greatest(solid, F.lit(1)) < 0.6) | (words == 0) | (total("([A-Za-zÀ-ÿ]{2,})") / F.greatest(words, F.lit(1)) > 14))
    links = total(r"(?i)(https?://\S+|www\.\S+)") / F.greatest(size, F.lit(1)) > 0.5
    markers = C.count(x, r"https?://") + C.count(x, r"www\.")
    boiler = F.regexp_like("x", F.lit("(?iu)" + C.NAVIGATION)) | ((size < 200) & (size > 0) & (links | (letters / F.greatest(size, F.lit(1)) < 0.4))) | ((markers >= 2) & (size < 160))
    spaced = F.array_join(F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace("x", "\r\n?", "\n"), "[ \t]+", " "), "\n"), trim), lambda y: y != ""), "\n")
    rows = spark.createDataFrame([(y,) for y in lines], "x string")
    found = rows.select((C.is_garbage(x) == garbage).alias("a"), (C.is_boilerplate(x) == boiler).alias("b"), (C.clean_whitespace(x) == spaced).alias("c")).collect()
    assert all(r.a and r.b and r.c for r in found)

    # characters that pass by neither change in composition nor join what stands before them
    safe = [chr(c) for c in range(1, 0x2028) if c < 0x300 or c >= 0x2010]
    assert all(unicodedata.normalize("NFC", b + c) == b + c for c in safe for b in "ae")

    written = []
    real = C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, label="table": written.append(label) or real(df, label))
    blocks = [(d, "s", p, p // 30, "paragraph", f"Uma linha que todos os documentos têm, de novo e de novo, {'' if p else d % 5}") for d in range(30) for p in range(9)]
    kept = C.clean_blocks(spark.createDataFrame(blocks, "doc_id long, source string, pos long, page long, kind string, line string"), "source").collect()
    assert sorted({r.doc_id for r in kept}) == [0, 1, 2]
    assert len(written) == 2


def test_repeated_lines_are_dropped_by_the_first_documents_of_a_key(spark):
    rng = random.Random(6)
    texts = [f"linha {i} com mais de quarenta caracteres ao todo, sim" for i in range(6)] + ["curta"]
    rows = [(d, f"s{d % 2}", p, rng.choice(texts)) for d in range(40) for p in range(rng.randint(1, 5))]
    held = {}
    for d, s, _, x in rows:
        held.setdefault((s, x), set()).add(d)
    wanted = sorted(r for r in rows if r[3] == "curta" or len([d for d in held[r[1], r[3]] if d < r[0]]) < 3)
    out = C.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, source string, pos int, line string"), "source")
    assert sorted(map(tuple, out.collect())) == wanted
    assert "WindowGroupLimit" in out._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_of_crowded_codes_meet_in_blocks_and_once(spark, monkeypatch):
    import numpy as np

    from millrace.operators import vectors as V

    assert V.plan_tables(10_000) == V.plan_tables(600_000)
    rng = np.random.default_rng(8)
    crowd = rng.normal(0, 1, 12)
    vectors = [crowd + rng.normal(0, 0.02, 12) for _ in range(60)] + [v + rng.normal(0, s, 12) for v in rng.normal(0, 1, (8, 12)) for s in np.linspace(0.02, 0.25, 8)]
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "id long, v array<double>")
    unit = np.array([v / np.linalg.norm(v) for v in vectors])
    near = unit @ unit.T >= V.SAME
    np.fill_diagonal(near, False)
    whole = {r.id: (r.unit, r.links) for r in V.merged_vectors(df, "id", "v").collect()}
    assert all(whole[k] == (0, 59) for k in range(60)) and near[:60].sum() == 60 * 59
    assert sum(n for _, n in whole.values()) >= 0.95 * near.sum() and all(n <= near[k].sum() for k, (_, n) in whole.items())
    links = V.vector_links(V.vector_classes(df, "id", "v")[1]).collect()
    assert len({(r.u, r.v) for r in links}) == len(links) == sum(n for _, n in whole.values()) // 2
    written = []
    real = V.materialize
    monkeypatch.setattr(V, "materialize", lambda d, label="table": (kept := real(d, label), written.append((label, kept.count())))[0])
    monkeypatch.setattr(V, "BLOCK", 9)
    assert {r.id: (r.unit, r.links) for r in V.merged_vectors(df, "id", "v").collect()} == whole
    # no table of pairs: 60 alike would be 1,770
    assert max(n for _, n in written) < 60 * 14


def test_stems_are_made_once_and_as_before(spark):
    from millrace.functions.text import fold

    rng = random.Random(2)
    words = ["", "Ação", "ações\n", "abc\n", "ção", None, "KK", *["".join(rng.choice("abçÉsx1-\n") for _ in range(rng.randint(0, 4))) + rng.choice([*C.SUFFIXES, "ções", "x", "L"]) for _ in range(1500)]]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    plain = F.regexp_replace(fold(F.col("w")), "[^a-z0-9]", "")
    old = F.when(F.char_length(plain) < 4, plain).otherwise(F.regexp_replace(plain, f"^(.{{3,}}?)(?:{'|'.join(C.SUFFIXES)})$", "$1"))
    assert all(r.a == r.b for r in rows.select(C.stem(F.col("w")).alias("a"), old.alias("b")).collect())
    docs, leaves = spark.createDataFrame([(1, "provas prova casa de mentes"), (2, None), (3, "de")], "d long, t string"), spark.createDataFrame([(7, "prova nova")], "l long, x string")
    found = C.lexical_scores(docs, "d", "t", leaves, "l", "x")
    assert [tuple(r) for r in found.collect()] == [(1, 7, 1.0)]
    # the stems of a text are not computed a second time to see whether there are any
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(t#") == 1
