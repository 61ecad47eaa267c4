"""Substring dedup, fill-in-middle and spelling variants against brute force, their SQL, and odd rows; which rows outlive a verdict; attributes of markup."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from millrace.llm import decontaminate, fill_in_middle, html_main_text, registry, spelling_variants, substring_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key long, kept boolean, word string, n long, form string"


def documents(spark, texts):
    """Documents with extra columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, 7, False, "w", 3, "f") for i, t in texts], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_fill_in_middle", "op13_spelling_variants"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    found, wanted = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = sorted(found.columns)
    at = {c: i for i, c in enumerate(wanted.columns)}
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    assert mine == sorted((tuple(plain(r[at[c]]) for c in columns) for r in wanted.fetchall()), key=repr)
    assert len(mine) > 100


# --- substring dedup --------------------------------------------------------------------------------


def brute_repeats(texts, length):
    first = {}
    for i, t in texts:
        words = WORD.findall(t or "")
        for s in range(len(words) - length + 1):
            if i is not None:
                key = tuple(words[s : s + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in texts:
        words = WORD.findall(t or "")
        gone = set()
        for s in range(len(words) - length + 1):
            if i is not None and first[tuple(words[s : s + length])] < i:
                gone.update(range(s, s + length))
        out.append((i, len(words), len(gone), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    return sorted(out, key=repr)


def repeating_texts(seed, documents_=60, vocabulary=9):
    """Texts of few words: passages of all lengths recur, in several surroundings, and periodic runs."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.randrange(3, 30))] for _ in range(6)]
    texts = []
    for i in range(documents_):
        words = []
        for _ in range(rng.randrange(5)):
            words += [word() for _ in range(rng.randrange(8))] + rng.choice(passages) + ["x"] * rng.choice([0, 0, 0, 12])
        texts.append((i, " ".join(words)))
    odd = [(None, texts[5][1]), (None, None), (7, texts[3][1]), (7, texts[4][1]), (7, texts[4][1]), (100, None), (101, ""), (102, " \t\n"), (103, texts[9][1].replace(" ", "\x0b\r")), (104, "é ß " * 30), (-3, texts[11][1])]
    rng.shuffle(texts)
    return texts + odd


@pytest.mark.parametrize(("seed", "length", "gram", "most"), [(1, 6, 2, 512), (2, 6, 2, 2), (3, 10, 4, 3), (4, 10, 10, 512), (5, 5, 1, 1)])
def test_repeats_match_brute_force(spark, seed, length, gram, most):
    texts = repeating_texts(seed)
    rows = substring_dedup.repeated_passages(documents(spark, texts).repartition(5), length, gram, most).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=repr) == brute_repeats(texts, length)
    for r in rows:
        assert sum(s.stop - s.start for s in r.removed) == r.n_removed
        assert all(a.stop < b.start for a, b in zip(r.removed, r.removed[1:]))


def test_long_and_common_passages(spark):
    rng = random.Random(8)
    line = " ".join(f"p{k}" for k in range(60))
    texts = [(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(rng.randrange(80)))) for i in range(300)]
    texts = [(i, f"{t} {line} {t[::-1]}" if i % 3 == 0 else t) for i, t in texts]
    texts += [(900, "x " * 20000), (901, "x " * 300), (902, " ".join(f"u{k % 37}" for k in range(5000))), (903, " ".join(f"u{k % 37}" for k in range(17, 400)))]
    for most in (512, 20):
        rows = substring_dedup.repeated_passages(documents(spark, texts), most_contexts=most).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=repr) == brute_repeats(texts, 50)


def test_no_documents_have_no_repeats(spark):
    assert substring_dedup.repeated_passages(documents(spark, [(1, "a")]).limit(0)).count() == 0


def test_equal_windows_have_an_anchor_of_one_key():
    rng = np.random.default_rng(3)
    for n in (49, 50, 51, 200, 1000):
        for few in (1, 3, 1 << 40):
            hashes = rng.integers(0, few, n).astype(np.uint64)
            positions, keys = substring_dedup.anchors(hashes, 50, 8)
            assert len(positions) == len(keys)
            for s in range(n - 49):
                inside = [k for p, k in zip(positions, keys) if s <= p <= s + 42]
                _, alone = substring_dedup.anchors(hashes[s : s + 50], 50, 8)
                assert set(alone) <= set(inside) and len(alone) == 1


def test_automaton_spans():
    rng = random.Random(5)
    for _ in range(200):
        held = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(3)]
        automaton = substring_dedup.SuffixAutomaton()
        for h in held:
            automaton.add(list(h))
        asked = "".join(rng.choice("ab") for _ in range(15))
        for least in (1, 3, 5):
            wanted = {k for s in range(16 - least) if any(asked[s : s + least] in h for h in held) for k in range(s, s + least)}
            assert {k for a, b in automaton.spans(list(asked), least) for k in range(a, b)} == wanted


# --- fill in the middle -----------------------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD_TEXTS = [None, "", " ", "\n\t ", "one", " one", "one ", "  one \n two\x0b", "a<P>b", "<S", "x<M", "é ß 漢字 😀 y", "<", "P> <P", "a " * 5000, " wide ", "a\x1cb\x85c"]


def brute_example(text, doc_id):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    assert "".join(units) == text
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_examples_match_brute_force(spark):
    rng = random.Random(2)
    texts = [(i, rng.choice(ODD_TEXTS)) for i in range(400)] + [(None, "a b c"), (None, None), (5, "same id"), (5, "same id")]
    made = fill_in_middle.fill_in_middle(documents(spark, texts))
    rows = made.select("*", fill_in_middle.restored().alias("back")).collect()
    wanted = sorted([(i, *brute_example(t, i), t or "") for i, t in texts], key=repr)
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in rows], key=repr) == wanted
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(documents(spark, texts[:1]).limit(0)).count() == 0


def test_unit_ends_are_the_units():
    scan = fill_in_middle.automaton()
    rng = random.Random(9)
    for _ in range(500):
        text = "".join(rng.choice(" \t\n\x0b\x0c\rab<P>S é😀") for _ in range(rng.randrange(30)))
        ends, marked = fill_in_middle.unit_ends(text, scan)
        assert ends.tolist() == [m.end() for m in UNIT.finditer(text)]
        assert marked == any(s in text for s in ("<P>", "<S>", "<M>"))


# --- spelling variants ------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = collections.Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    form, count = {}, {}
    for w in words:
        close = [v for v in words if near(w, v)]
        count[w] = len(close)
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], count[w], words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def spelled_texts(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abÉÿc") for _ in range(rng.randrange(4, 9))) for _ in range(40)]
    texts = []
    for i in range(80):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "a" + w[k:], w[:k] + "b" + w[k + 1 :]])
            words.append(rng.choice([w, w.upper(), f"{w}7{w}", f"{w}×"]))
        texts.append((i, " ".join(words)))
    return texts + [(None, texts[0][1]), (None, None), (3, ""), (4, "12 !?"), (5, texts[5][1]), (5, texts[5][1]), (6, "abcdeé" * 4000 + " zzzzz zzzzz zzzzz")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_match_brute_force(spark, seed):
    texts = spelled_texts(seed)
    rows = spelling_variants.spelling_variants(documents(spark, texts).repartition(3)).collect()
    found = sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows), key=repr)
    assert found == brute_variants(texts)
    assert any(r.root not in (r.word, r.form) for r in rows)


@pytest.mark.parametrize("most", [1, 2, 7, 4000])
def test_blocks_of_long_lists_lose_no_pair(spark, most):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(5, 9))) for _ in range(500)})
    df = spark.createDataFrame([(w, k + 3) for k, w in enumerate(words)], "word string, n long")
    rows = [tuple(sorted((r.a, r.b))) for r in spelling_variants.near_pairs(df, most).collect()]
    assert sorted(rows) == sorted((a, b) for k, a in enumerate(words) for b in words[k + 1 :] if near(a, b))


def test_no_words_have_no_variants(spark):
    assert spelling_variants.spelling_variants(documents(spark, [(1, "ab cd")])).count() == 0
    assert spelling_variants.spelling_variants(documents(spark, [(1, "a")]).limit(0)).count() == 0


def test_pieces_end_between_runs(monkeypatch):
    monkeypatch.setattr(spelling_variants, "PIECE", 7)
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("abÿ 1") for _ in range(rng.randrange(60)))
        assert [w for p in spelling_variants.pieces(text) for w in p] == spelling_variants.RUN.findall(text)


# --- what outlives a verdict ------------------------------------------------------------------------


def test_verdicts_reach_rows_without_an_id_and_only_their_own(spark):
    import corpus_pipeline

    good = " ".join(f"word{k % 50} and{k}" for k in range(60))
    item = " ".join(f"item{k}" for k in range(40))
    leak = f"{good} {item}"
    texts = [(None, "two words"), (1, "two words"), (2, good), (2, "too short"), (None, leak), (3, leak), (4, leak), (4, good + " tail"), (None, good + " end here")]
    docs = documents(spark, texts)
    held = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    ruled = held(corpus_pipeline.rules(spark, docs, SF))
    assert not any(t in ("two words", "too short") for _, t in ruled) and (2, good) in ruled
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = decontaminate.without_leaks(docs, benchmark)
    assert held(clean) == sorted([(i, t) for i, t in texts if t != leak], key=repr) and clean.columns == docs.columns
    first = held(corpus_pipeline.deduplicate(spark, docs, SF))
    assert len([t for _, t in first if t == "two words"]) == 1 and (1, "two words") in first
    assert len([t for _, t in first if t == leak]) == 1 and (3, leak) in first
    assert (2, "too short") in first


def test_one_of_repeated_rows_outlives_dedup(spark):
    import corpus_pipeline

    words = " ".join(f"word{k}" for k in range(30))
    rows = corpus_pipeline.deduplicate(spark, documents(spark, [(None, words), (None, words), (5, words + " x"), (5, words + " x"), (6, "other text that stands alone here")]), SF).collect()
    assert sorted(r.text for r in rows) in (sorted([words, "other text that stands alone here"]), sorted([words + " x", "other text that stands alone here"]))


# --- attributes -------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("markup", "shown"),
    [
        ('<div style="overflow:hidden">text</div>', True),
        ('<p title="a hidden gem">text</p>', True),
        ('<p data-hidden="false">text</p>', True),
        ('<p data-role="navigation">text</p>', True),
        ('<p data-class="menu" alt="site footer">text</p>', True),
        ('<div class="product-menu">text</div>', True),
        ('<figure class="img-banner"><figcaption>text</figcaption></figure>', True),
        ("<p title='class=menu'>text</p>", True),
        ('<p title="x" hidden>text</p>', False),
        ('<p HIDDEN="">text</p>', False),
        ("<div class=menu>text</div>", False),
        ('<div class="site-menu open">text</div>', False),
        ('<div id="top-banner">text</div>', False),
        ('<div data-x="1" role="navigation">text</div>', False),
        ('<div aria-hidden="true">text</div>', False),
        ('<div aria-hidden="false">text</div>', True),
        ('<div class="cookie-notice">text</div>', False),
    ],
)
def test_whole_attribute_names_mark_chrome(markup, shown):
    found = [t for z, t in html_main_text.blocks_of(f"<article><p>before</p>{markup}</article>") if z == "main"]
    assert found == (["before", "text"] if shown else ["before"])
