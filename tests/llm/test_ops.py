"""Corpus operators on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing columns, brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import byte_cnn, chat_format, decontaminate, html_main_text, katz, language_id, near_dup, quality_rules, sentencepiece_fst, sharding
from millrace.llm.components import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot int, score double, kept boolean, w string"


def documents(spark, texts):
    """Documents with extra columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, 7, 0.5, False, "w") for i, t in texts], SCHEMA)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    base = sentence(rng, 60)
    texts = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two three"), (5, base), (6, base), (6, base), (7, base + " tail"), (8, "x " * 20000), (9, "É ß 漢字 " * 5), (10, "Repeat this line\n" * 5)]
    return documents(spark, texts), texts


# --- sharding -------------------------------------------------------------------------------------


def test_best_fit_decreasing_matches_a_plain_scan():
    rng = random.Random(3)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 60) for _ in range(rng.randint(1, 80))), reverse=True)
        left, wanted = [], []
        for s in sizes:
            fits = [(r, b) for b, r in enumerate(left) if r >= s]
            b = min(fits)[1] if fits else len(left)
            if not fits:
                left.append(60)
            left[b] -= s
            wanted.append(b)
        assert sharding.best_fit_decreasing(sizes, 60) == wanted


def test_shards_hold_whole_groups(spark, odd):
    df, texts = odd
    rows = sharding.shard_documents(df, 3).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in texts)
    text = dict(texts)
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert r.size == len(data) + 16 and r.text_crc32 == zlib.crc32(data)
    where = collections.defaultdict(set)
    for r in rows:
        where[text[r.doc_id] or ""].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_shards_are_near_equal(spark):
    rows = sharding.op1_sharding(spark, "/root/testdata/sf0.01").collect()
    sums = collections.Counter()
    for r in rows:
        sums[r.shard] += r.size
    assert len(sums) == 40 and max(sums.values()) < 1.02 * sum(sums.values()) / 40


def test_sharding_of_nothing(spark):
    assert sharding.shard_documents(documents(spark, []), 4).count() == 0
    assert sharding.shard_documents(documents(spark, [(1, "abc")]), None, 1000).first().shard == 0


# --- near duplicates ------------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts}
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_against_all_pairs(spark, odd):
    df, texts = odd
    wanted = brute_components(texts)
    rows = near_dup.near_duplicates(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id) == wanted[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_a_large_group_of_near_copies(spark):
    """A hub with copies around it, over more documents than a block holds, and pairs at the threshold."""
    rng = random.Random(9)
    hub = [f"h{i}" for i in range(150)]
    texts = [(0, " ".join(hub))]
    for i in range(1, 140):
        copy = list(hub)
        for at in rng.sample(range(150), rng.randrange(1, 9)):
            copy[at] = f"n{i}x{at}"
        texts.append((i, " ".join(copy)))
    texts += [(1000 + i, sentence(rng, rng.randrange(3, 80))) for i in range(60)]
    wanted = brute_components(texts)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(documents(spark, texts)).collect()}
    assert found == wanted


def test_near_duplicates_of_null_ids_and_nothing(spark):
    rows = near_dup.near_duplicates(documents(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {(None, None, True), (1, 1, True), (2, 1, False)}
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (95, 100)] + [(7, 7)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(1, 31)) and found[95] == found[100] == 90


def exact_components(texts):
    """Components of all links, by a prefix filter over the rarest shingles (which loses none) and exact sets."""
    sets = {i: shingles(t) for i, t in texts}
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            comp[x] = comp[comp[x]]
            x = comp[x]
        return x

    def join(a, b):
        x, y = sorted((root(a), root(b)))
        comp[y] = x

    classes = collections.defaultdict(list)
    for i, s in sets.items():
        if s:
            classes[s].append(i)
    times = collections.Counter(x for s in classes for x in s)
    index = collections.defaultdict(list)
    for s, members in sorted(classes.items(), key=lambda c: len(c[0])):
        for other in members[1:]:
            join(members[0], other)
        rare = sorted(s, key=lambda x: (times[x], x))[: len(s) - -(-3 * len(s) // 4) + 1]
        for other in {o for x in rare for o in index[x] if 4 * len(o) >= 3 * len(s)}:
            if root(classes[other][0]) != root(members[0]) and 100 * len(s & other) >= 75 * len(s | other):
                join(members[0], classes[other][0])
        for x in rare:
            index[x].append(s)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_near_duplicates_equal_an_exact_join(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    wanted = exact_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs).collect()}
    assert found == wanted


# --- decontamination ------------------------------------------------------------------------------


def weighted(a, b):
    x, y = collections.Counter(a), collections.Counter(b)
    return sum((x & y).values()) / sum((x | y).values())


def test_leaks_against_all_windows(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randrange(12, 40))) for i in range(6)] + [(6, "two words"), (7, None), (8, ""), (9, "same same same same same same same same")]
    texts = [(0, None), (1, "")] + [(i, sentence(rng, 80)) for i in range(2, 12)]
    planted = items[0][1].split()
    planted[20 % len(planted)] = "changed"
    texts += [(20, sentence(rng, 30) + " " + items[1][1].upper() + " " + sentence(rng, 10)), (21, "\n".join(items[2][1].split())), (22, "pre " + " ".join(planted) + " post"), (23, "here are Two Words indeed"), (24, "same " * 30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(documents(spark, texts), bench).collect()}
    wanted = {}
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    for (d, t), (i, x) in itertools.product(texts, items):
        w, q = WORD.findall((t or "").translate(LOWER)), WORD.findall((x or "").translate(LOWER))
        best = max((weighted(grams(w[k : k + len(q)]), grams(q)) for k in range(len(w) - len(q) + 1)), default=0) if q else 0
        if best >= 0.75:
            wanted[d, i] = best
    assert found.keys() == wanted.keys()
    assert all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)
    assert {r.doc_id for r in decontaminate.without_leaks(documents(spark, texts), bench).collect()} == {d for d, _ in texts} - {d for d, _ in wanted}


def brute_leaks(texts, items):
    """Best similarity over all windows; they cross the document's ends as far as shared shingles put the item there."""
    out, grams = {}, lambda w, g: [tuple(w[i : i + g]) for i in range(len(w) - g + 1)]
    for (d, t), (i, x) in itertools.product(texts, items):
        w, q = WORD.findall((t or "").translate(LOWER)), WORD.findall((x or "").translate(LOWER))
        g = min(5, len(q))
        anchored = [k - j for k, a in enumerate(grams(w, g)) for j, b in enumerate(grams(q, g)) if a == b] if q and set(grams(w, g)) & set(grams(q, g)) else []
        if not anchored:
            continue
        starts = range(min(0, *anchored), max(len(w) - len(q), *anchored) + 1)
        best = max((weighted(grams(w[max(0, k) : max(0, k + len(q))], g), grams(q, g)) for k in starts), default=0)
        if best >= 0.75:
            out[d, i] = best
    return out


def test_leaks_of_cut_and_widened_items(spark):
    rng = random.Random(12)
    items, texts = [], []
    for i, n in enumerate((20, 25, 50, 50, 50, 60, 60, 80, 80, 120)):
        q = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        items.append((i, " ".join(q)))
        wide = q[1 : n // 2] + ["put", "in"] + q[n // 2 : -1]  # the best window starts at no anchored place
        texts += [(100 + i, " ".join(wide)), (200 + i, " ".join([sentence(rng, 20), *wide, sentence(rng, 20)])), (300 + i, " ".join([*q[3:], sentence(rng, 9)]))]
        texts.append((400 + i, f"{' '.join(q[: n // 2])} one two three {' '.join(q[n // 2 :])} {sentence(rng, 30)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(documents(spark, texts), bench).collect()}
    wanted = brute_leaks(texts, items)
    assert len(wanted) > 20 and found.keys() == wanted.keys()
    assert all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)


def test_leaks_with_replaced_ends(spark):
    rng = random.Random(13)
    items, texts = [], []
    for i in range(60):
        q = [f"v{rng.randrange(10**6)}" for _ in range((50, 100, 200)[i % 3])]
        items.append((i, " ".join(q)))
        texts.append((100 + i, " ".join([sentence(rng, 12), *q[: -((len(q) - 4) // 7)], sentence(rng, 30)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(documents(spark, texts), bench).collect()
    wanted = brute_leaks(texts, items)
    assert len(wanted) >= 60 and {(r.doc_id, r.item_id) for r in found} == wanted.keys()
    assert max(r.hamming for r in found) > 14


def test_decontamination_of_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(documents(spark, [(1, "a b c")]), empty).count() == 0
    assert decontaminate.leaks(documents(spark, []), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_hamming_blocks_find_every_neighbour(spark):
    rng = random.Random(2)
    own = rng.getrandbits(63)
    pairs = []
    for n in range(0, decontaminate.RADIUS + 1):
        other = own
        for b in rng.sample(range(63), n):
            other ^= 1 << b
        pairs.append((own, other))
    df = spark.createDataFrame(pairs, "a long, b long")
    met = df.select(F.arrays_overlap(decontaminate.own_blocks(F.col("a")), decontaminate.near_blocks(F.col("b"))).alias("ok"))
    assert all(r.ok for r in met.collect())


# --- quality rules --------------------------------------------------------------------------------


def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    out = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*out, out[0] < 20 or 100 * out[4] > 30 * out[0])


def test_base_statistics(spark, odd):
    rng = random.Random(6)
    passage = sentence(rng, 12)
    texts = [*odd[1], (30, f"{passage} {sentence(rng, 9)} {passage} tail"), (31, "# $ % & | < > * " * 3), (32, " ".join("abcdefgh") + " " + " ".join("abcdefgh"))]
    found = quality_rules.judge(documents(spark, texts)).collect()
    assert len(found) == len(texts)
    text = dict(texts)
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_outliers_are_rejected_and_the_rest_kept(spark):
    rng = random.Random(8)
    texts = [(i, sentence(rng, rng.randrange(25, 400))) for i in range(300)] + [(1000 + i, " ".join(w + "###" for w in sentence(rng, 100).split())) for i in range(30)]
    found = {r.doc_id: r.kept for r in quality_rules.judge(documents(spark, texts)).collect()}
    assert not any(found[i] for i in found if i >= 1000)
    assert sum(found[i] for i in range(300)) >= 298


def test_rules_of_nothing(spark):
    assert quality_rules.judge(documents(spark, [])).count() == 0
    assert [r.kept for r in quality_rules.judge(documents(spark, [(1, None)])).collect()] == [False]


def plain_mcd(x, rng):
    """The least determinant of many random starts, each concentrated until it stops."""
    n, d = x.shape
    keep, floor, best = int(np.ceil(0.75 * n)), np.square(quality_rules.FLOORS), None
    for _ in range(40):
        own = x[rng.choice(n, d + 2, replace=False)]
        for _ in range(60):
            mean, cov = own.mean(axis=0), np.cov(own.T, bias=True) + np.diag(floor)
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            new = x[np.argsort(d2, kind="stable")[:keep]]
            if np.array_equal(new, own):
                break
            own = new
        det = np.linalg.slogdet(np.cov(own.T, bias=True) + np.diag(floor))[1]
        if best is None or det < best[0]:
            best = (det, own.mean(axis=0), np.cov(own.T, bias=True) + np.diag(floor))
    return best


def test_estimates_equal_a_plain_minimum_covariance_determinant(spark):
    rng = np.random.default_rng(3)
    data = {}
    for g in ("a", "b"):
        x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) * 0.5
        x[:80] += 6.0  # a fifth lies together far off and would mask itself in plain moments
        data[g] = x
    rows = spark.createDataFrame([(g, *map(float, v)) for g, x in data.items() for v in x], "grp string, " + ", ".join(f"{f} double" for f in quality_rules.FEATURES))
    found = {r.grp: r.asDict() for r in quality_rules.robust_estimates(rows).collect()}
    for g, x in data.items():
        det, mean, cov = plain_mcd(x, rng)
        assert found[g]["n"] == 400 and found[g]["log_det"] < det + 0.05
        assert np.allclose([found[g][f"m_{i}"] for i in range(5)], mean, atol=0.12)
        d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        wide = max(np.median(d2) / quality_rules.CHI2_MEDIAN, 1)
        for i, j in quality_rules.UPPER:
            assert abs(found[g][f"c_{i}_{j}"] - wide * cov[i, j]) < 0.15 * wide * np.sqrt(cov[i, i] * cov[j, j])


def test_groups_of_few_rows_follow_their_language(spark):
    rng = random.Random(18)
    rows = [(i, sentence(rng, rng.randrange(25, 200)), "en", "big") for i in range(250)] + [(900 + i, sentence(rng, 60), "en", f"one{i}") for i in range(5)] + [(950, " ".join(f"w{i}###" for i in range(60)), "en", "lone"), (960, sentence(rng, 50), None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r.kept for r in quality_rules.judge(df).collect()}
    assert all(found[900 + i] for i in range(5)) and not found[950] and found[960]


# --- chat -----------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "<s>[INST] <~s> [~~/INST]"), (1, 1, "user", None), (1, 2, "assistant", "a\n</s>"), (1, 3, "user", "[INST][/INST]"), (1, 4, "assistant", ""), (1, 5, "user", "last"),
        (2, 0, "user", "only"), (3, 0, "assistant", "漢字 \\ <"), (3, 0, "assistant", "漢字 \\ <"), (None, 0, "user", "x"), (4, 0, None, "no role"),
    ]
    df = spark.createDataFrame([(*r, 9, "e") for r in rows], "conv_id long, turn long, role string, text string, example int, formatted string")
    found = {r.conv_id: r for r in chat_format.read_back(chat_format.prefix_targets(df)).collect()}
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role or "", text or ""))
    assert found.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (found[c].n_turns, found[c].turns_sha256, found[c].loss_chars, found[c].loss_sha256) == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat_format.prefix_targets(df).where("conv_id = 1").orderBy("example").collect()
    assert [e.example for e in examples] == [3, 5, 6] and examples[-1].loss_length == 0
    for e in examples[:2]:
        assert e.formatted.endswith("[/INST]</s>") and e.formatted.count("</s>") == e.example
    assert chat_format.read_back(chat_format.prefix_targets(df.limit(0))).count() == 0


# --- classifier -----------------------------------------------------------------------------------


def test_chunks_cover_everything():
    for n in (0, 1, 63, 512, 513, 960, 961, 5000):
        data = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        chunks = byte_cnn.chunks_of(data)
        step = byte_cnn.CHUNK - byte_cnn.OVERLAP
        back = {}
        for k, row in enumerate(chunks):
            for j, v in enumerate(row):
                if v:
                    back[k * step + j] = int(v) % 257 - 1
        assert bytes(back[i] for i in range(n)) == data


def test_gradients_match_differences():
    net = byte_cnn.ByteCNN()
    texts = [b"plain words in a row", b"$$$ ### odd *** marks " * 40]
    parts, labels = [byte_cnn.chunks_of(t) for t in texts], np.array([1, 0], np.float32)

    def loss():
        best = net._pooled(np.concatenate(parts))
        sizes = np.array([len(p) for p in parts])
        x = net._features(best, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        z = x @ net.weights["head"] + net.weights["intercept"][0]
        return float(np.mean(np.logaddexp(0, z) - labels * z))

    grads = net._gradients(parts, labels)
    for key, at in (("filters", (5, 3)), ("bias", (2,)), ("intercept", (0,)), ("embed", (ord("w") + 1, 2)), ("ages", (6, 1))):
        old = net.weights[key][at]
        net.weights[key][at] = old + 1e-2
        up = loss()
        net.weights[key][at] = old - 1e-2
        down = loss()
        net.weights[key][at] = old
        assert abs((up - down) / 2e-2 - grads[key][at]) < 5e-3


def test_classifier_on_held_out_documents(spark):
    rows = byte_cnn.op8_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95


def test_ages_against_a_plain_scan():
    rng = random.Random(3)
    for size in (0, 5, 6, 7, 200, 900):
        data = bytes(rng.choice(b"abc") if rng.random() < 0.9 else rng.randrange(256) for _ in range(size))
        last, wanted = {}, []
        for i in range(size):
            gram = data[i : i + 6] if i + 6 <= size else None
            wanted.append(min((i - last[gram]).bit_length() + 1, 15) if gram in last else 0)
            if gram:
                last[gram] = i
        assert byte_cnn.ages_of(np.frombuffer(data, np.uint8)).tolist() == wanted


def test_scores_against_plain_loops():
    rng = random.Random(4)
    net = byte_cnn.ByteCNN(seed=5)
    texts = [b"", b"short", bytes(rng.randrange(256) for _ in range(1300)), b"again and again " * 60]
    w = {k: v.astype(float) for k, v in net.weights.items()}
    for text, score in zip(texts, net.scores(texts)):
        tops = []
        for row in byte_cnn.chunks_of(text):
            place = [w["embed"][c % 257] + w["ages"][c // 257] for c in row.tolist()]
            spots = range(0, byte_cnn.CHUNK - byte_cnn.WIDTH + 1, byte_cnn.STRIDE)
            out = [np.concatenate(place[p : p + byte_cnn.WIDTH]) @ w["filters"] + w["bias"] for p in spots]
            tops.append(np.maximum(np.max(out, axis=0), 0))
        z = np.concatenate([np.max(tops, axis=0), np.mean(tops, axis=0)]) @ w["head"] + w["intercept"][0]
        assert abs(1 / (1 + np.exp(-z)) - score) < 1e-4


def test_classifier_without_labels(spark, odd):
    df, texts = odd
    model = byte_cnn.train(df, spark.createDataFrame([], "doc_id long, quality int"))
    rows = byte_cnn.score_documents(df, model).collect()
    assert len(rows) == len(texts) and {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {1}
    assert byte_cnn.keep_good(df, model).columns == df.columns


# --- language model -------------------------------------------------------------------------------


def test_language_model_against_a_plain_one(spark):
    rng = random.Random(12)
    texts = [(i, " ".join(rng.choice("a b c d e f g h i j k l m n o p".split()) for _ in range(rng.randrange(0, 40)))) for i in range(120)] + [(500, None), (501, "never seen WORDS A"), (502, "a " * 3000)]
    rows = katz.score_texts(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    tokens = {i: WORD.findall((t or "").translate(LOWER)) + [None] for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    train = [t for i, t in tokens.items() if not held[i]]
    one = collections.Counter(w for t in train for w in t)
    two = collections.Counter(p for t in train for p in zip(["<s>", *t], t))
    n, v = sum(one.values()), len(one)
    of = lambda c: [sum(x == k for x in c.values()) for k in range(1, 7)]
    d1, d2 = katz.good_turing(of(one)), katz.good_turing(of(two))
    cut = lambda r, d: r * (d[r - 1] if r <= len(d) else 1)
    held1 = sum(cut(r, d1) for r in one.values())
    scale = 1 if held1 < n * (1 - 1e-9) else n / (n + 1)
    p1 = {w: cut(r, d1) * scale / n for w, r in one.items()}
    unknown = 1 - sum(p1.values())
    after = collections.defaultdict(dict)
    for (a, b), r in two.items():
        after[a][b] = r

    def probability(a, b):
        low = p1.get(b, unknown)
        if a not in after:
            return low
        total, kept = sum(after[a].values()), sum(cut(r, d2) for r in after[a].values())
        s = 1 / total if kept < total * (1 - 1e-9) else 1 / (total + 1)
        if b in after[a]:
            return cut(after[a][b], d2) * s
        return (1 - kept * s) / (1 - sum(p1[w] for w in after[a])) * low

    for a in ["<s>", "a", "b", "p"]:
        assert abs(sum(probability(a, w) for w in one) + probability(a, "?") - 1) < 1e-9
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(w in one for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((one.get(w, 0) + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(probability(a, b)) for a, b in zip(["<s>", *t], t)), rel_tol=1e-9)


def test_language_model_of_nothing(spark):
    assert katz.score_texts(documents(spark, [])).count() == 0
    row = katz.score_texts(documents(spark, [(None, "a b")])).first()
    assert row.held_out and row.n_tokens == 3 and row.n_known == 0 and row.train_tokens == 0 and row.score == 0


def test_packed_arrays_come_back():
    a, b = np.array([3, 1, 2**63], np.uint64), np.array([], np.uint32)
    x, y = katz.load(katz.dump(a, b))
    assert x.tolist() == a.tolist() and x.dtype == a.dtype and len(y) == 0
    values, sizes = np.array([5, 9, 1, 7, 7], np.uint64), np.array([2, 0, 3])
    assert katz.undelta(katz.deltas(values, np.array([0, 2])), sizes).tolist() == values.tolist()


# --- pieces ---------------------------------------------------------------------------------------


def test_transducer_equals_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    machine = sentencepiece_fst.Transducer(sentencepiece_fst.read_model(sentencepiece_fst.MODEL))
    rng = random.Random(5)
    alphabet = " \n\t▁abcXYZ é梦𝔘ß<0x0A></s>\x00the ing"
    texts = ["", " ", "   ", "a", " a b  c    d ", "\n\n", "x" * 100, " " * 50, " " * 17 + "é", "</s>[INST] ok"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    for text in texts:
        assert machine.encode(text).tolist() == library.encode(text)
        if "▁" not in text:
            assert machine.decode(machine.encode(text)) == text


def test_encoding_rows(spark, odd):
    df, texts = odd
    rows = sentencepiece_fst.encode_documents(df).collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows) and all(len(r.token_ids) == r.n_tokens for r in rows)
    assert sentencepiece_fst.encode_documents(df.limit(0)).count() == 0


# --- pages ----------------------------------------------------------------------------------------


def test_article_only(spark):
    html = (
        "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li>Menu</li></ul></nav><header>Site</header><div class='cookie-notice'>Cookies<div>in</div></div>"
        "<article><h1>A &amp; b</h1><p>One<br>two&nbsp; three<p>Next <b>bold</b>\n text<aside>side</aside><div class=ad>Buy</div><form>f</form><section id='comments'><p>Nice!</p></section><p>End</article><footer>foot</footer>out</body></html>"
    )
    rows = spark.createDataFrame([(1, "http://a.b/x", html, 5, "t"), (2, "http://a.b/y", None, 5, "t"), (3, None, "", 5, "t"), (4, "http://a.b/z", "<p>plain", 5, "t")], "page_id long, url string, html string, n_chars int, text string")
    found = {r.page_id: (r.text, r.n_chars) for r in html_main_text.extract_main_text(rows).collect()}
    assert found[1][0] == "A & b\nOne two three\nNext bold text\nEnd"
    assert found[2] == ("", 0) and found[3] == ("", 0) and found[4] == ("plain", 5)
    assert html_main_text.extract_main_text(rows.limit(0)).count() == 0


def test_repeated_runs_are_boilerplate(spark):
    shared = "subscribe to our weekly letter and get all the best news"
    pages = [(i, f"http://h.example/{i}", f"<body><div>{shared}</div><p>unique text number {i} with some words of its own kind{i}</p></body>") for i in range(5)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_main_text.extract_main_text(rows).collect()} == {i: f"unique text number {i} with some words of its own kind{i}" for i in range(5)}


@pytest.mark.parametrize(
    ("name", "chrome"),
    [("cookie-notice", True), ("siteFooter", True), ("main_nav", True), ("related-posts", True), ("ad", True), ("no-sidebar", False), ("with-nav", False), ("has-ads", False), ("search-results", False), ("menu-open", False), ("content", False), ("leading", False)],
)
def test_names_of_chrome(name, chrome):
    assert html_main_text.names_chrome(name) == chrome


def test_wrappers_and_scripts_of_odd_form():
    page = "<div class='page has-ads no-sidebar'><script src=https://a/b/>var x = 1;</script><div class=promo-banner><main><p>Text</p></main></div></div><svg/><p>after"
    assert html_main_text.blocks_of(page) == [("main", "Text"), ("open", "after")]


def brute_texts(pages):
    """Runs of eight tokens over all blocks of a host, each looked up in every other page."""
    blocks = [(url.split("/")[2], html, html_main_text.blocks_of(html)) for _, url, html in pages]
    seen, chrome = {z: collections.defaultdict(set) for z in ("boiler", "main")}, set()
    for host, html, own in blocks:
        settled = any(z == "main" for z, _ in own)
        for zone, text in own:
            t = text.split(" ")
            for i in range(len(t) - 7):
                seen["main" if zone == "main" else "boiler"][host, tuple(t[i : i + 8])].add(html)
                if zone == "chrome" or (zone == "open" and settled):
                    chrome.add((host, tuple(t[i : i + 8])))
    out, sizes = [], collections.Counter(host for host, _ in {(h, x) for h, x, _ in blocks})
    for host, html, own in blocks:
        zone = "main" if any(z == "main" for z, _ in own) else "open"
        kept = []
        for text in (t for z, t in own if z == zone):
            t = text.split(" ")
            covered = set()
            for i in range(len(t) - 7):
                key = host, tuple(t[i : i + 8])
                if len(seen["boiler"][key]) > 1 and (zone == "open" or (key in chrome and len(seen["main"][key]) >= max(5, sizes[host] / 3))):
                    covered |= set(range(i, i + 8))
            kept.append(" ".join(x for i, x in enumerate(t) if i not in covered))
        out.append("\n".join(filter(None, kept)))
    return out


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_extraction_against_all_runs(spark, most):
    rng = random.Random(21)
    line, passage, teaser = sentence(rng, 11), sentence(rng, 60), sentence(rng, 15)
    pages = []
    for i in range(160):  # the host's size does not matter
        own = f"<h1>{teaser if i == 7 else sentence(rng, 9)}</h1><p>{sentence(rng, 40)}</p>"
        share = f"<p>{sentence(rng, 3)} {line} {sentence(rng, 2)}</p>" if i % 3 else f"<div class='share'>{line}</div>"
        quoted = f"<blockquote>{passage}</blockquote>" if i % 5 == 0 else ""
        listed = f"<aside>{teaser}</aside><div class=ad>{passage[:80]}</div>" if i in (8, 9) else ""
        body = f"<article>{own}{share}{quoted}</article>" if i % 4 else f"<div>{own}{share}{quoted}</div><div>{line}</div>"
        pages.append((i, f"http://{'big' if i < 150 else 'small'}.example/{i}", f"<body>{listed}{body}</body>"))
    pages.append((500, "http://big.example/copy?utm_source=x", pages[4][2]))
    rows = spark.createDataFrame([(*p, 3, "t", 1) for p in pages], "page_id long, url string, html string, n_chars int, text string, run int")
    found = {r.page_id: r.text for r in html_main_text.extract_main_text(rows, most).collect()}
    wanted = dict(zip((p[0] for p in pages), brute_texts(pages)))
    assert found == wanted
    assert not any(line in t for t in wanted.values()) and passage in wanted[5] and wanted[7].startswith(teaser) and wanted[500] == wanted[4] != ""


# --- languages ------------------------------------------------------------------------------------


def test_languages_of_documents_and_pages(spark):
    rows = language_id.op3_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = [r for r in rows if r.kind == "document"]
    assert len(docs) == len(truth) and np.mean([truth[r.doc_id] == r.lang for r in docs]) > 0.95
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    pages = [r for r in rows if r.kind == "page"]
    assert len(pages) == len(html) and np.mean([f'lang="{r.lang}"' in html[r.page_id] for r in pages]) > 0.9


def test_evidence_decides_where_text_says_nothing(spark):
    docs = spark.createDataFrame([(i, "the house and the tree " * 5, "en", "s") for i in range(20)] + [(50 + i, "der baum und das haus " * 5, "de", "t") for i in range(20)] + [(99, None, None, "t")], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(i, f"http://x.de/{i}", '<html lang="de"><p>der baum und das haus</p>') for i in range(8)] + [(100, "http://x.de/e", '<html lang="de"></html>'), (101, None, None)], "page_id long, url string, html string")
    found = {(r.doc_id, r.page_id): r.lang for r in language_id.identify(docs, pages).collect()}
    assert found[99, None] == "de" and found[None, 100] == "de" and found[0, None] == "en" and (None, 101) in found
    assert all(r.lang is None for r in language_id.identify(docs.limit(0), pages).collect())


def brute_languages(docs, pages):
    """Every posterior by its definition."""
    logs = collections.defaultdict(lambda: np.full(1 << 16, 0.5))
    for _, text, lang, _ in docs:
        if lang and text and (found := re.match(r"([a-z]{2,3})([-_].*)?$", lang.strip().lower())):
            np.add.at(logs[found[1]], language_id.trigram_bins(text), 1)
    names = sorted(logs)
    model = np.stack([np.log(logs[x] / logs[x].sum()) for x in names], axis=1).astype(np.float32)
    rows = [(("document", i), "", "", "source", f"source:{s or ''}", t or "") for i, t, _, s in docs]
    for i, url, html in pages:
        host = re.match(r"\w+://([^/]+)", url or "")
        host = host[1] if host else ""
        lang = re.search(r'<html lang="(\w+)"', html or "")
        rows.append((("page", i), lang[1] if lang else "", host.split(".")[-1] + "/", ".".join(host.split(".")[-2:]), host, language_id.plain(html)))
    text = []
    for *_, t in rows:
        x = model[language_id.trigram_bins(t)].sum(axis=0, dtype=np.float64) / 6
        text.append(np.maximum(x - x.max(), -60))
    share = [np.exp(x) / np.exp(x).sum() for x in text]
    add = lambda k: {v: sum((p for r, p in zip(rows, share) if r[k] == v), np.zeros(len(names))) for v in {r[k] for r in rows}}
    declared, suffix, domain, host = map(add, (1, 2, 3, 4))
    prior = (sum(share) + 1) / (len(rows) + len(names))
    out = {}
    for r, x in zip(rows, text):
        above = (domain[r[3]] + 20 * prior) / (domain[r[3]].sum() + 20)
        x = x + np.log((host[r[4]] + 5 * above) / (host[r[4]].sum() + 5))
        for k, sums in ((1, declared), (2, suffix)):
            if r[k]:
                seen = [v for v in sums if v]
                x = x + np.log((sums[r[k]] + 0.5) / (sum(sums[v] for v in seen) + 0.5 * (len(seen) + 1)))
        p = np.exp(x - x.max())
        out[r[0]] = (names[int(p.argmax())], p.max() / p.sum())
    return out


def test_languages_against_every_posterior(spark):
    rng = random.Random(17)
    stock = {x: [f"{x}{rng.randrange(60)}" for _ in range(50)] for x in ("en", "de", "fr", "nl", "da")}
    say = lambda x, n: " ".join(rng.choice(stock[x]) for _ in range(n))
    docs = [(i, say(x, rng.randrange(0, 30)), rng.choice([x, x.upper() + "-XX"]), rng.choice("st")) for i, x in enumerate(["en", "de", "fr", "nl", "da"] * 8)]
    docs += [(100, None, "en", "s"), (101, say("de", 4000), None, None), (102, "", "??", "t"), (5, docs[5][1], docs[5][2], docs[5][3])]
    pages = [(i, f"http://a{i % 3}.{x}.{'org' if i % 2 else x}/", f'<html lang="{x}"><p>{say(x, rng.randrange(0, 12))}</p>') for i, x in enumerate(["en", "de", "fr"] * 6)]
    pages += [(90, "http://a0.en.org/", None), (91, None, f"<p>{say('fr', 9)}")]
    wanted = brute_languages(docs, pages)
    doc_rows = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, lang string, source string, host string, confidence double")
    page_rows = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, lang string, rows int")
    found = language_id.identify(doc_rows, page_rows).collect()
    assert len(found) == len(docs) + len(pages)
    for r in found:
        lang, sure = wanted[r.kind, r.doc_id if r.kind == "document" else r.page_id]
        assert r.lang == lang and abs(r.confidence - sure) < 1e-4


def test_many_languages_are_all_modelled(spark):
    codes = ["".join(x) for x in itertools.islice(itertools.product("abcdefghijklm", repeat=2), 90)]
    docs = spark.createDataFrame([(i, f"{c}{c}{c} word{c} {c}x{c} " * 6, c, "s") for i, c in enumerate(codes)], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    found = {r.doc_id: r.text_lang for r in language_id.identify(docs, pages).collect()}
    assert [found[i] for i in range(90)] == codes
    assert language_id.bins_for(256) == 1 << 16 and language_id.bins_for(257) == 1 << 15


# --- pipeline -------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = kept
        kept = stage(spark, before, SF)
        assert kept.columns == docs.columns
        assert kept.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    ids = {r.doc_id for r in kept.collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == ids and all(r.round_trip for r in out)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert len(good & ids) <= 0.2 * max(1, len(good))


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, grp string, set_key string"


def odd_documents(spark):
    rng = random.Random(31)
    prose = sentence(rng, 80)
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, prose), (5, prose), (5, prose), (None, prose), (None, None), (6, sentence(rng, 25000, 90000)), (7, "x" * 300_000), (8, "a " * 30_000)]
    return spark.createDataFrame([(i, t, None if n % 3 else "en", None if n % 2 else "s", None, 0.5, False, "g", "k") for n, (i, t) in enumerate(texts)], ODD_SCHEMA)


@pytest.mark.parametrize("number", range(5))
def test_pipeline_stages_of_odd_rows(spark, number):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[number]
    docs = odd_documents(spark)
    out = stage(spark, docs, SF)
    rows = out.collect()
    if number < 4:
        assert out.columns == docs.columns and len(rows) <= docs.count()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
    else:
        assert len(rows) == docs.count() and all(r.round_trip for r in rows)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_odd_documents_in_every_operator(spark):
    docs = odd_documents(spark)
    many = docs.count()
    assert sharding.shard_documents(docs, 3).count() == many
    assert near_dup.near_duplicates(docs).count() == many
    assert katz.score_texts(docs).count() == many
    assert quality_rules.judge(docs).count() == many
    assert len({(r.doc_id, r.text_lang) for r in language_id.identify(docs, spark.createDataFrame([], "page_id long, url string, html string")).collect()}) > 1


def test_repeated_labelled_ids_train_one_text(spark):
    docs = documents(spark, [(3, "b good words"), (3, "a good words"), (4, "### $$$"), (4, None)])
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (9, None)], "doc_id long, quality int")
    scores = [sorted((r.doc_id, r.score) for r in byte_cnn.score_documents(docs, byte_cnn.train(docs.repartition(n), labels)).collect()) for n in (1, 4)]
    assert scores[0] == scores[1] and len(scores[0]) == 4


def test_equal_addresses_and_repeated_pages(spark):
    line = "all the very same words stand in this line of text"
    page = f"<body><p>{line}</p><p>own {{}} words here</p></body>"
    rows = [(1, "http://a.b/x", page.format(1)), (1, "http://a.b/x", page.format(1)), (2, "http://a.b/x", page.format(2)), (3, None, page.format(3)), (4, "http://c.d/", "<p>" + "long " * 60_000)]
    found = sorted((r.page_id, r.text) for r in html_main_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert found[:4] == [(1, "own 1 words here"), (1, "own 1 words here"), (2, "own 2 words here"), (3, f"{line}\nown 3 words here")] and len(found[4][1]) == 299_999


def test_ties_of_windows_take_the_first(spark):
    item = " ".join(f"t{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    docs = documents(spark, [(1, f"{item} between {item}"), (1, f"{item} between {item}"), (2, None)])
    assert sorted((r.doc_id, r.item_id, r.start_word, r.similarity) for r in decontaminate.leaks(docs, bench).collect()) == [(1, 1, 0, 1.0), (1, 2, 0, 1.0)]

