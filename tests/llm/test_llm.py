import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintang import session
from lintang.llm import consensus, cross_split, defects, encoding, leakage, near_duplicates, residue, scanned, setjoin, token_ids

WORD = re.compile(r"[^\W_]+")


def variations(seed, count):
    rng = random.Random(seed)
    vocabulary = [f"kata{i}" for i in range(60)]
    base = [rng.sample(vocabulary, 20) for _ in range(8)]
    out = []
    for _ in range(count):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rng.shuffle(words)
        out.append(" ".join(words))
    return out + [out[0], None, "", "pendek saja", out[0].upper() + "!"]


def jaccard(a, b):
    x, y = (set(WORD.findall((t or "").lower())) for t in (a, b))
    return len(x & y) / len(x | y) if min(len(x), len(y)) >= 12 else 0.0


def test_near_duplicates_match_brute_force(spark):
    texts = variations(1, 80)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("hashes", F.lit("clash")).withColumn("rep", F.lit(0))
    true = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j]) >= 0.75}
    found = near_duplicates.near_duplicate_pairs(df, "id", "t", 0.75, 12)
    got = [(r["id_a"], r["id_b"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == true
    assert near_duplicates.near_duplicate_pairs(df.limit(0), "id", "t").count() == 0


def test_large_class_is_expanded_in_chunks(spark):
    df = spark.range(1100).withColumn("t", F.lit(" ".join(f"w{i}" for i in range(15))))
    assert near_duplicates.near_duplicate_pairs(df, "id", "t", 0.75, 12).count() == 1100 * 1099 // 2


def test_cross_split_matches_brute_force(spark):
    a, b = variations(2, 60), variations(2, 40)[::-1]
    left = spark.createDataFrame(list(enumerate(a)), "x long, t string")
    right = spark.createDataFrame(list(enumerate(b)), "y long, u string")
    true = {(i, j) for i in range(len(a)) for j in range(len(b)) if jaccard(a[i], b[j]) >= 0.75}
    found = cross_split.cross_split_overlaps(left, right, "x", "y", F.col("t"), F.col("u"), 0.75, 12)
    got = [(r["id_a"], r["id_b"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == true
    assert cross_split.cross_split_overlaps(left, right.limit(0), "x", "y", F.col("t"), F.col("u"), 0.75, 12).count() == 0


def short_texts(seed, count):
    rng = random.Random(seed)
    base = [rng.sample([f"w{i}" for i in range(30)], rng.randrange(1, 14)) for _ in range(12)]
    return [" ".join(w for w in rng.choice(base) + rng.sample(["x", "y", "w1", "w2", "w3"], rng.randrange(3)) if rng.random() < 0.93) for _ in range(count)]


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.9])
def test_cross_split_of_short_texts(spark, monkeypatch, threshold):
    monkeypatch.setattr(cross_split, "RARE", 4)
    a, b = short_texts(5, 120), short_texts(6, 90)
    left = spark.createDataFrame(list(enumerate(a)), "x long, t string")
    right = spark.createDataFrame(list(enumerate(b)), "y long, u string")
    sets = lambda t: set(WORD.findall(t.lower()))
    true = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if sets(p) and sets(q) and len(sets(p) & sets(q)) >= threshold * len(sets(p) | sets(q))}
    got = [(r["id_a"], r["id_b"]) for r in cross_split.cross_split_overlaps(left, right, "x", "y", F.col("t"), F.col("u"), threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == true


def test_weighted_cosine_join_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cross_split, "RARE", 6)
    words = lambda prefix, seed: spark.createDataFrame(list(enumerate(variations(seed, 70) + short_texts(seed, 40))), f"{prefix} long, t string")
    left, right = (setjoin.set_classes(setjoin.word_sets(words("id", seed), "id", F.col("t"), 1)) for seed in (7, 8))
    counts = cross_split.document_counts(left.unionByName(right))
    squares = cross_split.squared_weights(counts)
    assert squares.min() >= 1 and squares.max() <= cross_split.SPREAD and len(set(squares.round(6))) > 5
    rows = [[(r["rep"], np.array(r["hashes"], dtype=np.int64)) for r in side.collect()] for side in (left, right)]
    mass = lambda h: squares[cross_split.buckets_of(h)].sum()
    cosine = {(a, b): mass(np.intersect1d(x, y)) / np.sqrt(mass(x) * mass(y)) for a, x in rows[0] for b, y in rows[1] if len(np.intersect1d(x, y))}
    for options in ({}, {"tile": 5, "sampled": 1}):  # the second cuts nearly every list into tiles
        found = {(r["a"], r["b"]): r["cosine"] for r in cross_split.cosine_join_pairs(left, right, 0.7, **options).collect()}
        assert set(found) == {k for k, c in cosine.items() if c >= 0.7 - 1e-9} and all(abs(found[k] - cosine[k]) < 1e-9 for k in found)


def test_candidates_of_a_jaccard_join_pass_the_sketches(spark, monkeypatch):
    # ten words in common of eighteen a side: their similarity is 0.38, which the sketches tell before a word set is sent
    common = [f"k{i}" for i in range(10)]
    table = lambda side: setjoin.set_classes(setjoin.word_sets(spark.createDataFrame([(i, " ".join(common + [f"{side}{i}x{k}" for k in range(8)])) for i in range(30)], "id long, t string"), "id", F.col("t"), 1))
    met = []
    monkeypatch.setattr(cross_split, "with_sets", lambda pairs, a, b: met.append(pairs.count()) or setjoin.with_sets(pairs, a, b))
    assert cross_split.cosine_join_pairs(table("a"), table("b"), 0.3).count() == met[0] == 900
    assert cross_split.cosine_join_pairs(table("a"), table("b"), 0.3, 0.75).count() == met[1] == 0


def test_rows_of_long_texts_grow_with_their_length():
    rng, counts = np.random.default_rng(1), np.zeros(1 << cross_split.BUCKETS)
    common = rng.integers(-(2**63), 2**63, 300)
    counts[cross_split.buckets_of(common)] = 10_000
    squares = cross_split.squared_weights(counts)
    sizes = {n: len(cross_split.heads_of(np.concatenate((common, rng.integers(-(2**63), 2**63, n - 300))), counts, squares, 0.75, 4)[0]) for n in (1000, 20_000)}
    assert sizes[1000] < 1000 and sizes[20_000] < 20_000


def test_long_bands_are_compared_in_tiles(spark):
    texts = variations(9, 90)
    classes = setjoin.set_classes(setjoin.word_sets(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", F.col("t"), 12))
    pairs = lambda **o: {(r["a"], r["b"]) for r in near_duplicates.candidate_pairs(classes, 0.75, near_duplicates.SketchParameters(), **o).collect()}
    assert pairs() and pairs() == pairs(tile=4, sampled=1)


def test_passes_of_bands_find_the_same_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SMALL", 0)
    classes = setjoin.set_classes(setjoin.word_sets(spark.createDataFrame(list(enumerate(variations(9, 90))), "id long, t string"), "id", F.col("t"), 12))
    pairs = lambda n: {(r["a"], r["b"]) for r in near_duplicates.candidate_pairs(classes, 0.75, near_duplicates.SketchParameters(at_once=n)).collect()}
    assert pairs(30) and pairs(30) == pairs(11)


def test_sketches_drop_no_pair_of_the_threshold():
    rng = np.random.default_rng(6)
    for n in (5, 30, 400, 3000):
        a = rng.integers(-(2**63), 2**63, n)
        for kept in range(0, n + 1, max(1, n // 8)):
            b = np.concatenate((a[:kept], rng.integers(-(2**63), 2**63, n - kept)))
            x, y = setjoin.odd_sketches([a, b], 4)
            assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= 2 * (n - kept)


def test_tables_that_were_stored_leave_no_shuffle_files(spark):
    sc = spark.sparkContext
    files = lambda: {f.getName() for f in map(manager.getAllFiles().apply, range(manager.getAllFiles().size())) if f.getName().startswith("shuffle_")}
    manager = sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, setting = files(), spark.conf.get(session.CLEANUP, None)
    rows = spark.range(1000).withColumn("t", F.concat_ws(" ", *[F.format_string(f"k{i}x%d", F.col("id") % 9) for i in range(14)]))
    keys, classes = setjoin.stored_classes(setjoin.word_sets(rows, "id", F.col("t"), 12))
    for _ in range(50):
        time.sleep(0.1)
        left = [f for f in files() - before if f.endswith(".data")]
        if not left:
            break
    assert not left
    assert keys.count() == 1000 and classes.count() == 9 and keys.columns == ["id", "key"] and spark.conf.get(session.CLEANUP, None) == setting


def test_membership_of_classes(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(15))) for i in range(70)] + [(100, " ".join(f"w{k}" for k in range(16))), (200, " ".join(f"v{k}" for k in range(15))), (300, None), (400, "")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("key", F.lit("clash"))
    got = {r["id"]: (r["rep"], r["members"], r["links"]) for r in near_duplicates.near_duplicate_membership(df, "id", "t", 0.8, 12).collect()}
    assert got == {i: (0, 70, 1) for i in range(70)} | {100: (100, 1, 1), 200: (200, 1, 0)}


def test_cross_split_of_one_word_texts(spark):
    left = spark.createDataFrame([(1, "Satu"), (2, "dua tiga"), (3, None), (4, "lima")], "x long, t string")
    right = spark.createDataFrame([(10, "satu!"), (11, "tiga"), (12, ""), (13, "enam"), (14, "dua, tiga")], "y long, u string")
    pairs = lambda t: {(r["id_a"], r["id_b"]) for r in cross_split.cross_split_overlaps(left, right, "x", "y", F.col("t"), F.col("u"), t).collect()}
    assert pairs(0.8) == {(1, 10), (2, 14)} and pairs(0.5) == {(1, 10), (2, 11), (2, 14)}


def test_survivors(spark):
    rows = [
        (1, "Berapa 2+2?", "Jumlahkan. Jadi 4.", "4", 2, "2024-01-01"), (2, "berapa $2+2$", "Jumlahkan…", "tidak ada", 5, None),
        (3, "Berapa 2+2", None, "empat", 2, "2024-02-01"), (4, "lain", "x", "y", 1, None), (5, None, "x", "y", 1, None), (6, " ", "x", "y", 1, None),
        (7, "Sama.", " ", "-", None, None), (8, "sama", "", "N/A", None, None),
    ]
    df = spark.createDataFrame(rows, "id long, q string, steps string, ans string, trust int, seen string").withColumn("field", F.lit("clash"))
    out = consensus.survivors(df, "id", "q", ["q", "steps", "ans"], F.col("trust"), F.col("seen").cast("timestamp"), ["steps"])
    got = {(r["group"], r["field"]): r["id"] for r in out.collect()}
    assert got == {(1, "q"): 2, (1, "steps"): 1, (1, "ans"): 3, (7, "q"): 7}
    assert consensus.survivors(df.limit(0), "id", "q", ["ans"], F.col("trust"), F.col("seen").cast("timestamp")).count() == 0


def test_consensus_of_equal_records(spark):
    rows = [(1, "Satu soal?", "a b x d", 5), (2, "satu soal", "a b c d", 1), (3, "Satu soal.", "a b c d e", 1), (4, "satu  soal", "q b c d", 1), (5, "dua", "z", 1), (6, "Dua!", None, 1)]
    df = spark.createDataFrame(rows, "id long, q string, v string, trust int").withColumn("seen", F.lit(None).cast("timestamp"))
    chosen = lambda weights: {(r["group"], r["id"]) for r in consensus.survivors(df, "id", "q", ["v"], F.col("trust"), F.col("seen"), weights=weights).collect()}
    assert chosen("rank") == {(1, 1), (5, 5)} and chosen("equal") == {(1, 2), (5, 5)}
    rng = random.Random(4)
    for _ in range(60):  # equal votes against brute force: the value with the fewest edits to all others' common tokens
        base = [f"t{i}" for i in range(8)]
        values = [" ".join(t if rng.random() < 0.9 else f"u{rng.randrange(50)}" for t in base) for _ in range(7)]
        columns = [max(set(c), key=c.count) for c in zip(*(v.split() for v in values))]
        if columns != base or any([v.split()[i] for v in values].count(t) < 4 for i, t in enumerate(base)):
            continue
        wrong = [sum(a != b for a, b in zip(v.split(), base)) for v in values]
        assert wrong[consensus.consensus_choice(values, [1] * 7)] == min(wrong)


def test_ranked_survivors_need_no_alignment(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, f"soal {i % 5}", f"nilai {rng.randrange(30)} {rng.randrange(3)}", rng.randrange(3), rng.choice([None, "2024-01-01", "2024-02-01"])) for i in range(200)]
    best = {}
    for i, q, v, trust, seen in rows:
        best[q] = max(best.get(q, ()), (trust, seen or "", -i))
    monkeypatch.setattr(consensus.F, "pandas_udf", lambda *_: pytest.fail("an alignment that decides nothing"))
    df = spark.createDataFrame(rows, "id long, q string, v string, trust int, seen string")
    out = consensus.survivors(df, "id", "q", ["v"], F.col("trust"), F.col("seen").cast("timestamp")).collect()
    assert {r["id"] for r in out} == {-b[2] for b in best.values()}


def test_hot_group_is_spread(spark):
    df = spark.range(3000).withColumn("q", F.when(F.col("id") % 3 < 2, F.lit("panas")).otherwise(F.concat(F.lit("dingin "), F.col("id").cast("string"))))
    out = consensus.survivors(df, "id", "q", ["q"], F.lit(1), F.lit(None).cast("timestamp")).collect()
    assert [(r["group"], r["id"], r["copies"]) for r in out] == [(0, 0, 2000)]


def test_consensus_of_a_large_group(spark):
    df = spark.range(1000).withColumn("q", F.lit("satu soal")).withColumn("v", F.concat(F.lit("nilai "), F.col("id").cast("string")))
    out = consensus.survivors(df, "id", "q", ["v"], F.when(F.col("id") == 777, 5).otherwise(1), F.lit(None).cast("timestamp")).collect()
    assert [r["id"] for r in out] == [777]
    assert consensus.consensus_choice(["a b c", "a x c", "a b d"], [1, 1, 1]) == 0


@pytest.mark.parametrize(
    "garbled,original",
    [("Ã—", "×"), ("Ã¢â‚¬Å“", "“"), ("┬░", "°"), ("‚àö", "√"), ("Г—", "×"), ("â‰ˆ", "≈"), ("ÃƒÂ©", "é"), ("â\x80\x93", "–"), ("&eacute;", "é"), ("Ã¢â\x82¬â\x84¢", "’"), ("ГўВЂВњ", "“"), ("â†’ â‰¥", "→ ≥")],
)
def test_encoding_restores(garbled, original):
    assert encoding.Restorer().text(f"a {garbled} b") == (f"a {original} b", True)


def test_encoding_keeps_genuine_signs(spark):
    for text in ("Kafé naïve façade", "Müllena 4 Å", "Huruf Я dan Г", "Garis ║ dan ╬", "Variabel Ã", "â dan ê", "São Ångmar", "π ≈ 22/7, ±3, 2 × 3 …", "", None, "%d & x"):
        assert encoding.Restorer().text(text) == (text, False), text
    assert encoding.Restorer().text("44�C")[1]
    df = spark.createDataFrame([(1, "5 Â° C", None), (2, "5 ° C", "")], "id long, a string, b string")
    assert [(r["id"], r["field"], r["restored"]) for r in encoding.restored_fields(df, "id", ["a", "b"]).collect()] == [(1, "a", "5 ° C")]


def test_rows_of_plain_ascii_with_escapes_are_searched(spark):
    garbled = ["caf\\u00e9 baru", "caf%c3%a9", "caf=C3=A9", "&frac12; gelas", "&#128512; ya", "&#x1F600; ya", "caf%C3%A9"]
    plain = ["biasa saja", "50%ab", "a=89 b", "\\underline{x}", "x & y", "&bukan; entitas", "n=12", "x=ca=ab"]
    df = spark.createDataFrame(list(enumerate(garbled + plain)), "id long, a string")
    got = {r["id"]: r["restored"] for r in encoding.restored_fields(df, "id", ["a"]).collect()}
    assert list(map(got.get, range(7))) == ["café baru", "café", "café", "½ gelas", "😀 ya", "😀 ya", "café"] and len(got) == 7


def test_token_ids(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["", None, " ", "Halo dunia, 12345 apel!\n\n  x", "🙂👍🏽 ﬁgur é 数学", "<|endoftext|> a", "a" * 5000, "'s don't  I'll"]
    texts += ["".join(chr(rng.choice((32, 97, 101, 233, 0x4E2D, 10, 48, 0x1F600)) + rng.randrange(3)) for _ in range(60)) for _ in range(40)]
    texts += ["".join(rng.choices("ab'sd 1.\n\t\r\x0b\x0c\x1c\x1f\x00_-", k=80)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in token_ids.token_ids(df, "doc_id", "text").collect()}
    for i, text in enumerate(texts):
        assert got[i] == (reference.encode(text, add_special_tokens=False).ids if text else []), text


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)
    words = [f"k{i}" for i in range(300)]
    items = [" ".join(rng.choices(words, k=rng.randrange(8, 40))) for _ in range(15)] + [None, ""]
    documents = []
    for _ in range(60):
        text = rng.choices([*words, "lain", "dan"], k=50)
        source = WORD.findall(rng.choice(items[:15]))
        at, size = rng.randrange(len(source)), rng.choice((5, 11, 12, 13, 30))
        text[10:10] = source[at : at + size]
        documents.append(" -- ".join(text).upper() if rng.random() < 0.3 else " ".join(text))
    documents += [None, "", "satu"]
    runs = lambda t: {tuple(w[k : k + 12]) for w in [WORD.findall((t or "").lower())] for k in range(len(w) - 11)}
    true = {(i, j) for i, a in enumerate(items) for j, b in enumerate(documents) if runs(a) & runs(b)}
    d = spark.createDataFrame(list(enumerate(documents)), "doc_id long, text string")
    q = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["item_id"], r["doc_id"]) for r in leakage.leaks(d, q, "doc_id", "text", "item_id", "text").where("run >= 12").collect()}
    assert true and got == true
    assert leakage.leaks(d, q.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_paraphrased_items_are_found(spark):
    rng = random.Random(8)
    words = [f"k{i}" for i in range(400)]
    items = [" ".join(rng.sample(words, 25) + [str(rng.randrange(100, 999)), str(rng.randrange(100, 999))]) for _ in range(12)]
    documents, true = [], set()
    for j in range(40):
        text = rng.choices([*words, "lain", "dan"], k=40)
        if j % 2:
            k = j % 12
            kept = [w if rng.random() < 0.8 or w.isdigit() else f"ganti{rng.randrange(99)}" for w in items[k].split()]
            text[20:20] = kept
            true.add((k, j))
        documents.append(" ".join(text))
    d = spark.createDataFrame(list(enumerate([*documents, None, ""])), "doc_id long, text string").withColumn("hashes", F.lit("clash"))
    q = spark.createDataFrame(list(enumerate([*items, None])), "item_id long, text string")
    found = leakage.paraphrases(d, q, "doc_id", "text", "item_id", "text").collect()
    assert {(r["item_id"], r["doc_id"]) for r in found} == true and all(r["answer_share"] == 1.0 for r in found)
    assert leakage.paraphrases(d.limit(0), q, "doc_id", "text", "item_id", "text").count() == 0


def test_cluster_index_loses_nothing():
    rng = np.random.default_rng(2)
    centres = leakage.unit(rng.standard_normal((30, 16)))
    near = lambda n: leakage.unit(centres[rng.integers(0, 30, n)] + 0.15 * rng.standard_normal((n, 16)))
    held, asked = near(500), near(300)
    i, j, _ = leakage.ClusterIndex(held, 12).search(asked, 0.9)
    assert set(zip(i, j)) == set(zip(*np.nonzero(asked @ held.T >= 0.9))) and len(i) > 50


def test_leak_across_the_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(leakage, "PIECE", 50)
    words = [f"k{i}" for i in range(60)]
    rng = random.Random(3)
    item = " ".join(rng.sample(words, 20))
    texts = [" ".join([*rng.choices(words, k=n), item, *rng.choices(words, k=70)]) for n in range(30, 60, 3)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r["doc_id"]: r["run"] for r in leakage.leaks(d, q, "doc_id", "text", "item_id", "text").collect()}
    assert set(found) == set(range(10)) and min(found.values()) >= 20


def test_pair_defects(spark):
    docs = [(f"Kita menghitung nilai persamaan dengan langkah yang benar untuk soal nomor {i} di sekolah.", "id") for i in range(60)]
    docs += [(f"We compute the value of the equation with the right step for exercise number {i} in school.", "en") for i in range(60)]
    labelled = spark.createDataFrame(docs, "text string, lang string")
    good = [("chatml", i, "Berapa nilai dari soal nomor satu?", f"Kita menghitung nilai persamaan. Jadi {i} + 1 = {i}. Maka \\boxed{{{i}}}.") for i in range(300)]
    bad = {
        1000: ("Berapa?", None), 1001: ("Berapa?", "<think>\n</think> "), 1002: ("Berapa?", "$$ $$"), 1003: ("Berapa?", "Maaf, saya tidak bisa menjawab."),
        1004: ("Berapa nilai dari soal nomor satu?", "Soal: berapa nilai dari soal nomor satu"), 1005: ("Berapa?", "Kita menghitung nilai. Jadi \\boxed{4"),
        1006: ("Berapa nilai dari soal nomor satu?", "We compute the value of the equation with the right step. So \\boxed{4}."), 1007: (None, "\\boxed{}"),
    }
    rows = good + [("chatml", k, *v) for k, v in bad.items()] + [("chatml", 2000, "Berapa?", "42"), ("chatml", 2001, "Berapa?", "\\boxed{{3}}")]
    pairs = spark.createDataFrame(rows, "tbl string, row_id long, prompt string, answer string")
    model = defects.pair_model(pairs, labelled, "text", "lang")
    got = {r["row_id"]: r["defect"] for r in defects.defective_pairs(pairs, model).collect()}
    assert got == {1000: "empty", 1001: "empty", 1002: "empty", 1003: "refusal", 1004: "copy", 1005: "truncated", 1006: "language", 1007: "empty"}


def test_long_copies_and_short_languages():
    asked = " ".join(f"kata{i}" for i in range(200))
    assert defects.is_copy(asked, f"{asked} {' '.join(f'baru{i}' for i in range(30))}") and not defects.is_copy(asked, f"kata1 {' '.join(f'baru{i}' for i in range(30))}")
    texts = {"id": "kita menghitung nilai persamaan dengan langkah yang benar " * 20, "en": "we compute the value of the equation with the right steps " * 20}
    model = defects.PairModel({n: defects.LanguageModel([t]) for n, t in texts.items()}, -9.0, "id", {}, {}, 0, 0)
    assert model.defect("Kita menghitung nilai persamaan yang benar?", "The equation is right.") == "language"


def test_refusals_of_any_length(spark):
    plain = defects.PairModel({}, 0.0, "", {}, {}, 0, 0)
    polite = "Terima kasih atas pertanyaan yang menarik ini, semoga hari ini menyenangkan. " * 6
    refusal = "Maaf, saya tidak dapat menjawab soal ini."
    assert plain.defect("Berapa x = 3 ditambah dua?", polite + refusal) == "refusal"
    assert plain.defect("Berapa x = 3 ditambah dua?", f"{refusal} Diketahui x = 3. {polite}") == "refusal"
    assert plain.defect("Berapa?", f"{polite}Jawaban tidak boleh negatif, jadi 2 + 3 = 5. {polite}") is None
    assert plain.defect("Berapa?", f"{polite}{refusal} Jadi \\boxed{{5}}.") is None


def test_labelled_texts_are_read_whole(spark):
    labelled = spark.createDataFrame([("kata biasa " * 300 + "zqzq", "id")], "text string, lang string")
    assert defects.language_model(labelled, "text", "lang", {})[0]["id"].counts["zqz"] == 1


def test_language_model_counts_all_rows(spark, monkeypatch):
    monkeypatch.setattr(defects, "MOST_WORDS", 40)
    said = {"id": "kita menghitung nilai persamaan dengan langkah yang benar untuk nomor", "en": "we compute the value of the equation with the right steps for number"}
    texts = [(f"{said[lang]} {chr(97 + i % 26)}q{chr(97 + i // 26 % 26)}", lang) for i in range(2600) for lang in said]
    labelled = spark.createDataFrame(texts, "text string, lang string")
    whole = {n: defects.LanguageModel([t for t, lang in texts if lang == n]) for n in said}
    models, floor, major = defects.language_model(labelled, "text", "lang", {})
    assert {n: m.counts for n, m in models.items()} == {n: m.counts for n, m in whole.items()} and major == "en"
    reached = sorted(defects.best_language(whole, t)[2] for t, _ in texts)
    assert floor == pytest.approx(reached[len(texts) // 500] - 0.4)
    asked = [f"{said['id']} {chr(97 + i % 26)}" for i in range(6100)]
    pairs = [(p, "然后计算每一部分的数值再把它们相加" if i % 100 == 0 else said["id"]) for i, p in enumerate(asked)]
    models, floor, _ = defects.language_model(labelled, "text", "lang", {}, spark.createDataFrame(pairs, "prompt string, answer string"))
    lines = [line for p, a in pairs for line in (p, a) if line.isascii()]  # answers in a language without labels teach nothing
    both = {"id": defects.LanguageModel([t for t, lang in texts if lang == "id"] + lines), "en": whole["en"]}
    assert {n: m.counts for n, m in models.items()} == {n: m.counts for n, m in both.items()}
    reached = sorted(defects.best_language(both, t)[2] for t in lines)
    assert floor == pytest.approx(reached[len(lines) // 500] - 0.4)


def test_scanned_pages(spark):
    clean = ["Ibu membeli majalah di toko dengan harga murah dan menyimpan buku di rumah." for _ in range(40)]
    pages = ["Ibu membeli majalah di\nNaskah UN 012 · Dokumen Sekolah\ntoko dengan harga murah" for _ in range(8)]
    noisy = {
        1: ("Ibu rnembeli m@jalah di toko dengan harga murah", {"misread"}), 2: ("Ibu mem-\nbeli majalah di toko", {"hyphen"}),
        3: ("Ibu membeli buku-\nbuku di toko", set()), 4: ("Ibu membeli\n12\nmajalah di toko", {"pageno"}), 5: ("Perhatikan data berikut.\n12\n13\n14\nIbu membeli majalah", set()),
        6: ("Ibu membeli majalah\nNaskah UN 013 · Dokumen Sekolah\ndi toko\n– 7 –", {"header", "pageno"}), 7: ("Zat H2O dengan x1 = 3 di toko", set()), 8: (None, set()), 9: (" ", set()),
    }
    texts = spark.createDataFrame([(t,) for t in clean + pages], "text string")
    df = spark.createDataFrame([(k, v[0]) for k, v in noisy.items()], "id long, t string").withColumn("headers", F.lit("clash"))
    for most in (None, 4):  # with a small lexicon in memory the other words are looked up
        model = scanned.page_model(texts, most)
        assert (model.others is None) == (most is None)
        got = {r["id"]: (set(r["noise"]), r["repaired"]) for r in scanned.scan_noise(df, "id", F.col("t"), model).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[1] for k, v in noisy.items() if v[1]}
    assert got[1][1] == "Ibu membeli majalah di toko dengan harga murah" and got[2][1] == "Ibu membeli majalah di toko"


def test_pairs_beyond_the_model_are_looked_up(spark):
    # the pairs decide between two frequent words, whichever of them the model holds
    lines = ["ibu makan nasi hari ini", "ibu masak nasi hari ini", "dia bantu teman hari ini", "batu besar di sana", "satu buah batu besar"]
    texts = spark.createDataFrame([(lines[k % 5],) for k in range(600)], "text string")
    pages = spark.createDataFrame(list(enumerate(["ibu rnakan nasi", "satu buah b@tu besar", "dia b@ntu teman"])), "id long, t string")
    whole = scanned.page_model(texts)
    cut = scanned.page_model(texts, most_pairs=2)
    assert whole.more is None and len(cut.pairs) <= 2 and cut.more.count() == len(whole.pairs) - len(cut.pairs)
    assert cut.behind == whole.behind and cut.after_rare == whole.after_rare
    read = lambda m: sorted((r["id"], r["repaired"]) for r in scanned.scan_noise(pages, "id", F.col("t"), m).collect())
    assert read(cut) == read(whole) == [(0, "ibu makan nasi"), (1, "satu buah batu besar"), (2, "dia bantu teman")]


def test_confusions_are_estimated():
    words = {"rumah": 1000, "r0mah": 3, "rum@h": 40, "malam": 900, "rnalam": 30, "buku": 500}
    model = scanned.PageModel(dict(words), {}, 3000, None).finish()
    assert set(model.words) == {"rumah", "malam", "buku", "r0mah"}
    assert model.confusions["a", "@"] > model.confusions["a", "ä"] and model.confusions["m", "rn"] > model.confusions["t", "7"]
    assert scanned.variants("m@j@l@h", 3, model.confusions)["majalah"] == pytest.approx(3 * model.confusions["a", "@"])


def test_headers_of_small_source_files(spark):
    words = [f"{a}{b}" for a in ("meja", "buku", "roti", "gula", "kuda") for b in ("lah", "nya", "kan", "mu")]
    line = lambda k: f"{words[k % 20]} {words[(3 * k + 1) % 20]} dan {words[(7 * k + 2) % 20]} itu"
    page = lambda k, head: f"{line(k)}\n{head}\n{line(k + 50)}"
    rows = [(page(k, f"Arsip Kecil {k % 4} - Kota Lama"), f"kecil_{k % 4}") for k in range(4)] + [(page(k + 9, "Berkas Sempit Desa Jauh"), "sempit") for k in range(2)]
    rows += [(page(30, "Kalimat biasa dalam salinan"), "salinan")] * 2 + [(page(k + 40, "Baris yang sering ada"), "lain") for k in range(2)]
    rows += [(f"lalu baris yang sering ada {line(k)}", "lain") for k in range(9)] + [(None, None), ("", "x")]
    texts = spark.createDataFrame(rows, "text string, file string")

    def headed(texts, pages):
        df = spark.createDataFrame(list(enumerate(pages)), "id long, t string")
        found = scanned.scan_noise(df, "id", F.col("t"), scanned.page_model(texts)).collect()
        return {r["id"] for r in found if "header" in r["noise"]}

    # a header on two pages of its file; lines of one page a file, of copies, or also inside running text are none
    assert headed(texts, [rows[4][0], rows[0][0], rows[6][0], rows[8][0]]) == {0}
    numbered = spark.createDataFrame([(page(k, f"Arsip Kecil {k} - Kota Lama | {k + 7}"), f"kecil_{k}") for k in range(2)], "text string, file string")
    assert headed(numbered, [page(5, "Arsip Kecil 5 - Kota Lama"), page(6, "Arsip Besar 5 - Kota Lama")]) == {0}


def residue_corpus():
    subjects, verbs = ["luas", "volume", "sudut", "deret", "pecahan", "grafik"], ["menghitung", "membaca", "mencatat", "membahas"]
    good = [f"Siswa {verbs[i % 4]} {subjects[i % 6]} dengan {i} contoh. Hasilnya ditulis di buku nomor {i % 17}.\nLatihan {i} meminta kita memeriksa {subjects[(i + 3) % 6]}." for i in range(240)]
    good += [f"Program JavaScript mencetak {i} bilangan." for i in range(15)] + [f"Isilah titik-titik: {i} + ___ = 9." for i in range(15)]
    good += [f'Kata "lorem ipsum" muncul pada {i} halaman buku.' for i in range(15)]
    good += [f"Catatan kelas {i}.\n{text}" for i, text in enumerate(good[240:])]
    good += ["\n".join(good[k : k + 60]) for k in range(0, 100, 5)]
    bad = ["Halaman tidak ditemukan\nSila pilih menu lain di bawah ini", "Aktifkan JavaScript di peramban Anda", "Materi {{ judul }} dimulai", "Lorem ipsum dolor sit amet", "Catatan [ISI JUDUL DI SINI] tetap"]
    return good, [t for n in range(6) for k, line in enumerate(bad) for t in (line, f"{line}\n{good[5 * n + k]}")]


def test_residue(spark):
    good, bad = residue_corpus()
    rows = [(i, t, f"h{i % 8}") for i, t in enumerate(good + bad)] + [(900, None, None), (901, "", None), (902, "Himpunan {{}, {1}} dan \\frac{{a}}{{b}}", None), (903, " \n ", "h1")]
    df = spark.createDataFrame(rows, "id long, text string, source string").withColumn("tokens", F.lit("clash"))
    model = residue.residue_model(df)
    got = {r["id"]: r["score"] for r in residue.residue_scores(df, "id", "text", model).collect()}
    assert {i for i, s in got.items() if s > 0} == set(range(len(good), len(good) + len(bad)))
    assert all(got[i] == float("-inf") for i in (900, 901))
    # the JVM and Python cut texts into the same tokens
    assert max(abs(a - got[i]) for i, a in enumerate(residue.scores_of(good + bad, model))) < 1e-3
    # inside a long text, and learned from the lines beside labelled ones, without a label of its own
    unlabelled = "Sila pilih menu lain di bawah ini"
    assert not re.search(residue.labels(), residue.plain(unlabelled))
    long = "\n".join(good[100:240])
    said = residue.scores_of([f"{long} Materi {{{{ judul }}}} dimulai {long}", unlabelled, long], model)
    assert said[0] > 0 and said[1] > 0 and said[2] < 0
    table = {r["labels_left_out"]: r for r in residue.validation(df).collect()}
    assert set(table) == {"even", "odd"} and all(r["recall"] == 1.0 and r["flagged_share"] == 0.0 for r in table.values())
    empty = df.limit(0)
    assert residue.residue_scores(empty, "id", "text", residue.residue_model(empty)).count() == 0
    assert residue.residue_scores(df, "id", "text", residue.residue_model(empty)).where("score > 0").count() == 0


def test_validation_counts_all_documents(spark, monkeypatch):
    for name in ("MOST_SEEN", "MOST_LABELLED", "MOST_OTHER"):
        monkeypatch.setattr(residue, name, 40)  # what a fit reads
    good, bad = residue_corpus()
    df = spark.createDataFrame([(t, f"h{i % 8}") for i, t in enumerate(good + bad)], "text string, source string")
    unseen = [r["text"] for r in df.where(F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.lit(9)), F.lit(4)) == 0).collect()]
    known = [{t for t in unseen if re.search(residue.labels(1 - k), residue.plain(t))} for k in (0, 1)]
    got = {r["labels_left_out"]: r["documents"] for r in residue.validation(df).collect()}
    assert got == {name: sum(t in known[k] and t not in known[1 - k] for t in unseen) for k, name in ((0, "even"), (1, "odd"))} and sum(got.values()) > 0


def test_signals_stand_in_all_labelled_texts(spark):
    texts = [*residue_corpus()[1], "HTTP 502 Bad Gateway", "Halo undefined!", "kata kata kata kata", "isi teks isi teks isi teks", "java.lang.StackException", "Sesi Anda berakhir", "teks contoh", "Oops, ada yang salah", "sudah dihapus", "Isi &lt;judul bab&gt; {namaSiswa}", "@Model.Judul", "biasa saja", "Kata \"lorem ipsum\""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", residue.is_labelled(residue.plain_column(F.col("t"))).alias("l"))
    pattern = re.compile(residue.labels())
    assert all(r["l"] == bool(pattern.search(residue.plain(r["t"]))) for r in df.collect())


def test_residue_on_texts_labelled_by_hand(spark):
    good, bad = residue_corpus()
    df = spark.createDataFrame([(i, t, f"h{i % 8}") for i, t in enumerate(good + bad)], "id long, text string, source string")
    model = residue.residue_model(df)
    residues = ["Please aktifkan JavaScript", "Selamat datang, {{nama}}!", "[TULIS ISI DI SINI]", "halaman tidak ditemukan", "lorem ipsum dolor sit amet, consectetur"]
    sound = ["Kata \"lorem ipsum\" terdiri dari dua kata.", "Program JavaScript mencetak 7 bilangan.", "Isilah titik-titik: 4 + ___ = 9.", "Jika $\\frac{{a}}{{b}} = 2$ maka a = 2b.", "Luas kelas itu 404 meter."]
    said = residue.scores_of(residues + sound, model) > 0
    assert said.tolist() == [True] * len(residues) + [False] * len(sound)
