import random

import numpy as np
from pyspark.sql import functions as F

from lintang.operators import dedup, generate, joins, sampling, sequence, similarity
from lintang.plans import distill, quality
from lintang.sources import readers, writers
from lintang.streaming import resumable


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_most_complete(spark):
    rows = [(1, "q", "", ""), (2, "q", "a", ""), (3, "q", "a", "s"), (4, "q", "b", "t"), (5, " ", "a", "s"), (6, None, "a", "s")]
    df = spark.createDataFrame(rows, "id int, q string, a string, s string")
    assert ids(dedup.most_complete(df, "q", "a", "s", "id")) == [3]
    assert dedup.most_complete(df.limit(0), "q", "a", "s", "id").count() == 0


def test_greedy_keep_matches_a_loop(spark):
    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    kept = []
    for i in range(40):
        if not any((k, i) in edges for k in kept):
            kept.append(i)
    nodes = spark.createDataFrame([(i,) for i in range(40)], "id long")
    out = dedup.greedy_keep(nodes, spark.createDataFrame(edges, "a long, b long"))
    assert ids(out.where("kept")) == kept
    assert ids(dedup.greedy_keep(nodes, spark.createDataFrame([], "a long, b long")).where("kept")) == list(range(40))


def test_cosine_pairs_match_brute_force(spark):
    words = "anak buku kelereng pasar toko harga jumlah siswa meja kursi lampu apel".split()
    rng = random.Random(1)
    texts = [" ".join(rng.sample(words, 6)) for _ in range(30)]
    texts += [t + " lagi" for t in texts[:8]] + [texts[0], "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    grams = [similarity.char_grams(t) for t in texts]
    df_count = {}
    for g in grams:
        for k in g:
            df_count[k] = df_count.get(k, 0) + 1
    idf = {k: np.log((1 + len(texts)) / (1 + v)) + 1 for k, v in df_count.items()}
    vectors = [{k: c * idf[k] for k, c in g.items()} for g in grams]
    norms = [np.sqrt(sum(x * x for x in v.values())) or 1.0 for v in vectors]
    true = {(i, j) for i in range(len(texts)) for j in range(i) if sum(w * vectors[j].get(k, 0) for k, w in vectors[i].items()) / norms[i] / norms[j] >= 0.7}
    for longest in (3, 50):
        found = similarity.gram_counts(df, "id", "t")
        v = similarity.tfidf_vectors(found, similarity.inverse_document_frequency(found, len(texts)))
        assert {(r["b"], r["a"]) for r in similarity.cosine_pairs(v, v, 0.7, longest).where("a < b").collect()} == true


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(0)
    m = rng.standard_normal((20, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    unit = similarity.unit_vectors(df, "id", "v")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    expected = {i: int(np.argmax(u[10:] @ u[i])) + 10 for i in range(10)}
    out = similarity.nearest_in_blocks(unit.where("id < 10"), unit.where("id >= 10"), block=3)
    assert {r["id"]: r["best"] for r in out.collect()} == expected


def test_joins(spark):
    train = spark.createDataFrame([(1, "Satu  dua"), (2, "tiga"), (3, None)], "id int, q string")
    test = spark.createDataFrame([("satu dua",)], "q string")
    assert ids(joins.decontaminate(train, test, "q", "q")) == [2, 3]
    cache = spark.createDataFrame([("tiga", "x", True, 1), ("tiga", "y", True, 2), ("tiga", "z", False, 3)], "q string, a string, ok boolean, o int")
    base = train.withColumn("a", F.lit(""))
    assert {r["id"]: (r["a"], r["filled"]) for r in joins.overlay_cache(base, cache, "q", ["a"], "ok", "o").collect()} == {1: ("", False), 2: ("y", True), 3: ("", False)}
    have = spark.createDataFrame([("p", 0), ("p", 1)], "id string, candidate_idx int")
    problems = spark.createDataFrame([("p",), ("r",)], "id string")
    assert sorted(map(tuple, joins.missing_indices(problems, have, "id", 3).collect())) == [("p", 2), ("r", 0), ("r", 1), ("r", 2)]


def test_sequence(spark):
    rows = [("d", 1, "lanjutan", "x", ""), ("d", 2, "soal", "a", ""), ("d", 3, "materi", "m", ""), ("d", 4, "lanjutan", "b", "9")]
    items = spark.createDataFrame(rows, "doc string, n int, kind string, steps string, answer string")
    out = sequence.continuation_merge(items, "doc", ["n"], "kind", "steps", "answer").collect()
    assert [(r["steps"], r["answer"], r["parts"]) for r in out] == [("a\nb", "9", 2)]
    links = readers.html_links(spark.createDataFrame([(1, "<a href='u'>x</a><h2>OSN 2019</h2><a href='v.pdf'>y</a>")], "id int, html string"), "id", "html")
    assert [(r["heading_year"], r["url"]) for r in links.orderBy("position").collect()] == [("unknown", "u"), ("2019", "v.pdf")]


def test_generate(spark):
    text = "1. Tentukan nilai x jika 2x = 10 dan y = 3.\n2. Hitunglah luas persegi dengan sisi 5 cm.\nKUNCI\n1. 5\n2. 25\n2. 26"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    assert [(r["answer"]) for r in generate.qa_pairs(df, "id", "t").orderBy("question").collect()] == ["26", "5"]
    assert generate.split_questions(df, "id", "t").where("numbered").count() == 2


def test_sampling_is_stable_and_disjoint(spark):
    df = spark.range(50).withColumn("q", F.col("id") % 20)
    a = sampling.holdout(df, "id", 10)
    assert a.where("part = 'test'").count() == 10 and ids(a.where("part = 'test'")) == ids(sampling.holdout(df, "id", 10).where("part = 'test'"))
    safe = sampling.leak_safe_holdout(df, F.col("q"), 5)
    assert safe.groupBy("q").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    assert sampling.train_val(df, "id", 0.0).where("part = 'val'").count() == 0


def test_rejection_sampling_and_stream(spark, tmp_path):
    rows = [("p", 0, r"\boxed{4}", "4"), ("p", 1, "tanpa", "4"), ("p", 2, r"\boxed{5}", "4"), ("p", 3, r"\boxed{$4$}", "4"), ("p", 3, r"\boxed{$4$}", "4"), ("r", 0, r"\boxed{1}", " ")]
    df = spark.createDataFrame(rows, "id string, candidate_idx int, text string, jawaban string").withColumn("soal", F.lit("q")).withColumn("cara", F.lit("")).withColumn("source", F.lit("s"))
    out = {(r["id"], r["candidate_idx"]): r["status"] for r in distill.rejection_sampling(df).collect()}
    assert out == {("p", 0): "kept", ("p", 1): "no_boxed", ("p", 2): "wrong", ("p", 3): "kept", ("r", 0): "no_gold"}
    again = distill.rejection_sampling(df, [df.select("id", "candidate_idx")])
    assert again.count() == 0
    writers.jsonl(df, f"{tmp_path}/in/a")
    stream = lambda: resumable.candidate_stream(spark, f"{tmp_path}/in/*")
    resumable.run_resumable(stream(), distill.judged, f"{tmp_path}/out", f"{tmp_path}/state")
    writers.jsonl(df, f"{tmp_path}/in/b")
    resumable.run_resumable(stream(), distill.judged, f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_chat_arms(spark):
    df = spark.createDataFrame([("p", 0, "q", r"the answer is \boxed{4}"), ("p", 1, "q", r"maka jawaban \boxed{4} panjang"), ("p", 2, "q", "tanpa")], "id string, candidate_idx int, soal string, text string")
    best = distill.to_chat(df, max_per_problem=1)
    assert [(r["arm"], r["candidate_idx"]) for r in best.orderBy("arm").collect()] == [("cot", 1), ("nocot", 1)]
    assert best.where("arm = 'nocot'").first()["messages"][1]["content"] == r"\boxed{4}"


def test_readers(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"soal": "a"}\n{broken\n{"soal": "b", "hard": true}\n')
    assert readers.jsonl(spark, str(path), readers.GOLD, "skip").count() == 2
    kept = readers.jsonl(spark, str(path), readers.GOLD, "keep").cache()
    assert [r["_parse_error"] for r in kept.where("_parse_error IS NOT NULL").collect()] == ["{broken"]
    (tmp_path / "p00001.json").write_text('["g1", "g2"]')
    (tmp_path / "p00007.json").write_text("oops")
    problems = spark.createDataFrame([(0,), (1,), (7,)], "i int")
    assert {r["i"]: r["gens"] for r in readers.sample_cache(spark, str(tmp_path), problems, "i", 1).collect()} == {0: [], 1: ["g1"], 7: []}


def test_quality(spark):
    rows = [("s", "a" * 30, "3", "cara \\boxed{3}"), ("s", "b" * 30, "4", "\\boxed{5}"), ("s", "c", "1", None), ("s", "d" * 30, None, None)]
    df = spark.createDataFrame(rows, "split string, soal string, jawaban string, cara string")
    reasons = sorted(str(r["reason"]) for r in quality.cleaning_reasons(df).collect())
    assert reasons == ["None", "cara_vs_gold_mismatch", "jawaban_kosong", "soal_rusak"]
    assert quality.answer_distribution(df.limit(0), ["split"], F.col("jawaban")).count() == 0
    table = writers.markdown_table(spark.createDataFrame([("m", "x", 0.5)], "model string, ds string, v double"), "model", "ds", "v", ["x", "y"])
    assert table.splitlines()[-1] == "| m | 0.500 | - |"


def test_bounded_sample_and_top(spark):
    df = spark.range(5000).withColumn("n", F.col("id") % 97 + 1)
    a = ids(sampling.bounded_sample(df, F.col("id"), 300, 5000))
    assert len(a) == 300 and a == ids(sampling.bounded_sample(df.repartition(7), F.col("id"), 300, 5000))
    assert sampling.bounded_sample(df.limit(0), F.col("id"), 5, 0).count() == 0
    top = sampling.bounded_top(df, "n", 400)
    assert 0 < top.count() <= 400 and top.agg(F.min("n")).first()[0] > 80
    assert sampling.bounded_top(df, "n", 10_000).count() == 5000


def test_greedy_embedding_survivors_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 24))
    vectors = np.concatenate([base[rng.integers(0, 60, 240)] + 0.2 * rng.standard_normal((240, 24)), base[:20], base[:20]])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine, kept = unit @ unit.T, []
    for i in range(len(unit)):
        if not any(cosine[i, j] >= 0.92 for j in kept):
            kept.append(i)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(unit)], "id long, v array<double>")
    for tile in (1000, 3):  # the second cuts every group of hyperplanes into parts
        pairs = {(r["a"], r["b"]) for r in similarity.embedding_pairs(rows, 0.92, tile=tile).collect()}
        true = {(i, j) for i in range(len(unit)) for j in range(i + 1, len(unit)) if cosine[i, j] >= 0.92 + 1e-9}
        assert len(true) > 100 and len(true & pairs) >= 0.99 * len(true)
    got = {r["id"] for r in similarity.greedy_embedding_survivors(rows).where("kept").collect()}
    assert len(got ^ set(kept)) <= 1
    assert similarity.greedy_embedding_survivors(rows.limit(0)).count() == 0


def test_blocks_of_a_hot_document_match_a_plain_loop(spark):
    import random

    rng = random.Random(6)
    rows = [(rng.choice(["panas"] * 8 + ["lain", None]), i, rng.choice([None, None, f"v{i}"]), rng.random() < 0.3, rng.random() < 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "doc string, n int, v string, numbered boolean, complete boolean").withColumn("t", F.concat(F.lit("t"), F.col("n").cast("string"))).repartition(5)
    carried, groups, last, before = {}, {}, {}, {}
    for doc, n, v, numbered, complete in rows:
        last[doc] = v or last.get(doc)
        carried[n] = last[doc]
        if numbered or before.get(doc, True):
            groups.setdefault(doc, []).append([])
        groups[doc][-1].append(n)
        before[doc] = complete
    got = {r["n"]: r["c"] for r in sequence.carry_down(df, "doc", "n", "v", "c").collect()}
    assert got == carried
    merged = {(r["doc"], r["n"]): r["t"] for r in sequence.pending_questions(df, "doc", ["n"], "t", "numbered", "complete").collect()}
    assert merged == {(doc, g[0]): "\n".join(f"t{n}" for n in g) for doc, parts in groups.items() for g in parts}
    assert sequence.carry_down(df.limit(0), "doc", "n", "v", "c").count() == 0


def test_ranked(spark):
    values = [(i * 7919 % 30011) ** 3 / 1e9 for i in range(30000)] + [5.0] * 15000 + [-1e6, 1e12]
    df, order = spark.createDataFrame([(v,) for v in values], "v double"), sorted(values)
    assert all(sampling.ranked(df, "v", k) == order[k] for k in (0, 1, 90, 20000, 44999, 45001))
