from pyspark.sql import functions as F

from lintang.functions import answers as A
from lintang.operators import records
from lintang.plans import distill, reports

GOLD = "split string, soal string, cara string, jawaban string"
LONG = "Tentukan nilai dari x yang memenuhi persamaan itu."


def gold(spark):
    rows = [
        ("a", LONG, "jadi \\boxed{4}", "4"), ("a", LONG, "jadi \\boxed{5}", "4"), ("a", "pendek", "tanpa hasil", "6"), ("a", None, None, None), ("b", LONG + "\x00", "", "jawaban yang panjang sekali"),
    ]
    return spark.createDataFrame(rows, GOLD).withColumn("flags", F.lit("clash"))


def test_gold_inspection(spark):
    flagged = reports.gold_flags(gold(spark))
    counts = {(r["split"], r["flag"]): r["n_rows"] for r in reports.flag_counts(flagged, ["split"]).collect()}
    assert counts == {
        ("a", "cara_vs_gold_mismatch"): 1, ("a", "soal_pendek"): 1, ("a", "cara_tanpa_jawaban"): 1, ("a", "jawaban_kosong"): 1, ("a", "soal_kosong"): 1, ("b", "mojibake"): 1, ("b", "jawaban_teks_bebas"): 1,
    }
    a, b = reports.gold_summary(flagged, ["split"]).orderBy("split").collect()
    assert (a["n"], a["dup_soal"], a["cara_checked"], a["cara_match_gold"], a["self_consistency"], a["soal_len_median"]) == (4, 1, 3, 1, 0.333, (len(LONG) + 6) // 2)
    assert b["self_consistency"] is None
    rates = reports.gold_rates(flagged, ["split"]).orderBy("split").first()
    assert (rates["empty_jawaban_rate"], rates["dup_rate"], rates["mojibake_rate"]) == (0.25, 0.25, 0.0)
    assert reports.gold_summary(reports.gold_flags(gold(spark).limit(0)), ["split"]).count() == 0


def test_chat_inspection_depends_on_the_mode(spark):
    say = lambda t: [("user", "perintah\n\nsoal"), ("assistant", t)]
    rows = [("cot", say("\\boxed{4}")), ("cot", say("langkah " * 20 + "\\boxed{4}")), ("nocot", say("langkah " * 20 + "\\boxed{4}")), ("nocot", say("\\boxed{4}")), ("nocot", say("\\boxed{ }")), ("nocot", []), ("nocot", None)]
    df = spark.createDataFrame(rows, "arm string, messages array<struct<role string, content string>>")
    counts = {(r["arm"], r["flag"]): r["n_rows"] for r in reports.flag_counts(reports.chat_flags(df, F.col("arm")), ["arm"]).collect()}
    assert counts == {("cot", "cot_tanpa_penalaran"): 1, ("nocot", "nocot_ada_penalaran"): 1, ("nocot", "boxed_kosong"): 1, ("nocot", "assistant_kosong"): 2, ("nocot", "tanpa_boxed"): 2}


def test_holdout_counters_are_independent(spark):
    rows = [("Hitung integral $x$", "4"), ("Hitung $x", "4"), ("Hitung $x", "??"), ("Hitung", "x^2+1"), ("Hitung", "jawaban bebas!"), ("Hitung", None)]
    r = reports.holdout_counters(spark.createDataFrame(rows, "soal string, jawaban string").withColumn("g", F.lit(1)), ["g"]).first()
    assert (r["n_input"], r["bad_gold"], r["bad_latex"], r["kept"], r["hard"]) == (6, 3, 2, 2, 1)


def test_judge_rates_and_prompts(spark):
    df = spark.createDataFrame([("benar", "ya"), ("salah", "ya"), ("ragu", "tidak"), ("benar", "ya")], "gold string, lengkap string")
    r = reports.label_rates(df, [], reports.GOLD_LABELS).first()
    assert (r["n"], r["gold_benar_rate"], r["gold_salah_rate"], r["soal_lengkap_rate"]) == (4, 0.5, 0.25, 0.75)
    rows = spark.createDataFrame([("s" * 2000, None), (" ", "g" * 100)], "soal string, gold string")
    prompts = [r["prompt"] for r in reports.judge_prompts(rows, "{soal}|{gold}", F.col("soal"), gold=(F.col("gold"), 80)).collect()]
    assert prompts == ["s" * 1800 + "|(kosong)", "|" + "g" * 80]
    assert [r[0] for r in rows.select(reports.says_correct(F.lit("Jawaban BENAR"))).limit(1).collect()] == [True]


def test_coverage_with_and_without_pools(spark):
    runs = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", "1"), ("b", "3"), ("b", "4")], "run string, id string")
    pools = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("b", "3"), ("b", "4")], "run string, id string")
    rows = lambda p: {r["run"]: (r["coverage_common"], r["winner"]) for r in reports.coverage_scores(runs, p, "run", "id").collect()}
    assert rows(pools) == {"a": (2, True), "b": (1, False)}
    assert rows(pools.where("run = 'a'")) == {"a": (2, False), "b": (3, True)}  # a run without a pool: all that were solved stand in
    apart = spark.createDataFrame([("a", "8"), ("b", "9")], "run string, id string")
    assert rows(apart) == {"a": (0, False), "b": (0, True)}  # nothing in common: the raw coverage decides


def test_sampling_counters(spark):
    rows = [("p", i, t, g) for i, (t, g) in enumerate([("\\boxed{4}", "4"), ("\\boxed{4}", "4"), ("\\boxed{0.5}", "1/2"), ("\\boxed{9}", "4"), ("x", "4"), ("\\boxed{4}", " ")])]
    df = spark.createDataFrame(rows, "id string, candidate_idx int, text string, jawaban string").withColumn("source", F.lit("s"))
    judge = lambda d: d.withColumn("judged_correct", A.quick_match(F.col("pred"), F.col("jawaban")))
    r = distill.sampling_counters(df, df.where("candidate_idx = 0"), ["source"], judge).first()
    assert r.asDict() == {"source": "s", "total": 6, "skipped_done": 1, "no_boxed": 1, "no_gold": 1, "by_prefilter": 1, "by_judge": 1, "wrong": 1, "kept": 2, "problems_covered": 1}


def test_record_operators(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    assert records.set_difference(ids("a", "b", None), ids("b", "a", "a", None), "id").count() == 0
    assert {(r["id"], r["side"]) for r in records.set_difference(ids("a", None), ids("c", "a"), "id").collect()} == {(None, "left"), ("c", "right")}
    assert records.union_distinct(ids("a", "a"), ids("b", "a")).count() == 2
    assert records.missing_files(ids("x", "y"), ids("y"), "id").first()["id"] == "x"
    assert records.aligned_by_index(spark.createDataFrame([(0, "a"), (1, "b")], "i int, t string"), spark.createDataFrame([(1, "g")], "i int, g string"), "i").first()["t"] == "b"
    pages = spark.range(47).select(F.lit("d").alias("d"), F.col("id").alias("p"), F.when(F.col("id") % 2 == 0, F.lit("x" * 50)).alias("t"))
    assert sorted(r["p"] for r in records.sampled_pages(pages, "d", "p", 20).collect()) == sorted({-(-i * 47 // 20) for i in range(20)})
    assert records.sampled_pages(pages.limit(7), "d", "p", 20).count() == 7
    blocks = spark.createDataFrame([(1, "lihat gambar", ["f"]), (1, "hitung", ["f"]), (2, "hitung", ["g"]), (3, "hitung", None)], "page int, text string, images array<string>")
    assert {(r["page"], r["text"]): r["images"] for r in records.attach_images(blocks, ["page"], "text", "images").collect()} == {(1, "lihat gambar"): ["f"], (1, "hitung"): [], (2, "hitung"): ["g"], (3, "hitung"): []}
    seen = []
    translate = lambda pool: seen.append(pool.count()) or pool.withColumn("translated", F.upper("text"))
    out = records.translate_once(spark.createDataFrame([(1, " a "), (2, " a "), (3, "12"), (4, None)], "n int, t string"), "t", translate)
    assert {r["n"]: r["translated"] for r in out.collect()} == {1: " A ", 2: " A ", 3: "12", 4: None} and seen == [1]
    found, unknown = records.chosen_sources(ids("a", "b"), "id", ids("b", "z"))
    assert (found.first()["id"], unknown.first()["id"]) == ("b", "z")
    order = spark.createDataFrame([("z", "b"), ("osn", "c"), ("z", "A")], "folder string, name string").orderBy(*records.priority_order(F.col("folder"), F.col("name"), ["osn"]))
    assert [r["name"] for r in order.collect()] == ["c", "A", "b"]
    merged = reports.merged_results([ids("a").withColumn("x", F.lit(1)), ids("a", "b").withColumn("y", F.lit(2))], "id")
    assert {(r["id"], r["x"], r["y"]) for r in merged.collect()} == {("a", None, 2), ("b", None, 2)}
