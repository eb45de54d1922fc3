import pytest
from pyspark.sql import functions as F

from lintang.functions import answers as A
from lintang.functions import predicates as P
from lintang.functions import text as X
from lintang.plans.evaluate import graded_generations, sampled_scores

# Answers of models, expected results and verdicts that a grader must give.
CASES = [
    (r"...jadi \boxed{42}", "42", True), (r"\boxed{7}", "8", False), (r"tanpa kotak sama sekali", "5", False),
    (r"awalnya \boxed{3} tapi ralat \boxed{4}", "4", True), (r"\boxed{\frac{1}{2}}", "1/2", True), (r"\boxed{\frac{1}{2}}", "0.5", True),
    (r"\boxed{0.50}", "1/2", True), (r"\boxed{1,000}", "1000", True), (r"\boxed{1,5}", "1.5", True), (r"\boxed{2x}", "x*2", True),
    (r"\boxed{x^2+2x+1}", "(x+1)^2", True), (r"\boxed{\text{42}}", "42", True), (r"\boxed{\dfrac{1}{n^2+3n+2}}", r"\(\frac{1}{(n+1)(n+2)}\)", True),
    (r"\boxed{2}", "c=2", True), (r"\boxed{\frac{7}{15}}", "7/15", True), (r"\boxed{4}", "A. 4", True), (r"\boxed{-17}", "B) -17", True),
    (r"\boxed{135}", "135 dolar", True), (r"\boxed{2}", "2 mol", True), (r"\boxed{(5,10)}", "A' = (5,10)", True), (r"\boxed{10}", "11", False),
    (r"\boxed{tahun 1998}", "15", False),
]


def test_grader_cases(spark):
    rows = spark.createDataFrame([(i, t, g, e) for i, (t, g, e) in enumerate(CASES)], "i int, text string, jawaban string, expected boolean")
    wrong = graded_generations(rows).where("correct <> expected").collect()
    assert not wrong, wrong


def test_boxed(one):
    assert one(A.extract_boxed, r"\boxed {a{b}c}") == "a{b}c"
    assert one(A.extract_boxed, r"\boxed x{1}") is None
    assert one(A.extract_boxed_loose, r"\boxed x{ 1 }") == "1"
    assert one(A.extract_boxed, r"\boxed{1") is None
    assert one(A.extract_boxed, None) is None
    assert one(A.extract_answer, "jadi 3 lalu 4,5") == "4,5"
    assert one(A.answer_from_steps, "maka $x=1$ dan $7$ lalu 9") == "7"


@pytest.mark.parametrize("n,c,k,expected", [(4, 2, 1, 0.5), (4, 2, 2, 5 / 6), (5, 0, 3, 0.0), (5, 5, 3, 1.0), (3, 1, 9, 1.0)])
def test_pass_at_k(one, n, c, k, expected):
    assert one(lambda a, b: A.pass_at_k(a, b, k), n, c) == pytest.approx(expected)


def test_majority_and_scores(spark):
    rows = [("g", "p", i, t, "4") for i, t in enumerate([r"\boxed{4}", r"\boxed{4}", r"\boxed{5}", r"\boxed{5}", "4"])]
    df = graded_generations(spark.createDataFrame(rows, "grp string, pid string, i int, text string, jawaban string"))
    out = sampled_scores(df, ["grp"], "pid", "i").first()
    assert (out["maj_3"], out["maj_5"], out["format_ok_rate"], out["samples"]) == (1.0, 1.0, 0.8, 5)


def test_answer_shapes(one):
    values = {"": "empty", " 3.5 ": "numeric", r"$\frac{1}{2}$": "fraction", "tahun seribu": "text", "x+1": "expr"}
    assert {v: one(A.answer_shape, v) for v in values} == values
    types = {"": "empty", "$4$": "pure_int", "1/2": "pure_num", "x + 1": "single_expr", "luas dan keliling $3$": "sentence", "tiga puluh orang": "sentence_plain"}
    assert {v: one(A.answer_type, v) for v in types} == types
    assert one(A.answer_shape, None) == "empty"


def test_predicates(one):
    assert one(P.is_multiple_choice, "Pilih\nA. 1\nB. 2\nC. 3")
    assert not one(P.is_multiple_choice, "A. 1")
    assert one(lambda c: P.is_true_false(c, True), "Benar atau salah?")
    assert one(P.needs_image, "Lihat gambar berikut")
    assert one(P.is_garbled, "3 Ã— 4 â€“ 5") and not one(P.is_garbled, "3 × 4")
    assert one(P.is_latex_balanced, r"\(a\) $b$ {c}") and not one(P.is_latex_balanced, "$a")
    assert one(lambda c: P.reason_rules(c, 2), "pendek") == "too_short"
    assert one(lambda c: P.reason_rules(c, 2), None) == "too_short"
    assert one(P.is_numeric_gold, "12 cm") and not one(P.is_numeric_gold, "dua")
    assert one(lambda c: P.visual_reference_undescribed(c), "Lihat gambar. [Gambar: segitiga siku-siku dengan alas tiga]") is False
    assert one(P.is_valid_verdict, "valid") and not one(P.is_valid_verdict, "TIDAK_VALID")


def test_text(one):
    assert one(X.normalize_math, "1/2 dan x^2, $3/4$") == r"$\frac{1}{2}$ dan $x^{2}$, $3/4$"
    assert one(X.normalize_url, "HTTPS://Ex.ORG/A/") == "https://ex.org/A"
    assert one(X.drive_id, "https://drive.google.com/file/d/abc/view") == "abc"
    assert one(X.parse_level, "Semifinal Nasional") == "nasional" and one(X.parse_level, None) == "unknown"
    assert one(X.strip_think, "<think>a</think> b") == "b"
    assert one(X.unwrap_prompt, "Instruksi\n\nSoal") == "Soal"
    assert one(X.clean_raw_text, "lihat http://x.y z\nab\nkalimat panjang") == "lihat  z\nkalimat panjang".replace("  z", "")
    assert one(lambda c: X.chunks(c, 10), "aaaa bbbb\n\ncccc dddd eeee ffff") == ["aaaa bbbb", "cccc dddd", "eeee ffff"]
    assert one(lambda c: X.parse_verdict(c, "gold", ["benar", "salah", "ragu"], "ragu"), "VERDICT gold=BENAR lengkap=ya") == "benar"
    assert [r["a"] for r in one(lambda c: X.json_items(c, "struct<a:int>"), '```json\n[{"a": 1}, {"a": 2}]\n```')] == [1, 2]
    assert one(lambda c: X.json_items(c, "struct<a:int>"), "bukan json") == []
    with pytest.raises(ValueError):
        X.wrap_prompt(F.lit("x"), "other")


@pytest.mark.parametrize("depth", [1, 4, 5, 9, 30])
def test_boxes_of_any_depth(one, depth):
    body = "a" + "{b" * depth + "}" * depth
    assert one(A.extract_boxed, f"x \\boxed {{{body}}} y}}") == body
    assert one(A.extract_boxed_loose, f"\\boxed z{{ {body} }}") == body
    assert one(A.extract_boxed, f"\\boxed{{{body}") is None


def test_prompts_are_exact(one):
    assert one(X.wrap_prompt, " Berapa? ") == (
        "Selesaikan soal matematika berikut. Tunjukkan langkah-langkah penyelesaian secara rinci dan sistematis dalam Bahasa Indonesia. "
        "Pastikan jawaban akhir (dan hanya jawaban) berada di dalam \\boxed{}.\n\nBerapa?"
    )
    assert one(lambda c: X.wrap_prompt(c, "nocot"), "Berapa?").startswith("Selesaikan soal matematika berikut. Berikan HANYA jawaban akhir di dalam \\boxed{} tanpa")
    assert one(lambda c: X.without_prompt(X.wrap_prompt(c)), "Berapa?\n\nYa") == "Berapa?\n\nYa" and one(X.without_prompt, " lain ") == "lain"


def test_control_characters(one):
    for text in ("a\x00b", "a\x08", "Ã\x80", "â€œ", "Â°", "\ufffd", "\x1f"):
        assert one(P.is_garbled, text), text
    assert not any(one(P.is_garbled, t) for t in ("a\tb\n", "Ã", "â", "Âu", ""))
    assert one(X.clean_record_text, "a\x00b\x7f") == "ab"


def test_language_labels(one):
    assert one(P.language_label, "$x^2$ 12 + 3") == "unknown" and one(P.language_label, "Tentukan nilai $x$") == "id"
    assert one(P.language_label, "the value is given") == "en" and one(P.language_label, None) == "unknown"
    assert one(lambda c, d: P.language_label(c, d), "hallo welt", "de") == "id" and one(lambda c, d: P.language_label(c, d), "hello world", "en") == "en"


def test_formulas_survive_a_change_of_text(one):
    for text in ("a $x$ b $y^2$", "$x$", "tanpa", "", "$ $a$ $", None, "$x$$y$"):
        protect = lambda c: F.struct(*[x.alias(n) for x, n in zip(X.protect_formulas(c), "tf")])
        row = one(protect, text) if text is not None else None
        if row:
            assert one(lambda c: X.restore_formulas(X.protect_formulas(c)[0], X.protect_formulas(c)[1]), text) == text
    assert one(lambda c: X.restore_formulas(F.upper(X.protect_formulas(c)[0]), X.protect_formulas(c)[1]), "jika $x$ maka $y$") == "JIKA $x$ MAKA $y$"


def test_small_text_functions(one):
    assert one(lambda c: X.relative_path(c, "/a/b"), "/a/b/c\\d") == "c/d" and one(lambda c: X.relative_path(c, "/a/b"), "/x/c") == "/x/c"
    assert one(lambda a, b: X.reattach_space(a, b), "\t satu \n", " dua ") == "\t dua \n"
    assert one(A.symbolic_match, "2^3", "8") and one(A.symbolic_match, "x" + "+x" * 200, "201x") and not one(A.symbolic_match, "2^3", "9")
