"""Broken pairs."""

import random

import pytest
from pyspark.sql import functions as F

from dialoom.llm import broken_pairs as B

Q = "Biển có nền màu gì?"


@pytest.mark.parametrize("a", [None, "", "  ", "\u3000", "\u200b", "...", "-", '""', "N/A", "None", "<empty>", "[không có câu trả lời]", "(trống)", "\ufeff", "。"])
def test_empty(a):
    assert B.is_empty(a)


@pytest.mark.parametrize("a", ["Không.", "12", "Không có người nào trong ảnh.", "đ", "0"])
def test_short_is_not_empty(a):
    assert not B.is_empty(a)


@pytest.mark.parametrize("a", ["Biển có nền màu gì", "BIỂN CÓ NỀN MÀU GÌ?", "Bien co nen mau gi?", "Câu hỏi: Biển có nền màu gì?", f"{Q} {Q}", "Ｂiển có nền màu gì..."])
def test_copies(a):
    assert B.copies_question(Q, a)


def test_a_name_out_of_the_question_is_an_answer():
    q = "Trong bức ảnh chụp Quán phở Mết Vân, biển hiệu trong ảnh ghi gì?"
    assert not B.copies_question(q, "Quán phở Mết Vân.")
    assert B.copies_question(q, "Biển hiệu trong ảnh ghi gì?")
    assert not B.copies_question("Đây là đâu?", "Đây là khu chợ.") and not B.copies_question("", "x")


@pytest.mark.parametrize("a", ["Tôi không thể trả lời.", "Xin lỗi, tôi không giúp được.", "Không được phép trả lời ạ.", "Câu này tôi xin phép bỏ qua.", "Hiện tại em xin phép không trả lời ạ về Chợ Hoa.", "Toi khong the tra loi cau hoi nay.", "I am unable to view images.", "Sorry, I can't help with that.", "As an AI model, I am not able to describe it.", "Unfortunately I must decline to comment.", "Je ne peux pas répondre.", "抱歉，我无法回答。", "Я не могу ответить на этот вопрос."])
def test_refusals(a):
    assert B.is_refusal(a)


@pytest.mark.parametrize("a", ['Tờ giấy ghi "Xin lỗi quý khách, tạm nghỉ".', 'Thông báo viết "Không thể nhận thẻ", khách phải trả tiền mặt.', "Không đỗ xe ở đây.", "Không có người nào trong ảnh.", "Ở Tiệm may, sữa chua được bán với giá 11.000 đồng.", "Không."])
def test_negative_and_quoted_answers_are_no_refusals(a):
    assert not B.is_refusal(a)


@pytest.mark.parametrize("a", ["It is a shop.", "C'est un petit magasin.", "Ini adalah sebuah pasar.", "这是一家卖早餐的小店。", "На вывеске написано название магазина.", "Das Schild von Quán phở Mết Vân hängt direkt über der Eingangstür.", "ป้ายร้านอยู่เหนือประตูทางเข้า"])
def test_other_language(a):
    assert B.other_language(Q, a)


@pytest.mark.parametrize("a", ["Co 6 chiec xe may dung truoc cua.", '"FRESH AND GOOD"', 'Ngay dưới tên là câu khẩu hiệu "COFFEE HOUSE OPEN 24H".', "Garage Mết Vân", "0123 456 789", "Màu đỏ", "tHÔNG bÁO vIẾT rẰNG"])
def test_same_language(a):
    assert not B.other_language(Q, a)


def test_foreign_pairs():
    assert not B.other_language("What is sold here?", "It is a shop.") and B.other_language("What is sold here?", "Đây là một quán ăn ở chợ.")
    assert not B.other_language("What is sold here?", "Quán phở Mết Vân") and not B.other_language("Where is it?", "Ở đường Mết Vân.")


@pytest.mark.parametrize("a", ["Theo tấm biển,", "Thư viện và", "Trước cửa (", 'Dòng chữ nhỏ ("', "Ngay dưới gồm có:", "Ảnh chụp những ...", "Bến xe tại ...", "Số điện thoại in, trong nh", "Phía trước, hoặc đườ", "Có các món:\n- phở\n-", '{"ten": "Quán', "```python\nx = 1"])
def test_truncated(a):
    assert B.is_truncated(a, False)


@pytest.mark.parametrize("a", ["Rau củ và bánh mì", "Năm 1985", "Số 748 đường Choa Lụy", "Màu xanh lá", "Giảm 5%", "0973 820 940", "7 giờ sáng 😀", '{"ten": "Quán", "gia": [1, 2]}', "Biển ghi “Mở cửa“.", "a) một b) hai", "Quán phở <b>Mết</b>.", "8 ạ"])
def test_short_phrases_are_whole(a):
    assert not B.is_truncated(a, False)


def test_parser_is_linear_on_long_texts():
    assert B.left_open("(" * 100_000) and not B.left_open('("a")' * 50_000)


def test_flagging(spark):
    whole = "Cửa hàng nằm trên đường Hoa, quán bán những bánh mì ngon."
    rows = [(1, Q, None), (1, Q, None), (2, Q, Q.upper()), (3, Q, "Tôi không thể trả lời."), (4, Q, "It is a small shop."), (5, Q, "Cửa hàng bán bả"), (6, Q, "Màu đỏ."), (7, Q, "Màu đỏ. " * 20_000), (8, None, "Màu đỏ.")]
    rows += [(100 + i, Q, "Bảng giá của bảng hiệu.") for i in range(5)] + [(200, Q, whole)]
    df = spark.createDataFrame(rows, "id int, question string, answer string").withColumn("word", F.lit("w")).withColumn("_seen", F.lit("s"))
    out = B.flag_defects(df)
    assert out.columns == [*df.columns, "defect"] and out.count() == len(rows)
    got = {r.id: r.defect for r in out.collect()}
    assert {k: got[k] for k in range(1, 9)} == {1: "empty", 2: "copies_question", 3: "refusal", 4: "other_language", 5: "truncated", 6: None, 7: None, 8: None}
    assert got[200] is None
    assert B.flag_defects(df.limit(0)).count() == 0


def test_greedy_tiling_against_brute_force():
    assert B.tiles(B._Runs(list("abcd")), list("cdab"), 2) in ([(0, 2, 2), (2, 0, 2)], [(2, 0, 2), (0, 2, 2)])
    assert B.tiles(B._Runs(list("ab")), list("xy"), 1) == [] and B.tiles(B._Runs([]), list("a"), 1) == []
    r = random.Random(4)
    for _ in range(200):  # against all runs of the question
        q, t = ["".join(r.choices("abc", k=r.randrange(n))) for n in (9, 30)]
        found = B.tiles(B._Runs(list(q)), list(t), 2)
        assert all(q[i : i + k] == t[j : j + k] and k >= 2 for i, j, k in found)
        covered, j = 0, len(t)
        while j:
            k = max((k for k in range(j + 1) if t[j - k : j] in q), default=0)
            covered += k if k >= 2 else 0
            j -= k if k >= 2 else 1
        assert sum(k for *_, k in found) == covered


def test_a_cut_answer_is_cut_however_often_it_stands(spark):
    answers = ["Đường không rộng lắm.", "Sân khô ráo, không có xe.", "Ở đây không có ai.", "Biển không ghi giá.", "Nền khô và sạch."]
    for copies in (1, 2, 30):
        rows = [(i, Q, a) for i, a in enumerate(answers)] + [(100 + i, Q, "Phía trước khô") for i in range(copies)]
        got = {r.id: r.defect for r in B.flag_defects(spark.createDataFrame(rows, "id int, question string, answer string")).collect()}
        assert all(got[100 + i] == "truncated" for i in range(copies)) and not any(got[i] for i in range(len(answers)))


def test_whole_texts_are_judged():
    vi, zh = "Đây là một quán cà phê ở góc phố. ", "这家店卖很多种类的水果和蔬菜，"
    assert B.language(vi * 600 + zh * 4000) == "zh" and B.language(vi * 600) == "vi"
    q = "Biển hiệu trong ảnh ghi gì?"
    assert all(B.copies_question(q, " ".join([q] * n)) for n in (1, 20, 20_000))
    assert not B.copies_question(q, " ".join([q] * 20) + " Chợ Lớn" * 20)
    assert B.is_empty("N/A" + "\u200b" * 450) and not B.is_empty("na " * 50) and not B.is_empty("\u200b" * 500 + "8")
    assert B.is_refusal("Đây là biển hiệu. " * 50 + "抱歉，我无法回答这个问题。") and B.is_refusal("Đây là quán. Lo siento, no puedo responder.")


# phrasings that the grammar wasn't written from
@pytest.mark.parametrize("a", ["Tôi chịu, hình mờ quá.", "Câu này mình bó tay.", "Em xin lỗi nhưng em không thể đọc được chữ trong hình.", "Mình không rõ nội dung trên biển.", "Tôi không biết.", "Rất tiếc, không thể xác định được từ bức ảnh này.", "Toi khong tra loi duoc cau nay", "Ảnh mờ quá nên không đọc được.", "Không đủ thông tin để trả lời.", "Yêu cầu này trái với chính sách.", "Tôi đành chịu thua câu này."])
def test_other_refusals(a):
    assert B.is_refusal(a)


@pytest.mark.parametrize("a", ["Biển ghi: Không thể trả lời điện thoại khi lái xe.", "Cửa hàng không thể cung cấp hàng trong ngày lễ.", "Khách không được phép nói chuyện trong thư viện.", "Không được đỗ xe trước cửa.", "Nhân viên không thể giúp khách ngoài giờ.", "Một em bé không thể với tới quầy.", "Người đàn ông không nhìn được biển vì xe che", "The shop cannot provide goods on holidays.", "Quán không bán trái cây."])
def test_no_refusals(a):
    assert not B.is_refusal(a)


@pytest.mark.parametrize("a", ["Biển ghi **Quán", "Giá là `12 đồng", "Dùng ```\ncode", "Công thức $$a+b", "| a | b |\n|---|---|\n| 1 | 2", "- một\n- hai\n-", "Tên (gọi tắt", "1. a\n2. b\n3.", "~~bỏ"])
def test_constructs_left_open(a):
    assert B.left_open(a)


@pytest.mark.parametrize("a", ["Quán *Hoa* rất đẹp", "5 * 3 = 15", "giá 5$ một cái", "**Quán**", "| a | b |\n| 1 | 2 |", "a_b_c", "* một\n* hai", "Khách sạn ***", "`x` và `(y`", "$$a(b$$", "- một\n-\n- hai", "**a\n\nb"])
def test_constructs_closed(a):
    assert not B.left_open(a)


def test_copies_change_nothing(spark):
    """A table united with itself gives each defect twice; a cut answer is cut however often it stands."""
    answers = ["Phía trước khô"] * 2 + ["Phía trước không có ai, không có xe."] * 3 + ["Không có ai.", "Tôi không thể trả lời.", "", None, "Bên phải không có biển hiệu nào."] * 4
    rows = [(i, "Phía trước có gì?", f"{a}" if a is not None else None) for i, a in enumerate(answers)]
    df = spark.createDataFrame(rows, "id int, question string, answer string")
    once, twice = (sorted((r.defect or "", r.n) for r in B.flag_defects(x).groupBy("defect").agg(F.count("*").alias("n")).collect()) for x in (df, df.unionAll(df)))
    assert [(d, 2 * n) for d, n in once] == twice
    assert ("truncated", 2) in once
