"""Look-alikes, canonical spelling, formatting copies."""

import itertools
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialoom.llm import canonical_text as C
from dialoom.llm import formatting_copies as K
from dialoom.llm.lookalikes import bare, is_plain, letters_and_digits, look, no_accents

BASE = "Trước cửa Nhà hàng Hang Ninh Boa có tất cả 11 chiếc xe máy dựng ở đó."
VARIANTS = [
    BASE,
    unicodedata.normalize("NFD", BASE),
    BASE.replace("o", "о").replace("a", "а"),
    BASE.replace(" ", " "),
    BASE.replace(" ", " ", 3),
    BASE.replace("h", "h​").replace("x", "­x"),
    "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in BASE),
    BASE.replace("N", "Ν").replace("đ", "đ"),
]


def test_variants_have_one_look():
    assert {look(v) for v in VARIANTS} == {BASE}


@pytest.mark.parametrize("other", [BASE + " ", BASE.upper(), BASE.replace(".", "!"), BASE.replace(" ", "  ", 1), BASE.replace("11", "¹¹"), no_accents(BASE), BASE.replace(" ", "\n", 1)])
def test_visible_differences_stay(other):
    assert look(other) != BASE


def test_joiners_between_pictographs_matter():
    family = "👩‍🍳"
    assert look(family) == family and look("👩🍳") == "👩🍳" != family
    assert look("👩‍‍🍳") == family and look("a‍b") == "ab"
    assert look(None) is None and look("") == ""


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aàoộđĐ xX оа​­ ｗＷ̣̀👩‍🍳\n", max_size=20))
def test_look_is_stable(t):
    assert look(look(t)) == look(t)
    if is_plain(t):
        assert look(t) == t


def rows(spark, texts):
    return spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "tab string, key bigint, text string")


TEXTS = [*VARIANTS, BASE, BASE.upper(), None, "", " ", "​", "вход", "вxод", "Hа", "На", "короткий текст", "x" * 30_000 + "​" + "y" * 30_000, "👩‍🍳 " * 50]


def test_canonical_spellings_are_consistent(spark):
    got = {r.key: r.canonical for r in C.canonical(rows(spark, TEXTS), "text").collect()}
    assert len(got) == len(TEXTS)
    for (i, a), (j, b) in itertools.combinations(enumerate(TEXTS), 2):
        if a is not None and b is not None:
            assert (look(a) == look(b)) == (got[i] == got[j]), (a[:40], b[:40])
    assert {got[i] for i in range(len(VARIANTS))} == {BASE}
    assert got[TEXTS.index(None)] is None and got[TEXTS.index("")] == ""
    assert got[TEXTS.index("вход")] == got[TEXTS.index("вxод")] == "вход"


def test_same_look_against_brute_force(spark):
    got = {(r.key_a, r.key_b) for r in C.same_look(rows(spark, TEXTS).withColumn("_salt", F.lit(1)).withColumn("form", F.lit(2)), "text", "key", ["tab"]).collect()}
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(TEXTS), 2) if a is not None and b is not None and a != b and look(a) == look(b) and letters_and_digits(a) >= 40}
    assert got == want and want
    assert C.same_look(rows(spark, []), "text", "key", ["tab"]).count() == 0


def test_java_and_python_agree_on_uncommon(spark):
    texts = [t for t in TEXTS if t is not None] + [f"a{chr(o)}" for o in [*range(0x1FFF), 0x2028, 0x3000, 0xFF41, 0xFEFF, 0x1F600] if not 0xD800 <= o < 0xE000]
    got = [r.u for r in rows(spark, texts).orderBy("key").select(C.uncommon("text").alias("u")).collect()]
    assert got == [not is_plain(t) for t in texts]


def test_trie_finds_zero_cost_and_counts_other_edits():
    trie = C.Trie([("hoa", 3), ("hòa", 2), ("вход", 1)])
    assert [s for c, s, _ in trie.search("hοа​") if c == 0] == ["hoa"]
    assert {(c, s) for c, s, _ in trie.search("hoa", 1)} >= {(0, "hoa"), (1, "hòa")}
    assert C.canonical_spelling(trie, "вxод") == "вход" and C.canonical_spelling(trie, "ｚ") == "z"


def test_repeated_rows_have_equal_forms(spark):
    text = unicodedata.normalize("NFD", "Quán cà phê Hoa")
    df = spark.createDataFrame([("t", 1, text, "x")] * 3 + [("t", 1, "Quán cà phê Hoa", "y")], "tab string, key bigint, text string, form string").withColumn("_t0", F.lit(5))
    got = C.canonical(df, "text").collect()
    assert [r.canonical for r in got] == ["Quán cà phê Hoa"] * 4 and {r._t0 for r in got} == {5} and sorted(r.form for r in got) == ["x", "x", "x", "y"]


def test_the_automaton_decides_what_the_table_cannot():
    trie = C.Trie([("lớn", 9), ("In", 4), ("OK", 2)])
    assert look("\u0399ớn") == "Iớn"  # a Greek capital iota: the table knows one twin
    assert C.canonical_spelling(trie, "\u0399ớn") == "lớn"  # only the vocabulary knows which letter is meant
    assert C.canonical_spelling(trie, "\u0399n") == "In" and C.canonical_spelling(trie, "\uff10K") == "OK"
    assert C.canonical_spelling(trie, "\u0399x") == "Ix"


def test_the_automaton_reads_tokens_as_stored():
    trie = C.Trie([("việt", 1), ("ﬁx"[0] + "x", 1), ("cafe", 2)])
    # marks in another order, parted by something invisible
    assert [x[:2] for x in trie.search("vie\u0302\u200b\u0323t")] == [(0, "việt")] == [x[:2] for x in trie.search("vi\u1ec7\u00adt\u200d")]
    assert trie.search("viet") == [] and [x[:2] for x in trie.search("viet", 2)] == [(2, "việt")]
    assert [x[:2] for x in trie.search("ｃаf\u2060e")] == [(0, "cafe")] and [x[0] for x in trie.search("cаf", 1)] == [1] and [x[0] for x in trie.search("cxafe", 1)] == [1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abêệhо", min_size=1, max_size=5), min_size=1, max_size=6), st.text(alphabet="abeệ̂hоо​ｈ", min_size=1, max_size=6))
def test_zero_cost_is_an_equal_look(words, token):
    found = {s for _, s, _ in C.Trie((w, 1) for w in words).search(token)}
    assert found == {w for w in words if look(w) == look(token)}


FORMS = [
    "Tên: Quán phở Mết; Điện thoại: 0123 456 789; Địa chỉ: số 4 đường Hoa",
    "ĐỊA CHỈ: SỐ 4 ĐƯỜNG HOA;TÊN: QUÁN PHỞ MẾT;ĐIỆN THOẠI: 0123 456 789",
    "Điện thoại: 0123456789 | Tên: Quán phở Mết | Địa chỉ: số 4 đường Hoa",
    "Tên: Quán phở Mết\nĐịa chỉ: số 4 đường Hoa\nĐiện thoại: 0123 456 789",
    '{"ten": "Quán phở Mết", "dien_thoai": "0123 456 789", "dia_chi": "số 4 đường Hoa"}',
    '{\n "dia_chi" : "số 4 đường Hoa",\n "TEN" : "QUÁN PHỞ MẾT", "dien_thoai":"0123 456 789"\n}',
]


def test_record_keys():
    keys = [K.record_key(f) for f in FORMS]
    assert len(set(keys[:4])) == 1 and len(set(keys[4:])) == 1 and keys[0] != keys[4]
    assert K.record_key(BASE) == K.record_key(f"\n({BASE.swapcase()}  !!") == K.record_key(VARIANTS[1])
    assert K.record_key(BASE) != K.record_key(BASE + " 👍") and K.record_key("ngắn") is None and K.record_key(None) is None
    a, b = "Câu thứ nhất nói về một quán nhỏ.", "Câu thứ hai nói về một con đường."
    assert K.record_key(f"{a} {b}") != K.record_key(f"{b} {a}")


def brute(texts):
    groups = {}
    for i, t in enumerate(texts):
        k = K.record_key(t)
        if k is not None:
            groups.setdefault(k, []).append(i)
    return {("t", min(g), x) for g in groups.values() for x in g if x != min(g)}


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_runs_across_ranges(spark, parts, monkeypatch):
    r = random.Random(parts)
    texts = [BASE.swapcase() if i % 3 == 0 else r.choice([*FORMS, *VARIANTS, None, "", "x" * 50_000, f"{BASE} {r.randint(0, 4)}"]) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(x) for x in K.copies(rows(spark, texts).withColumn("head", F.lit("x")).withColumn("id", F.lit(9)), "text", "key", "tab").collect()]
        counts = {x.keep_id: x.n_copies for x in K.collapsed(rows(spark, texts), "text", "key", "tab").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert set(got) == brute(texts) and len(got) == len(set(got))
    assert sum(counts.values()) == sum(K.record_key(t) is not None for t in texts)
    assert K.copies(rows(spark, []), "text", "key", "tab").count() == 0


def test_bare_keeps_letters_and_symbols():
    assert bare(" Đây, là: chợ! ") == "đâylàchợ" and bare("a👍") != bare("a")
