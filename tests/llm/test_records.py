"""Linked splits and overlaps between splits."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.llm import linked_split as L
from dialoom.llm import split_overlap as S


def test_numbers_in_names(spark):
    names = ["image_76.jpg", "image76.jpg", "IMAGE_76.JPG", "data\\images\\image_76.jpg", "./data/images/image_76.jpg", "batch_88/image_76.webp", "image_76 (8).jpg", "image_76_960x1440.jpg", "image-76.png", " image_76.jpg ", "image_76.jpg?v=4", "image_0076_copy.jpg"]
    df = spark.createDataFrame([(n,) for n in [*names, None, "", "img_76.jpg", "image_x.jpg", "image_99999999999999999999.jpg"]], "image string")
    got = [r.p for r in df.select(L.picture_number().alias("p")).collect()]
    assert got == [76] * len(names) + [None] * 5
    ids = spark.createDataFrame([("12_3",), ("5_6_7",), (None,), ("x_1",), ("9",)], "id string")
    assert [r.i for r in ids.select(L.item_number().alias("i")).collect()] == [12, None, None, None, None]


def brute_groups(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, e in rows:
        if k is not None:
            find(("k", k))
            if e is not None:
                parent[find(("k", k))] = find(("e", e))
    out = defaultdict(set)
    for k, _ in rows:
        if k is not None:
            out[find(("k", k))].add(k)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("kind", ["random", "chain", "star", "nulls", "empty"])
def test_components(spark, kind, monkeypatch):
    monkeypatch.setattr(L, "HOT", 20)
    r = random.Random(4)
    rows = {
        "random": [(r.randint(0, 150), r.choice([None, *range(140)])) for _ in range(180)],
        "chain": [(i, i) for i in range(70)] + [(i, i + 1) for i in range(70)],
        "star": [(i, 7) for i in range(300)] + [(500, 8), (500, None)],
        "nulls": [(None, 1), (1, None), (2, None), (None, None)],
        "empty": [],
    }[kind]
    df = spark.createDataFrame(rows, "item long, pic long").withColumn("component", F.lit(0)).withColumn("u", F.lit(1))
    got = defaultdict(list)
    for x in L.groups(df, "item", "pic").collect():
        got[x.component].append(x.item)
    assert sorted(map(sorted, got.values())) == brute_groups(rows)
    assert all(k == min(v) for k, v in got.items())
    if kind == "random":
        pairs = {(x.a, x.b) for x in L.linked_pairs(L.groups(df, "item", "pic"), "item").collect()}
        assert pairs == {p for g in brute_groups(rows) for p in itertools.combinations(g, 2)}


def test_flow_is_optimal():
    from itertools import product

    r = random.Random(2)
    for _ in range(30):
        cost = [[r.randint(-5, 9) for _ in range(3)] for _ in range(3)]
        supply, room = [r.randint(1, 2) for _ in range(3)], [2, 2, 2]
        g = L.Flow(8)
        for i in range(3):
            g.arc(0, 2 + i, supply[i], 0)
            for j in range(3):
                g.arc(2 + i, 5 + j, supply[i], cost[i][j])
        for j in range(3):
            g.arc(5 + j, 1, room[j], 0)
        units = [i for i in range(3) for _ in range(supply[i])]
        want = min(sum(cost[i][j] for i, j in zip(units, a)) for a in product(range(3), repeat=len(units)) if all(a.count(j) <= room[j] for j in range(3)))
        assert g.run(0, 1) == want


def test_allocation_meets_quotas():
    r = random.Random(1)
    bundles = [(s, x, r.randint(1, 30)) for s in range(1, 12) for x in "abc"]
    shares = [0.8, 0.1, 0.1]
    got = L.allocate(bundles, shares)
    assert all(sum(g) == n for g, (_, _, n) in zip(got, bundles))
    total = sum(s * n for s, _, n in bundles)
    for j, p in enumerate(shares):
        assert abs(sum(s * g[j] for g, (s, _, _) in zip(got, bundles)) - p * total) <= 2
    assert L.allocate([], shares) == [] and sum(map(sum, L.allocate([(5, "a", 1)], shares))) == 1


def test_assignment(spark):
    r = random.Random(6)
    rows = [(i, r.randint(0, 400) if r.random() > 0.02 else None, r.choice([None, r.randint(0, 900)]), r.choice(["a", "b", None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "row_id long, item long, pic long, kind string").withColumn("split", F.lit("x")).withColumn("_k", F.lit(1))
    got = {x.row_id: x.split for x in L.assign(df, "row_id", "item", "pic", "kind", {"train": 0.7, "test": 0.3}).collect()}
    assert len(got) == 2000
    of = {i: k for i, k, *_ in rows}
    for g in brute_groups([(k, e) for _, k, e, _ in rows]):
        assert len({got[i] for i in of if of[i] in g}) == 1
    sizes = Counter(of[i] is None or True for i in got)
    largest = max(sum(1 for i in of if of[i] in g) for g in map(set, brute_groups([(k, e) for _, k, e, _ in rows])))
    assert abs(Counter(got.values())["train"] - 1400) <= max(3, largest) and sizes
    assert L.assign(df.limit(0), "row_id", "item", "pic", "kind").count() == 0


A = "Khách muốn đặt hàng ở Tiệm tóc Gễn Môi Xứa có thể gọi số 0393 124 817 mỗi ngày trong tuần."
PAIRS = [  # question, answer, question, answer, whether they are the same record
    ("Giá bao nhiêu?", "Giá 115.000 đồng.", "Giá bao nhiêu?", "GGiá 115.000 đồng!", True),
    ("Giá bao nhiêu?", "Giá 115.000 đồng.", "Giá bao nhiêu?", "Giá 116.000 đồng.", False),
    ("Đây là đâu?", "Đây là khu chợ.", "Bạn ơi, đây là đâu vậy?", "Thưa bạn, đây là khu chợ ạ.", True),
    ("Đây là đâu?", A, "đây là đâu", A.upper(), True),
    ("Đây là đâu?", A, "Day la dau?", "Khach muon dat hang o Tiem toc Gen Moi Xua co the goi so (0393) 124817 moi ngay trong tuan.", True),
    ("Đây là đâu?", A, "Đây là đâu?", A.replace("Gễn Môi", "Bết Nhẩm"), False),
    ("Đây là đâu?", A, "Biển màu gì?", A, False),
    ("Bao nhiêu xe?", "8", "Bao nhiêu xe?", "8 ạ", True),
    ("Bao nhiêu xe?", "8", "Bao nhiêu xe?", "9", False),
    ("Thông tin?", "Tên: Mết; Địa chỉ: số 9; Điện thoại: 0123", "Thông tin?", "địa chỉ: số 9 | điện thoại: 0123 | tên: mết", True),
    ("Có giá không?", "Trà đào có giá 454.000 đồng một phần.", "Có giá không?", "Trà đào giá là 454.000 đồng một phần.", True),
    ("Chữ gì?", "Là câu Dân Vân.", "Chữ gì?", "Là câu Vân Dân.", True),
]


@pytest.mark.parametrize("q1,a1,q2,a2,same", PAIRS)
def test_same_record(q1, a1, q2, a2, same):
    ws = [S.question_words("<image>\n" + q1), S.normal_words(a1), S.question_words(q2), S.normal_words(a2)]
    assert S.same_record(*ws) == same == S.same_record(*ws[2:], *ws[:2])


@pytest.mark.parametrize("x,y,same", [("trên", "trrên", True), ("dòng", "dnòg", True), ("học", "hc", True), ("vân", "tân", False), ("12", "112", False), ("a", "b", False)])
def test_slips(x, y, same):
    assert S.slip(x, y) == same


def test_signatures_estimate_jaccard():
    r = random.Random(3)
    x = {str(r.random()) for _ in range(300)}
    y = set(list(x)[:200]) | {str(r.random()) for _ in range(100)}
    m = S._Minwise(256, 5, most=450)  # the table is emptied in between
    (a, plain), (b, _) = m.of(x), m.of(y)
    assert abs((a == b).mean() - S.jaccard(x, y)) < 0.12 and (m.of(x)[0] == a).all() and sorted(plain) == sorted(map(S._hash, x))
    assert S._fold(np.zeros(2, np.uint64), np.stack([a, b]), 4, 20).shape == (2, 20)


def test_bitmaps_bound_the_similarity():
    r = random.Random(8)
    for _ in range(200):
        x = {str(r.randrange(300)) for _ in range(r.randrange(1, 200))}
        y = {str(r.randrange(300)) for _ in range(r.randrange(1, 200))} | set(r.sample(sorted(x), len(x) // 2))
        bx, by = (int.from_bytes(row.tobytes(), "little") for row in S._bitmaps([np.array(list(map(S._hash, z))) for z in (x, y)]))
        assert (len(x) - (bx & ~by).bit_count()) / (len(x) + (by & ~bx).bit_count()) >= S.jaccard(x, y)


def test_overlaps_against_brute_force(spark):
    r = random.Random(9)
    syllables = "Gễn Môi Xứa Bết Nhẩm Hụy Soa Trinh Lụy Vân Ngạc Bẩm".split()

    def record():
        name = " ".join(r.choice(syllables) for _ in range(3))
        return r.choice(["Đây là đâu?", "Số nào?"]), f"Theo tấm biển, Khách sạn {name} có địa chỉ tại số {r.randint(1, 999)} đường {r.choice(syllables)} gần trung tâm {r.choice(syllables)}."

    def changed(q, a):
        i = r.randrange(5, len(a) - 5)
        kind = r.randrange(5)
        return q, [a, a.upper(), a.replace("tấm biển", "tấm  biển "), "Dạ, " + a, a[:i] + a[i + 1] + a[i] + a[i + 2 :] if a[i].isalpha() and a[i + 1].isalpha() and a[i].islower() else a][kind]

    base = [record() for _ in range(120)]
    train = [(i, r.choice([i // 3, None]), "<image>\n" + q, a) for i, (q, a) in enumerate(base)] + [(200, 1, None, "x"), (201, 1, "q", None), (202, None, "", ""), (203, 7, "Bao nhiêu?", "8"), (204, 7, "Bao nhiêu?", "8")]
    held = [(1000 + i, r.choice([i // 3, 999, None]), *changed(*base[i])) for i in range(0, 120, 2)] + [(2000, 1, None, None), (2001, 7, "Bao nhiêu?", "8 ạ"), (2002, 8, "Bao nhiêu?", "8")]
    schema = "key long, picture long, question string, answer string"
    t, v = (spark.createDataFrame(x, schema).withColumn("cid", F.lit(1)).withColumn("bucket", F.lit("b")) for x in (train, held))
    got = {(x.train_key, x.held_out_key) for x in S.overlaps(t, v).collect()}
    norm = lambda rows: {k: (p, S.question_words(q or ""), S.normal_words(a or ""), len(a or "")) for k, p, q, a in rows}
    nt, nv = norm(train), norm(held)
    want = {(x, y) for x, (p, q, a, n) in nt.items() for y, (p2, q2, a2, n2) in nv.items() if ((p is not None and p == p2) or (n >= 70 and n2 >= 70)) and S.same_record(q, a, q2, a2)}
    assert want <= got | set() and got <= want and len(want) > 50
    assert (203, 2001) in got and (204, 2001) in got and (203, 2002) not in got
    assert S.overlaps(t.limit(0), v).count() == 0 and S.overlaps(t, v.limit(0)).count() == 0
    again = S.Overlap(t.unionByName(t.where("key > 200")), v, crowd=5)  # crowded buckets, repeated rows
    rows = [(x.train_key, x.held_out_key) for x in again.pairs().collect()]
    assert set(rows) == got and len(rows) == len(got) + sum(x > 200 for x, _ in got)
    report = again.report(v.withColumn("split", F.lit("val")), "key", ["split"]).first()
    assert report.n_pairs == len(rows) and report.n_records == len({y for _, y in got})
    members = [(x.side, x.key, x["class"]) for x in again.members().collect()]
    classes = [(x.train_class, x.held_out_class) for x in again.class_pairs().collect()]
    assert len(set(classes)) == len(classes)
    assert sorted(rows) == sorted((k, y) for c, d in classes for side, k, m in members if side == "train" and m == c for side2, y, n in members if side2 == "held_out" and n == d)


def test_a_hot_short_text_meets_only_within_its_picture(spark):
    """A third of all rows share one short text, over many pictures; no pair across pictures."""
    schema = "key long, picture long, question string, answer string"
    train = spark.createDataFrame([(i, i % 50, "Có ai không?", "Không có ai.") for i in range(600)] + [(1000 + i, i, "Tên gì?", f"Chợ {i}") for i in range(1200)], schema)
    held = spark.createDataFrame([(5000 + i, i % 100, "Có ai không", "không có ai") for i in range(100)], schema)
    rows = S.overlaps(train, held, crowd=20).collect()
    assert len(rows) == len(set(rows)) == 600 and all((x.held_out_key - 5000) % 100 == x.train_key % 50 for x in rows)


def test_large_picture_numbers_and_null_keys(spark):
    schema = "key long, picture long, question string, answer string"
    big = 2**53
    train = spark.createDataFrame([(big + 1, big + 1, "Có ai không?", "Không có ai."), (2, big, "Có ai không?", "Không có ai."), (None, big, "Có ai không?", "Không có ai."), (4, None, "Có ai không?", "Không có ai.")], schema)
    held = spark.createDataFrame([(big + 3, big, "Có ai không", "không có ai"), (big + 5, big + 1, "Có ai không", "không có ai"), (None, big, "Có ai không", "không có ai"), (8, None, None, None)], schema)
    assert {tuple(x) for x in S.overlaps(train, held).collect()} == {(2, big + 3), (big + 1, big + 5)}


def test_unstated_accents_count():
    assert not S.same_words("nước Đỏ ở chợ Lê".casefold().split(), "nước Đo ở chợ Lề".casefold().split())


def test_copies_of_a_common_text_meet_without_a_picture(spark):
    base = "Theo tấm biển phía trên, quán bánh cuốn nóng mở cửa phục vụ khách từ sáng sớm đến chiều tối mỗi ngày trong tuần".split()
    r = random.Random(3)

    def copy():
        ws = list(base)
        for i in r.sample([i for i, w in enumerate(ws) if len(w) > 3], 2):
            j = r.randrange(1, len(ws[i]))
            ws[i] = ws[i][:j] + ws[i][j - 1] + ws[i][j:]
        return " ".join(ws) + "."

    train = [(i, None, "Quán này bán gì?", copy()) for i in range(1000)] + [(2000, 5, "Quán này bán gì vậy?", " ".join(base))]
    held = [(5000 + i, None, "Quán này bán gì?", copy()) for i in range(20)] + [(6000, 6, "Bạn ơi, quán này bán gì nhỉ?", " ".join(base))]
    schema = "key long, picture long, question string, answer string"
    got = {(x.train_key, x.held_out_key) for x in S.overlaps(spark.createDataFrame(train, schema), spark.createDataFrame(held, schema)).collect()}
    words = lambda rows: [(k, S.question_words(q), S.normal_words(a)) for k, _, q, a in rows]
    want = {(x, y) for x, q, a in words(train) for y, q2, a2 in words(held) if S.same_record(q, a, q2, a2)}
    assert len(want) > 15_000 and got <= want and len(got) >= 0.99 * len(want)
    crowded = S.overlaps(spark.createDataFrame(train, schema), spark.createDataFrame(held, schema), crowd=100)
    assert len(want - {(x.train_key, x.held_out_key) for x in crowded.collect()}) <= 0.01 * len(want)
    assert (2000, 6000) in got


def test_two_slips_in_a_record_without_a_picture(spark):
    r = random.Random(11)
    letters = "bcdghklmnt"
    word = lambda: r.choice(letters) + r.choice("aeiou") + r.choice("nmt")
    answers = [f"Theo tấm biển phía trước cửa, tiệm khoa {word()} {word()} bắt đầu mở bán những món giò gia truyền vào trời tối tại đường {word()} {word()}." for _ in range(400)]
    edits = [("khoa", "kh oa"), ("giò", "g iò"), ("vào trời", "và o t rời"), ("trước", "trưcớ"), ("truyền", "truyềnn"), ("bắt đầu ", "")]

    def changed(a):
        for x, y in r.sample(edits, 2):
            a = a.replace(x, y)
        return a

    schema = "key long, picture long, question string, answer string"
    train = [(i, None, "Tiệm bán gì?", a) for i, a in enumerate(answers)]
    held = [(1000 + i, 9, "Tiệm bán gì?", changed(a)) for i, a in enumerate(answers)]
    got = {(x.train_key, x.held_out_key) for x in S.overlaps(spark.createDataFrame(train, schema), spark.createDataFrame(held, schema)).collect()}
    norm = lambda q, a: (S.question_words(q), S.normal_words(a))
    want = {(i, 1000 + i) for i in range(400) if S.same_record(*norm(*train[i][2:]), *norm(*held[i][2:]))}
    assert len(want) > 200 and len(want - got) <= 0.01 * len(want)


def test_small_components_make_up_for_a_large_one():
    small = [(s, x, n) for s, n in ((1, 900), (2, 700), (3, 500), (7, 100)) for x in "abc"]
    third = sum(s * n for s, _, n in small) // 2
    bundles = [*small, (third, "a", 1)]
    got = L.allocate(bundles, [0.8, 0.1, 0.1])
    assert all(sum(g) == n and min(g) >= 0 for g, (_, _, n) in zip(got, bundles))
    total = sum(s * n for s, _, n in bundles)
    for j, p in enumerate([0.8, 0.1, 0.1]):
        assert abs(sum(s * g[j] for g, (s, _, _) in zip(got, bundles)) - p * total) <= 2


def test_records_without_a_key_go_with_their_picture(spark):
    rows = [(i, i, i, "a") for i in range(300)] + [(1000 + i, None, i, "a") for i in range(300)]
    rows += [(2000 + i, None, 5000 + i // 2, "b") for i in range(200)] + [(3000 + i, None, None, "b") for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, item long, pic long, kind string")
    got = {x.row_id: x.split for x in L.assign(df, "row_id", "item", "pic", "kind").collect()}
    assert len(got) == len(rows)
    assert all(got[i] == got[1000 + i] for i in range(300)) and all(got[2000 + i] == got[2001 + i] for i in range(0, 200, 2))


def test_large_and_textual_keys(spark):
    base = [2**53, 2**60, 2**62, -(2**62)]
    rows = [(i + d, g) for g, i in enumerate(base) for d in (0, 1)] + [(i + 2, None) for i in base]
    df = spark.createDataFrame(rows, "item long, pic long")
    got = {r.item: r.component for r in L.groups(df, "item", "pic").collect()}
    assert got == {i + d: i + (2 if d == 2 else 0) for i in base for d in (0, 1, 2)}
    text = spark.createDataFrame([("a", "p"), ("b", "p"), ("b", "q"), ("c", "q"), ("d", None), ("d", "r")], "item string, pic string")
    assert {r.item: r.component for r in L.groups(text, "item", "pic").collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}
    keys = spark.createDataFrame([("12_3",), ("x_1",), ("_1",), (None,), ("007_2",)], "id string").select(L.item_key().alias("k"))
    assert [r.k for r in keys.collect()] == ["12", "x", None, None, "7"]


def test_pairs_of_a_large_component_are_spread(spark):
    members = spark.createDataFrame([(i, 0 if i < 50 else i) for i in range(60)], "item long, component long")
    got = L.linked_pairs(members, "item", part=7).collect()
    assert sorted((r.a, r.b) for r in got) == list(itertools.combinations(range(50), 2))


def test_mixed_profiles_keep_all_quotas():
    r = random.Random(2)
    bundles = []
    for s in (1, 2, 3, 5, 8):
        for p in {tuple(sorted(Counter(r.choices("abc", k=s)).items())) for _ in range(6)}:
            bundles.append((s, dict(p), r.randrange(20, 200)))
    got = L.allocate(bundles, [0.8, 0.1, 0.1])
    assert all(sum(g) == n and min(g) >= 0 for g, (_, _, n) in zip(got, bundles))
    total = sum(s * n for s, _, n in bundles)
    for j, p in enumerate([0.8, 0.1, 0.1]):
        assert abs(sum(s * g[j] for g, (s, _, _) in zip(got, bundles)) - p * total) <= 1
        for label in "abc":
            of = [c.get(label, 0) for _, c, _ in bundles]
            assert abs(sum(c * g[j] for g, c in zip(got, of)) - p * sum(c * n for c, (_, _, n) in zip(of, bundles))) <= 8


def test_few_profiles_and_labels_still_meet_the_quotas(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT", 7)  # every component of more records is spread
    r = random.Random(6)
    rows = [(i, r.randrange(500), None, f"l{r.randrange(40)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, item long, pic long, kind string")
    got = {x.row_id: x.split for x in L.assign(df, "row_id", "item", "pic", "kind", profiles=2, labels=3).collect()}
    assert len(got) == 3000 and all(len({got[i] for i, k, *_ in rows if k == item}) == 1 for item in {k for _, k, *_ in rows})
    assert abs(Counter(got.values())["train"] - 2400) <= 1
