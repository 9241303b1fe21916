"""Leaks, packing, chunking, token sizes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.llm import chunking, leakage, packing
from dialoom.llm.token_sizes import Sizer


def test_sizes_are_exact():
    s, r = Sizer.get(), random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("ab \n\r\tđ.1'\xa0ệ") for _ in range(r.randint(0, 14)))
        assert s.size(t) == s.exact(t), repr(t)
    assert s.sizes([None, ""]) == [0, 0]


# ---------------------------------------------------------------- leaks

R = random.Random(5)
SYLLABLES = [a + b for a in "b ch d g kh l m n ph qu s t th v x".split() for b in "an em inh oi ung ap e".split()]


def sentence(n=30):
    return " ".join(R.choice(SYLLABLES) for _ in range(n)) + "."


ITEMS = {i: f"Đọc đoạn văn sau rồi trả lời: {sentence()} {sentence()} Hỏi: đúng hay sai?" for i in range(12)}


def alter(ws, every):
    return [("zzz" if i % every == every - 1 else w) for i, w in enumerate(ws)]


def test_leaks(spark):
    ws = {i: leakage.passages(ITEMS)[i] for i in ITEMS}
    assert len(ws[0]) == 60 and "hoi" not in ws[0]
    rest = lambda: sentence(40)
    docs = {
        1: f"{rest()} {' '.join(ws[3][10:40])} {rest()}",
        2: f"{rest()} {' '.join(ws[3][10:40])} {rest()}".upper(),
        3: " ".join(alter(ws[4][5:45], 10)),
        4: " ".join(ws[5][:14]) + " " + rest(),
        5: rest() * 50,
        6: None,
        7: "",
        8: "Đọc đoạn văn sau rồi trả lời: Hỏi: đúng hay sai?",
        9: " ".join(ws[6][:20] + ws[6][21:50]),
        10: (rest() + " ") * 400 + " ".join(ws[7][:25]),
        11: " ".join(ws[8][:18]),
        12: " ".join(alter(ws[9][:40], 3)),
        13: ws[1][0],
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    items = spark.createDataFrame([*ITEMS.items(), (900, None), (901, "ngắn"), (902, "")], "item_id bigint, text string")
    want = {(3, 1), (3, 2), (4, 3), (6, 9), (7, 10), (8, 11)}
    out = leakage.leaks(df, items)
    assert {(r.item_id, r.doc_id) for r in out.collect()} == want and out.count() == len(want)
    assert leakage.leaks(df.limit(0), items).count() == 0 and leakage.leaks(df, items.limit(0)).count() == 0
    # items in several blocks and parts
    assert {(r.item_id, r.doc_id) for r in leakage.leaks(df, items, block_chars=3000).collect()} == want


@pytest.mark.parametrize("sharing", [1, 2, 3, 5, 30])
def test_a_passage_that_items_share_leaks_for_all_of_them(spark, sharing):
    shared = f"{sentence()}. {sentence()}. {sentence()}."
    ask = ["Hỏi: đúng hay sai?", "Hỏi: ở đâu?", "Hỏi: vì sao?", "Hỏi: bao giờ?", "Hỏi: ai nói?"]
    items = [(i, f"Đọc đoạn văn sau: {shared} {ask[i % 5]}") for i in range(sharing)]
    items += [(100 + i, f"{'Đọc đoạn văn sau: ' if i % 2 else ''}{sentence()}. {sentence()}. {ask[i % 5]}") for i in range(100)]
    ws = leakage.passages(dict(items))
    assert all(len(ws[i]) == 90 for i in range(sharing)) and all(len(ws[100 + i]) == 60 for i in range(100))
    docs = spark.createDataFrame([(1, "x " * 30 + shared), (2, " ".join(alter(ws[0][20:60], 10)))], "doc_id bigint, text string")
    got = {(r.item_id, r.doc_id) for r in leakage.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(i, d) for i in range(sharing) for d in (1, 2)}


def test_long_items_take_linear_time():
    words = [f"w{i % 997}" for i in range(60_000)]
    ix = leakage._Index({1: words}, None, None, 3, 4, 18, 0.14, 0.45)
    assert ix.search([" ".join(words[30_000:30_400]), " ".join(words)], leakage._Ids(ix.vocabulary)) == [(0, 1), (1, 1)]


def test_every_shared_run_has_a_common_fingerprint():
    ix = leakage._Index({i: w for i, w in leakage.passages(ITEMS).items()}, None, 12, 3, 4, 18, 0.14, 0.45)
    r = np.random.default_rng(1)
    for _ in range(300):
        run = r.integers(0, 50, 6)
        a, b = (np.concatenate([r.integers(0, 50, 9), run, r.integers(0, 50, 9)]) for _ in range(2))
        rank = lambda x: leakage._mix(ix._grams(x))
        kept = [set(ix._grams(x)[ix._kept(rank(x))].tolist()) for x in (a, b)]
        assert kept[0] & kept[1]


# ---------------------------------------------------------------- packing


def texts():
    r = random.Random(2)
    out = [" ".join(r.choice(SYLLABLES) for _ in range(int(r.lognormvariate(3.5, 1.2)) + 1)) for _ in range(400)]
    return [*out, None, "", " ", "x" * 5000, "chữ " * 3000, *out[:30]]


def test_packing(spark):
    data = list(enumerate(texts()))
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("tokens", F.lit("t")).withColumn("rank", F.lit(0))
    rows = packing.pack(df, capacity=200, buckets=32).collect()
    used, sizer, of = {}, Sizer.get(), {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.tokens
        of.setdefault(r.doc_id, []).append((r.start, r.end, r.tokens))
    assert max(used.values()) <= 200
    for k, t in data:
        if not t:
            assert k not in of
            continue
        parts = sorted(of[k])
        assert "".join(t[a:b] for a, b, _ in parts) == t
        assert all(sizer.exact(t[a:b]) == n for a, b, n in parts)
        assert len(parts) == 1 or sizer.exact(t) > 200
    fill = packing.fill(packing.pack(df, capacity=200, buckets=32), 200).first()
    assert fill.containers == len(used) and fill.fill > 0.93
    assert packing.pack(df.limit(0)).count() == 0


def test_containers_of_few_tokens_and_many_characters_are_full():
    sizer = Sizer.get()
    text = " " * 40_000  # many characters a token
    got = packing.split_text(sizer, text, 50)
    assert "".join(text[a:b] for a, b, _ in got) == text and all(n <= 50 for *_, n in got)
    parts = packing._inside(sizer, text, 0, len(text), 50)
    assert all(sizer.exact(text[a:b]) >= 45 for a, b in parts[:-1])


def test_bounds_of_a_large_capacity():
    h = {s: 1_000_000 // s for s in range(1, 20_000)}
    assert len(packing.best_bounds(h, 64)) == 64


@pytest.mark.parametrize("buckets", [1, 2, 3, 5, 9])
def test_bounds_are_optimal(buckets):
    from itertools import combinations

    r = random.Random(buckets)
    h = {s: r.randint(1, 9) for s in r.sample(range(1, 60), 9)}
    sizes = sorted(h)
    padding = lambda bounds: sum(n * (min(b for b in bounds if b >= s) - s) for s, n in h.items())
    got = packing.best_bounds(h, buckets)
    want = min(padding([*c, sizes[-1]]) for k in range(buckets) for c in combinations(sizes[:-1], k))
    assert len(got) <= buckets and padding(got) == want


def test_recipes_use_everything():
    r = random.Random(1)
    for _ in range(50):
        bounds = sorted(r.sample(range(1, 101), 12))
        counts = [r.randint(0, 40) for _ in bounds]
        left = list(counts)
        for times, used in packing.recipes(bounds, counts, 100):
            assert sum(n * bounds[b] for b, n in used.items()) <= 100
            for b, n in used.items():
                left[b] -= times * n
        assert left == [0] * 12


# ---------------------------------------------------------------- chunking

ESSAY = "\n\n".join(f"# Phần {i}\n" + "\n".join(" ".join(R.choice(SYLLABLES) for _ in range(R.randint(5, 60))) + "." for _ in range(6)) for i in range(25))


@pytest.mark.parametrize("text", [ESSAY, "x" * 9000, "不" * 4000, "chữ " * 4000, "a\r\n" * 3000, " " * 5000, "\n" * 5000, "số 1. 2. 3. " * 900])
def test_pieces_cover_and_fit(text):
    s = Sizer.get()
    got = chunking.cut(text, chunking._Units(s), 512, 160, 64)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for a, b, kind, n in got:
        assert n == s.exact(text[a:b]) <= 512 and a < b
    for (a, b, *_), (a2, b2, *_) in zip(got, got[1:]):
        assert a < a2 <= b < b2
        assert s.exact(text[a2:b]) <= 64 + 8


@pytest.mark.parametrize("most,least,overlap", [(64, 24, 8), (100, 40, 16), (128, 40, 16), (512, 160, 64)])
def test_small_limits_hold(most, least, overlap):
    u = chunking._Units(Sizer.get())
    for text in (" ".join("😀𝒳𝕐🜁" * 27 + "x" for _ in range(40)), "𠀀" * 5000, ESSAY, " ".join("ǣ" * n for n in range(1, 118)), "x" * 119 + " " + ESSAY):
        got = chunking.cut(text, u, most, least, overlap)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(b[0] <= a[1] for a, b in zip(got, got[1:]))
        assert all(n == u.sizer.exact(text[a:b]) <= most for a, b, _, n in got)


def test_natural_boundaries_first():
    got = chunking.cut(ESSAY, chunking._Units(Sizer.get()), 512, 160, 64)
    kinds = [chunking.KINDS[k] for *_, k, _ in got[:-1]]
    assert len(kinds) > 5 and set(kinds) <= {"heading", "paragraph", "line", "sentence"}


def test_an_edit_changes_few_pieces():
    u = chunking._Units(Sizer.get())
    before = {ESSAY[a:b] for a, b, *_ in chunking.cut(ESSAY, u, 512, 160, 64)}
    p = len(ESSAY) // 2
    edited = ESSAY[:p] + " thêm vài chữ " + ESSAY[p:]
    after = [edited[a:b] for a, b, *_ in chunking.cut(edited, u, 512, 160, 64)]
    assert sum(x not in before for x in after) <= 5 < len(after)


def test_pieces_of_a_table(spark):
    df = spark.createDataFrame([(1, ESSAY), (2, None), (3, ""), (4, "ngắn"), (4, "ngắn")], "doc_id bigint, text string").withColumn("piece", F.lit("p"))
    rows = chunking.pieces(df).collect()
    assert {r.doc_id for r in rows} == {1, 4} and sum(r.doc_id == 4 for r in rows) == 2
    mine = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.piece)
    assert [r.piece for r in mine] == list(range(len(mine))) and all(ESSAY[r.start : r.end] == r.text for r in mine)
    assert chunking.pieces(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chunking.pieces(df, most=100, least=90, overlap=20)


def test_null_keys_are_left_out_and_large_ones_kept(spark):
    text = " ".join(leakage.passages(ITEMS)[3])
    docs = spark.createDataFrame([(2**53 + 1, text), (None, text)], "doc_id bigint, text string")
    assert [r.doc_id for r in leakage.leaks(docs, spark.createDataFrame(list(ITEMS.items()), "item_id bigint, text string")).collect()] == [2**53 + 1]
    assert {r.doc_id for r in chunking.pieces(docs).collect()} == {2**53 + 1} == {r.doc_id for r in packing.pack(docs).collect()}
