import random

import pytest

from ledgerloom.llm import leakage

SYL = ["ba", "ko", "ri", "tem", "sol", "vay", "ny", "dra", "fel", "gu", "hor", "pix", "zum", "lek"]


def word(rng):
    return "".join(rng.choice(SYL) for _ in range(rng.randint(2, 4)))


def texts(rng, n, length):
    return [" ".join(word(rng) for _ in range(length)) for _ in range(n)]


def test_finds_what_a_direct_search_finds(spark):
    rng = random.Random(3)
    items, docs, want = texts(rng, 20, 30), [], set()
    for d in range(120):
        body = word(rng) and [word(rng) for _ in range(40)]
        i, kind = rng.randrange(20), d % 6
        w = items[i].split()
        at = rng.randint(0, 30 - 13)
        part = w[at : at + 13]
        if kind == 0:
            part = [x.upper() for x in part]
        elif kind == 1:
            part = [f"<b>{x}</b>" for x in part]
        elif kind == 2:
            part = [x[:2] + "-\n" + x[2:] for x in part]
        elif kind == 3:
            part = part[:9]
        elif kind == 4:
            rng.shuffle(part)
        elif kind == 5:
            part = [x.replace("o", "0").replace("m", "rn") for x in part]
        if kind in (0, 1, 2, 5):
            want.add((i, d))
        docs.append((d, " ".join([*body[:20], *part, *body[20:]]), "clash"))
    docs += [(500, None, ""), (501, "", ""), (502, "   ", ""), (0, docs[0][1], "")]
    dd = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    ii = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(90, None, "x"), (91, "too short", "x")], "item_id bigint, text string, doc_id string")
    # Broadcast as an index, and joined by hash.
    for most in (leakage.BROADCAST_LETTERS, 0):
        assert {tuple(r) for r in leakage.leaks(dd, ii, most).collect()} == want
    assert leakage.leaks(dd.where("false"), ii).count() == 0 and leakage.leaks(dd, ii.where("false")).count() == 0


def found(index, text):
    return sorted(i for _, k in index.found([text]) for i in index.ids[k])


def around(rng, words):
    return " ".join([*texts(rng, 1, 15), *words, *texts(rng, 1, 15)])


def test_misread_letters_are_aligned():
    rng = random.Random(5)
    items = texts(rng, 30, 40)
    known = leakage.Index.of(list(enumerate(items)))
    for share, least in ((0.03, 97), (0.05, 95), (0.1, 88)):
        hits = 0
        for n in range(100):
            i = rng.randrange(30)
            noisy = ["".join(rng.choice("abcdefg") if rng.random() < share else c for c in w) for w in items[i].split()[5:21]]
            hits += i in found(known, around(rng, noisy))
        assert hits >= least, (share, hits)


def test_equal_items_are_found_together():
    t = " ".join(texts(random.Random(7), 1, 20))
    assert found(leakage.Index.of([(1, t), (2, t), (3, t.upper())]), "elő " + t) == [1, 2, 3]


def test_alignment():
    def align(a, b):
        return leakage.smith_waterman([leakage.codes(a)], [leakage.codes(b)], [len(b)])[0].tolist()

    assert align("abcdef", "xxabcdefyy") == [2, 3, 4, 5, 6, 7]
    assert align("abcdefgh", "zabcXefghz") == [1, 2, 3, 4, 5, 6, 7, 8]
    assert align("aaa", "bbb") == [-1, -1, -1]
    assert align("abcdefgh", "abcdXYefgh") == [0, 1, 2, 3, 6, 7, 8, 9]


def test_pairs_aligned_together_are_aligned_as_alone():
    rng = random.Random(17)
    pairs = [("".join(rng.choice("abcd") for _ in range(rng.randint(5, 60))), "".join(rng.choice("abcd") for _ in range(rng.randint(5, 80))), rng.randint(3, 40)) for _ in range(40)]
    left, right, widths = [leakage.codes(a) for a, _, _ in pairs], [leakage.codes(b) for _, b, _ in pairs], [w for _, _, w in pairs]
    together = [x.tolist() for x in leakage.smith_waterman(left, right, widths)]
    assert together == [leakage.smith_waterman([a], [b], [w])[0].tolist() for a, b, w in zip(left, right, widths)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 50])
def test_a_passage_of_many_items_is_found(n):
    rng = random.Random(13)
    common, own = texts(rng, 1, 20)[0], texts(rng, n, 15)
    known = leakage.Index.of([(i, f"{t} {common}") for i, t in enumerate(own)])
    assert found(known, around(rng, common.split())) == list(range(n))
    assert found(known, around(rng, common.split()[2:15])) == list(range(n))
    assert found(known, around(rng, common.split()[2:10])) == []


def test_shared_passages_are_found_however_items_are_held(spark):
    rng = random.Random(19)
    common = texts(rng, 1, 20)[0].split()
    items = [(i, f"{t} {' '.join(common)}") for i, t in enumerate(texts(rng, 12, 15))] + [(50 + i, t) for i, t in enumerate(texts(rng, 12, 30))]
    docs = [(d, around(rng, common[d % 5 : d % 5 + 13]) if d % 2 else around(rng, items[12 + d % 12][1].split()[3:17])) for d in range(30)]
    dd, ii = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = {(i, d) for d in range(1, 30, 2) for i in range(12)} | {(items[12 + d % 12][0], d) for d in range(0, 30, 2)}
    for most in (leakage.BROADCAST_LETTERS, 0):
        assert {tuple(r) for r in leakage.leaks(dd, ii, most).collect()} == want
        assert {tuple(r)[:2] for r in leakage.scored(dd, ii, most).collect()} >= want


def test_copies_edited_by_words_are_scored(spark):
    rng = random.Random(23)
    items = list(enumerate(texts(rng, 20, 60)))
    docs = [(d, around(rng, [word(rng) if n % 10 == 9 else w for n, w in enumerate(items[d % 20][1].split())])) for d in range(40)]
    docs += [(100 + d, around(rng, [word(rng) if n % 6 == 5 else w for n, w in enumerate(items[d % 20][1].split()[:24])])) for d in range(40)]
    docs += [(200 + d, " ".join(texts(rng, 1, 60))) for d in range(40)]
    got = {(r.doc_id, r.item_id): r for r in leakage.scored(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert sum((d, d % 20) in got for d in range(40)) == 40 and sum((100 + d, d % 20) in got for d in range(40)) >= 38
    assert not [k for k in got if k[0] >= 200]
    assert all(r.words >= 50 and 0.8 <= r.score <= 1 for k, r in got.items() if k[0] < 40)


def test_long_texts():
    rng = random.Random(29)
    long = texts(rng, 1, 6000)[0]
    known = leakage.Index.of([(1, long), (2, texts(rng, 1, 20)[0])])
    noisy = "".join(rng.choice("abcdefg") if c != " " and rng.random() < 0.04 else c for c in long)
    assert found(known, noisy) == [1] and found(known, "a" * 500_000) == []
    words = leakage.words_of(long)
    assert known.scores([noisy])[0, 0][0] > 0.9 * len(words)


def test_markup():
    assert leakage.fold('a<b class="x y" id=1>b</b >c<br/>d&amp;e') == leakage.fold("abcde")
    assert leakage.fold("x <y and all of these words > z") == leakage.fold("xyandallofthesewordsz")
