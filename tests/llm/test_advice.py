"""Places where an operator did less than its whole job."""

import hashlib
import random

import numpy as np

from veilframe.llm import mixing, neardup, passages, suffixes


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_verify_keeps_wide_gaps():
    """A long edit in the middle does not part a passage that is alike as a whole; stray matches around it do not either."""
    shingles = np.arange(400, dtype=np.int64)
    for n, edited in ((91, 13), (100, 12)):
        own, other = shingles[:n].copy(), shingles[:n].copy()
        at = (n - edited) // 2
        other[at : at + edited] += 1000
        (found,) = passages.verify(own, other, 46, 75)
        assert found[:4] == (0, n, 0, n) and abs(found[4] - (n - edited) / (n + edited)) < 1e-9
        stray = lambda x, k: np.concatenate([[7000], np.arange(k, k + 11), x, np.arange(k + 20, k + 31), [7001]])
        assert [f[:4] for f in passages.verify(stray(own, 5000), stray(other, 6000), 46, 75)] == [(12, 12 + n, 12, 12 + n)]


def test_every_place_of_a_tied_minimum():
    """All places of a minimum have a window; in periodic stretches one for each ``least`` tokens is enough."""
    rng = np.random.default_rng(1)
    copy = rng.integers(10, 1 << 40, 20).astype(np.uint64)
    copy[7] = 1
    values = np.concatenate([np.concatenate([copy, rng.integers(10, 1 << 40, k).astype(np.uint64)]) for k in (3, 8, 5, 2)])
    l, c, r, inner = passages.every_window(values, np.array([0, len(values)]), 15)
    assert sorted(c[values[c] == 1].tolist()) == np.flatnonzero(values == 1).tolist() and not inner.any()
    for period in (1, 4):
        values = np.tile(np.arange(1, period + 1, dtype=np.uint64), 400 // period)
        l, c, r, inner = passages.every_window(values, np.array([0, 400]), 15)
        places = np.sort(c[(l == 0) & (r == 399)])
        assert places[0] == 0 and places[-1] == 400 - period and np.diff(places).max() <= 15 and len(places) <= 402 // (15 - period) + 2


def test_middle_copies_and_other_places(spark):
    """Copies of a passage close together are all reported, in the document that has them and in a longer one."""
    rng = random.Random(21)
    text = lambda n: [f"m{rng.randrange(100_000)}" for _ in range(n)]
    docs = []
    for _ in range(8):
        passage = text(50)
        docs += [text(20) + passage + text(20), [w for _ in range(3) for w in (*passage, *text(1))]]
    rows = passages.find_passages(frame(spark, [" ".join(d) for d in docs])).collect()
    spans = {(r["doc_id"], r["start"], r["end"]) for r in rows}
    lost = [(d, k) for d in range(1, 16, 2) for k in range(3) if not any(i == d and a <= 51 * k and 51 * k + 50 <= b for i, a, b in spans)]
    assert not lost


def test_hot_phrases_hide_no_passage(spark):
    """Documents that share a passage of stock phrases find each other among lower and higher ids that hold a phrase each."""
    rng = random.Random(31)
    text = lambda n: [f"h{rng.randrange(100_000)}" for _ in range(n)]
    docs, wanted = [text(60) for _ in range(3)], []
    for _ in range(6):
        phrases = [text(10) for _ in range(5)]
        single = lambda: [text(40) + p + text(40) for p in phrases for _ in range(2)]
        passage = sum(phrases, [])
        low, high = single(), single()
        wanted.append((len(docs) + len(low), len(docs) + len(low) + 1))
        docs += [*low, text(30) + passage + text(30), text(45) + passage + text(20), *high]
    found = {frozenset((r["doc_id"], r["source_doc_id"])) for r in passages.find_passages(frame(spark, [" ".join(d) for d in docs])).collect()}
    assert found == set(map(frozenset, wanted))


def test_links_between_inner_documents(spark):
    """Of a - x - y - b, each one edit from the next, x and y are joined though neither is like the other's centre."""
    fresh = iter(range(1_000_000))
    text = lambda n: [f"i{next(fresh)}" for _ in range(n)]
    rng, docs = random.Random(61), []
    for _ in range(12):
        chain = [text(55)]
        for at in rng.sample(range(5, 50, 9), 3):
            chain.append(chain[-1][:at] + text(1) + chain[-1][at + 1 :])
        docs += [text(20) + p + text(20) for p in chain]
    found = {(r["doc_id"], r["source_doc_id"]) for r in passages.find_passages(frame(spark, [" ".join(d) for d in docs])).collect()}
    assert not [k for k in range(0, len(docs), 4) if not {(k, k + 1), (k + 1, k + 2), (k + 2, k + 3)} <= found]


def test_maps_bound_matches():
    """A map leaves out no pair: the places that match are at most those held but for the bits that the other lacks."""
    rng = np.random.default_rng(8)
    own = rng.integers(0, 1 << 40, 400).astype(np.uint64)
    for edited in (0, 40, 200):
        other = own.copy()
        other[rng.choice(400, edited, replace=False)] += np.uint64(1 << 50)
        for at in (0, 10, 200, 399):
            (x, held), (y, _) = (passages.shingle_maps(t, np.array([0, 400]), np.array([at])) for t in (own, other))
            lacks = int(np.bitwise_count(x & ~y).sum())
            around = slice(max(0, at - passages.AROUND), at + passages.AROUND)
            assert (own[around] == other[around]).sum() <= held[0] - lacks <= held[0] == len(own[around])


def test_stock_paragraphs_make_no_pairs(spark, monkeypatch):
    """Documents that share less than a passage are told apart within their group: few of their pairs are verified."""
    rng = random.Random(71)
    text = lambda n: [f"p{rng.randrange(1_000_000)}" for _ in range(n)]
    stock, keep, rows = text(40), passages.Scratch.keep, {}

    def counted(self, df, name):
        out = keep(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(passages.Scratch, "keep", counted)
    docs = [text(60) + stock + text(60) for _ in range(80)]
    passage = text(55)
    docs[30][60:100], docs[50][60:100] = passage, passage[:20] + text(1) + passage[21:]
    found = {(r["doc_id"], r["source_doc_id"]) for r in passages.find_passages(frame(spark, [" ".join(d) for d in docs])).collect()}
    assert found == {(30, 50), (50, 30)}
    assert sum(n for name, n in rows.items() if name.endswith("-votes")) <= len(docs) ** 2 / 4, rows


def test_likely_pairs_lose_no_passage():
    """All rows of a value whose own side holds a passage with another's are pairs, whatever the edits, shifts and repeats."""
    rng = np.random.default_rng(9)
    texts = []
    for n, kinds in ((70, 1 << 40), (46, 1 << 40), (64, 9)):
        base = rng.integers(0, kinds, n).astype(np.uint64)
        for _ in range(12):
            own = base.copy()
            own[rng.choice(n, rng.integers(0, n // 5), replace=False)] = rng.integers(0, kinds, 1)[0]
            own[n // 2] = base[n // 2]
            cut = int(rng.integers(0, n // 2 - 6))
            own = np.concatenate([own[:cut], rng.integers(0, 1 << 40, rng.integers(0, 6)).astype(np.uint64), own[cut:]])
            texts.append((np.concatenate([x := rng.integers(0, 1 << 40, rng.integers(0, 90)).astype(np.uint64), own, rng.integers(0, 1 << 40, 30).astype(np.uint64)]), len(x) + len(own) - n + n // 2, n))
    tokens, begins = np.concatenate([t for t, _, _ in texts]), np.cumsum([0, *(len(t) for t, _, _ in texts)])
    at = np.array([a for _, a, _ in texts])
    prints, repeats = passages.shingle_prints(tokens, begins, begins[:-1] + at)
    value = np.array([n for _, _, n in texts])
    number = np.arange(len(texts))
    got = {(int(i), int(j)) for x, y, _ in passages.likely_pairs(value, number, number, number, repeats, prints, 46, 75) for i, j in zip(x, y)}
    near = lambda k: texts[k][0][max(0, at[k] - 61) : at[k] + 62].view(np.int64)
    wanted = {(i, j) for i in number for j in number[:i] if value[i] == value[j] and any(lo <= min(at[i], 61) < hi for lo, hi, *_ in passages.verify(near(i), near(j), 46, 75))}
    assert len(wanted) > 90 and wanted <= got


def test_repeats_without_or_under_one_id(spark):
    """Texts under null ids or one id lose what they share, and none is taken for another."""
    rng = random.Random(41)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    one, two = text(60), text(60)
    parts = [(None, text(30), one, text(20)), (1, text(10), one, text(40)), (2, text(25), two, text(15)), (2, text(35), two, text(5)), (3, text(80), "", "")]
    docs = spark.createDataFrame([(i, a + b + c) for i, a, b, c in parts], "doc_id long, text string")
    rows = suffixes.find_repeats(docs, length=40).collect()
    wanted = [(i, len(a + b + c), len(b), int(b != ""), hashlib.sha256((a + c).encode()).hexdigest()) for i, a, b, c in parts]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows), key=key) == sorted(wanted, key=key)


def _near(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n long")


def test_links_through_rows_without_an_id(spark):
    """A text that only stands under a null id links its neighbours; each of two texts under one id is judged for itself."""
    words = [f"b{k}" for k in range(160)]
    a, n, b = " ".join(words[:130]), " ".join(words[12:142]), " ".join(words[24:154])
    for middle in (2, None):
        rows = neardup.find_near_duplicates(_near(spark, [(1, a, 0), (middle, n, 1), (middle, n, 2), (3, b, 3)])).collect()
        assert [r["component_id"] for r in rows] == [1] * 4
    assert {r["component_id"] for r in neardup.find_near_duplicates(_near(spark, [(1, a, 0), (3, b, 3)])).collect()} == {1, 3}
    other = " ".join(f"c{k}" for k in range(100))
    rows = [(1, a, 0), (1, other, 1), (1, other, 2), (5, other, 3), (6, n, 4), (7, "", 5), (7, None, 6), (0, b, 7), (None, a, 8)]
    kept = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in neardup.drop_near_duplicates(_near(spark, rows)).collect())
    assert kept == sorted([(True, 0, b), (True, 1, other), (True, 7, ""), (True, 7, ""), (False, 0, a)])


def test_buckets_compared_in_blocks(spark, monkeypatch):
    """Links found by the last comparison do not depend on the size of its blocks."""
    rng = random.Random(51)
    base = [f"d{k}" for k in range(200)]
    texts = []
    for k in range(60):
        own = list(base)
        for at in rng.sample(range(200), rng.randint(2, 9)):
            own[at] = f"x{k}-{at}"
        texts.append((k, " ".join(own), k))
    monkeypatch.setattr(neardup, "STARS", 0)
    found = []
    for block in (1000, 7):
        monkeypatch.setattr(neardup, "BLOCK", block)
        found.append(sorted((r["doc_id"], r["component_id"]) for r in neardup.find_near_duplicates(_near(spark, texts), common_buckets=1).collect()))
    sets = [{tuple(w[i : i + 5]) for i in range(196)} for w in (t[1].split() for t in texts)]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert found[0] == found[1] == list(enumerate(root))
