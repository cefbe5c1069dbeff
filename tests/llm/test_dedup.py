"""SimHash documents, repeated passages, fuzzy lines and components against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quadloom.llm import line_dedup, simhash_docs, substring_dedup
from quadloom.llm.common import components

from .helpers import Sets, corpus, words


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 51), (51, 50)], "random"])
def test_components(spark, edges):
    if edges == "random":
        rng = random.Random(1)
        edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.root(x) for x in sets.up if any(x in e and e[0] != e[1] for e in edges)}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    sets = Sets()
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    for i, f in fps:
        for j, g in fps:
            if (f ^ g).bit_count() <= 2:
                sets.join(i, j)
    return sorted((i, f"{f:016x}", sets.root(i)) for i, f in fps)


def test_simhash_groups(spark):
    rows = corpus() + [(500, None), (501, ""), (502, "one"), (503, "ONE"), (504, "two words")]
    got = simhash_docs.simhash_near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_groups(rows)


def test_tiles_find_every_link(spark):
    """Fingerprints at distances 0 to 4 of each other, in tiles of two blocks: connected as by comparing all."""
    rng = random.Random(9)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(8):
            fps.add(f)
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
    fps = [int(np.uint64(f).astype(np.int64)) for f in fps]
    sets = Sets()
    for a in fps:
        for b in fps:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                sets.join(a, b)
    links = simhash_docs.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2, block=3)
    got = {r.node: r.component for r in components(links).collect()}
    assert {f: got.get(f, f) for f in fps} == {f: sets.root(f) for f in fps}


def test_representatives(spark):
    rows = corpus()
    rows += [rows[0], rows[0]]  # repeated rows count once
    kept = sorted(r.doc_id for r in simhash_docs.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted({c for _, _, c in brute_groups(list(set(rows)))})


def test_representatives_keep_columns_with_inner_names(spark):
    df = spark.createDataFrame([(1, "a b c d", "x", 7)] * 2, "doc_id long, text string, _tk string, _id long").selectExpr("*", "'k' text_key")
    assert [tuple(r) for r in simhash_docs.keep_representatives(df).collect()] == [(1, "a b c d", "x", 7, "k")]


def brute_passages(rows, width=13):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batch", [200, 10**6])
def test_passages(spark, monkeypatch, batch):
    monkeypatch.setattr(substring_dedup, "BATCH_WORDS", batch)
    rows = corpus() + [(600, None), (601, " ".join(f"w{k}" for k in range(12))), (602, "again and " * 40), (603, "again and " * 41)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, substring_dedup.substring_dedup(df).collect())) == brute_passages(rows)
    spans = substring_dedup.substring_dedup(df, texts=True).where("n_removed > 0").collect()
    assert all(a < b and (k == 0 or r.stops[k - 1] < a) for r in spans for k, (a, b) in enumerate(zip(r.starts, r.stops)))


def test_packing():
    rng = np.random.default_rng(2)
    for x in (np.zeros(0, np.uint64), np.zeros(5, np.uint64), rng.integers(0, 1 << 63, 999).astype(np.uint64), np.array([2**64 - 1], np.uint64)):
        assert (substring_dedup.unpack(substring_dedup.pack(x)) == x).all()


def normal(line):
    import re

    return [w for w in re.split(r"[\x00-\x20!-@\[-`{-\x7f]+", line.lower()) if w]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def bound(a, b):
    """A lower bound of the edit distance: an edit changes two pairs of letters at most, and there are two sides."""
    x, y = (Counter(zip(t, t[1:])) for t in (a, b))
    return sum(((x - y) + (y - x)).values()) / 4


def brute_lines(rows):
    """By edit similarity alone, of all lines of five words or more."""
    places, sets = defaultdict(list), Sets()
    for i, t in sorted(rows):
        for p, line in enumerate(t.split("\n")):
            w = normal(line)
            if len(w) >= 5:
                places[" ".join(w)].append((i, p))
    links, known = 0, list(places)
    for k, a in enumerate(known):
        for b in known[:k]:
            most = int(max(len(a), len(b)) * 0.2 + 1e-9)
            if abs(len(a) - len(b)) <= most and bound(a, b) <= most and edit(a, b) <= most:
                sets.join(a, b)
                links += 1
    groups = defaultdict(list)
    for line, at in places.items():
        groups[sets.root(line)] += at
    gone = {x for at in groups.values() for x in sorted(at)[1:]}
    return {i: "\n".join(line for p, line in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}, links


def test_lines(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november".split()) + str(rng.randrange(9)) * 0 for _ in range(n)) for n in (70, 90, 130)]
    rows = corpus(50)
    for k in range(30):  # near copies of long lines, some of them of each other
        w = base[k % 3].split(" ")
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(["zulu", "yankee", "x"])
        rows.append((200 + k, f"Page {k}: " + " ".join(w) + "!\nshort line\nA line, number {k}, of more words than five.".replace("{k}", str(k))))
    want, links = brute_lines(rows)
    assert links > 20
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_removed == len(t.split("\n")) - (len(r.text.split("\n")) if r.text or not r.n_removed else 0) or not r.text for r, t in ((r, dict(rows)[r.doc_id]) for r in got))


def test_short_near_lines(spark):
    """One word changed in lines of 7 to 15 words, which the word fingerprints leave out."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 6)))
    rows = []
    for k in range(60):
        w = [word() for _ in range(7 + k % 9)]
        rows.append((k, " ".join(w)))
        w[rng.randrange(len(w))] = word()
        rows.append((1000 + k, " ".join(w)))
    near = [k for k in range(60) if edit(rows[2 * k][1], rows[2 * k + 1][1]) <= int(max(len(rows[2 * k][1]), len(rows[2 * k + 1][1])) * 0.2 + 1e-9)]
    assert len(near) > 50
    gone = {r.doc_id for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()}
    assert gone <= {1000 + k for k in near}
    assert len(gone) >= 0.9 * len(near)


def test_long_near_lines(spark):
    """One to four of 16 to 40 long words changed, which moves most word fingerprints by more than three bits."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 9)))
    rows = []
    for k in range(60):
        w = [word() for _ in range(16 + k % 25)]
        rows.append((k, " ".join(w)))
        for at in rng.sample(range(len(w)), 1 + k % (len(w) // 10)):
            w[at] = word()
        rows.append((1000 + k, " ".join(w)))
    near = [k for k in range(60) if edit(rows[2 * k][1], rows[2 * k + 1][1]) <= int(max(len(rows[2 * k][1]), len(rows[2 * k + 1][1])) * 0.2 + 1e-9)]
    assert len(near) > 50
    gone = {r.doc_id for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()}
    assert gone <= {1000 + k for k in near}
    assert len(gone) >= 0.95 * len(near)


def test_lines_of_scripts_without_blanks(spark):
    lines = ["本网站的全部内容版权所有未经许可不得转载", "このページの無断転載を禁じますのでご注意ください", "สงวนลิขสิทธิ์ห้ามทำซ้ำก่อนได้รับอนุญาต"]
    rows = [(i, f"{line}\n目录\nshort line") for i, line in enumerate(lines * 2)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == {i: t if i < 3 else "目录\nshort line" for i, t in rows}


def test_near_lines_of_scripts_without_blanks(spark):
    rng = random.Random(15)
    rows = []
    for k in range(40):
        line = [chr(0x4E00 + rng.randrange(3000)) for _ in range(30 + k)]
        rows.append((k, "".join(line)))
        for at in rng.sample(range(len(line)), 1 + k % 3):
            line[at] = "变"
        rows.append((1000 + k, "".join(line)))
    gone = {r.doc_id for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()}
    assert gone <= {1000 + k for k in range(40)} and len(gone) >= 36


def test_lines_in_large_blocks(spark):
    """Near pairs among many lines that share most of their smallest hashes with one another, though not enough to be near."""
    rng = random.Random(16)
    common = [f"common{c}" for c in "abcdefgh"]
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(6, 12)))
    rows = []
    for k in range(400):
        w = rng.sample(common, 3) + [word() for _ in range(9)]
        rng.shuffle(w)
        rows.append((k, " ".join(w)))
        if k % 4 == 0:
            w[rng.randrange(12)] = word()
            rows.append((1000 + k, " ".join(w)))
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    want, links = brute_lines(rows)
    assert links >= 90
    missed = [r.doc_id for r in got.collect() if r.text != want[r.doc_id]]
    assert len(missed) <= 0.05 * links


def test_all_pairs_of_a_block(spark):
    """Near lines of one large block that are near neither its smallest line nor one another's: a chain of changed words, shuffled among others."""
    rng = random.Random(17)
    common = [f"{c * 12}{c}common" for c in "abcd"]
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(6, 9)))
    lines = []
    for _ in range(30):
        w = [word() for _ in range(24)]
        for _ in range(8):  # each is near the one before, the first and the last are not
            lines.append(" ".join(common + w))
            for at in rng.sample(range(24), 4):
                w[at] = word()
    rng.shuffle(lines)
    rows = list(enumerate(lines))
    want, links = brute_lines(rows)
    assert links >= 200
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_near_lines_of_few_common_words(spark):
    """One letter changed in most of a line's words, which leaves few words in common, though most letters."""
    rng = random.Random(18)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for k in range(30):
        shared, rest = [word(16) for _ in range(7)], [word(5) for _ in range(18)]
        rows.append((k, " ".join(shared + rest)))
        rows.append((1000 + k, " ".join(shared + [w[:2] + ("x" if w[2] != "x" else "y") + w[3:] for w in rest])))
    want, links = brute_lines(rows)
    assert links == 30
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_letter_counts_lose_no_link(spark):
    """Pairs that fail the bound by letter counts are further apart than links may be; lines of up to 2,000 letters, some of other scripts."""
    rng = random.Random(19)
    rows = []
    for k in range(400):
        x = "".join(rng.choice("aaeeiotns bcdz éß变") for _ in range(rng.choice([5, 30, 200, 2000] if k % 20 == 0 else [5, 30, 200])))
        y = list(x)
        for _ in range(int(len(x) * rng.uniform(0, 0.5))):
            at = rng.randrange(len(y))
            y[at : at + rng.randrange(2)] = rng.choice(["", "q", "a", "zz"])
            y = y or ["a"]
        rows.append((2 * k, x, "".join(y)))
    df = spark.createDataFrame(rows, "k long, x string, y string")
    counts = lambda c: line_dedup._letters(df.selectExpr("k lh", f"{c} norm")).withColumnRenamed("lh", "k")
    other = counts("x")
    pairs = df.join(counts("y"), "k").join(other.toDF(*[n if n == "k" else f"{n}_x" for n in other.columns]), "k")
    got = line_dedup._may_link(pairs).selectExpr("may", "levenshtein(x, y) d", "floor(greatest(length(x), length(y)) * 0.2) most").collect()
    assert len(got) == 400 and all(r.may for r in got if r.d <= r.most)
    assert sum(not r.may for r in got) > 0.5 * sum(r.d > r.most for r in got) > 50


def test_long_lines_of_other_lengths_cannot_link(spark):
    """Lines long enough to be compared by words: none is a link where their numbers of words differ by more than a fifth."""
    rows = [(k, " ".join(["word"] * n), " ".join(["word"] * m)) for k, (n, m) in enumerate([(400, 200), (200, 400), (400, 319), (400, 320), (400, 500), (400, 501)])]
    df = spark.createDataFrame(rows, "k long, x string, y string")
    counts = lambda c: line_dedup._letters(df.selectExpr("k lh", f"{c} norm")).withColumnRenamed("lh", "k")
    other = counts("x")
    pairs = df.join(counts("y"), "k").join(other.toDF(*[n if n == "k" else f"{n}_x" for n in other.columns]), "k")
    assert [r.may for r in line_dedup._may_link(pairs).orderBy("k").collect()] == [False, False, False, True, True, False]


def test_copies_among_lines_with_a_common_passage(spark, monkeypatch):
    """Near copies in a block of lines that share a passage only: the pairs to verify are not all pairs of copies."""
    rng = random.Random(26)  # of the block, the smallest line is not one of the copies
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = [word(16) for _ in range(8)]
    copied = [word(5) for _ in range(40)]
    lines = [" ".join([word(5) for _ in range(40)] + passage) for _ in range(25)]
    for _ in range(60):
        w = list(copied)
        w[rng.randrange(40)] = word(5)
        lines.append(" ".join(w + passage))
    rng.shuffle(lines)
    rows = list(enumerate(lines))
    pairs, verified = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda p, *more: pairs.append(p.count()) or verified(p, *more))
    want, links = brute_lines(rows)
    assert links == 60 * 59 // 2
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert sum(pairs) < 25 * 24 // 2 + 25 * 60 + links // 3, pairs


def test_bands_give_the_same_links(spark):
    """Near the limit, a turn of whole distances finds what narrower bands and bounds find, in characters and in words."""
    rng = random.Random(7)
    lines = []
    for n in [1, 2, 8, 30, 150, 260] * 6:
        words = ["".join(rng.choices("aeinrst", k=rng.randint(1, 9))) for _ in range(n)]
        for share in (0, 0.1, 0.2, 0.3):
            lines.append(" ".join("".join(rng.choices("ou", k=len(w))) if rng.random() < share else w for w in words))
    texts = spark.createDataFrame(list(enumerate(lines)), "lh long, norm string")
    pairs = spark.createDataFrame([(4 * k, 4 * k + j) for k in range(len(lines) // 4) for j in (1, 2, 3)], "a long, b long")
    one, two = ({tuple(r) for r in line_dedup.verified(pairs, texts, bands).collect()} for bands in ((1,), (2, 1)))
    assert one == two and len(one) == pairs.count() and {ok for *_, ok in one} == {True, False}


def test_line_columns_with_inner_names(spark):
    """Columns named as the operator's own stay as they are."""
    line = "a line of more than five words"
    rows = [(1, line, "x", 7), (2, f"{line}\nthese other words stand in the second document", "y", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kid string, _kid long").selectExpr("*", "'t' tk", "'u' _tk", "'g' gone", "'h' _GONE", "9 n_lines")
    got = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    assert {k: (r.text, r.kid, r._kid, r.tk, r._tk, r.gone, r._GONE, r.n_lines, r.n_removed) for k, r in got.items()} == {
        1: (line, "x", 7, "t", "u", "g", "h", 1, 0), 2: ("these other words stand in the second document", "y", 8, "t", "u", "g", "h", 2, 1)
    }


def test_odd_rows(spark, odd, empty):
    for f in (simhash_docs.simhash_near_dedup, substring_dedup.substring_dedup, line_dedup.line_dedup):
        assert f(odd).count() == odd.count()
        assert f(empty).count() == 0
    assert simhash_docs.keep_representatives(empty).count() == 0
    got = {(r.doc_id, r.fingerprint) for r in simhash_docs.simhash_near_dedup(odd).collect()}
    assert {(1, "0" * 16), (2, "0" * 16), (3, "0" * 16), (None, "0" * 16)} <= got
    kept = simhash_docs.keep_representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 5, 6, 7]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is None) == [] or kept.where("doc_id is null").count() == 1
    lines = line_dedup.line_dedup(odd)
    assert set(lines.columns) == set(odd.columns) | {"n_removed"}
    assert {r.text for r in lines.where("doc_id = 1").collect()} == {None}
