"""MinHash, components, embeddings, decontamination and line dedup against brute force."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import common, components, decontaminate, line_templates, minhash, pq_dedup, registry


def words(rng, n, size=3000):
    return [f"w{rng.randint(0, size)}" for _ in range(n)]


def smallest(links, ids):
    to = {i: i for i in ids}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        to[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_word_hashes_follow_the_token_rule():
    texts = ["The cat\tTHE é É\x0b\x0cx", None, "", "cat", "A" * 5000 + " b"]
    h, edges = common.word_hashes(texts)
    found = [h[a:b].tolist() for a, b in zip(edges, edges[1:])]
    assert [len(x) for x in found] == [6, 0, 0, 1, 2]
    assert found[0][0] == found[0][2] and found[0][1] == found[3][0] and found[0][3] != found[0][4]
    rng = random.Random(0)
    many = [" ".join(words(rng, 50)) for _ in range(40)]
    h, _ = common.word_hashes(many)
    assert len(set(h.tolist())) == len({w for t in many for w in t.split()})


def test_components(spark):
    rng = random.Random(7)
    for n, m in ((1, 0), (30, 20), (200, 180)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(None, 1)] if m else [])
        df = spark.createDataFrame(links, "a long, b long")
        got = {r.node: r.component for r in components.components(df).collect()}
        real = [(a, b) for a, b in links if a is not None and a != b]
        want = smallest(real, range(n))
        assert got == {i: want[i] for i in {x for ab in real for x in ab}}
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.component for r in components.components(chain).collect()} == {0}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_docs():
    rng = random.Random(11)
    docs = []
    for _ in range(30):
        docs.append(" ".join(words(rng, rng.randint(3, 200))))
    for base in docs[:12]:
        for edits in (0, 0, 1, 1, 2, 4, 8):
            w = base.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = "edit%d" % rng.randint(0, 9)
            docs.append(" ".join(w))
    hub = words(rng, 120)  # a hub whose copies link with it but often not with each other
    for i in range(120):
        w = list(hub)
        w[rng.randrange(len(w))] = f"v{i}"
        docs.append(" ".join(w))
    docs.append(" ".join(hub))
    docs += [None, "", " \n ", "one two", "ONE two", "One  two three", "É a b c d e", "é a b c d e"]
    rng.shuffle(docs)
    return [(3 * i, t) for i, t in enumerate(docs)]


def test_minhash_finds_exactly_the_links(spark):
    docs = near_docs()
    sets = {d: shingles(t) for d, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = smallest(links, sets)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, kept string").repartition(6)
    got = {r.doc_id: r for r in minhash.link(df).collect()}
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.n_shingles == len(sets[d]) and r.kept == (want[d] == d) for d, r in got.items())
    kept = minhash.keep_first(df)
    assert kept.columns == ["doc_id", "text", "kept"] and kept.count() == sum(want[d] == d for d in want)


def test_minhash_shape_follows_the_percentage(spark):
    assert minhash.shape(85) == (32, 7, 0.73)
    for percent in (10, 50, 60, 70, 80, 90, 95, 100):
        bands, rows, floor = minhash.shape(percent)
        share = min(percent, 99) / 100
        assert (1 - share**rows) ** bands <= 5e-6 and floor < share and bands * rows <= minhash.COORDINATES
    rng, docs = random.Random(21), []
    for _ in range(60):
        base = words(rng, 150)
        docs.append(" ".join(base))
        for edits in (2, 3, 4, 5):  # each edit takes five shingles: similarities of about 0.7 to 0.87
            w = list(base)
            for e in range(edits):
                w[10 + 30 * e] = f"e{rng.randint(0, 99)}"
            docs.append(" ".join(w))
    sets = {i: shingles(t) for i, t in enumerate(docs)}
    pairs = [(a, b, 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in sets for b in range(a + 1, len(docs))]
    assert sum(80 <= s < 85 for *_, s in pairs) > 50
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for percent in (60, 80):
        want = smallest([(a, b) for a, b, s in pairs if s >= percent], sets)
        assert {r.doc_id: r.component_id for r in minhash.link(df, percent).collect()} == want
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == {d for d in want if want[d] == d}


def test_minhash_in_crowds_that_share_a_passage(spark, monkeypatch):
    """Large buckets: documents around one passage that don't link, groups of near copies in them,
    and documents that are little but the passage."""
    monkeypatch.setattr(minhash, "SMALL", 3)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "COLUMNS", 64)
    rng = random.Random(41)
    passage = words(rng, 60)
    docs = [" ".join(passage + words(rng, rng.randint(3, 24))) for _ in range(160)]
    for base in docs[:40:4]:
        for _ in range(6):
            w = base.split()
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 999)}"
            docs.append(" ".join(w))
    docs.append(" ".join(words(rng, 40_000)))  # a very long one and its near copy
    docs.append(docs[-1] + " more")
    rng.shuffle(docs)
    sets = {i: shingles(t) for i, t in enumerate(docs)}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = smallest(pairs, sets)
    got = {r.doc_id: r.component_id for r in minhash.link(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert got == want and 20 < sum(want[i] != i for i in want) < 160


def test_minhash_rows_of_one_id(spark):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = [(5, a, 1), (5, a, 2), (5, b, 3), (3, b, 4), (7, c, 5), (7, c, 6), (None, a, 7), (None, a, 8), (9, None, 9), (9, None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __kept int")
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.link(df).collect()}
    assert got == {(5, 3, False), (3, 3, True), (7, 7, True), (None, None, True), (9, 9, True)}
    left = minhash.keep_first(df)
    assert left.columns == df.columns and sorted((str(r.doc_id), r.text) for r in left.collect()) == [("3", b), ("7", c), ("9", None), ("None", a), ("None", a)]


def test_minhash_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.link(empty).count() == 0
    same = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (0, "A b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.link(same).collect()), key=str)
    assert got == [(0, 0, True), (1, 0, False), (1, 0, False), (None, None, True)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85):
        seen = []
        for _ in range(40):
            both = rng.integers(0, 2**63, 400, dtype=np.uint64)
            a, b = (np.concatenate([both, rng.integers(0, 2**63, int(400 * (1 / share - 1) / 2), dtype=np.uint64)]) for _ in range(2))
            seen.append((minhash.signature(a) == minhash.signature(b)).mean())
        assert abs(np.mean(seen) - share) < 0.03


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(600, 24))
    near = base[:150] + rng.normal(size=(150, 24)) * np.linspace(0.02, 0.5, 150)[:, None]
    crowd = base[0] + rng.normal(size=(80, 24)) * 0.1
    x = [list(map(float, v)) for v in np.concatenate([base, near, crowd, base[:5], 2 * base[5:8]])]
    rows = [(7 * i, v, 0) for i, v in enumerate(x)]
    rows += [(-1, None, 0), (-2, [], 0), (-3, [0.0] * 24, 0), (-4, [float("nan")] * 24, 0), (-5, [None] * 24, 0), (-6, [1.0], 0), (-7, [1.0, 2.0], 0), (-9, [2.0, 4.1], 0), (-8, [float("inf")] * 24, 0)]
    got = {r.vec_id: r for r in pq_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept int")).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    on = u @ u.T >= 0.9
    np.fill_diagonal(on, False)
    found = sum(got[7 * i].n_links for i in range(len(x)))
    assert found <= on.sum() and found >= 0.97 * on.sum()
    want = smallest([(7 * i, 7 * j) for i, j in zip(*np.nonzero(on)) if i < j], [7 * i for i in range(len(x))])
    assert np.mean([got[i].component_id == want[i] for i in want]) > 0.98
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (-1, -2, -3, -4, -5, -6, -8))
    assert got[-7].n_links == got[-9].n_links == 1 and got[-7].component_id == -9
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pq_dedup.link(empty).count() == 0


def test_embedding_recall_in_many_lists(spark, monkeypatch):
    """Lists of 8 vectors, so that probes are few of many, and blocks of 16 of a crowd."""
    monkeypatch.setattr(pq_dedup, "PER_LIST", 8)
    monkeypatch.setattr(pq_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(2500, 48))
    near = base[:700] + rng.normal(size=(700, 48)) * rng.uniform(0.1, 0.48, 700)[:, None]
    x = np.concatenate([base, near, base[0] + rng.normal(size=(90, 48)) * 0.1])
    got = {r.vec_id: r for r in pq_dedup.link(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    on = u @ u.T >= 0.9
    np.fill_diagonal(on, False)
    exact = on.sum(1)
    assert all(got[i].n_links <= exact[i] for i in got)
    loose = np.flatnonzero(exact < 50)  # the crowd doesn't hide the others
    assert sum(got[i].n_links for i in loose.tolist()) >= 0.9 * exact[loose].sum() and sum(r.n_links for r in got.values()) >= 0.95 * exact.sum()


def test_quantised_distances_are_within_the_error():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = pq_dedup.Quantizer(x, 8)
    of = q.nearest(x)[:, 0]
    assert ((x - q.centre(of)) ** 2).sum(1) == pytest.approx(np.min([((x - q.centre(k)) ** 2).sum(1) for k in range(q.size)], axis=0))
    codes, error = q.encode(x, of)
    for cell in range(q.size):
        rows = np.flatnonzero(of == cell)
        if len(rows):
            real = np.linalg.norm(x[:40, None] - x[None, rows], axis=2)
            assert (np.abs(np.sqrt(np.maximum(0, q.squares(x[:40], cell, codes[rows]))) - real) <= error[rows] + 1e-6).all()


def every_window(docs, items):
    """Best weighted similarity of 0.8 or more per (doc_id, item_id), in plain Python."""

    def bag(w):
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    held = [(i, t.lower().split()) for i, t in items if t is not None]
    holders = Counter(s for _, w in held for s in bag(w))
    most, out = 1 + math.log(len(held)), {}
    for key, text in docs:
        d = (text or "").lower().split()
        for item, w in held:
            own = bag(w)
            for at in range(max(1, len(d) - len(w) + 1)) if w and d else ():
                other = bag(d[at : at + len(w)])
                weight = {s: most - math.log(holders[s]) if s in own else most for s in {*own, *other}}
                found = sum(weight[s] * min(own[s], other[s]) for s in weight) / sum(weight[s] * max(own[s], other[s]) for s in weight)
                if found >= 0.8:
                    out[key, item] = max(found, out.get((key, item), 0))
    return out


def test_decontamination_against_every_window(spark):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([1, 3, 5, 9, 15, 30, 60, 60, 200])] + [(20, None), (21, ""), (22, "w1 w2 w3"), (22, "w1 w2 w3")]
    docs = []
    for i in range(120):
        w = words(rng, rng.randint(0, 300))
        if i % 2:
            item = rng.choice(items[2:9])[1].split()
            if i % 4 == 3:
                item[rng.randrange(len(item))] = "edit"
            at = rng.randint(0, len(w))
            w = w[:at] + item + w[at:]
        docs.append((i, " ".join(w).upper() if i % 3 else " ".join(w)))
    docs += [(500, None), (501, ""), (501, ""), (502, " ".join(items[7][1].split()[:55])), (503, items[6][1] + " w1"), (503, "clean"), (None, items[5][1]), (None, "clean too")]
    docs.append((504, " ".join(words(rng, 30_000)) + " " + items[8][1]))
    d, b = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(d, b).collect()}
    want = every_window(docs, items)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 40
    assert (502, 7) in want and (504, 8) in want and (None, 5) in want
    clean = decontaminate.drop_contaminated(d, b)
    kept = sorted((str(k), str(t)) for k, t in docs if not every_window([(k, t)], items))
    assert clean.columns == d.columns and sorted((str(r.doc_id), str(r.text)) for r in clean.collect()) == kept and ("503", "clean") in kept
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), b).count() == 0


def test_decontamination_of_short_items_and_in_blocks(spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, " ".join(words(rng, 5 + i % 16))) for i in range(160)]
    docs = []
    for i, (_, text) in enumerate(items * 3):
        w = text.split()
        if i >= 160:  # an edit at an end takes one shingle
            w[0 if i % 2 else -1] = "edit"
        docs.append((i, " ".join(words(rng, 20) + w + words(rng, 20))))
    want = every_window(docs, items)
    monkeypatch.setattr(decontaminate, "CLASS_ITEMS", 4)
    for most in (20_000, 50):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", most)
        index = list(decontaminate._indexes(spark.createDataFrame(items, "item_id long, text string")))
        assert len(index) == (1 if most > 160 else 4)
        found = {}
        for x in index:
            for key, text in docs:
                found |= {(key, x.ids[n]): s for n, (s, _) in x.scan(common.word_hashes([text])[0]).items()}
        assert set(found) <= set(want) and len(found) >= 0.999 * len(want) and len(want) > 300
        assert all(abs(found[k] - want[k]) < 1e-9 for k in found)


def test_hamming_tables_return_all_within_the_radius():
    rng = np.random.default_rng(8)
    prints = [int(x) for x in rng.integers(0, 2**63, 70)]
    own = decontaminate._Class(9, list(range(70)), prints)
    asked = np.array([p ^ int(sum(1 << int(b) for b in rng.choice(64, n, replace=False))) for p in prints for n in (0, 5, 20, 21, 30)], np.uint64)
    got = set(zip(*(x.tolist() for x in own.lookup(asked))))
    assert got == {(i, j) for i, a in enumerate(asked.tolist()) for j, p in enumerate(prints) if (a ^ p).bit_count() <= decontaminate.RADIUS}


def line_docs():
    rng = random.Random(6)
    docs = []
    for i in range(60):
        lines = [" ".join(words(rng, rng.randint(4, 12))).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(rng.randint(1, 6))]
        lines.append(f"{i} {i + 1} {i * 7}")  # a row of numbers is no template
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), "All rights reserved.")
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), f"page {i} of 60  seen 2024-01-{i:02d}")
        if i % 5 == 0:
            lines.insert(rng.randint(0, len(lines)), "posted by the user " + rng.choice(["ann", "bob", "cid", "dan"]) + " in the forum of this very site today")
        docs.append((i, "\n".join(lines)))
    docs += [(100 + i, docs[1][1]) for i in range(9)]  # copies of a whole document
    return docs + [(200, None), (201, ""), (202, "\n\n"), (203, "All rights reserved."), (None, "x\nAll rights reserved.")]


def test_line_templates(spark):
    docs = line_docs()
    df = spark.createDataFrame([(d, t, 5, "k") for d, t in docs], "doc_id long, text string, n_lines int, keys string")
    got = {r.doc_id: r for r in line_templates.dedup_lines(df).collect()}
    for d, t in docs[:60]:
        left = got[d].text
        assert "rights" not in left and "page" not in left and "posted by" not in left
        lost = [x for x in t.split("\n") if x not in left.split("\n")]
        assert all(x.startswith(("All", "page", "posted")) for x in lost) and got[d].n_dropped == len(lost)
    assert all(got[100 + i].text == got[1].text == docs[1][1] for i in range(9))
    assert got[200].text is None and got[201].text == "" and got[202].text == "\n\n" and got[203].text == "" and got[None].text == "x"
    out = line_templates.drop_lines(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {d for d, _ in docs} - {203}
    assert line_templates.dedup_lines(df.limit(0)).count() == 0


def letters(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))


def test_lines_recur_by_texts_whatever_their_neighbours(spark):
    """Blocks of recurring lines, documents that differ in one place, and copies of documents."""
    rng = random.Random(31)
    block = ["Les.", letters(rng, 5), "Of the edge.", letters(rng, 60)]
    docs = [(i, "\n".join(["home", *block, "foot", letters(rng, 8)])) for i in range(40)]
    alone = "\n".join(["one of a kind", letters(rng, 9), "end of it 7"])
    docs += [(100 + i, alone) for i in range(5)] + [(200 + i, alone.replace("7", str(i))) for i in range(5)]
    got = {r.doc_id: r for r in line_templates.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i].text == docs[i][1].split("\n")[-1] and got[i].n_dropped == 6 for i in range(40))
    assert all(got[d].text == t for d, t in docs[40:])


def test_stray_lines_of_a_leaf_do_not_hide_its_groups(spark):
    rng = random.Random(32)
    own = lambda: letters(rng, 8)
    posted = "posted by the user {} in the forum of this very site today"
    stray = "posted by the " + letters(rng, 10)
    assert len(stray.split()) == len(posted.format("x").split())
    docs = [(i, "\n".join([own(), posted.format(letters(rng, 1)), own()])) for i in range(30)]
    docs += [(50, f"{own()}\n{stray}")]
    docs += [(60 + i, f"{own()}\n+1 555 0100 {i % 2}") for i in range(5)]  # equal lines of fields: 3 and 2 texts
    got = {r.doc_id: r for r in line_templates.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i].n_dropped == 1 and "posted" not in got[i].text for i in range(30)) and got[50].text == docs[30][1]
    assert [got[60 + i].n_dropped for i in range(5)] == [1, 0, 1, 0, 1]


def test_line_templates_sql(spark):
    docs = [(d, t) for d, t in line_docs() if d is not None and t is not None]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    want = {r[0]: tuple(r[1:]) for r in con.execute(registry.oracle_sql()["op10_line_templates"]).fetchall()}
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_templates.dedup_lines(df).collect()} == want


@pytest.mark.parametrize("rows", [1, 5])
def test_results_do_not_depend_on_partitions(spark, rows):
    docs = near_docs()[:90]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    a = {r.doc_id: r.component_id for r in minhash.link(df.repartition(rows)).collect()}
    b = {r.doc_id: r.component_id for r in minhash.link(df.orderBy(F.desc("doc_id"))).collect()}
    assert a == b
