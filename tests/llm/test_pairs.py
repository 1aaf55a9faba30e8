"""Joins, line groups and benchmark items against brute force."""

import random
import re

import numpy as np
import pytest

from tidings.llm import edits, fuzzy_lines, leaks, links, shingle_join

SF = "/root/testdata/sf0.001"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def joined(pairs, items):
    top = {i: i for i in items}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {i: root(i) for i in items}


# -- edits -----------------------------------------------------------------------------


def test_edit_distances():
    rng = random.Random(0)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(rng.randint(0, n)))
    for _ in range(300):
        a, b = word(25), word(25)
        true = levenshtein(a, b)
        assert edits.distance(a, b) == true
        assert edits.within(a, b, 6) == (true <= 6)
        longer = max(len(a), len(b))
        assert edits.similar(a, b, 0.7) == (true <= edits.budget_of(longer, 0.7))
        if a:
            parts = [b[i:j] for i in range(len(b) + 1) for j in range(i, len(b) + 1)]
            assert edits.best_end(edits.masks(a), len(a), b)[0] == min(
                levenshtein(a, p) for p in parts
            )


def test_similar_pairs_side_by_side(monkeypatch):
    monkeypatch.setattr(edits, "FEW", 0)
    rng = random.Random(6)
    for letters in ("ab", "abcdefgh ", "a\u00e9\u6f22b", "a\U0001d4b3b"):
        pairs = [("", ""), ("a", ""), ("same", "same")]
        for size in [rng.choice([5, 9, 10, 11, 30, 64, 130, 300, 700]) for _ in range(150)]:
            a = rng.choices(letters, k=size)
            b = list(a)
            for _ in range(rng.randrange(size // 5 + 2)):
                at, way = rng.randrange(len(b) + 1), rng.randrange(3)
                b[at : at + (way > 0)] = rng.choice(letters) if way < 2 else ""
            pairs.append(("".join(a), "".join(b)))
        found = edits.similar_many(*map(list, zip(*pairs)), 0.9)
        true = [edits.distance(a, b) <= edits.budget_of(max(len(a), len(b)), 0.9) for a, b in pairs]
        assert found.tolist() == true and 0.1 < np.mean(true) < 0.9


# -- shingle join ----------------------------------------------------------------------


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def brute_components(rows):
    sets = {}
    for i, t in rows:
        sets[i] = shingles(t)
    ids = sorted(sets)
    pairs = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    return sets, joined(pairs, ids)


def edge_rows():
    """Near copies in a chain, copies, a passage in many documents, short and odd texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(words, k=60))
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One two"), (1004, "one TWO"),
            (1005, "one two three"), (1006, "a b c d e"), (1007, "A B c d e f")]
    base = rng.choices(words, k=200)
    for i in range(12):  # neighbours are similar, the ends are not
        base = list(base)
        base[10 * i] = f"new{i}"
        base[10 * i + 5] = f"more{i}"
        rows.append((1100 + i, " ".join(base)))
    for i in range(150):
        rows.append((1200 + i, passage + " " + " ".join(rng.choices(words, k=40))))
    rows += [(1500 + i, passage) for i in range(30)]
    rows.append((1600, " ".join(rng.choices(words, k=30_000))))
    return rows


@pytest.fixture(scope="module")
def some_documents(spark):
    stored = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"]) for r in stored] + edge_rows()


@pytest.mark.parametrize("common, block", [(64, 2048), (3, 7)])
def test_join_is_brute_force(spark, some_documents, monkeypatch, common, block):
    monkeypatch.setattr(shingle_join, "COMMON", common)
    monkeypatch.setattr(links, "BLOCK", block)
    docs = spark.createDataFrame(
        [(i, t, 1, "k") for i, t in some_documents], "doc_id LONG, text STRING, n INT, key STRING"
    ).repartition(4)
    found = shingle_join.jaccard_groups(docs).collect()
    sets, component = brute_components(some_documents)
    assert len(found) == len(some_documents)
    for r in found:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == component[r["doc_id"]]


def test_join_of_few_rows(spark):
    empty = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert shingle_join.jaccard_groups(empty).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    found = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in shingle_join.jaccard_groups(docs).collect())
    assert found[1:] == [(4, 4), (5, 4), (5, 4)]


def test_tree_leaves_out_nothing_that_links():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 63, rng.integers(5, 400), dtype=np.uint64)
        sets.append(np.unique(base))
        sets.append(np.unique(np.concatenate([base[: -(len(base) // 12) or None], rng.integers(0, 1 << 63, 2, dtype=np.uint64)])))
    points = [shingle_join.count_vector(s) for s in sets]
    own = np.arange(len(sets))
    found = {frozenset(p) for p in shingle_join.candidates(points, own)}
    linked = {
        frozenset((i, j))
        for i in range(len(sets))
        for j in range(i)
        if shingle_join.similar(sets[i].tobytes(), sets[j].tobytes())
    }
    assert linked and linked <= found and len(found) < len(sets) ** 2 / 4
    wide = shingle_join.count_vector(np.full(300, 5, np.uint64))
    assert shingle_join.unpacked(wide).max() == 300
    assert {len(shingle_join.unpacked(p)) for p in points} == {128}


def test_points_of_neighbouring_lengths_meet():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    sets = [np.unique(base[:505]), np.unique(base[:520])] + [
        np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (505, 515, 530, 3000)
    ]
    points = [shingle_join.count_vector(s) for s in sets]
    assert [len(shingle_join.unpacked(p)) for p in points] == [128, 256, 128, 256, 256, 1024]
    assert [frozenset(p) for p in shingle_join.candidates(points, np.arange(6))] == [{0, 1}]
    assert shingle_join.may_link(points[0], points[1])


def test_keys_of_the_same_items_count_once(spark):
    rows = [(k, i) for k, items in enumerate(["ab", "ab", "abc", "bc", "ab", "de"]) for i in items]
    found = links.different_keys(spark.createDataFrame(rows, "key LONG, id STRING")).collect()
    assert sorted((r["key"], r["id"], r["weight"]) for r in found) == [
        (0, "a", 3), (0, "b", 3), (2, "a", 1), (2, "b", 1), (2, "c", 1), (3, "b", 1), (3, "c", 1), (5, "d", 1), (5, "e", 1)
    ]


def test_texts_just_below_the_threshold_make_few_pairs(spark, monkeypatch):
    """Copies of one text with a part of their own: neighbours link, others share up to 0.79."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(40):  # ten of 400 words apart: 50 of 396 shingles
        varied = list(base)
        for k in rng.sample(range(2, 398, 5), 10):
            varied[k] = f"x{i}-{k}"
        rows.append((i, " ".join(varied)))
        varied[0] = f"y{i}"
        rows.append((100 + i, " ".join(varied)))
    compared = []
    monkeypatch.setattr(links, "verified", lambda pairs, *rest, real=links.verified: compared.append(pairs) or real(pairs, *rest))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    found = {r["doc_id"]: r["component_id"] for r in shingle_join.jaccard_groups(docs).collect()}
    assert found == brute_components(rows)[1]
    assert found[139] == 39 and len(set(found.values())) > 20
    assert sum(p.count() for p in compared) < 6 * len(rows)


def test_groups_of_a_long_path(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "id LONG, other LONG")
    found = {r["id"]: r["component"] for r in links.groups(pairs).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# -- lines -----------------------------------------------------------------------------


def test_lines(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 5)
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(400)]
    long = rng.choices(words, k=80)
    rows = [(1, "Same  LINE here\n\nkept one", 7), (2, "same line here \nkept two", 7), (3, None, 7),
            (4, "", 7), (5, "\n \n", 7), (6, "a | b | c\na | d | e", 7), (8, "same line here", 7)]
    for i in range(20):  # one word differs in each
        varied = list(long)
        varied[3 * i] = f"zz{i}"
        rows.append((10 + i, " ".join(varied) + f"\nown {i} {words[i]} {words[-i]} tail", 7))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, n_lines INT").repartition(3)
    found = {r["doc_id"]: r for r in fuzzy_lines.dedup_lines(docs).collect()}
    assert found[1]["text"] == "Same  LINE here\n\nkept one" and found[1]["n_dropped"] == 0
    assert found[2]["text"] == "kept two" and found[2]["n_lines"] == 2
    assert found[3]["text"] is None and found[4]["text"] == "" and found[5]["text"] == "\n \n"
    assert found[6]["n_dropped"] == 0 and found[8]["text"] == ""
    assert sum(found[10 + i]["n_dropped"] for i in range(20)) >= 15
    assert found[10]["n_dropped"] == 0
    assert all(found[10 + i]["text"].endswith("tail") for i in range(20))
    assert fuzzy_lines.dedup_lines(docs.where("doc_id < 0")).count() == 0


def test_lines_of_rows_without_a_key_of_their_own(spark):
    """NULL and repeated keys: no unique line is lost, and each repeated one stays once."""
    rows = [
        (None, "first unique words\nshared line of several words"),
        (None, "second other unique\nshared line of several words"),
        (7, "alpha beta gamma delta\nshared line of several words"),
        (7, "epsilon zeta eta\nalpha beta gamma delta"), (8, None), (None, ""), (9, "long " * 60_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").selectExpr("*", "'z' as line", "1 as id")
    found = fuzzy_lines.dedup_lines(docs).collect()
    assert len(found) == len(rows) and {r["line"] for r in found} == {"z"}
    left = [" ".join(x.split()) for r in found for x in (r["text"] or "").split("\n") if x.strip()]
    every = {" ".join(x.split()) for _, t in rows for x in (t or "").split("\n") if x.strip()}
    assert sorted(left) == sorted(every)
    # rows equal in key and text are one document
    twice = spark.createDataFrame([(1, "same words in here")] * 2, "doc_id LONG, text STRING")
    assert [r["text"] for r in fuzzy_lines.dedup_lines(twice).collect()] == ["same words in here"] * 2


def test_exact_lines_of_documents(spark):
    """What goes besides equal lines is similar to a line that stays before it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    decided = fuzzy_lines.decide_lines(docs.select(docs["doc_id"].alias("id"), "text")).collect()
    text = {r["doc_id"]: r["text"].split("\n") for r in docs.collect()}
    first = {}
    for d in sorted(text):
        for n, line in enumerate(text[d]):
            if fuzzy_lines.normalise(line):
                first.setdefault(fuzzy_lines.normalise(line), (d, n))
    assert len(decided) == sum(bool(fuzzy_lines.normalise(x)) for t in text.values() for x in t)
    for r in decided:
        line = fuzzy_lines.normalise(text[r["id"]][r["line"]])
        best = (r["group_id"], r["group_line"])
        assert r["kept"] == (best == (r["id"], r["line"])) and best <= first[line]


def test_what_lines_leave_on_disk(spark):
    """Marks and points are deleted, and shuffles of the steps freed, before the result is read."""
    from pathlib import Path

    from tidings.session import freed_shuffles, shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:")) / "tidings"
    rows = [(i, f"first line of number {i}\nanother line that all have in common") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    before = set(folder.glob("*")) if folder.exists() else set()
    assert fuzzy_lines.dedup_lines(docs).where("n_dropped > 0").count() >= 39
    made = {p.name.rpartition("-")[0] for p in set(folder.glob("*")) - before}
    assert {"lines", "distinct-lines"} <= made and not {m for m in made if m.startswith("marked")}
    stored = [p for p in set(folder.glob("*")) - before if p.name.startswith("lines-")]
    assert spark.read.parquet(*map(str, stored)).columns == ["id", "line", "a", "b"]

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    with freed_shuffles(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == was


def test_candidates_of_few_and_of_many_are_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 24, fuzzy_lines.BLOCKS)
    for _ in range(200):
        n = int(rng.integers(2, 7))
        flips = [sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 14), False)) for _ in range(n * 8)]
        bits = base ^ np.array(flips).reshape(n, 8)
        points = np.column_stack([bits, rng.integers(30, 45, n)]).tolist()
        own = rng.integers(0, 3, n)
        few = {frozenset(p) for p in fuzzy_lines.candidates(points, own)}
        with monkeypatch.context() as patch:
            patch.setattr(fuzzy_lines, "FEW", 0)
            assert few == {frozenset(p) for p in fuzzy_lines.candidates(points, own)}


def test_simhash_blocks_of_close_lines():
    import pyarrow as pa

    from tidings.llm.common import span_hashes, text_bytes, word_spans

    lines = ["", "a b c", "c b a", " ".join(f"w{i}" for i in range(700))]
    data, offsets = text_bytes(pa.array(lines))
    starts, ends, first = word_spans(data, offsets, fuzzy_lines._SPACE)
    blocks = fuzzy_lines.simhashes(span_hashes(data, starts, ends), first)
    assert blocks.shape == (4, fuzzy_lines.BLOCKS) and not blocks[0].any()
    assert (blocks[1] == blocks[2]).all() and blocks.max() < 1 << fuzzy_lines.BITS


def test_recall_of_lines_of_every_length(spark):
    """Nine of ten lines go that differ by all the edits that the similarity allows."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    sizes = [9, 10, 11, 15, 20, 30, 40, 55, 80, 110, 160, 178, 250, 400, 800, 1500]
    rows = []
    for size in sizes:
        for _ in range(60):
            line = list(" ".join(rng.choices(words, k=size))[: size - 1] + "q")
            edited = list(line)
            for _ in range(edits.budget_of(size, fuzzy_lines.SIMILARITY)):
                at, way = rng.randrange(len(edited)), rng.randrange(3)
                edited[at : at + (way > 0)] = rng.choice("uvwxyz") if way < 2 else ""
            rows.append((len(rows), size, "".join(line), "".join(edited)))
    docs = spark.createDataFrame([(i, f"{a}\n{b}") for i, _, a, b in rows], "id LONG, text STRING")
    gone = {r["id"] for r in fuzzy_lines.decide_lines(docs).collect() if r["line"] and not r["kept"]}
    for size in sizes:
        near = [i for i, n, a, b in rows if n == size and fuzzy_lines.alike(*map(fuzzy_lines.normalise, (a, b)))]
        assert len(near) >= 50 and len(gone & set(near)) >= 0.9 * len(near), size


def varied(line, times, rng):
    line = list(line)
    for at in rng.sample(range(len(line)), times):
        line[at] = rng.choice("uvwxyz")
    return "".join(line)


def test_pairs_of_a_bucket(monkeypatch):
    """Like lines that share a key are pairs, or in a group that is named; unlike ones are not."""
    rng = random.Random(2)
    common = "this passage stands in every one of the lines "
    lines = [common + "".join(rng.choices("abcdefgh ", k=rng.randint(150, 170))) for _ in range(150)]
    lines += [varied(x, rng.randint(1, 18), rng) for x in lines[:40] for _ in range(12)]
    packed = fuzzy_lines.packed_lines(np.arange(len(lines)), lines)
    keys, rows = fuzzy_lines._keys_of(packed, 0, fuzzy_lines.MARKS)
    table = np.empty((len(keys), fuzzy_lines._DEALT), np.uint64)
    table[:, 0], table[:, 1], table[:, 2] = keys.view(np.uint64), packed["id"][rows], packed["chars"][rows]
    table[:, 3:] = packed["sketch"][rows]
    held = {}
    for key, row in zip(keys.tolist(), packed["id"][rows].tolist()):
        held.setdefault(key, set()).add(row)
    shared = {(i, j) for v in held.values() for i in v for j in v if i < j}
    like = {(i, j) for i, j in shared if fuzzy_lines.alike(lines[i], lines[j])}
    a, b, _ = fuzzy_lines.bucket_pairs(table)
    monkeypatch.setattr(fuzzy_lines, "ALWAYS", 1 << 30)
    every = {(min(p), max(p)) for p in zip(*(v.tolist() for v in fuzzy_lines.bucket_pairs(table)[:2]))}
    assert like <= every and len(shared) > 10_000
    assert sum(lines[i][46:60] != lines[j][46:60] for i, j in every) < 0.2 * len(shared)
    monkeypatch.setattr(fuzzy_lines, "ALWAYS", 0)
    a, b, group = fuzzy_lines.bucket_pairs(table)
    found = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
    groups = joined(found, range(len(lines)))
    named = {groups[i] for i, g in zip(a.tolist(), group.tolist()) if g >= 0}
    assert found < every and named
    assert all(groups[i] == groups[j] and groups[i] in named for i, j in every - found)


def test_groups_that_unlike_lines_join_in_a_bucket(spark):
    """Two families of lines, near each other and unlike, stay two."""
    rng = random.Random(8)
    base = "".join(rng.choices("abcdefgh ", k=200))
    second = varied(base, 32, rng)
    lines = [varied(x, 1, rng) for _ in range(30) for x in (base, second)]
    docs = spark.createDataFrame(list(enumerate(lines)), "id LONG, text STRING")
    found = {r["id"]: r["group_id"] for r in fuzzy_lines.decide_lines(docs).collect()}
    pairs = [(i, j) for j in range(60) for i in range(j) if fuzzy_lines.alike(lines[i], lines[j])]
    assert found == joined(pairs, range(60)) and len(set(found.values())) == 2


# -- benchmark -------------------------------------------------------------------------


def test_leaks_are_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 14)))) for i in range(12)]
    items += [(50, ""), (51, None), (52, "..."), (3, items[3][1].upper())]
    rows = []
    for d in range(60):
        body = rng.choices(words, k=rng.randint(0, 30))
        if d % 2:
            taken = list(items[d % 12][1])
            for _ in range(d % 5):
                taken[rng.randrange(len(taken))] = rng.choice("abcdex")
            body[rng.randint(0, len(body)) : 0] = ["".join(taken)]
        rows.append((d, ", ".join(body)))
    rows += [(100, None), (101, ""), (102, items[0][1] * 300)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id LONG, text STRING, item_id INT")
    table = spark.createDataFrame(items, "item_id LONG, text STRING")
    expected = set()
    for d, t in rows:
        t = leaks.normalise(t or "")
        for i, item in items:
            item = leaks.normalise(item or "")
            if item and len(t) < 5000:
                best = edits.best_end(edits.masks(item), len(item), t)[0]
                if best <= int(0.1 * len(item)):
                    expected.add((d, i, best))
    for chars in (1 << 20, 60):
        found = leaks.find_leaks(docs, table, max_error=0.1, block_chars=chars).collect()
        got = {(r["doc_id"], r["item_id"], r["distance"]) for r in found}
        assert {g for g in got if g[0] != 102} == expected and (102, 0, 0) in got
    assert leaks.find_leaks(docs, table.where("item_id < 0")).count() == 0
    assert leaks.find_leaks(docs.where("doc_id < 0"), table).count() == 0
