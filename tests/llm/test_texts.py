"""License scans, chat formatting, exact duplicates and toxicity on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidings.llm import chat, licences, recipes, toxicity

# -- licenses --------------------------------------------------------------------------


def test_templates():
    automaton = licences.compile_template(
        "Licensed <<opt>>to <<var 2>><</opt>> under the <<opt>>new<</opt>> X License"
    )
    words = lambda t: licences.words(t.encode())
    for text, end in [
        ("Licensed under the X license", 5),
        ("licensed under the NEW x, license!", 6),
        ("licensed to Ada Lovelace under the x license more", 8),
        ("licensed to under the x license", 6),
        ("licensed to a b c under the x license", None),
        ("licensed under x license", None),
        ("licensed under the x", None),
    ]:
        assert automaton.accept(words(text), 0) == end, text
    for bad in ("<<opt>>a", "<<opt>>a<</opt>>", "<<what>> a"):
        with pytest.raises(ValueError):
            licences.compile_template(bad)


@pytest.mark.parametrize("label", sorted(licences.LICENSES))
def test_whole_licenses(label):
    """Every mandatory word counts, also late in the text; regions may differ."""
    scanner = licences.Scanner(licences.TEMPLATES, licences.BASE)
    accepts = lambda t: scanner.automata[label].accept(licences.words(t.encode()), 0)
    template = licences.LICENSES[label]
    full = template.replace("<<opt>>", "").replace("<</opt>>", "").replace("<<var 8>>", "the authors or copyright holders")
    bare = re.sub("<<opt>>.*?<</opt>>", "", template).replace("<<var 8>>", "X")
    for text in (full, bare, full.lower(), full.replace(",", " ,\n * ")):
        assert accepts(text) == len(licences.words(text.encode()))
    words = bare.split()
    for place in (5, len(words) // 2, len(words) - 3):
        changed = [*words[:place], "purple", *words[place + 1 :]]
        assert accepts(" ".join(changed)) is None
        assert accepts(" ".join(words[:place] + words[place + 1 :])) is None
    assert accepts(" ".join(words[:-1])) is None
    assert accepts(full.replace("the authors or copyright holders", "a b c d e f g h i")) is None or "<<var" not in template


def test_license_scan(spark):
    rows = [
        (1, "See the MIT License. mit\nLICENSE and the mit-license."),
        (2, "GNU General Public License, version 3"),
        (3, None), (4, ""), (5, "the mit licenses, Xmit license"), (6, "Licensed under CC BY-NC 4.0."),
        (7, "Licensed under the Apache License, Version 2.0 (the License)"), (8, "é" * 40_000),
        (1, "See the MIT License. mit\nLICENSE and the mit-license."),
    ]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id LONG, text STRING, labels STRING")
    found = {r["doc_id"]: r for r in licences.license_scan(docs).collect()}
    assert licences.license_scan(docs).count() == len(rows)
    assert (found[1]["n_base"], found[1]["first_word"], found[1]["last_word"]) == (3, 2, 8)
    assert found[1]["base_labels"] == "mit"
    assert found[2]["labels"] == "gpl,gpl-3.0" and found[2]["score"] == 1.0 * 6 / 6
    for i in (3, 4):
        assert (found[i]["n_words"], found[i]["labels"], found[i]["score"]) == (0, "", 0.0)
        assert found[i]["first_word"] is None
    assert found[5]["n_base"] == 0 and found[8]["n_words"] == 1
    assert found[6]["labels"] == "cc-by-nc-4.0" and found[6]["base_labels"] == ""
    assert found[7]["labels"] == "apache,apache-2.0"
    assert licences.license_scan(docs.where("doc_id < 0")).count() == 0


# -- chat ------------------------------------------------------------------------------


def log(spark, rows):
    return spark.createDataFrame(
        rows, "conv_id LONG, seq LONG, message LONG, role STRING, kind STRING, text STRING"
    )


def test_events_fold(spark):
    events = log(spark, [
        (1, 1, 1, "user", "delta", "Hel"), (1, 2, 1, None, "delta", "lo"),
        (1, 3, 2, "assistant", "delta", "draft"), (1, 4, 2, None, "regenerate", None),
        (1, 5, 2, None, "delta", "fi"), (1, 6, 2, None, None, "nal"), (1, 7, 1, None, "edit", "Hi"),
        (1, 8, 1, None, "delta", "!"), (2, 1, 1, None, "delta", None), (None, 1, 1, "user", "delta", "x"),
    ])
    found = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in chat.fold(events).collect()}
    assert found == {
        (1, 1): ("user", "Hi!"), (1, 2): ("assistant", "final"), (2, 1): ("", ""), (None, 1): ("user", "x"),
    }
    assert chat.format_log(events.where("seq < 0")).count() == 0


def test_control_strings_come_back(spark):
    rng = random.Random(1)
    parts = ["<|im_end|>\n", "<|im_start|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "|", "\n", "a", "é🤖", "\\n"]
    rows, expected = [], {}
    for conv in range(60):
        turns = []
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "a\nb\\", "", "<|x"])
            turns.append((role, "".join(rng.choices(parts, k=rng.randint(0, 12)))))
            rows.append((conv, turn, turn, role, "delta", turns[-1][1]))
        expected[conv] = turns
    formatted = chat.format_log(log(spark, rows).repartition(3))
    for r in chat.read_back(formatted).collect():
        turns = expected[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert list(r["learned"]) == [t for role, t in turns if role == "assistant"]
        assert r["formatted"].count(chat.START) == len(turns)


# -- exact duplicates ------------------------------------------------------------------


def equal_texts(rows):
    size, best = Counter(), {}
    for i, t in rows:
        size[t or ""] += 1
        best[t or ""] = max(best.get(t or "", i), i)
    return {(i, best[t or ""], size[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    rng = random.Random(2)
    long = [" ".join(rng.choices(["aa. ", "b\n", "ccc", "é"], k=4000)) for _ in range(3)]
    texts = [None, "", "a", "a", "b", "a\n", *long, *long, long[0][:-1], long[0] + "a", "x" * 9000, "y" * 9000]
    rows = list(enumerate(texts)) + [(3, "a")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id LONG, text STRING, kept INT")
    kind = {"chunk_id": lambda c: F.length(c).cast("long")} if weak else {}
    found = recipes.exact_groups(docs.repartition(3), **kind).collect()
    assert len(found) == len(rows)
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found}
    assert got == equal_texts(rows)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in found)
    assert recipes.exact_groups(docs.where("doc_id < 0"), **kind).count() == 0


def test_chunks_follow_content(spark):
    rng = random.Random(4)
    sentences = [f"Sentence {i} says {'so ' * rng.randint(0, 40)}{i * i}." for i in range(3000)]
    text, moved = " ".join(sentences), " ".join(sentences[7:])
    rows = spark.createDataFrame([(text,), (moved,), ("z" * 10_000,)], "text STRING")
    cut = [r[0] for r in rows.select(recipes.chunks(F.col("text"))).collect()]
    assert ["".join(c) for c in cut] == [text, moved, "z" * 10_000]
    assert len(cut[0]) > 20 and len(set(cut[0]) & set(cut[1])) >= 0.9 * len(cut[0])
    assert max(map(len, cut[2])) <= 4096


# -- toxicity --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(6)
    plain = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8))) for _ in range(500)]
    texts, labels = [], []
    for i in range(500):
        words = rng.choices(plain, k=rng.randint(20, 300))
        if i % 3 == 0:
            for _ in range(2 + len(words) // 60):
                words[rng.randrange(len(words))] = "vex" + rng.choice(["ed", "ing", "er", "ous"]) + rng.choice("aeiou")
        texts.append(" ".join(words))
        labels.append(float(i % 3 == 0))
    return texts, np.array(labels, np.float32)


def test_network_learns_spellings(labelled):
    texts, labels = labelled
    network = toxicity.train(texts[:400], labels[:400], 0.33)
    found = network.probabilities(toxicity.Words(pa.array(texts[400:] + ["", "!!"])))
    right = (found[:100] >= 0.5) == (labels[400:] == 1)
    assert right.mean() >= 0.9
    assert found[100] == found[101] == pytest.approx(0.33)
    again = toxicity.train(texts[:400], labels[:400], 0.33)
    assert np.array_equal(again.p["out"], network.p["out"])


def test_misspelt_words_raise_the_score(labelled):
    """Clean texts with two marking words, two letters of each swapped, score above clean ones."""
    rng = random.Random(8)
    marks = ["villain", "rubbish", "coward", "hideous", "parasite", "blockhead"]
    texts = []
    for text, label in zip(*labelled):
        words = [w for w in text.split(" ") if not w.startswith("vex")]
        for _ in range(3 if label else 0):
            words.insert(rng.randrange(len(words)), rng.choice(marks))
        texts.append(" ".join(words))
    network = toxicity.train(texts[:400], labelled[1][:400], 0.33)
    clean = [t for t, y in zip(texts[400:], labelled[1][400:]) if not y]
    planted = []
    for text in clean * 3:
        words = text.split(" ")
        for mark in rng.sample(marks, 2):
            at = rng.randrange(1, len(mark) - 1)
            words.insert(rng.randrange(len(words)), mark[:at] + mark[at + 1] + mark[at] + mark[at + 2 :])
        planted.append(" ".join(words))
    found = [network.probabilities(toxicity.Words(pa.array(t))) for t in (clean, planted)]
    assert (found[1] > np.quantile(found[0], 0.9)).mean() >= 0.5


def test_some_training_texts_of_both_labels_are_misspelt(labelled, monkeypatch):
    """Those that calibrate stay as they are; a changed word is still close to its own."""
    seen, of = [], toxicity.Words.of
    monkeypatch.setattr(toxicity.Words, "of", staticmethod(lambda texts: seen.append(texts) or of(texts)))
    monkeypatch.setattr(toxicity, "MOST_EPOCHS", 1)
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    texts, labels = labelled[0], labelled[1]
    toxicity.train(texts, labels, 0.33)
    given = [(t, y) for i, (t, y) in enumerate(zip(texts, labels)) if i % 5]
    changed = [y for t, (own, y) in zip(seen[0], given) if t != own]
    assert 0.1 * len(given) < len(changed) < 0.5 * len(given) and {0.0, 1.0} <= set(map(float, changed))
    assert seen[1] == texts[::5]
    for text, (own, _) in zip(seen[0], given):
        assert all(abs(len(a) - len(b)) <= 3 for a, b in zip(text.split(" "), own.split(" "), strict=True))


def test_gradients_are_those_of_the_loss():
    network = toxicity.Network(1)
    for k, v in network.p.items():
        network.p[k] = v.astype(np.float64)
    words = toxicity.Words(pa.array(["one two three four", "five six"]))
    start, size, row = words.windows()
    x, live = toxicity._cut(network.inputs(words).astype(np.float64), start, size)
    y = np.array([1.0, 0.0])

    def loss():
        q = toxicity._sigmoid(network.scores(x, live))
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    gradients, _ = network.gradients(x, live, y)
    for name in ("again_f", "in_b", "attend", "out", "bias_f", "attend_to"):
        flat = network.p[name].reshape(-1)
        for at in (0, len(flat) // 2):
            was = flat[at]
            flat[at] = was + 1e-3
            up = loss()
            flat[at] = was - 1e-3
            down = loss()
            flat[at] = was
            assert gradients[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-3, rel=0.03, abs=2e-5)


def test_windows_cover_every_word():
    for n in (1, 64, 65, 112, 113, 1000):
        words = toxicity.Words(pa.array([" ".join(["w"] * n), "", "x"]))
        start, size, row = words.windows()
        mine = [(a, a + s) for a, s, r in zip(start, size, row) if r == 0]
        assert {w for a, b in mine for w in range(a, b)} == set(range(n))
        assert max(b - a for a, b in mine) <= toxicity.WINDOW
    whole = toxicity.Words.of(["a bc", "", "déf " * 9])
    one = toxicity.Words(pa.array(["a bc", "", "déf " * 9]))
    assert np.array_equal(whole.first, one.first) and np.array_equal(whole.begin, one.begin)
    assert all(np.array_equal(a, b) for a, b in zip(whole.grams, one.grams))
    assert np.array_equal(whole.part(2, 3).word, one.word[2:])


def test_scores_of_a_table(spark, labelled):
    texts, labels = labelled
    rows = [(i, t, 0.5, "k") for i, t in enumerate(texts[:200])] + [(900, None, 0.1, "k"), (901, "", 0.1, "k")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, score DOUBLE, label STRING")
    known = [(i, int(y), 1) for i, y in enumerate(labels[:200])]
    table = spark.createDataFrame(known + [(3, None, 1), (5, 7, 1)], "doc_id LONG, toxic INT, quality INT")
    network = toxicity.fit(docs, table)
    # flipping every held out label changes nothing
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y, 1) for i, y, _ in known]
    other = toxicity.fit(docs, spark.createDataFrame(flipped, "doc_id LONG, toxic INT, quality INT"))
    assert np.array_equal(network.p["out"], other.p["out"])
    found = toxicity.score(docs, network).collect()
    assert len(found) == 202 and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["predicted"] == int(r["score"] >= 0.5) and r["label"] == "k" for r in found)
    nothing = toxicity.fit(docs, table.where("doc_id < 0"))
    scores = [r["score"] for r in toxicity.score(docs, nothing).collect()]
    assert max(scores) - min(scores) < 1e-5  # the base rate, up to rounding
    assert toxicity.score(docs.where("doc_id < 0"), network).count() == 0
