"""Personal data, divergence of sources and repair of conversations against plain versions."""

import hashlib
import heapq
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidings.llm import divergence, personal, repair
from tidings.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"

# -- personal data ---------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def strict(text):
    """The fixed patterns as they are stated."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(s))]
        return sum(d // 10 + d % 10 for d in doubled) % 10 == 0

    good = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s)),
        "phone": lambda s: 9 <= len(digits(s)) <= 15,
    }
    return {
        k: [m.span() for m in re.finditer(p, text) if good[k](m.group())]
        for k, p in PATTERNS.items()
    }


def test_strict_spans_equal_the_patterns():
    rng = random.Random(5)
    parts = ["a", "b.", "@", "@", "1", "2", ".", "-", " ", "+", "(", "25", ".1", "é", "\n",
             "4111111111111111", "0000", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert personal.base_spans(text) == strict(text), text


@pytest.mark.parametrize(
    "text", ["1" * 300_000, "1 " * 150_000, "1." * 150_000, "a@" * 150_000, "x" * 300_000 + "@",
             "+1" + " " * 300_000, "a at b dot " * 30_000, "f:" * 150_000, "((" * 150_000]
)
def test_long_texts_take_linear_time(text):
    start = time.perf_counter()
    personal.base_spans(text)
    personal.proposals(text)
    assert time.perf_counter() - start < 5


@pytest.fixture(scope="module")
def contexts():
    rng = random.Random(3)
    words = "the old mill stood by a river and nobody knew who had built it there".split()
    return [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) for _ in range(240)]


@pytest.fixture(scope="module")
def model(contexts):
    return personal.train(contexts)


def test_held_out_accuracy(contexts, model):
    """Fresh inventions in fresh texts: most are found, few look-alikes are."""
    made, found, planted, wrong, alike = personal.Inventor(99), Counter(), Counter(), 0, 0
    for text in contexts[:150]:
        whole, known = personal.planted(text[::-1], made)
        _, spans = personal.find(whole, model)
        got = {(k, s, e) for s, k, e, _ in spans}
        for kind, start, end in known:
            if kind >= 0:
                planted[kind] += 1
                found[kind] += (kind, start, end) in got
            elif not any(personal.base_spans(whole[start:end]).values()):
                alike += 1
                wrong += any(s < end and start < e for _, s, e in got)
    assert sum(found.values()) >= 0.8 * sum(planted.values())
    assert all(found[k] >= 0.6 * planted[k] for k in range(4))
    assert wrong <= 0.15 * alike


def test_trees_learn_and_thresholds_hold():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = personal.boost(x[:1000], y[:1000], np.ones(1000))
    assert ((trees.scores(x[1000:]) > 0) == y[1000:]).mean() > 0.97
    p = np.array([0.9, 0.9, 0.8, 0.7, 0.7, 0.6])
    y = np.array([1, 1, 1, 0, 1, 0])
    assert personal.threshold(p, y, 0.8) == 0.7
    assert personal.threshold(p, y, 1.0) == 0.8
    assert personal.threshold(p, np.zeros(6), 0.5) == float("inf")


def test_added_spans_overlap_nothing(contexts, model):
    made = personal.Inventor(4)
    for text in contexts[:100]:
        whole, _ = personal.planted(text, made)
        base, spans = personal.find(whole, model)
        strict_spans = {(s, e) for v in base.values() for s, e in v}
        added = [(s, e) for s, _, e, p in spans if (s, e) not in strict_spans]
        for s, e in added:
            others = [o for o in strict_spans | set(added) if o != (s, e)]
            assert all(oe <= s or e <= os for os, oe in others)
        for k, kind in enumerate(personal.KINDS):
            assert {(s, k, e) for s, e in base[kind]} <= {(s, q, e) for s, q, e, _ in spans}


def test_table_of_personal_data(spark):
    texts = [None, "", "mail a.b@c.org or 10.0.0.1, +49 (286) 555-5136.", "é 4111 1111 1111 1111", "x"]
    rows = [(i, t, t, t) for i, t in enumerate(texts)] + [(2, texts[2], "", ""), (None, texts[3], "", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, n_email string")
    for fitted in (personal.fit(docs), None):
        found = personal.find_personal(docs, fitted).collect()
        assert len(found) == len(rows)
        for r in found:
            text = dict(enumerate(texts)).get(r["doc_id"], texts[3]) or ""
            base = strict(text)
            assert [r[f"n_{k}"] for k in personal.KINDS] == [len(base[k]) for k in personal.KINDS]
            assert {(s["kind"], s["start"], s["end"]) for s in r["base"]} == {
                (k, *s) for k in base for s in base[k]
            }
    by_id = {r["doc_id"]: r["redacted"] for r in found}
    assert by_id[2] == "mail [EMAIL] or [IP], [PHONE]." and by_id[None] == "é [CARD]" and by_id[0] == ""
    empty = docs.limit(0)
    assert personal.fit(empty) is None and personal.find_personal(empty, None).count() == 0


def test_personal_query_lists_its_base_spans(spark):
    found = QUERIES["op11_personal_data"](spark, SF).toPandas().set_index("doc_id")
    texts = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")["text"]
    assert len(found) == len(texts) and found.index.is_unique
    for key, row in found.iterrows():
        base = strict(texts[key] or "")
        order = sorted((s, i, f"{k}:{s}:{e}") for i, k in enumerate(PATTERNS) for s, e in base[k])
        listed = ",".join(o[2] for o in order)
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(row["spans"].split(","))


# -- divergence ------------------------------------------------------------------------


def test_terms_of_a_text(monkeypatch):
    rng = random.Random(2)
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for piece in (1 << 20, 7):
        monkeypatch.setattr(divergence, "PIECE", piece)
        for _ in range(500):
            text = "".join(rng.choice("aBzZ é\xa0ÄÉ\0@[`{~ 1\n\t") for _ in range(rng.randint(0, 60)))
            want = Counter(t.encode() for t in pattern.findall(text.translate(lower)))
            assert divergence.count_terms(text.encode()) == want


def divergence_by_hand(rows, least, top):
    """The contract, term by term and source by source."""
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, n, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        terms = Counter(pattern.findall(text.translate(lower)))
        for t, c in terms.items():
            df[lang, t] += 1
            n[lang, source, t] += c
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (k, t), d in df.items() if k == lang and d >= least)
        sources = sorted(s for k, s in groups if k == lang)
        total = {s: sum(n[lang, s, t] for t in kept) for s in sources}
        whole = sum(total.values())

        def p(count, size):
            return 1 + 10**9 * (count + 5) // (size + 5 * len(kept))

        for a in sources:
            found = []
            for b in sources:
                if a != b:
                    value = sum(abs(p(n[lang, a, t], total[a]) - p(n[lang, b, t], total[b])) for t in kept)
                    found.append((-value, b.encode(), "pair", b))
            terms = []
            for t in kept:
                q = p(sum(n[lang, s, t] for s in sources), whole)
                mine = p(n[lang, a, t], total[a])
                if n[lang, a, t] and mine > q:
                    terms.append((q - mine, t.encode(), "term", t))
            for part in (sorted(found), sorted(terms)[:top]):
                out |= {(lang, a, kind, item, -v, r) for r, (v, _, kind, item) in enumerate(part, 1)}
    return out


def test_divergence_against_a_plain_version(spark, monkeypatch):
    """Several blocks of sources, gaps, repeated rows, a language without terms, a long text."""
    monkeypatch.setattr(divergence, "PARTS", 2)
    rng = random.Random(8)
    rows = []
    for k in range(400):
        words = " ".join(rng.choice("Ab cd ef éA gh ij kl".split()) for _ in range(rng.randint(0, 9)))
        rows.append((words, rng.choice(["en", "de", None]), f"s{rng.randint(0, 7)}"))
    rows += [(None, "en", None), ("", "xx", "a"), ("1 2", "xx", "b"), ("ab " * 5000, "en", "s0")] + rows[:9]
    table = spark.createDataFrame(rows, "text string, lang string, source string")
    docs = table.selectExpr("*", "1 as term", "2 as n", "cast(null as int) as rank", "3 as value")
    found = divergence.divergence_audit(docs, min_docs=5, top=3, block=3).collect()
    got = {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in found}
    assert len(got) == len(found) and got == divergence_by_hand(rows, 5, 3)
    assert divergence.divergence_audit(docs.limit(0)).count() == 0


def test_partial_counts_are_handed_on_in_rounds(monkeypatch):
    """What a task holds is bounded; sums do not depend on the rounds."""
    batch = pa.RecordBatch.from_pydict(
        {"lang": ["en"] * 4, "source": ["a", "b", "a", "a"], "text": ["x y", "x", "y y z", None]}
    )
    seen = []
    for held in (1, 1000):
        monkeypatch.setattr(divergence, "HELD", held)
        made = [tuple(r.values()) for b in divergence._partial(iter([batch])) for r in b.to_pylist()]
        sums = Counter()
        for lang, source, term, n, docs in made:
            sums[lang, source, term] += n
            sums[lang, source, term, "docs"] += docs
        seen.append((len(made), sums))
    assert seen[0][0] > seen[1][0] and seen[0][1] == seen[1][1]
    assert seen[1][1]["en", "a", b"y"] == 3 and seen[1][1]["en", "a", b"y", "docs"] == 2


def test_shares_are_exact_for_large_counts(spark):
    row = spark.sql("select 9000000000000000 as n, 9000000000000001 as total, 7L as v")
    got = row.select(divergence.share("n", "total", "v").alias("p")).first()["p"]
    assert got == 1 + 10**9 * (9 * 10**15 + 5) // (9 * 10**15 + 1 + 35)


# -- conversations ---------------------------------------------------------------------


def cheapest(rows):
    """Least cost, then least audit, by search over whole edit strings.

    ``rows`` has role, text and fault; states are last initials.
    """
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, lines = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(lines)
        if (at, last) in done:
            continue
        done.add((at, last))
        fits = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        role = {"u": "user", "a": "assistant"}[fits[-1]]
        heapq.heappush(heap, (cost + 5, audit + "I", at, role[0], (*lines, f"{role}:")))
        if at == len(rows):
            continue
        given, text, fault = rows[at]
        heapq.heappush(heap, (cost + 2, audit + "D", at + 1, last, lines))
        if fault not in ("blank", "duplicate"):
            extra = 5 * (fault == "truncated")
            if given[:1] and given[:1] in fits:
                heapq.heappush(heap, (cost + extra, audit + "K", at + 1, given[0], (*lines, f"{given}:{text}")))
            heapq.heappush(heap, (cost + 1 + extra, audit + "R", at + 1, role[0], (*lines, f"{role}:{text}")))
    raise AssertionError


def audit_by_hand(rows):
    """Everything of the contract for one conversation's rows ``turn, role, text``."""
    space = " \t\n\x0b\x0c\r"
    said = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][: repair.HEAD], said(r)))
    judged, seen, counts = [], set(), Counter()
    for turn, role, text in rows:
        body = text.rstrip(space)
        fault = (
            "blank" if not body.strip(space) else "duplicate" if (role, text) in seen
            else "truncated" if body[-1] not in ".!?" else ""
        )
        seen.add((role, text))
        counts[fault] += 1
        judged.append((role, text, fault))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, text = cheapest(judged)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, text)


def broken(rng, count):
    """Conversations of all kinds of faults; texts that differ in case and blanks repeat."""
    rows = []
    for conv in range(count):
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            turn = rng.choice([None, *range(-2, 9)])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u"])
            text = rng.choice(["Ok.", "Why?", "no end", " \t", "", "x" * 70 + ".", "x" * 70 + "!", "A. \n", "é"])
            rows.append((conv, turn, role, text))
    return rows


def test_audits_against_search(spark, monkeypatch):
    rng = random.Random(6)
    rows = broken(rng, 60) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes.")]
    rows += [(77, k, "user", "so on") for k in range(40)] + [(78, k % 5, "assistant", "Go.") for k in range(30)]
    monkeypatch.setattr(repair, "UNROLLED", 4)
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    for width in (1, 7):  # pieces of conversations
        monkeypatch.setattr(repair, "shuffle_width", lambda _: width)
        audited = repair.stage(repair.audits(table), "test")
        left = repair.repaired(table, audited).collect()
        digests = {r[0]: r[1] for r in repair.digests(repair.repaired(table, audited)).collect()}
        lines = {}
        for r in left:
            lines.setdefault(r["conv_id"], {})[r["place"]] = f"{r['role']}:{r['text']}"
        for r in audited.collect():
            own = [x[1:] for x in rows if x[0] == r["conv_id"]]
            *counts, text = audit_by_hand(own)
            got = tuple(r[c] for c in (*repair._COUNTS, "audit"))
            assert got == tuple(counts), (own, width)
            mine = lines.get(r["conv_id"], {})
            assert "\n".join(mine[k] for k in range(len(mine))) == text
            if mine:
                assert digests[r["conv_id"]] == hashlib.sha256(text.encode()).hexdigest()
    assert audited.count() == len({r[0] for r in rows})


def test_runs_by_binary_powers():
    """A run of any length equals its rows one by one."""
    for symbol in range(9):
        step = repair.run_matrix(symbol, 1)
        whole = repair.UNIT
        for count in range(1, 40):
            whole = repair._product(whole, step)
            assert whole == repair.run_matrix(symbol, count) == repair.advance(repair.UNIT, symbol, count)
    audit, state = repair.choose([(3, 1), (5, 1)] * 3 + [(3, 100_000)], repair.FINISH, 0)
    assert len(audit) == 100_006 and state in (0, 3)


def test_damage_follows_the_hash(spark):
    rows = [(c, t, "assistant", f"T{c}. Go! {t}?") for c in range(30) for t in range(6)]
    rows += [(None, None, None, None), (5, None, None, "x"), (None, 3, "user", None)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    want = []
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        fate = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        want += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    got = [tuple(r) for r in repair.damage(table).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_every_conversation_is_reported(spark):
    """Also those that lose all rows; NULL ids, clashing columns and empty tables do no harm."""
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Hi.", 1), (None, 4, "user", None, 2), (None, 4, None, "Ja.", 3)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, cost int")
    found = {r["conv_id"]: r.asDict() for r in repair.audit_report(table).collect()}
    assert set(found) == {dropped, None}
    empty = found[dropped]
    assert empty["audit"] == "" and empty["cost"] == empty["gaps"] == 0
    assert empty["repaired_sha256"] == hashlib.sha256().hexdigest()
    assert repair.audit_report(table.limit(0)).count() == 0


@pytest.mark.parametrize("sql", [divergence.SQL, repair.SQL])
def test_sql_is_valid_on_small_tables(sql):
    connection = duckdb.connect()
    for name in ("documents", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert len(connection.sql(sql).fetchall()) > 0
