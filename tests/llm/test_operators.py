"""The training-data operators against brute force, round trips, held-out accuracy and odd input."""

import gc
import hashlib
import json
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from parchline.llm import bpe, chat, chunks, common, decontaminate, minhash, quality, rules, secrets, toxicity, urls
from parchline.llm.common import word_hashes
from parchline.llm.labelled import calibrate
from parchline.llm.queries import ALLOW, BLOCK, QUERIES, tokenizer
from parchline.llm.sql import ORACLE_SQL

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, n bigint, bands string, ids string, hits int, secrets string"
LONG = "long words of a very long text " * 20_000


def table(spark, rows):
    """Rows (id, text) with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "b", "i", 0, "s") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "a null id"), (5, "same row"), (5, "same row"), (6, LONG), (7, "one")]


# --- stage tables ---


def test_written_tables_release_the_drivers_memory(spark, monkeypatch):
    """A full heap's garbage goes once a table is written, and the native heap is trimmed."""
    held = spark._jvm.java.lang.ref.WeakReference(spark._jvm.java.util.ArrayList())
    gc.collect()
    stage = common.Stage(spark, "release")
    monkeypatch.setattr(common, "FULL_HEAP", 0.0, raising=False)
    assert stage.save(spark.range(3), "a").count() == 3
    assert held.get() is None
    assert common.release(spark).startswith("Trim native heap")
    stage.drop()


# --- near duplicates ---


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORDS.findall(low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_minhash_matches_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 120))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    chain = [rng.choice(vocabulary) for _ in range(150)]  # each text is like its neighbour only
    for k in range(10):
        rows.append((len(rows), " ".join(chain[6 * k : 6 * k + 90])))
    got = {r.doc_id: r for r in minhash.near_duplicates(table(spark, rows)).collect()}
    want = brute_components(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(shingles(rows[i][1])) and r.kept == (i == want[i]) for i, r in got.items())


def test_minhash_odd_input(spark):
    got = minhash.near_duplicates(table(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert [r.n_shingles for r in got if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert all(r.component_id == r.doc_id for r in got)
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    from parchline.llm.common import Stage

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)], "a bigint, b bigint")
    got = {r.node: r.root for r in minhash.components(Stage(spark, "test"), edges, "t").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


# --- byte pairs ---


def test_bpe_is_exact(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = tokenizer()
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(path))}
    ours = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    texts = ["a" * 3000, "ab" * 900 + "!" * 400, "日本語のテキスト" * 60, "\n\n  \t x " * 30, "don't we'll  I'M", "🙂👍🏽" * 40, "<|endoftext|>"]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    rows = list(enumerate(texts)) + ODD[:7]
    out = bpe.encode(table(spark, rows), path, pattern, decode_back=True).collect()
    assert len(out) == len(rows)
    for (_, text), r in zip(rows, out):
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ours.encode_ordinary(text or "")
        assert bytes(r.decoded) == (text or "").encode() and r.n_tokens == len(r.ids) // 4
    again = bpe.decode(spark.createDataFrame([(1, bytearray(out[2].ids)), (2, None)], "doc_id int, ids binary"), path).collect()
    assert [bytes(r.decoded) for r in again] == [texts[2].encode(), b""]


def test_long_words_are_exact_and_quick():
    """Words of any make, whole steps at a time, against the public library."""
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = tokenizer()
    tokens = bpe.read_ranks(path)
    ours = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    codec, rng = bpe.Codec(tokens, pattern), random.Random(4)
    letters = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    words = [letters("etaoinshrdlu", 20_000), "a" * 3001, "ab" * 2000, letters("ab", 3000), letters("ACGT", 3000), letters("日本語のテキスト", 900), letters(["the", "ing", "tion", "un"], 900), "=-" * 700 + "=" * 333]
    words += [letters("etaoinshrdlu'é ", rng.randrange(bpe.LONG, 400)) for _ in range(500)]
    began = time.time()
    got = codec.contract([w.encode() for w in words])
    assert time.time() - began < 30
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ours._encode_single_piece(w.encode()) for w in words]


def test_codecs_go_by_content():
    """A vocabulary at the place of a freed one isn't taken for it."""
    class Shared:
        def __init__(self, value):
            self.value = value

    one, two = [bytes([b]) for b in range(256)], [bytes([b]) for b in range(255, -1, -1)]
    for digest, tokens, want in (("a", one, 97), ("b", two, 158), ("a", one, 97)):
        assert np.frombuffer(bpe._codec(Shared((digest, tokens)), r"\S+").encode(["a"])[0], "<u4").tolist() == [want]


# --- secrets ---

KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def brute_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_base_secrets_match_brute_force(spark):
    rng = random.Random(3)
    bits = ["password", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdefgh1", "short", "AKIA", "ABCD1234EFGH", "0af9" * 9, "é🙂", "\n", "secret", "."]
    rows = ODD + [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    out = secrets.scan(table(spark, rows)).selectExpr("text", secrets.joined_spans("secrets.base") + " b").collect()
    assert len(out) == len(rows) and all(r.b == brute_spans(r.text) for r in out)


def test_weak_parts_need_complements(spark):
    value = "Zx9" + "aB3" * 8
    rows = [(1, f"a lone {value} here"), (2, f"user=bob and {value}"), (3, f"user=bob {'x ' * 200} {value}"), (4, f"user=bob\n\n{value}"), (5, "see https://h.example.com only"), (6, "login: ann password: hunter2hunter2 https://h.example.com")]
    out = {r.doc_id: [s.kind for s in r.secrets.linked] for r in secrets.scan(table(spark, rows)).collect()}
    assert out == {1: [], 2: ["user", "value"], 3: [], 4: [], 5: [], 6: ["user", "endpoint"]}
    clean = {r.doc_id: r.text for r in secrets.redact(table(spark, rows + [(7, None)])).collect()}
    assert clean[2] == "[REDACTED] and [REDACTED]" and clean[1] == rows[0][1] and clean[7] is None


WEAK = [
    ("user", re.compile(secrets.USER), lambda m: True),
    ("endpoint", re.compile(secrets.ENDPOINT), lambda m: True),
    ("value", re.compile(secrets.VALUE), lambda m: all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))),
]
ROLE = {"access": "identifier", "user": "identifier", "endpoint": "endpoint"}


def brute_linked(text):
    """Base and linked spans by comparing every part with every other one."""
    parts = [(m.start(), m.end(), kind) for kind, p, ok in KINDS + WEAK for m in p.finditer(text) if ok(m)]
    breaks = [m.start() for m in re.finditer("\n[ \t]*\n", text)]
    scope = lambda p: sum(b < p[0] for b in breaks)
    base = [p for p in parts if p[2] in ("assign", "access", "hex")]
    linked = []
    for p in parts:
        near = {ROLE.get(q[2], "secret") for q in parts if q is not p and scope(q) == scope(p) and p[0] - q[1] <= secrets.REACH and q[0] - p[1] <= secrets.REACH}
        inside = any(q[0] <= p[0] and q[1] >= p[1] for q in base)
        wants = {"user": "secret" in near, "endpoint": {"identifier", "secret"} <= near, "value": bool(near & {"identifier", "endpoint"}) and not inside}
        linked += [p] if wants.get(p[2]) else []
    return sorted(base), sorted(linked)


def test_linked_parts_match_pairwise_join(spark):
    rng = random.Random(1)
    bits = ["password", "TOKEN", "=", ":", " ", "abcdefgh1", "AKIA", "ABCD1234EFGH", "0af9" * 9, "é🙂", "\n", "\n\n", "user=bob", "https://h.example.com", "Zx9" + "aB3" * 8, "x " * 60, "login: ann", "\n \n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 60)))) for i in range(600)]
    clean = {r.doc_id: r.text for r in secrets.redact(table(spark, rows)).collect()}
    n = 0
    for r in secrets.scan(table(spark, rows)).collect():
        base, linked = brute_linked(r.text)
        assert [(s.start, s.end, s.kind) for s in r.secrets.base] == base and [(s.start, s.end, s.kind) for s in r.secrets.linked] == linked
        n, at, want = n + len(linked), 0, ""
        for a, b, _ in sorted(base + linked):
            want, at = want + (r.text[at:a] + "[REDACTED]" if a >= at else ""), max(at, b)
        assert clean[r.doc_id] == want + r.text[at:]
    assert n > 1000


def test_texts_full_of_parts(spark):
    """Work follows n log n: a megabyte of parts takes seconds."""
    text = "password: abcdefgh1 \n\nuser: bob " * 32_000
    began = time.time()
    row = secrets.scan(table(spark, [(1, text)])).selectExpr("size(secrets.base) b", "size(secrets.linked) l").first()
    assert (row.b, row.l) == (32_000, 31_999)
    assert secrets.redact(table(spark, [(1, text)])).first().text.count("[REDACTED]") == 63_999 and time.time() - began < 60


# --- quality rules ---


def brute_rules(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    hit = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_rules_match_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["ab", "c", "é", " ", " ", "\n", "\t", "#", "|"]) for _ in range(rng.randrange(0, 200)))) for i in range(200)]
    rows += [(1000, "line one of it\n" * 30), (1001, os.urandom(3000).hex())] + ODD
    out = rules.judge(table(spark, rows)).collect()
    for (_, text), r in zip(rows, out):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    assert rules.Compressor().judge(b"la " * 2000)[3] is False and rules.Compressor().judge(os.urandom(4000))[3] is False


def test_last_chunk_is_judged():
    """A rest under SHORTEST bytes counts with the last chunk."""
    fine = " ".join(f"word{i * 7919 % 1000}" for i in range(5000)).encode()
    judge = rules.Compressor().judge
    assert judge(fine[: rules.CHUNK + 150])[1] == 1 and judge(fine[: rules.CHUNK + 250])[1] == 2 and judge(fine[: 2 * rules.CHUNK])[1] == 2
    long = os.urandom(rules.FEED + 5000)
    assert rules.Compressor().ratio(long) == pytest.approx(1.0, abs=0.01)


def test_words_that_fool_polynomials():
    """Thue-Morse words collide under every base modulo a power of two."""
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - b for b in bits]
    one, two = bytes(97 + b for b in bits), bytes(98 - b for b in bits)
    a, b = word_hashes([b"aa bb cc dd " + one, b"aa bb cc dd " + two], lower=True)
    assert (a[:4] == b[:4]).all() and a[4] != b[4]
    huge = b"x" * 100_000
    a = word_hashes([huge + b" y " + huge[:-1] + b" " + huge], lower=False)[0]
    assert a[0] == a[3] and a[0] != a[2]


# --- chunks ---


def test_passages_survive_shifts(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage = prose(120)
    rows = [(i, prose(40 + i) + " " + passage + " " + prose(30)) for i in range(6)] + [(10 + i, prose(200)) for i in range(6)] + [(20, prose(3) + "\n" + prose(90) * 2)]
    got = {r.doc_id: r for r in chunks.repeated_passages(table(spark, rows)).collect()}
    assert {i for i, r in got.items() if r.n_repeat_bytes} == set(range(6))
    for i in range(6):
        p = got[i].passages[0]
        assert rows[i][1][p.start : p.end] in " " + passage + " " and p.end - p.start > 0.7 * len(passage)
    assert got[0].n_extra_bytes == 0 and got[3].n_extra_bytes > 0 and got[12].n_extra_bytes == 0


def test_passages_of_pairs_are_whole(spark):
    """51 words that two documents share, wherever they stand; also lines that repeat themselves."""
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    shared = [words(51) for _ in range(60)] + ["- - = " * 60, "a line of the table\n" * 20]
    rows = [(2 * k + j, words(rng.randrange(5, 60)) + " " + p + " " + words(rng.randrange(5, 60))) for k, p in enumerate(shared) for j in (0, 1)]
    got = {r.doc_id: r for r in chunks.repeated_passages(table(spark, rows)).collect()}
    assert [i for i, t in rows if len(shared[i // 2]) >= 286 and not got[i].n_repeat_bytes] == []
    assert all(t[p.start : p.end] in " " + shared[i // 2] + " " for i, t in rows for p in got[i].passages)


def test_cuts_depend_on_neighbours_only():
    rng = random.Random(12)
    passage = bytes(rng.randrange(97, 123) for _ in range(3000))
    ends = {tuple(e - k for e in chunks.cut(os.urandom(k) + passage) if k + 200 <= e < k + 3000) for k in range(1, 60)}
    assert len(ends) == 1
    long = bytes(rng.randrange(97, 123) for _ in range(chunks.PIECE + 5000))
    late = chunks.PIECE - 3000
    assert [e - late for e in chunks.cut(long) if e > late + 200] == [e for e in chunks.cut(long[late:]) if e > 200]


def test_chunks_cover_texts():
    rng = random.Random(6)
    for n in (0, 1, 27, 28, 5000, 70_000):
        text = bytes(rng.randrange(97, 103) for _ in range(n))
        ends = chunks.cut(text)
        assert (ends[-1] if ends else 0) == n and all(b - a <= chunks.MAX_CHUNK for a, b in zip([0] + ends, ends))
    assert chunks.cut(b"x" * 2000)[:2] in ([512, 1024], [28, 56])


def test_chunks_odd_input(spark):
    got = chunks.repeated_passages(table(spark, ODD)).collect()
    assert len(got) == len(ODD) and chunks.repeated_passages(table(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_chunk_query_returns_every_document(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = QUERIES["op6_chunk_dedup"](spark, SMALL)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


# --- decontamination ---


def levenshtein(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for j, q in enumerate(p, 1):
            new.append(min(row[j - 1] + (q != c), row[j] + 1, new[-1] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_myers_matches_dynamic_program():
    rng = random.Random(2)
    for _ in range(200):
        p = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 40)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 80)))
        assert decontaminate.Pattern(p).best(t)[0] == levenshtein(p, t)


def test_hits_match_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(8, 40)))) for k in range(15)] + [(90, ""), (91, None)]
    rows = []
    for k, item in items[:15]:
        for edits in (0, decontaminate.budget(decontaminate.fold(item)), 3 * decontaminate.budget(decontaminate.fold(item)) + 6):
            y = list(item)
            for _ in range(edits):
                y[rng.randrange(len(y))] = "Q"
            rows.append((len(rows), " ".join(word() for _ in range(30)) + "  " + "".join(y).upper() + "\n" + " ".join(word() for _ in range(10))))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, h.item_id): h.distance for r in decontaminate.matches(table(spark, rows + ODD[:4]), bench).collect() for h in r.hits}
    want = {}
    for i, text in rows:
        for k, item in items[:15]:
            d = levenshtein(decontaminate.fold(item), decontaminate.fold(text))
            if d <= decontaminate.budget(decontaminate.fold(item)):
                want[i, k] = d
    assert got == want and len(want) >= 30
    parts = {(r.doc_id, h.item_id): h.distance for r in decontaminate.matches(table(spark, rows), bench, part_bytes=600).collect() for h in r.hits}
    assert parts == want
    kept = decontaminate.clean(table(spark, rows + ODD), bench)
    assert kept.columns == table(spark, []).columns and kept.count() == len(rows) + len(ODD) - len({i for i, _ in want})


# --- classifiers ---


@pytest.mark.skipif(not os.path.isdir(MIDDLE), reason="no test tables")
@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(spark, module, label):
    rows = duckdb.execute(f"SELECT doc_id, text, {label} FROM '{MIDDLE}/documents.parquet' JOIN '{MIDDLE}/labels.parquet' USING (doc_id)").fetchall()
    model = module.train(spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet"))
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % module.PARTS == module.HELD_OUT]
    right = [(model.score(t.encode()) >= module.THRESHOLD) == bool(y) for t, y in held]
    caught = [r for r, (_, y) in zip(right, held) if y == 1]
    print(label, len(held), np.mean(right), len(caught), np.mean(caught))
    assert len(held) > 300 and np.mean(right) > 0.97 and np.mean(caught) > 0.85


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifier_odd_input(spark, module):
    model = module.fit([b"fine words here", b"nasty trash here"] * 20, [0, 1] * 20)
    out = module.score(table(spark, ODD), model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert module.score(table(spark, []), model).count() == 0
    assert module.fit([b"x"], [1]).score(b"x") == 0.0


def test_calibration_of_equal_sums():
    """Texts without any weighted feature, whose sums are all equal, aren't cut apart nor called toxic."""
    reach = lambda raw, y: [a * r + b >= np.log(0.7 / 0.3) for a, b in [calibrate(np.array(raw), np.array(y), 0.7)] for r in raw]
    assert reach([0.0] * 10, [0] * 8 + [1] * 2) == [False] * 10
    assert reach([0.0] * 9 + [2.0], [0] * 8 + [1] * 2) == [False] * 9 + [True]


def test_convolution_matches_positions():
    """The network's sum, part by part, against one position after the other."""
    rng = np.random.default_rng(1)
    q = quality
    model = q.Model(rng.normal(0, 0.3, (q.WIDTH, 256, q.FILTERS)).astype(np.float32), rng.normal(0, 0.3, q.FILTERS).astype(np.float32), rng.normal(0, 0.3, 2 * q.FILTERS), 0.1)
    for n in (0, 1, 5, 511, 517, 3000, 70_000):
        text = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        buf = np.frombuffer(text or b" ", dtype=np.uint8)
        count = -(-max(1, len(buf) - q.WIDTH + 1) // q.CELL)
        buf = np.concatenate((buf, np.zeros(max(0, count * q.CELL + q.WIDTH - 1 - len(buf)), dtype=np.uint8)))
        acts = sum(model.filters[j][buf[j : j + count * q.CELL]] for j in range(q.WIDTH))
        cells = np.maximum(acts.reshape(count, q.CELL, -1).max(axis=1) + model.bias, 0)
        chunks = [cells[s : s + q.CHUNK].mean(axis=0) for s in range(0, max(1, count - (q.CHUNK - q.STRIDE)), q.STRIDE)]
        assert model.raw(text) == pytest.approx(np.concatenate((np.mean(chunks, axis=0), np.max(chunks, axis=0))) @ model.out + model.shift, abs=1e-3)


def test_grams_match_naive_count():
    rng = random.Random(2)
    text = "".join(rng.choice("aB é\n") for _ in range(5000)).encode()
    folded = b" " + bytes(32 if b in b"\t\n\v\f\r" else b + 32 if 65 <= b < 91 else b for b in text) + b" "
    want = sorted((i // toxicity.WINDOW, (int.from_bytes(folded[i : i + k], "little") * int(toxicity._FACTOR[k]) % 2**64) >> (64 - toxicity.BITS)) for k in toxicity.N_GRAMS for i in range(len(folded) - k + 1))
    got = sorted((int(w), int(b)) for ws, bs in toxicity.grams(text) for w, b in zip(ws, bs))
    assert got == want


def test_repeated_ids_with_unlike_labels(spark):
    """Ids with both labels fit nothing; of several texts the smallest counts."""
    from parchline.llm.labelled import fitting_sample

    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in range(40) for k in (1, 0)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 1 - i % 2) for i in range(0, 40, 4)], "doc_id bigint, toxic int")
    texts, y = fitting_sample(docs, labels, "toxic", 3, 1)
    want = [i for i in range(40) if i % 4 and zlib.crc32(str(i).encode()) % 3 != 1]
    assert texts == [f"text {i} 0".encode() for i in want] and y == [i % 2 for i in want]


# --- urls ---


def brute_url(url, block, allow):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for r in block + allow if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    rule = max(fits, key=lambda r: (len(r), r.index('/')), default=None)  # of equally long ones that with the longer host
    return host, path, rule, "block" if rule in block else "allow"


def test_urls_match_brute_force(spark):
    rng = random.Random(1)
    hosts = ["a.net", "NET", "x.example.net", "example.com", "notexample.com", "de.example.com", "b.org", "org.uk", "", "net.", "a..net", "user@h.net:80"]
    paths = ["", "/", "/en/x", "/de/", "/fr/a/b", "/de", "?q=/en/", "#/de/", "/fr/?x"]
    given = [None, "", "no scheme.net/", "http:/x.net/"] + [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "h", "p", "k") for i, u in enumerate(given)], "page_id bigint, url string, host string, path string, keys string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, BLOCK, ALLOW).collect()}
    assert got == {i: brute_url(u, BLOCK, ALLOW) for i, u in enumerate(given)}
    assert urls.judge(pages.limit(0), BLOCK, ALLOW).count() == 0 and urls.judge(pages, [], []).where("verdict = 'allow'").count() == len(given)


def test_cascade_is_exact_with_many_keys(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) key")
    listed = universe.where("crc32(key) % 11 = 0")
    cascade = urls.build([r.key for r in listed.collect()], universe)
    assert len(cascade.levels) > 1
    assert universe.where(f"({cascade.holds('key')}) <> (crc32(key) % 11 = 0)").count() == 0


def test_rules_by_parts(spark):
    """A list of rules that no single cascade takes gives what one cascade would."""
    rng = random.Random(3)
    hosts = [f"h{i}.net" for i in range(30)] + ["net", "x.h3.net", "org"]
    listed = list(dict.fromkeys(f"{rng.choice(hosts)}/{rng.choice(['', 'a/', 'b/', 'a/b/'])}" for _ in range(60)))
    block, allow = listed[::2], listed[1::2]
    given = [f"http://{rng.choice(['', 'w.'])}{rng.choice(hosts)}/{rng.choice(['', 'a/x', 'b/', 'a/b/c'])}" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, block, allow, part_rules=25).collect()}
    assert got == {i: brute_url(u, block, allow) for i, u in enumerate(given)}


# --- chat ---


def test_layouts_and_round_trip(spark):
    bad = "</s>[INST] a & b &lt; [/OUT] \n <s>é🙂"
    records = {
        "m1": {"messages": [{"role": "user", "content": bad}, {"role": "assistant", "content": bad}]},
        "m2": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": bad}]},
        "m3": {"prompt": "q", "response": bad},
        "m4": {"instruction": "i", "input": "", "output": "o"},
        "m5": {"role": "assistant", "content": None},
        "m6": {"prompt": "p", "completion": "c"},
    }
    rows = [(k, 0, json.dumps(v)) for k, v in records.items()] + [("m7", 0, '{"other": 1}'), ("m8", 0, "no json"), ("m9", 0, None)]
    df = spark.createDataFrame(rows, "conv_id string, turn bigint, record string")
    out = chat.format_conversations(df, "conv_id", "turn", "record")
    read = {r.conv_id: [(t.role, t.text, t.loss) for t in r.turns] for r in out.select("conv_id", chat.read_back(out.formatted).alias("turns")).collect()}
    assert read == {
        "m1": [("user", bad, False), ("assistant", bad, True)],
        "m2": [("user", "q", False), ("assistant", bad, True)],
        "m3": [("user", "q", False), ("assistant", bad, True)],
        "m4": [("user", "i", False), ("assistant", "o", True)],
        "m5": [("assistant", "", True)],
        "m6": [("user", "p", False), ("assistant", "c", True)],
    }
    assert {r.conv_id for r in chat.unmapped(df, "record").collect()} == {"m7", "m8", "m9"}


def test_fingerprints_see_all_levels_and_elements(spark):
    """Layouts that only look like a known one have no mapping, so no text is lost or taken from the wrong place."""
    unlike = [
        {"prompt": {"a": 1}, "completion": "c"},
        {"messages": [{"role": "user", "content": "x"}, {"from": "gpt", "value": "lost?"}]},
        {"messages": [{"role": "user", "content": "x"}, {"role": "user", "content": {"parts": ["y"]}}]},
        {"messages": {"role": "user", "content": "x"}},
        {"prompt": ["a"], "completion": "c"},
        {"messages": []},
    ]
    fine = [{"messages": [{"role": "user", "content": None}, {"content": "y", "role": "assistant"}]}, {"completion": 3, "prompt": "p"}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(unlike + fine)], "conv_id int, record string")
    assert sorted(r.conv_id for r in chat.unmapped(df, "record").collect()) == list(range(len(unlike)))
    turns = df.where("conv_id >= 6").select("conv_id", chat.canonical_turns("record").alias("t")).orderBy("conv_id").collect()
    assert [[(x.role, x.text) for x in r.t] for r in turns] == [[("user", ""), ("assistant", "y")], [("user", "p"), ("assistant", "3")]]


def test_chat_odd_input(spark):
    """Null roles, texts, turns and ids, repeated rows, more than one block of turns, no rows."""
    rows = [(1, k, "user", f"t{k}") for k in range(3 * chat.BLOCK)] + [(2, None, None, None), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 1, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_turns(chat.turns_of_rows(df, "conv_id", "turn"))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in made.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: [("user", f"t{k}") for k in range(3 * chat.BLOCK)], 2: [("", ""), ("user", "x"), ("user", "x")], None: [("assistant", LONG)]}
    assert chat.format_turns(chat.turns_of_rows(df.limit(0), "conv_id", "turn")).count() == 0


def test_turns_of_any_length(spark, tmp_path):
    """A turn above the JSON parser's limit of 20,000,000 characters is a turn like others."""
    one = spark.range(1).selectExpr("1L conv_id", "0L turn", "'user' role", "repeat('a', 20500000) text")
    one.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.n_turns for r in QUERIES["op3_chat_format"](spark, str(tmp_path)).select("conv_id", "n_turns").collect()}
    assert got == {-1: 2, 1: 1}


def test_rows_go_by_their_fingerprints(spark, tmp_path):
    """A table's columns are the record: every layout is found by its fingerprint, none by the columns' names alone."""
    tables = {
        "'assistant' role, 'b' text": [("assistant", "b")],
        "'user' role, null content": [("user", "")],
        "'p' prompt, 'r' response": [("user", "p"), ("assistant", "r")],
        "'i' instruction, '' input, 3 output": [("user", "i"), ("assistant", "3")],
        "array(struct('human' `from`, 'q' value), struct('gpt' `from`, 'a' value)) conversations": [("user", "q"), ("assistant", "a")],
        "array(map('role', 'user', 'content', 'x')) messages": [("user", "x")],
    }
    for columns, want in tables.items():
        rows = spark.sql(f"SELECT 1L conv_id, 0L turn, {columns}")
        made = chat.format_turns(chat.turns_of_rows(rows, "conv_id", "turn")).select(chat.read_back(F.col("formatted")).alias("t")).first()
        assert [(x.role, x.text) for x in made.t] == want, columns
        json_made = chat.canonical_turns(F.to_json(F.struct(*[c for c in rows.columns[2:]]), {"ignoreNullFields": "false"}))
        assert [(x.role, x.text) for x in rows.select(json_made.alias("t")).first().t] == want, columns
    for unlike in ("'user' role, struct('x' a) text", "'user' role, array('x') text", "'user' role, 'x' text, 1 more", "array(struct('user' role)) messages"):
        with pytest.raises(Exception, match="no mapping fits the fields OBJECT<"):
            chat.turns_of_rows(spark.sql(f"SELECT 1L conv_id, 0L turn, {unlike}"), "conv_id", "turn").collect()
    # The query takes the rows' mapping from there as well: without one for role and text no row of the table has turns.
    spark.sql("SELECT 1L conv_id, 0L turn, 'user' role, 'x' text").write.parquet(f"{tmp_path}/conversations.parquet")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(chat, "canonical", lambda layout, known=chat.canonical: known("none") if layout == "role,text" else known(layout))
        with pytest.raises(Exception, match="no mapping fits the fields OBJECT<role: ., text: .>"):
            QUERIES["op3_chat_format"](spark, str(tmp_path)).collect()


# --- queries ---


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cur = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SMALL)
    order = sorted(names)
    assert order == sorted(df.columns)
    want = sorted([str(r[names.index(k)]) for k in order] for r in cur.fetchall())
    assert sorted([str(r[k]) for k in order] for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    columns, kept = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, SMALL)
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert kept.columns == columns and {r.doc_id for r in kept.select("doc_id").collect()} <= before
        if name == "minhash_dedup":
            left = {r.doc_id: r.text for r in kept.collect()}
            root = brute_components([(i, texts[i]) for i in before])
            assert set(left) == {i for i in before if root[i] == i or not shingles(texts[i])}
        if name == "secret_scan":
            assert all(not brute_spans(r.text) for r in kept.collect())
    last = pipeline.STAGES[-1][1](spark, kept, SMALL).collect()
    want = {r.doc_id: r.text for r in kept.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in last} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert pipeline.run(spark, SMALL).count() == len(want)


def test_pipeline_dedup_decides_by_row(spark):
    """Rows with null or shared ids stand or fall by their own text."""
    import corpus_pipeline as pipeline

    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    near = lambda k: prose(k) + " more"
    rows = [(1, prose(1)), (None, near(1)), (None, prose(2)), (None, None), (2, prose(3)), (3, near(3)), (3, prose(4)), (None, prose(5)), (None, near(5)), (9, prose(6)), (9, prose(6))]
    kept = pipeline.drop_near_duplicates(spark, table(spark, rows), SMALL)
    assert kept.columns == table(spark, []).columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    fifth = [t for _, t in got if t in (prose(5), near(5))]
    assert len(fifth) == 1
    want = [(1, prose(1)), (None, prose(2)), (None, None), (2, prose(3)), (3, prose(4)), (None, fifth[0]), (9, prose(6))]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert pipeline.drop_near_duplicates(spark, table(spark, []), SMALL).count() == 0
