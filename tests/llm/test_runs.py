import hashlib
import random
import zlib

import pytest

from memloom.llm import runs


def brute(seq, shortest):
    """Every maximal stretch of every period, the smallest period of a stretch first."""
    n, out = len(seq), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if seq[i] != seq[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and seq[j] == seq[j + p]:
                j += 1
            if j + p - i >= max(shortest, 2 * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e, p) for (s, e), p in out.items())


def sequences(rng, count, n):
    for _ in range(count):
        k = rng.choice([1, 2, 2, 3, 4])
        seq = [rng.randrange(k) for _ in range(rng.randrange(n))]
        if rng.random() < 0.5 and len(seq) > 4:
            size, base, seq = len(seq), seq[: rng.randrange(1, 9)], []
            while len(seq) < size:
                seq += base * rng.randrange(1, 5)
                if rng.random() < 0.6:
                    seq.append(rng.randrange(k + 1))
                if rng.random() < 0.3:
                    seq += seq[-rng.randrange(1, 30) :]
        yield seq


@pytest.mark.parametrize("shortest", [2, 5, 12])
def test_runs_agree_with_brute_force(shortest):
    for seq in sequences(random.Random(shortest), 1500, 80):
        assert runs.runs(seq, shortest) == brute(seq, shortest), seq


def test_factors_are_the_longest_that_occur_before():
    for seq in sequences(random.Random(1), 300, 40):
        at = 0
        for b, e, earlier in runs.factors(seq):
            assert b == at and e > b
            longest = max((k for s in range(b) for k in range(len(seq) - b + 1) if seq[s : s + k] == seq[b : b + k]), default=0)
            assert e - b == max(1, longest) and (earlier < 0) == (longest == 0)
            assert earlier < b and (earlier < 0 or seq[earlier : earlier + e - b] == seq[b:e])
            at = e
        assert at == len(seq)


def expected(doc_id, text):
    words = [w for w in (text or "").encode().replace(b"\x0b", b" ").split() if w]
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words, 12)
    gone = {i for s, e, p in found for i in range(s + p, e)}
    best = min(((-(e - s), s, p) for s, e, p in found), default=None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    text = "".join(f"{s},{e - s},{p}\n" for s, e, p in found)
    longest = (None, None, None, None) if not best else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(found), *longest, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_report_agrees_with_brute_force(spark, none):
    rng = random.Random(6)
    rows = []
    for i in range(260):
        vocabulary = ["w%d" % k for k in range(rng.choice([1, 2, 3, 30, 400]))] + ["é", "Ü x"]
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 160))]
        if rng.random() < 0.5 and parts:
            a = rng.randrange(len(parts))
            parts[a:a] = parts[a : a + rng.randrange(1, 14)] * rng.randrange(1, 9)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(parts), 1, "x", i))
    rows += [(300, None, 0, "", 0), (301, "", 0, "", 0), (302, " \n ", 0, "", 0), (303, "one", 0, "", 0), (None, "a b " * 20, 0, "", 0), (None, None, 0, "", 0), rows[3], rows[3], (304, "a\x0bb\x0cc " * 12, 0, "", 0)]
    rows += [(i, None, 0, "", 0) for i in range(1000, 1040)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, _text string, _id long").repartition(3)
    got = [tuple(r) for r in runs.run_report(df).collect()]
    assert sorted(got, key=repr) == sorted([expected(r[0], r[1]) for r in rows], key=repr)
    assert sum(r[1] > 0 for r in got) > 60 and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in got if r[1])
    assert runs.run_report(none).count() == 0


def test_long_text_and_texts_without_repetitions(spark):
    rng = random.Random(8)
    base = ["v%d" % rng.randrange(5000) for _ in range(30_000)]
    text = " ".join(base[:20_000] + base[15_000:20_000] * 2 + base[20_000:])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = runs.find_runs(df, df.columns).first()
    assert [tuple(x) for x in r["runs"]] == [(15_000, 15_000, 5_000)] and r["runs_rest"] == " ".join(base) and r["text"] == text
