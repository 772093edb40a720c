"""Phrase mining against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL, same_rows

from cadenza.llm import phrases
from cadenza.llm.queries import ORACLE_SQL, QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = "doc_id long, text string, lang string, rank string, n long"


def brute_counts(rows):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    return f, n


def brute(rows, least=10, top=2000):
    counts, n = brute_counts(rows)
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= 50 * a for q, b in found.items()):
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], k))
        for rank, (s, a, p, left, right, k) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s, k))
    return sorted(out)


def rows():
    rng = np.random.default_rng(3)
    words = ["a", "b", "C", "dé", "漢", "x\x00y", "the", "of", "'q'", "zz z"]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(60)]
    texts += ["New  York\tCity is, new york city! NEW york"] * 12 + ["one two. three four\none two;three four"] * 11
    texts += [None, "", " ", "\t", ".", "...", "word", "rare pair here", "a " * 500, "hapax " * 9, "tie one", "b" * 5000]
    langs = [None, "en", "und", "de", "en", "en"]
    return [(k % 70, t, langs[k % 6]) for k, t in enumerate(texts)]


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", 1) for r in data], KINDS).repartition(3)


@pytest.mark.parametrize(("least", "top", "size"), [(10, 2000, 8 << 20), (10, 7, 300), (3, 2000, 900)])
def test_equals_brute_force(spark, monkeypatch, least, top, size):
    monkeypatch.setattr(phrases, "BATCH_BYTES", size)
    got = sorted(tuple(r) for r in phrases.collocations(frame(spark, rows()), least, top).collect())
    assert got == brute(rows(), least, top)


@pytest.mark.parametrize(("of", "floor", "bits"), [(1, 1, 1 << 16), (3, 2, 1 << 16), (10**9, 2, 1 << 16), (3, 2, 64)])
def test_every_frequent_phrase_is_counted_whatever_the_sample(spark, monkeypatch, of, floor, bits):
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    monkeypatch.setattr(phrases, "LEAST_BITS", 64)
    found, passes = phrases.frequent(frame(spark, rows()), 10, of, floor)
    got = Counter({(r["lang"], r["phrase"]): r["f"] for r in found.where("n_words > 0").collect()})
    assert found.where("n_words > 0").count() == len(got)  # none is counted in two passes
    want = {(lang, " ".join(p)): a for lang, f in brute_counts(rows())[0].items() for p, a in f.items() if a >= 10}
    assert got == want
    if of == 1:
        assert passes == 1
    if of == 10**9:
        assert passes == 3  # words, then pairs, then triples


def test_long_texts_are_cut_between_pieces_only():
    import pyarrow as pa

    text = b"one two three. " * 3000 + b"x" * 20000 + b" end"
    batch = pa.RecordBatch.from_arrays([pa.array([text.decode()]), pa.array(["en"])], ["t", "lang"])
    import unittest.mock as mock

    with mock.patch.object(phrases, "BATCH_BYTES", 1000):
        parts = [t for p in phrases._portions(iter([batch])) for t, _ in p]
    assert b"".join(parts) == text
    assert len(parts) > 30
    assert all(p.rstrip().endswith(b".") for p in parts[:-1])


def test_empty_table(spark):
    assert phrases.collocations(frame(spark, rows()).limit(0)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "x", 1)], KINDS)).count() == 0


def test_query_equals_its_sql(spark):
    same_rows(QUERIES["op11_phrases"](spark, SMALL), ORACLE_SQL["op11_phrases"], SMALL)


def test_counted_phrases_are_handed_over_in_small_batches():
    import pyarrow as pa

    class Sent:
        def __init__(self, value):
            self.value = value

    every = np.full(1 << 10, np.iinfo(np.uint64).max, np.uint64)
    text = " ".join(f"w{k}" for k in range(3 * phrases.BATCH_ROWS))
    batch = pa.record_batch([pa.array([text]), pa.array(["en"])], ["t", "lang"])
    got = list(phrases._counter(Sent(phrases.Border(None, None)), Sent(phrases.Border(every, every)), 3, True)(iter([batch])))
    assert max(b.num_rows for b in got) <= phrases.BATCH_ROWS
    rows = Counter(p for b in got for p in b.column("phrase").to_pylist())
    words = text.split()
    assert rows == Counter([""] + [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)])
