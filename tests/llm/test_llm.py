"""The training-data operators against brute force on a small fixture with every odd case."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import bpe, components, lines, lm, mixing, quality, simhash, sketch, suffix, urls, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = "the quick brown fox jumps over the lazy dog and runs away from seven small bears near the river bank"
SENTENCES = [f"{BASE} {k} times in a row, says {chr(97 + k)}." for k in range(12)]
KINDS = "doc_id long, text string, lang string, source string, n_chars long, shard int, row string, id long, size long, kept boolean"


def rows():
    long_text = "\n".join(f"{SENTENCES[k % 12]} line {k} é漢🙂" for k in range(400))
    texts = [
        None, "", " ", "\n\n", "word", "Ünïcödé text — with “quotes” … and\ttabs\x0b", BASE, BASE, BASE.upper(), SENTENCES[0] + "\n" + SENTENCES[1],
        SENTENCES[1] + "\n" + SENTENCES[2], "  " + SENTENCES[1].upper() + "  \nshort\nshort", long_text, long_text + " x", "aaaa " * 200, "a" * 3000,
        "\n".join(SENTENCES), "\n".join(SENTENCES[:11] + ["a new last line that differs"]), "x y z " * 5, "# * $ % & | < > and some ordinary words that make this long enough",
    ]
    out = [(k * 3 - 5, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, 1, "r", 9, 7, None) for k, t in enumerate(texts)]
    out.append(out[6])  # a repeated row
    out.append((None, BASE, "en", "s1", 1, None, None, None, None, True))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), KINDS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KINDS)


def texts():
    return [(r[0], r[1] or "") for r in rows()]


def last(doc_id):
    return (1 << 63) - 1 if doc_id is None else doc_id


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize(("shard_bytes", "cells"), [(4 << 20, 4 << 20), (2_000, 700)])
def test_suffix_dedup(docs, empty, monkeypatch, shard_bytes, cells):
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(suffix, "ARRAY_CELLS", cells)
    data = sorted(((last(i), t.encode()) for i, t in texts()), key=lambda x: x[0])
    first = {}
    want = Counter()
    for i, t in data:
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[i, len(t), int(gone.sum()), spans, kept, sha(kept)] += 1
    got = Counter((last(r["row"]["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["kept_sha256"]) for r in suffix.dedup_strings(docs).collect())
    assert got == want
    assert suffix.dedup_strings(empty).count() == 0


def test_two_hops_between_shards_and_buckets_change_nothing(spark, docs, monkeypatch):
    from cadenza.llm import common

    monkeypatch.setattr(suffix, "SHARD_BYTES", 2_000)
    monkeypatch.setattr(suffix, "MARKS_OF", 1)
    monkeypatch.setattr(suffix, "RUNS_OF", 1)
    monkeypatch.setattr(lm, "SHARD_BYTES", 2_000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 3_000)
    kept_text = lambda: Counter((r["row"]["doc_id"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup_strings(docs).collect())
    scores = lambda: Counter((r["doc_id"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.scored(docs).collect())
    one = kept_text(), scores()
    monkeypatch.setattr(common, "FAN", 3)
    assert (kept_text(), scores()) == one


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for text in (rng.integers(97, 99, 500), np.full(300, 97), np.tile(rng.integers(97, 110, 40), 9), np.array([5])):
        text = text.astype(np.uint8)
        raw = text.tobytes()
        order, word = suffix.suffix_array(text, 50)
        assert sorted(order.tolist()) == list(range(len(raw)))
        cut = [raw[i : i + 50] for i in order]
        assert cut == sorted(cut)
        common = suffix.common_prefixes(order, word, 50)
        for k in range(1, len(cut)):
            n = next((j for j in range(50) if cut[k][j : j + 1] != cut[k - 1][j : j + 1] or not cut[k][j : j + 1]), 50)
            assert common[k] == n


def test_mixing(docs, empty):
    got = mixing.mixed(docs).collect()
    sizes = defaultdict(int)
    for r in rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(sizes.values()))
    while free:
        each = rest / sum(weight[s] for s in free)
        over = {s for s in free if each * weight[s] > 3 * sizes[s]}
        for s in over or free:
            target[s] = 3.0 * sizes[s] if over else each * weight[s]
        rest -= sum(target[s] for s in over)
        free -= over or free
    by_row = Counter((r["doc_id"], r["size"]) for r in got)
    assert by_row == Counter((i, len(WORD.findall(t))) for i, t in texts())
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] <= 3 * r["size"]
        assert r["taken"] % max(1, r["size"]) == 0
        taken[r["source"]] += r["taken"]
    for s in sizes:  # as near as a document can bring it
        assert abs(taken[s] - target[s]) <= max([0] + [r["size"] for r in got if r["source"] == s])
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed(docs.repartition(5)).collect()), key=str)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["taken"] // r["size"] for r in got if r["size"]) + mixed.where("size(filter(split(coalesce(text, ''), '[ \t\n\u000b\f\r]+'), x -> x <> '')) = 0").count()
    assert mixing.mixed(empty).count() == mixing.mix(empty).count() == 0


def test_thresholds_are_nested(spark):
    sizes = spark.range(300).select(F.lit("s").alias("source"), (F.col("id") % 7 + 1).alias("size"), mixing.doc_hash(F.col("id")).alias("hash"), "id")
    total = sizes.agg(F.sum("size")).first()[0]
    before = set()
    for share in (0.1, 0.4, 0.8):
        plan = spark.createDataFrame([("s", total, total * share)], "source string, source_size long, target double")
        edge = mixing.thresholds(sizes.drop("id"), plan).first()
        now = {r["id"] for r in sizes.where((F.col("hash") < edge["edge"]) | ((F.col("hash") == edge["edge"]) & F.lit(edge["edge_in"]))).collect()}
        assert before < now
        before = now


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup(docs, empty, batches):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r").translate(LOW)
        return k if len(k) >= 10 else None

    owner = {}
    for i, t in texts():
        for line in t.split("\n"):
            if k := key(line):
                owner[k] = min(owner.get(k, last(i)), last(i))
    want = Counter()
    for i, t in texts():
        all_ = t.split("\n")
        stay = [x for x in all_ if key(x) is None or owner[key(x)] == last(i)]
        want[i, len(all_), len(all_) - len(stay), "\n".join(stay)] += 1
    got = Counter((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.dedup_lines(docs, batches).collect())
    assert got == want
    assert lines.dedup_lines(empty).count() == 0


def brute_fingerprint(text):
    w = WORD.findall(text.translate(LOW))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs, empty):
    prints = [(i, brute_fingerprint(t)) for i, t in texts()]
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 3:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((prints[k][0] for k in range(len(prints)) if group[k] == g and prints[k][0] is not None), default=None) for g in set(group)}
    want = Counter((prints[k][0], prints[k][1], least[group[k]]) for k in range(len(prints)))
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_components(docs).collect())
    assert got == want
    assert simhash.near_components(empty).count() == 0


def test_links_of_all_distances(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for k, f in enumerate(base.tolist()):
        for _ in range(6):
            for b in rng.choice(64, k % 5, replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    flat = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in flat], "fp long")
    edges = simhash.links(frame, ["fp"], 2, 3).distinct().collect()
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= 3 for a, b in edges)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in flat]
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if bin((a ^ b) % (1 << 64)).count("1") <= 3:
                assert got[a] == got[b]


def test_large_groups_are_cut_without_loss(monkeypatch):
    rng = np.random.default_rng(4)
    fp = np.unique(rng.integers(0, 1 << 14, 900, dtype=np.uint64) << np.uint64(20))[:, None]
    whole = simhash._forest(fp, 3)
    monkeypatch.setattr(simhash, "BLOCK", 50)
    cut = simhash._forest(fp, 3)

    def parts(links):
        root = list(range(len(fp)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(len(fp))]

    assert parts(whole) == parts(cut)


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in range(61)} == {0}
    assert {got[k] for k in range(100, 160)} == {100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark, docs, empty):
    left = simhash.near_duplicates(docs)
    assert left.columns == docs.columns
    ids = Counter(r["doc_id"] for r in left.collect())
    assert max(ids.values()) == 1
    assert 13 in ids and 16 not in ids  # copies of one text, the smaller stays
    assert simhash.near_duplicates(empty).count() == 0
    clean = spark.createDataFrame([(k, " ".join(f"w{(k * 7919 + j * 104729) % 100003}" for j in range(120))) for k in range(50)], "doc_id long, text string")
    assert simhash.near_duplicates(clean).count() == 50


def edited_corpus():
    """Texts of several lengths with copies edited at one end or here and there."""
    rng = np.random.default_rng(11)
    out = []
    for length in (12, 40, 120, 400, 1500):
        for _ in range(40):
            words = [f"w{x}" for x in rng.integers(0, 30000, length)]
            out.append(words)
            out.append(words[: length - int(length * rng.uniform(0.05, 0.25))])  # cut short
            more = list(words)
            for at in rng.choice(length, max(1, int(length * rng.uniform(0.005, 0.03))), replace=False):
                more[at] = f"x{rng.integers(0, 30000)}"
            out.append(more)
            out.append([*more, *(f"y{x}" for x in rng.integers(0, 30000, int(length * rng.uniform(0.02, 0.2))))])
    return [(k, " ".join(w)) for k, w in enumerate(out)]


def brute_alike(rows):
    """Pairs of row numbers at a shingle similarity of 0.8 or more."""
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").translate(LOW).split()) else set() for _, t in rows]
    return [
        (a, b) for a in range(len(sets)) for b in range(a)
        if 4 * max(len(sets[a]), len(sets[b])) <= 5 * min(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ]


def brute_stay(rows):
    """Row numbers that stay: the smallest doc_id (null last) of each component."""
    root = list(range(len(rows)))
    for a, b in brute_alike(rows):
        old, new = root[a], root[b]
        root = [new if r == old else r for r in root]
    best = {}
    for k in range(len(rows)):
        if (at := best.get(root[k])) is None or (rows[k][0] is None, rows[k][0]) < (rows[at][0] is None, rows[at][0]):
            best[root[k]] = k
    return best.values()


def test_near_duplicates_equal_brute_force(spark):
    rows = edited_corpus()
    left = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = sorted(rows[k][0] for k in brute_stay(rows))
    assert len(want) < len(rows) * 0.7
    assert sorted(r["doc_id"] for r in left.collect()) == want


@pytest.mark.parametrize(("small", "block"), [(6, 512), (2, 7), (64, 100)])
def test_near_duplicates_of_large_groups_equal_brute_force(spark, monkeypatch, small, block):
    rng = np.random.default_rng(6)
    rows = []
    for text in range(3):  # near-copies of one text, of which many pairs lie on either side of 0.8
        base = [f"t{text}w{k}" for k in range(150)]
        for k in range(400):
            words = list(base)
            for at in rng.choice(150, rng.integers(0, 10), replace=False):
                words[at] = f"x{text}y{k}z{at}"
            rows.append((len(rows), " ".join(words)))
    # a chain of neighbours whose ends have nothing in common
    chain = [f"c{k}" for k in range(300)]
    rows += [(len(rows) + k, " ".join(chain[k * 12 : k * 12 + 150])) for k in range(12)]
    monkeypatch.setattr(simhash, "SMALL_GROUP", small)
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)
    left = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(rows[k][0] for k in brute_stay(rows))


def test_near_duplicates_by_fingerprint_links_what_op4_links(spark):
    """Texts within 3 bits of each other's fingerprint are near-duplicates in the pipeline, however few five-word shingles they share."""
    import corpus_pipeline as P

    base = [f"w{k}" for k in range(40)]
    made = [" ".join(base)]
    own = int(simhash.fingerprints([made[0].encode()])[0])
    for k in range(4000):
        words = list(base)
        for at in (10 + k % 20, 3 + k % 7):
            words[at] = f"x{k}"
        text = " ".join(words)
        if (int(simhash.fingerprints([text.encode()])[0]) ^ own).bit_count() <= 3:
            made.append(text)
            break
    assert len(made) == 2 and not brute_alike(list(enumerate(made)))
    made += [made[0] + " " + made[0], " ".join(f"o{k}" for k in range(40)), "", "\t"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(made)], "doc_id long, text string")
    linked = {r["doc_id"]: r["component_id"] for r in simhash.near_components(docs).collect()}
    assert linked[1] == 0
    stay = {r["doc_id"] for r in P.no_near_duplicates(spark, docs, "").collect()}
    assert stay <= set(linked.values()) and {0, 3, 4} <= stay
    assert 1 in {r["doc_id"] for r in simhash.near_duplicates(docs).collect()}


def look_alikes(n, seed=8):
    """Texts with 120 words in common and 60 of their own; every tenth has a near-copy, some a farther one."""
    rng = np.random.default_rng(seed)
    page = [f"p{k}" for k in range(120)]
    rows = []
    for k in range(n):
        words = page + [f"o{k}w{j}" for j in range(60)]
        rows.append((len(rows), " ".join(words)))
        if k % 10 == 0:
            for at in 120 + rng.choice(60, rng.integers(1, 6), replace=False):
                words[at] = f"x{k}z{at}"
            rows.append((len(rows), " ".join(words)))
    return rows


def test_near_duplicates_among_look_alikes(spark, monkeypatch):
    """No link is lost in a group of texts with much in common, and what is compared grows as the texts do."""
    sizes = []

    def counted(df, name):
        out = kept_before(df, name)
        if name in ("near-cells", "near-more", "near-split"):
            sizes[-1] += out.count()
        return out

    kept_before = simhash.kept
    monkeypatch.setattr(simhash, "kept", counted)
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 50)
    for n in (300, 600, 1200):
        sizes.append(0)
        rows = look_alikes(n)
        left = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        got = sorted(r["doc_id"] for r in left.collect())
        assert len(got) < len(rows)
        if n == 300:
            assert got == sorted(rows[k][0] for k in brute_stay(rows))
    assert sizes[2] < 2.4 * sizes[1] < 5.8 * sizes[0]


def brute_parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    n = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    tail = rest[n:]
    return rest[:n].translate(LOW), tail[: next((k for k, c in enumerate(tail) if c in "?#"), len(tail))]


def brute_rule(host, path):
    fits = [r for r, _ in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits, key=len, default=None)


def test_url_rules_and_scores(spark):
    seen = [None, "", "no scheme", "http://", "http://A.Example.NET/en/x?y", "https://net/", "https://net", "x://a.net?q/", "ftp://notnet.org/fr/", "http://a.org/fr/1#z", "http://org/fra", "a://b://c/d", "http://example.com/de/ü", "http://xexample.com/de/"]
    seen += [f"http://s{k}.example.net/en/{k}" for k in range(40)] + [f"http://s{k}.example.com/de/{k}" for k in range(40)] + [f"http://q{k}.example.net/en" for k in range(9)]
    pages = spark.createDataFrame(list(enumerate(seen)), "page_id long, url string")
    got = {r["page_id"]: r for r in urls.filtered(pages).collect()}
    for k, u in enumerate(seen):
        host, path = brute_parts(u)
        rule = brute_rule(host, path)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert got[k]["verdict"] == dict(urls.RULES)[rule] if rule else got[k]["verdict"] in ("allow", "block")
    assert urls.filtered(pages.where("false")).count() == 0
    assert set(r["verdict"] for r in urls.filtered(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")).collect()) == {"allow"}


def brute_probability(lines_, gram):
    """Probability of a gram's last character by counting in padded lines."""
    p = 1 / urls.ALPHABET
    for k in range(urls.ORDER + 1):
        own, context = gram[urls.ORDER - k :], gram[urls.ORDER - k : urls.ORDER]
        n = sum(line[i - k : i + 1] == own for line in lines_ for i in range(urls.ORDER, len(line)))
        c = sum(line[i - k : i] == context for line in lines_ for i in range(urls.ORDER, len(line)))
        p = (n + urls.LEAN * p) / (c + urls.LEAN)
    return p


def test_url_model_equals_brute_force(spark):
    known = [(f"host{k}.good/{k}", True) for k in range(30)] + [(f"spam{k}.bad/{k}é", False) for k in range(30)]
    counts = urls.train(spark.createDataFrame(known, "s string, ok boolean")).cache()
    padded = lambda s: urls._START * urls.ORDER + s + urls._END
    lines_ = {ok: [padded(s) for s, o in known if o == ok] for ok in (True, False)}
    probes = ["host99.good/1", "spam1.bad/1", "", "é" * 9, "x" * 3000]
    got = {r["s"]: r["score"] for r in urls.scores(spark.createDataFrame([(p,) for p in probes + probes[:2]], "s string"), counts).collect()}
    assert len(got) == len(probes)
    memory = {}
    for probe in probes:
        line = padded(probe)
        total = 0.0
        for i in range(urls.ORDER, len(line)):
            gram = line[i - urls.ORDER : i + 1]
            if gram not in memory:
                memory[gram] = np.log(brute_probability(lines_[True], gram)) - np.log(brute_probability(lines_[False], gram))
            total += memory[gram]
        assert got[probe] == pytest.approx(total / (len(probe) + 1), rel=1e-9, abs=1e-12)


def test_url_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(4)
    known = [("".join(rng.choice(list("abcdefgh./"), 20)), bool(k % 2)) for k in range(400)]
    counts = urls.train(spark.createDataFrame(known, "s string, ok boolean")).cache()
    alphabet = {c for s, _ in known for c in s} | {urls._END}
    for context in ("abcd", urls._START * 4, "a.b/", "zzzz"):
        every = urls.probabilities(spark.createDataFrame([(context + c,) for c in [*alphabet, "é"]], "gram string"), counts).collect()
        rest = next(r for r in every if r["gram"].endswith("é"))
        for side in ("accepted", "rejected"):
            seen = [r[side] for r in every if not r["gram"].endswith("é")]
            assert all(0 < p < 1 for p in seen)
            assert sum(seen) + (urls.ALPHABET - len(alphabet)) * rest[side] == pytest.approx(1.0)


def test_url_method_on_held_out_labels(spark):
    for table in ("sf0.01", "sf0.1"):
        rates = urls.held_out_rates(spark.read.parquet(f"/root/testdata/{table}/pages.parquet"))
        assert sum(rates.values()) / 2 >= 0.9, rates  # a dozen accepted URLs in the smaller table


def test_url_rows_stay_and_clashing_columns_are_replaced(spark):
    rows_ = [(1, "http://net/a", "own", 1.0, "x"), (1, "http://net/a", "own", 1.0, "x"), (None, None, None, None, None), (2, "http://q.zz/" + "long/" * 3000, "h", 2.0, "y")]
    frame = spark.createDataFrame(rows_, "page_id long, url string, host string, score double, s string")
    got = urls.filtered(frame).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows_)
    assert Counter((r["page_id"], r["host"], r["s"]) for r in got) == Counter({(1, "net", "x"): 2, (None, "", None): 1, (2, "q.zz", "y"): 1})
    assert all((r["score"] is None) == (r["rule"] is not None) for r in got)


def test_lm_base_and_score(docs, empty):
    import math
    import zlib

    got = lm.scored(docs).collect()
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    tokens = [(i, [*WORD.findall(t.translate(LOW)), None]) for i, t in texts()]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, f"{sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws):.6f}") for i, ws in tokens)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], f"{r['base_score']:.6f}") for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert len({(r["doc_id"], r["score"]) for r in got if r["doc_id"] == 13}) == 1
    assert lm.scored(empty).count() == 0


def test_lm_nul_characters_are_no_end_marks(spark):
    import math
    import zlib

    rows = [(i, t) for i, t in enumerate(["a\0b \0 c", "\0\0\0", "A \0 B", "a", "", None, "x\0", "the \0cat", "\0", "c \0 c", "\0A", "b b \0", "end\0", "end"] * 4)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*WORD.findall((t or "").translate(LOW)), None]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(ws), sum(c[w] > 0 for w in ws), n, f"{sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws):.6f}") for i, ws in tokens)
    got = lm.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], f"{r['base_score']:.6f}") for r in got) == want
    histogram = lm.byte_counts(spark.createDataFrame([(b"A\0b\0",), (b"",)], "text binary"))
    assert (histogram[0], histogram[97], histogram[98], histogram[255]) == (2, 1, 1, 2)
    assert histogram.sum() == 6


def counted(texts, slot_bits=None):
    """Code and counts of some texts, all of which train."""
    counts = np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256)
    counts[0] = len(texts)
    code = lm.Code.of(counts)
    code.slot_bits = (slot_bits,) * lm.PREDICTORS if slot_bits else code.slot_bits
    table = np.zeros((code.edges[-1], 2), np.uint32)
    lm.count(table, texts, code)
    return code, table


def test_lm_held_out_texts_teach_nothing(spark, docs):
    import zlib

    some = docs.where("text is not null").select("doc_id", "text")
    held = F.udf(lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2, "boolean")
    marked = some.withColumn("h", held("doc_id")).cache()
    assert marked.where("h").count() > 1
    other = marked.withColumn("text", F.when(F.col("h"), F.concat(F.lit("§§ zzz qqq "), F.reverse("text"))).otherwise(F.col("text"))).drop("h")
    scores = lambda df: Counter((r["doc_id"], r["n_known"], r["base_score"], r["score"]) for r in lm.scored(df).where("not held_out").collect())
    assert scores(some) == scores(other)


def test_lm_probabilities_sum_to_one():
    train = [b"the cat sat on the mat", b"a dog sat on a log"] * 20
    code, table = counted(train)
    table = lm.packed(table)
    scorer = lm.Scorer(table, lm.train_mixer(table, train[:20], code), code)
    one = lm.symbols([b"the c"])
    context = one.gram[-1] >> np.uint64(8) << np.uint64(8)
    every = lm.Symbols(context | np.arange(256, dtype=np.uint64), np.repeat(one.word[-1:], 256), one.start)
    assert (10.0 ** scorer.costs(every)).sum() == pytest.approx(1.0)
    assert scorer.score([b"the cat sat"])[0] > scorer.score([b"xqj zzv kkw"])[0]
    assert np.allclose(scorer.score([b"the", b"", b"the"]), np.concatenate([scorer.score([t]) for t in (b"the", b"", b"the")]))
    # a training text is scored without itself
    assert scorer.score([b"the cat sat"])[0] > scorer.score([b"the cat sat"], trained=True)[0]


def brute_symbols(text):
    """(last five bytes, word so far, symbol) of each byte and the end mark."""
    out = []
    for i in range(len(text) + 1):
        word = re.split(rb"[\x20\x09-\x0D]", text[:i])[-1]
        out.append(((b"\0" * 5 + text[:i])[-5:], word, text[i] if i < len(text) else 0))
    return out


def test_lm_equals_a_plain_mixer():
    """Counts, inputs, gates and mixture of every decision, one at a time over dictionaries."""
    import math

    train = [b"the cat sat on the mat", b"a dog sat on a log\nthe end", b"", b"cats and dogs"] * 3
    code, raw = counted(train, 22)  # so many slots that none is shared
    counts = Counter()

    def contexts(last5, word):
        return [last5[-k:] for k in lm.ORDERS] + [(word,)]

    def kept_count(n):
        return n if n <= 16 else 16 * 1.06 ** round(math.log(n / 16, 1.06))

    def path(symbol):
        return [(int(code.node[k, symbol]), int(code.bit[k, symbol])) for k in range(len(code.node)) if code.node[k, symbol] >= 0]

    for t in train:
        for last5, word, symbol in brute_symbols(t):
            for node, bit in path(symbol):
                for k, c in enumerate(contexts(last5, word)):
                    counts[k, c, node, bit] += 1
    mixer = lm.train_mixer(lm.packed(raw), train, code)

    def cost(text, own):
        total = 0.0
        for last5, word, symbol in brute_symbols(text):
            for node, bit in path(symbol):
                mixed, gate, odds = 0.0, 0, []
                for k, c in enumerate(contexts(last5, word)):
                    n = [kept_count(counts[k, c, node, b]) - (own and b == bit) for b in (0, 1)]
                    level = sum(sum(n) > x for x in (0.5, 1.5, 3.5, 15.5))
                    odds.append(math.log((max(0, n[1]) + 0.3) / (max(0, n[0]) + 0.3)))
                    if k < len(lm.ORDERS):
                        gate = (k + 1) * 25 + level * 5 if level else gate
                    else:
                        gate += level
                mixed = sum(w * x for w, x in zip(mixer.weights[gate], [*odds, 0.3]))
                mixed = max(-12.0, min(12.0, mixed))
                at = max(0.0, min(lm.APM - 1.001, mixed * 2 + lm.APM // 2))
                low = int(at)
                refined = mixer.refine[gate, low] * (1 - at + low) + mixer.refine[gate, low + 1] * (at - low)
                p = max(1e-6, min(1 - 1e-6, (refined + 1 / (1 + math.exp(-mixed))) / 2))
                total += math.log10(p if bit else 1 - p)
        return total

    scorer = lm.Scorer(lm.packed(raw), mixer, code)
    for text in (b"the cat", b"a new\tdog sat", b"", b"cats"):
        assert scorer.score([text])[0] == pytest.approx(cost(text, False), rel=1e-4)
    assert scorer.score([train[1]], trained=True)[0] == pytest.approx(cost(train[1], True), rel=1e-4)


def test_lm_symbols():
    text = b"the\xff\x00a"
    part = lm.symbols([text, b"", text])
    assert part.start.tolist() == [0, 7, 8]
    assert [int(g) & 255 for g in part.gram] == [*text, 0, 0, *text, 0]
    assert int(part.gram[7]) == 0 and int(part.gram[8]) == text[0]
    assert (part.word[:7] == part.word[8:]).all() and part.word[7] == 0 and part.word[0] == 0 and part.word[5] != 0
    assert lm.symbols([b"ab cd"]).word[2] == lm.symbols([b"xy ab"]).word[5]
    rng = np.random.default_rng(2)
    texts_ = [b" ".join(b"w%d" % x for x in rng.integers(0, 5000, n)) for n in (0, 1, 30, 400)]
    part = lm.symbols(texts_, True)
    flat = b"".join(t + b"\0" for t in texts_)
    ends = np.append(part.cut[1:], len(flat))
    pieces = [flat[a:z] for a, z in zip(part.cut, ends)]
    assert set(part.start) <= set(part.cut) and b"".join(pieces) == flat
    # a cut stands behind a white space or a text's end, where the word before it says so
    assert all(p[-1:] in b" \0" for p in pieces) and 20 < len(pieces) < 120
    assert len(set(zip(pieces, part.stretch.tolist()))) == len(set(pieces)) == len(set(part.stretch.tolist()))


def test_lm_followers_equal_brute_force():
    rng = np.random.default_rng(5)
    pairs = [(int(k), int(v)) for k, v in zip(rng.integers(1, 60, 300), rng.integers(0, 3, 300) ** 2)]
    pairs += [(100, 5)] * 4 + [(101, 5)] * 3 + [(101, 6)] + [(102, 1), (102, 2)] + [(103, 9)]
    key, own = (np.array(x, np.uint64) for x in zip(*pairs))
    known, always, but, guess, table = lm.judged_followers(*lm._summed(key, own, None))
    place = {int(k): i for i, k in enumerate(known)}
    want = np.zeros((lm.SEEN_LEVELS, 2), np.int64)
    for at, (k, v) in enumerate(pairs):
        others = [y for j, (x, y) in enumerate(pairs) if x == k and j != at]
        i = place[k]
        seen, hit = lm.foretold(np.array([v], np.uint64), always[[i]], but[[i]], guess[[i]], True)
        if others and len(set(others)) == 1:
            assert seen[0] == len(others) and bool(hit[0]) == (others[0] == v)
            want[sum(len(others) > x for x in (1, 2, 4)), int(others[0] == v)] += 1
        else:
            assert seen[0] == 0
        every = [y for x, y in pairs if x == k]
        seen, hit = lm.foretold(np.array([v], np.uint64), always[[i]], but[[i]], guess[[i]], False)
        assert seen[0] == (len(every) if len(set(every)) == 1 else 0) and (not seen[0] or bool(hit[0]))
    assert (table == want).all()


def test_lm_tells_copies_from_single_texts_and_beats_the_base(spark):
    rng = np.random.default_rng(9)
    syllables = ["ba", "ko", "ri", "ten", "mul", "sa", "vor", "li"]
    vocabulary = ["".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(600)]
    share = 1 / np.arange(1, 601)
    once = [" ".join(rng.choice(vocabulary, 150, p=share / share.sum())) for _ in range(300)]
    rows_ = list(enumerate(once + once[:30]))
    got = {r["doc_id"]: r for r in lm.scored(spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)).collect()}
    rate = {k: r["score"] / r["n_tokens"] for k, r in got.items()}
    twice = [rate[k] for k in rate if k < 30 or k >= 300]
    single = sorted(rate[k] for k in rate if 30 <= k < 300)
    # but for the few of whom both copies are held out
    assert sum(r > single[int(0.9 * len(single))] for r in twice) >= 0.8 * len(twice)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_long_texts_and_clashing_columns(spark):
    long_text = " ".join(f"w{k % 977}" for k in range(300_000))
    rows_ = [(1, long_text, 1.0, True, 3), (2, "", 0.0, None, None), (3, "X" * 1_500_000, None, None, None)]
    frame = spark.createDataFrame(rows_, "doc_id long, text string, score double, train boolean, shard int")
    got = {r["doc_id"]: r for r in lm.scored(frame).collect()}
    assert got[1]["n_tokens"] == 300_001 and got[2]["n_tokens"] == 1 and got[3]["n_tokens"] == 2
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got.values())


def test_lm_keeps_the_ratio_of_large_counts():
    n = np.array([[3_000_000, 60_000_000], [10**11, 4 * 10**12], [2**63, 2**62]], np.uint64)
    pairs = lm.packed(n)
    assert np.allclose(lm._ODDS[pairs], np.log(n[:, 1] / n[:, 0]), atol=0.06)
    small = np.arange(17)
    for both in (np.column_stack([small, small[::-1]]), np.column_stack([small, 0 * small])):
        assert (lm._ZERO[lm.packed(both)] == both[:, 0]).all() and (lm._ONE[lm.packed(both)] == both[:, 1]).all()


def test_lm_sums_of_a_task_are_given_on_before_they_are_full(spark, monkeypatch):
    texts = [b"the cat sat on the mat %d" % (k % 7) for k in range(300)]
    code, want = counted(texts)
    frame = spark.createDataFrame([(t,) for t in texts], "text binary").coalesce(1)
    monkeypatch.setattr(lm, "FULL", 300_000)
    monkeypatch.setattr(lm, "CHUNK", 500)
    monkeypatch.setattr(lm, "HELD_SYMBOLS", 100)
    assert (lm.count_tables(frame, code) == lm.packed(want)).all()


def test_lm_mixer_learns_from_every_training_text(spark):
    rng = np.random.default_rng(8)
    rows = [(k, b" ".join(b"w%d" % x for x in rng.integers(0, 40, 12))) for k in range(900)]
    code, raw = counted([t for _, t in rows])
    table = lm.packed(raw)
    model = spark.sparkContext.broadcast((table, code))
    frame = spark.createDataFrame(rows, "doc_id long, text binary").repartition(5).cache()
    tasks = {}
    for r in frame.withColumn("task", F.spark_partition_id()).collect():
        tasks.setdefault(r["task"], []).append(bytes(r["text"]))
    parts = [lm.learned(table, texts, code) for texts in tasks.values()]
    n_decisions = len(lm.decisions(lm.symbols([t for _, t in rows]).gram, code)[0])
    assert sum(g.sum() for _, g, _ in parts) == sum(b.sum() for _, _, b in parts) == n_decisions
    gates, buckets = sum(g for _, g, _ in parts)[:, None], sum(b for _, _, b in parts)
    weights, refine = sum(m.weights * g[:, None] for m, g, _ in parts), sum(m.refine * b for m, _, b in parts)
    got, new = lm.trained_mixer(frame, model), lm.Mixer.new()
    assert np.allclose(got.weights, np.where(gates > 0, weights / np.maximum(gates, 1), new.weights))
    assert np.allclose(got.refine, np.where(buckets > 0, refine / np.maximum(buckets, 1), new.refine))
    assert not np.allclose(got.weights, lm.Mixer.new().weights)


def test_warc_round_trip(spark, tmp_path):
    big, small = "<html>" + "x" * 200 + "é</html>", "tiny"
    seen = [(5, "http://a/ü\r\nX: y", big), (2, "http://b", big), (9, None, big), (1, "u", small), (3, "u", small), (4, "u", None), (None, "n", big), (2, "http://b", big), (7, "z", "other " * 40)]
    pages = spark.createDataFrame(seen, "page_id long, url string, html string").withColumn("shard", F.lit(1))
    root = f"file://{tmp_path}/w"
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archived(pages, root).collect())
    want = Counter()
    for p, _, html in seen:
        data = (html or "").encode()
        same = [q for q, _, h in seen if (h or "").encode() == data and q is not None]
        again = len(data) >= 100 and len([1 for _, _, h in seen if (h or "").encode() == data]) > 1 and p != min(same)
        want[p, len(data), sha(data), "revisit" if again else "response", min(same) if again else None] += 1
    assert got == want
    assert all(not f.name.startswith("_writing") for f in (tmp_path / "w").iterdir())
    first = {f.name: f.read_bytes() for f in (tmp_path / "w").glob("*.gz")}
    warc.write_archives(pages.repartition(4), f"file://{tmp_path}/v", shard_bytes=16 << 20)
    assert {f.name: f.read_bytes() for f in (tmp_path / "v").glob("*.gz")} == first
    rolled = warc.write_archives(pages, f"file://{tmp_path}/r", shard_bytes=600, roll_bytes=100)
    assert rolled.count() > 3
    assert warc.read_archives(spark, f"file://{tmp_path}/r").count() == len(seen)
    warc.write_archives(pages.where("false"), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


def test_warc_commit(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"<html>{k} " + "x" * 150) for k in range(50)], "page_id long, url string, html string")
    root = f"file://{tmp_path}/w"
    with pytest.raises(Exception, match="_manifest"):  # nothing is committed yet
        warc.read_archives(spark, root).collect()
    warc.write_archives(pages, root, shard_bytes=3000)
    read = lambda: sorted(r["page_id"] for r in warc.read_archives(spark, root).collect())
    assert read() == list(range(50))
    files = sorted((tmp_path / "w").glob("*.gz"))
    assert len(files) > 2
    # a stray archive and what an unfinished write left are not read
    (tmp_path / "w" / "shard-999999-00000.warc.gz").write_bytes(files[0].read_bytes())
    (tmp_path / "w" / "_writing-x.tmp").write_bytes(b"half")
    assert read() == list(range(50))
    # a second write is refused and changes nothing
    with pytest.raises(FileExistsError):
        warc.write_archives(pages.limit(3), root)
    assert read() == list(range(50))
    # a changed and a missing file fail
    whole = files[1].read_bytes()
    files[1].write_bytes(whole[:-1] + b"?")
    with pytest.raises(Exception, match="not the file of the manifest"):
        read()
    files[1].unlink()
    with pytest.raises(Exception, match=files[1].name):
        read()
    files[1].write_bytes(whole)
    assert read() == list(range(50))


def test_warc_retried_task(tmp_path):
    """A second attempt at a shard finds the first one's files and leaves the same."""
    names = []
    for _ in range(2):
        shard = warc._Shard(f"file://{tmp_path}", 7, 300)
        for k in range(20):
            shard.add(warc.record(k, None, b"payload %d" % k, "d", None, False))
        shard.close()
        names.append(shard.rows)
    assert names[0] == names[1] and len(names[0]) > 1
    assert sorted(f.name for f in tmp_path.iterdir()) == sorted(r[1] for r in names[0])


EXTREME = [-(1 << 63), -(1 << 63) + 1, -5, 0, 7, (1 << 63) - 2, (1 << 63) - 1, 1 << 60]


def test_ids_at_both_ends_and_outliers(spark, tmp_path):
    rows_ = [(i, f"{BASE} number {k} " * 4) for k, i in enumerate(EXTREME)] + [(None, BASE * 2), (None, "other " * 30)]
    frame = spark.createDataFrame(rows_, "doc_id long, text string")
    for size in (1 << 20, 300):
        got = {(r["doc_id"], r["n_chars"]): r for r in sketch.edited_neighbours(frame, size).collect()}
        order = sorted((r for r in rows_ if r[0] is not None), key=lambda r: -r[0])
        for (i, t), (_, after) in zip(order, order[1:]):
            cut = len(t) // 3
            assert got[i, len(t)]["edited_sha256"] == sha((t[: len(t) - cut] + after[:cut]).encode())
        assert len(got) == len(rows_)
    pages = spark.createDataFrame([(i, "u", t) for i, t in rows_], "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/w", shard_bytes=900)
    assert sorted(map(str, (r["page_id"] for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()))) == sorted(str(i) for i, _ in rows_)
    # the largest id is no null: its rows are its own
    same = spark.createDataFrame([((1 << 63) - 1, BASE), ((1 << 63) - 2, BASE), (None, BASE)], "doc_id long, text string")
    assert {r["row"]["doc_id"]: r["n_removed"] > 0 for r in suffix.dedup_strings(same).collect()} == {(1 << 63) - 2: False, (1 << 63) - 1: True, None: True}
    assert {r["row"]["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(same).collect()} == {(1 << 63) - 2: 0, (1 << 63) - 1: 1, None: 1}


def test_ranges_of_uneven_ids(spark):
    from cadenza.llm.common import range_shards

    frame = spark.range(200_000).select(F.col("id").alias("k"), F.lit(10).alias("w"))
    frame = frame.unionByName(spark.createDataFrame([(1 << 60, 10), (-(1 << 63), 10), (None, 10)], "k long, w int"))
    place, n = range_shards(frame, "k", "w", 10_000)
    sizes = {r["s"]: r["count"] for r in frame.groupBy(place(F.col("k")).alias("s")).count().collect()}
    assert sizes.pop(None) == 1 and 190 <= n <= 210 and len(sizes) == n and max(sizes.values()) < 2_000
    again, _ = range_shards(frame.repartition(7), "k", "w", 10_000)
    assert frame.where(~place(F.col("k")).eqNullSafe(again(F.col("k")))).count() == 0


@pytest.mark.parametrize("shard_bytes", [1 << 20, 500])
def test_edited_neighbours(docs, empty, shard_bytes):
    order = sorted(((i, t) for i, t in texts()), key=lambda x: (-(x[0] if x[0] is not None else -(1 << 63)), x[1]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = (sketch.sketch(x.encode()) for x in (t, edited, after))
        want[i, len(t), sha(edited.encode()), sketch.to_text(a), sketch.to_text(b), f"{sketch.resemblance(a, b):.9f}", f"{sketch.resemblance(a, c):.9f}"] += 1
    got = Counter((r[0], r[1], r[2], r[3], r[4], f"{r[5]:.9f}", f"{r[6]:.9f}") for r in sketch.edited_neighbours(docs, shard_bytes).collect())
    assert got == want
    assert sketch.edited_neighbours(empty).count() == 0


def test_sketch_estimates(spark):
    words_ = [f"w{k}" for k in range(6000)]
    a, b = " ".join(words_[:4000]).encode(), " ".join(words_[2000:]).encode()
    x, y = sketch.sketch(a), sketch.sketch(b)
    assert sketch.resemblance(x, y) == pytest.approx(1 / 3, abs=0.12)
    assert sketch.containment(x, y) == pytest.approx(0.5, abs=0.15)
    assert sketch.distinct(x) == pytest.approx(3996, rel=0.25)
    assert sketch.resemblance(x[:0], x[:0]) == 1.0
    halves = [sketch.sketch(" ".join(words_[:3000]).encode()), sketch.sketch(" ".join(words_[2996:4000]).encode())]
    assert (sketch.merge(halves) == x).all()
    assert (sketch.from_text(sketch.to_text(x)) == x).all()
    parts = sketch.sketches(spark.createDataFrame([(1, " ".join(words_[:3000])), (1, " ".join(words_[2996:4000]))], "doc_id long, text string"))
    assert np.array_equal(np.array(sketch.merged(parts, "doc_id").first()["sketch"]).view(np.uint64), x)


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers as P

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return bpe.Bpe(bpe.read_ranks(f.read()), P.PATTERN)


def test_bpe_equals_tiktoken(coder):
    import random

    import public_tokenizers as P
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = random.Random(1)
    letters = "ab \n\t\x1c\x85\xa0᠎é漢🙂12.,'stx\u200b̀"
    seen = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + [t for _, t in texts()] + ["ab" * 999, " " * 500, "=-" * 400]
    ids = coder.encode_batch(seen)
    assert ids == [other.encode_ordinary(t) for t in seen]
    assert [coder.decode(i).decode() for i in ids] == seen
    assert bpe.Bpe(coder.ranks, None).encode_batch(["ab c"])[0]


def test_bpe_frames(docs, empty, coder):
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    want = Counter((i, len(x), sha(",".join(map(str, x)).encode()), sha(t.encode())) for (i, t), x in zip(texts(), coder.encode_batch([t for _, t in texts()]), strict=True))
    assert Counter(map(tuple, bpe.token_digests(docs, path, P.PATTERN).collect())) == want
    both = bpe.decode(bpe.encode(docs, path, P.PATTERN), path)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in both.collect())
    assert bpe.token_digests(empty, path, P.PATTERN).count() == 0


def test_quality_counts(docs, empty):
    want = Counter()
    for i, t in texts():
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(covered), failed] += 1
    got = quality.judged(docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter(map(tuple, got.select(*names).collect())) == want
    assert all(not (r["base_failed"] and r["kept"]) for r in got.collect())
    assert quality.judged(empty).count() == 0


def brute_judged(rows_):
    """(doc_id, text, source) rows -> (kept, n_left_words, cleaned) of each."""
    docs_of = Counter(src for _, _, src in rows_)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    held = defaultdict(set)
    for i, t, src in rows_:
        for line in (t or "").split("\n"):
            if key(line):
                held[src, key(line)].add((t or "", i))
    often = {k: min((i for _, i in v), key=last) for k, v in held.items() if (n := len({t for t, _ in v})) > quality.LEAST_TEXTS and 100 * n > quality.MOST_PER_CENT * docs_of[k[0]]}
    out = []
    for i, t, src in rows_:
        w = WORD.findall(t or "")
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        gone = lambda line: (src, key(line)) in often and often[src, key(line)] != i
        stay = [line for line in (t or "").split("\n") if not gone(line)]
        left = len(w) - sum(len(WORD.findall(line)) for line in (t or "").split("\n") if gone(line))
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        out.append((not failed and 3 * left >= 2 * len(w), left, "\n".join(stay) if t is not None else None))
    return out


def test_frequent_lines_deplete_documents(spark):
    own = lambda k: " ".join(f"own{k}word{j}" for j in range(20))
    menu = "home news sport weather contact imprint login register help search archive"
    foot = "copyright terms privacy cookies careers press investors partners sitemap feedback"
    made = [(k, f"{menu}\n{foot}\n{own(k)[:80]}", "web") for k in range(40)] + [(100 + k, f"{menu}\n{own(k)}\n{own(k + 500)}", "web") for k in range(40)]
    made += [(300 + k, f"{own(7)}\n{own(8)}", "copies") for k in range(60)]  # exact copies are one text
    made += [(400 + k, f"{menu}\n{own(k)}", None) for k in range(9)] + [(500, None, "web"), (501, "", "web"), (None, f"{menu}\n{foot}", "web"), made[0]]
    frame = spark.createDataFrame(made, "doc_id long, text string, source string").withColumn("kept", F.lit("x")).repartition(3)
    got = Counter((r["doc_id"], r["text"], r["kept"], r["n_left_words"], r["cleaned"]) for r in quality.judged(frame).collect())
    assert got == Counter((i, t, *j) for (i, t, _), j in zip(made, brute_judged(made)))
    by_id = {r["doc_id"]: r for r in quality.judged(frame).collect()}
    assert by_id[0]["kept"]  # the smallest doc_id keeps the lines
    assert not any(by_id[k]["kept"] for k in range(1, 40))
    assert all(by_id[100 + k]["kept"] and by_id[100 + k]["n_left_words"] == 40 for k in range(40))
    assert all(by_id[300 + k]["kept"] for k in range(60))
    small = quality.judged(frame, texts=False)
    assert "text" not in small.columns and Counter((r["doc_id"], r["kept"]) for r in small.collect()) == Counter((x[0], x[2]) for x in got.elements())


def test_lines_are_cleaned_without_a_shuffle_of_texts(spark):
    """However many documents lose lines, only the few lines of each host travel to the texts."""
    menu = "home news sport weather contact imprint login register help search archive"
    made = [(k, f"{menu}\n" + " ".join(f"own{k}word{j}" for j in range(30)), "web") for k in range(3000)]
    out = quality.judged(spark.createDataFrame(made, "doc_id long, text string, source string"))
    assert out.where("cleaned <> text").count() == 2999
    plan = out._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert not re.search("SortMergeJoin|hashpartitioning\\(doc_id", physical) and "BroadcastHashJoin" in physical


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_quality_rejects_depleted_documents_of_the_tables(spark, table):
    out = quality.judged(spark.read.parquet(f"/root/testdata/{table}/documents.parquet").select("doc_id", "source", "text"), texts=False)
    counts = out.agg(F.count_if(~F.col("base_failed") & ~F.col("kept")), F.count_if(~F.col("base_failed"))).first()
    assert 0 < counts[0] < 0.02 * counts[1]


def test_pipeline(spark, small_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, small_dir).cache()
        assert docs.columns == columns, name
        assert docs.count() > 0, name
    out = P.run(spark, small_dir)
    assert out.count() == docs.count()
    assert out.where("n_tokens <> size(ids)").count() == 0


def brute_pipeline(rows_):
    """(doc_id, text, lang, source) rows through all five stages, by the book."""
    import public_tokenizers
    import tiktoken

    judged = brute_judged([(i, t, s) for i, t, _, s in rows_])
    rows_ = [(i, c, lang, s) for (i, _, lang, s), (ok, _, c) in zip(rows_, judged) if ok]
    key = lambda line: k if len(k := line.strip(" \t\n\x0b\x0c\r").translate(LOW)) >= 10 else None
    owner = {}
    for i, t, *_ in rows_:
        for line in (t or "").split("\n"):
            if k := key(line):
                owner[k] = min(owner.get(k, last(i)), last(i))
    fresh = lambda i, t: "\n".join(x for x in (t or "").split("\n") if key(x) is None or owner[key(x)] == last(i))
    rows_ = [(i, fresh(i, t), lang, s) for i, t, lang, s in rows_]
    stay = sorted(brute_stay([(i, t) for i, t, *_ in rows_]))
    rows_ = [rows_[k] for k in stay]
    size = lambda t: len(WORD.findall(t))
    sizes = Counter()
    for _, t, _, s in rows_:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(sizes.values()))
    while free:
        each = rest / sum(weight[s] for s in free)
        over = {s for s in free if each * weight[s] > 3 * sizes[s]}
        for s in over or free:
            target[s] = 3.0 * sizes[s] if over else each * weight[s]
        rest -= sum(target[s] for s in over)
        free -= over or free
    taken = []
    for s in order:
        mine = sorted(((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) if i is not None else 0), i, t, lang) for i, t, lang, x in rows_ if x == s)
        times = int(target[s] // sizes[s]) if sizes[s] else 0
        left, run = target[s] - times * sizes[s], 0
        by_hash = defaultdict(list)
        for h, i, t, lang in mine:
            by_hash[h].append((i, t, lang))
        more = set()
        for h in sorted(by_hash):
            n = sum(size(t) for _, t, _ in by_hash[h])
            if run + n <= left:
                more.add(h)
                run += n
            else:
                if run + n - left < left - run:
                    more.add(h)
                break
        taken += [(i, t, lang, s) for h, i, t, lang in mine for _ in range(times + (h in more))]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Counter((i, lang, s, tuple(other.encode_ordinary(t)), len(t)) for i, t, lang, s in taken)


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    rng = np.random.default_rng(12)
    menu = "home news sport weather contact imprint login register help search archive"
    made = []
    for k in range(90):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(12, 300)))]
        cut = lambda w: "\n".join(" ".join(w[a : a + 25]) for a in range(0, len(w), 25))
        made.append(cut(words))
        if k % 3 == 0:  # a near-copy: some words changed, each on a line of its own kind
            more = list(words)
            for at in rng.choice(len(more), max(1, len(more) // 60), replace=False):
                more[at] = f"x{rng.integers(0, 5000)}"
            made.append(" ".join(more))
        if k % 5 == 0:
            made.append(cut(words) + "\n" + menu)
        if k % 4 == 0:
            made.append(f"{menu}\n" + cut(words[:8]))
    made += [made[0], made[0], SENTENCES[0] * 30, "", None, "short", "Ünï " * 12, " ".join(f"u{k}" for k in range(60_000))]
    rows_ = [(int(i) - 40, t, ["en", "fr", None][k % 3], ["a", "b", "c", None][k % 4]) for k, (i, t) in enumerate(zip(rng.permutation(len(made)), made))]
    rows_ += [(None, made[1], "en", "a"), (None, " ".join(f"n{k}" for k in range(40)), "en", "b"), (3, " ".join(f"m{k}" for k in range(50)), "en", "c"), rows_[2], rows_[2]]
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows_], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["lang"], r["source"], tuple(r["ids"]), r["decoded_chars"]) for r in P.run(spark, f"file://{tmp_path}").collect())
    want = brute_pipeline(rows_)
    assert 50 < sum(want.values()) and {x[0] for x in got} == {x[0] for x in want}
    assert got == want


def test_pipeline_of_an_empty_table_and_more_columns(spark):
    import corpus_pipeline as P

    kinds = "doc_id long, text string, lang string, source string, n_chars long, shard int, row string, node long, size long, hash long"
    for data in ([], [(k, f"{SENTENCES[k]} and {' '.join(f'q{k}x{j}' for j in range(30))}", "en", None, 1, 2, "r", 3, 4, 5) for k in range(5)]):
        docs = spark.createDataFrame(data, kinds)
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == [x.split()[0] for x in kinds.split(", ")]
        assert {(r["shard"], r["row"], r["node"], r["size"], r["hash"]) for r in docs.collect()} <= {(2, "r", 3, 4, 5)}
        assert P.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_lm_merges_symbols_in_little_memory():
    import tracemalloc

    from cadenza.llm import lm

    rng = np.random.default_rng(6)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), np.uint8)) for _ in range(3000)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 3000, 400)) for _ in range(2500)]  # some 6 MB
    want = sum(len(t) + 1 for t in texts)
    tracemalloc.start()
    total = sum(int(n.sum()) for _, n in lm.merged(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == want
    assert peak < 128 << 20, peak >> 20  # 146 MB with chunks of 2 MB
    # what repeats is one part, however long: a 32-bit sum is bounded by the depth of the code
    again = list(lm.merged(texts[:50] * 120, 20))
    assert len(again) == 1 and int(again[0][1].sum()) == 120 * sum(len(t) + 1 for t in texts[:50])
    (once, n), (many, times) = next(lm.merged(texts[:50])), again[0]
    assert np.array_equal(np.sort(once.key()), np.sort(many.key()))
    assert np.array_equal((n * 120)[np.argsort(once.key())], times[np.argsort(many.key())])


def test_lm_asks_once_for_what_is_alike_to_a_predictor(monkeypatch):
    from cadenza.llm import lm

    rng = np.random.default_rng(7)
    words = [bytes(rng.integers(97, 107, rng.integers(2, 9), np.uint8)) for _ in range(2000)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 2000, 300)) for _ in range(300)]
    code, raw = counted(texts)
    table = lm.packed(raw)
    # every decision counted for itself, and looked up for itself
    plain, part = np.zeros(raw.shape, np.uint32), lm.symbols(texts)
    row, at, begin = lm.decisions(part.gram, code)
    for i in range(lm.PREDICTORS):
        np.add.at(plain.reshape(-1), lm.slots_of(i, part, row, code.place[at], code) * 2 + code.bits[at], 1)
    assert (raw == plain).all()
    (part, n), asked = next(lm.merged(texts)), []
    row, at, begin = lm.decisions(part.gram, code)
    assert int(n.sum()) == sum(len(t) + 1 for t in texts)
    slots_of = lm.slots_of
    monkeypatch.setattr(lm, "slots_of", lambda i, part, row, *more: asked.append(len(row)) or slots_of(i, part, row, *more))
    for trained in (False, True):
        asked.clear()
        odds, gate = lm.inputs(table, part, row, at, begin, trained, code)
        # all predictors together ask for 2.7 slots a decision; each asked for its own, 5 in all
        assert sum(asked) < 0.6 * lm.PREDICTORS * len(row), sum(asked) / len(row)
        shift = (code.bits[at].astype(np.int64) + 1 << 16) * trained
        want = np.zeros(len(row), np.int64)
        for i in range(lm.PREDICTORS):
            pair = table[slots_of(i, part, row, code.place[at], code)] + shift
            assert (odds[i] == lm._ODDS[pair]).all()
            known = lm._KNOWN[pair].astype(np.int64)
            want = np.where(known > 0, (i + 1) * 25 + known * 5, want) if i < len(lm.ORDERS) else want + known
        assert (gate == want).all()
