"""Each operator against a brute-force version, on the smallest documents and on a fixture of awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, rows_of
from pyspark.sql import functions as F

from sedimentry.llm import components, decontam, jaccard, lengths, licenses, mixing, pii, quality, queries, repeats, storage, substrings, suffixes, tokenbin, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, start long, __key double"


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


def awkward_rows():
    """Nulls, empty and long texts, copies, near copies, shared passages, ties, repeated rows, odd white space."""
    rng = random.Random(5)
    base, passage = _prose(rng, 90), _prose(rng, 70)
    near = base.split()
    near[40] = "changed"
    texts = [
        base, base, " ".join(near), None, "", "   \n\t ", "one", "one", "one two three four", "One Two Three Four", _prose(rng, 30) + " " + passage, passage + "\n" + _prose(rng, 20),
        "a " * 400, "ab" * 700, "x" * 20_000, _prose(rng, 3000), "line\nline\nline\nother\n", "p q r\x1fs", "+1 (555) 010-2233, a.b@c.example.org 10.0.0.1 4111 1111 1111 1111",
        "under the MIT License. cc by-nc the mit license", "<|endoftext|> a.b, c ..", base + " tail", "😀 " * 60, "中文。字" * 90,
    ]
    rows = [(i * 3, t, "en", ("src", None, "b")[i % 3], None, 1, 2.0, 3, 4.0) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[6], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def bag(rows, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in rows)


def words(text):
    return text.encode().split()


@pytest.fixture(params=["small", "awkward"])
def docs(request):
    return request.getfixturevalue(request.param)


# --- 1 mixing --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows_of(got, columns) == rows_of(want, columns)


def test_mix(docs):
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == docs.count()
    assert bag(rows, "doc_id", "size", "taken") == bag(mixing.mix_report(docs.repartition(5)).collect(), "doc_id", "size", "taken")
    assert all(r.taken <= 3 * r["size"] for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(mixing.word_count("text"))).first()[0] == sum(r.taken for r in rows)


def test_mix_reaches_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice(["a", "b", "c", "d"])) for i in range(4000)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    per = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(per) == 4 and all(abs(r.taken - r.target) <= 60 for r in per)


def test_inclusion_odds(spark):
    """Of a source taken in part, documents four times as long have twice the odds to be taken."""
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.repeat(F.lit("w "), F.when(F.col("id") % 4 < 2, 10).otherwise(40)).alias("text"))
    got = mixing.mix_report(rows).where("target < source_size").groupBy("size").agg(F.avg((F.col("taken") > 0).cast("double")).alias("p")).collect()
    odds = {r["size"]: r.p / (1 - r.p) for r in got}
    assert set(odds) == {10, 40} and 1.85 < odds[40] / odds[10] < 2.15, odds


# --- 2 licences ------------------------------------------------------------------------------------------------------


def brute_license(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    phrases = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
    hits = [(i, label) for phrase, label in phrases for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_scan(docs):
    got = licenses.license_scan(docs).collect()
    want = collections.Counter((d, *brute_license(t)) for d, t in texts_of(docs))
    assert bag(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_matching_statistics():
    rng, auto = random.Random(4), licenses.automaton()
    pool = [w for _, t in auto.templates for w in t]
    joined = [b" " + b" ".join(t) + b" " for _, t in auto.templates] + [b" " + b" ".join(t) + b" " for _, t in auto.phrases]
    for _ in range(60):
        text = [rng.choice(pool) for _ in range(20)]
        k = rng.randrange(len(auto.templates))
        own = auto.templates[k][1]
        a = rng.randrange(len(own) - 5)
        text += own[a : a + 9] + [b"zzz"] + text[:5]
        _, matches = auto.stream(text, 1)
        best = [max((n for n in range(i + 1) if any(b" " + b" ".join(text[i - n : i]) + b" " in j for j in joined)), default=0) for i in range(len(text) + 1)]
        assert all(best[end] == n for end, n, _ in matches)
        assert max(n for _, n, _ in matches) == max(best)


def test_base_phrases():
    got = licenses.scan("Released under the MIT License; the mit license; UNDER the mit-license. Apache License, Version 2.0 cc by nc cc by nc")
    assert (got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (5, 1, 20, "apache-2,cc-by-nc,mit")
    assert licenses.scan("the mit license")["n_base"] == 0 and licenses.scan("the mit license")["first_word"] is None


def test_run_that_stands_twice_in_a_template():
    auto = licenses.Automaton((("twice", "one two three four five six seven eight one two three four nine"),), ())
    words = [w.encode() for w in "five six seven eight x one two three four".split()]
    assert max(c[0] for c in licenses.chain(auto.stream(words, 4)[1], auto)) == 8 / 13


def test_license_template():
    text = "note. " + licenses.TEMPLATES[0][1].upper() + " end"
    got = licenses.scan(text)
    assert "mit" in got["labels"].split(",") and got["score"] > 0.9


# --- 3 and 8 repeats -------------------------------------------------------------------------------------------------


def brute_words(docs):
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - 49):
            k = b" ".join(w[i : i + 50])
            first[k] = min(first.get(k, repeats.NO_ID), repeats.NO_ID if d is None else d)
    for d, t in docs:
        w = words(t)
        gone = bytearray(len(w))
        for i in range(len(w) - 49):
            if first[b" ".join(w[i : i + 50])] < (repeats.NO_ID if d is None else d):
                gone[i : i + 50] = b"\1" * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        yield d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()


def brute_bytes(docs):
    raw = [(d, t.encode()) for d, t in docs]
    seen = collections.Counter(b[i : i + 200] for _, b in raw for i in range(len(b) - 199))
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        yield d, len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substrings(docs, hot):
    plan = repeats.Plan(repeats.Words, 50, 10, True, hot=hot)
    got = repeats.remove_repeats(docs, plan, substrings.subtree, substrings._digest, substrings.SCHEMA).collect()
    assert bag(got, "doc_id", "n_words", "n_removed", "kept_sha256") == collections.Counter(brute_words(texts_of(docs)))


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffixes(docs, hot):
    plan = repeats.Plan(repeats.Bytes, 200, 40, False, hot=hot)
    got = repeats.remove_repeats(docs, plan, suffixes.merge_runs, suffixes._digest, suffixes.SCHEMA).collect()
    assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == collections.Counter(brute_bytes(texts_of(docs)))


def test_kept_texts(awkward):
    assert all(len(words(r.kept)) == r.n_words - r.n_removed for r in substrings.deduplicate(awkward).collect())
    assert suffixes.deduplicate(awkward).count() == awkward.count()


def test_loser_tree():
    rng = random.Random(8)
    for _ in range(200):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 6))]
        shared = [[0] + [repeats.common_prefix(a, b) for a, b in zip(r, r[1:])] for r in runs]
        got = list(suffixes.LoserTree(list(zip(runs, shared))))
        merged = [runs[r][i] for r, i, _ in got]
        assert merged == sorted(x for r in runs for x in r)
        assert [c for _, _, c in got][1:] == [repeats.common_prefix(a, b) for a, b in zip(merged, merged[1:])]


# --- 4 quality -------------------------------------------------------------------------------------------------------


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {t for t, n in collections.Counter(triples).items() if n > 1}
    covered = {i + k for i, t in enumerate(triples) if t in many for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    symbols, dup = len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines))
    chars = sum(map(len, w))
    kept = not (failed or symbols > len(w) or 100 * dup > 50 * len(lines) or not 2 * len(w) <= chars <= 20 * len(w))
    return len(w), chars, symbols, dup, len(covered), failed, kept


def test_quality(docs):
    got = quality.report(docs).collect()
    want = collections.Counter((d, *brute_quality(t)) for d, t in texts_of(docs))
    assert bag(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == want
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_cascade_order():
    ticks = iter([0, 10, 10, 11, 11, 12])
    rules = [quality.Rule("dear", lambda f: True), quality.Rule("cheap", lambda f: True), quality.Rule("idle", lambda f: False)]
    assert [r.name for r in quality.order_rules(["a"] * 4, rules, lambda: next(ticks))] == ["cheap", "idle", "dear"]
    asked = []
    watched = [quality.Rule(n, lambda f, n=n, v=v: asked.append(n) or v) for n, v in (("pass", False), ("stop", True), ("never", True))]
    assert quality.rejected(quality.Features("a"), watched) and asked == ["pass", "stop"]


def test_cascade_leaves_dear_features_alone():
    """Where the first rule rejects, no feature of a later one is computed."""
    g = quality.Features("## " * 60)
    assert quality.rejected(g, [next(r for r in quality.RULES if r.name == "symbol_ratio"), *quality.RULES]) and set(g._known) == {"n_symbols"}


def test_sample_comes_from_all_over(spark):
    rows = spark.createDataFrame([(k, f"text {k} of {'first' if k < 900 else 'second'}") for k in range(1000)], "doc_id long, text string").coalesce(1)
    assert any("second" in t for t in quality.sample_texts(rows, "text", 100))


# --- 5 similarity ----------------------------------------------------------------------------------------------------


def brute_components(docs):
    sets = {}
    for d, t in docs:
        w = t.encode().lower().split()
        if d is not None:
            sets.setdefault(d, []).append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    flat = [(d, s) for d, many in sets.items() for s in many if s]
    for i, (d, s) in enumerate(flat):
        for e, t in flat[:i]:
            if 100 * len(s & t) >= 80 * len(s | t):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
    out = [(d, len(s), root(d)) for d, many in sets.items() for s in many]
    for d, t in docs:
        if d is None:
            n = len(t.encode().lower().split())
            out.append((None, len({tuple(t.encode().lower().split()[i : i + 5]) for i in range(n - 4)}) if n > 4 else min(n, 1), None))
    return collections.Counter(out)


@pytest.mark.parametrize(("few", "big", "local"), [(3, 64, 32), (1, 1, 1), (2, 10**6, 10**6)])
def test_components(docs, few, big, local, monkeypatch):
    for name, value in (("SMALL", few), ("BELOW", few), ("BIG", big), ("LOCAL", local)):
        monkeypatch.setattr(jaccard, name, value)
    assert bag(jaccard.similarity_components(docs).collect(), "doc_id", "n_shingles", "component_id") == brute_components(texts_of(docs))


def _edited(rng, text, edits):
    out = text.split()
    for _ in range(edits):
        k = rng.randrange(len(out))
        roll = rng.random()
        out[k : k + (roll < 0.7)] = [] if roll < 0.1 else [_prose(rng, 1) + "x"]
    return " ".join(out)


def near_copies(n, seed):
    """A large group of near copies, most of them mutually below 0.8; some are copies of copies, some share a passage only."""
    rng = random.Random(seed)
    base, passage = _prose(rng, 150), _prose(rng, 60)
    texts = [base]
    for k in range(n):
        origin = base if rng.random() < 0.7 else rng.choice(texts)
        texts.append(_edited(rng, origin, rng.randrange(1, 24)))
        if k % 6 == 0:
            texts.append(_prose(rng, rng.randrange(4, 90)) + " " + passage + " " + _prose(rng, 60))
    return [(i * 7 % 100_003, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("few", "big", "local"), [(3, 64, 32), (1, 8, 2)])
def test_near_copies(spark, few, big, local, monkeypatch):
    for name, value in (("SMALL", few), ("BELOW", 8 * few), ("BIG", big), ("LOCAL", local)):
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies(500, 11)
    got = jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute_components(rows)
    assert bag(got, "doc_id", "n_shingles", "component_id") == want and len({x[2] for x in want}) > 150


def test_edges_grow_with_members(spark, monkeypatch):
    """A group of n near copies makes a bounded number of edges a member, far fewer than its pairs."""
    made, count = [], jaccard._edges_of
    monkeypatch.setattr(jaccard, "_edges_of", lambda *a: made.append((x := count(*a))[0].count()) or x)
    rows = near_copies(800, 3)
    jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert sum(made) < 80 * len(rows) < len(rows) ** 2 / 10


def test_texts_stay_where_they_are(spark, docs, monkeypatch):
    """Where the session asks for more partitions than there are buckets, the table of texts is still read by bucket; once the
    edges are known it holds no others than the documents that have one."""
    rows = docs.count()
    made, bucketed = [], storage.bucketed
    monkeypatch.setattr(storage, "bucketed", lambda *a, **k: made.append((x := bucketed(*a, **k)).count()) or x)
    plans, visit = [], jaccard._visit
    monkeypatch.setattr(jaccard, "_visit", lambda *a: plans.append((x := visit(*a))._jdf.queryExecution().executedPlan().toString()) or x)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        assert bag(jaccard.similarity_components(docs).collect(), "doc_id", "n_shingles", "component_id") == brute_components(texts_of(docs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert plans and all("Bucketed: true" in p and "Bucketed: false" not in p for p in plans)
    assert len(made) == 2 and made[1] < made[0] <= rows


def test_tokens_outside_the_pivot():
    """Linked sets, one of them not linked with a smaller pivot, share a token of their prefixes outside it."""
    rng, seen = np.random.default_rng(5), 0
    while seen < 3000:
        base = rng.integers(1, 1 << 63, int(rng.integers(5, 120)), dtype=np.uint64)
        fresh = lambda most: rng.integers(1, 1 << 63, int(rng.integers(0, most + 1)), dtype=np.uint64)
        more = fresh(len(base))
        x, y, p = (np.unique(np.r_[rng.permutation(part)[int(rng.integers(0, len(part) // 4 + 1)) :], fresh(len(base) // 5)]) for part in (np.r_[base, more], np.r_[base, more], base))
        if not len(p) or not jaccard.linked(x, y) or jaccard.linked(x, p) and jaccard.linked(y, p):
            continue
        seen += 1
        one, two = (jaccard._outside(z, p, min(len(x), len(y))) for z in (x, y))
        assert any(len(np.intersect1d(one[k], two[k])) for k in (0, 1))


def test_no_link_is_lost():
    """Random near copies of all sizes: linked sets share a signature that not both would give up."""
    rng = np.random.default_rng(3)
    for n in [*range(4, 60), 100, 237, 500, 1201]:
        for _ in range(12):
            a = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
            drop = int(rng.integers(0, n // 9 + 2))
            b = np.unique(np.r_[a[drop:], rng.integers(1, 1 << 63, int(rng.integers(0, n // 8 + 2)), dtype=np.uint64)])
            if len(b) and jaccard.linked(a, b) and len(a) != drop:
                if len(a) == len(b) and (a == b).all():
                    continue
                assert len(np.intersect1d(jaccard.signatures(a)[0], jaccard.signatures(b)[0])), (n, len(b))
                both = len(np.intersect1d(a, b))
                assert jaccard.apart(jaccard.parity(a), jaccard.parity(b)) <= len(a) + len(b) - 2 * both


def test_keep_first(docs):
    rows = jaccard.similarity_components(docs).collect()
    kept = jaccard.keep_first(docs)
    gone = {r.doc_id for r in rows if r.component_id is not None and r.component_id != r.doc_id}
    assert kept.columns == docs.columns
    left = kept.collect()
    assert {r.doc_id for r in left} == {r.doc_id for r in rows} - gone
    worded = [r.doc_id for r in left if r.doc_id is not None and (r.text or "").encode().split()]
    assert len(worded) == len(set(worded))
    assert sum(not (r.text or "").encode().split() for r in left) == sum(not t.encode().split() for d, t in texts_of(docs) if d not in gone)


def test_star_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.doc_id: r.label for r in components.labels(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in up if root(x) != x}


# --- 6 personal data -------------------------------------------------------------------------------------------------

_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def passes(kind, value):
        digits = [int(c) for c in value if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1])) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(_PATTERNS.items()) for m in re.finditer(p, text) if passes(kind, m[0])]
    return [(a, z, kind) for a, _, z, kind in sorted(found)]


def test_base_spans():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@+- ()93%_b2540é\n") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_personal_data(docs):
    got = pii.find_personal_data(docs).collect()
    want = collections.Counter()
    for d, t in texts_of(docs):
        spans = brute_spans(t)
        n = collections.Counter(k for _, _, k in spans)
        want[(d, *(n[k] for k in pii.KINDS), hashlib.sha256(pii.written(spans).encode()).hexdigest())] += 1
    assert bag(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want


def test_tagger_on_held_out_texts():
    rng, model = random.Random(1234), pii.train()
    made = [pii.labelled(rng, 300) for _ in range(150)]
    hit, wrong, all_ = collections.Counter(), collections.Counter(), collections.Counter()
    for (_, spans), got in zip(made, pii.model_spans([t for t, _ in made], model), strict=True):
        all_.update(s[2] for s in spans)
        hit.update(s[2] for s in spans if s in got)
        wrong.update(s[2] for s in got if s not in spans)
    assert all(hit[k] >= 0.9 * all_[k] and wrong[k] <= 0.1 * all_[k] for k in pii.KINDS), (hit, wrong, all_)


#: Written by hand, in forms that no base pattern finds; none is made by the training generator.
HELD = {
    "email": ["jane.doe (at) example (dot) com","bob_smith[at]mail[dot]example[dot]org","contact at openhouse dot net","Maria.Lopez AT university DOT edu","support {at} widgets {dot} io","r.feynman [at] caltech.edu","john (at) gmail.com","hr(at)company(dot)com","anna-lena at web.de","sales [AT] bigshop [DOT] com","peter.pan at neverland dot org","k.tanaka(at)tokyo-labs.com","press <at> museum <dot> org","info at city-hall dot example dot org","alice99 [at] proton [dot] net","w.shatner @ starfleet.org","office (AT) lawfirm (DOT) net","tom at farm dot io","billing[at]service.net","dr.who (at) tardis (dot) co"],
    "ip": ["2001:db8:85a3:0:0:8a2e:370:7334","fe80::1ff:fe23:4567:890a","2001:db8::1","fd12:3456:789a:1::1","2607:f0d0:1002:51::4","2001:0db8:0000:0042:0000:8329:1234:5678","fe80::a00:27ff:fe4e:66a1","2a00:1450:4001:81b::200e","fd00:abcd::12","2001:4860:4860::8888","3ffe:1900:4545:3:200:f8ff:fe21:67cf","2620:0:2d0:200::7","fe80::5efe:c0a8:102","2001:db8:1234::42","fc00:1:2:3:4:5:6:7"],
    "card": ["4111.1111.1111.1111","5500/0000/0000/0004","3782.822463.10005","3714/496353/98431","4012.8888.8888.1881","5105.1051.0510.5100","6011/1111/1111/1117","4222.2222.2222.2220","5555/5555/5555/4444","6011.0009.9013.9424"],
    "phone": ["555-010-2233 ext 4","(212) 555-0187","415.555.0132","303-555-0199","020 7946 0958","0049 30 901820","(617)555-0143","555 867 5309","0161/496/0000","800-555-0100 x27","702.555.0165","(404) 555.0177","0033 142 685 300","919 555 0121","206-555-0154 ext. 12","030 1234 5678","(503) 555-0111 x9","512/555/0198","0044 20 7946 0123","646-555-0173"],
}
BEFORE = ("You can reach me under ", "For details write to ", "The server log shows ", "Please call our desk: ", "On file we have ")
BEHIND = (" until Friday evening.", " for any questions", " as usual.\nThanks again", ", which is new.", "")


def test_tagger_on_hand_written_forms(spark):
    """Planted in documents, nine in ten of each kind are found: a span of the kind covers half of the value or more."""
    rows, want = [], {}
    for kind, values in HELD.items():
        for k, value in enumerate(values):
            before, doc = BEFORE[k % 5], len(rows)
            rows.append((doc, before + value + BEHIND[k % 5]))
            want[doc] = (kind, len(before), len(before) + len(value))
            assert pii._TRIGGER.search(value) and not pii.base_spans(rows[-1][1]), value
    clean = ["Meet at noon. Then go home at 5.30 on 2024-05-17, price $12.50, version v1.2.33, pages 100-220.", "Look at this. Dot the i, 48 % of 1200 people, No. 48213, 12:45."]
    rows += [(1000 + k, t) for k, t in enumerate(clean)]
    hit = collections.Counter()
    for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans = [x.rsplit(":", 2) for x in r.spans.split(",") if x]
        if r.doc_id >= 1000:
            assert not spans, (r.doc_id, spans)
            continue
        kind, a, z = want[r.doc_id]
        hit[kind] += any(k == kind and min(z, int(y)) - max(a, int(x)) >= (z - a) / 2 for k, x, y in spans)
    assert all(hit[k] >= 0.9 * len(v) for k, v in HELD.items()), hit


def test_gradients():
    model, rng = pii.Tagger(4, 1), random.Random(2)
    for g in (model.ahead, model.back, model.out):
        for k in g:
            g[k] = g[k].astype(np.float64)
    x, y = pii.batch_of(rng, 3, 12)
    _, grads = model.step(x, y)
    for g, d in zip((model.ahead, model.back, model.out), grads, strict=True):
        for k in g:
            at = np.unravel_index(np.abs(d[k]).argmax(), d[k].shape)
            was = g[k][at]
            g[k][at] = was + 1e-3
            up, _ = model.step(x, y)
            g[k][at] = was - 1e-3
            down, _ = model.step(x, y)
            g[k][at] = was
            assert abs((up - down) / 2e-3 - d[k][at]) < 2e-2 * max(1e-2, abs(d[k][at])), k


def test_redaction(awkward):
    got = {r.doc_id: r.text for r in pii.redact(awkward).collect()}
    assert "@" not in got[54] and "<email>" in got[54] and "<phone>" in got[54]


# --- 7 and 9 tokens --------------------------------------------------------------------------------------------------


def whole_ids(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_path())
    return [np.array([*e.ids, 2], "<u4") for e in library.encode_batch([t for _, t in docs], add_special_tokens=False)]


def test_token_files(docs):
    pairs = texts_of(docs)
    ids = whole_ids(pairs)
    made = sorted(zip([d for d, _ in pairs], ids), key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted(tokenbin.round_trip(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in made]
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter((d, len(x), zlib.crc32(x.tobytes())) for d, x in made)
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])[:-1]].tolist()


def test_encoder_takes_columns():
    """A column with nulls and texts that are encoded whole; of the cached stretches only a few are kept."""
    from tokenizers import Tokenizer

    texts = ["one two, three.", None, "", "a   b\n\n", "tab\there <|x", ". ,five", "é 中 ü.", "one two"] * 3
    library = Tokenizer.from_file(tokens.default_path())
    want = [np.array(library.encode(x or "", add_special_tokens=False).ids, "<u2").tobytes() for x in texts]
    enc = tokens.PieceEncoder(tokens.default_path(), 2, cached=3)
    assert enc.encode(pa.array(texts)) == want == enc.encode([x or "" for x in texts])


def test_read_ids(spark, awkward):
    folder = storage.new_path(spark, "test")
    tokenbin.write_ids(awkward, folder)
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in tokenbin.read_ids(spark, folder).collect())
    pairs = texts_of(awkward)
    assert got == collections.Counter((d, tuple(x.tolist())) for (d, _), x in zip(pairs, whole_ids(pairs), strict=True))


def test_code_lengths():
    import heapq

    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 300):
        counts = rng.integers(0, 1000, n) ** 2
        lengths = tokenbin.code_lengths(counts, 30)
        heap = [int(c) for c in counts if c]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        if (counts > 0).sum() > 1:
            assert int((lengths * counts).sum()) == cost
            assert sum(2.0 ** -int(x) for x in lengths if x) == 1.0
    skewed = tokenbin.code_lengths(2 ** np.arange(40, dtype=np.int64), 8)
    assert skewed.max() == 8 and sum(2.0 ** -int(x) for x in skewed) <= 1.0


def test_length_histogram(docs):
    n = np.array([len(x) - 1 for x in whole_ids(texts_of(docs))])
    table = lengths.token_counts(docs).cache()
    for r in table.collect():
        L = r.context_limit
        assert (r.n_docs, r.docs_over, r.tokens_within, r.truncated_total, r.total_tokens) == ((n == L).sum(), (n > L).sum(), n[n <= L].sum(), np.minimum(n, L).sum(), n.sum())
    for limit in (0, 1, 7, 100, 10**7):
        assert lengths.truncated_total(table, limit).first().tokens == np.minimum(n, limit).sum()
    assert lengths.quantile(table, 0.5).first().n_tokens == np.sort(n)[-(-len(n) // 2) - 1]


# --- 10 decontamination ----------------------------------------------------------------------------------------------


def _leak_tables(spark):
    rng = random.Random(9)
    item = "In the year 1997 Maria bought 12 apples for 3 dollars and later she sold 12 of them to her friend Peter near the old river bridge"
    changed = item.replace("1997", "2003").replace("12", "40").replace("Maria", "Helga").replace("Peter", "Otto").replace("dollars", "euros")
    mixed_up = item.replace("bought 12", "bought 40").replace("1997", "5").replace("for 3", "for 5")
    docs = [(1, _prose(rng, 30) + ". " + item + ". " + _prose(rng, 9)), (2, _prose(rng, 12) + ". " + changed), (3, _prose(rng, 50)), (4, _prose(rng, 9) + ". " + mixed_up), (5, None), (6, ""), (None, item)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_leaks(spark, limit, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", limit)
    docs, benchmark = _leak_tables(spark)
    got = {r.doc_id: r for r in decontam.leaks(docs, benchmark).collect()}
    assert got[1].kind == "exact" and got[1].item_id == 7 and got[1].coverage > 0.9
    assert got[2].kind == "reparameterised" and got[2].n_consistent == got[2].n_slots > 0
    assert 3 not in got and 4 not in got
    assert {1, 2} & {r.doc_id for r in decontam.clean(docs, benchmark).collect()} == set()


@pytest.mark.parametrize("change", [("Maria", "Maria Lopez"), ("sold 12 of", "sold then 12 of"), ("and later she", "and she"), ("12", "twenty five"), ("later she", "later that day she")])
def test_leaks_over_offsets(spark, change):
    _, benchmark = _leak_tables(spark)
    item = benchmark.where("item_id = 7").first().text
    docs = spark.createDataFrame([(1, "before it. " + item.replace(*change) + ". " + "behind it")], "doc_id long, text string")
    got = decontam.leaks(docs, benchmark).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 7)] and got[0].n_consistent == got[0].n_slots > 0
    assert decontam.clean(docs, benchmark).count() == 0


def test_slots_over_offsets(spark):
    _, benchmark = _leak_tables(spark)
    item = benchmark.where("item_id = 7").first().text
    wrong = item.replace("later she", "later indeed she").replace("bought 12", "bought 40").replace("1997", "5").replace("for 3", "for 5")
    assert decontam.leaks(spark.createDataFrame([(1, wrong)], "doc_id long, text string"), benchmark).count() == 0


def test_leak_behind_many_variants(spark):
    _, benchmark = _leak_tables(spark)
    item = benchmark.where("item_id = 7").first().text
    wrong = [item.replace("1997", "5").replace("for 3", "for 5").replace("bought 12", f"bought {40 + k}").replace("sold 12", f"sold {80 + k}") for k in range(12)]
    docs = [(1, ". ".join(wrong)), (2, ". ".join([*wrong, item.replace("12", "77")])), (3, ". ".join([*wrong, item.replace("Maria", "Helga").replace("later she", "later indeed she")]))]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(2, 7), (3, 7)} and all(r.n_consistent == r.n_slots for r in got)


def test_leaks_by_both_paths(spark, monkeypatch):
    docs, benchmark = _leak_tables(spark)
    item = benchmark.where("item_id = 7").first().text
    docs = docs.unionByName(spark.createDataFrame([(1, "clean row under a repeated id"), (None, "clean row without an id"), (2, item), (2, item)], "doc_id long, text string"))
    benchmark = benchmark.unionByName(spark.createDataFrame([(None, item), (7, item), (7, "ab ab. Who asked Maria this"), (10, None)], "item_id long, text string"))
    found, left = [], []
    for limit in (1 << 20, -1):
        monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", limit)
        found.append(collections.Counter(tuple(r) for r in decontam.leaks(docs, benchmark).collect()))
        left.append(collections.Counter(tuple(r) for r in decontam.clean(docs, benchmark).collect()))
    assert found[0] == found[1] and left[0] == left[1]
    assert collections.Counter((r[0], r[1]) for r in found[1].elements()) == {(d, i): n * m for d, n in ((1, 1), (2, 3), (None, 1)) for i, m in ((7, 2), (None, 1))}
    assert {r[1] for r in left[1]} >= {"clean row under a repeated id", "clean row without an id", None, ""} and item not in {r[1] for r in left[1]}


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_verbatim_leaks(spark, limit, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", limit)
    long = "In the year 1997 Maria bought 12 apples for 3 dollars and later she sold 12 of them to her friend Peter near the old river bridge"
    items = [(1, "Who wrote Hamlet?"), (2, "12 km + 7 kg - 3 lb * 9 oz / 4 m = 8 cm"), (3, long), (4, "12 + 7 = ?"), (5, "?!"), (6, ""), (7, "-")]
    texts = {1: "so who wrote Hamlet? Not me", 2: "it was 12 km + 7 kg - 3 lb * 9 oz / 4 m = 8 cm then", 3: "ab " + long.title() + ".", 4: "(12 + 7 = ?)", 5: "ab! " + long.upper(), 6: 'he asked "WHO WROTE\nHAMLET" again'}
    near = {11: "who wrote of Hamlet", 12: "12 km + 7 kg - 3 lb * 9 oz / 4 m = 9 cm", 13: "12 - 7 = 5", 14: "?! and", 15: "12 7"}
    docs = spark.createDataFrame([*texts.items(), *near.items()], "doc_id long, text string").repartition(2)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 3), (6, 1)} and len(got) == 6
    assert all((r.coverage, r.kind) == (1.0, "exact") for r in got) and {r.doc_id: r.first_word for r in got} == {1: 1, 2: 2, 3: 1, 4: 0, 5: 1, 6: 2}
    assert {r.doc_id for r in decontam.clean(docs, benchmark).collect()} == set(near)


def _questions(rng, n):
    """Word problems from invented templates, each as a benchmark has it and asked again with other values."""
    names = ["Maria", "Peter", "Aisha", "Tom", "Yuki", "Omar", "Lena", "Ravi", "Ines", "Kofi", "Olga", "Hugo"]
    units, things = ["apples", "books", "marbles", "stamps", "shells", "coins"], ["baskets", "boxes", "drawers", "crates"]
    places = ["old market by the river", "school near the railway bridge", "village library on the hill", "harbour behind the fish hall"]
    shapes = [
        "{a} went to the {place} and bought {x} {t} for {y} dollars each; how many dollars did {a} pay for all of them?",
        "At the {place} {a} and {b} share {x} {t} so that {a} gets {y} more than {b}; how many does each of them get in the end?",
        "A train leaves the {place} at {x} o'clock and runs {y} km in every hour; how far from there is it when {z} hours have gone by?",
        "{a} puts {x} {t} into each of {y} {c} and gives {z} of them to {b} later that day; how many are left over for {a} to keep?",
        "If {a} reads {x} pages of a long novel each day and {b} reads {y}, after how many days has {b} read {z} pages more than {a}?",
    ]
    for k in range(n):
        shape, place, t, c = shapes[k % 5], rng.choice(places), rng.choice(units), rng.choice(things)
        one, two = ({"a": p[0], "b": p[1], "x": v[0], "y": v[1], "z": v[2]} for p, v in ((rng.sample(names, 2), rng.sample(range(3, 97), 3)) for _ in range(2)))
        yield shape.format(place=place, t=t, c=c, **one), shape.format(place=place, t=t, c=c, **two)


def test_questions_asked_again():
    """Of 250 generated questions nine in ten or more are found again with other names and numbers; texts without one give none."""
    rng = random.Random(21)
    made = list(_questions(rng, 250))
    index, canon = decontam.Index([(k, item) for k, (item, _) in enumerate(made)]), decontam.Canon()
    found = sum(any(m["item_id"] == k for m in index.matches(f"{_prose(rng, 40)}. {again} {_prose(rng, 30)}", canon)) for k, (_, again) in enumerate(made))
    assert found >= 0.9 * len(made), found
    assert not any(index.matches(_prose(rng, 120), canon) for _ in range(60))


def test_planted_leaks(spark, small):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = [(r.item_id, " ".join(r.text.split())) for r in items.collect()]
    want = {(d, i) for d, t in texts_of(small) for i, x in plain if x in " ".join(t.split())}
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(small, items).collect()} == want


# --- edges -----------------------------------------------------------------------------------------------------------


def test_awkward_leaks(spark, awkward):
    assert decontam.leaks(awkward, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0


@pytest.mark.parametrize("run", [mixing.mix_report, mixing.mix, licenses.license_scan, substrings.report, quality.report, quality.keep, jaccard.similarity_components, jaccard.keep_first, pii.find_personal_data, tokenbin.round_trip, suffixes.report, lengths.token_counts])
def test_empty_table(empty, run):
    assert run(empty).count() == 0


def test_empty_leaks(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(empty, items).count() == 0
    assert decontam.clean(empty, items).count() == 0
