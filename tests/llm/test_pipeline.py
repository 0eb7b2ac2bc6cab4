"""run() against its stages done by brute force."""

import collections
import zlib

import numpy as np
from conftest import SF

import corpus_pipeline
from test_llm import brute_components, brute_quality, whole_ids


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text or "", r.source) for r in docs.collect()]
    rows = [r for r in rows if brute_quality(r[1])[-1]]
    first = {d: c for d, _, c in brute_components([r[:2] for r in rows])}
    rows = [r for r in rows if first[r[0]] == r[0]]
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(i in " ".join(r[1].split()) for i in items)]
    kept = {r[0]: r[1] for r in rows}
    got = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r.start)
    ids = dict(zip(kept, whole_ids([(d, t) for d, t in kept.items()]), strict=True))
    times = collections.Counter(r.doc_id for r in got)
    assert set(times) <= set(kept) and max(times.values()) <= 3
    assert all((r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes())) for r in got)
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])[:-1]].tolist()
    size = {d: len(t.encode().split()) for d, t in kept.items()}
    per = collections.defaultdict(list)
    for d, _, s in rows:
        per[s].append(d)
    total = sum(size.values())
    order = sorted(per)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    cap = {s: 3 * sum(size[d] for d in per[s]) for s in order}
    target, free = {}, set(order)
    while True:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap[s]}
        if not over:
            break
        target |= {s: cap[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    for s in order:
        assert abs(sum(times[d] * size[d] for d in per[s]) - target[s]) <= max(size[d] for d in per[s])


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_awkward_tables(spark, tmp_path):
    """Nulls, empty and long texts, copies, repeated rows, columns with clashing names, and empty tables pass every stage."""
    from test_llm import SCHEMA, awkward_rows

    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, rows, some in (("awkward", awkward_rows(), items), ("empty", [], items.limit(0))):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        some.write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert (len(got) > 0) == bool(rows)
        texts = [r[1] or "" for r in rows]
        assert len({r.doc_id for r in got}) <= sum(brute_quality(t)[-1] for t in texts)
