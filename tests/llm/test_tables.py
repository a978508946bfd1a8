"""Operators on pages and vectors, the queries, and the pipeline."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from ssaflow.llm import embeddings, queries, warc

from .cases import documents


def test_archive_round_trip(spark):
    big, other = "<p>é</p>" * 200, "x" * 1000
    pages = [(1, "http://a/1", big), (5, "http://a/5", big), (3, "http://a/\r\nX: y", big), (7, None, "short"), (8, "u", "short"), (9, "u", None), (10, "u", ""), (11, "u", other), (12, "u", "y" * 999), (13, "u", "y" * 999), (14, "", "Z: 1\r\n\r\n"), (None, "u", big), (5, "again", big)]
    df = spark.createDataFrame([(*p, "extra", "extra") for p in pages], "page_id bigint, url string, html string, row string, sha256 string")
    archive = warc.write_archive(df)
    payload = {p[0]: (p[2] or "").encode() for p in pages}
    out = warc.read_summaries(spark, archive).collect()
    assert Counter(r.page_id for r in out) == Counter(p[0] for p in pages)
    for r in out:
        data = payload[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 5) if data == big.encode() and r.page_id not in (5, None) else ("response", None))
    # a payload is stored once
    assert spark.read.parquet(archive.payloads).count() == len({v for v in payload.values()})
    for r in warc.read_records(spark, archive).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and head + b"\r\n\r\n" == bytes(r.header)
        assert body == (b"" if r.record_type == "revisit" else payload[r.page_id]) + b"\r\n\r\n"
        assert f"Content-Length: {len(body) - 4}".encode() in head
        assert head.count(b"\r\nX: ") == 0
    none = warc.write_archive(df.limit(0))
    assert warc.read_summaries(spark, none).count() == 0


def linked(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.zeros((len(good), max(len(v) for _, v in good)))
    for k, (_, v) in enumerate(good):
        x[k, : len(v)] = v / np.linalg.norm(v)
    near = x @ x.T >= threshold
    parent, n = {i: i for i, _ in rows}, dict.fromkeys((i for i, _ in rows), 0)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, (i, _) in enumerate(good):
        n[i] = int(near[k].sum()) - 1
        for j in np.flatnonzero(near[k]):
            a, b = find(i), find(good[j][0])
            parent[max(a, b)] = min(a, b)
    return {i: (n[i], find(i), find(i) == i) for i, _ in rows}


@pytest.mark.parametrize(("seed", "dims", "block"), [(1, 8, 100), (2, 3, 60), (3, 24, 2048)])
def test_embeddings(spark, monkeypatch, seed, dims, block):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", block)
    monkeypatch.setattr(embeddings, "LEAF_ROWS", 6)
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, dims))
    rows = []
    for k in range(900):
        spread = (0.0, 0.02, 0.1, 0.25, 1.0)[rng.integers(5)]
        rows.append((k, (centers[rng.integers(20)] + spread * rng.normal(size=dims)).astype("float32").tolist()))
    rows += [(900, None), (901, []), (902, [0.0] * dims), (903, [float("nan")] * dims), (904, [None] * dims), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [1e-40] * dims), (908, [1e38] * dims), (909, [float("inf")] + [1.0] * (dims - 1))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, rep string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got == linked(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in embeddings.near_duplicates(df.where("vec_id = 902")).collect()] == [(902, 0, 902, True)]


def test_repeated_and_missing_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (None, [-1.0, 0.0]), (None, [-1.0, 0.0]), (5, [-1.0, 0.01]), (None, None), (None, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id or 0, r.kept) for r in embeddings.near_duplicates(df).collect())
    # no component takes up the other vector of an id; what has no id counts as a partner
    assert got == [(0, 0, 0, True), (0, 0, 0, True), (0, 2, 0, True), (0, 2, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (5, 2, 5, True)]


def test_whole_balls_link_without_comparing():
    rng = np.random.default_rng(0)
    x = rng.normal(size=16) + 0.001 * rng.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    import io

    block = np.load(io.BytesIO(embeddings.build_block(x, np.arange(500), np.ones(500, np.int64), 0.04)))
    a, b, edges = embeddings.compare(block, block, 0.95, True)
    assert (a + b == 500).all() and len(edges) == 499


def test_queries_are_registered_and_whole():
    import __spark_entry__ as e

    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 11)}
    assert names | {"pipeline"} <= set(e.queries())
    assert set(queries.oracle_sql()) <= names


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    rows, df = documents(spark)
    docs = df.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = out.collect()
    ids = {r[0] for r in rows}
    assert pieces and {p.doc_id for p in pieces} <= ids
    stage = docs
    for name, f in pipeline.STAGES[:-1]:
        after = f(spark, stage, str(tmp_path))
        assert after.columns == docs.columns, name
        stage = after
    assert stage.where("text like '%@example.com%'").count() == 0
    (tmp_path / "none").mkdir()
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "none/labels.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
