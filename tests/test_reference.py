"""The reference's operators: literal cases, round trips, and every query against DuckDB at the smallest scale."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitloom.functions import bytemachine as bm
from bitloom.functions import codec, media
from bitloom.operators import metrics, records, retrieval, splits, text
from bitloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark embeddings pages conversations events".split()


def norm(rows):
    return sorted((tuple("null" if v is None else round(v, 7) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    cur = c.execute(catalog.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got, want = norm(tuple(r[k] for k in sorted(cols)) for r in df.collect()), norm(tuple(r[cols.index(k)] for k in sorted(cols)) for r in cur.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(math.isclose(x, y, abs_tol=2e-5) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))


def test_windows(spark):
    def cut(n, size, overlap):
        df = spark.createDataFrame([([str(i) for i in range(n)],)], "t array<string>")
        return [(r.start, r.start + len(r.chunk)) for r in text.windows(df, "t", size, overlap).orderBy("chunk_idx").collect()]

    assert cut(10, 4, 2) == [(0, 4), (2, 6), (4, 8), (6, 10), (8, 10)]
    assert cut(10, 4, 0) == [(0, 4), (4, 8), (8, 10)]
    assert cut(0, 4, 0) == [(0, 0)]
    for bad in (4, -1):
        with pytest.raises(ValueError):
            cut(3, 4, bad)


def test_fusion_ties_and_selection(spark):
    def ranking(ids):
        return spark.createDataFrame([(0, b, i + 1) for i, b in enumerate(ids)], "query_id bigint, base_id bigint, rank int")

    got = retrieval.fuse([ranking([3, 1, 2]), ranking([1, 3, 4])], 4).orderBy("rank").collect()
    assert [r.base_id for r in got] == [3, 1, 2, 4]
    assert [round(r.score, 6) for r in got] == [0.032522, 0.032522, 0.015873, 0.015873]
    df = spark.createDataFrame([([7, 9],)], "h array<bigint>")
    assert df.select(retrieval.select_contexts(F.col("h"), 4)).first()[0] == [7, 9, 9, 9]
    with pytest.raises(Exception, match="no candidate"):
        spark.createDataFrame([([],)], "h array<bigint>").select(retrieval.select_contexts(F.col("h"), 4)).collect()
    n = spark.createDataFrame([(1,), (256,), (257,), (65536,), (65537,)], "n bigint")
    assert [r[0] for r in n.select(retrieval.overhead_bytes(F.col("n"), 4)).collect()] == [4, 4, 8, 8, 12]


def test_splits(spark):
    for n, want in ((5, 2), (7, 4), (10, 5)):
        assert splits.three_way(spark.range(n), "id").filter("split = 'base'").count() == want


def test_losses(spark):
    ce = spark.createDataFrame([(0, i, 3.0, x) for i, x in enumerate((1.0, 2.0, 4.0))] + [(1, 0, 1.0, 1.0)], "qid int, cid int, l0 double, l double")
    assert metrics.softmin(ce.filter("qid = 0"), 0.5).first().loss == 1.125479
    assert [r.z for r in metrics.z_scores(ce).orderBy("cid").collect()] == [0.87287, 0.21822, -1.09109]
    ok = spark.createDataFrame([(0, 1), (0, 1), (1, -1), (1, -1), (2, 1), (2, -1), (3, 1), (3, 0)], "k int, ok int")
    assert [r[1] for r in ok.groupBy("k").agg(metrics.tri_state(F.col("ok"))).orderBy("k").collect()] == [1, -1, 0, 0]


def test_tokens_and_names(spark):
    df = spark.createDataFrame([("c++ and c# .net foo-bar_1 a.b", "a.C"), (" x \n", "a.c")], "text string, p string")
    assert df.select(text.tokens(F.col("text"))).first()[0] == ["c++", "and", "c#", ".net", "foo-bar_1", "a.b"]
    assert [r[0] for r in df.select(text.strip(F.col("text"))).collect()][1] == "x"
    assert [r[0] for r in df.select(text.lang_from_name(F.col("p"))).collect()] == ["C++", "C"]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 3))
def test_range_coder(data, seed):
    cum = [np.append(0, np.cumsum(f)).tolist() for f in codec.quantise(np.random.default_rng(seed).integers(0, 1000, (256, 256)))]
    code = codec.encode(data, cum)
    assert len(code) % 4 == 0
    assert codec.decode(code, len(data), cum) == data
    assert codec.strip_pad(codec.patch_tokens(data)[16:]) == data
    bits = codec.bytes_to_bits(data)
    assert codec.bits_to_bytes(bits)[0] == data


def test_range_coder_by_rows():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 1000, (256, 256))
    cum = [np.append(0, np.cumsum(f)).tolist() for f in codec.quantise(counts)]
    for rows in (0, 3, 60):
        texts = [rng.integers(0, 256, k).astype(np.uint8).tobytes() for k in rng.integers(0, 400, rows)] + [b"", b"a" * 3000] * (rows > 0)
        n = np.array([len(x) for x in texts], np.int64)
        z, ideal, ok = codec.round_trip(np.frombuffer(b"".join(texts), np.uint8), n, cum)
        assert z.tolist() == [len(codec.encode(x, cum)) for x in texts]
        assert ok.all()
        assert np.all(z * 8 >= ideal)


def test_range_coder_codes_the_documents(spark):
    got = catalog.queries()["range_roundtrip"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "coalesce(octet_length(text), 0) AS n").collect()
    assert sorted((r.id, r.original_bytes) for r in got) == sorted((r.doc_id, r.n) for r in docs)
    assert all(r.roundtrip_ok for r in got)


def test_patches():
    t = codec.patch_tokens(b"x" * 3126, 16, ".BMP")
    assert len(t) == 16 + 3136 + 16
    assert t[:4] == [*b"bmp", 256]


def test_machine():
    regs = [200, 201, 0, 0, 0, 0, 0, 0, 0, 0]
    for line in ("ROL A", "ROR B"):
        bm.execute(bm.assemble(line), 0, regs)
    assert regs[:2] == [145, 228]
    for line, acc, want in (("DIV C", 9, 255), ("INC", 255, 255), ("DEC", 0, 0), ("ADD A", 200, 255), ("SUB A", 1, 0), ("LOADI 7", 0, 7), ("NOT", 1, 254)):
        assert bm.execute(bm.assemble(line), acc, [145, 0, 0, *[0] * 7]) == want
    p = bm.random_program(5, 30)
    assert [bm.disassemble(bm.assemble(x)) for x in p] == p
    assert (len(bm.run(p)) - bm.MEMORY) % bm.STATE == 0


def test_machine_queries_run_long_programs(spark):
    assert catalog.queries()["bytemachine_run"](spark, SF).selectExpr("max(n_states)").first()[0] > 200
    assert catalog.queries()["bytemachine_eval"](spark, SF).selectExpr("max(total)").first()[0] > bm.MEMORY + 200 * bm.STATE


def test_media():
    x = np.random.default_rng(1).integers(0, 256, (50, 45, 3), dtype=np.uint8)
    parts = media.patches(media.write_bmp(x))
    assert len(parts) == 4
    assert np.array_equal(media.read_bmp(media.reassemble(parts)), x)
    wav = media.write_wav(np.zeros(20000), 8000)
    assert [len(c) - 44 for c in media.chunk_wav(wav, 1000)] == [8000, 8000, 4000]


def test_sources(spark, tmp_path):
    from bitloom.sources import readers

    (tmp_path / "code.jsonl").write_text('not json\n\n{"code": " "}\n{"code": "x"}\n')
    assert [r.text for r in readers.load(spark, str(tmp_path / "code.jsonl"), 1, 1).collect()] == ["x"]
    with pytest.raises(ValueError, match="no source"):
        readers.load(spark, "/nothing")
    with pytest.raises(FileNotFoundError):
        readers.files(spark, str(tmp_path), ["wav"])


def test_sources_in_order(spark, tmp_path):
    from bitloom.sources import readers

    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "a.jsonl").write_text('{"code": "a1"}\n\n{"code": "a2"}\n')
    (tmp_path / "code" / "b.jsonl").write_text("".join(f'{{"code": "b{i}"}}\n' for i in range(500)))
    path = str(tmp_path / "code")
    assert [r.text for r in readers.load(spark, path, 1).collect()] == ["a1"]
    assert [r.text for r in readers.load(spark, path, 3, 1).collect()] == ["a2", "b0", "b1"]
    for name in ("enwiki", "cosmopedia"):
        spark.createDataFrame([(t,) for t in ("z", " ", "y", "x", None)][:4], "text string").coalesce(1).write.parquet(f"{tmp_path}/{name}")
        assert [r.text for r in readers.load(spark, f"{tmp_path}/{name}", 2).orderBy("record").collect()] == ["z"]
        assert [r.text for r in readers.load(spark, f"{tmp_path}/{name}", 2, 2).orderBy("record").collect()] == ["y", "x"]


def test_records(spark):
    hits = spark.createDataFrame([(1, 7, 1), (1, 3, 2)], "query_id bigint, base_id bigint, rank int")
    split = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    assert {r.query_id: r.base_ids for r in records.with_cache(split, hits).collect()} == {1: [7, 3], 2: []}
    records.check_cache(hits, split, 8)
    for bad in ((hits, split, 7), (hits, split.filter("query_id = 2"), 8)):
        with pytest.raises(ValueError, match="stale"):
            records.check_cache(*bad)
    files = spark.createDataFrame([("d.x/a.abc",), ("d.x/a.mid",), ("d.x/b.abc",)], "path string")
    assert [tuple(r) for r in records.pair_files(files, "abc", "mid").collect()] == [("d.x/a", "d.x/a.abc", "d.x/a.mid")]
    assert records.pair_files(files, "abc", "mid", True).count() == 2
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 9)], "k int, n int")
    assert records.join_artefacts(a.filter("k = 1"), b, "k").count() == 1
    with pytest.raises(Exception, match="no artefact of 2"):
        records.join_artefacts(a, b, "k").collect()
    none = spark.createDataFrame([], "original_bytes bigint, z bigint")
    assert records.codec_totals(none, {"z": "z"}).first().ratio == 0.0
    p = spark.createDataFrame([(1, 1, 0.5), (0, 1, 0.25)], "p int, y int, q double")
    assert tuple(records.accuracy(p, "p", "y", "q").first()) == (2, 0.5, 1.039721)
    assert spark.range(1).select(records.sample_id("image", F.lit(7), F.lit(3))).first()[0] == "image000007_p0003"
    assert [r[0] for r in spark.createDataFrame([([1, 2],), (None,)], "c array<int>").select(records.prefix_length(F.col("c"))).collect()] == [2, 1]


def test_case_folding(spark):
    """Every letter gives the ASCII letters that Python's folding gives."""
    chars = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    got = {r.c: "".join(r.t) for r in df.select("c", text.tokens(F.col("c")).alias("t")).collect()}
    assert {c for c in chars if got[c] != "".join(x for x in c.casefold() if x.isascii() and x.isalnum())} == set()


def test_wide_wav():
    import io
    import wave

    x = np.array([-8388608, -1, 0, 1, 8388607])
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(3), w.setframerate(8000)
        w.writeframes(b"".join(int(v).to_bytes(3, "little", signed=True) for v in x))
    assert np.allclose(media.read_wav(out.getvalue())[0] * 8388608, x)


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(i, i * 10) for i in range(9)], "id bigint, code bigint")
    got = splits.hold_out(rows, "id").select("id", "code").collect()
    assert sorted(map(tuple, got)) == [(i, i * 10) for i in range(9)]


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert {r.method for r in __spark_entry__.entry(spark).collect()} == {"none", "token_rag", "rac", "rac_oracle"}


@pytest.mark.parametrize("skip_self", [False, True])
def test_inner_products_of_many_queries(spark, monkeypatch, skip_self):
    """Ties go by id, blocks come in any order, and no pair of blocks is shuffled."""
    monkeypatch.setattr(retrieval, "STRIP", 100)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[300:400], x[500:520] = x[7], 0
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in rng.permutation(len(x))], "query_id bigint, v array<float>")
    s = np.round(x.astype(float) @ x.astype(float).T, 5)
    if skip_self:
        np.fill_diagonal(s, -np.inf)
    best = np.lexsort((np.broadcast_to(np.arange(len(x)), s.shape), -s), axis=1)[:, :40]
    want = [(q, int(b), float(s[q, b]), i + 1) for q in range(len(x)) for i, b in enumerate(best[q])]
    base = df.withColumnRenamed("query_id", "base_id")
    for block in (256, 2048):
        got = retrieval.dense(base, df, 40, skip_self, block)
        assert "Join" not in got._jdf.queryExecution().toString()
        assert "Cartesian" not in got._jdf.queryExecution().toString()
        assert sorted(tuple(r) for r in got.select("query_id", "base_id", "score", "rank").collect()) == sorted(want)
    assert retrieval.dense(base, df.limit(0), 3).count() == 0


def test_fusion_shuffles_once(spark):
    r = spark.createDataFrame([(0, 1, 1)], "query_id bigint, base_id bigint, rank int")
    plan = retrieval.fuse([r, r], 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "SortAggregate" not in plan


def test_windows_tokenize_once(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "a b"), (1, None), (2, ""), (3, "c# x " * 70), (4, "é c++y")], "doc_id bigint, text string")
    cut = text.windows(docs.select("doc_id", text.tokens(F.col("text")).alias("t")), "t", 64, 16)
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = {(r.doc_id, r.chunk_idx, r.start, r.total_chunks): r.chunk for r in cut.collect()}
    long = ["c#", "x"] * 70
    assert got == {(0, 0, 0, 1): ["a", "b"], (1, 0, 0, 1): None, (2, 0, 0, 1): [], (3, 0, 0, 3): long[:64], (3, 1, 48, 3): long[48:112], (3, 2, 96, 3): long[96:], (4, 0, 0, 1): ["c++", "y"]}
    monkeypatch.setattr(text, "WINDOW_TOKENS", 3)
    rows = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([["x"], ["a"] * 5, None, [], ["b", "c", "d"], ["e"]])], ["id", "t"]).slice(1)
    out = pa.Table.from_batches(text._cut(4, 2, iter([rows]))).to_pylist()
    assert [(r["id"], r["start"], r["total_chunks"], r["chunk"]) for r in out] == [(1, 0, 3, ["a"] * 4), (1, 2, 3, ["a"] * 3), (1, 4, 3, ["a"]), (2, 0, 1, None), (3, 0, 1, []), (4, 0, 2, ["b", "c", "d"]), (4, 2, 2, ["d"]), (5, 0, 1, ["e"])]


def test_bm25_by_tasks(spark, monkeypatch):
    """Few terms are broadcast: nothing is joined, and the result is that of the joins, with ties, repeats and nulls."""
    docs = [(i, f"{'red ' * (i % 4)}fish {'blue' if i % 3 else 'c#'} w{i % 50}") for i in range(300)] + [(300, None), (301, ""), (302, "none of them")]
    base = spark.createDataFrame(docs, "base_id bigint, text string")
    asked = spark.createDataFrame([(7, "red fish"), (2, "C# red c# red w3"), (5, "nothing"), (6, None), (9, "FISH")], "query_id int, text string")
    got = retrieval.bm25(base, asked, 20)
    assert "Join" not in got._jdf.queryExecution().toString()
    rows = sorted(map(tuple, got.select("query_id", "rank", "base_id", "score").collect()))
    assert [r[:2] for r in rows] == [(q, i + 1) for q in (2, 7, 9) for i in range(20)]
    again = base.union(spark.createDataFrame([(7, "red blue w3")], "base_id bigint, text string"))
    repeated = sorted(map(tuple, retrieval.bm25(again, asked, 20).select("query_id", "rank", "base_id", "score").collect()))
    assert retrieval.bm25(base, asked.filter("query_id in (5, 6)"), 20).count() == 0
    monkeypatch.setattr(retrieval, "TERMS", 0)
    for b, want in ((base, rows), (again, repeated)):
        joined = retrieval.bm25(b, asked, 20)
        assert sorted(map(tuple, joined.select("query_id", "rank", "base_id", "score").collect())) == want


def test_scores_are_made_in_parts(monkeypatch):
    class Plan:
        value = (pa.array([4, 8]), np.array([0, 2, 3]), np.array([0, 1, 1]), np.array([1.0, 2.0, 0.5]), 1.5, 0.75, 2.0)

    rows = pa.table({"base_id": list(range(9)), "dl": [2] * 9, "term": pa.array([[0, 1], [1], [], *[[0]] * 6], pa.list_(pa.int32())), "tf": pa.array([[1, 2], [1], [], *[[3]] * 6], pa.list_(pa.int32()))})
    whole = pa.Table.from_batches(retrieval._scored(Plan, 3, iter(rows.to_batches()))).to_pylist()
    monkeypatch.setattr(retrieval, "SCORES", 3)
    assert pa.Table.from_batches(retrieval._scored(Plan, 3, iter(rows.to_batches(4)))).to_pylist() == whole
    assert [(r["query_id"], r["base_id"]) for r in whole] == [(4, 3), (4, 4), (4, 5), (8, 3), (8, 4), (8, 5)]


def test_hashed_vectors_stay_in_place(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, "---"), (3, None), (4, "b")], "id bigint, text string")
    got = retrieval.hashed_vectors(rows, "id")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    v = {r.id: r.v for r in got.collect()}
    assert set(v) == {1, 4}
    assert sorted(x for x in v[1] if x) == [np.float32(x / math.sqrt(5)) for x in (1, 2)]
    assert sum(v[4]) == 1


def test_byte_counts_in_pieces(spark, monkeypatch):
    """No piece but a single text is larger than PIECE; the totals of a task are at most 65,536 rows."""
    texts = ["abab", None, "", "é", "x" * 40, "ba"]
    monkeypatch.setattr(metrics, "PIECE", 8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["id", "text"])
    parts = list(metrics._bigrams(iter([batch])))
    assert len(parts) == 3
    got = sorted((r["id"], r["prev"], r["cur"], r["n"]) for p in parts for r in p.to_pylist())
    assert got == [(0, 0, 97, 1), (0, 97, 98, 2), (0, 98, 97, 1), (3, 0, 195, 1), (3, 195, 169, 1), (4, 0, 120, 1), (4, 120, 120, 39), (5, 0, 98, 1), (5, 98, 97, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    assert metrics.total_bigrams(docs).count() == 8
    one, other = (sorted(map(tuple, metrics.base_counts(x).collect())) for x in (metrics.total_bigrams(docs), metrics.byte_bigrams(docs)))
    assert one == other
