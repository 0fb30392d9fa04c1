"""The pipeline against plain Python on the smallest documents."""

import base64
import re

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from pinweave.llm import queries

DIR = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, scratch):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    steps, cur = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        cur = scratch.keep(stage(spark, cur, DIR), name)
        steps[name] = cur
    assert all(steps[n].columns == docs.columns for n, _ in corpus_pipeline.STAGES[:-1])

    first = {r["doc_id"]: r for r in docs.collect()}
    kept = [r for r in first.values() if re.search(r"[^\W\d_]", r["text"] or "")]
    got = {r["doc_id"]: r for r in steps["language_id"].collect()}
    assert set(got) == {r["doc_id"] for r in kept} and all(r["text"] == first[i]["text"] for i, r in got.items())

    sets = {}
    for i, r in got.items():
        w = r["text"].lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    ids, up = sorted(sets), {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in steps["near_duplicates"].collect()} == {i for i in ids if find(i) == i}

    clean = steps["secrets"].collect()
    assert len(clean) == steps["near_duplicates"].count() and not any(re.search(r"token = \"[0-9a-f]{40}", r["text"]) for r in clean)
    assert {r["doc_id"] for r in steps["mixing"].collect()} <= {r["doc_id"] for r in clean}

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in clean}
    final = steps["tokenization"].collect()
    assert len(final) == steps["mixing"].count() and all(r["ids"] == enc.encode_ordinary(texts[r["doc_id"]]) for r in final)
    again = corpus_pipeline.run(spark, DIR)
    assert again.select(F.sum(F.xxhash64("doc_id", "ids_sha256").cast("decimal(38,0)"))).first() == steps["tokenization"].select(F.sum(F.xxhash64("doc_id", "ids_sha256").cast("decimal(38,0)"))).first()


def test_every_operator_has_a_query():
    assert sorted(int(m[1]) for q in queries.QUERIES if (m := re.match(r"op(\d+)_", q))) == list(range(1, 11))


def test_stages_on_an_empty_table_and_on_nulls(spark, scratch, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).columns == docs.columns and stage(spark, docs, DIR).count() == 0, name
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, None), (3, "a b c d e f", "en", "a", 11), (3, "a b c d e f", "en", "a", 11)], schema)
    for _, stage in corpus_pipeline.STAGES[1:-1]:  # language ID goes first and leaves no null texts
        assert stage(spark, odd, DIR).columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.drop_near_duplicates(spark, odd, DIR).collect()) == [0, 1, 2, 3]
    assert corpus_pipeline.tokenize(spark, odd, DIR).count() == 5


def test_planted_vectors_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    got = queries.vector_dedup_planted(spark, DIR).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(queries.ORACLE_SQL["vector_dedup_planted"]).fetchall())
    assert sum(r["n_links"] > 0 for r in got) > 100
