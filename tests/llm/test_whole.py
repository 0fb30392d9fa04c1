"""The whole job on inputs where a shorter way gave less."""

import random

from pinweave.llm import jaccard, lm, secrets, vectors


def test_repeated_rows_do_not_hide_tiles(spark, scratch):
    rnd = random.Random(7)
    texts = []
    for g in range(16):  # six texts of least doc_ids lie in all tiles of the last two, which link with each other alone
        base = [f"w{rnd.randrange(400)}" for _ in range(120)]
        for i in range(8):
            copy = list(base)
            for k in range(2 if i < 6 else 1):
                copy[14 * i + 7 * k + 3] = f"new{g}-{i}-{k}"
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [set(jaccard.shingles(t, 3).tolist()) for _, t in rows]
    links = [(j, i) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    assert links == [(8 * g + 6, 8 * g + 7) for g in range(16)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string")
    got = jaccard.join_components(docs, scratch).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, i - (i % 8 == 7)) for i, _ in rows * 2)


def test_whole_private_keys_are_redacted(spark):
    line, last = "MIIEpAIBAAKCAQEAx7" + "Qz9+/aB" * 6 + "abcd", "q3Zk9w=="
    body = "\n".join([line] * 3 + [last])
    keys = [
        f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{body}\n-----END RSA PRIVATE KEY-----",
        f"-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: 2\n\n{body}\n=abcd\n-----END PGP PRIVATE KEY BLOCK-----",
        f"-----BEGIN PRIVATE KEY-----\\n{line}\\n{line}\\n-----END PRIVATE KEY-----",
        f"-----BEGIN EC PRIVATE KEY-----\n{body}",
    ]
    rows = [(i, f"é before {k}\nafter all") for i, k in enumerate(keys)] + [(9, "-----BEGIN PRIVATE KEY----- is a first line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert got == {i: "é before [secret]\nafter all" for i in range(4)} | {9: "[secret] is a first line"}
    kinds = {r["doc_id"]: [x for x in r["spans"].split(",") if x.startswith("pem")] for r in secrets.scan(docs).collect()}
    assert all(kinds[i] == [f"pem:9:{9 + len(k)}"] for i, k in enumerate(keys))


def test_model_trains_on_every_word(spark, scratch, monkeypatch):
    texts = ["one", "two words", None, "", " ".join(f"w{i}" for i in range(500))] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, merge = [], lm._merge

    def count(trained, scratch):
        seen.append(sum(r["n"] for r in trained.select("n").collect()))
        return merge(trained, scratch)

    monkeypatch.setattr(lm, "_merge", count)
    got = lm.score(docs, scratch).collect()
    assert sum(seen) == sum(r["n_tokens"] for r in got) == 3 * 503


def test_sets_of_one_short_name_are_not_lost(spark, scratch, monkeypatch):
    monkeypatch.setattr(jaccard, "NAME", 63)  # all names of sets and parts meet others by chance
    rnd = random.Random(11)
    rows = []
    for i in range(60):
        base = [f"w{rnd.randrange(5000)}" for _ in range(60)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base, "more"]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_vectors_at_the_ends_of_the_range_and_repeated_ids(spark, scratch):
    rows = [(1, [1e200, 1.0], 0), (2, [1e200, 1.0], 0), (3, [1e-200, 0.0], 1), (4, [1e-200, 0.0], 1), (5, [5e-324, 0.0], 1), (6, [1e308, 1e308], 2), (7, [1e307, 1.1e307], 2), (8, [0.0, 0.0], 2)]
    rows += [(11, [1.0, 0.2], 3), (11, [1.0, 0.2], 3), (12, [1.0, 0.2], 3), (13, [1.0, 0.3], 3), (14, [float("inf"), 1.0], 0)]
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), scratch).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (3, 2, 3), (4, 2, 3), (5, 2, 3), (6, 1, 6), (7, 1, 6), (8, 0, 8), (11, 2, 11), (12, 2, 11), (13, 2, 11), (14, 0, 14)}
