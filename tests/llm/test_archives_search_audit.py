"""Archives, ranked search and the filter audit against plain Python versions, and on odd inputs."""

import gzip
import io
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pinweave.llm import audit, search, warc

PAGES = "page_id long, url string, html string"
DOCS = "doc_id long, text string, source string"


def clash(df):
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in ("own", "first", "payload", "refers_to", "part", "fails", "n", "ids", "item", "rank", "archive", "_range", "good")])


# archives


def brute_pages(rows, least=0):
    groups = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= least:
            groups[html or ""] = min(page, groups.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = groups.get(html or "")
        again = first is not None and page != first and len(data) >= least
        out.append((page, len(data), warc.digest_of(data), "revisit" if again else "response", first if again else None))
    return Counter(out)


@pytest.mark.parametrize("least,archive_bytes", [(0, 1 << 28), (9, 2000)])
def test_pages_come_back_from_archives(spark, scratch, least, archive_bytes):
    rnd = random.Random(least)
    rows = [(i, f"http://x/{i} a\r\nb", "".join(rnd.choice("aé<\r\n小") for _ in range(rnd.choice([0, 3, 8, 9, 200])))) for i in range(150)]
    rows += [(1000 + i, None, rows[i % 7][2]) for i in range(60)] + [(2000 + i, "", "hot page") for i in range(200)]
    rows += [(None, "http://n", "hot page"), (None, None, "only nulls"), (None, "", "only nulls"), (5000, "u", None), (5001, "u", ""), (2000, "again", "hot page"), (6000, "u", "WARC/1.1\r\n\r\n" * 90_000)]
    rnd.shuffle(rows)
    pages = clash(spark.createDataFrame(rows, PAGES)).repartition(3)
    archives, folder = warc.archive_pages(pages, scratch, least, archive_bytes)
    archives = scratch.keep(archives)
    assert archives.agg(F.sum("records")).first()[0] == len(rows) and (archives.count() > 10 or least == 0)
    index = warc.read_index(archives, folder)
    got = warc.read_records(index, folder).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == brute_pages(rows, least)
    full = {(p, (h or "").encode()) for p, _, h in rows}
    assert all((r["page_id"], bytes(r["payload"])) in full for r in got if r["record_type"] == "response") and all(r["payload"] is None for r in got if r["record_type"] == "revisit")
    # every member stands alone at its place, and the members fill the file
    at, base = warc.store(folder)
    for r in archives.collect():
        lines = sorted((x["offset"], x["length"]) for x in index.where(F.col("archive") == r["archive"]).collect())
        with at.open_input_file(f"{base}/{r['archive']}") as f:
            assert f.size() == sum(n for _, n in lines) == r["packed"]
            assert [o for o, _ in lines] == [sum(n for _, n in lines[:i]) for i in range(len(lines))]
            assert all(gzip.decompress(f.read_at(n, o)).startswith(b"WARC/1.1\r\n") for o, n in lines[:20])


def test_no_pages(spark, scratch):
    assert warc.page_records(spark.createDataFrame([], PAGES), scratch).count() == 0


def test_normaliser_reads_any_members_and_refuses_cut_files():
    records = [warc.record(i, "http://x", bytes([65 + i]) * n, warc.digest_of(bytes([65 + i]) * n)) for i, n in enumerate((0, 5, 3_000_000, 17))]
    whole, split = gzip.compress(b"".join(records)), b"".join(gzip.compress(r) for r in records)
    mixed = gzip.compress(b"".join(records)[:700]) + gzip.compress(b"") + gzip.compress(b"".join(records)[700:])
    for source in (whole, split, mixed):
        out = io.BytesIO()
        places = [(o, n) for o, n, _ in warc.normalise_file(io.BytesIO(source), out)]
        data = out.getvalue()
        assert [gzip.decompress(data[o : o + n]) for o, n in places] == records and sum(n for _, n in places) == len(data)
        assert [warc.parse(data[o : o + n])["payload_bytes"] for o, n in places] == [0, 5, 3_000_000, 17]
    for cut in (whole[:-20], whole[: len(whole) // 2], gzip.compress(b"".join(records)[:-30])):
        with pytest.raises(EOFError):
            list(warc.normalise_file(io.BytesIO(cut), io.BytesIO()))
    with pytest.raises(ValueError):
        list(warc.normalise_file(io.BytesIO(gzip.compress(b"no record\r\n\r\n")), io.BytesIO()))
    with pytest.raises(ValueError):
        warc.parse(gzip.compress(records[1].replace(b"BBBBB", b"BBBBC")))
    assert list(warc.normalise_file(io.BytesIO(b""), io.BytesIO())) == []


# search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_rank(docs, items, k=10):
    lower = {i: i + 32 for i in range(65, 91)}
    bags = [(d, Counter(TERM.findall((t or "").translate(lower)))) for d, t, *_ in docs]
    bags = [(d, c) for d, c in bags if c]
    n, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in items:
        q = Counter(TERM.findall((text or "").translate(lower)))
        scores = []
        for d, c in bags:
            m = 25 + (75 * sum(c.values()) * n) // total
            s = sum(a * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, a in q.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d if d is not None else 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def ranked(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shard,beam,seed_part,item_bytes", [(1 << 20, 16, 16, 1 << 24), (40, 1, 2, 1 << 24), (300, 3, 1, 200)])
def test_ranking_equals_brute_force(spark, scratch, monkeypatch, shard, beam, seed_part, item_bytes):
    for name, value in (("SHARD_POSTINGS", shard), ("BEAM", beam), ("SEED_PART", seed_part), ("ITEM_BYTES", item_bytes)):
        monkeypatch.setattr(search, name, value)
    rnd = random.Random(shard)
    vocab = [f"{w}{i}" for i in range(30) for w in ("ab", "ü", "Q")]
    skew = [vocab[min(len(vocab) - 1, int(rnd.expovariate(0.08)))] for _ in range(4000)]
    docs = [(i, " ".join(rnd.choice(skew) for _ in range(rnd.choice([1, 4, 30, 120]))) + "!") for i in range(250)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(60)] + [(7, docs[9][1])] * 3 + [(None, docs[5][1]), (3000, None), (3001, ""), (3002, " .,; "), (3003, "ab1 " * 20_000)]
    items = [(i, " ".join(rnd.choice(skew) for _ in range(rnd.choice([1, 3, 12, 40])))) for i in range(25)] + [(90, None), (91, ""), (92, "nowhere"), (93, "AB1 ab1, ü2"), (93, "ab1"), (None, "ab2")]
    got = search.rank(clash(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3), clash(spark.createDataFrame(items, "item_id long, text string")), scratch)
    assert ranked(got) == brute_rank(docs, items)


def test_search_of_nothing(spark, scratch):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.rank(docs.where("false"), items, scratch).count() == 0
    assert search.rank(docs.where("text IS NULL"), items, scratch).count() == 0
    assert search.rank(docs, items.where("false"), scratch).count() == 0
    assert search.rank(docs, items, scratch).count() == 1


def test_intervals_follow_documents_and_keep_their_order():
    rng = np.random.default_rng(3)
    term, place = np.divmod(rng.choice(40 * 77, 900, replace=False), 77)
    impact = rng.integers(0, 5000, 900)
    shard = search.Shard(term, place, impact, 77)
    for t in range(40):
        (s,), (e,), _ = shard.roots([(t, 1)])
        nodes = [(0, 0, np.array([s]), np.array([e]))]
        while nodes:
            level, low, s, e = nodes.pop()
            high = low + (1 << (shard.levels - level))
            own = np.sort(impact[(term == t) & (place >= low) & (place < high)])[::-1]
            assert shard.impact[level, s[0] : e[0]].tolist() == own.tolist()
            if level < shard.levels and e[0] > s[0]:
                a, b = shard.children(np.array([level]), s, e)
                nodes += [(level + 1, low, *a), (level + 1, (low + high) // 2, *b)]


def test_lengths_beyond_64_bits():
    n = np.array([10**12, 5])
    assert search.lengths_norm(n, 10**9, 10**13).tolist() == [25 + 75 * 10**21 // 10**13, 25 + 75 * 5 * 10**9 // 10**13]


# audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_figures(text):
    words = WORD.findall(text or "")
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text or "")), len(re.findall(r"[#$%&*|]", text or "")), len(text or "")]


def odd_texts(seed, n=300):
    rnd = random.Random(seed)
    parts = ["a", "b", "Ab", "é", "小明", "#", "|x", " ", "  ", "\t", "\n", "\x0b", "\x85", " ", "　", "Z" * 9, "word", "word2"]
    return [None, "", " ", "x", " x", "x "] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("piece", [1 << 20, 64, 7])
def test_figures_equal_brute_force(monkeypatch, piece):
    monkeypatch.setattr(audit, "PIECE", piece)
    texts = odd_texts(piece)
    want = np.array([brute_figures(t) for t in texts]).T
    for kind in (pa.string(), pa.large_string()):
        col = pa.array(texts, kind)
        assert (audit.figures(col) == want).all()
        assert (audit.figures(col.slice(5, 77)) == want[:, 5:82]).all()
    assert audit.figures(pa.array([], pa.string())).shape == (5, 0) and (audit.figures(pa.array([None, None], pa.string())) == 0).all()


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_words_of_one_hash_are_told_apart(monkeypatch, piece):
    monkeypatch.setattr(audit, "PIECE", piece)
    monkeypatch.setattr(audit, "_NOISE", np.ones(256, dtype=np.uint64))  # words of one length have one hash
    texts = odd_texts(1, 100)
    assert (audit.figures(pa.array(texts, pa.string())) == np.array([brute_figures(t) for t in texts]).T).all()


def test_very_long_texts():
    rnd = random.Random(4)
    long = " ".join(f"w{rnd.randint(0, 90_000)}é" for _ in range(400_000)) + " " + "q" * 3_000_000 + " A#"
    texts = ["a b a", long, None, "Z"]
    assert (audit.figures(pa.array(texts, pa.string())) == np.array([brute_figures(t) for t in texts]).T).all()


def brute_audit(docs, labels):
    first, good, toxic = {}, {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    fails = []
    for d, t, s in docs:
        w, u, c, y, p = brute_figures(t)
        kinds = {f for f, x in zip("ABCDE", (w < 200, 100 * u < 50 * w, 100 * c > 2 * p, y > 0, d is not None and d > first.get(t or "", d)), strict=True) if x}
        fails.append((d, s or "", kinds))
    rows = {}
    for part in {s for _, s, _ in fails}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                own = [(d, x) for d, s, x in fails if s == part]
                here = [d for d, x in own if f in x and not x & set(order[:step])]
                shapley[f] += len(here)
                rows[part, "".join(order), step + 1] = [sum(not x & set(order[: step + 1]) for _, x in own), len(here), sum(f in x for _, x in own) - len(here), sum(x == {f} for _, x in own), sum(d in good for d in here), sum(d in toxic for d in here), f]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                rows[part, "".join(order), step + 1][6] = shapley[f]
    return rows


def test_audit_equals_brute_force(spark, scratch):
    rnd = random.Random(8)
    base = [" ".join(rnd.choice(["lorem", "Ipsum", "dolor", f"w{rnd.randint(0, 500)}"]) for _ in range(rnd.choice([5, 150, 230, 320]))) + rnd.choice(["", "#", " A B C"]) for _ in range(60)]
    docs = [(i, rnd.choice(base), rnd.choice(["a", "b", "", None])) for i in range(300)] + [(400 + i, "hot copy", "hot") for i in range(150)]
    docs += [(None, base[0], "a"), (None, "hot copy", "hot"), (7, base[1], "b"), (7, base[1], "b"), (900, None, "b"), (901, "", "c")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 500, 3)] + [(3, 1, 1), (None, 1, 1)]
    got = audit.audit(clash(spark.createDataFrame(docs, DOCS)).drop("good").withColumn("good", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), scratch).collect()
    cols = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert len(got) == 5 * 600 and {(r["part"], r["filter_order"], r["step"]): [r[c] for c in cols] for r in got} == brute_audit(docs, labels)
    assert audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), scratch).count() == 0


def test_hashes_of_words_do_not_depend_on_their_place():
    data = np.frombuffer(b" ".join([b"aa", b"b", b"word"] * 5000), dtype=np.uint8)
    _, _, h = audit._words(data, np.array([0, len(data)]))
    assert len(np.unique(h)) == 3 and (h[::3] == h[0]).all()
