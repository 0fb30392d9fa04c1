"""Masked pseudo-likelihood: a bidirectional window network in numpy scores every word from both sides."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.llm.langid import Trees, windows
from pinweave.llm.rows import map_texts, release
from pinweave.runtime import Scratch

CLASSES = 48
MEMBERS = 64
RARE = CLASSES * MEMBERS - 1  # the id that is predicted for all words but the RARE most frequent ones
HASHED = 1024  # ids of other words where they are context
CONTEXTS = RARE + HASHED
PAD = CONTEXTS  # beyond either end of a text
REACH = 2  # words on either side
DIM = 32
ROUNDS = 3
BATCH = 8192
RATE = 0.15
CHUNK = 1 << 14
HELD = 1 << 17  # training words that are shuffled together
GROUP_WORDS = 1 << 21  # words from which one copy of the weights learns in a round, about
MERGE = 64
REMEMBER = 300_000
SPELL = 2  # bytes of context in the spelling of words
SEED = 77
LOGIT = 60.0
OFFSETS = [o for o in range(-REACH, REACH + 1) if o]


def initial() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    normal = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    emb = normal(CONTEXTS + 1, DIM)
    emb[PAD] = 0
    zeros = lambda *shape: np.zeros(shape, dtype=np.float32)
    return {"emb": emb, "mix": normal(len(OFFSETS), DIM, DIM), "bias": zeros(DIM), "cls": normal(DIM, CLASSES), "cls_bias": zeros(CLASSES), "mem": normal(CLASSES, DIM, MEMBERS), "mem_bias": zeros(CLASSES, MEMBERS)}


def flatten(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unflatten(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at, shapes = {}, 0, initial()
    for k in sorted(shapes):
        n = shapes[k].size
        out[k] = flat[at : at + n].reshape(shapes[k].shape).astype(np.float32)
        at += n
    return out


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class _Places(dict):
    """Positions of words; one that is asked for first takes the next."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Coder:
    """Words to context ids and, with a spelling, to the log-probability of being that word among the rare ones; remembers a bounded number."""

    def __init__(self, frequent: list[bytes], spelling: Trees | None = None):
        self.frequent, self.spelling = frequent, spelling
        self._clear()

    def _clear(self) -> None:
        self.at = _Places((w, i) for i, w in enumerate(self.frequent))
        self.ids = np.arange(len(self.frequent), dtype=np.int32)
        self.own = np.zeros(len(self.frequent))

    def _learn(self, new: list[bytes]) -> None:
        used, need = len(self.at) - len(new), len(self.at)
        if need > len(self.ids):
            grow = lambda x: np.concatenate([x[:used], np.empty(need + REMEMBER - used, dtype=x.dtype)])
            self.ids, self.own = grow(self.ids), grow(self.own)
        self.ids[used:need] = [RARE + zlib.crc32(w) % HASHED for w in new]
        self.own[used:need] = spelt(self.spelling, new) if self.spelling is not None else 0.0

    def __call__(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """For each text the positions of its words in ``ids`` and ``own``, which hold until the next call."""
        if len(self.at) > REMEMBER + len(self.frequent):
            self._clear()
        used, at = len(self.at), self.at
        found = [np.fromiter(map(at.__getitem__, words), dtype=np.int64, count=len(words)) for words in texts]
        if len(at) > used:
            self._learn(list(islice(at, used, None)))
        return found


def spelt(spelling: Trees, words: list[bytes]) -> np.ndarray:
    """Natural log-probability of each word's bytes and its end, whatever words came before."""
    if not words:
        return np.empty(0)
    pad = b" " * SPELL
    bits = spelling.code_lengths(windows(pad + (b" " + pad).join(words) + b" ", SPELL))[:, 0]
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    start = np.cumsum(size + SPELL) - size - SPELL
    sums = np.concatenate([[0.0], np.cumsum(bits, dtype=np.float64)])
    return -np.log(2) * (sums[start + size] - sums[start])


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(cls.astype(np.uint8), kind="stable")  # bytes are sorted by radix
    return order, np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES))])


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials in place, of logits held within what single precision can add up, and their sums by row."""
    np.clip(z, -LOGIT, LOGIT, out=z)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], dtype=z.dtype)


def _soft(z: np.ndarray, n: int) -> np.ndarray:
    """Softmax of each row over n, in place."""
    z, sums = _exp(z)
    z *= (1 / (sums * n))[:, None]
    return z


def _log_prob_of(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log-softmax of each row at y; z is overwritten."""
    at = np.clip(z[np.arange(len(y)), y], -LOGIT, LOGIT)
    return at - np.log(_exp(z)[1])


class Network:
    """Class-factored softmax over the frequent words and RARE from the words around a masked one."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.sq = {k: np.full_like(v, 1e-6) for k, v in weights.items()}

    def log_probs(self, ids: np.ndarray) -> np.ndarray:
        """Log-probability of every word's target; ids holds REACH pads on both sides."""
        w, n = self.w, len(ids) - 2 * REACH
        tables = [w["emb"] @ m for m in w["mix"]]
        out = np.empty(n, dtype=np.float64)
        for at in range(0, n, CHUNK):
            m = min(CHUNK, n - at)
            h = np.repeat(w["bias"][None, :], m, axis=0)
            for t, o in zip(tables, OFFSETS, strict=True):
                h += t.take(ids[at + REACH + o : at + REACH + o + m], axis=0)
            np.tanh(h, out=h)
            y = ids[at + REACH : at + REACH + m]
            real = y != PAD
            y = np.minimum(y, RARE)
            cls, mem = y // MEMBERS, y % MEMBERS
            z = h @ w["cls"]
            z += w["cls_bias"]
            lp = _log_prob_of(z, cls).astype(np.float64)
            order, edge = _by_class(cls)
            h, inner, within = h.take(order, axis=0), mem[order], np.empty(m)
            for c in range(CLASSES):
                s, e = edge[c], edge[c + 1]
                if s < e:
                    z = h[s:e] @ w["mem"][c]
                    z += w["mem_bias"][c]
                    within[s:e] = _log_prob_of(z, inner[s:e])
            lp[order] += within
            out[at : at + m] = np.where(real, lp, 0.0)
        return out

    def gradients(self, context: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradients of the mean negative log-probability of targets y; those of ``emb`` for the context ids that occur, which come first.

        Context vectors are mixed once for each distinct id, and gradients are summed
        by id before they are multiplied out.
        """
        w, n = self.w, len(y)
        here = np.zeros(len(w["emb"]), dtype=bool)
        here[context] = True
        seen = np.flatnonzero(here)
        place = np.cumsum(here) - 1
        cls, mem = y // MEMBERS, y % MEMBERS
        order, edge = _by_class(cls)
        cls, mem, at = cls[order], mem[order], [place.take(c.take(order)) for c in context.T]
        emb, mix = w["emb"].take(seen, axis=0), np.concatenate(list(w["mix"]), axis=1)
        h = np.repeat(w["bias"][None, :], n, axis=0)
        for ids, m in zip(at, w["mix"], strict=True):
            h += (emb @ m).take(ids, axis=0)
        np.tanh(h, out=h)
        rows = np.arange(n)
        dz = h @ w["cls"]
        dz += w["cls_bias"]
        _soft(dz, n)
        dz[rows, cls] -= 1 / n
        dh = dz @ w["cls"].T
        g = {"cls": h.T @ dz, "cls_bias": dz.sum(axis=0), "mem": np.zeros_like(w["mem"]), "mem_bias": np.zeros_like(w["mem_bias"])}
        for c in range(CLASSES):
            s, e = edge[c], edge[c + 1]
            if s < e:
                dm = h[s:e] @ w["mem"][c]
                dm += w["mem_bias"][c]
                _soft(dm, n)
                dm[rows[: e - s], mem[s:e]] -= 1 / n
                dh[s:e] += dm @ w["mem"][c].T
                g["mem"][c], g["mem_bias"][c] = h[s:e].T @ dm, dm.sum(axis=0)
        dh *= 1 - h * h
        g["bias"] = dh.sum(axis=0)
        columns = np.ascontiguousarray(dh.T, dtype=np.float64)  # each column in one piece, as it is read once an offset
        sums = np.empty((len(OFFSETS) * DIM, len(seen)), dtype=emb.dtype)
        for k, ids in enumerate(at):
            for d, c in enumerate(columns):
                sums[k * DIM + d] = np.bincount(ids, weights=c, minlength=len(seen))
        g["mix"] = (sums @ emb).reshape(len(OFFSETS), DIM, DIM).transpose(0, 2, 1)
        g["emb"] = np.ascontiguousarray((mix @ sums).T)
        g["emb"][seen == PAD] = 0
        return seen, g

    def train(self, context: np.ndarray, y: np.ndarray) -> None:
        """One Adagrad step."""
        seen, g = self.gradients(context, y)
        for key, grad in g.items():
            at = seen if key == "emb" else ...
            self.sq[key][at] += grad * grad
            self.w[key][at] -= RATE * grad / np.sqrt(self.sq[key][at])


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of all documents, words as bytes; each batch adds its words up before they are shuffled."""

    def count(batches):
        for batch in batches:
            n: Counter = Counter()
            for text in batch.column("text").to_pylist():
                n.update(words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), type=pa.binary()), pa.array(list(n.values()), type=pa.int64())], names=["word", "n"])
        release()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spelling_counts(words: DataFrame) -> DataFrame:
    """``(code, n)``: occurrences of each byte after SPELL bytes in all occurrences of the words; at most 2 ** 24 rows."""
    pad = b" " * SPELL

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                size = pdf["word"].map(len).to_numpy() + 1
                code = windows(pad + (b" " + pad).join(pdf["word"]) + b" ", SPELL)
                first = np.repeat(np.cumsum(size + SPELL) - size - SPELL, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                code, at = np.unique(code[first], return_inverse=True)
                yield pd.DataFrame({"code": code.astype(np.int64), "n": np.bincount(at, weights=np.repeat(pdf["n"].to_numpy(), size)).astype(np.int64)})

    return words.mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def train_group(net: Network, texts: Iterator[np.ndarray]) -> int:
    """Learn from every word of each text of context ids, masked in turn, in the order given; the number of words."""
    held, waiting, total = [], 0, 0
    rng, pad = np.random.default_rng(SEED), np.full(REACH, PAD, dtype=np.int32)

    def step(least):
        nonlocal held, waiting
        rows = np.concatenate(held) if held else np.empty((0, 2 * REACH + 1), dtype=np.int32)
        rows, at = rows[rng.permutation(len(rows))], 0  # neighbouring words are alike
        while len(rows) - at >= least:
            part = rows[at : at + BATCH]
            net.train(part[:, 1:], np.minimum(part[:, 0], RARE))
            at += len(part)
        held, waiting = [rows[at:]] if at < len(rows) else [], len(rows) - at

    for ids in texts:
        padded = np.concatenate([pad, ids, pad])
        for at in range(0, len(ids), HELD):
            m = min(HELD, len(ids) - at)
            held.append(np.column_stack([ids[at : at + m], *[padded[at + REACH + o : at + REACH + o + m] for o in OFFSETS]]))
            total, waiting = total + m, waiting + m
            if waiting >= HELD:
                step(BATCH)
    step(1)
    return total


def _unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, dtype=np.uint16).astype(np.int32)


def _train_round(coded: DataFrame, groups: int, shared) -> DataFrame:
    """Each group of texts, dealt by hash and in the order of hash and words, trains its own copy of the weights: part, n, weights."""

    def run(batches):
        from pyspark import TaskContext

        net = Network(unflatten(shared.value))
        total = train_group(net, (_unpacked(x) for batch in batches for x in batch.column("ids").to_pylist()))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total], pa.int64()), pa.array([flatten(net.w).tobytes()], pa.binary())], names=["part", "n", "weights"])
        del net
        release()

    return coded.repartition(groups, "h").sortWithinPartitions("h", "ids").select("ids").mapInArrow(run, "part long, n long, weights binary")


def merged_mean(pdf: pd.DataFrame) -> np.ndarray:
    """Mean of the weights by numbers of words, added up in the order of parts."""
    pdf = pdf.sort_values("part")
    total = pdf["n"].sum()
    return sum(np.frombuffer(b, dtype=np.float32) * np.float64(n / total) for b, n in zip(pdf["weights"], pdf["n"], strict=True)).astype(np.float32)


def _merge(trained: DataFrame, scratch: Scratch) -> np.ndarray | None:
    """Mean of all groups' weights, by a tree of fan-in MERGE."""

    def add(pdf):
        return pd.DataFrame({"part": [pdf["g"].iloc[0]], "n": [pdf["n"].sum()], "weights": [merged_mean(pdf).tobytes()]})

    cur = scratch.keep(trained, "trained")
    while True:
        merged = scratch.keep(cur.withColumn("g", F.floor(F.col("part") / MERGE).cast("long")).groupBy("g").applyInPandas(add, "part long, n long, weights binary"), "merged")
        scratch.drop(cur)
        rows = merged.limit(2).collect()
        if len(rows) < 2:
            return np.frombuffer(rows[0]["weights"], dtype=np.float32) if rows else None
        cur = merged


def score(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Pseudo-log-likelihood of every whole text.

    All words of all documents are counted. A network sees REACH words on either side
    of a masked word and predicts it, one of the most frequent words or RARE, through a
    two-level softmax; it trains on every word of every document, each masked in turn,
    in ROUNDS rounds of a third of the documents. In a round texts are dealt by hash to
    groups of about GROUP_WORDS words, each of which trains its own copy in the order
    of its texts' hashes, and the copies' weights are averaged by words seen, so that
    scores do not depend on the layout of the input. Which of the rare words a word is
    comes from a byte context tree of the spellings of all their occurrences. The
    frozen model then predicts every word of every text from both sides.

    Returns doc_id, n_tokens, log_prob (natural, summed) and mean_log_prob. Null or
    blank texts have no tokens, log_prob 0 and a null mean; null doc_ids and repeated
    rows are scored alike; an empty table gives no rows. The driver holds the frequent
    words, the spelling counts and one set of weights, all of bounded size.
    """
    spark = docs.sparkSession
    counts = scratch.keep(word_counts(docs), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "word").limit(RARE)
    frequent = [bytes(r["word"]) for r in top.collect()]
    rare = counts.join(F.broadcast(spark.createDataFrame([(bytearray(w),) for w in frequent], "word binary")), "word", "left_anti")
    spell = spelling_counts(rare).toPandas()
    spelling = Trees([(spell["code"].to_numpy(), spell["n"].to_numpy())], SPELL)
    scratch.drop(counts)

    shared_words = spark.sparkContext.broadcast((frequent, spelling))

    def code():
        coder = Coder(*shared_words.value)

        def work(texts):
            found = coder([words_of(t) for t in texts])
            return [[len(x) for x in found], [float(coder.own[x].sum()) for x in found], [coder.ids[x].astype(np.uint16).tobytes() for x in found]]

        return work

    fields = [("n_tokens", pa.int64(), "long"), ("own", pa.float64(), "double"), ("ids", pa.binary(), "binary")]
    coded = scratch.keep(map_texts(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), code, fields), "coded")
    groups, flat = max(1, round(total / ROUNDS / GROUP_WORDS)), flatten(initial())
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast(flat)
        mean = _merge(_train_round(coded.where((F.pmod(F.xxhash64("h"), F.lit(ROUNDS)) == r) & (F.col("n_tokens") > 0)).select("h", "ids"), groups, shared), scratch)
        flat = flat if mean is None else mean
    shared = spark.sparkContext.broadcast(flat)

    def make():
        net, pad = Network(unflatten(shared.value)), np.full(REACH, PAD, dtype=np.int32)

        def work(texts):
            ids = [_unpacked(x) for x in texts]
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            sums = np.concatenate([[0.0], np.cumsum(net.log_probs(np.concatenate([pad, *[p for x in ids for p in (x, pad)]])))])
            start = np.cumsum(np.concatenate([[0], sizes[:-1] + REACH])) if len(ids) else np.empty(0, dtype=np.int64)
            total = sums[np.minimum(start + sizes, len(sums) - 1)] - sums[start]
            total[sizes == 0] = 0.0
            return [total]

        return work

    out = map_texts(coded.select("doc_id", "n_tokens", "own", "ids"), make, [("net", pa.float64(), "double")], column="ids")
    log_prob = F.col("own") + F.col("net")
    return out.select("doc_id", "n_tokens", log_prob.alias("log_prob"), F.when(F.col("n_tokens") > 0, log_prob / F.col("n_tokens")).alias("mean_log_prob"))
