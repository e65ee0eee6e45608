"""Every registered query runs, keeps its contract and agrees with its DuckDB text; the pipeline meets hard rows."""

import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import common, jaccard_join, line_dedup, mixing, packing, quality_gam, queries, simhash

from .test_llm import empty, hard_rows, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_duckdb(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    names = sorted(found.columns)
    mine = sorted(str([plain(r[n]) for n in names]) for r in found.collect())
    other = duck.sql(queries.ORACLES[name])
    assert sorted(other.columns) == names
    at = [other.columns.index(n) for n in names]
    assert mine == sorted(str([plain(r[k]) for k in at]) for r in other.fetchall())


@pytest.mark.parametrize(("name", "folds", "held", "threshold"), [("op1_toxicity", 5, 0, 0.5), ("op5_quality_gam", 4, 2, 0.7)])
def test_classifier_contract(spark, texts, name, folds, held, threshold):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)


def test_audio_contract(spark, texts):
    rows = queries.QUERIES["op2_mpeg_audio"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(r.seek_offsets) == r.n_frames and r.crc_bad == 0 and r.skipped == 0


def test_simhash_contract(spark, texts):
    rows = {r.doc_id: r for r in queries.QUERIES["op3_simhash"](spark, SF).collect()}
    assert sorted(rows) == sorted(texts)
    order = sorted(texts, reverse=True)
    for i, doc in enumerate(order):
        own, following = texts[doc], texts[order[(i + 1) % len(order)]]
        third = len(own) // 3
        changed = own[: len(own) - third] + following[:third]
        r = rows[doc]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(changed.encode()).hexdigest())
    # neighbours of every twentieth document, against all
    bits = {d: int(r.fingerprint, 16) for d, r in rows.items()}
    for doc in (d for d in order if d % 20 == 0):
        assert rows[doc].n_within == sum((bits[doc] ^ b).bit_count() <= simhash.RADIUS for d, b in bits.items() if d != doc)


def test_fingerprints_against_brute_force():
    import xxhash

    for _, text in hard_rows():
        count = {}
        for w in (text or "").encode().split():
            w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
            count[w] = count.get(w, 0) + 1
        votes, total = [0.0] * simhash.BITS, 0.0
        for w, n in count.items():
            h = xxhash.xxh3_64_intdigest(w)
            raw = b"".join(int(common.mix(np.array([x], np.uint64))[0]).to_bytes(8, "little") for x in (h, h ^ common.BASE))
            weight = (1 + math.log(n)) * min(len(w), simhash.LONGEST)
            total += weight
            for k in range(simhash.BITS):
                votes[k] += weight if raw[k // 8] >> (7 - k % 8) & 1 else 0
        got = simhash.fingerprints(pa.array([text], pa.string()))[0]
        for k in range(simhash.BITS):  # a vote at the edge may go either way in single precision
            if abs(votes[k] * 2 - total) > 1e-3 * max(total, 1):
                assert (got[k // 8] >> (7 - k % 8) & 1) == (votes[k] * 2 > total)


def test_mixing_contract(spark, texts):
    rows = queries.QUERIES["op9_mixing"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.rate >= 0 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in rows)


def test_packing_contract(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.QUERIES["op10_packing"](spark, SF).collect()
    ids = {d: np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    met, seats = {d: 0 for d in ids}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == met[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        met[r.doc_id] += r.length
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(met[d] == len(x) for d, x in ids.items())
    for s in seats.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048


def slow_tree(gain, weight, leaves):
    """Best cuts one after the other, every place tried."""
    cuts = [0, len(gain)]
    part = lambda a, b: sum(gain[a:b]) ** 2 / (sum(weight[a:b]) + 1)
    for _ in range(leaves - 1):
        options = [(part(a, m) + part(m, b) - part(a, b), m) for a, b in zip(cuts, cuts[1:], strict=False) for m in range(a + 1, b)]
        if not options or max(o[0] for o in options) <= 1e-9:
            break
        cuts = sorted([*cuts, max(options, key=lambda o: (o[0], -o[1]))[1]])
    return [sum(gain[a:b]) / (sum(weight[a:b]) + 1) for a, b in zip(cuts, cuts[1:], strict=False) for _ in range(a, b)]


def test_tree_steps_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 12))
        gain, weight = rng.normal(size=n), rng.random(n) * 5
        assert np.allclose(quality_gam.tree_step(gain, weight, 4), slow_tree(gain.tolist(), weight.tolist(), 4))


def slow_features(text):
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(quality_gam.FEATURES)
    chars = list(raw)
    among = lambda s: sum(c in s.encode() for c in chars)
    upper, lower = sum(65 <= c <= 90 for c in chars), sum(97 <= c <= 122 for c in chars)
    lines = raw.split(b"\n")
    n = len(words)
    return [
        math.log1p(n), sum(len(w) for w in words) / n, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, among("#$%&*+/<=>@[\\]^_`{|}~") / len(raw), upper / max(1, upper + lower),
        sum(48 <= c <= 57 for c in chars) / len(raw), among(".,;:?") / n, 1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), sum(c >= 128 for c in chars) / len(raw), raw.count(b"|") / n, raw.count(b"!") / n,
        max(words.count(w) for w in set(words)) / n, math.log1p(len(lines)), sum(len(w) < 4 for w in words) / n,
    ]


def test_quality_scores_against_brute_force(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = quality_gam.fit_quality(docs, labels, F.lit(True))
    rows = [(i, t) for i, t in hard_rows() if t is None or len(t) < 3000]
    got = quality_gam.score_quality(table(spark, rows), model).collect()
    slow = []
    for i, text in rows:
        x = slow_features(text)
        total = model.base + sum(float(t[sum(e <= v for e in edges)]) for v, edges, t in zip(x, model.edges, model.tables, strict=True))
        total += sum(float(t[sum(e <= x[a] for e in model.pair_edges[a])][sum(e <= x[b] for e in model.pair_edges[b])]) for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
        slow.append((-1 if i is None else i, round(1 / (1 + math.exp(-total)), 9)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 9)) for r in got) == sorted(slow)


def test_rates_against_brute_force(spark):
    """The distributed steps are projected-gradient steps of single documents, and end where no step changes anything."""
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.4, 0.4, 0.4], 60)
    n = rng.integers(1, 80, 60).astype(float)
    rows = spark.createDataFrame([(int(k), [float(v) for v in x]) for k, x in zip(n, p, strict=True)], "n_tokens long, posterior array<double>")
    model = mixing.DomainModel(["a", "b", "c"], np.ones(3) / 3, np.zeros((1, 3)))
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    rates = mixing.fit_rates(rows, model, shares)
    target = np.array([0.5, 0.3, 0.2]) * n.sum()
    rate, ahead, pace = [1.0] * 60, [1.0] * 60, 1.0
    present = [sum(n[i] * p[i][d] for i in range(60)) for d in range(3)]
    for _, anew in rates.steps:
        if anew:
            ahead, pace = rate, 1.0
        e = [sum(ahead[i] * n[i] * p[i][d] for i in range(60)) for d in range(3)]
        new = [max(0.0, ahead[i] - sum(p[i][d] * (e[d] - target[d]) / present[d] for d in range(3))) for i in range(60)]
        following = (1 + math.sqrt(1 + 4 * pace**2)) / 2
        ahead = [x + (pace - 1) / following * (x - y) for x, y in zip(new, rate, strict=True)]
        rate, pace = new, following
    assert np.allclose(rates.of(p), rate, atol=1e-9)
    assert rates.converged and np.allclose((np.array(rate) * n) @ p, target, rtol=1e-4)


def test_rates_out_of_reach_settle_at_the_least_squares(spark):
    """Where a least rate keeps targets out of reach, no other allowed rates come much closer; that they are missed is told."""
    rng = np.random.default_rng(7)
    p = rng.dirichlet([0.3, 0.3, 0.3], 40)
    n = rng.integers(1, 80, 40).astype(float)
    rows = spark.createDataFrame([(int(k), [float(v) for v in x]) for k, x in zip(n, p, strict=True)], "n_tokens long, posterior array<double>")
    model = mixing.DomainModel(["a", "b", "c"], np.ones(3) / 3, np.zeros((1, 3)))
    with pytest.warns(UserWarning, match="not settled"):
        rates = mixing.fit_rates(rows, model, {"a": 0.8, "b": 0.1, "c": 0.1}, least=0.6)
    present, target = n @ p, np.array([0.8, 0.1, 0.1]) * n.sum()
    miss = lambda r: (((r * n) @ p - target) ** 2 / present).sum()
    best = np.ones(40)
    for _ in range(20000):  # plain projected gradient, until nothing moves
        best = np.maximum(0.6, best - p @ (((best * n) @ p - target) / present))
    assert rates.of(p).min() >= 0.6 and miss(rates.of(p)) - miss(best) <= 0.02 * (miss(np.ones(40)) - miss(best))


HARD = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_removed string, score string, __id string, __row string, __rate string, __n string, __copy string, __text string, __places string, __kept string, posterior string, `own` string, stay string, page string, h string, line string"


def hard_table(spark, rows):
    extra = [f"x{k}" for k in range(HARD.count("string") - 3)]
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), *extra) for i, t in rows], HARD)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with hard documents and one without rows."""
    own, none = (str(tmp_path_factory.mktemp(n)) for n in ("hard", "none"))
    hard_table(spark, hard_rows()).write.mode("overwrite").parquet(f"{own}/documents.parquet")
    hard_table(spark, []).write.mode("overwrite").parquet(f"{none}/documents.parquet")
    labels = [(i, int(i % 9 > 0), int(i % 7 == 0)) for i in range(0, 40)]
    for d, rows in ((own, labels), (none, [])):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{d}/labels.parquet")
    return own, none


def key(r):
    return str((r.doc_id, r.text))


def test_pipeline_of_hard_rows(spark, folder):
    """Each stage, on what the one before left, against a plain version; columns with clashing names come through."""
    own, _ = folder
    docs = common.table(spark, own, "documents")
    columns, cut = docs.columns, common.Cuts(spark)
    (_, quality), (_, lines), (_, near), (_, mixed), (_, packed) = corpus_pipeline.STAGES
    first = cut(quality(spark, docs, own), "quality")
    model = quality_gam.fit_quality(docs, common.table(spark, own, "labels"), F.lit(True))
    score = {key(r): model.score(np.array([slow_features(r.text)]))[0] for r in docs.collect() if r.text is None or len(r.text) < 6000}
    left = sorted(key(r) for r in first.collect() if key(r) in score)
    assert left == sorted(key(r) for r in docs.collect() if score.get(key(r), 0) >= corpus_pipeline.QUALITY)
    second = cut(lines(spark, first, own), "lines")
    assert second.columns == first.columns == columns and second.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    judged = line_dedup.line_dedup(first, 1)
    assert judged.columns == [c for c in columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    kept = [r for r in judged.collect() if not (r.n_removed > 0 and not r.text.strip(" "))]
    assert sorted(key(r) for r in second.collect()) == sorted(map(key, kept))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.own == "x12" for r in second.collect())
    third = cut(near(spark, second, own), "near")
    rows = [(r.doc_id, r.text) for r in second.collect()]
    assert third.columns == columns and third.count() == one_each(rows)
    fourth = cut(mixed(spark, third, own), "mixed")
    assert fourth.columns == columns and {key(r) for r in fourth.collect()} == {key(r) for r in third.collect()}
    last = packed(spark, fourth, own).collect()
    encode = packing.encoder(queries.tokenizer_path())
    assert sum(r.length for r in last) == sum(len(encode(r.text or "")) + 1 for r in fourth.collect())


def one_each(rows):
    """How many rows stay: one of each group of linked texts; of empty ones one of each doc_id and text."""
    n, sets = len(rows), []
    for _, t in rows:
        w = [x.lower() if x.isascii() else x for x in (t or "").split()]
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    return len({root(i) for i in range(n) if sets[i]}) + len({rows[i] for i in range(n) if not sets[i]})


def test_pipeline_runs(spark, folder):
    for d in folder:
        out = corpus_pipeline.run(spark, d)
        assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
        assert (out.count() == 0) == (d == folder[1])


def test_operators_take_clashing_columns(spark, folder):
    docs, labels = (common.table(spark, folder[0], n) for n in ("documents", "labels"))
    n = docs.count()
    assert jaccard_join.one_of_each(docs).columns == docs.columns
    mixed = mixing.mix(docs, labels, least=1.0, grow=True)
    assert mixed.columns == docs.columns and mixed.count() >= n
    assert packing.pack(docs, queries.tokenizer_path()).count() >= n
    assert line_dedup.line_dedup(empty(spark)).count() == 0
