"""The training-data operators against brute force, round trips and hard rows."""

import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat_prefix, common, jaccard_join, line_dedup, media_mpeg, mixing, packing, quality_gam, simhash, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, row long"
VOCABULARY = [f"w{k}" for k in range(60)]


def words(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def hard_rows(seed=1):
    """Random texts with copies, near copies, nulls, empty and long texts, repeated rows and a null id."""
    rng = random.Random(seed)
    base = [words(rng, rng.choice([1, 2, 5, 30, 80, 200])) for _ in range(30)]
    texts = list(base)
    for t in base[:12]:
        texts.append(t)
        parts = t.split(" ")
        parts[rng.randrange(len(parts))] = "changed"
        texts.append(" ".join(parts))
        texts.append(words(rng, 10) + "\n" + t + "\r\n\t" + words(rng, 30))
    texts += [None, "", "   ", "\n\n", "é ü 漢字 \U0001f600 ABC", words(rng, 5000), "x" * 20000]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (5, "other text of the same id " + base[0]), (None, base[1])]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 9) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, hard_rows())


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in w]
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d if d is not None else -1, len(s), (least.get(find(i), -1) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, docs, n, percent):
    got = jaccard_join.jaccard_components(docs, n, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(hard_rows(), n, percent)


@pytest.mark.parametrize(("threshold", "finer"), [(0.8, False), (0.8, True), (0.9, True), (0.3, False)])
def test_linked_sets_share_a_segment(monkeypatch, threshold, finer):
    """Also where every first cut is too coarse to be sure; and no segment stands for an empty fragment."""
    if finer:
        real = jaccard_join.class_fragments
        monkeypatch.setattr(jaccard_join, "class_fragments", lambda k, t: (real(k, t)[0], real(k, t)[0] + 1))
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 64, int(rng.integers(1, 120)), np.uint64))
        most = int(len(a) * (1 - threshold) / (1 + threshold))  # gone and added alike
        change = int(rng.integers(0, most + 1))
        b = np.unique(np.r_[rng.permutation(a)[change:], rng.integers(0, 1 << 64, change, np.uint64)])
        common_ = len(np.intersect1d(a, b))
        if common_ < threshold * (len(a) + len(b) - common_):
            continue
        x, y = jaccard_join.segment_hashes(a, threshold), jaccard_join.segment_hashes(b, threshold)
        assert len(np.intersect1d(x, y))
    x = [jaccard_join.segment_hashes(np.unique(rng.integers(0, 1 << 64, 40, np.uint64)), threshold) for _ in range(50)]
    assert len(np.unique(np.concatenate(x))) == sum(map(len, x))


def test_jaccard_chain_of_near_copies(spark):
    rng = random.Random(3)
    parts, rows = [f"u{k}" for k in range(120)], []
    for i in range(40):  # each differs from the one before in one word: far ends do not link
        rows.append((100 - i, " ".join(parts)))
        parts[rng.randrange(len(parts))] = f"v{i}"
    got = jaccard_join.jaccard_components(table(spark, rows), 3, 90).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 3, 90)


def test_one_of_each(spark, docs):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 1 and 1 in ids and 30 not in ids  # 30 is the copy of 0, row 3 stands three times
    assert jaccard_join.one_of_each(empty(spark)).count() == 0


def test_one_of_each_tells_components_apart(spark):
    rng = random.Random(11)
    texts = [" ".join(f"c{k}w{rng.randrange(1000)}" for _ in range(30)) for k in range(6)]
    rows = [(None, t) for t in texts[:4]] + [(None, texts[0]), (8, texts[4]), (8, texts[5]), (9, texts[5]), (None, ""), (None, "  "), (4, ""), (4, ""), (4, None)]
    kept = jaccard_join.one_of_each(table(spark, rows)).collect()
    expected = [(None, t) for t in texts[:4]] + [(8, texts[4]), (8, texts[5]), (None, ""), (None, "  "), (4, ""), (4, None)]
    assert sorted(str((r.doc_id, r.text)) for r in kept) == sorted(map(str, expected))


def brute_substrings(rows, width):
    order = sorted(range(len(rows)), key=lambda k: common.NULL_ID if rows[k][0] is None else rows[k][0])
    first = {}
    split = [(t or "").encode().split() for _, t in rows]
    for k in order:
        d = common.NULL_ID if rows[k][0] is None else rows[k][0]
        for s in range(len(split[k]) - width + 1):
            w = tuple(split[k][s : s + width])
            first[w] = min(first.get(w, (d, s)), (d, s))
    out = []
    for k, (d, _) in enumerate(rows):
        mask = [False] * len(split[k])
        for s in range(len(split[k]) - width + 1):
            if first[tuple(split[k][s : s + width])] < (common.NULL_ID if d is None else d, s):
                mask[s : s + width] = [True] * width
        kept = b" ".join(w for w, m in zip(split[k], mask, strict=True) if not m)
        out.append((-1 if d is None else d, len(split[k]), sum(mask), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_substring_dedup(spark, docs, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    got = substring_dedup.substring_dedup(docs, 20, with_text=True).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substrings(hard_rows(), 20)
    assert all(sum(x.end - x.start for x in r.removed) == r.n_removed and hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert all(a.end < b.start for r in got for a, b in zip(r.removed, r.removed[1:], strict=False))
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def brute_lines(rows):
    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        p = q = 0
        while p < min(len(a), len(b)) and a[p] == b[p]:
            p += 1
        while q < min(len(a), len(b)) and a[-1 - q] == b[-1 - q]:
            q += 1
        return p + q >= max(len(a), len(b)) - 1

    at = lambda d, k: (common.NULL_ID if d is None else d, k)
    first = {}
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            line = line.strip(" ")
            if len(line.split(" ")) >= line_dedup.LEAST_WORDS:
                first[line] = min(first.get(line, at(d, k)), at(d, k))
    own = [(x.split(" "), f) for x, f in first.items()]
    gone = {" ".join(a) for a, f in own if any(g < f and near(a, b) for b, g in own)}
    out = []
    for d, t in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for k, x in enumerate(lines) if not (x.strip(" ") in first and (x.strip(" ") in gone or first[x.strip(" ")] < at(d, k)))]
        out.append((-1 if d is None else d, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rng = random.Random(5)
    lines = [words(rng, rng.choice([2, 5, 6, 12, 40])) for _ in range(40)]
    rows = []
    for i in range(60):
        pick = []
        for _ in range(rng.randrange(1, 6)):
            parts = rng.choice(lines).split(" ")
            k, move = rng.randrange(len(parts)), rng.randrange(5)
            if move == 0:
                parts[k] = f"z{rng.randrange(3)}"
            elif move == 1:
                del parts[k]
            elif move == 2:
                parts.insert(k, "extra")
            pick.append(rng.choice(["", "  "]) + " ".join(parts))
        rows.append((i, "\n".join(pick)))
    rows += [(7, "another text of the same id\n" + lines[0]), rows[3], (None, lines[0]), (90, None), (91, ""), (92, words(rng, 3000))]
    out = line_dedup.line_dedup(table(spark, rows))
    assert out.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "n_lines", "n_removed"]
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_removed, r.text) for r in out.collect()), key=str)
    assert got == brute_lines(rows)
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_line_dedup_of_short_lines(spark):
    rows = [(1, "All rights reserved.\nLes.\n\n \r\na\tb\tc\td\te\tf"), (2, "  Les.\nLas.\n\n \r\na\tb\tc\td\te\tf"), (3, "All rights reserved.\nAll rights observed.\nLes."), (None, "Las.")]
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.line_dedup(table(spark, rows), least_exact=1).collect()}
    assert got == {1: (0, rows[0][1]), 2: (3, "\n \r"), 3: (2, "All rights observed."), None: (0, "Las.")}


def test_audio_round_trip(spark, docs):
    got = media_mpeg.audio_features(media_mpeg.store_audio(docs), with_payload=True).collect()
    expected = sorted((-1 if i is None else i, media_mpeg.padded(t)) for i, t in hard_rows())
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.payload)) for r in got) == expected
    assert all(len(p) % 64 == 0 and len(p) for _, p in expected)
    assert all(r.crc_bad == 0 and r.skipped == 0 and r.crc_good == r.n_frames + 1 and r.duration_s == r.n_frames * 1152 / 32000 for r in got)
    assert media_mpeg.store_audio(empty(spark)).count() == 0


def test_audio_damage():
    data = bytearray(media_mpeg.write_stream(bytes(range(1, 255)) * 40))
    whole = media_mpeg.read_stream(bytes(data))
    assert whole["table"]["frames"] == whole["n_frames"] and whole["table"]["bytes"] == len(data) - (len(data) - whole["table"]["bytes"])
    at = int(whole["offsets"][2])
    data[at + 4] ^= 0xFF  # a wrong checksum
    assert media_mpeg.read_stream(bytes(data))["crc_bad"] == 1
    data[at] = 0  # a lost header: the next one is found again
    lost = media_mpeg.read_stream(bytes(data))
    assert lost["n_frames"] == whole["n_frames"] - 1 and lost["skipped"] > 0
    joined = media_mpeg.read_stream(b"junk\xff\xfb" + media_mpeg.write_stream(b"abc")[30:] + b"TAG" + bytes(125))
    assert joined["n_frames"] >= 1 and joined["skipped"] > 0
    assert media_mpeg.read_stream(b"")["n_frames"] == 0 and media_mpeg.read_stream(None)["payload"] == b""


def test_audio_vbri_table():
    frames = [bytes(media_mpeg.frame(9)) for _ in range(4)]
    table = bytearray(frames[0])
    toc = struct.pack(">HHH", 7, 8, 9)
    table[36 : 36 + 26 + len(toc)] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 4 * len(table), 3, 3, 1, 2, 1) + toc
    got = media_mpeg.read_stream(bytes(table) + b"".join(frames[1:]))
    assert got["table"] == {"bytes": 4 * len(table), "frames": 3, "toc": zlib.crc32(toc)}
    assert got["n_frames"] == 3 and got["samples"] == 3 * 1152 and got["offsets"].tolist() == [len(table) * k for k in (1, 2, 3)]


@pytest.mark.parametrize(("mode", "extension", "side"), [(3, 0, 16), (0, 0, 32), (1, 0, 18), (1, 2, 22)])
def test_audio_layer_one_checksums(mode, extension, side):
    size = 12000 * 384 // 32000 * 4
    one = bytearray(size)
    one[:4] = bytes([0xFF, 0xFE, 12 << 4 | 2 << 2, mode << 6 | extension << 4])
    one[6 : 6 + side] = bytes(range(1, side + 1))
    crc = 0xFFFF
    for byte in [*one[2:4], *one[6 : 6 + side]]:  # bit by bit
        for k in range(8):
            crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ byte >> (7 - k)) & 1 else 0)) & 0xFFFF
    one[4:6] = crc.to_bytes(2, "big")
    got = media_mpeg.read_stream(bytes(one) * 3)
    assert (got["n_frames"], got["samples"], got["crc_good"], got["crc_bad"]) == (3, 3 * 384, 3, 0)
    one[7] ^= 1
    assert media_mpeg.read_stream(bytes(one) * 3)["crc_bad"] == 3


def test_simhash(spark):
    rows = [(i, t) for i, t in hard_rows() if i is not None]
    rows = list({i: (i, t) for i, t in rows}.values())
    got = {r.doc_id: r for r in simhash.simhash(table(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        changed = simhash.edited(t, following)
        prints = simhash.fingerprints(pa.array([t, changed, following]))
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i].fingerprint == prints[0].tobytes().hex() and got[i].edited_fingerprint == prints[1].tobytes().hex()
        assert got[i].near_next == simhash.likeness(prints[:1], prints[2:])[0]
    assert simhash.simhash(empty(spark)).count() == 0
    assert simhash.simhash(table(spark, [(1, "a b c d e f")])).first().near_next == 1.0
    every = simhash.with_neighbours(simhash.simhash(table(spark, hard_rows())), F.col("doc_id") % 2 == 0, 3).collect()
    assert len(every) == len(hard_rows())
    for r in every:
        near = [x for x in every if (int(x.fingerprint, 16) ^ int(r.fingerprint, 16)).bit_count() <= 3]
        assert r.n_within == (len(near) - 1 if r.doc_id is not None and r.doc_id % 2 == 0 else None)


def test_ranges_of_a_hot_id(spark):
    """A third of all rows have one doc_id: their parts follow the hash, in order, and none holds them all."""
    rng = random.Random(5)
    rows = [(7 if rng.random() < 0.34 else rng.randrange(-(10**6), 10**6), rng.randrange(-(2**63), 2**63)) for _ in range(3000)] + [(7, -(2**63)), (7, 2**63 - 1)]
    df = spark.createDataFrame(rows, "key long, turn long")
    for n in (1, 4, 300):
        quantiles = [sorted(k for k, _ in rows)[len(rows) * i // n] for i in range(1, n)]
        got = df.withColumn("part", simhash.part_of(F.col("key"), F.col("turn"), quantiles)).orderBy(F.desc("key"), F.desc("turn")).collect()
        parts = [r.part for r in got]
        assert parts == sorted(parts) and min(parts) == 0 and max(parts) < n
        sizes = [parts.count(p) for p in set(parts)]
        assert max(sizes) <= 3 * len(rows) / n + 20


def test_simhash_of_a_hot_id(spark, monkeypatch):
    """Each row's next is the row after it by id, then hash, then text, wherever ranges are cut."""
    monkeypatch.setattr(simhash, "RANGE_BYTES", 1 << 10)
    rng = random.Random(6)
    rows = [(7 if i % 3 == 0 else None if i % 11 == 0 else i, " ".join(rng.choices("abcdefghij", k=rng.randrange(0, 40)))) for i in range(600)]
    docs = table(spark, rows)
    placed, n = simhash.with_next(docs.select("doc_id", "text"))
    own = [(r.part, r.key, r.turn, r.doc_id, r.text) for r in placed.where("own = 1").collect()]
    assert len({p for p, key, *_ in own if key == 7}) > n // 8
    order = sorted(own, key=lambda r: (-r[1], -r[2], r[4]))
    assert [r[0] for r in order] == sorted(r[0] for r in own)
    want = sorted(((r[3], hashlib.sha256(simhash.edited(r[4], order[(i + 1) % len(order)][4]).encode()).hexdigest()) for i, r in enumerate(order)), key=str)
    assert sorted(((r.doc_id, r.edited_sha256) for r in simhash.simhash(docs).collect()), key=str) == want


def test_neighbours_name_the_found(spark):
    a, b, c = "0" * 32, "0" * 31 + "7", "f" * 32
    prints = spark.createDataFrame([(2, a), (4, a), (1, b), (3, b), (6, c), (None, a)], "doc_id long, fingerprint string")
    got = {r.doc_id: (r.n_within, r.near and [tuple(x) for x in r.near]) for r in simhash.with_neighbours(prints, F.col("doc_id") % 2 == 0, 14).collect()}
    assert got == {2: (4, [(0, a), (3, b)]), 4: (4, None), 6: (0, [(0, c)]), 1: (None, None), 3: (None, None), None: (None, None)}


def test_within_radius(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(128) for _ in range(60)]
    for x in base[:30]:
        for n in range(1, 6):
            y = x
            for b in rng.sample(range(128), n):
                y ^= 1 << b
            base.append(y)
    prints = [f"{x:032x}" for x in base]
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    got = {(r.query, r.found): r.distance for r in simhash.within_radius(df.limit(40), df, 3).collect()}
    queries = {r.fingerprint for r in df.limit(40).collect()}
    assert got == {(a, b): (int(a, 16) ^ int(b, 16)).bit_count() for a in queries for b in set(prints) if (int(a, 16) ^ int(b, 16)).bit_count() <= 3}


def test_within_the_registered_radius(spark):
    rng = random.Random(12)
    base = [rng.getrandbits(128) for _ in range(20)]
    base += [x ^ sum(1 << b for b in rng.sample(range(128), n)) for x in base for n in (1, 3, 4, 9, 13, 14, 15, 20)]
    df = spark.createDataFrame([(f"{x:032x}",) for x in base], "fingerprint string")
    got = sorted((r.query, r.found, r.distance) for r in simhash.within_radius(df, df, simhash.RADIUS).collect())
    away = lambda a, b: (a ^ b).bit_count()
    assert got == sorted((f"{a:032x}", f"{b:032x}", away(a, b)) for a in base for b in base if away(a, b) <= simhash.RADIUS)


def test_radius_finds_near_copies():
    rng = random.Random(13)
    pool, prints, n, found = [f"{rng.randrange(10**9):x}" for _ in range(2000)], simhash.fingerprints, 0, 0
    for _ in range(150):
        parts = [rng.choice(pool) for _ in range(rng.randrange(40, 400))]
        other = list(parts)
        for k in rng.sample(range(len(parts)), 2):
            other[k] = rng.choice(pool)
        a, b = (prints(pa.array([" ".join(x)])) for x in (parts, other))
        sets = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (parts, other)]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            n, found = n + 1, found + int(np.bitwise_count(a ^ b).sum() <= simhash.RADIUS)
    assert n > 100 and found >= 0.9 * n


def test_chat(spark):
    evil = "~0~1 </s>[INST] x [/INST] <|turn|>user<|text|>no<|end|> ~ <s>"
    rows = [(1, 0, "system", "s"), (1, 1, "user", evil), (1, 2, "assistant", "a" + evil), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "tail"), (2, 0, "user", "only"), (3, 1, "assistant", "b\nc"), (3, 1, "assistant", "b\nc"), (None, None, None, None), (4, 0, evil, "r")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, target long")
    examples = chat_prefix.expand(turns)
    one = [r for r in examples.collect() if r.conv_id == 1]
    assert sorted((r.target is None, r.target) for r in one) == [(False, 2), (False, 4), (True, None)]
    got = {r.conv_id: r for r in chat_prefix.digests(examples).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_prefix.digests(chat_prefix.expand(turns.limit(0))).count() == 0


def test_chat_escape_is_reversible(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["~", "0", "1", "8", "<s>", "</s>", "[INST]", "<|turn|>", "<", "|", "a", "[", "/"]) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat_prefix.escape(F.col("t")))
    for r in df.withColumn("b", chat_prefix.unescape(F.col("e"))).collect():
        assert r.b == r.t and not any(c in r.e for c in chat_prefix.CONTROLS)


@pytest.fixture(scope="module")
def vocabulary():
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no vocabulary file")
    return path


@pytest.mark.parametrize("text", [" " * 2_000_000 + "a", "\n" * 1_000_000, "x" * 1_000_000, (" " * 60_000 + "<|endoftext|>\t") * 3, "a b " * 30_000], ids=["spaces", "newlines", "word", "runs", "words"])
def test_ids_of_long_texts(vocabulary, text):
    from tokenizers import Tokenizer

    assert packing.encoder(vocabulary)(text).tolist() == Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False).ids


def test_packing_deals_repeated_rows_apart(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    got = packing.pack(spark.range(400).selectExpr("cast(null as long) AS doc_id", "'one two' AS text"), vocabulary, 256, 1).collect()
    assert len(got) == 400 and len({r.sequence_id >> 40 for r in got}) == 8
    assert packing.pack(empty(spark), vocabulary).count() == 0


def test_packing(spark, docs, vocabulary):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary)
    rows = [*hard_rows(), (500, "a <|endoftext|> b  \n\n c"), (501, "don't 'll \x85 　 x")]
    got = packing.pack(table(spark, rows), vocabulary, 256, 1, with_ids=True).collect()
    expected = sorted(str((i, [*tok.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    by = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 256
        by.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    pieces = []
    for (i, n), parts in by.items():
        parts.sort(key=lambda p: p[0])
        copies = len(parts) * 256 // max(256, -(-n // 256) * 256)
        for c in range(copies):
            ids = [x for _, p in parts[c::copies] for x in p]
            pieces.append(str((i, ids)))
            assert len(ids) == n
    assert sorted(pieces) == expected
    seats = {}
    for r in got:
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seats.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack(empty(spark), vocabulary).count() == 0


def test_best_fit_is_tightest():
    rng = random.Random(6)
    lengths = sorted((rng.randrange(1, 101) for _ in range(400)), reverse=True)
    sequence, offset, n = packing.best_fit(lengths, 100)
    room = []
    for k, need in enumerate(lengths):
        fit = [r for r in room if r >= need]
        if fit:
            assert 100 - offset[k] == min(fit)
            room.remove(min(fit))
            room.append(min(fit) - need)
        else:
            assert offset[k] == 0
            room.append(100 - need)
    assert len(room) == n == max(sequence) + 1


def test_quality_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = np.zeros((4000, len(quality_gam.FEATURES)))
    x[:, :4] = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert (0, 1) in model.pairs


def test_quality_hard_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40)], "doc_id long, quality int, toxic int")
    model = quality_gam.fit_quality(docs, labels, F.lit(True))
    got = quality_gam.score_quality(docs, model).collect()
    assert len(got) == len(hard_rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality_gam.keep_good(docs, model, 0.0).count() == len(hard_rows())
    none = quality_gam.fit_quality(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality_gam.score_quality(docs, none).collect()} == {0.5}
    assert quality_gam.score_quality(empty(spark), model).count() == 0


def held_out_accuracy(spark, sf, score, target, held, threshold):
    labels = {r.doc_id: r[target] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score >= threshold, labels[r.doc_id]) for r in score.where(held).collect() if r.doc_id in labels]
    return sum(a == b for a, b in rows) / len(rows)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_gam.fit_quality(docs, labels, quality_gam.fold(F.col("doc_id"), 4) != 2)
    assert held_out_accuracy(spark, sf, quality_gam.score_quality(docs, model), "quality", quality_gam.fold(F.col("doc_id"), 4) == 2, 0.7) > 0.95


def votes_of_dependent_voters(n, seed=1):
    """Rows of a known class with VOTERS votes; the second voter mostly repeats the first."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.1
    v = (rng.random((n, toxicity.VOTERS)) < np.where(y, 0.7, 0.02)[:, None]).astype(float)
    v[:, 1] = np.where(rng.random(n) < 0.95, v[:, 0], v[:, 1])
    return y, v


def test_label_model_finds_accuracies_and_dependence():
    y, v = votes_of_dependent_voters(20000)
    codes, count = np.unique(toxicity.pattern(v), return_counts=True)
    v = toxicity.unpack(codes)
    model = toxicity.fit_label_model(v, count.astype(float), np.where(v.sum(axis=1) > 3, 0.9, 0.05))
    assert abs(model.prior - 0.1) < 0.02
    child = 1 if model.parent[1] == 0 else 0
    assert model.parent[child] == 1 - child
    assert model.fire[1, child, 1] > 0.95 and model.fire[1, child, 0] < 0.1  # given the other's vote
    others = [k for k in range(2, toxicity.VOTERS) if model.parent[k] < 0]
    assert len(others) >= toxicity.VOTERS - 4 and np.abs(model.fire[1, others, 0] - 0.7).max() < 0.05 and model.fire[0, others, 0].max() < 0.04


def slow_posterior(model, votes):
    """Bayes' rule over the two classes, voter by voter."""
    both = []
    for c, share in ((0, 1 - model.prior), (1, model.prior)):
        for k, vote in enumerate(votes):
            rate = model.fire[c][k][int(votes[model.parent[k]]) if model.parent[k] >= 0 else 0]
            rate = min(max(rate, 1e-5), 1 - 1e-5)
            share *= rate if vote else 1 - rate
        both.append(share)
    return both[1] / sum(both)


def test_label_model_against_brute_force():
    _, v = votes_of_dependent_voters(300, 2)
    tree = toxicity.dependence_tree(toxicity.dependence(v, np.stack([np.full(300, 0.9), np.full(300, 0.1)])))
    # one step of estimation, row by row
    q = np.where(v.sum(axis=1) > 3, 0.9, 0.05)
    model = toxicity.maximised(v.astype(int), np.stack([1 - q, q]), tree)
    assert abs(model.prior - (q.sum() + 1) / 302) < 1e-12
    for c in (0, 1):
        for k in range(toxicity.VOTERS):
            w = [(q[i] if c else 1 - q[i]) for i in range(300)]
            rate = (sum(w[i] * v[i, k] for i in range(300)) + 0.1) / (sum(w) + 1)
            for u in (0, 1):
                under = [i for i in range(300) if (v[i, tree[k]] if tree[k] >= 0 else 0) == u]
                assert abs(model.fire[c, k, u] - (sum(w[i] * v[i, k] for i in under) + rate) / (sum(w[i] for i in under) + 1)) < 1e-9
    assert np.allclose(toxicity.sigmoid(model.log_odds(v)), [slow_posterior(model, r) for r in v], atol=1e-9)
    # patterns with counts say what rows say
    codes, at, count = np.unique(toxicity.pattern(v), return_inverse=True, return_counts=True)
    own = toxicity.unpack(codes)
    x, y = toxicity.fit_label_model(v, np.ones(300), q), toxicity.fit_label_model(own, count.astype(float), np.where(own.sum(axis=1) > 3, 0.9, 0.05))
    assert np.allclose(x.fire, y.fire) and (x.parent == y.parent).all()


def slow_tree(information):
    """The edges of a tree of most information, by Kruskal's rule."""
    n = len(information)
    group = list(range(n))
    edges = set()
    for _, i, j in sorted(((-information[i, j], i, j) for i in range(n) for j in range(i)), key=lambda x: x[0]):
        if group[i] != group[j]:
            edges.add((min(i, j), max(i, j)))
            group = [group[j] if g == group[i] else g for g in group]
    return edges


def test_dependence_tree_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        x = rng.random((7, 7))
        x = x + x.T
        parent = toxicity.dependence_tree(x)
        assert {(min(k, p), max(k, p)) for k, p in enumerate(parent) if p >= 0} == slow_tree(x)


def slow_words(text):
    """A text's words and their beginnings, as hashes, with counts."""
    from collections import Counter

    import xxhash

    count = Counter()
    for word in (text or "").encode().split():
        word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word.decode())
        plain = word.strip(toxicity.EDGE).lower()
        count[xxhash.xxh3_64_intdigest(plain)] += 1
        for n in toxicity.PREFIXES:
            h = np.array([xxhash.xxh3_64_intdigest(plain[:n])], np.uint64) + np.uint64(n)
            count[int(common.mix(h)[0])] += 1
    return count


def test_toxicity_against_brute_force(spark, docs):
    rng = random.Random(8)
    rows = [(i, words(rng, 30) + (" grumble" if i % 5 == 0 else "")) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(450)], "doc_id long, quality int, toxic int")
    own = table(spark, rows)
    classifier, model, lexicons = toxicity.fit_toxicity(own, labels, F.lit(True))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(own, classifier).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(450, 600))
    weight = {int(w): x for w, x in zip(classifier.word, classifier.weight, strict=True)}
    for text in [*(t for _, t in rows[:20]), *(t for _, t in hard_rows())]:
        total = classifier.intercept
        for h, n in slow_words(text).items():
            total += sum(x for x, least in zip(weight.get(h, ()), toxicity.COUNTS, strict=False) if n >= least)
        assert abs(classifier.score(pa.array([text], pa.string()))[0] - 1 / (1 + np.exp(-total))) < 1e-9
        vote = toxicity.votes(pa.array([text], pa.string()), lexicons)[0]
        held = slow_words(text)
        fires = {int(k) for w, n, k in zip(lexicons.word, lexicons.least, lexicons.voter, strict=True) if held[int(w)] >= n}
        assert {k for k in range(toxicity.VOTERS - 5) if vote[k]} == fires
    assert toxicity.score_toxicity(docs, classifier).count() == len(hard_rows())
    none, _, _ = toxicity.fit_toxicity(docs, labels.limit(0), F.lit(True))
    assert toxicity.score_toxicity(empty(spark), none).count() == 0
    toxicity.fit_toxicity(empty(spark), labels, F.lit(True))


def test_covering_lexicons_against_brute_force(spark):
    import xxhash

    rng = random.Random(12)
    pool = [f"t{k}" for k in range(12)]
    rows = [(i, i, " ".join(rng.choices(pool[:9] if i % 2 else pool[7:], k=rng.randrange(1, 5)) + words(rng, 5).split()), float(i % 2)) for i in range(200)]
    candidates = sorted((xxhash.xxh3_64_intdigest(w), rng.choice([1, 1, 2])) for w in pool)
    got = toxicity.covering(spark.createDataFrame(rows, "doc_id long, row long, text string, label double"), candidates, 3)
    meets = [{i for i, _, t, _ in rows if slow_words(t)[h] >= least} for h, least in candidates]
    bad, free, expected = {i for i, _, _, y in rows if y}, set(range(len(candidates))), []
    for _ in range(3):
        left, mine = set(bad), []
        while True:
            gain = {k: len(meets[k] & left) - toxicity.CLEAN * len(meets[k] - bad) for k in free if len(meets[k] & left) >= toxicity.LEXICON_ROWS}
            if not gain or max(gain.values()) <= 0:
                break
            best = min(gain, key=lambda k: (-gain[k], k))
            free.discard(best)
            mine.append(candidates[best])
            left -= meets[best]
        expected.append(mine)
    assert got == expected and len(got[0]) > 2 and toxicity.covering(spark.createDataFrame(rows, "doc_id long, row long, text string, label double"), [], 2) == [[], []]


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    classifier, _, _ = toxicity.fit_toxicity(docs, labels, quality_gam.fold(F.col("doc_id"), 5) != 0)
    held = toxicity.score_toxicity(docs, classifier).where(quality_gam.fold(F.col("doc_id"), 5) == 0).join(labels, "doc_id")
    right, told, toxic = held.agg(F.count_if((F.col("score") >= 0.5) & (F.col("toxic") == 1)), F.count_if(F.col("score") >= 0.5), F.count_if(F.col("toxic") == 1)).first()
    assert right / told >= 0.95 and right / toxic >= 0.75


def test_mixing(spark):
    rng = random.Random(9)
    pools = {"aa": [f"a{k}" for k in range(40)], "bb": [f"b{k}" for k in range(40)], "cc": [f"c{k}" for k in range(40)]}
    rows = []
    for i in range(300):
        lang = "aa" if i % 10 < 7 else "bb" if i % 10 < 9 else "cc"
        rows.append((i, " ".join(rng.choice(pools[lang]) for _ in range(rng.randrange(5, 60))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "doc_id long")
    shares = {"aa": 0.4, "bb": 0.3, "cc": 0.3}
    model = mixing.fit_domains(docs, labels)
    members = mixing.members(docs, model)
    rates = mixing.fit_rates(members, model, shares)
    assert np.abs(rates.expected - rates.target).max() < 1e-4 * rates.target.sum()
    out = mixing.mixing_rates(docs, labels, shares=shares).collect()
    langs = {i: lang for i, _, lang in rows}
    assert all(r.domain == langs[r.doc_id] and r.rate >= 0 for r in out)
    mixed = mixing.mix(docs, labels, shares=shares, least=1.0, grow=True)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == set(range(300))
    hard = table(spark, hard_rows())
    assert mixing.mixing_rates(hard, labels.limit(0)).count() == len(hard_rows())
    assert mixing.mixing_rates(empty(spark), labels).count() == 0


def test_mixing_keeps_domains_with_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_DOMAINS", 2)
    rows = [(i, f"{d} {d}{i % 3}", d) for i, d in enumerate(["aa"] * 9 + ["bb"] * 6 + ["cc"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = mixing.mixing_rates(docs, docs.select("doc_id"), shares={"aa": 0.5, "cc": 0.5}).collect()
    assert {r.domain for r in got if r.doc_id >= 15} == {"cc"} and min(r.rate for r in got if r.doc_id >= 15) > 1
    with pytest.raises(ValueError, match="at most 2"):
        mixing.mixing_rates(docs, docs.select("doc_id"), shares={"aa": 0.4, "bb": 0.3, "cc": 0.3})


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.Cuts(spark)(stage(spark, docs, sf), "test-stage")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
        if name != "mixing" and k + 1 < len(corpus_pipeline.STAGES):
            assert docs.count() <= n, name
            n = docs.count()
    assert docs.where("length > 2048 or offset + length > 2048").count() == 0
