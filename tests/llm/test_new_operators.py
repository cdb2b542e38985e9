"""Packing, resampling and the manifest against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gistmill.llm import kernel, manifest, order, packing, resampling

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string, part int, h string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    None, "", " \n\t", "one", "ONE one", "it's THE U.S.A., 12 345!", "a" * 3000, "é " * 300, "x y z " * 1500, "twice the same", "twice the same",
    "café Ǆ İstanbul ΣΑΣ ß ́x", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "日本語テキスト と 한국어 \u0085x y z", "a\x0bb\x0cc\x1cd", "naïve—“quoted”… 50€ №7 ½",
]


def docs_of(spark, texts, sources=("s",)):
    """Documents with a null id, a repeated row and columns whose names the operators use."""
    rows = [(i, t, "en", sources[i % len(sources)], len(t or ""), "x", 7, None) for i, t in enumerate(texts)]
    rows += [(None, "no id here", None, None, None, None, None, "y"), (1, texts[min(1, len(texts) - 1)], "en", sources[1 % len(sources)], 0, "x", 7, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3), rows


# running sums --------------------------------------------------------------------
def test_before_and_ranked(spark, monkeypatch):
    monkeypatch.setattr(order, "GROUP", 3)
    sums = spark.createDataFrame([(p, g, p + 1) for p in range(10) for g in ("a", "b") if (p + len(g)) % 4], "p int, g string, n long")
    got = {(r.g, r.p): r.base for r in order.before(sums, "p", "n", "g").collect()}
    for (g, p), base in got.items():
        assert base == sum(r.n for r in sums.collect() if r.g == g and r.p < p)
    rng = np.random.default_rng(1)
    rows = [(("a" if x < 700 else f"g{x % 5}"), int(v)) for x, v in zip(range(1000), rng.integers(0, 50, 1000), strict=True)]
    ranks = order.ranked(spark.createDataFrame(rows, "g string, v long"), [F.desc("v")], "g").collect()
    by = defaultdict(list)
    for r in ranks:
        by[r.g].append((r.rank, r.v, r.rows))
    for rows_ in by.values():
        rows_.sort()
        assert [r[0] for r in rows_] == list(range(len(rows_))) and {r[2] for r in rows_} == {len(rows_)}
        assert [r[1] for r in rows_] == sorted((r[1] for r in rows_), reverse=True)


# packing -------------------------------------------------------------------------
@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("width", [7, 2048])
def test_packing(spark, whole, width):
    docs, rows = docs_of(spark, ODD)
    pieces = packing.packed(docs, P.path("word_bpe_49k.json"), width=width).cache()
    got, by, seqs = pieces.collect(), defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    want = Counter((r[0], tuple(whole(r[1]))) for r in rows)
    found = Counter()
    for doc_id, ps in by.items():
        ps.sort(key=lambda r: (r.sequence_id, r.offset))
        ids = []
        for p in ps:  # a repeated row begins anew at 0
            assert p.start == len(ids) and len(p.ids) == 4 * p.length
            ids += np.frombuffer(p.ids, "<u4").tolist()
            if len(ids) == p.doc_tokens:
                found[doc_id, tuple(ids)] += 1
                ids = []
        assert not ids
    assert found == want
    total = sum(len(k[1]) * n for k, n in want.items())
    assert sorted(seqs) == list(range(-(-total // width)))
    for s, ps in seqs.items():
        at = 0
        for p in sorted(ps, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at == (width if s < total // width else total % width)
    made = packing.sequences(pieces, width=width, pad_id=9).collect()
    assert len(made) == len(seqs)
    for s in made:
        ids = np.frombuffer(s.ids, "<u4").tolist()
        assert len(ids) == (s.length if s.length & (s.length - 1) == 0 else width)
        flat = [x for p in sorted(seqs[s.sequence_id], key=lambda r: r.offset) for x in np.frombuffer(p.ids, "<u4").tolist()]
        assert ids == flat + [9] * (len(ids) - len(flat))
        assert [(p.doc_id, p.start) for p in s.pieces] == [(p.doc_id, p.start) for p in sorted(seqs[s.sequence_id], key=lambda r: r.offset)]
    crc = packing.digests(pieces).where("doc_id = 3").first()
    assert crc.ids_crc32 == zlib.crc32(np.array(whole("one")[: crc.length], "<u4").tobytes())


def test_packing_of_nothing(spark):
    assert packing.digests(packing.packed(docs_of(spark, ODD)[0].limit(0), P.path("word_bpe_49k.json"))).count() == 0


def test_long_texts_are_encoded_in_pieces(whole, monkeypatch):
    monkeypatch.setattr(packing, "PIECE_BYTES", 50)
    monkeypatch.setattr(kernel, "GROUP_BYTES", 64)
    monkeypatch.setattr(packing, "CACHED", 5)
    texts = [" ".join(t or "" for t in ODD), "x" * 400 + " y", "The end. " * 200, *[t or "" for t in ODD]]
    enc = packing.WordEncoder(P.path("word_bpe_49k.json"))
    got = [x.tolist() for _, _, ids in packing.text_ids(enc, kernel.strings(pa.array(texts)), 1) for x in ids]
    assert got == [whole(t) for t in texts]


def test_ten_megabytes_of_text(spark, whole):
    text = " ".join(f"Wörter{i % 977}, und it's {i % 89}" for i in range(450_000))
    assert len(text) > 9_000_000
    pieces = packing.packed(spark.createDataFrame([(1, text)], "doc_id long, text string"), P.path("word_bpe_49k.json"))
    row = pieces.agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"), F.count("*").alias("rows")).first()
    assert row.n == row.t and row.rows == -(-row.n // 2048)
    head = pieces.where("start = 0").first()
    assert np.frombuffer(head.ids, "<u4").tolist() == whole(text[:20_000])[: head.length]


# resampling ----------------------------------------------------------------------
def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def brute_resampled(rows, target, buckets, least, percent):
    bucket = lambda fs: Counter(zlib.crc32(f.encode()) % buckets for f in fs)
    held = [(r[0], *features(r[1])) for r in rows]
    s = bucket(f for _, _, fs in held for f in fs)
    t = bucket(f for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, n, fs in held:
        weight = sum(gain[b] * m for b, m in bucket(fs).items()) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    pool = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0], r[1]))
    for i, r in enumerate(pool[: percent * len(pool) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_resampling(spark, rows):
    rng = np.random.default_rng(3)
    texts = ODD + ["w" * 200 + " and " + "v" * 150 + " Über Straße"] + [" ".join(f"W{int(x)}" for x in rng.integers(0, 60, int(n))) for n in rng.integers(1, 60, 80)]
    docs, given = docs_of(spark, texts, ("s", None, "t"))
    target = [None, "", "w1 w2 w3", "w5 and w6 w7 straße"]
    got = resampling.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), buckets=500, least_words=5, percent=40)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows(got) == brute_resampled(given, target, 500, 5, 40)


def test_resampling_of_nothing(spark):
    docs, _ = docs_of(spark, ODD)
    none = spark.createDataFrame([], "text string")
    assert resampling.resampled(docs.limit(0), none).count() == 0
    assert resampling.resampled(docs, none).count() == len(ODD) + 2


def test_long_texts_count_in_pieces(monkeypatch):
    texts = ["Ab cd, ef_gh " * 300, "x" * 700 + " y " + "z" * 90, "é" * 40 + "." + "à la " * 100, ". . . " * 100 + "end"]
    want = [Counter(zlib.crc32(f.encode()) % 997 for f in features(t)[1]) for t in texts]
    for limit in (16, 64, 1 << 20):
        monkeypatch.setattr(resampling, "PIECE_BYTES", limit)
        monkeypatch.setattr(kernel.groups, "__defaults__", (8,))
        for i, (_, _, words, ptr, bucket, n) in enumerate(resampling.counts(kernel.strings(pa.array(texts)), 997)):
            assert words.tolist() == [features(texts[i])[0]]
            assert dict(zip(bucket.tolist(), n.tolist(), strict=True)) == want[i], (limit, i)


# manifest ------------------------------------------------------------------------
def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row[:5]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes, fan):
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j, a in enumerate(at):
            run = nodes[a // fan * fan : a // fan * fan + fan]
            proofs[j].append(("".join(run[: a % fan]), "".join(run[a % fan + 1 :])))
            at[j] = a // fan
        nodes = [sha("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
    return nodes[0], proofs


def brute_manifest(rows, fan):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for held in by.values():
        held.sort(key=lambda r: (r[0] is not None, r[0], leaf(r)))
    subs = [tree([leaf(r) for r in by[s]], fan) for s in names]
    root, tops = tree([s[0] for s in subs], fan)
    out = []
    for name, (sub, proofs), top in zip(names, subs, tops, strict=True):
        for r, proof in zip(by[name], proofs, strict=True):
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                node = leaf((r[0], r[1].translate(LOW), *r[2:]))
            for left, right in proof + top:
                node = sha(left + node + right)
            out.append((r[0], leaf(r), sub, root, sha("".join(a + b for a, b in proof + top)), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("fan", "levels", "n"), [(16, 3, 60), (2, 1, 40), (2, 2, 61), (3, 2, 100), (16, 1, 300)])
def test_manifest(spark, rows, fan, levels, n):
    texts = [ODD[i % len(ODD)] and f"{ODD[i % len(ODD)]} Text {i}" for i in range(n)]
    docs, given = docs_of(spark, texts, ("hot", "hot", "a", "hot", "é", "hot", "Z", None, "hot", ""))
    got = manifest.manifest(docs, tampered=manifest.fifth(F.col("doc_id")), fan=fan, levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute_manifest(given, fan)
    assert rows(got) == want and 0 < sum(not r[-1] for r in want) < n / 2


def test_one_row_many_sources_and_none(spark, rows):
    docs, given = docs_of(spark, ["Only"])
    one = docs.where("doc_id = 0")
    assert rows(manifest.manifest(one)) == [(0, leaf(given[0]), leaf(given[0]), leaf(given[0]), sha(""), leaf(given[0]), True)]
    assert manifest.manifest(docs.limit(0)).count() == 0
    docs, given = docs_of(spark, [f"T{i}" for i in range(50)], tuple(f"s{i}" for i in range(50)))
    assert rows(manifest.manifest(docs, tampered=manifest.fifth(F.col("doc_id")), fan=3, levels=2)) == brute_manifest(given, 3)
