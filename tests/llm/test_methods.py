"""The operators against brute force, exact round trips and planted cases."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from weft.llm import buckets, chunk_dedup, forest, language, line_crf, line_rules, mixing, packing, secret_scan, sharding, simhash  # noqa: E402
from weft.llm.common import components, table  # noqa: E402
from weft.llm.queries import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(spark, rows, source="s"):
    return spark.createDataFrame([(i, t, source if isinstance(source, str) else source[i]) for i, t in enumerate(rows)], "doc_id bigint, text string, source string")


def closed(links):
    """Smallest member of each component of a boolean matrix."""
    comp = np.arange(len(links))
    while True:
        new = np.array([min(comp[i], comp[links[i]].min(initial=comp[i])) for i in range(len(links))])
        if (new == comp).all():
            return comp
        comp = new


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    links = np.zeros((600, 600), bool)
    for a, b in edges:
        links[a, b] = links[b, a] = True
    comp = closed(links)
    assert got == {i: comp[i] for i in {x for a, b in edges if a != b for x in (a, b)}}


# --- 1 secrets ---------------------------------------------------------------------------------

def test_base_spans(spark):
    cases = ['x password = "hunter22" y', "API_KEY:abc123 secret=tok token=short", "token=abcde:secret=longer1", "AKIA" + "A" * 16 + " AKIA123",
             "é" * 5 + " passwd: 'ÄÄ' PaSsWd=zzzzzz", "deadbeef" * 3 + " " + "abc" * 7, "apikey=aaaaaaa" * 700]
    kinds = [k[0] for k in secret_scan.BASE]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r["doc_id"]: r["s"] for r in secret_scan.scanned(texts(spark, cases)).select(
        "doc_id", secret_scan.listed(F.col("base"), kinds).alias("s")).collect()}
    for i, t in enumerate(cases):
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert got[i] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)), t[:40]


def test_entropy_windows(spark):
    rng = random.Random(8)
    kind, alphabet, width, bits = secret_scan.CLASSES[1]
    blobs = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (20, 45, 200)]
    runs = ["aaaa" * 30 + blobs[1] + "b" * 40 + blobs[0] + "1", *blobs]
    got = {r["i"]: [tuple(x) for x in r["w"]] for r in spark.createDataFrame(list(enumerate(runs)), "i int, t string").select(
        "i", secret_scan.windows(F.col("t"), alphabet, width, bits).alias("w")).collect()}
    for i, t in enumerate(runs):
        out = []
        for p in range(len(t) - width + 1):
            if sum(secret_scan.terms(width)[c] for c in Counter(t[p:p + width]).values()) <= secret_scan.most_sum(width, bits):
                if out and p <= out[-1][1]:
                    out[-1][1] = p + width
                else:
                    out.append([p, p + width])
        assert got[i] == [tuple(x) for x in out]


def test_allow_list(spark):
    clean = ["https://example/some-long-path/with_many/words", "a" * 40, "1234567890123456789012345", "123e4567-e89b-12d3-a456-426614174000",
             "Donaudampfschifffahrtsgesellschaft", "2024-01-02_03-04-05-678901"]
    dirty = ["see Zx9KqLm2Pv7RtYw4BnHs8JdF now"]
    got = {r["doc_id"]: len(r["extra"]) for r in secret_scan.scanned(texts(spark, clean + dirty)).collect()}
    assert got == {i: int(i >= len(clean)) for i in range(len(got))}


# --- 2 packing ---------------------------------------------------------------------------------

def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
        assert sum(3 * length > capacity for _, length in own) <= 2
    return len(by)


def test_packing_round_trip(spark):
    docs = table(spark, FOLDER, "documents")
    rows = packing.packed(docs, ids=True).collect()
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for d in docs.collect():
        ids = [*full.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        own = sorted(by[d["doc_id"]], key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == ids
        assert [r["start"] for r in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
        assert all(r["length"] == 2048 for r in own[1:]) and own[0]["length"] <= 2048
        assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in own)
    used = check_packing(rows, 2048)
    assert used <= 1.01 * sum(r["length"] for r in rows) / 2048 + 1


@pytest.mark.parametrize("text", ["", "<|endoftext|> x", "naïve Ünïcode ſ", "日本語 and русский   x", "a\x0b\x1cb", "!" * 3000, "it's  we'll\n\n\tok"])
def test_both_encoders_agree(text):
    _, full = packing._encoders("byte_bpe_50k.json")
    assert packing.token_ids(text) == full.encode(text, add_special_tokens=False).ids


def test_plan_is_a_packing():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([4, 10, 33, 100])
        counts = {x: rng.randint(1, 9) for x in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        where, rows = packing.plan(counts, capacity), []
        for length, n in counts.items():
            own = where[where[:, 0] == length]
            for rank in range(n):
                _, base, first, per, offset = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
                rows.append({"sequence_id": first + (rank - base) // per, "offset": offset + (rank - base) % per * length, "length": length})
        used = check_packing(rows, capacity)
        assert used <= 1.3 * sum(x * n for x, n in counts.items()) / capacity + 1 or max(counts) * 3 > capacity


# --- 3 forest, 9 simhash -----------------------------------------------------------------------

def test_forest_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n = 1500
    x, label = rng.standard_normal((n, 24)), rng.integers(0, 3, n)
    for k in range(300):
        i, j = rng.integers(0, n, 2)
        x[j], label[j] = x[i] + rng.standard_normal(24) * 0.04, label[i]
    x[900:1200], label[900:1200] = x[0] + rng.standard_normal((300, 24)) * 0.1, label[0]
    x[1300:1310], label[1300:1310] = x[1], label[1]
    df = spark.createDataFrame([(i, [float(y) for y in v], int(z)) for i, (v, z) in enumerate(zip(x, label))], "vec_id bigint, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    for sample in (20_000, 200):
        got = sorted(forest.near_duplicates(df, leaf=100, sample=sample).collect(), key=lambda r: r["vec_id"])
        counts = np.array([r["n_links"] for r in got])
        assert (counts <= links.sum(1)).all() and counts.sum() >= 0.99 * links.sum()
        if counts.sum() == links.sum():
            assert [r["component_id"] for r in got] == closed(links).tolist()
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_masks_cover_every_difference():
    rng = random.Random(6)
    for radius in (1, 3, 5):
        family = simhash.masks(radius)
        assert len(family) == 2 ** (radius + 1) - 1
        for _ in range(300):
            bits = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & bits == 0 for m in family)


def plain_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    import xxhash
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark):
    docs = table(spark, FOLDER, "documents")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    want = np.array([plain_print(r["text"]) for r in rows], np.uint64)
    comp = closed(np.bitwise_count(want[:, None] ^ want[None, :]) <= 3)
    got = sorted(QUERIES["op9_simhash"](spark, FOLDER).collect(), key=lambda r: r["doc_id"])
    assert [int(r["fingerprint"], 16) for r in got] == [int(x) for x in want]
    assert [r["component_id"] for r in got] == [rows[c]["doc_id"] for c in comp]


def test_large_buckets_are_compared_by_blocks(spark):
    rng = random.Random(1)
    prints = list({rng.getrandbits(9) << 20 for _ in range(400)})
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id bigint, print bigint")
    tables = df.select(F.col("print").alias("node"), F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("key"))
    edges = buckets.linked(tables, None, simhash._ready, simhash.near_within(1), block=37).filter("node != root").selectExpr("node a", "root b")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    ids = np.array(sorted(prints), np.uint64)
    comp = closed(np.bitwise_count(ids[:, None] ^ ids[None, :]) <= 1)
    assert all(got.get(int(x), int(x)) == int(ids[c]) for x, c in zip(ids, comp))


def varied(rng, words, share):
    return [rng.choice("abcdefgh") * 3 + str(rng.randint(0, 999)) if rng.random() < share else w for w in words]


def near_copies(seed, n_base, n_rows, low=60, high=400):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(low, high))] for _ in range(n_base)]
    rows = [" ".join(w) for w in base]
    rows += [" ".join(varied(rng, rng.choice(base), rng.choice([0.0, 0.002, 0.005, 0.01, 0.03]))) for _ in range(n_rows)]
    sets = [set(simhash._shingles(t.encode().lower().split(), 5).tolist()) for t in rows]
    return rows, np.array([[len(a & b) / len(a | b) for b in sets] for a in sets])


@pytest.mark.parametrize("seed, n_base, n_rows", [(12, 30, 170), (5, 120, 120), (6, 2, 150)])
def test_one_of_each(spark, seed, n_base, n_rows):
    rows, similar = near_copies(seed, n_base, n_rows)
    got = {r["doc_id"] for r in simhash.one_of_each(texts(spark, rows)).collect()}
    want = set(closed(similar >= 0.8).tolist())
    assert want <= got
    assert len(got) <= 1.02 * len(want) + 1


# --- 4 quality, 8 language ---------------------------------------------------------------------

def test_marginals_against_all_paths():
    rng = np.random.default_rng(5)
    evidence, step, counts = rng.standard_normal(9), rng.standard_normal((2, 2)), np.array([4, 1, 3, 1])
    good, log_sum, pairs = line_crf.marginals(evidence, step, counts)
    at, expected = 0, np.zeros((2, 2))
    for k, n in enumerate(counts):
        paths = np.array(np.meshgrid(*[[0, 1]] * n, indexing="ij")).reshape(n, -1).T
        weight = np.exp([(p * evidence[at:at + n]).sum() + sum(step[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert np.isclose(log_sum[k], np.log(weight.sum()))
        assert np.allclose(good[at:at + n], (paths * weight[:, None]).sum(0) / weight.sum())
        for p, w in zip(paths, weight / weight.sum()):
            for a, b in zip(p, p[1:]):
                expected[a, b] += w
        at += n
    assert np.allclose(pairs, expected)


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op4_line_crf"](spark, folder).join(table(spark, folder, "labels"), "doc_id").filter("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert ((got.predicted == 1) == (got.quality == 1)).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op8_language_spans"](spark, folder).join(table(spark, folder, "documents"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(7)
    scores = [rng.standard_normal((n, 3)).astype(np.float32) * 3 for n in (5, 0, 1, 6)]
    for path, s in zip(language.viterbi(scores, 2.0), scores):
        if not len(s):
            assert len(path) == 0
            continue
        paths = np.array(np.meshgrid(*[range(3)] * len(s), indexing="ij")).reshape(len(s), -1).T
        worth = [s[np.arange(len(s)), p].sum() - 2.0 * (p[1:] != p[:-1]).sum() for p in paths]
        assert len(path) == len(s) and np.isclose(max(worth), s[np.arange(len(s)), path].sum() - 2.0 * (path[1:] != path[:-1]).sum())


def test_spans_of_mixed_text(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language.learned(docs)
    part = {r["lang"]: r["text"].replace("\n", " ")[:600] for r in docs.filter("length(text) > 900").orderBy("doc_id").collect()}
    text = part["en"] + " " + part["de"] + " Привет"
    row = language.labelled(texts(spark, [text, "12 34"]), model).orderBy("doc_id").collect()
    spans = [(s["start"], s["end"], s["lang"]) for s in row[0]["spans"]]
    assert {"en", "de"} <= {s[2] for s in spans} and 0.3 < row[0]["score"] < 0.7
    assert abs(next(s[0] for s in spans if s[2] == "de" and s[0] > 300) - 601) < 80
    assert row[1]["lang_pred"] == "und"


# --- 5 line rules ------------------------------------------------------------------------------

def test_line_rules_by_brute_force(spark):
    rng = random.Random(9)
    filler = [" ".join(f"u{rng.randint(0, 10 ** 6)}" for _ in range(30)) for _ in range(400)]
    rows, hosts = [], []
    for i in range(60):
        rows.append("\n".join([rng.choice(filler), "Read  MORE here", *(["menu " * 40] if i % 3 == 0 else []), rng.choice(filler)]))
        hosts.append("ab"[i % 2])
    rows += [rows[0]] * 20
    hosts += [hosts[0]] * 20
    docs = texts(spark, rows, hosts)
    got = {r["doc_id"]: r for r in line_rules.judged(docs, most_texts=8, most_share=0.1).collect()}

    def norm(line):
        return " ".join(line.split()).lower()
    seen = defaultdict(set)
    for t, h in zip(rows, hosts):
        for x in t.split("\n"):
            seen[h, norm(x)].add(t)
    for i, (t, h) in enumerate(zip(rows, hosts)):
        removed = sum(len(x.split()) for x in t.split("\n") if len(seen[h, norm(x)]) > 8)
        words = t.split()
        grams = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        r = got[i]
        assert (r["n_removed_words"], r["n_repeat_words"], r["base_failed"]) == (removed, len(covered), failed)
        assert r["kept"] == (not failed and len(words) - removed >= 0.5 * len(words))
    left = {r["doc_id"]: r["text"] for r in line_rules.cleaned(docs, most_texts=8, most_share=0.1).collect()}
    assert set(left) == {i for i, r in got.items() if r["kept"]} and left
    assert all("MORE" not in t for t in left.values())


def test_count_limit_holds_in_a_large_host(spark):
    rows = [f"{' '.join(f'u{i}x{k}' for k in range(60))}\n{'All rights reserved.' if i < 31 else f'own {i}'}\n{'Just below.' if i < 30 else f'too {i}'}" for i in range(1600)]
    left = [r["text"] for r in corpus_pipeline.quality_rules(spark, texts(spark, rows), FOLDER).collect()]
    assert len(left) == 1600 and not any("All rights" in t for t in left)
    assert sum("Just below." in t for t in left) == 30


# --- 6 shards, 7 mixing ------------------------------------------------------------------------

def test_shards_match_the_mixture(spark):
    rows = QUERIES["op6_stratified_shards"](spark, FOLDER).join(table(spark, FOLDER, "documents").select("doc_id", "source"), "doc_id").collect()
    shard = Counter(r["shard"] for r in rows)
    assert max(shard.values()) - min(shard.values()) <= 1
    for k, n in shard.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(n))
    own = Counter((r["source"], r["shard"]) for r in rows)
    for source, n in Counter(r["source"] for r in rows).items():
        assert all(abs(own[source, k] - n / 8) <= 2 for k in range(8))


def test_shards_as_files(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    sharding.write_shards(docs, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("row.*").exceptAll(docs).isEmpty() and docs.exceptAll(got.select("row.*")).isEmpty()
    assert got.select("shard").distinct().count() == 8


def test_targets_stop_and_share(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 50), (None, 40)], "_s string, source_size bigint")
    got = {r["_s"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20.0 and sum(got.values()) == pytest.approx(300.0)
    assert all(got[s] <= 2 * n for s, n in (("a", 10), ("b", 100), ("c", 50), (None, 40)))


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [" ".join(["w"] * rng.randint(1, 40)) for _ in range(3000)]
    docs = texts(spark, rows, [rng.choice("xyz") for _ in rows])
    rates = mixing.rates(docs).withColumn("taken", F.col("size") * F.col("copies"))
    for r in rates.groupBy("target").agg(F.sum("taken").alias("taken")).collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.05)
    emitted = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    assert emitted == Counter({r["doc_id"]: r["copies"] for r in rates.collect() if r["copies"]})


# --- 10 chunks ---------------------------------------------------------------------------------

def chunked(text):
    """Word-line numbers of each chunk, and whether it is compared."""
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if WORD.search(x)]
    h = [int(hashlib.md5(lines[i].encode()).hexdigest()[:8], 16) for i in at]
    long = [len(WORD.findall(lines[i])) >= 50 for i in at]
    r = [h[k] + 31 * (h[k - 1] if k else 0) for k in range(len(at))]
    out, last = [], 0

    def edge(k):
        return not 0 <= k < len(at) or long[k]
    for k in range(len(at)):
        low = not edge(k - 1) and not edge(k + 2) and r[k] < r[k - 1] and r[k] <= r[k + 1] if 0 < k < len(at) - 1 else False
        if k == len(at) - 1 or edge(k) or edge(k + 1) or low:
            out.append((at[last:k + 1], k > last or long[k] or len(at) == 1))
            last = k + 1
    return lines, out


def left_by_chunks(rows):
    """What stays of each row by the rule, one row after the other."""
    first, want = {}, {}
    for d, t in enumerate(rows):
        lines, spans = chunked(t)
        gone = set()
        for pos, (places, compared) in enumerate(spans):
            bytes_ = "\n".join(lines[i] for i in places)
            if not compared:
                continue
            if bytes_ not in first:
                first[bytes_] = d, pos
                continue
            d0, p0 = first[bytes_]
            lines0, spans0 = chunked(rows[d0])
            start, end = places[0], places[-1]
            if pos and p0:
                for i, j in zip(spans[pos - 1][0][::-1], spans0[p0 - 1][0][::-1]):
                    if lines[i] != lines0[j]:
                        break
                    start = i
            if pos + 1 < len(spans) and p0 + 1 < len(spans0):
                for i, j in zip(spans[pos + 1][0], spans0[p0 + 1][0]):
                    if lines[i] != lines0[j]:
                        break
                    end = i
            gone |= set(range(start, end + 1))
        left = [x for i, x in enumerate(lines) if i not in gone]
        want[d] = "\n".join(left) if not gone or any(WORD.search(x) for x in left) else ""
    return want


@pytest.mark.parametrize("window", ["query", "stage"])
def test_chunks_by_brute_force(spark, window):
    rng = random.Random(10)
    pool = [f"line {i} has some words" for i in range(60)] + ["", "  "]
    rows = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    passage = [f"passage {k} of a shared text" for k in range(12)]
    rows += ["\n".join([*rng.sample(pool, 3), *passage, *rng.sample(pool, 3)]) for _ in range(20)]
    long = " ".join(f"long{k}" for k in range(50))
    rows += ["\n".join([f"before {i}", *passage[:5], f"after {i}", long, f"end {i}", *rows[rng.randint(0, 50)].split("\n")]) for i in range(20)]
    rows += rows[:30] + ["a\n\nb", "x\na\nb\ny", "same\nsame\nsame", "alone", "alone", long, long + "\nx"]
    want = left_by_chunks(rows)
    docs = texts(spark, rows)
    if window == "query":
        got = {r["doc_id"]: r for r in chunk_dedup.deduplicated(docs).collect()}
        assert {i: r["text"] for i, r in got.items()} == want
        assert all(r["n_removed_lines"] >= 9 for i, r in got.items() if 61 <= i < 80)
    else:
        assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, FOLDER).collect()} == want


def test_repeated_runs_go_whole(spark):
    passage = [f"passage {k} of a text that is shared" for k in range(9)]
    long = " ".join(f"long{k}" for k in range(50))
    rows = ["\n".join(f"own {i} line {k}" for k in range(1 + i % 7)) for i in range(40)]
    rows += rows + ["\n".join([f"before {i}", *passage, f"after {i}", long, f"end {i}"]) for i in range(30)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, texts(spark, rows), FOLDER).collect()}
    assert all(got[i] == "" for i in range(40, 80))
    for i in range(81, 110):
        assert long not in got[i] and len(got[i].split("\n")) <= 3 + 3 and {f"before {i - 80}", f"after {i - 80}", f"end {i - 80}"} <= set(got[i].split("\n"))
    assert {x for t in rows for x in t.split("\n") if x.strip()} == {x for t in got.values() for x in t.split("\n") if x.strip()}
