"""The ten operators against brute force, round trips and held-out accuracy, with awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanlake.llm import chat, decontam, langid, lm, packing, quality, simhash, token_counts, toxicity, warc
from spanlake.llm.bpe import Encoder, default_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int"
VOCAB = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were her all she there would".split()


def text_of(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(["", "", "s", "ed", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Ordinary documents, exact and near copies, and rows that are null, empty, repeated or very long; two columns have names that operators use too."""
    rng = random.Random(3)
    out = [(i, text_of(rng, rng.randint(1, 300)), rng.choice(["en", "fr"]), "s", 0, "x", 1) for i in range(120)]
    out += [(200 + i, out[7][1], "en", "s", None, None, None) for i in range(20)]
    base = text_of(rng, 600).split()
    for i in range(15):
        copy = list(base)
        copy[rng.randrange(600)] = f"changed{i}"
        out.append((300 + i, " ".join(copy), "en", None, 0, "x", 0))
    out += [(400, None, None, None, None, None, None), (401, "", "en", "s", 0, "", 0), (402, " \n\t ", "en", "s", 0, "", 0), (None, "null id here", "en", "s", 0, "", 0)]
    out += [(403, text_of(rng, 20_000), "en", "s", 0, "", 0), (404, "é" * 3000 + " <|endoftext|> a  b\n\n c ", "fr", "s", 0, "", 0)]
    out += [out[3], out[3]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def same(df, expected):
    assert Counter(map(tuple, df.collect())) == Counter(map(tuple, expected))


def test_encoder_equals_the_tokenizer(rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    texts = [r[1] or "" for r in rows] + ["a  b", " lead", "trail ", "it's 12's don't're", "tab\t x", "\n\n", "x,! y", "日本 語 é́ ü", "a  b", "end. \n new", "' s", "1, 2,"]
    for t, ids in zip(texts, Encoder.of(default_tokenizer()).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_encoder_takes_all_but_added_tokens_by_rank(monkeypatch):
    encoder = Encoder.of(default_tokenizer())
    rng = random.Random(2)
    signs = [*"aaZ\u00e91\u0663,'.s\u65e5\t\n\n  \r\x0b\x1c\x1f\x85\xa0\u2003\u3000\u200b\ufeff", "'s", "'re", " \n", "  "]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 14))) for _ in range(3000)]
    want = encoder._whole(texts)
    slow = []
    monkeypatch.setattr(encoder, "_whole", lambda some: slow.extend(some) or [b""] * len(some))
    assert encoder.encode([*texts, f"a  {encoder.added[0]}"])[:-1] == want
    assert slow == [f"a  {encoder.added[0]}"]


def test_token_counts(docs, rows, none):
    encoder = Encoder.of(default_tokenizer())
    got = token_counts.count_tokens(docs, block_ids=997)
    same(got.select("doc_id", "n_tokens"), [(r[0], len(encoder.encode([r[1] or ""])[0]) // 4) for r in rows])
    spans = defaultdict(list)
    for r in got.collect():
        spans[r["file"]].append((r["ordinal"], r["start"], r["n_tokens"]))
    for x in spans.values():
        x.sort()
        assert [o for o, _, _ in x] == list(range(len(x)))
        assert all(a[1] + a[2] + 1 == b[1] for a, b in zip(x, x[1:]))
    assert token_counts.count_tokens(none).count() == 0


def test_a_separator_that_texts_hold_is_refused(docs, tmp_path):
    mark = 50256  # the vocabulary's own end-of-text token, which row 404 spells out
    with pytest.raises(Exception, match="separator"):
        token_counts.write_token_files(docs, f"file://{tmp_path}/own", eod=mark).count()
    clean = token_counts.write_token_files(docs.filter("doc_id <> 404"), f"file://{tmp_path}/clean", eod=mark)
    assert clean.count() == docs.filter("doc_id <> 404").count()
    assert [token_counts.separator(n) for n in (2, 4)] == [65535, 4294967295]


@pytest.mark.parametrize("block", [1, 3, 8, 1000])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = []
    for k in range(3):
        ids = rng.integers(0, 6, 200 * k).astype("<u4")
        ids.tofile(tmp_path / f"{k}.bin")
        start = 0
        ends = np.flatnonzero(ids == 5).tolist()
        for o, e in enumerate(ends):
            want.append((f"{k}.bin", o, start, e - start, True))
            start = e + 1
        if start < len(ids):
            want.append((f"{k}.bin", len(ends), start, len(ids) - start, False))
    same(token_counts.scan_token_files(spark, str(tmp_path), eod=5, block_ids=block), want)


def test_packing(docs, rows, none, spark):
    encoder = Encoder.of(default_tokenizer())
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append(np.append(np.frombuffer(encoder.encode([r[1] or ""])[0], "<u4"), 2).astype("<u4"))
    got = packing.pack_documents(docs, region=64).collect()
    assert Counter((r["doc_id"], r["piece"]) for r in got) == Counter((d, p) for d, xs in ids.items() for x in xs for p in range(-(-len(x) // 1024)))
    bins = defaultdict(list)
    for r in got:
        x = ids[r["doc_id"]][0]
        assert r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
        assert r["length"] == 1024 or r["piece"] == 0
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in bins.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and sum(x[-1]) <= 1024
    total = sum(len(x) for xs in ids.values() for x in xs)
    assert len(bins) <= 1.08 * -(-total // 1024) + 3
    assert packing.pack_documents(none).count() == 0


def test_genetic_search_beats_or_equals_its_start():
    rng = random.Random(1)
    sizes = [rng.choice([350, 400, 512, 300, 212, 674, 624, 100]) + rng.randint(-9, 9) for _ in range(300)]
    bins, room = [], []
    packing.best_fit(sizes, sorted(range(300), key=lambda i: -sizes[i]), bins, room, 1024)
    best = packing.evolve(sizes, [(bins, room)], seed=4, capacity=1024, generations=60)
    assert sorted(i for b in best[0] for i in b) == list(range(300))
    assert all(sum(sizes[i] for i in b) == 1024 - r and r >= 0 for b, r in zip(*best))
    assert len(best[0]) <= len(bins)


def plain_fingerprint(text, k=4):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + k]).encode(), 42) for i in range(max(1, len(ws) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, bits):
    """component (least index) of each of a list of (id, fp)."""
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_simhash(docs, rows, none):
    rows = [r for r in rows if r[0] is not None]
    fps = [plain_fingerprint(r[1]) for r in rows]
    groups = defaultdict(list)
    for r, c in zip(rows, plain_components(fps, 4), strict=True):
        groups[c].append(r[0])
    name = {d: min(x) for x in groups.values() for d in x}
    same(simhash.near_duplicates(docs.filter("doc_id is not null")), [(r[0], f"{fp:016x}", name[r[0]]) for r, fp in zip(rows, fps, strict=True)])
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(set(name.values()))
    assert kept.filter("doc_id is null").count() == 1
    assert simhash.one_of_each(none).count() == 0


@pytest.mark.parametrize(("cell", "segments"), [(5, 2), (4096, 2), (40, 4), (200, 8)])
def test_simhash_join_finds_every_link(spark, cell, segments):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(400)} | {0, 2**64 - 1, 1, 3, 7}
    for fp in list(fps)[:150]:  # chains of near ones
        for _ in range(rng.randint(1, 6)):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                fp ^= 1 << b
            fps.add(fp)
    fps = sorted(fps)
    df = spark.createDataFrame([(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in enumerate(fps)], "doc_id long, fp long")
    same(simhash.group(df, cell=cell, around=2 * cell, segments=segments).select("doc_id", "component_id"), list(enumerate(plain_components(fps, 4))))


def test_reach_has_one_of_every_pair_of_cells():
    for segments, bits in ((2, 4), (4, 4), (3, 2)):
        steps = set(simhash.reach(segments, bits))
        ball = [s for s in itertools.product(range(-bits, bits + 1), repeat=segments) if 0 < sum(map(abs, s)) <= bits]
        assert all((s in steps) != (tuple(-x for x in s) in steps) for s in ball) and len(steps) * 2 == len(ball)
    assert [simhash.segments_for(n) for n in (10**5, 2 * 10**7, 10**10)] == [2, 4, 8]


def test_one_of_each_keeps_a_row_of_every_group(spark):
    long = "a long text of many words that another row repeats word for word in full"
    rows = [(5, long, "x"), (3, long, "y"), (None, long, "z"), (None, None, "n"), (None, "", "e"), (9, "quite other words stand here", "o"), (9, "nothing in common with that", "p"), (9, "quite other words stand here", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(3, long), (None, got[[g[0] for g in got].index(None)][1]), (9, rows[5][1]), (9, rows[6][1])], key=str)


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 105), (100, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in (100, 101, 105)}) == 1 and got[0] != got[100]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_overlap(rows, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        ws = plain_words(text)
        k = min(window, len(ws))
        for i in range(len(ws) - k + 1 if k else 0):
            windows[tuple(ws[i : i + k])].add(str(item) if item is not None else None)
    for r in rows:
        ws = plain_words(r[1])
        hit, ids = set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(ws) - k + 1):
                if found := windows.get(tuple(ws[i : i + k])):
                    hit |= set(range(i, i + k))
                    ids |= found - {None}
        yield (r[0], len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))


@pytest.mark.parametrize("block_chars", [16_000_000, 400])
def test_decontamination(spark, rows, docs, none, block_chars):
    rng = random.Random(5)
    items = [(i, text_of(rng, rng.choice([1, 2, 3, 5, 9, 10, 11, 30]))) for i in range(12)] + [(2, "SHE there. Would, all"), (None, "changed3"), (50, None), (51, ""), (52, "é" * 3000)]
    planted = [(r[0], (r[1] or "") + " Xx " + items[k % 12][1].upper().replace(" ", "--") if k % 3 == 0 else r[1], *r[2:]) for k, r in enumerate(rows)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(planted, DOCS)
    want = list(plain_overlap(planted, items))
    same(decontam.contamination(frame, bench, block_chars=block_chars), want)
    assert sorted(str(r["doc_id"]) for r in decontam.uncontaminated(frame, bench, block_chars=block_chars).collect()) == sorted(str(w[0]) for w in want if not w[5])
    assert decontam.contamination(none, bench).count() == 0
    same(decontam.contamination(docs, bench.limit(0)).select("doc_id", "n_hit"), [(r[0], 0) for r in rows])


def test_warc_round_trip(spark, rows):
    pages = [(i, f"http://x/{i}\r\nX: y" if i % 2 else None, r[1]) for i, r in enumerate(rows)] + [(None, "u", "only me"), (None, "u", rows[7][1]), (5, "again", rows[5][1])]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    path = __import__("spanlake.llm._base", fromlist=["new_path"]).new_path(spark, "test-warc")
    index = warc.write_archives(df, path, frame_bytes=2000)
    got = warc.read_archives(spark, path, payloads=True)
    largest = {}
    for p, _, html in pages:
        if p is not None:
            largest[html or ""] = max(p, largest.get(html or "", -1))
    want = []
    for p, url, html in pages:
        data = (html or "").encode()
        rep = largest.get(html or "")
        revisit = rep is not None and p != rep
        want.append((p, len(data), __import__("base64").b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", rep if revisit else None, b"" if revisit else data))
    same(got.selectExpr("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").rdd.map(lambda r: (*r[:5], bytes(r[5]))), want)
    stored = {w[0]: w[5] for w in want if w[3] == "response"}
    for r in index.filter("page_id % 20 = 3").collect():
        one = warc.read_record(f"{path}/{r['file']}", r["frame"], r["offset"], r["length"])
        assert one["head"]["WARC-Record-ID"] == f"<{r['record_id']}>" and one["payload"] == (stored.get(r["page_id"], b""))
    # a plain decoder reads the whole file, the seek table being a frame that it skips
    import zstandard

    name = index.first()["file"]
    raw = open(f"{path}/{name}".removeprefix("file:").replace("//", "/"), "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert len(list(warc.parse(plain))) == index.filter(F.col("file") == name).count()
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def plain_counts(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    inside = {i + k for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(rows):
    rng = random.Random(8)
    texts = [r[1] for r in rows] + ["\n".join([text_of(rng, 12)] * 3 + ["a|b é#"]), "w " * 30, " ".join(VOCAB * 3), "a b c d e f g h a b c d e f g h", "x y z\x85"]
    for t in texts:
        assert quality.base_counts(t)[:5] == plain_counts(t), t


def test_quality_verdicts(spark, none):
    rng = random.Random(2)
    made = [(i, text_of(rng, rng.randint(25, 400)), "en", rng.choice(["a", "b", None]), 0, "x", 1) for i in range(300)]
    junk = [(1000 + i, " ".join(w.upper() + "!!##" for w in text_of(rng, 60).split()), "en", "a", 0, "x", 1) for i in range(12)]
    short = [(2000, "too short", "en", "a", 0, "x", 1), (2001, None, None, None, None, None, None), (2002, "", "xx", "a", 0, "", 0), (2003, "w " * 100, "en", "a", 0, "", 0)]
    df = spark.createDataFrame(made + junk + short + made[:2], DOCS)
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert not any(got[r[0]]["kept"] for r in junk + short)
    assert all(got[r[0]]["base_failed"] for r in short)
    assert sum(got[r[0]]["kept"] for r in made) >= 295
    assert quality.judge(df).count() == len(made) + len(junk) + len(short) + 2
    assert quality.judge(none).count() == 0


def test_robust_estimate_is_not_moved_by_outliers(spark):
    rng = np.random.default_rng(0)
    good = rng.multivariate_normal([50_000, 0, 0, 0, 0], np.diag([4e6, 4e4, 1e5, 1e5, 1e6]), 1500)
    bad = rng.multivariate_normal([90_000, 9_000, 0, 0, 0], np.diag([1e5] * 5), 300)
    df = spark.createDataFrame([("g", *map(int, r)) for r in np.concatenate([good, bad])], "lang string, x0 long, x1 long, x2 long, x3 long, x4 long")
    (row,) = quality.robust_estimates(df, ["lang"], [f"x{i}" for i in range(5)]).collect()
    assert abs(row["mean"][0] - 50_000) < 500 and abs(row["mean"][1]) < 200


def test_robust_estimate_withstands_large_groups_of_copies(spark):
    assert math.isclose(quality.consistency(0.5), 1.913, abs_tol=2e-3)
    rng = np.random.default_rng(4)
    made, clean = [], {}
    for share in (0.28, 0.33, 0.4):
        good = rng.multivariate_normal([50_000, 0, 0, 0, 0], np.diag([4e6, 4e4, 1e5, 1e5, 1e6]), 1200)
        bad = rng.multivariate_normal([90_000, 9_000, 3_000, 0, 0], np.diag([1e4] * 5), round(1200 * share / (1 - share)))
        clean[str(share)] = good
        made += [(str(share), *map(int, r)) for r in np.concatenate([good, bad])]
    df = spark.createDataFrame(made, "lang string, x0 long, x1 long, x2 long, x3 long, x4 long")
    got = quality.robust_estimates(df, ["lang"], [f"x{i}" for i in range(5)]).collect()
    assert len(got) == 3
    for r in got:
        mean, inverse = np.array(r["mean"]), np.array(r["inverse"]).reshape(5, 5)
        far = np.array([90_000, 9_000, 3_000, 0, 0]) - mean
        assert far @ inverse @ far > quality.CUT
        (good,) = [g for s, g in clean.items() if s in r["key"]]
        d = good - mean
        assert ((d @ inverse * d).sum(axis=1) <= quality.CUT).mean() > 0.995


def test_estimate_has_the_least_determinant_of_all_halves(spark):
    rng = np.random.default_rng(8)
    made = {}
    for name, far in (("a", 0), ("b", 4), ("c", 6)):
        good = rng.multivariate_normal([0, 0], [[9e8, 4e8], [4e8, 4e8]], 16 - far)
        made[name] = np.concatenate([good, rng.multivariate_normal([4e5, -3e5], np.diag([1e8, 1e8]), far)]).round().astype(int)
    df = spark.createDataFrame([(k, *map(int, r)) for k, x in made.items() for r in x], "lang string, x0 long, x1 long")
    got = {k: r for r in quality.robust_estimates(df, ["lang"], ["x0", "x1"], min_group=1, reweighted=False).collect() for k in made if f'"{k}"' in r["key"]}
    for k, x in made.items():
        halves = [x[list(h)].astype(float) for h in itertools.combinations(range(16), 8)]
        floor = np.diag([(f * quality.UNIT) ** 2 for f in quality.FLOOR[:2]])
        logs = [np.linalg.slogdet(np.cov(h.T, bias=True) * quality.consistency(0.5) + floor)[1] for h in halves]
        # no half is better by more than the classes of distances and local optima allow
        assert sum(v < got[k]["logdet"] - 0.05 for v in logs) <= len(logs) // 1000, k
        best = halves[int(np.argmin(logs))].mean(axis=0)
        assert np.abs(np.array(got[k]["mean"]) - best).max() < 1.5e4, k


def test_gradients_of_the_recurrent_network():
    net = langid.Network(["a", "b", "c"], embed=3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 5, (9, 4)).astype(np.uint8), np.array([2, 0, 1, 1])
    labelled = rng.random(x.shape) < 0.7
    _, g = net.gradients(x, labelled, y)
    for name, v in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(s) for s in v.shape) if name != "embed" else (int(rng.integers(5)), int(rng.integers(3)))
            old, eps = v[at], 1e-5
            v[at] = old + eps
            up = net.gradients(x, labelled, y)[0]
            v[at] = old - eps
            down = net.gradients(x, labelled, y)[0]
            v[at] = old
            assert math.isclose((up - down) / (2 * eps), g[name][at], rel_tol=1e-4, abs_tol=1e-8), name


def test_labels_are_those_of_the_plain_recurrence(monkeypatch):
    tanh, sigmoid = np.tanh, lambda a: (1 + np.tanh(a / 2)) / 2
    net = langid.Network(["a", "b", "c"], embed=3, hidden=4)
    net.p |= {f"bias_{d}": np.linspace(-9, 9, 12).astype(np.float32) for d in "fb"}
    net.p["embed"][7] *= 1000  # gates that are quite open or shut
    x = np.random.default_rng(0).integers(0, 9, (11, 5)).astype(np.uint8)
    p, want = {k: v.astype(np.float64) for k, v in net.p.items()}, np.tile(net.p["out_b"], (11, 5, 1)).astype(np.float64)
    for d, places, out in (("f", range(11), p["out"][:4]), ("b", range(10, -1, -1), p["out"][4:])):
        h = np.zeros((5, 4))
        for t in places:
            a, u = p["embed"][x[t]] @ p[f"in_{d}"] + p[f"bias_{d}"], h @ p[f"rec_{d}"]
            r, z = sigmoid(a[:, :4] + u[:, :4]), sigmoid(a[:, 4:8] + u[:, 4:8])
            h = z * h + (1 - z) * tanh(a[:, 8:] + r * u[:, 8:])
            want[t] += h @ out
    want = np.exp(want) / np.exp(want).sum(axis=2, keepdims=True)
    # a tangent takes twice an exponential's time, and most of the network's time went there
    monkeypatch.setattr(np, "tanh", None)
    got = net.label(x)
    assert got.shape == want.shape and np.abs(got - want).max() < 1e-5


def test_windows_label_every_byte_once():
    texts = [b"abc", b"", bytes(range(97, 120)) * 3, b"x" * 10, b"y" * 11]
    data, labelled, of = langid.windows(texts, window=14, context=2)
    for i, t in enumerate(texts):
        mine = of == i
        assert data[:, mine].T[labelled[:, mine].T].tobytes() == t
        # what stands before and after a window's labelled part is the text there
        padded = b"  " + t + b" " * 20
        for k, w in enumerate(data[:, mine].T):
            assert w.tobytes() == padded[k * 10 : k * 10 + 14].ljust(14)


def test_pooled_probabilities_do_not_depend_on_the_batch():
    net = langid.Network(["a", "b"], embed=3, hidden=4)
    texts = ["one two three " * 60, None, "", "12 ½ ²", "Ünder", "q" * 1000]
    every = langid.pooled(net, texts)
    assert [x[0] for x in every[1:4]] == ["und"] * 3
    for t, want in zip(texts, every, strict=True):
        (got,) = langid.pooled(net, [t])
        assert got[0] == want[0] and math.isclose(got[1], want[1], abs_tol=1e-5)
        if want[0] != "und":
            read, prob = langid.label_positions(net, t)
            assert len(read) == len(prob) and math.isclose(prob.mean(axis=0).max(), want[1], abs_tol=1e-5)


def test_language_id(spark, none):
    rng = random.Random(4)
    parts = {"en": ["th", "ing", "er", "on", "ea"], "de": ["sch", "ung", "ei", "ü", "tz"], "es": ["ción", "ado", "ñ", "os", "ez"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4)))
    made = [(i, " ".join(word(lang) for _ in range(rng.randint(8, 60))).capitalize() + ".", lang, "s", 0, "x", 1) for i, lang in enumerate(rng.choice(list(parts)) for _ in range(400))]
    odd = [(900, None, None, None, None, None, None), (901, "", "en", "s", 0, "", 0), (902, "12 -- 34_!", "en", "s", 0, "", 0), (903, "ung" * 5000, None, "s", 0, "", 0), (904, "„“ — 。 ² ½ Ⅷ", "en", "s", 0, "", 0)]
    df = spark.createDataFrame(made + odd + made[:3], DOCS)
    net = langid.learn(langid.learnable(df).filter("doc_id < 300"))
    got = langid.identify(df, net).collect()
    assert len(got) == len(made) + len(odd) + 3
    by = {r["doc_id"]: r for r in got}
    assert sum(by[r[0]]["lang_pred"] == r[2] for r in made[300:]) >= 97
    assert [by[k]["lang_pred"] for k in (900, 901, 902, 904)] == ["und"] * 4 and by[903]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = langid.keep_identified(df, net)
    assert kept.columns == df.columns and kept.filter("doc_id in (900, 901, 902)").count() == 0 and kept.filter("doc_id < 400").count() >= 395
    assert langid.learn(none) is None and langid.identify(df, None).filter("lang_pred = 'und'").count() == df.count()
    assert langid.identify(none, net).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    make = lambda: {int(t): float(w) for t, w in zip(rng.choice(40, rng.integers(1, 8), replace=False), rng.random(8), strict=False)}
    unit = lambda v: {t: w / math.sqrt(sum(x * x for x in v.values())) for t, w in v.items()}
    examples = [unit(make()) for _ in range(500)] + [unit({1: 1.0})] * 30
    flat = [(i, t, w) for i, e in enumerate(examples) for t, w in e.items()]
    queries = [unit(make()) for _ in range(60)] + [unit({1: 1.0}), {}]
    flatten = [(np.array(list(q), np.int64), np.array(list(q.values()))) for q in queries]
    for common in (2, 16, 1000):
        index = toxicity.BlockMaxIndex(*map(np.array, zip(*flat, strict=True)), len(examples), 40, block=16, common=common)
        for but in (None, 3, 510):
            for q, (cosines, near) in zip(queries, index.nearest(flatten, 15, None if but is None else [but] * len(queries)), strict=True):
                every = sorted((-round(sum(w * e.get(t, 0) for t, w in q.items()), 6), i) for i, e in enumerate(examples) if i != but)
                want = [s for s, _ in every if s < 0][:15]
                assert np.allclose(-cosines, want, atol=2e-6) and but not in near
                assert all(abs(sum(w * examples[i].get(t, 0) for t, w in q.items()) - c) < 2e-6 for c, i in zip(cosines, near, strict=True))
                assert len(set(near.tolist())) == len(near)
                if len(q) == 1:
                    assert list(zip(-cosines, near, strict=True)) == sorted(zip(-cosines, near, strict=True))


def test_neighbours_are_those_of_plain_tf_idf(spark):
    rng = random.Random(12)
    texts = [text_of(rng, rng.randint(3, 40)) for _ in range(90)] + [None, "", "unseen ¤"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("which" in (texts[i] or ""))) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.learn(df.join(labels, "doc_id"), df, neighbours=5)
    counts = [Counter(re.findall(r"[a-z\u0080-\U0010ffff]+", (t or "").lower())) for t in texts]
    place = {w.decode(): i for i, w in enumerate(model.shared.value.terms.to_pylist())}
    assert set(place) == {w for c in counts[:60] for w in c}
    mark = toxicity.marking(*(np.array([sum(1 for i in range(60) if w in counts[i] and (not only or "which" in texts[i])) for w in place], float) for only in (False, True)), np.mean([int("which" in texts[i]) for i in range(60)]))
    weight = {w: (math.log((1 + len(texts)) / (1 + sum(w in c for c in counts))) + 1) * (toxicity.FLOOR + (1 - toxicity.FLOOR) * mark[i]) for w, i in place.items()}

    def vector(c):
        x = {w: (1 + math.log(n)) * weight[w] for w, n in c.items() if w in weight}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {w: v / norm for w, v in x.items()}

    vectors = [vector(c) for c in counts]
    for r in toxicity.score_documents(df, model).collect():
        q = vectors[r["doc_id"]]
        want = sorted((sum(v * vectors[i].get(w, 0) for w, v in q.items()) for i in range(60)), reverse=True)[:5]
        assert np.allclose([e["cosine"] for e in r["evidence"]], [x for x in want if x > 0], atol=1e-5)
        assert all(abs(sum(v * vectors[e["example"]].get(w, 0) for w, v in q.items()) - e["cosine"]) < 1e-5 for e in r["evidence"])
        assert (r["evidence"] == []) == (not q)


def test_toxicity(spark, none):
    rng = random.Random(6)
    rude = ["grobble", "grobbling", "snarkish", "snarkful"]

    def made(i, bad):
        ws = text_of(rng, rng.randint(20, 200)).split()
        for _ in range(rng.randint(2, 6) if bad else 0):
            ws[rng.randrange(len(ws))] = rng.choice(rude)
        return (i, " ".join(ws), "en", "s", 0, "x", 1), (i, int(bad))

    both = [made(i, i % 8 == 0) for i in range(600)]
    df = spark.createDataFrame([d for d, _ in both] + [(900, None, None, None, None, None, None), (901, "", "en", "s", 0, "", 0), (902, text_of(rng, 9000) + " grobble snarkish grobble", "en", "s", 0, "", 0)], DOCS)
    labels = spark.createDataFrame([x for _, x in both] + [(900, 1), (901, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(df.join(labels, "doc_id").filter("doc_id < 400 or doc_id > 899"), df)
    got = {r["doc_id"]: r for r in toxicity.score_documents(df, model).collect()}
    assert len(got) == 603 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[d[0]]["predicted"] == y[1] for d, y in both[400:])
    assert got[900]["predicted"] == 0 == got[901]["predicted"] and got[902]["predicted"] == 1
    assert got[402]["evidence"] == [] or all(e["cosine"] <= 1 + 1e-9 for e in got[402]["evidence"])
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] == 0 for r in got.values())
    empty = toxicity.learn(none.withColumn("toxic", F.lit(1)), none)
    assert toxicity.score_documents(df, empty).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score_documents(none, model).count() == 0


def test_language_model(spark, docs, rows, none):
    vocab = lm.commonest(lm.word_totals(lm.chunks(docs)))
    want = Counter(w for r in rows for w in lm.words(r[1]))
    assert list(vocab) == [w for w, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))][: lm.COMMON]
    got = {r["doc_id"]: r for r in lm.score_corpus(docs).collect()}
    assert {d: r["n_tokens"] for d, r in got.items()} == {r[0]: len(lm.words(r[1])) for r in rows}
    assert got[400]["log_likelihood"] == 0.0 and got[401]["mean_log_likelihood"] is None
    n = sum(want.values())
    unigram = sum(c * math.log(c / n) for c in want.values()) / n
    mean = sum(r["log_likelihood"] for r in got.values()) / sum(r["n_tokens"] for r in got.values())
    assert mean > math.log(1 / lm.TOKENS) and mean > unigram - 1.5
    assert lm.score_corpus(none).count() == 0


def test_language_model_tells_rare_words_apart(spark):
    common = " ".join(f"w{i}" for i in range(lm.COMMON))
    first = "rare0"
    klass = zlib.crc32(first.encode()) % lm.RARE
    second = next(f"rare{i}" for i in range(1, 100_000) if zlib.crc32(f"rare{i}".encode()) % lm.RARE == klass)
    texts = [common] * 12 + [f"w1 {first} w2"] * 9 + [f"w1 {second} w2"] * 3 + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["log_likelihood"] for r in lm.score_corpus(df, rounds=1).collect()}
    assert len(got) == len(texts)
    # same window and hash class: the scores differ by the words' shares of the class
    assert math.isclose(got[12] - got[21], math.log(9 / 3), rel_tol=1e-6)
    totals = lm.word_totals(lm.chunks(df))
    assert lm.class_totals(totals, lm.commonest(totals))[klass] == 12


def test_chunks_hold_every_word(docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 2000)
    seen = []
    for r in lm.chunks(docs).collect():
        ids, at = np.frombuffer(bytes(r["ids"]), "<u4"), 0
        assert np.bincount(ids, minlength=len(r["words"])).tolist() == r["counts"]
        for name, n in zip(r["doc_ids"], r["lengths"], strict=True):
            seen.append((name, [bytes(r["words"][i]) for i in ids[at : at + n]]))
            at += n
    assert sorted(seen, key=str) == sorted(((r[0], lm.words(r[1])) for r in rows), key=str)


def test_windows_have_every_position():
    tokens, lengths = np.arange(10, 17, dtype=np.uint16), np.array([3, 0, 1, 3])
    context, target = lm.Windows(tokens, lengths)(slice(None))
    e = lm.EDGE
    assert target.tolist() == list(range(10, 17))
    assert context.tolist() == [[e, e, 11, 12], [e, 10, 12, e], [10, 11, e, e], [e, e, e, e], [e, e, 15, 16], [e, 14, 16, e], [14, 15, e, e]]


def test_training_averages_all_tasks_and_learns(spark, docs):
    table = lm.chunks(docs).cache()
    vocab, start = lm.commonest(lm.word_totals(table)), lm.initial()
    alone = []
    for r in table.collect():
        one = spark.createDataFrame([r], table.schema)
        alone.append((sum(r["lengths"]), lm.train_round(spark, one, vocab, start)))
    want = sum(n * w.astype(np.float64) for n, w in alone) / sum(n for n, _ in alone)
    assert len(alone) > 1 and np.allclose(lm.train_round(spark, table, vocab, start), want, atol=1e-5)

    def loss(weights):
        p, total, n = lm.views(weights), 0.0, 0
        for r in table.collect():
            of = lm.Windows(lm.token_of(vocab, [bytes(w) for w in r["words"]])[np.frombuffer(bytes(r["ids"]), "<u4")], np.array(r["lengths"]))
            context, target = of(slice(None))
            total, n = total - lm.log_probabilities(p, lm.hidden(p, context), target).sum(), n + len(target)
        return total / n

    assert loss(lm.train_round(spark, table, vocab, start)) < loss(start) - 0.5


def test_language_model_probabilities_and_gradients():
    p = {k: v.astype(np.float64) for k, v in lm.views(lm.initial()).items()}
    context, target = np.array([[1, 2, 3, 4], [lm.EDGE, lm.EDGE, 7, 100]]), np.array([5, 4000])
    h = lm.hidden(p, context)
    total = sum(np.exp(lm.log_probabilities(p, np.repeat(h[:1], 512, axis=0), np.arange(k, k + 512))).sum() for k in range(0, lm.TOKENS, 512))
    assert math.isclose(total, 1, rel_tol=1e-6)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    loss = lm.gradients(p, g, context, target)
    assert math.isclose(loss, -lm.log_probabilities(p, h, target).mean(), rel_tol=1e-9)
    for name, at in (("embed", (7, 3)), ("hide", (5, 6)), ("hide_b", (2,)), ("klass", (1, 2)), ("klass_b", (3,)), ("word", (62, 4, 32)), ("word_b", (0, 5))):
        old = p[name][at]
        p[name][at] = old + 1e-5
        up = -lm.log_probabilities(p, lm.hidden(p, context), target).mean()
        p[name][at] = old - 1e-5
        down = -lm.log_probabilities(p, lm.hidden(p, context), target).mean()
        p[name][at] = old
        assert math.isclose((up - down) / 2e-5, g[name][at], rel_tol=1e-3, abs_tol=1e-8), name


def test_slopes_of_repeated_words_add_up(monkeypatch):
    rng = np.random.default_rng(3)
    flat = lm.initial()
    context, target = np.where(rng.random((3000, 4)) < 0.1, lm.EDGE, rng.integers(0, 40, (3000, 4))), rng.integers(0, lm.TOKENS, 3000)
    p, one = {k: v.astype(np.float64) for k, v in lm.views(flat).items()}, lm.views(np.zeros(len(flat)))
    want, loss = lm.views(np.zeros(len(flat))), 0.0
    for a in range(0, 3000, 100):
        loss += lm.gradients(p, one, context[a : a + 100], target[a : a + 100]) / 30
    for k in want:
        want[k] += one[k] / 30
    # a batch is one tile, and its slopes meet in place, not in counts of a column at a time
    monkeypatch.setattr(np, "bincount", None)
    got = lm.views(np.zeros_like(flat))
    assert math.isclose(lm.gradients(lm.views(flat), got, context, target), loss, rel_tol=1e-5)
    for k in want:
        assert np.allclose(got[k], want[k], rtol=1e-3, atol=1e-6), k


def test_viterbi_finds_the_best_path():
    hmm = chat.Hmm([])
    features = [f for _, f in chat.observe("User: hi\nmore\n\nAI: yes\n\nno marker here?\nx")]
    logs = sum(hmm.emit[k][:, [f[k] for f in features]] for k in chat.SIZES).T

    def value(path):
        return hmm.move[-1, path[0]] + logs[0, path[0]] + sum(hmm.move[a, b] + logs[i + 1, b] for i, (a, b) in enumerate(zip(path, path[1:])))

    best = max(value(p) for p in itertools.product(range(len(chat.STATES)), repeat=len(features)))
    assert value(hmm.viterbi(features)) == best


def test_long_conversations_are_decoded_as_one(spark):
    rng = random.Random(11)
    rows = []
    for c in range(12):
        for t in range(rng.choice([1, 3, 40, 90])):
            text = rng.choice(["", None, " ", "yes?", text_of(rng, rng.randint(1, 40)).replace(",", "\n"), "User: quoted", "a\n\nAI: b"])
            rows.append((c, rng.choice([t, t, None]) if c == 3 else t, rng.choice(["user", "assistant", "system", "tool", None]), text))
    rows += [(20, t, "user", " ") for t in range(30)] + [(21, 0, "user", " " * t) for t in range(20)] + rows[:5]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    hmm = chat.learn(chat.conversations_as_rows(df))
    parts = chat.conversations_as_rows(df, turns_each=4)
    written = chat.as_transcripts(parts).orderBy("conv_id", "part").collect()
    assert len(written) > 40 and not all(r["whole"] for r in written)
    texts = defaultdict(list)
    for r in written:
        texts[r["conv_id"]].append(r["transcript"])
    want = [(c, i, role, x) for c, ts in texts.items() for i, (role, x) in enumerate(chat.turns(hmm, "\n\n".join(ts)))]
    for some in (parts, parts.withColumn("whole", F.lit(False))):
        same(chat.parse_conversations(some, hmm).select("conv_id", "turn", "role", "text"), want)
    # turns are in order whatever the parts, and every row is there once
    held = [[(t["turn"], t["role"], t["text"]) for t in r["turns"]] for r in parts.orderBy("conv_id", "part").collect()]
    assert Counter(x for h in held for x in h) == Counter((t, r, x) for _, t, r, x in {tuple(r) for r in rows})


def test_chat_roles(spark):
    rng = random.Random(7)
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 8)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text_of(rng, 12 if t % 2 == 0 else 90).replace(",", ",\n") or "x", "clash"))
    odd = [(500, 0, "user", None, ""), (500, 1, None, "who?", ""), (None, 0, "user", "lone", ""), (None, 0, "user", "other", ""), (501, None, "user", "no turn", ""), rows[0], rows[0]]
    df = spark.createDataFrame(rows + odd, "conv_id long, turn long, role string, text string, rendered string")
    grouped = chat.conversations_as_rows(df)
    got = chat.parse_conversations(grouped, chat.learn(grouped)).cache()
    found = {(r["conv_id"], r["turn"]): r for r in got.filter("conv_id < 500").collect()}
    right = sum((r[0], r[1]) in found and found[r[0], r[1]]["role"] == r[2] for r in rows)
    assert right >= 0.97 * len(rows)
    r = next(x for x in rows if x[0] % 7 == 3)
    assert found[r[0], r[1]]["rendered"] == f"<|{r[2]}|>\n{found[r[0], r[1]]['text']}\n<|end|>\n"
    assert got.filter("conv_id is null").count() == 2
    hmm = chat.Hmm([])
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "\n \n"), (4, "Human: a\nb\nAI: c")], "id int, transcript string")
    assert [(r["id"], r["role"], r["text"]) for r in chat.parse_transcripts(odd, hmm, id_cols=("id",)).orderBy("turn").collect()] == [(4, "user", "a\nb"), (4, "assistant", "c")]
    assert chat.parse_transcripts(odd.limit(0), hmm, id_cols=("id",)).count() == 0
